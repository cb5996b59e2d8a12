"""Table operations: columns, predicates, duplicates, sampling, order and code."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import col, java_regex, not_blank, strict_cast, text_of

from .order import HIDDEN, POS, dense, require, user_columns

#: Places that an exact draw may broadcast: the rows of a sample, or of a table that is shuffled.
EXACT_ROWS = 200_000


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All at once, so names can be swapped; unknown columns are left out; clashes are errors."""
    known = {a: b for a, b in mapping.items() if a in df.columns}
    names = [known.get(c, c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"rename gives more than one column the name {', '.join(twice)}")
    return df.select(*(col(c).alias(n) for c, n in zip(df.columns, names, strict=True)))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(col(c) for c in df.columns if c not in set(columns)))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The known ones of columns, in the order asked for."""
    return df.select(*(col(c) for c in columns if c in df.columns))


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        return df.select(*(value.alias(name) if c == name else col(c) for c in df.columns))
    return df.select("*", value.alias(name))


def concat(df: DataFrame, target: str, columns: Sequence[str], sep: str = "") -> DataFrame:
    """Texts of columns, joined; a null reads None, an unknown column is empty."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return _put(df, target, F.concat_ws(sep, *(text_of(col(c), kinds[c]) if c in kinds else F.lit("") for c in columns)))


def cast(df: DataFrame, column: str, to: str) -> DataFrame:
    """A value that can't be cast fails the query, even where the column isn't used later."""
    if column not in df.columns:
        raise ValueError(f"cast: there is no column {column}")
    return require(_put(df, column, strict_cast(col(column), df.schema[column].dataType, to)), col(column))


def try_cast(df: DataFrame, column: str, to: str) -> DataFrame:
    """As cast, with a null in place of an error."""
    kind = {"str": "string", "int": "bigint", "float": "double"}[to]
    return _put(df, column, col(column).try_cast(kind))


def add_constant(df: DataFrame, name: str, value: str = "") -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return df.select("*", F.lit(value).alias(name))


PREDICATES: dict[str, Callable[[Column, object], Column]] = {
    "min_len": lambda s, v: F.length(s) >= int(v),
    "max_len": lambda s, v: F.length(s) <= int(v),
    "contains": lambda s, v: F.contains(s, F.lit(str(v))),
    "not_contains": lambda s, v: ~F.contains(s, F.lit(str(v))),
    "regex": lambda s, v: s.rlike(java_regex(str(v))),
    "not_empty": lambda s, v: not_blank(s),
    "equals": lambda s, v: s == F.lit(str(v)),
}


def predicate(df: DataFrame, column: str, mode: str, value: object = None) -> Column:
    """A test of a column's text; a null reads None, an unknown column is empty."""
    if mode not in PREDICATES:
        raise ValueError(f"filter mode {mode!r} is unknown")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return PREDICATES[mode](text_of(col(column), kinds[column]) if column in kinds else F.lit(""), value)


def filter_rows(df: DataFrame, column: str, mode: str, value: object = None) -> DataFrame:
    if column in df.columns and isinstance(df.schema[column].dataType, T.StringType) and mode in ("contains", "equals") and "None".find(str(value)) < 0:
        # a plain comparison reaches the scan; a null can't pass it
        return df.where(PREDICATES[mode](col(column), value))
    return df.where(predicate(df, column, mode, value))


def dedup(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row, in order, of each key; nulls are one key; without columns all user columns count.

    Spark prunes each partition to one row a key before it shuffles, so a key
    that holds a third of all rows doesn't gather in one task.
    """
    keys = [col(c) for c in (columns or user_columns(df)) if c in df.columns]
    if not keys:
        return limit(df, 1)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = [F.to_json(k) if isinstance(kinds[c], (T.MapType, T.VariantType)) else k for k, c in zip(keys, [c for c in (columns or user_columns(df)) if c in df.columns], strict=True)]
    first = Window.partitionBy(*keys).orderBy(POS)
    return df.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first n rows."""
    return df.orderBy(POS).limit(n)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, in the order listed, by column name; a column of differing types becomes text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for x in f.schema.fields:
            kinds.setdefault(x.name, set()).add(x.dataType.simpleString())
    out = None
    for i, f in enumerate(frames):
        texts = [c for c in user_columns(f) if len(kinds[c]) > 1]
        f = f.select(*(text_of(col(c), f.schema[c].dataType, None).alias(c) if c in texts else col(c) for c in f.columns))
        if POS in f.columns:
            f = f.withColumn(POS, F.concat(F.array(F.lit(i).cast("bigint")), POS))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def _seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def seed_order(df: DataFrame, seed: int, key: Column | None = None) -> DataFrame:
    """A random order that depends on the seed and each row's key alone."""
    key = F.array_join(F.transform(POS, lambda x: x.cast("string")), ",") if key is None else key.cast("string")
    return df.withColumn(POS, F.array(F.conv(F.substring(_seeded(key, seed), 1, 15), 16, 10).cast("bigint"), F.conv(F.substring(_seeded(key, seed), 16, 15), 16, 10).cast("bigint")))


def sample(df: DataFrame, n: int, seed: int | None = None, key: Column | None = None, exact: bool = False) -> DataFrame:
    """n rows without replacement, in the order drawn; all rows, unchanged, if there aren't more.

    exact draws places from Python's generator, at most EXACT_ROWS of a table of
    any size, which numbers the whole table; else rows are drawn by the order of
    seeded hashes, which scales as a top-n does.
    """
    seed = random.randrange(2**31) if seed is None else seed
    if exact:
        total = df.count()
        if n >= total:
            return df
        if n > EXACT_ROWS:
            raise ValueError(f"an exact sample has at most {EXACT_ROWS} rows; draw with exact=False")
        return _take(df, random.Random(seed).sample(range(total), n))
    if df.limit(n + 1).count() <= n:
        return df
    return limit(seed_order(df, seed, key), n)


def shuffle(df: DataFrame, seed: int | None = None, key: Column | None = None, exact: bool = False) -> DataFrame:
    """All rows in a random order; exact, for at most EXACT_ROWS rows, is the order of Python's generator."""
    seed = random.randrange(2**31) if seed is None else seed
    if exact:
        total = df.limit(EXACT_ROWS + 1).count()
        if total > EXACT_ROWS:
            raise ValueError(f"an exact shuffle takes at most {EXACT_ROWS} rows; shuffle with exact=False")
        places = list(range(total))
        random.Random(seed).shuffle(places)
        return _take(df, places)
    return seed_order(df, seed, key)


def _take(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows at the given places (at most EXACT_ROWS), in that order."""
    picked = df.sparkSession.createDataFrame(pd.DataFrame({"_n": pd.array(places, "int64"), "_rank": pd.array(range(len(places)), "int64")}), "_n long, _rank long")
    return dense(df).join(F.broadcast(picked), "_n").withColumn(POS, F.array("_rank")).drop("_n", "_rank")


Process = Callable[[list[dict]], list[dict]]


def code(df: DataFrame, process: Process, output: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Runs process(rows) on whole groups of rows, in order; output declares the new columns.

    Without partition_by the whole table is one group, as the operation is
    defined; name a key to let groups run side by side.
    """
    fields = T._parse_datatype_string(output)
    names = [f.name for f in fields.fields]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: _plain(v) for k, v in r.items()} for r in g.sort_values(POS, key=lambda s: s.map(tuple)).drop(columns=list(HIDDEN), errors="ignore").to_dict("records")]
        got = process(rows)
        if not isinstance(got, list) or not all(isinstance(r, dict) for r in got):
            raise TypeError("process() must return a list of dicts")
        at = min(map(tuple, g[POS]), default=(0,))
        out = pd.DataFrame([{n: r.get(n) for n in names} for r in got], columns=names)
        out[POS] = [[*at, i] for i in range(len(out))]
        return out

    keys = [col(k) for k in partition_by]
    return df.groupBy(*keys).applyInPandas(run, T.StructType([*fields.fields, T.StructField(POS, T.ArrayType(T.LongType()))]))


def _plain(v):
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    return None if isinstance(v, float) and v != v else v


def apply_operations(df: DataFrame, operations: Sequence[dict], seed: int | None = None, processes: dict[str, Process] | None = None) -> DataFrame:
    """The operations of a node, left to right.  Each draw has a seed of its own, derived from the node's."""
    for i, op in enumerate(operations):
        kind = op.get("op")
        own = seed if seed is None else int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:4], "big") if i else seed
        if kind == "rename":
            df = rename(df, op["mapping"])
        elif kind == "drop":
            df = drop(df, op["columns"])
        elif kind == "concat":
            df = concat(df, op["target"], op["columns"], op.get("sep", ""))
        elif kind == "cast":
            df = cast(df, op["column"], op["to"])
        elif kind == "filter":
            df = filter_rows(df, op["column"], op["mode"], op.get("value"))
        elif kind == "dedup":
            df = dedup(df, op.get("columns"))
        elif kind == "sample":
            df = sample(df, op["n"], own, exact=op.get("exact", False))
        elif kind == "shuffle":
            df = shuffle(df, own, exact=op.get("exact", False))
        elif kind == "code":
            df = code(df, (processes or {})[op["process"]], op["output"], op.get("partition_by", ()))
        else:
            raise ValueError(f"table operation {kind!r} is unknown")
    return df
