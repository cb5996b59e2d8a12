"""URL filters as a temporal list join.

List events (a host pattern is put on a list or taken off it on a date) become
validity intervals; each capture is then judged by the entries that were active
when it was fetched.  A pattern covers its host and all hosts below it.

Captures are first reduced to distinct (host, date) pairs with map-side sums,
so a host that holds a third of all captures is judged once a date; its captures,
and the hosts below a pattern that covers very many, stay dealt out in the joins.
Everything is DataFrame code.

Defined cases: of events of one pattern, list and date the removal counts;
adding a listed pattern again changes nothing; an entry is active from its date
to the day before its removal; a null URL, or one without a host, or a null
date is never blocked; captures that repeat are judged each for itself; columns
of captures named host, lists or blocked are replaced, others kept.  Texts of any
length are URLs like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .skew import join_dealt, join_unique


def host_of(url: Column) -> Column:
    """The lower-cased host, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, list, since, until) from events (pattern, list, action, date); until is open or the first day after."""
    clean = events.where("pattern IS NOT NULL AND list IS NOT NULL AND date IS NOT NULL").select(F.lower("pattern").alias("pattern"), "list", "date", (F.col("action") == "add").alias("on"))
    days = clean.groupBy("pattern", "list", "date").agg(F.bool_and("on").alias("on"))
    by = Window.partitionBy("pattern", "list").orderBy("date")
    # one entry's history is a few events; hosts with many captures play no part here
    return days.withColumn("until", F.lead("date").over(by)).where("on").select("pattern", "list", F.col("date").alias("since"), "until")


def verdicts(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, lists (sorted, comma between) and blocked."""
    rows = captures.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), F.col(fetched).cast("date").alias("day"))
    keys = stored(rows.select("host", "day").where("host IS NOT NULL AND day IS NOT NULL").distinct(), "hosts")
    entries = stored(intervals(events), "entries")
    size = F.size(F.split("pattern", r"\."))
    # shorter ends of a host than any pattern, such as its last label, can't match
    shortest = entries.agg(F.min(size)).first()[0] or 1
    labels = F.split("host", r"\.")
    starts = F.sequence(F.lit(1), F.size(labels) - shortest + 1)
    suffixes = F.when(F.size(labels) >= shortest, F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = keys.select("host", "day", F.explode(suffixes).alias("pattern"))
    # very many hosts may lie below one pattern
    weights = stored(parts.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(entries.select("pattern").distinct(), "pattern"), "weights")
    hit = join_dealt(parts, entries, ["pattern"], F.xxhash64("host", "day"), weights).where("since <= day AND (until IS NULL OR day < until)")
    lists = hit.groupBy("host", "day").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    # a host that holds a third of all captures meets its lists once a date
    captured = stored(rows.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n")).join(lists, ["host", "day"]), "lists")
    # the captures of a hot host are dealt out by their own contents
    out = join_unique(rows, captured, ["host", "day"], F.xxhash64(F.to_json("row")), how="left")
    taken = {"host", "lists", "blocked"}
    kept = [F.col("row").getField(c).alias(c) for c in captures.columns if c not in taken]
    return out.select(*kept, "host", F.coalesce("lists", F.lit("")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))
