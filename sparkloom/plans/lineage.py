"""Columns of each node, without running anything."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from .graph import Graph, Node


def union(lists: Sequence[Sequence[str]]) -> list[str]:
    """All names, in the order first seen."""
    return list(dict.fromkeys(n for x in lists for n in x))


def intersection(lists: Sequence[Sequence[str]]) -> list[str]:
    """The names in every list, in the order of the first."""
    return [n for n in lists[0] if all(n in x for x in lists[1:])] if lists else []


@dataclass(frozen=True)
class Change:
    """What an operation or a node does to a list of columns: it keeps those that pass, under new names, and adds some."""

    adds: Sequence[str] = ()
    drops: Collection[str] = ()
    names: Mapping[str, str] = field(default_factory=dict)
    replaces_all: bool = False

    def __call__(self, columns: Sequence[str]) -> list[str]:
        kept = [] if self.replaces_all else [self.names.get(c, c) for c in columns if c not in self.drops]
        return union([kept, self.adds])


def _code(op: dict) -> Change:
    listed = op.get("output_columns") or [f.split()[0] for f in op.get("output", "").split(",") if f.strip()]
    return Change(adds=listed, replaces_all=bool(listed))


#: Operations that change no column aren't listed.
OPERATIONS: dict[str, Callable[[dict], Change]] = {
    "rename": lambda op: Change(names=op["mapping"]),
    "drop": lambda op: Change(drops=op["columns"]),
    "concat": lambda op: Change(adds=[op["target"]]),
    "code": _code,
}
NODES: dict[str, Callable[[dict], list[Change]]] = {
    "auto_process": lambda c: [OPERATIONS[op["op"]](op) for op in c.get("operations", []) if op.get("op") in OPERATIONS],
    "llm_synth": lambda c: [Change(adds=c.get("output_columns", []) if c.get("output_mode") == "json" else [c.get("output_column", "output")])],
    "http_fetch": lambda c: [Change(adds=list(c.get("extract", {})))],
    "qc": lambda c: [Change(adds=[c.get("status_column", "qc_status"), c.get("feedback_column", "qc_feedback")])],
}


def changes(node: Node) -> list[Change]:
    """All that a node does to its columns, one after the other."""
    return [*NODES.get(node.type, lambda c: [])(node.config), Change(drops=node.config.get("drop_columns", []))]


class Columns(Protocol):
    """What knows the columns of datasets: a catalog does, from its manifests."""

    def columns(self, name: str) -> Sequence[str]: ...


def propagate(graph: Graph, datasets: dict[str, Sequence[str]] | Columns) -> dict[str, dict[str, list[str]]]:
    """{node: {"input": columns, "output": columns}}; datasets gives the columns of each dataset id, or is a catalog.

    Datasets that are stacked offer the columns that all have; branches that
    are merged offer those that any has.
    """
    of = datasets.__getitem__ if isinstance(datasets, dict) else datasets.columns
    out: dict[str, dict[str, list[str]]] = {}
    for name in graph.order():
        node = graph.node(name)
        if node.type == "input":
            came = intersection([list(of(d)) for d in node.config.get("dataset_ids", [])])
        else:
            came = union([out[p]["output"] for p in graph.parents(name)])
        out[name] = {"input": came, "output": reduce(lambda cols, change: change(cols), changes(node), list(came))}
    return out


def merge_warnings(graph: Graph, datasets: dict[str, Sequence[str]] | Columns) -> list[str]:
    """Nodes whose branches share no column, so that merging them must fail."""
    cols = propagate(graph, datasets)
    return [n.id for n in graph.nodes if len(p := graph.parents(n.id)) > 1 and not intersection([cols[x]["output"] for x in p])]
