"""Pipelines as small graphs: nodes of six kinds, edges that carry rows or send rejects back."""

from __future__ import annotations

import copy
from collections import deque
from dataclasses import dataclass, field

#: The kinds of nodes and edges.
NODE_KINDS = ("input", "auto_process", "llm_synth", "http_fetch", "qc", "output")
NORMAL, RESCAN = "normal", "rescan"


class GraphError(ValueError):
    pass


@dataclass
class Node:
    id: str
    type: str
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    kind: str = NORMAL


@dataclass
class Graph:
    nodes: list[Node]
    edges: list[Edge]

    @staticmethod
    def parse(data: dict) -> Graph:
        try:
            nodes = [Node(str(n["id"]), n["type"], dict(n.get("config") or {})) for n in data["nodes"]]
            edges = [Edge(str(e["source"]), str(e["target"]), e.get("kind") or NORMAL) for e in data["edges"]]
        except (KeyError, TypeError) as e:
            raise GraphError(f"the graph lacks {e}") from None
        return Graph(nodes, edges)

    def dump(self) -> dict:
        return {"nodes": [{"id": n.id, "type": n.type, "config": copy.deepcopy(n.config)} for n in self.nodes], "edges": [{"source": e.source, "target": e.target, "kind": e.kind} for e in self.edges]}

    def node(self, name: str) -> Node:
        for n in self.nodes:
            if n.id == name:
                return n
        raise GraphError(f"there is no node {name}")

    def parents(self, name: str) -> list[str]:
        return [e.source for e in self.edges if e.kind == NORMAL and e.target == name]

    def children(self, name: str) -> list[str]:
        return [e.target for e in self.edges if e.kind == NORMAL and e.source == name]

    def rescan_target(self, name: str) -> str | None:
        return next((e.target for e in self.edges if e.kind == RESCAN and e.source == name), None)

    def _reach(self, name: str, step) -> list[str]:
        seen, todo = set(), deque(step(name))
        while todo:
            n = todo.popleft()
            if n not in seen:
                seen.add(n)
                todo.extend(step(n))
        return [n.id for n in self.nodes if n.id in seen]

    def ancestors(self, name: str) -> list[str]:
        return self._reach(name, self.parents)

    def descendants(self, name: str) -> list[str]:
        return self._reach(name, self.children)

    def order(self) -> list[str]:
        """Parents before children; of nodes that are ready, the first listed goes first."""
        waiting = {n.id: len(self.parents(n.id)) for n in self.nodes}
        ready = deque(n.id for n in self.nodes if not waiting[n.id])
        out = []
        while ready:
            n = ready.popleft()
            out.append(n)
            for c in self.children(n):
                waiting[c] -= 1
                if not waiting[c]:
                    ready.append(c)
        if len(out) < len(self.nodes):
            raise GraphError("the graph has a cycle")
        return out

    def validate(self) -> Graph:
        names = [n.id for n in self.nodes]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise GraphError(f"more than one node has the id {', '.join(twice)}")
        for n in self.nodes:
            if n.type not in NODE_KINDS:
                raise GraphError(f"node {n.id} is of an unknown type, {n.type}")
            count = n.config.get("count")
            if n.type == "output" and count is not None and (isinstance(count, bool) or not isinstance(count, int) or count < 1):
                raise GraphError(f"node {n.id}: count must be a whole number from 1 on")
        for e in self.edges:
            if e.source not in names or e.target not in names:
                raise GraphError(f"an edge from {e.source} to {e.target} leads nowhere")
            if e.kind not in (NORMAL, RESCAN):
                raise GraphError(f"an edge is of an unknown kind, {e.kind}")
            if e.kind == RESCAN and self.node(e.source).type != "qc":
                raise GraphError("only a qc node sends rows back")
        self.order()
        return self

    # editing: each returns a new graph
    def add_node(self, node: Node) -> Graph:
        if any(n.id == node.id for n in self.nodes):
            raise GraphError(f"there is a node {node.id}")
        return Graph([*self.nodes, node], list(self.edges))

    def remove_node(self, name: str) -> Graph:
        self.node(name)
        return Graph([n for n in self.nodes if n.id != name], [e for e in self.edges if name not in (e.source, e.target)])

    def connect(self, source: str, target: str, kind: str = NORMAL) -> Graph:
        edge = Edge(self.node(source).id, self.node(target).id, kind)
        if edge in self.edges:
            raise GraphError(f"{source} and {target} are connected")
        return Graph(list(self.nodes), [*self.edges, edge])

    def disconnect(self, source: str, target: str, kind: str = NORMAL) -> Graph:
        edge = Edge(source, target, kind)
        if edge not in self.edges:
            raise GraphError(f"{source} and {target} aren't connected")
        return Graph(list(self.nodes), [e for e in self.edges if e != edge])

    def configure(self, name: str, **values) -> Graph:
        """Sets keys of a node; a value of None removes its key."""
        self.node(name)
        return Graph([Node(n.id, n.type, {k: v for k, v in {**n.config, **values}.items() if v is not None}) if n.id == name else n for n in self.nodes], list(self.edges))

    def add_operation(self, name: str, operation: dict, at: int | None = None) -> Graph:
        ops = list(self.node(name).config.get("operations", []))
        ops.insert(len(ops) if at is None else at, operation)
        return self.configure(name, operations=ops)

    def remove_operation(self, name: str, at: int) -> Graph:
        ops = list(self.node(name).config.get("operations", []))
        if not 0 <= at < len(ops):
            raise GraphError(f"node {name} has no operation {at}")
        del ops[at]
        return self.configure(name, operations=ops)


def frozen_parts(graph: Graph) -> dict:
    """What a loop towards a goal must leave alone: which data comes in, and how it is judged."""
    return {n.id: (n.type, n.config.get("dataset_ids") if n.type == "input" else n.config) for n in graph.nodes if n.type in ("input", "qc")}


def check_frozen(before: Graph, after: Graph) -> None:
    a, b = frozen_parts(before), frozen_parts(after)
    changed = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
    if changed:
        raise GraphError(f"the inputs and judges can't change: {', '.join(changed)}")
