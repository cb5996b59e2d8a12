"""Rewrites of a graph that Catalyst can't know of."""

from __future__ import annotations

from .graph import Graph, GraphError

#: The keys that can name a stored prompt.
PROMPT_KEYS = ("system_prompt", "user_prompt")


def bind_prompts(graph: Graph, latest: dict[str, str]) -> Graph:
    """Puts the latest body of each stored prompt in place of its reference."""
    for n in list(graph.nodes):
        for key in PROMPT_KEYS:
            ref = n.config.get(f"{key}_ref")
            if ref is None:
                continue
            if str(ref) not in latest:
                raise GraphError(f"node {n.id}: there is no prompt {ref}")
            graph = graph.configure(n.id, **{key: latest[str(ref)], f"{key}_ref": None})
    return graph


def input_caps(graph: Graph) -> dict[str, int]:
    """How many rows each llm_synth node has to work on, because an output takes only so many.

    The cap reaches back through a chain without forks or merges.  It counts
    inputs, failed ones as well, and isn't topped up when later nodes drop rows:
    that is the feature, so it is no limit that Spark could derive.
    """
    caps: dict[str, int] = {}
    for out in graph.nodes:
        count = out.config.get("count") if out.type == "output" else None
        at = out.id
        while count is not None and len(parents := graph.parents(at)) == 1 and len(graph.children(parents[0])) == 1:
            at = parents[0]
            node = graph.node(at)
            if node.type == "llm_synth":
                caps[at] = min(-(-count // node.config.get("fanout_n", 1)), caps.get(at, 1 << 62))
    return caps


def prompt_users(graphs: dict[str, Graph], prompt: str) -> list[tuple[str, str]]:
    """(graph, node) pairs that refer to a stored prompt."""
    return [(g, n.id) for g, x in graphs.items() for n in x.nodes for key in PROMPT_KEYS if str(n.config.get(f"{key}_ref")) == str(prompt)]


def generation_chain(graph: Graph) -> list[str] | None:
    """The nodes of a graph that generates without an input, in order, or None."""
    from sparkloom.operators.generate import is_linear

    if any(n.type == "input" for n in graph.nodes) or not any(n.type == "llm_synth" for n in graph.nodes):
        return None
    order = graph.order()
    straight = all(graph.children(a) == [b] and graph.parents(b) == [a] for a, b in zip(order, order[1:], strict=False))
    if not straight or not is_linear([graph.node(n).type for n in order]):
        return None
    if graph.node(order[-1]).config.get("count") is None:
        raise GraphError("generation needs the output's count")
    return order
