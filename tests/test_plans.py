import pytest

from sparkloom.plans.graph import Graph, GraphError, Node, check_frozen
from sparkloom.plans.lineage import intersection, merge_warnings, propagate, union
from sparkloom.plans.rewrites import bind_prompts, generation_chain, input_caps, prompt_users


def graph(nodes, edges):
    return Graph.parse({"nodes": [{"id": n, "type": t, "config": c} for n, t, c in nodes], "edges": [{"source": e[0], "target": e[1], "kind": e[2] if len(e) > 2 else "normal"} for e in edges]})


CHAIN = [("in", "input", {"dataset_ids": ["d"]}), ("llm", "llm_synth", {"fanout_n": 2}), ("qc", "qc", {}), ("out", "output", {"count": 5})]
LINKS = [("in", "llm"), ("llm", "qc"), ("qc", "out")]


def test_parse_and_dump_round_trip():
    g = graph(CHAIN, LINKS)
    assert Graph.parse(g.dump()) == g
    with pytest.raises(GraphError):
        Graph.parse({"nodes": [{"type": "input"}], "edges": []})
    with pytest.raises(GraphError):
        Graph.parse({"nodes": []})


@pytest.mark.parametrize(
    "nodes, edges",
    [
        ([("a", "input", {}), ("a", "output", {})], []),
        ([("a", "sql", {})], []),
        ([("a", "output", {"count": 0})], []),
        ([("a", "output", {"count": True})], []),
        ([("a", "input", {})], [("a", "b")]),
        ([("a", "auto_process", {}), ("b", "auto_process", {})], [("a", "b"), ("b", "a")]),
        ([("a", "input", {}), ("b", "llm_synth", {})], [("a", "b", "rescan")]),
        ([("a", "input", {}), ("b", "llm_synth", {})], [("a", "b", "odd")]),
    ],
)
def test_bad_graphs_are_refused(nodes, edges):
    with pytest.raises(GraphError):
        graph(nodes, edges).validate()


def test_order_and_reach():
    g = graph([(n, "auto_process", {}) for n in "dcba"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert g.order() == ["a", "b", "c", "d"]
    assert g.ancestors("d") == ["c", "b", "a"]
    assert g.descendants("a") == ["d", "c", "b"]
    assert graph(CHAIN, [*LINKS, ("qc", "llm", "rescan")]).validate().rescan_target("qc") == "llm"


def test_editing_returns_new_graphs():
    g = graph(CHAIN, LINKS)
    h = g.remove_node("qc")
    assert len(h.edges) == 1 and len(g.edges) == 3
    with pytest.raises(GraphError):
        g.connect("in", "llm")
    with pytest.raises(GraphError):
        g.add_node(Node("in", "input"))
    assert g.disconnect("in", "llm").connect("in", "llm").validate()
    k = g.add_node(Node("ops", "auto_process")).add_operation("ops", {"op": "dedup"}).add_operation("ops", {"op": "drop", "columns": []}, 0)
    assert [o["op"] for o in k.node("ops").config["operations"]] == ["drop", "dedup"]
    assert k.remove_operation("ops", 0).node("ops").config["operations"] == [{"op": "dedup"}]
    with pytest.raises(GraphError):
        k.remove_operation("ops", 7)
    with pytest.raises(GraphError):
        check_frozen(g, g.configure("qc", pass_k=2))
    check_frozen(g, g.configure("llm", user_prompt="x"))


def test_lineage():
    g = graph(
        [
            ("in", "input", {"dataset_ids": ["d", "e"], "drop_columns": ["z"]}),
            (
                "ops", "auto_process",
                {"operations": [{"op": "rename", "mapping": {"q": "question"}}, {"op": "concat", "target": "both", "columns": ["question", "a"]}, {"op": "drop", "columns": ["a"]}]}
            ),
            ("llm", "llm_synth", {"output_column": "answer"}),
            ("web", "http_fetch", {"extract": {"title": "t"}}),
            ("out", "output", {"drop_columns": ["both"]}),
        ],
        [("in", "ops"), ("ops", "llm"), ("ops", "web"), ("llm", "out"), ("web", "out")],
    )
    cols = propagate(g, {"d": ["q", "a", "z"], "e": ["a", "z", "q"]})
    assert cols["in"]["output"] == ["q", "a"]
    assert cols["ops"]["output"] == ["question", "both"]
    assert cols["out"]["input"] == ["question", "both", "answer", "title"]
    assert cols["out"]["output"] == ["question", "answer", "title"]
    assert union([["a", "b"], ["b", "c"]]) == ["a", "b", "c"] and intersection([["a", "b"], ["b", "c"]]) == ["b"] and intersection([]) == []
    assert merge_warnings(g, {"d": ["q"], "e": ["q"]}) == []


def test_code_replaces_columns():
    g = graph([("in", "input", {"dataset_ids": ["d"]}), ("ops", "auto_process", {"operations": [{"op": "code", "output": "x bigint, y string"}]})], [("in", "ops")])
    assert propagate(g, {"d": ["q"]})["ops"]["output"] == ["x", "y"]


def test_caps_and_prompts():
    assert input_caps(graph(CHAIN, LINKS)) == {"llm": 3}
    forked = graph([*CHAIN, ("side", "output", {})], [*LINKS, ("llm", "side")])
    assert input_caps(forked) == {}
    g = graph([("llm", "llm_synth", {"user_prompt_ref": 7})], [])
    assert bind_prompts(g, {"7": "hello"}).node("llm").config == {"user_prompt": "hello"}
    assert prompt_users({"g": g}, "7") == [("g", "llm")]
    with pytest.raises(GraphError):
        bind_prompts(g, {})


def test_generation_chain():
    chain = graph([("llm", "llm_synth", {}), ("ops", "auto_process", {}), ("out", "output", {"count": 3})], [("llm", "ops"), ("ops", "out")])
    assert generation_chain(chain) == ["llm", "ops", "out"]
    assert generation_chain(graph(CHAIN, LINKS)) is None
    assert generation_chain(graph([("llm", "llm_synth", {}), ("web", "http_fetch", {}), ("out", "output", {"count": 3})], [("llm", "web"), ("web", "out")])) is None
    with pytest.raises(GraphError):
        generation_chain(graph([("llm", "llm_synth", {}), ("out", "output", {})], [("llm", "out")]))
