"""Small graphs with known answers."""

import pytest

from strataloom.operators import capsule, change, graph

EDGE = "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_arg string"


def raw(spark, *edges):
    return spark.createDataFrame([(s, d, k, "compiler_proved", "a.cs", 1, False, None) for s, d, k in edges], EDGE)


def deduped(spark, *edges):
    return graph.edge_dedup(raw(spark, *edges))


def chains(df):
    return sorted((r.chain, r.truncated) for r in df.collect())


@pytest.mark.parametrize(
    ("edges", "seed", "down", "kinds", "depth", "want"),
    [
        ([("A", "B", "Calls")], "X", True, None, 3, []),
        ([("A", "B", "Calls")], "B", True, None, 3, []),
        ([("A", "B", "Calls")], "A", True, None, 3, [(">Calls:B", False)]),
        ([("A", "B", "Calls"), ("B", "C", "Calls")], "A", True, None, 3, [(">Calls:B>Calls:C", False)]),
        ([("A", "B", "Calls"), ("A", "C", "Calls")], "A", True, None, 3, [(">Calls:B", False), (">Calls:C", False)]),
        ([("B", "A", "Calls"), ("C", "A", "Calls")], "A", False, None, 3, [(">Calls:B", False), (">Calls:C", False)]),
        ([("A", "B", "Calls"), ("B", "A", "Calls")], "A", True, None, 5, [(">Calls:B", False)]),
        ([("A", "B", "Calls"), ("B", "C", "Calls"), ("C", "A", "Calls")], "A", True, None, 5, [(">Calls:B>Calls:C", False)]),
        ([("A", "B", "Calls"), ("B", "C", "Calls")], "A", True, None, 1, [(">Calls:B", True)]),
        ([("A", "B", "Calls")], "A", True, None, 1, [(">Calls:B", True)]),
        ([("A", "B", "Calls"), ("A", "C", "Reads")], "A", True, ["Calls"], 3, [(">Calls:B", False)]),
        ([("A", "A", "Calls")], "A", True, None, 3, []),
        ([("A", "B", "Calls"), ("A", "B", "Reads")], "A", True, None, 3, [(">Calls:B", False), (">Reads:B", False)]),
    ],
)
def test_trace_impact(spark, edges, seed, down, kinds, depth, want):
    assert chains(graph.trace_impact(deduped(spark, *edges), [seed], down, kinds, depth)) == want


def test_impact_groups(spark):
    e = deduped(spark, ("A", "B", "Calls"), ("B", "B1", "Calls"), ("B", "B2", "Calls"), ("B", "B3", "Calls"), ("A", "C", "Calls"), ("C", "C1", "Calls"))
    g = {r.first_node: r.paths for r in graph.impact_groups(graph.trace_impact(e, ["A"])).collect()}
    assert g == {"B": 3, "C": 1}


def test_edge_dedup(spark):
    rows = [("A", "B", "Calls", "possible", "a", 1, False, "x"), ("A", "B", "Calls", "compiler_proved", "z", 9, True, "y"), ("A", "B", "Calls", "compiler_proved", "z", 3, True, "x"), ("A", "B", "Reads", "odd", None, None, None, None)]
    out = {r.kind: r for r in graph.edge_dedup(spark.createDataFrame(rows, EDGE)).collect()}
    assert (out["Calls"].provenance, out["Calls"].line, out["Calls"].type_args) == ("compiler_proved", 3, "x,y")
    assert (out["Reads"].provenance, out["Reads"].type_args) == ("odd", None)


def test_orphans(spark):
    e = deduped(spark, ("T:a|x", "T:b|x", "Calls"), ("T:a|x", "T:z|inv", "Calls"), ("T:a|x", "T:<c>|x", "Calls"), ("T:q|x", "T:b|x", "Calls"), ("T:a|x", "route:/r", "RoutesTo"))
    nodes = spark.createDataFrame([("T:a|x",), ("T:b|x",), ("route:/r",)], "symbol_id string")
    kept, dropped = graph.split_orphans(e, nodes)
    assert {r.dst for r in kept.collect()} == {"T:b|x", "route:/r"}
    assert {r.dropped: r.edges for r in graph.orphan_summary(dropped).collect()} == {"external": 1, "compiler_synthesized": 1, "other": 1}


def test_reverse_doc_closure_gives_up(spark):
    rows = [("A", "B", "Calls", "possible", "1", 1, False, None), ("C", "A", "Calls", "possible", "2", 1, False, None), ("D", "C", "Calls", "possible", "3", 1, False, None)]
    e = graph.edge_dedup(spark.createDataFrame(rows, EDGE))
    declared = spark.createDataFrame([("B", "0"), ("A", "1"), ("C", "2"), ("D", "3")], "symbol_id string, path string")
    start = spark.createDataFrame([("0",)], "path string")
    docs, gave_up = graph.reverse_doc_closure(e, declared, start, 1.0)
    assert ({r.path for r in docs.collect()}, gave_up) == ({"0", "1", "2", "3"}, False)
    assert graph.reverse_doc_closure(e, declared, start, 0.6)[1]


def test_audit_dead(spark):
    e = deduped(spark, ("T:r|x", "T:a|x", "Registers"), ("T:b|x", "M:b.m|x", "Declares"), ("M:u|x", "M:b.m|x", "Calls"), ("T:c|x", "M:t|x", "TestedBy"))
    s = spark.createDataFrame([(x,) for x in ("T:a|x", "T:b|x", "T:c|x")], "symbol_id string")
    assert [r.symbol_id for r in change.audit_dead(e, s).collect()] == ["T:c|x"]


def test_simulate(spark):
    e = deduped(spark, ("T:s|x", "M:s.m|x", "Declares"), ("M:c|x", "M:s.m|x", "Calls"), ("M:d|x", "M:c|x", "Calls"), ("T:s|x", "T:i|x", "Implements"))
    assert [(r.affected, r.kind) for r in change.simulate_rename(e, "T:s|x").collect()] == [("M:c|x", "Calls")]
    assert {(r.affected, r.depth) for r in change.simulate_remove(e, "T:s|x").collect()} == {("M:c|x", 1), ("M:d|x", 2), ("T:i|x", 0)}


def test_diff_edges(spark):
    cols = "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_args string"
    a = spark.createDataFrame([("A", "B", "Calls", "possible", "x", 1, False, None), ("A", "C", "Calls", "possible", None, None, False, None), ("A", "D", "Calls", "possible", "x", 1, False, None)], cols)
    b = spark.createDataFrame([("A", "B", "Calls", "possible", "y", 1, True, None), ("A", "C", "Calls", "possible", None, None, False, None), ("A", "E", "Calls", "possible", "x", 1, False, None)], cols)
    assert {(r.dst, r.change) for r in change.diff_edges(a, b).collect()} == {("B", "evidence_changed"), ("B", "location_changed"), ("D", "removed"), ("E", "added")}


def test_match_transitions(spark):
    cols = "symbol_id string, kind string, assembly string, fqn string, fingerprint string"
    old = [("1", "M", "a", "n.X", "f"), ("2", "M", "a", "n.P", "g"), ("3", "M", "a", "n.Q", "g"), ("4", "M", "a", "n.K", "h")]
    new = [("5", "M", "a", "n.Y", "f"), ("6", "M", "a", "n.R", "g"), ("7", "M", "a", "n.S", "g"), ("8", "M", "b", "n.K", "h")]
    out = change.match_transitions(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()
    assert [(r.old, r.new, r.transition) for r in out] == [("1", "5", "rename")]


def test_budget_prefix(spark):
    items = spark.createDataFrame([(0, 1, "a", 2), (0, 2, "a", 3), (1, 1, "b", 1)], "tier_rank int, item_rank int, tier string, cost int")
    out = capsule.budget_prefix(items, 2)
    assert {(r.tier_rank, r.item_rank): r.included for r in out.collect()} == {(0, 1): True, (0, 2): False, (1, 1): False}
    reasons = {r.tier: r.reason for r in capsule.tier_reasons(capsule.budget_prefix(items, 5, 9), ["a", "b", "c"]).collect()}
    assert reasons == {"a": "budget_exhausted", "b": "budget_exhausted", "c": "empty"}


def test_budget_enforce():
    c = {"anchor": {"source": "x" * 4000}, "tiers": {"contracts": [{"source": "y" * 2000}], "surroundingSource": [{"source": "z" * 2000}]}, "paths": [["a"] * 9] * 9}
    out = capsule.budget_enforce(c, 400, capsule.tier_order())
    assert capsule.artifact_estimate(out) <= 400 and out["anchor"]["source"]
    assert out["dropped"] == ["paths", "itemSource", "surroundingSource", "contracts", "anchorSource"]
    assert capsule.budget_enforce(c, 10_000, capsule.tier_order())["dropped"] == []


def test_tiers(spark):
    e = deduped(spark, ("M:a|x", "M:i|x", "Calls"), ("M:i|x", "M:h|x", "MayDispatchTo"), ("M:c|x", "M:a|x", "Calls"), ("M:d|x", "M:c|x", "Calls"), ("M:c|x", "M:t|y", "TestedBy"))
    ids = spark.createDataFrame([("M:a|x",)], "id string")
    got = {n: sorted(r.symbol_id for r in f(e, ids).collect()) for n, f in capsule.TIERS.items()}
    assert got["directCallees"] == ["M:h|x", "M:i|x"] and got["directCallers"] == ["M:c|x"] and got["secondDegree"] == ["M:d|x"] and got["relevantTests"] == ["M:t|y"]
    with pytest.raises(ValueError, match="unknown tier"):
        capsule.tier_page(e, "nope", 0, 1)
