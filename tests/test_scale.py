"""What the graph's steps shuffle, and their results on the paths that large tables take."""

import re

import pytest

from strataloom.operators import capsule, change, graph

RAW = "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_arg string"


@pytest.fixture
def large(spark):
    """Nothing is small enough to be broadcast, but for what is told to be."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def raw(spark, *edges):
    return spark.createDataFrame([(s, d, k, "possible", doc, n, False, None) for n, (s, d, k, doc) in enumerate(edges)], RAW)


SOME = [("A", "B", "Calls", "1"), ("A", "B", "Calls", "2"), ("B", "C", "Calls", "2"), ("C", "D", "Reads", None), ("D", "A", "Calls", "3"), ("E", "E", "Calls", "3")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_shuffles_rows_once_without_merging_before(spark):
    p = plan(graph.edge_dedup(raw(spark, *SOME)))
    assert p.count("Exchange hashpartitioning") == 1 and "Aggregate" not in p


def test_links_are_counted_where_they_are(spark):
    df = change.audit_fan_out(graph.links(raw(spark, *SOME)), 0)
    assert exchanges(df) == 1
    assert rows(df) == [("A", 1), ("B", 1), ("D", 1), ("E", 1)]


def test_orphans_stay_dealt_by_src(large):
    nodes = large.createDataFrame([("A",), ("B",), ("B",), (None,)], "symbol_id string")
    kept, dropped = graph.split_orphans(graph.links(raw(large, *SOME)), nodes)
    assert exchanges(dropped) <= 4  # the edges by src and by dst, the nodes for either
    assert rows(kept) == [("A", "B", "Calls")]
    assert rows(dropped.select("src", "dst", "dropped")) == [("B", "C", "other"), ("C", "D", "other"), ("D", "A", "other"), ("E", "E", "other")]


def test_diff_is_made_once_and_sides_stay_dealt(large):
    e = graph.edge_dedup(raw(large, *SOME), graph.KEY)
    d = change.diff_edges(e.filter("src <> 'A'"), e.filter("src <> 'B'"))
    assert exchanges(d) == 2  # one a side
    s = change.diff_scoped(d, large.createDataFrame([("B",), ("B",), ("X",), (None,)], "symbol_id string"))
    assert plan(s).count("FullOuter") == 1
    assert rows(s) == [("A", "B", "Calls", "added"), ("B", "C", "Calls", "removed")]


@pytest.mark.parametrize("scope", [[], ["1"], ["2"], ["3", None], ["1", "2", "3"]])
def test_refresh_deduplicated(large, scope):
    """Against a plain loop: old evidence, none left, new, other keys, keys with nulls."""
    old = [("A", "B", "Calls", "1"), ("B", "C", "Calls", "1"), ("X", "Y", "Calls", "2"), ("Q", None, "Calls", "3"), ("Z", "Z", "Calls", None)]
    new = [("A", "B", "Calls", "2"), ("B", "C", "Calls", "3"), ("N", "M", "Calls", "3"), ("Q", None, "Reads", "3"), ("Z", "Z", "Calls", "9")]
    previous = graph.edge_dedup(raw(large, *old))
    out = change.refresh_deduplicated(previous, raw(large, *new), large.createDataFrame([(s,) for s in scope], "doc string"))
    assert plan(out).count("LeftAnti") == 0  # which joined all edges by document, then by key
    hit = {e[:3] for e in old + new if e[3] is not None and e[3] in scope and None not in e[:3]}
    want = [e for e in old if e[:3] not in hit] + [e for e in new if e[:3] in hit]
    assert rows(out.select("src", "dst", "kind", "doc")) == sorted(want, key=repr)


def test_retire_leaves_facts_where_they_are(spark):
    df = change.retire(graph.edge_dedup(raw(spark, *SOME)), raw(spark, *SOME).filter("doc = '2' OR doc IS NULL").select("doc").distinct(), "doc")
    assert exchanges(df) == 1
    assert rows(df.select("src", "doc")) == [("A", "1"), ("C", None), ("D", "3"), ("E", "3")]


@pytest.mark.parametrize(("few", "rounds"), [(100, 9), (0, 9), (100, 0), (1, 1)])
@pytest.mark.parametrize(("seeds", "depth"), [(["A"], None), (["A", "E", "A"], 2), (["none"], None)])
def test_reachable_by_filter_and_by_buckets(large, monkeypatch, few, rounds, seeds, depth):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    monkeypatch.setattr(graph, "MANY", min(few, 1))
    found = graph.reachable(raw(large, *SOME, ("B", "E", "Reads", "1")), large.createDataFrame([(s,) for s in seeds], "node string"), max_depth=depth)
    want = dict.fromkeys(seeds, 0)
    for k in range(1, 1 + (4 if depth is None else depth)):
        want |= {d: k for s, d, _, _ in [*SOME, ("B", "E", "Reads", "1")] if want.get(s) == k - 1 and d not in want}
    assert rows(found) == sorted(want.items(), key=repr)
    assert not [t.name for t in large.catalog.listTables() if t.name.startswith("step_")]


def test_stored_edges_are_not_shuffled_again(large):
    step = graph.bucketed(raw(large, *SOME).selectExpr("src AS node", "dst AS next"), "node", "step_test")
    df = step.join(large.createDataFrame([("A",)], "node string").hint("shuffle_hash"), "node", "left_semi")
    assert exchanges(df) == 1  # the frontier
    assert rows(df) == [("A", "B"), ("A", "B")]
    large.sql("DROP TABLE step_test")


@pytest.mark.parametrize("many", [1000, 0])
def test_few_keys_become_a_filter(large, monkeypatch, many):
    monkeypatch.setattr(graph, "MANY", many)
    e, ids = graph.edge_dedup(raw(large, *SOME)), large.createDataFrame([("B",), (None,)], "id string")
    df = capsule.change_sites(e, ids)
    assert ("Join" in plan(df)) == (many == 0)
    assert rows(df) == [("1", 1), ("2", 0)]
    assert rows(graph.among(e, "src", ids.filter("id = 'none'"))) == []


def test_items_of_tiers_are_written_once(large):
    symbols = large.createDataFrame([(s, f"n.{s}") for s in "ABCD"], "symbol_id string, fqn string")
    items = capsule.all_tiers(graph.edge_dedup(raw(large, *SOME)), symbols, "B")
    assert "Window" not in plan(items) and "Join" not in plan(items)
    assert rows(items.select("tier", "symbol_id", "fqn", "item_rank")) == [("directCallees", "C", "n.C", 1), ("directCallers", "A", "n.A", 1), ("secondDegree", "D", "n.D", 1)]
