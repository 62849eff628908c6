"""Store, engine, text, search and stream."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strataloom.engine import Engine
from strataloom.functions import cursors
from strataloom.functions import text as fx
from strataloom.operators import adapters, change, graph, retrieval, search
from strataloom.sources.sinks import write_capsule, write_jsonl
from strataloom.sources.store import Store
from strataloom.streaming.feed import follow

RAW = "src string, dst string, kind string, provenance string, doc string, line int, cross_generated boolean, type_arg string"
SYMBOL = "symbol_id string, doc_comment_id string, assembly string, kind string, fqn string, accessibility string, is_abstract boolean, type_kind string"


def symbols(spark, n=12):
    return spark.createDataFrame([(f"M:s{i}|a", f"M:s{i}", "a", "Method", f"n.s{i}", "Public", False, None) for i in range(n)], SYMBOL)


def edges(rng, docs, n=12):
    return [(f"M:s{rng.randrange(n + 2)}|a", f"M:s{rng.randrange(n)}|a", rng.choice(["Calls", "Reads"]), rng.choice(["possible", "compiler_proved"]), d, rng.randrange(9), False, rng.choice([None, "t"])) for d in docs for _ in range(4)]


def rows(df):
    return sorted(df.collect(), key=str)


def test_incremental_equals_full(spark, tmp_path):
    rng = random.Random(1)
    docs = {f"d{i}": None for i in range(8)}
    for d in docs:
        docs[d] = [r for r in edges(rng, [d])]
    own = lambda dd: [r for d in dd.values() for r in d]
    syms = symbols(spark)
    a, b = Engine(spark, f"{tmp_path}/a", "w"), Engine(spark, f"{tmp_path}/b", "w")
    a.build("s0", syms, spark.createDataFrame(own(docs), RAW))
    for step in range(3):
        changed = rng.sample(sorted(docs), 2)
        for d in changed:
            docs[d] = edges(rng, [d]) if rng.random() < 0.8 else []
        fresh = spark.createDataFrame(own({d: docs[d] for d in changed}), RAW)
        a.refresh(f"s{step + 1}", syms, spark.createDataFrame([(d,) for d in changed], "doc string"), fresh)
        b.build(f"s{step + 1}", syms, spark.createDataFrame(own(docs), RAW))
        assert rows(a.table("edges")) == rows(b.table("edges").select(a.table("edges").columns))


def test_publish_is_atomic(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    e = graph.edge_dedup(spark.createDataFrame(edges(random.Random(2), ["a"]), RAW))
    s.publish("one", "w", {"edges": e}, t0)
    bad = e.withColumn("line", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        s.publish("two", "w", {"edges": bad}, t0 + timedelta(1))
    assert s.latest("w")["snapshot_id"] == "one" and s.latest_failure("w")["snapshot_id"] == "two"
    with pytest.raises(ValueError):
        s.read("edges", "two")
    assert s.gc() == [("two", "tombstone")] and s.gc() == []
    assert s.publish("one", "w", {})["tables"] == ["edges"]
    for k in range(3):
        s.publish(f"n{k}", "w", {"edges": e}, t0 + timedelta(2 + k))
    assert set(s.prune(3)) == {"one", "two"} and s.get("n0")["previous"] is None
    assert rows(s.read("edges", "n1")) == rows(e)
    with pytest.raises(ValueError, match="unknown tables"):
        s.publish("x", "w", {"nope": e})


def test_pages_partition_the_paths(spark, tmp_path):
    e = Engine(spark, str(tmp_path), "w")
    e.build("s", symbols(spark), spark.createDataFrame(edges(random.Random(3), ["a", "b", "c"]), RAW))
    whole = e.impact("M:s1|a", max_paths=1000)
    seen, cursor = [], None
    while True:
        p = e.impact("M:s1|a", max_paths=3, cursor=cursor)
        seen += [r.chain for r in p["paths"]]
        assert p["total"] == whole["total"] and p["remaining"] == whole["total"] - len(seen)
        cursor = p["cursor"]
        if cursor is None:
            break
    assert seen == [r.chain for r in whole["paths"]] and len(seen) == len(set(seen)) == whole["total"]
    c = e.context("M:s1|a", 200)
    assert c["anchor"]["symbol"] == "M:s1|a" and e.context("M:none|a")["reasons"]["contracts"] == "unresolved"
    assert [r.symbol_id for r in e.find_symbol("n.s3").collect()] == ["M:s3|a"] == [r.symbol_id for r in e.find_symbol("M:s3").collect()]
    e.annotate("s2", "M:s1|a", "note", "v")
    assert e.table("annotations").count() == 1 and e.table("symbols").count() == 12
    assert {k: v.count() >= 0 for k, v in e.audit().items()} and e.diff("s", "s2")["edges"].count() == 0 and e.simulate("move", "M:s1|a").count() >= 0


def test_cursors():
    f = cursors.fingerprint(q="a")
    c = cursors.encode_cursor("search", "s", f, [1, "x"])
    assert cursors.decode_cursor(c, "search", "s", f) == [1, "x"] and cursors.decode_cursor("junk", "search", "s", f) is None
    for args in (("impact", "s", f), ("search", "t", f), ("search", "s", "other")):
        with pytest.raises(ValueError):
            cursors.decode_cursor(c, *args)
    with pytest.raises(ValueError, match="did you mean --kind"):
        cursors.check_options(["--kin"], ["--kind", "--depth"])
    cursors.check_options(["--kind"], ["--kind"])


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b.g.cs", "x\nyé\n\nz"), ("obj/c.cs", ""), ("src/d.cs", "// <auto-generated> by hand\n")], "path string, text string")
    r = df.select("path", fx.line_starts("text").alias("s"), fx.is_generated("path", "text").alias("g"), fx.generator_identity("text").alias("w"), fx.is_build_output("path").alias("b"), fx.is_ignored("path", ["*.cs", "!src/"]).alias("i")).collect()
    assert [x.s for x in r] == [[0, 2, 6, 7], [0], [0]] and [x.g for x in r] == [True, True, True] and [x.w for x in r] == [None, None, "by hand"]
    assert [x.b for x in r] == [False, True, False] and [x.i for x in r] == [True, True, False]
    raw = spark.createDataFrame([(bytearray(b"\xff\xfeh\x00\xe9\x00"),), (bytearray(b"\xef\xbb\xbfh"),), (bytearray("hé".encode()),), (bytearray("﻿h".encode("utf-16-be")),)], "b binary")
    assert [bytes(x.n).decode() for x in raw.select(fx.normalize_bytes("b").alias("n")).collect()] == ["hé", "h", "hé", "h"]
    with pytest.raises(Exception, match="neither UTF-8"):
        spark.createDataFrame([(bytearray(b"\xc3\x28\xa0"),)], "b binary").select(fx.normalize_bytes("b")).collect()
    ids = spark.createDataFrame([("M:N.T.Run(System.String,A.B)|x",), ("T:N.T|x",), ("P:N.T.P|x",)], "s string")
    assert [x[0] for x in ids.select(fx.containing_type("s")).collect()] == ["T:N.T|x", None, "T:N.T|x"]


def test_search(spark):
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha alpha gamma"), ("c", ""), ("d", "alphabet"), ("e", None)], "path string, content string")
    p, n = search.build_search_index(docs, "path", ["content"])
    got = lambda q: {r.key for r in search.bm25(p, n, q).collect()}
    assert got("alpha") == {"a", "b"} and got("alpha beta") == {"a"} and got("beta OR gamma") == {"a", "b"} and got("alpha NOT gamma") == {"a"} and got("alph*") == {"a", "b", "d"}
    assert search.search_source(docs, "  ").collect() == [] and search.search_source(docs, "alpha", 0).collect() == []
    s = spark.createDataFrame([("1", "T:CourseService", "NamedType", "n.CourseService")], "symbol_id string, doc_comment_id string, kind string, fqn string")
    assert search.search_symbols(s, "rseServ").count() == 1 and search.search_symbols(s, "rseServ", "Method").count() == 0
    assert docs.filter("path = 'a'").select(search.snippet("content", ["beta"])).first()[0] == "alpha <mark>beta</mark>"


def test_views(spark):
    docs = spark.createDataFrame([("p", "int é = 1;\nx\n", [0, 12, 14])], "path string, content string, line_starts array<int>")
    decls = spark.createDataFrame([("A", "p", 4, 6), ("A", "p", 4, 6), ("B", "p", None, None), ("C", "p", 0, 11), ("D", "p", 12, 13)], "symbol_id string, path string, full_start int, full_end int")
    view = {r.symbol_id: r["view"] for r in retrieval.symbol_view(decls, docs).collect()}
    assert view == {"A": "é", "B": None, "C": "int é = 1;", "D": "x"}
    where = {(r.symbol_id, r.line, r.column) for r in retrieval.declaration_locations(decls, docs).collect()}
    assert where == {("A", 0, 4), ("C", 0, 0), ("D", 1, 0)}
    places = spark.createDataFrame([(1, "p", 5), (2, "p", 0), (3, "p", 11)], "place_id int, path string, offset int")
    assert {r.place_id: r.symbol_id for r in retrieval.navigate(decls, places).collect()} == {1: "A", 2: "C"}


def test_freshness(spark):
    known = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h")], "path string, built_at int, content_hash string")
    files = spark.createDataFrame([("a", 2, "h"), ("b", 0, "h")], "path string, mtime int, content_hash string")
    got = lambda mode: {r.path: r.why for r in change.freshness_cheap(known, files, mode).collect()}
    assert got("auto") == {"a": "touched", "c": "missing"} and got("hash") == {"c": "missing"} and got("off") == {}


def test_adapters_are_isolated(spark):
    class Good:
        name, version = "good", "1"

        def extract(self, staging):
            return {"edges": staging["x"]}

    class Bad(Good):
        name = "bad"

        def extract(self, staging):
            raise RuntimeError("no")

    df = spark.createDataFrame([("A", "B")], "src string, dst string")
    out = adapters.run_adapters([Bad(), Good()], {"x": df})
    assert out.edges.count() == 1 and out.failures == [("bad", "RuntimeError: no")]
    assert adapters.run_adapters([Good()], {"x": df}, {"good"}).edges is None


def test_sinks(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("a",)], "x string"), f"{tmp_path}/j", {"n": 1})
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"meta": {"n": 1}}', '{"x":"a"}']
    a, b = (write_capsule({"a": 1}, str(tmp_path), "M:" + "x" * 300 + c) for c in "ab")
    assert a != b


def test_change_feed(spark, tmp_path):
    """Each batch equals a rebuild: evidence of one edge in two documents, best evidence that goes, a document without edges."""
    store = Store(spark, f"{tmp_path}/store")
    rng = random.Random(9)
    full = {d: edges(rng, [d], 3) for d in "abc"}
    shared = ("M:s0|a", "M:s1|a", "Calls", "possible", "a", 1, False, None)
    full["a"].append(shared)
    full["b"].append((*shared[:3], "compiler_proved", "b", 5, False, None))
    now: dict[str, list] = {}
    cols = [f.split()[0] for f in RAW.split(", ")]

    def derive(batch):
        return spark.createDataFrame([r for d in now.values() for r in d], RAW).join(batch.select("doc").distinct(), "doc", "left_semi").select(*cols)

    for k, (d, rows_) in enumerate([("a", full["a"]), ("b", full["b"]), ("c", full["c"]), ("b", [])]):
        now[d] = rows_
        spark.createDataFrame([(d,)], "doc string").write.mode("append").parquet(f"{tmp_path}/feed")
        follow(spark, f"{tmp_path}/feed", "doc string", store, "w", derive, f"{tmp_path}/checkpoint", lambda _: symbols(spark, 5)).awaitTermination()
        b = Engine(spark, f"{tmp_path}/b{k}", "w")
        b.build("s", symbols(spark, 5), spark.createDataFrame([r for d in now.values() for r in d], RAW))
        e = Engine(spark, f"{tmp_path}/store", "w")
        assert rows(e.table("edges")) == rows(b.table("edges").select(e.table("edges").columns))
        assert e.table("symbols").count() == 5


def test_refresh_keeps_what_a_build_has(spark, tmp_path):
    """Synthetic nodes, annotations, facts by document and by snapshot."""
    a, b = Engine(spark, f"{tmp_path}/a", "w"), Engine(spark, f"{tmp_path}/b", "w")
    one = [("M:s0|a", "M:s1|a", "Calls", "possible", "x", 1, False, None), ("route:/r", "M:s0|a", "RoutesTo", "framework_derived", "x", 2, False, None)]
    old, new = [("M:s1|a", "M:s2|a", "Calls", "possible", "y", 1, False, None)], [("M:s2|a", "M:s1|a", "Calls", "possible", "y", 3, False, None), ("route:/n", "M:s2|a", "RoutesTo", "framework_derived", "y", 3, False, None)]
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "symbol_id string")
    docs = lambda **d: spark.createDataFrame([(p, "p", c, c, c) for p, c in d.items()], "path string, project string, content string, content_hash string, version_id string")
    notes = spark.createDataFrame([(1, "M:s0|a", "note", "v", None)], "seq bigint, symbol_id string, kind string, value string, document_path string")
    timings = spark.createDataFrame([(1, "load", 5)], "seq bigint, step string, elapsed bigint")
    a.build("s0", symbols(spark), spark.createDataFrame(one + old, RAW), nodes("route:/r"), documents=docs(x="1", y="1"), annotations=notes, timings=timings)
    a.refresh("s1", symbols(spark), spark.createDataFrame([("y",)], "doc string"), spark.createDataFrame(new, RAW), nodes("route:/n"), documents=docs(y="2"))
    b.build("s1", symbols(spark), spark.createDataFrame(one + new, RAW), nodes("route:/r", "route:/n"), documents=docs(x="1", y="2"), annotations=notes, timings=timings)
    assert a.store.latest("w")["tables"] == b.store.latest("w")["tables"] and a.store.latest("w")["dropped"] == b.store.latest("w")["dropped"]
    for t in b.store.latest("w")["tables"]:
        assert rows(a.table(t)) == rows(b.table(t).select(a.table(t).columns)), t
