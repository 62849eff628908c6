"""The stages one by one against what the operators decide, and the whole."""

import random

import corpus_pipeline
from tests.llm.test_filters import later, speak, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, "\n".join(speak(rng, g, 12) for _ in range(5)), g, f"s{i % 3}") for i, g in enumerate(rng.choices(["en", "de", "fr", "es"], k=80))]
    item = " ".join(words(rng, 20))
    block = "\n".join(speak(rng, "en", 10) for _ in range(3))
    docs += [
        (100, docs[0][1], "en", "s0"),  # an exact copy: no line is left
        (101, docs[1][1].replace("\n", " "), "en", "s0"),  # a near copy in other lines
        (102, block + "\n" + docs[2][1][:0] + speak(rng, "en", 40), "en", "s1"),
        (103, block + "\n" + speak(rng, "en", 40), "en", "s1"),
        (104, speak(rng, "de", 30) + " " + item.upper(), "de", "s2"),
        (105, None, "en", "s1"),
        (106, "", "en", "s1"),
        (107, "12345 %%%", "en", "s1"),
        (108, "Привет это русский текст", "en", "s1"),
    ]
    rows = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in df.collect()}
    gone = lambda a, b: set(a) - set(b)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert gone({r[0] for r in rows}, kept[names[0]]) == {105, 106, 107, 108}
    assert gone(kept[names[0]], kept[names[1]]) == {100}
    assert kept[names[1]][103].text.count("\n") == 0 and kept[names[1]][103].n_chars == len(kept[names[1]][103].text)
    assert 101 in gone(kept[names[1]], kept[names[2]]) and len(gone(kept[names[1]], kept[names[2]])) <= 2
    assert gone(kept[names[2]], kept[names[3]]) == {104}
    assert set(kept[names[4]]) <= set(kept[names[3]])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r["copy"], r.text) for r in whole.collect()) == sorted((r.doc_id, r["copy"], r.text) for r in df.collect())


def test_odd_tables(spark, tmp_path):
    """Clashing names, nulls in any column, ties, repeated rows and a very long text; then no rows at all."""
    rng = random.Random(2)
    odd = "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string, __id string, row string, __gone string, copy string, links bigint"
    docs = [(i, "\n".join(speak(rng, g, 12) for _ in range(5)), g, f"s{i % 2}", None, "a", "b", "c", "d", "e", None) for i, g in enumerate(rng.choices(["en", "de", "fr", "es"], k=40))]
    docs += [docs[3], docs[3], (None, docs[4][1][::-1], "en", None, 1, *[None] * 6), (50, None, None, None, None, *[None] * 6), (51, "\n".join(speak(rng, "de", 30) for _ in range(3000)), None, None, None, *[None] * 6)]
    spark.createDataFrame([(1, "none of these"), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, odd).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {d[0] for d in docs} - {50} and len({r.doc_id for r in rows}) > 30
    assert all(r["__text"] == "a" and r["__gone"] == "d" for r in rows if r.doc_id in range(40))
    assert out.columns[:4] == ["doc_id", "text", "lang", "source"] and "copy" in out.columns
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], odd).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_a_dialect_of_later_documents_stays(spark, tmp_path):
    """Documents beyond the first 400 of their language by hash are known to language ID like the others."""
    rng = random.Random(5)
    late = later(spark, 460, 400)
    dialect = "xw zk qv jx wq".split()
    docs = [(i, " ".join("".join(rng.choices(dialect, k=3)) for _ in range(20)) if i in late else speak(rng, "de", 20), "de", "s", 0) for i in range(460)]
    docs += [(1000 + i, speak(rng, "en", 20), "en", "s", 0) for i in range(60)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path)).collect()}
    assert late <= kept and len(kept) > 500
