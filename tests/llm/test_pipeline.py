import brute
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.store import Scratch


def test_stages(spark, docs, rows, tmp_path):
    junk = {r[0] for r in rows if "###" in (r[1] or "")}
    labels = [(r[0], 0 if r[0] in junk else 1, 0) for r in rows if r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    state = {r[0]: (r[1], r[3]) for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            n = {i: brute.rule_features(t) for i, (t, _) in state.items()}
            state = {i: x for i, x in state.items() if i not in junk and n[i][0] >= 50 and 100 * n[i][4] <= 50 * n[i][0]}
        elif name == "line_dedup":
            text = brute.boilerplate([(i, t, s) for i, (t, s) in state.items()])
            state = {i: (text[i], s) for i, (_, s) in state.items()}
        elif name == "near_duplicates":
            group, *_ = brute.near_duplicates([(i, t) for i, (t, _) in state.items()])
            state = {i: x for i, x in state.items() if group[i] == i}
        elif name == "passage_dedup":
            gone = brute.passages([(i, t) for i, (t, _) in state.items()])
            left = {i: [w for k, w in enumerate(brute.words(t)) if k not in gone[i]] for i, (t, _) in state.items()}
            state = {i: (" ".join(left[i]), s) for i, (_, s) in state.items() if left[i] or not gone[i]}
        got = {r["doc_id"]: r for r in docs.collect()}
        assert set(got) == set(state), name
        if name in ("line_dedup", "near_duplicates"):
            assert {i: r["text"] for i, r in got.items()} == {i: t for i, (t, _) in state.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "passage_dedup":
            assert {i: brute.words(r["text"]) for i, r in got.items()} == {i: brute.words(t) for i, (t, _) in state.items()}
    assert docs.where(F.col("start") + F.col("n_words") % 2048 > 2048).count() == 0
    assert 60 < docs.count() < len(rows) - 80


def test_near_duplicates_by_row(spark):
    """Repeated rows are one, an id's other text stays, and of a group the smallest id."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(None, a), (9, a), (9, b), (5, a + " more"), (5, a + " more"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in got.collect())) == [(5, "a"), (7, ""), (7, ""), (8, ""), (9, "b")]


def test_whole_run(spark, docs, tmp_path):
    """Repeated rows, null ids and texts, and no labels; and no documents at all."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.unionAll(docs.where("doc_id < 20")).unionAll(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    for name, table in (("some", odd), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        before = len(Scratch.made)
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in got.collect()]
        assert len(ids) == len(set(ids)) and (len(ids) > 60) == (name == "some")
        assert len(Scratch.made) == before + 1
