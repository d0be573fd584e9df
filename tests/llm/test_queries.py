"""The registered queries on whole small tables: SQL where it can say the same, else brute force."""

import hashlib
import os
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest

queries = pytest.importorskip("gridloom.llm.queries")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = run(spark, name)
    names = sorted(want.columns)
    plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    left = sorted(repr([plain(r[c]) for c in names]) for r in got)
    right = sorted(repr([int(x) if isinstance(x := plain(v), float) else x for v in r]) for r in want[names].astype(object).itertuples(index=False, name=None))
    assert left == right


def test_op1(spark, texts):
    got = run(spark, "op1_best_fit_packing")
    assert {r["doc_id"]: r["n_words"] for r in got} == {i: len(brute.words(t)) for i, t in texts.items()}


def test_op2(spark, texts):
    component, sizes, linked = brute.near_duplicates(list(texts.items()))
    got = {r["doc_id"]: r for r in run(spark, "op2_ngram_jaccard")}
    assert {i: (r["component_id"], r["n_shingles"], r["n_links"]) for i, r in got.items()} == {i: (component[i], sizes[i], linked[i]) for i in texts}


def test_op3(spark, texts):
    got = run(spark, "op3_quality_classifier")
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_op4(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet' order by 1").fetchall()
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r["vec_id"]: r["n_links"] for r in run(spark, "op4_embedding_dedup")}
    assert len(got) == len(rows) and all(got[i] <= n for (i, _), n in zip(rows, close.sum(axis=1)))
    assert sum(got.values()) >= 0.9 * close.sum()


def test_op5(spark, texts):
    gone = brute.passages(list(texts.items()))
    got = {r["doc_id"]: r for r in run(spark, "op5_suffix_dedup")}
    assert {i: r["n_removed"] for i, r in got.items()} == {i: len(g) for i, g in gone.items()}


def test_op8(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op8_quality_rules")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {i: tuple(r[c] for c in names) for i, r in got.items()} == {i: brute.rule_features(t) for i, t in texts.items()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got.values())


def test_op9(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op9_sharding")}
    held = {}
    for i, t in texts.items():
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(data) + 8, zlib.crc32(data), "rows")
        held.setdefault(t or "", []).append(got[i]["shard"])
    counts = np.bincount([r["shard"] for r in got.values()], minlength=24)
    assert counts.max() - counts.min() <= 1 and len(counts) == 24
    for s in range(24):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(counts[s]))
    assert all(got[i]["cut_links"] == sum(s != got[i]["shard"] for s in held[t or ""]) for i, t in texts.items())


def test_op10(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    got = {r["doc_id"]: r for r in run(spark, "op10_bpe")}
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
