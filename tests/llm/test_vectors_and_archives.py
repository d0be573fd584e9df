import base64
import hashlib
import random

import brute
import numpy as np
import pytest

from gridloom.llm import embed_dedup, warc
from gridloom.llm.graph import components


def test_components(spark, scratch):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    want = brute.components({x for pair in links for x in pair}, links)
    assert all(want[n] == c for n, c in got.items()) and all(n in got for n in want if want[n] != n)


def test_no_links(spark, scratch):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long"), scratch).count() == 0


def _vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 24))
    near = base[:60] + 0.05 * rng.standard_normal((60, 24))
    dense = base[5] + 0.08 * rng.standard_normal((300, 24))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([base, near, dense]))]
    n = len(rows)
    rows += [(n + k, rows[3][1]) for k in range(50)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 0.0], [2.0, 0.0]]
    return rows + [(n + 50 + k, v) for k, v in enumerate(odd)] + [(7, rows[7][1])]


def test_embeddings(spark, scratch):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, n int")
    got = embed_dedup.near_duplicates(df, scratch, leaf=64).collect()
    assert len(got) == len(rows)
    sound = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    true, links = {}, []
    for size in {len(v) for _, v in sound}:
        own = [(i, v / np.linalg.norm(v)) for i, v in sound if len(v) == size]
        x = np.stack([v for _, v in own])
        close = x @ x.T >= 0.95
        np.fill_diagonal(close, False)
        for k, (i, _) in enumerate(own):
            true[i] = int(close[k].sum())
            links += [(i, own[j][0]) for j in np.flatnonzero(close[k])]
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= true.get(i, 0) for i in found)
    assert sum(found.values()) >= 0.9 * sum(true.values())
    want = brute.components([i for i, _ in rows], links)
    assert np.mean([want[r["vec_id"]] == r["component_id"] for r in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("total", [3000, 12000])
def test_embeddings_of_a_large_group(spark, scratch, monkeypatch, total):
    """A third of the rows are distinct near copies, many of them just about linked; all their links count, at any size."""
    monkeypatch.setattr(embed_dedup, "CELL", 700)
    rng = np.random.default_rng(total)
    x = rng.standard_normal((total, 64))
    x[::3] = 8 * x[0] / np.linalg.norm(x[0]) + 0.22 * rng.standard_normal((len(x[::3]), 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, scratch).collect()}
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    true = close.sum(axis=1) - 1
    assert 0.3 < true.sum() / (total / 3) ** 2 < 0.95
    assert [got[k]["n_links"] for k in range(total)] == true.tolist()
    want = brute.components(range(total), zip(*(k.tolist() for k in np.nonzero(close))))
    assert all(got[k]["component_id"] == want[k] for k in range(total))


def test_trees_deeper_than_their_sample(spark, scratch):
    """Levels below those that the sample fits split further, and links are still found."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 32))
    x[3000:] = x[:3000] + 0.03 * rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, scratch, leaf=64, sample=150).collect()}
    forest = embed_dedup.Forest(x[:150] / np.linalg.norm(x[:150], axis=1, keepdims=True), 6000, 10, 64, 0.06)
    _, code = forest.leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert forest.depth == 7 and forest.fitted == 5 and np.median(np.unique(code, return_counts=True)[1]) < 300
    assert sum(got.values()) >= 0.9 * 6000 and max(got.values()) == 1


def test_no_vectors(spark, scratch):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


PAGES = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "http://a/3", None), (4, "http://a/4", ""),
    (5, "u: v", "x\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (6, "u", "long " * 30_000), (9, None, "<p>é</p>"), (10, "u WARC-Type: response", "same"),
    (11, "http://b/\r\nWARC-Type: response", "same"), (12, "", "same"), (13, " http://b/é ", "same"), (14, "http://b/é?q=a b", "same"), (-3, "\t", "own"), (None, "http://c", "nobody"),
]


def _parse(data):
    """Records of a WARC file, read by Content-Length."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        assert lines[0] == b"WARC/1.1"
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def test_archive(spark, scratch, tmp_path):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, addr string")
    archive = warc.write(df, scratch)
    got = archive.index().collect()
    assert len(got) == len(PAGES) and all(r["verified"] for r in got)
    html = {p[0]: p[2] or "" for p in PAGES}
    for r in got:
        data = html[r["page_id"]].encode()
        last = max((i for i, h in html.items() if h == html[r["page_id"]]), key=lambda i: i if i is not None else -99)
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
    assert archive.store.count() == len(set(html.values()))
    assert sorted(map(repr, archive.pages().collect())) == sorted(map(repr, spark.createDataFrame(PAGES, archive.pages().schema).collect()))
    archive.save(f"{tmp_path}/warc")
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    assert sorted(b"".join(files)) == sorted(b"".join(bytes(r["record"]) for r in archive.records().collect()))
    found = [x for f in files for x in _parse(f)]
    assert len({f[b"WARC-Record-ID"] for f, _ in found}) == len(found) == len(PAGES)
    responses = {f[b"WARC-Record-ID"]: (f, body) for f, body in found if f[b"WARC-Type"] == b"response"}
    for fields, body in found:
        assert fields[b"WARC-Date"] and fields[b"WARC-Target-URI"] is not None
        if fields[b"WARC-Type"] == b"revisit":
            assert body == b""
            fields, body = responses[fields[b"WARC-Refers-To"]][0] | {b"WARC-Payload-Digest": fields[b"WARC-Payload-Digest"]}, responses[fields[b"WARC-Refers-To"]][1]
        assert b"sha1:" + base64.b32encode(hashlib.sha1(body).digest()) == fields[b"WARC-Payload-Digest"]


def test_empty_archive(spark, scratch):
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), scratch).index().count() == 0
