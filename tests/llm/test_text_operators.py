import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, classifier, counting, jaccard, linededup, packing, quality_rules, sharding, suffix_dedup


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(docs, rows, scratch):
    got = by_id(jaccard.near_duplicates(docs, scratch))
    component, sizes, linked = brute.near_duplicates([(r[0], r[1]) for r in rows])
    assert {i: r["n_links"] for i, r in got.items()} == linked
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert len(set(component.values())) < len(component) - 35


def test_near_duplicates_in_blocks(docs, rows, scratch, monkeypatch):
    """Many small blocks of hosts and guests, small matrices and lists in parts give the same links."""
    for name, n in (("BLOCK", 3), ("GUESTS", 2), ("DENSE", 500), ("LIST", 2), ("PAIRS", 2)):
        monkeypatch.setattr(jaccard, name, n)
    got = by_id(jaccard.near_duplicates(docs, scratch))
    component, _, linked = brute.near_duplicates([(r[0], r[1]) for r in rows])
    assert {i: r["component_id"] for i, r in got.items()} == component and {i: r["n_links"] for i, r in got.items()} == linked


def test_near_duplicates_of_one_id(spark, scratch):
    """Rows of one id are one node: what its texts are linked with is one component."""
    a, b, c = ([f"{x}{k}" for k in range(40)] for x in "abc")
    rows = [(5, a), (9, a), (7, b), (9, b), (11, c), (12, c), (12, []), (3, ["alone"]), (3, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(df, scratch).collect())
    assert got == sorted([(5, 5, 1), (9, 5, 1), (7, 5, 1), (9, 5, 1), (11, 11, 1), (12, 11, 1), (12, 11, 0), (3, 3, 0), (3, 3, 0)])


def test_near_duplicates_that_no_star_joins(spark, scratch):
    """B and C are linked; A, of smaller id and linked to neither, takes the lead of many keys that they share."""
    rng, rows = random.Random(8), []
    for _ in range(300):
        b = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        for edits in ((10, 30, 50, 70), (), (20, 60)):
            w = list(b)
            for k in edits:
                w[k + rng.randrange(8)] = f"w{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    want, _, linked = brute.near_duplicates(rows)
    assert sum(want[i] != i for i in want) == 300
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch))
    assert {i: r["n_links"] for i, r in got.items()} == linked
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_repeated_and_null_ids(spark, scratch):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text + " more", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = jaccard.near_duplicates(df, scratch).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] is not None} == {1}
    left = suffix_dedup.dedup_passages(df, scratch).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in left) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 60)]


def test_passages(docs, rows, scratch):
    got = by_id(suffix_dedup.dedup_passages(docs, scratch))
    gone = brute.passages([(r[0], r[1]) for r in rows])
    for r in rows:
        spans = got[r[0]]["spans"]
        assert {k for a, b in spans for k in range(a, b)} == gone[r[0]]
        assert brute.words(got[r[0]]["text"]) == [w for k, w in enumerate(brute.words(r[1])) if k not in gone[r[0]]]
        if not spans:
            assert got[r[0]]["text"] == r[1]
    assert sum(map(len, gone.values())) > 1000


def test_passages_across_ranges(spark, scratch):
    """A passage that all documents hold, with other words around it, over many small ranges; and one in other case."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    hot, cased = [word() for _ in range(70)], [f"Mixed{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(20, 60))]
        at = rng.randrange(len(w))
        w[at:at] = hot if i % 3 else hot[: rng.randrange(50, 70)]
        if i % 10 == 0:
            w += cased if i % 20 else [x.upper() for x in cased]
        if i % 25 == 0:
            w += hot + hot
        rows.append((i, " ".join(w)))
    rows += [(i + 200, t) for i, t in rows[:20]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        for fold in (True, False):
            got = by_id(suffix_dedup.dedup_passages(df, scratch, fold=fold))
            gone = brute.passages(rows, lower=fold)
            assert {i: {k for a, b in r["spans"] for k in range(a, b)} for i, r in got.items()} == gone
            if fold:
                assert sum(map(len, gone.values())) > 9000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_passages_of_one_id_and_two_texts(spark, scratch):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (5, two), (5, one), (5, two)]
    got = suffix_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"][:1]) for r in got) == [(1, 0, "a"), (5, 0, "b"), (5, 0, "b"), (5, 60, "")]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_lines(docs, rows, scratch, broadcast):
    got = by_id(linededup.dedup_lines(docs, scratch, broadcast_lines=broadcast))
    want = brute.boilerplate([(r[0], r[1], r[3]) for r in rows])
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(want[r[0]] != r[1] for r in rows) > 20
    assert got[0]["row"] == 1 and got[0]["line"] == "x"


def test_line_threshold_is_exact(spark, scratch):
    rows = [(i, f"the same line again\nown {i} b c d e f", f"s{i % n}") for n in (7, 8) for i in range(n)]
    rows = [(k, t.replace("same", "same7" if k < 7 else "same8"), s) for k, (_, t, s) in enumerate(rows)]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch))
    assert [got[k]["lines_removed"] for k in range(15)] == [0] * 7 + [1] * 8


def test_short_documents_lose_boilerplate_too(spark, scratch):
    """Most words of nine documents are boilerplate, all words of three; the three stay whole."""
    line = "terms and conditions of the whole site apply to you here"
    rows = [(k, line + ("\nown word %d" % k if k < 9 else ""), f"s{k}") for k in range(12)]
    got = by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch))
    assert [got[k]["text"] for k in range(12)] == ["own word %d" % k for k in range(9)] + [line] * 3
    assert [got[k]["lines_removed"] for k in range(12)] == [1] * 9 + [0] * 3


def test_rule_features(docs, rows):
    got = by_id(quality_rules.features(docs))
    for r in rows:
        assert tuple(got[r[0]][c] for c in quality_rules.BASE) == brute.rule_features(r[1]), r[0]


def test_learned_rules(spark, docs, rows, scratch):
    junk = {r[0] for r in rows if "###" in (r[1] or "")}
    labels = spark.createDataFrame([(r[0], 0 if r[0] in junk else 1, 0) for r in rows if r[0] % 4] + [(1, None, None)], "doc_id long, quality int, toxic int")
    out, rules = quality_rules.judge(docs, labels, scratch)
    got = by_id(out)
    assert rules and all(str(t) for rule in rules for t in rule)
    for r in rows:
        n, _, _, _, again = brute.rule_features(r[1])
        failed = n < 50 or 100 * again > 50 * n
        assert got[r[0]]["base_failed"] == failed
        assert got[r[0]]["kept"] == (not failed and r[0] not in junk)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    whole, _ = quality_rules.judge(docs, labels, scratch, carry=True)
    assert whole.select("row.*").columns == docs.columns


def test_verdicts_are_those_of_the_rules(spark, docs, rows, scratch):
    """The conditional expression against the same list of rules in plain Python, first rule that holds."""
    labels = spark.createDataFrame([(r[0], int("###" not in (r[1] or "") and r[0] % 7 > 0)) for r in rows], "doc_id long, quality int")
    out, rules = quality_rules.judge(docs, labels, scratch)
    hand = [(quality_rules.Term("n_words", True, 100.0), quality_rules.Term("word_chars", False, 700.0)), (quality_rules.Term("n_symbols", True, 0.0),), *rules]
    for some in (rules, hand, []):
        for r in out.withColumn("said", quality_rules.verdict(some)).collect():
            want = next((k for k, rule in enumerate(some, 1) if all((r[t.measure] > t.cut) == t.above for t in rule)), 0)
            assert r["said"] == want
            if some is rules:
                assert r["rule"] == want and r["kept"] == (not r["base_failed"] and not want)


def test_classifier(spark, docs, rows, scratch):
    junk = {r[0] for r in rows if "###" in (r[1] or "")}
    labels = spark.createDataFrame([(r[0], 0 if r[0] in junk else 1) for r in rows] + [(3, None)], "doc_id long, quality int")
    got = by_id(classifier.classify(docs, labels, scratch))
    held = [i for i, r in got.items() if r["held_out"]]
    assert 20 < len(held) < len(rows) / 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert np.mean([(got[i]["predicted"] == 0) == (i in junk) for i in held]) > 0.95


def test_classifier_without_labels(spark, docs, scratch):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, labels, scratch).collect()} == {0.5}


def test_packing(docs, rows, scratch):
    capacity = 512
    got = packing.pack(packing.lengths(docs), scratch, capacity=capacity, per_source=2, group_rows=100).collect()
    assert len(got) == len(rows)
    fields = {r[0]: r for r in rows}
    bins = {}
    for r in got:
        assert r["n_words"] == len(brute.words(fields[r["doc_id"]][1])) and r["n_full"] == r["n_words"] // capacity
        bins.setdefault((r["pack_group"], r["bin"]), []).append(r)
    for items in bins.values():
        items.sort(key=lambda r: (r["start"], r["n_words"] % capacity))
        ends = [r["start"] + r["n_words"] % capacity for r in items]
        assert ends[-1] <= capacity and all(a <= b["start"] for a, b in zip(ends, items[1:]))
        texts = [tuple(brute.words(fields[r["doc_id"]][1])) for r in items]
        texts = [t for t in texts if t]
        assert len(set(texts)) == len(texts)
        sources = [fields[r["doc_id"]][3] for r in items]
        assert all(sources.count(s) <= 2 for s in sources if s)


def test_best_fit_takes_the_tightest_compatible_bin():
    none = np.full(5, -1)
    bins, starts = packing.pack_group(np.array([6, 5, 4, 3, 2]), none, none, 10, 1)
    assert bins.tolist() == [0, 1, 0, 1, 1] and starts.tolist() == [0, 0, 6, 5, 8]
    bins, _ = packing.pack_group(np.array([6, 5, 4, 3, 2]), none, np.array([0, -1, 0, -1, -1]), 10, 1)
    assert bins.tolist() == [0, 1, 1, 0, 2]


def _best_fit(items, capacity, per_source):
    """Each item in the bin with the least room that holds it, has not its cluster, and has its source less than so often."""
    bins = []
    for n, s, c in items:
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and (c < 0 or c not in b["c"]) and (s < 0 or b["s"].count(s) < per_source)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "c": set(), "s": []})
        bins[k]["room"] -= n
        bins[k]["c"].add(c)
        bins[k]["s"].append(s)
        yield k, capacity - bins[k]["room"] - n


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    items = sorted(((rng.randrange(0, 100), rng.choice([-1, 0, 0, 0, 1, 2]), rng.choice([-1, -1, 0, 1, 2, 3])) for _ in range(400)), reverse=True)
    columns = [np.array(c) for c in zip(*items)]
    bins, starts = packing.pack_group(*columns, 100, 2)
    assert list(zip(bins.tolist(), starts.tolist())) == list(_best_fit(items, 100, 2))


def test_bitmaps_grow_with_the_input():
    assert [counting.bits_for(n) for n in (0, 1 << 20, 1 << 30, 1 << 31, 1 << 50, 1 << 62)] == [1 << 26, 1 << 26, 1 << 28, 1 << 29, 1 << 29, 1 << 26]


def test_sharding(docs, rows, scratch):
    df = docs.unionAll(docs.where("doc_id = 5")).unionAll(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard(df, scratch).collect()
    counts, slots, texts = [0] * 24, [[] for _ in range(24)], {}
    for r in got:
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
        texts.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    assert len(got) == len(rows) + 2 and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    together = [len(set(s)) for s in texts.values() if 1 < len(s) <= 3]
    assert sum(n == 1 for n in together) > 0.8 * len(together)


def test_sharding_of_one_text(spark, scratch):
    df = spark.createDataFrame([(i, "same") for i in range(100)], "doc_id long, text string")
    got = sharding.shard(df, scratch).toPandas()
    assert set(got.groupby("shard").size()) == {4, 5} and set(got["size"]) == {12}


def test_sharding_keeps_large_groups_whole(spark, scratch):
    """Groups from a quarter of the quota (100) up to it stay in one shard; a larger one is cut no more than it must be."""
    sizes = [250, 100, 95, 80, 70, 60, 55, 50, 45, 40, 30, 26, 26, 5, 5, 2]
    texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)]
    texts += [f"alone {k}" for k in range(2400 - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(sharding.shard(df, scratch))
    counts, held = [0] * 24, {}
    for i, text in enumerate(texts):
        counts[got[i]["shard"]] += 1
        held.setdefault(text, set()).add(got[i]["shard"])
    assert len(got) == 2400 and counts == [100] * 24
    assert [len(held[f"group {k}"]) for k in range(len(sizes))] == [3] + [1] * (len(sizes) - 1)


def _sharded(spark, scratch, sizes, alone=0):
    texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)] + [f"alone {k}" for k in range(alone)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, held, counts = by_id(sharding.shard(df, scratch)), {}, [0] * 24
    for i, text in enumerate(texts):
        counts[got[i]["shard"]] += 1
        held.setdefault(text, []).append(got[i]["shard"])
    for i, text in enumerate(texts):
        assert got[i]["cut_links"] == sum(s != got[i]["shard"] for s in held[text])
    assert max(counts) - min(counts) <= 1
    return [len(set(held[f"group {k}"])) for k in range(len(sizes))]


def test_sharding_cuts_no_text_that_fits(spark, scratch):
    """Two texts of half a quota for each shard; eight texts of an eighth and four rows of others."""
    assert _sharded(spark, scratch, [50] * 48) == [1] * 48
    assert _sharded(spark, scratch, [12] * 192, alone=96) == [1] * 192


def test_sharding_cuts_what_finds_no_room(spark, scratch):
    """Eight texts of 12 rows fill a shard of 100 up to four rows, so just eight of 200 are cut."""
    assert sorted(_sharded(spark, scratch, [12] * 200)) == [1] * 192 + [3] * 8
    assert sorted(_sharded(spark, scratch, [70] * 34, alone=20)) == [1] * 24 + [3] * 10


def test_sharding_moves_with_current_labels(spark, scratch):
    """Votes count labels as they are: a label without room gives way to the commonest one that has."""
    cells = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 2), (2, 0, 4)], "unit long, label int, n long")
    got = {r["unit"]: (r["to"], r["gain"]) for r in sharding._votes(cells, [6, 7, 9], 0).collect()}
    assert got == {1: (1, 2), 2: (0, 4)}
    load = [0, 0, 0]
    found = sharding._settle(cells, load, [4, 7, 0], 4, scratch, "hand")
    assert sorted((r["unit"], r["shard"]) for t in found for r in t.collect()) == [(1, 1), (2, 0)] and load == [4, 7, 0]


@pytest.mark.parametrize("words", [1, 6, 32])
def test_bpe(docs, rows, scratch, words, monkeypatch):
    """Ids and decoded texts of both forms are the tokenizer's own; copies share chunks over many splits, hot ones salted."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "SPLIT_BYTES", 20_000)
    monkeypatch.setattr(bpe, "HOT", 5)
    codec, made = bpe.Codec(path), []
    got = by_id(bpe.encode(docs, path, scratch, words))
    digest = by_id(bpe.digests(docs, path, scratch, words))
    assert len(got) == len(digest) == len(rows)
    for r in rows:
        ids = codec.tok.encode(r[1] or "", add_special_tokens=False).ids
        text = codec.tok.decode(ids, skip_special_tokens=False)
        assert (got[r[0]]["ids"], got[r[0]]["decoded"]) == (ids, text), r[0]
        made.append(len(ids))
        d = digest[r[0]]
        assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    table = scratch.spark.read.parquet(f"{scratch.root}/once").where("k1 is not null")
    assert 0 < table.count() == table.select("k1", "k2").distinct().count()


def test_bpe_without_words_apart(rows, monkeypatch):
    """A tokenizer of other steps encodes runs whole, with the same ids."""
    public = pytest.importorskip("public_tokenizers")
    apart, whole = (bpe.Codec(public.path("word_bpe_49k.json")) for _ in range(2))
    assert apart.by_word
    whole.by_word = False
    for r in rows:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        c = bpe.chunks_of(data, np.array([0, len(data)]), 8)
        assert list(apart.run(c)) == list(whole.run(c))


def test_bpe_by_pieces(monkeypatch):
    """Plain words go to the model by their pieces, each piece once, with the tokenizer's ids; other words go another way."""
    public = pytest.importorskip("public_tokenizers")
    codec = bpe.Codec(public.path("word_bpe_49k.json"))
    assert codec.by_piece
    letters = "".join(map(chr, [*range(65, 91), *range(97, 123), 170, 181, 186, *(x for x in range(192, 256) if x not in (215, 247))]))
    marks = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())
    plain = [a + b for a, b in zip(letters, letters[1:])] + [f"Ma{x}" for x in marks if x != "<"] + ["straße###", "ÉTÉ.%%%", "x''", "a|>", letters]
    other = [f"n{x}s" for x in marks] + ["don't", "I'LL", "x<|", "b<", "<|endoftext|>", "a<|endoftext|>b", "İx", "é", "日本", "日本,", "ä5", "×", "1,2", "ǅ", "가", "\x01x"]
    want = [np.array(codec.tok.encode(w, add_special_tokens=False).ids, codec.kind).tobytes() for w in plain + other]
    assert codec.learn([w.encode() for w in plain + other]) == want
    assert all(map(bpe.PLAIN, plain)) and not any(map(bpe.PLAIN, other))
    asked = []
    monkeypatch.setattr(codec, "piece", asked.append)
    assert codec.learn([w.encode() for w in plain]) == want[: len(plain)] and not asked


def test_bpe_of_repeated_rows_and_null_ids(spark, scratch):
    public = pytest.importorskip("public_tokenizers")
    text = " ".join(f"word{k}" for k in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (1, "other"), (None, None), (2, "")], "doc_id long, text string")
    got = bpe.digests(df, public.path("word_bpe_49k.json"), scratch).collect()
    n = len(bpe.Codec(public.path("word_bpe_49k.json")).tok.encode(text, add_special_tokens=False).ids)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, n), (1, 1), (1, n), (1, n), (2, 0)]


def test_bpe_repairs_joins(monkeypatch):
    """Chunks whose join does not agree are encoded as one, with the ids of the whole."""
    public = pytest.importorskip("public_tokenizers")
    codec = bpe.Codec(public.path("word_bpe_49k.json"))
    text = "na日 本a ́b x cé 日 z"
    data = np.frombuffer(text.encode(), np.uint8)
    chunks = bpe.chunks_of(data, np.array([0, len(data)]), 1)
    want = codec.tok.encode(text, add_special_tokens=False).ids
    keys = list(zip(chunks.k1.tolist(), chunks.k2.tolist()))
    own = dict(zip(keys, (codec.ids(text.encode()[a:b].decode()).tobytes() for a, b in zip(chunks.starts[chunks.first], chunks.ends[chunks.last]))))
    assert len(own) == 4 and not codec.torn(chunks, np.arange(1, 4)).any()
    for bad in ((), (" ",), ("日 z",), ("x cé", "日 z")):
        monkeypatch.setattr(codec, "agreed", {w: not any(x in w.decode() for x in bad) for w in codec.agreed})
        wrong = b"\0\0"  # what does not agree is not taken from the table
        for known in (None, {}, own, {keys[1]: own[keys[1]]}, {k: wrong if bad == (" ",) else own[k] for k in keys}):
            (ids,) = codec.run(chunks, known)
            assert np.frombuffer(ids, codec.kind).tolist() == want


def test_empty_tables(spark, none, scratch):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert jaccard.near_duplicates(none, scratch).count() == 0
    assert suffix_dedup.dedup_passages(none, scratch).count() == 0
    assert linededup.dedup_lines(none, scratch).count() == 0
    assert quality_rules.judge(none, labels, scratch)[0].count() == 0
    assert classifier.classify(none, labels, scratch).count() == 0
    assert packing.pack(packing.lengths(none), scratch).count() == 0
    assert sharding.shard(none, scratch).count() == 0
    pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    assert bpe.digests(none, public.path("word_bpe_49k.json"), scratch).count() == 0


def test_lines_that_agree_in_one_hash_are_told_apart():
    known = linededup._known([(5, 1), (5, 2), (-7, 3)])
    h = np.array([(5, 2), (5, 3), (-7, 3), (-7, 1), (9, 9), (0, 0)], np.int64)
    assert linededup._among(h, known).tolist() == [True, False, True, False, False, False]
    assert not linededup._among(h, linededup._known([])).any()
    data = np.frombuffer("one two three four\nfour three two one".encode(), np.uint8)
    _, _, _, hashes, counted, _ = linededup.line_hashes(data, np.array([0, len(data)]), 4)
    assert counted.all() and len(np.unique(hashes)) == 4


def test_packing_deals_rows_alike_to_many_groups(spark, scratch):
    rows = [(None, "", "a")] * 700 + [(7, "same words here", None)] * 500 + [(k, f"words {k}", "b") for k in range(100)]
    got = packing.pack(packing.lengths(spark.createDataFrame(rows, "doc_id long, text string, source string")), scratch, capacity=20, group_rows=50).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got) == sorted(-1 if r[0] is None else r[0] for r in rows)
    sizes = Counter(r["pack_group"] for r in got)
    assert len(sizes) > 20 and max(sizes.values()) < 150
    bins = Counter((r["pack_group"], r["bin"]) for r in got if r["doc_id"] == 7 and r["n_words"] == 3)
    assert max(bins.values()) == 1  # copies never share a bin
