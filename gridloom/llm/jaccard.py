"""Exact self-join of shingle sets by Jaccard similarity, with set relations to skip work.

1. Shingles are counted in packed blocks; those that many sets hold come last in the global order,
   and a bitmap tells which occur once only.
2. Every set gives its prefix in that order to inverted index lists (shingle, position): two sets
   with similarity >= t share a shingle of both prefixes.  Entries are skipped by position and set
   size, and shingles that occur once are never listed.
   Lone sets whose 256-bit parities differ too much are skipped too.
3. Equal sets are one.  A set highly similar to another (they share a min-hash, and the similarity
   is verified) joins that set's star; lists hold stars, so copies of one text never meet pairwise.
4. The answers of a star's members derive from the answer of its centre: Jaccard distance is a
   metric, so only members whose distances to the centres leave the matter open are compared.  These
   are nearly equal sets, so a block of members lists its shingles once, and a product of matrices
   gives what many guests share with all of them.

No link is lost and none is invented: every link is verified on whole sets, and a pair is skipped
only if it is bounded below t.  Links inside a star and between stars are counted where they are
found (``n_links``) and never written as pairs; of them only one for each guest and block is kept,
which connects just what all of them connect.

Texts without words have empty sets and link with nothing, null texts likewise.  Null ids keep a
null component.  Rows with the same id are one node of the link graph; n_links counts other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .counting import Counted, count
from .graph import components
from .store import Scratch, Shared

K, PERCENT = 5, 80
#: Part of the hash space whose shingles are counted: enough for the prefix of a half-common text.
SHARE = 0.4
#: A shingle of more sets is common. The lists of common shingles hold stars; they have no cap.
COMMON = 24
KEYS = 4


def _limit() -> np.uint64:
    return tk.U64(int(SHARE * 2**64))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for first, last, data, offsets in tk.pieces(batch):
        _, _, h, bounds = tk.words(data, offsets)
        yield first, last, tk.shingle_sets(h, bounds, k)


PROFILE = "doc_id long, n long, s1 long, s2 long, listed binary, places binary, keys array<long>, parity array<long>"
#: Bits of a set's parity: bit i says if an odd number of its shingles hash to i.
WIDTH, WORDS = 256, 4


def _low(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for _, _, sets in _sets(batch, k):
        yield from (s[: np.searchsorted(s, _limit())] for s in sets)


def _profile(docs: DataFrame, counted: Counted, k: int, percent: int) -> DataFrame:
    """A row per text; without a prefix shingle that may come twice, listed and what follows are null."""
    shared = Shared(docs.sparkSession, counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.get()
        for batch in batches:
            for first, last, sets in _sets(batch, k):
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                low = flat < _limit()
                hot, again = low & known.often(flat), ~low | known.again(flat)
                mixed = tk.mix(flat)
                cols: list[list] = [[] for _ in range(7)]
                begin = 0
                for s in sets:
                    n = len(s)
                    own = slice(begin, begin + n)
                    begin += n
                    row: list = [n, 0, 0, None, None, None, None]
                    if n:
                        row[1] = int(np.add.reduce(mixed[own]).view(np.int64))
                        row[2] = int(np.bitwise_xor.reduce(mixed[own] * tk.U64(0x9FB21C651E98DF25)).view(np.int64))
                        p = n - -(-percent * n // 100) + 1
                        h = hot[own]
                        order = np.concatenate([np.flatnonzero(~h), np.flatnonzero(h)])[:p] if h.any() else np.arange(p)
                        place = np.flatnonzero(again[own][order])
                        if len(place):
                            row[3] = s[order[place]].tobytes()
                            row[4] = place.astype(np.int32).tobytes()
                            row[5] = [int(s[0].view(np.int64)), *(int(tk.mix(s ^ tk.U64(7919 * (j + 1))).min().view(np.int64)) for j in range(KEYS - 1))]
                            odd = np.bincount((mixed[own] % tk.U64(WIDTH)).astype(np.int64), minlength=WIDTH) & 1
                            row[6] = np.packbits(odd.astype(bool)).view(np.int64).tolist()
                    for c, x in zip(cols, row):
                        c.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][first:last], *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["doc_id", "n", "s1", "s2", "listed", "places", "keys", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, PROFILE)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of at least the ids: a bitmap of them goes to the texts, so that the others are never shuffled."""
    found = Shared(docs.sparkSession, count(ids, lambda batch: iter([tk.mix(np.repeat(batch["doc_id"].drop_null().to_numpy().view(np.uint64), 2))]), of=docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(found.get().again(tk.mix(i))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, text string")


def _shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    return [s for _, _, sets in _sets(pa.RecordBatch.from_arrays([texts], ["text"]), k) for s in sets]


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    spot = np.searchsorted(y, x)
    return int((y[np.minimum(spot, len(y) - 1)] == x).sum()) if len(y) else 0


#: Pairs of one set that meet in a task; sets that hold more pairs are sent to several.
PAIRS = 2000


def _compare(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str, k: int) -> DataFrame:
    """``pairs`` (u, v) with the sizes of both sets, of what they share (both), and of their union (any). v may be in many pairs."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = scratch.table(_texts(docs, ids), f"{name}-texts", wide=True)
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / PAIRS).alias("salts"))
    salted = pairs.join(salts, "v").select("u", "v", F.pmod(F.xxhash64("u"), "salts").alias("salt"))
    many = texts.withColumnRenamed("doc_id", "v").join(salts, "v").select("v", F.col("text").alias("tv"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # Texts are never broadcast, so that the plan is the same at every size.
    both = salted.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")).hint("merge"), "u").join(many.hint("merge"), ["v", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                held: dict[int, np.ndarray] = {}
                for side, text in (("u", "tu"), ("v", "tv")):
                    at_first = {i: j for j, i in reversed(list(enumerate(part[side].to_pylist()))) if i not in held}
                    held |= zip(at_first, _shingles(part[text].take(pa.array(list(at_first.values()), pa.int64())), k))
                out += [(_shared(held[u], held[v]), len(held[u]), len(held[v])) for u, v in zip(part["u"].to_pylist(), part["v"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], *[pa.array([o[j] for o in out], pa.int64()) for j in range(3)]], ["u", "v", "both", "nu", "nv"])

    out = both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long, both long, nu long, nv long")
    return out.withColumn("any", F.col("nu") + F.col("nv") - F.col("both"))


#: Members of a star in a block, and guests that meet a block in one task; shingles of either, on average; entries of a dense matrix.
BLOCK, GUESTS, SHINGLES, DENSE = 1024, 4096, 1 << 20, 1 << 22


def _overlaps(hosts: list[np.ndarray], guests: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of guests: where the run starts, and how many shingles each of them shares with each host."""
    words, spot = np.unique(np.concatenate(hosts), return_inverse=True)
    of, step = np.repeat(np.arange(len(hosts)), [len(x) for x in hosts]), max(1, DENSE // max(1, len(words)))
    for at in range(0, len(guests), 256):
        part = guests[at : at + 256]
        flat, who = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        to = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[to] == flat
        to, who = to[hit], who[hit]
        both = np.zeros((len(part), len(hosts)), np.float32)
        for a in range(0, len(part), step):
            own = (who >= a) & (who < a + step)
            left = np.zeros((min(step, len(part) - a), len(words)), np.float32)
            left[who[own] - a, to[own]] = 1
            for b in range(0, len(hosts), step):
                mine = (of >= b) & (of < b + step)
                right = np.zeros((min(step, len(hosts) - b), len(words)), np.float32)
                right[of[mine] - b, spot[mine]] = 1
                both[a : a + step, b : b + step] = left @ right.T
        yield at, both


def _answers(open_: DataFrame, members: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """(doc, add, link): rows that sets of ``open_`` stars (host, guest; may be the same) are linked with, and a link of each guest and block.

    ``members``: (star, doc_id, n, m), m rows having the set doc_id.
    """
    hosts = open_.select(F.col("host").alias("star")).distinct().join(members, "star")
    guests = open_.select("host", F.col("guest").alias("star")).join(members, "star")
    guests = guests.select(F.col("host").alias("star"), (F.col("host") == F.col("star")).alias("own"), F.col("doc_id").alias("v"), "n", F.col("m").alias("gm"))
    ids = hosts.select("doc_id").unionAll(guests.select(F.col("v").alias("doc_id"))).distinct()
    texts = scratch.table(_texts(docs, ids), "answer-texts", wide=True)
    parts = lambda df, most, name: df.groupBy("star").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / SHINGLES)).alias(name))
    sizes = scratch.table(parts(hosts, BLOCK, "blocks").join(parts(guests, GUESTS, "salts"), "star"), "answer-sizes")
    host = hosts.join(sizes, "star").join(texts.hint("merge"), "doc_id").select(F.col("star").alias("s"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("z"), F.col("doc_id").alias("id"), "m", F.col("text").alias("t"))
    guest = guests.join(sizes, "star").join(texts.withColumnRenamed("doc_id", "v").hint("merge"), "v").select(F.col("star").alias("gs"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("gb"), F.pmod(F.xxhash64("v"), "salts").alias("gz"), F.col("v").alias("gid"), "own", "gm", F.col("text").alias("gt"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_, adds, links_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            ids, m = left["id"].to_numpy(), left["m"].to_numpy()
            gids, gm, own = right["gid"].to_numpy(), right["gm"].to_numpy(), right["own"].to_numpy()
            sets, mine = _shingles(right["gt"].combine_chunks(), k), _shingles(left["t"].combine_chunks(), k)
            n, gn = np.array([len(s) for s in mine]), np.array([len(s) for s in sets])
            back, largest = np.zeros(len(ids), np.int64), np.iinfo(np.int64).max
            for at, both in _overlaps(mine, sets):
                sel = slice(at, at + len(both))
                both = both.astype(np.int64)
                good = (100 * both >= percent * (n + gn[sel, None] - both)) & (ids != gids[sel, None])
                docs_.append(gids[sel])
                adds.append((good * m).sum(axis=1))
                links_.append(np.where(good, ids, largest).min(axis=1))
                back += (good & ~own[sel, None]).T @ gm[sel]
            docs_.append(ids)
            adds.append(back)
            links_.append(np.full(len(ids), largest))
        doc, add, link = (np.concatenate(x) for x in (docs_, adds, links_))
        some = add > 0
        return pa.table({"doc": pa.array(doc[some]), "add": pa.array(add[some]), "link": pa.array(link[some], mask=link[some] == np.iinfo(np.int64).max)})

    return host.groupBy("s", "b", "z").cogroup(guest.groupBy("gs", "gb", "gz")).applyInArrow(run, "doc long, add long, link long")


#: Stars of a list that meet in a task; longer lists meet part by part.
LIST = 2000


def links(docs: DataFrame, scratch: Scratch, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profile of each row; distinct sets (n, s1, s2, rep, m rows); verified links (u, v) between reps; linked rows (doc, add) of reps).

    The links connect just what all links connect; the counts are of all of them.
    """
    whole = scratch.table(_profile(docs, count(docs.select("text"), lambda batch: _low(batch, k), COMMON, of=docs), k, percent), "profile", wide=True)
    prof = scratch.table(whole.select("doc_id", "n", "s1", "s2", F.col("listed").isNotNull().alias("live")), "ids")
    live = whole.where("listed is not null")
    reps = scratch.table(live.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("m")), "reps")
    ids = reps.where("rep is not null").select(F.col("rep").alias("doc_id"), "n", "m")
    linked = 100 * F.col("both") >= percent * F.col("any")
    far = 1 - percent / 100 + 1e-9

    # Stars: the smallest set that shares a min-hash and is similar.
    keyed = live.select("doc_id", F.posexplode("keys").alias("j", "key")).join(ids, "doc_id", "left_semi")
    keyed = scratch.table(keyed, "keyed")
    first = scratch.table(keyed.groupBy("j", "key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m"), "first")
    lead = keyed.join(first, ["j", "key"]).where("lead < doc_id").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")).distinct()
    lead = scratch.table(lead, "lead")
    near = _compare(lead, docs, scratch, "lead", k).where(linked).select("u", "v", (1 - F.col("both") / F.col("any")).alias("d"))
    near = scratch.table(near.groupBy("u").agg(F.min(F.struct("v", "d")).alias("x")).select("u", "x.*"), "near")
    scratch.drop("lead-texts")
    members = ids.join(near.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("doc_id", "n", "m", F.coalesce("v", "doc_id").alias("star"), F.coalesce("d", F.lit(0.0)).alias("d"))
    members = scratch.table(members, "members")
    parity = live.select("doc_id", *[F.get("parity", F.lit(w)).alias(f"f{w}") for w in range(WORDS)])
    stars = members.join(parity, "doc_id").groupBy("star").agg(F.count("*").alias("size"), F.max("d").alias("radius"), *[F.min(f"f{w}").alias(f"f{w}") for w in range(WORDS)])
    stars = scratch.table(stars, "stars")

    # Lists of (shingle, place) with what is needed to skip by size and place.
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([len(x.as_buffer()) // 8 for x in batch["listed"]], np.int64)
            for a in range(0, len(m), 2000):
                own = slice(a, a + 2000)
                shingle = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch["listed"][own]])
                place = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch["places"][own]])
                who = pa.array(np.repeat(np.arange(a, a + len(m[own])), m[own]))
                yield pa.RecordBatch.from_arrays([pa.array(shingle), batch["star"].take(who), batch["n"].take(who), pa.array(place.astype(np.int64))], ["shingle", "star", "n", "place"])

    listed = live.select("doc_id", "n", "listed", "places").join(members.select("doc_id", "star"), "doc_id").select("star", "n", "listed", "places").mapInArrow(entries, "shingle long, star long, n long, place long")
    lists = listed.groupBy("shingle", "star").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("place").alias("p0"))
    lists = scratch.table(lists, "lists", wide=True)
    mixed = scratch.table(lists.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle", F.ceil(F.col("m") / LIST).alias("parts")), "mixed")
    lists = scratch.table(lists.join(mixed, "shingle").join(stars, "star").withColumn("alone", F.col("size") == 1).select("shingle", "parts", "star", "n0", "n1", "p0", "alone", *[f"f{w}" for w in range(WORDS)]), "blocks")
    scratch.drop("profile", "lists", "mixed", "keyed", "first", "lead")

    # A block holds the entries of a list with about the same size; a set looks only at its own block and those
    # that sizes allow, and skips entries whose places leave too little to share.  Two lone sets share at most what
    # stands behind an entry and what precedes it; only their first common entry leaves room for all that they share.
    step = np.log(100 / percent)
    lists = lists.withColumn("b0", F.floor(F.log(F.col("n0")) / step)).withColumn("b1", F.floor(F.log(F.col("n1")) / step))
    held = ["star", "n0", "n1", "p0", "alone", "b0", *[f"f{w}" for w in range(WORDS)]]
    # Of a long list, each entry meets one part after the other, in tasks of their own.
    left = lists.withColumn("block", F.explode(F.sequence(F.col("b0") - 1, F.col("b1") + 1))).select("shingle", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"a_{c}") for c in held])
    right = lists.select("shingle", F.explode(F.sequence("b0", "b1")).alias("block"), F.pmod(F.xxhash64("star"), "parts").alias("part"), *[F.col(c).alias(f"b_{c}") for c in held])
    fits = (percent * F.col("a_n0") <= 100 * F.col("b_n1")) & (percent * F.col("b_n0") <= 100 * F.col("a_n1"))
    room = F.least(F.col("a_n1") - F.col("a_p0"), F.col("b_n1") - F.col("b_p0"))
    ahead = F.when(F.col("a_alone") & F.col("b_alone"), F.least("a_p0", "b_p0")).otherwise(0)
    need = percent * (F.col("a_n0") + F.col("b_n0"))  # both * (100 + percent) >= percent * (n + n')
    once = F.col("block") == F.greatest(F.col("a_b0") - 1, F.col("b_b0"))  # the first block that both are in
    # Two lone sets differ in as many shingles, at least, as their parities differ in bits.
    size = F.col("a_n0") + F.col("b_n0")
    apart = sum((F.bit_count(F.col(f"a_f{w}").bitwiseXOR(F.col(f"b_f{w}"))) for w in range(WORDS)), F.lit(0))
    close = ~(F.col("a_alone") & F.col("b_alone")) | (apart <= size - 2 * F.ceil(percent * size / (100 + percent)))
    met = left.join(right, ["shingle", "block", "part"]).where((F.col("a_star") < F.col("b_star")) & once & fits & ((100 + percent) * (ahead + room) >= need) & close)
    cand = met.groupBy(F.col("a_star").alias("u"), F.col("b_star").alias("v")).agg(
        F.count("*").alias("shared"), F.max(room).alias("room"), F.first(F.col("a_alone") & F.col("b_alone")).alias("alone"), F.min("a_n0").alias("na"), F.min("b_n0").alias("nb")
    )
    # Two lone sets share at most what their prefixes share and what stands behind one prefix.
    behind = lambda n: F.floor((percent * F.col(n) + 99) / 100) - 1
    enough = (100 + percent) * F.least("room", F.col("shared") + F.greatest(behind("na"), behind("nb"))) >= percent * (F.col("na") + F.col("nb"))
    cand = scratch.table(cand.where(~F.col("alone") | enough).select("u", "v"), "pairs")
    centre = _compare(cand, docs, scratch, "pairs", k).select("u", "v", linked.alias("linked"), (1 - F.col("both") / F.col("any")).alias("d"))
    centre = scratch.table(centre, "centre")
    scratch.drop("blocks", "pairs", "pairs-texts")
    sure = near.select("u", "v").unionAll(centre.where("linked").select("u", "v"))

    # Stars of several sets: members look at those of their own star, and of stars that theirs leaves in doubt.
    wide = stars.select("star", "radius", "size")
    apart_ = wide.select(F.col("star").alias("u"), F.col("radius").alias("ru"), F.col("size").alias("mu")), wide.select(F.col("star").alias("v"), F.col("radius").alias("rv"), F.col("size").alias("mv"))
    met = scratch.table(centre.join(apart_[0], "u").join(apart_[1], "v").where("linked or mu > 1 or mv > 1"), "met")
    lone = met.where("linked and mu = 1 and mv = 1").select("u", "v")
    weight = ids.select(F.col("doc_id").alias("v"), F.col("m").alias("add"))
    counts = lone.unionAll(lone.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(weight, "v").select(F.col("u").alias("doc"), "add")
    open_ = met.where((F.col("mu") + F.col("mv") > 2) & (F.col("d") <= far + F.col("ru") + F.col("rv")))
    first = F.col("mu") >= F.col("mv")
    open_ = open_.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("host"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("guest"))
    open_ = scratch.table(open_.unionByName(wide.where("size > 1").select(F.col("star").alias("host"), F.col("star").alias("guest"))), "open")
    if not open_.isEmpty():
        found = scratch.table(_answers(open_, members.select("star", "doc_id", "n", "m"), docs, scratch, k, percent), "answers")
        sure = sure.unionAll(found.where("link is not null").select(F.col("doc").alias("u"), F.col("link").alias("v")))
        counts = counts.unionByName(found.select("doc", "add"))
        scratch.drop("answer-texts")
    return prof, reps, sure, counts


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text); null ids have a null component and no count."""
    prof, reps, sure, counts = links(docs, scratch, k, percent)
    label = components(sure, scratch)
    counts = counts.groupBy(F.col("doc").alias("rep")).agg(F.sum("add").alias("add"))
    known = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    known = known.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("add", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    known = scratch.table(known, "known")
    live = prof.where("live").select("doc_id", "n", "s1", "s2").join(known, ["n", "s1", "s2"])
    rest = prof.where(~F.col("live"))
    there = F.col("doc_id").isNotNull()
    out = live.select("doc_id", F.col("n").alias("n_shingles"), F.when(there, F.col("component_id")).alias("component_id"), F.when(there, F.col("n_links")).alias("n_links"))
    out = out.unionByName(rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.when(there, F.lit(0)).cast("long").alias("n_links")))
    out = scratch.table(out, "rows")
    # Rows of one id with different texts join what each of them is linked with.
    twice = out.groupBy("doc_id").agg(F.min("component_id").alias("v"), F.max("component_id").alias("most")).where("v <> most").select("doc_id", "v")
    twice = scratch.table(twice, "twice")
    if twice.isEmpty():
        return out
    joined = components(out.join(twice, "doc_id").select(F.col("component_id").alias("u"), "v"), scratch, "ids")
    out = out.join(joined.select(F.col("node").alias("component_id"), "component"), "component_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"), "n_links")
