"""BPE encoding and decoding with content-defined chunks that documents share.

1. A rolling hash over four words cuts every text into chunks of some 32 words, at the same places
   wherever the same words come.  Chunks that come twice or more in the corpus are found by a bitmap.
2. Each of them has one owner, the document of least hash that holds it, where it is encoded, once
   for the whole corpus, into a table of chunks.
3. Documents go to splits of a few megabytes by hash; each split is joined with the chunks that its
   documents hold, each once, so a chunk that all documents hold is sent once a split (and salted).
   What stands between shared chunks is encoded in place, as one; a word that comes again in a task
   is not encoded again, where the tokenizer's steps show that words do not touch.  Documents with no or hardly a
   shared chunk (``LEAST_SHARED``) stay where they are and are encoded there.
4. Every join with a shared chunk is proved: the words on both sides must have the same ids together
   as apart.  Chunks whose join does not agree are re-encoded as one, until all joins agree.

Chunks end at ASCII white space, and are told apart by 128 bits over the hashes of their words and
what stands between these.  Ids and decoded texts are those of the tokenizer on whole texts.

Null texts count as empty: no ids, and an empty decoded text.  Repeated rows and rows with the same
id are encoded each; null ids are kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .counting import Counted, count
from .store import Scratch, Shared

#: Words of a chunk on average, and of the rolling hash; bytes of text of a split; joins and words that a task remembers.
CHUNK_WORDS, ROLL_WORDS, SPLIT_BYTES, CACHE_JOINS, CACHE_WORDS = 32, 4, 4 << 20, 500_000, 1_000_000
#: A chunk of more occurrences than this is hot: its rows are salted.
HOT, SALTS = 2000, 32
#: A document goes to the shared chunks if they are one part in so many of it, at least. Below, sending its text costs
#: more than encoding them again where it is.
LEAST_SHARED = 16


@dataclass
class Chunks:
    """The chunks of some texts: first and last word, keys; each text's range among them; and all words: bytes from, to, hash."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    bounds: np.ndarray

    def only(self, texts: np.ndarray) -> Chunks:
        """Those of the texts that a mask picks."""
        n = np.diff(self.bounds)
        sub = np.repeat(texts, n)
        return Chunks(self.raw, self.starts, self.ends, self.hashes, *(x[sub] for x in (self.first, self.last, self.k1, self.k2)), np.concatenate([[0], np.cumsum(n[texts])]))

    def sizes(self) -> np.ndarray:
        return self.ends[self.last] - self.starts[self.first]


def chunks_of(data: np.ndarray, offsets: np.ndarray, chunk_words: int) -> Chunks:
    starts, ends, h, bounds = tk.words(data, offsets, lower=False)
    if not len(starts):
        none, keys = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Chunks(b"", none, none, keys, none, none, keys, keys, np.zeros(len(offsets), np.int64))
    last = np.zeros(len(h), bool)
    roll = tk.rolling(h, ROLL_WORDS)
    last[len(h) - len(roll) :] = roll % tk.U64(chunk_words) == 0
    some = bounds[1:] > bounds[:-1]
    for k in range(ROLL_WORDS - 1):  # these would depend on the text before
        last[np.minimum(bounds[:-1][some] + k, len(h) - 1)] = False
    last[bounds[1:][some] - 1] = True
    end = np.flatnonzero(last)
    first = np.concatenate([[0], end[:-1] + 1])
    # What stands before a word within its chunk: how much, and how it begins.
    gap = np.zeros(len(h), np.uint64)
    gap[1:] = (starts[1:] - ends[:-1]).astype(np.uint64) * tk.U64(256) + data[np.minimum(ends[:-1], len(data) - 1)]
    gap[first] = 0
    n = end - first + 1
    place = tk.powers(int(n.max()))[np.arange(len(h)) - np.repeat(first, n)]
    keys = [tk.mix(np.add.reduceat(tk.mix((h ^ tk.U64(salt)) + tk.mix(gap)) * place, first) + n.astype(np.uint64)) for salt in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)]
    return Chunks(data.tobytes(), starts, ends, h, first, end, *keys, np.searchsorted(end, bounds - 1, "right"))


#: With these steps, no character of a text changes or splits another one across ASCII white space (it
#: composes with nothing, lower case is by character, no alternative matches white space), so words can be encoded apart.
NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
PUNCTUATION = ".,;:!?"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters up to U+00FF, which compose with nothing and have one letter in lower case; then ASCII marks but "<", which
#: special tokens begin with: two pieces.
PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:;=-@[-`{-~]*)").fullmatch
#: The characters that stand for bytes of no character of their own, in order from U+0100.
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Codec:
    """A tokenizer that encodes texts chunk by chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [(x["id"], x["content"]) for x in spec["added_tokens"] if x["special"]]
        self.stop, self.stop_text = special[-1]
        self.open, self.shut = b"<|", b">"  # how special tokens begin and end
        assert all(c.startswith("<|") and c.endswith(">") for _, c in special)
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.token = [(self.tok.id_to_token(i) or "").encode() for i in range(n)]
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        self.agreed: dict[bytes, bool] = {}
        self.forget()
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = all(x in NORMALISERS for x in steps) and parts[0].get("pattern") == {"Regex": PATTERN} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        suffix = spec["model"].get("end_of_word_suffix")
        self.final = np.array([bool(suffix) and t.endswith(suffix.encode()) for t in self.token])

        # Where the steps are just these, a plain piece in lower case goes to the model as it is, its bytes as characters.
        just = [x.get("type") for x in parts] == ["Split", "ByteLevel"] and not parts[1].get("add_prefix_space") and parts[1].get("use_regex") is False
        self.by_piece = self.by_word and just and steps == list(NORMALISERS) and len(special) == len(spec["added_tokens"]) and not spec["model"].get("dropout")
        self.tokenize, self.code = self.tok.model.tokenize, "H" if n <= 1 << 16 else "I"

    def forget(self) -> None:
        """No words are remembered: their hashes in order, how many ids each has and where; and no pieces."""
        self.words, self.sizes, self.places, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: pieces that are plain one by one, others of letters, also with a mark at the end, in runs that are cut where a piece ends."""
        out = [b""] * len(words)
        runs: dict[int, list[int]] = {1: [], 2: []}  # by pieces
        rest, ids = [], self.pieces
        for k, word in enumerate(words):
            text = word.decode()
            if plain := self.by_piece and PLAIN(text):
                body, tail = plain.groups()
                body = body.lower()
                if (made := ids.get(body)) is None:
                    made = ids[body] = self.piece(body)
                if tail:
                    made += ids[tail] if tail in ids else ids.setdefault(tail, self.piece(tail))
                out[k] = made
            elif text.isalpha():
                runs[1].append(k)
            elif text[:-1].isalpha() and text[-1] in PUNCTUATION:
                runs[2].append(k)
            else:
                rest.append(k)
        for pieces, some in runs.items():
            for at in range(0, len(some), 2000):
                run = some[at : at + 2000]
                made = self.ids(" ".join([words[k].decode() for k in run]))
                # Each word makes so many pieces at least, so if all make that many times their number, each makes just that many.
                cuts = np.flatnonzero(self.final[made]) + 1
                if len(cuts) == pieces * len(run):
                    cuts, flat, width = cuts[pieces - 1 :: pieces].tolist(), made.tobytes(), made.itemsize
                    for k, x, y in zip(run, [0, *cuts[:-1]], cuts):
                        out[k] = flat[width * x : width * y]
                else:
                    rest += run
        for k, x in zip(rest, self.encode_many([words[k] for k in rest])):
            out[k] = x.tobytes()
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece that the steps before the model have been through, but for its bytes as characters."""
        ids = [x.id for x in self.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(BYTES))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode_runs(self, c: Chunks, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Ids of the runs of words from first to last, which do not overlap; a word that comes again is encoded once."""
        if not len(first):
            return []
        if not self.by_word:
            return [x.tobytes() for x in self.encode_many([c.raw[a:b] for a, b in zip(c.starts[first].tolist(), c.ends[last].tolist())])]
        n = last - first + 1
        end = np.cumsum(n)
        own = np.repeat(first - end + n, n) + np.arange(int(end[-1]))
        keys, at, which = np.unique(c.hashes[own], return_index=True, return_inverse=True)
        if len(self.words) > CACHE_WORDS:
            self.forget()
        spot = np.searchsorted(self.words, keys)
        new = np.append(self.words, 0)[spot] != keys
        new |= spot == len(self.words)
        width = np.dtype(self.kind).itemsize
        if new.any():
            made = self.learn([c.raw[a:b] for a, b in zip(c.starts[own[at[new]]].tolist(), c.ends[own[at[new]]].tolist())])
            size = np.array([len(x) // width for x in made], np.int64)
            self.words = np.insert(self.words, spot[new], keys[new])
            self.sizes = np.insert(self.sizes, spot[new], size)
            self.places = np.insert(self.places, spot[new], len(self.flat) + np.cumsum(size) - size)
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), self.kind)])
            spot = spot + np.cumsum(new) - new  # new words before each
        length = self.sizes[spot][which]
        to = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(self.places[spot][which] - to[:-1], length) + np.arange(to[-1])].tobytes()
        cut = (width * to[np.concatenate([[0], end])]).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; texts without special tokens go in runs, parted by a special token."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        plain, size = [], 0

        def flush() -> None:
            ids = self.ids(self.stop_text.join([texts[i].decode() for i in plain]))
            cuts = np.flatnonzero(ids == self.stop)
            for i, a, b in zip(plain, np.concatenate([[0], cuts + 1]).tolist(), np.concatenate([cuts, [len(ids)]]).tolist()):
                out[i] = ids[a:b]

        for i, text in enumerate(texts):
            if self.open in text or text[-1:] == self.open[:1] or text[:1] == self.shut:
                out[i] = self.ids(text.decode())
                continue
            plain.append(i)
            size += len(text) + len(self.stop_text)
            if size > 1 << 14:
                flush()
                plain, size = [], 0
        if plain:
            flush()
        return out

    def settle(self, joins: list[tuple[bytes, bytes, bytes]]) -> None:
        """Find out for each (left word, both, right word) if encoding the words together makes no difference."""
        ids = self.encode_many([x for join in joins for x in join])
        for k, (_, both, _) in enumerate(joins):
            left, whole, right = ids[3 * k : 3 * k + 3]
            self.agreed[both] = np.array_equal(whole, np.concatenate([left, right]))

    def torn(self, c: Chunks, at: np.ndarray) -> np.ndarray:
        """Which of the chunks at ``at`` do not agree with the one before."""
        left, a = c.starts[c.last[at - 1]].tolist(), c.ends[c.last[at - 1]].tolist()
        b, right = c.starts[c.first[at]].tolist(), c.ends[c.first[at]].tolist()
        both = [c.raw[x:y] for x, y in zip(left, right)]
        if len(self.agreed) > CACHE_JOINS:
            self.agreed.clear()
        new = {w: (c.raw[left[k] : a[k]], w, c.raw[b[k] : right[k]]) for k, w in enumerate(both) if w not in self.agreed}
        if new:
            self.settle(list(new.values()))
        return np.array([not self.agreed[w] for w in both], bool)

    def run(self, c: Chunks, known: dict[tuple[int, int], bytes] | None = None) -> Iterator[bytes]:
        """The ids of each text, as bytes; ``known`` chunks are not encoded again, and what stands between them is encoded as one."""
        pairs = list(zip(c.k1.tolist(), c.k2.tolist())) if known else []
        held = np.array([key in known for key in pairs], bool) if known else np.zeros(len(c.first), bool)
        opens = held.copy()
        opens[1:] |= held[:-1]
        opens[c.bounds[:-1][c.bounds[:-1] < c.bounds[1:]]] = False
        at = np.flatnonzero(opens)
        torn = at[self.torn(c, at)]
        opens[torn] = False
        held[torn] = held[np.maximum(torn - 1, 0)] = False  # encoded as one with the chunk before
        opens[c.bounds[:-1][c.bounds[:-1] < c.bounds[1:]]] = True
        start = np.flatnonzero(opens)
        stop = np.append(start[1:], len(opens)) if len(start) else start
        todo = np.flatnonzero(~held[start])
        made = iter(self.encode_runs(c, c.first[start[todo]], c.last[stop[todo] - 1]))
        parts = [known[pairs[k]] if own else next(made) for k, own in zip(start.tolist(), held[start].tolist())]
        edge = np.searchsorted(start, c.bounds).tolist()
        for x, y in zip(edge, edge[1:]):
            yield parts[x] if y == x + 1 else b"".join(parts[x:y])

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join([self.token[i] for i in ids.tolist()])


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>, decoded string"


def _digest(codec: Codec, ids: list[bytes]) -> list[pa.Array]:
    arrays = [np.frombuffer(x, codec.kind) for x in ids]
    sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in arrays]
    return [pa.array([len(x) for x in arrays], pa.int64()), pa.array(sha, pa.string()), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in arrays], pa.string())]


def _plain(codec: Codec, ids: list[bytes]) -> list[pa.Array]:
    arrays = [np.frombuffer(x, codec.kind) for x in ids]
    return [pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())), pa.array([codec.decode(x).decode() for x in arrays], pa.string())]


def _held(found: Counted, c: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are shared, and which texts are sent to them."""
    shared, n = found.again(c.k1), c.sizes()
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[c.bounds])
    moved = (total(shared) > 0) & (total(shared * n) * LEAST_SHARED >= total(n))
    return shared & np.repeat(moved, np.diff(c.bounds)), moved


def _apply(docs: DataFrame, path: str, scratch: Scratch, chunk_words: int, schema: str, result) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits = max(1, int(total) // SPLIT_BYTES)
    own = F.xxhash64("doc_id", "text").alias("own")
    docs = docs.select("doc_id", "text", own).withColumn("split", F.pmod("own", F.lit(splits)))
    found = Shared(spark, count(docs.select("text"), lambda batch: (chunks_of(d, o, chunk_words).k1 for _, _, d, o in tk.pieces(batch)), HOT, of=docs))
    names = [x.split(" ")[0] for x in schema.split(", ")]
    long = lambda x: pa.array(x.view(np.int64))

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in tk.pieces(batch):
                c = chunks_of(data, offsets, chunk_words)
                shared, _ = _held(found.get(), c)
                row = first + np.repeat(np.arange(len(offsets) - 1), np.diff(c.bounds))[shared]
                k1, k2, split, who = c.k1[shared], c.k2[shared], batch["split"].to_numpy()[row], batch["own"].to_numpy()[row]
                order = np.lexsort((who, split, k2, k1))
                k1, k2, split, who = (x[order] for x in (k1, k2, split, who))
                new = np.ones(len(k1), bool)
                new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (split[1:] != split[:-1])
                salt = np.where(found.get().often(k1[new]), split[new] % SALTS, 0)
                yield pa.RecordBatch.from_arrays([long(k1[new]), long(k2[new]), pa.array(split[new]), pa.array(salt), pa.array(who[new])], ["k1", "k2", "split", "salt", "own"])

    refs = scratch.table(docs.select("text", "own", "split").mapInArrow(references, "k1 long, k2 long, split long, salt long, own long"), "refs")
    owners = refs.groupBy("k1", "k2").agg(F.min("own").alias("own"))
    pair = lambda k, who: tk.mix(k ^ tk.mix(who))
    view = lambda batch, name: batch[name].to_numpy().view(np.uint64)
    heads = Shared(spark, count(owners, lambda batch: iter([np.repeat(pair(view(batch, "k1"), view(batch, "own")), 2)])))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The results of documents without shared chunks, and the ids of the shared chunks that documents own."""
        codec, kinds = Codec(path), None
        keys = ["k1", "k2", "chunk", "hot", "moved"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64()]

        def row(n: int, **given: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in zip([*keys, *names], [*types, pa.int64(), *kinds])], [*keys, *names])

        for batch in batches:
            for first, last, data, offsets in tk.pieces(batch):
                c = chunks_of(data, offsets, chunk_words)
                shared, moved = _held(found.get(), c)
                size, alone = np.diff(c.bounds), np.flatnonzero(~moved)
                cols = result(codec, list(codec.run(c.only(~moved))))
                kinds = kinds or [x.type for x in cols]
                yield row(len(alone), **dict(zip(names, [batch["doc_id"].take(pa.array(first + alone)), *cols])))
                who = batch["own"].to_numpy()[first:last]
                yield row(int(moved.sum()), moved=pa.array(who[moved]))
                at = np.flatnonzero(shared)
                at = at[heads.get().again(pair(c.k1[at], np.repeat(who.view(np.uint64), size)[at]))]
                if len(at):
                    _, spot = np.unique(np.stack([c.k1[at], c.k2[at]]), axis=1, return_index=True)
                    at = at[np.sort(spot)]
                    made = codec.encode_runs(c, c.first[at], c.last[at])
                    yield row(len(at), k1=long(c.k1[at]), k2=long(c.k2[at]), chunk=pa.array(made, pa.binary()), hot=pa.array(found.get().often(c.k1[at])))

    first = scratch.table(docs.select("doc_id", "text", "own").mapInArrow(once, "k1 long, k2 long, chunk binary, hot boolean, moved long, " + schema), "once", wide=True)
    # The chunks, each once, at the splits that hold them.
    table = first.where("k1 is not null").groupBy("k1", "k2").agg(F.any_value("chunk").alias("chunk"), F.any_value("hot").alias("hot"))
    salted = table.select("k1", "k2", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))).alias("salt"))
    at_splits = refs.select("k1", "k2", "salt", "split").distinct().join(salted, ["k1", "k2", "salt"]).select(F.col("split").alias("at"), "k1", "k2", "chunk")
    at_splits = scratch.table(at_splits, "at-splits")

    # Documents that are sent, by a bitmap; those of others that it lets pass too are told apart where they arrive.
    sent = Shared(spark, count(first.where("moved is not null").select("moved"), lambda batch: iter([np.repeat(tk.mix(view(batch, "moved")), 2)])))

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["split", "doc_id", "text"]).filter(pa.array(sent.get().again(tk.mix(view(batch, "own")))))

    rest = docs.select("split", "own", "doc_id", "text").mapInArrow(sharing, "split long, doc_id long, text string")
    held: list[Codec] = []

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        held or held.append(Codec(path))
        keys = zip(right["k1"].to_numpy().view(np.uint64).tolist(), right["k2"].to_numpy().view(np.uint64).tolist())
        known, out = dict(zip(keys, right["chunk"].to_pylist())), []
        for batch in left.select(["doc_id", "text"]).combine_chunks().to_batches():
            for first, last, data, offsets in tk.pieces(batch):
                c = chunks_of(data, offsets, chunk_words)
                _, moved = _held(found.get(), c)
                ids = [x for x, own in zip(held[0].run(c, known), moved) if own]
                out.append(pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first).filter(pa.array(moved)), *result(held[0], ids)], names))
        return pa.Table.from_batches(out) if out else pa.table(dict(zip(names, [pa.array([], pa.int64()), *result(held[0], [])])))

    joined = rest.groupBy("split").cogroup(at_splits.groupBy("at")).applyInArrow(join, schema)
    scratch.drop("refs")
    return first.where("k1 is null and moved is null").select(names).unionByName(joined)


def digests(docs: DataFrame, path: str, scratch: Scratch, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs`` (doc_id, text)."""
    return _apply(docs, path, scratch, chunk_words, DIGESTS, _digest)


def encode(docs: DataFrame, path: str, scratch: Scratch, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) of each row of ``docs`` (doc_id, text)."""
    return _apply(docs, path, scratch, chunk_words, ENCODED, _plain)
