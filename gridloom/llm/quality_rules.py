"""Quality rules: fixed base rules, and a learned decision list, as Spark conditional expressions.

``features`` measures each whole text with built-in functions.  ``learn`` grows an ordered list of
conjunctions of thresholds from labelled rows by sequential covering: grow a rule condition by
condition on one part of the labelled rows, prune it on the other, keep it if it is precise
there, take out the rows it covers, and go on.  ``verdict`` turns the list into CASE WHEN.

Words are runs outside ``[\\x20\\x09-\\x0D]``.  Null texts have none.  A text without words fails the
base rules.  Labels that are null teach nothing; without labels of both kinds the list is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CUTS, MAX_RULES, MAX_TERMS, MIN_PRECISION, MIN_COVER = 12, 8, 3, 0.97, 8

SPACES = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"
MEASURES = ["symbols", "dup_lines", "repeats", "mean_word", "upper", "digits", "marks", "log_words", "variety", "line_words", "non_ascii"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(w: Column, h: Column) -> Column:
    """Words in 3-word windows whose hash comes twice or more: sort the windows, compare neighbours, unite spans."""
    keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - i)).alias("n"))
    return let(keyed, lambda s: F.aggregate(places(s), start, step)["n"])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, BASE and the measures that rules are learned from; with ``carry`` the whole row too, as a struct."""
    more = ["row"] if carry else []
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("t"), *row).select(
        "doc_id",
        *more,
        "t",
        F.array_remove(F.split("t", SPACES), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "").alias("lines"),
    )
    windows = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated(F.col("w"), h)))
    df = df.select(
        "doc_id",
        *more,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_kinds"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("t", F.lit("[!?]")).alias("n_marks"),
        F.octet_length("t").alias("n_bytes"),
        F.length("t").alias("n_all"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        "doc_id", *more, *BASE,
        per("n_symbols", "word_chars").alias("symbols"),
        per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("word_chars", "n_words").alias("mean_word"),
        per("n_upper", "word_chars").alias("upper"),
        per("n_digits", "word_chars").alias("digits"),
        per("n_marks", "word_chars").alias("marks"),
        F.log1p("n_words").alias("log_words"),
        per("n_kinds", "n_words").alias("variety"),
        per("n_words", "n_lines").alias("line_words"),
        ((F.col("n_bytes") - F.col("n_all")) / F.greatest(F.col("n_all"), F.lit(1))).alias("non_ascii"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.measure) > self.cut if self.above else F.col(self.measure) <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Term, ...]


def _all(terms: Rule) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The place of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), k).otherwise(out)
    return out


def learn(labelled: DataFrame, scratch: Scratch, measures: list[str] = MEASURES, max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Rules for label 0 from ``labelled`` (doc_id, label, measures). Only counts per measure and cut come to the driver."""
    rows = labelled.where("label is not null").select((F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *measures)
    rows = scratch.table(rows, "labelled")
    at = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    found = rows.agg(*[F.percentile_approx(F.when(w, F.col(m)), at, 1000).alias(f"{m}_{k}") for m in measures for k, w in enumerate((F.lit(True), F.col("bad")))]).first()
    cuts = {m: sorted({*(found[f"{m}_0"] or []), *(found[f"{m}_1"] or [])}) for m in measures}
    # The number of cuts below a value: value > cuts[j] is bin > j.

    def rank(m: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[m]]), lambda c: c < F.col(m))) if cuts[m] else F.lit(0)

    rows = scratch.table(rows.select("bad", "prune", *[rank(m).alias(m) for m in measures]), "binned")
    covered, rules = F.lit(False), []

    def holds(terms: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for m, above, j in terms:
            out = out & (F.col(m) > j if above else F.col(m) <= j)
        return out

    def grow() -> list[tuple[str, bool, int]]:
        terms: list[tuple[str, bool, int]] = []
        while len(terms) < MAX_TERMS:
            live = rows.where(~covered & ~F.col("prune") & holds(terms))
            long = live.select("bad", F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col(m).alias("bin")) for k, m in enumerate(measures)])).alias("x"))
            table: dict[int, dict[int, list[int]]] = {}
            for r in long.groupBy("x.m", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():  # a row per measure and bin
                table.setdefault(r["m"], {})[r["bin"]] = [r["p"], r["n"]]
            if not table:
                return []
            p0, n0 = (sum(x[k] for x in table[min(table)].values()) for k in (0, 1))
            if n0 == 0 or p0 == 0:
                break
            best, score = None, 1e-9
            for k, m in enumerate(measures):
                p = n = 0
                for j in range(len(cuts[m])):
                    a, b = table.get(k, {}).get(j, [0, 0])
                    p, n = p + a, n + b
                    for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                        if x >= min_cover / 2 and (gain := x * (_info(x, y) - _info(p0, n0))) > score:
                            best, score = (m, above, j), gain
            if best is None:
                break
            terms.append(best)
        return terms

    while len(rules) < max_rules:
        terms = grow()
        if not terms:
            break
        heads = [terms[:k] for k in range(1, len(terms) + 1)]
        sums = rows.where(~covered & F.col("prune")).agg(*[F.count_if(holds(h) & F.col("bad")).alias(f"p{k}") for k, h in enumerate(heads)], *[F.count_if(holds(h) & ~F.col("bad")).alias(f"n{k}") for k, h in enumerate(heads)]).first()
        k = max(range(len(heads)), key=lambda k: ((sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]), sums[f"p{k}"]))
        p, n = sums[f"p{k}"], sums[f"n{k}"]
        covered = covered | holds(heads[k])
        if p + n >= min_cover / 2 and p >= min_precision * (p + n):
            rules.append(tuple(Term(m, above, float(cuts[m][j])) for m, above, j in heads[k]))
        elif p + n == 0 or p < 0.5 * (p + n):
            break
    scratch.drop("labelled", "binned")
    return rules


def _info(p: int, n: int) -> float:
    import math

    return math.log2((p + 0.5) / (p + n + 1))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, carry: bool = False) -> tuple[DataFrame, list[Rule]]:
    """``features`` of each document with base_failed, rule and kept, and the rules learned from ``labels`` (doc_id, quality)."""
    feats = scratch.table(features(docs, carry), "features", wide=True)
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    # What fails the base rules is gone already, and teaches nothing.
    rules = learn(feats.where(~base_failed()).select("doc_id", *MEASURES).join(marked, "doc_id"), scratch)
    out = feats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
