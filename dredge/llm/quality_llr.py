"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and pairs of adjacent words of a text are hashed into ``BUCKETS`` buckets. Two multinomials are counted: the
raw corpus over all documents, and the trusted target over all documents labelled good. A document's score is the
mean of log(target / raw) over its n-grams, so it does not depend on length; it is kept if the score reaches a
cut and the base rules pass. All documents are scored.

The level of the ratio depends on the size of the table, and a trusted document's own n-grams raise its
score. So trusted documents are scored without their own counts, and the cut is the ``CUT_QUANTILE`` of the
scores of those that pass the base rules: what a trusted document would reach as an unlabelled one. It is the
exact quantile of all of them.

Counting is one scan: up to ``BROADCAST_IDS`` trusted ids go to every task, more are joined by a shuffle of ids and
texts (no task holds them all); n-grams are counted per task before the shuffle of counts, which has at most
BUCKETS rows per task whatever the corpus. Scoring is a second scan without a shuffle of texts: the weights
(BUCKETS doubles) are a scalar subquery's value, each text that may be trusted (a filter of hashed ids never misses
one) gets its score with and without its own counts, and the narrow rows of scores are joined with the trusted ids,
which decides.

Defined edge cases: null or empty text has no words, fails the base rules and has a null score; repeated
rows are scored alike and counted once each; without trusted documents the ratio is nowhere informative
(score 0 everywhere) and only base rules decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import WORD, checkpointed, documents, quoted, table, words
from dredge.operators.ranged import in_ranges, running

BUCKETS = 1 << 17
#: So many trusted ids are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 10_000
#: Bits an id, and in all, of the filter that spares other documents the second score; beyond it more are scored twice in vain.
ID_BITS, MOST_BITS = 16, 1 << 26
SMOOTH = 0.5
#: The share of trusted documents that may lie below the cut.
CUT_QUANTILE = 0.005
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row (a lambda variable, which the optimizer does not inline)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashes(w: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(w, lambda x: F.xxhash64(x))


def pairs(h: Column) -> Column:
    """Hashes of all pairs of adjacent words, from the word hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def repeated_words(w: Column, p: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, from the words and the hashes of their pairs.

    If the windows' hashes are all distinct so are the windows; only else are the windows themselves sorted, those
    whose hash (33 bits of it, above the place) is found twice.
    """
    n = F.greatest(F.size(p) - 1, F.lit(0))
    hashed = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    near = lambda x, y: F.shiftright(x.bitwiseXOR(y), 31) == 0

    def suspects(v: Column) -> Column:
        placed = F.sort_array(F.transform(v, lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))
        alike = let(placed, lambda s: F.filter(s, lambda x, i: near(x, F.get(s, i + 1)) | near(x, F.get(s, i - 1))))
        return F.transform(alike, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))

    def windows(places: Column) -> Column:
        return F.transform(places, lambda i: F.struct(F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)).alias("t"), i.alias("i")))

    def covered(v: Column) -> Column:
        twice = let(
            F.sort_array(windows(suspects(v))),
            lambda s: F.transform(F.filter(s, lambda x, i: (x["t"] == F.get(s, i + 1)["t"]) | (x["t"] == F.get(s, i - 1)["t"])), lambda x: x["i"]),
        )
        # windows of three words at ascending places: each adds what the one before does not cover
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return let(hashed, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def base_columns(t: Column, w: Column, p: Column) -> dict[str, Column]:
    """From a text, its words and the hashes of their pairs: the base statistics."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": duplicate_lines(t).cast("long"),
        "n_repeat_words": repeated_words(w, p).cast("long"),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled good."""
    return labels.where("quality = 1").select("doc_id").distinct()


def marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows with ``_trusted``: whether their id is a trusted one."""
    ids = trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_good"))
    ids = F.broadcast(ids) if trusted.count() <= BROADCAST_IDS else ids.hint("merge")
    return rows.join(ids, F.col("doc_id") == F.col("_id"), "left").withColumn("_trusted", F.coalesce("_good", F.lit(False))).drop("_id", "_good")


def id_place(bits: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), bits if isinstance(bits, Column) else F.lit(bits))


def id_filter(trusted: DataFrame) -> DataFrame:
    """One row: a bit array ``bits``, as longs, with the bits of all hashed ids."""
    n = min(MOST_BITS, 1 << max(10, (ID_BITS * trusted.count()).bit_length()))
    place = trusted.select(id_place(n).alias("p"))
    words_ = place.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    every = trusted.sparkSession.range(n // 64).select(F.col("id").alias("w")).join(words_, "w", "left").fillna(0)
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bits"))


def may_be_trusted(bits: Column) -> Column:
    place = id_place(F.size(bits).cast("long") * 64)
    return F.getbit(F.get(bits, (place / 64).cast("int")), (place % 64).cast("int")) == 1


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> DataFrame:
    """One row: arrays over the buckets of the log-likelihood ratios, of the same less a single n-gram of one's own (``alone``), and of the trusted counts; their sum."""
    rows = marked(docs.select("doc_id", "text"), trusted)
    good = F.col("_trusted").cast("long").alias("good")
    # a row per word, then one per n-gram: without lambdas all of it is compiled
    w = rows.select(good, words(F.col("text")).alias("w")).select("good", "w", F.posexplode("w").alias("at", "word"))
    h, following = F.xxhash64("word"), F.get("w", F.col("at") + 1)
    both = w.select("good", h.alias("h"), F.when(following.isNotNull(), F.xxhash64(h, F.xxhash64(following))).alias("p"))
    grams = both.select("good", F.explode(F.array("h", "p")).alias("g")).where("g IS NOT NULL")
    counts = grams.groupBy(bucket(F.col("g"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0)
    row = every.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("rows"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))

    def ratio(x: Column) -> Column:
        good = F.log((x["good"] + smooth) / (F.col("all_good") + smooth * buckets))
        raw = F.log((x["raw"] + smooth) / (F.col("all_raw") + smooth * buckets))
        return F.when(F.col("all_good") > 0, good - raw).otherwise(F.lit(0.0))

    weights = [F.transform("rows", ratio), F.transform("rows", lambda x: ratio(x) + fewer(x["good"], F.lit(1), F.lit(0), smooth)), F.transform("rows", lambda x: x["good"])]
    return row.select(*[w.alias(n) for w, n in zip(weights, ("weights", "alone", "counts"), strict=True)], "all_good")


def fewer(n: Column, less: Column, than: Column, smooth: float) -> Column:
    """What a bucket's log count changes by with ``less`` n-grams taken out instead of ``than``; no count goes below none (only trusted documents' own are in it)."""
    return F.log((F.greatest(n - less, F.lit(0)) + smooth) / (F.greatest(n - than, F.lit(0)) + smooth))


def mean_weight(g: Column, weights: Column) -> Column:
    """Mean weight of the n-grams of an array of buckets; null without any."""
    return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weights, b)) / F.size(g))


def left_out(g: Column, alone: Column, counts: Column, all_good: Column, buckets: int = BUCKETS, smooth: float = SMOOTH) -> Column:
    """A trusted document's mean ratio without its own n-grams in the trusted counts, from the sorted buckets of its n-grams."""

    def again(more: Column) -> Column:
        # buckets of several n-grams, each without its first one. The places where a run ends; the distance to the one before is the run's length
        ends = F.filter(F.sequence(F.lit(0), F.size(more) - 1), lambda i: F.coalesce(F.get(more, i) != F.get(more, i + 1), F.lit(True)))
        runs = let(ends, lambda e: F.transform(e, lambda at, k: F.struct((at - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(-1)) + 1).alias("c"), F.get(counts, F.get(more, at)).alias("n"))))
        change = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + r["c"] * fewer(r["n"], r["c"], F.lit(1), smooth))
        return F.when(F.size(more) > 0, change).otherwise(F.lit(0.0))

    repeated = F.filter(g, lambda b, i: b == F.get(g, i - 1))
    total = F.log((all_good - F.size(g) + smooth * buckets) / (all_good + smooth * buckets))
    return mean_weight(g, alone) + let(repeated, again) / F.size(g) - total


def scored(docs: DataFrame, model: DataFrame, min_words: int = MIN_WORDS, buckets: int = BUCKETS, among: DataFrame | None = None) -> DataFrame:
    """doc_id, the text's hash, base statistics, base_failed, score; with the row of ``id_filter`` also ``left_out``, the score if the document is a trusted one."""
    rows, fair = docs.select("doc_id", F.col("text").alias("_text")), among is not None
    if fair:
        rows = rows.withColumn("bits", among.scalar()).select("doc_id", "_text", may_be_trusted(F.col("bits")).alias("_maybe"))

    def scores(g: Column) -> Column:
        own = lambda s: left_out(s, F.col("alone"), F.col("counts"), F.col("all_good"), buckets)
        return F.struct(mean_weight(g, F.col("weights")).alias("score"), *([F.when(F.col("_maybe") & (F.size(g) > 0), let(F.sort_array(g), own)).alias("left_out")] if fair else []))

    def measured(x: Column) -> Column:
        grams = F.transform(F.concat(x["h"], x["p"]), lambda g: bucket(g, buckets))
        return F.struct(*[v.alias(k) for k, v in base_columns(x["t"], x["w"], x["p"]).items()], let(grams, scores).alias("s"))

    def checked(x: Column) -> Column:
        failed = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        return F.struct(*[x[k].alias(k) for k in MEASURES], failed.alias("base_failed"), x["s"].alias("s"))

    split = F.struct(F.coalesce("_text", F.lit("")).alias("t"), words(F.col("_text")).alias("w"))
    hashed = let(split, lambda x: let(hashes(x["w"]), lambda h: F.struct(x["t"].alias("t"), x["w"].alias("w"), h.alias("h"), pairs(h).alias("p"))))
    # one expression with all results as fields measures a text once. The arrays of the model are used once, in
    # the projection that names them, so no row carries a copy.
    for name in ("weights", "alone", "counts", "all_good") if fair else ("weights",):
        rows = rows.withColumn(name, model.select(name).scalar())
    rows = rows.withColumn("j", let(let(hashed, measured), checked))
    found = [F.col(f"j.{k}").alias(k) for k in (*MEASURES, "base_failed")] + [F.col(f"j.s.{k}").alias(k) for k in ("score", "left_out")[: 1 + fair]]
    return rows.select("doc_id", F.xxhash64("_text").alias("_key"), *found)


def fair_scores(docs: DataFrame, trusted: DataFrame, model: DataFrame, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """As ``scored``, trusted documents without their own counts, and ``_trusted``."""
    rows = marked(scored(docs, model, min_words, buckets, checkpointed(id_filter(trusted))), trusted)
    return rows.withColumn("score", F.when(F.col("_trusted"), F.col("left_out")).otherwise(F.col("score"))).drop("left_out")


def verdicts(rows: DataFrame, min_score: float, *more: str) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, score, and the columns ``more``."""
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= min_score, F.lit(False))
    return rows.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), "score", *more)


def judge(docs: DataFrame, trusted: DataFrame, min_score: float = 0.0, min_words: int = MIN_WORDS, buckets: int = BUCKETS, model: DataFrame | None = None) -> DataFrame:
    """doc_id, base statistics, base_failed, kept and score.

    model: where given, the row of ``log_ratios``, and trusted documents are scored without their own counts.
    """
    if model is None:
        return verdicts(scored(docs, log_ratios(docs, trusted, buckets), min_words, buckets), min_score)
    return verdicts(fair_scores(docs, trusted, model, min_words, buckets), min_score)


def quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of the column ``score``: the least score that reaches the share, by running counts over ranges of scores; None without rows."""
    counts = checkpointed(scores.groupBy("score").agg(F.count("*").alias("k")))
    rank = max(1, math.ceil(share * (counts.agg(F.sum("k")).first()[0] or 0)))
    upto = running(in_ranges(counts, ["score"]), ["score"], "upto", F.sum("k"), F.sum("k"), F.sum("total"), F.coalesce("before", F.lit(0)) + F.col("inside"))
    return upto.where(F.col("upto") >= rank).agg(F.min("score")).first()[0]


def fair_verdicts(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Verdicts by the low quantile of what trusted documents score without their own counts; without any, no cut."""
    trusted = checkpointed(trusted_ids(labels))
    rows = checkpointed(fair_scores(docs, trusted, checkpointed(log_ratios(docs, trusted))))
    cut = quantile(rows.where("_trusted AND NOT base_failed").select("score"), CUT_QUANTILE)
    return verdicts(rows, float("-inf") if cut is None else cut, *more)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever those are called.

    Null and empty texts go (too few words); equal rows share one verdict; without trusted documents only the
    base rules decide. Verdicts find their rows by id and the text's 64-bit hash, so texts are not measured twice.
    """
    carry = docs.columns
    kept = fair_verdicts(docs, labels, "_key").where("kept").select("doc_id", "_key")
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), *[F.col(quoted(c)).alias(f"_carry_{k}") for k, c in enumerate(carry)])
    found = rows.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_key")), "left_semi")
    return found.select(*[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict."""
    return fair_verdicts(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
