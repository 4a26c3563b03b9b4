"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a share of the corpus by its weight. A share stops at ``max_epochs`` times its
source's size; what is over goes to the others by weight, until no share is above its stop. In the
order of stop / weight the clamped sources are a prefix, so running sums give the level in one pass
over the per-source sizes (no iteration, nothing collected).

A source's target is then drawn as whole repetitions of all its documents and one fractional
repetition: its documents in a seeded order until the rest is used up, the last one in part. Where the order
ends is one place per source, found by two-level sums (per source and hash bucket, then within the one bucket
that holds the end), so a source with a third of all rows is spread over ``BUCKETS`` keys. Every document
then compares its own place with the end of its source: texts are never shuffled. Words are counted once, into a
lean table in the shared folder (``mix_documents`` counts once more when it reads the texts again).

Defined edge cases: null text counts 0 words and is taken 0 words; null source is a source of its own,
last in order; equal rows are separate rows (if the order ends among rows equal in id and size, each of them
gives the same number of words, so the target may be missed by a word a row); a source without words has target
0; an empty table gives no rows; columns besides doc_id, text, source are only carried by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dredge.llm.common import WORD, checkpointed, documents, n_words, quoted

MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash buckets of a source's seeded order: three hex digits.
BUCKETS = 4096
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (src, source_size), one row per source: adds target (double) and quota (long)."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("src")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    level = ranked.withColumns(
        {
            "all_size": F.sum("source_size").over(every),
            "used": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights_left": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("all_size") - F.col("used")).cast("double") / F.col("weights_left"))
    level = level.withColumn("clamped", F.col("cap").cast("double") <= F.col("weight") * F.col("level"))
    # among the open sources the first has the level: it falls with each cap that is then taken off
    water = F.max(F.when(~F.col("clamped"), F.col("level"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * water)
    return level.withColumn("target", target).select(
        "src", "source_size", "target", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("cap")).alias("quota")
    )


def source_key(source: Column) -> Column:
    """A key in code point order with null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


#: The most sources whose ends are broadcast; beyond, they are joined.
NAMED_SOURCES = 100_000


def lean(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """What the plan needs of each document: src, and its place in the order (h, id, size)."""
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.struct(hashed.alias("h"), F.col("doc_id").cast("long").alias("id"), n_words(F.col("text")).alias("size"))
    return docs.select(source_key(F.col("source")).alias("src"), place.alias("place"), *more)


def ends(rows: DataFrame, max_epochs: int) -> DataFrame:
    """Per source of ``lean`` rows: source_size, target, whole repetitions, the place where the fractional one ends, and
    the words that each row at that place gives."""
    bucket = F.substring("place.h", 1, 3)
    buckets = checkpointed(rows.groupBy("src", bucket.alias("b")).agg(F.sum("place.size").alias("bucket_size")))
    per_source = targets(buckets.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    per_source = checkpointed(per_source.withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = buckets.withColumn("before", before).join(per_source, "src").where("before <= rest AND rest < before + bucket_size").select("src", "b", "before", "rest")
    inside = rows.withColumn("b", bucket).join(last, ["src", "b"]).groupBy("src", "place", "before", "rest").agg(F.count("*").alias("n"))
    run = F.sum(F.col("place.size") * F.col("n")).over(Window.partitionBy("src").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    here = inside.withColumn("filled", F.col("before") + run).where("rest < filled")
    end = here.groupBy("src").agg(F.min(F.struct("place", "filled", "n", "rest")).alias("e"))
    given = F.floor((F.col("e.rest") - F.col("e.filled") + F.col("e.place.size") * F.col("e.n")) / F.col("e.n"))
    end = end.select("src", F.col("e.place").alias("end"), given.cast("long").alias("given"))
    return checkpointed(per_source.join(end, "src", "left").select("src", "source_size", "target", "whole", "end", "given"))


def taken(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``lean`` rows with the columns of ``ends`` and the words taken of each."""
    few = per_source.count() <= NAMED_SOURCES
    size = F.col("place.size")
    part = F.when(F.col("place") < F.col("end"), size).when(F.col("place") == F.col("end"), F.col("given")).otherwise(F.lit(0))
    return rows.join(F.broadcast(per_source) if few else per_source, "src").withColumn("taken", (F.col("whole") * size + part).cast("long"))


def mix_plan(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words)."""
    rows = checkpointed(lean(docs, seed))
    return taken(rows, ends(rows, max_epochs)).select(F.col("place.id").alias("doc_id"), F.col("place.size").alias("size"), "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: a row per whole repetition, and one with the first words for a fractional one.

    Columns are those of ``docs``; the ones named text and n_chars follow a fractional repetition.
    """
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row")
    plan = taken(lean(docs, seed, row), ends(checkpointed(lean(docs, seed)), max_epochs))
    size = F.col("place.size")
    times = F.when(size > 0, F.ceil(F.col("taken") / size)).otherwise(F.lit(0)).cast("int")
    plan = plan.where(times > 0).select("row", size.alias("size"), "taken", F.explode(F.sequence(F.lit(1), times)).alias("k"))
    here = F.least(F.col("size"), F.col("taken") - (F.col("k") - 1) * F.col("size"))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    text = F.when(here == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), here.cast("int")), ""))
    plan = plan.select("row", text.alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return plan.select(*[new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_plan(documents(spark, sf_dir, "doc_id", "text", "source"))


SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, {MAX_EPOCHS} * sum(size)::BIGINT AS cap,
    1 + (row_number() OVER (ORDER BY src) - 1) % 3 AS weight FROM d GROUP BY src),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_size,
    (sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_weight FROM s),
g AS (SELECT *, left_size::DOUBLE / left_weight AS level, cap::DOUBLE <= weight * (left_size::DOUBLE / left_weight) AS clamped FROM f),
t AS (SELECT src, source_size, cap, CASE WHEN clamped THEN cap::DOUBLE ELSE weight * (max(level) FILTER (NOT clamped) OVER ()) END AS target FROM g),
q AS (SELECT src, source_size, target, least(floor(target + 0.5)::BIGINT, cap) AS quota FROM t),
r AS (SELECT d.*, source_size, target, quota, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN q ON d.src = q.src)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, quota - whole * source_size - before)))::BIGINT AS taken FROM r
"""
