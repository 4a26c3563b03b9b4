"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes ``len(NAMES)`` transformed statistics. Class means and covariances come from sums and
cross products over all labelled documents of the learning folds, added up in the shuffle as one row
per task and class. A class covariance is shrunk towards the pooled one (``POOL``) and that towards its
diagonal (``DIAGONAL``), so it stays definite even if a statistic never varies in a class. The inverse
Cholesky factors are computed once and cached in the model; a score is the logistic of the difference
of log densities (half Mahalanobis distances and log determinants) plus the log prior odds.

Statistics are computed once per document, from whole texts, and kept as a checkpoint of a few numbers
per document; labels are joined to those numbers, never to texts. Scoring is then narrow.

Defined edge cases: null text is empty and scored like an empty text; repeated rows are scored alike;
without labels of both classes every score is the prior (0.5 without labels); unknown label values
and null labels teach nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from dredge.llm.common import checkpointed, documents, quoted, split_mod, table

NAMES = ("length", "word_length", "upper", "symbols", "shouts", "digits", "distinct", "echoes", "same_lines", "line_length")
D = len(NAMES)
POOL = 0.1
DIAGONAL = 0.05
FLOOR = 1e-3
KEEP = 0.3
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text. Shares are smoothed, so short texts stay near the middle."""
    raw = (text or "").encode()
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = len(words)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = int(h[65:91].sum())
    letters = upper + int(h[97:123].sum() + h[192:].sum())
    spaces = int(h[32] + h[9:14].sum())
    threes = max(0, n - 2)
    echoes = threes - len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log(n + 10.0),
        np.log((len(raw) - spaces + 50.0) / (n + 10.0)),
        np.log((upper + 1.0) / (letters + 20.0)),
        np.log((int(h[SYMBOLS].sum()) + 0.5) / (n + 10.0)),
        np.log((int(h[33]) + 0.5) / (n + 10.0)),
        np.log((int(h[48:58].sum()) + 5.0) / (n + 50.0)),
        np.log((len(set(words)) + 10.0) / (n + 10.0)),
        np.log((echoes + 2.0) / (threes + 40.0)),
        np.log((len(lines) - len(set(lines)) + 1.0) / (len(lines) + 10.0)),
        np.log((n + 40.0) / (len(lines) + 4.0)),
    ]


def with_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns and the statistics ``x`` (array) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    fields = docs.schema
    schema = StructType([*[fields[c] for c in carry], StructField("x", ArrayType(DoubleType()))])
    return docs.select(*[quoted(c) for c in carry], "text").mapInArrow(run, schema)


@dataclass
class Qda:
    """Means, inverse Cholesky factors and log densities' constants of the classes 0 and 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.constants[0])))
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Qda:
    """From class to (count, sums, cross products)."""
    n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Qda([], [], [float(np.log((n[1] + 1) / (n[0] + 1)))])
    means = {k: moments[k][1] / n[k] for k in (0, 1)}
    covs = {k: moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(pooled))
    factors, constants = [], []
    for k in (0, 1):
        own = POOL + (1 - POOL) * len(pooled) / (len(pooled) + n[k])  # few documents: closer to the pooled
        lower = np.linalg.cholesky((1 - own) * covs[k] + own * pooled)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(lower)).sum()))
    return Qda([means[0], means[1]], factors, constants)


def exact(value: Column) -> Column:
    """A sum that does not depend on the order of the rows: of decimals."""
    return F.sum(value.cast("decimal(22,14)")).cast("double")


def learn(labelled: DataFrame) -> Qda:
    """From rows of statistics ``x`` and ``y`` (0 or 1)."""
    x = [F.get("x", F.lit(i)) for i in range(D)]
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    sums = labelled.where("y IN (0, 1)").groupBy("y").agg(
        F.count("*").alias("n"), F.array(*[exact(c) for c in x]).alias("s"), F.array(*[exact(x[i] * x[j]) for i, j in pairs]).alias("ss")
    )
    moments = {}
    for r in sums.collect():  # two rows
        square = np.zeros((D, D))
        for (i, j), v in zip(pairs, r["ss"], strict=True):
            square[i, j] = square[j, i] = v
        moments[int(r["y"])] = (float(r["n"]), np.array(r["s"]), square)
    return fit(moments)


def score_column(spark: SparkSession, model: Qda) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(x.flatten().to_numpy().reshape(-1, D)))

    return scored("x")


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns.

    The statistics of a text are computed for the fit and once more where the text is kept or left: that costs
    less than to shuffle all texts for a join with their scores. A null text is scored like an empty one.
    """
    marked = checkpointed(with_statistics(docs.select("doc_id", "text"), "doc_id"))
    y = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    model = learn(marked.join(y, "doc_id"))
    rows = with_statistics(docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row"), "text"), "row")
    kept = rows.where(score_column(docs.sparkSession, model) >= threshold)
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; fold 0 of 5 is held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = checkpointed(with_statistics(docs.select("doc_id", (split_mod(5) == 0).alias("held_out"), "text"), "doc_id", "held_out"))
    y = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    model = learn(rows.where("NOT held_out").join(y, "doc_id"))
    scored = rows.select("doc_id", "held_out", score_column(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
