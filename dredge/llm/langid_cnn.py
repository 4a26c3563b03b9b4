"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy.

Filters of several widths run over one-hot bytes (ASCII letters lowered), each is max-pooled over its
window, and a softmax layer turns the pooled values into language probabilities. A text is cut into
windows of ``WINDOW`` bytes, the last one zero-filled; its distribution is the mean over its windows,
weighted by their text bytes. Windows of many texts are scored together in blocks of ``BLOCK``.

The network learns every language of the labelled documents. It is fitted on about ``PER_LANG`` windows of
each (on ``SAMPLE`` windows in all, if there are many languages): the documented bound of the labelled sample.
Windows are drawn by a hash of document and place, out of all windows of all whole texts (all of them, if
there are fewer), and cut out before anything leaves the scan. Scoring is narrow: no shuffle, memory for one block.

Defined edge cases: null text or text without a letter is ``und`` with score 0; without any labelled
text every text is ``und``; repeated rows are scored alike; an empty table gives no rows; other columns
are ignored; languages are learned as they are written in ``lang``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import checkpointed, documents, split_mod

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
BLOCK = 512
PER_LANG = 2400
SAMPLE = 200_000
#: The most languages whose shares are broadcast; beyond, they are joined.
NAMED_LANGS = 100_000
EPOCHS = 12
BATCH = 64
RATE = 0.01
SEED = 7


@dataclass
class ByteCnn:
    langs: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: list[np.ndarray]  # per width: (FILTERS,)
    out: np.ndarray  # (filters in all, languages)
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled and rectified responses, and per width where each filter's largest response lies."""
        values, places = [], []
        for table, bias in zip(self.tables, self.bias, strict=True):
            k = len(table)
            n = windows.shape[1] - k + 1
            r = table[0][windows[:, :n]]
            for j in range(1, k):
                r += table[j][windows[:, j : j + n]]
            at = r.argmax(axis=1)
            values.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + bias)
            places.append(at)
        return np.maximum(0, np.concatenate(values, axis=1)), places

    def largest(self, windows: np.ndarray) -> np.ndarray:
        """As ``pooled``, without the places."""
        values = []
        for table, bias in zip(self.tables, self.bias, strict=True):
            k = len(table)
            n = windows.shape[1] - k + 1
            r = table[0][windows[:, :n]]
            for j in range(1, k):
                r += table[j][windows[:, j : j + n]]
            values.append(r.max(axis=1) + bias)
        return np.maximum(0, np.concatenate(values, axis=1))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [softmax(self.largest(windows[i : i + BLOCK]) @ self.out + self.out_bias) for i in range(0, len(windows), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, one row each."""
    raw = text.encode().lower()
    raw += bytes(-len(raw) % WINDOW)
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)


def gradients(net: ByteCnn, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted cross-entropy of windows by tables, biases, output weights and output bias."""
    hidden, places = net.pooled(w)
    p = softmax(hidden @ net.out + net.out_bias)
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None]
    back = (p @ net.out.T) * (hidden > 0)
    grads = []
    rows = np.arange(len(y))[:, None]
    for g, (table, at) in enumerate(zip(net.tables, places, strict=True)):
        own = back[:, g * FILTERS : (g + 1) * FILTERS]
        d = np.zeros_like(table)
        for j in range(len(table)):
            np.add.at(d[j], (w[rows, at + j], np.arange(FILTERS)[None, :]), own)
        grads.append(d)
    grads += [back[:, g * FILTERS : (g + 1) * FILTERS].sum(axis=0) for g in range(len(WIDTHS))]
    return [*grads, hidden.T @ p, p.sum(axis=0)]


def new(langs: list[str], rng: np.random.Generator) -> ByteCnn:
    tables = [rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
    return ByteCnn(langs, tables, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], out, np.zeros(len(langs), np.float32))


def fit(windows: np.ndarray, langs: list[str], labels: np.ndarray, seed: int = SEED) -> ByteCnn:
    """Adam on the cross-entropy of window labels, classes weighted evenly."""
    rng = np.random.default_rng(seed)
    net = new(langs, rng)
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(labels, minlength=len(langs)) * len(langs) / len(labels)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            w, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
            grads = gradients(net, w, y, 1 / np.maximum(share[y], 0.05) / len(y))
            step += 1
            for q, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(labelled: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> DataFrame:
    """(lang, doc_id, place, w): about ``per_lang`` windows of each language, drawn out of all windows of all texts."""
    known = labelled.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    n = F.ceil(F.octet_length("text") / WINDOW)
    sizes = checkpointed(known.groupBy("lang").agg(F.sum(n).alias("n")))  # a row for each language
    langs = sizes.count()
    each = max(1, min(per_lang, sample // max(1, langs)))
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")).alias("share"))
    spot = lambda place: F.pmod(F.xxhash64(F.col("doc_id"), place, F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    places = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: spot(k) < F.col("share"))
    shares = F.broadcast(shares) if langs <= NAMED_LANGS else shares
    drawn = known.join(shares, "lang").select("lang", "doc_id", F.col("text").cast("binary").alias("raw"), F.explode(places).alias("place"))
    return drawn.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "place", F.substring("raw", F.col("place") * WINDOW + 1, F.lit(WINDOW)).alias("w"))


def learn(labelled: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> ByteCnn | None:
    """A network from documents (doc_id, text, lang); None without any."""
    rows = sorted(zip(*training_windows(labelled, per_lang, sample).toArrow().to_pydict().values(), strict=True), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3]))
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    windows = np.frombuffer(b"".join(bytes(r[3]).lower().ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit(windows, langs, np.array([number[r[0]] for r in rows]))


def predict(docs: DataFrame, net: ByteCnn | None, *carry: str) -> DataFrame:
    """The carried columns, lang_pred and score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            held, size = [], 0

            def flush(held, langs, scores):
                blocks = [w for _, w, _ in held]
                p = net.probabilities(np.concatenate(blocks))
                at = 0
                for i, w, n in held:
                    weight = np.full(len(w), WINDOW, np.float64)
                    weight[-1] = n - WINDOW * (len(w) - 1)
                    mean = weight @ p[at : at + len(w)] / n
                    at += len(w)
                    best = int(mean.argmax())
                    langs[i], scores[i] = net.langs[best], float(min(1.0, mean[best]))

            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py()
                if net is None or not has_letter(text):
                    continue
                held.append((i, windows_of(text), len(text.encode())))
                size += len(held[-1][1])
                if size >= BLOCK:
                    flush(held, langs, scores)
                    held, size = [], 0
            if held:
                flush(held, langs, scores)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*carry, "text").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "lang_pred string", "score double"]))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; fold 2 of 4 is held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = split_mod(4) == 2
    net = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net, "doc_id", "held_out")
