"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as words (ASCII letters lowered, signs at their ends taken off). Each word gives a word
vector (words known from training; all others share one) and a character vector (mean of hashed
character trigrams of the marked word); both feed a forward and a backward GRU
over overlapping windows of ``WINDOW`` words at every ``STRIDE`` words, the last window at the text's
end. Attention pools the states of a window; a logistic unit scores it. A text's score is that of its
worst window, so every part of every text counts and length does not dilute.

Labels mark documents, not places: in training a document stands for one window. That is the one whose
words speak most for the label (log odds over the sample) at first, and then the worst under the
network so far. The network is fitted on at most ``POSITIVES`` toxic and ``NEGATIVES`` other documents of the learning
folds, chosen by hashed id (all if there are fewer): the documented bound of the labelled sample. Ids
are chosen first and broadcast (their number is that bound), so texts are never shuffled. The words of
their whole texts are counted on the executors, where then each document gives its candidates: of all its
windows the ``LIKELY`` ones with the most evidence, wherever they lie, and ``RANDOM`` others. So the driver
gets a bounded number of words per document and no text is cut.

Input projections are computed once per distinct word of a block and gathered per step. Scoring is
narrow; memory is bounded by ``BLOCK_WORDS`` words and one text.

Defined edge cases: null, empty or wordless text scores 0; repeated rows are scored alike; without
labels of both kinds the model scores every text 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import checkpointed, documents, split_mod, table

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_DIM, CHAR_DIM = 6, 6
WORD_ROWS, CHAR_ROWS = 8192, 8192
SIGNS = b".,;:!?#*$%&|<>\"'()[]{}-_=+/\\~^@"
LEAST_SEEN = 4
BLOCK_WORDS = 100_000
POSITIVES, NEGATIVES = 700, 1000
LIKELY, RANDOM = 8, 40
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.02, 11
#: Small samples are shown more often, until there are this many steps.
STEPS = 600
#: The share of epochs that begins with the likeliest windows.
START = 5 / 14
DECAY = 1e-4
CUT = 0.7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def coded(words: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, and the character trigram rows of all words with each word's first place among them."""
    words = [w.strip(SIGNS) or w for w in words]  # every marked word has a trigram
    rows = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
    flat = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in words]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    hashed = (flat[:-2] * 0x9E3779B1 + flat[1:-1] * 0x85EBCA77 + flat[2:] * 0xC2B2AE3D).astype(np.uint32)
    hashed = ((hashed ^ (hashed >> 15)) % CHAR_ROWS).astype(np.int64)
    inside = np.ones(len(flat), bool)  # a trigram starts at every place but a word's last two
    inside[ends - 1] = inside[ends - 2] = False
    starts = np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])
    return rows, hashed[inside[:-2]], starts


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


@dataclass
class Gru:
    """Parameters; the leading axis 2 of the recurrent ones is the direction, gates are reset, update, new."""

    word: np.ndarray  # (WORD_ROWS, WORD_DIM)
    char: np.ndarray  # (CHAR_ROWS, CHAR_DIM)
    w: np.ndarray  # (2, WORD_DIM + CHAR_DIM, 3 * HIDDEN)
    b: np.ndarray  # (2, 3 * HIDDEN)
    u: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    a: np.ndarray  # (2 * HIDDEN, HIDDEN) attention
    av: np.ndarray  # (HIDDEN,)
    o: np.ndarray  # (2 * HIDDEN,)
    ob: np.ndarray  # (1,)
    vocabulary: dict[bytes, int]  # row 0 is for all other words

    @classmethod
    def new(cls, seed: int, vocabulary: dict[bytes, int]) -> Gru:
        rng = np.random.default_rng(seed)
        g = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        return cls(g(0.2, WORD_ROWS, WORD_DIM), g(0.2, CHAR_ROWS, CHAR_DIM), g(0.4, 2, d, 3 * h), np.zeros((2, 3 * h), np.float32), g(0.3, 2, h, 3 * h), g(0.3, 2 * h, h), g(0.3, h), g(0.3, 2 * h), np.zeros(1, np.float32), vocabulary)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what the backward pass needs."""
        rows, grams, starts = coded(words, self.vocabulary)
        counts = np.diff(np.append(starts, len(grams)))
        chars = np.add.reduceat(self.char[grams], starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate([self.word[rows], chars], axis=1), (rows, grams, counts)

    def states(self, proj: np.ndarray, ids: np.ndarray, real: np.ndarray | None, keep: bool = False):
        """States (step, window, 2 * HIDDEN) of windows of word ids (window, step); real: False where padded."""
        n, steps = ids.shape
        h2 = 2 * HIDDEN
        out = np.empty((steps, n, h2), np.float32)
        tape = []
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            u_gates, u_new = np.ascontiguousarray(self.u[d][:, :h2]), np.ascontiguousarray(self.u[d][:, h2:])
            for t in order:
                x = proj[d][ids[:, t]]
                gates = h @ u_gates
                gates += x[:, :h2]
                np.negative(gates, out=gates)
                np.exp(np.minimum(gates, 30, out=gates), out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
                rh = r * h
                c = np.tanh(x[:, h2:] + rh @ u_new)
                nxt = c + z * (h - c)
                if real is not None:
                    nxt = np.where(real[:, t, None], nxt, h)
                if keep:
                    tape.append((d, t, h, r, z, rh, c))
                h = nxt
                out[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out, tape

    def pool(self, states: np.ndarray, real: np.ndarray | None):
        q = np.tanh(states @ self.a)
        e = q @ self.av
        if real is not None:
            e = np.where(real.T, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        context = np.einsum("tn,tnh->nh", alpha, states)
        return sigmoid(context @ self.o + self.ob[0]), q, alpha, context

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ self.w[d] + self.b[d] for d in (0, 1)])

    def score_texts(self, texts: list[list[bytes]]) -> np.ndarray:
        """The score of each text's worst window; 0 for a text without words."""
        scores, worst = np.zeros(len(texts)), self.window_scores(texts)
        for i, p in worst.items():
            scores[i] = p.max()
        return scores

    def window_scores(self, texts: list[list[bytes]]) -> dict[int, np.ndarray]:
        """The scores of all windows of each text that has words."""
        vocabulary: dict[bytes, int] = {}
        found: dict[int, np.ndarray] = {}
        short, long = [], []
        for i, words in enumerate(texts):
            if words:
                ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
                (long if len(words) >= WINDOW else short).append((i, ids))
        if not vocabulary:
            return found
        proj = self.project(self.inputs(list(vocabulary))[0])
        step = np.arange(WINDOW)
        for i, ids in short:
            found[i] = self.pool(self.states(proj, ids[None, :], None)[0], None)[0]
        if long:
            flat, begins, counts, at = [], [], [], 0
            for _, ids in long:
                starts = window_starts(len(ids))
                flat.append(ids)
                begins.append(starts + at)
                counts.append(len(starts))
                at += len(ids)
            flat, begins = np.concatenate(flat), np.concatenate(begins)
            p = np.concatenate([self.pool(self.states(proj, flat[b[:, None] + step], None)[0], None)[0] for b in (begins[k : k + 4096] for k in range(0, len(begins), 4096))])
            for (i, _), own in zip(long, np.split(p, np.cumsum(counts)[:-1]), strict=True):
                found[i] = own
        return found


def gradients(net: Gru, words: list[bytes], ids: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted cross-entropy of windows, as a list in the order of the fields."""
    x, (rows, grams, counts) = net.inputs(words)
    proj = net.project(x)
    states, tape = net.states(proj, ids, real, keep=True)
    p, q, alpha, context = net.pool(states, real)
    d_logit = ((p - y) * weight).astype(np.float32)
    g_o, g_ob = context.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_context = d_logit[:, None] * net.o
    d_states = alpha[:, :, None] * d_context[None]
    d_alpha = np.einsum("nh,tnh->tn", d_context, states)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g_av = np.einsum("tn,tnk->k", d_e, q)
    d_q = d_e[:, :, None] * net.av * (1 - q * q)
    g_a = np.einsum("tnh,tnk->hk", states, d_q)
    d_states += d_q @ net.a.T
    g_u, g_proj = np.zeros_like(net.u), np.zeros_like(proj)
    h2 = 2 * HIDDEN
    carried = [np.zeros((len(ids), HIDDEN), np.float32) for _ in (0, 1)]
    for d, t, h, r, z, rh, c in reversed(tape):
        dh = d_states[t][:, d * HIDDEN : (d + 1) * HIDDEN] + carried[d]
        live = real[:, t, None]
        dn = np.where(live, dh, 0)
        back = np.where(live, 0, dh)
        dz = dn * (h - c) * z * (1 - z)
        dc = dn * (1 - z) * (1 - c * c)
        d_rh = dc @ net.u[d][:, h2:].T
        dr = d_rh * h * r * (1 - r)
        back = back + dn * z + d_rh * r
        gates = np.concatenate([dr, dz], axis=1)
        g_u[d][:, :h2] += h.T @ gates
        g_u[d][:, h2:] += rh.T @ dc
        back += gates @ net.u[d][:, :h2].T
        np.add.at(g_proj[d], ids[:, t], np.concatenate([gates, dc], axis=1))
        carried[d] = back
    g_w = np.stack([x.T @ g_proj[d] for d in (0, 1)])
    g_b = g_proj.sum(axis=1)
    g_x = g_proj[0] @ net.w[0].T + g_proj[1] @ net.w[1].T
    g_word, g_char = np.zeros_like(net.word), np.zeros_like(net.char)
    np.add.at(g_word, rows, g_x[:, :WORD_DIM])
    np.add.at(g_char, grams, np.repeat(g_x[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
    return [g_word, g_char, g_w, g_b, g_u, g_a, g_av, g_o, g_ob]


PARAMETERS = ("word", "char", "w", "b", "u", "a", "av", "o", "ob")


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(doc_id, y, words) of rows doc_id, y, text."""
    for batch in batches:
        for doc, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            yield doc, y, (text.as_py() or "").encode().lower().split()


def evidence(sample: DataFrame) -> tuple[dict[bytes, int], dict[bytes, float]]:
    """The vocabulary of the sample (doc_id, y, text), and each word's log odds for the label where they are positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, words in word_lists(batches):
            own = sorted({w.strip(SIGNS) for w in words} - {b""})
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([y] * len(own), pa.int64())], ["word", "y"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = sample.mapInArrow(run, "word binary, y long").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    known = seen.where(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "word").limit(WORD_ROWS - 1).collect()
    odds = {bytes(r["word"]): float(np.log((r["toxic"] + 0.5) / (n.get(1, 0) + 1)) - np.log((r["n"] - r["toxic"] + 0.5) / (n.get(0, 0) + 1))) for r in known if r["toxic"] > 1}
    return {bytes(r["word"]): i for i, r in enumerate(known, 1)}, {w: x for w, x in odds.items() if x > 0}


def candidates(words: list[bytes], odds: dict[bytes, float], seed: int) -> list[list[bytes]]:
    """Windows of a text to learn from: those with the most evidence, the first of them in front, and others at random."""
    sums = np.cumsum([0.0, *(odds.get(w.strip(SIGNS), 0.0) ** 2 for w in words)])
    starts = window_starts(len(words))
    order = np.argsort(sums[starts] - sums[np.minimum(starts + WINDOW, len(words))], kind="stable")
    rest = order[LIKELY:]
    drawn = np.random.default_rng(seed).permutation(len(rest))[:RANDOM]
    return [words[starts[k] : starts[k] + WINDOW] for k in (*order[:LIKELY], *rest[drawn])]


def fit(windows: list[list[list[bytes]]], labels: np.ndarray, vocabulary: dict[bytes, int], seed: int = SEED) -> Gru:
    """Adam on one window per document and epoch, out of the document's candidates (the likeliest one first)."""
    net = Gru.new(seed, vocabulary)
    rng = np.random.default_rng(seed)
    params = [getattr(net, name) for name in PARAMETERS]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    ends = np.cumsum([len(w) for w in windows])
    flat = [w for own in windows for w in own]
    last = np.zeros(len(windows), np.int64)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(windows)))
    every = epochs // EPOCHS  # windows are scored anew as often as in a fit of EPOCHS epochs
    for epoch in range(epochs):
        chosen = np.array([rng.integers(len(own)) for own in windows])
        if epoch < START * epochs:
            chosen = np.where(labels == 1, 0, chosen)
        elif epoch % every == 0 and epoch // every % 3 != 2:  # in other epochs texts of label 0 are shown at random places
            scores = np.concatenate([net.score_texts(flat[i : i + 4096]) for i in range(0, len(flat), 4096)])
            chosen = np.array([int(own.argmax()) for own in np.split(scores, ends[:-1])])
        else:
            chosen = np.where(labels == 1, last, chosen)
        last = chosen
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            picked = order[i : i + BATCH]
            places: dict[bytes, int] = {}
            ids, real = np.zeros((len(picked), WINDOW), np.int64), np.zeros((len(picked), WINDOW), bool)
            for row, k in enumerate(picked):
                own = windows[k][chosen[k]]
                ids[row, : len(own)] = [places.setdefault(w, len(places)) for w in own]
                real[row, : len(own)] = True
            grads = gradients(net, list(places), ids, real, labels[picked], weight[picked] / len(picked))
            step += 1
            for q, d, m, v in zip(params, grads, first, second, strict=True):
                d = d + DECAY * q
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                q -= (RATE * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Gru | None:
    """From documents (doc_id, text) and labels (doc_id, toxic); None without both kinds."""
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(POSITIVES).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(NEGATIVES))
    sample = docs.join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("long").alias("y"), "text")
    sample = checkpointed(sample)
    vocabulary, odds = evidence(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, y, words in word_lists(batches):
            if words:
                own = [b" ".join(w) for w in candidates(words, odds, SEED + doc % 2**32)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([y], pa.int64()), pa.array([own], pa.list_(pa.binary()))], ["doc_id", "y", "windows"])

    rows = sample.mapInArrow(cut, "doc_id long, y long, windows array<binary>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["windows"]))
    labels_ = np.array([r["y"] for r in rows], np.float32)
    if not rows or labels_.min() == labels_.max():
        return None
    return fit([[w.split() for w in r["windows"]] for r in rows], labels_, vocabulary)


def score(docs: DataFrame, net: Gru | None, *carry: str) -> DataFrame:
    """The carried columns and the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            scores, held, size = np.zeros(batch.num_rows), [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                words = (text.as_py() or "").encode().lower().split() if net else []
                held.append(words)
                size += len(words)
                if size >= BLOCK_WORDS or i == batch.num_rows - 1:
                    if net:
                        scores[i + 1 - len(held) : i + 1] = net.score_texts(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*carry, "text").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "score double"]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; fold 1 of 3 is held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    held_out = split_mod(3) == 1
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    net = learn(docs.where(~held_out), labels.where(~held_out))
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), net, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
