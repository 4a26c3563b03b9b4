"""MinHash near-deduplication with one-permutation hashing, banded buckets and star candidates.

1. Every text becomes its set of word shingles (64-bit hashes), and from one hash of each shingle a
   signature of ``BINS`` minima; empty bins are filled by optimal densification (each probes bins in an
   order of its own until it meets a filled one). Texts with equal sets are one class, named by its
   smallest id, so copies never meet as pairs.
2. Class signatures go into ``BANDS`` buckets each. Every bucket picks one member as its centre, another
   one in every band (smallest hash of id and bucket), and links the others to it: a star, so a bucket of
   n classes makes n - 1 candidates. The bands' different centres tie a group together many times over.
   A pair at the threshold 0.8 shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
3. Candidates whose signatures agree in far fewer bins than the threshold asks (``MARGIN`` below, over
   four deviations) go. A centre may be unlike the members that it shares a common passage with, so every
   member that it lost then meets all others of the bucket by signature. Where that is more than a block
   of ``BUCKET_BLOCK`` squared, the bucket is first narrowed: its members go on into one bucket for each other
   band, and only members that share a second band meet there (a pair at 0.8 that shares one band shares no
   second with probability (1 - 0.8 ** 4) ** 31 = 8e-8). A narrow bucket that is still too large is met in
   blocks. Thus any two members that agree are connected, whatever the centre. What remains connected is a
   cluster: it holds all members of its links.
4. A star does not see every pair. So each cluster is settled exactly, on full sets from whole texts:
   members linked to the best centre join it; every other member is compared with all. Clusters of over
   ``CLUSTER_BLOCK`` classes are split into blocks and all pairs of blocks are settled in tasks of their
   own, so no task holds more than two blocks.
5. The links' components, by the large-star / small-star alternation, give each class its smallest id.

What is shuffled: a signature and 32 bucket keys per class, a signature per member of a bucket whose
centre lost members (31 keys more per member of a bucket to be narrowed), and the texts of classes that are
in a cluster. Hot copies collapse in the first aggregation; ids, links and components stay in tables.

Defined edge cases: null text and text without words have the empty set and stay alone; with fewer
words than a shingle has, the whole sequence is the one shingle; repeated rows (same id, same text) are one
document per row of output and link to nothing new; rows of one id with different texts are documents of
their own that share a name; a null id is a document of its own id null, never linked; an empty table gives
no rows; columns besides doc_id and text are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import checkpointed, documents, quoted

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: How far below the threshold the share of agreeing bins may lie.
MARGIN = 0.18
CLUSTER_BLOCK = 1500
BUCKET_BLOCK = 2048
MAX_ROUNDS = 60
CACHE = 300_000
PROBES = 64


class WordHashes(dict):
    """64-bit hashes of words, the first ``CACHE`` of them kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, min(words, len(h)), np.uint64)
        for j in range(min(words, len(h))):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(x)


def probe_table() -> np.ndarray:
    """For each bin, the bins it asks in turn when it is empty: its own pseudo-random sequence."""
    at = np.arange(BINS * PROBES, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (mix(at * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, PROBES)


PROBE = probe_table()


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation minima of a set, densified."""
    h = mix(s + np.uint64(0xD6E8FEB86659FD93))
    bins = (h >> np.uint64(57)).astype(np.int64)
    low = h & np.uint64((1 << 57) - 1)
    order = np.argsort(h, kind="stable")  # by bin, then by value
    first = np.ones(len(h), bool)
    first[1:] = bins[order[1:]] != bins[order[:-1]]
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[order[first]]] = low[order[first]]
    full[bins[order[first]]] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[PROBE[empty]]
        at = hit.argmax(axis=1)
        found = PROBE[empty, at]
        lost = ~hit[np.arange(len(empty)), at]
        if lost.any():  # no probe hit a filled bin: the filled bin next in a fixed cyclic order
            filled = np.flatnonzero(full)
            found[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        out[empty] = out[found]
    return out


assert BINS == 1 << 7  # the top seven bits of a hash choose the bin


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(BANDS, ROWS)[:, j])
    return x


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set digest, band keys, and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            n, digests, keys, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words, cache)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(band_keys(sig).view(np.int64))
                    sigs.append((mix(sig) & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "digest", "keys", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sig binary")


def agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Share of agreeing signature bytes of each pair, less what agrees by chance."""
    return shares(unpacked(a), unpacked(b))


def unpacked(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, BINS)


def shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.count_nonzero(x == y, axis=1) / BINS - 1 / 256) / (1 - 1 / 256)


def agreeing():
    @F.arrow_udf("double")
    def share(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(agreement(a, b))

    return share


def star_candidates(classes: DataFrame, percent: int, block: int = BUCKET_BLOCK) -> DataFrame:
    """Pairs (a, b) of classes (rep, keys, sig) that connect all agreeing members of each bucket."""
    members = classes.select("rep", F.explode("keys").alias("key"))
    centres = members.groupBy("key").agg(F.min_by("rep", F.struct(F.xxhash64("rep", "key"), "rep")).alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = members.join(centres, "key").where("rep <> centre")
    stars = checkpointed(stars.select("key", "rep", F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")))
    sig = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    pairs = stars.select("a", "b").distinct().join(sig, "a").join(sig.select(F.col("a").alias("b"), F.col("sig_a").alias("sig_b")), "b")
    judged = checkpointed(pairs.select("a", "b", (agreeing()("sig_a", "sig_b") < percent / 100 - MARGIN).alias("lost")))
    flagged = with_losses(stars, judged.where("lost").select("a", "b"))
    tasks = in_blocks(narrowed(flagged, classes, block), block)
    met = meet(tasks.join(classes.select("rep", "sig"), "rep"), percent)
    return judged.where("NOT lost").select("a", "b").unionByName(met)


def with_losses(stars: DataFrame, lost: DataFrame) -> DataFrame:
    """(key, rep, lost, n, n_lost): the members besides the centre of each bucket whose centre lost any, and how many there are."""
    flagged = stars.join(lost.withColumn("lost", F.lit(True)), ["a", "b"], "left").select("key", "rep", F.coalesce("lost", F.lit(False)).alias("lost"))
    return counted(flagged)


def counted(flagged: DataFrame) -> DataFrame:
    counts = flagged.groupBy("key").agg(F.count("*").alias("n"), F.count_if("lost").alias("n_lost")).where("n > 1 AND n_lost > 0")
    return checkpointed(flagged.join(counts, "key"))


def narrowed(flagged: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """The same rows, where members of too large a bucket go into a bucket for each other band instead."""
    large = F.col("n") * F.col("n_lost") > block * block
    bands = flagged.where(large).select("key", "rep", "lost").join(classes.select("rep", "keys"), "rep").select("key", "rep", "lost", F.explode("keys").alias("other")).where("other <> key")
    both = bands.groupBy(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "rep").agg(F.max("lost").alias("lost"))
    return flagged.where(~large).unionByName(counted(both))


def in_blocks(flagged: DataFrame, block: int) -> DataFrame:
    """(task, rep, lost): of each bucket, every pair of a lost member and another member in some task.

    The lost and the linked members of a bucket of over ``block`` are split into parts, and each part of lost ones
    meets every part in a task of its own.
    """
    one = F.col("n") <= block
    parts = F.ceil(F.col("n_lost") / block).cast("int")
    others = F.when(one, 0).otherwise(F.ceil((F.col("n") - F.col("n_lost")) / block)).cast("int")
    dealt = flagged.select("key", "rep", "lost", parts.alias("parts"), others.alias("others"), one.alias("one"))
    own = F.when(F.col("lost"), F.pmod(F.xxhash64("rep"), "parts")).when(F.col("one"), 0).otherwise(F.col("parts") + F.pmod(F.xxhash64("rep"), "others"))
    last = F.col("parts") - 1 + F.when(F.col("lost"), F.col("others")).otherwise(0)
    met = dealt.select("key", "rep", "lost", own.cast("int").alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"), "rep", "lost")


def meet(rows: DataFrame, percent: int) -> DataFrame:
    """Agreeing pairs (a, b) from rows (task, rep, lost, sig): they connect each lost row with all that agree with it in its task."""

    def pairs(rep: np.ndarray, lost: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
        forest = Forest(len(rep))
        for i in np.flatnonzero(lost).tolist():
            for j in np.flatnonzero(shares(sig, sig[i]) >= percent / 100 - MARGIN).tolist():
                if forest.join(i, j):
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, BINS), np.uint8)]
        for batch in batches:  # sorted by task; the last task of a batch may go on in the next
            new = [*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], unpacked(batch.column(3))]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            found = []
            for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                found += pairs(*[x[i:j] for x in held[1:]])
            yield batch_of(found)
            if len(cuts):
                held = [x[cuts[-1] :] for x in held]
        yield batch_of(list(pairs(*held[1:])))

    return rows.select("task", "rep", "lost", "sig").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node reachable."""
    edges = checkpointed(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: larger neighbours of u go to the least of u and its neighbours
        large = both.where("v > u").select("u", "v").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = tuple(now)
    raise RuntimeError("components did not settle")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def is_link(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def settle(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what the links of all pairs connect.

    left: where given, only pairs of a left with a right set count (two different blocks).
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    forest, out = Forest(n), []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1  # a shingle of one set only cannot be common
    keep = shared[place]
    rows, cols = owner[keep], column[place[keep]]
    width = int(shared.sum())
    order = np.lexsort((rows, cols))
    by_col = rows[order]
    starts = np.searchsorted(cols[order], np.arange(width + 1))
    of_row = np.split(cols, np.cumsum(np.bincount(rows, minlength=n))[:-1])

    def common_with(i: int) -> np.ndarray:
        mine = of_row[i]
        parts = [by_col[starts[c] : starts[c + 1]] for c in mine]
        return np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)

    def look(i: int) -> None:
        common = common_with(i)
        ok = is_link(common, size[i], size, percent)
        ok[i] = False
        if left is not None:
            ok &= left != left[i]
        for j in np.flatnonzero(ok).tolist():
            if forest.join(i, j):
                out.append((i, j))

    popular = np.array([(starts[c + 1] - starts[c]).sum() / len(s) if len(s) else 0 for c, s in zip(of_row, sets, strict=True)])
    centre = int(popular.argmax())
    look(centre)
    home = forest.find(centre)
    for i in range(n):
        if i != centre and (left is not None or forest.find(i) != home):
            look(i)
            home = forest.find(centre)
    return out


def settled(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) from rows (task, part, rep, text): within one part, or between the two parts of a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cache = WordHashes()
        group = group.sort_values("rep", kind="stable").drop_duplicates(["part", "rep"])
        sets = [shingles(t, words, cache) for t in group["text"]]
        part = group["part"].to_numpy()
        ids = group["rep"].to_numpy()
        found = settle(sets, percent, part if len(set(part.tolist())) > 1 else None)
        return pd.DataFrame({"a": [int(ids[i]) for i, _ in found], "b": [int(ids[j]) for _, j in found]}, dtype="int64")

    return members.groupBy("task").applyInPandas(run, "a long, b long")


def digest_of(words: int):
    """The digest of a text's shingle set; null for the empty set."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        cache = WordHashes()
        sets = (shingles(t.as_py(), words, cache) for t in texts)
        return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())

    return digest


def linked_classes(docs: DataFrame, words: int, percent: int, block: int, bucket_block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, digest), and classes (digest, least, root): its smallest id, and one value per component.

    A class is a node of the graph by its smallest id; of several classes with one smallest id (rows of one
    id with different texts) all but one by a hash of id and digest.
    """
    rows = checkpointed(sketches(docs, words))
    sets = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    named = sets.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("keys", "sig"), "doc_id").alias("s"))
    shared = sets.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select(F.col("doc_id").alias("least"), "first")
    node = F.when(F.col("first").isNull() | (F.col("first") == F.col("digest")), F.col("least")).otherwise(F.xxhash64("least", "digest"))
    named = checkpointed(named.join(shared, "least", "left").select("digest", "least", F.col("first").isNotNull().alias("shares"), node.alias("rep"), "s.keys", "s.sig"))
    clusters = components(star_candidates(named.select("rep", "keys", "sig"), percent, bucket_block))
    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("n")), "root")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = sized.select("node", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"))
    placed = checkpointed(placed.join(named.select(F.col("rep").alias("node"), "least", "digest", "shares"), "node"))
    lean = docs.select(F.col("doc_id").cast("long").alias("least"), "text").where("least IS NOT NULL")
    texts = lean.join(placed.where("NOT shares").drop("digest", "shares"), "least")
    if not placed.where("shares").isEmpty():
        own = lean.join(placed.where("shares").select("least").distinct(), "least", "left_semi").withColumn("digest", digest_of(words)("text"))
        texts = texts.unionByName(own.join(placed.where("shares").drop("shares"), ["least", "digest"]).drop("digest"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = texts.select("root", "node", "text", "part", other).select(
        F.struct("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).alias("task"), "part", F.col("node").alias("rep"), "text"
    )
    roots = components(settled(tasks, words, percent))
    classes = named.select("digest", "least", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "least", F.coalesce("root", "rep").alias("root"))
    return rows.select("doc_id", "n_shingles", "digest"), classes


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = CLUSTER_BLOCK, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    rows, classes = linked_classes(docs, words, percent, block, bucket_block)
    least = classes.groupBy("root").agg(F.min("least").alias("component"))
    by_class = classes.join(least, "root").select("digest", "component")
    # rows without a set need no class and would meet in one task of the join; a hot digest is split by AQE's skew join
    found = rows.where("digest IS NOT NULL").join(by_class, "digest", "left").select("doc_id", "n_shingles", "component")
    out = found.unionByName(rows.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with its own columns: the one of the smallest id, then digest.

    Of equal rows one stays; rows of one id whose texts differ stay each, unless they are near duplicates
    (of those, and of rows of one id without words, the first by its columns). Rows with a null id stay.
    """
    rows, classes = linked_classes(docs, words, percent, CLUSTER_BLOCK, BUCKET_BLOCK)
    firsts = classes.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("f")).select(F.col("f.least").alias("doc_id"), F.col("f.digest").alias("digest"))
    known = rows.where("doc_id IS NOT NULL")
    kept = checkpointed(firsts.unionByName(known.where("digest IS NULL").select("doc_id", "digest").distinct()))
    often = checkpointed(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    out = docs.join(kept.select("doc_id").join(often, "doc_id", "left_anti"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    if not often.isEmpty():
        columns = [F.col(quoted(c)).alias(c) for c in docs.columns]
        again = docs.join(kept.join(often, "doc_id").select("doc_id"), "doc_id", "left_semi")
        packed = again.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(words)("text").alias("digest"), F.struct(*columns).alias("row"), F.to_json(F.struct(*columns)).alias("order"))
        chosen = packed.groupBy("doc_id", "digest").agg(F.min_by("row", "order").alias("row")).alias("c")
        pairs = kept.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"))
        chosen = chosen.join(pairs, (F.col("doc_id") == F.col("id")) & F.col("digest").eqNullSafe(F.col("d")), "left_semi").select("row")
        out = out.unionByName(chosen.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]))
    return out.select(*[quoted(c) for c in docs.columns])


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, percent=85)


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
r AS (SELECT min(doc_id) AS rep, list_sort(s) AS k, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS (SELECT rep, n, unnest(k) AS g FROM r),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(node, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node),
f AS (SELECT s.doc_id, m.root FROM s JOIN r ON len(s.s) > 0 AND list_sort(s.s) = r.k JOIN m ON m.node = r.rep)
SELECT n.doc_id, n.n AS n_shingles, coalesce(f.root, n.doc_id) AS component_id, n.doc_id = coalesce(f.root, n.doc_id) AS kept
FROM n LEFT JOIN f ON n.doc_id = f.doc_id
"""
