"""Best-fit packing into fixed-length sequences by swap-based local search.

A document's ids end with ``END``. A document over ``LENGTH`` ids is cut into full pieces, the first one
shorter; full pieces are sequences of their own. The others are packed in blocks of at most ``BLOCK``
pieces of one scan partition. A block begins as its pieces come, each in the fullest bin that has room for
it. Local search then empties bins, from the emptiest: a piece moves to the fullest bin that has room for
it, or is swapped one for one, one for two or two for one with smaller pieces of another bin. A change is
made only if it raises the sum of squared fills, so fuller bins get fuller and others drain until they are
empty. The search ends when no bin can be emptied any more or as few are left as the ids need at least.

What a block does not fill is packed again: the pieces of bins with over ``WASTE`` free places, of all
partitions together, in blocks of their own that begin with their longest pieces. So a table of many small partitions wastes no more than one of a
few. The pieces (numbers only) are written once in the shared folder; texts are tokenized once and never
shuffled, and a lost task packs the same rows the same way again.

Defined edge cases: null or empty text is the document of the end id alone (one piece of length 1);
repeated rows are packed each; equal lengths are told apart by their order in the scan; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import checkpointed, documents
from dredge.llm.tokens import byte_bpe

LENGTH = 1024
END = 2
BLOCK = 20_000
ROUNDS = 200
#: Bins looked at for one swap.
LOOK = 8
#: Rounds end when this many bins in a row could not be emptied.
PATIENCE = 100
#: Free places beyond which a bin is packed again with those of other partitions.
WASTE = 1
#: The largest difference of two pieces that are swapped.
SPAN = 64
#: Sequences of a partition: ids are partition * this + number.
PER_PARTITION = 1 << 40


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


class Bins:
    """Bins of item sizes, found by their free room."""

    def __init__(self, length: int):
        self.length = length
        self.items: list[list[int]] = []  # per bin, its items
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]  # bins by free room; entries may be stale
        self.present: list[int] = []  # sorted rooms that have an entry
        self.changes = 0

    def index(self, sizes: list[int]) -> None:
        """Find items by their size, and the bin of each."""
        self.by_size: dict[int, list[int]] = {}
        self.bin_of = [0] * len(sizes)
        for b, own in enumerate(self.items):
            for i in own:
                self.bin_of[i] = b
                self.by_size.setdefault(sizes[i], []).append(i)

    def swap(self, size: int, source: int) -> tuple[int, int, list[int]] | None:
        """(gain, bin, [item]): an item of a fuller bin that is smaller by at most the bin's room; the largest gain found."""
        best = None
        for gain in range(min(size - 1, SPAN), 0, -1):
            same = self.by_size.get(size - gain)
            if not same:
                continue
            at = (source * 7 + size) % len(same)
            for i in (same + same)[at : at + min(LOOK, len(same))] if len(same) <= 4 * LOOK else (same[(at + k) % len(same)] for k in range(LOOK)):
                b = self.bin_of[i]
                if b != source and gain <= self.free[b] and self.free[b] - gain < self.free[source]:
                    if self.free[b] == gain:
                        return gain, b, [i]
                    best = best or (gain, b, [i])
        return best

    def note(self, b: int) -> None:
        room = self.free[b]
        if not self.by_free[room]:
            bisect.insort(self.present, room)
        self.by_free[room].append(b)

    def best(self, size: int, source: int = -1) -> int | None:
        """The fullest bin besides ``source`` with room for ``size``."""
        i = bisect.bisect_left(self.present, size)
        while i < len(self.present):
            room = self.present[i]
            at = self.by_free[room]
            while at:
                b = at[-1]
                if self.free[b] != room or not self.items[b]:
                    at.pop()
                elif b != source:
                    return b
                else:
                    other = next((x for x in reversed(at) if x != source and self.free[x] == room and self.items[x]), None)
                    if other is not None:
                        return other
                    break
            if at:
                i += 1
            else:
                self.present.pop(i)
        return None


def best_fit(sizes: list[int], length: int, falling: bool = False) -> Bins:
    """Each item, as they come or the longest first, in the fullest bin that has room for it."""
    bins = Bins(length)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]) if falling else range(len(sizes)):
        b = bins.best(sizes[item])
        if b is None:
            b = len(bins.items)
            bins.items.append([])
            bins.free.append(length)
        bins.items[b].append(item)
        bins.free[b] -= sizes[item]
        bins.note(b)
    return bins


def local_search(bins: Bins, sizes: list[int], rounds: int = ROUNDS) -> None:
    """Empty bins into the others, from the emptiest, while that succeeds.

    For each source bin: (a) move an item where it fits best; (b) swap an item against a smaller one of
    another bin that has just the room for the difference; (c) swap one item against two smaller ones, or
    two against one. All raise the squared fill: the fuller bin gets fuller.
    """
    least = -(-sum(sizes) // bins.length)
    bins.index(sizes)
    used = sum(map(bool, bins.items))
    for _ in range(rounds):
        before, failed = bins.changes, 0
        order = sorted((b for b in range(len(bins.items)) if bins.items[b] and bins.free[b]), key=lambda b: (-bins.free[b], b))
        for source in order:
            if used <= least or failed >= PATIENCE:
                break
            if not bins.items[source]:
                continue
            if drain(bins, sizes, source):
                used, failed = used - 1, 0
            else:
                failed += 1
        if used <= least or bins.changes == before:
            break


def others(bins: Bins, source: int, room: int, slack: int) -> list[int]:
    """A few bins with at least this room, the fullest first, to which ``slack`` ids may go with gain.

    Moving x ids from fill s to fill t raises the sum of squares exactly if t + x > s.
    """
    out: list[int] = []
    for r in bins.present[bisect.bisect_left(bins.present, room) :]:
        if r >= bins.free[source] + slack or len(out) >= LOOK:
            break
        out += [b for b in dict.fromkeys(reversed(bins.by_free[r])) if bins.free[b] == r and b != source and bins.items[b]][: LOOK - len(out)]
    return out


def change(bins: Bins, source: int, target: int, give: list[int], get: list[int], sizes: list[int]) -> None:
    """Items ``give`` go to the target, ``get`` come back."""
    moved = sum(sizes[i] for i in give) - sum(sizes[i] for i in get)
    bins.items[source] = [i for i in bins.items[source] if i not in give] + get
    bins.items[target] = [i for i in bins.items[target] if i not in get] + give
    for i in give:
        bins.bin_of[i] = target
    for i in get:
        bins.bin_of[i] = source
    bins.free[source] += moved
    bins.free[target] -= moved
    bins.note(source)
    bins.note(target)
    bins.changes += 1


def drain(bins: Bins, sizes: list[int], source: int) -> bool:
    """Move and swap the items of a bin away as far as that goes; whether it is empty then."""
    for item in sorted(bins.items[source], key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = bins.best(size, source)
        if fits is not None and bins.length - bins.free[fits] + size > bins.length - bins.free[source]:  # move
            change(bins, source, fits, [item], [], sizes)
            continue
        best = bins.swap(size, source)  # one for one
        for target in others(bins, source, 1, 1) if best is None else []:  # one for two
            free, own = bins.free[target], bins.items[target]
            for k, a in enumerate(own):
                for b in own[k + 1 :]:
                    gain = size - sizes[a] - sizes[b]
                    if (best[0] if best else 0) < gain <= free:
                        best = (gain, target, [a, b])
            if best and best[0] == free:
                break
        if best:
            change(bins, source, best[1], [item], best[2], sizes)
    for target in others(bins, source, 1, 1) if bins.items[source] else []:  # two for one
        own, free = bins.items[source], bins.free[target]
        found = next(
            (([own[i], own[j]], [a]) for a in bins.items[target] for i in range(len(own)) for j in range(i) if 0 < sizes[own[i]] + sizes[own[j]] - sizes[a] <= free),
            None,
        )
        if found:
            change(bins, source, target, *found, sizes)
            break
    return not bins.items[source]


def pack(sizes: list[int], length: int = LENGTH, falling: bool = False) -> list[tuple[int, int]]:
    """(bin, offset) of each item; bins are numbered from 0."""
    bins = best_fit(sizes, length, falling)
    local_search(bins, sizes)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    number = 0
    for items in bins.items:
        at = 0
        for i in sorted(items):
            out[i] = (number, at)
            at += sizes[i]
        number += bool(items)
    return out


KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "wasteful": pa.bool_()}


#: Partitions of the second packing count from here.
SECOND = 1 << 22
ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, wasteful boolean"


def placed(held: list[tuple], number: int, length: int, falling: bool = False) -> tuple[list[tuple], int]:
    """Rows (doc_id, piece, start, length, ids_crc32) with a sequence from ``number`` on, their offset, and whether
    the sequence has over ``WASTE`` free places; and the next free number."""
    open_ = [i for i, r in enumerate(held) if r[3] < length]
    places = dict(zip(open_, pack([held[i][3] for i in open_], length, falling), strict=True))
    used = 1 + max((b for b, _ in places.values()), default=-1)
    fill = [0] * used
    for i, (b, _) in places.items():
        fill[b] += held[i][3]
    rows = []
    for i, r in enumerate(held):
        if i in places:
            b, offset = places[i]
            rows.append((*r, number + b, offset, length - fill[b] > WASTE))
        else:
            rows.append((*r, number + used, 0, False))
            used += 1
    return rows, number + used


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], list(KINDS))


def cut_and_pack(docs: DataFrame, length: int, block: int) -> DataFrame:
    """The pieces of all documents, packed within scan partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe().ids
        end = np.array([END], "<u4").tobytes()
        number = TaskContext.get().partitionId() * PER_PARTITION
        held: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, (start, n) in enumerate(pieces(len(ids) // 4, length)):
                    held.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    if len(held) >= block:
                        rows, number = placed(held, number, length)
                        held = []
                        yield _batch(rows)
        if held:
            yield _batch(placed(held, number, length)[0])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def pack_again(rows: DataFrame, length: int, block: int) -> DataFrame:
    """The same pieces in new sequences, packed in blocks of ``block`` over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (SECOND + TaskContext.get().partitionId()) * PER_PARTITION
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                held.append(r)
                if len(held) >= block:
                    done, number = placed(held, number, length, True)
                    held = []
                    yield _batch(done)
        if held:
            yield _batch(placed(held, number, length, True)[0])

    parts = max(1, -(-rows.count() // block))
    dealt = rows.repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset") if parts > 1 else rows.repartition(1).sortWithinPartitions("sequence_id", "offset")
    return dealt.mapInArrow(run, ROWS)


def pack_documents(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    first = checkpointed(cut_and_pack(docs, length, block))
    return first.where("NOT wasteful").unionByName(pack_again(first.where("wasteful"), length, block)).drop("wasteful")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
