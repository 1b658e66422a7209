"""Best-fit packing of whole documents by exact complements.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut), and pieces of one length can stand for each
other, so a packing is planned on the number of pieces of each length: ``capacity`` numbers, whatever the corpus holds. The plan
is a list of patterns, each a sequence's lengths and how many sequences are filled like that:

1. Each length, from the longest down, is completed exactly where the index of length sums says that lengths which are still
   available fill the gap: first by one, then by two, then by three of them, the longest first. A pattern is used as often as
   the counts of its lengths allow.
2. What has no exact complement is filled best first: the longest length that fits goes in until the rest of the gap has an exact
   complement or nothing fits.

Pieces take their places by number. A task numbers its pieces of each length when it makes them; the table of pieces is written
once to the shared folder, so the numbers hold if executors are lost later. The tasks' counts are added up along the tasks of
each length, which gives each task the number of its first piece. The number then finds its pattern by binary search in
the plan, which is broadcast: a pattern empties one of its lengths or leaves less of it than the pattern uses, and has at most
sqrt(2 capacity) different lengths, so its size depends on the capacity alone. Only rows of pieces are shuffled (with token ids
where they are asked for), and no task holds the pieces of a length.

Defined cases: a null or empty text is the single ``end_id``; repeated rows and ids are packed each for itself; an empty table
gives no row; other columns are ignored. Among pieces of one length it is arbitrary which goes where.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise
from cellweave.llm.packing import CACHE_CHUNKS, Chunks, Encoder, default_tokenizer
from cellweave.llm.textscan import blocks

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class SumIndex:
    """Which sums one, two or three of the available lengths make; bit s of a mask stands for the sum s."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.whole = (1 << len(counts)) - 1
        self.one = sum(1 << x for x, n in enumerate(counts) if n > 0)
        self.stale = True

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.one &= ~(1 << length)
            self.stale = True

    def refresh(self) -> None:
        """Sums of two and three lengths. They may use a length more often than there are pieces; :meth:`exact` counts."""
        if self.stale:
            available = [x for x, n in enumerate(self.counts) if n > 0]
            self.two = self.three = 0
            for x in available:
                self.two |= self.one << x & self.whole
            for x in available:
                self.three |= self.two << x & self.whole
            self.stale = False

    def _pair(self, gap: int, have) -> tuple[int, ...]:
        below = self.one & ((1 << gap) - 1)
        while below:
            x = below.bit_length() - 1
            if 2 * x < gap:
                break
            if self.one >> (gap - x) & 1 and have(x) > 0 and have(gap - x) > (gap - x == x):
                return x, gap - x
            below ^= 1 << x
        return ()

    def exact(self, gap: int, used: Counter, most: int) -> tuple[int, ...]:
        """At ``most`` three available lengths that make up the gap beside what is ``used``, as few as possible; else none."""

        def have(x: int) -> int:
            return self.counts[x] - used[x]

        if most and self.one >> gap & 1 and have(gap) > 0:
            return (gap,)
        if most < 2:
            return ()
        self.refresh()
        if self.two >> gap & 1 and (found := self._pair(gap, have)):
            return found
        if most > 2 and self.three >> gap & 1:
            below = self.one & ((1 << gap) - 1)
            while below:
                x = below.bit_length() - 1
                if 3 * x < gap:
                    break
                if self.two >> (gap - x) & 1 and have(x) > 0:
                    used[x] += 1
                    found = self._pair(gap - x, have)
                    used[x] -= 1
                    if found:
                        return (x, *found)
                below ^= 1 << x
        return ()

    def longest(self, gap: int, used: Counter) -> int:
        """The longest available length that fits, 0 if none does."""
        below = self.one & ((2 << gap) - 1)
        while below:
            x = below.bit_length() - 1
            if self.counts[x] > used[x]:
                return x
            below ^= 1 << x
        return 0


def plan_of_width(counts: dict[int, int], capacity: int, width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """A packing whose exact complements have up to ``width`` pieces; see :func:`plan`."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError("lengths lie from 1 to the capacity")
        left[length] = int(n)
    index, patterns = SumIndex(left), []

    def use(content: list[int]) -> None:
        times = Counter(content)
        many = min(left[x] // k for x, k in times.items())
        patterns.append((many, sorted(times.items(), reverse=True)))
        for x, k in times.items():
            index.take(x, many * k)

    if left[capacity]:
        use([capacity])
    for most in range(1, width + 1):
        for seed in range(capacity - 1, 0, -1):
            while left[seed] and (rest := index.exact(capacity - seed, Counter([seed]), most)):
                use([seed, *rest])
    for seed in range(capacity - 1, 0, -1):
        while left[seed]:
            content, gap = [seed], capacity - seed
            while gap:
                used = Counter(content)
                rest = index.exact(gap, used, width)
                if not rest and (best := index.longest(gap, used)):
                    rest = (best,)
                content += rest
                gap = gap - sum(rest) if rest else 0
            use(content)
    return patterns


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns: how many sequences, and the lengths of each with how often it has them.

    Triples fill more gaps exactly, but they use up short pieces that other gaps may need; so the packing is planned with
    complements of up to three, two, one and no pieces, and the one of the fewest sequences is taken.
    """
    plans = [plan_of_width(counts, capacity, width) for width in (3, 2, 1, 0)]
    return min(plans, key=lambda patterns: sum(many for many, _ in patterns))


class Places:
    """Where the pieces of a plan go: for each length, the numbers of its pieces that a pattern takes."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rows, taken, self.sequences = [], Counter(), 0
        for many, content in patterns:
            offset = 0
            for length, uses in content:
                rows.append((length << 44 | taken[length], taken[length], uses, self.sequences, offset))
                taken[length] += many * uses
                offset += length * uses
            self.sequences += many
        rows.sort()
        self.key, self.low, self.uses, self.first, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers among those of their lengths."""
        at = np.searchsorted(self.key, length << 44 | number, side="right") - 1
        turn = number - self.low[at]
        return self.first[at] + turn // self.uses[at], self.offset[at] + turn % self.uses[at] * length


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One cache for all tasks of a worker."""
    return Encoder(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: see PIECES. ``number`` counts the pieces of one length in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for some in blocks(batch.column(1)):
                tokens = [np.append(t, end_id).astype("<u4") for t in encoder.encode(Chunks(some, encoder.as_is))]
                if len(encoder.size) > CACHE_CHUNKS:
                    encoder.reset()
                sizes = np.array([len(t) for t in tokens], np.int64)
                parts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                often = np.bincount(length, minlength=capacity + 1)
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - (np.cumsum(often) - often - seen)[length[order]]
                seen += often
                raw = [tokens[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length)]
                columns = [
                    batch.column(0).slice(at, len(some)).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    pa.array(np.full(len(doc), task, np.int64)),
                    pa.array(number),
                ]
                names = [x.split()[0] for x in PIECES.split(", ")]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(some)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its sequence and offset: see PLACED.

    ``with_ids`` adds the piece's token ids as little-endian unsigned 32-bit integers; they then take part in the shuffle.
    """
    path = tokenizer_path or default_tokenizer()
    pieces = materialise(token_pieces(docs, path, capacity, end_id, with_ids), "bestfit-pieces")
    made = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = made.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in ("length", "number"))
            sequence, offset = places.value(length, number)
            rest = [batch.column("ids")] if with_ids else []
            kept = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = [x.split()[0] for x in PLACED.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset), *rest], names)

    numbered = pieces.join(offsets, ["length", "task"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.drop("task", "before").mapInArrow(run, PLACED + (", ids binary" if with_ids else ""))


def op12_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir))
