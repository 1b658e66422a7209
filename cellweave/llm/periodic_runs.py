"""Periodic runs of words, by maximal pairs of the LCP-interval tree.

A run is a stretch of consecutive words of smallest period q, at least ``least`` words and ``times`` periods long, that no
neighbouring word extends. Words q apart are equal all along it, so the suffixes at its start s and at s + q agree on exactly
length - q words and have different words on their left: they are a maximal pair. The other way round, a maximal pair at
distance d that agrees on l words is a run of l + d words where l >= (times - 1) d and l + d >= least, if no copy of those l
words starts between the two; a copy there would give the run a smaller period, by the theorem of Fine and Wilf. Nothing has
to be extended.

For each document the suffixes of its words are sorted by prefix doubling; those that agree with no other on ``seed`` words,
the least l that the bounds allow, leave the rounds early and never enter the tree. The tree of LCP intervals is walked from
the leaves up. An interval keeps its positions in order, each with the class of its left word; where children meet, the smaller
is put into the larger, and only neighbours in that order that are of different children and classes are paired. So a document
of n words takes O(n log n) steps and memory proportional to n, and documents need each other in nothing: no shuffle.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows and ids are handled
each for itself; an empty table gives no row; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents
from cellweave.llm.textscan import mix

LEAST, TIMES = 24, 3
#: Bytes of texts that are handed back to Spark at once.
OUT_BYTES = 4 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_codes(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeats(codes: np.ndarray, seed: int) -> bool:
    """Whether a string of the largest power of two up to ``seed`` words may start twice: equal strings have equal hashes."""
    h, size = codes.astype(np.uint32), 1
    while 2 * size <= seed:
        if len(h) <= size:
            return False
        h = mix(h[:-size] * np.uint32(0x85EBCA77), h[size:])
        size *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def suffix_ranks(codes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes, and the positions whose first words (a power of two up to ``seed``) start another suffix too.

    In each round suffixes that agree so far are sorted by the rank of the suffix as many words on as were compared.
    """
    n = len(codes)
    live, rank = np.arange(n), np.zeros(n, np.int64)
    second, compared, shared = codes, 0, live
    while len(live):
        order = np.argsort(rank[live] * (n + 1) + second, kind="stable")
        live, second = live[order], second[order]
        old, place = rank[live], np.arange(len(live))
        head, new = np.ones(len(live), bool), np.ones(len(live), bool)
        head[1:] = old[1:] != old[:-1]
        new[1:] = head[1:] | (second[1:] != second[:-1])
        group = np.maximum.accumulate(np.where(head, place, 0))
        rank[live] = old + np.maximum.accumulate(np.where(new, place, 0)) - group
        live = live[~(new & np.append(new[1:], True))]
        compared = max(2 * compared, 1)
        if compared <= seed:
            shared = live
        after = live + compared
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
    return rank, shared


def common_prefixes(words: list[int], rank: np.ndarray, shared: np.ndarray) -> tuple[list[int], list[int]]:
    """The positions ``shared`` in the order of their suffixes, with the words each has in common with the suffix before it.

    ``words`` ends with a word of its own. Where a suffix agrees with the one before it on h words, the next suffix of the text
    agrees with its own predecessor on h - 1 at least.
    """
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    at = np.sort(shared)
    ranks = rank[at]
    before = place[np.maximum(ranks - 1, 0)].tolist()
    found, h, last = [], 0, -2
    for i, j, r in zip(at.tolist(), before, ranks.tolist()):
        h = h - 1 if i == last + 1 and h > 0 else 0
        if r:
            while words[i + h] == words[j + h]:
                h += 1
        else:
            h = 0
        found.append(h)
        last = i
    order = np.argsort(ranks)
    return at[order].tolist(), np.array(found, np.int64)[order].tolist()


def maximal_pairs(words: list[int], places: list[int], shares: list[int], seed: int, least: int, times: int) -> list[tuple]:
    """(start, length, period) of the runs, from suffixes in order and the words they share with the one before."""
    runs: list[tuple] = []

    def pair(i: int, j: int, depth: int) -> None:
        gap = j - i
        if gap * (times - 1) <= depth and depth + gap >= least and words[i - 1] != words[j - 1]:
            runs.append((i, depth + gap, gap))

    def meet(one: list[int], other: list[int], depth: int) -> list[int]:
        """The positions of two children of an interval of ``depth`` words."""
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        last = -1
        for k, x in enumerate(small):
            at = bisect(large, x)
            if at and large[at - 1] != last:
                pair(large[at - 1], x, depth)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                pair(x, large[at], depth)
            large.insert(at, x)
            last = x
        return large

    depths: list[int] = []  # the open intervals, from the root of the tree, and their positions so far
    held: list[list[int]] = []
    child: list[int] = []
    for x, share in zip([*places, -1], [*shares, 0]):
        while depths and depths[-1] > share:
            child = meet(held.pop(), child, depths.pop())
        if share >= seed:
            if depths and depths[-1] == share:
                held[-1] = meet(held[-1], child, share)
            else:
                depths.append(share)
                held.append(child)
        child = [x]
    return sorted(runs)


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a row of word numbers, by start, then period."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    seed = max(-(-least * (times - 1) // times), 1)
    if len(codes) < least or not repeats(codes, seed):
        return []
    rank, shared = suffix_ranks(codes, seed)
    if not len(shared):
        return []
    words = [*codes.tolist(), -1]  # the left word of the first and the right word of the last is none of theirs
    runs = maximal_pairs(words, *common_prefixes(words, rank, shared), seed, least, times)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of each row of (doc_id, text): see SCHEMA."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUN), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "replace").split()  # of bytes: at ASCII white space alone
                found = runs_of(word_codes(words), least, times)
                said = b" ".join(kept_words(words, found)).decode()
                rows.append((doc_id.as_py(), len(words), [dict(zip(("start", "length", "period"), r)) for r in found], said))
                held += len(said)
                if held > OUT_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where documents whose id has a crc32 that ends in 0 repeat their words from a place on.

    With h the crc32 of the decimal id, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where a = g mod n
    and p = 1 + (n - a) div (3 + g mod 8).
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", hashed.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    parts = parts.withColumns({"g": F.expr("h div 10"), "n": F.when(F.col("w").isNotNull(), F.size("w")).otherwise(0)})
    parts = parts.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    parts = parts.withColumn("p", (1 + F.expr("(n - a) div (3 + g % 8)")).cast("int"))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", source(i)))
    return parts.select("doc_id", F.when(F.col("n") > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    ranked = F.transform(
        "runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("less"), r["start"], r["period"], r["length"])
    )
    best = F.array_min(ranked)
    said = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(said, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
