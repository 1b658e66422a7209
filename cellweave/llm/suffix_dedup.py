"""Exact substring dedup by ranks at fixed sizes over sampled suffixes (in place of prefix doubling; the README says why).

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id.
Ranks are names: equal strings have equal names, which is all that finding repeats needs. They are made where the bytes lie,
and Spark sorts (rank, document) rows at growing lengths; whatever is unique to a document leaves.

1. *16 bytes.* Of the suffixes in every window of 35 starts only the one with the least name is kept, so equal 50-byte strings
   keep equal suffixes while one suffix in about eighteen is sorted. The strings for which a suffix was kept are its stretch.
2. *33 bytes.* In the same sort, suffixes that agree are told apart by the names of the bytes that double them to either side,
   and by the name of the whole stretch. A stretch that a smaller document has too is settled: all its strings repeat. A
   stretch that shares no doubled rank with a different one is unique: none of its strings repeat elsewhere.
3. *50 bytes.* Only what is left, the stretches at the edges of shared passages, is expanded into strings, each ranked by the
   pair of the ranks at its start and at offset 25; equal pairs in a smaller document are repeats.

Only steps 1 and 3 shuffle ranks, and only marks and texts are joined at the end. Before a shuffle, a map task combines the
rows that it holds: of equal stretches, or equal strings, only those of the least document are judged elsewhere, the others are
marked at once; of the many different stretches around one passage, two stand for all. So a passage that many documents share
is a few rows of each map task wherever it is judged.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; rows with the same doc_id are one smallest document to
each other and lose nothing to each other, whether their texts are equal or not (rows of one id are told apart by 31 bits of the
hash of their texts); a null doc_id is larger than all; an empty table gives no row; other columns are ignored by the query and
kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise, set_apart, small_batches
from cellweave.llm.suffix_scan import LENGTH, scramble, stretches, string_pairs
from cellweave.llm.textscan import blocks, text_bytes

#: Stands for a null id while documents are compared.
_NO_ID = (1 << 63) - 1
#: Bytes of texts that are looked at together.
BLOCK_BYTES = 1 << 18
#: Rows that a map task combines, and rows of sorted ranks that a task looks at in one step.
STEP_ROWS = 400_000
#: Of more stretches than this with a doubled rank in common, a map task sends two.
MANY = 16

SETTLED, EDGE, START = 0, 1, 2
#: In place of ranks, for rows that a map task has judged.
_KNOWN = {SETTLED: -1, EDGE: -2}


def _starts_of(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _group_ends(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: how many rows its group has, whether it has different documents, and whether the row is its first or last by document."""
    order = np.lexsort((doc, group))
    first = np.flatnonzero(_starts_of(group[order]))
    size = np.diff(np.append(first, len(group)))
    last = first + size - 1
    out = np.empty((3, len(group)), np.int64)
    out[0, order] = np.repeat(size, size)
    out[1, order] = np.repeat(doc[order[first]] != doc[order[last]], size)
    out[2] = 0
    out[2, order[first]] = out[2, order[last]] = 1
    return out[0], out[1] > 0, out[2] > 0


def _sides(ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the left and the right doubled rank: the group of its equals, and whether there is one."""
    left, right = (ranks >> 12) & 0xFFF, ranks & 0xFFF
    return [(ranks >> 12, left != 0), ((ranks >> 24 << 12) | right, right != 0)]


def combine_ranks(ranks: np.ndarray, names: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """What a map task sends of its rows: (ranks, name, doc), with ``_KNOWN`` in place of ranks for those that it judges itself."""
    order = np.lexsort((docs, names))
    order = order[_starts_of(names[order], docs[order])]
    ranks, names, docs = ranks[order], names[order], docs[order]
    first = _starts_of(names)
    out = np.where(first, ranks, _KNOWN[SETTLED])
    at = np.flatnonzero(first)
    edge, speaks = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for group, there in _sides(ranks[at]):
        some = np.flatnonzero(there)
        size, differ, end = _group_ends(group[some], docs[at[some]])
        hot = differ & (size > MANY)
        edge[some[hot]] = True
        speaks[some[hot & end]] = True
    out[at[edge & ~speaks]] = _KNOWN[EDGE]
    back = np.argsort(order)  # rows of one document stand together, which makes them small on disk
    return [out[back], names[back], docs[back]]


def _rank_rows(batches: Iterator[pa.RecordBatch], step_rows: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], [], []]
    count = 0

    def emit():
        rows = combine_ranks(*(np.concatenate(h) for h in held))
        for i in range(0, len(rows[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in rows], ["ranks", "name", "doc"])

    for batch in batches:
        docs, at = batch.column(0).to_numpy(zero_copy_only=False), 0
        for some in blocks(batch.column(1), BLOCK_BYTES):
            ranks, names, _, _, text = stretches(*text_bytes(some))
            for h, x in zip(held, (ranks, names, docs[at + text])):
                h.append(x)
            at += len(some)
            count += len(ranks)
        if count >= step_rows:
            yield from emit()
            held, count = [[], [], []], 0
    if count:
        yield from emit()


def judge_ranks(ranks: np.ndarray, names: np.ndarray, docs: np.ndarray):
    """Marks from rows sorted by (ranks, name, doc) that hold all rows of their 16-byte ranks."""
    stretch = _starts_of(ranks, names)
    settled = ~stretch  # a smaller document, or this one, stands first with the same stretch
    least = docs[np.flatnonzero(stretch)][np.cumsum(stretch) - 1]
    settled &= docs > least
    r, d, n = ranks[stretch], docs[stretch], names[stretch]
    edge = np.zeros(len(r), bool)
    for group, there in _sides(r):
        some = np.flatnonzero(there)
        edge[some] |= _group_ends(group[some], d[some])[1]
    return (
        np.concatenate([docs[settled], d[edge]]),
        np.concatenate([names[settled], n[edge]]),
        np.concatenate([np.full(settled.sum(), SETTLED, np.int32), np.full(edge.sum(), EDGE, np.int32)]),
    )


def _mark_rows(batches: Iterator[pa.RecordBatch], step_rows: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], [], []]
    count = 0

    def emit(d, n, k):
        for i in range(0, len(d), 65536):
            part = slice(i, i + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(d[part]), pa.array(n[part]), pa.array(k[part])], ["doc", "value", "kind"])

    for batch in batches:
        ranks, names, docs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        known = (ranks == _KNOWN[SETTLED]) | (ranks == _KNOWN[EDGE])
        if known.any():
            yield from emit(docs[known], names[known], np.where(ranks[known] == _KNOWN[SETTLED], SETTLED, EDGE).astype(np.int32))
            ranks, names, docs = ranks[~known], names[~known], docs[~known]
        for h, x in zip(held, (ranks, names, docs)):
            h.append(x)
        count += len(ranks)
        if count >= step_rows:
            rows = [np.concatenate(h) for h in held]
            key = rows[0] >> 24
            cut = int(np.searchsorted(key, key[-1]))  # the last rank may go on in the next batch
            if cut:
                yield from emit(*judge_ranks(*(x[:cut] for x in rows)))
            held = [[x[cut:]] for x in rows]
            count = len(rows[0]) - cut if cut else 0  # a rank that fills a step waits for its end
    if held[0]:
        rows = [np.concatenate(h) for h in held]
        if len(rows[0]):
            yield from emit(*judge_ranks(*rows))


def _is_marked(names: np.ndarray, text: np.ndarray, lists: list[list[int] | None]) -> np.ndarray:
    """Which of the names, each of a text, are in the list of their text."""
    size = [len(x) if x else 0 for x in lists]
    marks = np.fromiter((m for x in lists if x for m in x), np.int64, sum(size)).view(np.uint64)
    number = np.repeat(np.arange(len(lists), dtype=np.uint64), size)
    return np.isin(scramble(names.view(np.uint64) + scramble(text.astype(np.uint64))), scramble(marks + scramble(number)))


def combine_strings(one: np.ndarray, two: np.ndarray, docs: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """The strings of a map task; those that it finds in a smaller document have a negative value and are judged."""
    order = np.lexsort((docs, two, one))
    new = _starts_of(one[order], two[order])
    judged = np.empty(len(order), bool)
    judged[order] = docs[order] > docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    # What is judged needs no meeting, so it is dealt by its own place.
    return [np.where(judged, docs, one), np.where(judged, value & 0x7FFFFFFF, two), docs, np.where(judged, ~value, value)]


def _edge_strings(batches: Iterator[pa.RecordBatch], step_rows: int) -> Iterator[pa.RecordBatch]:
    """(doc, text, hash, marks) -> the strings of the marked stretches; ``value`` is the hash of the text and the start."""
    held: list[list[np.ndarray]] = [[], [], [], []]
    count = 0

    def emit():
        rows = combine_strings(*(np.concatenate(h) for h in held))
        for i in range(0, len(rows[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in rows], ["one", "two", "doc", "value"])

    for batch in batches:
        docs, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        at = 0
        for some in blocks(batch.column(1), BLOCK_BYTES):
            row, bounds = text_bytes(some)
            _, names, begin, end, text = stretches(row, bounds)
            hit = _is_marked(names, text, batch.column(3).slice(at, len(some)).to_pylist())
            size = (end - begin + 1)[hit]
            starts = np.arange(size.sum()) + np.repeat(begin[hit] - (np.cumsum(size) - size), size)
            text = np.repeat(text[hit], size)
            value = hashes[at + text] << 32 | (starts - bounds[text])
            one, two = string_pairs(row, starts)
            for h, x in zip(held, (one, two & 0x7FFFFFFF, docs[at + text], value)):  # 95 bits name a string
                h.append(x)
            at += len(some)
            count += len(starts)
            if count >= step_rows:
                yield from emit()
                held, count = [[], [], [], []], 0
    if count:
        yield from emit()


def find_repeats(docs: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """(doc, settled, starts): per document the names of its settled stretches, and the single repeated strings of its texts.

    ``docs`` has columns id (long, never null), text and hash (31 bits of the text's).
    """
    small_batches(docs.sparkSession)
    ranked = docs.select("id", "text").mapInArrow(partial(_rank_rows, step_rows=step_rows), "ranks long, name long, doc long")
    key = F.when(F.col("ranks").isin(*_KNOWN.values()), F.col("name")).otherwise(F.shiftright("ranks", 24))
    dealt = ranked.repartition(key).sortWithinPartitions("ranks", "name", "doc")
    marks = materialise(dealt.mapInArrow(partial(_mark_rows, step_rows=step_rows), "doc long, value long, kind int"), "stretch-marks")
    edges = marks.filter(F.col("kind") == EDGE).groupBy("doc").agg(F.collect_list("value").alias("marks"))
    strings = docs.join(edges, docs["id"] == edges["doc"]).select("id", "text", "hash", "marks")
    pairs = strings.mapInArrow(partial(_edge_strings, step_rows=step_rows), "one long, two long, doc long, value long")
    least = F.min("doc").over(Window.partitionBy("one", "two"))
    single = pairs.withColumn("least", least).filter((F.col("doc") > F.col("least")) | (F.col("value") < 0))
    value = F.when(F.col("value") < 0, F.bitwise_not("value")).otherwise(F.col("value"))
    starts = materialise(single.select("doc", value.alias("value"), F.lit(START).alias("kind")), "string-marks")
    return (
        marks.filter(F.col("kind") == SETTLED)
        .unionByName(starts)
        .groupBy("doc")
        .agg(
            F.collect_list(F.when(F.col("kind") == SETTLED, F.col("value"))).alias("settled"),
            F.collect_list(F.when(F.col("kind") == START, F.col("value"))).alias("starts"),
        )
    )


def removed_bytes(row: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, settled: list, starts: list) -> np.ndarray:
    """True for each byte of the texts that goes."""
    edge = np.zeros(len(row) + 1, np.int64)
    if any(settled):
        _, names, begin, end, text = stretches(row, bounds)
        hit = _is_marked(names, text, settled)
        edge[begin[hit]] += 1
        edge[end[hit] + LENGTH] -= 1
    size = [len(x) if x else 0 for x in starts]
    if any(size):
        value = np.fromiter((v for x in starts if x for v in x), np.int64, sum(size))
        text = np.repeat(np.arange(len(starts)), size)
        own = value >> 32 == hashes[text]
        place = (value & 0xFFFFFFFF)[own] + bounds[text[own]]
        edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + LENGTH, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def _cut(batch: pa.RecordBatch, text: int, hash_: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of the batch its bytes and which of them go; the columns after ``hash_`` are settled and starts."""
    hashes, at = batch.column(hash_).to_numpy(zero_copy_only=False), 0
    for some in blocks(batch.column(text), BLOCK_BYTES):
        row, bounds = text_bytes(some)
        part = slice(at, at + len(some))
        marks = [batch.column(hash_ + k).slice(at, len(some)).to_pylist() for k in (1, 2)]
        gone = removed_bytes(row, bounds, hashes[part], *marks)
        at += len(some)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield row[a:b], gone[a:b]


def _with_marks(docs: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """``docs`` (id, text, hash, ...) with settled and starts."""
    found = find_repeats(docs.select("id", "text", "hash"), step_rows)
    return docs.join(found, docs["id"] == found["doc"], "left").drop("doc")


def _known(docs: DataFrame) -> DataFrame:
    short = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))
    return docs.withColumns({"id": F.coalesce("doc_id", F.lit(_NO_ID)), "hash": short})


def dedup_digest(docs: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, gone in _cut(batch, 1, 2):
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                kept = row[~gone] if spans else row
                out.append((len(row), len(row) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
            n, removed, spans, digest = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return (
        _with_marks(_known(docs.select("doc_id", "text")), step_rows)
        .select("doc_id", "text", "hash", "settled", "starts")
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def remove_repeats(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (all columns kept).

    A character that loses one of its bytes loses all; a document of which nothing is left goes, unless it had no text.
    """
    inner = set_apart(docs, "doc_id", "text")
    at, schema, extra = inner.columns.index("text"), inner.schema, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for i, (row, gone) in enumerate(_cut(batch, at, extra + 1)):
                if gone.any():
                    char = np.cumsum((row & 0xC0) != 0x80) - 1
                    cut = np.zeros(char[-1] + 1, bool)
                    cut[char[gone]] = True
                    texts[i] = row[~cut[char]].tobytes().decode("utf-8", "surrogatepass")
                keep.append(bool(texts[i]) or not gone.any() or not drop_empty)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))
            yield batch.select(range(extra)).filter(pa.array(keep, pa.bool_()))

    marked = _with_marks(_known(inner)).select(*inner.columns, "id", "hash", "settled", "starts")
    return marked.mapInArrow(run, schema).toDF(*docs.columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(documents(spark, sf_dir))
