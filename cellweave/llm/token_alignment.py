"""Alignment of the tokens of two tokenizers by their byte ranges, and how often they meet in a corpus.

A text with a space before it is cut into tokens by A (byte-level) and by B (pieces, which adds that space). Where tokens of
both end at one byte a group ends. An A and a B token are linked where their byte ranges overlap; the count of an id pair is the
number of documents that hold it linked.

* *Segments.* Before a space that follows another character than a space and is not followed by white space, both tokenizers
  cut whatever stands around it: A's pattern takes the space into the next word, and no piece of B has a space behind another
  character (checked when the files are loaded). So a text is the row of its segments, and a worker tokenises and aligns each
  segment once, kept with its text in a table that is started anew when it is large. If a segment does not come back byte for
  byte, the text is taken whole.
* *Identity map.* For each A id there is at most one B id that is taken as the same bytes. Pairs of this map, which is what
  nearly all one-to-one groups are, are counted in a vector as long as A's vocabulary, one a task.
* *Pair shuffle.* Only other pairs become rows, summed in the task before the shuffle. Their counts are written once.
* Texts are tokenised once: the pairs of a document's links are written in a table (4 bytes a link), from which counts and sums are
  taken. The best count of each A id is a vector of A's vocabulary. The counts of pairs are broadcast if they are at most
  ``most_pairs``, which is checked; else the documents' pairs are joined with them. Both ways give the same rows.

Defined cases: texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens (zeros and an
empty digest) and count nowhere; repeated rows and ids count each for itself; an empty table gives no row; other columns are
ignored; special tokens inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, in_small_batches, materialise
from cellweave.llm.textscan import blocks

#: Pairs (of 12 bytes) that are broadcast at most: 48 MB.
MOST_PAIRS = 4 << 20
#: Characters of the segments that a worker keeps, and of a text that are cut into segments at once.
CACHE_CHARS, PART_CHARS = 36 << 20, 1 << 20
#: Bytes of texts whose new segments are tokenised together.
BLOCK_BYTES = 256 << 10
#: Characters that a kept segment counts beside its own, for its numbers.
ENTRY_CHARS = 100
#: Pairs that a task holds before it hands their counts on, and bytes of links that it hands back at once.
HELD_PAIRS, OUT_BYTES = 1 << 20, 4 << 20

#: A space between another character and the start of a word.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")

TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_TEXT_TYPES = [pa.int64()] * 5 + [pa.string(), pa.binary()]
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable ones are themselves, the rest follow 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of their entries and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("no piece may have a space behind another character")
        self.bytes_b = [p.replace("▁", " ").encode() for p in pieces]
        for i, piece in enumerate(pieces):
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Where several pieces have the same bytes (a letter and its byte) the written one is taken.
        same = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=lambda i: not self.b.is_byte(i))}
        self.identity = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)

        #: What is written for an id: A's before ``,`` and ``|``, then B's before ``,``, ``;`` and the end of a segment.
        ids = [[str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b)]
        parts = [[i + "," for i in ids[0]], [i + "|" for i in ids[0]], *([i + mark for i in ids[1]] for mark in (",", ";", "\n"))]
        self.written = np.array(sum(parts, []), object)
        self.written_from = np.cumsum([0, *map(len, parts)])[:-1]

    def encode(self, segments: list[str]) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers for segments that follow each other, each with a space before it."""
        text = " ".join(segments)
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def come_back(self, raw: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b))


@lru_cache(1)
def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    return Tokenizers(*paths)


class Aligned:
    """Groups and links of segments that follow each other, ``sizes`` bytes long, given the ids of both tokenizers."""

    def __init__(self, known: Tokenizers, sizes: np.ndarray, ids_a: list[int], ids_b: list[int]):
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(known.size_a[a]), np.cumsum(known.size_b[b])
        cuts, bounds = np.intersect1d(end_a, end_b, assume_unique=True), np.cumsum(sizes)
        until = [np.searchsorted(x, bounds, side="right") for x in (end_a, end_b, cuts)]
        #: Whether all segments end where tokens of both do; else they can't be parted.
        self.parted = not len(bounds) or bool((cuts[np.maximum(until[2] - 1, 0)] == bounds).all())
        if not self.parted:
            return
        self.n_a, self.n_b, self.n_groups = (np.diff(x, prepend=0) for x in until)
        first = np.searchsorted(end_b, end_a - known.size_a[a], side="right")
        links = np.searchsorted(end_b - known.size_b[b], end_a) - first
        self.link_a = np.repeat(a, links)
        self.link_b = b[np.repeat(first - (np.cumsum(links) - links), links) + np.arange(links.sum())]
        self.n_links = np.diff(np.cumsum(links)[until[0] - 1], prepend=0)
        # A group's A ids come first; the last of a side, a group or a segment is written with another mark.
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        kind_a = np.append(group_a[1:] != group_a[:-1], True).astype(np.int64)
        kind_b = 2 + np.append(group_b[1:] != group_b[:-1], True)
        kind_b[until[1] - 1] = 4
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        at = np.concatenate([known.written_from[kind_a] + a, known.written_from[kind_b] + b])[order]
        self.groups = "".join(known.written[at].tolist()).split("\n")[:-1]


class Grown:
    """Rows that are appended; the space doubles when it is full."""

    def __init__(self, *width: int):
        self.space, self.size = np.zeros((1 << 12, *width), np.int64), 0

    def append(self, rows: np.ndarray) -> None:
        size = self.size + len(rows)
        if size > len(self.space):
            more = np.zeros((max(size, 2 * len(self.space)), *self.space.shape[1:]), np.int64)
            more[: self.size] = self.rows
            self.space = more
        self.space[self.size : size] = rows
        self.size = size

    @property
    def rows(self) -> np.ndarray:
        return self.space[: self.size]


class SegmentTable:
    """The segments that a worker has met. A pair is the number A id x B's vocabulary + B id."""

    def __init__(self, paths: tuple[str, str]):
        self.known = tokenizers(paths)
        self.reset()

    def reset(self) -> None:
        self.number: dict = {}
        self.chars = 0
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, n_links and whether the segment came back whole.
        self.stats = Grown(5)
        #: The pairs of the links, and where those of each segment end.
        self.pairs, self.ends = Grown(), Grown()

    def _learn(self, segments: list[str], names: list) -> None:
        """Enter segments that follow each other in any order, each with a space before it; those that don't come back, too."""
        raw = [b" " + x.encode("utf-8", "replace") for x in segments]
        ids_a, ids_b = self.known.encode(segments)
        whole = self.known.come_back(b"".join(raw), ids_a, ids_b)
        got = Aligned(self.known, np.array([len(x) for x in raw], np.int64), ids_a, ids_b) if whole else None
        if got is None or not got.parted:
            if len(segments) > 1:
                half = len(segments) // 2
                self._learn(segments[:half], names[:half])
                self._learn(segments[half:], names[half:])
                return
            self.groups.append("")
            self.stats.append(np.zeros((1, 5), np.int64))
            self.ends.append(np.array([self.pairs.size]))
        else:
            self.groups += got.groups
            self.stats.append(np.stack([got.n_a, got.n_b, got.n_groups, got.n_links, np.ones_like(got.n_a)], 1))
            self.ends.append(self.pairs.size + np.cumsum(got.n_links))
            self.pairs.append(got.link_a * len(self.known.bytes_b) + got.link_b)
        for name in names:
            self.number[name] = len(self.number)
        self.chars += sum(map(len, raw)) + ENTRY_CHARS * len(names)

    def _numbers(self, rows: list[list[str]]) -> list[list[int]]:
        """Numbers of rows of segments; those that are new are learnt together."""
        found = [list(map(self.number.get, pieces)) for pieces in rows]
        open_rows = [k for k, numbers in enumerate(found) if None in numbers]
        new = dict.fromkeys(x for k in open_rows for x, n in zip(rows[k], found[k]) if n is None)
        inner = [x for x in new if not (x[0].isspace() or x[-1].isspace())]
        if inner:
            self._learn(inner, inner)
        for x in new:
            if x not in self.number:  # white space at an end must not meet other segments
                self._learn([x], [x])
        for k in open_rows:
            found[k] = list(map(self.number.__getitem__, rows[k]))
        return found

    def _checked(self, text: str, numbers: np.ndarray) -> np.ndarray:
        return numbers if self.stats.rows[numbers, 4].all() else self._whole(text)

    def look_up(self, text: str) -> np.ndarray:
        """Numbers of the segments of a text that is not empty; long ones are cut part by part."""
        found, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
            found += self._numbers([_CUT.split(text[at : cut.start() if cut else len(text)])])
            at = cut.end() if cut else len(text)
        return self._checked(text, np.concatenate([np.array(x, np.int64) for x in found]))

    def look_up_all(self, texts: list[str]) -> list[np.ndarray]:
        """The same for some texts at once."""
        if any(len(x) > PART_CHARS for x in texts):
            return [self.look_up(x) for x in texts]
        found = self._numbers([_CUT.split(x) for x in texts])
        return [self._checked(x, np.array(n, np.int64)) for x, n in zip(texts, found)]

    def _whole(self, text: str) -> np.ndarray:
        """One segment for all of a text, kept under a name that no segment has."""
        name = (text,)
        if name not in self.number:
            self._learn([text], [name])
        return np.array([self.number[name]])

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs of the links of these segments, in order."""
        size = self.stats.rows[numbers, 3]
        first = self.ends.rows[numbers] - size
        return self.pairs.rows[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


@lru_cache(1)
def _table(paths: tuple[str, str]) -> SegmentTable:
    """One table for all tasks of a worker."""
    return SegmentTable(paths)


def _number(pairs: int) -> str:
    """The type of the numbers of so many pairs."""
    return "<u4" if pairs <= 1 << 32 else "<u8"


def aligned_texts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each row's counts and digest, with the pair numbers of its links, sorted, as little-endian integers: see TEXTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(paths)
        kind = _number(len(table.known.bytes_a) * len(table.known.bytes_b))
        out: list[tuple] = []
        held = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out), _TEXT_TYPES)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TEXTS.split(", ")])

        for batch in batches:
            at = 0
            for some in blocks(batch.column(1), BLOCK_BYTES):
                if table.chars > CACHE_CHARS:
                    table.reset()
                texts, ids = some.to_pylist(), batch.column(0).slice(at, len(some)).to_pylist()
                at += len(some)
                numbers = iter(table.look_up_all([x for x in texts if x]))
                for doc_id, text in zip(ids, texts):
                    if text:
                        mine = next(numbers)
                        links = np.sort(table.links(mine)).astype(kind).tobytes()
                        out.append((doc_id, *_described(table, mine), links))
                        held += len(links)
                    else:
                        out.append((doc_id, 0, 0, 0, 0, "", b""))
                    if held > OUT_BYTES or len(out) >= 4096:
                        yield rows()
                        out, held = [], 0
        if out:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TEXTS)


def pair_counts(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(a, b, docs): how many rows of :func:`aligned_texts` hold each linked id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(paths)
        identity, width = known.identity, len(known.bytes_b)
        kind = _number(len(known.bytes_a) * width)
        vector = np.zeros(len(identity), np.int64)
        held: list[np.ndarray] = []
        n = 0

        def rows(pairs: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*np.divmod(pairs, width), count)], ["a", "b", "docs"])

        for batch in batches:
            for raw in batch.column(0):
                links = np.frombuffer(raw.as_py(), kind).astype(np.int64)
                if not len(links):
                    continue
                pairs = links[np.append(True, links[1:] != links[:-1])]
                a, b = np.divmod(pairs, width)
                same = identity[a] == b
                vector[a[same]] += 1
                held.append(pairs[~same])
                n += len(held[-1])
                if n > HELD_PAIRS:
                    yield rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if n:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))
        met = np.flatnonzero(vector)
        yield rows(met * width + identity[met], vector[met])

    found = texts.select("links").mapInArrow(run, "a long, b long, docs long")
    return found.groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def best_counts(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """The highest count of each A id: one number for each entry of the vocabulary."""
    out = np.zeros(vocabulary, np.int64)
    got = counts.groupBy("a").agg(F.max("docs").alias("docs")).toArrow()
    out[got["a"].to_numpy()] = got["docs"].to_numpy()
    return out


def _described(table: SegmentTable, numbers: np.ndarray) -> tuple:
    """n_a, n_b, n_groups, n_links and the digest of a text's groups."""
    n_a, n_b, n_groups, n_links, whole = table.stats.rows[numbers].sum(0).tolist()
    if whole < len(numbers):
        return 0, 0, 0, 0, ""
    digest = hashlib.sha256()
    for i in range(0, len(numbers), 1 << 16):
        part = ";".join(map(table.groups.__getitem__, numbers[i : i + (1 << 16)].tolist()))
        digest.update((";" * (i > 0) + part).encode())
    return n_a, n_b, n_groups, n_links, digest.hexdigest()


def _looked_up(texts: DataFrame, kind: str, width: int, counts: Broadcast, best: Broadcast) -> DataFrame:
    """n_best and count_sum of each row by binary search in the sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, often = counts.value
        for batch in batches:
            raw = batch.column("links")
            n_best, count_sum = [], []
            for x in raw:
                links = np.frombuffer(x.as_py(), kind).astype(np.int64)
                n = often[np.searchsorted(pairs, links)]
                n_best.append(int((n == best.value[links // width]).sum()))
                count_sum.append(int(n.sum()))
            known = [batch.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            sums = [pa.array(x, pa.int64()) for x in (n_best, count_sum)]
            names = [x.split()[0] for x in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([*known, *sums, batch.column("groups_sha256")], names)

    return texts.mapInArrow(run, ALIGNED)


def _joined(texts: DataFrame, kind: str, width: int, counts: DataFrame) -> DataFrame:
    """The same by a join of each row's pairs with the counts, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column(0), batch.column(1)):
                pairs, times = np.unique(np.frombuffer(raw.as_py(), kind).astype(np.int64), return_counts=True)
                columns = [np.full(len(pairs), row.as_py()), *np.divmod(pairs, width), times]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["row", "a", "b", "times"])

    # Numbered rows are written, as they meet again.
    rows = materialise(texts.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    links = rows.select("row", "links").mapInArrow(run, "row long, a long, b long, times long")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    known = counts.join(best, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("is_best"))
    summed = links.join(known, ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    met = rows.drop("links").join(summed, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return met.select(*[x.split()[0] for x in ALIGNED.split(", ")])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The alignment of each row of (doc_id, text), see ALIGNED, and the counts (a, b, docs) of all linked id pairs."""
    paths = paths or default_tokenizers()
    known = tokenizers(paths)
    with in_small_batches(docs.sparkSession):
        texts = materialise(aligned_texts(docs, paths), "aligned-texts")
    counts = materialise(pair_counts(texts, paths), "alignment-pairs")
    width, context = len(known.bytes_b), docs.sparkSession.sparkContext
    kind = _number(len(known.bytes_a) * width)
    if counts.count() > most_pairs:
        return _joined(texts, kind, width, counts), counts
    got = counts.select((F.col("a") * width + F.col("b")).alias("pair"), "docs").toArrow()
    pairs, often = got["pair"].to_numpy(), got["docs"].to_numpy()
    order = np.argsort(pairs)
    best = context.broadcast(best_counts(counts, len(known.bytes_a)))
    return _looked_up(texts, kind, width, context.broadcast((pairs[order], often[order])), best), counts


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))[0]
