"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are maximal runs of ASCII letters and digits and of any non-ASCII characters, with A-Z lower-cased. A window is
ten consecutive words of one test item; an item of one to nine words is one window as a whole. A document word inside an
occurrence of a window is hit. Test words are numbered, so a document becomes a row of numbers; windows of test words only
are looked up by fingerprint in the set, and every hit is verified word by word.

The set is arrays, 11 to 22 bytes for each byte of the tests as measured. What is broadcast is bounded: the different tests are put
into slices of at most ``slice_bytes`` of text and ids (only a single test may be longer). One slice is the usual case. Of several,
each is a scan in tasks of its own, so a task holds one set, and hits are brought together by row.

Defined cases: a null or wordless text has no words, no hits and no items; item ids may repeat (the id is reported once); a
test without an id hits words but is not listed; an empty test table leaves every document clean; repeated documents are
scanned each for itself; an empty document table gives no row; other columns are ignored by the query and kept by
:func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise, small_batches
from cellweave.llm.textscan import NameTable, blocks, chunk_bounds, chunk_names

WINDOW = 10
SLICE_BYTES = 8 << 20

# Every byte that is not part of a word becomes a space; A-Z become a-z. UTF-8 bytes of non-ASCII characters are word bytes.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_FOLD_ROW = np.frombuffer(_FOLD, np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit names of all words of some texts, in order, and where each text's words begin and end."""
    row, start, end, owner = chunk_bounds(texts, _FOLD_ROW)
    return chunk_names(row, start, end), np.searchsorted(owner, np.arange(len(texts) + 1))


def _prints(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint of the n ids from each start."""
    out = np.full(len(starts), n, np.uint64)
    for k in range(n):
        out = (out ^ ids[starts + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first..first+size: which range, and all their members."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class WindowSet:
    """The different windows of one slice of tests, by size: fingerprints in order, where the words are, and whose they are."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = [None if i is None else str(i) for i, _ in items]
        said, bounds = words(pa.array([t for _, t in items], pa.large_string()))
        self.vocabulary = NameTable()
        self.vocabulary.add(np.unique(said))
        self.ids = self.vocabulary.find(said)
        count = np.diff(bounds)
        size = np.minimum(count, window)
        self.sizes: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(size[size > 0]).tolist():
            some = np.flatnonzero(size == n)
            which, at = _spread(bounds[some], count[some] - n + 1)
            prints, item = _prints(self.ids, at, n), some[which]
            order = np.lexsort((item, prints))
            prints, item, at = prints[order], item[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = prints[1:] != prints[:-1]
            for k in range(n):
                new[1:] |= self.ids[at[1:] + k] != self.ids[at[:-1] + k]
            first = np.flatnonzero(new)
            self.sizes[n] = prints[first], at[first], np.append(first, len(at)), item

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """Per text: how many words it has, the sorted places of the hit words, and the items hit, as sorted strings."""
        said, bounds = words(texts)
        ids = self.vocabulary.find(said)
        edge = np.zeros(len(ids) + 1, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whose = [np.empty(0, np.int64)]
        run = np.zeros(len(ids), np.int64)  # test words of the text from here on
        stop = np.union1d(np.flatnonzero(ids < 0), bounds[1:])
        run = stop[np.searchsorted(stop, np.arange(len(ids)), side="right")] - np.arange(len(ids)) if len(ids) else run
        run[ids < 0] = 0
        for n, (prints, at, first, item) in self.sizes.items():
            starts = np.flatnonzero(run >= n)
            got = _prints(ids, starts, n)
            low = np.searchsorted(prints, got)
            found = low < len(prints)
            found[found] = prints[low[found]] == got[found]
            starts, low, got = starts[found], low[found], got[found]
            which, window = _spread(low, np.searchsorted(prints, got, side="right") - low)
            starts = starts[which]
            same = np.ones(len(starts), bool)
            for k in range(n):
                same &= ids[starts + k] == self.ids[at[window] + k]
            starts, window = starts[same], window[same]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + n, -1)
            both = np.unique(owner[starts] * len(prints) + window)
            text, window = both // len(prints), both % len(prints)
            which, place = _spread(first[window], first[window + 1] - first[window])
            whose.append(np.unique(text[which] * len(self.names) + item[place]))
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        hits = np.split(hit - bounds[owner[hit]], np.searchsorted(owner[hit], np.arange(1, len(texts))))
        items: list[set] = [set() for _ in range(len(texts))]
        for pair in np.unique(np.concatenate(whose)).tolist():
            name = self.names[pair % len(self.names)]
            if name is not None:
                items[pair // len(self.names)].add(name)
        return np.diff(bounds), hits, [sorted(x) for x in items]


def _slices(tests: DataFrame, slice_bytes: int, window: int) -> Iterator[WindowSet]:
    """The sets of all slices, one at least. Tests come to the driver as they are put into slices, and stay no longer."""
    some, room = [], slice_bytes
    for row in tests.filter(F.octet_length("text") > 0).dropDuplicates().toLocalIterator():
        size = len(row["text"].encode("utf-8", "surrogatepass")) + len(str(row["item_id"]))
        if some and size > room:
            yield WindowSet(some, window)
            some, room = [], slice_bytes
        some.append((row["item_id"], row["text"]))
        room -= size
    yield WindowSet(some, window)


_FOUND = "n_words long, hits array<long>, items array<string>"


def _scan(docs: DataFrame, tests: WindowSet, key: str, only_hits: bool) -> DataFrame:
    """``docs`` (key, text) as key, n_words, hits and items."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in blocks(batch.column(1)):
                count, hits, items = shared.value.scan(some)
                found = [pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *found], [key, "n_words", "hits", "items"])
                at += len(some)
                yield out.filter(pa.array([len(h) > 0 for h in hits], pa.bool_())) if only_hits else out

    return docs.mapInArrow(run, f"{key} long, {_FOUND}")


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, n_words, hits (sorted word positions), items (ids of the tests hit, as sorted strings)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    slices = _slices(benchmark.select("item_id", "text"), slice_bytes, window)
    first, second = next(slices), next(slices, None)
    if second is None:
        return _scan(docs, first, "doc_id", False)
    # Equal and null ids stay rows of their own.
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = _scan(rows.select("row", "text"), first, "row", False)
    while second is not None:
        found = found.unionByName(_scan(rows.select("row", "text"), second, "row", True))
        second = next(slices, None)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), union("hits"), union("items"))
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def cut_spans(text: str | None, hits: set[int]) -> str | None:
    """The text without its hit words; the marks and spaces around the words that stay are kept."""
    if text is None or not hits:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    out, at, k, i = bytearray(), 0, 0, 0
    while i < len(folded):
        if folded[i] == 32:
            i += 1
            continue
        end = folded.find(b" ", i)
        end = len(folded) if end < 0 else end
        if k in hits:
            out += raw[at:i]
            at = end
        k += 1
        i = end
    return (bytes(out) + raw[at:]).decode("utf-8", "surrogatepass")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` without contamination: mode 'documents' drops hit documents, 'spans' cuts the hit words out.

    All columns are kept. Every slice of tests is a pass of its own over what the passes before have left and written.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    spark = docs.sparkSession
    small_batches(spark)
    at, schema = docs.columns.index("text"), docs.schema
    for k, tests in enumerate(_slices(benchmark.select("item_id", "text"), slice_bytes, window)):
        docs = materialise(docs, "cleaned") if k else docs
        shared = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [h for some in blocks(batch.column(at)) for h in shared.value.scan(some)[1]]
                if mode == "documents":
                    yield batch.filter(pa.array([not len(h) for h in hits], pa.bool_()))
                else:
                    texts = [cut_spans(t.as_py(), set(h.tolist())) for t, h in zip(batch.column(at), hits)]
                    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

        docs = docs.mapInArrow(run, schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )



_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP9_SQL = f"""
WITH tests AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
         array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM tests WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
),
found AS (SELECT DISTINCT s.doc_id, s.n, s.i, g.item_id FROM spots s JOIN grams g ON s.n = g.n AND s.gram = g.gram),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
),
who AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
