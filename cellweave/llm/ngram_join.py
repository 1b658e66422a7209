r"""N-gram Jaccard self-join with Bayesian candidate pruning.

Words are ``[^\x00-\x20]+`` of the lower-cased text; a document is the set of its five-word shingles (one shingle of all words
if it has fewer). Two documents are linked if the Jaccard similarity of their sets is 0.8 or more; documents that are joined
by links, or have equal words, are a class.

1. Documents with equal word rows are one text, represented by the least doc_id.
2. A text has ``BANDS`` x ``ROWS`` MinHash codes of one byte. Texts that agree in all codes of a band are candidates; a pair
   of similarity 0.8 is missed with a probability of (1 - 0.8^6)^40 = 5e-6, one of 0.85 with 1e-9.
3. Candidates are compared by growing prefixes of their codes. With m of n codes equal and a uniform prior, a pair leaves as
   soon as the posterior probability of reaching the threshold is under ``TOLERANCE``.
4. The survivors' components are compared exactly, over whole sets of 64-bit shingle names.

Buckets and components of any size are dealt into blocks; a task sees two blocks, so no group meets in one task, and pairs are
counted where they are found and never become rows: a task returns the number of links of each text and one edge per linked
text. A pair that shares several buckets is taken up only in the first band in which its codes agree. A block of sets has
about ``SET_BLOCK`` texts or ``SET_BYTES`` bytes, so a set of a component of m texts is sent about m / ``SET_BLOCK`` times.

Rows have keys of their own, so ids may repeat, with equal or different texts, and may be null.

Defined cases: null texts and texts without a word have no shingle, are linked to nothing and are their own class; repeated
rows and exact copies count as links of each other; a class is named by the least doc_id in it, null if all are null; an empty
table gives no row; other columns are ignored by the query and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise, set_apart, small_batches
from cellweave.llm.components import components, local_roots
from cellweave.llm.suffix_scan import Names, scramble
from cellweave.llm.textscan import runs

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
CODES = BANDS * ROWS
TOLERANCE = 1e-6
STEPS = (24, 48, 96, 168, CODES)
#: Texts of a block while codes are compared, and texts and bytes of one while sets are.
CODE_BLOCK, SET_BLOCK, SET_BYTES = 256, 1024, 8 << 20
PAIRS_AT_ONCE = 40_000

_rng = np.random.default_rng(20240917)
_MULTIPLY = (_rng.integers(1, 1 << 31, CODES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, CODES, dtype=np.int64).astype(np.uint32)[:, None]


def word_names(text: str | None) -> np.ndarray:
    row = np.frombuffer(text.lower().encode("utf-8", "surrogatepass") if text else b"", np.uint8)
    start, end = runs(row > 32)
    return Names(row).of(start, end)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit names of the shingles."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = scramble(out + words[k : k + len(out)] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    return np.unique(out)


def minhash_codes(names: np.ndarray) -> np.ndarray:
    least = np.full(CODES, 0xFFFFFFFF, np.uint32)
    x = (names ^ (names >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = x[None, i : i + 2048] * _MULTIPLY
        h += _ADD
        np.minimum(least, h.min(1), out=least)
    return (least ^ (least >> np.uint32(11)) ^ (least >> np.uint32(21))).astype(np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones, twos, sizes, codes = [], [], [], []
        for text in batch.column(2):
            words = word_names(text.as_py())
            found = shingles(words)
            place = np.arange(1, len(words) + 1, dtype=np.uint64)
            ones.append(int(scramble(words + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
            twos.append(int(scramble(words ^ scramble(place)).sum(dtype=np.uint64).view(np.int64)))
            sizes.append(len(found))
            codes.append(minhash_codes(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array(ones, pa.int64()),
                pa.array(twos, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(codes, pa.binary()),
            ],
            ["id", "hash", "one", "two", "n_shingles", "codes"],
        )


def _band_keys(codes: np.ndarray) -> np.ndarray:
    """(n, CODES) bytes -> (n, BANDS) keys: the band's number and its codes, so equal keys are equal codes."""
    wide = np.zeros((len(codes), BANDS, 8), np.uint8)
    wide[:, :, :ROWS] = codes.reshape(len(codes), BANDS, ROWS)
    return wide.view("<i8")[:, :, 0] | (np.arange(BANDS, dtype=np.int64) << (8 * ROWS))


def _code_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CODES)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = _band_keys(_code_matrix(batch.column(1)))
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], ["key", "rep"])


def _block_of(rep: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (scramble(rep.astype(np.int64).view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)


def _meetings(own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in block ``own`` of ``n``: row numbers, and the lower and upper block of each pair of blocks they are in."""
    row = np.repeat(np.arange(len(own)), n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    mine = own[row]
    return row, np.minimum(mine, other), np.maximum(mine, other)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, codes, buckets) -> a row for each bucket and pair of blocks that the text is in."""
    for batch in batches:
        lists = batch.column(2)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        key = lists.flatten().field("key").to_numpy(zero_copy_only=False)
        members = lists.flatten().field("m").to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(batch.num_rows), size)
        rep = batch.column(0).to_numpy(zero_copy_only=False)[text]
        n = -(-members // CODE_BLOCK)
        own = _block_of(rep, n)
        row, low, high = _meetings(own, n)
        for i in range(0, len(row), 8192):
            r = row[i : i + 8192]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[r]),
                    pa.array(low[i : i + 8192]),
                    pa.array(high[i : i + 8192]),
                    pa.array(own[r]),
                    pa.array(rep[r]),
                    batch.column(1).take(pa.array(text[r])),
                ],
                ["key", "low", "high", "own", "rep", "codes"],
            )


@lru_cache(4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, steps: tuple = STEPS) -> tuple[int, ...]:
    """For each n of ``steps`` the least number of equal codes with which a pair stays."""
    s = (np.arange(20000) + 0.5) / 20000
    p = s + (1 - s) / 256  # one-byte codes of different minima agree by chance
    out = []
    for n in steps:
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(logs - logs.max(1, keepdims=True))
        reach = weight[:, s >= threshold].sum(1) / weight.sum(1)
        out.append(int(np.flatnonzero(reach >= tolerance)[0]))
    return tuple(out)


def _group_pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, groups being contiguous; in groups marked ``cross`` only those of different sides."""
    n = len(group)
    end = np.searchsorted(group, group, side="right")
    left, right, held = [], [], 0
    rows, shift = np.arange(n), 1
    while len(rows := rows[rows + shift < end[rows]]):
        other = rows + shift
        fits = ~cross[rows] | (side[rows] != side[other])
        left.append(rows[fits])
        right.append(other[fits])
        held += int(fits.sum())
        shift += 1
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def prune(codes: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray) -> np.ndarray:
    """True for the pairs to be verified: first met in this band, and never improbable. Codes of live pairs only are compared."""
    live, count, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in zip(STEPS, least_matches()):
        same = codes[left[live], done:n] == codes[right[live], done:n]
        agree = same.reshape(len(live), (n - done) // ROWS, ROWS).all(2)
        first = np.where(agree.any(1), agree.argmax(1) + done // ROWS, BANDS)
        count = count + np.count_nonzero(same, axis=1)
        stay = (first >= band[live]) & (count >= least)
        live, count, done = live[stay], count[stay], n
    out = np.zeros(len(left), bool)
    out[live] = True
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that hold whole groups of the first ``keys`` columns, by which rows are sorted."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = np.ones(count, bool)
        for k in range(keys):
            c = whole.column(k).to_numpy()
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            count -= cut
    if count:
        yield pa.Table.from_batches(held)


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _sorted_groups(batches, 3, 20_000):
        key, low, high, own, rep = (t.column(k).to_numpy() for k in range(5))
        codes = _code_matrix(t.column(5))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        names, number = np.unique(rep, return_inverse=True)
        lefts, rights = [], []
        for left, right in _group_pairs(np.cumsum(new), own, low != high):
            for i in range(0, len(left), PAIRS_AT_ONCE):
                a, b = left[i : i + PAIRS_AT_ONCE], right[i : i + PAIRS_AT_ONCE]
                keep = prune(codes, a, b, key[a] >> (8 * ROWS))
                # Of the pairs only a forest is kept.
                lefts.append(number[a[keep]])
                rights.append(number[b[keep]])
        if lefts:
            root = local_roots(np.concatenate(lefts), np.concatenate(rights), len(names))
            some = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], ["a", "b"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text, component, blocks, copies) -> a row with the shingles for each pair of blocks that the text is in."""
    for batch in batches:
        rep, comp, n, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
        own = _block_of(rep, n)
        for k, text in enumerate(batch.column(1)):
            names = shingles(word_names(text.as_py())).tobytes()
            _, low, high = _meetings(own[k : k + 1], n[k : k + 1])
            step = max(1, SET_BYTES // max(len(names), 1))
            for i in range(0, len(low), step):
                size = len(low[i : i + step])
                fixed = [pa.array(np.full(size, x[k])) for x in (own, rep, copies)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, comp[k])),
                        pa.array(low[i : i + step]),
                        pa.array(high[i : i + step]),
                        *fixed,
                        pa.array([names] * size, pa.binary()),
                    ],
                    ["comp", "low", "high", "own", "rep", "copies", "names"],
                )


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets on the left with those on the right."""
    both = len(left) + len(right)
    owner = np.repeat(np.arange(both), [len(s) for s in (*left, *right)])
    names, flat = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    often = np.bincount(flat, minlength=len(names)) > 1
    column = np.cumsum(often) - 1
    keep = often[flat]
    owner, flat = owner[keep], column[flat[keep]]
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for i in range(0, int(often.sum()), width):
        a, b = np.searchsorted(flat, [i, i + width])
        grid = np.zeros((both, min(width, int(often.sum()) - i)), np.float32)
        grid[owner[a:b], flat[a:b] - i] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out.astype(np.int64)


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _sorted_groups(batches, 3, 1):
        comp, low, high, own, rep, copies = (t.column(k).to_numpy() for k in range(6))
        new = np.ones(len(comp), bool)
        new[1:] = (comp[1:] != comp[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begin = np.flatnonzero(new)
        for a, b in zip(begin, np.append(begin[1:], len(comp))):
            sets = [np.frombuffer(x, np.uint64) for x in t.column(6).slice(a, b - a).to_pylist()]
            size = np.array([len(s) for s in sets])
            # Of two blocks the one meets the other; one block meets itself.
            rows = np.flatnonzero(own[a:b] == low[a])
            others = np.flatnonzero(own[a:b] == high[a])
            if not len(rows) or not len(others):
                continue
            links, edges = np.zeros(b - a, np.int64), []
            for i in range(0, len(rows), 256):
                some = rows[i : i + 256]
                both = intersections([sets[k] for k in some], [sets[k] for k in others])
                linked = both >= THRESHOLD * (size[some, None] + size[None, others] - both) - 1e-9
                linked &= some[:, None] != others[None, :]
                links[some] += linked @ copies[a:b][others]
                if low[a] != high[a]:
                    links[others] += copies[a:b][some] @ linked
                left, right = np.nonzero(linked)
                edges.append((some[left], others[right]))
            left, right = (np.concatenate(x) for x in zip(*edges))
            root = local_roots(left, right, b - a)
            # The least key of a local component names it.
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, root, rep[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[a:b]), pa.array(least[root]), pa.array(links)], ["rep", "root", "links"]
            )


def _classified(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: id, hash of the text, n_shingles, class_key, class_id and n_links; without a shingle the last three are null."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    columns = "id long, hash long, one long, two long, n_shingles long, codes binary"
    sketched = materialise(source.mapInArrow(_sketch, columns).withColumn("row", F.monotonically_increasing_id()), "sketches")
    texts = materialise(
        sketched.filter("n_shingles > 0")
        .groupBy("one", "two")
        .agg(
            F.min(F.struct("row", "id", "hash")).alias("first"),
            F.min("id").alias("least_id"),
            F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("codes").alias("codes"),
        )
        .select("one", "two", F.col("first.row").alias("rep"), "first.id", "first.hash", "least_id", "copies", "n_shingles", "codes"),
        "texts",
    )
    bands = texts.select("rep", "codes").mapInArrow(_band_rows, "key long, rep long")
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    buckets = bands.join(shared, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "m")).alias("buckets"))
    met = texts.select("rep", "codes").join(buckets, "rep").select("rep", "codes", "buckets")
    dealt = (
        met.mapInArrow(_bucket_rows, "key long, low long, high long, own long, rep long, codes binary")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
    )
    likely = components(dealt.mapInArrow(_candidate_edges, "a long, b long"))

    members = likely.join(texts.drop("one", "two", "codes", "least_id"), F.col("node") == F.col("rep"))
    n_blocks = F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(8 * F.sum("n_shingles") / SET_BYTES))
    sizes = members.groupBy("component").agg(n_blocks.cast("long").alias("n_blocks"))
    asked = members.join(sizes, "component").select(
        F.col("id").alias("asked_id"), F.col("hash").alias("asked_hash"), "rep", "component", "n_blocks", "copies"
    )
    small_batches(spark, 64)
    sets = (
        source.join(asked, F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("hash") == F.col("asked_hash")))
        .dropDuplicates(["rep"])
        .select("rep", "text", "component", "n_blocks", "copies")
        .mapInArrow(_set_rows, "comp long, low long, high long, own long, rep long, copies long, names binary")
        .repartition("comp", "low", "high")
        .sortWithinPartitions("comp", "low", "high")
    )
    links = materialise(sets.mapInArrow(_exact_links, "rep long, root long, links long"), "links")
    small_batches(spark)
    classes = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(texts.select("rep", "least_id"), F.col("node") == F.col("rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("class_least"))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    by_text = (
        texts.select("one", "two", "rep", "copies", "least_id")
        .join(classes.join(least, "component"), F.col("rep") == F.col("node"), "left")
        .join(counts, "rep", "left")
        .select(
            F.col("one").alias("t1"),
            F.col("two").alias("t2"),
            F.coalesce("component", "rep").alias("class_key"),
            F.coalesce("class_least", "least_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    same = (F.col("one") == F.col("t1")) & (F.col("two") == F.col("t2")) & (F.col("n_shingles") > 0)
    return sketched.join(by_text, same, "left").select("id", "hash", "n_shingles", "class_key", "class_id", "n_links")


def similar_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles) of every row of ``docs`` (doc_id, text).

    ``n_links`` counts the other rows whose text is similar or equal; ``class_id`` is the least doc_id of the class.
    """
    return _classified(docs).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with one row of each class: one of least doc_id (null last). Rows without a shingle stay."""
    inner = set_apart(docs, "doc_id", "text")
    rows = materialise(_classified(inner), "classified")
    linked = rows.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("w")
    kept = linked.groupBy("class_key").agg(first).select(F.col("w.id").alias("kept_id"), F.col("w.hash").alias("kept_hash"))
    bare = rows.filter("n_shingles = 0").select(F.col("id").alias("kept_id"), F.col("hash").alias("kept_hash"))
    often = linked.groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    often = often.select(F.col("id").alias("often_id"), F.col("hash").alias("often_hash"))
    repeats = F.col("kept_id").eqNullSafe(F.col("often_id")) & (F.col("kept_hash") == F.col("often_hash"))
    keyed = inner.withColumn("hash", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    once = keyed.join(kept.join(often, repeats, "left_anti").unionByName(bare), on, "left_semi")
    # Rows that agree in id and text are told apart by nothing else, so one of them is taken.
    again = keyed.join(kept.join(often, repeats, "left_semi"), on, "left_semi").dropDuplicates(["doc_id", "hash"])
    return once.unionByName(again).drop("hash").toDF(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir))
