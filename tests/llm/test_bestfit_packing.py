"""Best-fit packing: token ids against the tokenizer, and the number of sequences against bounds and an exact search."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import bestfit_packing as bp
from cellweave.llm.common import documents

SF = "/root/testdata/sf0.001"


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best-fit decreasing needs, one piece after the other."""
    gaps, n = Counter(), 0
    for x in sorted(Counter(counts).elements(), reverse=True):
        fits = [g for g, k in gaps.items() if k and g >= x]
        gap = min(fits) if fits else capacity
        gaps[gap] -= bool(fits)
        n += not fits
        gaps[gap - x] += 1
    return n


@lru_cache(None)
def fewest(lengths: tuple, capacity: int) -> int:
    """The optimum: the longest piece's sequence is filled in every way."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]

    def fill(left: tuple, gap: int, start: int):
        yield left
        for i in range(start, len(left)):
            if left[i] <= gap and (i == start or left[i] != left[i - 1]):
                yield from fill(left[:i] + left[i + 1 :], gap - left[i], i)

    return 1 + min(fewest(left, capacity) for left in set(fill(rest, capacity - first, 0)))


def check_plan(counts, capacity):
    patterns = bp.plan(counts, capacity)
    made = Counter()
    for many, content in patterns:
        assert many > 0 and sum(x * k for x, k in content) <= capacity
        for x, k in content:
            made[x] += many * k
    assert made == Counter({x: n for x, n in counts.items() if n})
    return sum(many for many, _ in patterns)


@pytest.mark.parametrize("capacity", [1, 2, 7, 12, 20])
def test_small_plans_are_near_the_optimum(capacity):
    rng = np.random.default_rng(capacity)
    worse = 0
    for _ in range(40):
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 9)))
        best = fewest(tuple(sorted(lengths.tolist(), reverse=True)), capacity)
        n = check_plan(Counter(lengths.tolist()), capacity)
        assert best <= n <= best + 1
        worse += n > best
    assert worse <= 4


@pytest.mark.parametrize("kind", ["uniform", "short", "middle", "few", "many"])
def test_plans_are_no_worse_than_best_fit_decreasing(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "uniform": rng.integers(1, 2049, 4000),
        "short": np.clip(rng.exponential(300, 6000).astype(int) + 1, 1, 2048),
        "middle": rng.integers(600, 1000, 3000),
        "few": rng.integers(500, 1500, 300),
        "many": rng.integers(1, 2049, 10),
    }[kind]
    counts = Counter(lengths.tolist())
    if kind == "many":
        counts = Counter({x: n * 10**12 for x, n in counts.items()})
        check_plan(counts, 2048)
        return
    n, least = check_plan(counts, 2048), -(-int(lengths.sum()) // 2048)
    assert least <= n <= best_fit_decreasing(counts, 2048)
    if kind == "short":
        assert n == least


def test_exact_complements_count_what_is_there():
    index = bp.SumIndex([0, 0, 0, 2, 0, 1, 0, 0, 0, 0, 0])
    assert index.exact(6, Counter(), 3) == (3, 3) and index.exact(6, Counter([3]), 3) == ()
    assert index.exact(8, Counter(), 3) == (5, 3) and index.exact(10, Counter(), 3) == ()
    assert index.exact(9, Counter(), 3) == () and index.exact(5, Counter([5]), 3) == ()


def placed(df, capacity=2048):
    """The pieces by sequence, checked to be gapless and within the capacity."""
    by = defaultdict(list)
    for r in df.collect():
        by[r.sequence_id].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by


def whole_ids(text, end):
    from tokenizers import Tokenizer

    return [*_tokenizer(Tokenizer).encode(text or "", add_special_tokens=False).ids, end]


@lru_cache(1)
def _tokenizer(kind):
    return kind.from_file(bp.default_tokenizer())


def test_query_holds_every_token_once(spark):
    from cellweave.llm.queries import QUERIES

    by = placed(QUERIES["op12_bestfit_packing"](spark, SF))
    pieces = defaultdict(list)
    for r in (r for rows in by.values() for r in rows):
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    total = 0
    for r in documents(spark, SF).collect():
        ids = whole_ids(r.text, 0)
        want = []
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted(pieces.pop(r.doc_id)) == want
        total += len(ids)
    assert not pieces and -(-total // 2048) <= len(by) <= -(-total // 2048) + 1


def test_odd_rows_small_capacity(spark):
    texts = [None, "", "one two three", "one two three", "word " * 100, "ß <|endoftext|> é", "x" * 300]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(4, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "task": F.lit(1), "n": F.lit(2)})
    out = bp.pack_best_fit(docs.repartition(5), capacity=16, with_ids=True)
    by = placed(out, 16)
    got = Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for rows in by.values() for r in rows)
    want = Counter()
    for doc, text in rows:
        ids = whole_ids(text, 0)
        want.update((doc, k, s, np.array(ids[s : s + 16], "<u4").tobytes()) for k, s in enumerate(range(0, len(ids), 16)))
    assert got == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for rows in by.values() for r in rows)
    assert bp.pack_best_fit(docs.limit(0)).count() == 0
