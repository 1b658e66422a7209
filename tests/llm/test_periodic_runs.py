"""Periodic runs against a brute-force search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from cellweave.llm import periodic_runs as pr
from cellweave.llm.common import documents

SF = "/root/testdata/sf0.001"


def brute(c, least=24, times=3):
    """Maximal stretches of every period, without those whose words have a smaller one."""
    n, out = len(c), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if c[i] != c[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and c[i] == c[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, times * q) and not any(c[s : s + length - d] == c[s + d : s + length] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (4, 3), (2, 2), (12, 4)])
def test_runs_equal_brute_force(least, times):
    rng = np.random.default_rng(least)
    for case in range(400):
        n = int(rng.integers(0, 140))
        c = rng.integers(0, int(rng.integers(1, 4)), n)
        if case % 3 == 0 and n > 30:
            c, p, a = rng.integers(0, 50, n), int(rng.integers(1, n // 3)), int(rng.integers(0, n))
            for i in range(a, n):
                c[i] = c[a + (i - a) % p]
        assert pr.runs_of(c.astype(np.int64), least, times) == brute(c.tolist(), least, times)


@pytest.mark.parametrize("kind", ["one word", "long period", "phrase", "two words"])
def test_long_texts_take_linear_time(kind):
    import time

    n = np.arange(300_000)
    codes = {
        "one word": n * 0,
        "long period": n % 75_000,
        "phrase": np.where(n % 17 == 0, n + 100, n % 17),  # a phrase of 16 words between words of their own
        "two words": np.random.default_rng(1).integers(0, 2, len(n)),
    }[kind]
    began = time.process_time()
    found = pr.runs_of(codes)
    assert time.process_time() - began < 20
    if kind in ("one word", "long period"):
        assert found == [(0, 300_000, 1 if kind == "one word" else 75_000)]


def test_operator_on_odd_rows(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " \t\n", "a " * 30, "x y " * 8 + "end", "é ü " * 12 + "é", "a " * 30, " ".join(f"w{i}" for i in range(100))]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, "b c " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("s")})
    got = {(r.doc_id, r.n_words): r for r in pr.periodic_runs(docs).collect()}
    assert len(got) == len(rows)
    assert got[(None, 0)].runs == [] and got[(1, 0)].collapsed == "" == got[(2, 0)].collapsed
    assert [tuple(x) for x in got[(3, 30)].runs] == [(0, 30, 1)] and got[(3, 30)].collapsed == "a"
    assert [tuple(x) for x in got[(3, 24)].runs] == [(0, 24, 2)] and got[(3, 24)].collapsed == "b c"
    assert got[(4, 9)].runs == [] and [tuple(x) for x in got[(5, 25)].runs] == [(0, 25, 2)]
    assert got[(7, 100)].collapsed == texts[7]
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    want = {}
    for r in documents(spark, SF).select("doc_id", "text").collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        code = {x: i for i, x in enumerate(dict.fromkeys(w))}
        # Only documents of up to 1,500 words, as brute force takes their square.
        runs = brute([code[x] for x in w]) if n <= 1500 else None
        if runs is None:
            continue
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-(x[1] / x[2]), x[0], x[2]), default=(None, None, None))
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, kept)]
        want[r.doc_id] = (len(runs), *best, milli, *digests)
    from cellweave.llm.queries import QUERIES

    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) >= len(want) > 150 and sum(x[0] > 0 for x in want.values()) > 10
    assert {k: got[k] for k in want} == want
