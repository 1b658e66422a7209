"""Token alignment against a plain version that tokenises whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellweave.llm import token_alignment as ta
from cellweave.llm.common import documents

SF = "/root/testdata/sf0.001"
PATHS = ta.default_tokenizers()


def brute(rows):
    """(doc_id, text) -> the contract's columns, by the byte ranges of every token of the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = ta._byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at += len(of(i))
        return out

    found, held = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        if not text:
            found.append((doc, [], [], [], ""))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        if b"".join(map(names.get, ids_a)) != raw or b"".join(map(piece, ids_b)) != raw:
            found.append((doc, [], [], [], ""))
            continue
        sa, sb = spans(ids_a, names.get), spans(ids_b, piece)
        links, j = [], 0
        for s, e, i in sa:
            while sb[j][1] <= s:
                j += 1
            m = j
            while m < len(sb) and sb[m][0] < e:
                links.append((i, sb[m][2]))
                m += 1
        cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, x, y = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while x < len(sa) and sa[x][1] <= cut:
                left.append(str(sa[x][2]))
                x += 1
            while y < len(sb) and sb[y][1] <= cut:
                right.append(str(sb[y][2]))
                y += 1
            groups.append(f"{','.join(left)}|{','.join(right)}")
        for p in links:
            held[p].add(k)
        found.append((doc, sa, sb, links, ";".join(groups)))
    count = {p: len(d) for p, d in held.items()}
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return sorted(
        (
            doc,
            len(sa),
            len(sb),
            groups.count(";") + bool(groups),
            len(links),
            sum(count[p] == best[p[0]] for p in links),
            sum(count[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for doc, sa, sb, links, groups in found
    ), count


def random_texts(n):
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "▁", "ﬁ", "é", "é", "日本", "😀", "'s", "12", "<s>", "</s>"]
    odd += ["<|endoftext|>", "<0x0A>", "\x00", "a", "Hello", "world", ".", "...", "ß", "​", "﻿", "Ünï", "don't", "_x_", "̀", ""]
    return ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*[x.split()[0] for x in ta.ALIGNED.split(", ")]).collect())


@pytest.mark.parametrize("most_pairs", [ta.MOST_PAIRS, 0])
def test_equal_to_brute_force_on_odd_texts(spark, most_pairs):
    texts = random_texts(1500) + ["", " ", "a", "same text twice", "same text twice", "x" * 3000, "ab " * 2000]
    rows = list(enumerate(texts)) + [(1, "same id"), (9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "docs": F.lit("x"), "row": F.lit(2)})
    want, count = brute(rows)
    out, counts = ta.align(docs, most_pairs=most_pairs)
    assert rows_of(out) == want
    assert {(r.a, r.b): r.docs for r in counts.collect()} == count


@pytest.mark.parametrize("name", ["PART_CHARS", "CACHE_CHARS"])
def test_small_parts_and_tables(monkeypatch, name):
    """Cut texts and tables started anew give what large ones give."""
    texts = random_texts(300)
    table = ta.SegmentTable(PATHS)
    want = [(ta._described(table, n := table.look_up(t)), sorted(table.links(n).tolist())) for t in texts]
    monkeypatch.setattr(ta, name, 10)
    table = ta.SegmentTable(PATHS)
    for t, w in zip(texts, want):
        n = table.look_up(t)
        assert (ta._described(table, n), sorted(table.links(n).tolist())) == w
        if table.chars > ta.CACHE_CHARS:
            table.reset()


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in ta.align(docs)[0].collect()] == [None, None]
    for most in (ta.MOST_PAIRS, 0):
        out, counts = ta.align(docs.limit(0), most_pairs=most)
        assert out.count() == counts.count() == 0


def test_identity_map():
    known = ta.tokenizers(PATHS)
    same = [(i, j) for i, j in enumerate(known.identity.tolist()) if j >= 0]
    assert len(same) > 10_000 and all(known.bytes_a[i] == known.bytes_b[j] for i, j in same)


def test_query_equals_brute_force(spark):
    from cellweave.llm.queries import QUERIES

    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_token_alignment"](spark, SF)) == brute(rows)[0]
