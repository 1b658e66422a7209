"""Edge cases of the corpus operators, and comparisons with brute force on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import chat_format, decontaminate, html_extract, language_id, ngram_join, packing
from cellweave.llm import quality_model, quality_rules, sharding, suffix_dedup
from cellweave.llm.components import components, local_roots
from cellweave.llm.common import documents
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"id": F.lit("x"), "slot_": F.lit(1), "marks": F.lit(2)}) if extra else df


WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", " \n", "é" * 70, "a" * 500, "%%% !!!", "one two three", "one two three", " ".join(WORDS[:60]), " ".join(WORDS[:60])]


@pytest.mark.parametrize("name", ["op3_chat_format", "op8_quality_rules", "op9_decontamination"])
def test_equal_to_sql(spark, name):
    from cellweave.llm.queries import ORACLE_SQL, QUERIES

    assert differences(spark, views(SF), name, QUERIES[name], ORACLE_SQL[name], SF) == ""


# ---- 1 ----


def test_main_text():
    page = (
        "<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; line</h1><p>First  para,\n with <b>bold</b> text."
        "<p>Second&nbsp;para. It is long enough, is it not?<br>Yes.</article><section id=comments><p>Nice, I agree!</p></section>"
        "<footer>&copy; me</footer><!-- never"
    )
    assert html_extract.main_text(page) == (
        "Head & line\nFirst para, with bold text.\nSecond para. It is long enough, is it not? Yes."
    )
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x") == ""
    assert html_extract.main_text("just text, no tags") == "just text, no tags"


def test_text_is_chosen_by_path():
    said = "This sentence, like the others, has some words and marks in it; is it not so? "
    two = f"<body><article><p>{said * 6}</p></article><article><p>{said * 4}</p></article></body>"
    assert html_extract.main_text(two) == f"{said.strip() + (' ' + said.strip()) * 5}\n{said.strip() + (' ' + said.strip()) * 3}"
    body = f"<div class=text>{f'<p>{said * 5}</p>' * 30}</div>"
    split = html_extract.main_text(f"<body><div><h1>Head line</h1><p>A short lead, as is usual.</p>{body}</div></body>").split("\n")
    assert split[:2] == ["Head line", "A short lead, as is usual."] and len(split) == 32
    links = "<div><ul>" + "<li><a href=/x>Home</a></li>" * 9 + "</ul></div>"
    marked = html_extract.main_text(f"<body><article><h1>Head</h1>{links}<p>{said}</p>{links}<p>{said}</p><h2>More</h2>{links}</article>")
    assert html_extract.main_text("<h1>Alone</h1>") == "Alone"
    assert marked.count("Home") <= 4 and marked.startswith("Head\n") and "More" not in marked and marked.count("marks") == 2


def test_ratios_decide(monkeypatch):
    """No element or class tells these blocks apart, and a constant ratio keeps them all."""
    said = "This sentence, like the others, has some words and marks in it; is it not so? "
    page = f"<body><div><span>Home</span></div><div><span>About</span></div>{f'<div><p>{said * 3}</p></div>' * 8}</body>"
    left = html_extract.main_text(page)
    assert "Home" not in left and left.count("is it not so?") == 24
    monkeypatch.setattr(html_extract, "CONTENT_SHARE", 0.0)
    assert "Home" in html_extract.main_text(page)


@pytest.mark.parametrize("piece", ["<a ", "<span>a", "<a '", '<a "x', "<b><div></b>", "<!--", "</i>", "<![CDATA[", "<p>a b. ", "<ul><li>x"])
def test_long_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    html_extract.main_text(piece * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - began < 40


def test_article_text_is_kept():
    said = "This sentence, like the others, has some words and marks in it; is it not so? "
    items = "<ul><li>Milk</li><li>Eggs</li><li>Flour</li></ul>"
    page = f"<article><h1>Cake</h1><p>{said * 8}</p>{items}<p>{said * 8}</p></article>"
    assert html_extract.main_text(page).split("\n")[2:5] == ["Milk", "Eggs", "Flour"]
    assert html_extract.main_text("<p><i a=b' >w0</i>, <i a=b' >w1</i></p>") == "w0, w1"
    assert html_extract.main_text("<p><i a=\"x>y\" b='>'>w0</i> <i a\"b>w1</i> <i c=\"d>w2</i></p>") == "w0 w1 w2"
    assert html_extract.main_text("<p>" + "<i a=\"x'>w</i>" * 40 + "<i b='\">v</i></p>").count("w") == 40 // 2
    for name in ("related-work", "share price", "notice-period", "social-network"):
        inside = f"<article><p>{said * 3}</p><div class='related-work'><p>{said}</p></div><p class='{name}'>{said}</p></article>"
        assert html_extract.main_text(inside).count("is it not so?") == 5
    for name in ("related", "share-buttons", "ad sticky", "sidebar_left", "comments-area", "ad-1"):
        assert html_extract.main_text(f"<article><p>{said * 3}</p><div class='{name}'><p>{said}</p></div></article>").count("so?") == 3


def test_deep_elements_stay_left_out():
    said = "This sentence, like the others, has some words and marks in it. "
    depth = html_extract.MOST_DEPTH
    for n in (depth - 3, depth - 2, depth - 1, depth, depth + 5):
        deep = "<span>" * n + "<nav><a>Home, and more.</a> <nav>or, all.</nav> <a>About, us.</a></nav>" + f"<b>{said}</b>" + "</span>" * n
        got = html_extract.main_text(f"<div>{deep}<p>{said}</p></div>")
        assert got.count("marks") == 2 and "Home" not in got and "About" not in got and "all" not in got


def test_pages_query(spark):
    rows = [(1, "u", None), (2, None, "<p>a</p>"), (2, None, "<p>a</p>")]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "", 0), (2, "a", 1), (2, "a", 1)]


# ---- 2 ----


def test_quality_model_learns(spark):
    good = [("plain words of a clean text number %d" % i, 1) for i in range(60)]
    bad = [("$$$ ### junk%d *** !!" % i, 0) for i in range(60)]
    model = quality_model.fit(good + bad)
    s = model.score(["other plain words of a text", "junk *** $$$ !!", "", None])
    assert s[0] > 0.5 > s[1] and 0 <= s[2] <= 1 and s[2] == s[3]
    assert quality_model.fit([]).score(["x"])[0] == 0.5
    assert quality_model.score_documents(docs_of(spark, []), model).count() == 0


def test_quality_training_rows(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(500)] + [(None, "x"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = quality_model.training_rows(docs.withColumn("quality", F.lit(7)), labels.withColumn("text", F.lit("t")))
    assert sorted(got) == sorted([("text 0", 0), ("text 1", 1), ("text 102", 0), ("text 103", 0), ("text 104", 0)])


def test_quality_scores_equal_the_mean_of_vectors():
    model = quality_model.fit([("good words here", 1), ("bad words there", 0)] * 20)
    texts = ["good words here", "bad", None, "x y z", "good good good words"]
    for t, s in zip(texts, model.score(texts)):
        ids, _ = quality_model.bucket_ids([t])
        z = model.bias + (np.mean(model.weight[ids]) if len(ids) else 0)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6


def test_quality_of_a_text_in_parts():
    rng = np.random.default_rng(5)
    model = quality_model.Model(rng.normal(0, 1, quality_model.BUCKETS).astype(np.float32), 0.1)
    text = " ".join(rng.choice(WORDS, 4000))
    parts = [text[a:b] for a, b in quality_model.parts.__globals__["cuts"](text, 900)]
    assert "".join(parts) == text and len(parts) > 20 and all(p.endswith(" ") for p in parts[:-1])
    ids = [quality_model.bucket_ids([p])[0] for p in parts]
    mean = np.concatenate([model.weight[i] for i in ids]).mean(dtype=np.float64)
    got = model.score([None, text, "a b", text], 900)
    assert np.allclose(got[[1, 3]], 1 / (1 + np.exp(-(mean + 0.1)))) and np.allclose(got[[0, 2]], model.score([None, "a b"]))
    assert abs(got[1] - model.score([text])[0]) < 0.02


def test_quality_without_labels(spark):
    empty = documents(spark, SF, "labels").limit(0)
    model = quality_model.train(documents(spark, SF), empty)
    assert {r.score for r in quality_model.score_documents(docs_of(spark, ODD), model).collect()} == {0.5}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_model.op2_quality_classifier(spark, sf).join(documents(spark, sf, "labels"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


# ---- 3 ----


def test_chat_round_trip(spark):
    odd = ["a\\b<|end|>", "<|", None, "", "</s>[INST] x [/INST]", "\\<\\|turn|>", "<<||>|"]
    rows = [(7, i // 2, r, t) for i, (t, r) in enumerate(zip(odd, "user user assistant assistant user assistant assistant".split()))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.read_back(chat_format.format_conversations(df)).first()
    expected = sorted((t, r or "", x or "") for _, t, r, x in rows)
    assert [(t.role, t.text) for t in out.turns] == [(r, x) for _, r, x in expected]
    assert out.loss_text == "".join(x for _, r, x in expected if r == "assistant")
    for mark in ("</s>", "[INST]", "[/INST]"):
        assert mark not in out.formatted


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    out = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], schema)))
    assert out.count() == 0
    rows = [(None, None, None, None), (None, 1, "assistant", "é<|"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    for r in got.values():
        for s in r.loss_spans:
            cut = r.formatted.encode()[s.byte_start : s.byte_start + s.byte_length].decode()
            assert cut == r.formatted[s.start : s.start + s.length] and cut in ("é<\\|", "a")
    assert len(got[3].loss_spans) == 2 and len(got[None].loss_spans) == 1


def test_long_conversation_is_linear(spark):
    turns = spark.range(100_000).select(
        F.lit(5).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text of turn "), F.col("id").cast("string")).alias("text"),
    )
    out = chat_format.read_back(chat_format.format_conversations(turns)).first()
    said = [f"text of turn {i}" for i in range(100_000)]
    assert [t.text for t in out.turns] == said
    assert out.loss_text == "".join(t for i, t in enumerate(said) if i % 3)


# ---- 4 ----


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "don't <|endoftext|> İΣΑΣ x́ a b\x1cc\r\nq ABC'S it's,, 12,3.4. 中文", " ".join(WORDS) * 9]
    out = packing.pack(docs_of(spark, texts, True).coalesce(1), shard_tokens=4000).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        pieces = sorted((r.start, np.frombuffer(r.ids, "<u4")) for r in out if r.doc_id == i)
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.concatenate([p for _, p in pieces]).tolist() == ids
    lengths = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert lengths.get(r.sequence_id, 0) == r.offset
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_marks_after_any_letter():
    """Ids of chunks of a letter and a mark are the tokenizer's, for all letters but the inner ones of the largest blocks."""
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    letters = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]
    letters = [c for c in letters if not 0x4E10 < ord(c) < 0x9F00 and not 0xAC10 < ord(c) < 0xD780 and not 0x17000 < ord(c) < 0x31400]
    words = [c + mark for c in letters for mark in ("", ".", ",")] + ["İKİ,", "SİVRİ.", "x" + "y" * 90 + "."]
    texts = [*(" ".join(words[i : i + 60]) for i in range(0, len(words), 60)), "<|ENDOFTEXT|>, <|endoftext|>. <|EndOfText|>x", ". , .. ,."]
    encoder, tokenizer = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for _ in range(2):  # the second time from the cache
        for i in range(0, len(texts), 128):
            some = texts[i : i + 128]
            got = encoder.encode(packing.Chunks(pa.array(some), encoder.as_is))
            for t, ids in zip(some, got):
                assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_name_table_finds_what_was_added():
    from cellweave.llm.textscan import NameTable

    rng, table, added = np.random.default_rng(2), NameTable(4), []
    names = np.unique(rng.integers(1, 1 << 20, 5000)).astype(np.uint64)  # low bits collide
    rng.shuffle(names)
    for part in np.split(names, [3, 50, 51, 900]):
        assert (table.find(part) == -1).all()
        table.add(part)
        added += part.tolist()
        assert table.find(np.array(added, np.uint64)).tolist() == list(range(len(added)))


def documents_of(terms):
    return [np.unique(t, return_counts=True) for t in terms]


def brute_bm25(terms, seed):
    n, mean = len(terms), np.mean([len(t) for t in terms])
    out = np.zeros(n)
    for t in set(terms[seed].tolist()):
        df = sum(t in d for d in terms)
        for k, d in enumerate(terms):
            tf = int((d == t).sum())
            if tf and df > 1:
                out[k] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return out


def test_scores_are_bm25():
    rng = np.random.default_rng(8)
    terms = [rng.zipf(1.4, rng.integers(1, 80)) % 500 for _ in range(60)]
    index = packing.Index(documents_of(terms))
    for seed in range(60):
        expected = brute_bm25(terms, seed)
        assert np.allclose(index.scores(seed)[index.entry], expected, rtol=1e-4, atol=1e-5)
        got = list(packing.Index(documents_of(terms)).neighbours(seed, np.arange(60) == seed))
        assert sorted(got) == [k for k in range(60) if expected[k] > 0 and k != seed]
        assert (np.diff(expected[got]) < 1e-4).all()


def test_neighbours_are_packed_together():
    a, b = np.arange(30), np.arange(100, 130)
    terms = [a, b, np.arange(200, 230), np.arange(300, 330), a.copy(), b.copy(), *[np.arange(k, k + 9) for k in range(400, 600, 10)]]
    order = packing.pack_order(np.full(len(terms), 50), documents_of(terms), 64)
    assert sorted(order) == list(range(len(terms)))
    assert abs(order.index(0) - order.index(4)) == 1 and abs(order.index(1) - order.index(5)) == 1


def test_common_and_light_terms_find_neighbours():
    own = [np.arange(100 + 40 * k, 130 + 40 * k) for k in range(6)]
    common = [np.concatenate([x, np.arange(9)]) if k in (0, 5) else x for k, x in enumerate(own)]
    order = packing.pack_order(np.full(6, 50), documents_of(common), 100)
    assert order[:2] == [0, 5]  # terms that a third of the documents have
    copies = [np.arange(9)] * 4
    index = packing.Index(documents_of([*copies, np.arange(500, 520), np.arange(500, 520)]))
    assert index.size == 2 and list(index.neighbours(0, np.array([True] + [False] * 5))) == [1, 2, 3]
    long = np.arange(1000, 1060)
    pairs = [np.concatenate([long[k : k + 1]] * 2) for k in range(60)]  # each has one term of the long seed
    assert sorted(packing.Index(documents_of([long, *pairs])).neighbours(0, np.zeros(61, bool))) == list(range(61))


def test_frequencies_and_shards_are_of_all_documents(spark):
    texts = [f"Apple, pear{k} tree." for k in range(40)] + [None, "rare words here", "rare words there"]
    docs = docs_of(spark, texts).repartition(7)
    known = packing.frequencies(docs)
    at = lambda *t: known(np.array([packing.term_name(x) for x in t])).tolist()
    assert known.n == 43 and at("apple", "rare", "tree", "here", "pear3") == [40, 2, 40, 0, 0]
    n = 64
    far = [f"alpha{k % n} beta{k % n} gamma{k % n} own{k}" for k in range(2 * n)]  # partners lie in different partitions
    two = docs_of(spark, far).repartitionByRange(2, "doc_id")
    rows = sorted(packing.pack(two, window=16).collect(), key=lambda r: (r.sequence_id, r.offset))
    placed = list(dict.fromkeys(r.doc_id for r in rows))
    assert sorted(placed) == list(range(2 * n))
    assert sum(abs(placed.index(k) - placed.index(k + n)) == 1 for k in range(n)) > 0.9 * n


@pytest.mark.parametrize("most", [0, 60, 150])
def test_packing_does_not_depend_on_the_terms_that_are_broadcast(spark, most):
    """The weightiest and the neighbours are those of all documents, wherever the frequencies come from."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(3, 60)) % 400) for _ in range(120)]
    docs = docs_of(spark, [*texts, None, "", texts[3], texts[3]]).repartition(5)
    docs = docs.unionByName(docs.filter("doc_id = 3"))  # a repeated row
    at = lambda m: sorted(map(tuple, packing.pack(docs, window=64, shard_tokens=1500, most_terms=m).collect()))
    known = packing.frequencies(docs, most)
    assert len(known.terms) <= most < len(packing.frequencies(docs).terms)
    assert at(most) == at(packing.MOST_TERMS)


# ---- 5 ----


def brute_classes(texts):
    sets = []
    for t in texts:
        w = [x for x in "".join(c if ord(c) > 32 else " " for c in (t or "").lower()).split(" ") if x]
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, links


def test_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice(WORDS, 120).tolist() for _ in range(4)]
    texts = list(ODD)
    for b in base:
        for k in range(12):
            w = list(b)
            for at in rng.integers(0, 120, k // 2):
                w[at] = "x%d" % rng.integers(1000)
            texts.append(" ".join(w))
    root, links = brute_classes(texts)
    out = {r.doc_id: r for r in ngram_join.similar_classes(docs_of(spark, texts, True)).collect()}
    assert [out[i].class_id for i in range(len(texts))] == root
    assert [out[i].n_links for i in range(len(texts))] == links
    kept = ngram_join.keep_one(docs_of(spark, texts, True))
    assert kept.columns == docs_of(spark, [], True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_join_of_a_large_class_counts_all_links(spark, monkeypatch):
    """Some thousand near copies in blocks, against the sizes of intersections of their sets."""
    rng = np.random.default_rng(6)
    base = rng.choice(WORDS, 300)
    texts = []
    for k in range(1500):
        w = base.copy()
        at = rng.choice(300, int(rng.integers(0, 9)), replace=False)
        w[at] = [f"y{x}" for x in rng.integers(0, 40, len(at))]
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 400)
    out = {r.doc_id: r for r in ngram_join.similar_classes(docs_of(spark, texts)).collect()}
    sets = [np.unique([hash(tuple(t.split()[i : i + 5])) for i in range(296)]) for t in texts]
    grid = np.zeros((1500, 1 + max(np.unique(np.concatenate(sets), return_inverse=True)[1])), np.float32)
    names = {n: i for i, n in enumerate(np.unique(np.concatenate(sets)).tolist())}
    for k, x in enumerate(sets):
        grid[k, [names[n] for n in x.tolist()]] = 1
    both, size = grid @ grid.T, grid.sum(1)
    linked = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-6
    assert [out[i].n_links for i in range(1500)] == (linked.sum(1) - 1).tolist()
    assert [out[i].class_id for i in range(1500)] == local_roots(*np.nonzero(linked), 1500).tolist()


def test_join_with_repeated_and_null_ids(spark):
    a, b = " ".join(WORDS[:80]), " ".join(WORDS[100:180])
    rows = [(5, a), (5, a), (5, b), (3, a + " more"), (None, a), (None, b + " end"), (None, "alone in here"), (8, None), (8, None), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "hash": F.lit("h")})
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.n_links) for r in ngram_join.similar_classes(docs).collect()))
    assert got == sorted([(5, 3, 3), (5, 3, 3), (5, 5, 2), (3, 3, 3), (-1, 3, 3), (-1, 5, 2), (-1, -1, 0), (8, 8, 0), (8, 8, 0), (9, 5, 2)])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert left == sorted([(3, a + " more"), (5, b), (-1, "alone in here"), (8, ""), (8, "")])


def test_pruning_by_steps_equals_whole_rows():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 3, (60, ngram_join.CODES)).astype(np.uint8)
    codes[30:] = np.where(rng.random((30, ngram_join.CODES)) < 0.12, codes[30:], codes[:30])
    left, right = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    band = rng.integers(0, 6, len(left))
    same = codes[left] == codes[right]
    expected = same.reshape(-1, ngram_join.BANDS, ngram_join.ROWS).all(2).argmax(1) == band
    for n, least in zip(ngram_join.STEPS, ngram_join.least_matches()):
        expected &= same[:, :n].sum(1) >= least
    expected &= same.reshape(-1, ngram_join.BANDS, ngram_join.ROWS).all(2)[np.arange(len(left)), band]
    met = same.reshape(-1, ngram_join.BANDS, ngram_join.ROWS).all(2)[np.arange(len(left)), band]
    assert (ngram_join.prune(codes, left, right, band)[met] == expected[met]).all() and expected.any()


def test_join_of_nothing(spark):
    assert ngram_join.similar_classes(docs_of(spark, [])).count() == 0
    assert ngram_join.similar_classes(docs_of(spark, ["a b", None])).filter("class_id <> doc_id").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in components(edges).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100


# ---- 6 ----


def brute_removed(texts):
    first, out = {}, []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in first:
                gone[k : k + 50] = True
        for w in own:
            first.setdefault(w, 1)
        out.append((b, gone))
    return out


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    p = " ".join(rng.choice(WORDS, 80))
    texts = [*ODD, *[f"{' '.join(rng.choice(WORDS, 30))} {p[k : k + 60 + 9 * k]} {' '.join(rng.choice(WORDS, 30))}" for k in range(20)]]
    texts += ["ab " * 100, "ab " * 90, "é" * 71, p[:49], p[:50], p]
    out = {r.doc_id: r for r in suffix_dedup.dedup_digest(docs_of(spark, texts, True)).collect()}
    for i, (b, gone) in enumerate(brute_removed(texts)):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (out[i].n_bytes, out[i].n_removed, out[i].kept_sha256) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest()), i
    left = suffix_dedup.remove_repeats(docs_of(spark, texts, True))
    assert left.columns == docs_of(spark, [], True).columns
    assert {r.doc_id for r in left.collect()} >= {0, 1, 2, 8} and left.filter("doc_id = 9").count() == 0
    assert suffix_dedup.dedup_digest(docs_of(spark, [])).count() == 0


def test_repeats_with_hot_lines_and_equal_ids(spark):
    """A line in every document, and ids that repeat with equal and different texts; map tasks combine now and then."""
    rng = np.random.default_rng(12)
    line = "this very common line stands in every one of all documents, word for word."
    rows = []
    for k in range(160):
        own = [" ".join(rng.choice(WORDS, int(rng.integers(1, 25)))) for _ in range(2)]
        rows.append((int(rng.integers(0, 60)) if k % 3 else 1000 + k, f"{own[0]} {line} {own[1]}"))
    rows += [rows[5], (None, line), (None, rows[0][1]), (rows[0][0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).repartition(3)
    key = lambda d: (1 << 63) if d is None else d
    strings = [{(t or "").encode()[k : k + 50] for k in range(len((t or "").encode()) - 49)} for _, t in rows]
    expected = []
    for d, t in rows:
        b = (t or "").encode()
        smaller = set().union(*(s for s, (e, _) in zip(strings, rows) if key(e) < key(d)))
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in smaller:
                gone[k : k + 50] = True
        expected.append((str(d), len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    for steps in (suffix_dedup.STEP_ROWS, 60):
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup_digest(docs, steps).collect()]
        assert sorted(got) == sorted(expected)
    assert suffix_dedup.remove_repeats(docs).columns == ["doc_id", "text", "hash"]


def test_map_tasks_send_little_of_a_shared_passage():
    n = 5000
    ranks = np.full(n, (77 << 24) | (5 << 12) | 7)
    sent, _, _ = suffix_dedup.combine_ranks(ranks, np.arange(n) + 10, np.arange(n))  # different stretches around one passage
    assert (sent >= 0).sum() <= 4 and (sent == -2).sum() >= n - 4
    sent, _, docs = suffix_dedup.combine_ranks(ranks, np.full(n, 9), np.arange(n)[::-1].copy())  # one stretch
    assert (sent >= 0).sum() == 1 and docs[sent >= 0] == [0] and (sent == -1).sum() == n - 1
    one, two = np.full(n, 3), np.full(n, 4)
    out = suffix_dedup.combine_strings(one, two, np.arange(n), np.arange(n))
    assert (out[3] >= 0).sum() == 1 and len(set(zip(out[0].tolist(), out[1].tolist()))) == n


# ---- 7 ----


def test_language_model():
    a = [("the cat sat on the mat and the dog was there with them", "en")] * 20
    b = [("der hund und die katze sind nicht in dem haus mit uns", "de")] * 20
    model = language_id.fit(a + b)
    names, scores = model.predict(["the dog and the cat", "die katze und der hund", None, "", "123 !!"])
    assert names == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for s in scores) and scores[2] == 0
    tags = model.tag("the cat sat on the mat und die katze sind nicht in dem haus")
    assert tags[1][1] == "en" and tags[-1][1] == "de"
    assert language_id.fit([]).predict(["x"])[0] == ["und"]


def brute_posteriors(e, m, f):
    import itertools

    weight, gamma = 0.0, np.zeros_like(e)
    for y in itertools.product(range(e.shape[1]), repeat=len(e)):
        w = np.exp(f[y[0]] + sum(e[t, y[t]] for t in range(len(e))) + sum(m[y[t], y[t + 1]] for t in range(len(e) - 1)))
        weight += w
        for t in range(len(e)):
            gamma[t, y[t]] += w
    return gamma / weight


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    m, f = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [4, 0, 1, 6, 4, 0]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    e = rng.normal(size=(bounds[-1], 3)) * 3
    got = language_id.chain_posteriors(e, bounds, m, f)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            expected = brute_posteriors(e[a:b], m, f)
            assert np.allclose(got[a:b], expected)
            assert np.allclose(language_id.forward_backward(e[None, a:b], m, f)[0][0], expected)
    long = rng.normal(size=(5000, 3))
    both = language_id.chain_posteriors(np.concatenate([long, long[:10]]), np.array([0, 5000, 5010]), m, f)
    assert np.allclose(both[:5000], language_id.forward_backward(long[None], m, f)[0][0])


def test_text_without_letter_is_unknown(spark):
    model = language_id.fit([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 9)
    names, scores = model.predict(["\u2764\ufe0f", "\u260e\ufe0f 12", "\u0301", "e\u0301", "the \u0301"])
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and names[3] != "und" and names[4] == "en"


def test_many_languages_and_repeated_ids(spark):
    rows = [(i, f"wort{i % 300} satz{i % 300} text{i % 300}", f"l{i % 300}") for i in range(900)]
    rows += [(7, f"again and again {k % 3}", "l7") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_passages(docs, passages=2)
    assert len({lang for _, lang in got}) == 300 and len(got) <= 600
    assert sum("again" in t for t, _ in got) <= 1
    model = language_id.fit(got, epochs=1)
    assert model.grams.shape == (3, 300, language_id.buckets_of(300)) and model.grams.size <= 3 * language_id.TABLE
    assert model.predict(["wort299 satz299"])[0][0] in model.languages


def test_long_texts_are_read_in_parts():
    model = language_id.fit([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et la souris", "fr")] * 9)
    rng = np.random.default_rng(3)
    model.moves[:] = rng.normal(0, 1, model.moves.shape)
    model.first[:] = rng.normal(0, 1, 3)
    pool = "the cat der hund le chat mat katze souris x7 --".split()
    texts = [" ".join(rng.choice(pool, n)) for n in (1, 5, 400, 3000)] + ["123 " * 200, "a" * 300 + " the cat", "-- " * 90 + "le chat"]
    for t in texts:
        codes, starts, ends, bounds = language_id.word_grid([t])
        whole = language_id.segment_sums(model.posteriors(model.emissions(codes, starts, ends), bounds), bounds)[0]
        for part in (40, 333, 1 << 20):
            got, n = model.long_sums(t, part)
            if "a" * 300 in t and part < 300:
                continue  # a word of more than a part
            assert n == len(starts) and np.allclose(got, whole, atol=1e-6)
    a, b = model.predict(texts), model.predict(texts, 64)
    assert a[0][:5] == b[0][:5] and np.allclose(a[1][:5], b[1][:5], atol=1e-6) and a[0][4] == "und"


MEMORY = """
import resource, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
import numpy as np
from cellweave.llm import language_id, quality_model
from cellweave.llm.textscan import blocks, letter_table
text = pa.array(["word of a long text, " * {n}, "short"])
model = language_id.fit([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 9)
scorer = quality_model.Model(np.ones(quality_model.BUCKETS, np.float32), 0.0)
letter_table()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {which} == 2:
    assert sum(len(scorer.score(some.to_pylist())) for some in blocks(text)) == 2
else:
    assert len(language_id.predict_column(model, text)[0]) == 2
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("which", [2, 7])
def test_one_long_text_has_bounded_memory(which):
    """60 MB of text take less than 1 GB beside the text's own copies."""
    import subprocess
    import sys
    from pathlib import Path

    code = MEMORY.format(root=str(Path(__file__).resolve().parents[2]), n=60_000_000 // 21, which=which)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True)
    assert int(out.stdout.split()[-1]) < 1000


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.op7_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


# ---- 8 ----


def test_rules_on_odd_texts(spark):
    texts = [*ODD, "\n".join(["same line here"] * 40), " ".join(WORDS[:200])]
    out = {r.doc_id: r for r in quality_rules.score_documents(docs_of(spark, texts, True)).collect()}
    assert out[0].n_words == 0 and out[0].base_failed and not out[0].kept
    assert out[10].n_dup_lines == 39 and out[10].base_failed
    assert out[11].n_repeat_words == 0 and out[11].kept
    assert quality_rules.score_documents(docs_of(spark, [])).count() == 0
    nulls = docs_of(spark, [" ".join(WORDS[:80])]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert quality_rules.filter_documents(nulls).count() == 1
    good, bad = " ".join(WORDS[:80]), "same words again " * 60
    rows = [(None, good), (None, bad), (4, good), (4, good), (4, bad), (5, None)]
    mixed = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "kept": F.lit(1)})
    left = quality_rules.filter_documents(mixed)
    assert left.columns == mixed.columns and sorted(str(r.doc_id) for r in left.collect()) == ["4", "4", "None"]


# ---- 9 ----


def test_slices_agree(spark):
    bench = spark.createDataFrame(
        [(1, " ".join(WORDS[:15])), (2, "One, TWO three"), (3, None), (2, " ".join(WORDS[30:40]))], "item_id long, text string"
    )
    docs = docs_of(spark, [*ODD, "x " + " ".join(WORDS[5:15]) + " y"], True)
    a = {r.doc_id: tuple(r) for r in decontaminate.scan_documents(docs, bench).collect()}
    b = {r.doc_id: tuple(r) for r in decontaminate.scan_documents(docs, bench, slice_bytes=40).collect()}
    assert a == b and a[6][3] == ["2"] and a[10][3] == ["1"] and a[10][2] == list(range(1, 11))
    assert decontaminate.clean(docs, bench).filter("doc_id in (6, 7, 8, 9, 10)").count() == 0
    cut = decontaminate.clean(docs, bench, "spans").filter("doc_id = 10").first()
    assert cut.text.split() == ["x", "y"]
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_slices_keep_rows(spark):
    bench = spark.createDataFrame([(k, " ".join(WORDS[20 * k : 20 * k + 12])) for k in range(6)], "item_id long, text string")
    a, b = " ".join(WORDS[:12]), "x y " + " ".join(WORDS[100:112])
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (None, None), (2, f"{a} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(repr, decontaminate.scan_documents(docs, bench, slice_bytes=n).collect())) for n in (60, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def brute_windows(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text or "").split()


def test_scan_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [f"Q{i % 23}é" if i % 5 else f"w{i % 7}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(pool, n))
    items = [(k % 9, make(int(n))) for k, n in enumerate([*rng.integers(1, 14, 40), 0])] + [(None, "Q1é w1 lone"), (50, None)]
    texts = [*ODD, *[f"{make(20)}, {rng.choice([t for _, t in items if t])}. {make(9)}" for _ in range(30)], "lone Q1é w1 lone"]
    tests = spark.createDataFrame(items, "item_id long, text string")
    for size in (100, 1 << 20):
        out = {r.doc_id: r for r in decontaminate.scan_documents(docs_of(spark, texts, True), tests, slice_bytes=size).collect()}
        for i, t in enumerate(texts):
            said, hits, who = brute_windows(t), set(), set()
            for item, text in items:
                w = brute_windows(text)
                n = min(10, len(w))
                for k in range(len(w) - n + 1 if w else 0):
                    for at in range(len(said) - n + 1):
                        if said[at : at + n] == w[k : k + n]:
                            hits.update(range(at, at + n))
                            who |= {str(item)} if item is not None else set()
            assert (out[i].n_words, out[i].hits, out[i].items) == (len(said), sorted(hits), sorted(who))


def test_equal_tests_are_one_and_slices_hold_what_they_may(spark):
    long = " ".join(WORDS[:80])
    rows = [(1, " ".join(WORDS[:12]))] * 500 + [(k, f"{WORDS[k]} x{k} y") for k in range(200)] + [(7, long), (8, None), (9, "")]
    tests = spark.createDataFrame(rows, "item_id long, text string")
    slices = list(decontaminate._slices(tests, 300, 10))
    assert sum(len(s.names) for s in slices) == 202
    assert all(len(s.names) == 1 or len(s.ids) < 100 for s in slices) and len(slices) > 5
    assert [len(s.names) for s in decontaminate._slices(tests.limit(0), 300, 10)] == [0]
    plan = decontaminate.scan_documents(docs_of(spark, ODD), tests, slice_bytes=600)._jdf.queryExecution().toString()
    branch = plan[plan.index("Union") :].split("== Analyzed")[0]
    assert branch.count("MapInArrow") == branch.count("Relation")  # each branch has one set


def test_window_set_is_bounded():
    import pickle

    text = " ".join(f"word{i % 5000} of item {i}" for i in range(40_000))
    assert len(pickle.dumps(decontaminate.WindowSet([(1, text)]))) < 20 * len(text)


# ---- 10 ----


def test_table_is_even_and_stable(spark):
    names = sharding.shard_names(16)
    table = sharding.fill_table(names, 4099)
    share = np.bincount(table)
    assert share.max() - share.min() <= 1
    fewer = sharding.fill_table(names[:-1], 4099)
    moved = (fewer != table) & (table != 15)
    assert moved.mean() < 0.1
    # Brute force of the turns.
    taken, walks = {}, []
    for n in names:
        d = hashlib.blake2b(n.encode(), digest_size=16).digest()
        off, skip = int.from_bytes(d[:8], "little") % 4099, int.from_bytes(d[8:], "little") % 4098 + 1
        walks.append(iter([(off + j * skip) % 4099 for j in range(4099)]))
    while len(taken) < 4099:
        for k, w in enumerate(walks):
            slot = next((s for s in w if s not in taken), None)
            if slot is not None:
                taken[slot] = k
    assert [taken[s] for s in range(4099)] == table.tolist()
    df = spark.createDataFrame([(None,), (1,), (1,)], "doc_id long")
    out = sharding.assign_shards(df, "doc_id", names, 4099).collect()
    assert len(out) == 3 and len({r.shard for r in out if r.doc_id == 1}) == 1
    with pytest.raises(ValueError):
        sharding.assign_shards(df.withColumn("slot", F.lit(1)), "doc_id", names)


def test_names_of_columns_do_not_meet(spark):
    names = ["ID", "__id", "kept_id", "kept_hash", "__hash", "hash", "key", "__key", "_0", "settled", "starts", "doc", "row", "n"]
    texts = [" ".join(WORDS[:60]), " ".join(WORDS[:60]), "x " + " ".join(WORDS[100:160]), None]
    docs = docs_of(spark, texts).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for run in (ngram_join.keep_one, suffix_dedup.remove_repeats, quality_rules.filter_documents):
        got = run(docs)
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    both = suffix_dedup.remove_repeats(docs.withColumnRenamed("n", "id")).collect()
    assert sorted((r[0], r["ID"], r["id"]) for r in both) == [(i, f"ID{i}", f"n{i}") for i in (0, 2, 3)]
    taken = docs.withColumns({"slot": F.lit(1), "Shard": F.lit(2), "key": F.lit(3)})
    placed = sharding.assign_shards(taken, "doc_id", sharding.shard_names(4), 101, ("at", "where"))
    plain = sharding.assign_shards(docs, "doc_id", sharding.shard_names(4), 101)
    assert placed.columns == [*taken.columns, "at", "where"]
    assert sorted((r.doc_id, r["at"], r["where"]) for r in placed.collect()) == sorted((r.doc_id, r.slot, r.shard) for r in plain.collect())


# ---- pipeline ----


def test_pipeline(spark):
    """Every stage on its own input, against brute force."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    inputs = []
    for name, stage in cp.STAGES[:-1]:
        inputs.append({r.doc_id: r.text for r in docs.collect()})
        docs = cp.materialise(stage(spark, docs, SF), "test")
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
    inputs.append({r.doc_id: r.text for r in docs.collect()})
    raw, known, single, cut, left = inputs
    assert all(any(c.isalpha() for c in raw[d] or "") for d in known)
    assert {d for d in raw if any(c.isalpha() for c in raw[d] or "")} >= set(known) and len(known) > 0.95 * len(raw)

    ids = sorted(known)
    root, _ = brute_classes([known[d] for d in ids])
    assert set(single) == {ids[r] for r in root}

    ids = sorted(single)
    for d, (b, gone) in zip(ids, brute_removed([single[d] for d in ids])):
        char = np.cumsum([(x & 0xC0) != 0x80 for x in b]) - 1
        bad = set(char[gone].tolist())
        rest = "".join(c for k, c in enumerate(single[d] or "") if k not in bad)
        assert cut.get(d, "") == rest

    tests = [brute_windows(r.text) for r in documents(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in tests if w for k in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    for d, t in cut.items():
        w = brute_windows(t)
        hit = any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
        assert (d in left) != hit

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = {}
    for r in sorted(cp.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert set(pieces) == set(left)
    assert all(pieces[d] == tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in left.items())
