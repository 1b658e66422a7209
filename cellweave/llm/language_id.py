"""Language identification by a linear-chain conditional random field over the words of a text.

Words are runs of letters and of the marks that combine with them, with a letter at least. A word's emission scores come from hashed character 2- to 4-grams that include the word's edges
(so its prefixes and suffixes of up to three letters are features) and from a learned lexicon: the languages for which the
word is characteristic in the training text. Transitions between the languages of neighbouring words are learned from
training chains in which passages of different languages are spliced, and forward-backward gives each word's posterior. A
document's language has the largest mean posterior over its words, and that mean is the score.

The recursion runs over the whole of every text, short ones side by side. A long text is read in parts, forwards and then
backwards, and what a part hands to the next is one vector; the chains are the same, unless a part has neither space nor line
break. Memory is that of a part. The model is fitted on the driver on at most ``TRAIN_PASSAGES`` passages (of at most
``TRAIN_CHARS`` characters, at hashed places) a language and about ``TRAIN_ALL`` in all, at least one for every language; of many
languages each has fewer buckets (``TABLE`` in all), so the tables of n-grams have a bounded size and no language is refused.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no training rows everything is ``und``;
repeated rows are judged alike; an empty table gives no row; other columns are ignored by the query and kept by
:func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, fold, small_batches
from cellweave.llm.textscan import PART, blocks, code_points, cuts, gram_hashes, letter_table, parts, run_hashes, runs, segment_sums

BUCKETS = 1 << 16
LEXICON = 1 << 18
TRAIN_PASSAGES = 240
TRAIN_CHARS = 3000
TRAIN_ALL = 48_000
#: Buckets of all languages together; up to 256 languages have ``BUCKETS`` each.
TABLE = BUCKETS << 8
UNKNOWN = "und"


def word_grid(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts (0 where there is no letter), the starts and ends of words, and each text's bounds in words."""
    parts, edges, at = [np.zeros(3, np.uint32)], [], 3
    for t in texts:
        c = code_points(t.lower()) if t else np.empty(0, np.uint32)
        edges.append(at)
        parts += [c, np.zeros(3, np.uint32)]
        at += len(c) + 3
    codes = np.concatenate(parts)
    kind = letter_table()[codes]
    codes = np.where(kind > 0, codes, np.uint32(0))
    starts, ends = runs(codes > 0)
    if len(starts) and (kind == 1).any():
        real = np.maximum.reduceat(kind, starts) == 2  # what follows a word's end, up to the next, is 0
        starts, ends = starts[real], ends[real]
    return codes, starts, ends, np.append(np.searchsorted(starts, edges), len(starts))


def gram_features(codes: np.ndarray, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the n-gram that starts one code before each position; index 0 is position 1 of ``codes``."""
    return (gram_hashes(codes, n, n) & np.uint32(buckets - 1)).astype(np.int64)


def buckets_of(n_languages: int) -> int:
    """Buckets of a language, a power of two."""
    return min(BUCKETS, max(1 << 8, 1 << (TABLE // max(n_languages, 1)).bit_length() - 1))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # (3, L, buckets)
    lexicon: np.ndarray  # (LEXICON,) 0 or 1 + language
    lexical: np.ndarray  # (1 + L, L)
    moves: np.ndarray  # (L, L)
    first: np.ndarray  # (L,)

    def emissions(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        score = np.zeros((len(starts), len(self.languages)), np.float32)
        if not len(starts):
            return score
        spots = [np.concatenate([[0], gram_features(codes, n, self.grams.shape[2])[: len(codes) - n]]) for n in (2, 3, 4)]
        edges = np.stack([starts, ends], 1).ravel()
        for j in range(len(self.languages)):
            letters = np.zeros(len(codes), np.float32)
            for k, at in enumerate(spots):
                letters[: len(at)] += self.grams[k, j].take(at)
            score[:, j] = np.add.reduceat(letters, edges)[::2]
        score /= np.sqrt(3.0 * (ends - starts), dtype=np.float32)[:, None]
        known = self.lexicon[run_hashes(codes, starts, ends) & np.uint32(LEXICON - 1)]
        return score + self.lexical[known].astype(np.float32)

    def posteriors(self, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Posterior of each word's language; ``bounds`` are the texts' limits in words."""
        return chain_posteriors(emissions, bounds, self.moves, self.first)

    def predict(self, texts: list[str | None], part: int = PART) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        part = max(8 * part // max(len(self.languages), 8), 64)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        long = [i for i, t in enumerate(texts) if t and len(t) > part]
        for i in long:
            total[i], n[i] = self.long_sums(texts[i], part)
        short = np.setdiff1d(np.arange(len(texts)), long)
        for owner, some in parts([texts[i] for i in short], part):
            codes, starts, ends, bounds = word_grid(some)
            total[short[owner]] = segment_sums(self.posteriors(self.emissions(codes, starts, ends), bounds), bounds)
            n[short[owner]] = np.diff(bounds)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, n)]
        return names, np.where(n > 0, np.clip(mean[np.arange(len(n)), best], 0, 1), 0.0)

    def long_sums(self, text: str, part: int) -> tuple[np.ndarray, int]:
        """The sum of the posteriors of all words of one text, and how many there are."""

        def evidence(a: int, b: int) -> np.ndarray:
            codes, starts, ends, _ = word_grid([text[a:b]])
            e = self.emissions(codes, starts, ends).astype(np.float64)
            return np.maximum(np.exp(e - e.max(1, keepdims=True)), 1e-200) if len(e) else e

        m, first = np.exp(self.moves - self.moves.max()), np.exp(self.first - self.first.max())
        spans, before, state = cuts(text, part), [], None
        for span in spans:
            x = evidence(*span)
            before.append(state)
            state = run_chain(x, m, first, state)[-1] if len(x) else state
        total, n, after = np.zeros(len(first)), 0, None
        for span, state in zip(reversed(spans), reversed(before)):
            x = evidence(*span)
            if len(x):
                back = run_chain(x[::-1], m.T, np.ones_like(first), after)[::-1]
                post = run_chain(x, m, first, state) * (back / x)
                total += (post / post.sum(1, keepdims=True)).sum(0)
                n, after = n + len(x), back[0]
        return total, n

    def tag(self, text: str | None) -> list[tuple[str, str]]:
        """(word, language) of each word of one text: the labelling itself, for code-switched text."""
        codes, starts, ends, bounds = word_grid([text])
        if not len(starts) or not self.languages:
            return []
        post = self.posteriors(self.emissions(codes, starts, ends), bounds).argmax(1)
        words = ["".join(map(chr, codes[s:e])) for s, e in zip(starts, ends)]
        return [(w, self.languages[k]) for w, k in zip(words, post)]


def chain_posteriors(e: np.ndarray, bounds: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors (N, L) of the labels of chains of any lengths: chain i has the scores e[bounds[i]:bounds[i+1]].

    Rows are ordered by place, and within a place by the lengths of their chains, longest first; so the chains that have a
    place are a prefix of those that have the one before, and a step of the recursion is one block of rows.
    """
    length = np.diff(bounds)
    chains = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    if not steps:
        return np.zeros_like(e, np.float64)
    # How many chains have place t, and where the rows of place t begin.
    live = np.searchsorted(-length[chains], -np.arange(steps), side="left")
    at = np.concatenate([[0], np.cumsum(live)])
    rank = np.arange(at[-1]) - np.repeat(at[:-1], live)
    row = bounds[chains[rank]] + np.repeat(np.arange(steps), live)
    x = np.exp((e - e.max(1, keepdims=True))[row], dtype=np.float64)
    m = np.exp(moves - moves.max())
    alpha, beta = x, np.ones_like(x)
    back, ones = np.ascontiguousarray(m.T), np.ones(len(m))
    at, live = at.tolist(), live.tolist()
    x = x.copy()
    alpha[: live[0]] *= np.exp(first - first.max())
    alpha[: live[0]] /= (alpha[: live[0]] @ ones)[:, None]
    for t in range(1, steps):
        n, here = live[t], at[t]
        a = alpha[here : here + n]
        a *= alpha[at[t - 1] : at[t - 1] + n] @ m
        a /= (a @ ones)[:, None]
    for t in range(steps - 2, -1, -1):
        n, there = live[t + 1], at[t + 1]
        b = (x[there : there + n] * beta[there : there + n]) @ back
        b /= (b @ ones)[:, None]
        beta[at[t] : at[t] + n] = b
    alpha *= beta
    alpha /= alpha.sum(1, keepdims=True)
    out = np.empty_like(alpha)
    out[row] = alpha
    return out


def run_chain(x: np.ndarray, m: np.ndarray, first: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The recursion a[t] = x[t] * (a[t-1] @ m), scaled, over one chain that goes on from ``before`` or begins with ``first``.

    The chain is cut into about as many segments as each has places. What every segment does to any vector before it is found for
    all of them side by side, then the vectors between segments follow one from another, then all places side by side again.
    """
    if before is None:
        a = first * x[0]
        a /= a.sum()
        return np.concatenate([a[None], run_chain(x[1:], m, first, a)])
    n, k = x.shape
    if not n:
        return np.empty((0, k))
    size = int(np.ceil(n**0.5))
    segments = -(-n // size)
    grid = np.concatenate([x, np.ones((segments * size - n, k))]).reshape(segments, size, k)
    live = [segments - ((segments - 1) * size + t >= n) for t in range(size)]
    through = np.tile(np.eye(k), (segments, 1, 1))
    for t, s in enumerate(live):
        step = (through[:s] @ m) * grid[:s, t, None, :]
        through[:s] = step / step.sum((1, 2), keepdims=True)
    a = np.empty((segments, k))
    a[0] = before
    for s in range(1, segments):
        a[s] = a[s - 1] @ through[s - 1]
        a[s] /= a[s].sum()
    for t, s in enumerate(live):
        step = (a[:s] @ m) * grid[:s, t]
        a[:s] = step / step.sum(1, keepdims=True)
        grid[:s, t] = a[:s]
    return grid.reshape(-1, k)[:n]


def forward_backward(e: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For scores e (S, T, L) of chains of one length: posteriors (S, T, L), and the expected moves (S, L, L)."""
    s, t, n = e.shape
    x = np.exp((e - e.max(2, keepdims=True)).transpose(1, 2, 0), order="C")  # (T, L, S): sums over L are then cheap
    m = np.exp(moves - moves.max()).astype(x.dtype)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    a = np.exp(first - first.max()).astype(x.dtype)[:, None] * x[0]
    alpha[0] = a / a.sum(0)
    back = np.ascontiguousarray(m.T)
    for k in range(1, t):
        a = (back @ alpha[k - 1]) * x[k]
        a /= a.sum(0)
        alpha[k] = a
    for k in range(t - 2, -1, -1):
        b = m @ (x[k + 1] * beta[k + 1])
        b /= b.sum(0)
        beta[k] = b
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    gamma = gamma.transpose(2, 0, 1)
    right = x[1:] * beta[1:]
    z = np.einsum("tis,ij,tjs->ts", alpha[:-1], m, right)
    return gamma, np.einsum("tis,tjs,ts->sij", alpha[:-1], right, 1 / z) * m


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit on (text, language) passages by stochastic gradient ascent of the chains' log-likelihood."""
    languages = sorted({lang for _, lang in rows})
    n_lang = len(languages)
    codes, starts, ends, bounds = word_grid([t for t, _ in rows])
    label = np.repeat([languages.index(lang) for _, lang in rows], np.diff(bounds)).astype(np.int64)
    slot = (run_hashes(codes, starts, ends) & np.uint32(LEXICON - 1)).astype(np.int64)
    buckets = buckets_of(n_lang)
    # The share of each (word, language) that occurs, of the word's shares in all languages.
    pair, seen = np.unique(slot * max(n_lang, 1) + label, return_counts=True)
    word, lang = pair // max(n_lang, 1), pair % max(n_lang, 1)
    share = seen / np.maximum(np.bincount(label, minlength=max(n_lang, 1)), 1)[lang]
    share = share / np.bincount(word, share, LEXICON)[word]
    lexicon = np.zeros(LEXICON, np.int32)
    clear = (np.bincount(word, seen, LEXICON)[word] >= 3) & (share > 0.8)
    lexicon[word[clear]] = lang[clear] + 1
    model = Model(
        languages,
        np.zeros((3, n_lang, buckets), np.float32),
        lexicon,
        np.zeros((1 + n_lang, n_lang)),
        np.zeros((n_lang, n_lang)),
        np.zeros(n_lang),
    )
    if n_lang == 0 or not len(starts):
        return model
    # Training chains: 48 words, spliced from three stretches of 8 to 32 words of different passages.
    rng = np.random.default_rng(seed)
    width, per_batch = 48, 64
    features = [np.pad(gram_features(codes, n, buckets), (1, n))[: len(codes)] for n in (2, 3, 4)]
    lengths = ends - starts
    usable = np.flatnonzero(np.diff(bounds) >= 1)
    n_batches = max(8, int(len(starts) / (width * per_batch)))
    grads = np.zeros_like(model.grams)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for _ in range(n_batches):
            chain = np.empty((per_batch, width), np.int64)
            for s in range(per_batch):
                at = 0
                while at < width:
                    p = usable[rng.integers(len(usable))]
                    want = min(int(rng.integers(8, 33)), width - at, bounds[p + 1] - bounds[p])
                    begin = int(rng.integers(bounds[p], bounds[p + 1] - want + 1))
                    chain[s, at : at + want] = np.arange(begin, begin + want)
                    at += want
            flat = chain.ravel()
            e = model.emissions_of(features, slot, starts, lengths, flat).reshape(per_batch, width, n_lang)
            gamma, pairs = forward_backward(e, model.moves, model.first)
            gold = np.eye(n_lang)[label[chain]]
            gap = (gold - gamma).reshape(-1, n_lang)
            observed = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
            model.moves += step * (observed - pairs.sum(0)) / per_batch / 8
            model.first += step * (gold[:, 0] - gamma[:, 0]).mean(0) / 8
            np.add.at(model.lexical, lexicon[slot[flat]], step * gap / per_batch)
            spread = np.repeat(np.arange(len(flat)), lengths[flat])
            where = np.repeat(starts[flat], lengths[flat]) + (
                np.arange(len(spread)) - np.repeat(np.cumsum(lengths[flat]) - lengths[flat], lengths[flat])
            )
            push = (step * gap / np.sqrt(3.0 * lengths[flat])[:, None])[spread]
            for k in range(3):
                f = features[k][where]
                for j in range(n_lang):
                    grads[k, j] = np.bincount(f, push[:, j], buckets)
                model.grams[k] += grads[k] / 4
    return model


def _emissions_of(self: Model, features, slot, starts, lengths, words) -> np.ndarray:
    """Emission scores of some words of the training text."""
    n = lengths[words]
    where = np.repeat(starts[words], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    out = np.zeros((len(words), len(self.languages)))
    for k in range(3):
        out += np.add.reduceat(self.grams[k][:, features[k][where]], np.cumsum(n) - n, axis=1).T
    return out / np.sqrt(3.0 * n)[:, None] + self.lexical[self.lexicon[slot[words]]]


Model.emissions_of = _emissions_of


def training_passages(docs: DataFrame, passages: int = TRAIN_PASSAGES, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled passages: about ``passages`` a language, at hashed documents and places."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    counts = {r["lang"]: max(r["n"], 1) for r in sizes.collect()}
    if not counts:
        return []
    passages = max(1, min(passages, TRAIN_ALL // len(counts)))
    scale = 1_000_000_000
    shares = [(lang, int(min(1.0, max(1.2 * passages, 20) / n) * scale)) for lang, n in sorted(counts.items())]
    share: Column = F.create_map(*[F.lit(v) for pair in shares for v in pair])[F.col("lang")]
    h = F.xxhash64("doc_id")
    picked = (
        rows.filter(F.pmod(h, F.lit(scale)) < share)
        .select(
            "lang",
            h.alias("h"),
            F.substring(
                "text",
                F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - chars, F.lit(1))).cast("int") + 1,
                F.lit(chars),
            ).alias("text"),
        )
        .groupBy("lang", "h")  # a document counts once, however often its id comes
        .agg(F.min("text").alias("text"))
        .collect()
    )
    out, used = [], dict.fromkeys(counts, 0)
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"], r["text"])):
        if used[r["lang"]] < passages:
            used[r["lang"]] += 1
            out.append((r["text"], r["lang"]))
    return out


def predict_column(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for some in blocks(texts):
        said, how_sure = model.predict(some.to_pylist())
        names += said
        scores += how_sure.tolist()
    return names, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_column(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is known with a score of at least ``least``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_column(shared.value, batch.column(at))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame) -> Model:
    """Fit on the rows outside the held-out fold; only text and language are seen."""
    return fit(training_passages(docs.filter(fold("doc_id", 4) != 2)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs)
    said = identify(docs, model)
    return said.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
