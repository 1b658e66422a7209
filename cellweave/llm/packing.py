"""Lexical retrieval packing.

Document frequencies are counted over all documents. Each document is keyed by its weightiest term that another document has
too (so copies share a key), documents are dealt by key to partitions, and a partition is cut in the order of its keys into
shards of about ``SHARD_TOKENS`` tokens. The documents of a frequent key are dealt as parts of about ``PART_TOKENS`` tokens.
A shard holds an inverted index of its documents with BM25 weights over all terms, those of equal documents once. Packing
starts a window with a seed document, asks the index with all terms of the seed for its neighbours that are still unused, best
first, and appends them until the window of ``WINDOW`` tokens is full. A document that crosses the edge is cut there; its rest
opens the next window and is the next seed. If no unused document shares a term with the seed, the next unused one in the order
of the shard goes on. Neighbours are sought within the shard. Only the end of a shard is short of a window; it is cut into
sequences whose lengths are powers of two, so no token of padding is needed.

Memory is bounded by one shard, the cache of chunks and the table of frequent terms; rare terms beyond it are joined to the
documents that have them. No weight depends on that, and a task that runs again makes the same
sequences. Sequence ids are (partition, running number).

A document's ids are those of the tokenizer file, without special tokens added, then ``end_id``. A chunk is what ASCII white
space parts, with A-Z in lower case, and is tokenised once per Python worker: the tokenizer must lower-case, end words at white
space and drop it, which is checked. Chunks and terms are known by 64- and 56-bit names; the chance that any two of a full
cache of chunks share one is 2e-7.

Defined cases: a null or empty text is the single ``end_id``; repeated rows and ids are packed each for itself; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise, small_batches
from cellweave.llm.textscan import NameTable, blocks, chunk_bounds, chunk_names

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 20
#: Tokens of the parts in which the documents of one frequent key are dealt.
PART_TOKENS = 1 << 16
#: Entries of the broadcast table of frequencies. The rarest terms beyond it come to the documents by a join, with the same numbers.
MOST_TERMS = 4 << 20
RARE = "array<struct<term: bigint, docs: bigint>>"
K1, B = 1.2, 0.75
#: Chunks kept by a worker's cache; a full cache is started anew.
CACHE_CHUNKS = 2_000_000
#: A term that one in so many entries of a shard have is a dense row of its index.
DENSE = 12

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
)

_TERM_BITS = 56
_MARKS = (46, 44)  # the bytes of full stop and comma
_MARKED = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        ends[i] = token.endswith("</w>")
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    texts = ("Ab cd. Ef,", " ab\t\ncd.\refg", "ab", "cd", ".", "ef", ",", "efg")
    got = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    if got[0] != sum(got[2:7], []) or got[1] != sum((*got[2:5], got[7]), []) or any(len(t.split()) != 1 for t in added):
        raise ValueError("the tokenizer must lower-case, end words at white space and drop it")
    return tokenizer, ends, added


@lru_cache(1 << 16)
def _stays_letter(c: str) -> bool:
    """Whether a character is made of letters, and old enough for every table of letters, when composed and in lower case."""
    old = unicodedata.ucd_3_2_0
    return all(old.category(x)[0] == "L" for x in c + unicodedata.normalize("NFC", c).lower())


def plain(word: str) -> bool:
    """Whether the tokenizer takes the word as one unit, whatever mark follows it."""
    return word.isalpha() and (word.isascii() or all(map(_stays_letter, word)))


class Chunks:
    """The chunks of some texts, in order: bytes in lower case, bounds without the mark at the end, mark, text and name.

    A chunk with one of the strings ``as_is`` in other letters keeps its capitals.
    """

    def __init__(self, texts: pa.Array, as_is: tuple[str, ...] = ()):
        self.row, self.begin, self.end, self.owner = chunk_bounds(texts)
        if as_is:
            self._keep_capitals(texts, as_is)
        last = self.row[self.end - 1]
        self.mark = np.where(self.end - self.begin > 1, (last == _MARKS[0]) + 2 * (last == _MARKS[1]), 0)
        self.end = self.end - (self.mark > 0)
        self.name = chunk_names(self.row, self.begin, self.end)
        self.count = len(texts)

    def _keep_capitals(self, texts: pa.Array, as_is: tuple[str, ...]) -> None:
        low, raw = self.row.tobytes(), b""
        for mark in (x.lower().encode() for x in as_is):
            at = low.find(mark)
            while at >= 0:
                raw = raw or b"".join(t.encode("utf-8", "surrogatepass") for t in texts.to_pylist() if t)
                k = int(np.searchsorted(self.begin, at, side="right")) - 1
                self.row[self.begin[k] : self.end[k]] = np.frombuffer(raw[self.begin[k] : self.end[k]], np.uint8)
                at = low.find(mark, int(self.end[k]))

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct terms of each text: text, term and how often. A term is a chunk without its mark."""
        key = self.name >> np.uint64(64 - _TERM_BITS) | self.owner.astype(np.uint64) << np.uint64(_TERM_BITS)
        key, often = np.unique(key, return_counts=True)
        low = np.uint64((1 << _TERM_BITS) - 1)
        return (key >> np.uint64(_TERM_BITS)).astype(np.int64), (key & low).astype(np.int64), often

    def codes(self) -> np.ndarray:
        """Names of the chunks with their marks."""
        return self.name ^ _MARKED[self.mark]

    def text(self, at: np.ndarray, marked: bool = False) -> list[str]:
        raw, end = self.row.tobytes(), self.end[at] + (self.mark[at] > 0 if marked else 0)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.begin[at].tolist(), end.tolist())]


def term_name(term: str) -> int:
    return int(Chunks(pa.array([term])).terms()[1][0])


class Encoder:
    """Token ids of texts by way of a cache of chunks."""

    def __init__(self, path: str):
        self.tokenizer, self.word_ends, self.as_is = _load(path)
        self.reset()

    def reset(self) -> None:
        self.known = NameTable()
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.tokens = np.empty(0, np.uint16 if len(self.word_ends) <= 1 << 16 else np.uint32)

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([y for x in found for y in x], np.int64), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of plain words: encoded together and parted at the tokens that end a word."""
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.word_ends[ids])
            if len(ends) == len(some) and len(ids) == ends[-1] + 1:
                parts.append((ids, np.diff(ends, prepend=-1)))
            else:
                parts.append(self._encode_each(some))
        ids, sizes = zip(*parts)
        return np.concatenate(ids), np.concatenate(sizes)

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[number]
        where = np.repeat(self.begin[number] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.tokens[where], size

    def _add(self, names: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.known.add(names)
        self.begin = np.append(self.begin, len(self.tokens) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.tokens = np.append(self.tokens, ids.astype(self.tokens.dtype))

    def _learn(self, chunks: Chunks, new: np.ndarray, codes: np.ndarray) -> None:
        """Add the chunks at the places ``new``, whose names with marks are ``codes``."""
        words = chunks.text(new)
        odd = np.array([not plain(w) for w in words], bool)
        # A plain word is known without its mark first; a chunk of another kind is known as it stands.
        bare, first = np.unique(chunks.name[new[~odd]], return_index=True)
        unknown = self.known.find(bare) < 0
        some = np.flatnonzero(~odd)[first[unknown]]
        self._add(bare[unknown], *self._encode_words([words[k] for k in some]))
        marked = ~odd & (chunks.mark[new] > 0)
        if marked.any():
            ids, size = self._gather(self.known.find(chunks.name[new[marked]]))
            both = self._encode_each([".", ","])[0]
            ids = np.insert(ids.astype(np.int64), np.cumsum(size), both[chunks.mark[new[marked]] - 1])
            self._add(codes[marked], ids, size + 1)
        if odd.any():
            self._add(codes[odd], *self._encode_each(chunks.text(new[odd], True)))

    def encode(self, chunks: Chunks) -> list[np.ndarray]:
        """Per text its token ids, without the end id."""
        codes = chunks.codes()
        number = self.known.find(codes)
        new = np.flatnonzero(number < 0)
        if len(new):
            names, first = np.unique(codes[new], return_index=True)
            self._learn(chunks, new[first], names)
            number[new] = self.known.find(codes[new])
        ids, size = self._gather(number)
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(chunks.owner, np.arange(1, chunks.count))]
        return np.split(ids, bounds)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One cache for all tasks of a worker."""
    return Encoder(path)


class Frequencies:
    """In how many of all documents terms are. Terms of one document are absent, and of those beyond the most frequent ones what
    :meth:`extended` did not add."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, n: int, mean: float, base: Frequencies | None = None):
        order = np.argsort(terms)
        self.terms, self.docs, self.n, self.mean, self.base = terms[order], docs[order], n, mean, base

    def __call__(self, names: np.ndarray) -> np.ndarray:
        """0 where a term is absent."""
        found = self.base(names) if self.base else np.zeros(len(names), np.int64)
        if not len(self.terms):
            return found
        at = np.minimum(np.searchsorted(self.terms, names), len(self.terms) - 1)
        return np.where(self.terms[at] == names, self.docs[at], found)

    def extended(self, rare: list[pa.Array]) -> Frequencies:
        """With the rare terms of some documents, see :func:`with_rare_terms`."""
        each = [x.flatten() for x in rare if x.null_count < len(x)]
        if not each:
            return self
        terms, docs = (np.concatenate([x.field(k).to_numpy(zero_copy_only=False) for x in each]) for k in ("term", "docs"))
        terms, first = np.unique(terms, return_index=True)
        return Frequencies(terms, docs[first], self.n, self.mean, self)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """Inverted BM25 index of one shard. Documents of equal terms are one entry.

    A document is its distinct terms, in order, and how often it has them. ``known`` has the frequencies of terms over all
    documents; for terms it does not know, and without it, the shard's own are taken.
    """

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], known: Frequencies | None = None):
        entries, chosen, entry = {}, [], np.empty(len(docs), np.int64)
        for i, (terms, often) in enumerate(docs):
            entry[i] = e = entries.setdefault(terms.tobytes() + often.tobytes(), len(entries))
            if e == len(chosen):
                chosen.append((terms, often))
        self.entry, self.size = entry, len(chosen)
        self.copies = copies = np.bincount(entry, minlength=self.size)
        self.members = np.split(np.argsort(entry, kind="stable"), np.cumsum(copies)[:-1]) if docs else []
        self.past = np.zeros(self.size, np.int64)  # members of an entry that are known to be used
        none = np.empty(0, np.int64)
        numbers, term = np.unique(np.concatenate([none, *(t for t, _ in chosen)]), return_inverse=True)
        tf = np.concatenate([none, *(n for _, n in chosen)])
        owner = np.repeat(np.arange(self.size), [len(t) for t, _ in chosen])
        size = np.bincount(owner, tf, self.size)
        here = np.bincount(term, copies[owner], len(numbers)).astype(np.int64)
        total, often, mean = len(docs), here, float(size @ copies) / max(len(docs), 1)
        if known is not None:
            total, often, mean = max(known.n, len(docs)), np.maximum(known(numbers), here), known.mean
        keep = (here >= 2)[term]  # what one document has finds no other
        term, tf, owner = term[keep], tf[keep], owner[keep]
        norm = K1 * (1 - B + B * size / max(mean, 1))
        weight = (idf(often, total)[term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        spread = np.bincount(term, minlength=len(numbers))
        dense = np.flatnonzero(spread * DENSE > self.size)
        row = np.full(len(numbers), -1)
        row[dense] = np.arange(len(dense))
        row = row[term]
        self.dense = np.zeros((len(dense), self.size), np.float32)
        self.dense[row[row >= 0], owner[row >= 0]] = weight[row >= 0]
        # Terms of each entry: dense rows and others apart; then the postings of the others.
        self.dense_terms = _grouped(owner[row >= 0], row[row >= 0], self.size)
        rest = row < 0
        self.rare_terms = _grouped(owner[rest], term[rest], self.size)
        order = np.argsort(term[rest], kind="stable")
        self.doc, self.weight = owner[rest][order], weight[rest][order]
        self.first = np.searchsorted(term[rest][order], np.arange(len(numbers) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Per entry the BM25 score of all terms of the seed."""
        e = self.entry[seed]
        score = self.dense[self.dense_terms[e]].sum(0)
        rare = self.rare_terms[e]
        if len(rare):
            size = self.first[rare + 1] - self.first[rare]
            at = np.repeat(self.first[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score = score + np.bincount(self.doc[at], self.weight[at], self.size)
        return score

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; equal scores in order of entries, copies in theirs."""
        score = self.scores(seed)
        score[self.past == self.copies] = 0
        for e in np.argsort(-score, kind="stable")[: np.count_nonzero(score)].tolist():
            members = self.members[e]
            while self.past[e] < len(members):
                d = int(members[self.past[e]])
                self.past[e] += 1
                if not used[d]:
                    yield d


def _grouped(group: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(group, kind="stable")
    return np.split(value[order], np.searchsorted(group[order], np.arange(1, n)))


def pack_order(sizes: np.ndarray, docs: list, window: int = WINDOW, known: Frequencies | None = None) -> list[int]:
    """The order in which a shard's documents follow each other through its windows."""
    index, used = Index(docs, known), np.zeros(len(sizes), bool)
    order: list[int] = []
    room, fresh = window, 0

    def place(d: int) -> None:
        nonlocal room
        used[d] = True
        order.append(d)
        room -= int(sizes[d])

    while len(order) < len(sizes):
        if room <= 0 and room % window:  # the last document opens the next window
            seed, room = order[-1], room % window
        else:
            room = room if room > 0 else window
            while used[fresh]:
                fresh += 1
            seed = fresh
            place(seed)
            if room <= 0:
                continue
        for d in index.neighbours(seed, used):
            place(d)
            if room <= 0:
                break
    return order


def sequence_lengths(total: int, window: int = WINDOW) -> list[int]:
    """Full windows, then the powers of two that make up the rest."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]


def _shard_pieces(ids: list, tokens: list[np.ndarray], docs: list, first_sequence: int, window: int, known: Frequencies):
    sizes = np.array([len(t) for t in tokens], np.int64)
    order = np.array(pack_order(sizes, docs, window, known))
    limits = np.cumsum(sizes[order])
    lengths = np.array(sequence_lengths(int(limits[-1]), window), np.int64)
    edges = np.cumsum(lengths)
    cuts = np.union1d(limits, edges)
    begins = np.concatenate([[0], cuts[:-1]])
    doc = order[np.searchsorted(limits, begins, side="right")]
    doc_begin = (limits - sizes[order])[np.searchsorted(limits, begins, side="right")]
    seq = np.searchsorted(edges, begins, side="right")
    start, size = begins - doc_begin, cuts - begins
    return len(lengths), pa.RecordBatch.from_arrays(
        [
            pa.array([ids[d] for d in doc], pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(size, pa.int64()),
            pa.array([tokens[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, size)], pa.binary()),
            pa.array(sizes[doc], pa.int64()),
            pa.array(first_sequence + seq, pa.int64()),
            pa.array(begins - (edges - lengths)[seq], pa.int64()),
            pa.array(lengths[seq], pa.int64()),
        ],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"],
    )


def frequencies(docs: DataFrame, most: int = MOST_TERMS) -> Frequencies:
    """Document frequencies over all of ``docs``, of the most frequent terms that at least two documents have."""
    return parted(counted_terms(docs), most)[0]


def counted_terms(docs: DataFrame) -> DataFrame:
    """(term, docs) over all of ``docs``, of terms that at least two documents have; keys -1 and -2 count rows and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, whole = 0, np.zeros(2, np.int64)

        def counted() -> pa.RecordBatch:
            terms, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(count.astype(np.int64))], ["term", "docs"])

        for batch in batches:
            for some in blocks(batch.column(0)):
                _, terms, often = Chunks(some).terms()
                held.append(terms)
                n += len(terms)
                whole += len(some), often.sum()
            if n > 4 << 20:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array(whole)], ["term", "docs"])

    found = docs.select("text").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    return materialise(found.filter((F.col("docs") >= 2) | (F.col("term") < 0)), "packing-frequencies")


def parted(table: DataFrame, most: int = MOST_TERMS) -> tuple[Frequencies, DataFrame | None]:
    """Frequencies of up to ``most`` of the most frequent terms, and the rows of all others, if there are any."""
    rest = None
    if table.count() > most + 2:
        total, least = 0, None
        for row in table.filter("term >= 0").groupBy("docs").count().orderBy(F.desc("docs")).toLocalIterator():
            total += row["count"]
            if total > most:
                break
            least = row["docs"]
        common = F.lit(False) if least is None else F.col("docs") >= least
        table, rest = table.filter(common | (F.col("term") < 0)), table.filter(~common & (F.col("term") >= 0))
    got = table.toArrow()
    terms, counts = got["term"].to_numpy().copy(), got["docs"].to_numpy().copy()
    rows, said = (int(counts[terms == k].sum()) for k in (-1, -2))
    return Frequencies(terms[terms >= 0], counts[terms >= 0], rows, said / max(rows, 1)), rest


def with_rare_terms(docs: DataFrame, shared, rest: DataFrame | None) -> DataFrame:
    """``docs`` (doc_id, text, salt) with ``rare``: those of its terms, with their frequencies, that are in ``rest``."""
    if rest is None:
        return docs.withColumn("rare", F.lit(None).cast(RARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in blocks(batch.column(1)):
                text, term, _ = Chunks(some).terms()
                left = shared.value(term) == 0
                row = pa.array(at + text[left])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(2).take(row), pa.array(term[left])], ["rare_id", "rare_salt", "term"]
                )
                at += len(some)

    said = docs.mapInArrow(run, "rare_id long, rare_salt long, term long").join(rest, "term")
    rare = said.groupBy("rare_id", "rare_salt").agg(F.collect_set(F.struct("term", "docs")).cast(RARE).alias("rare"))
    same = F.col("salt").eqNullSafe(F.col("rare_salt")) & F.col("doc_id").eqNullSafe(F.col("rare_id"))
    return docs.join(rare, same, "left").select("doc_id", "text", "salt", "rare")


def weightiest(chunks: Chunks, known: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have a term of another document too, ascending, with the weightiest such term and its frequency."""
    text, term, tf = chunks.terms()
    df = known(term)
    text, term, tf, df = (x[df > 0] for x in (text, term, tf, df))
    if not len(text):
        return text, term, df
    weight = idf(df, known.n) * tf / (tf + K1)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    most = np.repeat(np.maximum.reduceat(weight, first), np.diff(np.append(first, len(text))))
    best = np.flatnonzero(weight == most)
    best = best[np.unique(text[best], return_index=True)[1]]
    return text[best], term[best], df[best]


def dealt(docs: DataFrame, shared, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, text, rare) of (doc_id, text, salt, rare), documents of one key next to each other in one partition, or in parts of
    about ``part_tokens`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            salt = batch.column(2).to_numpy(zero_copy_only=False)
            keys, parts, at = salt.copy(), np.zeros(len(salt), np.int64), 0
            for some in blocks(batch.column(1)):
                text, term, df = weightiest(Chunks(some), known.extended([batch.column(3).slice(at, len(some))]))
                # A chunk has about two tokens.
                keys[at + text] = term
                parts[at + text] = salt[at + text] % (1 + (df * max(known.mean, 1) * 2).astype(np.int64) // part_tokens)
                at += len(some)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys), pa.array(parts)], ["doc_id", "text", "salt", "rare", "key", "part"]
            )

    keyed = docs.mapInArrow(run, f"doc_id long, text string, salt long, rare {RARE}, key long, part long")
    return keyed.repartition("key", "part").sortWithinPartitions("key", "part", "salt").select("doc_id", "text", "rare")


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """One row per piece: see SCHEMA; ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers.

    Frequencies of ``most_terms`` terms are broadcast and the others joined; which are which changes no weight.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    path = tokenizer_path or default_tokenizer()
    _load(path)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common, rest = parted(counted_terms(docs), most_terms)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    docs = with_rare_terms(docs.withColumn("salt", F.xxhash64("doc_id", "text")), shared, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence, known = _encoder(path), TaskContext.get().partitionId() << 32, shared.value
        names: list = []
        tokens: list[np.ndarray] = []
        said: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[pa.Array] = []
        held = 0
        for batch in batches:
            ids, at = iter(batch.column(0).to_pylist()), 0
            for some in blocks(batch.column(1)):
                chunks = Chunks(some, encoder.as_is)
                text, term, often = chunks.terms()
                cuts = np.searchsorted(text, np.arange(1, len(some)))
                said += zip(np.split(term, cuts), np.split(often, cuts))
                rare.append(batch.column(2).slice(at, len(some)))
                at += len(some)
                for t in encoder.encode(chunks):
                    names.append(next(ids))
                    tokens.append(np.append(t, np.array([end_id], t.dtype)))
                    held += len(tokens[-1])
                if len(encoder.size) > CACHE_CHUNKS:
                    encoder.reset()
                if held >= shard_tokens:
                    n, out = _shard_pieces(names, tokens, said, sequence, window, known.extended(rare))
                    yield out
                    sequence += n
                    names, tokens, said, rare, held = [], [], [], [], 0
        if names:
            yield _shard_pieces(names, tokens, said, sequence, window, known.extended(rare))[1]

    return dealt(docs, shared).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
