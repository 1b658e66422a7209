r"""Main-text extraction by tag-path ratios.

A page is read tag by tag into text nodes, each with its root-to-leaf tag path, and into blocks (text between the edges of
block elements). Elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments are left out. For every tag path the mean text length and the mean number of punctuation marks per
node are taken and fused by the root of their product. Along the page, over runs of nodes of one path, the logarithms of these
ratios are smoothed (so a short list inside of long text gains much, one beside it little), and averaged by path; a path has the
larger of its own ratio and this mean, so short neighbours take nothing from long text. Paths at or above
a share of the characters' mean, or the ratio of a short sentence, are content, as are those of which every second node has a
mark; a path is content as a whole or not at all. A block with a content node is kept whole, and so is a heading if content follows before the next heading of its rank
or a higher one. All else is dropped. If the article and main elements of the page hold half of the content's characters
together, only what stands in one of them is kept.

Inside a block white space becomes one space (a line break element is white space), ends are trimmed, character references are
decoded, and the blocks that are not empty are joined by ``\n``.

Defined cases: null or empty html gives an empty text; unclosed and misnested tags are closed as browsers do; elements nest
``MOST_DEPTH`` deep, and of further ones text takes the path of the innermost, while what is left out stays so; an unterminated
comment or script runs to the end of the page; quotes open after ``=`` only, one that does not end is part of its word, and if
the quotes of a tag leave it no ``>`` up to the end of the page, quotes count no more from there; a tag without ``>`` is text;
repeated rows are extracted alike; an empty
table gives no row; further columns are ignored. Time and memory are linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import documents, small_batches

# Element names of HTML and words by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg template math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center details div html main section table tbody td tr".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe input menu nav noscript object script select style "
    "svg template textarea".split()
)
LEFT_OUT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo related "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that stand beside those in names of furniture (``share-buttons``); with any other (``related-work``) a name is no furniture.
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons col column container content count desktop entry footer form group "
    "header heading icon icons inner item items left link links list main meta mobile news outer page panel post posts primary "
    "right row secondary section site stories text title top wrap wrapper".split()
)
PROSE = frozenset("b blockquote dd dt em h1 h2 h3 h4 h5 h6 i li p pre q span strong td th".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")
#: Tags that a start tag closes if they are open: the start tag, what it closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}

CONTENT_SHARE = 0.5  # of the characters' mean fused ratio, for a node to be content
CLEAR = 6.0  # the ratio of a short sentence, which is content beside any longer text
SENTENCE_MARKS = 0.5  # marks a node from which a path is sentences, however short
NAMED_SHARE = 0.5  # of the content's characters, for article and main elements to be all of the text
HEADINGS = {f"h{k}": k for k in range(1, 7)}

#: Open elements at most, as in browsers.
MOST_DEPTH = 512

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TO_END = re.compile(r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)[^>=]*+)*+>")
_ATTR = re.compile(r"([^\s=/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z0-9]+")


def _furniture(tag: str, names: str) -> bool:
    """Whether classes or an id say that an element is not the article: one of them, or all of them on an element of prose."""
    said = []
    for name in names.split():
        words = _WORD.findall(name)
        some = not LEFT_OUT_WORDS.isdisjoint(words)
        said.append(some and all(w in LEFT_OUT_WORDS or w in BESIDE or w.isdigit() for w in words))
    return bool(said) and (all(said) if tag in PROSE else any(said))


def _left_out(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in LEFT_OUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and _furniture(tag, value):
            return True
    return False


def markup(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, rest) of comments and declarations (kind !), CDATA ([), start tags (empty) and end tags (/).

    What is sent to the generator is the place at which it goes on.
    """
    at, quotes = 0, True
    while m := _MARKUP.search(html, at):
        start, opening = m.start(), m[0]
        if opening in ("<!--", "<![CDATA["):
            close = "-->" if opening == "<!--" else "]]>"
            end = html.find(close, m.end())
            end = len(html) if end < 0 else end + len(close)
            kind, name, rest = ("!", "", "") if opening == "<!--" else ("[", "", html[start + 9 : end].removesuffix("]]>"))
        else:
            first = html.find(">", start)
            if first < 0:
                if opening[1] not in "!?":
                    return  # what is left has no tag
                first = len(html) - 1
            end, kind, name, rest = first + 1, "!", "", ""
            if opening[1] not in "!?":
                named = _NAME.match(html, start)
                whole = _TO_END.match(html, named.end()) if quotes else None
                end, quotes = (whole.end(), True) if whole else (end, False)
                kind, name, rest = named[1], named[2].lower(), html[named.end() : end - 1]
        skipped_to = yield start, end, kind, name, rest
        at = skipped_to or end


class Page:
    """Text nodes and blocks of one page. A block is a list of nodes.

    A node is (path, text, whether it is in an article or main element, the rank of the heading that it is in or 0).
    """

    def __init__(self, html: str):
        self.blocks: list[list[tuple[int, str, bool, int]]] = [[]]
        paths: dict[tuple[int, str], int] = {}
        # Open elements: tag, whether it or an ancestor is left out, and path, named and rank of its nodes.
        stack: list[tuple[str, bool, int, bool, int]] = []
        out, path, named, rank = False, 0, False, 0
        # Open elements beyond the deepest: how many by tag, and the first that is left out, as the tag and its number.
        deeper: Counter[str] = Counter()
        hidden: tuple[str, int] | None = None
        at = 0

        def settle() -> None:
            nonlocal out, path, named, rank
            _, out, path, named, rank = stack[-1] if stack else ("", False, 0, False, 0)
            out = out or hidden is not None

        def text(raw: str) -> None:
            if not out and raw:
                self.blocks[-1].append((path, entities.unescape(raw), named, rank))

        def edge() -> None:
            if self.blocks[-1]:
                self.blocks.append([])

        def pop(k: int) -> None:
            nonlocal hidden
            if any(t in BLOCK for t, *_ in stack[k:]) or any(t in BLOCK for t in deeper):
                edge()
            del stack[k:]
            deeper.clear()  # they stood inside
            hidden = None
            settle()

        tags = markup(html)
        found = next(tags, None)
        while found:
            start, end, kind, tag, rest = found
            text(html[at:start])
            at = end
            if kind == "[":
                text(entities.unescape(rest).replace("&", "&amp;"))
            elif kind == "/" and deeper[tag]:
                if hidden == (tag, deeper[tag]):
                    hidden = None
                    settle()
                deeper[tag] -= 1
                if tag in BLOCK:
                    edge()
            elif kind == "/":
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if tag == "br":
                    text(" ")
                elif k is not None:
                    if tag in BLOCK or not any(t in BLOCK for t, *_ in stack[k:]):
                        pop(k)
                    else:  # an inline end tag does not close blocks
                        del stack[k]  # what is open inside keeps its path
                        settle()
                elif tag in BLOCK:
                    edge()
            elif tag == "br":
                text(" ")
            elif tag:
                if tag in BLOCK:
                    edge()
                    scope = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CONTAINER or stack[k][0] == "li"), -1)
                    p = next((k for k in range(len(stack) - 1, scope, -1) if stack[k][0] == "p"), None)
                    if p is not None:
                        pop(p)
                if tag in CLOSES:
                    closed, stop = CLOSES[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in stop:
                            break
                        if stack[k][0] in closed:
                            pop(k)
                            break
                if tag in RAW:
                    if not rest.endswith("/"):
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                        at = close.end() if close else len(html)
                        found = tags.send(at) if at < len(html) else None
                        continue
                elif tag not in VOID:
                    gone = out or _left_out(tag, rest, named)
                    if len(stack) >= MOST_DEPTH:
                        deeper[tag] += 1
                        hidden = (tag, deeper[tag]) if gone and not out else hidden
                    else:
                        path = paths.setdefault((path, tag), len(paths) + 1)
                        stack.append((tag, gone, path, named or tag in ("article", "main"), rank or HEADINGS.get(tag, 0)))
                    settle()
            found = next(tags, None)
        text(html[at:])

    def content(self) -> list[str]:
        nodes = [(p, t) for block in self.blocks for p, t, *_ in block if not t.isspace()]
        if not nodes:
            return []
        size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
        for p, t in nodes:
            size[p] += len(t.strip())
            marks[p] += len(PUNCTUATION.findall(t))
            count[p] += 1
        fused = {p: log(size[p] / n * (1 + marks[p] / n)) / 2 for p, n in count.items()}
        order = [p for p, _ in groupby(p for p, _ in nodes)]
        near = defaultdict(list)
        for p, f in zip(order, smooth([fused[p] for p in order])):
            near[p].append(f)
        ratio = {p: exp(max(fused[p], sum(f) / len(f))) for p, f in near.items()}
        limit = min(CONTENT_SHARE * sum(exp(fused[p]) * n for p, n in size.items()) / sum(size.values()), CLEAR)
        content = {p for p, f in ratio.items() if f >= limit or marks[p] >= SENTENCE_MARKS * count[p]}
        kept = [any(p in content for p, t, *_ in block if not t.isspace()) for block in self.blocks]
        inside = [any(named for _, _, named, _ in block) for block in self.blocks]
        held = [sum(len(t) for _, t, *_ in block) * k for block, k in zip(self.blocks, kept)]
        if sum(n for n, i in zip(held, inside) if i) >= NAMED_SHARE * sum(held):
            kept = [k and i for k, i in zip(kept, inside)]
        else:
            inside = [True] * len(kept)
        ranks = [min((rank for *_, rank in block if rank), default=0) for block in self.blocks]
        reach = 0  # a heading of a rank below this is followed by content of its own
        if any(k and not rank for k, rank in zip(kept, ranks)):  # else the headings are all there is
            for k in range(len(kept) - 1, -1, -1):
                if ranks[k]:
                    kept[k] = inside[k] and ranks[k] < reach
                    reach = min(reach, ranks[k])
                elif kept[k]:
                    reach = 7
        out = []
        for block, k in zip(self.blocks, kept):
            said = " ".join("".join(t for _, t, *_ in block).split())
            if k and said:
                out.append(said)
        return out


def smooth(x: list[float]) -> list[float]:
    """Binomial weights 1 2 1 along the page; the ends lean on themselves."""
    return [(x[max(i - 1, 0)] + 2 * v + x[min(i + 1, len(x) - 1)]) / 4 for i, v in enumerate(x)]


def main_text(html: str | None) -> str:
    return "\n".join(Page(html).content()) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(documents(spark, sf_dir, "pages"))
