"""Main text of web pages as the maximum-scoring run of their words and tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

#: A tag ends at the first > outside quotes, or at the first one if its quotes don't match; neither part runs past another <, so that a page is read in linear time.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^<>"'])*+)>|<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+["']?true""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")

#: Elements whose content is no text of the page; the only ones left out without a score (fixed values).
RAW_TAGS = {"script", "style", "textarea", "noscript", "template", "svg", "title", "iframe", "select", "head", "audio", "video", "canvas", "object"}
_OPAQUE = {name: re.compile(rf"</{name}\b[^<>]*+>", re.I) for name in RAW_TAGS - {"head"}}

#: Before any page is seen: elements and words of class, id or role whose words are hardly main text, and those of which that holds for short ones (fixed values).
CHROME = {
    "nav", "footer", "aside", "dialog", "menu", "button", "hidden", "ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "masthead", "modal", "navbar", "navigation", "newsletter", "popup", "replies", "responses", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar",
}
PERHAPS = {"form", "header", "alert", "banner", "login", "notice", "notices", "promo", "related", "search", "share", "sharing", "social", "widget"}
COMMENTS = {"comment", "comments", "disqus", "replies", "responses"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li",
    "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "li", "td", "th"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE_TAGS = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "td", "th", "time", "u"}
LABEL_TAGS = {"article", "main"}
TABLE_TAGS = {"tbody", "td", "tfoot", "th", "thead", "tr"}
KNOWN_TAGS = BLOCK_TAGS | VOID_TAGS | INLINE_TAGS

#: Chance that a word or tag is main text before any page is seen, and the words or tags that this counts for.
PRIOR = {"chrome": 0.01, "perhaps": 0.65, "word": 1.0, "inline": 0.9, "text": 0.98, "block": 0.5}
PRIOR_ROWS = 20
#: Words that a tag which is never main text weighs against; a word of an element that is never main text; a tag inside a marked article.
TAG_WORDS, LEAST_WORD, INSIDE = 12.0, 0.001, 0.01


@dataclass
class Scores:
    """marks: of elements and class words, the part of a word's score that words in them keep; tags: the score of each tag, not positive."""

    marks: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def mark(self, name: str) -> float:
        known = self.marks.get(name)
        return _kept(_prior_of(name)) if known is None else known

    def tag(self, name: str) -> float:
        known = self.tags.get(name)
        return -TAG_WORDS * (1 - _prior_of_tag(name)) if known is None else known


def _prior_of(mark: str) -> float:
    return PRIOR["chrome" if mark in CHROME else "perhaps" if mark in PERHAPS else "word"]


def _prior_of_tag(name: str) -> float:
    return PRIOR["text" if name in TEXT_TAGS else "block" if name in BLOCK_TAGS else "inline"]


def _kept(chance: float) -> float:
    return max(LEAST_WORD, 2 * chance - 1)


def _marks(name: str, attributes: str) -> list[str]:
    """What an element's name and attributes say: chrome elements' names, class words and their parts, hidden.  "x-free" says nothing of x."""
    out = [name] if name in CHROME or name in PERHAPS else []
    if attributes:
        for _, *said in _ATTRIBUTE.findall(attributes):
            for word in "".join(said).lower().split():
                parts = _PARTS.findall(word)
                out += [word] if len(parts) < 2 or parts[-1] == "free" else [word, *(p for p in parts if p in CHROME or p in PERHAPS)]
        if name in TEXT_TAGS:
            out = [m for m in out if m not in PERHAPS]  # a paragraph is no widget
        if _HIDDEN.search(attributes):
            out.append("hidden")
    return out


@dataclass(slots=True)
class Element:
    name: str
    marks: list[str]
    label: bool
    at: int
    total: float = 0.0
    word: float = 1.0
    in_label: bool = False
    marked: bool = False
    words: int = 0
    paragraphs: int = 0


def tokens(page: str) -> Iterator[tuple[str, str, object]]:
    """``open, name, attributes``, ``close, name, None`` and ``text, "", words`` of a page in order; comments, declarations and the content of RAW_TAGS are skipped."""
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        cut = page.find("<", at)
        if cut < 0 or cut > last:
            yield "text", "", page[at:]
            return
        if cut > at:
            yield "text", "", page[at:cut]
        if page.startswith("<!--", cut):
            end = page.find("-->", cut + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), cut):
            at = page.find(">", cut) + 1
            continue
        m = _TAG.match(page, cut)
        if not m:
            yield "text", "", "<"
            at = cut + 1
            continue
        at = m.end()
        shut, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        name = name.lower()
        if shut:
            yield "close", name, None
        elif name in _OPAQUE:
            end = _OPAQUE[name].search(page, at)
            at = end.end() if end else size
        else:
            yield "open", name, attributes


class _Tree:
    """The open elements while tokens go by, with ends that a page leaves out."""

    def __init__(self, scores: Scores, has_label: bool):
        self.scores, self.has_label = scores, has_label
        self.open: list[Element] = []
        self.count: Counter = Counter()

    def push(self, name: str, attributes: str, at: int) -> Element:
        top = self.open[-1] if self.open else None
        marks = _marks(name, attributes)
        of_comments = any(m in COMMENTS for m in marks) or top is not None and "comments" in top.marks
        label = name in LABEL_TAGS and not of_comments
        e = Element(name, marks, label, at)
        if of_comments and "comments" not in marks:
            e.marks = [*marks, "comments"]  # what reader comments hold is of them
        e.in_label = label or top is not None and top.in_label
        if name == "header" and e.in_label:
            e.marks = [m for m in e.marks if m != "header"]
        own = min([1.0, *map(self.scores.mark, e.marks)])
        e.marked = own < 1 and not label
        outer = (1.0 if self.has_label is False else LEAST_WORD) if top is None else top.word
        e.word = (1.0 if label and not (top is not None and top.in_label) else outer) * (1.0 if label else own)
        self.open.append(e)
        self.count[name] += 1
        return e

    def pop(self, name: str) -> Iterator[Element]:
        """Close the innermost element of this name and all in it."""
        if self.count[name]:
            while True:
                e = self.open.pop()
                self.count[e.name] -= 1
                yield e
                if e.name == name:
                    return

    def step(self, kind: str, name: str, said: object) -> None:
        if kind == "close":
            for _ in self.pop(name):
                pass
        elif kind == "open":
            if ended := self.implied(name):
                for _ in self.pop(ended):
                    pass
            if name not in VOID_TAGS:
                self.push(name, said, 0)

    def implied(self, name: str) -> str:
        """The innermost element that this one's start ends."""
        if name in BLOCK_TAGS and name != "html" and self.count["head"]:
            return "head"
        if name in BLOCK_TAGS and self.count["p"]:
            return "p"
        if name == "li" and self.count["li"]:
            for e in reversed(self.open[-64:]):
                if e.name in ("ul", "ol", "menu"):
                    return ""
                if e.name == "li":
                    return "li"
        return ""


def _scored(found: list[tuple[str, str, object]], scores: Scores) -> tuple[list[float], list[bool]]:
    """Each token's score, and whether it lies in an element that falls out: a marked one whose words don't outweigh its tags."""
    has_label = _marks_article(found)
    tree, score, fallen = _Tree(scores, has_label), [], []
    gap = 0.0 if has_label else 2 * scores.tag("div")  # what fell out still parts what is beside it, but within a block that has paragraphs of its own

    def close(e: Element, end: int) -> None:
        above = tree.open[-1] if tree.open else None
        gone = e.marked and e.total <= 0 or e.name == "head"
        if gone:
            fallen.append((e.at, end, above))
            e.total = gap
        if above:
            above.total += e.total
            if e.name not in BLOCK_TAGS and not gone:
                above.words += e.words
            above.paragraphs += e.name in TEXT_TAGS and e.words > 0 and not gone

    def tag(name: str) -> float:
        top = tree.open[-1] if tree.open else None
        if not has_label and name in TABLE_TAGS and tree.count["table"]:
            return 0.0  # a table costs once, whatever its rows
        return scores.tag(name) * (INSIDE if top and top.in_label and top.word > 2 * LEAST_WORD else 1.0)

    for k, (kind, name, said) in enumerate(found):
        top = tree.open[-1] if tree.open else None
        if kind == "text":
            value = len(said.split()) * (top.word if top else LEAST_WORD if has_label else 1.0)
            if top:
                top.total += value
                top.words += len(said.split())
        elif kind == "open":
            if ended := tree.implied(name):
                for e in tree.pop(ended):
                    close(e, k)
            if name in VOID_TAGS:
                value = tag(name)
            else:
                e = tree.push(name, said, k)
                value = tag(name)
                e.total += value - (TAG_WORDS if e.marked and name in BLOCK_TAGS and name not in TEXT_TAGS else 0.0)  # a container marked as something else
        else:
            value = tag(name)
            for e in tree.pop(name):
                e.total += value if e.name == name else 0.0
                close(e, k + 1)
        score.append(value)
    while tree.open:
        close(tree.open.pop(), len(found))
    out, until = [False] * len(found), 0
    for lo, hi, above in sorted(fallen, key=lambda f: f[:2]):
        if hi > until:
            lo = max(lo, until)
            out[lo:hi] = [True] * (hi - lo)
            score[lo:hi] = [0.0 if above is not None and above.paragraphs > 1 else gap] + [0.0] * (hi - lo - 1)
            until = hi
    return score, out


def _marks_article(found: list[tuple[str, str, object]]) -> bool:
    """Does the page mark an article with words, other than a reader comment's?"""
    if not any(name in LABEL_TAGS for _, name, _ in found):
        return False
    tree = _Tree(Scores(), None)
    for kind, name, said in found:
        tree.step(kind, name, said)
        if kind == "text" and tree.open and tree.open[-1].in_label and said.strip():
            return True
    return False


def main_text(page: str, scores: Scores | None = None) -> str:
    """The blocks of the best run of tokens, joined by \n; of equal runs the first and longest."""
    found = list(tokens(page))
    score, out = _scored(found, scores or Scores())
    start = 0
    top = total = 0.0
    first = last = -1
    for k, value in enumerate(score):
        if total <= 0 and value > 0:
            total, start = 0.0, k
        total += value
        if value > 0 and total >= top:
            top, first, last = total, start, k
    blocks: list[str] = []
    here: list[str] = []
    for k in range(first, last + 1) if first >= 0 else ():
        kind, name, text = found[k]
        if kind == "text":
            if not out[k]:
                here.append(text)
        elif name in BLOCK_TAGS:
            blocks.append("".join(here))
            here = []
        elif name == "br" or name in ("td", "th"):
            here.append(" ")
    blocks.append("".join(here))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by mark and tags by name, inside and outside the article of pages that mark one."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0):
            found = list(tokens(page.as_py() or ""))
            if not _marks_article(found):
                continue
            tree = _Tree(Scores(), True)
            for kind, name, said in found:
                tree.step(kind, name, said)
                if kind == "text":
                    if tree.open and (n := len(said.split())):
                        to = inside if tree.open[-1].in_label else outside
                        for mark in {m for e in tree.open if not e.label for m in e.marks}:
                            to["mark " + mark] += n
                elif kind == "open" and name not in LABEL_TAGS:
                    (inside if tree.open and tree.open[-1].in_label else outside)["tag " + name] += 1
    keys = list(inside | outside)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["key", "inside", "outside"])


def learned_scores(pages: DataFrame, html_col: str = "html", most_keys: int = 20_000) -> Scores:
    """Scores from the pages that mark their article.

    A tag scores the negative of its chance to lie outside, as TAG_WORDS words.
    A word scores 1 times what its elements' marks (names such as nav, and words
    of class, id and role) keep: twice the chance that words in them are main
    text, less one.  The ``most_keys`` most frequent tags and marks come to the
    driver.  Without labelled pages the prior stands.
    """
    counts = pages.select(F.col(html_col)).mapInArrow(_label_counts, "key string, inside bigint, outside bigint").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    out = Scores()
    for key, i, o in counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(most_keys).collect():
        kind, name = key.split(" ", 1)
        prior = _prior_of(name) if kind == "mark" else _prior_of_tag(name)
        chance = (i + prior * PRIOR_ROWS) / (i + o + PRIOR_ROWS)
        if kind == "mark":
            out.marks[name] = _kept(chance)
        elif name in KNOWN_TAGS:
            out.tags[name] = -TAG_WORDS * (1 - chance)
    return out


def extract(pages: DataFrame, scores: Scores | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: ``page_id, url, text``.

    Words score positive and tags negative, with weights learned from labelled
    pages (``learned_scores``, from these pages unless given); a linear scan
    finds the best run.  Words of menus, footers, comments and the like keep
    little of their score, so such elements fall out where their tags outweigh
    them; where a page marks an article, so do words outside it.  A line break
    (br) is white space.  A null or empty page has an empty text, as has one
    whose words never outweigh its tags; of equal runs the first and longest
    counts; an empty table gives no rows; a null id or url stays null; repeated
    rows are each extracted; other columns, whatever their names, aren't read.
    """
    small_batches(pages.sparkSession)
    scores = learned_scores(pages, html_col) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                part = whole.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(x.as_py() or "", scores) for x in part.column(2)], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id bigint, url string, text string")
