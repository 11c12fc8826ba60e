"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of word and tag tokens. A word scores by the kind of block it stands in, a tag by its name, with
weights learnt from labelled pages: log-odds of standing in the main text against outside, which come out positive for
words of running text and negative for tags. One linear scan finds the contiguous run of the largest sum; that run is
the main text, less the elements within it that are boilerplate by their name (forms, adverts, comments and the like).

Labelled pages are those that mark their main text themselves (article, main or role=main). A mark is a feature of words
and tags on pages that have one ("*" within, "-" outside), so the run follows the mark by its weights; the plain kinds
serve pages without marks.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.session import ship

#: Labelled pages that weights are learnt from at most, by hash of the id: the documented bound of the sample.
SAMPLE_PAGES = 500
#: Characters of a sampled page's html up to which it may serve as a labelled page.
SAMPLE_CHARS = 100_000
#: Score of an element of named boilerplate within a run, and of the end of an element that marks a main text.
OUTSIDE_COST, END_COST, ENDS = -2.0, -12.0, frozenset(("/article", "/main"))
#: Share of a page's words from which an element named like boilerplate is a wrapper of the page.
WRAPPER = 0.6

# Element names of the HTML standard by their role here.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("template svg math object canvas select button datalist audio video".split())
#: Hidden elements that hold no blocks: a block's tag ends them.
PHRASING = frozenset("svg math select button datalist".split())
OUTSIDE = frozenset("nav footer aside menu dialog".split())
OUTSIDE_UNLESS_WRAPPER = frozenset("form header".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation contentinfo complementary menu menubar".split())
ROLES_UNLESS_WRAPPER = frozenset("banner search dialog alert alertdialog toolbar form".split())
#: Open elements that a start tag ends, as their end tags may be left out, and elements that they are not looked for beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: A block's start tag ends an open p, unless one of these is open within it.
P_SCOPE = frozenset("table td th caption object template button".split())
# Words that name boilerplate in a class, id or role: always, and where the element is no wrapper of the page.
ADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
ALWAYS = ADS | frozenset("comment comments commentlist respond replies disqus related recommended".split())
UNLESS_WRAPPER = frozenset(
    "banner cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets "
    "header masthead footer share sharing social pagination pager search toolbar promo".split()
)
NAMES = ALWAYS | UNLESS_WRAPPER
#: Words that may follow such a word in a name, and words that make a name speak of the page's state.
FOLLOWING = frozenset("area bar block bottom box button buttons container icons inner item items left links list message panel right section slot top unit wrap wrapper".split())
STATES = frozenset("has with no without is not non show hide shows hides".split())

PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)\s*(/?)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NEXT = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")


@dataclass
class Block:
    """Text between two block boundaries, with what encloses it."""

    text: str
    inner: str  # innermost block element
    outside: int  # number of the boilerplate element around it, 0 in the main flow
    mark: str  # on a page that marks its main text "*" within and "-" outside, else empty
    words: int
    linked: int
    tags: list[str]

    @property
    def kind(self) -> str:
        """What its words score by: the innermost block element, and whether most words are links."""
        return self.inner + ("+link" if 2 * self.linked > self.words else "")


def named(token: str) -> str:
    """The word of boilerplate that a class or id ends in, or starts with if nothing of substance follows; else empty."""
    parts = [p.lower() for p in NAME_PARTS.findall(token)]
    if not parts or parts[0] in STATES:
        return ""
    word = parts[-1] if parts[-1] in NAMES else parts[0] if parts[0] in NAMES and all(p in NAMES or p in FOLLOWING or p.isdigit() for p in parts[1:]) else ""
    return word if word not in UNLESS_WRAPPER or parts[0] not in ALWAYS else parts[0]


class _Scanner:
    """Tags of a page by plain searches; every character is passed over a fixed number of times, broken mark-up or not."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.closes: dict[str, list[int]] = {}

    def tag_end(self, at: int) -> int:
        """Just behind the tag that starts at at; -1 if no ">" follows. Quotes count after "=", unless they never end."""
        if at > self.last:
            return -1
        pos = at
        while self.quotes:
            m = NEXT.search(self.page, pos)
            if m and not m[1]:
                return m.end()
            pos = self.page.find(m[1], m.end()) + 1 if m else 0
            if not pos:
                self.quotes = False
        return self.page.find(">", at) + 1

    def close_of(self, name: str, at: int) -> int:
        """Where the next end tag of name starts; -1 if there is none."""
        if name not in self.closes:
            self.closes[name] = [m.start() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])", self.page, re.I)][::-1]
        left = self.closes[name]
        while left and left[-1] < at:
            left.pop()
        return left[-1] if left else -1


@dataclass
class _Open:
    """An open element with what it hands on to those within it. flag, header: numbers of boilerplate elements."""

    name: str = ""
    block: bool = True
    inner: str = "body"
    flag: int = 0
    hidden: bool = False
    marked: bool = False
    header: int = -1  # within the main text's own header: the flag around that


class _Page:
    """Reads a page into blocks. Time and memory are linear in the page, however deep it is nested."""

    def __init__(self, page: str) -> None:
        self.page, self.scan = page, _Scanner(page)
        self.blocks: list[Block] = []
        self.flags: list[int] = []  # of each block
        self.boilerplate: list[tuple[int, bool]] = [(0, False)]  # of each such element: the one around it, whether always
        self.stack = [_Open()]
        self.where: dict[str, list[int]] = defaultdict(list)  # places in the stack by name, and those of blocks
        self.block_at = [0]
        self.parts: list[str] = []
        self.tags: list[str] = []
        self.linked, self.link_depth = 0, -1

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                top = self.stack[-1]
                self.flags.append(top.header if top.header >= 0 and top.inner in HEADINGS else top.flag)
                self.blocks.append(Block(text, top.inner, 0, "*" if top.marked else "-", text.count(" ") + 1, self.linked, self.tags))
                self.tags = []
        self.linked = 0

    def cut(self, upto: int) -> None:
        while len(self.stack) > upto:
            e = self.stack.pop()
            self.where[e.name].pop()
            if e.block:
                self.block_at.pop()
        if self.link_depth > len(self.stack):
            self.link_depth = -1

    def last(self, names) -> int:
        return max((self.where[n][-1] for n in names if self.where[n]), default=-1)

    def text(self, text: str) -> None:
        if not self.stack[-1].hidden:
            text = htmllib.unescape(text)
            self.parts.append(text)
            if self.link_depth >= 0:
                self.linked += len(text.split())

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        self.tags.append("/" + name)
        if name == "a":
            self.link_depth = -1
        if self.where[name]:
            i = self.where[name][-1]
            if name in BLOCKS or name in HIDDEN or self.block_at[-1] <= i:
                self.cut(i)

    def imply(self, name: str) -> None:
        """End the open elements that a block's start tag ends."""
        self.flush()
        for ends, barrier in ((PHRASING, BLOCKS), ({"p"}, P_SCOPE), IMPLIED.get(name, ((), ()))):
            i = self.last(ends)
            if i >= 0 and i > (self.block_at[-1] if barrier is BLOCKS else self.last(barrier)):
                self.cut(i)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.cut(len(self.stack) - 1)

    def start(self, name: str, attributes: str, at: int, alone: bool) -> None:
        block = name in BLOCKS
        if block:
            self.imply(name)
        self.tags.append(name)
        if name in VOID or name in ("html", "body", "head"):
            return
        if name == "a":
            self.link_depth = len(self.stack)
        around = self.stack[-1]
        hidden = name in HIDDEN
        if hidden and (alone or self.scan.close_of(name, at) < 0):
            return  # never closed: hides nothing
        given = {k.lower(): htmllib.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        role = given.get("role", "").lower()
        hidden = hidden or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        names = {named(t) for t in f"{given.get('class', '')} {given.get('id', '')}".split()}
        mark = name in ("article", "main") or role == "main"
        if not block:
            hidden = hidden or bool(names & ADS)
            if hidden or around.hidden:  # other inline elements matter only where a line is to leave boilerplate out
                self.push(_Open(name, False, around.inner, around.flag, True, around.marked, around.header))
            return
        always = name in OUTSIDE or role in ROLES or bool(names & ALWAYS)
        unless = name in OUTSIDE_UNLESS_WRAPPER or role in ROLES_UNLESS_WRAPPER or bool(names & UNLESS_WRAPPER)
        flag, header = around.flag, around.header
        if mark and not (around.marked and names & ALWAYS):
            always = unless = False
            while not around.marked and flag and not self.boilerplate[flag][1]:
                flag = self.boilerplate[flag][0]  # a form or the like around the main text
        if always or unless:
            header = flag if around.marked and not always and (name == "header" or "header" in names) else -1
            self.boilerplate.append((flag, always or header >= 0))
            flag = len(self.boilerplate) - 1
        self.push(_Open(name, True, name, flag, hidden or around.hidden, mark or around.marked, header))

    def push(self, e: _Open) -> None:
        self.where[e.name].append(len(self.stack))
        if e.block:
            self.block_at.append(len(self.stack))
        self.stack.append(e)

    def read(self) -> list[Block]:
        page, scan, at, size = self.page, self.scan, 0, len(self.page)
        while at < size:
            lt = page.find("<", at)
            if lt != at:
                lt = lt if lt >= 0 else size
                self.text(page[at:lt])
                at = lt
                continue
            m = PLAIN_TAG.match(page, at)
            if m:
                at, ending, name, attributes, alone = m.end(), m[1] == "/", m[2].lower(), "", m[3] == "/"
            else:
                m = NAME.match(page, at)
                end = scan.tag_end(at) if m else -1
                if end < 0:
                    at = self.odd(at)
                    continue
                ending, name, attributes, alone = page[at + 1] == "/", m[1].lower(), page[m.end() : end - 1], page[end - 2] == "/"
                at = end
            if name == "br":
                self.text(" ")
                self.tags.append("br")
            elif ending:
                self.end(name)
            elif name in RAW:
                self.tags.append(name)
                end = scan.close_of(name, at)
                end = scan.tag_end(end) if end >= 0 else size
                at = end if end >= 0 else size
            else:
                self.start(name, attributes, at, alone)
        self.flush()
        self.judge()
        return self.blocks

    def odd(self, at: int) -> int:
        """Pass over a comment or declaration; any other "<" is text."""
        page, size = self.page, len(self.page)
        if page.startswith(("<!", "<?", "</"), at) and (page.startswith("<!--", at) or at <= self.scan.last):
            end, width = (page.find("-->", at + 4), 3) if page.startswith("<!--", at) else (page.find(">", at), 1)
            return end + width if end >= 0 else size
        self.text("<")
        return at + 1

    def judge(self) -> None:
        """Number the boilerplate around each block, less elements that wrap the page and marks on pages without one."""
        words = [0] * len(self.boilerplate)
        for b, f in zip(self.blocks, self.flags):
            words[f] += b.words
        for i in range(len(words) - 1, 0, -1):
            around, always = self.boilerplate[i]
            if not always:
                words[around] += words[i]
        number = [0] * len(words)
        for i, (around, always) in enumerate(self.boilerplate[1:], 1):
            number[i] = number[around] or (i if always or words[i] <= WRAPPER * words[0] else 0)
        marks = any(b.mark == "*" for b in self.blocks)
        for b, f in zip(self.blocks, self.flags):
            b.outside = number[f]
            b.mark = b.mark if marks else ""


def parse(page: str) -> list[Block]:
    """Blocks of a page in order; tags between two blocks belong to the later one. Never fails on broken mark-up."""
    return _Page(page).read()


Weights = dict[str, float]


def learn(pages: list[str]) -> Weights:
    """Log-odds of kinds of words and of tags, from pages that mark their main text; smoothed, and shifted so tags cost.

    Each counts with its mark, for pages that have one, and without, for pages that have none.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        for b in parse(page):
            if not b.mark:
                break
            to = inside if b.mark == "*" and not b.outside else outside
            for mark in ("", b.mark):
                if not b.outside:
                    to["w:" + b.kind + mark] += b.words
                for t in b.tags:
                    to["t:" + t + mark] += 1
    weights = {}
    for key in inside | outside:
        odds = math.log((inside[key] + 1.0) / (outside[key] + 1.0))
        weights[key] = min(max(odds, -3.0), 3.0) if key[0] == "w" else min(0.0, min(max(odds, -6.0), 6.0) / 8 - 0.25)
    return weights


def default_weight(key: str) -> float:
    """Of a kind of word or a tag that no labelled page has shown."""
    kind, mark = (key[2:-1], key[-1]) if key[-1] in "*-" else (key[2:], "")
    if key[0] == "w":
        return 1.0 if mark == "*" else -1.0 if mark == "-" or kind.endswith("+link") else 0.25 if kind in ("li", "td", "th", "dd", "dt", "div", "section", "body") else 1.0
    return -0.02 if mark == "*" else -0.5 if kind.removeprefix("/") in ("p", "br", "b", "i", "em", "strong", "span", *HEADINGS) else -1.0


def region(blocks: list[Block], weights: Weights) -> tuple[int, int]:
    """First and last (excluded) block of the maximum-scoring run; of equal sums the earliest, then the longest."""

    def weight(key: str) -> float:
        w = weights.get(key)
        return default_weight(key) if w is None else w

    best, best_at, total, start, before = 0.0, (0, 0), 0.0, 0, 0
    for i, b in enumerate(blocks):
        cost = sum(END_COST for t in b.tags if t in ENDS)
        if b.outside:  # an element that is left out costs as one tag
            value = 0.0 if b.outside == before else OUTSIDE_COST if b.mark != "*" else OUTSIDE_COST / 100
        else:
            value = b.words * weight("w:" + b.kind + b.mark)
            tags = sum(weight("t:" + t + b.mark) for t in b.tags)
            cost += max(tags, -0.5 * value) if b.mark == "*" else tags  # within a mark its tags alone end no run
        before = b.outside
        if total + cost <= 0:
            total, start, cost = 0.0, i, 0.0  # a run starts with a word, not with tags
        total += cost + value
        if total > best:
            best, best_at = total, (start, i + 1)
        if total <= 0:
            total, start = 0.0, i + 1
    return best_at


def extract(page: str | None, weights: Weights) -> str:
    """Main text: the maximum-scoring run's blocks without boilerplate, joined by blank lines; empty if there is none."""
    blocks = parse(page or "")
    start, end = region(blocks, weights)
    return "\n\n".join(b.text for b in blocks[start:end] if not b.outside)


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from at most SAMPLE_PAGES pages that mark their main text, by hash of the id and html."""
    page = F.col(html_col)
    labelled = df.select(F.col(id_col).alias("m_id"), page.alias("m_html")).where(page.rlike(r"(?i)<(?:article|main)[\s>]") & (F.length(page) <= SAMPLE_CHARS))
    mark = F.xxhash64("m_id", "m_html")
    picked = labelled.select("m_id", mark.alias("m_mark")).orderBy("m_mark", "m_id").limit(SAMPLE_PAGES).distinct()  # 16 bytes a row
    chosen = F.broadcast(picked.select(F.col("m_id").alias("c_id"), F.col("m_mark").alias("c_mark")))
    rows = labelled.join(chosen, F.col("m_id").eqNullSafe(F.col("c_id")) & (mark == F.col("c_mark")), "left_semi").select("m_html").distinct().limit(SAMPLE_PAGES).collect()
    return learn(sorted(r["m_html"] for r in rows))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page.

    Null and empty html give the empty text. Broken mark-up is read as browsers do: end tags may be missing, a comment,
    script or style that never ends takes the rest of the page, a "<" that begins no tag is text; an unclosed button,
    select, svg or object hides nothing. Pages may be of any length and depth. Repeated rows stay rows; an empty table gives an empty result; other
    columns do not matter, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(df, id_col, html_col))  # one number an element name

    @pandas_udf("string")
    def kernel(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p if isinstance(p, str) else None, shared.value) for p in pages], dtype=object)

    return df.select(F.col(id_col), F.col(url_col), kernel(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
