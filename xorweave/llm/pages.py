"""Main text of web pages by two-pass block rules.

Blocks are what stands between block-level tags. Blocks inside a navigation, header, footer, aside,
form or similar element, or inside one whose class or id says so, are boilerplate from the start;
an <article> or <main> inside starts afresh, and wrappers that hold most of the text don't count.
Pass 1 calls all others good, bad, near-good or short by length, link density and stop-word density;
to stand inside an <article> or <main> element is one more feature, which raises a block by a step. Blocks of it
that are nothing but a link count as short between its paragraphs and in lists that hold other items, else as bad.
Pass 2 gives near-good and short blocks the label of the nearest decided block, nearest by the inner
element that holds both and then by blocks; page edges and boilerplate elements don't count.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style noscript template svg math iframe object textarea select title head".split())
AWAY = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset(("article", "main"))
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Class, id or role words that mark boilerplate; those of FIRM say so of an <article> inside as well.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer header menu nav navbar navigation newsletter notice pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe widget complementary contentinfo".split()
)
#: Those of reader comments.
READER = frozenset("comment comments commentlist disqus respond".split())
FIRM = frozenset("comment comments commentlist disqus respond related sidebar footer menu nav navbar navigation complementary contentinfo".split())
#: Words that may stand beside them in a hyphenated name (site-footer, cookie-box).
BESIDE = frozenset("site page global main top bottom left right primary secondary inner outer box block bar list links area container wrapper wrap section item items message text form button buttons icons".split())
#: Those that say so as the last part of any hyphenated name (user-comments, gdpr-consent), and as the first of any (ad-slot), unless
#: a word of UNLESS stands in the name (with-sidebar, no-comments).
LAST = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus nav navbar navigation newsletter pagination popup promo sharing sidebar sponsored subscribe".split())
FRONT = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus navbar newsletter pagination popup promo sponsor sponsored subscribe".split())
UNLESS = frozenset("with without no not non has have is hide hidden open closed off free enabled disabled".split())
#: Frequent function words of the languages of the pages.
STOP = frozenset(
    "the of and to in a is that for it with as was on by this are be from or at an not have has der die das und in den von zu mit ist des dem ein eine nicht auch für auf als le la les des et de un une du est que qui dans en pour pas au sur ce el los las y del que se un una por con para es al lo como".split()
)
SPACE = re.compile(r"\s+")
#: What the copyright line of a footer holds.
FOOTER = re.compile(r"^\W*(?:copyright\b|\xa9|&copy)|\xa9\s*(?:copyright\s*)?\d{4}|\ball rights reserved\b", re.I)
#: Pass 1: characters of a short block; link density of a bad one; length and stop-word density of a good one;
#: link density of a block of the main element that is nothing but links.
SHORT, LINKS, LONG, STOP_LOW, STOP_HIGH, LINKS_ONLY = 70, 0.33, 200, 0.15, 0.30, 0.9


class Block:
    """``low`` is the least depth of open elements since the block before; ``head``: a heading; ``item``: of a list."""

    __slots__ = ("text", "linked", "mark", "away", "main", "low", "head", "item", "label")

    def __init__(self, text: str, linked: int, mark: int, main: bool, low: int, head: bool, item: bool) -> None:
        self.text, self.linked, self.mark, self.away, self.main, self.low, self.head, self.item, self.label = text, linked, mark, False, main, low, head, item, ""


class Mark:
    """An <article> or <main> element, or an unwanted one; the first stands for the page. ``kind``: tag
    (a closed <nav> and the like), reader, firm or soft (by a class, a <form>, or never closed), or empty."""

    __slots__ = ("parent", "main", "kind", "away", "text", "free")

    def __init__(self, parent: int, main: bool, kind: str) -> None:
        self.parent, self.main, self.kind, self.away, self.text, self.free = parent, main, kind, False, 0, 0


@functools.lru_cache(10_000)
def class_kind(said: str, heading: bool) -> str:
    """reader, firm, soft or empty: what the class, id and role say of an element. A name counts as a whole, or by its last
    or first part: with-sidebar, entry-header and related-work say nothing. ``heading``: header and banner say nothing."""
    kind = ""
    for name in re.sub("(?<=[a-z])(?=[A-Z])", "-", said).lower().split():
        parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
        of = UNWANTED.intersection(parts)
        if not of or heading and of <= {"header", "banner"}:
            continue
        if not all(x in UNWANTED or x in BESIDE for x in parts):
            of = {x for x, said_by in ((parts[-1], LAST), (parts[0], FRONT)) if x in said_by and not UNLESS.intersection(parts)}
        if not of:
            continue
        if of & READER:
            return "reader"
        if of & FIRM:
            kind = "firm"
        kind = kind or "soft"
    return kind


def settle(found: list[Block], marks: list[Mark]) -> None:
    """Sets which blocks are boilerplate by their elements.

    An <article> or <main> starts afresh, unless it stands in a tag or firm element and there is main
    text elsewhere (comments, teasers). A firm or soft element whose text, but for what starts afresh, is
    most of the unlinked text of the page or of the <article> around it is no boilerplate; reader comments
    are, if there is main text elsewhere.
    """
    own = [len(b.text) - b.linked for b in found]
    inside = [False] * len(marks)
    for i, m in enumerate(marks[1:], 1):
        inside[i] = m.kind in ("tag", "firm", "reader") or inside[m.parent]
    elsewhere = sum(n for n, b in zip(own, found, strict=True) if b.main and not inside[b.mark]) >= LONG

    def down() -> None:
        for i, m in enumerate(marks[1:], 1):
            m.away = bool(m.kind) or marks[m.parent].away and not (m.main and not (elsewhere and inside[i]))

    down()
    for n, b in zip(own, found, strict=True):
        marks[b.mark].text += n
        marks[b.mark].free += 0 if marks[b.mark].away else n
    for m in marks[:0:-1]:
        marks[m.parent].text += m.text
        marks[m.parent].free += m.free
    hosts = [0] * len(marks)  # of each, the <article> around it that counts, or the page
    for i, m in enumerate(marks[1:], 1):
        over = marks[m.parent]
        hosts[i] = m.parent if over.main and not over.away else hosts[m.parent]
        if m.kind in (("firm", "soft") if elsewhere else ("firm", "soft", "reader")) and m.text - m.free >= SHORT:
            around, gain = marks[hosts[i]], m.text - m.free
            if 2 * gain > around.text and gain > 3 * around.free:
                m.kind = ""
    down()
    for b in found:
        b.away = marks[b.mark].away


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order, white space made single, character references decoded."""
    page = page or ""
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, the mark around each that is marked, else -1, and if it is main
    opened: Counter = Counter()  # how many of a name are open
    ends: set[str] = set()  # what isn't found any more from here on: end tags of raw elements, ]]>, >
    marks = [Mark(-1, False, "")]
    mark = main = links = heads = low = 0
    at = 0

    def close() -> None:
        nonlocal low
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            out.append(Block(text, len(SPACE.sub(" ", html.unescape("".join(linked))).strip()), mark, main > 0, low, heads > 0, opened["li"] > 0))
            low = len(stack)
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                linked.append(text)

    def leave(k: int, closed: bool) -> None:
        """Ends the open elements from the k-th on; only the k-th is ``closed``, if any."""
        nonlocal mark, main, links, heads, low
        for i in range(len(stack) - 1, k - 1, -1):
            tag, around, is_main = stack[i]
            opened[tag] -= 1
            if around >= 0:
                if marks[mark].kind == "tag" and not (closed and i == k):
                    marks[mark].kind = "soft"
                mark = around
            main -= is_main
            links -= tag == "a"
            heads -= tag in HEADS
        del stack[k:]
        low = min(low, len(stack))

    def after(text: str, start: int) -> int:
        """Where the next ``text`` ends, or -1; looked for once only if there is none."""
        k = -1 if text in ends else page.find(text, start)
        if k < 0:
            ends.add(text)
        return k + len(text) if k >= 0 else -1

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0] == "<![CDATA[":
                to = after("]]>", at)
                at = to if to >= 0 else max(at, after(">", at))
            continue
        if name in RAW and not m[1]:
            end = None if name in ends else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                ends.add(name)
            if name != "head" or end is None:
                close() if name in BLOCK else None
                at = end.end() if end else (len(page) if name in ("script", "style") else at)
                continue
        if name in BLOCK:
            close()
        if m[1]:
            for k in range(len(stack) - 1 if opened[name] else -1, -1, -1):
                if stack[k][0] == name:
                    leave(k, True)
                    break
        elif name not in VOID and not (m[0].endswith("/>") and name not in BLOCK):
            if name == "p" and stack and stack[-1][0] == "p":
                leave(len(stack) - 1, True)
            said = " ".join(x or y or z for _, x, y, z in ATTRIBUTE.findall(m[3])) if m[3] else ""
            kind = "soft" if name == "form" else "tag" if name in AWAY and not (name == "header" and main) else ""
            if not kind and said and name not in ("html", "body"):
                kind = (class_kind if len(said) < 1000 else class_kind.__wrapped__)(said, name in HEADS or main > 0)
            is_main = name in MAIN and kind != "reader"
            if is_main:
                kind = ""
            around = -1
            if kind or is_main:
                marks.append(Mark(mark, is_main, kind))
                around, mark = mark, len(marks) - 1
            stack.append((name, around, is_main))
            opened[name] += 1
            main += is_main
            links += name == "a"
            heads += name in HEADS
    add(page[at:])
    close()
    leave(0, False)
    settle(out, marks)
    return out


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP for w in words) / len(words)


def first_pass(b: Block, known: bool) -> str:
    """good, bad, neargood, short, or linked: nothing but a link, in the main element. ``known``: the page's language is one that STOP covers; if not,
    stop-word density says nothing, and length and links decide alone."""
    n = len(b.text)
    density = b.linked / n
    if b.away or n < LONG and not b.main and FOOTER.search(b.text):
        return "bad"
    stop = stop_share(b.text) if n >= SHORT else 0.0
    if density > LINKS:
        # inside the main element headings, sentences and blocks with text of their own are left to their neighbours
        return "bad" if not b.main else "short" if b.head or density <= LINKS_ONLY else "linked"
    if n < SHORT:
        return "short"
    if not known or stop >= STOP_HIGH:
        return "good" if n > LONG or b.main else "neargood"
    if stop >= STOP_LOW:
        return "good" if n > LONG and b.main else "neargood"
    return "neargood" if b.main else "short" if n < LONG or not b.linked else "bad"


def neighbours(found: list[Block], labels: list[str]) -> list[tuple]:
    """Per block the nearest decided blocks before and after it: (label, depth of the innermost element
    that holds both, blocks between), or None. Blocks in boilerplate elements are passed over."""

    def scan(order: Iterable[int], step: int) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(found)
        label, depth, gap = "", 0, 0
        for i in order:
            if label:
                depth = min(depth, found[i if step > 0 else i + 1].low)
                out[i] = (label, depth, gap)
            if not found[i].away:
                gap += 1
                if labels[i] in ("good", "bad"):
                    label, depth, gap = labels[i], 1 << 30, 0
        return out

    ahead = scan(range(len(found) - 1, -1, -1), -1)
    return list(zip(scan(range(len(found)), 1), ahead, strict=True))


def settle_linked(found: list[Block], labels: list[str]) -> None:
    """What is nothing but a link in a main element is short where text of the element stands before and after it, or if half of its list
    isn't of this kind; else it is bad."""
    ends: dict[int, tuple[int, int]] = {}
    for i, (b, own) in enumerate(zip(found, labels, strict=True)):
        if own in ("good", "neargood") and b.main:
            ends[b.mark] = (ends.get(b.mark, (i, i))[0], i)
    of_list, at = {}, 0
    while at < len(found):
        end = at + 1
        if found[at].item:
            while end < len(found) and found[end].item and found[end].mark == found[at].mark:
                end += 1
            linked = sum(x == "linked" for x in labels[at:end])
            of_list.update(dict.fromkeys(range(at, end), 2 * linked <= end - at))
        at = end
    for i, b in enumerate(found):
        if labels[i] == "linked":
            first, last = ends.get(b.mark, (i, i))
            labels[i] = "short" if first < i < last or of_list.get(i) else "bad"


def classify(found: list[Block]) -> None:
    """Sets the label of each block to good or bad."""
    prose = [b for b in found if not b.away and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    known = any(stop_share(b.text) >= STOP_LOW for b in prose)
    decided = [first_pass(b, known) for b in found]
    settle_linked(found, decided)
    labels = list(decided)
    for i, sides in enumerate(neighbours(found, decided)):
        if decided[i] == "neargood":
            labels[i] = "bad" if all(x and x[0] == "bad" for x in sides) and "good" in decided and not found[i].main else "good"
    decided = labels
    for b, own, (before, after) in zip(found, decided, neighbours(found, decided), strict=True):
        b.label = own
        if own == "short":
            if before and after and before[0] != after[0]:
                # the one in the same inner element; else what follows a heading, the text beside plain text, the nearer one
                near = lambda x: (x[1], b.head and x is after, not b.linked and x[0] == "good", -x[2], x[0] == "good")
                b.label = max(before, after, key=near)[0]
            else:
                b.label = (before or after or ("good",))[0]


def main_text(page: str | None) -> str:
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, *, keep: tuple = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per row: the columns ``keep``, text, n_chars. Null and empty pages give an empty text; repeated
    rows give equal texts; other columns are ignored."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(main_text)

    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    rows = pages.select(*kept, text_of(F.col(html_col)).alias("text"))
    return rows.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
