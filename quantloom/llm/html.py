"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides a block from its
place (menus, headers, footers, sidebars, forms, notices, adverts and comments are never
content), its link density, its length and its share of stop words. Short blocks without a
clear case stay open; the second pass gives them the label of the nearest decided
neighbours in the same part of the page, or, with none there, that of the part: an article
is content, the rest isn't.

Places are known by tags and by whole tokens of class, id and role: a token names a place
by its last word ("site-footer") or by its first before a word for a container
("comments-area"); tokens that tell what a page has or is ("has-sidebar", "tag-menu") name
none. An article is a named place only where a token makes it a comment, an advert or a
pointer to other pages; main, body and html are none. A form around most of a page's text, and
a part that only sounds like a menu, are wrappers and no places. Articles hold a page's text
where they hold more decided text than the rest; else they are teasers beside it. Stop words
decide where they can; in languages without any on the list, length and link density do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's tags by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head title button select textarea datalist".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags outside that can be wrappers of a whole page.
WRAPPERS = frozenset("form fieldset dialog".split())
#: Elements whose class names no place, and the names that an article can have.
NEVER_NAMED = frozenset("main body html".split())
#: Words in class, id and role that name parts which aren't content.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended share sharing social footer header masthead "
    "comment comments respond reply disqus login search searchbox toolbar tags legal copyright complementary contentinfo toc sphinxsidebar catlinks".split()
)
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments disqus promo recommended related reply respond sponsored".split())
#: Words for containers, after which the first word of a token names the place.
CONTAINERS = frozenset("area bar block blocks body box button buttons container content form group holder icons inner item items link links list panel posts section slot stories thread threads unit wrap wrapper".split())
#: Words for where on the page a part is, after its name.
POSITIONS = frozenset("bottom first left primary right second secondary top".split())
#: Words that tell what a page has, anywhere in a token, and first words of tokens for kinds of content.
TELLING = frozenset("has no not with without".split())
KINDS = frozenset("is are tag tags category cat type format status theme template js lang".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is it that for on as with by be at this are was from or an not have has but they his her which one you we all there their so if no "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei einer um am sind noch wie einem über so "
    "le la les de des du et un une est en que qui dans pour pas par sur au ce il elle avec plus ne se sont son sa ou mais comme aux nous vous "
    "el los las del y que se por con para una su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre".split()
)
LONG, SHORT = 140, 70
STOP_HIGH, STOP_LOW = 0.20, 0.12
LINK_HIGH = 0.35
NEUTRAL, GOOD, BAD = 0, 1, -1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[a-zA-Z/][^<>]*>|[^<]++|<""", re.DOTALL)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW_TAGS}
#: Words of a token: cut at capitals and at what isn't a letter.
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = re.compile(r"[.!?…。！？।؟]")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


def _names_outside(attrs: str, header_too: bool, known: frozenset[str] = OUTSIDE_WORDS) -> bool:
    """Whether a token of class, id or role names a part that isn't content, by the words known. A header inside an article holds its title."""
    for m in _ATTR.finditer(attrs):
        for token in next((g for g in m.groups() if g), "").split():
            words = [w.lower() for w in _NAME.findall(token)]
            if not words or not TELLING.isdisjoint(words) or (len(words) > 1 and words[0] in KINDS):
                continue
            if len(words) > 1 and words[-1] in POSITIONS and words[-2] in known and (len(words) == 2 or words[0] == "region"):
                words.pop()
            name = words[-1] if words[-1] in known else words[0] if len(words) > 1 and all(w in CONTAINERS for w in words[1:]) else ""
            if name in known and (header_too or name != "header"):
                return True
    return False


class _Part:
    """An open element: what it makes of the text in it."""

    __slots__ = ("article", "heading", "link", "lifted", "main", "over", "place", "skipped", "tag")

    def __init__(self, tag: str, above: _Part | None, attrs: str) -> None:
        self.tag = tag
        self.main = tag == "main" or (above is not None and above.main)
        self.article = tag == "article" or (above is not None and above.article)
        inside = above is not None and (above.main or above.article)
        by_tag = tag in OUTSIDE_TAGS and not (inside and tag == "header")
        by_name = "=" in attrs and tag not in NEVER_NAMED and _names_outside(attrs, not inside, ARTICLE_WORDS if tag == "article" else OUTSIDE_WORDS)
        #: The nearest part, itself included, that is never content, and the next one around it.
        self.over = above.place if above is not None else None
        self.place = self if by_tag or by_name else self.over
        #: Whether it can turn out to be a wrapper of the page, and whether it did.
        self.lifted = False
        self.skipped = tag in SKIPPED_TAGS or (above is not None and above.skipped) or bool(attrs and _HIDDEN.search(attrs))
        self.heading = tag in HEADINGS or (above is not None and above.heading)
        self.link = tag == "a" or (above is not None and above.link)


@dataclass
class Block:
    text: str
    #: Characters in links.
    linked: int
    #: Inside a main element, and inside an article.
    main: bool
    article: bool
    #: The nearest part around it that is never content.
    place: _Part | None = None
    heading: bool = False

    def outside(self) -> _Part | None:
        """The nearest part that is never content and no wrapper."""
        part = self.place
        while part is not None and part.lifted:
            part = part.over
        return part


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order. The work is linear in the page: no end tag is looked for that isn't open."""
    out: list[Block] = []
    open_parts: list[_Part] = []
    counts: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    state: tuple[bool, bool, _Part | None, bool] = (False, False, None, False)
    plain = lambda parts: _SPACE.sub(" ", unescape("".join(parts))).strip()

    def close_block() -> None:
        if text:
            joined = plain(text)
            if joined:
                out.append(Block(joined, min(len(plain(linked)), len(joined)) if linked else 0, *state))
            text.clear()
            linked.clear()

    def close(n: int) -> None:
        for part in open_parts[n:]:
            counts[part.tag] -= 1
        del open_parts[n:]

    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                top = open_parts[-1] if open_parts else None
                if top is None or not top.skipped:
                    now = (False, False, None, False) if top is None else (top.main, top.article, top.place, top.heading)
                    if now != state:
                        close_block()
                        state = now
                    text.append(raw)
                    if top is not None and top.link:
                        linked.append(raw)
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close_block()
        if m[1]:
            # An end tag closes what is open above its element; one without a start tag closes nothing.
            if counts[tag] > 0:
                i = len(open_parts) - 1
                while open_parts[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            for i in range(len(open_parts) - 1, max(len(open_parts) - 3, -1), -1):
                if open_parts[i].tag == tag:
                    close(i)
                    break
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        open_parts.append(_Part(tag, open_parts[-1] if open_parts else None, m[3]))
        counts[tag] += 1
    close_block()
    return out


def first_pass(block: Block) -> int:
    """GOOD, BAD or NEUTRAL from one block alone."""
    if block.outside() is not None:
        return BAD
    return by_words(block)


def by_words(block: Block) -> int:
    """The label of a block wherever it stands."""
    n = len(block.text)
    if block.linked > LINK_HIGH * n:
        return BAD
    if n < SHORT:
        return NEUTRAL
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if share >= STOP_HIGH or (n >= LONG and share >= STOP_LOW):
        return GOOD
    # Long prose without a single stop word is of a language that has none on the list.
    if n >= LONG and words and not share and _ENDS.search(block.text):
        return GOOD
    return NEUTRAL


def second_pass(page: list[Block], labels: list[int]) -> list[bool]:
    """Whether each block is content: open ones follow the nearest decided neighbours of their part of the page, headings the next one."""
    n = len(page)
    out = []
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, int] = {}
        for i in order:
            part = page[i].main or page[i].article or page[i].place is not page[i].outside()
            near[i] = last.get(part)
            # Parts that are never content say nothing about an article's own short blocks.
            if labels[i] != NEUTRAL and not (part and page[i].outside()):
                last[part] = i
    for i, label in enumerate(labels):
        if label == NEUTRAL:
            near = [j for j in (before[i], after[i]) if j is not None]
            if not near:
                label = GOOD if page[i].main or page[i].article else BAD
            elif page[i].heading:
                # A heading belongs to what follows.
                label = labels[near[-1]]
            else:
                signs = {labels[j] for j in near}
                label = signs.pop() if len(signs) == 1 else labels[min(near, key=lambda j: abs(j - i))]
        out.append(label == GOOD)
    return out


def _lift(page: list[Block]) -> None:
    """Mark the parts that are wrappers of the page.

    Forms (and the like) with decided text of their own, more than stands in no place at all,
    are: their menus and comments are places inside them. So are, on a page without any other
    text, parts that hold most of what stands in no other place by its tag.
    """
    own: dict[_Part, int] = {}
    free = decided = 0
    for b in page:
        part = b.outside()
        while part is not None and part.tag in WRAPPERS:
            if by_words(b) == GOOD:
                own[part] = own.get(part, 0) + len(b.text)
                decided += 1
            part = part.over
        if b.place is None:
            free += len(b.text)
    for part, n in own.items():
        part.lifted = n > free
    if decided and any(part.lifted for part in own):
        return
    if any(first_pass(b) != BAD for b in page):
        return
    size: dict[_Part, int] = {}
    total = 0
    for b in page:
        part = b.outside()
        if part is None or part.tag not in OUTSIDE_TAGS or part.tag in WRAPPERS:
            total += len(b.text)
            if part is not None:
                size[part] = size.get(part, 0) + len(b.text)
    for part, n in size.items():
        while part is not None and 2 * n > total and (part.tag not in OUTSIDE_TAGS or part.tag in WRAPPERS):
            part.lifted, part = True, part.over


def _within(page: list[Block], labels: list[int]) -> list[bool]:
    """Which blocks can be content, by main elements first and articles then.

    Where main elements hold half as much decided text as the rest, they hold all content. Of
    what is left articles do, if they hold as much as what lies outside of them; if they
    hold less, they point elsewhere and are none.
    """
    kept = [True] * len(page)
    for inside, share in (([b.main for b in page], 2), ([b.article for b in page], 1)):
        size = {True: 0, False: 0}
        some = {True: False, False: False}
        for b, label, has, k in zip(page, labels, inside, kept, strict=True):
            if k and label != BAD:
                size[has] += len(b.text) * (label == GOOD)
                some[has] = True
        if not some[True]:
            continue
        if size[True] * share >= size[False]:
            kept = [k and has for k, has in zip(kept, inside, strict=True)]
        elif size[True] and share == 1:
            kept = [k and not has for k, has in zip(kept, inside, strict=True)]
    return kept


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null, empty and contentless pages."""
    page = blocks(html or "")
    _lift(page)
    labels = [first_pass(b) for b in page]
    if GOOD not in labels:
        # Nothing is decided by words: length and link density alone.
        labels = [GOOD if label == NEUTRAL and len(b.text) >= SHORT else label for b, label in zip(page, labels, strict=True)]
    kept = _within(page, labels)
    labels = [label for label, k in zip(labels, kept, strict=True) if k]
    page = [b for b, k in zip(page, kept, strict=True) if k]
    return " ".join(b.text for b, k in zip(page, second_pass(page, labels), strict=True) if k)


def extract(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """pages with the main text of every row; other columns and repeated rows stay as they are.

    Null and empty pages have an empty text; very long and deeply nested ones are read
    whole, in linear time. A column of the name `column` is replaced. Empty in, empty out.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    return pages.withColumn(column, texts(F.col(f"`{html}`")))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
