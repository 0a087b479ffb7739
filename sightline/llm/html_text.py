r"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines: every block-level tag ends a line, inline tags do not. A line keeps
two lengths, that of its text and that of its *countable* text: outside links, and outside elements
that are never the article (menus, headers, footers, sidebars, notices, adverts, forms, comments), the
text of which is no line at all. The countable lengths of WINDOW successive lines are summed; a surge
point is where the sum reaches LEVEL at a line with countable text, a dive point where it falls to nothing.

Without marks in the page, the lines from a surge to its dive are the text; on a page where nothing
surges, every span of countable text. Where a page marks sections (``article`` elements; without one
``main`` or its role), lines of different sections are distributions of their own: a section in which
the sums surge is text, and its surge and dive points are moved out to its edges, so that its short
first and last lines are kept with it. Sections without a surge (teasers, empty shells) and lines
outside the sections are left out; where no section surges, all are text.

The tokenizer follows the rules of HTML for tags, attributes, comments and raw text, and reads every
character once: what is not closed runs to the end of the page, as browsers have it. Character
references are decoded after the markup is gone, white space inside a line becomes one space, lines are
trimmed, and empty ones dropped.

An element's class or id masks it by a whole token that names what it is (``cookie-banner``, ``comment-list``), not by a word in a token
that says something else (``has-sidebar``, ``no-header``, ``share-enabled``, ``related-work``), and never if the page's first
marked section lies inside it. Captions of figures are text of the article.

Defined results: null or empty html, or a page without an article text, gives the empty string;
repeated rows and null ids each give their own row; unclosed tags end with the page or with the
enclosing element; other columns of the input are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Lines whose lengths are summed.
WINDOW = 3
#: Countable characters that a window must reach for a surge.
LEVEL = 60

#: Element classes of the HTML standard.
RAW = "script style noscript template textarea title svg math iframe object canvas noframes noembed xmp"
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
MASKED = "nav footer aside form menu dialog button select fieldset head"
MASKED_ROLES = "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog status note toolbar"
#: Words of class and id tokens: what such an element is, its parts, and words before it that say the contrary or a state.
NAMES = (
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget widgets related recommended share sharing social "
    "comment comments commentlist disqus respond replies reply reviews newsletter subscribe subscription login signup search pagination pager copyright disclaimer toolbar"
)
PARTS = "area bar block box btn btns button buttons container element form group icons inner item items link links list message panel posts row section slot stories text thread unit widget wrap wrapper zone"
CONTRARY = "has no non not with without is are show hide hidden enable disable can before after under"
#: Headers that are a site's even inside an article.
SITE = "site page main global top masthead"
_TOKEN = re.compile(rf"(?!(?:{'|'.join(CONTRARY.split())})[_-])((?:[a-z0-9]+[_-]+)*?)({'|'.join(NAMES.split())})(?:[_-]+(?:{'|'.join(PARTS.split())}|[0-9]+))*", re.I)
_SITE = re.compile(rf"(?:^|[_-])(?:{'|'.join(SITE.split())})[_-]", re.I)
_RAW_SET, _BLOCK_SET, _VOID_SET, _MASK_SET, _ROLE_SET = (frozenset(x.split()) for x in (RAW, BLOCKS, VOID, MASKED, MASKED_ROLES))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag that has no attribute with a value, or none at all.
_PLAIN_TAG = re.compile(r"[^>=\"']*>")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?)?""")
_COMMENT_END = re.compile(r"--!?>")
#: Elements that a new start tag of the same kind closes; any block-level one closes a paragraph.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW.split()}


class _Lines:
    """Lines of a page: (text, countable length, section); section 0 is none, ``main`` sections are below 0."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.count = 0

    def add(self, text: str, countable: bool) -> None:
        self.parts.append(text)
        if countable:
            self.count += len(text.strip())

    def end(self, section: int) -> None:
        if self.parts:
            text = " ".join(html_lib.unescape("".join(self.parts)).split())
            if text:
                self.out.append((text, self.count, section))
            self.parts, self.count = [], 0


def _tag_end(page: str, at: int) -> tuple[int, dict[str, str], bool]:
    """(offset after the tag, attributes by lower-case name, self-closing) of a tag whose name ends at ``at``; offset -1: never closed."""
    if page[at : at + 1] == ">":
        return at + 1, {}, False
    m = _PLAIN_TAG.match(page, at)
    if m:
        words = m[0][:-1].replace("/", " ").split()
        return m.end(), dict.fromkeys((w.lower() for w in words), ""), m[0][-2:-1] == "/"
    attributes: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = _ATTRIBUTE.match(page, at)
        end = m.end()
        if m[1] is not None:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            attributes.setdefault(m[1].lower(), value)
            if m[2] is m[3] is m[4] is None and m[0].rstrip().endswith("=") and page[end : end + 1] in ("\"", "'"):
                return -1, attributes, False  # a quote that is never closed
        if end < n and page[end] == ">":
            return end + 1, attributes, page[end - 1] == "/" and (m[1] is None or m[4] is None)
        at = end if end > at else at + 1
    return -1, attributes, False


def _names_mask(names: str, in_article: bool) -> bool:
    """Whether a whole token of a class or id says that the element is no part of an article."""
    for token in names.split():
        m = _TOKEN.fullmatch(token)
        if m and (m[2].lower() != "header" or (_SITE.search(m[1]) if in_article or m[1] else True)):
            return True
    return False


def _is_masked(tag: str, attributes: dict[str, str], in_article: bool, by_name: bool = True) -> bool:
    if tag in _MASK_SET or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    get = attributes.get
    if "hidden" in attributes or get("aria-hidden", "").lower() == "true" or get("role", "").lower() in _ROLE_SET:
        return True
    if "display:none" in get("style", "").replace(" ", "").lower():
        return True
    return by_name and (tag != "article" or in_article) and any(x in attributes and _names_mask(attributes[x], in_article) for x in ("class", "id"))


def _by_name(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a section's own name says that it is none (a comment, a teaser's widget)."""
    return tag == "article" and any(x in attributes and _names_mask(attributes[x], True) for x in ("class", "id"))


def around_the_article(page: str) -> frozenset[int]:
    """Where the elements begin that hold the first marked section of a page: no name of theirs hides it."""
    for tag in ("article", "main"):
        if f"<{tag}" in page.lower():
            found: list[frozenset[int]] = []
            page_lines(page, None, lambda t, within: found.append(within) if t == tag else None, first=True)
            if found:
                return found[0]
    return frozenset()


def page_lines(page: str | None, open_names: frozenset[int] | None = frozenset(), seen: Callable[[str, frozenset[int]], None] | None = None, first: bool = False) -> list[tuple[str, int, int]]:
    """(text, countable length, section) of every line of a page.

    Elements that begin at a place in ``open_names`` are not masked by their class or id; None: none are. ``seen`` hears of each marked section and
    of where the elements around it begin; ``first``: of the first alone, at which reading ends.
    """
    lines = _Lines()
    starts: list[int] = []  # where they begin
    stack: list[str] = []  # open non-void elements
    open_: Counter[str] = Counter()  # how many of each
    mask_at = link_at = -1  # stack depth at which a masked element or a link began
    article_at = main_at = -1  # and the outermost marked elements
    articles = mains = 0
    page = page or ""
    at, n = 0, len(page)

    def section() -> int:
        return articles if article_at >= 0 else -mains if main_at >= 0 else 0

    while at < n:
        upto = page.find("<", at)
        upto = n if upto < 0 else upto
        if upto > at and mask_at < 0:
            lines.add(page[at:upto], link_at < 0)
        if upto == n:
            break
        at = upto + 1
        closing = page.startswith("/", at)
        m = _NAME.match(page, at + closing)
        if not m:
            if page.startswith("!--", at):
                # <!--> and <!---> are whole comments
                short = 4 if page.startswith("!-->", at) else 5 if page.startswith("!--->", at) else 0
                m = None if short else _COMMENT_END.search(page, at + 3)
                at = at + short if short else m.end() if m else n
            elif closing or page[at : at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
            elif mask_at < 0:
                lines.add("<", link_at < 0)  # no tag begins here
            continue
        tag = m[0].lower()
        at, attributes, empty = _tag_end(page, m.end())
        if at < 0:
            break
        if closing:
            if tag in _BLOCK_SET and mask_at < 0:
                lines.end(section())
            if open_[tag]:
                while True:
                    starts.pop()
                    popped, depth = stack.pop(), len(stack)
                    open_[popped] -= 1
                    if depth in (mask_at, article_at, main_at):
                        lines.end(section())
                    mask_at = -1 if depth == mask_at else mask_at
                    link_at = -1 if depth == link_at else link_at
                    article_at = -1 if depth == article_at else article_at
                    main_at = -1 if depth == main_at else main_at
                    if popped == tag:
                        break
            continue
        if tag in _RAW_SET:
            if not (empty and tag in ("svg", "math")):
                close = _RAW_ENDS[tag].search(page, at)
                at = close.end() if close else n
            continue
        if tag in _BLOCK_SET and mask_at < 0:
            lines.end(section())
        if tag == "br" and mask_at < 0:
            lines.add(" ", False)
        if tag in _VOID_SET:
            continue
        if stack and ((tag in _SELF_CLOSING and stack[-1] == tag) or (tag in _BLOCK_SET and stack[-1] == "p")):
            starts.pop()
            open_[stack.pop()] -= 1  # ends without a tag of its own
            mask_at = -1 if mask_at == len(stack) else mask_at
            link_at = -1 if link_at >= len(stack) else link_at
        if mask_at < 0:
            if _is_masked(tag, attributes, article_at >= 0, open_names is not None and upto not in open_names):
                lines.end(section())
                mask_at = len(stack)
            elif tag == "article" and article_at < 0:
                articles, article_at = articles + 1, len(stack)
            elif (tag == "main" or attributes.get("role", "").lower() == "main") and main_at < 0:
                mains, main_at = mains + 1, len(stack)
            elif tag == "a":
                link_at = len(stack)
            if seen and mask_at < 0 and (tag in ("article", "main") and not _by_name(tag, attributes)):
                seen(tag, frozenset(starts))
                if first and tag == "article":
                    break
        stack.append(tag)
        starts.append(upto)
        open_[tag] += 1
    lines.end(section())
    return lines.out


def window_sums(weights: list[int]) -> list[int]:
    """The sum of each line's weight and those of the WINDOW - 1 lines after it."""
    upto = [0, *accumulate(weights)]
    return [upto[min(i + WINDOW, len(weights))] - upto[i] for i in range(len(weights))]


def spans(weights: list[int], level: int) -> list[tuple[int, int]]:
    """[start, end) between surge and dive points of the window sums."""
    n, sums = len(weights), window_sums(weights)
    out, i = [], 0
    while i < n:
        if sums[i] >= level and weights[i] > 0:
            end = i
            while end < n and sums[end] > 0:
                end += 1
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The article's text: its blocks in page order, one line each."""
    lines = page_lines(page, around_the_article(page or ""))
    kind = (lambda s: s > 0) if any(s > 0 for *_, s in lines) else (lambda s: s < 0)
    sections: dict[int, list[int]] = {}
    for _, count, s in lines:
        if kind(s):
            sections.setdefault(s, []).append(count)
    if sections:
        surging = {s for s, weights in sections.items() if spans(weights, LEVEL)} or set(sections)
        return "\n".join(t for t, _, s in lines if s in surging)
    weights = [c for _, c, _ in lines]
    kept = spans(weights, LEVEL) or spans(weights, 1)
    return "\n".join(lines[i][0] for a, b in kept for i in range(a, b))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns of ``keep``, then text and n_chars of every page; narrow."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
