"""Main text of web pages by two passes of block rules.

A page is cut at block-level tags. The first pass decides blocks by link density,
length and stop-word density; short and undecided ones inherit, in the second
pass, the label of the nearest decided neighbour. Where a block stands shifts
the thresholds and does not replace them:

* ``for``: inside an ``article`` or ``main`` element that holds at least half of
  the page's good text; half the lengths and stop words are enough, and a block
  without decided neighbours there stays;
* ``apart``: outside of such an element; twice the length is needed;
* ``doubt``: inside it, in an element whose class is a soft hint (search, tags,
  legal ...); the common thresholds hold and short blocks go;
* ``against``: a soft hint elsewhere, or an ``article`` that does not hold most of
  the good text (a card); only long blocks full of stop words stay;
* ``none``: everything else.

No density tells a reader comment, a notice or an advert from an article, so
their elements and classes (``never``) lose their text whatever it looks like.

Defined results: NULL and empty pages give an empty text; unclosed and stray
tags are tolerated; an unclosed script, style or comment swallows the rest of
the page, as in a browser; very long pages take time and memory in proportion to
their length; repeated pages give equal rows; other columns, whatever their
names, are not read. A block as near to a good as to a bad one follows the
earlier, a heading the later one. Everything is a map over pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from panelworks.llm.common import batches, whole_text

# Frequent function words of the languages handled.
STOP_WORDS = frozenset(
    """
    the of and to in is that it was for on are as with be at by this from or an not but have has
    de la le et les des en un du une que est pour qui dans par sur au plus ne se ce il pas avec
    der die und das den von zu mit sich auf ist im dem nicht ein eine als auch es werden aus er
    el los y las del se por con para una su al lo como mas no o sus
    """.split()
)
# Element names.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset(
    "head title nav aside footer form menu dialog select button textarea label fieldset noscript iframe template".split()
)
RAW = "script|style|noscript|template|svg|iframe|textarea|object|canvas"
# Words of class and id names. The first never hold article text, the second may.
FIRM = re.compile(
    r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:nav(?:bar|igation)?|menus?|breadcrumbs?|masthead|footer|side-?bar|aside|ads?|advert\w*|"
    r"sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|sign-?up|"
    r"log-?in|comments?|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommend\w*)(?:$|[\s_-])",
    re.IGNORECASE,
)
SOFT = re.compile(
    r"(?:^|[\s_-])(?:header|widget|toolbar|pagination|pager|copyright|legal|disclaimer|tags?|byline-links|skip|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<(?P<raw>{RAW})\b[^>]*(?:>(?:.*?</(?P=raw)\s*>|.*)|$)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^>]*)(?:>|$)"
    r"|<[!?/][^>]*(?:>|$)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")

LONG, MEDIUM = 200, 70
STOPS_HIGH, STOPS_LOW = 0.30, 0.15
LINKS_MOST, LINKS_ALL = 0.5, 0.9
NEVER, DOUBTED = 2, 1
SENTENCE_ENDS = (".", "!", "?", "…", ":", "。", "！", "？", '"', "”", "»")


@dataclass
class Block:
    text: str
    linked: int
    force: int  # NEVER, DOUBTED or 0, of the elements around
    article: bool
    heading: bool
    item: bool


def _force(name: str, attrs: str, in_article: bool) -> int:
    """What an element says against its text, by its name, role or class."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return NEVER
    if not attrs or name in ("html", "body", "article", "main"):
        # the whole page or the article is never thrown out for a word among its classes, comments are
        return NEVER if name == "article" and re.search(r"\bcomment", attrs, re.IGNORECASE) else 0
    force = 0
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if FIRM.search(value):
                return NEVER
            force = max(force, DOUBTED if SOFT.search(value) else 0)
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return NEVER
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
    return force


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements and what each says against its text
    forces = [0, 0, 0]
    articles = links = headings = items = 0
    pieces: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                force = NEVER if forces[NEVER] else DOUBTED if forces[DOUBTED] else 0
                found.append(Block(text, linked, force, articles > 0, headings > 0, items > 0))
            pieces.clear()
        linked = 0

    def count(name: str, force: int, by: int) -> None:
        nonlocal articles, links, headings, items
        forces[force] += by
        articles += by * (name in ("article", "main"))
        links += by * (name == "a")
        headings += by * (len(name) == 2 and name[0] == "h" and name[1] in "123456")
        items += by * (name in ("li", "dt", "dd", "td", "th"))

    for token in TOKEN.finditer(page):
        name = token["name"]
        if name is None:
            part = token.group()
            if token["raw"] is None and (part[0] != "<" or part == "<"):
                part = html.unescape(part)  # a reference ends where a tag begins
                pieces.append(part)
                if links:
                    linked += len(part.strip())
            continue
        name = name.lower()
        if name in BLOCKS:
            close()
        elif name == "br":
            pieces.append(" ")
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    for gone, force in stack[depth:]:
                        count(gone, force, -1)
                    del stack[depth:]
                    break
        elif name not in VOID and not token["attrs"].endswith("/"):
            if name in ("p", "li", "option", "dt", "dd", "a") and stack and stack[-1][0] == name:
                count(*stack.pop(), -1)  # these end where the next one begins
            elif name == "p":
                # a paragraph ends open paragraphs, with what is left open in them
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        for gone, force in stack[depth:]:
                            count(gone, force, -1)
                        del stack[depth:]
                        break
                    if stack[depth][0] in BLOCKS:
                        break
            force = _force(name, token["attrs"], articles > 0)
            stack.append((name, force))
            count(name, force, 1)
    close()
    return found


def first_pass(block: Block, standing: str) -> tuple[str, str]:
    """(good, bad, near or short; what decided). Near and short blocks are for the neighbours to decide."""
    size = len(block.text)
    density = block.linked / size
    if density > LINKS_MOST and standing != "for" or density > LINKS_ALL and block.item:
        return "bad", "links"
    if standing == "never":
        return "bad", "element"
    if density > LINKS_MOST and not block.heading:
        return "short", "links"
    if size < MEDIUM:
        if standing in ("doubt", "against") or "©" in block.text and standing != "for":
            return "bad", "length"
        return "short", "length"
    words = WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    long = LONG * {"for": 0.5, "apart": 2.0}.get(standing, 1.0)
    high, low = (x * (0.5 if standing == "for" else 1.0) for x in (STOPS_HIGH, STOPS_LOW))
    if stops >= high and size > long:
        return "good", "density"
    if standing in ("apart", "against"):
        return "bad", "density"
    # of few stop words: a long list of names, or a table of figures; inside the article its neighbours decide
    return ("near" if stops >= low or size >= long or standing == "for" else "bad"), "density"


def standings(blocks: list[Block]) -> list[str]:
    """Where each block stands; an article counts as such if at least half of the good text is in it."""
    inside = outside = 0
    for block in blocks:
        if not block.force and first_pass(block, "none")[0] in ("good", "near"):
            inside += len(block.text) * block.article
            outside += len(block.text) * (not block.article)
    trusted = any(b.article for b in blocks) and inside >= outside

    def standing(block: Block) -> str:
        if block.force == NEVER:
            return "never"
        if not trusted:
            return "against" if block.article or block.force else "none"
        if block.force:
            return "doubt" if block.article else "against"
        return "for" if block.article else "apart"

    return [standing(b) for b in blocks]


def second_pass(labels: list[str], blocks: list[Block], stand: list[str]) -> list[str]:
    """Open blocks take the label of the nearest decided block; near ones lean to good.

    Inside the article only its own blocks are neighbours, so that a menu before or a footer after it decides nothing.
    """
    n = len(labels)
    within = [s in ("for", "doubt") for s in stand]

    def nearest(order: range) -> list[tuple[str, int]]:
        seen, at, out = ["", ""], [0, 0], [("", 0)] * n
        for i in order:
            own = within[i]
            out[i] = (seen[own], at[own])
            at = [x + len(blocks[i].text) for x in at]
            if labels[i] in ("good", "bad"):
                seen[own], at[own] = labels[i], 0
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    final = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            final.append(label)
            continue
        (b, far_b), (a, far_a) = before[i], after[i]
        if stand[i] == "for" and label == "short" and "good" not in (a, b):
            # no text of the article is near: a caption between lists of links goes, anything else stays
            between = a == b == "bad" and not blocks[i].heading and not blocks[i].text.endswith(SENTENCE_ENDS)
            final.append("bad" if between else "good")
        elif label == "near" and ("good" in (a, b) or stand[i] == "for" or not a and not b):
            final.append("good")
        elif a == b or not a or not b:
            final.append(a or b or "bad")
        elif blocks[i].heading:
            final.append(a)  # a heading belongs to what follows
        else:
            final.append(b if far_b <= far_a else a)
    return final


def main_text(page: str) -> str:
    """The article of one page as one line."""
    blocks = blocks_of(page)
    stand = standings(blocks)
    first = [first_pass(b, s)[0] for b, s in zip(blocks, stand, strict=True)]
    labels = second_pass(first, blocks, stand)
    return " ".join(b.text for b, label in zip(blocks, labels, strict=True) if label == "good")


def _extracted(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, text="html"):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, type=pa.string()),
                pa.array([len(t) for t in texts], type=pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    chosen = pages.select("page_id", "url", whole_text("html"))
    types = {c: chosen.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return chosen.mapInArrow(
        _extracted, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    )
