"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags. Scripts, styles, forms,
navigation, headers, footers, sidebars, notices, adverts and reader comments go
with their tags, or with the words of a class, id or role that name them. An
element that only its name or `form` speaks against stays if it holds most of
the page's text, and its marked article if there is one: it is a wrapper.

First pass, each block by itself: too many of its characters in links is bad;
short ones are undecided; long ones are good with enough stop words, undecided
with somewhat fewer, and bad without. Stop words are those of a fixed list,
and the short words that the page itself says again and again, so that the
language doesn't matter; where words aren't spaced, each character is one.

Second pass: undecided blocks take the label of the nearest decided neighbours;
where these differ, the nearer one's; headings follow the text after them. The
page's ends count as bad neighbours for what is no sentence. Where a page marks
its article, and the article holds a third of its text or more, only that is
looked at, its ends count as good, and its text without links is never bad for
want of stop words. A page without any good block, but with a long one, gives its
blocks without links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags and names by their role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("nav footer aside form menu dialog button select head datalist label".split())
#: Names that may also stand on a wrapper of the whole page are taken at their word only where they hold little of it.
DROPPED_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social newsletter subscribe subscription related recommended widget popup modal toolbar pager pagination copyright skip signup login".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Parts that turn a name around, or make it a state of the page.
STATES = frozenset("has no not with without is show hide open closed enabled disabled active status".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
PAGE_HEADER_NAMES = frozenset("header masthead topbar".split())
RAW_TAGS = "script|style|noscript|template|iframe|svg|canvas|object|textarea|annotation|annotation-xml|title"
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Stop words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up
    le la les de des du un une et en à au aux est que qui dans pour par sur pas plus ne ce cette il elle se son sa ses avec sont ou mais nous vous on leur été être comme
    der die das und zu den von mit ist des auf für im dem nicht ein eine als auch es an er so dass sich aus bei nach sie wird sind oder einer um noch wie über war
    el los las y del que por con para una su al lo como más o pero sus este ya entre cuando muy sin sobre también me hasta hay donde quien desde todo nos""".split()
)

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS.split("|")}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_WIDE = re.compile(f"[{_UNSPACED}]")
_SENTENCE = re.compile(r"[.!?…:;。！？।؟][\"'”’»)\]]*$")
#: Share of a page's text that makes an element its wrapper, even if it is named for comments, or a marked article the whole of it.
WRAPPER, WHOLE, MARKED = 0.6, 0.9, 1 / 3


@dataclass
class Block:
    tag: str
    text: str
    link_chars: int
    inside: bool


def _dropped(tag: str, attributes: str, inside: bool) -> str:
    """strong: the element goes; weak: it goes unless it holds most of the page; apart: unless it holds all articles, or nearly the whole page; empty: it stays."""
    if tag in DROPPED_TAGS or (tag == "header" and not inside):
        return "weak" if tag == "form" else "strong"
    if "=" not in attributes:
        return ""
    found = ""
    for name, *values in _NAMES.findall(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower()
        if name.lower() == "role":
            if set(_SPLIT.split(value)) & DROPPED_ROLES:
                return "strong"
            continue
        for word in value.split():
            parts = set(_SPLIT.split(word))
            if parts & STATES:
                continue
            if parts & COMMENT_NAMES and tag not in ("body", "html", "main"):
                return "strong" if inside or tag == "article" else "apart"
            if tag not in ("body", "html", "article", "main") and (parts & DROPPED_NAMES or (not inside and parts & PAGE_HEADER_NAMES)):
                found = "weak"
    return found


def blocks_of(page: str | None, everything: bool = False) -> list[Block]:
    """The blocks of a page in order, without what its tags or names mark as not main text.

    everything: only what no reader sees goes (scripts, styles, the head, comments in the markup).
    """
    page = page or ""
    found: list[tuple[Block, tuple[int, ...]]] = []
    pieces: list[str] = []
    linked = 0
    open_tags: list[tuple[str, str]] = []
    weak: list[int] = []  # the numbers of the open elements that only their name speaks against
    apart: set[int] = set()  # those that are named for comments
    number = hidden = links = inside = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tag = next((t for t, _ in reversed(open_tags) if t in BLOCK_TAGS), "")
                found.append((Block(tag, text, min(linked, len(text)), inside > 0), tuple(weak)))
            pieces.clear()
        linked = 0

    def pop() -> str:
        nonlocal hidden, links, inside
        tag, drop = open_tags.pop()
        hidden -= drop == "strong"
        if drop in ("weak", "apart"):
            weak.pop()
        links -= tag == "a"
        inside -= tag in ("article", "main")
        return tag

    def put(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            pieces.append(piece)
            if links:
                linked += len(" ".join(html.unescape(piece).split()))

    at = 0
    while m := _TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if not hidden:
                pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        elif tag == "br" and not hidden:
            pieces.append(" ")
        if m[1]:
            if any(t == tag for t, _ in open_tags):
                while pop() != tag:
                    pass
        elif tag not in VOID_TAGS and not (m[3] or "").endswith("/"):
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and open_tags and tag in (x := [t for t, _ in open_tags[-4:]]) and not {"ul", "ol", "table", "dl", "div"} & set(x[x.index(tag) :]):
                while pop() != tag:
                    pass
            drop = ("strong" if tag == "head" else "") if everything else _dropped(tag, m[3] or "", inside > 0)
            open_tags.append((tag, drop))
            hidden += drop == "strong"
            if drop in ("weak", "apart"):
                number += 1
                weak.append(number)
                if drop == "apart":
                    apart.add(number)
            links += tag == "a"
            inside += tag in ("article", "main")
    put(page[at:])
    close()
    total = sum(len(b.text) for b, _ in found)
    held: Counter = Counter()
    for b, own in found:
        held.update(dict.fromkeys(own, len(b.text)))
    articles = {k for b, own in found if b.inside for k in own} if any(b.inside for b, _ in found) else set(held)
    marked = [own for b, own in found if b.inside]

    def stays(k: int) -> bool:
        if k in apart:
            return all(k in own for own in marked) if marked else held[k] >= WHOLE * total
        return k in articles and held[k] >= WRAPPER * total

    kept = {k: stays(k) for k in held}
    return [b for b, own in found if all(kept[k] for k in own)]


def size_of(text: str) -> int:
    """Characters, those of unspaced scripts twice."""
    return len(text) + len(_WIDE.findall(text))


def said_again(blocks: list[Block], times: int = 3, longest: int = 4) -> frozenset[str]:
    """The short words that stand in a page's text at least so many times, outside link lists."""
    counts = Counter(w for b in blocks if 2 * b.link_chars <= len(b.text) for w in _WORD.findall(b.text.lower()) if len(w) <= longest)
    return frozenset(w for w, k in counts.items() if k >= times and not w.isdigit())


def first_pass(block: Block, own: frozenset[str] = frozenset(), low: int = 70, stop_low: float = 0.12, stop_high: float = 0.25, most_linked: float = 0.5) -> str:
    """good, bad or undecided, from the block alone; own: the page's own stop words."""
    if block.link_chars > most_linked * len(block.text):
        return "undecided" if block.inside and block.tag == "p" else "bad"
    if size_of(block.text) < low:
        return "undecided"
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS or w in own for w in words) / max(len(words), 1)
    if stops >= stop_high:
        return "good"
    return "undecided" if stops >= stop_low or block.inside else "bad"


def second_pass(blocks: list[Block], labels: list[str], marked: bool) -> list[str]:
    """Undecided blocks take the nearest decided neighbour's label; marked: the blocks are those of a marked article."""
    n = len(labels)
    before: list[tuple[int, str]] = []
    after: list[tuple[int, str]] = [(0, "")] * n
    last = (-1, "")
    for i, label in enumerate(labels):
        before.append((i - last[0], last[1]))
        if label != "undecided":
            last = (i, label)
    last = (n, "")
    for i in range(n - 1, -1, -1):
        after[i] = (last[0] - i, last[1])
        if labels[i] != "undecided":
            last = (i, labels[i])
    out = []
    for block, label, (d, x), (e, y) in zip(blocks, labels, before, after):
        if label == "undecided":
            said = bool(_SENTENCE.search(block.text)) or size_of(block.text) >= 70
            edge = "good" if marked or said else "bad"
            x, y = x or edge, y or edge
            if marked and not block.link_chars:
                label = "good"
            elif block.tag in HEADINGS:
                label = y
            elif d == e:
                label = x if x == y else "good" if marked or said else "bad"
            else:
                label = x if d < e else y
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, two line feeds between them; empty for a null page."""
    blocks = blocks_of(page)
    inside = [b for b in blocks if b.inside]
    marked = sum(len(b.text) for b in inside) >= MARKED * sum(len(b.text) for b in blocks) > 0
    blocks = inside if marked else [Block(b.tag, b.text, b.link_chars, False) for b in blocks]
    own = said_again(blocks)
    labels = second_pass(blocks, [first_pass(b, own) for b in blocks], marked)
    if "good" not in labels:
        some = any(not b.link_chars and size_of(b.text) >= 70 for b in blocks)
        labels = ["good" if some and not b.link_chars else "bad" for b in blocks]
    return "\n\n".join(b.text for b, x in zip(blocks, labels) if x == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html), repeated rows included; n_chars: code points of text.

    A null or empty page has an empty text; long ones are taken in whole, in
    time linear in their length. Other columns of pages are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
