"""HTML: text blocks, rendering, links, heading and title."""

from __future__ import annotations

import html as entities
import json
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import squeeze_whitespace, strip
from pageloom.functions.topics import clean_title
from pageloom.functions.urls import link_base, join_link, url_site

# Elements that never hold page content.
DROPPED_TAGS = frozenset((
    "script", "style", "nav", "footer", "aside", "form", "header", "button",
    "input", "select", "textarea", "figure", "figcaption", "link", "meta", "noscript",
))
# Roles of elements that never hold page content.
DROPPED_ROLES = frozenset((
    "navigation", "banner", "contentinfo", "search", "complementary", "form",
    "menu", "menubar", "toolbar",
))
# Elements whose text is listed.
BLOCK_TAGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "td", "th"))
# Elements that cannot hold anything, and those whose text is not
# part of the text around them.
VOID_TAGS = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed",
    "frame", "hr", "image", "img", "input", "isindex", "keygen", "link",
    "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
))
# Elements that may be the main region, with the rank of their rule;
# a div has rank 2 to 5 by its attributes.
REGION_TAGS = {"main": 0, "article": 1, "div": 2, "body": 6}
MUTE_TAGS = frozenset(("template", "rt", "rp"))

# Fixed values of the HTML standard: elements that end an open paragraph, and what an
# element ends besides (the nearest of the first, unless one of the second is nearer).
ENDS_PARAGRAPH = frozenset((
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "td", "th", "tr", "ul",
))
PARAGRAPH_BOUNDS = ("button", "caption", "object", "table", "td", "th", "template")
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
}
NESTING = ("once", "all", "outermost")

PARSED_TYPE = "struct<blocks:array<struct<pos:int,tag:string,text:string,last_cell:boolean>>,fallback:string>"
_BLOCK_ARROW = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("last_cell", pa.bool_())])
_PARSED_ARROW = pa.struct([("blocks", pa.list_(_BLOCK_ARROW)), ("fallback", pa.string())])
# Markup that a task holds parsed at a time; a longer page comes alone.
PARSED_BYTES = 1 << 20


@dataclass(slots=True)
class _Block:
    tag: str
    first: int  # first text piece
    end: int  # one past its last
    row: int | None  # nearest table row, of cells only


@dataclass(slots=True)
class _Open:
    tag: str
    block: _Block | None
    ranks: tuple[int, ...]  # main-region rules this element is the first to meet
    row: int | None
    n_blocks: int  # blocks listed before its content
    dropped: bool = False
    mute: bool = False


class _BlockParser(HTMLParser):
    """One pass over a page, noting where each block's text starts and ends.

    Text of dropped elements is never stored, so a block's text is the pieces
    between its two marks. A close tag ends the nearest open element of its
    name and all inside it; one that fits no open element is ignored.
    """

    def __init__(self, implied: bool = False) -> None:
        """implied: elements end where the HTML standard ends them, and not only at their end tags."""
        super().__init__(convert_charrefs=True)
        self.implied = implied
        self.pieces: list[str] = []
        self.pending: list[str] = []
        self.blocks: list[_Block] = []
        self.stack: list[_Open] = [_Open("", None, (), None, 0)]
        self.open_at: dict[str, list[int]] = {}  # tag -> places in the stack
        self.regions: dict[int, list[int]] = {}  # rule -> [first block, one past the last]
        self.last_cell = -1  # block number of the latest cell
        self.rows: list[int] = []  # row number -> block number of its last cell

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _flush(self) -> None:
        if self.pending:
            top = self.stack[-1]
            if not (top.dropped or top.mute):
                self.pieces.append("".join(self.pending))
            self.pending = []

    def _innermost(self, tags: tuple[str, ...]) -> int:
        """The place of the last open element of these names, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.open_at.get(t))), default=0)

    def _end(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close the last open element of these names and all inside it, unless a bound lies further in."""
        at = self._innermost(tags)
        if at and at > self._innermost(bounds):
            while len(self.stack) > at:
                self._close()

    def _open(self, tag: str, attrs: list, empty: bool) -> None:
        self._flush()
        if self.implied:
            if tag in ENDS_PARAGRAPH:
                self._end(("p",), PARAGRAPH_BOUNDS)
            if tag in ENDS_LIKE:
                self._end(*ENDS_LIKE[tag])
        top = self.stack[-1]
        named = dict(reversed(attrs))
        new = _Open(tag, None, (), top.row, 0, top.dropped, top.mute or tag in MUTE_TAGS)
        if (
            new.dropped
            or tag in DROPPED_TAGS
            or named.get("role") in DROPPED_ROLES
            or named.get("aria-hidden") == "true"
        ):
            new.dropped = True
        else:
            self._note(new, named)
        if not empty:
            self.open_at.setdefault(tag, []).append(len(self.stack))
            self.stack.append(new)

    def _note(self, new: _Open, named: dict) -> None:
        tag, here = new.tag, len(self.pieces)
        if tag in BLOCK_TAGS:
            is_cell = tag in ("td", "th")
            new.block = _Block(tag, here, here, new.row if is_cell else None)
            if is_cell:
                self.last_cell = len(self.blocks)
            self.blocks.append(new.block)
        elif tag == "tr":
            new.row = len(self.rows)
            self.rows.append(-1)
        new.n_blocks = len(self.blocks)
        if tag in REGION_TAGS:
            new.ranks = tuple(r for r in _region_rules(tag, named) if r not in self.regions)
            for rank in new.ranks:
                self.regions[rank] = [new.n_blocks, new.n_blocks]

    def _close(self) -> str:
        done = self.stack.pop()
        self.open_at[done.tag].pop()
        if done.block is not None:
            done.block.end = len(self.pieces)
        for rank in done.ranks:
            self.regions[rank][1] = len(self.blocks)
        if done.tag == "tr" and not done.dropped and self.last_cell >= done.n_blocks:
            self.rows[done.row] = self.last_cell
        return done.tag

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, empty=tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, empty=True)

    def handle_endtag(self, tag):
        self._flush()
        if self.open_at.get(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()

    def result(self, nested: str) -> list[dict]:
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close()
        first, end = self.regions[min(self.regions)] if self.regions else (0, len(self.blocks))
        stripped = [p.strip() for p in self.pieces]
        out, covered = [], -1
        for number in range(first, end):
            block = self.blocks[number]
            if nested != "all":
                if block.first < covered:
                    continue
                covered = max(covered, block.end)
            inside = slice(block.first, block.end)
            if block.tag == "pre":
                text = "".join(self.pieces[inside]).strip()
            else:
                text = ("\t" if block.row is not None or block.tag in ("td", "th") else "").join(
                    p for p in stripped[inside] if p
                )
            last = block.row is not None and self.rows[block.row] == number
            out.append({"pos": len(out), "tag": block.tag, "text": text, "last_cell": last})
        return out


def _region_rules(tag: str, named: dict) -> list[int]:
    """Which of the ordered rules for a page's main region an element meets."""
    if tag != "div":
        return [REGION_TAGS[tag]]
    classes = (named.get("class") or "").split()
    met = (
        (2, named.get("role") == "main"),
        (3, named.get("id") == "content"),
        (4, "content" in classes),
        (5, "main-content" in classes),
    )
    return [rank for rank, is_met in met if is_met]


class _PlainText(HTMLParser):
    """All text but scripts and styles, for pages the block parser gives up on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.pieces = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.pieces.append(data.strip())


def plain_text(page: str) -> str:
    parser = _PlainText()
    try:
        parser.feed(page)
        parser.close()
    except Exception:
        return ""
    return "\n".join(parser.pieces)


def parse_blocks(page: str | None, nested: str = "all") -> dict | None:
    """Blocks of one page, or its plain text if it cannot be parsed."""
    if page is None:
        return None
    parser = _BlockParser(nested == "once")
    try:
        parser.feed(page)
        return {"blocks": parser.result(nested), "fallback": None}
    except Exception:
        return {"blocks": [], "fallback": plain_text(page)}


def parsed_batches(batches: Iterator[pa.Array], nested: str) -> Iterator[pa.Array]:
    """parse_blocks of each page, given out after every PARSED_BYTES of markup, whatever the size of a batch."""
    for pages in batches:
        sizes = pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < len(pages):
            end = max(start + 1, int(np.searchsorted(at, at[start] + PARSED_BYTES, side="right")) - 1)
            parsed = [parse_blocks(p, nested) or {"blocks": None, "fallback": None} for p in pages[start:end].to_pylist()]
            yield pa.array(parsed, _PARSED_ARROW)
            start = end


def page_blocks(html: Column, nested: str = "once") -> Column:
    """struct(blocks, fallback) of an HTML column; only that column goes to Python.

    nested="once" ends paragraphs, items and cells where the HTML standard does
    and lists a block inside a block once, so that a page gives no more text than it
    has. "all" ends blocks at end tags only and lists a block inside a block in both,
    which for many unclosed blocks is as much as the square of the page; "outermost" lists
    it once.
    """
    if nested not in NESTING:
        raise ValueError(f"unknown nesting rule {nested!r}")

    @F.arrow_udf(PARSED_TYPE)
    def blocks(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parsed_batches(pages, nested)

    # Not to be parsed again in a filter that Spark moves below the projection.
    return blocks.asNondeterministic()(html)


def render_blocks(blocks: Column) -> Column:
    """Blocks as text: headings with #, bullets, fenced code, cells with row ends."""

    def lines(b: Column) -> Column:
        text, tag = b["text"], b["tag"]
        level = F.substring(tag, 2, 1).cast("int")
        return (
            F.when(tag == "p", F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")))
            .when(tag == "li", F.array(F.concat(F.lit("* "), text)))
            .when(tag == "pre", F.array(F.concat(F.lit("\n---\nCODE BLOCK:\n"), text, F.lit("\n---\n"))))
            .when(tag.isin("td", "th"), F.when(b["last_cell"], F.array(text, F.lit("\n"))).otherwise(F.array(text)))
            .otherwise(F.array(F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n"))))
        )

    return F.array_join(F.flatten(F.transform(blocks, lines)), "\n")


def clean_html(parsed: Column) -> Column:
    """Text of a page_blocks column."""
    return F.when(parsed["fallback"].isNotNull(), parsed["fallback"]).otherwise(
        squeeze_whitespace(render_blocks(parsed["blocks"]))
    )


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(entities.unescape, na_action="ignore")


def page_title(html: Column, strict: bool = False) -> Column:
    """The page's title without its site name, or null; see clean_title."""
    return clean_title(_unescape(raw_title(html)), strict)


def raw_title(html: Column) -> Column:
    """Inner text of the first title element, entities as written."""
    return F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)


def raw_heading(html: Column) -> Column:
    """Text parts of the first h1 joined by a space, entities as written."""
    inner = F.regexp_extract(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1)
    parts = F.split(F.regexp_replace(inner, r"(?s)<!--.*?-->", ""), r"<[^>]*>")
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), " ")


def page_heading(html: Column) -> Column:
    """The page's first h1 if it is longer than 3 characters, else null."""
    text = _unescape(raw_heading(html))
    return F.when(F.length(text) > 3, text)


# One pass over a page's markup. Every repetition is possessive, so that a place is looked at once and
# nothing is stacked: comments, scripts and styles (to the end of the page if they are not closed), then
# tags with their attributes. Only an anchor that ends is given out, as group 1.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
_ATTRIBUTES = rf"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+"""
_MARKUP = (
    r"(?is)<(?:!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
    r"|script(?=[\s/>])(?:[^<]++|<(?!/script[\s/>]))*+(?:</script|\z)"
    r"|style(?=[\s/>])(?:[^<]++|<(?!/style[\s/>]))*+(?:</style|\z)"
    rf"|(a(?=[\s/]){_ATTRIBUTES}>)"
    rf"|[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\z))"
)
# The value of an anchor's first href, past the attributes before it.
_HREF = rf"""(?is)^a(?:[\s/]++|(?!href\s*+=)[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+href\s*+=\s*+({_VALUE})"""
# A character reference: by name with its semicolon, or by number.
_REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]{1,40}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"


def _named_characters() -> Column:
    """The characters of all named references, by name, as one constant; the table is the standard library's."""
    return F.from_json(F.lit(json.dumps({n: c for n, c in html5.items() if n.endswith(";")})), "map<string,string>")


def _referred_start(part: Column, named: Column) -> Column:
    """A text whose leading character reference, if any, is replaced by what it stands for; unknown names stay."""
    reference = F.regexp_extract(part, f"^{_REFERENCE}", 0)
    body = F.substring(reference, 2, 64)
    digits = F.regexp_extract(body, r"^#([0-9]+|[xX][0-9a-fA-F]+);", 1)
    point = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
    # A code point as UTF-32 bytes.
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    # The map is searched from its start, so the name that URLs are full of is not looked up.
    by_name = F.when(body == "amp;", "&").otherwise(F.element_at(named, body))
    meant = F.when(reference == "", F.lit(None)).when(digits == "", by_name).when(valid, char)
    return F.when(meant.isNull(), part).otherwise(F.concat(meant, F.substring(part, F.length(reference) + 1, F.length(part))))


def decode_references(text: Column) -> Column:
    """A text with its character references decoded once, all HTML names among them."""
    parts = F.split(text, f"(?={_REFERENCE})")
    decoded = F.array_join(F.transform(parts, lambda part: _referred_start(part, _named_characters())), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def page_hrefs(html: Column) -> Column:
    """The link targets of a page as written, in order, outside comments, scripts and other tags' attributes.

    Linear in the page, whatever is unclosed. Null without a page.
    """
    anchors = F.filter(F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(1)), lambda a: a != "")
    values = F.filter(F.transform(anchors, lambda a: F.regexp_extract(a, _HREF, 1)), lambda v: v != "")

    def bare(value: Column) -> Column:
        quote = F.left(value, F.lit(1))
        inner = F.when(quote.isin('"', "'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return strip(decode_references(inner))

    def leads_somewhere(href: Column) -> Column:
        low = F.lower(href)
        return (href != "") & ~href.startswith("#") & ~low.startswith("mailto:") & ~low.startswith("javascript:")

    return F.filter(F.transform(values, bare), leads_somewhere)


def with_links(pages: DataFrame, same_site: bool = False) -> DataFrame:
    """Pages with a column `links`, the distinct absolute URLs each leads to.

    All work happens inside the page's row, so nothing is shuffled. With
    same_site only links to the page's own scheme and host are kept.
    """
    read = pages.withColumn("_base", link_base(F.col("url"))).withColumn("_hrefs", page_hrefs(F.col("html")))
    links = F.filter(F.transform("_hrefs", lambda h: join_link(F.col("_base"), h)), lambda u: u.isNotNull())
    if same_site:
        site = F.concat(F.col("_base.scheme"), F.lit("://"), F.col("_base.netloc"))
        links = F.filter(links, lambda u: url_site(u) == site)
    return read.withColumn("links", F.array_distinct(links)).drop("_base", "_hrefs")


def extract_links(pages: DataFrame) -> DataFrame:
    """links(src_url, dst_url), each target once per page."""
    linked = with_links(pages.select("url", "html"))
    # For a plain explode Spark infers a filter on `links` and works them out
    # a second time below it; the outer one has no such filter.
    targets = linked.select(F.col("url").alias("src_url"), F.explode_outer("links").alias("dst_url"))
    return targets.filter(F.col("dst_url").isNotNull())
