"""Main text of web pages by removing what a site repeats.

Every page is read into elements once per pass. The first pass hashes each element's subtree and
counts, per host, on how many pages it occurs; the second deletes subtrees that recur on many pages
of their host, together with elements whose tag, role or class says what they are. Only hashes are
shuffled. Declared main content (article, main) is kept against recurrence, since copied articles
recur too; inside it recurrence removes only elements that consist mainly of links.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

MIN_PAGES = 5  # a template occurs on so many pages of its host at least
MIN_SHARE = 0.05  # and on this share of them
TEASER = 0.1  # declared main content with less than this share of the remaining text is no article
MAX_BROADCAST = 1_000_000  # templates of all hosts that may be sent to every task

# HTML elements by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # an open element of the key ends where one of these starts, unless a fence lies between
    "p": BLOCK - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"} | {"li", "dd", "dt"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "head": {"body"},
}
FENCE = {
    "p": set("table td th caption button object".split()),
    "li": set("ul ol menu table td".split()),
    "dt": {"dl", "table"},
    "dd": {"dl", "table"},
    "option": {"select"},
    "td": {"table"},
    "th": {"table"},
    "tr": {"table"},
    "head": set(),
}
DROPPED_TAGS = set(
    "head nav footer aside form script style noscript template iframe object embed svg canvas dialog menu button select "
    "option textarea input label audio video map title xmp noembed noframes search".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar footer breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended widget toolbar masthead skip skiplink login".split()
)
COMMENT_WORDS = set("comment comments commentlist commentform disqus respond replies".split())
CONTENT_WORDS = set("article content entry post story main body page has no with".split())
GUARDED, SURE = 1, 2  # how far a name counts: a guarded one never takes more than half of the text
KEPT_TAGS = {"html", "body", "main", "article"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?=[\s=/>]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Elements (parent, hash, flags) and text blocks (element, text) of a page."""

    __slots__ = ("parent", "tag", "hash", "dropped", "weak", "main", "size", "linked", "blocks", "found_main")

    def __init__(self, text: str):
        self.parent, self.tag, self.hash, self.dropped, self.weak = [-1], [""], [0], [False], [0]
        self.main, self.size, self.linked, self.blocks, self.found_main = [False], [0], [0], [], False
        self._read(text or "")

    def _read(self, text: str) -> None:
        # Beside the stack of open elements: the depths at which each tag and any block is open, and how
        # many elements above the last block are named as boilerplate. They keep a token's work the same
        # however many elements are open.
        stack, parts, buffer = [0], [[]], []
        depths: dict[str, list[int]] = {}
        blocks, soft = [0], [0]
        where = 0  # the element that owns the text in the buffer
        lower = None

        def top(tag):
            held = depths.get(tag)
            return held[-1] if held else 0

        def flush():
            nonlocal where
            if buffer:
                block = " ".join("".join(buffer).split())
                buffer.clear()
                if block:
                    self.blocks.append((where, block))

        def write(raw):
            nonlocal where
            piece = html_lib.unescape(raw) if "&" in raw else raw
            if not (self.dropped[stack[-1]] or soft[-1]):
                if not buffer:
                    where = stack[blocks[-1]]
                buffer.append(piece)
            short = " ".join(piece.split())
            if short:
                parts[-1].append(short)
                self.size[stack[-1]] += len(short)
                if top("a"):
                    self.linked[stack[-1]] += len(short)

        def close():
            element, own = stack.pop(), parts.pop()
            depths[self.tag[element]].pop()
            soft.pop()
            if self.tag[element] in BLOCK:
                blocks.pop()
                flush()
            digest = xxhash.xxh64_intdigest("\x00".join([self.tag[element], *own]).encode("utf-8", "surrogatepass"))
            self.hash[element] = digest
            up = self.parent[element]
            self.size[up] += self.size[element]
            self.linked[up] += self.linked[element]
            parts[-1].append("%016x" % digest)

        at = 0
        while (m := _TOKEN.search(text, at)) is not None:
            if m.start() > at:
                write(text[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                depth = top(name)
                if name == "p" and not depth:
                    flush()
                elif name == "br":
                    buffer.append(" ")
                elif depth and name not in ("html", "body"):
                    # A stray end tag of an inline element does not end a block around it.
                    if name in BLOCK or blocks[-1] < depth:
                        while len(stack) > depth:
                            close()
                continue
            for open_tag, starters in CLOSED_BY.items():
                if name in starters:
                    depth = top(open_tag)
                    if depth and all(top(fence) < depth for fence in FENCE[open_tag]):
                        while len(stack) > depth:
                            close()
            if name in VOID:
                if name == "hr":
                    flush()
                buffer.append(" ")
                continue
            if name in ("html", "body") and top(name):
                continue
            if name in BLOCK:
                flush()
            self._open(name, m[3], stack[-1], top("article") or top("main"))
            depths.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
                soft.append(0)
            else:
                soft.append(soft[-1] + (self.weak[-1] > 0))
            stack.append(len(self.tag) - 1)
            parts.append([])
            if name in RAW:
                if lower is None:
                    lower = text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]+", lambda x: x[0].lower(), text)
                end = lower.find("</" + name, at)
                at = len(text) if end < 0 else end
        if at < len(text):
            write(text[at:])
        while len(stack) > 1:
            close()
        flush()

    def _open(self, name: str, attributes: str, up: int, in_content: int) -> None:
        dropped = name in DROPPED_TAGS
        weak, words = 0, set()
        role = ""
        if len(attributes) > 1:
            for a in _ATTR.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                    dropped = True
                elif key == "role":
                    role = value.lower().strip()
                    dropped = dropped or role in DROPPED_ROLES
                elif key in ("class", "id"):
                    words.update(w.lower() for w in _NAME.findall(value))
        inside = self.main[up]
        if words:
            named = words & CONTENT_WORDS
            if words & COMMENT_WORDS:
                weak = GUARDED if named else SURE
            elif words & DROPPED_WORDS or ("header" in words and not inside and not named):
                weak = GUARDED
        is_main = (name in ("article", "main") or role == "main") and not dropped and not weak
        if name == "header" and not inside and not in_content:
            dropped = True
        if name in ("html", "body") or (weak and name == "main"):
            weak = 0
        self.parent.append(up)
        self.tag.append(name)
        self.hash.append(0)
        self.size.append(0)
        self.linked.append(0)
        self.dropped.append(dropped or self.dropped[up])
        self.weak.append(weak)
        self.main.append(inside or (is_main and not self.dropped[-1]))

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be site templates: with text, outside the declared main
        content unless mainly links, and with no more than half of the page's text."""
        half = self.size[0] / 2
        return {
            self.hash[e]
            for e in range(1, len(self.tag))
            if self.size[e]
            and self.tag[e] not in KEPT_TAGS
            and (2 * self.linked[e] >= self.size[e] if self.main[e] else self.size[e] <= half)
        }

    def main_text(self, templates: set[int]) -> str:
        """The blocks that remain, in page order. Declared main content counts alone unless it is only a
        teaser, with less than ``TEASER`` of the text that remains; then the whole body does."""
        half, gone = self.size[0] / 2, [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            main = self.main[e]
            template = (
                self.hash[e] in templates
                and self.tag[e] not in KEPT_TAGS
                and (2 * self.linked[e] >= self.size[e] if main else self.size[e] <= half)
            )
            named = self.weak[e] == SURE or (self.weak[e] == GUARDED and self.size[e] <= half)
            gone[e] = gone[self.parent[e]] or self.dropped[e] or template or named
        kept = [(self.main[e], text) for e, text in self.blocks if not gone[e]]
        main = [text for inside, text in kept if inside]
        if main and sum(map(len, main)) >= TEASER * sum(len(text) for _, text in kept):
            return "\n".join(main)
        return "\n".join(text for _, text in kept)


def _host(url: str):
    authority = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def site_templates(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """(host_key, hashes): the subtrees of each host that recur on many of its pages. Counts are
    combined before the shuffle, so a host with a third of all pages is no hot spot. A list has at
    most 1 / ``min_share`` times the subtrees of an average page."""

    def run(batches):
        for batch in batches:
            counts: dict[tuple[int, int], int] = {}
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for h in (0, *Page(text).candidates()):
                    counts[host, h] = counts.get((host, h), 0) + 1
            if counts:
                hosts, hashes = zip(*counts)
                yield pa.record_batch(
                    [
                        pa.array(hosts, pa.int64()),
                        pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    names=["host_key", "hash", "n"],
                )

    counted = (
        pages.select(F.xxhash64(_host(url_col)).alias("host_key"), F.col(html_col).alias("html"))
        .mapInArrow(run, "host_key long, hash long, n long")
        .groupBy("host_key", "hash")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= min_pages))
    )
    counted = stage(counted, "subtrees")
    total = counted.where("hash = 0").select("host_key", F.col("n").alias("n_pages"))
    return (
        counted.where("hash <> 0")
        .join(total, "host_key")
        .where(F.col("n") >= F.col("n_pages") * min_share)
        .groupBy("host_key")
        .agg(F.collect_list("hash").alias("hashes"))
    )


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(page_id, url, text, n_chars) for each page.

    Null or empty html has empty text. A null or odd URL belongs to the nameless host. Repeated
    pages are pages of their own. Other columns are ignored; an empty table gives an empty result.
    The templates reach the pages by a broadcast if there are at most ``max_broadcast`` of them,
    else by a join on the host, whose hot partitions Spark splits."""
    templates = stage(site_templates(pages, url_col, html_col, min_pages, min_share), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    if size <= max_broadcast:
        templates = F.broadcast(templates)
    source = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        F.xxhash64(_host(url_col)).alias("host_key"),
    )

    def run(batches):
        for batch in slices(batches):
            texts = []
            for html, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                texts.append(Page(html).main_text({h & (1 << 64) - 1 for h in hashes or ()}))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    id_type = source.schema["page_id"].dataType.simpleString()
    return (
        source.join(templates, "host_key", "left")
        .select("page_id", "url", "html", "hashes")
        .mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
    )
