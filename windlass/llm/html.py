"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: elements at the same path of tags and classes are one node. For
each block node the entropy of its children's layout (presentation) and of its text (content) over the host's distinct
pages (a page counts once, by the texts and layouts of all its elements of the node in order), as a share of the largest
possible one, is its importance. Small hosts say little, so it is shrunk towards that of the path over all hosts, which
weighs as much as PRIOR pages. Branches of less importance than LOW, which look and read alike on page after page, are
removed from each page, in articles too; only those that hold or are an article stay. Elements whose tag, role or class
says what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) are noise at any
entropy: their texts differ from page to page on many sites, where entropy alone would keep them.

An article or main element is evidence, not a switch: where such elements hold at least MAIN_SHARE of the letters that
remain, the text is theirs; where they hold less (a teaser beside an unmarked body), it is all that remains. Blocks are
joined by a line feed in page order, white space within one is a single space, character references are decoded. Scripts,
styles, frames, drawings, formulas and form fields (RAW) are never text.

Defined results: a null or empty html gives the empty text; a null or odd url belongs to the host ''; broken markup is
read to its end (unclosed elements end with their parent, an unclosed script or comment ends the page); repeated rows
are treated alike and count once in the tree; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, slices

PRIOR, LOW, MAIN_SHARE = 2.0, 0.2, 0.25
HOT = 200  # a host of over 1 / HOT of all pages is dealt to several tasks; there are fewer than HOT of them

# The elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("html body article main".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
NOISE = frozenset("nav footer aside form head button dialog menu label input".split())
CONTENT = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption b i em strong a span code sub sup br".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments disqus cookie cookies consent footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pagination pager popup promo promoted promotion related recommended respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)", re.I)


def host(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def _said(attrs: str) -> tuple[str, bool]:
    """The element's class signature and whether its role, class or id names a part that isn't main text."""
    sig, noise = "", bool(_HIDDEN.search(attrs))
    for name, a, b, c in _ATTR.findall(attrs):
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
        if name.lower() == "class":
            sig = "." + "-".join(words)
        noise |= bool(ROLES.intersection(words) if name.lower() == "role" else WORDS.intersection(words))
    return sig, noise


def _path(up: str, step: str) -> str:
    """The name of a path of tags and classes: a hash of the whole, of equal length at any depth."""
    return xxhash.xxh3_128_hexdigest(f"{up}>{step}".encode("utf-8", "surrogatepass"))


class Node:
    __slots__ = ("tag", "path", "noise", "main", "start", "children", "holds_main")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, start: int):
        self.tag, self.path, self.noise, self.main, self.start, self.children, self.holds_main = tag, path, noise, main, start, [], False


def read(page: str | None, low: frozenset | set = frozenset(), visit=None) -> list[tuple[bool, str]]:
    """(whether within article or main, text) of the blocks without noise and without the branches in low, in page order.

    visit(node, pieces of its text) is called as each element that isn't noise ends.
    """
    page = page or ""
    blocks: list[tuple[bool, str]] = []
    pieces: list[str] = []  # of all text that isn't noise, for visit
    block: list[str] = []
    stack = [Node("", "", False, False, 0)]

    def flush() -> None:
        if block:
            if text := " ".join(entities.unescape("".join(block)).split()):
                blocks.append((stack[-1].main, text))
            block.clear()

    def text(s: str) -> None:
        if s and not stack[-1].noise:
            block.append(s)
            if visit:
                pieces.append(s)

    def pop() -> None:
        node = stack[-1]
        if node.tag in BLOCK:
            flush()
        stack.pop()
        if node.main and node.tag in ("article", "main") or node.holds_main:
            stack[-1].holds_main = True
        if visit and not node.noise:
            visit(node, pieces)

    at = 0
    while m := _TAG.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if any(n.tag == tag for n in stack):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text(" ")
            continue
        if tag in BLOCK:
            flush()
            while any(n.tag == "p" for n in stack) and stack[-1].tag in CONTENT - {"article", "main", "body", "html", "li", "td", "th", "dd", "blockquote"}:
                pop()
        if tag in CLOSED_BY:
            while stack[-1].tag in CLOSED_BY[tag]:
                pop()
        up = stack[-1]
        sig, said = _said(m[3] or m[6] or "")
        path = _path(up.path, tag + sig)
        noise = up.noise or said and tag not in ("html", "body", "main") or tag in NOISE or tag == "header" and not up.main or path in low
        if stack[-1].children is not None:
            up.children.append(tag)
        stack.append(Node(tag, path, noise, up.main or tag in ("article", "main"), len(pieces)))
    text(page[at:])
    while len(stack) > 1:
        pop()
    flush()
    return blocks


def main_text(page: str | None, low=frozenset(), share: float = MAIN_SHARE) -> str:
    blocks = read(page, low)
    inside = sum(len(t) for main, t in blocks if main)
    marked = inside > 0 and inside >= share * sum(len(t) for _, t in blocks)
    return "\n".join(t for main, t in blocks if main or not marked)


def _styles(batches):
    """(host, path, content, layout, page) of the elements that the tree may judge."""
    for piece in slices(batches, rows=256, column="html"):
        rows = []
        for url, page in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            site, whole = host(url), xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
            seen: dict = {}

            def visit(node, pieces):
                if (node.tag in BLOCK or node.tag not in CONTENT) and node.tag not in KEPT and not node.holds_main:
                    said = "".join(pieces[node.start:]).strip()
                    at = seen.setdefault(node.path, (xxhash.xxh3_64(), xxhash.xxh3_64()))
                    for kept, value in zip(at, (said, " ".join(node.children))):
                        kept.update(xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass")))

            read(page, visit=visit)
            rows += [(site, p, c.intdigest() >> 1, s.intdigest() >> 1, whole) for p, (c, s) in seen.items()]
        if rows:
            a, b, c, d, e = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["host", "path", "content", "layout", "page"])


def _hosted(batches):
    """Rows with the host of their url, under which the style tree has them."""
    for batch in batches:
        hosts = pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])


def _with_removed(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with the paths that removed (host, low) has for their host; a hot host's pages go to several tasks."""
    sizes = pages.select("url").mapInArrow(_hosted, "url string, host string").groupBy("host").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT rows whatever the input, each with as many salts as it has shares of 1 / HOT
    hot = sizes.filter(F.col("n") > F.lit(total / HOT)).select("host", F.ceil(F.col("n") * HOT / max(total, 1)).cast("int").alias("salts"))
    salted = lambda df: df.join(F.broadcast(hot), "host", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted(pages.mapInArrow(_hosted, "page_id long, url string, html string, host string")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("salts")).cast("int"))
    right = salted(removed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, ["host", "salt"], "left").select("page_id", "url", "html", "low")


def style_tree(pages: DataFrame, scratch: Scratch, prior: float = PRIOR) -> DataFrame:
    """(host, path, n, importance) of the merged nodes: the mean of content and layout entropy as shares of log n, shrunk to all hosts'."""
    rows = pages.select("url", "html").mapInArrow(_styles, "host string, path string, content long, layout long, page long")
    rows = scratch.table(rows.distinct(), "styles")

    def entropy(column: str) -> DataFrame:
        counts = rows.groupBy("host", "path", column).agg(F.count("*").alias("c"))
        total = F.sum("c")
        h = F.log(total) - F.sum(F.col("c") * F.log("c")) / total
        return counts.groupBy("host", "path").agg(total.alias("n"), F.when(total > 1, h / F.log(total)).otherwise(1.0).alias(f"{column}_h"))

    both = entropy("content").join(entropy("layout").drop("n"), ["host", "path"])
    # text weighs more than layout, which is alike wherever a template is
    own = scratch.table(both.select("host", "path", "n", (0.8 * F.col("content_h") + 0.2 * F.col("layout_h")).alias("own")), "own")
    # the path over all hosts; paths of one page only say nothing
    everywhere = own.groupBy("path").agg((F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("own"))) / F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("all"))
    shrunk = (F.col("n") * F.col("own") + prior * F.coalesce("all", F.lit(1.0))) / (F.col("n") + prior)
    return own.join(everywhere, "path").select("host", "path", "n", shrunk.alias("importance"))


def _extract(batches):
    for piece in slices(batches, rows=256, column="html"):
        texts = [main_text(p, frozenset(low or ())) for p, low in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame, *, prior: float = PRIOR, low: float = LOW) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    removed = style_tree(pages, scratch, prior).filter(F.col("importance") < low)
    removed = scratch.table(removed.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "removed")
    scratch.drop("styles", "own")
    return _with_removed(pages, removed).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, load(spark, sf_dir, "pages"))
