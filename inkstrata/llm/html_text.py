"""Main text of web pages: site templates are found by counting hashed element subtrees per host, and removed."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_batches, trimmed, written

# Fixed values of HTML: elements without content, elements that end a block of text, those whose content is no text, and what ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style template noscript svg math iframe object embed canvas audio video map select button input textarea option datalist title noembed noframes".split())
CHROME = frozenset("nav aside footer form menu dialog".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar comment".split())
CONTAINERS = frozenset("div section ul ol table figure dl header details center".split())


class Node:
    __slots__ = ("tag", "marks", "kids", "role", "key", "size", "parent", "protected")

    def __init__(self, tag: str, marks: str = "", role: str = "", parent: Node | None = None) -> None:
        self.tag, self.marks, self.role, self.parent = tag, marks, role, parent
        self.kids: list[Node | str] = []
        self.key = self.size = 0
        self.protected = parent is not None and (parent.protected or parent.tag in ("article", "main"))  # within the article


def parse(page: str) -> list[Node]:
    """The elements of a page in order, the page itself first. Nothing is an error: what isn't a tag is text, missing ends are supplied, ends without a beginning go. Depth has no limit."""
    root = Node("#root")
    nodes = [root]
    stack = [root]
    open_tags: Counter = Counter()
    at = 0
    n = len(page)
    search = _TOKEN.search

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    def add(tag: str, marks: str = "", role: str = "") -> Node:
        node = Node(tag, marks, role, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        return node

    while at < n:
        m = search(page, at)
        if m is None:
            rest = page[at:]
            broken = re.search(r"<[A-Za-z/!][^<]*\Z", rest)  # a tag that the page's end cuts off
            stack[-1].kids.append(rest[: broken.start()] if broken else rest)
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if tag not in BLOCK and stack[i].tag in BLOCK:
                        break  # an inline end doesn't close the block around it
            elif tag == "p":
                add(tag)  # the end of no paragraph is an empty one
            continue
        if tag in BLOCK and open_tags["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES and any(open_tags[x] > 0 for x in CLOSES[tag]):
            scope = SCOPE.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    cut(i)
                    break
                if stack[i].tag in scope:
                    break
        marks = role = ""
        if m[3]:
            for name, x, y, z in _ATTRIBUTE.findall(m[3]):
                if name.lower() in ("role", "itemprop"):
                    role = (x or y or z).lower()
                else:
                    marks += " " + (x or y or z)
        node = add(tag, marks, role)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
        open_tags[tag] += 1
    # subtrees from the last element on: children come after their parents
    for node in reversed(nodes):
        parts = [node.tag, node.marks]
        for kid in node.kids:
            if isinstance(kid, str):
                word = " ".join(kid.split())
                if word:
                    parts.append(word)
                    node.size += 0 if node.tag in SILENT else len(word)
            else:
                parts.append(str(kid.key))
                node.size += kid.size
        node.key = int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1
    return nodes


def _chrome(node: Node) -> bool:
    """True for elements that are no main text by what HTML says of them: their tag or role. An article within an article is a comment on it; a header belongs to what it is in."""
    return node.tag in SILENT or node.tag in CHROME or node.role in _ROLES or (node.tag == "header" and not node.protected)


def _mains(nodes: list[Node]) -> list[Node]:
    """The outermost articles, or else mains, or else the page. Of several articles the one with most text and those beside it in the same element."""
    root = nodes[0]
    gone: set[int] = set()
    for node in nodes[1:]:  # parents first
        if id(node.parent) in gone or (_chrome(node) and node.tag != "main"):
            gone.add(id(node))
    for wanted in ("article", "main"):
        inner: set[int] = set()
        found: list[Node] = []
        for node in nodes[1:]:
            if id(node.parent) in inner:
                inner.add(id(node))
            elif node.tag == wanted and id(node) not in gone:
                inner.add(id(node))
                found.append(node)
        if found:
            longest = max(found, key=lambda x: x.size)
            return [x for x in found if x.parent is longest.parent]
    return [root]


def _counts(node: Node) -> bool:
    """True for elements that may be the site's template: outside an article any block of text, within one its containers only, as paragraphs may recur in other articles."""
    return node.size > 0 and node.tag not in ("html", "body", "article", "main") and node.tag in (CONTAINERS if node.protected else BLOCK)


def template_keys(page: str) -> set[int]:
    """Names of the subtrees of a page that may belong to its site's template."""
    return {node.key for node in parse(page)[1:] if _counts(node)}


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """The text blocks of a page's main part in order, each with the names of those subtrees around it that go if they recur on the host. What holds over half of the main part's text is the text itself, not a template."""
    mains = _mains(parse(page))
    half = sum(m.size for m in mains) / 2
    out: list[tuple[str, list[int]]] = []
    buffer: list[str] = []
    around: list[int] = []

    def close() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, list(around)))

    for main in mains:
        todo: list[tuple[Node | str, bool]] = [(main, False)]  # with what is left to do: begin or end
        while todo:
            node, ends = todo.pop()
            if isinstance(node, str):
                buffer.append(node)
                continue
            block = node.tag in BLOCK or node is main
            named = node is not main and _counts(node) and node.size <= half
            if ends:
                if block:
                    close()
                if named:
                    around.pop()
                continue
            if node is not main and (_chrome(node) or (node.tag == "article" and node.protected)):
                if block:
                    close()
                continue
            if node.tag in ("br", "wbr"):
                buffer.append(" " if node.tag == "br" else "")
                continue
            if block:
                close()
            if named:
                around.append(node.key)
            todo.append((node, True))
            todo.extend((kid, False) for kid in reversed(node.kids))
    return out


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_pages: int = 5, share: float = 0.005) -> DataFrame:
    """(key, url, text, n_chars) for every row of pages: text is the main text, blocks joined by one line feed, or "".

    A subtree is the site's template if ``least_pages`` different pages of its host and ``share`` of its host's pages have it; such subtrees are deleted, whatever their tags and classes. Counted are blocks of
    text; within articles only containers, as articles may share paragraphs and copies of an article repeat them. A subtree with over half of a page's main text is no template there, and a page of which nothing
    would be left keeps what its tags leave. What HTML itself marks as no main text (menus, asides, footers, forms, scripts, roles, articles within the article) goes on any host: that is all that hosts with few pages have.
    A null page is empty; pages of a null or hostless URL share one host "". Repeated rows stay (copies count as one page towards ``least_pages``); columns besides these go. An empty table gives none.
    Counts are combined in the task before the shuffle: of a subtree's pages a task gives the ``least_pages`` least hashes, which is enough to tell. Pages are parsed twice, once for the counts.
    """
    spark = pages.sparkSession
    arrow_batches(spark, 200)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    src = pages.select(F.col(key), F.col(url), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = dict(src.dtypes)
    deal = "host string, k long, page long, n long"
    count_schema = to_arrow_schema(StructType.fromDDL(deal))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}  # how many pages, and the least hashes of different ones

        def flush() -> pa.RecordBatch:
            rows = [(h, k, p, n if i == 0 else 0) for (h, k), (n, least) in held.items() for i, p in enumerate(least)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(count_schema)], schema=count_schema)

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1
                for k in (-1, *template_keys(page)):
                    row = held.setdefault((h, k), [0, []])
                    row[0] += 1
                    if name not in row[1]:
                        row[1] = sorted([*row[1], name])[:least_pages]
            if len(held) > 200_000:
                yield flush()
        if held:
            yield flush()

    apart = src.select("host", "html").mapInArrow(trimmed(count), deal).groupBy("host", "k", "page").agg(F.sum("n").alias("n"))
    counts = apart.groupBy("host", "k").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"))
    counts = written(counts.where((F.col("k") == -1) | (F.col("different") >= least_pages)), "subtree-counts")
    sizes = counts.where("k = -1").select("host", F.col("n").alias("pages"))
    recurring = written(counts.where("k <> -1").join(sizes, "host").where(F.col("n") >= share * F.col("pages")).select("host", "k"), "recurring-subtrees")

    found_ddl = f"`{key}` {kinds[key]}, `{url}` string, host string, row long, text string, blocks array<struct<text:string,around:array<bigint>>>"
    found_schema = to_arrow_schema(StructType.fromDDL(found_ddl))

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list = []
            open_: list = []
            rows: list = []
            for page, k in zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), strict=True):
                found = blocks(page)
                sure = not any(a for _, a in found)
                texts.append("\n".join(t for t, _ in found) if sure else None)
                open_.append(None if sure else [{"text": t, "around": a} for t, a in found])
                rows.append(None if sure else int.from_bytes(hashlib.blake2b(f"{k}\x1f{page}".encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(found_schema.field(i).type) for i in range(3)), pa.array(rows, "int64"), pa.array(texts, "string"), pa.array(open_, found_schema.field("blocks").type)], schema=found_schema)

    found = written(src.mapInArrow(trimmed(main_text), found_ddl), "page-texts")
    sure = found.where(F.col("text").isNotNull()).select(key, url, "text")
    # the others: a block goes if a subtree around it recurs
    left = found.where(F.col("text").isNull()).drop("text")
    around = left.select("host", "row", F.posexplode("blocks").alias("at", "b")).select("host", "row", "at", F.explode("b.around").alias("k")).distinct()
    gone = written(written(around, "block-subtrees").join(recurring, ["host", "k"]).groupBy("host", "row").agg(F.collect_set("at").alias("gone")), "template-blocks")
    # a set of places as a map: a page's cost grows with its blocks, not their square
    none = F.coalesce(F.size("gone"), F.lit(0)).isin(0) | (F.size("gone") == F.size("blocks"))
    of = F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True)))
    some = F.filter(F.transform("blocks", lambda b, i: F.struct(b["text"].alias("text"), F.lit(i).alias("i"))), lambda b: F.element_at("of", b["i"]).isNull())
    rest = left.join(gone, ["host", "row"], "left").withColumn("of", of)
    rest = rest.select(key, url, F.array_join(F.when(none, F.col("blocks.text")).otherwise(F.transform(some, lambda b: b["text"])), "\n").alias("text"))
    return sure.union(rest).select(key, url, "text", F.char_length("text").cast("long").alias("n_chars"))
