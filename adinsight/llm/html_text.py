"""Main text of web pages: site templates found by counting hashed element subtrees per host.

Every element of a page gets a hash of its whole subtree (tag, class and id, text and children). The hashes of all
elements that may be template are counted per host in Spark, once for each different main text, so copies of one page
do not make a template of it. Subtrees on ``MIN_PAGES`` or more different pages of their host, however large it is, are
deleted. Paragraph-like blocks of the article itself never are template: passages that many articles share
are text. What is left is cleaned by element names and class words, and the blocks of the article are returned, or of
the whole body where a page marks no article.

Character references are decoded, white space within a block becomes one space, blocks are joined by a line break.

Nulls: null html is an empty page, its text "". A null or odd URL has the host "". Rows with the same id or the same
html are pages of their own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import binary, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different pages of a host that share a template subtree.
MIN_PAGES = 5

# Element names of HTML by role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody td tfoot th thead tr ul""".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption tr".split())
INLINE_PART = frozenset("a abbr b big cite code em font i kbd mark q s samp small span strong sub sup tt u var".split())
NEVER = frozenset("""aside button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noscript
    object script search select style svg template textarea title video audio""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl article section div body aside main nav td th form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id attributes that name page furniture.
FURNITURE = frozenset("""ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter
    notice notices notification pagination pager popup promo promotion promoted recommended related reply replies respond search
    share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
_HEADERS = frozenset(("header", "pageheader", "siteheader"))

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")


class Page(NamedTuple):
    """A parsed page: elements in page order, and text runs with their element and block number."""

    tags: list[str]
    parents: list[int]
    marks: list[str]  # the attributes that matter
    hashes: list[int]
    runs: list[tuple[int, int, str]]


def parse(source: str) -> Page:
    import xxhash

    tags, parents, marks, content = ["#page"], [-1], [""], [[]]
    runs: list[tuple[int, int, str]] = []
    open_ = [0]
    opened: Counter[str] = Counter()  # open elements by name
    block = at = 0
    closed: list[int] = []
    hashes = [0]

    def text(until: int) -> None:
        if until > at:
            raw = source[at:until]
            runs.append((open_[-1], block, raw))
            content[open_[-1]].append(raw)

    def close() -> None:
        i = open_.pop()
        hashes[i] = xxhash.xxh3_64_intdigest(f"{tags[i]}|{marks[i]}|" + "".join(content[i])) & (2**63 - 1)
        content[i] = []
        content[open_[-1]].append(f"\0{hashes[i]}\0")
        closed.append(i)
        opened[tags[i]] -= 1

    def close_upto(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for k in range(len(open_) - 1, 0, -1):
            if tags[open_[k]] in names:
                while len(open_) > k:
                    close()
                return
            if tags[open_[k]] in stop:
                return

    for m in _TAG.finditer(source):
        if m.start() < at:  # inside a raw element
            continue
        text(m.start())
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in BLOCK:
                block += 1
            if opened[name]:
                while tags[open_[-1]] != name:
                    close()
                close()
            continue
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            block += 1
            if name not in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                close_upto({"p"}, SCOPE)
        if name in CLOSES:
            close_upto(CLOSES[name], SCOPE - CLOSES[name])
        if name in VOID:
            if name == "br":
                runs.append((open_[-1], block, " "))
            continue
        attributes = m[3] or m[5] or ""
        found = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ()
        tags.append(name)
        parents.append(open_[-1])
        marks.append(" ".join(f"{k}={v}" for k, v in found))
        content.append([])
        hashes.append(0)
        open_.append(len(tags) - 1)
        opened[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            text(stop)
            at = stop
    text(len(source))
    while len(open_) > 1:
        close()
    return Page(tags, parents, marks, hashes, runs)


def _areas(page: Page) -> list[int]:
    """The article element above each element (itself included), or 0; all are 1 where no page marks one."""
    wanted = {"article"} if "article" in page.tags else {"main"}
    out = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        up = out[page.parents[i]]
        out[i] = up or (i if page.tags[i] in wanted or "role=main" in page.marks[i] else 0)
    return out


def _furniture(page: Page, areas: list[int], i: int) -> bool:
    tag, marks = page.tags[i], page.marks[i]
    if tag in NEVER or tag == "header" and not areas[i]:
        return True
    if not marks or tag in ("html", "body"):
        return False
    for mark in marks.split(" "):
        key, _, value = mark.partition("=")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
    words = set(_NAME_WORDS.findall(re.sub(r"(?:^| )(?:role|hidden|aria-hidden)=\S*|(?:class|id)=", " ", marks.lower())))
    return bool(words & FURNITURE) and areas[i] != i or bool(words & _HEADERS) and not areas[i]


def candidates(page: Page) -> list[int]:
    """Elements that may be template: all outside the article, and containers inside it."""
    areas = _areas(page)
    wrappers = {page.parents[k] for k in range(1, len(page.tags)) if page.tags[k] in ("article", "main")}
    return [i for i in range(1, len(page.tags)) if areas[i] != i and i not in wrappers and page.tags[i] not in ("html", "body", "#page", "br")
            and not (areas[i] and (page.tags[i] in TEXTUAL or page.tags[i] in INLINE_PART))]


def blocks(page: Page, recurring: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Text blocks of the main area, without furniture and without the subtrees whose hashes recur."""
    areas = _areas(page)
    marked = any(areas)
    may = set(candidates(page)) if recurring else set()
    gone = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        gone[i] = gone[page.parents[i]] or i in may and page.hashes[i] in recurring or _furniture(page, areas, i)
    out, last = [], None
    for node, block, raw in page.runs:
        if gone[node] or marked and not areas[node]:
            continue
        if block != last:
            out.append([])
            last = block
        out[-1].append(raw)
    texts = (" ".join(entities.unescape("".join(parts)).split()) for parts in out)
    return [t for t in texts if t]


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _outlines(pages: DataFrame) -> DataFrame:
    """(key, host, content, subtrees) of each page of the rows (key, host, html): a hash of its text, and of its candidates."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, subtrees = [], []
            for source in binary(batch.column(2)):
                page = parse(source.decode())
                contents.append(xxhash.xxh3_64_intdigest("\n".join(blocks(page))) - 2**63)
                subtrees.append(sorted({page.hashes[i] for i in candidates(page)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(contents, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))],
                                             names=["key", "host", "content", "subtrees"])

    return pages.select("key", "host", "html").mapInArrow(run, "key long, host string, content long, subtrees array<long>")


def find_templates(outlines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that recur on different pages of a host."""
    seen = outlines.select("host", F.explode("subtrees").alias("subtree"), "content").distinct()
    counts = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_pages).select("host", "subtree")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: its id and URL and ``text``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _host(url_col).alias("host"),
                        F.coalesce(html_col, F.lit("")).alias("html")).withColumn("key", F.xxhash64("id", "url", "html"))
    outlines = written(_outlines(rows), "page-outlines")
    own = outlines.select("key", "host", F.explode("subtrees").alias("subtree"))
    # a template of the largest host is on a third of all pages: this join is one that Spark can split
    hit = own.join(find_templates(outlines, min_pages), ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("recurring"))
    carried = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # pages move once; packed, they are a third as large
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([zlib.compress(x, 1) for x in binary(batch.column(3))], pa.binary())],
                                             names=["id", "url", "key", "html"])

    light = rows.select("id", "url", "key", "html").mapInArrow(
        packed, T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("key", T.LongType()), T.StructField("html", T.BinaryType())]))
    joined = light.join(hit, "key", "left").select("id", "url", "html", "recurring")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(blocks(parse(zlib.decompress(source).decode()), set(recurring or ())))
                     for source, recurring in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[*carried.names, "text"])

    return joined.mapInArrow(extract, T.StructType([*carried, T.StructField("text", T.StringType())]))


def op4_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
