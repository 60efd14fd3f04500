"""Landed web pages: list records, links, error pages (expressions), and detail text (an Arrow UDF, since no built-in parses HTML)."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard.functions.dates import parsed
from noticeboard.functions.text import SUFFIXES, blank, has_any, strip
from noticeboard.sources.registry import connector
from noticeboard.sources.tables import ship

#: fixed values: what error pages say, and link texts that name no file
ERROR_MARKERS = ("404 not found", "nginx 404", "error 404", "页面不存在", "您访问的页面不存在", "系统发生错误", "访问出错")
CONTAINERS = ("#Zoom", ".TRS_Editor", ".content_box_nr #Zoom", ".content_box_nr", ".article-content", ".main-content", ".detail-content", ".content", ".text")
AUXILIARY = ("ckywj", "dyby", "clear")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def list_records(pages: DataFrame, now: Column, *, url_col: str = "url", html_col: str = "html", wrapped: bool = True) -> DataFrame:
    """Title, href, publish_date of each record of list pages; records without a link or a title are left out.

    wrapped: the records stand in a datastore element (a first page); else anywhere.
    """
    body = F.regexp_extract(html_col, r"(?s)<datastore>(.*?)</datastore>", 1) if wrapped else F.col(html_col)
    record = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<record><!\[CDATA\[(.*?)\]\]></record>"), F.lit(1))).alias("r")
    r = pages.select(F.col(url_col).alias("page_url"), record)
    r = r.select("page_url", strip(F.regexp_extract("r", r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)).alias("href"), strip(F.regexp_replace(F.regexp_extract("r", r"""(?is)<span\b[^>]*class\s*=\s*["'][^"']*\blist_title\b[^"']*["'][^>]*>(.*?)</span>""", 1), "<[^>]*>", "")).alias("title"), F.regexp_extract("r", r"(?is)<i\b[^>]*>(.*?)</i>", 1).alias("d"))
    return r.filter("href <> '' and title <> ''").select("page_url", "href", "title", parsed(F.col("d"), now).alias("publish_date"))


def is_list_page(html: Column) -> Column:
    return has_any(F.lower(html), ("<datastore", "<record", "<![cdata["))


def page_title(html: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def is_error_page(text: Column, attachments: Column) -> Column:
    """Without attachments, and empty, marked as an error, or a short text with a status code."""
    v = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (attachments == 0) & (blank(v) | has_any(v, ERROR_MARKERS) | ((F.length(v) <= 80) & v.rlike(r"\b(?:403|404|500|502|503)\b")))


def link_filename(url: Column) -> Column:
    """From the query (filename, file, name, download), else the last part of the path."""
    keys = [F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1), F.lit("")) for k in ("filename", "file", "name", "download")]
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.try_url_decode(F.element_at(F.split(F.coalesce(*keys, path), "/"), -1))


#: fixed values: link texts that name no file
GENERIC_TEXTS = ("附件", "下载", "点击下载", "查看附件", "点击查看原文件")
_SUFFIX = "|".join(re.escape(x) for x in SUFFIXES)


def attachment_name(text: Column, url: Column) -> Column:
    """A link's text as file name, with the suffix of its URL where the two differ; where the text names nothing, the name in the URL."""
    t = F.regexp_replace(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), r"^[：: ]+|[：: ]+$", "")
    t = F.regexp_replace(t, rf"(?i)({_SUFFIX})\s+[xX]$", "$1")
    name = F.coalesce(link_filename(url), F.lit(""))
    suffix = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    own = F.regexp_extract(t, rf"(?i)({_SUFFIX})$", 1)
    swapped = F.concat(F.regexp_replace(t, rf"(?i)(?:{_SUFFIX})$", ""), suffix)
    named = (t != "") & ~F.lower(t).isin(*GENERIC_TEXTS)
    return (
        F.when((own != "") & (suffix != "") & (F.lower(own) != F.lower(suffix)), swapped)
        .when(own != "", t)
        .when(named & (suffix != ""), F.concat(t, suffix))
        .when(named, t)
        .when(name != "", name)
        .otherwise(F.coalesce(F.nullif(t, F.lit("")), F.lit("未命名附件")))
    )


def site_root(url: Column) -> Column:
    """Scheme and host of a URL; null if it has none."""
    return F.nullif(F.regexp_extract(strip(F.coalesce(url, F.lit(""))), r"^([A-Za-z][\w+.-]*://[^/?#]+)", 1), F.lit(""))


PAGING = ("columnid", "unitid", "webid")


def paging_params(url: Column, overrides: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> Column:
    """The parameters of a list's further pages, name -> value, from the query, the column's number in the path, and what overrides them; null if one is missing."""
    of_path = F.nullif(F.regexp_extract(url, r"/col/col(\d+)", 1), F.lit(""))
    values = []
    for k in PAGING:
        query = F.nullif(F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1), F.lit(""))
        given = F.lit((overrides or {}).get(k) or None).cast("string")
        values.append(F.coalesce(given, query, *([of_path] if k == "columnid" else []), F.lit((defaults or {}).get(k)).cast("string")))
    whole = values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    return F.when(whole, F.create_map(*[x for k, v in zip(PAGING, values, strict=True) for x in (F.lit(k), v)]))


def crawl(fetch: Callable[[int], DataFrame], most: int, cancelled: Callable[[], bool] = lambda: False) -> tuple[DataFrame, int]:
    """Pages 1 to `most` of a landed list by `fetch(number)`. The first page's failure is raised; a later one, or a page without records, ends the run. Returns the records and how many pages gave some."""
    out, n = fetch(1), 1
    for number in range(2, most + 1):
        if cancelled():
            break
        try:
            more = fetch(number)
            if more.isEmpty():
                break
        except Exception:  # noqa: BLE001  what failed later keeps what came before
            break
        out, n = out.unionByName(more), number
    return out, n


#: fixed values: answers worth another try
RETRY = (408, 425, 429, 500, 502, 503, 504)


def next_try(attempts: DataFrame, most: int = 2, step: float = 0.25) -> DataFrame:
    """Of a fetcher's log (url, attempt from 0, status or null for a transport error) each url's outcome: done, retry with the seconds to wait, or failed."""
    last = attempts.groupBy("url").agg(F.max_by(F.struct("attempt", "status"), "attempt").alias("l")).select("url", "l.*")
    again = F.col("status").isNull() | F.col("status").isin(*RETRY)
    ok = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    state = F.when(ok, "done").when(again & (F.col("attempt") < most), "retry").otherwise("failed")
    return last.select("url", "attempt", "status", state.alias("outcome"), F.when(state == "retry", step * (F.col("attempt") + 1)).alias("wait_seconds"))


def list_counts(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """Pages with how many records they hold and how many of these lack a link or a title, and whether a first page lacks its datastore."""
    rs = F.regexp_extract_all(html_col, F.lit(r"(?s)<record><!\[CDATA\[(.*?)\]\]></record>"), F.lit(1))
    bad = lambda r: ~r.rlike(r"""(?is)<a\b[^>]*\bhref\s*=\s*["'][^"']+["']""") | ~r.rlike(r"(?is)list_title[^>]*>\s*[^<\s]")
    return pages.withColumns({"n_records": F.size(rs), "n_skipped": F.size(F.filter(rs, bad)), "no_datastore": ~F.contains(F.lower(html_col), F.lit("<datastore"))})


def file_type(name: Column, url: Column) -> Column:
    """The known suffix of a name or URL, '' for none."""
    out = F.lit("")
    for s in reversed(SUFFIXES):
        out = F.when(F.lower(name).endswith(s) | F.lower(link_filename(url)).endswith(s) | F.lower(url).endswith(s), s[1:]).otherwise(out)
    return out


def links(pages: DataFrame, *, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Key, href of all links, each once (the first), with its position. Built-in expressions only."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    one = pages.select(key, F.posexplode(hrefs).alias("position", "href"))
    return one.groupBy(key, "href").agg(F.min("position").alias("position"))


#: fixed values of HTML: a start tag of the key closes an open element of the first names, up to one of the second
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
IMPLIED = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
IMPLIED |= {t: (("p",), ("td", "th", "li", "table", "div")) for t in _BLOCKS}


class _Page(HTMLParser):
    """Text blocks and links of a page's main container, in one pass over a stack of open elements.

    Start tags close what HTML lets be left open (p, li, td, tr, ...); an end tag closes what is open inside its
    element, and one without an open element is nothing.
    """

    def __init__(self, container: tuple[str, str] | None):
        super().__init__(convert_charrefs=True)
        self.want, self.all = container, container is None
        self.stack: list[tuple[str, bool, bool]] = []  # name, is it the container, is it left out
        self.inside, self.skip, self.tables = int(self.all), 0, 0
        self.rows, self.blocks, self.loose, self.links = [], [], [], []
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None
        self.block: list[str] | None = None
        self.link: list | None = None

    def _pop(self) -> None:
        tag, container, out = self.stack.pop()
        self.skip -= out
        if self.inside and not self.skip and not out:
            if tag in ("td", "th") and self.cell is not None and self.cells is not None:
                self.cells.append(_joined(self.cell))
                self.cell = None
            elif tag == "tr" and self.cells is not None:
                if row := [c for c in self.cells if c]:
                    self.rows.append(" | ".join(row))
                self.cells = None
            elif tag == "table":
                self.tables -= 1
            elif tag in ("p", "li"):
                self._end_block()
            elif tag == "a" and self.link is not None:
                self.links.append((self.link[0], _joined(self.link[1])))
                self.link = None
        if container:
            self.inside, self.want = 0, None  # only the first container

    def _end_block(self) -> None:
        if self.block is not None and (text := _joined(self.block)):
            self.blocks.append(text)
        self.block = None

    def _close_implied(self, tag: str) -> None:
        names, until = IMPLIED.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        self._close_implied(tag)
        if tag not in VOID:
            container = bool(self.want) and not self.inside and (a.get("id") == self.want[1] if self.want[0] == "#" else self.want[1] in classes)
            out = tag in ("script", "style") or any(c in AUXILIARY for c in classes)
            self.stack.append((tag, container, out))
            self.inside += container
            self.skip += out
        if not self.inside or self.skip:
            return
        if tag == "table":
            self.tables += 1
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag in ("p", "li") and not self.tables:
            self._end_block()
            self.block = []
        elif tag == "a" and a.get("href", "").strip():
            self.link = [a["href"].strip(), []]

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def close(self) -> None:
        super().close()
        while self.stack:
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.inside and not self.skip and data.strip():
            self.loose.append(data.strip())
            for part in (self.cell, self.block, self.link[1] if self.link else None):
                if part is not None:
                    part.append(data.strip())


def _joined(parts: list[str]) -> str:
    return re.sub(r"[ \t\r\n 　]+", " ", " ".join(parts)).strip()


def container_of(html: str) -> tuple[str, str] | None:
    """The first selector of the list that the page has."""
    for s in CONTAINERS:
        kind, name = s.split()[-1][0], s.split()[-1][1:]
        attr = "id" if kind == "#" else "class"
        if re.search(rf"""<[^>]+\b{attr}\s*=\s*["'][^"']*(?<![\w-]){re.escape(name)}(?![\w-])[^"']*["']""", html):
            return kind, name
    return None


def detail(html: str | None, url: str | None) -> dict:
    """Content (tables first, then paragraphs, else all text) and attachments."""
    html = html or ""
    p = _Page(container_of(html))
    p.feed(html)
    p.close()
    attachments, seen = [], set()
    for href, text in p.links:
        full = urljoin(url or "", href)
        name = re.sub(r"\s+", " ", text).strip("：: ") or full.rsplit("/", 1)[-1]
        kind = next((s[1:] for s in SUFFIXES if name.lower().endswith(s) or full.split("?")[0].lower().endswith(s)), "")
        if kind and full not in seen:
            seen.add(full)
            attachments.append({"filename": name if name.lower().endswith(SUFFIXES) else f"{name}.{kind}", "file_url": full, "file_type": kind})
    names = {a["filename"] for a in attachments}
    blocks = (["\n".join(p.rows)] if p.rows else []) + [b for b in p.blocks if b and not any(n in b for n in names)]
    return {"content": "\n\n".join(blocks) or "\n".join(p.loose), "attachments": attachments}


DETAIL = "struct<content:string,attachments:array<struct<filename:string,file_url:string,file_type:string>>>"


def details(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with `detail` and `detail_failed`. The parser runs on Arrow batches; a page it can't read is a failed one."""

    ship(pages.sparkSession)

    def parse(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        rows = []
        for u, h in zip(url, html, strict=True):
            try:
                rows.append(detail(h, u))
            except (ValueError, AssertionError, RecursionError):
                rows.append({"content": "", "attachments": []})
        return pd.DataFrame(rows, columns=["content", "attachments"])

    d = pages.withColumn("detail", F.pandas_udf(parse, DETAIL)(url_col, html_col))
    return d.withColumn("detail_failed", is_error_page(F.concat_ws("\n", page_title(F.col(html_col)), "detail.content"), F.size("detail.attachments")))




@connector("landed_pages")
def landed_pages(spark: SparkSession, location: str, **options) -> DataFrame:
    """Pages that a fetcher left in a folder, as url (the file's path) and html."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", options.get("glob", "*.html")).load(location)
    return files.select(F.col("path").alias("url"), F.decode("content", "utf-8").alias("html"), "modificationTime")
