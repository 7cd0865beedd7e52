"""HTML and XML read with the standard library on executors: links with context, tables, text, page metadata, facts, spreadsheets."""

from __future__ import annotations

import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import map_rows

# Parts of a page that are no text; elements that a link's context is taken from; suffixes of page furniture; concept words of facts; row words of spreadsheets.
NO_TEXT = {"script", "style", "noscript", "svg", "nav", "header", "footer"}
HEADINGS, PARENTS = {"h1", "h2", "h3", "h4", "dt"}, {"li", "tr", "article", "section", "div", "p"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FURNITURE = (".jpg", ".jpeg", ".gif", ".png", ".css", ".xml", ".xsd")
CONCEPTS = ("revenue", "income", "profit", "earnings", "cash", "margin", "assets", "liabilities", "capital", "inventory", "backlog", "debt", "tax", "expense")
ROW_WORDS = ("revenue", "income", "margin", "cash", "guidance", "segment", "capex", "orders", "backlog", "inventory", "eps")
# end of fixed values
MOST_FACTS, MOST_SHEETS, MOST_ROWS, MOST_COLUMNS, MOST_SHEET_CHARS = 200, 30, 1200, 80, 60_000


class _Page(HTMLParser):
    """One pass over a page: links with their context, table rows, running text, scripts, titles and meta elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []  # element and its text so far
        self.heading, self.text, self.scripts, self.meta = "", [], [], {}
        self.links: list[dict] = []
        self.pending: list[tuple[dict, int]] = []  # links that wait for their parent's whole text
        self.rows: list[list[dict]] = []
        self.table, self.headline = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("property") or a.get("name") or a.get("itemprop") or "").lower(), a.get("content", ""))
        if tag == "table":
            self.table = a.get("class", "")
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append({"text": "", "href": "", "table": self.table, "th": tag == "th"})
        if tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "label": "", "heading": self.heading, "parent": ""})
            depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in PARENTS), None)
            if depth is not None:
                self.pending.append((self.links[-1], depth))
            if self.rows and self.rows[-1]:
                self.rows[-1][-1]["href"] = self.rows[-1][-1]["href"] or a["href"]
        if tag not in VOID:
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, parts = self.open.pop()
            said = " ".join(" ".join(parts).split())
            if t in HEADINGS:
                self.heading = said
            if t == "h1":
                self.headline = self.headline or said
            if t == "title":
                self.meta.setdefault("title", said)
            if t == "script":
                self.scripts.append("".join(parts))
            if t == "a" and self.links:
                self.links[-1]["label"] = self.links[-1]["label"] or said
            if t in ("td", "th") and self.rows and self.rows[-1]:
                self.rows[-1][-1]["text"] = said
            for link, depth in [p for p in self.pending if p[1] == len(self.open)]:
                link["parent"] = said
            self.pending = [p for p in self.pending if p[1] != len(self.open)]
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        inside = {t for t, _ in self.open}
        for t, parts in self.open:
            if t == "script" or not inside & {"script", "style"}:
                parts.append(data)
        if data.strip() and not inside & NO_TEXT:
            self.text.append(" ".join(data.split()))


def read_page(source: str | None) -> _Page:
    page = _Page()
    if isinstance(source, str):
        page.feed(source)
        page.close()
        while page.open:
            page.handle_endtag(page.open[-1][0])
    return page


def page_links(source: str | None, base: str | None) -> list[dict]:
    """Links of a page in order, with the page's headline, their label and context: label, heading before and parent's text, each once; also assets named in scripts with what is around them."""
    page, out = read_page(source), []
    for x in page.links:
        context = " ".join(dict.fromkeys(p for p in (x["label"], x["heading"], x["parent"]) if p))
        out.append({"at": len(out), "target": urljoin(base or "", x["href"]), "label": x["label"], "context": context, "headline": page.headline, "kind": "anchor"})
    for s in page.scripts:
        s = s.replace("\\/", "/")
        for m in re.finditer(r"((?:https?:)?//|/)[^\"'<>\s]{3,300}?\.(?:pdf|xlsx?|txt|html?)(?:\?[^\"'<>\s]*)?", s, re.I):
            out.append({"at": len(out), "target": urljoin(base or "", m[0]), "label": "", "context": s[max(0, m.start() - 700) : m.end() + 700], "headline": page.headline, "kind": "script"})
    return out


def attachments(source: str | None, base: str | None) -> list[dict]:
    """Rows of a filing index's table of files: description, type and link, without images and schemas."""
    out = []
    for row in read_page(source).rows:
        cells = [c for c in row if not c["th"]]
        link = next((c["href"] for c in row if c["href"]), None)
        if len(cells) < 4 or not link or "tableFile" not in cells[0]["table"]:
            continue
        url = urljoin(base or "", link)
        if not url.lower().split("?")[0].endswith(FURNITURE):
            kind = cells[3]["text"].upper()
            out.append({"description": cells[1]["text"] or kind, "document_type": kind, "url": url})
    return out


def clean_text(source: str | None) -> str:
    return "\n".join(read_page(source).text)


def published(source: str | None) -> dict:
    """A page's published time as text, title and description, from JSON-LD and then from meta elements."""
    page, when = read_page(source), None
    for s in page.scripts:
        try:
            data = json.loads(s)
        except ValueError:
            continue
        items = data if isinstance(data, list) else [data]
        items += [g for i in items if isinstance(i, dict) for g in (i.get("@graph") or [])]
        when = when or next((str(i["datePublished"]) for i in items if isinstance(i, dict) and i.get("datePublished")), None)
    m = page.meta
    when = when or m.get("article:published_time") or m.get("datepublished") or m.get("date") or None
    return {"published": when, "title": html.unescape(m.get("og:title") or m.get("title") or "") or None, "description": html.unescape(m.get("og:description") or m.get("description") or "") or None}


def inline_facts(source: str | None) -> list[dict]:
    """Facts tagged within a page's text, of known concepts, at most MOST_FACTS of them."""
    out = []
    for m in re.finditer(r"<([\w.-]+:)?nonfraction\b([^>]*)>(.*?)</(?:[\w.-]+:)?nonfraction>", source or "", re.I | re.S):
        a = {k.lower(): v for k, v in re.findall(r"([\w:-]+)\s*=\s*[\"']([^\"']*)[\"']", m[2])}
        value = " ".join(re.sub(r"<[^>]+>", " ", m[3]).split())
        if value and any(c in a.get("name", "").lower() for c in CONCEPTS):
            out.append({"concept": a["name"], "value": html.unescape(value), "context": a.get("contextref"), "unit": a.get("unitref"), "scale": a.get("scale"), "source_file": None})
        if len(out) == MOST_FACTS:
            break
    return out


def zipped_facts(blob: bytes | None, most_files: int = 12) -> list[dict]:
    """Facts in the XML files of an archive: elements with a context and a short value, of known concepts."""
    out: list[dict] = []
    try:
        z = zipfile.ZipFile(io.BytesIO(blob or b""))
    except zipfile.BadZipFile:
        return out
    for name in [n for n in z.namelist() if n.lower().endswith(".xml")][:most_files]:
        try:
            root = ET.fromstring(z.read(name))
        except ET.ParseError:
            continue
        for e in root.iter():
            tag, value = e.tag.rpartition("}")[2], (e.text or "").strip()
            if e.get("contextRef") and value and len(value) <= 100 and any(c in tag.lower() for c in CONCEPTS):
                out.append({"concept": tag, "value": value, "context": e.get("contextRef"), "unit": e.get("unitRef"), "scale": e.get("decimals"), "source_file": name})
                if len(out) == MOST_FACTS:
                    return out
    return out


def sheet_text(blob: bytes | None) -> str:
    """Rows of a spreadsheet that hold a known word, as "[sheet] cell | cell"."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    try:
        z = zipfile.ZipFile(io.BytesIO(blob or b""))
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets.get(s.get(rel), "")) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")][:MOST_SHEETS]
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return ""
    out: list[str] = []
    for title, target in sheets:
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in names:
            continue
        for k, row in enumerate(ET.fromstring(z.read(path)).iter(f"{ns}row")):
            if k >= MOST_ROWS:
                break
            cells = []
            for c in list(row)[:MOST_COLUMNS]:
                v = c.find(f"{ns}v")
                said = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                cells.append(strings[int(said)] if c.get("t") == "s" and said else said)
            line = " | ".join(x for x in cells if x)
            if any(w in line.lower() for w in ROW_WORDS):
                out.append(f"[{title}] {line}")
    return "\n".join(out)[:MOST_SHEET_CHARS]


def _each(df: DataFrame, key: str, cols: list[str], f, schema: str) -> DataFrame:
    """f of each row's columns gives dicts, which come out as rows with the key."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{key: k} | r for k, *v in zip(pdf[key], *[pdf[c] for c in cols]) for r in f(*v)]
            yield pd.DataFrame(rows, columns=names)

    names = [key, *(x.split()[0] for x in schema.split(", "))]
    return map_rows(df, [key], [F.col(c) for c in cols], run, schema)


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return _each(pages, key, ["html", "url"], page_links, "at int, target string, label string, context string, headline string, kind string")


def attachment_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return _each(pages, key, ["html", "url"], attachments, "description string, document_type string, url string")


def page_metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return _each(pages, key, ["html"], lambda h: [published(h)], "published string, title string, description string")


def page_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return _each(pages, key, ["html"], lambda h: [{"text": clean_text(h)}], "text string")


_FACT = "concept string, value string, context string, unit string, scale string, source_file string"


def facts(files: DataFrame, key: str = "path") -> DataFrame:
    """Facts of archives and of tagged pages; files has content as binary, as binaryFile reads it."""

    def read(blob: bytes | None) -> list[dict]:
        return zipped_facts(blob) if (blob or b"")[:2] == b"PK" else inline_facts((blob or b"").decode("utf-8", "replace"))

    return _each(files, key, ["content"], read, _FACT)


def extract(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, kind, text, raw_chars, truncated) of files by their first bytes: spreadsheets, archives, pages or plain text, none of them cut short but by a sheet's limit."""

    def read(blob: bytes | None) -> list[dict]:
        b = blob or b""
        if b[:2] == b"PK":
            said = sheet_text(b)
            kind = "spreadsheet" if said or b"xl/workbook.xml" in b else "archive"
            return [{"kind": kind, "text": said, "raw_chars": len(said), "truncated": len(said) == MOST_SHEET_CHARS}]
        if b[:4] == b"%PDF":
            return [{"kind": "pdf", "text": "", "raw_chars": 0, "truncated": True}]
        said = b.decode("utf-8", "replace")
        is_page = bool(re.search(r"<(?:html|body|p|div|table)\b", said[:4000], re.I))
        plain = clean_text(said) if is_page else said
        return [{"kind": "page" if is_page else "text", "text": plain, "raw_chars": len(said), "truncated": False}]

    return _each(files, key, ["content"], read, "kind string, text string, raw_chars long, truncated boolean")


def crawl_once(pages: DataFrame, found: DataFrame, most: int = 8, key: str = "page_id") -> DataFrame:
    """Links one level down: of each page, its own links and those of the first `most` distinct pages it links to that are there, each target once, first come first kept.

    Order is that of links on a page, so that the same pages give the same result in every run."""
    from brightloom.functions import urls
    from brightloom.operators.groups import first_rows, top_rows

    named = pages.groupBy(urls.asset_key(F.col("url")).alias("_key")).agg(F.min(key).alias("_to"))
    numbered = found.withColumn("_key", urls.asset_key(F.col("target")))
    hops = first_rows(numbered.join(named, "_key").where(F.col("_to") != F.col(key)).select(key, "_to", "at"), [key, "_to"], [F.col("at")])
    hops = top_rows(hops, [key], [F.col("at"), F.col("_to")], most, "_hop").select(F.col(key).alias("_from"), F.col("_to"), "_hop")
    below = numbered.join(hops, numbered[key] == hops["_to"]).select(F.col("_from").alias(key), "target", "context", "kind", "_key", "_hop", "at")
    every = numbered.select(key, "target", "context", "kind", "_key", F.lit(0).alias("_hop"), "at").unionByName(below)
    return first_rows(every, [key, "_key"], [F.col("_hop"), F.col("at")]).select(key, "target", "context", "kind", F.col("_hop").alias("hop"))
