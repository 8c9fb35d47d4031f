"""Pages as rows: one tolerant pass of the standard parser over each page, in Arrow batches.

HTML is no XML, so no built-in reads it. Everything later stages ask of a page comes out of this one pass;
what they do with it is column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a new line of visible text, those that hide it, those without an end tag.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_CELLS = 20_000

SCHEMA = (
    "title string, h1 string, h2 string, meta map<string,string>, lines array<string>, links array<struct<href:string,text:string,rel:string>>, images array<struct<src:string,alt:string,width:int,height:int>>, "
    "json_ld array<string>, cells array<struct<tab:int,row:int,col:int,text:string,image:string>>, inputs map<string,string>"
)


def _whole(x: str | None) -> int | None:
    digits = "".join(c for c in x or "" if c.isdigit())
    return int(digits[:9]) if digits else None


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = {"title": None, "h1": None, "h2": None, "meta": {}, "lines": [], "links": [], "images": [], "json_ld": [], "cells": [], "inputs": {}}
        self.line: list[str] = []
        self.hidden: str | None = None
        self.script: list[str] | None = None
        self.heads: dict[str, list[str]] = {}
        self.link: tuple[str, str | None, list[str]] | None = None
        self.tables: list[list[int]] = []
        self.seen_tables = 0
        self.cell: list[dict] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.line).split())
        self.line = []
        if text:
            self.out["lines"].append(text)

    def _end_link(self) -> None:
        if self.link:
            href, rel, text = self.link
            self.out["links"].append({"href": href, "text": " ".join("".join(text).split()), "rel": rel})
            self.link = None

    def _end_cell(self) -> None:
        if self.cell:
            c = self.cell.pop()
            c["text"] = " ".join("".join(c["text"]).split())
            self.out["cells"].append(c)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in BLOCKS:
            self._end_line()
        if tag in HIDDEN:
            self.hidden, self.script = tag, [] if a.get("type", "").lower() == "application/ld+json" else None
        elif tag in ("title", "h1", "h2") and tag not in self.heads:
            self.heads[tag] = []
        elif tag == "meta" and (name := a.get("property") or a.get("name")) and "content" in a:
            self.out["meta"].setdefault(name.lower(), a["content"])
        elif tag == "a" and a.get("href"):
            self._end_link()
            self.link = (a["href"], a.get("rel") or None, [])
        elif tag == "link" and a.get("rel", "").lower() == "next" and a.get("href"):
            self.out["links"].append({"href": a["href"], "text": "", "rel": "next"})
        elif tag == "img" and a.get("src"):
            self.out["images"].append({"src": a["src"], "alt": a.get("alt") or a.get("title"), "width": _whole(a.get("width")), "height": _whole(a.get("height"))})
            if self.cell and not self.cell[-1]["image"]:
                self.cell[-1]["image"] = a["src"]
        elif tag == "input" and a.get("name"):
            self.out["inputs"].setdefault(a["name"], a.get("value", ""))
        elif tag == "table":
            self.tables.append([self.seen_tables, -1, -1])
            self.seen_tables += 1
        elif tag == "tr" and self.tables:
            self.tables[-1][1] += 1
            self.tables[-1][2] = -1
        elif tag in ("td", "th") and self.tables and len(self.out["cells"]) < MOST_CELLS:
            t = self.tables[-1]
            if self.cell and self.cell[-1]["tab"] == t[0]:
                self._end_cell()
            t[1] = max(t[1], 0)
            t[2] += 1
            self.cell.append({"tab": t[0], "row": t[1], "col": t[2], "text": [], "image": None})

    def handle_endtag(self, tag: str) -> None:
        if tag == self.hidden:
            if self.script is not None:
                self.out["json_ld"].append("".join(self.script).strip())
            self.hidden = self.script = None
        if tag in BLOCKS and tag not in VOID:
            self._end_line()
        if tag == "a":
            self._end_link()
        elif tag in ("title", "h1", "h2") and isinstance(self.heads.get(tag), list):
            self.out[tag] = " ".join("".join(self.heads[tag]).split()) or None
            self.heads[tag] = None
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "table" and self.tables:
            done = self.tables.pop()
            while self.cell and self.cell[-1]["tab"] == done[0]:
                self._end_cell()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.script is not None:
                self.script.append(data)
            return
        self.line.append(data)
        for parts in self.heads.values():
            if parts is not None:
                parts.append(data)
        if self.link:
            self.link[2].append(data)
        for c in self.cell:
            c["text"].append(data)

    def page(self, body: str) -> dict:
        self.feed(body)
        self.close()
        self._end_line()
        self._end_link()
        while self.cell:
            self._end_cell()
        return self.out


def parse_page(body: str | None) -> dict:
    """The parts of one page; a null or empty body has none, broken markup gives what can be read."""
    return _Page().page(body or "")


def parse_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages without their body, with the parts of SCHEMA as columns."""
    kept = [c for c in pages.columns if c != body]
    parts = [f.split(" ")[0] for f in ("title", "h1", "h2", "meta", "lines", "links", "images", "json_ld", "cells", "inputs")]
    target = pages.sparkSession.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in target}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_page(b) for b in batch["_body"].to_pylist()]
            columns = [batch[c] for c in kept]
            for p in parts:
                values = [list(r[p].items()) if isinstance(r[p], dict) else r[p] for r in rows]
                columns.append(pa.array(values, types[p]))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *parts])

    fields = ", ".join([*(f"`{c}` {kind}" for c, kind in pages.dtypes if c != body), SCHEMA])
    return pages.select(*kept, F.col(body).alias("_body")).mapInArrow(run, fields)


def json_nodes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(<keys>, place, kind, node): every object in the pages' JSON-LD, outer before inner; broken JSON is left out."""

    def walk(x: object) -> Iterator[dict]:
        stack = [x]
        while stack:
            top = stack.pop()
            if isinstance(top, dict):
                yield top
                stack.extend(reversed(list(top.values())))
            elif isinstance(top, list):
                stack.extend(reversed(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, kind, node = [], [], [], []
            for i, texts in enumerate(batch["json_ld"].to_pylist()):
                at = 0
                for text in texts or []:
                    try:
                        tree = json.loads(text)
                    except ValueError:
                        continue
                    for x in walk(tree):
                        k = x.get("@type")
                        row.append(i)
                        place.append(at)
                        kind.append(k if isinstance(k, str) else ",".join(map(str, k)) if isinstance(k, list) else None)
                        node.append(json.dumps(x))
                        at += 1
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[k].take(taken) for k in keys), pa.array(place, pa.int32()), pa.array(kind, pa.string()), pa.array(node, pa.string())], [*keys, "place", "kind", "node"])

    kinds = dict(pages.dtypes)
    return pages.select(*keys, "json_ld").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "place int, kind string, node string"]))


def page_title(pages: DataFrame, out: str = "page_title") -> DataFrame:
    """Adds the first of the page's headings and titles that isn't empty."""
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    return pages.withColumn(out, F.coalesce(tidy(F.col("h1")), tidy(F.col("h2")), tidy(F.col("meta")["og:title"]), tidy(F.col("meta")["twitter:title"]), tidy(F.col("title"))))


def labelled_value(lines: str, label: str):
    """The value of a ``Label: value`` line, else the next line that is no label itself; null without one."""
    at = F.expr(f"array_position(transform({lines}, x -> lower(x) rlike '^{label}\\\\s*:'), true)")
    own = F.regexp_extract(F.get(lines, at - 1), r"^[^:]*:\s*(.*)$", 1)
    after = F.get(F.filter(F.slice(lines, at + 1, 3), lambda x: ~x.rlike(r"^[^:]{1,40}:")), F.lit(0))
    return F.when(at > 0, F.coalesce(F.nullif(own, F.lit("")), after))


def table_records(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(<keys>, tab, col, texts, image): each table's columns as records, their cells in order of rows."""
    cell = pages.select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")
    held = F.sort_array(F.collect_list(F.struct("row", "text", "image")))
    whole = cell.groupBy(*keys, "tab", "col").agg(held.alias("held"))
    return whole.select(*keys, "tab", "col", F.col("held.text").alias("texts"), F.get(F.filter("held.image", lambda x: x.isNotNull()), F.lit(0)).alias("image"))


def sitemap_urls(pages: DataFrame, body: str = "body") -> DataFrame:
    """(url, place): the locations of sitemaps, each once, at its first place."""
    found = pages.select(F.posexplode(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), 1)).alias("place", "url"))
    return found.groupBy("url").agg(F.min("place").alias("place")).select("url", "place")
