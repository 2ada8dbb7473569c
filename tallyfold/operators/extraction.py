"""Extraction over page tables: templates, e-mail channels, URL joins, NFKC text. A page is parsed once, in Arrow batches; cheap tests come first in Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "page_id long, block int, core map<string,string>, source_data map<string,string>, missing array<string>, detail_url string, detail_source string"
CHANNEL = "page_id long, email string, channel string"
TRACE = "page_id long, label string, xpath string, regex string, matches int, value string, previews array<string>, attempts array<struct<index:int,matched:boolean,value:string,preview:string>>, matched_index int, status string"
#: Rows that a task holds before it hands them on.
ROWS = 2048
#: Bytes of pages that capture moves to Python at once; a smaller bound of the session's stays.
BATCH_BYTES = 4 << 20


def rows_of(pages: DataFrame, schema: str, one: Callable, *columns: str) -> DataFrame:
    """What one(page_id, *columns) yields of each page, as rows of the schema."""
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(struct)

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", *columns))):
                out += one(*row)
                if len(out) >= ROWS:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), *columns).mapInArrow(run, schema)


def capture(pages: DataFrame) -> DataFrame:
    """Pages as the operators read them: answers with status 200 where a status is known, text in Unicode's NFKC form."""

    def run(batches: Iterator) -> Iterator:
        from unicodedata import is_normalized, normalize

        import pyarrow as pa

        for b in batches:
            texts = [t if t is None or is_normalized("NFKC", t) else normalize("NFKC", t) for t in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "html" else c for f, c in zip(b.schema, b.columns)], schema=b.schema)

    if "status" in pages.columns:
        pages = pages.where("status = 200")
    # by rows alone, as a UDF's are cut, a batch of pages takes tens of MB, of which a worker holds several copies
    conf, bound = pages.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(bound, None) or ""
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(bound, str(BATCH_BYTES))
    return pages.mapInArrow(run, pages.schema)


def email_channels(pages: DataFrame) -> DataFrame:
    """(page_id, email, channel) of the seven places where pages keep e-mails."""

    def one(page_id, html):
        from tallyfold.functions.html import email_channels as channels

        return [(page_id, e, c) for e, c in channels(html)]

    # what stands as an entity in the markup, as &#64;, passes too
    return rows_of(pages.where("html RLIKE '(?i)[@&]|at|email-protection|cfemail'"), CHANNEL, one, "html")


def extract_blocks(pages: DataFrame, template: dict) -> DataFrame:
    """A template's blocks of every page (page_id, url, html), with the labels of required fields that have no value."""
    text = json.dumps(template)

    def one(page_id, url, html):
        from tallyfold.functions.template import program

        return [(page_id, i, list(core.items()), list(dynamic.items()), missing, to, source) for i, core, dynamic, missing, to, source in program(text).blocks(html, url or "")]

    return rows_of(pages, BLOCK, one, "url", "html")


def extract_pages(pages: DataFrame, fields: list[dict], keep: str = "") -> DataFrame:
    """One row a page: fields found anywhere on it, e-mail fields with their fallback; keep: "url" for the page's own URL beside them."""
    text = json.dumps(fields)

    def one(page_id, url, html):
        from tallyfold.functions import html as H
        from tallyfold.functions.template import contact, page_fields

        core, dynamic, missing = contact(H.parse(html), page_fields(text), url or "", html or "")
        return [(page_id, 1, list(core.items()), list(dynamic.items()), missing, "", "", *([url] if keep else []))]

    return rows_of(pages, BLOCK + (", url string" if keep else ""), one, "url", "html")


def whole_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that lack no required field."""
    return blocks.where("size(missing) = 0")


def with_details(blocks: DataFrame, details: DataFrame) -> DataFrame:
    """Blocks with their detail page's values over their own: blocks have detail_url, details have url; a URL's first detail counts."""
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    empty = F.create_map().cast("map<string,string>")
    first = details.groupBy("url").agg(F.min_by(F.struct("core", "source_data"), "page_id").alias("detail"))
    both = blocks.join(first, F.col("detail_url") == F.col("url"), "left")
    new = lambda c: F.coalesce(F.col(f"detail.{c}"), empty)
    return both.withColumn("core", over(F.col("core"), new("core"))).withColumn("source_data", over(F.col("source_data"), new("source_data"))).select(*blocks.columns)


def asked_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those pages that a block names as its detail page: only they are parsed. One broadcast or shuffle of the distinct names, none of the parsed rows."""
    names = blocks.where("detail_url <> ''").select("detail_url").distinct()
    return pages.join(names, pages["url"] == names["detail_url"], "left_semi")


def traces(pages: DataFrame, fields: list[dict]) -> DataFrame:
    """How each field of each page got its value, and its status."""
    text = json.dumps(fields)

    def one(page_id, html):
        from tallyfold.functions import html as H
        from tallyfold.functions.template import page_fields

        root = H.parse(html)
        return [(page_id, *f.trace(root).values()) for f in page_fields(text)]

    return rows_of(pages, TRACE, one, "html")


def absolute_links(rows: DataFrame, base: str, link: str, into: str) -> DataFrame:
    """rows with a link resolved against its page, dot segments and all."""
    @F.pandas_udf("string")
    def joined(bases: pd.Series, links: pd.Series) -> pd.Series:
        from tallyfold.functions.template import absolute

        return pd.Series([absolute(b or "", x) for b, x in zip(bases, links)], dtype=object)

    return rows.withColumn(into, joined(F.col(base), F.col(link)))
