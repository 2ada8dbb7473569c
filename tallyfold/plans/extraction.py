"""Queries that read pages as trees; DuckDB texts where SQL can tell the same from patterns."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import links as L
from tallyfold.functions.dialect import DuckDB, Spark
from tallyfold.operators import extraction as X
from tallyfold.plans import listing
from tallyfold.plans.base import mailed
from tallyfold.sources.tables import view

#: Paragraphs of a page as blocks, their links and numbers as fields.
PARAGRAPHS = {
    "fast": {
        "block_xpath": "//p",
        "fields": [
            {"label": "text", "target_field": "text", "xpath": "normalize-space(.)", "required": True},
            {"label": "site", "target_field": "website", "xpath": "//a/@href"},
            {"label": "number", "target_type": "dynamic", "target_field": "number", "xpath": ".", "regex": "([0-9]{3,})"},
        ],
    },
    "slow": {"enabled": True, "detail_url_xpath": "//a/@href"},
}


#: A protected link to info@acmefix.com and a block of linked data.
PROTECTED = '<a href="/cdn-cgi/l/email-protection#2a43444c456a4b49474f4c435204494547">x</a><script type="application/ld+json">{"contact":[{"Email":"Desk@acmefix.com"}]}</script>'


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_email_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each page's e-mails; the sample pages get some, a protected one among them."""
    pages = view(spark, sf_dir, f"SELECT page_id, url, html FROM {mailed(Spark())}")
    return X.email_channels(pages.withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, PROTECTED).otherwise(""))))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's blocks that lack no required field, as plain columns."""
    found = X.whole_blocks(X.extract_blocks(_pages(spark, sf_dir), PARAGRAPHS))
    return found.select("page_id", "block", F.col("core")["text"].alias("text"), F.col("core")["domain"].alias("site"), F.col("source_data")["number"].alias("number"), "detail_url", "detail_source")


def page_field_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two fields of each page got their values."""
    fields = [{"label": "title", "xpath": "//title"}, {"label": "numbers", "xpath": "//p", "regex": "[0-9]{3,}"}]
    return X.traces(_pages(spark, sf_dir), fields).select("page_id", "label", "matches", "value", "matched_index", "status", F.size("attempts").alias("n_attempts"), F.to_json("previews").alias("previews"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in Unicode's NFKC form."""
    return X.capture(_pages(spark, sf_dir)).select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("html_sha256"))


def page_absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages resolved against them."""
    links = _pages(spark, sf_dir).select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#][^"]*)"'), F.lit(1))).alias("href")).distinct()
    return X.absolute_links(links, "url", "href", "link").select("page_id", "href", "link")


_SHOWN = ("name", "url", "rating", "reviews", "business_type", "address", "hours", "phone", "site", "email", "sponsored")


def _spread(pages: DataFrame) -> DataFrame:
    """Made-up pages, which come out of few tasks, over as many as work side by side."""
    spark = pages.sparkSession
    return pages.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # by no key: one by page_id would be left out as already there


def listing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of listing pages with their eleven values; N/A where one is missing, as e-mails always are in a list."""
    found = X.whole_blocks(X.extract_blocks(_spread(view(spark, sf_dir, listing.LISTING_PAGES)), listing.LISTING))
    name = lambda c: "business_name" if c == "name" else "review_count" if c == "reviews" else c
    return found.select("page_id", "block", *[F.coalesce(F.col("core")[name(c)], F.lit("Not Sponsored" if c == "sponsored" else "N/A")).alias(c) for c in _SHOWN])


def place_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place pages' values; N/A where one is missing."""
    found = X.extract_pages(_spread(view(spark, sf_dir, listing.PLACE_PAGES)), listing.DETAIL)
    name = lambda c: {"name": "business_name", "reviews": "review_count"}.get(c, c)
    return found.select("page_id", *[F.coalesce(F.col("core")[name(f["label"])], F.lit("N/A")).alias(f["label"]) for f in listing.DETAIL])


def listing_with_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed places with what their own pages say laid over it; only pages that a block names are parsed."""
    blocks = X.whole_blocks(X.extract_blocks(_spread(view(spark, sf_dir, listing.LISTING_PAGES)), listing.LISTING | {"slow": {"enabled": True}})).persist(StorageLevel.DISK_ONLY)  # read for the names and for the rows
    pages = X.asked_pages(view(spark, sf_dir, listing.PLACE_PAGES), blocks)
    details = X.extract_pages(_spread(pages), listing.DETAIL, keep="url")
    return X.with_details(blocks, details).select("page_id", "block", *[F.col("core")[c].alias(c) for c in ("business_name", "address", "phone", "category", "hours_detail")])


QUERIES = {f.__name__: f for f in (page_email_channels, page_blocks, page_field_traces, page_captures, page_absolute_links, listing_results, place_details, listing_with_details)}

#: The texts of pages' paragraphs in order, by patterns: a paragraph goes on to its end tag or to the next element that ends it.
_ENDS = "(?is)(?:</(?:p|article|div|nav|body|html)>|<(?:p|div|article|footer|nav|ul|ol|h[1-6]|table)[ >]).*$"
_ENTITIES = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT = _ENTITIES.format("trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))")
_P = f"""SELECT page_id, CAST(i AS INTEGER) AS block, {_TEXT.format(f"regexp_replace(parts[i + 1], '{_ENDS}', '')")} AS text
FROM (SELECT page_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT page_id, string_split_regex(html, '(?i)<p(?:\\s[^>]*)?>') AS parts FROM pages) s) t"""
_PREVIEWS = "list_transform(list_slice({0}, 1, 3), lambda v: substring(v, 1, 300))"
_B = "CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY floor(c_custkey / 10) ORDER BY c_custkey) AS INTEGER) AS block"
_OLDER = "lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[<>\"'']+|[<>\"'']+$', '', 'g'), '^(?i:mailto:)', ''), '[?#&,;].*$', '')))"
_FOUND = "SELECT page_id, unnest(regexp_extract_all({0}, '{1}', 0)) AS raw FROM {2}"
_MAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"
#: The page's texts, scripts and styles left out, each trimmed; then at and dot as signs.
_BARE = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g')"
_JOINED = "array_to_string(list_filter(list_transform(string_split_regex(" + _BARE + ", '<[^>]*>'), lambda v: regexp_replace(" + _ENTITIES.format("v") + ", '^\\s+|\\s+$', '', 'g')), lambda v: v <> ''), ' ')"


def _signs(x: str) -> str:
    x = f"concat(' ', lower({x}), ' ')"
    for pattern, to in (("\\s*[(\\[]?at[)\\]]?\\s*", "@"), ("\\s*[(\\[]?dot[)\\]]?\\s*", "."), ("\\s+@\\s+", "@"), ("\\s*[.]\\s*", ".")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


#: What the made-up pages were made of.
ORACLES = {
    "page_email_channels": f"""WITH m AS (SELECT page_id, concat(html, CASE WHEN page_id % 3 = 0 THEN '{PROTECTED}' ELSE '' END) AS html FROM {mailed(DuckDB())})
SELECT DISTINCT page_id, email, channel FROM (
  SELECT page_id, {_OLDER.format('raw')} AS email, 'raw' AS channel FROM ({_FOUND.format('html', _MAIL, 'm')}) a
  UNION ALL SELECT page_id, {_OLDER.format('raw')}, 'mailto' FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a href="(mailto:[^"]*)"', 1)) AS raw FROM m) b
  UNION ALL SELECT page_id, 'info@acmefix.com', 'protected link' FROM m WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'desk@acmefix.com', 'linked data' FROM m WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, {_OLDER.format('raw')}, 'text' FROM ({_FOUND.format(_signs(_JOINED), _MAIL, 'm')}) c) u WHERE email <> ''""",
    # the sample's letters are their own compatibility forms: the composed form is NFKC there
    "page_captures": "SELECT page_id, url, sha256(nfc_normalize(html)) AS html_sha256 FROM pages",
    "page_absolute_links": f"SELECT page_id, href, {L.slashless(DuckDB(), 'whole')} AS link FROM (SELECT page_id, href, {L.joined(DuckDB(), 'url', 'href')} AS whole FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"#][^\"]*)\"', 1)) AS href FROM pages) l) j",
    "page_blocks": f"SELECT page_id, block, text, NULL AS site, nullif(regexp_extract(text, '[0-9]{{3,}}'), '') AS number, '' AS detail_url, '' AS detail_source FROM ({_P}) p WHERE text <> ''",
    "page_field_traces": f"""WITH p AS (SELECT page_id, list(text ORDER BY block) FILTER (WHERE text <> '') AS v FROM ({_P}) p GROUP BY page_id),
q AS (SELECT g.page_id, coalesce(p.v, []) AS v FROM pages g LEFT JOIN p ON p.page_id = g.page_id),
n AS (SELECT page_id, v, list_transform(v, lambda x: regexp_extract(x, '[0-9]{{3,}}')) AS hits FROM q),
f AS (SELECT page_id, v, hits, list_filter(range(1, len(hits) + 1), lambda i: hits[i] <> '') AS hit FROM n),
t AS (SELECT page_id, {_TEXT.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM pages)
SELECT page_id, 'title' AS label, CAST(CASE WHEN title = '' THEN 0 ELSE 1 END AS INTEGER) AS matches, title AS value, 0 AS matched_index, CASE WHEN title = '' THEN 'xpath_empty' ELSE 'ok' END AS status, 0 AS n_attempts, CAST(to_json(CASE WHEN title = '' THEN [] ELSE [substring(title, 1, 300)] END) AS VARCHAR) AS previews FROM t
UNION ALL SELECT page_id, 'numbers', CAST(len(v) AS INTEGER), value, CAST(CASE WHEN hit[1] <= 12 THEN hit[1] ELSE 0 END AS INTEGER), CASE WHEN value <> '' THEN 'ok' WHEN len(v) > 0 THEN 'regex_empty' ELSE 'xpath_empty' END,
CAST(least(len(v), 12) AS INTEGER), CAST(to_json({_PREVIEWS.format('v')}) AS VARCHAR) FROM (SELECT *, CASE WHEN len(hit) > 0 THEN hits[hit[1]] ELSE regexp_extract(array_to_string(v, ' '), '[0-9]{{3,}}') END AS value FROM f) g""",
    "listing_results": f"""SELECT {_B}, concat('Shop ', c_custkey) AS name, concat('{listing.PLACE}', c_custkey, '/') AS url, concat('4.', c_custkey % 10) AS rating, CAST(c_custkey AS VARCHAR) AS reviews,
lower(c_mktsegment) AS business_type, concat(c_custkey % 13, ' Main St') AS address, 'Open until 5' AS hours, 'N/A' AS email, concat('(555) 000-', 1000 + c_custkey % 9000) AS phone,
CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE concat('https://shop', c_custkey, '.com') END AS site, 'Not Sponsored' AS sponsored FROM customer""",
    "place_details": """SELECT c_custkey AS page_id, concat('Shop ', c_custkey, ' & Sons') AS name, concat(c_custkey % 13, ' Main St') AS address, 'N/A' AS located_in, 'N/A' AS plus_code, concat('+1 555 ', c_custkey % 17) AS phone,
concat('https://shop', c_custkey, '.com') AS site, 'N/A' AS booking_link, concat('4.', c_custkey % 10) AS rating, CAST(c_custkey AS VARCHAR) AS reviews, c_mktsegment AS category, 'N/A' AS hours, concat('Mon:', c_custkey % 9, '-18') AS hours_detail
FROM customer WHERE c_custkey % 2 = 0""",
    "listing_with_details": f"""SELECT {_B}, CASE WHEN c_custkey % 2 = 0 THEN concat('Shop ', c_custkey, ' & Sons') ELSE concat('Shop ', c_custkey) END AS business_name,
concat(c_custkey % 13, ' Main St') AS address,
CASE WHEN c_custkey % 2 = 0 THEN concat('+1 555 ', c_custkey % 17) ELSE concat('(555) 000-', 1000 + c_custkey % 9000) END AS phone,
CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS category, CASE WHEN c_custkey % 2 = 0 THEN concat('Mon:', c_custkey % 9, '-18') END AS hours_detail FROM customer""",
}
