"""Line deduplication by site-relative frequency (operator 6): DataFrame functions only.

Per site (host), the number of pages that contain a line is divided by the site's number of pages; lines over the
ratio are boilerplate of that site and are dropped from its pages.  Only hashes of lines are counted and shuffled;
the texts meet nothing but the positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import table

SPACES = " \t\n\x0b\f\r"
#: A line is boilerplate if more than this many of 1000 pages of its site have it, and at least MIN_PAGES do.
MAX_PERMILLE = 10
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def boilerplate(docs: DataFrame, site: Column, text: Column, max_permille: int = MAX_PERMILLE, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(site, line, pages, site_pages): the 128-bit digests of lines to drop, with their counts.

    Without ``copies`` pages of a site with the same text count as one page, in both counts.
    """
    if not copies:
        # A page's lines are the same for all copies; one digest per page is shuffled with them.
        page = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
        docs = docs.select(site.alias("site"), page.alias("page"), text.alias("text")).where("site is not null").groupBy("site", "page").agg(F.first("text").alias("text"))
        site, text = F.col("site"), F.col("text")
    # Within a page a line counts once, so pages are counted without a distinct over all rows.
    rows = docs.select(site.alias("site"), F.array_distinct(_digests(text)).alias("lines")).where("site is not null")
    totals = rows.groupBy("site").agg(F.count("*").alias("site_pages"))
    lines = rows.select("site", F.explode("lines").alias("line")).where("line is not null")
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "site").where(1000 * F.col("pages") > max_permille * F.col("site_pages")).select("site", "line", "pages", "site_pages")


def _digests(text: Column) -> Column:
    """One digest per line of the text; null for lines without a word."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.when(_key(x) != "", F.struct(F.xxhash64(_key(x)).alias("a"), F.xxhash64(F.lit(1), _key(x)).alias("b"))),
    )


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", max_permille: int = MAX_PERMILLE, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(row, clean, n_lines, n_dropped): each row of ``docs``, and its text without its site's boilerplate lines.

    Lines are compared without white space at their ends; lines without a word are neither counted nor dropped.  A
    row with a null site belongs to no site and loses nothing; a null text stays null and has no line; a page that
    occurs twice counts twice, or once without ``copies``; an empty table gives an empty one.  The row is kept in a struct of its own, so no
    column name can clash.  Rows are numbered where they are read, so ``docs`` has to be a table or a checkpoint.
    """
    site, text = F.col(f"`{site_col}`"), F.col(f"`{text_col}`")
    numbered = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), site.alias("site"), text.alias("t"), F.monotonically_increasing_id().alias("rid"))
    bad = boilerplate(docs, site, text, max_permille, min_pages, copies).select("site", "line")
    lines = numbered.select("rid", "site", F.posexplode(_digests(F.col("t"))).alias("at", "line")).where("line is not null and site is not null")
    # Sites of any size are joined by site and line together, which spreads a large site over all tasks.
    hits = lines.join(bad, ["site", "line"]).groupBy("rid").agg(F.collect_set("at").alias("at"))
    whole = numbered.select("rid", "row", "t").join(hits, "rid", "left")
    kept = F.when(F.col("at").isNull(), F.col("t")).otherwise(
        F.array_join(F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains("at", i)), "\n")
    )
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n"))).cast("long")
    return whole.select("row", kept.alias("clean"), n.alias("n_lines"), F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_dropped"))


def op6_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "row.source", "n_lines", "n_dropped", F.char_length("clean").cast("long").alias("clean_chars"), F.md5("clean").alias("clean_md5"))


_SP = r"[\x20\x09-\x0D]"
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
k AS (SELECT rid, source, pos, line, regexp_replace(line, '^{_SP}+|{_SP}+$', '', 'g') AS key FROM l),
t AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bad AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT rid) AS pages FROM k WHERE key <> '' GROUP BY ALL) JOIN t USING (source)
        WHERE pages >= {MIN_PAGES} AND 1000 * pages > {MAX_PERMILLE} * t.n),
j AS (SELECT k.rid, k.pos, k.line, bad.key IS NOT NULL AS dropped FROM k LEFT JOIN bad ON k.source = bad.source AND k.key = bad.key),
a AS (SELECT rid, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS clean FROM j GROUP BY rid)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       length(clean)::BIGINT AS clean_chars, md5(clean) AS clean_md5 FROM d LEFT JOIN a USING (rid)
"""
