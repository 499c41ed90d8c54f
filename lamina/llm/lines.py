"""Line dedup by site-relative frequency, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import known, saved, table

#: A line is boilerplate if over this part of its host's pages have it, and more than one. Menus and footers stand on all pages of a
#: site or of a section of it, and a site has few sections; what fewer than a fifth have is taken for content.
RATIO, LEAST_PAGES = 0.2, 2
#: Blanks that end a line's text on either side.
BLANKS = " \t\r\f\x0b"


def host_of(url: Column | str) -> Column:
    """The lower-case host of a URL, without user and port; null for null, empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines_of_html(html: Column | str) -> Column:
    """Text lines of a page: scripts, styles and comments go, a tag ends a line, blank lines go. Null gives none.

    A script, style or comment that nothing closes goes to the page's end; a ``<`` begins a new tag, also within one. So each
    pattern passes a page once, however long it is and whatever it holds.
    """
    html = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)", "")
    return lines_of_text(F.regexp_replace(bare, r"<[^<>]*>", "\n"))


def lines_of_text(text: Column | str) -> Column:
    """The lines of a text, trimmed; blank ones go. Null gives none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(rows: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``site`` and ``boilerplate``, the keys of its boilerplate lines, from rows of ``site`` and ``keys``.

    A page counts once for each line it has, however often. Counts are aggregated before they are shuffled, so
    neither a frequent line nor a large host is gathered. A host's list is short whatever its size: if its pages
    have n different lines on average, at most n / ratio lines can be on over ``ratio`` of them.
    """
    pages = rows.groupBy("site").agg(F.count("*").alias("pages"))
    having = rows.select("site", F.explode(F.array_distinct("keys")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
    often = having.where(F.col("n") >= least_pages).join(pages, "site").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("site").agg(F.sort_array(F.collect_list("key")).alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Add ``host``, ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay, in order) to each row.

    A line goes if over ``ratio`` of its host's pages have it, and ``least_pages`` or more: by default two, as a line on one page alone
    repeats nothing, whatever part of a small host it is. Rows without a host are a site of their own, as are those of a null
    host. Empty pages count as pages and have no lines; repeated rows count as pages each; an empty table gives no rows. Lines compare whole, by their MD5. Columns with the names
    of the new ones are replaced.
    """
    named = pages.withColumns({"host": host, "__lines": lines})
    keyed = named.select("*", known("host").alias("__site"), F.transform("__lines", lambda x: F.md5(x.cast("binary"))).alias("__keys"))
    bad = saved(boilerplate(keyed.select(F.col("__site").alias("site"), F.col("__keys").alias("keys")), ratio, least_pages), "boilerplate")
    joined = keyed.join(bad.withColumnsRenamed({"site": "__site", "boilerplate": "__bad"}), "__site", "left")
    # a set operation first, so that a line is compared with the few that its page has and not with all of its host
    joined = joined.withColumn("__gone", F.coalesce(F.array_intersect("__keys", "__bad"), F.array().cast("array<string>")))
    return joined.withColumn("kept", F.filter("__lines", lambda x, i: ~F.array_contains("__gone", F.col("__keys")[i]))).withColumns({"n_lines": F.size("__lines"), "n_dropped": F.size("__lines") - F.size("kept")}).drop("__site", "__keys", "__bad", "__lines", "__gone")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All pages, without the lines that are boilerplate on their host. The parsed lines are written once and read twice."""
    pages = table(spark, sf_dir, "pages")
    parsed = saved(pages.select("page_id", host_of("url").alias("at"), lines_of_html("html").alias("lines")), "lines")
    out = drop_boilerplate(parsed, F.col("at"), F.col("lines"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))


ORACLE_SQL = rf"""
WITH b AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', '', 'g'), '<[^<>]*>', chr(10), 'g') AS text FROM pages),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x <> '') AS lines FROM b),
e AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM l),
n AS (SELECT host, line, count(*) AS n FROM e GROUP BY host, line),
h AS (SELECT host, count(*) AS pages FROM b GROUP BY host),
bad AS (SELECT n.host, list(n.line) AS gone FROM n JOIN h ON n.host IS NOT DISTINCT FROM h.host WHERE n.n >= {LEAST_PAGES} AND n.n > {RATIO}::DOUBLE * h.pages GROUP BY n.host),
k AS (SELECT l.*, list_filter(l.lines, lambda x: NOT list_contains(coalesce(bad.gone, []), x)) AS kept FROM l LEFT JOIN bad ON l.host IS NOT DISTINCT FROM bad.host)
SELECT page_id, host, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""
