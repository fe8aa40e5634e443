"""Line dedup by site-relative frequency, in DataFrame operations only.

A page's lines are the texts between its block tags. Per host, the pages that contain a line are divided by the host's pages;
lines above `ratio` (on at least `least` pages) are boilerplate and are dropped from every page of that host.

A host's boilerplate lines number at most the mean of distinct lines per page divided by ratio, so the list that is joined to
its pages is bounded; counts are summed before they are exchanged, and lines travel as 16-byte digests. The lists are measured: if
all of them fit in LIST_BYTES they are broadcast and no page is moved; else pages are dealt by host, and a host with more than its
share of the pages over as many keys as it has shares.

Defined cases: null html has no lines and an empty text; null url or one without a host belongs to host ''; a line repeated in
a page counts once there; repeated page rows count as pages; a comment, script or style that never closes goes on to the end of the page, and a <
after the last > is text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, sweeping

#: Share of a host's pages from which (exclusive) a line is boilerplate, and pages it must be on at least.
RATIO, LEAST = 0.3, 3
#: Bytes of all hosts' lists that are broadcast; shares that pages are dealt in, and the least pages of a share: a host above a share is
#: dealt over several keys, and there are at most SHARES such hosts.
LIST_BYTES, SHARES, SHARE_PAGES = 16 << 20, 10_000, 10_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
# What has no text: from an opening to its end, and what stands in its place.
COMMENT, COMMENT_END = "<!--", "-->"
RAW, RAW_END = r"(?i)<(?:script|style)\b", r"(?is)^.*?</(?:script|style)[ \t\n\f\r]*>"
#: Then each pattern in turn: block tags (a new line), other tags, white space within a line.
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS, SPACES = r"<[^>]*>", r"[ \t\r]+"


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _tags(text: Column, pattern: str, by: str) -> Column:
    """Replaces tags up to the last >, as none can end after it and each < there would look for its end in vain."""

    def replace(t: Column) -> Column:
        rest = F.substring_index(t, ">", -1)
        return F.concat(F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(rest)), pattern, by), rest)

    return _with(text, replace)


def lines_of(html: Column) -> Column:
    """The page's lines. A page is cut at all openings of comments, then at those of scripts and styles, and each piece is looked through
    once for the end of its own, so the work is linear however many never close; what never closes goes on to the end of the page."""
    at = F.instr
    text = F.split(F.coalesce(html, F.lit("")), COMMENT)
    text = F.array_join(F.transform(text, lambda x, i: F.when(i == 0, x).when(at(x, COMMENT_END) > 0, F.substring(x, at(x, COMMENT_END) + len(COMMENT_END), F.length(x))).otherwise("")), " ")
    text = F.array_join(F.transform(F.split(text, RAW), lambda x, i: F.when(i == 0, x).when(F.rlike(x, F.lit(RAW_END)), F.regexp_replace(x, RAW_END, "")).otherwise("")), "\n")
    text = F.regexp_replace(_tags(_tags(text, BLOCKS, "\n"), TAGS, ""), SPACES, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, list_bytes: int = LIST_BYTES, share_pages: int = SHARE_PAGES) -> DataFrame:
    """page_id, url, host, n_lines, n_dropped and the text of the lines kept, for each row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = stage(pages.select("page_id", "url", host.alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    digest = lambda x: F.unhex(F.md5(x.cast("binary")))
    per_line = rows.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    per_host = rows.groupBy("host").agg(F.count("*").alias("pages"))
    common = per_line.where(F.col("n") >= least).join(per_host, "host").where(F.col("n") > ratio * F.col("pages"))
    lists = stage(common.groupBy("host").agg(F.collect_list("line").alias("boilerplate")), "line-lists")
    with sweeping(pages.sparkSession):
        size = lists.agg(F.sum(64 + F.length("host") + 32 * F.size("boilerplate"))).first()[0] or 0
    if size <= list_bytes:
        matched = rows.join(F.broadcast(lists), "host", "left")
    else:
        with sweeping(pages.sparkSession):
            share = max(share_pages, -(-rows.count() // SHARES))
        large = F.broadcast(per_host.where(F.col("pages") > share).select("host", F.ceil(F.col("pages") / share).alias("keys")))  # at most SHARES rows
        keys = F.coalesce("keys", F.lit(1).cast("long"))
        dealt = rows.join(large, "host", "left").withColumn("key", F.pmod(F.xxhash64("page_id", "url", F.size("lines")), keys)).drop("keys")
        copies = lists.join(large, "host", "left").withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), keys - 1))).drop("keys")
        matched = dealt.join(copies, ["host", "key"], "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), digest(x))))
    return matched.select(
        "page_id",
        "url",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_tags(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace(substring({text}, 1, length({text}) - length(string_split({text}, '>')[-1])), '{_sql(pattern)}', {by}, 'g') || string_split({text}, '>')[-1]"


ORACLE = f"""
WITH t0 AS (SELECT row_number() OVER () AS row, page_id, url, lower(regexp_extract(coalesce(url, ''), '{_sql(HOST)}', 1)) AS host, coalesce(html, '') AS t FROM pages),
t1 AS (SELECT row, page_id, url, host, array_to_string(list_transform(string_split(t, '{COMMENT}'),
       lambda x, i: CASE WHEN i = 1 THEN x WHEN contains(x, '{COMMENT_END}') THEN substring(x, position('{COMMENT_END}' IN x) + {len(COMMENT_END)}) ELSE '' END), ' ') AS t FROM t0),
t2 AS (SELECT row, page_id, url, host, array_to_string(list_transform(regexp_split_to_array(t, '{_sql(RAW)}'),
       lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '{_sql(RAW_END)}') THEN regexp_replace(x, '{_sql(RAW_END)}', '') ELSE '' END), chr(10)) AS t FROM t1),
t3 AS (SELECT row, page_id, url, host, {_sql_tags("t", BLOCKS, "chr(10)")} AS t FROM t2),
t4 AS (SELECT row, page_id, url, host, {_sql_tags("t", TAGS, "''")} AS t FROM t3),
r AS (SELECT row, page_id, url, host, list_filter(list_transform(string_split(regexp_replace(t, '{SPACES}', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM t4),
p AS (SELECT host, count(*) AS pages FROM r GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM r) GROUP BY host, line),
b AS (SELECT host, list(line) AS boilerplate FROM c JOIN p USING (host) WHERE n >= {LEAST} AND n > {RATIO} * pages GROUP BY host),
k AS (SELECT page_id, url, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(boilerplate, x), false)) AS kept FROM r LEFT JOIN b USING (host))
SELECT page_id, url, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
