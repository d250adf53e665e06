"""Operator 8: line dedup by site-relative frequency, as DataFrame operations only.

A line is boilerplate of a host if more than ``RATIO`` of the host's pages contain it, and
at least ``LEAST_PAGES`` do. Boilerplate lines are dropped from the pages of that host.

Counts are of 64-bit line hashes with map-side combination, so a line or a host that
very many pages share meets as one partial count a task. What is joined back is thin (a page's
key and the hashes of its lines); each page then gets the short list of hashes to drop.

Defined cases: lines are compared without white space at their ends; blank lines are
neither counted nor kept; null texts and hosts: a null text has no lines, a null host is a
host of its own; a page counts once for a line that it repeats; repeated rows are pages of
their own, unless ``once`` is set: then pages of a host with the same set of lines count as one,
in the line's count and in the host's; a page whose lines are all dropped stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpath.llm.common import keep

RATIO = 0.1
LEAST_PAGES = 3


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_text(html: Column) -> Column:
    """The visible text of a page: a line for each block element."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<title\b.*?</title>", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|body|html|head)\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def lines_of(text: Column) -> Column:
    """Lines without blanks at their ends; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " "))),
                    lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str, host: Column, text: Column, carry: bool = False,
                     ratio: float = RATIO, least_pages: int = LEAST_PAGES, once: bool = False) -> DataFrame:
    """(id, host, text, n_lines, n_dropped) of every row; text: the lines that stay. With ``carry`` also the
    whole input row as a struct ``row``. With ``once`` copies count as one page."""
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), lines_of(text).alias("lines"),
                        *([F.struct(*(F.col(c) for c in pages.columns)).alias("row")] if carry else []))
    rows = rows.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x))).withColumn("key", F.xxhash64("id", "host", "hashes"))
    thin = keep(rows.select("host", "key", F.array_distinct("hashes").alias("hashes")), "lines")
    found = thin.select("host", "key", F.explode("hashes").alias("line"))
    counted = thin.groupBy("host", F.array_sort("hashes").alias("hashes")).agg(F.lit(1).alias("_one")) if once else thin
    pages_of = counted.groupBy("host").agg(F.count("*").alias("pages")).select(F.col("host").alias("_h"), "pages")
    common = (counted.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count("*").alias("with_line")).where(F.col("with_line") >= least_pages)
              .join(pages_of, F.col("host").eqNullSafe(F.col("_h")))
              .where(F.col("with_line") > F.lit(ratio) * F.col("pages"))
              .select(F.col("host").alias("_h"), F.col("line").alias("_line")))
    drops = (found.join(common, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_line")))
             .groupBy("key").agg(F.collect_set("line").alias("drops")).withColumnRenamed("key", "_key"))
    out = rows.join(drops, F.col("key") == F.col("_key"), "left")
    drop = F.coalesce("drops", F.array().cast("array<long>"))
    out = out.withColumn("stay", F.filter("lines", lambda x: ~F.array_contains(drop, F.xxhash64(x))))
    return out.select(F.col("id").alias(id_col), "host", F.array_join("stay", "\n").alias("text"),
                      F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), *(["row"] if carry else []))
