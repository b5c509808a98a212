"""Line de-duplication by site-relative frequency.

For each host, a line's ratio is the number of the host's pages that contain it divided by
the number of the host's pages; lines above a boilerplate ratio are dropped from every page
of that host. Pages with the same text are one page fetched again and count once, so the
lines of a page that was copied often are not mistaken for boilerplate.

Short lines recur by chance, so a line of fewer than ``many_words`` words must pass the higher
of two ratios. A line on one or two pages is never boilerplate: that is what a near copy of a
page looks like, however small its host.

Counting moves 24-byte rows (host, page, line hashes), combined in each task first, so a host
with a third of all pages is dealt out by page and line. Only lines whose hash passes are
counted again as text, which makes the result exact. Boilerplate meets the pages on (host,
line hash), and each page gets only its own lines: no host's list is held as a whole.

Defined results: lines are compared without blanks at their ends, and blank lines are never
boilerplate; a null host is a host of its own; a null text stays null and is no page; an
empty text has one blank line; repeated rows are one page, and each is cleaned; an empty
table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceboard.llm.common import stored

BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def host_key(host: str) -> Column:
    """The host behind a mark, so that no name equals the mark of a null host."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def _passes(n: Column, n_host: Column, n_words: Column, ratio: float, short_ratio: float, min_pages: int, many_words: int) -> Column:
    needed = F.when(n_words >= many_words, F.lit(ratio)).otherwise(F.lit(short_ratio))
    return (n >= min_pages) & (n > needed * n_host)


def boilerplate(pages: DataFrame, ratio: float, short_ratio: float, min_pages: int, many_words: int, host: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(host, line, n_pages, n_host)`` of every line found on more than ``ratio`` of its host's
    distinct pages (``short_ratio`` for lines of fewer than ``many_words`` words), and on
    ``min_pages`` of them at least; and ``(host, page, drop)``, each page's lines of that kind."""
    body = F.col(text).cast("string")
    rows = pages.where(body.isNotNull()).select(
        host_key(host).alias("host"), F.xxhash64(body).alias("page"),
        F.array_distinct(F.transform(F.split(body, "\n"), line_key)).alias("lines"))
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    words = lambda line: F.least(F.size(F.split(line, " ")), F.lit(many_words)).cast("int")
    limits = (ratio, short_ratio, min_pages, many_words)
    hashes = rows.select("host", "page", F.explode(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line_hash"), words(x).alias("n_words")))).alias("l"))
    hashes = hashes.select("host", "page", "l.line_hash", "l.n_words").distinct()
    frequent = hashes.groupBy("host", "line_hash", "n_words").agg(F.count(F.lit(1)).alias("n")).join(totals, "host").where(
        _passes(F.col("n"), F.col("n_host"), F.col("n_words"), *limits)).select("host", "line_hash", "n_host").distinct()
    frequent = stored(frequent, "frequent-lines")
    candidates = stored(rows.select("host", "page", F.explode("lines").alias("line")).where(F.col("line") != "")
                        .withColumn("line_hash", F.xxhash64("line")).join(frequent, ["host", "line_hash"]).distinct(), "frequent-lines-of-pages")
    exact = candidates.groupBy("host", "line_hash", "line", "n_host").agg(F.count(F.lit(1)).alias("n_pages"))
    exact = stored(exact.where(_passes(F.col("n_pages"), F.col("n_host"), words(F.col("line")), *limits)), "boilerplate")
    # pages whose hashes agree share a list: all its lines are boilerplate of their host
    drops = candidates.join(exact.select("host", "line_hash", "line"), ["host", "line_hash", "line"]).groupBy("host", "page").agg(F.collect_list("line").alias("drop"))
    return exact.select("host", "line", "n_pages", "n_host"), drops


def drop_boilerplate(pages: DataFrame, ratio: float = 0.005, short_ratio: float = 0.05, min_pages: int = 3, many_words: int = 3,
                     host: str = "source", text: str = "text") -> DataFrame:
    """``pages`` packed as ``row`` (all its columns) with ``clean`` (the text without its
    host's boilerplate lines), ``n_lines`` and ``n_dropped``."""
    _, drops = boilerplate(pages, ratio, short_ratio, min_pages, many_words, host, text)
    body = F.col(text).cast("string")
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_key(host).alias("host"), F.xxhash64(body).alias("page"), body.alias("body"))
    lines = F.split("body", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), line_key(x)))
    # the lists grow with the pages, so texts and lists meet by a shuffle at every size
    out = packed.join(stored(drops, "lines-to-drop").hint("merge"), ["host", "page"], "left").withColumn("kept", F.when(F.col("drop").isNull(), lines).otherwise(kept))
    return out.select("row", F.array_join("kept", "\n").alias("clean"), F.size(lines).cast("long").alias("n_lines"),
                      (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"))
