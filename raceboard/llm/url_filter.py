"""Temporal URL lists: validity intervals and an as-of join.

A list is a history of dated events that add or remove an entry (a host, a domain with all
its hosts, or a host's path prefix). ``intervals`` turns the history into validity
intervals; ``evaluate`` joins every capture with the entries that were active when it was
fetched. Both sides meet on (entry key, month), so an entry that changes often, or a host
with a third of all captures, is spread over the months it covers; within that Spark may
split a large key, since the join needs no order.

Defined results: a capture without url or fetch time matches nothing and is kept; a null
date, entry or action is no event; of events of one entry on one day the removal counts last;
repeated events change nothing; repeated captures each get a row; empty tables give no
matches, or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceboard.llm.common import stored


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, domain_sizes: Column, path_sizes: Column) -> Column:
    """Entry keys that a URL can match: its host, its parent domains (of two labels or more)
    and the host with leading parts of the path, of as many labels and parts as ``*_sizes``
    names. A URL of many parts makes a key for each size in the lists, not for each part."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.filter(domain_sizes, lambda n: (n <= F.size(labels)) & ((n > 1) | (F.size(labels) == 1))),
                          lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.filter(path_sizes, lambda n: (n > 0) & (n <= F.size(parts))),
                           lambda n: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), parents, prefixes))


def _sizes(entries: DataFrame, kind: str, separator: str, less: int) -> Column:
    """The distinct numbers of parts of the entries of one kind."""
    of_kind = entries.where(F.col("entry").startswith(kind)).select((F.size(F.split("entry", separator)) - less).alias("n"))
    return F.coalesce(of_kind.agg(F.sort_array(F.collect_set("n"))).scalar(), F.array().cast("array<int>"))


def intervals(events: DataFrame, key: str = "entry", category: str = "category", day: str = "day", action: str = "action") -> DataFrame:
    """``(entry, category, valid_from, valid_to)``; ``valid_to`` is exclusive, null while open.

    Only changes of state count: one interval runs from the first addition to the next removal.
    """
    e = (events.select(F.col(key).alias("entry"), F.col(category).alias("category"), F.col(day).cast("date").alias("day"),
                       F.col(action).alias("action"))
         .where(F.col("action").isin("add", "remove") & F.col("entry").isNotNull() & F.col("day").isNotNull())
         .groupBy("entry", "category", "day").agg(F.max("action").alias("action")))
    w = Window.partitionBy("entry", "category").orderBy("day")
    changes = e.withColumn("before", F.lag("action").over(w)).where(
        F.when(F.col("action") == "add", F.coalesce(F.col("before") == "remove", F.lit(True))).otherwise(F.col("before") == "add"))
    return (changes.withColumn("valid_to", F.lead("day").over(w)).where(F.col("action") == "add")
            .select("entry", "category", F.col("day").alias("valid_from"), "valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per capture: ``page_id, host, fetched, n_matches, categories`` (sorted), ``entry``
    (the longest matching entry's key, then the first by name) and ``blocked``."""
    rows = captures.select(F.col(capture_id).alias("page_id"), F.col(url).cast("string").alias("u"), F.col(fetched).cast("date").alias("fetched"))
    entries = stored(entries, "intervals")
    # a URL's verdict on a day is the same for every capture of it
    asked = (rows.select(F.xxhash64("u").alias("uh"), "u", "fetched").distinct()
             .withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u")), "domain_sizes": _sizes(entries, "domain:", r"\.", 0),
                           "path_sizes": _sizes(entries, "path:", "/", 1)})
             .withColumn("key", F.explode(keys_of(F.col("host"), F.col("path"), F.col("domain_sizes"), F.col("path_sizes"))))
             .select("uh", "u", "fetched", "key", F.trunc("fetched", "month").alias("month")))
    # an interval is needed in the months that captures have; the calendar bounds their list
    months = rows.agg(F.sort_array(F.collect_set(F.trunc("fetched", "month")))).scalar()
    inside = lambda m: (m >= F.trunc("valid_from", "month")) & (F.col("valid_to").isNull() | (m < F.col("valid_to")))
    spread = (entries.withColumn("months", months).withColumn("month", F.explode(F.filter("months", inside)))
              .select(F.col("entry").alias("key"), "category", "valid_from", "valid_to", "month"))
    active = asked.join(spread, ["key", "month"]).where(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    rank = F.struct((-F.length("key")).alias("n"), "key")
    verdicts = stored(active.groupBy("uh", "u", "fetched").agg(
        F.count_distinct("key").alias("n_matches"), F.sort_array(F.collect_set("category")).alias("categories"),
        F.min(rank)["key"].alias("entry")), "verdicts")
    return (rows.withColumn("uh", F.xxhash64("u")).join(verdicts, ["uh", "u", "fetched"], "left")
            .select("page_id", host_of(F.col("u")).alias("host"), "fetched", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
                    F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ",").alias("categories"), "entry",
                    F.col("n_matches").isNotNull().alias("blocked")))
