"""Exact de-duplication by content-defined chunk recipes.

A normalised text is cut where its own content says so, so equal texts give equal chunks.
Its recipe is the ordered list of its chunks' identifiers. Only texts whose recipe occurs
again can have an equal; just their chunks travel, each once per task and content, to
a dictionary that compares the chunks themselves. An identifier under which the dictionary
finds two contents is split by content, and the recipes that use it are written anew before
lists are compared, so an equal recipe is an equal text. Whole documents never move.

Defined results: a null text is an empty text; a null id takes part, and is never the one
that stays while its group has an id; repeated rows each give a row, and all rows with the id
that stays are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceboard.llm.common import id_key, keyed, stored

#: A chunk has 512 to 4096 characters and ends after two vowels and a space, or at 4096.
CHUNK = r"(?s).{512,4096}?(?:[aeiou]{2} |\z)|.{4096}|.+\z"


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    out = F.coalesce(text, F.lit(""))
    for code in range(0x09, 0x0E):
        out = F.replace(out, F.lit(chr(code)), F.lit(" "))
    return F.regexp_replace(out, r"\x20{2,}", " ")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, doc_id: str, text: str, pattern: str = CHUNK, hash_of=F.xxhash64) -> DataFrame:
    """``(doc_id, h, norm, parts, recipe)`` by a narrow pass."""
    return (keyed(docs, doc_id, text).select("doc_id", "h", normalised(F.col("text")).alias("norm"))
            .withColumn("parts", chunks(F.col("norm"), pattern))
            .withColumn("recipe", F.transform("parts", lambda c: hash_of(c))))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = CHUNK, hash_of=F.xxhash64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row; ``hash_of`` is the
    chunks' first identifier (a weak one only makes the dictionary work harder)."""
    cut = recipes(docs, doc_id, text, pattern, hash_of)
    rows = stored(cut.select("doc_id", "h", "recipe", F.sha2("norm", 256).alias("text_sha256")), "recipes")
    again = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.xxhash64("recipe").alias("r"))
    texts = stored(rows.withColumn("r", F.xxhash64("recipe")).join(stored(again.distinct(), "repeated-recipes"), "r", "left_semi")
                   .select("h").distinct(), "repeated-texts")
    kept_cut = recipes(keyed(docs, doc_id, text).join(texts, "h", "left_semi"), "doc_id", "text", pattern, hash_of)
    # the dictionary: distinct contents of those texts' chunks, and identifiers that stand for several
    parts = (kept_cut.select(F.explode(F.array_distinct("parts")).alias("chunk")).distinct()
             .select(hash_of(F.col("chunk")).alias("c"), "chunk"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("c"))
    clashes = stored(parts.withColumn("n", shared).where(F.col("n") > 1)
                     .withColumn("ord", F.row_number().over(Window.partitionBy("c").orderBy("chunk")).cast("long"))
                     .select("c", "chunk", "ord"), "clashing-chunks")
    # only texts with such a chunk need their chunks' ordinals beside the recipe
    touched = (kept_cut.select("doc_id", "h", F.posexplode("parts").alias("i", "chunk"))
               .withColumn("c", hash_of(F.col("chunk"))).join(clashes, ["c", "chunk"])
               .select(id_key().alias("d"), "h", F.struct("i", "ord").alias("o")).distinct()
               .groupBy("d", "h").agg(F.sort_array(F.collect_list("o")).alias("ordinals")))
    exact = (rows.withColumn("d", id_key()).join(stored(touched, "ordinals"), ["d", "h"], "left")
             .withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<struct<i:int,ord:bigint>>"))))
    key = ["recipe", "ordinals"]
    groups = stored(exact.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return (exact.join(groups, key)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
