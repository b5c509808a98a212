"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` stores the postings (term, document, position) of the training texts for the
vocabulary of the test items, ordered by term within each shard, plus one end-of-document
posting whose position is the document's length. A search takes the rarest terms of each
test window, intersects their posting lists after subtracting each term's offset, and
confirms what is left on the postings of all other terms. Nothing but the index is read.

Defined results: a null or wordless text has no words and no hits; a null id is kept and its
row gets its own result; repeated rows give repeated result rows; a repeated test item counts
once; a test item without id marks words but is not listed; empty tables give empty results,
or documents without hits; other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceboard.llm.common import id_key, keyed, stored

_GAPS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FROM = string.ascii_uppercase + _GAPS
_TO = string.ascii_lowercase + " " * len(_GAPS)
END = ""  # no word is empty: the term of the end-of-document posting


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words: digits, letters and everything beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, ih, words)`` of every distinct test item that has words."""
    return (keyed(items, item_id, text)
            .select(F.col("doc_id").alias("item_id"), F.col("h").alias("ih"), words(F.col("text")).alias("words"))
            .where(F.size("words") > 0).dropDuplicates(["item_id", "ih"]))


def vocabulary(items: DataFrame) -> DataFrame:
    """``(term, tid)`` of the test items' terms and of the end-of-document mark; stored."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    end = items.sparkSession.createDataFrame([(END,)], "term string")
    return stored(terms.unionByName(end).select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")


def build_index(docs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``(tid, doc_id, h, pos)`` of ``vocab``'s terms, by term in each shard.

    Lists of terms outside the vocabulary can never be asked for, so they are not kept. The
    vocabulary is bounded by the test set; Spark broadcasts it only if its files are small.
    """
    tokens = (keyed(docs, doc_id, text)
              .select("doc_id", "h", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term")))
    postings = tokens.join(vocab, "term").select("tid", "doc_id", "h", "pos", (F.col("term") == END).alias("is_end"))
    return stored(postings, "postings", sort=["is_end", "tid", "doc_id", "pos"])


def test_windows(items: DataFrame, size: int) -> DataFrame:
    """``(item_id, ih, start, len, ipos, term)``: the terms of each window of ``size`` words."""
    at = items.select("item_id", "ih", "words", F.least(F.size("words"), F.lit(size)).alias("len")).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("start"))
    return at.select("item_id", "ih", "start", "len", F.posexplode(F.slice("words", F.col("start") + 1, F.col("len"))).alias("o", "term")).select(
        "item_id", "ih", "start", "len", (F.col("start") + F.col("o")).alias("ipos"), "term")


def phrase_matches(index: DataFrame, vocab: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3) -> DataFrame:
    """Every place where a window occurs word for word: ``(doc_id, h, item_id, ih, start, len, delta)``.

    Position ``start + delta`` of the document is the window's first word. The lists of the
    ``rarest`` least frequent terms of each window are intersected on (document, item,
    position minus offset); the rest of the window is then looked up at its places.
    """
    postings = index.where(~F.col("is_end")).select("tid", "doc_id", "h", "pos")
    frequency = stored(postings.groupBy("tid").agg(F.count(F.lit(1)).alias("freq")), "frequencies")
    per_window = Window.partitionBy("item_id", "ih", "start")
    windows = (test_windows(items, size).join(vocab, "term").join(frequency, "tid", "left")
               .withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(per_window))
               .where(F.col("least") > 0)  # a window with an unseen term occurs nowhere
               .withColumn("rank", F.row_number().over(per_window.orderBy("freq", "tid", "ipos")))
               .select("item_id", "ih", "start", "len", "ipos", "tid", "rank"))
    windows = stored(windows, "windows").withColumn("need", F.least("len", F.lit(rarest)))
    rare = windows.where(F.col("rank") <= F.col("need"))
    place = ["doc_id", "h", "item_id", "ih", "delta"]
    lists = (postings.join(rare.select("tid", "item_id", "ih", "ipos", "need").distinct(), "tid")
             .select("doc_id", "h", "item_id", "ih", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos", "need"))
    aligned = (lists.groupBy(*place, "need").agg(F.collect_set("ipos").alias("found"))
               .where(F.size("found") >= F.col("need")))
    aligned = stored(aligned.select(*place, F.explode("found").alias("ipos")), "aligned")
    it = id_key("item_id").alias("it")
    key = [it, F.col("ih"), F.col("ipos")]
    candidates = (aligned.select("*", it).join(rare.select(*key, "start", "len", "need"), ["it", "ih", "ipos"])
                  .groupBy(*place, "start", "len", "need").agg(F.count_distinct("ipos").alias("n"))
                  .where(F.col("n") == F.col("need")).select(*place, "start", "len"))
    candidates = stored(candidates, "candidates").select("*", it)
    spread = candidates.withColumn("ipos", F.explode(F.expr("sequence(start, start + len - 1)")))
    terms = windows.select(*key, "tid").distinct()
    probes = stored(spread.select(*place, "it", "ipos").distinct().join(terms, ["it", "ih", "ipos"])
                    .select(*place, "it", "ipos", "tid", (F.col("delta") + F.col("ipos")).alias("pos"), id_key().alias("d")), "probes")
    texts = stored(probes.select("h").distinct(), "candidate-texts")  # eight bytes a text: the index is filtered by them where it lies
    within = postings.join(texts, "h", "left_semi").withColumn("d", id_key()).drop("doc_id")
    confirmed = (probes.join(within, ["d", "h", "tid", "pos"], "left_semi")
                 .select("d", "h", "it", "ih", "delta", "ipos"))
    return (spread.withColumn("d", id_key()).join(confirmed, ["d", "h", "it", "ih", "delta", "ipos"])
            .groupBy(*place, "start", "len").agg(F.count_distinct("ipos").alias("n"))
            .where(F.col("n") == F.col("len")).drop("n"))


def proximity_matches(index: DataFrame, vocab: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """``(doc_id, h, item_id, ih, pos)``: places of an item's rarest term with every other
    distinct term of the item within ``slop`` words of it, in any order."""
    postings = index.where(~F.col("is_end")).select("tid", "doc_id", "h", "pos")
    frequency = stored(postings.groupBy("tid").agg(F.count(F.lit(1)).alias("freq")), "frequencies")
    per_item = Window.partitionBy("item_id", "ih")
    terms = (items.select("item_id", "ih", F.explode(F.array_distinct("words")).alias("term")).join(vocab, "term")
             .join(frequency, "tid", "left").withColumn("n_terms", F.count(F.lit(1)).over(per_item))
             .withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(per_item)).where(F.col("least") > 0)
             .withColumn("rank", F.row_number().over(per_item.orderBy("freq", "tid"))))
    terms = stored(terms.select(id_key("item_id").alias("it"), "item_id", "ih", "tid", "n_terms", "rank"), "item-terms")
    width = slop + 1
    cell = F.floor(F.col("pos") / width)
    anchors = (postings.join(terms.where(F.col("rank") == 1), "tid")
               .select("item_id", "it", "ih", "doc_id", id_key().alias("d"), "h", "n_terms", F.col("pos").alias("at"),
                       F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct())
    near = (postings.join(terms.select("it", "ih", "tid"), "tid")
            .select("it", "ih", "tid", id_key().alias("d"), "h", "pos", cell.alias("cell")))
    return (anchors.join(near, ["it", "ih", "d", "h", "cell"])  # the anchors' item, document and stretch of text
            .where(F.abs(F.col("pos") - F.col("at")) <= slop)
            .groupBy("doc_id", "h", "item_id", "ih", "at", "n_terms").agg(F.count_distinct("tid").alias("n"))
            .where(F.col("n") == F.col("n_terms")).select("doc_id", "h", "item_id", "ih", F.col("at").alias("pos")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, rarest: int = 3, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, h, n_words, n_hit, n_items, items`` (sorted item ids)."""
    items = stored(item_words(benchmark, item_id, item_text), "items")
    vocab = vocabulary(items)
    index = build_index(docs, vocab, doc_id, text)
    hits = stored(phrase_matches(index, vocab, items, size, rarest), "matches").withColumn("d", id_key())
    covered = (hits.select("d", "h", F.explode(F.expr("sequence(start + delta, start + delta + len - 1)")).alias("pos"))
               .distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (hits.where(F.col("item_id").isNotNull()).groupBy("d", "h")
             .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    documents = index.where("is_end").select("doc_id", id_key().alias("d"), "h", F.col("pos").cast("long").alias("n_words"))
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return (documents.join(covered.join(named, ["d", "h"], "left"), ["d", "h"], "left")
            .select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items")))
