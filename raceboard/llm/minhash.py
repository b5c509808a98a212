"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``COORDS`` coordinates. In round ``i`` every shingle is thrown by a hash into one
coordinate, with a value in ``i .. i + 1``; a coordinate keeps the least value thrown into it.
After ``COORDS`` such rounds, round ``COORDS + j`` throws every shingle into coordinate ``j``,
so all coordinates fill for a set of any size; rounds stop as soon as all are filled, which
for most texts is after two or three. Two sets agree in a coordinate with a probability of
their similarity, and the share of agreeing coordinates is as concentrated as with that many
independent hashes, at the cost of a few.

Bands of ``ROWS`` coordinates are the candidate keys: two sets of similarity 0.8 share none of
the 32 bands once in 20 million pairs. Candidates whose sizes rule a link out, or whose
sketches agree in so few coordinates that a link is as unlikely as a missed band
(``_LEAST_AGREE``), go; the rest is confirmed on the full shingle sets.

Sets are handled once, however many documents have them. Within a bucket not all pairs are
compared: first every set is compared with the bucket's least set. Links that are confirmed
make components, and then each bucket compares only members of different components (those
outside the largest one with all others), in blocks of sets that a task holds in memory, so
nothing is lost, a bucket of thousands of near copies costs about its size, and pairs that
nearly link are counted where they lie instead of being moved.

Defined results: a null, empty or wordless text has no shingles and is linked with nothing; a
text of fewer words than a shingle has is one shingle; a null id takes part but names no
component (its component may have a null id when it has no other); repeated rows each get a
row; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceboard.llm.common import keyed, stored
from raceboard.llm.simhash import components
from raceboard.session import share_code

COORDS, ROWS = 128, 4
#: At similarity 0.8, fewer agreeing coordinates of 128 have a chance below 1 in 10 million.
_LEAST_AGREE = 77
_CELLS = 1 << 16  # hashes made at a time
_BLOCK, _BLOCK_SHINGLES = 256, 1 << 20


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    grams = {b" ".join(g) for g in zip(*[words[i:] for i in range(size)])}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``COORDS`` values: the round in the upper, the thrown value in the lower 32 bits."""
    values = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, _CELLS // 16 // len(hashes))  # small sets throw many rounds at a time
    first = 0
    while first < 2 * COORDS:
        rounds = np.arange(first, min(first + step, 2 * COORDS), dtype=np.uint64)
        for a in range(0, len(hashes), _CELLS):
            part = hashes[a:a + _CELLS]
            thrown = _mixed(part[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            value = (rounds[:, None] << np.uint64(32)) | (thrown & np.uint64(0xFFFFFFFF))
            into = np.where(rounds[:, None] < COORDS, ((thrown >> np.uint64(32)) * np.uint64(COORDS)) >> np.uint64(32),
                            rounds[:, None] - np.minimum(rounds[:, None], np.uint64(COORDS)))
            np.minimum.at(values, into.astype(np.int64).ravel(), value.ravel())
        if values.max() != np.iinfo(np.uint64).max:
            break  # later rounds throw larger values only
        first += step
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each band; the band's number is part of it."""
    rows = values.reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int = 2) -> DataFrame:
    """``doc_id, h, n, k1, k2, bands, coords`` per row of ``docs(doc_id, h, text)``: the set's
    size, a 128-bit key of its content, its band keys and a byte of each coordinate in longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands, coords = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                    hashes = shingle_hashes(text, size)
                    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    n.append(len(hashes))
                    k1.append((key >> 64) - (1 << 63))
                    k2.append((key & (1 << 64) - 1) - (1 << 63))
                    values = sketch(hashes) if len(hashes) else None
                    bands.append([] if values is None else band_keys(values))
                    coords.append([] if values is None else values.astype(np.uint8).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), *(pa.array(x, pa.int64()) for x in (n, k1, k2)),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (bands, coords))], names=["doc_id", "h", "n", "k1", "k2", "bands", "coords"])

    share_code(docs.sparkSession)
    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id bigint, h bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, coords array<bigint>")


def shingle_sets(texts: DataFrame, size: int = 2) -> DataFrame:
    """``node, shingles`` (sorted hashes) of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, size).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    share_code(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


class _Search:
    """Buckets of distinct sets, and the shingles of every set that shares a bucket."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> None:
        self.percent = percent
        rows = nodes.where("n > 0").select("node", "n", F.explode("bands").alias("key"))
        again = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1"), "bucket-keys")
        self.buckets = stored(rows.join(again, "key").select("key", "node", "n", "pivot"), "buckets")
        met = self.buckets.groupBy("node").agg(F.min("pivot").alias("home"))
        self.brief = stored(nodes.select("node", "n", "coords", "row_id", "row_h").join(met, "node"), "brief")
        # one text of each of these sets is read again for its shingles
        source = self.brief.select("node", F.col("row_id").alias("d"), F.col("row_h").alias("h"))
        texts = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("d"), "h", "text").join(source, ["d", "h"]).select("node", "text").distinct()
        self.sets = stored(shingle_sets(texts, size), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored ``pairs(a, b)`` that link by their full sets."""
        side = lambda x: self.brief.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("coords").alias(f"c{x}"))
        close = (pairs.join(side("a"), "a").join(side("b"), "b").where(self.sizes_allow(F.col("na"), F.col("nb")))
                 .where(_agreeing("ca", "cb") >= _LEAST_AGREE).select("a", "b"))
        close = stored(close, "close")
        sets = lambda x: self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
        common = F.size(F.array_intersect("sa", "sb"))
        linked = 100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)
        return close.join(sets("a"), "a").join(sets("b"), "b").where(linked).select("a", "b")

    def sizes_allow(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


def _agreeing(a: str, b: str) -> Column:
    """How many coordinates have equal bytes: in each byte of the difference all bits are folded
    onto the lowest."""
    differ = F.lit(0)
    for i in range(COORDS // 8):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(COORDS) - differ


def joined(search: _Search) -> DataFrame:
    """``(node, root)`` of all sets that have a link: the smallest set that links join them with."""
    least = stored(search.buckets.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    found = stored(search.confirm(least), "links")
    roots = stored(components(found), "roots")
    return _merged(roots, stored(_across(search, roots), "links"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links(a, b)``, which join whole components: only their roots are looked at."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = stored(components(between), "roots-of-roots")
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(over.join(roots, "node", "left_anti").select("node", "root"))


def _across(search: _Search, roots: DataFrame) -> DataFrame:
    """Links between members of different components (of ``roots``) that share a bucket.

    Of each bucket the members outside its largest component ask for all others. They ask by
    blocks of sets, which hold at most ``_BLOCK`` sets or about ``_BLOCK_SHINGLES`` shingles
    of about one size, mostly from one bucket: a request names the wanted members of one
    block, however many buckets two sets share. A task then holds one block, counts common
    shingles for its requests, and hands on links only, so sets that nearly link (and there
    may be as many pairs of them as a group has) make no rows.
    """
    blocks = stored(_blocks(search), "blocks")
    named = search.buckets.select("key", "node", "n").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1").select("key", "main")
    mixed = stored(named.join(stored(main, "mixed-keys"), "key").join(blocks, "node"), "mixed")
    lists = mixed.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "n", (F.col("root") == F.col("main")).alias("is_main"))).alias("members"))
    asking = mixed.where("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    wanted = F.filter("members", lambda m: (m["root"] != F.col("ra")) & (m["is_main"] | (F.col("a") < m["node"])) & search.sizes_allow(F.col("na"), m["n"]))
    requests = (asking.join(lists, "key").select("a", "block", F.transform(wanted, lambda m: m["node"]).alias("wanted")).where(F.size("wanted") > 0)
                .groupBy("a", "block").agg(F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted")))
    requests = stored(requests, "requests")
    shares = stored(requests.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("shares")), "shares")
    held = (blocks.join(shares, "block").join(search.sets, "node")
            .select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "node", "shingles"))
    asked = (requests.join(shares, "block").join(search.sets.withColumnRenamed("node", "a"), "a")
             .select(F.col("block").alias("of_block"), F.pmod(F.xxhash64("a"), F.col("shares").cast("long")).cast("int").alias("of_share"), F.col("a").alias("asker"),
                     F.col("shingles").alias("own"), F.col("wanted").alias("asks")))
    percent = search.percent

    def count(block: pa.Table, requests: pa.Table) -> pa.Table:
        if not block.num_rows or not requests.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        nodes = block.column("node").to_numpy()
        sets = [np.asarray(x) for x in block.column("shingles").to_pylist()]
        lengths = np.array([len(x) for x in sets])
        starts = np.cumsum(lengths) - lengths
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        left, right = [], []
        for a, own, ask in zip(*(requests.column(c).to_pylist() for c in ("asker", "own", "asks"))):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            place = place[known[place] == own]
            present = np.zeros(len(known), np.int64)
            present[place] = 1
            common = np.add.reduceat(present[at], starts)
            linked = 100 * common >= percent * (lengths + len(own) - common)
            hits = np.intersect1d(nodes[linked], ask)
            left += [a] * len(hits)
            right += hits.tolist()
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    share_code(roots.sparkSession)
    return held.groupBy("block", "share").cogroup(asked.groupBy("of_block", "of_share")).applyInArrow(count, "a bigint, b bigint")


def _blocks(search: _Search) -> DataFrame:
    """``node, block``: sets that share a bucket's least set and are of about one size."""
    of_size = F.floor(F.log("n") / F.lit(math.log(1.25))).cast("int")
    sized = search.brief.select("node", "home", of_size.alias("class"))
    room = F.greatest(F.lit(1), F.least(F.lit(_BLOCK), F.floor(F.lit(_BLOCK_SHINGLES) / F.pow(F.lit(1.25), F.col("class") + 1)).cast("int")))
    counts = sized.groupBy("home", "class").agg(F.count(F.lit(1)).alias("members")).select("home", "class", F.ceil(F.col("members") / room).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return sized.join(counts, ["home", "class"]).select("node", F.xxhash64("home", "class", part).alias("block"))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest id reachable over links."""
    source = keyed(docs, doc_id, text)
    prints = stored(sketches(source, size), "sketches")
    of_set = ["n", "k1", "k2"]
    one = prints.groupBy(*of_set).agg(F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "h", "bands", "coords"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r"))
    nodes = stored(one.select(*of_set, "least", F.coalesce("r.doc_id", F.lit(0).cast("long")).alias("row_id"), F.col("r.h").alias("row_h"), "r.bands", "r.coords",
                              F.monotonically_increasing_id().alias("node")), "nodes")
    search = _Search(source, nodes, size, percent)
    roots = stored(joined(search), "roots")
    linked = nodes.select("node", "least").join(roots, "node")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", F.lit(True).alias("found"), "component")
    every = stored(nodes.select("node", *of_set, "least").join(named, "node", "left")
                   .select(*of_set, F.when(F.col("found"), F.col("component")).otherwise(F.col("least")).alias("component_id")), "components")
    some = prints.where("n > 0").select("doc_id", *of_set).join(every, of_set).select("doc_id", "n", "component_id")
    none = prints.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumnRenamed("n", "n_shingles")
