"""SimHash near-duplicates by pivot distance tables.

A fingerprint's table row holds its Hamming distances to reference fingerprints. Distances
to the same reference differ by no more than the fingerprints do, so a pair with one
coordinate further apart than the allowed bits is discarded without comparing fingerprints.

Two sets of references serve. The ramp (0, 1, 3, 7, ... all ones) has a coordinate step per
bit. Split into blocks, two rows within ``max_bits`` agree on all steps of all but
``max_bits`` blocks, so joining on the agreeing blocks' steps reaches every pair that can
link, without comparing all rows; a step is the bit itself, so the key is read off the
fingerprint. Eight scattered references, packed in one long, then discard most of the pairs
that meet. (Scattered references alone give no join key: distances of 64-bit fingerprints
cluster around 32.) Survivors are verified on the fingerprints.

Only distinct fingerprints are paired, so copies cost nothing. Where more than ``dense`` rows
share a key, they meet only if they agree on further blocks of the remaining bits.

Defined results: a null, empty or wordless text has fingerprint zero and is linked like any
other; a null id takes part but names no component (its component may have a null id when
it has no other); repeated rows each get a row; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceboard.llm.common import bare_id, keyed, map_batches, null_id, stored

SEED = 42
PIVOTS = [random.Random(1000 + i).getrandbits(64) for i in range(8)]
_STEP = 1 << 16
#: Tables of links are worked on by at least so many tasks, or one for so many rows.
_LEAST_TASKS, _TASK_ROWS = 8, 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: bit set where over half the shingles' XXH64 have it set."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(tokens))
    n = len(tokens) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):  # bounded memory for any length
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, h, fp)`` per row, by a narrow Arrow-batched pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_doc_id": batch["no_doc_id"], "h": batch["h"],
                                "fp": np.array([fingerprint(t, shingle) for t in batch["text"]], np.int64)})

    return null_id(map_batches(bare_id(keyed(docs, doc_id, text)), run, "doc_id bigint, no_doc_id boolean, h bigint, fp bigint"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(mask: int, blocks: int, differ: int) -> list[int]:
    """The bits of ``mask`` in ``blocks`` parts: every union of all parts but ``differ``."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - differ)]


def pivot_row(fp: Column) -> Column:
    """Distances to the scattered references, seven bits each."""
    packed = F.lit(0).cast("long")
    for i, pivot in enumerate(PIVOTS):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("long"), 7 * i))
    return packed


def _far(a: str, b: str) -> Column:
    """The largest coordinate difference of two packed rows."""
    at = lambda c, i: F.shiftright(F.col(c), 7 * i).bitwiseAND(F.lit(127))
    return F.greatest(*[F.abs(at(a, i) - at(b, i)) for i in range(len(PIVOTS))])


def blocks_for(n: int, max_bits: int) -> int:
    """Enough blocks for the agreeing ones to tell ``n`` fingerprints apart (every choice finds the same links)."""
    blocks = max_bits + 2
    while blocks < 16 and 64 * (blocks - max_bits) / blocks < math.log2(max(n, 1)) + 4:
        blocks += 1
    return blocks


def _pairs(members: DataFrame, key: list[str], max_bits: int) -> DataFrame:
    left = members.select(*key, F.col("fp").alias("a"), F.col("row").alias("ra"))
    right = members.select(*key, F.col("fp").alias("b"), F.col("row").alias("rb"))
    return (left.join(right, key).where(F.col("a") < F.col("b")).where(_far("ra", "rb") <= max_bits)
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))


def _shared(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows whose key occurs again, with the key's count ``n``."""
    again = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), f"{name}-keys")
    return stored(rows.join(again, key), name)


def links(fps: DataFrame, max_bits: int = 3, dense: int = 64) -> DataFrame:
    """``(a, b)``: all pairs of distinct fingerprints (column ``fp``) within ``max_bits`` bits."""
    fps = stored(fps.select("fp").distinct(), "fingerprints")
    masks = _masks((1 << 64) - 1, blocks_for(fps.count(), max_bits), max_bits)
    key_of = lambda all_masks: F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(all_masks)])).alias("k")
    rows = fps.select("fp", pivot_row(F.col("fp")).alias("row"), key_of(masks)).select("k.mask", "k.key", "fp", "row")
    members = _shared(rows, ["mask", "key"], "pivot-cells")
    found = _pairs(members.where(F.col("n") <= dense), ["mask", "key"], max_bits)
    crowded = members.where(F.col("n") > dense).drop("n")
    rest = [_masks(((1 << 64) - 1) ^ m, max_bits + 3, max_bits) for m in masks]
    subs = F.element_at(F.array(*[F.array(*[F.lit(_signed(s)) for s in r]) for r in rest]), F.col("mask") + 1)
    finer = crowded.select("*", F.posexplode(subs).alias("sub", "sub_mask")).select(
        "mask", "key", "sub", F.col("fp").bitwiseAND(F.col("sub_mask")).alias("sub_key"), "fp", "row")
    sub_key = ["mask", "key", "sub", "sub_key"]
    found = found.unionByName(_pairs(_shared(finer, sub_key, "finer-cells"), sub_key, max_bits))
    return stored(found.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``: its component's smallest node.

    Alternating stars: every node's larger neighbours, then its smaller ones, are hung on the
    smallest, until only stars are left; written tables carry the rounds, in as many tasks as
    their rows need.
    """
    star = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "stars")
    while tasks := _tasks_left(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(stored(least.coalesce(tasks), "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct().coalesce(tasks), "large-stars")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "small-least")
        hung = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        star = stored(hung.where(F.col("u") != F.col("v")).distinct().coalesce(tasks), "stars")
    roots = star.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _tasks_left(star: DataFrame) -> int:
    """0 if ``star(u, v)`` is stars only (every ``u`` hangs on one ``v``, which hangs on none),
    else how many tasks its rows are worth."""
    ends = star.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
    crossed = (F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))
    found = nodes.agg(F.count(F.when(crossed, F.lit(1))).alias("crossed"), F.sum("hangs").alias("rows")).first()
    return max(_LEAST_TASKS, found["rows"] // _TASK_ROWS) if found["crossed"] else 0


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, dense: int = 64, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, h, fp, component_id`` per row: the smallest id reachable over links."""
    prints = stored(fingerprints(docs, shingle, doc_id, text), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    of = stored(components(links(nodes, max_bits, dense)), "roots")
    linked = nodes.join(of, F.col("fp") == F.col("node")).select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    every = stored(nodes.join(named, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id")),
                   "components")
    return prints.join(every, "fp").select("doc_id", "h", "fp", "component_id")
