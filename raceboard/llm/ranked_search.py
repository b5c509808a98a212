"""Ranked lexical search for many items at once, sharing their common term sets.

The items of a block are planned together. Each item's terms (with their repeats) are sorted
by how many items hold them; items that begin alike share that term set. ``sharing_dag`` keeps
a node for every term set that two or more items share and that is not merely part of a longer
one with the same items. A node's parent is the next smaller shared set, and it owns only the
terms it adds; an item is a node under its largest shared set.

Documents are counted once (terms of the block's vocabulary, in one narrow pass) and stored.
The weights come from all documents. Then, chunk by chunk of the stored counts, every node's
document accumulator is made once, from its own terms, and added down the graph: what twenty
items share is summed once for the twenty. A task keeps the best ``top`` documents of each
item as it goes and hands on only those, so the final ranking sees ``top`` rows an item and
task. All scores are 64-bit integers.

Items are split into blocks of about ``block_terms`` terms by a hash of their key; a block's
vocabulary and graph go to the workers, so their size has that bound whatever the number of
items, and so has what the driver holds.

Defined results: a null or wordless text has no terms, counts in no statistic and is never
returned; an item without terms, or whose terms no document holds, returns no rows; a repeated
item row counts once; a null id is carried, and sorts last among equal scores; repeated
documents each count and are returned each; empty tables give empty results; other columns of
either table are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceboard.llm.common import keyed, stored
from raceboard.llm.decontamination import item_words
from raceboard.session import share_code

_KEPT = (string.ascii_lowercase + string.digits).encode()
#: Bytes of terms as they are, A-Z lower-cased, all other ASCII a gap.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or c in _KEPT else 0x20 for c in range(256))
_CELLS = 1 << 18  # accumulator cells that a task holds at once


@dataclass(frozen=True)
class Dag:
    """``parent`` of each node (-1: none, parents come first), ``owned[node]`` its own
    ``(term number, repeats)``, and the node of each item."""

    parent: list[int]
    owned: list[list[tuple[int, int]]]
    item_nodes: list[int]


def sharing_dag(items: list[list[tuple[int, int]]]) -> Dag:
    """The query-sharing graph of items, given as lists of ``(term number, repeats)``."""
    held_by = Counter(e for item in items for e in item)
    paths = [sorted(item, key=lambda e: (-held_by[e], e)) for item in items]
    prefix: dict[tuple[int, tuple[int, int]], int] = {}
    trails, users = [], Counter()
    for path in paths:
        at, trail = -1, []
        for e in path:
            at = prefix.setdefault((at, e), len(prefix))
            trail.append(at)
        users.update(trail)
        trails.append(trail)
    parent: list[int] = []
    owned: list[list[tuple[int, int]]] = []
    node_of: dict[int, int] = {}
    item_nodes = []
    for path, trail in zip(paths, trails):
        above, begin = -1, 0
        for i, at in enumerate(trail):
            if users[at] > 1 and (i + 1 == len(trail) or users[trail[i + 1]] < users[at]):
                if at not in node_of:
                    node_of[at] = len(parent)
                    parent.append(above)
                    owned.append(path[begin:i + 1])
                above, begin = node_of[at], i + 1
        item_nodes.append(len(parent))
        parent.append(above)
        owned.append(path[begin:])
    return Dag(parent, owned, item_nodes)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, tids, tfs`` per row: its terms with repeats, and those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, tids, tfs = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                terms = text.translate(_TABLE).split()
                counts = Counter(filter(vocabulary.__contains__, terms))
                sizes.append(len(terms))
                tids.extend(map(vocabulary.__getitem__, counts))
                tfs.extend(counts.values())
                ends.append(len(tids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "tids", "tfs"])

    share_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, tids array<int>, tfs array<int>")


def weights(counts: DataFrame) -> tuple[int, int, DataFrame]:
    """``N``, ``L`` and ``(tid, w)`` over all counted documents."""
    n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counts.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    return n_docs, n_terms, holders.select("tid", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"))


class _Best:
    """The best ``top`` ``(score, doc_id)`` of every item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """``scores``: items x documents."""
        item, at = np.nonzero(scores >= self.least[:, None])
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[item, at]))
        doc, null = np.concatenate((self.doc, docs[at])), np.concatenate((self.null, null[at]))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        full = place == self.top - 1
        self.least[item[full]] = score[full]
        keep = place < self.top
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]


def _best_of_tasks(counts: DataFrame, dag: Dag, weight: dict[int, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``item, doc_id, score``: of each task the best ``top`` documents of every item."""
    nodes, n_items = len(dag.parent), len(dag.item_nodes)
    pairs = sorted((tid, node, repeats * weight[tid]) for node, own in enumerate(dag.owned) for tid, repeats in own if weight.get(tid))
    depth: list[int] = []
    for p in dag.parent:
        depth.append(0 if p < 0 else depth[p] + 1)
    width = max(1, _CELLS // max(nodes, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, value = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.int64)
        tid_of = np.array([p[0] for p in pairs], np.int64)
        levels = [(np.array(x), np.array([dag.parent[i] for i in x])) for x in
                  ([i for i in range(nodes) if depth[i] == d] for d in range(1, max(depth, default=0) + 1))]
        of_items = np.array(dag.item_nodes, np.int64)
        best = _Best(n_items, top)
        for batch in batches:
            ids = batch.column("doc_id")
            docs, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            size = batch.column("n").to_numpy()
            ends = batch.column("tids").offsets.to_numpy().astype(np.int64)
            tids, tfs = (batch.column(c).values.to_numpy().astype(np.int64) for c in ("tids", "tfs"))
            m = 25 + (75 * size * n_docs) // max(n_terms, 1)
            for a in range(0, len(docs), width):
                b = min(a + width, len(docs))
                part = slice(int(ends[a]), int(ends[b]))
                at = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
                tf = tfs[part]
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[a:b][at])
                low, high = np.searchsorted(tid_of, tids[part], "left"), np.searchsorted(tid_of, tids[part], "right")
                times = high - low
                use = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                made = np.zeros(nodes * (b - a), np.int64)
                np.add.at(made, owner[use] * (b - a) + np.repeat(at, times), value[use] * np.repeat(impact, times))
                made = made.reshape(nodes, b - a)
                for below, above in levels:
                    made[below] += made[above]
                best.add(made[of_items], docs[a:b], null[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())],
                                         names=["item", "doc_id", "score"])

    return counts.where(F.size("tids") > 0).mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, block_terms: int = 100_000, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, ih, rank, doc_id, score``: the ``top`` documents of each item, score above 0."""
    spark = docs.sparkSession
    asked = stored(item_words(items, item_id, item_text), "items")
    blocks = -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // block_terms)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "ih"), F.lit(max(blocks, 1))))
    found = []
    for block in range(max(blocks, 1)):
        rows = asked.where(F.col("block") == block).orderBy("item_id", "ih").collect()  # about block_terms words
        vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
        dag = sharing_dag([[(vocabulary[w.encode()], c) for w, c in Counter(r["words"]).items()] for r in rows])
        counts = stored(count_terms(keyed(docs, doc_id, text), vocabulary), "term-counts")
        n_docs, n_terms, weighed = weights(counts)
        best = _best_of_tasks(counts, dag, dict(map(tuple, weighed.collect())), n_docs, n_terms, top)
        names = spark.createDataFrame([(i, r["item_id"], r["ih"]) for i, r in enumerate(rows)], "item bigint, item_id bigint, ih bigint")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found.append(stored(ranks.join(names, "item").select("item_id", "ih", "rank", "doc_id", "score"), "ranked"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
