"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical) and at least ``max(24, 3 * q)`` words, which no neighbouring word extends. Every
word of a run occurs in it three times or more. So a word that occurs less often within a
segment can join no run there: it splits the segment, the counts are taken anew in the pieces,
and so on until nothing splits. Pieces of under 24 words are dropped; common prose leaves
hardly any segment over.

The lag scan of a surviving segment tries every lag. A run of ``3 * q`` words or more holds two
whole blocks of ``q`` words that start at multiples of ``q``, and they are equal; block hashes
find those pairs (a segment of m words has about m * ln m blocks over all lags). Each pair is
then compared word by word and extended to both sides, so hashes decide nothing. A lag that is
a multiple of a known run's period is passed over inside that run.

Each row is worked on by itself in one narrow pass; nothing is shuffled, and a lost executor
costs only its own rows. A task holds one batch of rows and the words and results of a part of
it that is bounded in rows and bytes.

Defined results: a null, empty or wordless text has no words and no runs and collapses to the
empty text; ids are carried, not looked at, and may be null; ties and repeated rows each get
their own result; empty tables give empty results; other columns are carried along under
``row``, whatever their names; a text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceboard.llm.common import short_batches
from raceboard.session import share_code

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
LEAST = 24  # words of the shortest run
TIMES = 3  # periods of the shortest run
_BASE = 0x9E3779B97F4A7C15  # odd: block hashes are taken modulo 2**64
_BATCH = 1 << 16  # block pairs compared at a time
_ROWS, _BYTES = 64, 1 << 20  # of texts held as Python objects and of results handed on

Run = tuple[int, int, int]  # start, length, period


def coded(words: list) -> np.ndarray:
    """The words as numbers, equal where they are equal."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, ids)`` of the stretches in which every word occurs often enough for a run."""
    open_ = [(0, ids)]
    while open_:
        start, part = open_.pop()
        if len(part) < LEAST:
            continue
        _, code, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[code] < TIMES)
        if not len(rare):
            yield start, code
            continue
        edges = np.concatenate(([-1], rare, [len(part)]))
        for i in np.flatnonzero(np.diff(edges) > LEAST):
            a, b = edges[i] + 1, edges[i + 1]
            open_.append((start + a, part[a:b]))


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items agree; looks no further than about twice that."""
    at, step = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def _squares(x: np.ndarray, power: np.ndarray, prefix: np.ndarray, low: int, high: int, known: list[Run]) -> Iterator[tuple[int, int]]:
    """``(start, lag)`` of equal neighbouring blocks at multiples of each lag in ``low..high``."""
    lags = np.arange(low, high + 1)
    blocks = len(x) // lags - 1
    while len(lags):  # so many lags at a time that memory stays bounded
        take = max(1, int(np.searchsorted(np.cumsum(blocks), _BATCH, "right")))
        lag = np.repeat(lags[:take], blocks[:take])
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(blocks[:take]) - blocks[:take], blocks[:take])) * lag
        lags, blocks = lags[take:], blocks[take:]
        same = np.flatnonzero((x[at] == x[at + lag]) & (x[at + lag - 1] == x[at + 2 * lag - 1]))
        at, lag = at[same], lag[same]
        if not len(at):
            continue
        middle = prefix[at + lag]
        same = (middle - prefix[at]) * power[lag] == prefix[at + 2 * lag] - middle
        for start, length, period in known:
            same &= (lag % period != 0) | (at < start) | (at + 2 * lag > start + length)
        at, lag = at[same], lag[same]
        chained = np.zeros(len(at), bool)  # a pair that starts a lag after another is of the same run
        chained[1:] = (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + lag[1:])
        yield from zip(at[~chained].tolist(), lag[~chained].tolist())


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and hashes of the prefixes of ``x``, modulo 2**64."""
    with np.errstate(over="ignore"):
        power = np.full(len(x) + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return power, np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(mixed * power[:-1])))


def lag_scan(x: np.ndarray) -> list[Run]:
    """All runs of a segment, by lags in doubling steps."""
    found: dict[tuple[int, int], int] = {}
    low, high = 1, 7
    power, prefix = _hashes(x)
    while low <= len(x) // TIMES:
        known = [(start, length, q) for (start, length), q in found.items() if length >= max(4 * q, 2 * low)]  # can hold two blocks of a multiple
        for at, q in _squares(x, power, prefix, low, min(high, len(x) // TIMES), known):
            if not np.array_equal(x[at:at + q], x[at + q:at + 2 * q]):
                continue
            left = _first_difference(x[:at][::-1], x[q:at + q][::-1])
            right = _first_difference(x[at + q:len(x) - q], x[at + 2 * q:])
            start, length = at - left, left + 2 * q + right
            if length >= max(LEAST, TIMES * q):
                found.setdefault((start, length), q)  # lags rise, so the first is the smallest period
        low, high = high + 1, 2 * high + 1
    return [(start, length, q) for (start, length), q in found.items()]


def runs_of(words: list) -> list[Run]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < LEAST:
        return []
    return sorted(((int(at) + start, length, q) for at, part in segments(coded(words)) for start, length, q in lag_scan(part)),
                  key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``_ROWS`` rows and about ``_BYTES`` of text (a longer text is a piece)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start == _ROWS or held + size > _BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, n_words, runs, collapsed`` per row of ``docs``: all its other columns as ``row``, the
    runs as ``array<struct<start, length, period>>`` and the text without repeats."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    source = docs.select(F.struct(*rest or [F.lit(None).cast("int").alias("nothing")]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    out = T.StructType([source.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            for part in _parts(batch):
                counts, runs, texts = [], [], []
                for text in part.column("text").cast(pa.binary()).fill_null(b""):
                    words = text.as_py().split()
                    counts.append(len(words))
                    runs.append(found := runs_of(words))
                    texts.append(collapsed(words, found).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(counts, pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], kind),
                     pa.array(texts, pa.string())], names=["row", "n_words", "runs", "collapsed"])

    share_code(docs.sparkSession)
    short_batches(docs.sparkSession)
    return source.mapInArrow(scan, out)
