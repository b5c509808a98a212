"""Packing of tokenised documents into fixed windows by multiway differencing.

Each document is tokenised, closed with the end id and cut: first into full windows, which
need no partner and stay where they are, then the rest into pieces of at most ``piece`` ids.
Pieces are dealt by hash into blocks of about ``block_windows`` windows; only their sizes
travel. Within a block the Karmarkar-Karp method starts from one partial partition per piece and keeps merging the two
with the largest spread, the largest sums of one on the smallest of the other, until one
partition into k near-equal windows is left. If a window exceeds the capacity, k rises by one
and the block is packed again. A block's work and memory are bounded whatever the input.

Defined results: a null text is an empty document, a single end id; a null id is kept;
repeated rows are packed each; an empty table gives an empty result; a very long text is cut
in a stream; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raceboard.llm.common import bare_id, keyed, map_batches, null_id, stored
from raceboard.session import share_code

TOKENIZER = "word_bpe_49k.json"
#: Chunks of these characters are cut and merged here; any other goes through the tokenizer file as a whole.
_PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įĲ-ž]*")
_CACHE_ROOM = 16 << 20  # bytes, about
_CACHED, _EACH = 64, 180  # the longest chunk that is kept; bytes of an entry beside its characters and ids


class WordBpe:
    """Ids of a word-end BPE tokenizer file, by white-space chunks that are remembered.

    White space is dropped before merging, so a text's ids are its chunks' ids in order. New
    chunks of plain Latin text go through the same merges as byte ranks, all others through the
    tokenizer itself. The memory is emptied when it holds about ``_CACHE_ROOM`` bytes. A text
    that names one of the file's added tokens goes through the file's tokenizer whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = spec["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        added = {t["content"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(added))) or "(?!)", regex.IGNORECASE)
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in added:
                body = token.removesuffix(suffix) or token
                ranks[bytes(letters[c] for c in body) + b"\xff" * (body != token)] = rank  # 0xFF is in no UTF-8 text: the word end
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            ids = [i for w in self.words.findall(chunk.lower()) for i in self.merge(w.encode() + b"\xff")]
        else:
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or self.marks.search(text):  # the former are white space for str.split() alone
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        chunks, cache = text.split(), self.cache
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            own: dict[str, bytes] = {}
            for c in set(chunks):
                found = cache.get(c)
                if found is None:
                    found = self._chunk(c)
                    if len(c) <= _CACHED:
                        if self.held > _CACHE_ROOM:
                            cache.clear()
                            self.held = 0
                        cache[c] = found
                        self.held += len(c) + len(found) + _EACH
                own[c] = found
            return b"".join(map(own.__getitem__, chunks))


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of full windows, then of near-equal pieces of the rest."""
    full = n // window
    out = [(i * window, window) for i in range(full)]
    rest = n - full * window
    if rest:
        parts = -(-rest // piece)
        at = [full * window + rest * i // parts for i in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(at, at[1:])]
    return out


def pieces(docs: DataFrame, window: int = 4096, piece: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, start, length, ids_crc32, doc_tokens`` (and ``ids``, as bytes) per piece."""
    schema = "doc_id bigint, no_doc_id boolean, h bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            rows = []
            for d, no, h, t in zip(batch["doc_id"], batch["no_doc_id"], batch["h"], batch["text"]):
                ids = (bpe.ids(t) if t else b"") + end
                n = len(ids) // 4
                for start, length in cuts(n, window, piece):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((d, no, h, start, length, zlib.crc32(part), n, part)[:len(names)])
            yield pd.DataFrame(rows, columns=names)

    return null_id(map_batches(bare_id(keyed(docs, doc_id, text)), run, schema))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``k`` windows of near-equal sums.

    A partial partition is its slots (relative sum, members) in falling order, with empty
    slots left out; a merge lays the largest slots of one on the smallest of the other.
    """
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = max(0, len(a) + len(b) - k)  # so many slots of both meet
        keep, low = a[:len(a) - over], a[len(a) - over:]
        met = [(x + y, (m, o)) for (x, m), (y, o) in zip(low, reversed(b[:over]))]
        slots = sorted(keep + met + b[over:], key=lambda s: -s[0])
        if len(slots) == k:
            floor = slots[-1][0]
            slots = [(s - floor, m) for s, m in slots]
        spread = slots[0][0] - (slots[-1][0] if len(slots) == k else 0)
        heapq.heappush(heap, (-spread, tie, slots))
        tie += 1

    def leaves(members: tuple) -> list[int]:
        out, todo = [], [members]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                out.append(x)
            else:
                todo.extend(x)
        return out

    return [leaves(m) for _, m in heap[0][2]] if heap else []


def pack_sizes(sizes: list[int], capacity: int, bundle: int = 64) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the differencing fills without excess.

    Sizes under ``bundle`` are first gathered into bundles of up to ``bundle``, which bounds
    the number of merges by the block's tokens.
    """
    groups: list[list[int]] = []
    small: list[int] = []
    held = 0
    for i, s in enumerate(sizes):
        if s >= bundle:
            groups.append([i])
        else:
            if held + s > bundle:
                groups.append(small)
                small, held = [], 0
            small.append(i)
            held += s
    if small:
        groups.append(small)
    totals = [sum(sizes[i] for i in g) for g in groups]
    k = max(1, -(-sum(totals) // capacity))
    while True:
        windows = difference(totals, k)
        if all(sum(totals[i] for i in w) <= capacity for w in windows):
            return [[i for g in w for i in groups[g]] for w in windows]
        k += 1


def pack(cut: DataFrame, window: int = 4096, block_windows: int = 128) -> DataFrame:
    """``cut`` (of ``pieces``, stored) with ``sequence_id`` and ``offset``.

    Full windows are sequences as they stand and are not shuffled. The block of a loose piece
    also hangs on its place in the stored table, so that repeated rows spread as well.
    """
    cut = cut.drop("ids")
    whole = cut.where(F.col("length") >= window).withColumns(
        {"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    loose = cut.where(F.col("length") < window)
    tokens = loose.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (window * block_windows)))
    share_code(cut.sparkSession)
    block = F.pmod(F.xxhash64("no_doc_id", "doc_id", "h", "start", F.monotonically_increasing_id()), F.lit(blocks))
    loose = bare_id(loose).withColumn("block", block)
    columns = [c for c in loose.columns if c != "block"]
    schema = ", ".join(f"{c} {'boolean' if c == 'no_doc_id' else 'bigint'}" for c in [*columns, "sequence_id", "offset"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "h", "start"], ascending=[False, True, True, True], ignore_index=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for s, members in enumerate(pack_sizes(sizes, window)):
            at = 0
            for i in members:
                sequence[i], offset[i] = s, at
                at += sizes[i]
        return rows[columns].assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    return null_id(loose.groupBy("block").applyInPandas(run, schema)).unionByName(whole)


def pack_documents(docs: DataFrame, window: int = 4096, piece: int = 1024, block_windows: int = 128, end_id: int = 2,
                   path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    cut = stored(pieces(docs, window, piece, end_id, path, doc_id=doc_id, text=text), "pieces")
    return pack(cut, window, block_windows)


def sequences(packed: DataFrame, cut: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the windows themselves, padded, as little-endian bytes.

    ``cut`` is the table of ``pieces(..., keep_ids=True)`` that ``packed`` was made from. A
    length that is a power of two is left as it is.
    """
    key = ["doc_id", "h", "start"]
    ids = cut.select(*[F.col(c).alias(f"_{c}") for c in key], "ids").dropDuplicates([f"_{c}" for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    rows = packed.join(ids, same).groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    power = F.bit_count("n_tokens") == 1
    room = F.when(power, F.lit(0)).otherwise(window - F.col("n_tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), room))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"))
