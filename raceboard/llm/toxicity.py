"""Toxicity behind noisy spelling.

A text is a clean text sent through a noisy channel: letters become look-alike signs, runs of
a letter grow, blanks or dots get between letters. Suspicious stretches become character
lattices (per sign: the letters it can stand for, itself, or nothing), and a Viterbi search
under a trigram character model of the whole corpus picks the likeliest clean reading. The
score reads the restored text's words.

A word without a look-alike sign, a run of three or a separator has one reading, itself, and so
have URLs, hex digests and plain numbers; every other stretch is decoded whole, whatever its
length, and so is each of its parts between separators. A look-alike sign at the edge of a
stretch may be just a sign; words count with either reading. The classifier is a lexicon
of words and word beginnings that toxic training texts share, each with its smoothed
precision; a text's score is a noisy-or over its distinct words.

Defined results: a null or empty text has no words and scores as a text without a lexicon
word; a null id is never held out and its label is never used; repeated rows each get a row;
of several labels of one id the highest counts; without labels nothing is toxic; empty tables
give empty results; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.llm.common import bare_id, keyed, map_batches, null_id, stored
from raceboard.session import share_code

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœß"
SIZE = len(LETTERS) + 1  # 0 is the word boundary, and any other character
_CODE = np.zeros(0x10000, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}

#: The letters that a sign can stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
#: Costs (negative log probabilities) of the channel.
SIGN, DROP, RUN, JOIN, BREAK = 0.5, 5.0, 0.5, 0.2, 1.5
#: Signs that rather part words than join them.
PARTING = "=/\\:"
#: What is surely no disguised word: URLs, UUIDs, hex digests (collapsed runs still leave 16 digits), numbers.
URL = re.compile(r"(?:https?|ftp)://|www\.")
HEX = re.compile(r"(?:0x)?(?=[a-f]*\d)(?:([\da-f])\1*+){16,}+|[\da-f]{8}(?:-[\da-f]{4}){3}-[\da-f]{12}")
NUMBER = re.compile(r"[+($€-]*\d[\d.,:/-]*[%)!]*[$€]?")
EDGE = "\"'.,;:!?()[]{}<>|*#%&$-_=+~/\\`^«»…“”’"
SPACED = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){2,}(?!\w)")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
WORD = re.compile(r"[^\W\d_]+")
_SIGNS = frozenset(LOOKALIKES)
#: Standard deviations that a feature's precision is taken lower by.
Z = 3.0
_EDGE_PLAIN = "".join(c for c in EDGE if c not in LOOKALIKES)
#: What parts a stretch: neither a letter nor a digit nor a look-alike sign.
_PARTS = re.compile(rf"[^\w{re.escape(''.join(LOOKALIKES))}]+|_+")


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODE[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(gram, n)`` over all texts: each task adds up its own, at most ``SIZE``**3 rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            for t in batch["text"]:
                if t:
                    t = f" {t} "
                    for at in range(0, len(t) - 2, 1 << 20):  # parts that share two characters
                        c = codes(t[at:at + (1 << 20) + 2])
                        np.add.at(total, (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    return (map_batches(docs.select(F.col(text).cast("string").alias("text")), run, "gram bigint, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs -log P(c | a, b), interpolated with bigrams and unigrams. The table has ``SIZE``**3
    entries however large the corpus, so it is the one thing that is brought to the driver."""
    n = np.zeros(SIZE ** 3, np.float64)
    found = counts.toPandas()
    n[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    n = n.reshape(SIZE, SIZE, SIZE)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def lattice(stretch: str, edges: bool = True) -> list[list[tuple[str, float]]]:
    """Per sign or run the readings (letters, nothing, and with ``edges`` for a sign at an edge
    the sign itself) with their costs."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    first, last = len(stretch) - len(stretch.lstrip(EDGE)), len(stretch.rstrip(EDGE))
    while at < len(stretch):
        c = stretch[at]
        end = at
        while end < len(stretch) and stretch[end] == c:
            end += 1
        run = end - at
        if c in LOOKALIKES:
            readings = [(x, SIGN) for x in LOOKALIKES[c]] + [("", DROP)]
            if edges and (at < first or at >= last):
                readings = [*readings, (c, 0.0)]
            out += [readings] * min(run, 2) if run < 3 else [readings + [(x + x, SIGN + RUN) for x in LOOKALIKES[c]]]
        elif c in _AT:
            out.append([(c * run, 0.0)] if run < 3 else [(c, RUN), (c + c, RUN)])
        elif c.isalnum():
            out.append([("", DROP)])
        elif c in PARTING:
            out.append([("", BREAK), (c, JOIN)])
        else:  # a separator: joins what it parts, or ends a word
            out.append([("", JOIN), (c, BREAK)])
        at = end
    return out


def decode(stretch: str, model: np.ndarray, edges: bool = True) -> str:
    """The likeliest clean reading: Viterbi over states of the last two letters. Paths are linked
    backwards and share what they have in common, so length costs in proportion. A boundary after
    a boundary is the same one."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in [*lattice(stretch, edges), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, price in readings:
                x, y, total = a, b, cost + price
                for letter in letters:
                    z = _AT.get(letter, 0)
                    if y or z:
                        total += float(model[x, y, z])
                        x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, letters) if letters else path)
        states = after
    path, out = min(states.values(), key=lambda s: s[0])[1], []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out)).strip()


class Memory(dict):
    """What was worked out for chunks, emptied when it holds about ``room`` bytes.

    Chunks over ``LONGEST`` characters seldom come again and are not kept.
    """

    LONGEST, EACH = 64, 150  # bytes of an entry beside its characters

    def __init__(self, room: int = 96 << 20):
        super().__init__()
        self.room, self.size = room, 0

    def keep(self, chunk: str, found: tuple) -> tuple:
        if len(chunk) <= self.LONGEST:
            if self.size >= self.room:
                self.clear()
                self.size = 0
            self[chunk] = found
            self.size += len(chunk) + self.EACH + sum(60 + len(str(f)) for f in found)
        return found


class Restorer:
    """Decodes suspicious stretches."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def reading(self, chunk: str, edges: bool = True) -> str | None:
        """The restored form of a chunk without white space, or None if it has but one reading.
        Without ``edges`` look-alike signs at its edges are letters in any case."""
        core = chunk.strip(_EDGE_PLAIN)
        if not core or core.isalpha() and not TRIPLE.search(core) or URL.match(core) or HEX.fullmatch(core) or NUMBER.fullmatch(core):
            return None
        letters = sum(c.isalpha() for c in core)
        signs = sum(c in _SIGNS for c in core)
        if letters + signs < 2 or not letters and all(c.isdigit() or c not in _SIGNS for c in core):
            return None
        if not (signs or TRIPLE.search(core) or _PARTS.search(core)):
            return None
        at = chunk.index(core)
        return chunk[:at] + decode(core, self.model, edges) + chunk[at + len(core):]

    def readings(self, chunk: str) -> Iterator[str]:
        """The restored forms of a chunk and of its parts, with either reading of the edges."""
        if URL.match(chunk.strip(_EDGE_PLAIN)):
            return
        for part in dict.fromkeys([chunk, *_PARTS.split(chunk)]):
            first = self.reading(part)
            if first is not None:
                yield first
                core = part.strip(_EDGE_PLAIN)
                if core[0] in EDGE or core[-1] in EDGE:
                    yield self.reading(part, False)

    def chunk_words(self, chunk: str) -> tuple[str, ...]:
        """The words of a lower-cased chunk: as they stand, and as restored."""
        return tuple(dict.fromkeys(w for r in [*self.readings(chunk), chunk] for w in WORD.findall(r)))

    def text_words(self, text: str | None, memory: Memory) -> set[str]:
        """Distinct words of the restored text."""
        low = (text or "").lower()
        out: set[str] = set()
        for chunk in set(low.split()):
            got = memory.get(chunk)
            out.update(memory.keep(chunk, self.chunk_words(chunk)) if got is None else got)
        for m in SPACED.finditer(low):
            out.update(WORD.findall(self.spaced(m[0])))
        return out

    def spaced(self, stretch: str) -> str:
        """Spaced letters as words."""
        return decode(" ".join(stretch[::2]), self.model)

    def restore(self, text: str | None) -> str | None:
        """The whole text with its suspicious stretches decoded."""
        if text is None:
            return None
        text = SPACED.sub(lambda m: self.spaced(m[0].lower()), text)

        def swap(m: re.Match) -> str:
            got = self.reading(m[0].lower())
            return m[0] if got is None else got

        return re.sub(r"\S+", swap, text)


def restored(docs: DataFrame, model: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, h, text)`` with the restored text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model)
        for batch in batches:
            yield batch.assign(text=[restorer.restore(t) for t in batch["text"]])

    return null_id(map_batches(bare_id(keyed(docs, doc_id, text)), run, "doc_id bigint, h bigint, text string, no_doc_id boolean"))


def features(word: str) -> list[str]:
    """The word, and its beginnings of four to six letters marked with a dash."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_train: int = 10_000, least: int = 5, precision: float = 0.9,
                doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict[str, float]:
    """Feature to precision, from at most ``max_train`` labelled rows (those with the smallest
    hash of their id) that are not held out.

    Training texts with the same sketch (eight smallest word hashes) count once, so copies of
    one text lend its words no weight. A feature needs ``least`` toxic texts, however many there
    are in all, ``precision`` of its texts toxic, and a lower bound of that share (Wilson's, at
    ``Z`` deviations) above the share of toxic texts in all, or above a half where that is less:
    of the many rare words some stand in toxic texts alone by chance.
    """
    marks = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("mark"))
             .where(F.col("id").isNotNull() & F.col("mark").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("mark").alias("mark")).orderBy(F.xxhash64("id"), "id").limit(max_train))
    marks = stored(marks, "training-labels")
    train = keyed(docs, doc_id, text).withColumnRenamed("doc_id", "id").join(F.broadcast(marks), "id")  # max_train rows at most

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, memory = Restorer(model), Memory()
        for batch in batches:
            yield pd.DataFrame({"mark": batch["mark"], "words": [sorted(restorer.text_words(t, memory)) for t in batch["text"]]})

    bags = map_batches(train.select("mark", "text"), words, "mark int, words array<string>")
    sketch = F.slice(F.sort_array(F.transform("words", lambda w: F.xxhash64(w))), 1, 8)
    bags = stored(bags.groupBy(sketch.alias("sketch")).agg(F.max(F.struct("mark", "words")).alias("b")).select("b.*"), "training-bags")
    toxic, clean = (bags.where(F.col("mark") == m).count() for m in (1, 0))
    if not toxic or not clean:
        return {}

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for mark, bag in zip(batch["mark"], batch["words"]):
                n[int(mark > 0)].update({f for w in bag for f in features(w)})
        names = [*n[0].keys() | n[1].keys()]
        yield pd.DataFrame({"f": names, "t": [n[1][f] for f in names], "c": [n[0][f] for f in names]}).astype({"f": str})

    table = (map_batches(bags, seen, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
             .where(F.col("t") >= least))
    prior = toxic / (toxic + clean)
    n = F.col("t") + F.col("c")
    bound = (F.col("t") + Z * Z / 2 - Z * F.sqrt(F.col("t") * F.col("c") / n + Z * Z / 4)) / (n + Z * Z)
    rows = table.where((F.col("t") >= precision * n) & (bound > min(prior, 0.5))).withColumn("p", (F.col("t") + 3 * prior) / (F.col("t") + F.col("c") + 3))
    return {r["f"]: float(r["p"]) for r in rows.select("f", "p").collect()}  # bounded by max_train texts


def scorer(spark: SparkSession, model: np.ndarray, lexicon: dict[str, float], base: float):
    """A column function text -> score: 1 - (1 - base) times (1 - p) over the distinct lexicon words."""
    share_code(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer, known = Restorer(model), Memory()

        def hits(words: Iterable[str]) -> tuple[tuple[str, float], ...]:
            found = ((w, max((lexicon.get(f, 0.0) for f in features(w)), default=0.0)) for w in words)
            return tuple((w, p) for w, p in found if p)

        def score(text: str | None) -> float:
            low, words = (text or "").lower(), {}
            for chunk in set(low.split()):
                got = known.get(chunk)
                if got is None:
                    got = known.keep(chunk, hits(restorer.chunk_words(chunk)))
                if got:
                    words.update(got)
            for m in SPACED.finditer(low):
                words.update(hits(WORD.findall(restorer.spaced(m[0]))))
            out = 1 - base
            for w in sorted(words):
                out *= 1 - words[w]
            return 1 - out

        for batch in batches:
            yield batch.map(score)

    return F.pandas_udf(run, "double")


def fitted(docs: DataFrame, labels: DataFrame, max_train: int = 10_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The score as a column function, with the model of all of ``docs`` and the lexicon of its labelled rows."""
    model = language_model(trigram_counts(docs, text))
    return scorer(docs.sparkSession, model, fit_lexicon(docs, labels, model, max_train, doc_id=doc_id, text=text, label=label), 0.01)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 10_000, doc_id: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """``doc_id, h, held_out, score, predicted`` for every row."""
    score = fitted(docs, labels, max_train, doc_id, text, label)
    found = keyed(docs, doc_id, text).select("doc_id", "h", score(F.col("text")).alias("score"))
    return found.select("doc_id", "h", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
