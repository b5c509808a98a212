"""Incremental secret scan over a content-addressed blob ledger.

Every version of every path is stored under the SHA-256 of its content. A scan takes the
distinct (blob, rule version) pairs that the ledger has not seen, runs the rules of that
version over each blob once, appends what it found and that it looked, and joins findings
back to all paths that ever held the blob.

Defined results: a null text is an empty blob, which holds nothing; a null path id keeps its
own row; repeated rows share one scan and each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceboard.llm.common import keyed, stored

SPAN = "struct<start:bigint,ord:int,kind:string,end:bigint>"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True
    #: Cheap test that every text with a counting match passes.
    hint: str | None = None


#: A run of hex digits, or of letters after AKIA, is matched whole or not at all, so its
#: least length stands in the pattern; the value of an assignment is measured afterwards.
RULES = {
    1: (
        Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
             hint=r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
        Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    ),
    2: (
        Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    ),
}
_ORDER = {r.kind: i for i, r in enumerate(r for v in sorted(RULES) for r in RULES[v])}


#: Matches whose spans are listed at a time: adding to a list copies it.
BLOCK = 256


def spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule's counting matches, in code points, by the lengths of the matches
    and of the pieces between them. Lists grow a block of matches at a time, so that a text
    with very many takes time in proportion to them."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    sizes = lambda a: F.transform(a, lambda x: F.char_length(x))
    # the piece after the last match has no match beside it
    rows = F.filter(F.arrays_zip(sizes(matches).alias("m"), sizes(values).alias("v"), sizes(F.split(text, rule.pattern)).alias("p")), lambda r: r["m"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["p"]
        end = begin + row["m"]
        span = F.struct(begin.alias("start"), F.lit(_ORDER[rule.kind]).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        found = row["v"] >= rule.least
        return F.struct(end.alias("at"), F.when(found, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(f"array<{SPAN}>").alias("out"))

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).cast(f"array<array<{SPAN}>>").alias("out")))[0]

    starts = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(F.array(rows), lambda a: F.transform(starts(a), lambda i: F.slice(a, i, F.lit(BLOCK))))[0]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    # most texts hold nothing: one search for the pattern's start, and no lists
    return F.when(text.rlike(rule.hint or rule.pattern), F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, h, blob)``: which content each path's version holds."""
    return keyed(docs, doc_id, text).select("doc_id", "h", blob_id(F.col("text")).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_versions: tuple[int, ...] = (1, 2), text: str = "text") -> DataFrame:
    """New ledger rows ``(blob, rule_version, spans)`` for the pairs that ``ledger`` lacks.

    Each task keeps one text of each blob before anything is shuffled, so copies neither
    travel nor meet in one task.
    """
    pairs = docs.sparkSession.createDataFrame([(v,) for v in rule_versions], "rule_version int")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = docs.select(blob_id(content).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(v) for v in rule_versions])
    if ledger is not None:
        seen = ledger.join(F.broadcast(pairs), "rule_version").groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        wanted = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<int>")))
    todo = blobs.select("blob", "text", F.explode(wanted).alias("rule_version"))
    found = F.lit(None).cast(f"array<{SPAN}>")
    for version in rule_versions:
        of_version = F.concat(*[spans(F.col("text"), r) for r in RULES[version]])
        found = F.when(F.col("rule_version") == version, of_version).otherwise(found)
    return todo.select("blob", "rule_version", F.sort_array(found).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rule_versions: tuple[int, ...] = (1, 2), text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` has not seen, append it there and return the whole ledger."""
    spark = docs.sparkSession
    schema = f"blob string, rule_version int, spans array<{SPAN}>"
    try:
        known = spark.read.schema(schema).parquet(path)
        known.isEmpty()
    except Exception as e:  # noqa: BLE001 - only a missing folder means an empty ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    scan(docs, known, rule_versions, text).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def findings(history: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(doc_id, h, blob, spans)`` for all paths of ``history`` (of ``versions``), spans in order."""
    hits = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    hits = stored(hits.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans")), "findings")
    return history.join(hits, "blob", "left").select(
        "doc_id", "h", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def joined(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
