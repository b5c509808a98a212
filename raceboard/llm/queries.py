"""The registered queries: thin calls of the operators on the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.llm import chat_format, decontamination, exact_dedup, line_dedup, minhash, packing, periodic_runs, ranked_search, secrets, simhash, toxicity, url_filter, warc
from raceboard.llm.common import read_table
from raceboard.session import scratch_path

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') g
        FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) s FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') g
          FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s, win.n FROM grams JOIN win USING (g) WHERE grams.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat_format.link_tool_calls(*chat_format.calls_of_turns(read_table(spark, sf_dir, "conversations")))
    return linked.withColumn("violations", F.array_join("violations", ","))


OP2_SQL = """
WITH t AS (SELECT *, conv_id || ':' || turn id, conv_id || ':' || (turn - 1) back, coalesce(role IN ('user', 'system'), false) asks FROM conversations),
c AS (SELECT t.*, CASE WHEN role = 'user' AND EXISTS (SELECT 1 FROM t e WHERE e.conv_id = t.conv_id AND e.turn = t.turn - 2 AND e.role = 'user')
                       THEN conv_id || ':' || (turn - 2) END aft, count(*) OVER (PARTITION BY id) copies FROM t WHERE asks),
r AS (SELECT *, id IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.id = t.back) called, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) place FROM t WHERE NOT asks)
SELECT c.conv_id, c.id call_id, c.turn seq, 0 AS level, CASE WHEN c.id IS NOT NULL AND c.copies > 1 THEN 'duplicate' WHEN r.back IS NULL THEN 'unanswered' ELSE 'linked' END status,
       concat_ws(',', CASE WHEN c.text IS NULL THEN 'missing:prompt' END, CASE WHEN c.turn IS NULL THEN 'missing:turn' END) violations,
       '{"arguments":{' || concat_ws(',', '"after":' || to_json(aft), '"prompt":' || to_json(c.text), '"turn":' || c.turn)
       || '},"depends_on":[' || CASE WHEN aft IS NULL THEN '' ELSE to_json(aft)::VARCHAR END || '],"id":' || coalesce(to_json(c.id)::VARCHAR, 'null') || ',"name":"'
       || CASE c.role WHEN 'user' THEN 'respond' ELSE 'configure' END || '","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}' record
FROM c LEFT JOIN r ON r.back = c.id AND r.place = 1
UNION ALL
SELECT conv_id, back, turn, NULL, CASE WHEN called THEN 'extra_result' ELSE 'orphan_result' END, '',
       '{"id":' || coalesce(to_json(back)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
FROM r WHERE NOT (called AND place = 1)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a fresh ledger: every blob under rule version 1, then, when version 2 is
    added, the pairs that the first has not looked at."""
    docs = read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "ledger")
    secrets.update_ledger(docs, path, (1,))
    ledger = secrets.update_ledger(docs, path, (1, 2))
    found = secrets.findings(secrets.versions(docs), ledger)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.RULES[1]]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def _spans_sql(rule: secrets.Rule, order: int) -> str:
    """DuckDB: spans of one rule by the lengths of matches and of the pieces between them."""
    pattern = rule.pattern.replace("'", "''")
    least = f"WHERE length(v[i]) >= {rule.least}"
    return f"""SELECT doc_id, '{rule.kind}' kind, {order} ord, s, s + length(m[i]) e FROM (
      SELECT doc_id, m, v, i, (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT s FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') m, regexp_extract_all(text, '{pattern}', {rule.group}) v, string_split_regex(text, '{pattern}') p,
               unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) i FROM t)) {least}"""


_KINDS = [(r, i) for i, r in enumerate(r for v in sorted(secrets.RULES) for r in secrets.RULES[v])]
OP4_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sp AS ({" UNION ALL ".join(_spans_sql(r, i) for r, i in _KINDS)}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {len(secrets.RULES[1])}) base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT n_assign, coalesce(n_access, 0)::BIGINT n_access, coalesce(n_hex, 0)::BIGINT n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM t LEFT JOIN a USING (doc_id)"""


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: one day of 2024 for each page. List history: for each host a domain or host
    entry and for each host's first path part a path entry, with dates drawn from their digest."""
    pages = read_table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    names = pages.select(host.alias("host"), F.when(path.startswith("/"), F.try_element_at(F.split(path, "/"), F.lit(2))).alias("part")).distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    entries = names.select(F.explode(F.array(
        F.concat(F.lit("host:"), "host"), F.when(domain != "", F.concat(F.lit("domain:"), domain)),
        F.concat(F.lit("path:"), "host", F.lit("/"), "part"))).alias("entry")).where(F.col("entry").isNotNull()).distinct()
    digest = F.md5("entry")
    number = lambda i, m: (F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % m)
    drawn = (entries.where(number(0, 3) == 0)
             .withColumn("category", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), number(1, 3) + 1))
             .withColumn("a", number(2, 300)).withColumn("b", F.col("a") + 1 + number(3, 90)).withColumn("c", F.col("b") + 1 + number(4, 60)))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    events = drawn.select("entry", "category", F.explode(F.array(
        F.struct(day("a").alias("day"), F.lit("add").alias("action")), F.struct(day("b").alias("day"), F.lit("remove").alias("action")),
        F.struct(day("c").alias("day"), F.lit("add").alias("action")))).alias("e")).select("entry", "category", "e.day", "e.action")
    return url_filter.evaluate(captures, url_filter.intervals(events)).withColumn("fetched", F.col("fetched").cast("string"))


OP5_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT fetched,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path FROM pages),
n AS (SELECT DISTINCT host, CASE WHEN path LIKE '/%' THEN string_split(path, '/')[2] END part, regexp_extract(host, '([^.]+\.[^.]+)$', 1) domain FROM p),
e AS (SELECT DISTINCT entry, md5(entry) m FROM (SELECT unnest(['host:' || host, CASE WHEN domain <> '' THEN 'domain:' || domain END, 'path:' || host || '/' || part]) entry FROM n)
      WHERE entry IS NOT NULL),
x AS (SELECT entry, [('0x' || substr(m, 4 * i + 1, 4))::INT FOR i IN [0, 1, 2, 3, 4]] v FROM e),
dr AS (SELECT entry, ['adult', 'malware', 'spam'][v[2] % 3 + 1] category, v[3] % 300 a, v[3] % 300 + 1 + v[4] % 90 b, v[5] % 60 g FROM x WHERE v[1] % 3 = 0),
iv AS (SELECT entry, category, DATE '2024-01-01' + a::INT f, DATE '2024-01-01' + b::INT u FROM dr
       UNION ALL SELECT entry, category, DATE '2024-01-01' + (b + 1 + g)::INT, NULL FROM dr),
k AS (SELECT page_id, fetched, unnest(list_concat(['host:' || host],
        ['domain:' || array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)],
        ['path:' || host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda q: q <> '')[1:i], '/')
         FOR i IN range(1, len(list_filter(string_split(path, '/'), lambda q: q <> '')) + 1)])) key FROM p WHERE host <> ''),
h AS (SELECT DISTINCT page_id, key, category FROM k JOIN iv ON key = entry AND fetched >= f AND (u IS NULL OR fetched < u)),
v AS (SELECT page_id, count(DISTINCT key) n, array_to_string(list_sort(list(DISTINCT category)), ',') cats, arg_min(key, (-length(key), key)) entry FROM h GROUP BY 1)
SELECT p.page_id, p.host, p.fetched::VARCHAR fetched, coalesce(v.n, 0)::BIGINT n_matches, coalesce(cats, '') categories, entry, v.n IS NOT NULL blocked FROM p LEFT JOIN v USING (page_id)"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).drop("h")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t FROM documents),
g AS (SELECT t, min(doc_id) keep_id, count(*)::BIGINT group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256 FROM n JOIN g USING (t)"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(first, page_id) = page_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN first <> page_id THEN first END refers_to, true AS verified FROM p LEFT JOIN f USING (payload_digest)"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.source", "n_lines", "n_dropped", F.sha2("clean", 256).alias("clean_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, text, md5(text) page, string_split(text, chr(10)) lines FROM documents),
l AS (SELECT doc_id, source, page, unnest(lines) line, unnest(range(len(lines))) i FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) kl FROM l),
h AS (SELECT source, count(DISTINCT page) n_host FROM d GROUP BY 1),
b AS (SELECT source, kl, count(DISTINCT page) n FROM k WHERE kl <> '' GROUP BY 1, 2),
drops AS (SELECT b.source, kl FROM b JOIN h ON b.source = h.source WHERE n >= 3 AND n > CASE WHEN len(string_split(kl, ' ')) >= 3 THEN 0.005 ELSE 0.05 END * n_host),
o AS (SELECT doc_id, count(*) n_dropped FROM k WHERE EXISTS (SELECT 1 FROM drops x WHERE x.source = k.source AND x.kl = k.kl) GROUP BY 1),
c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) clean FROM k
      WHERE NOT EXISTS (SELECT 1 FROM drops x WHERE x.source = k.source AND x.kl = k.kl) GROUP BY 1)
SELECT d.doc_id, d.source, len(lines)::BIGINT n_lines, coalesce(n_dropped, 0)::BIGINT n_dropped, sha256(coalesce(clean, '')) clean_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)"""


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth checksum the words from ``a`` on repeat the ``p``
    words that begin there (words joined by one space)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), "")
    g = F.floor(h / 10).cast("long")
    planted = docs.where((h % 10 == 0) & (F.size(words) > 0)).withColumn("w", words).withColumn("a", (g % F.size("w")).cast("int"))
    period = F.lit(1) + F.floor((F.size("w") - F.col("a")) / (F.lit(3) + g % 8)).cast("int")
    moved = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.col("w")[
        F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))])
    planted = planted.withColumn("p", period).withColumn("text", F.array_join(moved, " ")).drop("w", "a", "p")
    return docs.where(~F.coalesce((h % 10 == 0) & (F.size(words) > 0), F.lit(False))).unionByName(planted)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(with_planted_repeats(docs))
    longer = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  the sign of the exponents' difference
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(longer(r, b) > 0, r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP11_SQL = r"""
WITH crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
               lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)::UBIGINT[]),
                 lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
d AS (SELECT documents.doc_id, xor(c, 4294967295::UBIGINT)::BIGINT h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents LEFT JOIN crc USING (doc_id)),
o AS (SELECT doc_id, w, len(w) n, h % 10 = 0 AND len(w) > 0 moved, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END a, h // 10 g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) p FROM o),
t AS (SELECT doc_id, i, w[CASE WHEN moved AND i >= a THEN a + (i - a) % p ELSE i END + 1] word, n FROM (SELECT *, unnest(range(n)) i FROM p)),
eq AS (SELECT x.doc_id, x.i, y.i - x.i q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
often AS (SELECT doc_id, q FROM eq GROUP BY 1, 2 HAVING count(*) >= greatest(24 - q, 2 * q)),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) k FROM eq SEMI JOIN often USING (doc_id, q)),
st AS (SELECT doc_id, q, min(i) s, count(*) + q l FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, l, min(q) q FROM st GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) txt FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
agg AS (SELECT doc_id, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) listed FROM runs GROUP BY 1),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.doc_id = r.doc_id AND (x.l * r.q > r.l * x.q OR (x.l * r.q = r.l * x.q AND (x.s < r.s OR (x.s = r.s AND x.q < r.q))))))
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT n_runs, s::BIGINT AS start, l::BIGINT length, q::BIGINT period, (1000 * l // q)::BIGINT exponent_milli,
       sha256(coalesce(listed, '')) runs_sha256, sha256(coalesce(txt, '')) collapsed_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')) term FROM benchmark),
g AS (SELECT count(*) n_docs, sum(len(w)) n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, term, n, count(*) tf FROM (SELECT doc_id, len(w) n, unnest(w) term FROM d) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM tf, g WHERE term IN (SELECT term FROM b) GROUP BY term),
s AS (SELECT item_id, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) score
      FROM (SELECT item_id, term, count(*) reps FROM b GROUP BY ALL) JOIN tf USING (term) JOIN wt USING (term), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT score FROM r WHERE rank <= 10"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 2], ' ') g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
c AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id r FROM w UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id WHERE reach.r < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(w.doc_id, m.r) component_id, w.doc_id <= m.r kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) r FROM reach GROUP BY 1) m USING (doc_id)"""


QUERIES = {
    "op1_decontamination": (op1_decontamination, OP1_SQL),
    "op2_tool_calls": (op2_tool_calls, OP2_SQL),
    "op3_toxicity": (op3_toxicity, None),
    "op4_secret_ledger": (op4_secret_ledger, OP4_SQL),
    "op5_url_lists": (op5_url_lists, OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_simhash": (op7_simhash, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_warc": (op9_warc, OP9_SQL),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_periodic_runs": (op11_periodic_runs, OP11_SQL),
    "op12_ranked_search": (op12_ranked_search, OP12_SQL),
    "op13_minhash": (op13_minhash, OP13_SQL),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
