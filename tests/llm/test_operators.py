"""Each operator against brute force on small tables: nulls, empty and long texts, repeated rows,
empty tables and extra columns whose names clash with the operators' own."""

import base64
import datetime
import gzip
import hashlib
import json
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from raceboard.llm import chat_format, decontamination, exact_dedup, line_dedup, packing, queries, secrets, simhash, toxicity, url_filter, warc
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, h string, term string, fp double, `row` int, host string, score string"


def rows_of(pairs, source="src"):
    return [(d, t, "en", source, None if t is None else len(t), 1, "h", "t", 0.5, 2, "host", "no") for d, t in pairs]


def table(spark, pairs):
    return spark.createDataFrame(rows_of(pairs), DOCS).repartition(3)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


PASSAGE = " ".join(f"Rare{i} and the" for i in range(12))
TEXTS = [(1, prose(1, 80)), (2, prose(2, 60) + " " + PASSAGE + " " + prose(3, 20)), (3, None), (4, ""), (5, "  \n\t "), (6, PASSAGE.upper()),
         (7, prose(7, 30_000)), (8, prose(1, 80)), (8, prose(1, 80)), (8, "other text under the same id"), (None, PASSAGE), (None, None), (0, PASSAGE),
         (9, "short item here"), (10, "x short, item HERE y short item here"), (11, PASSAGE + " " + PASSAGE), (12, "Élan É rare0 AND")]
ITEMS = [(1, PASSAGE), (2, "short item here"), (2, "short item here"), (3, None), (4, "..."), (None, "élan É"), (5, "never seen words at all anywhere in these texts so no")]


def item_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "item_id long, text string, tid int, term string")


def test_decontamination(spark):
    got = decontamination.decontaminate(table(spark, TEXTS), item_table(spark, ITEMS)).collect()
    want = brute.contaminated(TEXTS, ITEMS)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_hit > 0 for r in got) >= 7


def test_decontamination_of_empty_tables(spark):
    assert decontamination.decontaminate(table(spark, []), item_table(spark, ITEMS)).count() == 0
    rows = decontamination.decontaminate(table(spark, TEXTS), item_table(spark, [])).collect()
    assert len(rows) == len(TEXTS) and not any(r.n_hit for r in rows)


def test_proximity(spark):
    docs = [(1, "alpha one two beta"), (2, "beta x x x x x alpha"), (3, "beta alpha"), (4, "alpha alpha beta")]
    items = decontamination.item_words(item_table(spark, [(1, "alpha beta")]))
    vocab = decontamination.vocabulary(items)
    index = decontamination.build_index(table(spark, docs), vocab)
    near = decontamination.proximity_matches(index, vocab, items, slop=3)
    assert {r.doc_id for r in near.collect()} == {1, 3, 4}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "add", '{"y": 2, "x": 1}', [], 9), (1, "b", 1, "add", '{"x": "1"}', ["a", "a", None], 9), (1, "c", 2, "none", "{}", ["zz"], 9),
        (1, None, 3, "add", None, None, 9), (1, "a2", 4, "add", "[1]", [], 9), (1, "d", 5, "add", '{"x":1,"y":2,"z":3}', [], 9), (1, "d", 6, "add", "{bad", [], 9),
        (2, "p", 0, "add", '{"x":1,"y":1}', ["q"], 9), (2, "q", 1, "add", '{"x":1,"y":1}', [], 9), (2, "r", 2, "add", '{"x":1,"y":1}', ["p"], 9),
        (3, "m", 0, "add", '{"x":1,"y":1}', ["n"], 9), (3, "n", 1, "add", '{"x":1,"y":1}', ["m"], 9), (3, "o", 2, "add", '{"x":1,"y":1}', ["o"], 9)],
        "conv_id long, call_id string, seq long, tool string, arguments string, depends_on array<string>, level int")
    results = spark.createDataFrame([(1, "a", 9, "late", 1), (1, "a", 8, 'say "3"\n', 1), (1, "x", 1, "lost", 1), (1, None, 1, "null", 1), (2, "q", 3, None, 1)],
                                    "conv_id long, call_id string, seq long, content string, status int")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", True), ("add", "y", "number", True), (None, "x", "string", True)],
                                    "tool string, argument string, type string, required boolean")
    got = {(r.conv_id, r.call_id, r.seq): r for r in chat_format.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == calls.count() + 3 and (got[1, "a", 9].status, got[1, "a", 9].record) == ("extra_result", '{"id":"a","result":"late"}')
    a = got[1, "a", 0]
    assert (a.status, a.violations, a.level) == ("linked", [], 0)
    assert a.record == '{"arguments":{"x":1,"y":2},"depends_on":[],"id":"a","name":"add","result":"say \\"3\\"\\n"}'
    assert got[1, "b", 1].violations == ["missing:y", "type:x"] and got[1, "b", 1].status == "unanswered"
    assert json.loads(got[1, "b", 1].record)["depends_on"] == ["a"]
    assert got[1, "c", 2].violations == ["unknown_tool", "unknown_dependency:zz"]
    assert got[1, "a2", 4].violations == ["not_an_object"] == got[1, None, 3].violations
    assert {got[1, "d", n].status for n in (5, 6)} == {"duplicate"} and got[1, "d", 5].violations == ["unknown:z"]
    assert [got[2, c, n].level for c, n in (("q", 1), ("p", 0), ("r", 2))] == [0, 1, 2]
    assert got[2, "q", 1].status == "linked" and json.loads(got[2, "q", 1].record)["result"] is None
    assert all(got[3, c, n].level is None and "cycle" in got[3, c, n].violations for c, n in (("m", 0), ("n", 1), ("o", 2)))
    assert {k[1] for k, r in got.items() if r.status == "orphan_result"} == {"x", None}
    assert chat_format.link_tool_calls(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_tool_calls_of_odd_turns(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "q1"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 2, "tool", None), (1, 3, "user", None),
            (1, 5, "user", "é\n\"q\""), (1, 6, None, "odd"), (7, None, "user", "x"), (7, None, "user", "y"), (7, None, "assistant", "z"), (None, 5, "user", "n"), (None, 6, "assistant", "m"),
            (8, 1, "user", "twice"), (8, 1, "user", "twice"), (8, 2, "assistant", "ok"), (9, 4, "assistant", "lost"), (9, 4, "assistant", "lost"), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, call_id string").repartition(3)
    linked = chat_format.link_tool_calls(*chat_format.calls_of_turns(turns)).withColumn("violations", F.array_join("violations", ","))
    duck = duckdb.connect()
    conversations = turns.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841  DuckDB reads it by name
    found = duck.execute(queries.OP2_SQL)
    got = [tuple(r) for r in linked.select(*[d[0] for d in found.description]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, found.fetchall()))
    assert len(got) == len(rows) - 3  # the linked results are in their calls' rows
    assert [r[6] for r in got if r[4] == "linked" and r[1] == "1:1"][0].endswith('"result":null}')
    assert sorted(r[4] for r in got if r[1] == "1:1") == ["extra_result"] * 3 + ["linked"]


TOXIC = ["idiot", "moron", "scumbag"]


def toxic_corpus():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        w = prose(100 + i, 40).translate(str.maketrans("0123456789", "bcdfghjklm")).split() + ["the", "idea", "of", "a", "patriot", "is", "more", "on", "ios"]
        bad = i % 3 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        texts.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    noisy = [(1000, "you are an 1diot"), (1001, "what a m0r0n"), (1002, "i d i o t"), (1003, "such an idiooooot."), (1004, "sc.um.b.ag"), (1005, "an idea of a patriot"),
             (1006, None), (1007, ""), (None, "an idiot"), (1008, prose(9, 30_000)), (1008, prose(9, 30_000))]
    label_rows = spark.createDataFrame([*labels, (None, 1, 1), (1005, None, None)], "doc_id long, quality int, toxic int")
    got = {}
    for r in toxicity.toxicity(table(spark, texts + noisy), label_rows).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(texts) + len(noisy)
    for i, _, mark in labels:
        assert got[i][0].predicted == mark
    assert [got[i][0].predicted for i in range(1000, 1008)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert got[None][0].predicted == 1 and got[None][0].held_out is False
    assert got[1008][0] == got[1008][1] and got[1008][0].predicted == 0 and all(0 <= r[0].score <= 1 for r in got.values())
    assert got[1006][0].score == got[1007][0].score


def test_decode_equals_all_paths():
    """Viterbi against every path of the lattice, priced on its own."""
    from itertools import product
    rng = random.Random(5)
    counts = rng.choices(range(1, 60), k=toxicity.SIZE ** 3)
    model = -np.log(np.array(counts, np.float64).reshape((toxicity.SIZE,) * 3) / 60).astype(np.float32)

    def price(readings):
        a = b = 0
        total = 0.0
        for letters, cost in readings:
            total += cost
            for letter in letters:
                z = toxicity._AT.get(letter, 0)
                if b or z:  # a boundary after a boundary is the same one
                    total += float(model[a, b, z])
                    a, b = b, z
        return total

    tried = 0
    for stretch in ["1d1ot", "m0r0n", "s.t.u", "$tup1d", "(1d)", "aaab", "h4.te", "a-b", "@ss!", "l33t", "00ps", "x1", *("".join(rng.choices("ab1043$.-!", k=6)) for _ in range(40))]:
        for edges in (True, False):
            steps = [*toxicity.lattice(stretch, edges), [(" ", 0.0)]]
            paths = list(product(*steps))
            least = min(map(price, paths))
            got = toxicity.decode(stretch, model, edges)
            best = {"".join(x for x, _ in p).strip() for p in paths if price(p) <= least + 1e-4}
            assert got in best, (stretch, got, best)
            tried += len(paths)
    assert tried > 3000


def test_score_equals_a_plain_noisy_or(spark):
    """The scorer against one pass over all words of the restored text, whatever its memory holds."""
    lexicon = {"idiot": 0.9, "idio-": 0.5, "moron": 0.8, "stup-": 0.6}
    model = toxicity.language_model(toxicity.trigram_counts(table(spark, [(i, prose(i, 200)) for i in range(5)] + [(9, "idiot moron stupid idiots " * 30)])))
    texts = [None, "", "you 1diot", "idiot idiot moron", "s t u p i d", "stupidly idiotic m0ron", prose(4, 300), "x" * 500 + " moron", "clean words only"]
    restorer = toxicity.Restorer(model)
    want = []
    for t in texts:
        found = {w for chunk in set((t or "").lower().split()) for w in restorer.chunk_words(chunk)}
        found |= {w for m in toxicity.SPACED.finditer((t or "").lower()) for w in toxicity.WORD.findall(restorer.spaced(m[0]))}
        left = 0.99
        for w in sorted(found):
            left *= 1 - max((lexicon.get(f, 0.0) for f in toxicity.features(w)), default=0.0)
        want.append(1 - left)
    score = toxicity.scorer(spark, model, lexicon, 0.01)
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(score("text").alias("s")).collect()]
    assert got == pytest.approx(want, abs=1e-12) and max(got) > 0.9 and min(got) == pytest.approx(0.01)
    memory = toxicity.Memory(room=2000)
    for i in range(500):
        memory.keep(f"chunk{i}", ("word",))
    assert 0 < len(memory) < 20 and memory.get("x" * 70) is None and memory.keep("x" * 70, ("a",)) == ("a",) and "x" * 70 not in memory


def test_toxicity_decodes_every_stretch(spark):
    """Long runs, stretches joined by dots or parted by = / \\ :, one separator, edge signs; not URLs, digests, numbers."""
    texts, labels = toxic_corpus()
    noisy = ["m" + "0" * 40 + "r0n", "an id" + "i" * 60 + "ot", "you...are...such...a...1d10t...we...know", "you:1d10t", "1d10t/m0r0n", r"a\m0r0n", "x=1d10t", "id.iot", "sc-umbag", "!d10t", "+++m0r0n"]
    plain = ["http://a.bc/1d10t", "www.ab.cd/m0r0n", "0123456789abcdef01234567", "2024-01-05", "$5.00", "(12)", "the=idea", "a:patriot", "w" * 5000]
    rows = [(1000 + i, t) for i, t in enumerate(noisy)] + [(2000 + i, t) for i, t in enumerate(plain)]
    found = toxicity.toxicity(table(spark, texts + rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in found.collect()}
    assert [t for i, t in rows if got[i] != (i < 2000)] == []


def test_toxicity_learns_words_that_few_toxic_texts_share(spark):
    """A language with under 2 % of the toxic training texts has features of its own."""
    rare = [(i, f"{prose(i, 8).translate(str.maketrans('0123456789', 'bcdfghjklm'))} {'salaud' if i % 60 == 0 else 'moron'}") for i in range(1800)]
    clean = [(5000 + i, prose(5000 + i, 8).translate(str.maketrans("0123456789", "bcdfghjklm"))) for i in range(1800)]
    labels = spark.createDataFrame([(i, 0, 1) for i, _ in rare] + [(i, 0, 0) for i, _ in clean], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(table(spark, [*rare, *clean, (9000, "quel salaud"), (9001, "what a moron"), (9002, "quel salon")]), labels)
    got = {r.doc_id: r.predicted for r in found.collect()}
    assert (got[9000], got[9001], got[9002]) == (1, 1, 0)
    assert all(got[i] for i, _ in rare) and sum(got[i] for i, _ in clean) < 18


def test_toxicity_ignores_labels_of_held_out_rows(spark):
    texts, labels = toxic_corpus()
    docs = table(spark, texts)
    held = {r.doc_id for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("o")).where("o").collect()}
    assert 60 < len(held) < 140
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - m if i in held else m) for i, q, m in labels]
    score = lambda rows: {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(rows, schema)).collect()}
    assert score(labels) == score(flipped)
    assert set(score([])) == set(range(300)) and toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, schema)).count() == 0


SECRET_TEXTS = [(1, "password=abcdef"), (2, "PassWord : 'short' token=\"0123456789abcdef0123456789abcdef\""), (3, None), (4, ""), (5, "é api_key= ünö AKIA" + "A1" * 9),
                (6, "secret=token: abcdefgh"), (7, "AKIAAKIA" + "B" * 16 + " x deadbeef" * 3), (8, "token=a token=abcdefg token=secret=abc"), (8, "token=a token=abcdefg token=secret=abc"),
                (None, "🙂 passwd:hunter22"), (9, prose(4, 30_000) + " apikey='abcdef12'"), (10, "0123456789abcdef01234567" * 3)]


def test_secret_ledger(spark, tmp_path):
    docs = table(spark, SECRET_TEXTS)
    path = str(tmp_path / "ledger")
    ledger = secrets.update_ledger(docs, path, (1,))
    found = secrets.findings(secrets.versions(docs), ledger).select("doc_id", secrets.joined(F.col("spans")).alias("spans")).collect()
    want = [(d, brute.secrets(t)) for d, t in SECRET_TEXTS]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    n = ledger.count()
    assert n == len({t or "" for _, t in SECRET_TEXTS})
    assert secrets.scan(docs, ledger, (1,)).count() == 0  # every pair is known
    more = docs.unionByName(table(spark, [(50, "new secret=abcdefgh")]))
    assert secrets.scan(more, ledger, (1,)).count() == 1
    assert secrets.scan(docs, ledger, (1, 2)).count() == n  # a new rule version looks at each blob once
    assert secrets.update_ledger(more, path, (1, 2)).count() == n + 1 + n + 1
    assert secrets.scan(table(spark, [])).count() == 0


def test_secrets_of_a_text_with_very_many(spark):
    hits = "".join(f"{i:024x} token=abcde{i % 10}{'x' * (i % 2)} " for i in range(32_000))
    mixed = [(1, hits), (2, " ".join("token=" + "a" * (i % 12) for i in range(1000))), (3, " ".join(["ab" * 12] * 256)), (4, " ".join(["ab" * 12] * 257))]
    began = time.monotonic()
    found = secrets.findings(secrets.versions(table(spark, mixed)), secrets.scan(table(spark, mixed))).select("doc_id", secrets.joined(F.col("spans"))).collect()
    assert time.monotonic() - began < 60
    assert sorted(map(tuple, found)) == [(d, brute.secrets(t)) for d, t in mixed]


def test_url_with_very_many_parts(spark):
    day = datetime.date(2024, 1, 5)
    events = spark.createDataFrame([("path:x.com/a/a/a", "spam", day, "add"), ("path:x.com/a", "spam", day, "add"), ("domain:y.com", "adult", day, "add"),
                                    ("domain:com", "adult", day, "add"), ("domain:localhost", "adult", day, "add")], "entry string, category string, day date, action string")
    caps = spark.createDataFrame([
        (1, "http://x.com" + "/a" * 64_000, day), (2, "http://" + "z." * 20_000 + "y.com/", day), (3, "http://x.com/a/b", datetime.date(9999, 12, 31)),
        (4, "http://localhost/", day), (5, "http://x.com/a", datetime.date(1, 1, 1)), (6, "http://other.com/", day), (7, "http://x.com/b/a", day)], "page_id long, url string, fetched date")
    began = time.monotonic()
    got = {r.page_id: (r.n_matches, r.entry) for r in url_filter.evaluate(caps, url_filter.intervals(events)).collect()}
    assert time.monotonic() - began < 60
    assert got == {1: (2, "path:x.com/a/a/a"), 2: (1, "domain:y.com"), 3: (1, "path:x.com/a"), 4: (1, "domain:localhost"), 5: (0, None), 6: (0, None), 7: (0, None)}


def test_url_lists(spark):
    day = lambda m, d=1: datetime.date(2024, m, d)
    events = spark.createDataFrame([
        ("domain:bad.com", "spam", day(2), "add"), ("domain:bad.com", "spam", day(2), "add"), ("domain:bad.com", "spam", day(4), "remove"), ("domain:bad.com", "spam", day(6), "add"),
        ("host:www.ok.com", "adult", day(3), "add"), ("host:www.ok.com", "adult", day(3), "remove"), ("path:x.com/a/b", "malware", day(1), "add"),
        ("path:x.com/a/b", "malware", day(5), "add"), (None, "spam", day(1), "add"), ("host:x.com", "spam", None, "add"), ("host:x.com", "spam", day(1), "what")],
        "entry string, category string, day date, action string")
    caps = spark.createDataFrame([
        (1, "http://a.b.bad.com/p", day(1, 31), 0), (2, "http://a.b.bad.com/p", day(2), 0), (3, "https://u@BAD.com:8080/?q", day(3, 31), 0), (4, "http://bad.com", day(4), 0),
        (5, "http://bad.com#x", day(12), 0), (6, "http://notbad.com", day(12), 0), (7, "http://www.ok.com/", day(3), 0), (8, "http://x.com/a/b/c?d", day(2), 0),
        (9, "http://x.com/a/bc", day(2), 0), (10, None, day(2), 0), (11, "http://bad.com", None, 0), (12, "no url", day(12), 0), (5, "http://bad.com#x", day(12), 0)],
        "page_id long, url string, fetched date, month int")
    got = url_filter.evaluate(caps, url_filter.intervals(events)).collect()
    assert len(got) == 13
    assert sorted({r.page_id for r in got if r.blocked}) == [2, 3, 5, 8]
    one = {r.page_id: r for r in got}
    assert (one[8].entry, one[8].categories, one[8].n_matches, one[8].host) == ("path:x.com/a/b", "malware", 1, "x.com")
    assert url_filter.evaluate(caps, url_filter.intervals(events.limit(0))).where("blocked").count() == 0
    assert url_filter.evaluate(caps.limit(0), url_filter.intervals(events)).count() == 0


ODD = "naïve ﬁne Ünïcödé ΣΑΣ İstanbul é 日本語 a b x y don't I'M 12³ ½ _under_ ... <|endoftext|> a\x1cb \x00z 🙂🙂 ª"


def test_tokenizer_equals_the_file(spark):
    import public_tokenizers
    bpe = packing.WordBpe(public_tokenizers.path(packing.TOKENIZER))
    marks = ["hello <|endoftext|>", "<|startoftext|>x<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "a<|endoftext|>b \n <|startoftext|> c", "<|end of text|> <|endoftext"]
    rng, signs = random.Random(8), " \n'<|>.,abcdeIstßéÉłŚ日本🙂\u0301\u00ad½²ªx1209"
    drawn = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) + rng.choice(["", "", "<|endoftext|>"]) for _ in range(6000)]
    for text in [ODD, *ODD.split(" "), "", " ", prose(3, 500), "The THE the's 'S can't", "y" * 300 + " " + "y" * 300, *marks, *drawn]:
        assert list(memoryview(bpe.ids(text)).cast("I")) == brute.ids(text)[:-1], text
    assert 49407 in brute.ids(marks[0]) and 49406 in brute.ids(marks[1])


def test_packing(spark):
    docs = TEXTS + [(100 + i, prose(i, 5 + 37 * i % 900)) for i in range(60)] + [(99, ODD)]
    frame = table(spark, docs)
    got = packing.pack_documents(frame, block_windows=4).collect()
    want = sorted((str(d), brute.ids(t)) for d, t in docs)
    by_row, windows = {}, {}
    for r in got:
        by_row.setdefault((str(r.doc_id), r.h), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    rebuilt = []
    for (d, _), parts in by_row.items():
        parts.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in parts)
        ids = next(x for y, x in want if y == d and len(x) == parts[0].doc_tokens and brute.crc(x[:parts[0].length]) == parts[0].ids_crc32)
        at = 0
        for r in parts[::copies]:
            assert r.start == at and r.ids_crc32 == brute.crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids) == parts[0].doc_tokens
        rebuilt += [(d, ids)] * copies
    assert sorted(rebuilt) == want
    total = sum(len(x) for _, x in want)
    for parts in windows.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(windows) <= total / 4096 * 1.15 + 2
    cut = packing.pieces(frame, keep_ids=True)
    whole = packing.sequences(packing.pack(packing.stored(cut, "cut")), cut).collect()
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 4096) for r in whole) and sum(r.n_tokens for r in whole) == total
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packing_spreads_repeated_rows(spark):
    """Copies of one row (no id, one text) go to many blocks, full windows to none."""
    rows = table(spark, [(None, "alpha beta " * 400)] * 200 + [(7, "gamma " * 9000)])
    got = packing.pack_documents(rows, window=1024, piece=256, block_windows=8).collect()
    per_block = {}
    for r in got:
        if r["length"] < 1024:
            per_block[r["sequence_id"] >> 32] = per_block.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert len(per_block) > 8 and max(per_block.values()) < sum(per_block.values()) / 4
    whole = [r for r in got if r["length"] == 1024]
    assert whole and len({r["sequence_id"] for r in whole}) == len(whole) and all(r["offset"] == 0 for r in whole)
    assert not {r["sequence_id"] for r in whole} & {r["sequence_id"] for r in got if r["length"] < 1024}
    sizes = {}
    for r in got:
        sizes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sizes.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert sum(r["length"] for r in got) == sum({(r["doc_id"], r["h"]): r["doc_tokens"] * (200 if r["doc_id"] is None else 1) for r in got}.values())


def test_differencing():
    rng = random.Random(1)
    for n, k in ((0, 1), (1, 1), (7, 3), (500, 20), (3000, 7)):
        sizes = [rng.randrange(1, 1024) for _ in range(n)]
        windows = packing.difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) <= k
        sums = [sum(sizes[i] for i in w) for w in windows]
        if n > 10 * k:
            assert max(sums) - min(sums) < 20
    packed = packing.pack_sizes([60] * 5 + [1] * 100, 100, bundle=8)  # five halves do not fit in four windows
    assert len(packed) == 5 and sorted(i for w in packed for i in w) == list(range(105))


@pytest.mark.parametrize("dense", [64, 2])
def test_simhash(spark, dense):
    base = prose(50, 150)
    near = []
    for i in range(60):
        w = base.split()
        w[i % 140] = f"edit{i}"
        near.append((200 + i, " ".join(w)))
    docs = TEXTS + near + [(300, base), (301, base), (302, base.upper()), (303, base.replace(" ", " \n"))]
    got = simhash.near_duplicates(table(spark, docs), dense=dense).collect()
    fps = [(d, brute.fingerprint(t)) for d, t in docs]
    want = sorted(((d, f, c) for (d, f), c in zip(fps, brute.components(fps))), key=str)
    assert sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in got), key=str) == want
    if dense == 64:
        assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_links_equal_all_pairs(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    for dense in (64, 3):
        assert {tuple(r) for r in simhash.links(frame, dense=dense).collect()} == want
    assert [simhash.blocks_for(n, 3) for n in (1, 10 ** 5, 10 ** 8, 10 ** 11)] == sorted(simhash.blocks_for(n, 3) for n in (1, 10 ** 5, 10 ** 8, 10 ** 11))


def exact_want(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(brute.normal(t), []).append(d)
    out = []
    for d, t in docs:
        g = groups[brute.normal(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, brute.sha(brute.normal(t))))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    long = prose(60, 4000)
    docs = TEXTS + [(20, "a b"), (21, "a\t\n b"), (22, "a  b"), (23, " a b"), (24, "a b"), (30, long), (31, long.replace(" ", "  ")), (32, long + "x"), (None, "only null"),
                    (40, "z" * 9000), (41, "z" * 9000), (42, "z" * 9001)]
    hash_of = (lambda c: (F.char_length(c) % 3).cast("long")) if weak else F.xxhash64  # many contents under one identifier
    got = exact_dedup.exact_groups(table(spark, docs), hash_of=hash_of).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == exact_want(docs)
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh") for _ in range(200_000)) * 90  # over 16 MB
    pages = [(5, "http://a/é\r\nX: y", "p" * 100), (3, "http://b", "p" * 100), (3, "http://b", "p" * 100), (9, None, "p" * 99), (8, "u", "p" * 99), (1, "u", None), (2, "u", ""),
             (None, "u", "p" * 100), (None, "u", "q" * 200), (7, "big", big), (6, "mark", "WARC/1.1\r\n\r\n" + "é" * 80), (2 ** 60 + 1, "u", "r" * 120), (2 ** 60 + 3, "u", "r" * 120)]
    frame = spark.createDataFrame([(*p, "x", b"m") for p in pages], "page_id long, url string, html string, digest string, member binary").repartition(2)
    path = str(tmp_path / "warc")
    warc.write_archives(frame, path, records_per_file=3)
    got = warc.read_archives(spark, path, keep_payload=True).collect()
    first = {}
    for p, _, t in pages:
        if p is not None and len((t or "").encode()) >= 100:
            first[t] = min(p, first.get(t, p))
    want = []
    for p, _, t in pages:
        b = (t or "").encode()
        ref = first.get(t)
        revisit = ref is not None and p != ref
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", ref if revisit else None, True))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in got), key=str) == sorted(want, key=str)
    assert next(bytes(r.payload) for r in got if r.page_id == 7) == big.encode()
    import pathlib
    names = list(pathlib.Path(path).rglob("part*"))
    assert len(names) >= len(pages) / 3
    data = b"".join(gzip.decompress(p.read_bytes()) for p in names)  # any gzip reader takes them
    assert data.count(b"WARC-Type: ") == len(pages)
    empty = str(tmp_path / "none")
    warc.write_archives(frame.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_finds_damage():
    rec = warc.record(1, "u", b"x" * 300, None, hashlib.sha256(b"x" * 300).hexdigest())
    assert [r[-1] for r in warc.read_records(warc.member(rec) * 2)] == [True, True]
    assert [r[-1] for r in warc.read_records(warc.member(rec.replace(b"xxx", b"xyx", 1)))] == [False]
    for bad in (rec[:-3], rec.replace(b"Content-Length: 3", b"Content-Length: 9", 2), b"nothing\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.read_records(warc.member(bad)))
    with pytest.raises(ValueError):
        list(warc.read_records(warc.member(rec)[:-20]))


def foreign_record(kind, name, block, more=()):
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), *more, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_of_other_writers(spark, tmp_path):
    body = b"<p>\xe9 body</p>" * 30
    http = b"HTTP/1.1 200 OK\r\nX-Name: \xe9\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    typed = ("Content-Type", "application/http; msgtype=response")
    records = [foreign_record("warcinfo", "<urn:uuid:1>", b"software: x\r\n", [("Content-Type", "application/warc-fields")]),
               foreign_record("response", "<urn:uuid:2>", http, [typed, ("WARC-Target-URI", "http://a"), ("WARC-Payload-Digest", f"sha1:{sha1}")]),
               foreign_record("response", "<urn:uuid:3>", http, [typed, ("WARC-Payload-Digest", f"sha1:{sha1[::-1]}")]),
               foreign_record("response", "<urn:uuid:4>", http, [typed, ("WARC-Payload-Digest", "md5:x")]),
               foreign_record("resource", "<urn:uuid:5>", body, [("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}")]),
               foreign_record("response", "<urn:page:7>", b"HTTP/1.1 200 OK", [typed])]
    folder = tmp_path / "with space %20"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path), keep_payload=True).collect()}
    assert [got[f"<urn:uuid:{i}>"].verified for i in range(1, 6)] == [None, True, False, None, True]
    assert all(bytes(got[f"<urn:uuid:{i}>"].payload) == body and got[f"<urn:uuid:{i}>"].payload_bytes == len(body) for i in range(2, 6))
    assert got["<urn:uuid:1>"].payload_digest == hashlib.sha256(b"software: x\r\n").hexdigest() and got["<urn:uuid:2>"].payload_digest == sha1
    assert {i: r.page_id for i, r in got.items() if r.page_id is not None} == {"<urn:page:7>": 7} and got["<urn:page:7>"].payload_bytes == 0
    with pytest.raises(ValueError, match="goes on"):
        list(warc.read_records(gzip.compress(records[0] + records[1])))


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(4)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefghijklmnop", k=20_000))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), bytes_per_file=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part*")]
    assert max(sizes) <= 100_000 and len(sizes) > 5
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(60))


def test_warc_reader_holds_one_step_of_a_large_file(tmp_path):
    rng = random.Random(5)
    noise = rng.randbytes(1 << 20)
    path = tmp_path / "large.warc.gz"
    with open(path, "wb") as out:
        for i in range(300):  # one record a member, 300 MB that do not compress, then one of 100 MB
            out.write(warc.member(foreign_record("resource", f"<urn:uuid:{i}>", noise[i:] + noise[:i])))
        out.write(warc.member(foreign_record("resource", "<urn:uuid:300>", noise * 100)))
    assert path.stat().st_size > 300 << 20
    tracemalloc.start()
    with open(path, "rb") as source:
        assert sum(r[6] for r in warc.read_records(source)) == 400 << 20
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_line_dedup(spark):
    pages = [(i, "a", f"header\nunique {i}\n  footer \n\nsame {i % 7}") for i in range(20)]
    pages += [(100 + i, "b", "header\nalone") for i in range(30)]  # one page fetched often
    pages += [(200 + i, None, f"null host\nline {i}") for i in range(6)] + [(300, "c", None), (301, "c", ""), (302, "c", prose(1, 30_000)), (0, "a", pages[0][2]), (None, "a", "header")]
    frame = spark.createDataFrame([(d, t, "en", s, 1, 1, "h", "t", 0.5, 2, "host", "no") for d, s, t in pages], DOCS)
    got = line_dedup.drop_boilerplate(frame, 0.3, 0.3, 5).select("row.doc_id", "clean", "row.host", "n_lines", "n_dropped").collect()
    want = brute.restored_lines(pages, 0.3, 0.3, 5)
    assert sorted(((r.doc_id, r.clean) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_dropped or 0 for r in got) == 21 * 2 + 1 + 6 and {r.host for r in got} == {"host"}
    assert line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


def test_line_dedup_of_short_and_long_lines(spark):
    long, short = "this line is on every fifth page", "or so"
    pages = [(i, "a", f"own text of page {i}" + f"\n {long} " * (i % 5 == 0) + f"\n{short}" * (i % 4 == 0)) for i in range(60)]
    pages += [(100 + i, "tiny", f"{long}\nown words of {i}") for i in range(3)]  # no host is too small
    pages += [(200 + i, "pair", f"near copies share\nall but one line\n{i}") for i in range(2)]
    frame = spark.createDataFrame([(d, t, "en", s, 1, 1, "h", "t", 0.5, 2, "host", "no") for d, s, t in pages], DOCS).repartition(4)
    for args in ((), (0.1, 0.24, 3, 3), (0.1, 0.26, 3, 3), (0.21, 0.2, 3, 3), (0.1, 0.2, 13, 3), (0.1, 0.1, 3, 9)):
        got = line_dedup.drop_boilerplate(frame, *args).select("row.doc_id", "clean").collect()
        assert sorted(map(tuple, got)) == sorted(brute.restored_lines(pages, *args))
    clean = dict(map(tuple, line_dedup.drop_boilerplate(frame).select("row.doc_id", "clean").collect()))
    assert clean[100] == "own words of 0" and clean[200].startswith("near copies share") and clean[20] == "own text of page 20"
