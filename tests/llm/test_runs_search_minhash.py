"""Periodic runs, ranked search and MinHash near-duplicates against brute force on small tables:
nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from raceboard.llm import minhash, periodic_runs, queries, ranked_search, simhash
from tests.llm.test_operators import ITEMS, TEXTS, item_table, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs ---------------------------------------------------------------------

def brute_runs(words):
    """Every lag over the whole text; of equal stretches the smallest lag counts."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


piece = st.one_of(
    st.lists(st.sampled_from("abcdefgh"), max_size=40),
    st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(1, 90)).map(lambda x: [x[0][i % len(x[0])] for i in range(x[1])]))


@settings(max_examples=400, deadline=None)
@given(st.lists(piece, max_size=5).map(lambda x: sum(x, [])))
def test_runs_equal_every_lag(words):
    assert periodic_runs.runs_of(words) == brute_runs(words)


def test_runs_in_nested_and_long_texts():
    fib = "a", "ab"
    while len(fib[1]) < 1500:
        fib = fib[1], fib[1] + fib[0]
    assert periodic_runs.runs_of(list(fib[1])) == brute_runs(list(fib[1]))
    long = [f"w{i}" for i in range(50_000)] + [f"p{i % 700}" for i in range(100_000)] + ["x"] * 100_000
    assert periodic_runs.runs_of(long) == [(50_000, 100_000, 700), (150_000, 100_000, 1)]
    assert list(periodic_runs.segments(periodic_runs.coded(long[:60_000])))[0][0] == 50_000  # all before it split away


RUN_TEXTS = [*TEXTS, (20, "ha " * 30), (21, "ha " * 23), (22, " ".join(["a b c"] * 9) + " tail"), (22, " ".join(["a b c"] * 9) + " tail"),
             (23, "one two " * 14 + "x " + "y z " * 14), (24, "é é " * 30), (None, "go " * 40)]


def test_find_runs(spark):
    got = periodic_runs.find_runs(table(spark, RUN_TEXTS)).select("row.doc_id", "row.row", "row.host", "n_words", "runs", "collapsed").collect()
    want = []
    for d, t in RUN_TEXTS:
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 2000 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    key = lambda r: (str(r[0]), r[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert {(r["row"], r.host) for r in got} == {(2, "host")}
    assert periodic_runs.find_runs(table(spark, [])).count() == 0
    assert sum(len(r.runs) for r in got) >= 7


def test_planted_repeats_and_digest_columns(spark, tmp_path):
    import hashlib
    import zlib
    docs = [(i, prose(i, 150, 40)) for i in range(60)] + [(60, None), (61, ""), (None, "ha " * 30), (62, "ha " * 30), (63, "a b " * 20 + "z " + "c d " * 20)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.collapsed_sha256): r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    moved = 0
    for d, t in docs:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            moved += 1
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d, sha(" ".join(x for i, x in enumerate(w) if i not in gone))]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    assert moved >= 3 and len(got) == len(docs)


# --- ranked search ---------------------------------------------------------------------

def brute_ranked(docs, items, top):
    terms = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = 0
            for term in terms(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(term in x for _, x in held) + 1)))
                    s += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


SEARCHED = [(d, t) for d, t in TEXTS if t is None or len(t) < 5000] + [(100 + i, prose(i, 40, 60)) for i in range(30)]
ASKED = [*ITEMS, (6, prose(5, 12, 60)), (7, prose(5, 12, 60) + " w1 w1"), (8, "w1 w2 w3"), (9, "w3 w2 w1 w4"), (10, "w1")]


@pytest.mark.parametrize("block_terms", [100_000, 40])
def test_ranked_search(spark, block_terms):
    got = ranked_search.ranked(table(spark, SEARCHED), item_table(spark, ASKED), top=7, block_terms=block_terms)
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=key) == sorted(brute_ranked(SEARCHED, ASKED, 7), key=key)


def test_ranked_search_of_empty_tables(spark):
    assert ranked_search.ranked(table(spark, []), item_table(spark, ASKED)).count() == 0
    assert ranked_search.ranked(table(spark, SEARCHED), item_table(spark, [])).count() == 0


def test_sharing_dag():
    """Every item's terms are exactly those owned on its way up; what several items share is owned once."""
    rng = random.Random(4)
    for _ in range(200):
        items = [sorted({(t, 1 + rng.randrange(2)) for t in rng.sample(range(12), rng.randrange(9))}) for _ in range(rng.randrange(1, 9))]
        dag = ranked_search.sharing_dag(items)
        for item, node in zip(items, dag.item_nodes):
            found = []
            while node >= 0:
                found += dag.owned[node]
                node = dag.parent[node]
            assert sorted(found) == item
        assert all(p < i for i, p in enumerate(dag.parent))
    dag = ranked_search.sharing_dag([[(1, 1), (2, 1), (3, 1)], [(1, 1), (2, 1), (4, 1)], [(1, 1), (2, 1), (4, 1), (5, 1)], [(9, 1)]])
    assert sum(len(own) for own in dag.owned) == 6  # of 11 terms
    assert sorted(dag.owned[dag.parent[dag.item_nodes[0]]]) == [(1, 1), (2, 1)]


# --- MinHash ---------------------------------------------------------------------------

def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 2]) for i in range(max(len(w) - 1, 1))} if w else set()


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(docs)]


def edited(seed, base, n):
    rng = random.Random(seed)
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    docs = [*TEXTS, (30, "one"), (31, "ONE"), (32, "two"), (33, "É x"), (34, "é x")]
    for k in range(6):
        base = prose(50 + k, 90)
        docs += [(100 + 10 * k + i, edited(100 * k + i, base, i)) for i in range(10)]  # from equal to far
    chain = prose(77, 200).split()
    docs += [(300 + i, " ".join(chain[6 * i:6 * i + 120])) for i in range(13)]  # neighbours link, ends do not
    return docs


def test_minhash_equals_all_pairs(spark):
    docs = near_copies()
    got = minhash.near_duplicates(table(spark, docs)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(docs), key=key)


def test_minhash_of_empty_tables(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    rows = minhash.near_duplicates(table(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_sketches_fill_and_estimate():
    with np.errstate(over="ignore"):
        rng = np.random.default_rng(1)
        for n in (1, 2, 5, 40, 300, 100_000):
            assert minhash.sketch(rng.integers(0, 2**63, n).astype(np.uint64)).max() < np.uint64(2 * minhash.COORDS) << np.uint64(32)
        errors, missed = [], 0
        for _ in range(300):
            common, a, b = rng.integers(0, 2**63, 80).astype(np.uint64), *rng.integers(0, 2**63, (2, 10)).astype(np.uint64)
            x, y = (minhash.sketch(np.unique(np.concatenate((common, z)))) for z in (a, b))  # similarity 0.8
            errors.append(np.mean(x == y) - 0.8)
            missed += not np.any(minhash.band_keys(x) == minhash.band_keys(y)) or np.sum(x == y) < minhash._LEAST_AGREE
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045 and missed == 0


def test_sketch_agreement_counts_bytes(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (50, 128)).astype(np.uint8)
    b = np.where(rng.random((50, 128)) < 0.5, a, rng.integers(0, 256, (50, 128))).astype(np.uint8)
    rows = [(x.view("<i8").tolist(), y.view("<i8").tolist(), int(np.sum(x == y))) for x, y in zip(a, b)]
    found = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert found.where(minhash._agreeing("a", "b") != F.col("n")).count() == 0


def test_texts_are_scanned_in_bounded_parts(spark):
    texts = [None, "", "x" * (3 * periodic_runs._BYTES), *["y" * (periodic_runs._BYTES // 3)] * 10, *["z"] * 200]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n": pa.array(range(len(texts)))})
    parts = list(periodic_runs._parts(batch))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(len(texts)))
    sizes = [[len(t or "") for t in p.column("text").to_pylist()] for p in parts]
    assert all(len(s) <= periodic_runs._ROWS and (sum(s) <= periodic_runs._BYTES or len(s) == 1) for s in sizes)
    assert list(periodic_runs._parts(batch.slice(0, 0))) == []
    periodic_runs.find_runs(table(spark, RUN_TEXTS))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "a bigint, b bigint")


def test_components_end_when_only_stars_are_left(spark, monkeypatch):
    written, stored = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, sort=None: written.append(name) or stored(df, name, sort))
    stars = [(0, i) for i in range(1, 40)] + [(i, 50) for i in range(50, 60)] + [(50, 50)]
    assert dict(map(tuple, simhash.components(edge_table(spark, stars)).collect())) == union_find([e for e in stars if e != (50, 50)])
    assert written == ["stars"]
    rng = random.Random(3)
    tangled = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    tangled = [e for e in tangled if e[0] != e[1]]
    assert dict(map(tuple, simhash.components(edge_table(spark, tangled)).collect())) == union_find(tangled)
    assert simhash.components(edge_table(spark, [])).count() == 0


def test_links_across_components_join_their_roots(spark):
    first, later = [(1, 2), (2, 5), (7, 8), (10, 12), (20, 21)], [(5, 8), (12, 30), (31, 32), (7, 3), (2, 1)]
    roots = simhash.components(edge_table(spark, first))
    got = [tuple(r) for r in minhash._merged(roots, edge_table(spark, later)).collect()]
    assert len(got) == len(set(got)) and dict(got) == union_find(first + later)
    got = minhash._merged(roots, edge_table(spark, [])).collect()
    assert dict(map(tuple, got)) == union_find(first)
