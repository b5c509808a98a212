"""The pipeline against brute force of its filters, and the registered queries against their SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from raceboard.llm import queries
from raceboard.llm.common import read_table
from tests.llm import brute
from tests.llm.test_operators import DOCS, ITEMS, PASSAGE, TOXIC, item_table, prose, rows_of, toxic_corpus

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts, labels = toxic_corpus()
    clean = [(d, t) for d, t in texts if d % 3]
    # lines that a third of the source's pages carry, copies, near copies, a passage, disguised toxicity, odd rows
    docs = [(d, f"Site header\n{t}\nline {d}") for d, t in texts]
    copy = prose(77, 200)
    near = copy.split()
    near[100] = "changed"
    docs += [(1000, copy), (1001, copy), (1002, " ".join(near)), (1003, prose(78, 50) + " " + PASSAGE), (1004, "what an 1diot you are"), (1005, None), (1006, ""), (None, "kept though it has no id")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows_of(docs), DOCS).write.parquet(f"{folder}/documents.parquet")
    item_table(spark, ITEMS[:1]).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, clean


def test_stages(spark, corpus, tmp_path):
    folder, docs, clean = corpus
    frame, out = read_table(spark, folder, "documents"), {}
    columns = frame.dtypes
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{i}")
        frame = spark.read.parquet(f"{tmp_path}/{i}")
        out[name] = frame
        if i < 4:
            assert frame.dtypes == columns
    ids = lambda name: sorted(str(r.doc_id) for r in out[name].select("doc_id").collect())
    toxic = lambda t: any(w in (t or "").split() for w in TOXIC)
    kept = [(d, t) for d, t in docs if not toxic(t) and d != 1004]
    assert ids("toxicity") == sorted(str(d) for d, _ in kept)
    cleaned = brute.restored_lines([(d, "src", t) for d, t in kept])
    texts = {str(r.doc_id): r.text for r in out["line_dedup"].select("doc_id", "text").collect()}
    assert texts == {str(d): t for d, t in cleaned} and not any((t or "").startswith("Site header") for t in texts.values())
    comp = brute.components([(d, brute.fingerprint(t)) for d, t in cleaned])
    single = [(d, t) for (d, t), c in zip(cleaned, comp) if d == c]
    assert ids("simhash_near_dedup") == sorted(str(d) for d, _ in single)
    rest = [(d, t) for d, t in single if not brute.contaminated([(d, t)], [(1, PASSAGE)])[0][2]]
    assert ids("benchmark_decontamination") == sorted(str(d) for d, _ in rest) and "1003" not in ids("benchmark_decontamination")
    tokens = {}
    for r in out["packing"].collect():
        tokens[str(r.doc_id)] = tokens.get(str(r.doc_id), 0) + r.length
    assert tokens == {str(d): len(brute.ids(t)) for d, t in rest}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(
        map(tuple, out["packing"].select("doc_id", "start", "length", "ids_crc32").collect()), key=str)


def test_stages_on_an_empty_table(spark, corpus, tmp_path):
    folder, _, _ = corpus
    empty = read_table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_repeated_rows_leave_one_of_each_group(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame(rows_of([(1, "same text here"), (1, "same text here"), (1, "Same text here"), (2, "same text here"), (None, "same text here")]), DOCS)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, folder).collect()
    assert {r.doc_id for r in kept} == {1} and len({r.text for r in kept}) == 1


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, found.fetchall()))
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == want and want


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_give_a_row_per_document(spark, name):
    docs = read_table(spark, SF, "documents")
    found = queries.queries()[name](spark, SF)
    assert {r.doc_id for r in found.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
