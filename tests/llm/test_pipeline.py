"""The pipeline's stages against plain versions, on given tables and on odd rows."""

import plain
import pytest
from test_search import prose

import corpus_pipeline as pipeline
from concordat.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    from check_reference import compare, duck

    assert compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], SQL[name]).startswith("ok")


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, items = docs.columns, plain.given(spark, FOLDER, "benchmark", "item_id", "text")
    for name, stage in pipeline.STAGES:
        out = pipeline.settle(stage(spark, docs, FOLDER), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(rows)
            break
        assert out.columns == columns and out.schema == docs.schema
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(got)
        if name == "language_id":
            assert len(got) >= 0.99 * len(rows)
        elif name == "near_dedup":
            assert set(got) == {i for i, c in plain.classes(rows.items()).items() if i == c}
        elif name == "substring_dedup":
            assert {i: plain.sha(b" ".join((t or "").encode().split())) for i, t in got.items()} == {i: sha for i, _, _, sha in plain.repeats(rows.items())}
        else:
            assert set(got) == {r[0] for r in plain.contamination(rows.items(), items) if not r[5]}
        docs, rows = out, got


def test_stages_on_odd_rows(spark, docs):
    one = prose(30, 80)
    rows = docs([(1, None), (2, ""), (3, "..."), (4, one), (5, one), (None, one), (6, prose(31, 30) + " " + one), (7, prose(32, 40)), (7, prose(33, 40)), (8, "x" * 100000)])
    for name, stage in pipeline.STAGES:
        assert stage(spark, rows.limit(0), FOLDER).count() == 0
    near = pipeline.keep_one_of_near_duplicates(spark, rows, FOLDER)
    assert near.columns == rows.columns and sorted((r["doc_id"] or -1) for r in near.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8]
    cut = {r["doc_id"]: r for r in pipeline.remove_repeated_passages(spark, near, FOLDER).collect()}
    assert cut[6]["text"] == prose(31, 30) and cut[6]["n_chars"] == len(prose(31, 30)) and cut[1]["text"] is None and cut[4]["text"] == one and cut[None]["text"] == one
    kept = pipeline.drop_contaminated(spark, rows, FOLDER)
    assert kept.count() == rows.count() and kept.schema == rows.schema
