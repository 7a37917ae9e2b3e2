"""Queries over model answers on documents of which some hold no word or share an id, against their SQL."""

import os

import pytest
from conftest import rows

from mnemolake.operators import extraction

FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from check import compare, duck  # noqa: E402

BLANK = {40: "", 41: " \n\t ", 42: None, 43: "\f", 45: "", 46: " ", 47: "", 48: None, 51: "\v first", 54: "last \f"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("blank")
    con = duck(FOLDER)
    con.execute("CREATE TABLE changed (id BIGINT, said VARCHAR)")
    con.executemany("INSERT INTO changed VALUES (?, ?)", list(BLANK.items()))
    con.execute(
        f"COPY (SELECT * EXCLUDE (id, said) REPLACE (CASE WHEN id IS NULL THEN text ELSE said END AS text) FROM documents "
        f"LEFT JOIN changed ON id = doc_id) TO '{made}/documents.parquet' (FORMAT parquet)"
    )
    con.execute(f"COPY embeddings TO '{made}/embeddings.parquet' (FORMAT parquet)")
    return str(made)


@pytest.mark.parametrize("name", ["episodes", "entity_source", "semantics", "job_cold_path"])
def test_blank_texts_as_in_the_sql(spark, folder, name):
    text, _, ok = compare(spark, duck(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, text


@pytest.mark.parametrize("name", ["episodes", "semantics"])
def test_shared_ids_as_in_the_sql(spark, tmp_path, name):
    con = duck(FOLDER)
    twice = "SELECT * FROM documents UNION ALL SELECT * REPLACE (text || ' more' AS text) FROM documents WHERE doc_id BETWEEN 40 AND 47"
    con.execute(f"COPY ({twice}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    twice = "SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id BETWEEN 44 AND 51"
    con.execute(f"COPY ({twice}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    text, _, ok = compare(spark, duck(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert ok, text


def test_blank_cells_have_episodes_only_if_answered(spark):
    cells = spark.createDataFrame(
        [("t", "u", m, text) for m, text in (("a", " "), ("b", None), ("c", ""), ("d", " words "))],
        "tenant_id string, user_id string, mem_cell_id string, text string",
    )
    said = spark.createDataFrame([("a", "nothing"), ("b", '{"summary": "s"}')], "mem_cell_id string, response string")
    assert rows(extraction.episodes(cells, said), "episode_id", "summary") == [("a#0", ""), ("b#0", "s"), ("d#0", "words")]


def test_facts_of_an_answered_episode_without_summary(spark):
    found = spark.createDataFrame(
        [("t", "u", "a", f"a#{i}", s) for i, s in enumerate([" ", None, "s"])],
        "tenant_id string, user_id string, mem_cell_id string, episode_id string, summary string",
    )
    said = spark.createDataFrame([(f"a#{i}", '{"content": "c"}') for i in range(2)], "episode_id string, response string")
    assert rows(extraction.semantics(found, said), "semantic_id", "content") == [("a#0#0", "c"), ("a#1#0", "c")]
