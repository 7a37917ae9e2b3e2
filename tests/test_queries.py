"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from check import compare, duck  # noqa: E402

SOME = (
    "raw_per_turn raw_metadata segment index_fanout reconcile bm25_topk vector_topk graph_traverse rrf_fuse "
    "feedback_fold select_to_forget decide_facts episodes param_history serving_rollups stream_segment"
).split()


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    text, _, ok = compare(spark, duck(FOLDER), name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, text


def test_every_operator_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110


def test_entry(spark):
    assert entry.entry(spark).count() > 0
