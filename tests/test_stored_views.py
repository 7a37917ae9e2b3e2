"""Jobs that read the cells in several steps store them first, so that their joins move the texts once."""

from mnemolake.plans import catalog
from mnemolake.sources.views import Tables

FOLDER = "/root/testdata/sf0.001"


def reads_documents(df):
    return any("documents.parquet" in name for name in df.inputFiles())


def test_views_over_a_stored_one_read_it(spark):
    t = Tables(spark, FOLDER)
    rows = t["cells"].count()
    assert reads_documents(t["cells"])
    cells = t.stored("cells")
    assert cells.count() == rows and cells.schema == t["cells"].schema
    assert not reads_documents(cells) and not reads_documents(t["stated"]) and not reads_documents(t["responses"])


def test_retrieval_reads_texts_from_the_stored_cells(spark):
    out = catalog.QUERIES["job_retrieve_options"](spark, FOLDER)
    assert not reads_documents(out) and out.count() > 0


def test_entities_of_both_mentions_are_drawn_once(spark):
    out = catalog.QUERIES["graph_edges"](spark, FOLDER)
    assert not reads_documents(out) and out.filter("strength <> 2").isEmpty()
