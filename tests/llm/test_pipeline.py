"""The whole pipeline and the registered queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import lineage, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_covers_its_table(spark, name):
    out = registry.QUERIES[name](spark, SF)
    rows = out.collect()
    if name == "op12_sort_means":
        assert sorted(r.vec_id for r in rows) == sorted(r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    elif name != "op10_chat_format":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    else:
        assert {r.conv_id for r in rows} == {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()} | {-1}


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        def __init__(self, master, named=None):
            settings = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": "/warehouse/"}
            self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: settings.get(k, d))})
            self.sparkContext = type("Context", (), {"master": master})

    assert lineage.shared_folder(Session("local[4]")) == "/warehouse/_checkpoints"
    assert lineage.shared_folder(Session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_folder(Session("spark://host:7077"))


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == names, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in seen.select("doc_id").collect()}
        if name == "line_dedup":
            assert out.count() == seen.count()
        seen = out
    final = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in seen.collect()} and all(r.restored for r in final)


def test_stages_on_awkward_rows(spark, make):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = "the cat and the dog of that house was in it for as long as on the day they had with us in time and peace"
    other = "an old man of the sea was with his boat and it is said that from that day on he was at peace with all in it"
    rows = [(1, good), (1, good), (1, other), (2, None), (3, ""), (None, good), (4, good), (5, f"{other} " * 400)]
    docs = make(rows).withColumn("rep", F.lit(7)).withColumn("k", F.lit("own")).withColumn("term", F.lit(1.5))
    for table in (docs, docs.limit(0)):
        seen = table
        for _, stage in pipeline.STAGES[:-1]:
            seen = stage(spark, seen, SF)
            assert seen.columns == docs.columns
        left = seen.collect()
        assert all(r.rep == 7 and r.k == "own" for r in left)
        final = pipeline.STAGES[-1][1](spark, seen, SF).collect()
        assert len(final) == len(left) and all(r.restored for r in final)
        if table is docs:
            assert {r.doc_id for r in left} == {1, None}  # one of each group of copies; repeated rows are one document
        else:
            assert not left
