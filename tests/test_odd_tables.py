"""Queries on small tables with missing and repeated keys, and at the edges of their bounds, against their SQL."""

import duckdb
import pytest
from test_oracles import rows

from skein import catalogue


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for t, (schema, data) in tables.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got, want = rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(catalogue.ORACLES[name]).df())
        assert got == want
        return got

    return check


def test_actor_buckets_keep_a_customer_without_key(same_as_sql):
    customers = [(1,), (1,), (2,), (3,), (None,), (None,)]
    orders = [(1, 10, "F"), (1, 11, "O"), (2, None, "O"), (2, 12, None), (None, 13, "F")]
    got = same_as_sql("actor_buckets", customer=("c_custkey long", customers), orders=("o_custkey long, o_orderkey long, o_orderstatus string", orders))
    assert len(got) == 4


def test_document_heads_keep_a_line_end_at_the_cut(same_as_sql):
    data = [(1, 0, "user", "a" * 299), (1, 1, "bot", "b"), (2, 0, "user", "a" * 300), (2, 1, "bot", "b"), (3, 0, None, "a" * 298), (3, 1, "bot", "b"), (3, None, "user", "last"), (None, 0, "user", None), (None, 1, "bot", "x")]
    got = same_as_sql("document_heads", conversations=("conv_id long, turn long, role string, text string", data))
    assert len(got) == 4


def test_rrf_fusion_takes_ten_thousand_of_each_list(same_as_sql):
    data = [(k, "ring" if k % 50 else "x", float(k % 977), 20 + k % 3) for k in range(16_000)] + [(None, "ring", 5.0, 30), (16_001, "ring", None, None)]
    got = same_as_sql("rrf_fusion", part=("p_partkey long, p_name string, p_retailprice double, p_size int", data))
    assert len(got) < len(data)


def test_tfidf_labels_in_slices_of_texts(spark, monkeypatch):
    import pyarrow as pa

    from skein.operators import topics

    data = [(k % 2, "alpha beta gamma-ray " * (k % 4) + f"word{k}") for k in range(40)] + [(0, None), (1, "")]
    docs = spark.createDataFrame(data, "cluster int, text string").coalesce(1)
    whole = sorted(topics.term_totals(docs).collect())
    monkeypatch.setattr(topics, "SLICE_BYTES", 100)
    assert sorted(topics.term_totals(docs).collect()) == whole
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in data])], names=["text"])
    parts = [p.column(0).to_pylist() for p in topics._slices(batch, 0, 100)]
    assert sum(parts, []) == [t for _, t in data] and all(len(p) == 1 or sum(len(t or "") for t in p) <= 100 for p in parts)


def test_issue_table_reads_its_comments_once(spark, monkeypatch):
    """Ranking by ranges makes several passes over the issues, but the comments are gathered in one."""
    from pyspark.sql import functions as F

    from skein.operators import digests, ranks

    monkeypatch.setattr(ranks, "FEW_ROWS", 0)
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return "thanks" if k % 2 else f"A duplicate of #{k + 1}"

    issues = spark.range(30).selectExpr("concat('r', id % 2) AS repo", "id AS number", "'OPEN' AS state", "'t' AS title", "array('x') AS labels", "date'2024-01-01' AS created", "CAST(NULL AS date) AS updated", "'a' AS author", "'text' AS body")
    rows = spark.range(60).select(F.concat(F.lit("r"), F.col("id") % 2).alias("repo"), (F.col("id") % 30).alias("number"), F.col("id").alias("at"), F.udf(counted, "string")("id").alias("author"), F.lit("thanks").alias("body"))
    got = digests.issue_table(issues, rows).collect()
    assert sorted(r.place for r in got) == sorted([*range(1, 16)] * 2) and sum(r.comments for r in got) == 60
    assert seen.value == 60
