"""Queries on nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import decision as D, neighbours as N
from mailsift.plans.catalog import query
from mailsift.session import scratch_path
from mailsift.sources.emails import table

# Squared differences in double precision, as the vectors are stored in single precision.
_DISTANCE = """round(list_sum(list_transform(range(1, len(a.embedding) + 1),
  lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6)"""
_RANKED = f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label, {_DISTANCE} AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM d)"""


def _nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return N.nearest(vectors, vectors, exclude_self=True)


@query("knn_l2", f"{_RANKED} SELECT query_id, neighbour_id, distance, rank FROM ranked WHERE rank <= 3")
def knn_l2(spark, sf_dir):
    """The three nearest other vectors of every vector."""
    return _nearest(spark, sf_dir)


@query("similar_threats", f"""{_RANKED} SELECT query_id, count(*) FILTER (WHERE label < 5 AND distance < 0.5) AS spam_matches
  FROM ranked WHERE rank <= 3 GROUP BY 1""")
def similar_threats(spark, sf_dir):
    """Close neighbours that are known spam; labels below five stand for spam here. The store is written first."""
    path = scratch_path(spark, "neighbours")
    N.add(table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("label") < 5, "spam").otherwise("ham")), path)
    store = spark.read.parquet(path)
    matches = N.nearest(store, store, exclude_self=True)
    return N.similar_threats(matches, store).select(
        "query_id", D.spam_matches(F.col("similar_threats")).cast("long").alias("spam_matches"))
