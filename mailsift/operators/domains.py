"""Domains that share an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CLUSTER_SIZE = 5


def cluster_analysis(nodes: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """``domain, network_threat, cluster_id, shared_domains`` for nodes ``domain, ip``.

    Addresses are counted by an aggregation that combines before the shuffle and joined back, so an address
    shared by very many domains is never gathered in one task. Unknown origins give false and null.
    """
    sizes = nodes.groupBy("ip").agg(F.count("*").alias("shared_domains"))
    known = nodes.join(sizes, "ip").select(
        "domain", (F.col("shared_domains") > CLUSTER_SIZE).alias("network_threat"),
        F.concat(F.lit("IP_Cluster_"), F.col("ip").cast("string")).alias("cluster_id"), "shared_domains")
    if origins is None:
        return known
    return origins.join(known, "domain", "left").withColumn(
        "network_threat", F.coalesce("network_threat", F.lit(False)))
