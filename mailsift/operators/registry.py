"""Model registry as a table: versions, status, best and default model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mailsift import config


def with_versions(entries: DataFrame) -> DataFrame:
    """Version = position among the entries of the same name by registration time."""
    w = Window.partitionBy("model_name").orderBy("registered_at", "dataset_version")
    return entries.withColumn("version", F.row_number().over(w))


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Append entries; each gets the next version of its name."""
    last = registry.groupBy("model_name").agg(F.max("version").alias("_last"))
    new = with_versions(entries).join(last, "model_name", "left")
    new = new.withColumn("version", (F.col("version") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
    return registry.unionByName(new.select(registry.columns))


def list_models(registry: DataFrame, status: str | None = None) -> DataFrame:
    return registry.filter(F.col("status") == status) if status else registry


def archive(registry: DataFrame, model_name: str, version: int) -> DataFrame:
    hit = (F.col("model_name") == model_name) & (F.col("version") == version)
    return registry.withColumn("status", F.when(hit, "archived").otherwise(F.col("status")))


def archive_all(registry: DataFrame, targets: DataFrame) -> DataFrame:
    """Archive every ``model_name, version`` listed in ``targets``."""
    marked = targets.select("model_name", "version", F.lit(True).alias("_hit"))
    return (registry.join(marked, ["model_name", "version"], "left")
            .withColumn("status", F.when(F.col("_hit"), "archived").otherwise(F.col("status"))).drop("_hit"))


def latest_active(registry: DataFrame) -> DataFrame:
    """Per model the active entry with the highest version."""
    cols = [c for c in registry.columns if c not in ("model_name", "version")]
    newest = F.max(F.struct("version", *cols)).alias("m") if "parameters" not in cols else F.max_by(
        F.struct("version", *cols), "version").alias("m")
    return list_models(registry, "active").groupBy("model_name").agg(newest).select("model_name", "m.*")


def best_active(registry: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The active entry with the highest F1; the earliest registration wins among equals."""
    scored = list_models(registry, "active").filter(F.col(metric).isNotNull())
    return scored.orderBy(F.col(metric).desc(), "registered_at", "model_name", "version").limit(1)


def default_model(registry: DataFrame) -> DataFrame:
    """One row: the best active model, or the fixed fallback when there is none."""
    return best_active(registry).agg(F.coalesce(F.max("model_name"), F.lit(config.DEFAULT_MODEL)).alias("model_name"))
