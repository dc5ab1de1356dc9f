"""Versioned datasets and feature sets on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift import schemas


def version_entry(df: DataFrame, version: str, source: str, steps: list[str] | None = None,
                  at=None) -> DataFrame:
    """Metadata row of a dataset version; counting is its only job."""
    columns = F.array(*[F.lit(c) for c in df.columns])
    steps_col = F.array(*[F.lit(s) for s in steps or []]).cast("array<string>")
    return df.agg(F.count("*").alias("num_samples")).select(
        F.lit(version).alias("version"), F.lit(f"version={version}").alias("filename"), F.lit(source).alias("source"),
        (at if at is not None else F.current_timestamp()).alias("date_added"), "num_samples",
        columns.alias("columns"), steps_col.alias("preprocessing_steps"))


class DatasetVersions:
    """``<root>/data/version=<tag>`` and ``<root>/metadata``, both appended by independent files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.data, self.metadata = spark, f"{root}/data", f"{root}/metadata"

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def list(self) -> DataFrame:
        if not self._exists(self.metadata):
            return self.spark.createDataFrame([], schemas.DATASET_VERSIONS)
        return self.spark.read.schema(schemas.DATASET_VERSIONS).parquet(self.metadata)

    def register(self, df: DataFrame, version: str | None = None, source: str = "unknown",
                 steps: list[str] | None = None) -> str:
        version = version or f"v{self.list().count() + 1}"
        path = f"{self.data}/version={version}"
        df.write.mode("overwrite").parquet(path)
        version_entry(self.spark.read.parquet(path), version, source, steps).write.mode("append").parquet(self.metadata)
        return version

    def read(self, version: str) -> DataFrame:
        """Rows of one version; its folder alone is listed and read."""
        if self.list().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"Dataset version '{version}' not found")
        return self.spark.read.parquet(f"{self.data}/version={version}")


class FeatureStore:
    """Feature sets by name; saving again replaces the set and its metadata."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._versions = DatasetVersions(spark, root)

    def _path(self, name: str) -> str:
        return f"{self.root}/features/name={name}"

    def _meta(self, name: str) -> str:
        return f"{self.root}/feature_metadata/name={name}"

    def exists(self, name: str) -> bool:
        return self._versions._exists(self._meta(name))

    def save(self, features: DataFrame, name: str, dataset_version: str = "unknown", method: str = "tfidf",
             row_key: str = "doc_id", column_key: str = "term_id") -> None:
        """Write a long feature table and record its shape (rows, highest column + 1)."""
        features.write.mode("overwrite").parquet(self._path(name))
        saved = self.spark.read.parquet(self._path(name))
        keys = saved.select(row_key).distinct().agg(F.count("*").alias("rows"))
        width = saved.agg((F.coalesce(F.max(column_key), F.lit(-1)) + 1).cast("long").alias("width"))
        shape = F.array(keys.scalar(), width.scalar())
        self.spark.range(1).select(
            F.lit(self._path(name)).alias("path"), F.lit(method).alias("method"),
            F.lit(dataset_version).alias("dataset_version"), shape.alias("shape"),
            F.current_timestamp().alias("created_at")).write.mode("overwrite").parquet(self._meta(name))

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"Feature set '{name}' not found in store")
        return self.spark.read.parquet(self._path(name))

    def list(self) -> DataFrame:
        """One row per feature set; the name comes from the folder."""
        if not self._versions._exists(f"{self.root}/feature_metadata"):
            return self.spark.createDataFrame([], schemas.FEATURE_SETS)
        fields = schemas.FEATURE_SETS
        return self.spark.read.schema(fields).parquet(f"{self.root}/feature_metadata")
