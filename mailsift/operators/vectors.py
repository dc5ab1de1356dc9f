"""Term entries as ML vectors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from mailsift.session import scratch_path


def to_vectors(rows: DataFrame, size: int, entries: str = "entries", out: str = "features") -> DataFrame:
    """Replace ``entries`` by a sparse vector column.

    A vector is stored as a struct of type, size, indices and values; the rows are written in this form and
    read back as vectors. Training reads the features many times, so the written copy is needed anyway.
    """
    spark = rows.sparkSession
    as_struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.transform(entries, lambda e: e["term_id"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["weight"]).alias("values"))
    stored = rows.withColumn(out, as_struct).drop(entries)
    path = scratch_path(spark, "vectors")
    stored.write.parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in stored.schema.fields]
    return spark.read.schema(StructType(fields)).parquet(path)
