"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.shared import shared_dir, written

__all__ = ["extended", "sha256_of", "shared_dir", "table", "written"]


def sha256_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, run, added: str) -> DataFrame:
    """df with columns that run (over Arrow batches) appends; columns of df with such a name give way to them."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(added)
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c not in new.names])

    def over(batches):
        import pyarrow as pa

        for batch in batches:
            arrays = run(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new.names])

    return kept.mapInArrow(over, StructType([*kept.schema.fields, *new.fields]))
