"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import shared_folder, swept, written

__all__ = ["NULL_ID", "free", "let", "row_key", "shared_folder", "small_batches", "swept", "table", "whole_text", "written"]

#: Stands for a null document id in keys; real ids are taken to be larger.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two non-null columns that tell rows apart; rows equal in id and text share them and count as one."""
    return [F.coalesce(doc_id, F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2")]


def free(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Python workers of this session get texts by so many bytes at a time at most, however many rows that is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > size:
        spark.conf.set(key, str(size))
