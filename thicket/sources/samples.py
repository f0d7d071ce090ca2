"""Sample sets from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.plans.runtime import table


def embeddings(spark: SparkSession, d: str, positive: bool = False) -> DataFrame:
    """``position, truelabel, feat`` of the embeddings; labels start at 1."""
    e = F.col("embedding")
    feat = F.transform(e, lambda v: F.abs(v)) if positive else e
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("position"), (F.col("label") + 1).cast("int").alias("truelabel"), feat.cast("array<double>").alias("feat"))


def embeddings3(spark: SparkSession, d: str) -> DataFrame:
    """The first three dimensions, labelled by the signs of two of them."""
    e = F.col("embedding").cast("array<double>")
    label = 1 + (e[0] > 0).cast("int") + 2 * (e[1] > 0).cast("int")
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("position"), label.cast("int").alias("truelabel"), F.slice(e, 1, 3).alias("feat"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts by size and price, labelled by the hash of their type (1 to 25)."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("position"), (F.conv(F.substring(F.md5("p_type"), 1, 4), 16, 10).cast("int") % 25 + 1).alias("truelabel"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("feat"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items by quantity, price, discount and tax, labelled by return flag."""
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    feats = [F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return table(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * 16 + F.col("l_linenumber").cast("long")).alias("position"), code.alias("truelabel"), F.array(*feats).alias("feat"))
