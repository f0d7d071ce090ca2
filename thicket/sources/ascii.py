"""The text form of sample sets: a header ``n nlabels nfeats``, then ``id label f1 ... fn``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.plans.runtime import cut
from thicket.sources.binary import register, write_samples


def to_lines(samples: DataFrame) -> DataFrame:
    """``position, line`` with features in six decimals."""
    feats = F.transform("feat", lambda v: F.format_string("%.6f", v.cast("double")))
    return samples.select("position", F.concat_ws(" ", F.col("position").cast("string"), F.col("truelabel").cast("string"), F.concat_ws(" ", feats)).alias("line"))


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``position, truelabel, feat`` of well-formed rows (no header)."""
    parts = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    return lines.select(parts.alias("p")).select(F.col("p")[0].try_cast("long").alias("position"), F.col("p")[1].try_cast("int").alias("truelabel"), F.transform(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), lambda v: v.try_cast("double")).alias("feat"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a text file or folder: lines count from 1 in order of file name and offset.

    A file is read in pieces by many tasks. Pieces of a file are partitions in order of their
    offset, so a line's number is its place in its piece plus the lines before.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at"))
    placed = cut(rows)
    parts = placed.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy().orderBy("_f", "_b")) - F.col("_n"))  # one row a piece of a file
    at = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return placed.join(F.broadcast(before.select("_f", "_b", "_first", "_before")), ["_f", "_b"]).select(at.alias("line_no"), "value")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a text file; its first line is the header and is skipped."""
    return parse_lines(numbered_lines(spark, path).filter("line_no > 1"), "value")


def write(samples: DataFrame, path: str) -> None:
    """A folder of text parts; the first line of the first part is the header."""
    from thicket.operators.prepare import info

    head = info(samples).select(F.lit(-1).cast("long").alias("position"), F.concat_ws(" ", "nnodes", "nlabels", "nfeats").alias("line"))
    head.unionByName(to_lines(samples)).orderBy("position").select("line").write.mode("overwrite").text(path)


def _float_ok(part: Column, classic: bool) -> Column:
    if classic:
        count = lambda c: F.length(part) - F.length(F.replace(part, F.lit(c), F.lit("")))
        return part.rlike(r"\A[0-9.+\-\r]*\z") & (count(".") <= 1) & (count("+") <= 1) & (count("-") <= 1) & ~((count(".") > 0) & (count("+") > 0))
    return part.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")


def check(lines: DataFrame, nfeats: int | Column, nlabels: int | Column, classic: bool = False) -> DataFrame:
    """``line_no, ok`` for each of ``line_no, line``; ``nfeats`` and ``nlabels`` may be columns of ``lines``.

    The strict rule accepts exponents and wants 0 < label <= nlabels; ``classic`` keeps the
    original rule: no exponents, no number with both a point and a plus, any positive label.
    """
    parts = F.split(F.trim("line"), r"[ \t]+")
    ok = (
        (F.size("p") == nfeats + 2)
        & F.coalesce(F.try_element_at("p", F.lit(1)).rlike(r"\A[0-9]+\z"), F.lit(False))
        & F.coalesce(F.try_element_at("p", F.lit(2)).rlike(r"\A[0-9]+\z") & (F.try_element_at("p", F.lit(2)).try_cast("long") > 0), F.lit(False))
        & F.forall(F.slice("p", 3, nfeats), lambda v: _float_ok(v, classic))
    )
    if not classic:
        ok = ok & F.coalesce(F.try_element_at("p", F.lit(2)).try_cast("long") <= nlabels, F.lit(False))
    return lines.withColumn("p", parts).select("line_no", F.coalesce(ok, F.lit(False)).alias("ok"))


def check_header(line: str) -> bool:
    parts = line.split()
    return len(parts) == 3 and all(p.isascii() and p.isdigit() and int(p) > 0 for p in parts)


def first_bad(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("ok")).agg(F.min("line_no").alias("line_no"))


def check_file(spark: SparkSession, path: str, classic: bool = False) -> int | None:
    """The number of the first bad line of a text file, its header being line 1; None if all are good.

    Like the header says, only its ``n`` lines are looked at; a file that holds fewer is bad at
    the line that is missing.
    """
    lines = numbered_lines(spark, path)
    head = lines.filter("line_no = 1").first()
    if head is None or not check_header(head.value):
        return 1
    n, nlabels, nfeats = map(int, head.value.split())
    body = cut(lines.filter((F.col("line_no") > 1) & (F.col("line_no") <= n + 1)).withColumnRenamed("value", "line"))
    bad = first_bad(check(body, nfeats, nlabels, classic)).first()[0]
    there = body.count()
    return bad if bad is not None else there + 2 if there < n else None


def to_binary(spark: SparkSession, text: str, path: str) -> None:
    """A text file as a binary sample file."""
    write_samples(read(spark, text), path)


def from_binary(spark: SparkSession, path: str, text: str) -> None:
    """A binary sample file as a text file."""
    register(spark)
    write(spark.read.format("forest_samples").load(path), text)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, label`` of a file with one predicted label a line; lines count from 1."""
    return numbered_lines(spark, path).select("line_no", F.col("value").try_cast("int").alias("label"))
