"""Strict loading of sample lines, with a reason for every line that does not conform.

Method: the raw lines keep their offset (``raw_id``). The strict load keeps only the
lines that satisfy one anchored pattern per format and whose values are in range; the
offsets of the loaded rows are subtracted from all offsets (anti-join), and only that
remainder is split and diagnosed. Everything is a JVM-side expression; no Python runs.

Defined cases (also covered by tests):

* null ``line`` or a line whose subgraph is unknown counts as an empty line: ``columns``;
* null or unknown ``fmt`` is read as ``txt``; the format is compared without case;
* empty text has zero fields (``columns``); blanks around a ``txt`` line make no field;
* rows that repeat a ``raw_id`` are each judged; the anti-join works on the offset, so an
  offset is rejected only if no conforming row carries it;
* null ``nlabels`` sets no upper bound on the label;
* columns of the input beside those used are carried neither in nor out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest 32-bit float, and the pattern of an ASCII integer.
FLOAT_MAX = 3.4028234663852886e38
DIGITS = r"[0-9]+"
#: One csv field: no quote at all, or wholly enclosed with inner quotes doubled.
#: Possessive, so that Java matches iteratively: long fields need no stack.
BARE, QUOTED = r'[^",]*+', r'[ \t]*+"(?:[^"]++|"")*+"[ \t]*+'
#: Both patterns are applied to the line with a comma put before it.
CSV_LINE = rf"(?s)\A(?:,(?:{QUOTED}|{BARE}))*+\z"
CSV_FIELD = rf"(?s),({QUOTED}|{BARE})"
#: Patterns of an ASCII decimal number and integer, possessive.
_NUM, _INT = r"[+-]?+(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+", "[0-9]++"


def _maybe_quoted(pattern: str) -> str:
    return rf'[ \t]*+(?:{pattern}|"{pattern}")[ \t]*+'


#: A conforming line, but for its width and the size of its values.
TXT_GOOD = rf"\A[ \t]*+{_INT}[ \t]++{_INT}(?:[ \t]++{_NUM})*+[ \t]*+\z"
CSV_GOOD = rf"\A,{_maybe_quoted(_INT)},{_maybe_quoted(_INT)},(?:{QUOTED}|{BARE})(?:,{_maybe_quoted(_NUM)})*+\z"
#: Without an exponent or 38 digits in a row no number exceeds a 32-bit float.
LARGE = "[eE]|[0-9]{38}"


def _prepared(raw: DataFrame, subgraph: DataFrame) -> DataFrame:
    """Lines with the metadata their check needs. The join is left to Catalyst and AQE."""
    meta = subgraph.select(F.col("subgraph_id").alias("_sid"), "nfeats", "nlabels").dropDuplicates(["_sid"])
    body = F.regexp_replace(F.coalesce("line", F.lit("")), r"\r\z", "")
    return (
        raw.select("raw_id", "subgraph_id", (F.coalesce(F.lower("fmt"), F.lit("txt")) == "csv").alias("is_csv"), body.alias("body"))
        .join(meta, F.col("subgraph_id") == F.col("_sid"), "left")
        .drop("_sid")
    )


def _csv_fields(body: Column) -> Column:
    """Fields of a csv line that obeys the quoting rule, outer quotes removed."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(CSV_FIELD), F.lit(1))
    return F.transform(parts, _unquoted)


def _csv_ok(body: Column) -> Column:
    return F.concat(F.lit(","), body).rlike(CSV_LINE)


def _unquoted(part: Column) -> Column:
    trimmed = F.btrim(part, F.lit(" \t"))
    inner = F.regexp_replace(F.regexp_replace(trimmed, r'(?s)\A"(.*)"\z', "$1"), '""', '"')
    return F.when(trimmed.startswith('"'), inner).otherwise(trimmed)


def _txt_fields(body: Column) -> Column:
    trimmed = F.btrim(body, F.lit(" \t"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t]+"))


def _with_fields(lines: DataFrame) -> DataFrame:
    """Adds ``fields`` and the numbers cast from the feature fields."""
    fields = F.when(F.col("is_csv"), _csv_fields(F.col("body"))).otherwise(_txt_fields(F.col("body")))
    first = F.when(F.col("is_csv"), F.lit(4)).otherwise(F.lit(3))
    return lines.withColumn("fields", fields).withColumn("feats", F.slice("fields", first, F.greatest(F.size("fields"), F.lit(0))))


def _label_ok(label: Column) -> Column:
    value = label.try_cast("decimal(38,0)")
    tall = F.length(F.regexp_replace(label, "^0+", "")) > 18
    return label.rlike(rf"\A{DIGITS}\z") & (F.col("nlabels").isNull() | (~tall & (value <= F.col("nlabels"))))


def _width_ok() -> Column:
    extra = F.when(F.col("is_csv"), F.lit(3)).otherwise(F.lit(2))
    return F.coalesce(F.size("fields") == F.col("nfeats") + extra, F.lit(False))


def strict_load(raw: DataFrame, subgraph: DataFrame) -> DataFrame:
    """The conforming rows: ``raw_id, subgraph_id, position, truelabel, feat``.

    ``position`` is a decimal wide enough for any digit string of the id up to 38 places;
    longer ids load with a null position.
    """
    return _loaded(_prepared(raw, subgraph))


def _loaded(lines: DataFrame) -> DataFrame:
    conforms = F.when(F.col("is_csv"), F.concat(F.lit(","), F.col("body")).rlike(CSV_GOOD)).otherwise(F.col("body").rlike(TXT_GOOD))
    shaped = _with_fields(lines.filter(conforms))
    in_range = ~F.col("body").rlike(LARGE) | F.forall("feats", lambda v: F.abs(v.try_cast("double")) <= FLOAT_MAX)
    good = _width_ok() & _label_ok(F.element_at("fields", 2)) & in_range
    # a case: element_at must not run on lines that are too short
    return shaped.filter(F.when(_width_ok(), good).otherwise(False)).select(
        "raw_id",
        "subgraph_id",
        F.element_at("fields", 1).try_cast("decimal(38,0)").alias("position"),
        F.element_at("fields", 2).try_cast("int").alias("truelabel"),
        F.col("feats").cast("array<float>").alias("feat"),
    )


def rejected(raw: DataFrame, subgraph: DataFrame) -> DataFrame:
    """The other rows: ``raw_id, reason``, the first reason that applies.

    The order is ``quoting, columns, ident, label, feature``.
    """
    lines = _prepared(raw, subgraph)
    rest = lines.join(_loaded(lines).select("raw_id"), "raw_id", "left_anti")
    broken = F.col("is_csv") & ~_csv_ok(F.col("body"))
    shaped = _with_fields(rest.withColumn("broken", broken).withColumn("body", F.when(F.col("broken"), "").otherwise(F.col("body"))))
    reason = (
        F.when(F.col("broken"), "quoting")
        .when(~_width_ok(), "columns")
        .when(~F.element_at("fields", 1).rlike(rf"\A{DIGITS}\z"), "ident")
        .when(~_label_ok(F.element_at("fields", 2)), "label")
        .otherwise("feature")
    )
    return shaped.select("raw_id", reason.alias("reason")).distinct()
