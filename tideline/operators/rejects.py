"""Rows that fail to parse: delimited lines split into loaded rows and rejected rows with every reason.

All columns are first nullable text; cast and constraint rules then fill an array of errors per row, and rows with an
empty array are the loaded ones. Everything is a column expression, linear in the line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field: enclosed in double quotes with those inside doubled, or without any. Possessive, so that a line is read once and no recursion grows with it.
FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?$"
#: The order in which reasons apply.
REASONS = ("quoting", "columns", "timestamp", "value")


def clean(line: Column) -> Column:
    """Without carriage returns at the end and a byte order mark at the start."""
    return F.regexp_replace(F.regexp_replace(line, r"\r+$", ""), "^\\uFEFF", "")


def fields(line: Column) -> Column:
    """The fields of a line one after the other, quotes and all. They make up the whole line only if its quoting is right."""
    return F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(f"({FIELD}),"), F.lit(1))


def quoting_ok(line: Column, cells: Column) -> Column:
    """A field with a quote is enclosed in quotes and doubles those inside: then nothing of the line lies between its fields."""
    return F.array_join(cells, ",") == line


def bare(field: Column) -> Column:
    """The text of a field."""
    return F.when(field.startswith('"'), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def as_time(text: Column) -> Column:
    """The timestamp of a text, or null if it names no existing one."""
    return F.when(text.rlike(TIME), F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def as_number(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "nan", F.lit(float("nan"))).when(text.rlike(NUMBER), text.try_cast("double"))


def parsed(lines: DataFrame) -> DataFrame:
    """file_no, line_no, label, timestamp, value, note, category, errors: one row per line after the header.

    ``errors`` holds every reason that applies, in the order of REASONS. A null or blank line has no columns to load
    ('columns'). The header (line 1) gives the columns and their order; where it is missing, null or has no ``timestamp`` or
    ``value``, its lines have the reason 'columns'. If a (file_no, line_no) is repeated with other contents, the largest line stays, nulls smallest. Rows
    without file_no or line_no are left out. An empty table gives no rows.
    """
    rows = lines.where("file_no is not null and line_no is not null").groupBy(F.col("file_no").cast("long").alias("file_no"), F.col("line_no").cast("long").alias("line_no")).agg(F.max(F.struct("line", "label")).alias("r"))
    rows = rows.select("file_no", "line_no", "r.label", clean(F.col("r.line")).alias("line"))
    head = rows.where("line_no = 1").select("file_no", F.transform(fields(F.col("line")), lambda x: F.lower(F.trim(bare(x)))).alias("names"))
    head = head.select("file_no", F.size("names").alias("wanted"), *(F.array_position("names", F.lit(c)).cast("int").alias(f"at_{c}") for c in ("timestamp", "value", "category", "note")))
    df = rows.where("line_no > 1").withColumn("cells", fields(F.col("line"))).withColumn("good", F.coalesce(quoting_ok(F.col("line"), F.col("cells")), F.lit(True)))
    df = df.join(head, "file_no", "left")
    text = lambda c: F.when(F.col("good") & (F.col(f"at_{c}") > 0), bare(F.try_element_at("cells", F.col(f"at_{c}"))))
    df = df.select("file_no", "line_no", "label", "good", F.trim(F.col("line")).alias("stripped"), F.size("cells").alias("n"), "wanted", *(F.trim(text(c)).alias(f"{c}_text") for c in ("timestamp", "value")), *(text(c).alias(c) for c in ("category", "note")), (F.coalesce(F.col("at_timestamp"), F.lit(0)) > 0).alias("has_t"), (F.coalesce(F.col("at_value"), F.lit(0)) > 0).alias("has_v"))
    df = df.withColumn("timestamp", as_time(F.col("timestamp_text"))).withColumn("value", as_number(F.col("value_text")))
    columns_ok = F.coalesce((F.col("stripped") != "") & (F.col("n") == F.col("wanted")) & F.col("has_t") & F.col("has_v"), F.lit(False))
    rules = (("quoting", F.col("good")), ("columns", ~F.col("good") | columns_ok), ("timestamp", F.col("timestamp").isNotNull()), ("value", F.col("value").isNotNull()))
    errors = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules)))
    return df.select("file_no", "line_no", "label", "timestamp", "value", "category", "note", errors.alias("errors"))


def loaded(lines: DataFrame) -> DataFrame:
    """The rows without errors: file_no, line_no, label, timestamp, value, category, note."""
    return parsed(lines).where(F.size("errors") == 0).drop("errors")


def rejected(lines: DataFrame) -> DataFrame:
    """file_no, line_no, reason (the first that applies), reasons (all of them)."""
    return parsed(lines).where(F.size("errors") > 0).select("file_no", "line_no", F.col("errors")[0].alias("reason"), F.col("errors").alias("reasons"))
