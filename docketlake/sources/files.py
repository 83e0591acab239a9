"""Readers: tolerant JSON, folders of records, logs with torn lines, registries with hashes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_DECODER = json.JSONDecoder()


def json_values(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(offset, value as JSON, error) of a file that is an array, JSON lines or objects one after another.

    Where a value can't be read, its offset and the error are given and reading goes on at the next '{'; nothing is
    repaired.
    """
    at, n = 0, len(text)
    inside = False
    while at < n:
        c = text[at]
        if c.isspace() or c == ",":
            at += 1
        elif c == "[" and not inside:
            inside, at = True, at + 1
        elif c == "]" and inside:
            inside, at = False, at + 1
        else:
            try:
                value, end = _DECODER.raw_decode(text, at)
                yield at, json.dumps(value, ensure_ascii=False), None
                at = end
            except ValueError as e:
                yield at, None, str(e)
                at = text.find("{", at + 1)
                if at < 0:
                    return


def tolerant_json(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, idx, offset, value, error) of all *.json* files under a path, in Arrow batches, one file a row of input."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json*").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = list(json_values(content.decode("utf-8", "replace")))
                yield pd.DataFrame([(name, i, *r) for i, r in enumerate(rows)], columns=["file", "idx", "offset", "value", "error"])

    return raw.mapInPandas(run, "file string, idx int, offset long, value string, error string")


def records(spark: SparkSession, path: str, schema: StructType | str, recursive: bool = True) -> DataFrame:
    """Typed JSON lines with their file's name and the raw text of lines that don't fit (null otherwise)."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json*").text(path)
    wide = StructType([*kind.fields, StructField("_bad", StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.filter(F.trim("value") != "").select(parsed.alias("r"), "value", F.col("_metadata.file_name").alias("file"))
    return rows.select("r.*", "file")


def log_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines log; lines that can't be read, such as a half-written last one, are skipped."""
    return records(spark, path, schema).filter("_bad is null").drop("_bad", "file")


def undocumented_fields(raw: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(field, n): top-level keys of JSON objects that the schema doesn't name."""
    keys = F.explode(F.json_object_keys(column))
    return raw.select(keys.alias("field")).filter(~F.col("field").isin(known)).groupBy("field").agg(F.count("*").alias("n"))


def registry(spark: SparkSession, path: str, pinned: DataFrame) -> DataFrame:
    """(file, sha256, ok): files under a path against their pinned hashes (file, sha256); files without one are not ok."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return found.join(pinned.withColumnRenamed("sha256", "want"), "file", "left").select("file", "sha256", F.coalesce(F.col("sha256") == F.col("want"), F.lit(False)).alias("ok"))


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Writes a table as a new snapshot folder; readers of older ones are not disturbed."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def append_trace(df: DataFrame, path: str) -> None:
    """Appends events as JSON lines, one part a task."""
    df.write.mode("append").json(path)


def markdown_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line) of a table as Markdown, head first, in the order given; a report of any size, written in Spark."""
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    cells = F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns])
    body = df.select(F.struct(*order).alias("o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    # A global order without a single task: rows of equal rank by range partition, numbered by their partition's offset.
    ordered = body.orderBy("o").select("line", F.monotonically_increasing_id().alias("line_no"))
    top = df.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "line_no long, line string")
    return top.unionByName(ordered.select("line_no", "line"))


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A report as one Markdown text, whole; for tables that fit a page. Larger ones are written by markdown_rows."""
    return "".join(r.line + "\n" for r in markdown_rows(df, order).orderBy("line_no").toLocalIterator())
