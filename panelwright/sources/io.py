"""Readers and writers around Spark's own."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_parts(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Parquet files with differing columns as one table; an unexpected number of files is an error."""
    table = spark.read.option("mergeSchema", True).parquet(path)
    if files is not None and (found := len(table.inputFiles())) != files:
        raise ValueError(f"expected {files} files, found {found}")
    return table


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped; the file's name is ``source_file``.

    Columns are strings unless ``schema`` types them by name; what doesn't fit its type is null.
    """
    table = spark.read.csv(path, header=True)
    table = table.withColumnsRenamed({c: c.lstrip("\ufeff") for c in table.columns if c.startswith("\ufeff")})
    typed = {f.name: f.dataType for f in StructType.fromDDL(schema).fields} if schema else {}
    return table.select(*[F.col(c).try_cast(typed[c]).alias(c) if c in typed else F.col(c) for c in table.columns], F.col("_metadata.file_name").alias("source_file"))


def read_label_files(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Label files of years or months, whose columns may differ, as one table."""
    tables = [read_csv(spark, p, schema) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def flattened(table: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> list:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, StructType):
                out += leaves(field.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return table.select(*leaves(table.schema, ()))


def read_payload(spark: SparkSession, path: str, rows: str = "data") -> DataFrame:
    """Rows of an array inside JSON documents, flattened."""
    table = spark.read.json(path, multiLine=True)
    if not isinstance(table.schema[rows].dataType, ArrayType):
        raise ValueError(f"{rows} is no array")
    return flattened(table.select(F.explode(rows).alias("_r")).select("_r.*"))


def read_variant(spark: SparkSession, path: str, rows: str = "data") -> DataFrame:
    """Each row of an array inside JSON documents as a variant column ``row``; files may disagree on fields and types. A document that is no JSON, or lacks the array, gives none."""
    text = spark.read.text(path, wholetext=True)
    return variant_rows(text, "value", rows)


def variant_rows(table: DataFrame, c: str, rows: str | None = None) -> DataFrame:
    """The JSON texts of a column, or the rows of an array in each, as a variant column ``row`` beside the other columns."""
    value = F.try_parse_json(F.col(c))
    others = [x for x in table.columns if x != c]
    if rows is None:
        return table.select(*others, value.alias("row")).where("row is not null")
    return table.select(*others, F.explode(F.try_variant_get(value, f"$.{rows}", "array<variant>")).alias("row"))


def variant_fields(table: DataFrame, c: str = "row") -> dict[str, str]:
    """Dotted names of all fields that the variants have, and the type of each that holds all its values; text where they disagree."""
    found = table.agg(F.schema_of_variant_agg(c)).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return {}

    def leaves(text: str, path: str) -> dict[str, str]:
        out: dict[str, str] = {}
        depth, start, parts = 0, 0, []
        for i, ch in enumerate(text):
            depth += (ch == "<" or ch == "(") - (ch == ">" or ch == ")")
            if ch == "," and not depth:
                parts.append(text[start:i])
                start = i + 1
        for part in filter(str.strip, [*parts, text[start:]]):
            name, kind = (x.strip() for x in part.split(":", 1))
            name = f"{path}.{name.strip('`')}" if path else name.strip("`")
            if kind.startswith("OBJECT<"):
                out |= leaves(kind[7:-1], name)
            else:
                out[name] = "string" if kind in ("VARIANT", "VOID") or kind.startswith("ARRAY") else kind.lower()
        return out

    return leaves(found[7:-1], "")


def flattened_variant(table: DataFrame, c: str = "row", fields: dict[str, str] | None = None) -> DataFrame:
    """The variant's fields as columns with dotted names, nulls where a row lacks one; ``fields`` is ``variant_fields`` unless given.

    A field whose values differ in type is text, and so is an array.
    """
    fields = variant_fields(table, c) if fields is None else fields
    path = lambda name: "$" + "".join(f'["{p}"]' for p in name.split("."))
    taken = [F.try_variant_get(c, path(n), k).alias(n) for n, k in fields.items()]
    return table.select(*[x for x in table.columns if x != c], *taken)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header after a byte order mark, as spreadsheets expect UTF-8."""
    table = table.withColumnRenamed(table.columns[0], "\ufeff" + table.columns[0])
    table.write.mode("overwrite").option("header", True).csv(path)


def audit_json(audit: DataFrame) -> DataFrame:
    """Each row of a summary as one JSON text in ``value``."""
    return audit.select(F.to_json(F.struct("*")).alias("value"))


def write_audit(audit: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    audit_json(audit).write.mode("overwrite").text(path)


def write_panel(panel: DataFrame, path: str, date: str) -> None:
    """Parquet in a folder for each year; rows of a null date are in the folder of no year."""
    panel.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, ``spark.checkpoint.dir``.

    Where that is unset, local mode takes a temporary folder and a cluster the warehouse.
    """
    if (where := spark.conf.get("spark.checkpoint.dir", None)) is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        where = tempfile.mkdtemp(prefix="panelwright-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read back, so that it isn't worked out twice and outlives executors."""
    path = shared_path(table.sparkSession, "kept")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
