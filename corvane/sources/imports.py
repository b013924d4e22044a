"""Imports that report errors by row instead of failing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.scope import CASTS


def manifest(rows: DataFrame, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """A metadata manifest's rows (row_no, file_name, one string column for each field) with typed fields and errors.

    ``fields`` maps a name to its type and whether it is required. A value that
    can't be read as its type, a missing required value and a file name seen
    before (whatever its case) are errors; the row of the first is named.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    errors = [F.when(blank("file_name"), F.lit("file_name: missing"))]
    first = F.min("row_no").over(Window.partitionBy(F.lower(F.trim("file_name"))))
    errors.append(F.when(~blank("file_name") & (first < F.col("row_no")), F.concat(F.lit("file_name: first in row "), first.cast("string"))))
    typed = []
    for name, (kind, required) in fields.items():
        value = F.trim(name).try_cast(CASTS[kind]) if kind != "TEXT_LIST" else F.filter(F.transform(F.split(name, ","), lambda x: F.trim(x)), lambda x: x != "")
        typed.append(value.alias(name))
        if required:
            errors.append(F.when(blank(name), F.lit(f"{name}: missing")))
        errors.append(F.when(~blank(name) & value.isNull(), F.lit(f"{name}: not {kind.lower()}")))
    return rows.select("row_no", F.trim("file_name").alias("file_name"), *typed, F.array_compact(F.array(*errors)).alias("errors"))


def resolve_keys(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (row_no, key) with the one document whose key they name; none or several is an error."""
    found = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"))
    out = rows.join(found, "key", "left")
    error = F.when(F.col("n").isNull(), "not found").when(F.col("n") > 1, "ambiguous")
    return out.select("row_no", "key", F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"), error.alias("error"))


def check_header(columns: list[str], known: list[str], required: list[str]) -> list[str]:
    """What is wrong with a header: unknown, repeated and missing columns, in that order."""
    names = [c.strip().lower() for c in columns]
    unknown = [f"unknown column: {c}" for c in names if c not in known]
    twice = [f"repeated column: {c}" for c in dict.fromkeys(names) if names.count(c) > 1]
    return unknown + twice + [f"missing column: {c}" for c in required if c not in names]


def repeated_questions(cases: DataFrame) -> DataFrame:
    """Normalised questions that a bundle holds more than once, with the first case and how many."""
    norm = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    return cases.groupBy(norm.alias("question")).agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_case")).where("n > 1")


def write_bundle(cases: DataFrame, path: str) -> None:
    """A data set of cases as JSON lines."""
    cases.write.json(path)


def read_bundle(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
