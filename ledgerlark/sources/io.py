"""File imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.text import non_blank
from ledgerlark.sources.records import read_csv

# fixed values: column names (lower case, separators removed) that tell a record's type
PERSON_COLUMNS = ("email", "firstname", "lastname")
PROFILE_COLUMNS = ("linkedinurl", "personlinkedin", "personallinkedin", "profileurl")
COMPANY_COLUMNS = ("company", "companyname", "website", "companywebsite", "domain")


def write_contact_export(df: DataFrame, path: str) -> None:
    """CSV with a header; one file per task, so any size is written in parallel. Blanks at the ends of values stay."""
    writer = df.write.mode("error").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _columns(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    plain = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    return [F.col(f"`{c}`") for c in df.columns if plain(c) in names]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def raw_records(df: DataFrame, list_id: str) -> DataFrame:
    """Rows -> raw JSON records with a type: person, company or unknown."""
    person = _any([non_blank(c.cast("string")).isNotNull() for c in _columns(df, PERSON_COLUMNS)])
    profile = _any([c.cast("string").contains("/in/") for c in _columns(df, PROFILE_COLUMNS)])
    company = _any([non_blank(c.cast("string")).isNotNull() for c in _columns(df, COMPANY_COLUMNS)])
    kind = F.when(person | profile, "person").when(company, "company").otherwise("unknown")
    return df.select(
        F.lit(list_id).alias("list_id"), F.to_json(F.struct("*")).alias("raw_data"), kind.alias("record_type"), F.lit("pending").alias("import_status")
    )


def import_csv_records(spark: SparkSession, path: str, list_id: str, multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """CSV rows -> raw records; every column stays text.

    Files are split over tasks, also where quoted fields hold line breaks. Without `multi_line` the caller
    says that they hold none, which saves a pass; with `whole_files` a task reads a whole file.
    """
    if multi_line and not whole_files:
        return raw_records(read_csv(spark, path), list_id)
    rows = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return raw_records(rows, list_id)


def explode_json_array(df: DataFrame, column: str, schema: str | T.DataType) -> DataFrame:
    """A JSON array column -> one row per item, with the item's fields as columns."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    items = F.from_json(column, f"array<{ddl}>")
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(items).alias("_item")).select(*others, "_item.*")
