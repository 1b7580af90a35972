"""Docket storage: JSON documents, upserts, deletes, search rows and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.filters import first_filled

PRODUCT_INFO = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("commodity_name", T.StringType()),
    T.StructField("batch_number", T.StringType()),
    T.StructField("manufacturer", T.StructType([T.StructField("full_address", T.StringType())])),
])
CHECK = T.StructType([
    T.StructField("rule_no", T.StringType()),
    T.StructField("sub_rule", T.StringType()),
    T.StructField("rule_title", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detected_declaration", T.StringType()),
    T.StructField("section_penalty", T.StringType()),
    T.StructField("surface", T.StringType()),
])
CANONICAL = T.StructType([
    T.StructField("field_name", T.StringType()),
    T.StructField("statutory_name", T.StringType()),
    T.StructField("extracted_value", T.StringType()),
    T.StructField("rule_reference", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
DOCKET = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("overall_status", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("compliance_score", T.IntegerType()),
    T.StructField("complianceScore", T.IntegerType()),
    T.StructField("officer_notes", T.StringType()),
    T.StructField("officerNotes", T.StringType()),
    T.StructField("final_decision", T.StringType()),
    T.StructField("finalDecision", T.StringType()),
    T.StructField("product_info", PRODUCT_INFO),
    T.StructField("compliance_checks", T.ArrayType(CHECK)),
    T.StructField("canonical_fields", T.ArrayType(CANONICAL)),
])


def parse_dockets(raw: DataFrame, json_col: str = "docket_json") -> DataFrame:
    """JSON text to a typed struct; text that is not JSON becomes an empty docket."""
    return raw.withColumn("docket", F.from_json(F.col(json_col), DOCKET, {"mode": "PERMISSIVE"}))


def docket_row(parsed: DataFrame) -> DataFrame:
    """Stored columns of a parsed docket, each with its chain of fallbacks.

    A score of zero stays zero; only an absent score becomes 100.
    """
    d = lambda name: F.col(f"docket.{name}")
    return parsed.select(
        first_filled(d("scan_id"), d("id")).alias("id"),
        first_filled(d("product_name"), d("productName"), d("product_info.product_name"), default="Packaged Commodity").alias("product_name"),
        first_filled(d("brand"), d("product_info.brand"), default="").alias("brand"),
        first_filled(d("product_info.manufacturer.full_address"), d("manufacturer"), default="").alias("manufacturer"),
        first_filled(d("overall_status"), d("status"), default="COMPLIANT").alias("overall_status"),
        F.coalesce(d("compliance_score"), d("complianceScore"), F.lit(100)).alias("compliance_score"),
        first_filled(d("officer_notes"), d("officerNotes"), default="").alias("officer_notes"),
        first_filled(d("final_decision"), d("finalDecision"), default="Draft").alias("final_decision"),
        *[c for c in parsed.columns if c not in ("docket",)],
    )


def latest_per_id(rows: DataFrame, key: str, seq: Column) -> DataFrame:
    """Upsert semantics over a change log: the last write of each key wins.

    ``max_by`` combines map-side, so a key with very many versions never lands
    in one task as raw rows.
    """
    payload = F.struct(*[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(payload, seq).alias("r")).select(key, "r.*")


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", seq_col: str = "seq") -> DataFrame:
    return latest_per_id(current.unionByName(changes, allowMissingColumns=True), key, F.col(seq_col))


def cascade_delete(dead: DataFrame, key: str, tables: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Remove the keys in ``dead`` from each table: name -> (frame, key column)."""
    out = {}
    for name, (frame, column) in tables.items():
        out[name] = frame.join(dead.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return out


def by_id(dockets: DataFrame, wanted: str) -> DataFrame:
    return dockets.filter(F.col("id") == wanted)


def search_rows(scans: DataFrame) -> DataFrame:
    """Rows of the search table, ready for an append-mode write."""
    return scans.select("scan_id", "product_name", "manufacturer", "ocr_text", "overall_status", "compliance_score", "ts")


def append_search_rows(scans: DataFrame, path: str) -> None:
    search_rows(scans).write.mode("append").parquet(path)


def quoted(col: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*columns: str) -> Column:
    """One CSV record with every value quoted and quotes doubled."""
    return F.concat_ws(",", *[quoted(F.col(c)) for c in columns])


def export_audit_csv(audit: DataFrame, path: str) -> None:
    (audit.write.mode("overwrite").option("header", True).option("quoteAll", True)
        .option("quote", '"').option("escape", '"').csv(path))


def annotation_json(scans: DataFrame) -> DataFrame:
    """Annotation document per scan from a ``shapes`` array column.

    The array belongs to one image row, so no grouping is needed.
    """
    return scans.select(
        "scan_id",
        F.to_json(F.struct(F.lit("5.0.1").alias("version"), F.col("image_id").alias("imagePath"), F.col("shapes"))).alias("document"),
    )


def add_late_columns(old: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Add columns that older files lack, with a default for old rows."""
    out = old
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in old.columns else F.lit(value))
    return out


def inspection_records(api_rows: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Rows from the docket list that are not known yet, reshaped as inspections."""
    fresh = api_rows.join(known_ids.select(F.col("id")).distinct(), "id", "left_anti")
    failed = F.filter(F.coalesce(F.col("docket.compliance_checks"), F.array().cast(T.ArrayType(CHECK))), lambda c: c["status"] == "FAIL")
    return fresh.select(
        "id",
        F.date_format("created_at", "yyyy-MM-dd").alias("date"),
        first_filled(F.col("product_name"), F.col("docket.product_info.product_name"), default="Packaged Commodity").alias("product_name"),
        first_filled(F.col("docket.product_info.commodity_name"), default="Packaged Commodity").alias("category"),
        first_filled(F.col("manufacturer"), F.col("docket.product_info.manufacturer.full_address"), default="").alias("manufacturer"),
        F.coalesce(F.col("docket.product_info.batch_number"), F.lit("")).alias("batch_number"),
        "status", "compliance_score",
        F.transform(failed, lambda c, i: F.struct(
            F.concat(F.lit("VIO-DB-"), c["rule_no"], F.lit("-"), i.cast("string")).alias("violation_id"),
            c["rule_title"].alias("violation_type"),
            F.concat(c["rule_no"], F.lit(" ("), c["sub_rule"], F.lit(")")).alias("rule_reference"),
            F.lit("High").alias("severity"),
        )).alias("violations"),
    )


