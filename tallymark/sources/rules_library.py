"""The rule book as a table: JSON library, standard rules, lookups by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: canonical names of the numbered declarations of rule 6
RULE_ALIASES = {
    "RULE_06_1_A": "RULE_06_NAME_ADDRESS",
    "RULE_06_1_B": "RULE_06_PRODUCT_NAME",
    "RULE_06_1_C": "RULE_06_NET_QUANTITY",
    "RULE_06_1_D": "RULE_06_DATE",
    "RULE_06_1_E": "RULE_06_MRP",
    "RULE_06_1_F": "RULE_06_CONSUMER_CARE",
    "RULE_06_1_EA": "RULE_06_COUNTRY_ORIGIN",
    "RULE_06_1_G": "RULE_06_BATCH",
}

# fixed values: the standard rules, used where no library file is given
STANDARD_RULES = [
    ("RULE_06_NAME_ADDRESS", "Rule 6(1)(a)", "6(1)(a)", "Name and address of Manufacturer/Packer/Importer"),
    ("RULE_06_PRODUCT_NAME", "Rule 6(1)(b)", "6(1)(b)", "Generic or common name of commodity"),
    ("RULE_06_NET_QUANTITY", "Rule 6(1)(c)", "6(1)(c)", "Net quantity declaration"),
    ("RULE_06_DATE", "Rule 6(1)(d)", "6(1)(d)", "Month and year of manufacture/packing/import"),
    ("RULE_06_MRP", "Rule 6(1)(e)", "6(1)(e)", "Maximum Retail Price (MRP)"),
    ("RULE_06_CONSUMER_CARE", "Rule 6(2)", "6(2)", "Consumer Care contact details"),
    ("RULE_06_COUNTRY_ORIGIN", "Rule 6(1)(ea)", "6(1)(ea)", "Country of Origin for imported products"),
]

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_number", T.StringType()),
    T.StructField("sub_rule", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("requirement_type", T.StringType()),
    T.StructField("required_fields", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("market_context", T.StringType()),
    T.StructField("effective_from", T.DateType()),
    T.StructField("effective_until", T.DateType()),
    T.StructField("verification_status", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_version", T.StringType()),
])

LIBRARY_ENTRY = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("rule_id", "rule_no", "sub_rule", "rule_title", "applicable_category", "required_declaration",
              "validation_condition", "exception_condition", "source", "version_date", "verification_status",
              "penal_provision", "compounding_fee")
])
LIBRARY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("statutory_act", T.StringType()),
    T.StructField("statutory_rules", T.StringType()),
    T.StructField("rules", T.ArrayType(LIBRARY_ENTRY)),
])


def canonical_rule_id(rule_id: Column) -> Column:
    upper = F.upper(rule_id)
    out = upper
    for old, new in RULE_ALIASES.items():
        out = F.when(upper == old, F.lit(new)).otherwise(out)
    return out


def _mentions(title: Column, *words: str) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(F.lower(title), F.lit(w))
    return test


def required_fields(title: Column) -> Column:
    """Fields a rule asks for.  Only the title decides."""
    arr = lambda *names: F.array(*[F.lit(n) for n in names])
    return (
        F.when(_mentions(title, "name and complete address"), arr("MANUFACTURER_NAME", "MANUFACTURER_ADDRESS"))
        .when(_mentions(title, "common or generic name"), arr("PRODUCT_NAME"))
        .when(_mentions(title, "net quantity"), arr("NET_QUANTITY"))
        .when(_mentions(title, "month and year"), arr("MANUFACTURING_DATE"))
        .when(_mentions(title, "maximum retail price", "mrp"), arr("MRP"))
        .when(_mentions(title, "consumer care"), arr("CONSUMER_CARE"))
        .when(_mentions(title, "country of origin"), arr("IMPORTER_NAME", "IMPORTER_ADDRESS", "COUNTRY_OF_ORIGIN"))
        .when(_mentions(title, "batch"), arr("BATCH_NUMBER"))
        .otherwise(arr("PRODUCT_NAME"))
    )


def requirement_type(title: Column) -> Column:
    return (
        F.when(_mentions(title, "country of origin"), "IMPORTER")
        .when(_mentions(title, "net quantity"), "NET_QUANTITY")
        .when(_mentions(title, "price"), "MRP")
        .when(_mentions(title, "consumer care"), "CONSUMER_CARE")
        .otherwise("DECLARATION")
    )


def verification(status: Column) -> Column:
    word = F.upper(F.coalesce(status, F.lit("MANDATORY")))
    return (
        F.when(word.isin("UNVERIFIED", "DRAFT"), "UNVERIFIED")
        .when(word.isin("SUPERSEDED", "EXPIRED"), "SUPERSEDED")
        .otherwise("VERIFIED")
    )


def derive_rules(library: DataFrame) -> DataFrame:
    """Library documents to rule rows with derived type, fields and status."""
    rows = library.select("version", F.inline("rules"))
    title = F.coalesce(F.col("rule_title"), F.lit("General Rule"))
    return rows.select(
        canonical_rule_id(F.coalesce(F.col("rule_id"), F.lit("RULE_01"))).alias("rule_id"),
        F.coalesce(F.col("rule_no"), F.lit("RULE 1")).alias("rule_number"),
        "sub_rule",
        title.alias("title"),
        requirement_type(title).alias("requirement_type"),
        required_fields(title).alias("required_fields"),
        F.array(F.lit("ALL")).alias("categories"),
        F.lit("RETAIL").alias("market_context"),
        F.try_to_date(F.coalesce(F.col("version_date"), F.lit("2011-03-07")), "yyyy-MM-dd").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_until"),
        verification(F.col("verification_status")).alias("verification_status"),
        F.coalesce(F.col("source"), F.lit("Gazette of India")).alias("source_name"),
        F.coalesce(F.col("version"), F.lit("2024.1")).alias("source_version"),
    )


def read_rule_library(spark: SparkSession, path: str) -> DataFrame:
    return derive_rules(spark.read.schema(LIBRARY_SCHEMA).option("multiLine", True).json(path))


def standard_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules, with explicit types and fields by rule id."""
    rows = spark.createDataFrame(STANDARD_RULES, "rule_id string, rule_number string, sub_rule string, title string")
    rid = F.col("rule_id")
    arr = lambda *names: F.array(*[F.lit(n) for n in names])
    kind = (F.when(rid == "RULE_06_NET_QUANTITY", "NET_QUANTITY").when(rid == "RULE_06_MRP", "MRP")
            .when(rid == "RULE_06_CONSUMER_CARE", "CONSUMER_CARE").when(rid == "RULE_06_COUNTRY_ORIGIN", "IMPORTER")
            .otherwise("DECLARATION"))
    fields = (F.when(rid == "RULE_06_NAME_ADDRESS", arr("MANUFACTURER_NAME", "MANUFACTURER_ADDRESS"))
              .when(rid == "RULE_06_NET_QUANTITY", arr("NET_QUANTITY")).when(rid == "RULE_06_DATE", arr("MANUFACTURING_DATE"))
              .when(rid == "RULE_06_MRP", arr("MRP")).when(rid == "RULE_06_CONSUMER_CARE", arr("CONSUMER_CARE"))
              .when(rid == "RULE_06_COUNTRY_ORIGIN", arr("COUNTRY_OF_ORIGIN")).otherwise(arr("PRODUCT_NAME")))
    return rows.select(
        "rule_id", "rule_number", "sub_rule", "title", kind.alias("requirement_type"), fields.alias("required_fields"),
        arr("ALL").alias("categories"), F.lit("RETAIL").alias("market_context"),
        F.lit("2011-03-07").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_until"),
        F.lit("VERIFIED").alias("verification_status"), F.lit("Gazette of India").alias("source_name"),
        F.lit("2024.1").alias("source_version"),
    )


def latest_rules(rules: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per rule id; the last registration wins when ``seq`` is given."""
    if seq is None:
        return rules.dropDuplicates(["rule_id"])
    body = F.struct(*[F.col(c) for c in rules.columns if c not in ("rule_id", seq)])
    return rules.groupBy("rule_id").agg(F.max_by(body, F.col(seq)).alias("r")).select("rule_id", "r.*")


def find_rule(rules: DataFrame, wanted: str) -> DataFrame:
    """By id, alias, rule number or sub-rule."""
    word = wanted.strip().upper()
    alias = RULE_ALIASES.get(word, word)
    return rules.filter(
        F.col("rule_id").isin(word, alias)
        | (F.upper(F.trim("rule_number")) == word)
        | (F.upper(F.trim("sub_rule")) == word)
    )
