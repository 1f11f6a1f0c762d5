"""Ice-chart and risk-index dimension tables: fixed values and readers of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: published risk index values (IMO MSC.1/Circ.1519) -----------
ICE_TYPES = [
    "Ice-Free", "New Ice", "Grey Ice", "Grey White Ice", "Thin First Year Ice 1st Stage",
    "Thin First Year Ice 2nd Stage less than 1 m thick", "Medium First Year Ice",
    "Medium First Year Ice less than 1 m thick", "Thick First Year Ice", "Second Year Ice",
    "Light Multi Year Ice less than 2.5 m thick", "Heavy Multi Year Ice"]
RIV_STANDARD = {
    "PC1": [3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1],
    "PC2": [3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1, 0],
    "PC3": [3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 0, -1],
    "PC4": [3, 3, 3, 3, 2, 2, 2, 2, 1, 0, -1, -2],
    "PC5": [3, 3, 3, 3, 2, 2, 1, 1, 0, -1, -2, -2],
    "PC6": [3, 2, 2, 2, 2, 1, 1, 0, -1, -2, -3, -3],
    "PC7": [3, 2, 2, 2, 1, 1, 0, -1, -2, -3, -3, -3],
    "IA Super": [3, 2, 2, 2, 2, 1, 0, -1, -2, -3, -4, -4],
    "IA": [3, 2, 2, 2, 1, 0, -1, -2, -3, -4, -5, -5],
    "IB": [3, 2, 2, 1, 0, -1, -2, -3, -4, -5, -6, -6],
    "IC": [3, 2, 1, 0, -1, -2, -3, -4, -5, -6, -7, -8],
    "Not Ice Strengthened": [3, 1, 0, -1, -2, -3, -4, -5, -6, -7, -8, -8]}
RIV_DECAYED = {
    "PC1": [3, 3, 3, 3, 2, 2, 2, 2, 2, 2, 1, 1],
    "PC2": [3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 1, 0],
    "PC3": [3, 3, 3, 3, 2, 2, 2, 2, 2, 1, 0, -1],
    "PC4": [3, 3, 3, 3, 2, 2, 2, 2, 1, 0, -1, -2],
    "PC5": [3, 3, 3, 3, 2, 2, 2, 2, 1, -1, -2, -2],
    "PC6": [3, 2, 2, 2, 2, 1, 2, 1, 0, -2, -3, -3],
    "PC7": [3, 2, 2, 2, 1, 1, 1, 0, -1, -3, -3, -3],
    "IA Super": [3, 2, 2, 2, 2, 1, 1, 0, -1, -3, -4, -4],
    "IA": [3, 2, 2, 2, 1, 0, 0, -1, -2, -4, -5, -5],
    "IB": [3, 2, 2, 1, 0, -1, -1, -2, -3, -5, -6, -6],
    "IC": [3, 2, 1, 0, -1, -2, -2, -3, -4, -6, -7, -8],
    "Not Ice Strengthened": [3, 1, 0, -1, -2, -3, -3, -4, -5, -7, -8, -8]}
CATEGORY = {c: ("polar_class" if c.startswith("PC") else "no_ice_class" if c.startswith("Not")
                else "below_polar_class") for c in RIV_STANDARD}
# stage code -> (conservative ice type, optimistic ice type)
STAGES = {
    "83": ("Grey White Ice", "Grey Ice"),
    "86": ("Thick First Year Ice", "Thin First Year Ice 1st Stage"),
    "87": ("Thin First Year Ice 2nd Stage less than 1 m thick", "Thin First Year Ice 1st Stage"),
    "95": ("Heavy Multi Year Ice", "Second Year Ice"),
    "97": ("Heavy Multi Year Ice", "Light Multi Year Ice less than 2.5 m thick"),
    "00": ("Ice-Free", "Ice-Free")}
# total concentration code -> (low, high) tenths
CT_CODES = {"92": (10, 10), "13": (1, 3), "24": (2, 4), "46": (4, 6), "68": (6, 8), "81": (8, 10), "00": (0, 0)}
# partial concentration code -> tenths
PARTIALS = {"00": 0, "10": 1, "20": 2, "30": 3, "40": 4, "50": 5, "60": 6, "70": 7, "80": 8, "90": 9, "92": 10}
UNUSED, ICEBERG = "-9", "98"
PENALTIES = {"normal_operation": 0.0, "elevated_operational_risk": 25.0,
             "operation_subject_to_special_consideration": 100.0, "indeterminate": 100.0, "unknown": 100.0}
# --------------------------------------------------------------------------------


def dimension(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small fixed table as inline VALUES: part of the plan itself, no job to build it."""
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}D" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def lookup(code: Column, table: dict) -> Column:
    """Value of a fixed code table, NULL for a code it does not list (never a near match)."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), code)


def riv_map(ice_class: str, table: dict = RIV_STANDARD) -> dict[str, float]:
    return {t: float(v) for t, v in zip(ICE_TYPES, table[ice_class])}


def riv_rows(spark: SparkSession) -> DataFrame:
    """riv(riv_table, ice_class, category, ice_type, riv): a dimension of fixed size."""
    rows = [(name, c, CATEGORY[c], t, float(v)) for name, table in (("standard", RIV_STANDARD), ("decayed", RIV_DECAYED))
            for c, values in table.items() for t, v in zip(ICE_TYPES, values)]
    return dimension(spark, rows, "riv_table, ice_class, category, ice_type, riv")


def read_riv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from a JSON document {ice_classes: {...}, riv: {class: {type: value}}}."""
    doc = spark.read.schema("ice_classes map<string,string>, riv map<string,map<string,double>>").json(
        path, multiLine=True)
    return (doc.select("ice_classes", F.explode("riv").alias("ice_class", "types"))
            .select("ice_class", F.try_element_at("ice_classes", "ice_class").alias("category"),
                    F.explode("types").alias("ice_type", "riv")))


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """bands(category, ord, min_rio, outcome); the last band of a category is -Infinity."""
    doc = spark.read.schema("rio_bands map<string,array<struct<min_rio:string,category:string>>>").json(
        path, multiLine=True)
    return (doc.select(F.explode("rio_bands").alias("category", "bands"))
            .select("category", F.posexplode("bands").alias("ord", "b"))
            .select("category", "ord", F.when(F.col("b.min_rio") == "-inf", F.lit(float("-inf")))
                    .otherwise(F.expr("try_cast(b.min_rio AS double)")).alias("min_rio"),
                    F.col("b.category").alias("outcome")))


def read_stage_policy(spark: SparkSession, path: str) -> DataFrame:
    """stage(code, conservative, optimistic, mapping_sensitive) from a policy document."""
    doc = spark.read.schema("stage_mapping map<string,struct<conservative:string,optimistic:string,"
                            "mapping_sensitive:boolean>>").json(path, multiLine=True)
    return doc.select(F.explode("stage_mapping").alias("code", "m")).select("code", "m.*")


def read_concentrations(spark: SparkSession, path: str) -> DataFrame:
    """concentration(field, code, low, high) from a policy document."""
    doc = spark.read.schema("concentration struct<ct_codes:map<string,array<int>>,"
                            "partial_codes:map<string,array<int>>>").json(path, multiLine=True)
    parts = [doc.select(F.lit(f).alias("field"), F.explode(f"concentration.{f}_codes").alias("code", "ends"))
             for f in ("ct", "partial")]
    return parts[0].unionByName(parts[1]).select("field", "code", F.col("ends")[0].alias("low"),
                                                 F.col("ends")[1].alias("high"))
