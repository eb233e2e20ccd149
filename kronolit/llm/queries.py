"""Queries of the text, name and document problems (2, 4, 7, 8, 9, 10). SQL can express none of them on whole tables; the tests
compare them with brute force, exact round trips and other implementations instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronolit.llm.canonical import canonical_codes
from kronolit.llm.characters import consistent, inconsistent_fields, latin_lookalikes
from kronolit.llm.names import linked_names, linked_pairs
from kronolit.llm.packing import pack_documents
from kronolit.llm.spans import SharedSpans
from kronolit.llm.tokens import encode_documents

TYPED = ["nature_raw", "instrument_type_raw", "role_raw"]
SEEN = ["pdmr_name", "issuer_name_raw", "instrument_name"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(linked_names(_table(spark, d, "person_names"))).toDF("name_id_a", "name_id_b")


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the entity it belongs to and the number of its links."""
    e = linked_names(_table(spark, d, "person_names"))
    n = e.groupBy("entity").agg((F.count("*") - 1).alias("links"))
    return e.join(n, "entity").select(F.col("id").alias("name_id"), F.col("grp").alias("issuer_key"), F.col("entity").alias("entity_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_codes(_table(spark, d, "register_txns"), _table(spark, d, "ref_terms"), "row_id", TYPED).select(F.col("id").alias("row_id"), "field_name", "code")


def p4_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty value of the typed fields with its code, exact labels included."""
    t, r = _table(spark, d, "register_txns"), _table(spark, d, "ref_terms")
    labels = r.select("field_name", "code", F.explode(F.array("label", "label_en")).alias("value")).where("value is not null").groupBy("field_name", "value").agg(F.min("code").alias("code"))
    long = t.select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in TYPED])).alias("x")).select("row_id", "x.*").where("value != ''")
    exact = long.join(labels, ["field_name", "value"])
    typed = canonical_codes(t, r, "row_id", TYPED).withColumnRenamed("id", "row_id")
    return exact.select("row_id", "field_name", "value", "code").unionByName(typed)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return inconsistent_fields(_table(spark, d, "register_txns"), "row_id", SEEN).select(F.col("id").alias("row_id"), "field_name")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """The three fields of every row in the consistent form."""
    look = latin_lookalikes(spark)
    return _table(spark, d, "register_txns").select("row_id", *[consistent(spark, F.col(f), look).alias(f) for f in SEEN])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(_table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(_table(spark, d, "documents")).pairs()


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between the representatives of different texts; with ``p10_members`` the same as ``p10_found`` without expanding copies."""
    return SharedSpans(_table(spark, d, "documents")).links_of_representatives()


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(_table(spark, d, "documents")).members()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document stands verbatim in another one."""
    return SharedSpans(_table(spark, d, "documents")).shares()


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p4_found, p4_codes, p7_found, p7_forms, p8_ids, p9_containers, p10_found, p10_links, p10_members, p10_shares)}
SQL: dict[str, str] = {}
