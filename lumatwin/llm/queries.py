"""The queries p1 to p8 of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.llm import codes, components, history, mixing, personal, survivors, tokens
from lumatwin.llm.inputs import PHASH_RADIUS, file_batches, file_hashes
from lumatwin.operators.bounded import sorted_join
from lumatwin.operators.hamming import near_values
from lumatwin.tables import table


def batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = file_batches(spark, sf_dir).join(file_hashes(spark, sf_dir, "sha256", "phash"), "file_id")
    return history.batch_pairs(spark, members, PHASH_RADIUS)


def similar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = file_hashes(spark, sf_dir, "phash", "dhash", "whash")
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id")).where("file_id IS NOT NULL").distinct()
    vectors = hashes.join(files, "file_id", "left_semi").select(F.col("file_id").alias("id"), F.col("phash").alias("a"), F.col("dhash").alias("b"), F.col("whash").alias("c"))
    found = codes.neighbours(spark, vectors)
    return found.select(F.least("id", "other").alias("file_id_a"), F.greatest("id", "other").alias("file_id_b")).distinct()


def similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, other): the five embeddings of largest cosine of each."""
    found = codes.similar(spark, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return found.select(F.col("id").alias("vec_id"), "other")


def tie_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): each member of a group with the group's smallest, each file with the smallest of its phash, and those of near phashes."""
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id")).where("file_id IS NOT NULL").distinct()
    groups = table(spark, sf_dir, "dup_groups").select(F.col("id").alias("group_id")).where("group_id IS NOT NULL").distinct()
    members = table(spark, sf_dir, "group_members").select("group_id", "file_id").distinct()
    members = sorted_join(sorted_join(members, groups, "group_id", "left_semi"), files, "file_id", "left_semi")
    first = members.groupBy("group_id").agg(F.min("file_id").alias("u"))
    hashed = sorted_join(file_hashes(spark, sf_dir, "phash").where("phash IS NOT NULL"), files, "file_id", "left_semi")
    lead = hashed.groupBy("phash").agg(F.min("file_id").alias("u"))
    near = near_values(hashed.select("phash"), PHASH_RADIUS, "phash").select("a", "b")
    a, b = lead.select(F.col("phash").alias("a"), "u"), lead.select(F.col("phash").alias("b"), F.col("u").alias("v"))
    parts = [sorted_join(members, first, "group_id"), sorted_join(hashed, lead, "phash")]
    return sorted_join(sorted_join(near, a, "a"), b, "b").select("u", "v").union(parts[0].select("u", F.col("file_id").alias("v"))).union(parts[1].select("u", F.col("file_id").alias("v")))


def tied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(spark, tie_edges(spark, sf_dir)).select(F.col("root").alias("root_id"), F.col("vertex").alias("file_id"))


def queries() -> dict:
    return {
        "p1_found": batch_duplicates,
        "p2_found": similar_files,
        "p2_similar_embeddings": similar_embeddings,
        "p4_found": survivors.survivor_sources,
        "p4_records": survivors.survivor_records,
        "p4_consensus": survivors.survivor_consensus,
        "p5_found": tied_files,
        "p6_ids": tokens.document_ids,
        "p6_offsets": tokens.document_offsets,
        "p6_round_trip": tokens.round_trip,
        "p7_selection": mixing.selection,
        "p7_shares": mixing.shares,
        "p8_found": personal.details,
        "p8_redacted": personal.redacted_documents,
    }


def oracle_sql() -> dict[str, str]:
    from lumatwin.llm import sql

    return sql.QUERIES
