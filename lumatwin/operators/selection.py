"""Selecting files of duplicate groups and planning what is done with them.

selection(group_id, file_id, path, size, role, selected).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators.ordered import running
from lumatwin.stage import Stage


def select_role(rows: DataFrame, roles: list[str], visible: DataFrame | None = None) -> DataFrame:
    """rows with those of the given roles selected besides what is selected already, only in the visible groups if some are given."""
    hit = F.col("role").isin(roles)
    if visible is not None:
        rows = rows.join(visible.select("group_id").distinct().withColumn("_v", F.lit(True)), "group_id", "left")
        hit &= F.col("_v").isNotNull()
    return rows.withColumn("selected", F.col("selected") | hit).drop("_v")


def stats(rows: DataFrame) -> DataFrame:
    """One row on the selected files: all, safe and other duplicates, groups, bytes, and bytes of the other duplicates."""
    s = rows.where("selected")
    other = F.col("role") == "duplicate"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.agg(
        F.count("*").alias("total_selected"), F.count_if(F.col("role") == "safe_duplicate").alias("safe_selected"), F.count_if(other).alias("duplicate_selected"), F.countDistinct("group_id").alias("groups_affected"),
        zero(F.sum("size")).alias("total_size"), zero(F.sum(F.when(other, F.col("size")))).alias("reclaimable_size"),
    )


def group_state(rows: DataFrame) -> DataFrame:
    """(group_id, state): all, none or partial."""
    return rows.groupBy("group_id").agg(F.when(F.bool_and("selected"), "all").when(F.bool_or("selected"), "partial").otherwise("none").alias("state"))


def view(groups: DataFrame, kind: str) -> DataFrame:
    """Groups(tier, has_safe, has_conflict, ...) of a view: all, exact, near, safe or conflicts."""
    return {"all": groups, "exact": groups.where("tier = 'exact'"), "near": groups.where("tier = 'near'"), "safe": groups.where("has_safe"), "conflicts": groups.where("has_conflict")}[kind]


def touching(rows: DataFrame, chosen: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of which either path is chosen, once each."""
    paths = lambda n: chosen.select(F.col("path").alias(n)).distinct()
    return rows.join(paths(left), left, "left_semi").select(*rows.columns).unionByName(rows.join(paths(right), right, "left_semi").select(*rows.columns)).distinct()


def batches(deleted: DataFrame) -> DataFrame:
    """Per batch of deleted(batch_id, path, size): files, bytes and MB."""
    return deleted.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").alias("size"), media.megabytes(F.sum("size")).alias("megabytes"))


def ledger(files: DataFrame, chosen: DataFrame, method: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """The batch (batch_id, file_id, path, size, method) of deleting the chosen files(file_id) that are active, and files(file_id, path, size, status, ...) with them deleted."""
    hit = chosen.select("file_id").distinct().withColumn("_hit", F.lit(True))
    rows = files.join(hit, "file_id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & (F.col("status") == "active"), F.lit(False)))
    batch = rows.where("_hit").select(F.lit(batch_id).alias("batch_id"), "file_id", "path", "size", F.lit(method).alias("method"))
    return batch, rows.withColumn("status", F.when(F.col("_hit"), "deleted").otherwise(F.col("status"))).select(*files.columns)


def undo_totals(deleted: DataFrame) -> DataFrame:
    """One row: files and bytes deleted in all batches, what undoing the last one restores (only what lies in quarantine), and what stays deleted."""
    last = deleted.agg(F.max("batch_id").alias("_last"))
    back = (F.col("batch_id") == F.col("_last")) & (F.col("method") == "quarantine")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = deleted.join(F.broadcast(last)).agg(F.count("*").alias("files"), zero(F.sum("size")).alias("size"), F.count_if(back).alias("restored"), zero(F.sum(F.when(back, F.col("size")))).alias("restored_size"))  # one row
    return sums.withColumns({"files_left": F.col("files") - F.col("restored"), "size_left": F.col("size") - F.col("restored_size")})


def role_label(is_original, is_safe):
    return F.when(is_original, "original").when(is_safe, "safe_duplicate").otherwise("duplicate")


def exported(rows: DataFrame) -> DataFrame:
    """The selected rows as they're exported: file_id, group_id, file_path, file_size, role, is_selected, is_safe_duplicate."""
    safe = F.col("role") == "safe_duplicate"
    return rows.where("selected").select("file_id", "group_id", F.col("path").alias("file_path"), F.col("size").alias("file_size"), role_label(F.col("role") == "original", safe).alias("role"), F.col("selected").alias("is_selected"), safe.alias("is_safe_duplicate"))


def undo_last(deleted: DataFrame) -> DataFrame:
    """The rows of the last batch, which can be restored only where they lie in quarantine."""
    last = deleted.agg(F.max("batch_id").alias("batch_id"))
    return deleted.join(F.broadcast(last), "batch_id").withColumn("restorable", F.col("method") == "quarantine")  # one row


def quarantine_names(rows: DataFrame) -> DataFrame:
    """rows(path) with a name ``stored_as`` that is unique in one folder, for different paths.

    The first path of a name keeps it; the others, in path order, get a_1.jpg, a_2.jpg ... with numbers left out that make the name of another
    file. Names are numbered over the whole table, so a name that a third of all files have is no hot task.
    """
    name = media.name_of(F.col("path"))
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    stage = Stage(rows.sparkSession, "names")
    placed = running(rows.select("path", name.alias("name"), stem.alias("stem"), ext.alias("ext")).distinct(), [F.col("name"), F.col("path")]).drop("before")
    placed = stage.write(placed, "placed")
    first = placed.groupBy("name").agg(F.min("place").alias("first"))
    ranked = placed.join(first, "name").select("path", "name", "stem", "ext", (F.col("place") - F.col("first")).alias("k"))
    copies = stage.write(ranked.where("k > 0"), "copies")
    # names of the form stem_n, for stems of which there are copies: n is not free
    number = F.regexp_extract("stem", r"_([1-9][0-9]{0,17})$", 1)
    other = first.join(placed.select("name", "stem", "ext").distinct(), "name").select(F.regexp_replace("stem", r"_[1-9][0-9]{0,17}$", "").alias("stem"), "ext", number.try_cast("long").alias("n")).where("n IS NOT NULL")
    other = running(other.join(copies.select("stem", "ext").distinct(), ["stem", "ext"], "left_semi"), [F.col("stem"), F.col("ext"), F.col("n")]).drop("before")
    # the k-th free number is k and the numbers taken up to it: the i-th of them counts if it's less than k + i
    start = other.groupBy("stem", "ext").agg(F.min("place").alias("first"))
    steps = other.join(start, ["stem", "ext"]).select("stem", "ext", (F.col("n") - (F.col("place") - F.col("first"))).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("name"))
    both = steps.unionByName(copies.select("stem", "ext", F.col("k").alias("v"), F.lit(1).alias("kind"), "path", "name"))
    counted = stage.write(running(both, [F.col(c) for c in ("stem", "ext", "v", "kind", "path")], 1 - F.col("kind")), "counted")
    begin = counted.groupBy("stem", "ext").agg(F.min("before").alias("start"))
    renamed = counted.where("kind = 1").join(begin, ["stem", "ext"]).select("path", F.concat("stem", F.lit("_"), (F.col("v") + F.col("before") - F.col("start")).cast("string"), "ext").alias("stored_as"))
    kept = ranked.where("k = 0").select("path", F.col("name").alias("stored_as"))
    return rows.join(kept.union(renamed), "path")
