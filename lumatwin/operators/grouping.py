"""Two-tier duplicate groups: exact by size and hashes, near by Hamming radius; and the choice of one original each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.functions.hashes import hash_long
from lumatwin.operators.bounded import sorted_join
from lumatwin.operators.hamming import near_values
from lumatwin.operators.presets import RADIUS
from lumatwin.stage import Stage

def exact_groups(files: DataFrame, confirm: bool = True) -> DataFrame:
    """(group_no, file_id, confidence): files of one size and fast_hash, and of one sha256 if confirm.

    files(file_id, size, fast_hash, sha256). Files without a hash that is needed are in no group; a size of null is one too. Groups are
    numbered by their smallest file_id; confidence is 1.0 confirmed, else 0.95.
    """
    keys = ["size", "fast_hash", *(["sha256"] if confirm else [])]
    known = files.where(reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys[1:]]) & F.col("size").isNotNull())
    # sizes of groups first, so that no group is gathered on one task
    groups = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("file_id").alias("first")).where("n >= 2")
    return sorted_join(known, groups, keys).select(F.col("first").alias("group_no"), "file_id", F.lit(1.0 if confirm else 0.95).alias("confidence"))


def original_order(f: str = "") -> Column:
    """A struct that sorts the files of a group, the original first: more pixels, earlier exif_dt, larger, better format, path, id."""
    c = lambda n: F.col(f + n)
    exif = media.present(c("exif_dt"))
    return F.struct(
        -media.resolution(c("dims_w"), c("dims_h")), exif.isNull(), exif, -F.coalesce(c("size"), F.lit(0)), media.format_priority(c("format"), c("path")), c("path"), c("file_id").alias("file_id")
    )


def originals(members: DataFrame, files: DataFrame, group: str = "group_no") -> DataFrame:
    """(group, original_id): the first file of each group in original_order. Members without a files row don't count."""
    rows = members.select(group, "file_id").join(files, "file_id")
    return rows.groupBy(group).agg(F.min(original_order()).alias("o")).select(group, F.col("o.file_id").alias("original_id"))


def number(files: DataFrame, name: str) -> Column:
    """A hash column as a number, whether it's one already or a text."""
    return F.col(name) if files.schema[name].dataType.typeName() == "long" else hash_long(F.col(name))


def near_edges(files: DataFrame, radius: int, hashes: tuple[str, ...] = ("phash", "dhash", "whash"), exact: DataFrame | None = None, strict: bool = False, tolerance: float = 0.1) -> DataFrame:
    """(a, b, distance), a < b: files near by any of the hashes, with compatible sides; the smallest distance of all hashes.

    files(file_id, dims_w, dims_h, exif_dt and the hashes as texts or numbers). exact: files that take no part. strict: capture times at
    most a minute apart, too. Unusable hashes match nothing. Copies of one hash are compared once.
    """
    if exact is not None:
        files = sorted_join(files, exact.select("file_id").distinct(), "file_id", "left_anti")
    kinds = F.array(*[F.struct(F.lit(hashes.index(h)).alias("kind"), number(files, h).alias("v")) for h in hashes])
    at = files.select("file_id", F.explode(kinds).alias("h")).select("file_id", "h.kind", "h.v").where("v IS NOT NULL")
    a, b = at.select("kind", F.col("file_id").alias("x"), F.col("v").alias("a")), at.select("kind", F.col("file_id").alias("y"), F.col("v").alias("b"))
    near = near_values(at.select("kind", "v"), radius, "v", by=("kind",))
    parts = [sorted_join(sorted_join(near, a, ["kind", "a"]), b, ["kind", "b"]).select("x", "y", "distance"), sorted_join(a, b.withColumnRenamed("b", "a"), ["kind", "a"]).where("x < y").select("x", "y", F.lit(0).alias("distance"))]
    best = reduce(DataFrame.union, parts).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"))
    side = lambda n: files.select(F.col("file_id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("dims_w", "dims_h", "exif_dt")])
    rows = sorted_join(sorted_join(best, side("a"), "a"), side("b"), "b")
    keep = media.dims_compatible(F.col("dims_w_a"), F.col("dims_h_a"), F.col("dims_w_b"), F.col("dims_h_b"), tolerance)
    if strict:
        keep &= media.times_close(F.col("exif_dt_a"), F.col("exif_dt_b"))
    return rows.where(keep).select("a", "b", "distance")


#: Edges that one task settles.
BLOCK_EDGES = 500_000


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in x.columns] for x in batches if x.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else []


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All groups of the edges (a, b, distance) of one task: files by id, each free one takes its free neighbours."""
    if not (columns := _columns(batches)):
        return
    order = np.lexsort((columns[1], columns[0]))
    a, b, distance = (c[order] for c in columns)
    ids, place = np.unique(b, return_inverse=True)
    taken = np.zeros(len(ids) + 1, bool)
    heads, begin = np.unique(a, return_index=True)
    own = np.searchsorted(ids, heads)
    own[(own == len(ids)) | (ids[np.minimum(own, len(ids) - 1)] != heads)] = len(ids)  # nobody's larger neighbour
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(begin, [*begin[1:], len(a)])):
        if not taken[own[k]]:
            free = ~taken[place[x:y]]
            keep[x:y] = free
            taken[place[x:y][free]] = True
    leaders = np.unique(a[keep])
    none = pa.nulls(len(leaders), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(distance[keep].astype(np.int32))], ["leader", "file_id", "distance"])
    yield pa.RecordBatch.from_arrays([pa.array(leaders), pa.array(leaders), none], ["leader", "file_id", "distance"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, state) of the files b of one range of ids that its edges (a, b, state of a) decide: 1 for leaders, 0 for members; -1 is unknown."""
    if not (columns := _columns(batches)):
        return
    order = np.lexsort((columns[0], columns[1]))
    a, b, state = (c[order] for c in columns)
    ids, begin = np.unique(b, return_index=True)
    at = np.searchsorted(ids, a)
    at[(at == len(ids)) | (ids[np.minimum(at, len(ids) - 1)] != a)] = len(ids)  # outside this range: known by its state alone
    found = np.full(len(ids) + 1, -1, np.int8)
    for k, (x, y) in enumerate(zip(begin, [*begin[1:], len(a)])):
        known = np.maximum(state[x:y], found[at[x:y]])  # a file of this range is unknown before
        if (known == 1).any():
            found[k] = 0
        elif (known == 0).all():
            found[k] = 1
    done = found[:-1] >= 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[done]), pa.array(found[:-1][done].astype(np.int32))], ["id", "state"])


def leader_groups(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(leader, file_id, distance): greedy groups as by going through the files by id, each free one taking its free neighbours.

    edges(a, b, distance). A file is a leader if no smaller neighbour is one; others join their smallest leader. Leaders without
    members are dropped; the leader itself is a row with a null distance. Not transitive.

    Up to BLOCK_EDGES edges are one task. More are cut into ranges of ids, and rounds settle all files whose smaller neighbours are settled
    or lie in the same range: ids that are near each other in time or path mostly fall into one range, and there are no more rounds than ranges.
    """
    stage = Stage(spark, "leaders")
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("int").alias("distance"))
    clean = stage.write(clean.groupBy("a", "b").agg(F.min("distance").alias("distance")), "edges")
    count = clean.count()
    if count <= BLOCK_EDGES:
        return clean.coalesce(1).mapInArrow(_greedy, "leader long, file_id long, distance int")
    first = clean.select(F.col("a").alias("id")).distinct()
    first = sorted_join(first, clean.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    known = [stage.write(first.select("id", F.lit(1).alias("state")), "states")]
    left = clean.select("a", "b", F.lit(-1).alias("state"))
    while count:
        told = sorted_join(left, known[-1].select(F.col("id").alias("a"), F.col("state").alias("now")), "a", "left").select("a", "b", F.coalesce("now", "state").alias("state"))
        told = stage.write(told, "told")
        # whatever has a leader for a neighbour is a member; so a file with most edges is settled before they'd be brought to one task
        sure = stage.write(told.where("state = 1").select(F.col("b").alias("id")).distinct(), "sure")
        open_ = sorted_join(told, sure.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "state").repartitionByRange(-(-count // BLOCK_EDGES), "b")
        known.append(stage.write(open_.mapInArrow(_settle, "id long, state int").union(sure.select("id", F.lit(0))), "states"))
        stage.drop(left)
        left = stage.write(sorted_join(told, known[-1].select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "state"), "left")
        stage.drop(told)
        count = left.count()
    leaders = reduce(DataFrame.union, known).where("state = 1").select(F.col("id").alias("leader"))
    member = sorted_join(sorted_join(clean, leaders.withColumn("a", F.col("leader")), "a"), leaders.select(F.col("leader").alias("b")), "b", "left_anti")
    nearest = member.groupBy("b").agg(F.min(F.struct("a", "distance")).alias("m")).select(F.col("m.a").alias("leader"), F.col("b").alias("file_id"), "m.distance")
    heads = nearest.select("leader").distinct().select("leader", F.col("leader").alias("file_id"), F.lit(None).cast("int").alias("distance"))
    return nearest.union(heads)


def alike(files: DataFrame, hashes: tuple[str, ...], strict: bool) -> DataFrame:
    """(file_id, first): files with some hash (as numbers), and the smallest id of those that no comparison can tell from it: same hashes, sides and, if strict, time."""
    known = files.select("file_id", *hashes, "dims_w", "dims_h", *(["exif_dt"] if strict else [])).where(F.coalesce(*hashes).isNotNull())
    same = [c for c in known.columns if c != "file_id"]
    first = known.groupBy(*same).agg(F.min("file_id").alias("first"))
    equal = reduce(lambda x, y: x & y, [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in same])
    return sorted_join(known.alias("k"), first.alias("f"), equal).select("k.file_id", "f.first")


def near_groups(spark: SparkSession, files: DataFrame, radius: int, hashes: tuple[str, ...] = ("phash", "dhash", "whash"), exact: DataFrame | None = None, strict: bool = False, tolerance: float = 0.1) -> DataFrame:
    """(group_no, file_id, confidence): greedy near groups; confidence is 1 - smallest distance / radius, 0.1 at least.

    Files that are alike have the same neighbours and are neighbours of each other, so they go to one group: only the first of them is
    compared, and the others join its group at the end. No pairs of copies are made.
    """
    stage = Stage(spark, "near")
    if exact is not None:
        files = sorted_join(files, exact.select("file_id").distinct(), "file_id", "left_anti")
    files = stage.write(files.select("file_id", "dims_w", "dims_h", "exif_dt", *[number(files, h).alias(h) for h in hashes]), "files")
    like = stage.write(alike(files, hashes, strict), "alike")
    firsts = sorted_join(files, like.where("file_id = first").select("file_id"), "file_id", "left_semi")
    rows = leader_groups(spark, near_edges(firsts, radius, hashes, strict=strict, tolerance=tolerance))
    rows = stage.write(rows, "groups")
    others = like.where("file_id <> first")
    joined = sorted_join(others, rows.select(F.col("file_id").alias("first"), "leader", F.coalesce("distance", F.lit(0)).alias("distance")), "first", "left")
    joined = joined.select(F.coalesce("leader", "first").alias("leader"), "file_id", F.coalesce("distance", F.lit(0)).alias("distance"))
    # a first file that only its copies join leads a group of its own
    alone = sorted_join(others.select(F.col("first").alias("leader")).distinct(), rows.select(F.col("file_id").alias("leader")), "leader", "left_anti")
    rows = stage.write(rows.union(joined).union(alone.select("leader", F.col("leader").alias("file_id"), F.lit(None).cast("int"))), "members")
    least = rows.groupBy("leader").agg(F.min("distance").alias("d"))
    score = F.greatest(F.lit(0.1), 1.0 - F.col("d") / F.lit(float(max(radius, 1))))
    return sorted_join(rows, least, "leader").select(F.col("leader").alias("group_no"), "file_id", score.alias("confidence"))


def two_tier(spark: SparkSession, files: DataFrame, radius: int = RADIUS["Balanced"], confirm: bool = True, **options) -> DataFrame:
    """(tier, group_no, file_id, role, confidence): exact groups, near groups of the other files, and the original of each group."""
    stage = Stage(spark, "tiers")
    hashes = options.get("hashes", ("phash", "dhash", "whash"))
    kept = [c for c in ("file_id", "size", "fast_hash", "sha256", "path", "format", "dims_w", "dims_h", "exif_dt") if c in files.columns]
    files = stage.write(files.select(*kept, *[number(files, h).alias(h) for h in hashes]), "files")  # read three times below
    exact = stage.write(exact_groups(files, confirm), "exact")
    near = near_groups(spark, files, radius, exact=exact, **options)
    members = exact.withColumn("tier", F.lit("exact")).unionByName(near.withColumn("tier", F.lit("near")))
    members = stage.write(members, "members")
    key = ["tier", "group_no"]
    rows = sorted_join(members.select(*key, "file_id"), files, "file_id")
    chosen = rows.groupBy(*key).agg(F.min(original_order()).alias("o")).select(*key, F.col("o.file_id").alias("original_id"))
    role = F.when(F.col("file_id") == F.col("original_id"), "original").otherwise("duplicate")
    return sorted_join(members, chosen, key).select(*key, "file_id", role.alias("role"), "confidence")


def summary(groups: DataFrame, files: DataFrame) -> DataFrame:
    """One row: groups, by tier and by confidence, files, duplicates, and the size of all different duplicates."""
    sized = sorted_join(groups, files.select("file_id", "size"), "file_id", "left")
    per = sized.groupBy("tier", "group_no").agg(F.first("confidence").alias("c"), F.count("*").alias("n"), F.count_if(F.col("role") == "duplicate").alias("d"))
    totals = per.agg(
        F.count("*").alias("total_groups"), F.count_if(F.col("tier") == "exact").alias("exact_groups"), F.count_if(F.col("tier") == "near").alias("near_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("total_duplicates"), F.count_if(F.col("c") >= 0.8).alias("high"), F.count_if((F.col("c") >= 0.5) & (F.col("c") < 0.8)).alias("medium"), F.count_if(F.col("c") < 0.5).alias("low"),
    )
    space = sized.where("role = 'duplicate'").select("file_id", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("space_savings"))
    return totals.join(F.broadcast(space))  # one row each
