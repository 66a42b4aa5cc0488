"""Queries on duplicate groups: scans, hashes, near pairs, exact and near groups, originals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.functions.hashes import hamming, hash_long, hex_digits, hex_distance, similarity_score
from lumatwin.operators import greedy, grouping
from lumatwin.operators.bounded import sorted_join
from lumatwin.operators.hamming import near_digits, near_values, probe
from lumatwin.plans import sqltext as S
from lumatwin.stage import Stage
from lumatwin.tables import current_features, current_files, table

HASHES = ("phash", "dhash", "whash")


def records(spark: SparkSession, d: str) -> DataFrame:
    """The active current files, with their features where they have some; unusable hashes are null."""
    features = current_features(spark, d, ["file_id", "feature_ver", "fast_hash", "sha256", *HASHES])
    clean = features.select("file_id", hex_digits(F.col("fast_hash"), 16).alias("fast_hash"), hex_digits(F.col("sha256"), 64).alias("sha256"), *HASHES)
    columns = ["id", "last_seen_at", "path", "size", "dims_w", "dims_h", "exif_dt", "format", "status"]
    files = current_files(spark, d, columns).withColumnRenamed("id", "file_id").where("status = 'active'")
    return sorted_join(files, clean, "file_id", "left")


def load_records(spark, d):
    return records(spark, d).select("file_id", "path", "size", "dims_w", "dims_h", "fast_hash", "sha256")


def index_rows(spark, d):
    """What a search index holds: all files with a phash, whatever their status."""
    features = current_features(spark, d, ["file_id", "feature_ver", *HASHES]).select("file_id", *[hash_long(F.col(h)).alias(h) for h in HASHES]).where("phash IS NOT NULL")
    files = current_files(spark, d, ["id", "last_seen_at", "path"]).select(F.col("id").alias("file_id"), "path")
    return files.join(features, "file_id").select("file_id", "path", *[F.lpad(F.lower(F.hex(h)), 16, "0").alias(h) for h in HASHES])


def index_stats(spark, d):
    rows = index_rows(spark, d)
    return rows.agg(F.count("*").alias("files"), *[F.countDistinct(h).alias(f"{h}_values") for h in HASHES])


def exact_groups(spark, d):
    return grouping.exact_groups(records(spark, d))


def exact_no_sha(spark, d):
    return grouping.exact_groups(records(spark, d), confirm=False)


def original_selection(spark, d):
    """W01 over the stored groups: the original of each by the sort order, beside the number of its members."""
    members = table(spark, d, "group_members").select(F.col("group_id").alias("group_no"), "file_id").distinct()
    files = current_files(spark, d, ["id", "last_seen_at", "path", "size", "dims_w", "dims_h", "exif_dt", "format"]).withColumnRenamed("id", "file_id")
    counts = members.join(files.select("file_id"), "file_id").groupBy("group_no").agg(F.count("*").alias("members"))
    return grouping.originals(members, files).join(counts, "group_no")


def hash_group_counts(spark, d):
    """Values of phash that several files have."""
    f = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select("file_id", hex_digits(F.col("phash"), 16).alias("phash")).where("phash IS NOT NULL")
    return f.groupBy("phash").agg(F.count("*").alias("files"), F.min("file_id").alias("first_id")).where("files > 1")


def near_pairs(radius):
    def query(spark, d):
        f = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select(hash_long(F.col("phash")).alias("value"))
        near = near_values(f, radius)
        text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
        return near.select(F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "distance")

    return query


def near_pairs_multi(spark, d):
    """Pairs of indexed files near by any hash, with the distance of each hash that is, and the smallest."""
    rows = current_features(spark, d, ["file_id", "feature_ver", *HASHES]).select("file_id", *[hash_long(F.col(h)).alias(h) for h in HASHES]).where("phash IS NOT NULL")
    rows = Stage(spark, "multi").write(rows, "rows")
    kinds = F.array(*[F.struct(F.lit(k).alias("hash"), F.col(h).alias("v")) for k, h in enumerate(HASHES)])
    at = rows.select("file_id", F.explode(kinds).alias("h")).select("file_id", "h.hash", "h.v").where("v IS NOT NULL")
    a, b = at.select("hash", F.col("file_id").alias("x"), F.col("v").alias("a")), at.select("hash", F.col("file_id").alias("y"), F.col("v").alias("b"))
    pairs = near_values(at.select("hash", "v"), grouping.RADIUS["Ultra-Lite"], "v", by=("hash",))
    pairs = sorted_join(sorted_join(pairs, a, ["hash", "a"]), b, ["hash", "b"]).select("x", "y", "hash", "distance")
    same = sorted_join(a, b.withColumnRenamed("b", "a"), ["hash", "a"]).where("x < y").select("x", "y", "hash", F.lit(0).alias("distance"))
    all_ = pairs.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "hash", "distance")
    of = lambda h: F.min(F.when(F.col("hash") == HASHES.index(h), F.col("distance"))).alias(h)
    return all_.groupBy("a", "b").agg(*[of(h) for h in HASHES], F.min("distance").alias("min_distance"))


def similarity(spark, d):
    """F02 over the pairs of J09."""
    rows = near_pairs_multi(spark, d)
    return rows.select("a", "b", F.round(similarity_score([(F.col("phash"), 0.5), (F.col("dhash"), 0.3), (F.col("whash"), 0.2)]), 9).alias("score"))


def similar_by_hash(spark, d):
    """For every hash that is a group's commonest, all files within the radius: probes by value, not by file."""
    rows = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select("file_id", hash_long(F.col("phash")).alias("value")).where("value IS NOT NULL")
    asked = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.col("value").alias("query"))
    near = probe(rows.select("value"), asked, grouping.RADIUS["Balanced"])
    return near.join(rows, "value").select(F.lpad(F.lower(F.hex("query")), 16, "0").alias("query"), "file_id", "distance")


def hamming_texts(spark, d):
    """the distance of each file's phash and dhash texts as they stand, null where they can't be compared."""
    return current_features(spark, d, ["file_id", "feature_ver", "phash", "dhash"]).select("file_id", hex_distance(F.col("phash"), F.col("dhash")).alias("distance"))


def hash_similar(spark, d):
    """Whether phash and dhash of a file differ by at most a preset's radius."""
    f = current_features(spark, d, ["file_id", "feature_ver", *HASHES]).select("file_id", *[hash_long(F.col(h)).alias(h) for h in HASHES])
    dist = hamming(F.col("phash"), F.col("dhash"))
    return f.select("file_id", *[F.coalesce(dist <= r, F.lit(False)).alias("within_" + p.lower().replace("-", "_")) for p, r in grouping.RADIUS.items()])


def near_groups_r8(spark, d):
    return grouping.near_groups(spark, records(spark, d), grouping.RADIUS["Balanced"])


def near_groups_strict(spark, d):
    return grouping.near_groups(spark, records(spark, d), grouping.RADIUS["Ultra-Lite"], strict=True).select("group_no", "file_id")


def two_tier(spark, d):
    return grouping.two_tier(spark, records(spark, d))


def group_summary(spark, d):
    files = records(spark, d)
    return grouping.summary(grouping.two_tier(spark, files), files)


def group_details(spark, d):
    """Each group's tier, size and the texts stored with it."""
    rows = grouping.two_tier(spark, records(spark, d)).groupBy("tier", "group_no").agg(F.count("*").alias("files"), F.first("confidence").alias("confidence"))
    return rows.select("tier", "group_no", "files", F.concat("tier", F.lit("_duplicates")).alias("reason"), F.format_string("confidence:%.3f|files:%d", "confidence", "files").alias("score_summary"))


def threshold_sweep(spark, d):
    """How many pairs and files are near at each radius from 0 to 12."""
    rows = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select("file_id", hash_long(F.col("phash")).alias("value")).where("value IS NOT NULL")
    near = near_values(rows.select("value"), 12).select("distance", F.explode(F.array("a", "b")).alias("value"))
    first = near.groupBy("value").agg(F.min("distance").alias("d")).groupBy("d").agg(F.count("*").alias("values"))
    pairs = near.groupBy(F.col("distance").alias("d")).agg((F.count("*") / 2).cast("long").alias("pairs"))
    radii = spark.range(13).select(F.col("id").cast("int").alias("radius"))
    both = pairs.join(first, "d", "full").na.fill(0)
    return radii.join(F.broadcast(both), F.col("d") <= F.col("radius"), "left").groupBy("radius").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("values"), F.lit(0)).alias("values"))


def dims_compatible(spark, d):
    """P09, P10 within the stored groups."""
    m = table(spark, d, "group_members").select("group_id", "file_id").distinct()
    f = current_files(spark, d, ["id", "last_seen_at", "dims_w", "dims_h", "exif_dt"])
    side = lambda n: m.join(f, m.file_id == f.id).select("group_id", *[F.col(c).alias(f"{c}_{n}") for c in ("file_id", "dims_w", "dims_h", "exif_dt")])
    pairs = side("a").join(side("b"), "group_id").where("file_id_a < file_id_b")
    fits = media.dims_compatible(F.col("dims_w_a"), F.col("dims_h_a"), F.col("dims_w_b"), F.col("dims_h_b"))
    return pairs.select("group_id", "file_id_a", "file_id_b", fits.alias("dims_fit"), media.times_close(F.col("exif_dt_a"), F.col("exif_dt_b")).alias("times_fit"))


def tuner_groups(spark, d):
    """Greedy groups of files whose dhash texts differ in at most 5 characters and whose sizes, where both are known, by at most a tenth."""
    rows = current_features(spark, d, ["file_id", "feature_ver", "dhash"]).select("file_id", hash_long(F.col("dhash")).alias("value")).where("value IS NOT NULL")
    sized = current_files(spark, d, ["id", "last_seen_at", "size"]).select(F.col("id").alias("file_id"), "size")
    rows = Stage(spark, "tuner").write(rows, "rows")
    of = lambda n, v: rows.select(F.col("file_id").alias(n), F.col("value").alias(v))
    near = near_digits(rows.select("value"), 5).select(F.col("a").alias("va"), F.col("b").alias("vb"), "distance")
    near = sorted_join(sorted_join(near, of("x", "va"), "va"), of("y", "vb"), "vb").select("x", "y", "distance")
    same = sorted_join(of("x", "v"), of("y", "v"), "v").where("x < y").select("x", "y", F.lit(0).alias("distance"))
    near = near.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    side = lambda n: sized.select(F.col("file_id").alias(n), F.col("size").alias(f"s{n}"))
    edges = sorted_join(sorted_join(near, side("a"), "a"), side("b"), "b").where(F.coalesce(media.size_ratio(F.col("sa"), F.col("sb")) <= 0.1, F.lit(True)))
    return grouping.leader_groups(spark, edges.select("a", "b", "distance")).select("leader", "file_id", "distance")


def tuner_groups_all(spark, d):
    """Greedy groups of all current files as the tuner judges them: phash within 5 characters and sizes within a tenth, each only where both files have one."""
    features = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select(F.col("file_id").alias("id"), hash_long(F.col("phash")).alias("value"))
    files = current_files(spark, d, ["id", "last_seen_at", "size"]).select("id", "size").join(features, "id", "left")
    return greedy.similar_groups(spark, files, 0.1, 5).select("leader", F.col("id").alias("file_id"))


def neighbours_of_batch(spark, d):
    """For every file of the last batch, the files near its phash: one join for the whole set."""
    rows = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select("file_id", hash_long(F.col("phash")).alias("value")).where("value IS NOT NULL")
    asked = rows.join(table(spark, d, "batch_items").where("batch_no = 6").select("file_id").distinct(), "file_id", "left_semi").select(F.col("file_id").alias("asked"), F.col("value").alias("query"))
    near = probe(rows.select("value"), asked.select("query"), grouping.RADIUS["Balanced"])
    return near.join(asked, "query").join(rows, "value").where("asked <> file_id").select("asked", "file_id", "distance")


def size_groups(spark, d):
    """Greedy groups of documents of equal source whose lengths differ by at most 0.1 percent."""
    docs = table(spark, d, "documents").where("n_chars > 0").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("size"))
    return grouping.leader_groups(spark, size_edges(docs, 0.001)).select("leader", F.col("file_id").alias("doc_id"))


def indexed(spark, d):
    """The hashes of all files with a phash, as numbers."""
    return current_features(spark, d, ["file_id", "feature_ver", *HASHES]).select("file_id", *[hash_long(F.col(h)).alias(h) for h in HASHES]).where("phash IS NOT NULL")


def neighbours_any_hash(spark, d):
    """For every file of the last batch and every file whose id is divisible by 100, the indexed files near by any hash, with the distance of each hash that is, and the smallest."""
    rows = indexed(spark, d)
    last = table(spark, d, "batch_items").where("batch_no = 6").select("file_id")
    asked = rows.join(last.union(rows.where("file_id % 100 = 0").select("file_id")).distinct(), "file_id", "left_semi")
    parts = []
    for h in HASHES:
        near = probe(rows.select(F.col(h).alias("value")), asked.select(F.col(h).alias("query")), grouping.RADIUS["Balanced"])
        met = near.join(asked.select(F.col("file_id").alias("asked"), F.col(h).alias("query")), "query").join(rows.select("file_id", F.col(h).alias("value")), "value")
        parts.append(met.where("asked <> file_id").select("asked", "file_id", F.lit(h).alias("hash"), "distance"))
    of = lambda h: F.min(F.when(F.col("hash") == h, F.col("distance"))).alias(h)
    return parts[0].union(parts[1]).union(parts[2]).groupBy("asked", "file_id").agg(*[of(h) for h in HASHES], F.min("distance").alias("min_distance"))


def threshold_groups(spark, d):
    """Pairs of files near by phash, files in them and greedy groups at each radius from 0 to 12; copies of a hash are near at 0.

    Groups go over hashes, each as its first file: copies are taken together. All radii are grouped at once, as files numbered 16 * id + radius.
    """
    rows = current_features(spark, d, ["file_id", "feature_ver", "phash"]).select("file_id", hash_long(F.col("phash")).alias("value")).where("value IS NOT NULL")
    stage = Stage(spark, "sweep")
    values = stage.write(rows.groupBy("value").agg(F.count("*").alias("n"), F.min("file_id").alias("first")), "values")
    side = lambda x: values.select(F.col("value").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"first{x}"))
    near = stage.write(sorted_join(sorted_join(near_values(values, 12), side("a"), "a"), side("b"), "b"), "near")
    copies = values.where("n > 1")
    pairs = near.select("distance", (F.col("na") * F.col("nb")).alias("p")).union(copies.select(F.lit(0), (F.col("n") * (F.col("n") - 1) / 2).cast("long")))
    ends = near.select("distance", F.explode(F.array(F.struct("a", "na"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na")))).alias("e")).select("distance", "e.a", "e.na").union(copies.select(F.lit(0), "value", "n"))
    first = ends.groupBy("a").agg(F.min("distance").alias("distance"), F.first("na").alias("f"))
    radius = lambda low: F.explode(F.sequence(low, F.lit(12))).alias("radius")
    at = lambda x: (F.col(f"first{x}") * 16 + F.col("radius")).alias(x)
    groups = stage.write(grouping.leader_groups(spark, near.select("firsta", "firstb", "distance", radius(F.col("distance"))).select(at("a"), at("b"), "distance")), "groups")
    led = groups.where("leader = file_id").select((F.col("leader") % 16).cast("int").alias("radius"))
    alone = copies.select((F.col("first") * 16).alias("k"), radius(F.lit(0))).withColumn("k", F.col("k") + F.col("radius"))
    alone = sorted_join(alone, groups.select(F.col("file_id").alias("k")), "k", "left_anti").select("radius")
    zero = F.lit(0).cast("long")
    parts = [
        spark.range(13).select(F.col("id").cast("int").alias("radius"), zero.alias("p"), zero.alias("f"), zero.alias("g")), led.union(alone).select("radius", zero, zero, F.lit(1).cast("long")),
        pairs.groupBy("distance").agg(F.sum("p").alias("p")).select(radius(F.col("distance")), "p", zero, zero), first.groupBy("distance").agg(F.sum("f").alias("f")).select(radius(F.col("distance")), zero, "f", zero),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("radius").agg(F.sum("p").alias("pairs"), F.sum("f").alias("files"), F.sum("g").alias("groups"))


def file_size_groups(spark, d):
    """Greedy groups of the current files whose sizes differ by at most a tenth, whatever their status; files without a size are in none."""
    files = current_files(spark, d, ["id", "last_seen_at", "size"]).where("size > 0").select("id", "size")
    return greedy.similar_groups(spark, files, 0.1).select("leader", F.col("id").alias("file_id"))


def size_edges(rows: DataFrame, ratio: float) -> DataFrame:
    """(a, b, distance) of rows(id, source, size) of one source with media.size_ratio at most ratio: a range join on bins of the logarithm."""
    width = F.lit(-1.0) * F.log(F.lit(1.0 - ratio))
    bin_ = F.floor(F.log("size") / width)
    a = rows.select(F.col("id").alias("a"), "source", F.col("size").alias("sa"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    b = rows.select(F.col("id").alias("b"), "source", F.col("size").alias("sb"), bin_.alias("bin"))
    return a.join(b, ["source", "bin"]).where((F.col("a") < F.col("b")) & (media.size_ratio(F.col("sa"), F.col("sb")) <= ratio)).select("a", "b", F.lit(0).alias("distance"))


def queries() -> dict:
    return {
        "s09_load_records": load_records, "s10_index_rows": index_rows, "s10_index_stats": index_stats, "a01_exact_groups": exact_groups, "a01_exact_no_sha": exact_no_sha, "w01_original_selection": original_selection,
        "a03_hash_group_counts": hash_group_counts, "j08_near_pairs_r6": near_pairs(6), "j08_near_pairs_r8": near_pairs(8), "j08_near_pairs_r12": near_pairs(12), "j09_near_pairs_multi": near_pairs_multi, "f02_similarity_score": similarity,
        "j11_similar_by_hash": similar_by_hash, "f01_hamming_texts": hamming_texts, "p11_hash_similar": hash_similar, "g01_near_groups_r8": near_groups_r8, "g01_near_groups_strict_r6": near_groups_strict, "g03_two_tier": two_tier,
        "a04_group_summary": group_summary, "a05_group_details": group_details, "i11_threshold_sweep": threshold_sweep, "p09_dims_compatible": dims_compatible, "g02_size_groups": size_groups, "g02_file_size_groups": file_size_groups,
        "j16_tuner_groups": tuner_groups, "j16_tuner_groups_all": tuner_groups_all, "j10_neighbours_of_batch": neighbours_of_batch, "j10_neighbours_any_hash": neighbours_any_hash,
        "i11_threshold_groups": threshold_groups,
    }


def _pairs(radius: int) -> str:
    return f"""WITH {S.FEATURES}, v AS (SELECT DISTINCT phash v FROM feat WHERE phash IS NOT NULL)
SELECT lower(lpad(to_hex(x.v), 16, '0')) a, lower(lpad(to_hex(y.v), 16, '0')) b, bit_count(xor(x.v, y.v)) distance FROM v x JOIN v y ON x.v < y.v AND {S.near("x.v", "y.v", radius)}"""


_MULTI = f"""WITH {S.FEATURES}, w AS (SELECT * FROM feat WHERE phash IS NOT NULL),
p AS (SELECT x.file_id a, y.file_id b, {", ".join(f"CASE WHEN {S.near(f'x.{h}', f'y.{h}', 6)} THEN bit_count(xor(x.{h}, y.{h})) END {h}" for h in HASHES)} FROM w x JOIN w y ON x.file_id < y.file_id),
q AS (SELECT *, least(phash, dhash, whash) min_distance FROM p WHERE least(phash, dhash, whash) IS NOT NULL)
"""
_EXACT = "ex AS (SELECT min(file_id) OVER (PARTITION BY size, fast_hash, sha256) group_no, file_id, 1.0::DOUBLE confidence, count(*) OVER (PARTITION BY size, fast_hash, sha256) n FROM rec WHERE fast_hash IS NOT NULL AND sha256 IS NOT NULL AND size IS NOT NULL)"
_TIERS = f"""WITH RECURSIVE {S.BASE}, {_EXACT}, x1 AS (SELECT group_no, file_id, confidence FROM ex WHERE n >= 2), fr AS (SELECT * FROM rec WHERE file_id NOT IN (SELECT file_id FROM x1)),
e AS ({S.edges(8, "fr")}), {S.leaders("e")}, lo AS (SELECT leader, min(distance) md FROM grp GROUP BY leader),
nr AS (SELECT g.leader group_no, g.file_id, greatest(0.1, 1 - md / 8.0) confidence FROM grp g JOIN lo USING (leader)),
m AS (SELECT 'exact' tier, * FROM x1 UNION ALL SELECT 'near', * FROM nr),
t AS (SELECT tier, group_no, m.file_id, confidence, rec.size, CASE WHEN row_number() OVER (PARTITION BY tier, group_no ORDER BY {S.ORDER.replace("file_id", "rec.file_id")}) = 1 THEN 'original' ELSE 'duplicate' END AS role FROM m JOIN rec ON rec.file_id = m.file_id)
"""


def oracle_sql() -> dict[str, str]:
    index = f"""WITH {S.CURRENT}, {S.FEATURES}, ix AS (SELECT cur.id file_id, path, {", ".join(f"lower(lpad(to_hex({h}), 16, '0')) {h}" for h in HASHES)} FROM cur JOIN feat ON feat.file_id = cur.id WHERE phash IS NOT NULL) """
    group = "SELECT g.leader group_no, g.file_id, greatest(0.1, 1 - md / 8.0) confidence FROM grp g JOIN (SELECT leader, min(distance) md FROM grp GROUP BY leader) USING (leader)"
    return {
        "s09_load_records": f"WITH {S.BASE} SELECT file_id, path, size, dims_w, dims_h, fast_hash, sha256 FROM rec",
        "s10_index_rows": index + "SELECT * FROM ix",
        "s10_index_stats": index + "SELECT count(*) files, count(DISTINCT phash) phash_values, count(DISTINCT dhash) dhash_values, count(DISTINCT whash) whash_values FROM ix",
        "a01_exact_groups": f"WITH {S.BASE}, {_EXACT} SELECT group_no, file_id, confidence FROM ex WHERE n >= 2",
        "a01_exact_no_sha": f"WITH {S.BASE}, ex AS (SELECT min(file_id) OVER w group_no, file_id, 0.95::DOUBLE confidence, count(*) OVER w n FROM rec WHERE fast_hash IS NOT NULL AND size IS NOT NULL WINDOW w AS (PARTITION BY size, fast_hash)) SELECT group_no, file_id, confidence FROM ex WHERE n >= 2",
        "w01_original_selection": f"""WITH {S.CURRENT}, m AS (SELECT DISTINCT group_id, file_id FROM group_members), r AS (SELECT group_id, file_id, count(*) OVER (PARTITION BY group_id) members, row_number() OVER (PARTITION BY group_id ORDER BY {S.ORDER}) rn FROM m JOIN cur ON cur.id = m.file_id)
SELECT group_id group_no, file_id original_id, members FROM r WHERE rn = 1""",
        "a03_hash_group_counts": f"WITH {S.FEATURES} SELECT lower(lpad(to_hex(phash), 16, '0')) phash, count(*) files, min(file_id) first_id FROM feat WHERE phash IS NOT NULL GROUP BY feat.phash HAVING count(*) > 1",
        "j08_near_pairs_r6": _pairs(6), "j08_near_pairs_r8": _pairs(8), "j08_near_pairs_r12": _pairs(12),
        "j09_near_pairs_multi": _MULTI + "SELECT * FROM q",
        "f02_similarity_score": _MULTI + """SELECT a, b, round((coalesce(0.5 * pow(2, -phash / 8.0), 0) + coalesce(0.3 * pow(2, -dhash / 8.0), 0) + coalesce(0.2 * pow(2, -whash / 8.0), 0))
  / (CASE WHEN phash IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN dhash IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN whash IS NULL THEN 0 ELSE 0.2::DOUBLE END), 9) score FROM q""",
        "j11_similar_by_hash": f"""WITH {S.FEATURES}, w AS (SELECT file_id, phash FROM feat WHERE phash IS NOT NULL), ask AS (SELECT phash FROM w GROUP BY 1 HAVING count(*) > 1)
SELECT lower(lpad(to_hex(ask.phash), 16, '0')) query, file_id, bit_count(xor(ask.phash, w.phash)) distance FROM ask JOIN w ON {S.near("ask.phash", "w.phash", 8)}""",
        "f01_hamming_texts": """WITH f AS (SELECT file_id, lower(phash) p, lower(dhash) d FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1)
SELECT file_id, CASE WHEN length(p) = length(d) AND regexp_full_match(p, '[0-9a-f]{1,16}') AND regexp_full_match(d, '[0-9a-f]{1,16}') THEN bit_count(xor(('0x' || p)::UBIGINT, ('0x' || d)::UBIGINT)) END distance FROM f""",
        "p11_hash_similar": f"WITH {S.FEATURES} SELECT file_id, " + ", ".join(f"coalesce({S.near('phash', 'dhash', r)}, false) within_{p.lower().replace('-', '_')}" for p, r in grouping.RADIUS.items()) + " FROM feat",
        "g01_near_groups_r8": f"WITH RECURSIVE {S.BASE}, e AS ({S.edges(8)}), {S.leaders('e')} {group}",
        "g01_near_groups_strict_r6": f"""WITH RECURSIVE {S.BASE}, e AS ({S.edges(6, extra="coalesce(abs(CASE WHEN x.exif_dt <> 0 AND NOT isnan(x.exif_dt) THEN x.exif_dt END - CASE WHEN y.exif_dt <> 0 AND NOT isnan(y.exif_dt) THEN y.exif_dt END) <= 60, true)")}), {S.leaders("e")} SELECT leader group_no, file_id FROM grp""",
        "g03_two_tier": _TIERS + "SELECT tier, group_no, file_id, role, confidence FROM t",
        "a04_group_summary": _TIERS + """, per AS (SELECT tier, group_no, any_value(confidence) c, count(*) n, count(*) FILTER (role = 'duplicate') d FROM t GROUP BY 1, 2)
SELECT count(*) total_groups, count(*) FILTER (tier = 'exact') exact_groups, count(*) FILTER (tier = 'near') near_groups, sum(n)::BIGINT total_files, sum(d)::BIGINT total_duplicates, count(*) FILTER (c >= 0.8) high,
  count(*) FILTER (c >= 0.5 AND c < 0.8) medium, count(*) FILTER (c < 0.5) low, (SELECT sum(size)::BIGINT FROM (SELECT DISTINCT file_id, size FROM t WHERE role = 'duplicate')) space_savings FROM per""",
        "a05_group_details": _TIERS + "SELECT tier, group_no, count(*) files, tier || '_duplicates' reason, printf('confidence:%.3f|files:%d', any_value(confidence), count(*)) score_summary FROM t GROUP BY tier, group_no",
        "i11_threshold_sweep": f"""WITH {S.FEATURES}, v AS (SELECT DISTINCT phash v FROM feat WHERE phash IS NOT NULL), p AS (SELECT x.v a, y.v b, bit_count(xor(x.v, y.v)) d FROM v x JOIN v y ON x.v < y.v AND {S.near("x.v", "y.v", 12)}),
f AS (SELECT v, min(d) d FROM (SELECT a v, d FROM p UNION ALL SELECT b, d FROM p) GROUP BY v)
SELECT r::INT radius, (SELECT count(*) FROM p WHERE d <= r) pairs, (SELECT count(*) FROM f WHERE d <= r) "values" FROM range(13) t(r)""",
        "p09_dims_compatible": f"""WITH {S.CURRENT}, m AS (SELECT DISTINCT group_id, file_id FROM group_members), r AS (SELECT m.group_id, m.file_id, dims_w, dims_h, CASE WHEN exif_dt <> 0 AND NOT isnan(exif_dt) THEN exif_dt END dt FROM m JOIN cur ON cur.id = m.file_id)
SELECT x.group_id, x.file_id file_id_a, y.file_id file_id_b, {S.compatible("x", "y")} dims_fit, coalesce(abs(x.dt - y.dt) <= 60, true) times_fit FROM r x JOIN r y ON x.group_id = y.group_id AND x.file_id < y.file_id""",
        "j16_tuner_groups": f"""WITH RECURSIVE {S.CURRENT}, f AS (SELECT file_id, size, {S.digits("dhash", 16)} t FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) ft JOIN cur ON cur.id = ft.file_id WHERE rn = 1),
p AS (SELECT x.file_id a, y.file_id b, x.size sa, y.size sb, hamming(x.t, y.t) distance FROM f x JOIN f y ON x.file_id < y.file_id WHERE x.t IS NOT NULL AND y.t IS NOT NULL),
e AS (SELECT a, b, distance FROM p WHERE distance <= 5 AND (coalesce(sa, 0) <= 0 OR coalesce(sb, 0) <= 0 OR abs(sa - sb) / greatest(sa, sb) <= 0.1)), {S.leaders("e")} SELECT leader, file_id, distance FROM grp""",
        "j16_tuner_groups_all": f"""WITH RECURSIVE {S.CURRENT}, f AS (SELECT cur.id file_id, cur.size, t FROM cur LEFT JOIN (SELECT file_id, {S.digits("phash", 16)} t FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1) ft ON ft.file_id = cur.id),
e AS (SELECT x.file_id a, y.file_id b, 0 distance FROM f x JOIN f y ON x.file_id < y.file_id WHERE coalesce(hamming(x.t, y.t) <= 5, true) AND (coalesce(x.size, 0) <= 0 OR coalesce(y.size, 0) <= 0 OR abs(x.size - y.size) / greatest(x.size, y.size) <= 0.1)),
{S.leaders("e")} SELECT leader, file_id FROM grp""",
        "j10_neighbours_of_batch": f"""WITH {S.FEATURES}, w AS (SELECT file_id, phash FROM feat WHERE phash IS NOT NULL) SELECT x.file_id asked, y.file_id, bit_count(xor(x.phash, y.phash)) distance FROM w x JOIN w y ON x.file_id <> y.file_id AND {S.near("x.phash", "y.phash", 8)} WHERE x.file_id IN (SELECT file_id FROM batch_items WHERE batch_no = 6)""",
        "j10_neighbours_any_hash": f"""WITH {S.FEATURES}, w AS (SELECT * FROM feat WHERE phash IS NOT NULL), q AS (SELECT * FROM w WHERE file_id % 100 = 0 OR file_id IN (SELECT file_id FROM batch_items WHERE batch_no = 6)),
p AS (SELECT x.file_id asked, y.file_id, {", ".join(f"CASE WHEN {S.near(f'x.{h}', f'y.{h}', 8)} THEN bit_count(xor(x.{h}, y.{h})) END {h}" for h in HASHES)} FROM q x JOIN w y ON x.file_id <> y.file_id)
SELECT *, least(phash, dhash, whash) min_distance FROM p WHERE least(phash, dhash, whash) IS NOT NULL""",
        "i11_threshold_groups": f"""WITH RECURSIVE {S.FEATURES}, w AS (SELECT file_id i, phash v FROM feat WHERE phash IS NOT NULL), p AS (SELECT x.i a, y.i b, bit_count(xor(x.v, y.v)) distance FROM w x JOIN w y ON x.i < y.i AND {S.near("x.v", "y.v", 12)}),
e AS (SELECT a * 16 + r a, b * 16 + r b, distance FROM p JOIN range(13) t(r) ON distance <= r), {S.leaders("e")}, f AS (SELECT i, min(distance) d FROM (SELECT a i, distance FROM p UNION ALL SELECT b, distance FROM p) GROUP BY i)
SELECT r::INT radius, (SELECT count(*) FROM p WHERE distance <= r) pairs, (SELECT count(*) FROM f WHERE d <= r) files, (SELECT count(DISTINCT leader) FROM grp WHERE leader % 16 = r) "groups" FROM range(13) t(r)""",
        "g02_size_groups": f"""WITH RECURSIVE e AS (SELECT x.doc_id a, y.doc_id b, 0 distance FROM documents x JOIN documents y ON x.source = y.source AND x.doc_id < y.doc_id AND x.n_chars > 0 AND y.n_chars > 0 AND abs(x.n_chars - y.n_chars) / greatest(x.n_chars, y.n_chars) <= 0.001),
{S.leaders("e")} SELECT leader, file_id doc_id FROM grp""",
        "g02_file_size_groups": f"""WITH RECURSIVE {S.CURRENT}, n AS (SELECT id, size, row_number() OVER (ORDER BY id) rn FROM cur WHERE size > 0),
st AS (SELECT 0::BIGINT rn, []::BIGINT[] led UNION ALL SELECT n.rn, CASE WHEN len(list_filter(led, lambda l: abs(l - size) / greatest(l, size) <= 0.1)) > 0 THEN led ELSE list_append(led, size) END FROM st JOIN n ON n.rn = st.rn + 1),
ld AS (SELECT min(id) leader, size FROM n WHERE size IN (SELECT unnest(led) FROM st WHERE rn = (SELECT max(rn) FROM st)) GROUP BY size),
g AS (SELECT min(leader) leader, n.id file_id FROM n JOIN ld ON abs(n.size - ld.size) / greatest(n.size, ld.size) <= 0.1 WHERE n.id NOT IN (SELECT leader FROM ld) GROUP BY n.id)
SELECT * FROM g UNION ALL SELECT DISTINCT leader, leader FROM g""",
    }
