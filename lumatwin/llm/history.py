"""Deduplicating batches against all history with multi-key sorted-neighbourhood runs.

Every record is stored under several keys. A key of its perceptual hash is the hash with some of its blocks moved to the front: all hashes
that share the leading bits form one window, and within the radius two hashes share at least one window. Two more keys, the whole hash and the
SHA-256, lead from a value to the files that have it. The keys live in runs: tables sorted by key and cut into files of a bounded number of
rows, with the key range of each file known (its fence).

A batch becomes a small sorted run of its own. Its keys are laid beside the fences of the older runs, and only those files are read in which
one of its keys can be; within them, only rows of the same windows are compared. So what a batch reads grows with its own keys, not with the
history. Several batches that wait are accepted in one pass: each is a run, and meets the older ones and those before it. Runs of like size are
merged when there are ``fan`` of them, so that a row is written again only as often as the history has grown by that factor. The runs hold
all that's needed to name pairs of files: another session opens them and goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions.hashes import hamming
from lumatwin.operators import hamming as hamming_join
from lumatwin.stage import Stage

#: Rows of one file of a run at most. A key of a batch makes one such file be read, or two if its window lies on an edge.
FILE_ROWS = 200_000
#: Rows below which runs count as of one size.
LEAST_ROWS = 100_000
#: Rows of new batches up to which their window keys are sent to every task instead of shuffling what they meet: 24 bytes each.
MOST_BROADCAST = 1_000_000
#: The upper byte of a key: windows, whole hashes, SHA-256.
WINDOW, WHOLE, SHA = 0, 1, 2
SCHEMA = "key long, value long, sha string, file_id long"


@dataclass
class Run:
    """A sorted table of keys at a path; fences: for each of its files the path, first and last key, rows and bytes; crowded: its windows of more than hamming.CROWD values, if there are some."""

    path: str
    rows: int
    fences: list[tuple[str, int, int, int, int]]
    crowded: DataFrame | None = None

    @property
    def level(self) -> int:
        return math.floor(math.log(max(self.rows / LEAST_ROWS, 1), 4))


def _key(kind: int, number: Column) -> Column:
    """A key of a kind: the kind above 56 bits of the number."""
    return F.shiftrightunsigned(number, 8).bitwiseOR(F.lit(kind << 56).cast("long"))


def _whole(value: Column) -> Column:
    return _key(WHOLE, F.xxhash64(value))


def _sha(sha: Column) -> Column:
    return _key(SHA, F.xxhash64(sha))


class _Spans:
    """The fences of runs, laid out for searching; a file is known by its place in ``files``."""

    def __init__(self, runs: list[Run]) -> None:
        self.files = [f for r in runs for f in r.fences]
        self.runs, at = [], 0
        for r in runs:  # within a run, ranges ascend
            self.runs.append((at, np.array([f[1] for f in r.fences]), np.array([f[2] for f in r.fences])))
            at += len(r.fences)

    def hits(self, keys: np.ndarray, seen: np.ndarray) -> None:
        """Marks the files in whose ranges some of the keys lie."""
        for start, low, high in self.runs:
            first, last = np.searchsorted(high, keys, "left"), np.searchsorted(low, keys, "right")
            marks, some = np.zeros(len(low) + 1, np.int64), first < last
            np.add.at(marks, first[some], 1)
            np.add.at(marks, last[some], -1)
            seen[start : start + len(low)] |= np.cumsum(marks)[:-1] > 0


def _surveyed(batches: Iterator[pa.RecordBatch], spans: _Spans, crowd: int) -> Iterator[pa.RecordBatch]:
    """(hit, crowded) of a part of a sorted run: numbers of files in whose ranges its keys lie, and windows that stand in more than half of ``crowd`` rows on end.

    All windows with more than crowd rows in a run are among these, as a key lies in neighbouring files.
    """
    seen, last, n = np.zeros(len(spans.files), bool), None, 0
    for x in batches:
        keys, counts = np.unique(x["key"].to_numpy(), return_counts=True)
        if not len(keys):
            continue
        spans.hits(keys, seen)
        if keys[0] == last:
            counts[0] += n
        last, n = keys[-1], counts[-1]
        crowded = keys[(counts > crowd // 2) & (keys < WHOLE << 56)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(crowded), pa.int64()), pa.array(crowded)], ["hit", "crowded"])
    hit = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.nulls(len(hit), pa.int64())], ["hit", "crowded"])


@dataclass
class HistoryIndex:
    """The keys of all records accepted so far.

    radius: most differing bits of a near pair; fan: how many runs of like size are merged into one; expected: about how many different
    hashes the index will hold, which settles the length of window keys (they should have about log2 of it bits: then a window holds few
    others). It may be wrong by far: results don't depend on it. Null hashes match nothing; a record with neither hash is ignored.
    """

    spark: SparkSession
    radius: int = 6
    fan: int = 4
    expected: int = 1_000_000
    runs: list[Run] = field(default_factory=list)
    read: tuple[int, int] = (0, 0)

    def __post_init__(self) -> None:
        self.stage = Stage(self.spark, "history")
        self.plan = hamming_join.plan(self.radius, self.expected, self.expected**2 / 100, least=2)

    # --- runs ---

    def _keys(self, records: DataFrame) -> DataFrame:
        """records(batch_no, file_id, sha256, phash) under all their keys: each hash of a batch once under its windows, each file under its whole hash and its SHA-256."""
        hashed = records.where("phash IS NOT NULL")
        shared = hamming_join.windows(hashed.select("batch_no", F.col("phash").alias("value")).distinct(), "value", self.plan, "key")
        none, nobody = F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("file_id")
        parts = [
            shared.select("batch_no", "key", "value", none, nobody),
            hashed.select("batch_no", _whole(F.col("phash")).alias("key"), F.col("phash").alias("value"), none, "file_id"),
            records.where("sha256 IS NOT NULL").select("batch_no", _sha(F.col("sha256")).alias("key"), F.lit(None).cast("long").alias("value"), F.col("sha256").alias("sha"), "file_id"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def _save(self, keyed: DataFrame, rows: int) -> list[Run]:
        """keyed(batch_no, ...), about so many rows, as one sorted run for each batch. Files are ranges of keys, so one key is in one file, or in neighbouring ones if it has more rows than a file."""
        at = self.stage.path("run")
        cut = keyed.repartitionByRange(-(-rows // FILE_ROWS), "batch_no", "key", F.xxhash64("file_id", "value")) if rows > FILE_ROWS else keyed.coalesce(1)
        cut.sortWithinPartitions("batch_no", "key").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("batch_no").parquet(at)
        found = self.spark.read.schema(f"{SCHEMA}, batch_no int").parquet(at).groupBy("batch_no", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        files: dict[int, list] = {}
        for r in found.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).collect():  # one row a file
            files.setdefault(r.batch_no, []).append((r.file, r.low, r.high, r.n, r.bytes))
        return [Run(f"{at}/batch_no={k}", sum(f[3] for f in v), sorted(v, key=lambda f: f[1:3])) for k, v in sorted(files.items())]

    def _survey(self, runs: list[Run], older: list[Run]) -> list[str]:
        """Reads the keys of new runs once: notes their crowded windows, and returns the files of older runs in whose ranges some key lies. Only numbers of files reach the driver."""
        if not runs:
            return []
        spans, crowd = _Spans(older), hamming_join.CROWD
        rows = self.spark.read.schema(SCHEMA).parquet(*[r.path for r in runs]).select("key")
        found = self.stage.write(rows.mapInArrow(lambda batches: _surveyed(batches, spans, crowd), "hit long, crowded long"), "survey")
        seen = found.agg(F.collect_set("hit").alias("hits"), F.count("crowded").alias("n")).first()  # a number for each file at most
        if seen.n:
            crowded = found.where("crowded IS NOT NULL").select(F.col("crowded").alias("key"))
            for r in runs:
                r.crowded = crowded
        return self._chosen(spans, seen.hits)

    def _chosen(self, spans: _Spans, hits: list[int]) -> list[str]:
        fences = [spans.files[n] for n in sorted(hits)]
        self.read = (self.read[0] + len(fences), self.read[1] + sum(f[4] for f in fences))
        return [f[0] for f in fences]

    def manifest(self) -> dict:
        """What open() needs to go on with the runs in another session; their fences are written beside them."""
        for run in self.runs:
            at = f"{run.path}.fences"
            self.spark.createDataFrame(run.fences, "file string, low long, high long, rows long, bytes long").coalesce(1).write.mode("overwrite").parquet(at)
            crowded = run.crowded if run.crowded is not None else self.spark.createDataFrame([], "key long")
            crowded.write.mode("overwrite").parquet(f"{run.path}.crowded")
        return {"radius": self.radius, "fan": self.fan, "expected": self.expected, "runs": [r.path for r in self.runs]}

    @classmethod
    def open(cls, spark: SparkSession, manifest: dict) -> HistoryIndex:
        """The index of a manifest. Only fences are read now; whoever opens it last owns the runs: merging deletes merged ones."""
        index = cls(spark, manifest["radius"], manifest["fan"], manifest["expected"])
        for path in manifest["runs"]:
            fences = sorted((tuple(r) for r in spark.read.parquet(f"{path}.fences").collect()), key=lambda f: f[1:3])
            index.runs.append(Run(path, sum(f[3] for f in fences), fences))
            crowded = spark.read.schema("key long").parquet(f"{path}.crowded")
            index.runs[-1].crowded = None if crowded.isEmpty() else crowded
        return index

    def _drop(self, run: Run) -> None:
        self.stage.delete(run.path)
        self.stage.delete(f"{run.path}.fences")
        self.stage.delete(f"{run.path}.crowded")

    def close(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []

    def compact(self) -> None:
        """Merges runs of like size: of fan runs of one level one of a higher one is made. Called before new ones come."""
        while True:
            by = {k: [r for r in self.runs if r.level == k] for k in {r.level for r in self.runs}}
            full = next((runs for _, runs in sorted(by.items()) if len(runs) >= self.fan), None)
            if full is None:
                return
            rows = self.spark.read.schema(SCHEMA).parquet(*[r.path for r in full]).withColumn("batch_no", F.lit(0))
            windows = rows.where(F.col("key") < F.lit(WHOLE << 56)).distinct()
            merged = self._save(windows.unionByName(rows.where(F.col("key") >= F.lit(WHOLE << 56))), sum(r.rows for r in full))
            self._survey(merged, [])
            self.runs = [r for r in self.runs if r not in full] + merged
            for run in full:
                self._drop(run)

    # --- lookups ---

    def _old(self, files: list[str]) -> DataFrame:
        """The rows of some files of older runs, as of a batch before all others."""
        reader = self.spark.read.schema(SCHEMA)
        return (reader.parquet(*files) if files else self.spark.createDataFrame([], SCHEMA)).withColumn("batch_no", F.lit(-1))

    def load(self, records: DataFrame, count: int | None = None) -> None:
        """Accepts records(file_id, sha256, phash) without comparing them: the history before the first batch."""
        self.compact()
        runs = self._save(self._keys(records.withColumn("batch_no", F.lit(0))), (count if count is not None else records.count()) * (self.plan.keys() + 2))
        self._survey(runs, [])
        self.runs += runs

    def add(self, records: DataFrame) -> DataFrame:
        """Accepts a batch records(file_id, sha256, phash), one row per file. Returns the pairs (file_id_a, file_id_b), a < b, of a file of the batch and another one, accepted before or with it, that have equal sha256 or hashes within the radius."""
        return self.add_all(records.withColumn("batch_no", F.lit(0)))

    def add_all(self, records: DataFrame, count: int | None = None) -> DataFrame:
        """The same for several batches in the order of their batch_no, one row per file: a file is compared with those accepted before and those of batches up to its own."""
        self.compact()
        self.read = (0, 0)
        records = self.stage.write(records.select("file_id", "batch_no", "sha256", "phash").where("sha256 IS NOT NULL OR phash IS NOT NULL"), "batches")
        rows = (count if count is not None else records.count()) * (self.plan.keys() + 2)
        older, runs = self.runs, self._save(self._keys(records), rows)
        self.runs = older + runs
        if not runs:
            return self.stage.write(self.spark.createDataFrame([], "file_id_a long, file_id_b long"), "found")
        hits = self._survey(runs, older)
        fresh = self.spark.read.schema(f"{SCHEMA}, batch_no int").option("basePath", runs[0].path.rsplit("/", 1)[0]).parquet(*[r.path for r in runs])
        window = F.col("key") < F.lit(WHOLE << 56)
        asked = fresh.where(window).select("key", F.col("value").alias("a"), F.col("batch_no").alias("ab"))
        known = self._old(hits).union(fresh).where(window).select("key", F.col("value").alias("b"), F.col("batch_no").alias("bb"))
        near = self.stage.write(self._near(asked, known, rows).union(records.where("phash IS NOT NULL").select(F.col("phash").alias("a"), F.col("batch_no").alias("ab"), F.col("phash").alias("b")).distinct()).withColumn("key", _whole(F.col("b"))), "near")
        # files that have one of the hashes found
        spans, crowd = _Spans(older), hamming_join.CROWD
        more = near.select("key").mapInArrow(lambda batches: _surveyed(batches, spans, crowd), "hit long, crowded long").agg(F.collect_set("hit").alias("hits")).first().hits
        members = self._old(sorted({*hits, *self._chosen(spans, more)})).union(fresh)
        up_to = F.col("yb") <= F.col("ab")
        by_hash = members.where("value IS NOT NULL AND file_id IS NOT NULL").select("key", F.col("value").alias("b"), F.col("file_id").alias("y"), F.col("batch_no").alias("yb"))
        by_hash = by_hash.join(near, ["key", "b"]).where(up_to).join(records.select(F.col("phash").alias("a"), F.col("batch_no").alias("ab"), F.col("file_id").alias("x")), ["a", "ab"]).select("x", "y")
        shas = records.where("sha256 IS NOT NULL").select(_sha(F.col("sha256")).alias("key"), F.col("sha256").alias("sha"), F.col("file_id").alias("x"), F.col("batch_no").alias("ab"))
        by_sha = members.where("sha IS NOT NULL").select("key", "sha", F.col("file_id").alias("y"), F.col("batch_no").alias("yb")).join(shas, ["key", "sha"]).where(up_to).select("x", "y")
        found = by_hash.union(by_sha).where("x <> y").select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b")).distinct()
        return self.stage.write(found, "found")

    def _near(self, asked: DataFrame, known: DataFrame, rows: int) -> DataFrame:
        """(a, ab, b): the different hashes b of known(key, b, bb) within the radius of each hash a of asked(key, a, ab), of no later batch."""
        on, a, b = ["key"], F.col("a"), F.col("b")
        near = (a != b) & (F.col("bb") <= F.col("ab")) & (hamming(a, b) <= self.radius) & hamming_join.first_common(a, b, F.col("key"), self.plan)
        crowded = [r.crowded for r in self.runs if r.crowded is not None]
        if crowded:
            keys = reduce(DataFrame.union, crowded).distinct()
            asked, known = hamming_join.split(asked, keys, on, "a", self.plan), hamming_join.split(known, keys, on, "b", self.plan)
            on, near = ["key", "inner"], near & hamming_join.first_inner(a, b, F.col("inner"), self.plan)
        elif rows <= MOST_BROADCAST:  # counted
            asked = F.broadcast(asked)
        # the same hash may stand in several runs
        return known.join(asked, on).where(near).select("a", "ab", "b").distinct()


def batch_pairs(spark: SparkSession, members: DataFrame, radius: int = 6) -> DataFrame:
    """(file_id_a, file_id_b), a < b: files not both of batch 0 with equal sha256 or phash within radius.

    members(file_id, batch_no, sha256?, phash?), one row per file: usable hashes or null, which match nothing. Batch 0 is the history, the
    others wait and are accepted in their order; a pair comes out with its later file only. Copies are members of one hash, so hashes
    are compared once, and are expanded into pairs only in the result.
    """
    stage = Stage(spark, "batches")
    members = stage.write(members.select("file_id", "batch_no", "sha256", "phash").where("sha256 IS NOT NULL OR phash IS NOT NULL"), "members")
    old = F.col("batch_no") == 0
    sizes = members.agg(F.count_if(old).alias("old"), F.count_if(~old).alias("new")).first()
    index = HistoryIndex(spark, radius, expected=max(sizes.old + sizes.new, 1))
    index.load(members.where(old), sizes.old)
    found = index.add_all(members.where(~old), sizes.new)
    index.close()
    stage.drop(members)
    return found
