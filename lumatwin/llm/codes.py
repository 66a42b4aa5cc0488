"""Most similar vectors by randomly rotated one-bit codes.

A vector is rotated by a random orthogonal matrix; the signs of the result are its code and the length of its projection on the code's
direction is its correction scalar.

Sign vectors (``neighbours``: 192 bits, three 64-bit hashes). Of two codes that differ in H of 192 places, (1 - 2H/192) / (s_a s_b) estimates
the arcsine of the vectors' cosine: for two directions at angle t a rotated sign differs with probability t/pi, and the scalars replace the mean
shortening sqrt(2/pi) of each code by its own. The standard error of H is known too, so a pair is dropped only where its estimate plus
``z`` errors stays below the cosine of the radius. The others are reranked by their exact distance. Which codes meet is decided by cells:
each of ``tables`` draws ``bits`` of the 192 places evenly from the three hashes, and vectors that agree in all of them share a cell. Bits grow
with the logarithm of the number of vectors, and the number of tables follows from the recall wanted for a pair at the very radius; nearer
pairs are found more surely. Equal vectors are one class with its six smallest ids: copies never meet each other.

Numeric vectors (``similar``: any dimension, by cosine). Centres of cells are fitted on a bounded sample; every vector lies in the cell of its
nearest centre and asks the cells of its ``probes`` nearest ones. Codes are those of the normalised differences from the centre, so only bits
and three scalars of a vector are moved to be compared. An inner product is estimated from bits and scalars with its error bound; of each
cell, those go on whose upper bound isn't below the k-th best lower bound, and they are reranked by exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatwin.functions.hashes import hamming
from lumatwin.stage import Stage, spread

DIM, WORDS = 192, 3


def rotation(seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((DIM, DIM)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def table_count(bits: int, radius: int, recall: float) -> int:
    """Tables needed for a pair at the radius to share a cell with probability recall."""
    agree = math.prod((DIM - radius - k) / (DIM - k) for k in range(bits))
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


#: Cost of comparing two codes of a cell, where copying one to a cell costs 1.
COMPARE = 0.03


def cell_plan(count: int, radius: int, recall: float) -> int:
    """The number of bits of a cell that is cheapest for so many vectors."""
    cost = lambda bits: (t := table_count(bits, radius, recall)) * (count + COMPARE * count * count / 2 / 2**bits)
    return min(range(6, 31), key=cost)


def cell_bits(tables: int, bits: int, seed: int) -> np.ndarray:
    """The places each table draws: about a third of them from each hash, so one constant hash spoils no table."""
    rng = np.random.default_rng(seed + 1)
    out = []
    for k in range(tables):
        share = [bits // WORDS + ((w + k) % WORDS < bits % WORDS) for w in range(WORDS)]
        out.append(np.concatenate([w * 64 + rng.choice(64, n, replace=False) for w, n in enumerate(share)]))
    return np.array(out)


def unpacked(words: list[np.ndarray]) -> np.ndarray:
    """Three columns of 64-bit numbers as rows of 192 zeros and ones."""
    return np.concatenate([np.unpackbits(w.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1) for w in words], axis=1)


def packed(bits: np.ndarray) -> list[np.ndarray]:
    raw = np.packbits(bits, axis=1)
    return [np.ascontiguousarray(raw[:, 8 * w : 8 * w + 8]).view(">i8").ravel().astype(np.int64) for w in range(WORDS)]


def encode(words: list[np.ndarray], turn: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of sign vectors as three numbers each, and the correction scalars."""
    signs = unpacked(words).astype(np.float32) * 2 - 1
    turned = signs @ turn / np.float32(math.sqrt(DIM))
    return packed((turned > 0).astype(np.uint8)), np.abs(turned).sum(axis=1, dtype=np.float64) / math.sqrt(DIM)


def least_estimate(radius: int, z: float) -> float:
    """The smallest (1 - 2H/192) / (s_a s_b) that a pair within the radius may have but for z standard errors."""
    cos = 1 - 2 * radius / DIM
    p = math.acos(cos) / math.pi
    return math.asin(cos) - z * 2 * math.sqrt(p * (1 - p) / DIM) * math.pi / 2


def neighbours(spark: SparkSession, vectors: DataFrame, k: int = 5, radius: int = 24, bits: int | None = None, recall: float = 0.999, z: float = 4.5, seed: int = 7) -> DataFrame:
    """(id, other, distance): for each vector the k others of smallest distance, smaller id first, not farther than radius.

    vectors(id, a, b, c): an id and three 64-bit numbers; rows with a null take no part. Distances are exact; at a distance of
    radius a pair is found with probability recall, at smaller ones with more. Equal vectors are at distance 0 of each other. Empty
    input gives an empty result.
    """
    stage = Stage(spark, "codes")
    vectors = vectors.select("id", "a", "b", "c").where("id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL").distinct()
    code = ["a", "b", "c"]
    # the smallest ids of each class, cut off in each partition before anything is shuffled
    ranked = vectors.withColumn("n", F.row_number().over(Window.partitionBy(*code).orderBy("id"))).where(F.col("n") <= k + 1)
    classes = stage.write(ranked.groupBy(*code).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cls", F.col("ids")[0]), "plain")
    bits = bits or cell_plan(classes.count(), radius, recall)
    tables = table_count(bits, radius, recall)
    places = cell_bits(tables, bits, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(seed)
        weights = (1 << np.arange(bits)).astype(np.int64)
        for x in batches:
            words = [x[w].to_numpy() for w in code]
            plain = unpacked(words)
            cells = np.stack([(plain[:, at] * weights).sum(axis=1) + (t << bits) for t, at in enumerate(places)], axis=1)
            found, scalar = encode(words, turn)
            offsets = np.arange(0, cells.size + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([x["cls"], x["ids"], *[x[w] for w in code], *map(pa.array, found), pa.array(scalar.astype(np.float32)), pa.ListArray.from_arrays(offsets, cells.ravel())], ["cls", "ids", *code, "r0", "r1", "r2", "s", "cells"])

    schema = "cls long, ids array<long>, a long, b long, c long, r0 long, r1 long, r2 long, s float, cells array<long>"
    classes = stage.write(spread(classes.select("cls", "ids", *code)).mapInArrow(coded, schema), "classes")
    side = lambda n: classes.select(F.explode("cells").alias("cell"), *[F.col(x).alias(f"{x}_{n}") for x in ("cls", "r0", "r1", "r2", "s")])
    differing = hamming(F.col("r0_x"), F.col("r0_y")) + hamming(F.col("r1_x"), F.col("r1_y")) + hamming(F.col("r2_x"), F.col("r2_y"))
    likely = 1 - differing / F.lit(DIM / 2) >= F.lit(least_estimate(radius, z)) * F.col("s_x") * F.col("s_y")
    met = side("x").join(side("y"), "cell").where((F.col("cls_x") < F.col("cls_y")) & likely).select("cls_x", "cls_y").distinct()
    # rerank by exact distance
    full = lambda n: classes.select(F.col("cls").alias(f"cls_{n}"), *[F.col(w).alias(f"{w}_{n}") for w in code], F.col("ids").alias(f"ids_{n}"))
    exact = sum((hamming(F.col(f"{w}_x"), F.col(f"{w}_y")) for w in code), F.lit(0)).alias("d")
    pairs = met.join(full("x"), "cls_x").join(full("y"), "cls_y").select("cls_x", "cls_y", "ids_x", "ids_y", exact).where(F.col("d") <= radius)
    both = pairs.select(F.col("cls_x").alias("cls"), F.col("cls_y").alias("near"), F.col("ids_y").alias("ids"), "d").union(pairs.select("cls_y", "cls_x", "ids_x", "d"))
    listed = _listed(classes.select("cls", "ids", *code), both, k, "int")
    return vectors.join(listed, code).select("id", _others(k)).select("id", F.col("p.id").alias("other"), F.col("p.d").alias("distance"))


def _listed(classes: DataFrame, both: DataFrame, k: int, kind: str) -> DataFrame:
    """classes(cls, ids, ...) with ``list``: the ids of the class itself at distance 0 and those of its nearest classes, in order. both(cls, near, ids, d): distances seen from either side."""
    # any of a class's k nearest files is in one of its k nearest classes by (distance, smallest id)
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("d", "near"))).where(F.col("n") <= k)
    near = first.groupBy("cls").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))))).alias("near"))
    own = F.transform("ids", lambda i: F.struct(F.lit(0).cast(kind).alias("d"), i.alias("id")))
    return classes.join(near, "cls", "left").withColumn("list", F.array_sort(F.concat(own, F.coalesce("near", F.array().cast(f"array<struct<d:{kind},id:bigint>>"))))).drop("near")


def _others(k: int) -> Column:
    """The first k of ``list`` but the row's own id, one a row, as p."""
    return F.explode(F.slice(F.filter("list", lambda p: p["id"] != F.col("id")), 1, k)).alias("p")


# --- numeric vectors ---------------------------------------------------------------------------------------------------

#: Vectors of a cell on average, and in one task at most; cells at most; rows of the sample that centres are fitted on.
CELL, TASK, MOST_CELLS, SAMPLE = 1024, 4096, 65_536, 50_000


def turn_of(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres_of(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of cells: rows of the sample, moved to the means of their cells where the sample has eight rows for each."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(4 if len(sample) >= 8 * cells else 0):
        own = np.argmax(sample @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rows(values: np.ndarray) -> pa.Array:
    n, dim = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), pa.array(np.ascontiguousarray(values, np.float32).ravel()))


def estimates(codes: np.ndarray, scalars: np.ndarray, asked: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors with rotated ``asked`` ones (rows: asked), and their error bounds: z standard errors."""
    dim = asked.shape[1]
    signs = (np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    spread_ = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / math.sqrt(max(dim - 1, 1))
    return (asked @ signs.T) / scalars, np.broadcast_to(z * spread_, (len(asked), len(codes)))


def similar(spark: SparkSession, vectors: DataFrame, k: int = 5, probes: int = 8, z: float = 3.0, seed: int = 7, cell: int = CELL) -> DataFrame:
    """(id, other, cosine): for each vector the k others of largest cosine among those in the cells of its nearest centres, smaller id first.

    vectors(id, vector array<float>). Vectors take part that have the length of the longest one, no null or NaN in them and a length above 0.
    Equal directions are at cosine 1 of each other. With few vectors there is one cell, and only the error bound can lose a neighbour.
    Cells are of about ``cell`` vectors, whatever their number (up to MOST_CELLS cells, then larger), so comparisons grow in proportion to the
    vectors; crowded cells are cut into tasks of at most TASK vectors. Empty input gives an empty result.
    """
    stage = Stage(spark, "similar")
    known = stage.write(vectors.select("id", F.col("vector").cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"), "known")
    dim = known.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "id long, other long, cosine double")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = _matrix(x["v"], dim).astype(np.float64)
            length = np.sqrt((v * v).sum(axis=1))
            ok = np.isfinite(length) & (length > 0)
            yield pa.RecordBatch.from_arrays([x["id"].filter(pa.array(ok)), _rows((v[ok] / length[ok, None]).astype(np.float32))], ["id", "v"])

    whole = (F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e))
    units = stage.write(spread(known.where(whole)).mapInArrow(unit, "id long, v array<float>").distinct(), "units")
    ranked = units.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = stage.write(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "v"), "classes")
    count = classes.count()
    if not count:
        return spark.createDataFrame([], "id long, other long, cosine double")
    cells = min(MOST_CELLS, max(1, count // cell))
    sample = np.array([r.v for r in classes.orderBy(F.xxhash64("cls", F.lit(seed))).select("v").limit(max(SAMPLE, cells)).collect()], np.float32)
    centres, turn = spark.sparkContext.broadcast(centres_of(sample, cells, seed)), turn_of(dim, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        half = (c**2).sum(axis=1) / 2
        for x in batches:
            v = _matrix(x["v"], dim)
            near = v @ c.T - half
            top = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, len(c))]
            home = c[top[:, 0]]
            rest = v - home
            r = np.sqrt((rest**2).sum(axis=1))
            turned = (rest / np.where(r > 0, r, 1)[:, None]) @ turn
            scalar = np.abs(turned).sum(axis=1) / np.float32(math.sqrt(dim))
            packed_ = [b.tobytes() for b in np.packbits((turned > 0).astype(np.uint8), axis=1)]
            arrays = [x["cls"], _lists_of(top.astype(np.int32)), pa.array(packed_, pa.binary()), pa.array(scalar.astype(np.float32)), pa.array(r.astype(np.float32)), pa.array((v * home).sum(axis=1).astype(np.float32))]
            yield pa.RecordBatch.from_arrays(arrays, ["cls", "cells", "code", "s", "r", "oc"])

    placed = stage.write(spread(classes.select("cls", "v")).mapInArrow(coded, "cls long, cells array<int>, code binary, s float, r float, oc float"), "placed")
    member = placed.select(F.col("cells")[0].alias("cell"), "cls", "code", "s", "r", "oc")
    query = placed.select(F.explode("cells").alias("cell"), "cls")
    parts = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TASK)).cast("int").alias(n))
    sizes = stage.write(parts(member, "m").join(parts(query, "q"), "cell"), "sizes")  # a row for each cell, MOST_CELLS at most
    piece = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int").alias(f"{n}c")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(f"{n}c")
    none = lambda kind: F.lit(None).cast(kind)
    left = member.join(F.broadcast(sizes), "cell").select("cell", piece("m"), every("q"), "cls", "code", "s", "r", "oc", none("array<float>").alias("v"))
    right = query.join(F.broadcast(sizes), "cell").select("cell", every("m"), piece("q"), "cls").join(classes.select("cls", "v"), "cls")
    right = right.select("cell", "mc", "qc", "cls", none("binary").alias("code"), none("float").alias("s"), none("float").alias("r"), none("float").alias("oc"), "v")

    def compared(g: pd.DataFrame) -> pd.DataFrame:
        c = centres.value[g["cell"].iloc[0]]
        is_member = g["code"].notna()
        m, q = g[is_member], g[~is_member]
        out = {"cls": [], "near": [], "low": [], "high": []}
        if len(m) and len(q):
            codes = np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(m), -1)
            scalars, r, oc = (np.maximum(m[n].to_numpy(np.float64), 1e-9) if n == "s" else m[n].to_numpy(np.float64) for n in ("s", "r", "oc"))
            ids, asked = m["cls"].to_numpy(), q["cls"].to_numpy()
            vs = np.stack(q["v"].to_numpy()).astype(np.float32)
            for at in range(0, len(asked), 512):
                v = vs[at : at + 512]
                rest = v - c
                length = np.sqrt((rest**2).sum(axis=1))
                estimate, bound = estimates(codes, scalars, (rest / np.where(length > 0, length, 1)[:, None]) @ turn, z)
                scale = length[:, None] * r[None, :]
                middle = estimate * scale + oc[None, :] + (v @ c)[:, None] - float(c @ c)
                low, high = middle - bound * scale, middle + bound * scale
                self_ = ids[None, :] == asked[at : at + 512, None]
                low[self_], high[self_] = -9, -9
                kth = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if low.shape[1] >= k else np.full((len(v), 1), -8.0)
                i, j = np.nonzero(high >= np.maximum(kth, -8))
                for n, values in zip(out, (asked[at + i], ids[j], low[i, j], high[i, j])):
                    out[n].append(values)
        return pd.DataFrame({n: np.concatenate(v) if v else np.array([], np.int64 if n in ("cls", "near") else float) for n, v in out.items()})

    met = left.unionByName(right).groupBy("cell", "mc", "qc").applyInPandas(compared, "cls long, near long, low double, high double")
    met = stage.write(met, "met")
    kth = met.groupBy("cls").agg(F.try_element_at(F.sort_array(F.collect_list("low"), False), F.lit(k)).alias("least"))
    chosen = met.join(kth, "cls").where("least IS NULL OR high >= least").select("cls", "near")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cosine = (_matrix(x["v"], dim).astype(np.float64) * _matrix(x["w"], dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([x["cls"], x["near"], x["ids"], pa.array(-np.minimum(cosine, 1.0))], ["cls", "near", "ids", "d"])

    pairs = chosen.join(classes.select("cls", "v"), "cls").join(classes.select(F.col("cls").alias("near"), F.col("v").alias("w"), "ids"), "near")
    pairs = stage.write(pairs.select("cls", "near", "ids", "v", "w").mapInArrow(exact, "cls long, near long, ids array<long>, d double"), "pairs")
    own = classes.select("cls", "ids", "v")
    shifted = pairs.withColumn("d", F.col("d") + 1.0)  # a class itself is at 0
    listed = _listed(own, shifted, k, "double")
    return units.join(listed, "v").select("id", _others(k)).select("id", F.col("p.id").alias("other"), (1.0 - F.col("p.d")).alias("cosine"))


def _lists_of(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(values.ravel()))
