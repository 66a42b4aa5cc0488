"""Queries and operators against plain code that does the whole job."""

from __future__ import annotations

import random

from lumatwin.operators import greedy
from lumatwin.plans import catalog
from lumatwin.tables import current_files


def greedy_groups(items, similar):
    """(leader, id): going through items by id, each free one takes all free ones similar to it."""
    used, out = set(), set()
    for k, x in enumerate(items):
        if x[0] not in used and (group := [y[0] for y in items[k + 1 :] if y[0] not in used and similar(x, y)]):
            used.update(group)
            out.update((x[0], y) for y in [x[0], *group])
    return out


def sizes_fit(x, y):
    return abs(x[1] - y[1]) / max(x[1], y[1]) <= 0.1


# --- sizes (G02, J17) ---


def test_size_groups_take_all_files(spark, tiny):
    files = sorted(map(tuple, current_files(spark, tiny, ["id", "last_seen_at", "size"]).where("size > 0").select("id", "size").collect()))
    got = catalog.queries()["g02_file_size_groups"](spark, tiny).select("leader", "file_id")
    assert {tuple(r) for r in got.collect()} == greedy_groups(files, sizes_fit)


def test_size_groups_at_the_edge(spark):
    rng = random.Random(2)
    items = [(k, rng.choice([90, 100, 810, 900, 1000, 10**9, rng.randrange(1, 3000)])) for k in range(1, 200)]
    got = greedy.similar_groups(spark, spark.createDataFrame(items, "id long, size long"), 0.1)
    assert {tuple(r) for r in got.collect()} == greedy_groups(items, sizes_fit)


# --- sizes and hashes (J16) ---


def tuner_fits(x, y):
    if (x[1] or 0) > 0 and (y[1] or 0) > 0 and not sizes_fit(x, y):
        return False
    digits = lambda v: f"{v % 2**64:016x}"
    return x[2] is None or y[2] is None or sum(a != b for a, b in zip(digits(x[2]), digits(y[2]))) <= 5


def test_tuner_takes_items_without_a_hash_or_size(spark):
    rng = random.Random(3)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    base, items = [rng.getrandbits(64) for _ in range(12)], []
    for k in range(1, 250):
        near = sum(rng.randrange(16) << 4 * d for d in rng.sample(range(16), rng.randrange(7)))
        size = rng.choice([0, None, 90, 100]) if k > 60 and rng.random() < 0.1 else rng.randrange(1, 10**5)
        items.append((k, size, None if rng.random() < 0.15 else signed(rng.choice(base) ^ near)))
    got = {tuple(r) for r in greedy.similar_groups(spark, spark.createDataFrame(items, "id long, size long, value long"), 0.1, 5).collect()}
    assert got == greedy_groups(items, tuner_fits)
    assert {k for k, _, v in items if v is None} & {k for _, k in got}


# --- neighbours (J10) and radii (I11) ---


def tables(spark, to, hashes):
    spark.createDataFrame([(k, *h, 1) for k, h in hashes.items()], "file_id long, phash string, dhash string, whash string, feature_ver int").write.parquet(f"{to}/features.parquet")
    spark.createDataFrame([(6, 7)], "batch_no int, file_id long").write.parquet(f"{to}/batch_items.parquet")
    return str(to)


A, B, C = "0123456789abcdef", "fedcba9876543210", "0f1e2d3c4b5a6978"


def test_neighbours_by_any_hash(spark, tmp_path):
    d = tables(spark, tmp_path, {100: (A, A, None), 7: (B, B, B), 8: (C, A[:-1] + "e", None), 9: (A[:-1] + "c", None, B), 10: (None, A, B)})
    got = {tuple(r) for r in catalog.queries()["j10_neighbours_any_hash"](spark, d).select("asked", "file_id", "phash", "dhash", "whash", "min_distance").collect()}
    assert got == {(100, 8, None, 1, None, 1), (100, 9, 2, None, None, 2), (7, 9, None, None, 0, 0)}


def test_radii_count_copies_and_groups(spark, tmp_path):
    d = tables(spark, tmp_path, {1: (A,) * 3, 2: (A,) * 3, 3: (A[:-1] + "e",) * 3, 4: (B,) * 3, 5: (B,) * 3, 6: (C,) * 3})
    got = {r.radius: (r.pairs, r["files"], r.groups) for r in catalog.queries()["i11_threshold_groups"](spark, d).collect()}
    assert got == {0: (2, 4, 2)} | {r: (4, 5, 2) for r in range(1, 13)}
