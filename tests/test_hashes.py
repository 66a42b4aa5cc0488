from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumatwin.functions.hashes import hash_long, hex_digits, hex_distance
from lumatwin.operators import hamming
from lumatwin.operators.hamming import near_values, plan, probe


def test_usable_digits(spark):
    good = "0123456789abcdef"
    cases = [(good, good), (good.upper(), good), ("0x" + good, good), ("0X" + good, good), (f" {good}\t", good), (f"phash:{good}\n", good), (f"phash={good}", good), ("0" * 16, None), ("f" * 16, None), ("g" + good[1:], None),
             (good[:15], None), (good + "0", None), ("", None), (None, None), ("error", None), ("x" * 100_000, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.d for r in df.select("k", hex_digits(F.col("t"), 16).alias("d")).collect()}
    assert [got[k] for k in range(len(cases))] == [e for _, e in cases]


def test_distances_of_texts(spark):
    cases = [("0000", "0000", 0), ("0001", "0000", 1), ("0003", "0001", 1), ("000f", "0000", 4), ("ff00ff00ff00ff00", "ff00ff00ff00ff01", 1), ("abcdef123456789a", "abcdef123456789b", 1), ("0" * 16, "f" * 16, 64), ("ff00", "00ff", 16),
             ("", "", None), ("ff", "ffff", None), ("xyz", "abc", None), (None, "00", None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: r.d for r in df.select("k", hex_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [got[k] for k in range(len(cases))] == [d for *_, d in cases]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def clustered(n: int, seed: int) -> list[int]:
    rng, out = random.Random(seed), []
    for _ in range(n // 4):
        base = rng.getrandbits(64)
        out += [base, *(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 14))) for _ in range(3))]
    return out


@pytest.mark.parametrize(("radius", "cost"), [(0, 0.03), (1, 0.03), (6, 0.03), (8, 0.03), (12, 0.03), (0, 1e9), (1, 1e9), (6, 1e9), (8, 1e9), (12, 100.0)])
def test_near_values_against_brute_force(spark, monkeypatch, radius, cost):
    monkeypatch.setattr(hamming, "COMPARE", cost)  # the dearer comparisons are, the longer are keys
    values = clustered(240, radius)
    df = spark.createDataFrame([(signed(v),) for v in values + values[:10]] + [(None,)], "value long")
    expected = {tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a != b and bin(a ^ b).count("1") <= radius}
    got = [(r.a, r.b) for r in near_values(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_plans():
    """Keys grow with the logarithm of the number of values; the blocks of a plan are all bits, once."""
    for radius in (0, 1, 6, 8, 12):
        frees = [plan(radius, n, n * n / 2).free for n in (10**k for k in range(2, 12))]
        assert frees == sorted(frees) and (radius < 6 or frees[0] < frees[-1])
        for free in range(1, 5):
            for turned in (False, True):
                p = hamming.Plan(radius, free, turned)
                assert sorted(p.order) == list(range(64)) and p.blocks - max(radius, 1) == free
                assert sum(m & (2**64 - 1) for m in p.masks) == 2**64 - 1
    assert plan(6, 10**9, 5e17).density() < 1e-5 < plan(6, 10**5, 5e9).density()


@pytest.mark.parametrize(("radius", "cost"), [(0, 0.03), (6, 0.03), (12, 0.03), (6, 1000.0)])
def test_crowded_windows(spark, monkeypatch, radius, cost):
    monkeypatch.setattr(hamming, "COMPARE", cost)
    monkeypatch.setattr(hamming, "CROWD", 5)
    rng = random.Random(radius)
    values = clustered(120, 1) + [0xABCD_EF01_2345_0000 | rng.getrandbits(16) for _ in range(60)] + [(0x1234 << 48) | rng.getrandbits(48) for _ in range(60)]
    df = spark.createDataFrame([(signed(v),) for v in values], "value long")
    expected = {tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a != b and bin(a ^ b).count("1") <= radius}
    got = [(r.a, r.b) for r in near_values(df, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_probe(spark):
    values = spark.createDataFrame([(signed(int(h, 16) << 32),) for h in ("ff00ff00", "ff00ff01", "ff00ff03", "ff00fe00", "00ff00ff")], "value long")
    asked = spark.createDataFrame([(signed(0xFF00FF00 << 32),)], "query long")
    for radius, n in ((0, 1), (1, 3), (2, 4), (4, 4), (8, 4)):
        assert probe(values, asked, radius).count() == n


def test_empty(spark):
    assert near_values(spark.createDataFrame([], "value long"), 6).count() == 0
    assert spark.createDataFrame([(None,)], "t string").select(hash_long(F.col("t")).alias("h")).first().h is None


def test_near_texts(spark):
    from lumatwin.operators.hamming import near_texts

    rng = random.Random(9)
    base = ["".join(rng.choice("abcd") for _ in range(8)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100, None), (101, "abc"), (102, base[0])]
    got = {(r.a, r.b, r.distance) for r in near_texts(spark.createDataFrame(rows, "id long, text string"), 3, 8).collect()}
    differ = lambda x, y: sum(p != q for p, q in zip(x, y))
    known = [(k, t) for k, t in rows if t and len(t) == 8]
    assert got == {(i, j, differ(x, y)) for i, x in known for j, y in known if i < j and differ(x, y) <= 3}


@pytest.mark.parametrize("runs", [None, 1, 2, 3, 4])
def test_near_digits_however_they_are_cut(spark, runs):
    from lumatwin.operators.hamming import near_digits

    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(15)]
    values = {x ^ sum(rng.randrange(16) << 4 * d for d in rng.sample(range(16), n)) for x in base for n in range(8)}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    differ = lambda x, y: sum(p != q for p, q in zip(f"{x % 2**64:016x}", f"{y % 2**64:016x}"))
    known = sorted(map(signed, values))
    got = sorted(tuple(r) for r in near_digits(spark.createDataFrame([(v,) for v in [*known, known[0], None]], "value long"), 5, runs).collect())
    assert got == [(x, y, differ(x, y)) for k, x in enumerate(known) for y in known[k + 1 :] if differ(x, y) <= 5]


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"tier", "group_no", "file_id", "role", "confidence"} == set(entry.entry(spark).columns) and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
