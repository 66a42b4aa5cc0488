"""Batches against history, similar vectors and components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lumatwin.llm import codes, components, history
from lumatwin.operators import hamming
from lumatwin.stage import Stage


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flipped(rng, x: int, n: int) -> int:
    return x ^ sum(1 << b for b in rng.sample(range(64), n))


def collection(n: int, seed: int):
    """Members of batches 0 to 4; a third are copies of one file."""
    rng, rows, bases = random.Random(seed), [], []
    hot = rng.getrandbits(64)
    for k in range(n):
        if k % 3 == 0:
            p = hot
        elif bases and rng.random() < 0.6:
            p = flipped(rng, rng.choice(bases), rng.randint(0, 9))
        else:
            bases.append(p := rng.getrandbits(64))
        rows.append((k, rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.choice([None, f"s{rng.randint(0, n // 3)}"]), None if rng.random() < 0.1 else signed(p)))
    return rows


@pytest.mark.parametrize(("seed", "crowd"), [(1, None), (2, 3)])
def test_batches(spark, monkeypatch, seed, crowd):
    if crowd:  # nearly every window is crowded then
        monkeypatch.setattr(hamming, "CROWD", crowd)
    rows = collection(150, seed)
    df = spark.createDataFrame(rows, "file_id long, batch_no int, sha256 string, phash long")
    near = lambda a, b: a is not None and b is not None and bin((a ^ b) & (2**64 - 1)).count("1") <= 6
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] + b[1] > 0 and ((a[2] is not None and a[2] == b[2]) or near(a[3], b[3]))}
    got = [tuple(r) for r in history.batch_pairs(spark, df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_batches_without_anything_new(spark):
    schema = "file_id long, batch_no int, sha256 string, phash long"
    assert history.batch_pairs(spark, spark.createDataFrame([(1, 0, "a", 5), (2, 0, "a", 5)], schema)).count() == 0
    assert history.batch_pairs(spark, spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in history.batch_pairs(spark, spark.createDataFrame([(2, 1, "a", None), (1, 1, "a", None), (3, 1, None, None)], schema)).collect()] == [(1, 2)]


def records(spark, rows):
    return spark.createDataFrame([(k, s, None if p is None else signed(p)) for k, s, p in rows], "file_id long, sha256 string, phash long")


def test_runs_are_merged_and_opened_again(spark, monkeypatch):
    monkeypatch.setattr(history, "FILE_ROWS", 8)  # many files a run
    index = history.HistoryIndex(spark, fan=3)
    index.load(records(spark, [(100, "h", 0), (101, "h", 0), (102, None, None)]))
    pairs = lambda i, *rows: {tuple(r) for r in i.add(records(spark, rows)).collect()}
    assert pairs(index, (1, "a", 1), (2, "a", 0xFFFF << 40)) == {(1, 100), (1, 101), (1, 2)}
    assert len(index.runs) == 2 and len(index.runs[0].fences) > 2
    assert pairs(index, (3, None, 3)) == {(1, 3), (3, 100), (3, 101)}
    index.compact()
    assert len(index.runs) == 1  # three of like size became one
    again = history.HistoryIndex.open(spark, index.manifest())
    assert pairs(again, (4, "h", None), (5, "q", (0xFFFF << 40) ^ 7), (6, "q", (0xFFFF << 40) ^ 7)) == {(4, 100), (4, 101), (2, 5), (2, 6), (5, 6)}
    again.close()
    assert not again.runs


def test_a_batch_reads_as_much_of_any_history(spark, monkeypatch):
    """A small batch reads no more files of a history ten times as large: some for each of its keys, whatever the runs hold."""
    monkeypatch.setattr(history, "FILE_ROWS", 400)
    read = []
    for n in (2_000, 20_000):
        index = history.HistoryIndex(spark, expected=100_000)
        index.load(spark.range(n).selectExpr("id AS file_id", "'s' || id AS sha256", "xxhash64(id) AS phash"))
        files = sum(len(r.fences) for r in index.runs)
        assert index.add(records(spark, [(10**6, "s7", random.Random(n).getrandbits(64))])).count() == 1
        read.append((index.read, files))
        index.close()
    (few, all_few), (more, all_more) = read
    assert all_more > 8 * all_few and more[0] <= 2 * (index.plan.keys() + 3) and more[0] < 0.1 * all_more and more[1] <= 1.5 * few[1]


def brute_neighbours(rows, k, radius):
    out = set()
    for i, *x in rows:
        near = sorted((sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x, y)), j) for j, *y in rows if j != i)
        out |= {(i, j, d) for d, j in near[:k] if d <= radius}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_neighbours(spark, seed):
    rng, rows = random.Random(seed), []
    for k in range(60):
        base = [rng.getrandbits(64) for _ in range(3)]
        for j in range(rng.choice([1, 2, 4, 9])):
            rows.append((1000 - len(rows) * 7 % 997 + len(rows) * 1000, *[signed(flipped(rng, b, rng.randint(0, 7) if j else 0)) for b in base]))
    hot = [signed(rng.getrandbits(64)) for _ in range(3)]
    rows += [(10_000_000 + k, *hot) for k in range(80)]  # copies
    df = spark.createDataFrame([*rows, rows[0], (1, None, 2, 3), (None, 1, 2, 3)], "id long, a long, b long, c long")
    expected = brute_neighbours(rows, 5, 24)
    got = [(r.id, r.other, r.distance) for r in codes.neighbours(spark, df).collect()]
    assert len(got) == len(set(got))
    assert len(expected & set(got)) >= 0.99 * len(expected) and len(set(got) - expected) <= 0.01 * len(expected)


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(5)
    turn = codes.rotation(7)
    assert np.allclose(turn @ turn.T, np.eye(192), atol=1e-4)
    n = 4000
    a = rng.integers(0, 2, (n, 192), dtype=np.uint8)
    b = a.copy()
    for k in range(n):
        b[k, rng.choice(192, 24, replace=False)] ^= 1
    code = lambda x: codes.encode(codes.packed(x), turn)
    (ca, sa), (cb, sb) = code(a), code(b)
    assert all((codes.unpacked(codes.packed(a)) == a).ravel())
    differ = lambda x, y: (codes.unpacked(x) != codes.unpacked(y)).sum(axis=1)
    estimate = (1 - differ(ca, cb) / 96) / (sa * sb)
    assert abs(np.sin(estimate).mean() - 0.75) < 0.02  # 1 - 2 * 24 / 192
    least = codes.least_estimate(24, 4.5)
    assert (estimate >= least).mean() > 0.999
    assert ((1 - differ(ca, np.roll(np.stack(cb), 1, axis=1)) / 96) / (sa * np.roll(sb, 1)) >= least).mean() < 0.01  # strangers


def test_cells_grow_with_the_number_of_vectors():
    """From 10^5 to 10^6 vectors candidates grow twentyfold at most; longer cells need more tables, which keep the recall."""
    met = lambda n: n * n / 2 * codes.table_count(b := codes.cell_plan(n, 24, 0.999), 24, 0.999) / 2**b
    assert met(10**6) <= 20 * met(10**5) and met(10**8) <= 20 * met(10**7)
    assert codes.cell_plan(10**3, 24, 0.999) < codes.cell_plan(10**7, 24, 0.999)


@pytest.mark.parametrize("bits", [6, 20])
def test_neighbours_whatever_the_bits(spark, bits):
    rng = random.Random(bits)
    bases = [[rng.getrandbits(64) for _ in range(3)] for _ in range(15)]
    rows = [(k, *[signed(flipped(rng, b, rng.randint(0, 6))) for b in bases[k % 15]]) for k in range(90)]
    expected = brute_neighbours(rows, 5, 24)
    got = {(r.id, r.other, r.distance) for r in codes.neighbours(spark, spark.createDataFrame(rows, "id long, a long, b long, c long"), bits=bits).collect()}
    assert len(expected & got) >= 0.99 * len(expected)


def nearest(ids, v, k):
    """The k nearest by cosine of each, by brute force; of equal cosines the smaller id first."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = v @ v.T
    np.fill_diagonal(cosine, -9)
    return {i: [(ids[j], cosine[x, j]) for j in sorted(range(len(ids)), key=lambda j: (-round(cosine[x, j], 6), ids[j]))[:k]] for x, i in enumerate(ids)}


@pytest.mark.parametrize(("cell", "task", "least"), [(codes.CELL, codes.TASK, 0.99), (250, 100, 0.95)])
def test_similar_embeddings(spark, tiny, monkeypatch, cell, task, least):
    """Recall against brute force on the embeddings: of one cell, and of several, each cut into tasks. These vectors have no clusters, so most of the cells are asked."""
    monkeypatch.setattr(codes, "TASK", task)
    table = spark.read.parquet(f"{tiny}/embeddings.parquet").where("embedding IS NOT NULL")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    expected = nearest([k for k, _ in rows], np.array([v for _, v in rows], float), 5)
    got = {}
    for r in codes.similar(spark, table.selectExpr("vec_id AS id", "embedding AS vector"), 5, cell=cell, probes=8).collect():
        got.setdefault(r.id, {})[r.other] = r.cosine
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({j for j, _ in v} & got[i].keys()) / 5 for i, v in expected.items()])
    print("recall", recall)
    assert recall >= least
    assert all(abs(got[i][j] - c) < 1e-4 for i, v in expected.items() for j, c in v if j in got[i])


def test_similar_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(k, (centres[k % 12] + 0.05 * rng.standard_normal(24)).tolist()) for k in range(240)]
    hot = centres[0].tolist()
    copies = [(1000 + k, [2.5 * x for x in hot]) for k in range(150)]  # one direction, a third of all
    odd = [(5000, None), (None, hot), (5001, []), (5002, [0.0] * 24), (5003, [float("nan"), *hot[1:]]), (5004, hot[:5]), (5005, [None, *hot[1:]])]
    df = spark.createDataFrame([*rows, *copies, *odd, rows[0]], "id long, vector array<double>")
    got = {}
    for r in codes.similar(spark, df, 4, cell=40, probes=3).collect():
        got.setdefault(r.id, []).append((r.other, round(r.cosine, 6)))
    assert got.keys() == {k for k, _ in rows + copies}
    assert sorted(got[1000]) == [(1001, 1.0), (1002, 1.0), (1003, 1.0), (1004, 1.0)] and sorted(got[1149]) == [(1000, 1.0), (1001, 1.0), (1002, 1.0), (1003, 1.0)]
    all_ = rows + copies
    expected = nearest([k for k, _ in all_], np.array([v for _, v in all_]), 4)
    recall = np.mean([len({round(c, 4) for _, c in expected[k]} & {round(c, 4) for _, c in got[k]}) / len({round(c, 4) for _, c in expected[k]}) for k, _ in rows])
    assert recall >= 0.95
    empty = spark.createDataFrame([], "id long, vector array<float>")
    assert codes.similar(spark, empty).count() == 0 and codes.similar(spark, spark.createDataFrame(odd, "id long, vector array<double>").where("id = 5002")).count() == 0
    assert codes.similar(spark, df.where("id = 0")).count() == 0


def linked(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize(("n", "m", "side"), [(200, 150, 2), (300, 280, 3), (400, 900, 4), (60, 59, 7)])
def test_components(spark, n, m, side):
    rng = random.Random(n)
    edges = [(k, k + 1) for k in range(59)] if m == 59 else [tuple(rng.sample(range(-n, n), 2)) for _ in range(m)]
    if m == 900:
        edges += [(7, k) for k in range(1000, 1500)]  # a star with a third of the edges
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, edges[0], (5000, 5000), (None, 3), (3, None)], "u long, v long")
    got = [(r.vertex, r.root) for r in components.components(spark, df, side).collect()]
    assert len(got) == len(set(got)) and set(got) == linked(edges)


def test_components_of_nothing(spark):
    assert components.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_local_roots():
    u, v = np.array([5, 9, 2, 7]), np.array([9, 2, 8, 4])
    vertex, root = components.local_roots(u, v)
    assert dict(zip(vertex.tolist(), root.tolist())) == {5: 2, 9: 2, 8: 2, 7: 4}


def test_stage_writes_to_the_shared_folder(spark):
    assert Stage(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))
