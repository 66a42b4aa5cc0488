"""Mixing sources to target weights by balanced sampling (the cube method).

Each source of a mix gets so many tokens: its weight of the mix's size, at most max_repeats times its own. Divided by its
tokens that's a rate; its whole part is how often every document is used, and its fraction an inclusion probability. The
flight phase moves the probabilities of three documents at a time along the null space of two balancing rows (tokens, documents)
until each is 0 or 1: the expected totals of both stay as they are. It runs in parallel on chunks of each source, then on
the undecided documents of all chunks (two each, and a small reserve), and so on; the last two are a small landing problem.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.llm.tokens import sizes, vocabulary
from lumatwin.operators.bounded import small
from lumatwin.stage import Stage
from lumatwin.tables import table

#: Documents of one chunk, on average.
CHUNK = 20_000
#: Documents of a chunk that only the next level decides on.
RESERVE = 64
_EPS = 1e-9


def flight(x: list[float], p: list[float], draw) -> list[float]:
    """Probabilities after the flight phase: all but two at most are 0 or 1; sum(p) and sum(x p) are kept (for rounding)."""
    p = list(p)
    active: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = round(p[k])
            continue
        active.append(k)
        while len(active) == 3:
            i, j, m = active
            u = (x[j] - x[m], x[m] - x[i], x[i] - x[j])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(active, u) if d)
            down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(active, u) if d)
            step = up if draw() * (up + down) < down else -down
            for a, d in zip(active, u):
                p[a] += step * d
            still = [a for a in active if _EPS < p[a] < 1 - _EPS]
            for a in active:
                if a not in still:
                    p[a] = float(round(p[a]))
            if len(still) == 3:  # rounding kept the one that was to end: end the nearest
                a = min(still, key=lambda a: min(p[a], 1 - p[a]))
                p[a] = float(round(p[a]))
                still.remove(a)
            active = still
    return p


def landing(x: list[float], p: list[float], wanted: float) -> list[float]:
    """A whole outcome for the few undecided documents, then exchanges of decided ones that bring the tokens nearer to wanted.

    All outcomes of the undecided (two at most) are tried. What's still missing or too much is a document's size at most; one chosen
    document is exchanged for another that differs by just about that, as long as this helps.
    """
    left = [k for k, v in enumerate(p) if _EPS < v < 1 - _EPS]
    sizes_of, out = np.asarray(x), np.array([float(round(v)) if not _EPS < v < 1 - _EPS else 0.0 for v in p])
    rest = wanted - float(sizes_of @ out)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda o: abs(sum(x[k] * v for k, v in zip(left, o)) - rest))
    out[left] = best
    for _ in range(64):
        rest = wanted - float(sizes_of @ out)
        if abs(rest) < 1:
            break
        # -1 stands for no document, of size 0: one is added or dropped without an exchange
        ins, outs = np.append(np.flatnonzero(out == 1), -1), np.append(np.flatnonzero(out == 0), -1)
        have, free = np.where(ins < 0, 0, sizes_of[ins]), np.where(outs < 0, 0, sizes_of[outs])
        order = np.argsort(free, kind="stable")
        outs, free = outs[order], free[order]
        at = np.searchsorted(free, have + rest)
        near = np.stack([np.clip(at - 1, 0, len(outs) - 1), np.clip(at, 0, len(outs) - 1)])
        miss = np.abs(rest - (free[near] - have))
        row, k = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[row, k] >= abs(rest):
            break
        for changed, to in ((ins[k], 0.0), (outs[near[row, k]], 1.0)):
            if changed >= 0:
                out[changed] = to
    return out.tolist()


def _level(rows: DataFrame, chunks: Column, last: bool, seed: int) -> DataFrame:
    """One flight over chunks of each (mix_id, source); with the landing on the last level, when each source is one chunk.

    Below the last level the RESERVE smallest documents of a chunk stay undecided, as material for the landing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True])
        draw = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & (2**63 - 1)]).random
        x, p = pdf["tokens"].astype(float).tolist(), pdf["p"].tolist()
        if last:
            p = landing(x, flight(x, p, draw), float(np.dot(x, p)))
        else:
            p[:-RESERVE] = flight(x[:-RESERVE], p[:-RESERVE], draw)
        return pdf.assign(p=p).drop(columns="chunk")

    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed)), chunks).cast("int"))
    return chunked.groupBy("mix_id", "source", "chunk").applyInPandas(run, rows.schema)


def plan(sources: DataFrame, targets: DataFrame, all_tokens: Column) -> DataFrame:
    """One row for each mix and source that takes part: wanted and planned tokens, whole repeats and the probability of one more.

    Weights are relative within their mix; null and negative weights, repeats and factors count as 0. Of repeated targets the one
    with the largest values counts. A source without tokens gets none. A shortfall isn't moved to other sources.
    """
    least = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    clean = targets.select("mix_id", source_name(F.col("source")).alias("source"), least("target_share").alias("weight"), least("max_repeats").alias("max_repeats"), least("size_factor").alias("size_factor"))
    clean = clean.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.max(F.struct("weight", "max_repeats", "size_factor")).alias("t")).select("mix_id", "source", "t.*")
    whole = clean.groupBy("mix_id").agg(F.sum("weight").alias("weights"), F.max("size_factor").alias("factor"))
    rows = clean.join(whole, "mix_id").join(sources, "source", "left").na.fill(0, ["source_tokens", "source_docs"])
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    rows = rows.withColumn("target_share", share).withColumn("wanted_tokens", F.col("target_share") * F.col("factor") * all_tokens)
    rows = rows.withColumn("planned_tokens", F.least("wanted_tokens", F.col("max_repeats") * F.col("source_tokens").cast("double")))
    rate = F.when(F.col("source_tokens") > 0, F.col("planned_tokens") / F.col("source_tokens")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _EPS).cast("int"))
    p = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    return rows.select("mix_id", "source", "target_share", "max_repeats", "wanted_tokens", "planned_tokens", "source_docs", "whole", F.when(p > _EPS, p).otherwise(0.0).alias("p"))


def source_name(c: Column) -> Column:
    """A source's name whatever its case, outer blanks and hyphens."""
    return F.translate(F.lower(F.trim(c)), "-", "_")


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, plan) for docs(doc_id, source, tokens) and targets(mix_id, source, target_share, max_repeats, size_factor).

    selection(mix_id, source, doc_id, tokens, repeats) has the documents used at least once. Documents without a source or without
    tokens take no part (they can't change a size). The selection is the same for the same seed and rows.
    """
    stage = Stage(spark, "mixing")
    docs = stage.write(docs.select("doc_id", source_name(F.col("source")).alias("source"), "tokens").where("doc_id IS NOT NULL"), "docs")
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    usable = docs.where("source IS NOT NULL AND tokens > 0")
    sources = usable.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    planned = stage.write(plan(sources, targets, F.lit(float(total))), "plan")
    rows = usable.join(small(planned.select("mix_id", "source", "source_docs", "whole", "p").where("whole > 0 OR p > 0")), "source")
    rows = rows.select("mix_id", "source", "doc_id", "tokens", "whole", "p", "source_docs")
    done = [rows.where("p = 0").select("mix_id", "source", "doc_id", "tokens", F.col("whole").alias("repeats"))]
    open_rows, most = rows.where("p > 0"), planned.agg(F.max("source_docs")).first()[0] or 0
    chunks = F.ceil(F.col("source_docs") / F.lit(CHUNK))
    while True:
        last = most <= CHUNK
        level = stage.write(_level(open_rows, chunks, last, seed), "flight")
        done.append(level.where("p IN (0.0, 1.0)").select("mix_id", "source", "doc_id", "tokens", (F.col("whole") + F.col("p").cast("int")).alias("repeats")))
        if last:
            break
        # two undecided documents and the reserve of a chunk go on
        most = (2 + RESERVE) * -(-most // CHUNK)
        open_rows = level.where("p NOT IN (0.0, 1.0)").withColumn("source_docs", F.ceil(F.col("source_docs") / F.lit(CHUNK)) * (2 + RESERVE))
        seed += 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.where("repeats > 0"), planned


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path=vocabulary(spark))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats) of all mixes."""
    return mix(spark, _documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of each mix was to contribute and does contribute, in tokens and in documents (planned_docs and drawn_docs count a document as often as it's used)."""
    chosen, planned = mix(spark, _documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("docs"), F.sum("repeats").alias("drawn_docs"), F.max("repeats").alias("most_repeats"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    rows = planned.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").na.fill(0, ["tokens", "docs", "drawn_docs", "most_repeats", "mix_tokens"])
    actual = F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share")
    return rows.select("mix_id", "source", "target_share", actual, "wanted_tokens", "planned_tokens", "tokens", ((F.col("whole") + F.col("p")) * F.col("source_docs")).alias("planned_docs"), "drawn_docs", "docs", "most_repeats", "max_repeats")
