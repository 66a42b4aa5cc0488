"""Exact Hamming-radius joins over 64-bit numbers.

A hash is cut into ``blocks`` runs of bits. Two hashes within ``radius`` agree in at least ``blocks - radius`` of them, so
every combination of that many (or fewer) blocks makes a key under which some of the keys must be equal. Keys are
ordinary columns: the search is an equi-join on them with the distance as a further condition, and no pair is missed. How many
blocks make a key follows from the number of values, and a pair counts only under the first of the keys it shares, so that pairs come
out once without being shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatwin.functions.hashes import hamming
from lumatwin.functions.media import char_distance
from lumatwin.operators.bounded import sorted_join
from lumatwin.stage import Stage, spread


#: Numbers of one window above which it's split.
CROWD = 4096
#: Cost of comparing two numbers of a window, where copying a number to a window costs 1.
COMPARE = 0.03
#: Copies of a number at most: plans with more aren't considered.
MOST_KEYS = 500


@dataclass(frozen=True)
class Plan:
    """How numbers are cut: masks of the blocks, and how many of them agree in a key. interleaved: blocks of bits that lie far apart."""

    radius: int
    free: int
    interleaved: bool = False

    @property
    def blocks(self) -> int:
        return max(self.radius, 1) + self.free

    @property
    def cuts(self) -> list[int]:
        return [64 * k // self.blocks for k in range(self.blocks + 1)]

    @property
    def order(self) -> list[int]:
        """The bits (0 is the highest) in the order in which they're cut: as they are, or first every n-th one, then every n-th from the second on ..."""
        n = self.blocks if self.interleaved else 1
        return [b for start in range(n) for b in range(start, 64, n)]

    @property
    def masks(self) -> list[int]:
        """The bits of each block, as a signed number."""
        found = [sum(1 << (63 - b) for b in self.order[x:y]) for x, y in zip(self.cuts, self.cuts[1:])]
        return [m - (1 << 64) if m >> 63 else m for m in found]

    @property
    def width(self) -> int:
        """Most bits of a key."""
        return self.free * max(b - a for a, b in zip(self.cuts, self.cuts[1:]))

    def density(self) -> float:
        """The part of all pairs of random numbers that meet."""
        size = [b - a for a, b in zip(self.cuts, self.cuts[1:])]
        return sum(2.0 ** -sum(size[k] for k in combo) for combo in combinations(range(self.blocks), self.free))

    def keys(self) -> int:
        return len(list(combinations(range(self.blocks), self.free)))


def plan(radius: int, copies: float, pairs: float, least: int = 1) -> Plan:
    """The cheapest plan for so many numbers to copy and pairs of them: keys get longer with the logarithm of the number of pairs."""
    options = [x for free in range(least, 6) if (x := Plan(radius, free)).width + x.blocks < 63 and x.keys() <= MOST_KEYS]
    return min(options, key=lambda x: copies * x.keys() + pairs * x.density() * COMPARE)


def _bits(value: Column, order: list[int]) -> Column:
    """Bits of a number, in the order named, as the lowest bits of another one; runs of neighbours are cut out at once."""
    out, k = F.lit(0).cast("long"), 0
    while k < len(order):
        n = 1
        while k + n < len(order) and order[k + n] == order[k] + n:
            n += 1
        run = F.shiftrightunsigned(value, 64 - order[k] - n)
        out = F.shiftleft(out, n).bitwiseOR(run if n == 64 else run.bitwiseAND(F.lit((1 << n) - 1).cast("long")))
        k += n
    return out


def windows(values: DataFrame, column: str, p: Plan, name: str = "window") -> DataFrame:
    """values once for each of its keys, in a column ``name``.

    Above the bits of its blocks, a key holds the mask of the earlier blocks that it leaves out, which tells combinations apart. The
    combinations are one constant list, so the plan's code is as short for many keys as for few.
    """
    step = max(b - a for a, b in zip(p.cuts, p.cuts[1:]))
    combos = combinations(range(p.blocks), p.free)
    codes = [sum(1 << k for k in range(c[-1]) if k not in c) << 30 | sum(k << 6 * n for n, k in enumerate(c)) for c in combos]
    parts = F.array(*[_bits(F.col(column), p.order[a:b]) for a, b in zip(p.cuts, p.cuts[1:])])
    rows = values.withColumn("_parts", parts).withColumn("_code", F.explode(F.lit(codes).cast("array<long>")))
    key = F.shiftright("_code", 30)
    for n in range(p.free):
        at = F.shiftright("_code", 6 * n).bitwiseAND(F.lit(63).cast("long")).cast("int")
        key = F.shiftleft(key, step).bitwiseOR(F.get("_parts", at))
    return rows.withColumn(name, key).drop("_parts", "_code")


def first_common(a: Column, b: Column, window: Column, p: Plan) -> Column:
    """Whether a window that two numbers share is the first one they do: they differ in all earlier blocks that it leaves out."""
    x = a.bitwiseXOR(b)
    agree = F.lit(0).cast("long")
    for k, mask in enumerate(p.masks):
        agree = agree + F.when(x.bitwiseAND(F.lit(mask).cast("long")) == 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return agree.bitwiseAND(F.shiftrightunsigned(window, p.width)) == 0


def split(rows: DataFrame, crowded: DataFrame, keys: list[str], column: str, p: Plan) -> DataFrame:
    """rows(*keys, column, ...) with ``inner``: -1, but for the rows of crowded windows all windows of their bits in another order."""
    other = Plan(p.radius, p.free, True)
    light = rows.join(crowded, keys, "left_anti").withColumn("inner", F.lit(-1).cast("long"))
    heavy = windows(rows.join(crowded, keys, "left_semi"), column, other, "inner")
    return light.unionByName(heavy)


def first_inner(a: Column, b: Column, inner: Column, p: Plan) -> Column:
    return (inner < 0) | first_common(a, b, inner, Plan(p.radius, p.free, True))


def near_values(values: DataFrame, radius: int, column: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (*by, a, b, distance), a < b, of the different 64-bit numbers of a column that differ in at most radius bits.

    by: columns in which both numbers must be equal, too: several kinds of numbers are searched in one pass. Nulls take no part and
    repeated numbers count once. Empty input gives an empty result. A window that holds more than CROWD numbers is split by the
    windows of its numbers with their bits in another order, which as surely have one in common for each near pair; so a window with
    a third of all numbers isn't compared as a whole.
    """
    stage = Stage(values.sparkSession, "near")
    different = stage.write(values.select(*by, F.col(column).alias("value")).where("value IS NOT NULL").distinct(), "values")
    n = F.count("*").alias("n")
    count, pairs = (different.groupBy(*by).agg(n) if by else different.agg(n)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n") / 2.0), F.lit(0.0))).first()
    p = plan(radius, count, pairs)
    rows, keys, inner = windows(spread(different), "value", p), [*by, "window"], None
    if count > CROWD:
        crowded = stage.write(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*keys), "crowded")
        if not crowded.isEmpty():
            rows, inner = split(rows, crowded, keys, "value", p), "inner"
    on = [*keys, inner] if inner else keys
    a, b = (rows.select(*on, F.col("value").alias(n)) for n in "ab")
    distance = hamming(F.col("a"), F.col("b"))
    near = (F.col("a") < F.col("b")) & (distance <= radius) & first_common(F.col("a"), F.col("b"), F.col("window"), p)
    if inner:
        near &= first_inner(F.col("a"), F.col("b"), F.col("inner"), p)
    return sorted_join(a, b, on).where(near).select(*by, "a", "b", distance.alias("distance"))


def probe(values: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """Rows (query, value, distance) for the numbers of ``values.value`` within radius of each of ``queries.query``."""
    stage = Stage(values.sparkSession, "probe")
    asked = stage.write(queries.select("query").where("query IS NOT NULL").distinct(), "asked")
    known = stage.write(values.select("value").where("value IS NOT NULL").distinct(), "known")
    q, n = asked.count(), known.count()
    p = plan(radius, q + n, q * n)
    left, right = windows(spread(asked), "query", p), windows(spread(known), "value", p)
    distance = hamming(F.col("query"), F.col("value"))
    near = (distance <= radius) & first_common(F.col("query"), F.col("value"), F.col("window"), p)
    return sorted_join(left, right, "window").where(near).select("query", "value", distance.alias("distance"))


def near_texts(rows: DataFrame, most: int, length: int) -> DataFrame:
    """(a, b, distance), a < b: ids of rows(id, text) whose texts of one length differ in at most ``most`` characters.

    Texts are cut into most + 1 runs of characters, one of which is equal in two such texts. Other lengths and nulls match nothing.
    """
    cuts = [length * k // (most + 1) for k in range(most + 2)]
    keys = F.array(*[F.concat(F.lit(f"{k}:"), F.substring("text", a + 1, b - a)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    keyed = rows.where(F.length("text") == length).select("id", "text", F.explode(keys).alias("window"))
    a, b = (keyed.select("window", F.col("id").alias(n), F.col("text").alias(f"t{n}")) for n in "ab")
    distance = char_distance(F.col("ta"), F.col("tb"))
    met = sorted_join(a, b, "window").where("a < b").select("a", "b", "ta", "tb").distinct()
    return met.select("a", "b", distance.alias("distance")).where(F.col("distance") <= most)


def near_digits(values: DataFrame, most: int, runs: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: the different 64-bit numbers of values.value that differ in at most ``most`` of their 16 hexadecimal digits.

    Digits are cut into most + runs runs, so many of which are equal in two such numbers; by default the cheapest number of runs for so many values. No pair is missed.
    """
    different = Stage(values.sparkSession, "digits").write(values.select("value").where("value IS NOT NULL").distinct(), "values")
    count = different.count()
    cuts = {r: [16 * k // (most + r) for k in range(most + r + 1)] for r in ([runs] if runs else range(1, 5)) if most + r <= 16}

    def cost(r: int) -> float:
        sizes = [sum(cuts[r][k + 1] - cuts[r][k] for k in c) for c in combinations(range(most + r), r)]
        return count * len(sizes) + count * count / 2 * sum(16.0**-n for n in sizes) * COMPARE

    r = min(cuts, key=cost)
    part = lambda k: F.shiftrightunsigned("value", 64 - 4 * cuts[r][k + 1]).bitwiseAND(F.lit((1 << 4 * (cuts[r][k + 1] - cuts[r][k])) - 1).cast("long"))
    keys = []
    for n, c in enumerate(combinations(range(most + r), r)):
        key = F.lit(0).cast("long")
        for k in c:
            key = F.shiftleft(key, 4 * (cuts[r][k + 1] - cuts[r][k])).bitwiseOR(part(k))
        keys.append(F.struct(F.lit(n).alias("n"), key.alias("key")))
    keyed = spread(different).select("value", F.explode(F.array(*keys)).alias("k")).select("value", "k.*")
    a, b = (keyed.select("n", "key", F.col("value").alias(x)) for x in "ab")
    x = F.col("a").bitwiseXOR(F.col("b"))
    any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    distance = F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111)))
    return sorted_join(a, b, ["n", "key"]).where((F.col("a") < F.col("b")) & (distance <= most)).select("a", "b", distance.alias("distance")).distinct()
