"""Pieces of the SQL that queries are compared with."""

from __future__ import annotations


def digits(column: str, n: int) -> str:
    """The digits of a usable hash text, else null."""
    found = f"lower(regexp_extract({column}, '^\\s*(?:[A-Za-z][A-Za-z0-9_\\-]*\\s*[:=]\\s*)?(?:0[xX])?([0-9a-fA-F]{{{n}}})\\s*$', 1))"
    return f"CASE WHEN {found} <> '' AND {found} <> repeat(left({found}, 1), {n}) THEN {found} END"


def number(column: str) -> str:
    """A usable perceptual hash as a number of 64 bits."""
    return f"(('0x' || {digits(column, 16)})::UBIGINT)"


def near(a: str, b: str, radius: int) -> str:
    return f"bit_count(xor({a}, {b})) <= {radius}"


CURRENT = "cur AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen_at DESC) rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"
FEATURES = f"""feat AS (SELECT file_id, fast_hash AS raw_fast, {digits("fast_hash", 16)} fast_hash, {digits("sha256", 64)} sha256, {number("phash")} phash, {number("dhash")} dhash, {number("whash")} whash,
  phash AS raw_phash, feature_ver FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1)"""
RANK = """CASE WHEN {x} IN ('raw','cr2','cr3','nef','orf','arw','dng','raf','rw2') THEN 1 WHEN {x} IN ('tiff','tif') THEN 2 WHEN {x} = 'png' THEN 3 WHEN {x} IN ('jpg','jpeg') THEN 4 WHEN {x} = 'webp' THEN 5 ELSE 6 END"""
EXTENSION = r"lower(regexp_extract(path, '[^./]\.([^./]+)$', 1))"
FORMAT = f"lower(CASE WHEN coalesce(format, '') <> '' THEN format ELSE {EXTENSION} END)"
RECORDS = f"""rec AS (SELECT cur.*, cur.id AS file_id, fast_hash, sha256, phash, dhash, whash, raw_phash FROM cur LEFT JOIN feat ON feat.file_id = cur.id WHERE status = 'active')"""
#: The order in which the first file of a group is its original.
ORDER = f"""CASE WHEN dims_w <> 0 AND dims_h <> 0 THEN dims_w::BIGINT * dims_h ELSE 0 END DESC, (exif_dt IS NULL OR exif_dt = 0 OR isnan(exif_dt)), CASE WHEN exif_dt <> 0 AND NOT isnan(exif_dt) THEN exif_dt END,
  coalesce(size, 0) DESC, {RANK.format(x=FORMAT)}, path, file_id"""
BASE = f"{CURRENT}, {FEATURES}, {RECORDS}"


def compatible(a: str, b: str, tolerance: float = 0.1) -> str:
    """Whether the sides of two rows fit."""
    known = " AND ".join(f"{t}.{c} <> 0" for t in (a, b) for c in ("dims_w", "dims_h"))
    off = lambda x, y: f"abs({x} - {y}) / greatest({x}, {y}) <= {tolerance}"
    ratio, area = (lambda t: f"({t}.dims_w::DOUBLE / {t}.dims_h)"), (lambda t: f"({t}.dims_w::DOUBLE * {t}.dims_h)")
    return f"CASE WHEN {known} THEN {off(ratio(a), ratio(b))} AND {off(area(a), area(b))} ELSE true END"


def edges(radius: int, source: str = "rec", hashes: tuple[str, ...] = ("phash", "dhash", "whash"), extra: str = "true") -> str:
    """Pairs (a, b, distance) of near files of a relation."""
    d = ", ".join(f"bit_count(xor(x.{h}, y.{h}))" for h in hashes)
    return f"""SELECT x.file_id a, y.file_id b, least({d}) distance FROM {source} x JOIN {source} y ON x.file_id < y.file_id
  WHERE least({d}) <= {radius} AND {compatible("x", "y")} AND {extra}"""


def leaders(edge: str, prefix: str = "") -> str:
    """Relations that follow from edges(a, b, distance): {prefix}grp(leader, file_id, distance). Needs WITH RECURSIVE."""
    return f"""{prefix}lk AS (SELECT a, b FROM {edge} UNION SELECT b, a FROM {edge}),
{prefix}n AS (SELECT a i, list(b) nb, row_number() OVER (ORDER BY a) rn FROM {prefix}lk GROUP BY a),
{prefix}st AS (SELECT 0::BIGINT rn, []::BIGINT[] leaders UNION ALL SELECT n.rn, CASE WHEN list_has_any(leaders, nb) THEN leaders ELSE list_append(leaders, i) END FROM {prefix}st s JOIN {prefix}n n ON n.rn = s.rn + 1),
{prefix}ld AS (SELECT unnest(leaders) leader FROM {prefix}st WHERE rn = (SELECT max(rn) FROM {prefix}st)),
{prefix}mem AS (SELECT e.b file_id, min(e.a) leader FROM {prefix}lk e JOIN {prefix}ld l ON l.leader = e.a WHERE e.b NOT IN (SELECT leader FROM {prefix}ld) GROUP BY e.b),
{prefix}grp AS (SELECT m.leader, m.file_id, e.distance FROM {prefix}mem m JOIN {edge} e ON e.a = least(m.leader, m.file_id) AND e.b = greatest(m.leader, m.file_id)
  UNION ALL SELECT DISTINCT leader, leader, NULL FROM {prefix}mem)"""
