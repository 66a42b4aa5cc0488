"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from lumatwin.plans.sqltext import CURRENT, FEATURES


MEMBERS = f"""WITH {CURRENT},
gm AS (SELECT DISTINCT m.group_id, m.file_id FROM group_members m JOIN dup_groups g ON g.id = m.group_id),
known AS (SELECT id AS file_id, CASE WHEN size >= 1 THEN size END size, CASE WHEN dims_w BETWEEN 1 AND 100000 THEN dims_w END dims_w,
  CASE WHEN exif_dt >= 1262304000 AND exif_dt < 1767225600 AND NOT isnan(exif_dt) THEN exif_dt END exif_dt,
  CASE WHEN mtime >= 1262304000 AND mtime < 1767225600 AND NOT isnan(mtime) THEN mtime END mtime FROM cur),
rows AS (SELECT gm.group_id, known.*, (size IS NOT NULL)::INT + (dims_w IS NOT NULL)::INT + (exif_dt IS NOT NULL)::INT + (mtime IS NOT NULL)::INT n,
  count(*) OVER (PARTITION BY gm.group_id) members FROM gm JOIN known USING (file_id)),
long AS (SELECT *, 'record' field_name, file_id::VARCHAR val FROM rows UNION ALL SELECT *, 'size', size::VARCHAR FROM rows UNION ALL SELECT *, 'dims_w', dims_w::VARCHAR FROM rows
  UNION ALL SELECT *, 'exif_dt', exif_dt::VARCHAR FROM rows UNION ALL SELECT *, 'mtime', mtime::VARCHAR FROM rows),
best AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY n DESC, dims_w DESC NULLS LAST, exif_dt NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST, file_id) rn
  FROM long WHERE val IS NOT NULL AND members >= 2)
"""
QUERIES = {
    "p1_found": f"""WITH {FEATURES}, b AS (SELECT file_id, min(batch_no) batch_no FROM batch_items WHERE batch_no >= 1 GROUP BY 1),
m AS (SELECT f.id file_id, coalesce(b.batch_no, 0) batch_no, sha256, phash FROM (SELECT DISTINCT id FROM files) f LEFT JOIN b ON b.file_id = f.id JOIN feat ON feat.file_id = f.id)
SELECT x.file_id file_id_a, y.file_id file_id_b FROM m x JOIN m y ON x.file_id < y.file_id AND x.batch_no + y.batch_no > 0
WHERE x.sha256 = y.sha256 OR bit_count(xor(x.phash, y.phash)) <= 6""",
    "p2_found": f"""WITH {CURRENT}, {FEATURES}, v AS (SELECT feat.* FROM feat JOIN cur ON cur.id = file_id WHERE phash IS NOT NULL AND dhash IS NOT NULL AND whash IS NOT NULL),
d AS (SELECT x.file_id x, y.file_id y, bit_count(xor(x.phash, y.phash))::INT + bit_count(xor(x.dhash, y.dhash)) + bit_count(xor(x.whash, y.whash)) d FROM v x JOIN v y ON x.file_id <> y.file_id),
n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) rn FROM d WHERE d <= 24)
SELECT DISTINCT least(x, y) file_id_a, greatest(x, y) file_id_b FROM n WHERE rn <= 5""",
    "p2_similar_embeddings": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL), d AS (SELECT x.vec_id, y.vec_id other, list_cosine_similarity(x.e, y.e) c FROM v x JOIN v y ON x.vec_id <> y.vec_id)
SELECT vec_id, other FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) rn FROM d) WHERE rn <= 5""",
    "p4_found": MEMBERS + "SELECT group_id, field_name, file_id FROM best WHERE rn = 1",
    "p4_records": MEMBERS
    + """SELECT group_id, max(file_id) FILTER (field_name = 'record') file_id, max(size) FILTER (field_name = 'size') size, max(dims_w) FILTER (field_name = 'dims_w') dims_w,
  max(exif_dt) FILTER (field_name = 'exif_dt') exif_dt, max(mtime) FILTER (field_name = 'mtime') mtime FROM best WHERE rn = 1 GROUP BY 1""",
    "p4_consensus": MEMBERS
    + """, sn AS (SELECT id, max(last_seen_at) seen FROM files GROUP BY 1), vt AS (SELECT group_id, field_name, floor(val::DOUBLE)::BIGINT::VARCHAR AS "value", l.file_id, n, (max(seen) OVER (PARTITION BY group_id) - seen) / 86400.0::DOUBLE age
  FROM long l JOIN sn ON sn.id = l.file_id WHERE val IS NOT NULL AND members >= 2 AND field_name <> 'record'),
sm AS (SELECT group_id, field_name, "value", round(sum(n * pow(2, -age / 180.0::DOUBLE)), 9) votes, min(age) age, arg_min(file_id, (age, file_id)) file_id FROM vt GROUP BY 1, 2, 3)
SELECT group_id, field_name, "value", file_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY votes DESC, age, file_id) rn FROM sm) WHERE rn = 1""",
    "p5_found": f"""WITH RECURSIVE {CURRENT}, {FEATURES}, gm AS (SELECT DISTINCT m.group_id, m.file_id FROM group_members m JOIN dup_groups g ON g.id = m.group_id JOIN cur ON cur.id = m.file_id),
p AS (SELECT file_id, phash FROM feat JOIN cur ON cur.id = file_id WHERE phash IS NOT NULL),
e AS (SELECT x.file_id u, y.file_id v FROM gm x JOIN gm y USING (group_id) WHERE x.file_id <> y.file_id
  UNION SELECT x.file_id, y.file_id FROM p x JOIN p y ON x.file_id <> y.file_id AND bit_count(xor(x.phash, y.phash)) <= 6),
r AS (SELECT u root_id, u file_id FROM e UNION SELECT r.root_id, e.v FROM r JOIN e ON e.u = r.file_id)
SELECT min(root_id) root_id, file_id FROM r GROUP BY file_id""",
}
