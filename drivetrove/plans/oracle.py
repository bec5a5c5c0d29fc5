"""DuckDB side of the correctness check: the catalogue mapping as plain SQL.

Written independently of the DataFrame code. Paths and folder sizes come from the known four levels of
the test tables, so they check the generic tree operators.
"""

PRELUDE = """WITH
lf AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, CAST(max(l_quantity) AS BIGINT) AS qty,
         CAST(epoch(min(l_shipdate)) AS BIGINT) AS shipped
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
f0 AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 4 + 3 AS id, CAST(c_nationkey + 1 AS BIGINT) AS disk_id,
         l_orderkey * 4 + 2 AS parent_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS ln, c_custkey, c_nationkey, qty,
         shipped, CAST(epoch(o_orderdate) AS BIGINT) AS created_at, p_brand, o_orderpriority, n_name, c_name,
         p_name || ' ' || p_brand || '.' || CASE p_type WHEN 'ECONOMY' THEN 'JPG' WHEN 'STANDARD' THEN 'mp4'
           WHEN 'PROMO' THEN 'MOV' WHEN 'SMALL' THEN 'wav' WHEN 'MEDIUM' THEN 'zip' ELSE 'pdf' END AS name,
         CASE p_type WHEN 'ECONOMY' THEN 'jpg' WHEN 'STANDARD' THEN 'mp4' WHEN 'PROMO' THEN 'mov'
           WHEN 'SMALL' THEN 'wav' WHEN 'MEDIUM' THEN 'zip' ELSE 'pdf' END AS ext,
         ((l_orderkey * 37 + l_linenumber * 11) % 1201 - 600) / 10.0::DOUBLE AS lat,
         ((l_orderkey * 91 + l_linenumber * 7) % 3601 - 1800) / 10.0::DOUBLE AS lon,
         shipped + (l_orderkey * 7 + l_linenumber) % 24 * 3600 + 1800 AS captured
  FROM lf JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON pk = p_partkey JOIN nation ON c_nationkey = n_nationkey),
files AS (
  SELECT *, qty * 1048576 AS size_logical, qty * 1048576 + 4096 AS size_physical,
         CASE WHEN l_orderkey % 17 <> 0 THEN shipped END AS modified_at,
         CASE WHEN (l_orderkey + ln) % 10 <> 2 THEN md5(name || ':' || CAST(qty AS VARCHAR)) END AS content_hash,
         CASE WHEN ext IN ('mp4', 'mov') THEN lat END AS gps_lat, CASE WHEN ext IN ('mp4', 'mov') THEN lon END AS gps_lon,
         CASE WHEN ext IN ('mp4', 'mov') THEN 'Place ' || CAST(l_orderkey % 50 AS VARCHAR) || ', C' || CAST(c_nationkey AS VARCHAR) END AS gps_place,
         CASE WHEN ext IN ('mp4', 'mov') THEN captured END AS captured_at,
         CASE WHEN ext IN ('mp4', 'mov') AND l_orderkey % 2 = 0 THEN 'Make ' || p_brand END AS camera_make,
         c_name || '/Order#' || CAST(l_orderkey AS VARCHAR) || '/' || name AS rel_path
  FROM f0),
osz AS (SELECT l_orderkey AS k, CAST(sum(size_logical) AS BIGINT) AS s, CAST(sum(size_physical) AS BIGINT) AS p FROM files GROUP BY 1),
csz AS (SELECT c_custkey AS k, CAST(sum(size_logical) AS BIGINT) AS s, CAST(sum(size_physical) AS BIGINT) AS p FROM files GROUP BY 1),
nsz AS (SELECT c_nationkey AS k, CAST(sum(size_logical) AS BIGINT) AS s, CAST(sum(size_physical) AS BIGINT) AS p FROM files GROUP BY 1),
entries AS (
  SELECT id, disk_id, parent_id, name, FALSE AS is_folder, size_logical, size_physical, created_at, modified_at, ext,
         content_hash, gps_lat, gps_lon, gps_place, captured_at, camera_make,
         '/' || n_name || '/' || rel_path AS path, rel_path, 3 AS depth, c_nationkey, c_custkey, l_orderkey
  FROM files
  UNION ALL
  SELECT o_orderkey * 4 + 2, CAST(c_nationkey + 1 AS BIGINT), o_custkey * 4 + 1, 'Order#' || CAST(o_orderkey AS VARCHAR), TRUE,
         coalesce(s, 0), coalesce(p, 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         '/' || n_name || '/' || c_name || '/Order#' || CAST(o_orderkey AS VARCHAR), c_name || '/Order#' || CAST(o_orderkey AS VARCHAR),
         2, c_nationkey, c_custkey, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN osz ON k = o_orderkey
  UNION ALL
  SELECT c_custkey * 4 + 1, CAST(c_nationkey + 1 AS BIGINT), CAST(c_nationkey AS BIGINT) * 4, c_name, TRUE, coalesce(s, 0), coalesce(p, 0),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '/' || n_name || '/' || c_name, c_name, 1, c_nationkey, c_custkey, NULL
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN csz ON k = c_custkey
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 4, CAST(n_nationkey + 1 AS BIGINT), NULL, n_name, TRUE, coalesce(s, 0), coalesce(p, 0),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '/' || n_name, NULL, 0, n_nationkey, NULL, NULL
  FROM nation LEFT JOIN nsz ON k = n_nationkey),
disks AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name,
         CASE WHEN n_nationkey % 3 <> 2 THEN 'uuid-' || CAST(n_nationkey AS VARCHAR) END AS volume_uuid,
         CAST((n_nationkey % 4 + 1) AS BIGINT) * 1099511627776 AS capacity, n_nationkey % 2 = 0 AS is_online,
         CASE WHEN n_nationkey % 2 = 0 THEN '/Volumes/' || n_name END AS mount_path, r_name AS location,
         CAST(n_nationkey + 1700000000 AS BIGINT) AS scanned_at,
         (SELECT count(*) FROM files f WHERE f.c_nationkey = n_nationkey) AS file_count,
         1 + (SELECT count(*) FROM customer c WHERE c.c_nationkey = n_nationkey)
           + (SELECT count(*) FROM orders JOIN customer c ON o_custkey = c_custkey WHERE c.c_nationkey = n_nationkey) AS folder_count,
         coalesce((SELECT s FROM nsz WHERE k = n_nationkey), 0) AS total_size
  FROM nation JOIN region ON n_regionkey = r_regionkey),
sun0 AS (
  SELECT id, size_logical, gps_lat AS la, gps_lon AS lo, captured_at / 86400.0::DOUBLE + 2440587.5 - 2451545.0 AS n
  FROM files WHERE gps_lat IS NOT NULL),
sun1 AS (
  SELECT *, ((280.460 + 0.9856474 * n) % 360 + 360) % 360 AS l, radians(((357.528 + 0.9856003 * n) % 360 + 360) % 360) AS g,
         radians(23.439 - 0.0000004 * n) AS e, ((280.46061837::DOUBLE + 360.98564736629::DOUBLE * n) % 360 + 360) % 360 AS gm FROM sun0),
sun2 AS (SELECT *, radians(l + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS lam, ((gm + lo) % 360 + 360) % 360 AS lst FROM sun1),
sun3 AS (
  SELECT *, asin(sin(e) * sin(lam)) AS dec,
         ((lst - degrees(atan2(cos(e) * sin(lam), cos(lam))) + 180) % 360 + 360) % 360 - 180 AS h FROM sun2),
sun AS (
  SELECT id, size_logical, h, degrees(asin(sin(radians(la)) * sin(dec) + cos(radians(la)) * cos(dec) * cos(radians(h)))) AS el FROM sun3),
light AS (
  SELECT id, size_logical, CASE WHEN el >= 6 THEN 'day'
    WHEN el >= 0 THEN 'golden ' || CASE WHEN h > 0 THEN 'dusk sunset' ELSE 'dawn sunrise' END
    WHEN el >= -6 THEN 'twilight bluehour ' || CASE WHEN h > 0 THEN 'dusk sunset' ELSE 'dawn sunrise' END
    WHEN el >= -18 THEN 'twilight ' || CASE WHEN h > 0 THEN 'dusk sunset' ELSE 'dawn sunrise' END
    ELSE 'night' END AS light_phase FROM sun),
entry_tags AS (
  SELECT id AS entry_id, lower(p_brand) AS tag FROM files UNION ALL SELECT id, lower(o_orderpriority) FROM files),
thumbnails AS (SELECT id AS entry_id FROM files WHERE ext IN ('jpg', 'mp4', 'mov') AND (id // 4) % 3 <> 0),
clips AS (SELECT * FROM files WHERE ext IN ('mp4', 'mov')),
video_meta AS (SELECT id AS entry_id, qty * 1000 + 500 AS duration_ms FROM clips WHERE (id // 4) % 4 <> 0),
first_file AS (SELECT o_orderkey AS k, coalesce((o_orderkey * 8 + min(l_linenumber)) * 4 + 3, o_orderkey * 4 + 2) AS entry_id
               FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
vecs AS (
  SELECT vec_id, entry_id, CASE WHEN (vec_id // 4) % 5 <> 0 THEN CAST(vec_id % 4 AS DOUBLE) END AS frame_ts,
         CAST(CASE WHEN (vec_id // 4) % 7 = 1 AND other IS NOT NULL
           THEN list_concat([CAST(other[1] + CAST(0.05 AS FLOAT) AS FLOAT)], other[2:]) ELSE embedding END AS DOUBLE[]) AS v
  FROM (SELECT e.vec_id, e.embedding, p.embedding AS other FROM embeddings e LEFT JOIN embeddings p ON p.vec_id = e.vec_id - 4)
  JOIN first_file ON k = vec_id // 4),
transcripts AS (SELECT entry_id, doc_id, lang, text FROM documents JOIN first_file ON k = doc_id),
members AS (
  SELECT id AS entry_id, i, CASE i WHEN 0 THEN 'docs' WHEN 1 THEN 'docs/B1.txt' ELSE 'docs/a2.txt' END AS path,
         i = 0 AS is_dir, CAST(i * 100 AS BIGINT) AS size
  FROM (SELECT id, unnest(generate_series(0, qty % 3)) AS i FROM files WHERE ext = 'zip' AND (id // 4) % 4 <> 1)),
volumes AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION_' || CAST(s_nationkey AS VARCHAR) ELSE s_name END AS name,
         '/Volumes/' || s_name AS mount_path, CASE WHEN s_suppkey % 3 = 1 THEN 'uuid-' || CAST(s_nationkey AS VARCHAR) END AS fingerprint,
         (s_suppkey % 4 + 1) * 1099511627776 AS total_space,
         (s_suppkey % 4 + 1) * 1099511627776 - s_suppkey % 10 * 42949672960 AS available_space
  FROM supplier),
by_uuid AS (SELECT fingerprint AS k, min(mount_path) AS m, arg_min(total_space, mount_path) AS t, arg_min(available_space, mount_path) AS a
            FROM volumes WHERE fingerprint IS NOT NULL GROUP BY 1),
by_mount AS (SELECT mount_path AS k, total_space AS t, available_space AS a FROM volumes),
by_name AS (SELECT name AS k, min(mount_path) AS m, arg_min(total_space, mount_path) AS t, arg_min(available_space, mount_path) AS a
            FROM volumes GROUP BY 1),
places AS (
  SELECT s_suppkey AS place_id, s_suppkey * 7919 % 12001 / 100.0::DOUBLE - 60 AS lat, s_suppkey * 10473 % 36001 / 100.0::DOUBLE - 180 AS lon,
         s_name || CASE WHEN s_suppkey % 3 <> 0 THEN ', Admin ' || CAST(s_nationkey AS VARCHAR) ELSE '' END || ', C' || CAST(s_nationkey AS VARCHAR) AS place
  FROM supplier),
devices AS (
  SELECT user_id, 'dev' || CAST(user_id AS VARCHAR) AS id, CAST(floor(epoch(min(ts))) AS BIGINT) AS created_at,
         CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen, user_id % 7 = 0 AS revoked
  FROM events GROUP BY user_id),
scopes AS (
  SELECT DISTINCT id AS device_id, unnest([CAST(user_id % 25 + 1 AS BIGINT), CAST(user_id * 7 % 25 + 1 AS BIGINT)]) AS disk_id
  FROM devices WHERE NOT revoked AND user_id % 5 <> 0),
src AS (
  SELECT disk_id AS pair, rel_path, max_by({'id': id, 'f': is_folder, 's': size_logical, 'h': content_hash}, id) AS n
  FROM entries WHERE rel_path IS NOT NULL GROUP BY 1, 2),
bk AS (
  SELECT disk_id, c_custkey, l_orderkey, c_name, rel_path, id,
         size_logical + CASE WHEN (l_orderkey * 7 + ln) % 10 = 1 THEN 1 ELSE 0 END AS s,
         CASE (l_orderkey * 7 + ln) % 10 WHEN 2 THEN NULL WHEN 3 THEN 'x' || content_hash ELSE content_hash END AS h
  FROM files WHERE (l_orderkey * 7 + ln) % 10 <> 0 AND l_orderkey % 13 <> 0 AND c_custkey % 50 <> 7
  UNION ALL
  SELECT disk_id, c_custkey, l_orderkey, c_name, c_name || '/Order#' || CAST(l_orderkey AS VARCHAR) || '/extra_' || name, id + 1000000000000000,
         size_logical, content_hash
  FROM files WHERE (l_orderkey * 7 + ln) % 10 = 4 AND l_orderkey % 13 <> 0 AND c_custkey % 50 <> 7),
bent AS (
  SELECT disk_id AS pair, rel_path, id, FALSE AS f, s, h FROM bk
  UNION ALL
  SELECT CAST(c_nationkey + 1 AS BIGINT), c_name || '/Order#' || CAST(o_orderkey AS VARCHAR), o_orderkey * 4 + 2, TRUE,
         coalesce((SELECT CAST(sum(s) AS BIGINT) FROM bk WHERE l_orderkey = o_orderkey), 0), NULL
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 13 <> 0 AND c_custkey % 50 <> 7
  UNION ALL
  SELECT CAST(c_nationkey + 1 AS BIGINT), c_name, c_custkey * 4 + 1, c_custkey % 50 <> 7,
         CASE WHEN c_custkey % 50 = 7 THEN 42 ELSE coalesce((SELECT CAST(sum(s) AS BIGINT) FROM bk WHERE bk.c_custkey = customer.c_custkey), 0) END, NULL
  FROM customer),
dst AS (
  SELECT pair, rel_path, max_by({'id': id + 1000000000000000, 'f': f, 's': s, 'h': h}, id) AS n FROM bent GROUP BY 1, 2),
both_sides AS (
  SELECT coalesce(src.pair, dst.pair) AS pair, coalesce(src.rel_path, dst.rel_path) AS rel_path, src.n AS a, dst.n AS b
  FROM src FULL OUTER JOIN dst ON src.pair = dst.pair AND src.rel_path = dst.rel_path),
diff AS (
  SELECT pair, rel_path, coalesce(a.f, b.f) AS is_folder, coalesce(a.s, 0) AS src_size, coalesce(b.s, 0) AS dst_size,
         coalesce(a.id, b.id) AS src_entry_id,
         CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a.f <> b.f THEN 'conflict' WHEN a.f THEN 'same'
              WHEN a.s = b.s THEN 'same' ELSE 'mismatch' END AS fast,
         CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a.f <> b.f THEN 'conflict' WHEN a.f THEN 'same'
              WHEN a.h IS NOT NULL AND b.h IS NOT NULL THEN CASE WHEN a.h = b.h THEN 'same' ELSE 'mismatch' END
              WHEN a.s = b.s THEN 'unverified' ELSE 'mismatch' END AS deep
  FROM both_sides)
"""


def tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def bm25(docs: str, terms: list[tuple[str, bool]]) -> str:
    """CTEs ending in ``ranked(entry_id, disk_id, score)`` for ``docs(entry_id, disk_id, text)``."""
    def count(term: str, prefix: bool) -> str:
        test = f"starts_with(w, '{term}')" if prefix else f"w = '{term}'"
        return f"len(list_filter(t, lambda w: {test}))"

    columns = ", ".join(f"{count(*t)} AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2::DOUBLE"
        f" / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f""", tok AS (SELECT entry_id, disk_id, {tokens('text')} AS t FROM ({docs})),
counted AS (SELECT entry_id, disk_id, len(t) AS dl, {columns} FROM tok),
corpus AS (SELECT count(*) AS n, sum(dl) * 1.0::DOUBLE / count(*) AS avgdl, {dfs} FROM counted),
ranked AS (SELECT entry_id, disk_id, -({score}) AS score FROM counted, corpus WHERE {every})
"""
