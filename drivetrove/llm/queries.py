"""The registered queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .contamination import contamination
from .divergence import divergence
from .html import extract
from .licences import duckdb_sql, licences
from .lm import lm_scores
from .mixing import mix
from .neardup import near_duplicates
from .pii import personal_data
from .quality import quality
from .repeats import without_repeats
from .toxicity import toxicity
from .trie import prefix_trie
from .warc import archived

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_spans")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_decontamination, op3_pii, op4_html_extraction, op5_minhash_dedup, op6_suffix_dedup, op7_toxicity, op8_licences, op9_lm_scoring, op10_mixing, op11_warc, op12_prefix_trie, op13_divergence)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE32 = "translate(" + " || ".join(
    f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', 1 + CAST(('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift} & 31 AS INT), 1)" for k in range(8) for shift in (15, 10, 5, 0)
) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

ORACLES: dict[str, str] = {
    "op8_licences": duckdb_sql(),
    "op11_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d""",
    "op12_prefix_trie": """
WITH RECURSIVE k(conv_id, s, i, c) AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT conv_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
    FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM k WHERE i < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM k WHERE i = 8 * length(s)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, 0 AS part, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND pos <= h.h
      UNION ALL SELECT conv_id, 1, pos, role, text FROM t JOIN h USING (conv_id) WHERE pos > h.h),
o AS (SELECT conv_id, row_number() OVER w AS d, string_agg(md5(octet_length(encode(role)) || ':' || role || text), '') OVER w AS path, octet_length(encode(text)) AS bytes
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
u AS (SELECT conv_id, 0 AS d, '' AS path, CAST(NULL AS VARCHAR) AS parent, 0 AS bytes FROM h
      UNION ALL SELECT conv_id, d, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY d), bytes FROM o),
n AS (SELECT path, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM u GROUP BY path, d),
c AS (SELECT parent AS path, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
b AS (SELECT u.path, sum(CASE WHEN l.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((l.n - 1) * l.bytes) AS saved FROM l JOIN u ON u.conv_id = l.conv_id AND u.d <= l.d GROUP BY u.path),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM u GROUP BY conv_id) GROUP BY path)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(l.n AS BIGINT) AS n_convs, CAST(l.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM l JOIN b USING (path) LEFT JOIN e USING (path) LEFT JOIN n p ON p.path = l.parent""",
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM t JOIN v USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, v.term, coalesce(n.c, 0) AS c FROM g JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
s AS (SELECT *, CAST(1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS BIGINT) AS p FROM x WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(c) AS c FROM x GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q FROM l WINDOW w AS (PARTITION BY lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT s.lang, s.source, 'term', s.term, s.p - q.q FROM s JOIN q USING (lang, term) WHERE s.c > 0 AND s.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(13, len(w)) AS n FROM bi),
dl AS (SELECT d.doc_id, d.w, n.n FROM d JOIN (SELECT DISTINCT n FROM bw) n ON len(d.w) >= n.n),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dl),
h AS (SELECT di.doc_id, di.i, di.n, bw.item_id FROM di JOIN bw ON bw.n = di.n AND bw.win = array_to_string(di.w[di.i:di.i + di.n - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.names, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op5_minhash_dedup": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT id AS doc_id, min(m) AS component_id FROM r GROUP BY id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, p * 400 AS a, substr(h, 800 * p + 1, 998) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 800 + 1)) AS p FROM d)),
w AS (SELECT doc_id, a + j AS i, md5(substr(h, 2 * j + 1, 200)) AS k FROM (SELECT doc_id, a, h, unnest(range(0, least(greatest(len(h) // 2 - 99, 0), 400))) AS j FROM c)),
f AS (SELECT k, min({'d': doc_id, 'i': i}) AS f FROM w GROUP BY k),
l AS (SELECT w.doc_id, w.i FROM w JOIN f USING (k) WHERE w.doc_id <> f.f.d OR w.i <> f.f.i),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY 1, 2),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
x AS (SELECT q.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
      FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN x.doc_id IS NULL THEN h ELSE x.kept || substr(h, 2 * x.last + 1) END)) AS kept_sha256 FROM d LEFT JOIN x ON x.doc_id = d.doc_id""",
}
