"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .decontaminate import decontaminate
from .dimension_merge import merge_versions
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .periodic_runs import periodic_runs
from .scratch import Scratch
from .secrets_scan import scan_secrets
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op11_versioned_dimension_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_versions(table(spark, sf_dir, "client_changes"), early_hours=240)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark).root
    write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(spark, root, payloads=False).drop("url")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), repeated=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ship(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_toxicity, op4_line_dedup, op5_secret_scans, op6_token_counts, op7_sharding, op8_substring_dedup, op9_exact_dedup, op10_source_mixing, op11_versioned_dimension_merge, op12_warc, op13_periodic_runs, pipeline)
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingles as strings, links by counting shared ones, components by spreading the smallest doc_id.
_OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
c AS (SELECT g2 AS g, len(g2) AS n, min(doc_id) AS c, list(doc_id) AS ids FROM (SELECT doc_id, list_sort(g) AS g2 FROM s) GROUP BY g2),
e AS (SELECT c, n, unnest(g) AS g FROM c WHERE n > 0),
l AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.g = b.g AND a.c <> b.c AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(c, k) AS (SELECT c, c FROM c WHERE n > 0 UNION SELECT l.b, r.k FROM r JOIN l ON l.a = r.c),
m AS (SELECT c, min(k) AS k FROM r GROUP BY c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.k END AS component_id
FROM s LEFT JOIN (SELECT unnest(ids) AS doc_id, c.c FROM c) x ON s.doc_id = x.doc_id LEFT JOIN m ON m.c = x.c
"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(p) WHERE len(w) > 0),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, p, bw.n, item_id FROM dp JOIN bw ON bw.n = dp.n AND array_to_string(w[p : p + dp.n - 1], ' ') = bw.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, i, l[i] AS line, {_LOWER.format("trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM d, unnest(range(1, len(l) + 1)) t(i)),
c AS (SELECT k, max(doc_id) AS last FROM e WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN c.last IS NOT NULL AND doc_id < c.last THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.last IS NULL OR doc_id >= c.last), '')) AS kept_sha256
FROM e LEFT JOIN c USING (k) GROUP BY doc_id
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r)),
k AS (SELECT doc_id, list(q) AS gone FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM x
"""

_OP9 = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""

#: The CRC32 of a number's digits, from the table that its polynomial gives.
_CRC = """
bits AS (SELECT list(x ORDER BY n) AS crc_of_byte FROM (SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(n)))
"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(y) AS BIGINT) FOR y IN string_split({text}, '')]), lambda x, y: xor(x >> 8, crc_of_byte[CAST(xor(x, y) & 255 AS INTEGER) + 1])), 4294967295)"


_OP11 = f"""
WITH {_CRC},
c AS (SELECT DISTINCT change_id, client_id, seq, op, source, segment, city, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents,
      epoch_us(valid_at) // 1000000 - CASE WHEN {_crc("CAST(change_id AS VARCHAR)")} % 3 = 0 THEN 864000 ELSE 0 END AS tm FROM client_changes, bits WHERE valid_at IS NOT NULL),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY client_id, seq ORDER BY change_id DESC NULLS LAST) = 1),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY client_id, tm ORDER BY seq DESC NULLS LAST) = 1),
g AS (SELECT *, sum(CASE WHEN op = 'U' THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY tm) AS g FROM k),
v AS (SELECT client_id, tm, seq, op = 'D' AS is_deleted, {", ".join(f"last_value(CASE WHEN op <> 'D' THEN {a} END IGNORE NULLS) OVER w AS {a}" for a in ("source", "segment", "city", "balance_cents"))}
      FROM g WINDOW w AS (PARTITION BY client_id, g ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT * FROM v WINDOW w AS (PARTITION BY client_id ORDER BY tm)
      QUALIFY row_number() OVER w = 1 OR (is_deleted, source, segment, city, balance_cents) IS DISTINCT FROM lag((is_deleted, source, segment, city, balance_cents)) OVER w),
m AS (SELECT *, row_number() OVER w AS version, lead(tm) OVER w AS until FROM n WINDOW w AS (PARTITION BY client_id ORDER BY tm)),
i AS (SELECT m.client_id, m.version, count(DISTINCT c.change_id) AS n_changes FROM m JOIN c ON m.client_id = c.client_id AND c.tm >= m.tm AND (until IS NULL OR c.tm < until) GROUP BY 1, 2)
SELECT m.client_id, CAST(m.version AS INTEGER) AS version, m.tm AS valid_from, until AS valid_to, is_deleted, source, segment, city, balance_cents, seq AS first_seq, n_changes
FROM m LEFT JOIN i USING (client_id, version)
"""

#: SHA-1 by way of base 32 needs bits; DuckDB has the digest in hexadecimal only, so each five bits are cut out of its binary digits.
_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT page_id, t, min(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (SELECT *, array_to_string([bin(16 + CAST('0x' || x AS INTEGER))[2:] FOR x IN string_split(sha1(t), '')], '') AS bits FROM f)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + list_reduce([CAST(c AS INTEGER) FOR c IN string_split(bits[5 * k + 1 : 5 * k + 5], '')], lambda x, y: 2 * x + y)] FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

#: Runs from pairs of equal 5-word stretches at one distance, which every run of six words and four periods has.
_OP13 = rf"""
WITH {_CRC},
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, bits),
a AS (SELECT doc_id, w, h, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
g AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM d, unnest(range(n - 4)) t(i) WHERE n >= 6),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k),
r AS (SELECT doc_id, s, l, min(q) AS q FROM s WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY doc_id),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
k AS (SELECT z.doc_id, string_agg(v, ' ' ORDER BY z.i) AS kept FROM (SELECT doc_id, i, w[i + 1] AS v FROM d, unnest(range(n)) t(i)) z ANTI JOIN x ON x.doc_id = z.doc_id AND x.i = z.i GROUP BY z.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, o.s AS start, o.l AS length, o.q AS period, 1000 * o.l // o.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op1_ngram_jaccard_join": _OP1, "op2_benchmark_decontamination": _OP2, "op4_line_dedup": _OP4, "op8_substring_dedup": _OP8, "op9_exact_dedup": _OP9, "op11_versioned_dimension_merge": _OP11, "op12_warc": _OP12, "op13_periodic_runs": _OP13}
