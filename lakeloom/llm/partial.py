"""What SQL can express of operators whose whole result it can't: columns of ops 4, 8, 9 and 13, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import katz, personal_data, secret_scan, whitening


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op4_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def katz_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.op8_katz(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


PERSONAL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id,
    regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
  FROM d
)
SELECT doc_id,
  len(email) AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x)), lambda i:
    CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INT WHEN x[length(x) - i]::INT > 4 THEN 2 * x[length(x) - i]::INT - 9 ELSE 2 * x[length(x) - i]::INT END)) % 10 = 0)) AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone
FROM m
"""

SECRET_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM d
"""

#: crc32 of the id as text, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"""

KATZ_SQL = rf"""
WITH d AS (SELECT doc_id, {CRC} % 7 = 2 AS held_out,
  list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))), 6) AS base_score
FROM t LEFT JOIN c USING (w) CROSS JOIN s GROUP BY doc_id, held_out, n
"""

WHITENING_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM e),
u AS (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS i FROM f),
s AS (SELECT i, sum(c)::HUGEINT AS s, count(*)::BIGINT AS n FROM u GROUP BY i),
v AS (SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM e)
SELECT vec_id, n, sum((n * c - s) * (n * c - s))::BIGINT AS deviation FROM v JOIN s USING (i) GROUP BY vec_id, n
"""

QUERIES = {"personal_data_counts": personal_data_counts, "secret_counts": secret_counts, "katz_base": katz_base, "whitening_deviations": whitening_deviations}
ORACLES = {"personal_data_counts": PERSONAL_SQL, "secret_counts": SECRET_SQL, "katz_base": KATZ_SQL, "whitening_deviations": WHITENING_SQL}
