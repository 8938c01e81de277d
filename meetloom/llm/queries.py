"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, exact_dedup, media, mixing, near_dedup, packing, pii, quality, sharding, spelling, suffix_dedup, toxicity, warc
from .common import documents, labels


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "text", "copy_no", "order_key")


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shard(documents(spark, sf_dir)))


def op3_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(suffix_dedup.remove_repeats(documents(spark, sf_dir)))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_runs(documents(spark, sf_dir))


def op5_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op7_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_personal_data(documents(spark, sf_dir)))


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(packing.pack(documents(spark, sf_dir)))


def op9_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.read_media(media.to_media(documents(spark, sf_dir))))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.pages_digest(warc.archived(pages), pages.schema["page_id"].dataType.simpleString())


def op12_sorted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), slip_every=199))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_feistel_shards, op3_suffix_sort, op4_content_sort, op5_random_indexing, op6_chosen_path, op7_boosted_candidates, op8_concatenate_and_cut, op9_recurrent_toxicity, op10_png_media, op11_warc, op12_sorted_variants, op13_collocations)
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
totals AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS shares, sum(n) AS n_all FROM counts),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) * (n_all / shares) / n AS rate FROM counts, totals),
terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM (SELECT *, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates)),
sums AS (SELECT source, list(c ORDER BY k) AS cs FROM (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
points AS (
  SELECT doc_id, source, text, ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS parts FROM documents),
drawn AS (
  SELECT p.*, len(list_filter(cs, lambda c: c < (('0x' || substr(md5('mix-1' || parts), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS copies
  FROM points p JOIN sums s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, text, k::INTEGER AS copy_no,
  ('0x' || substr(md5('order:mix-1' || parts || ':' || k::VARCHAR), 1, 13))::BIGINT AS order_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS k FROM drawn)
""",
    "op4_content_sort": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
""",
    "op11_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
parts AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, p.f AS l, q.f AS r, n, (1000::HUGEINT * x.a * n) // (p.f::HUGEINT * q.f) AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(x.ws[1:x.cut], ' ')
  JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(x.ws[x.cut+1:], ' ') JOIN totals t ON t.lang = x.lang),
weakest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM weakest x WHERE NOT EXISTS (
  SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""",
    "op6_chosen_path": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, near.b FROM reach r JOIN near ON r.b = near.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, min(reach.b) = n.doc_id AS kept
FROM n JOIN reach ON n.doc_id = reach.a GROUP BY n.doc_id, n.n
""",
}
