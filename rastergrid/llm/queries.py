"""Registered queries of the training-data operators, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rastergrid.llm import (
    langid, lm, nearest, packing, phrases, pieces, resample, secrets, sharding, simhash, tokenfiles, topk, urlrules)
from rastergrid.llm.common import documents, embeddings
from rastergrid.session import materialize

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(f):
    LLM_QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("text_hash")


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.write_token_files(documents(spark, sf_dir))
    return tokenfiles.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    again = pieces.decoded(spark, F.col("ids"))
    # stored ids keep the workers that decode out of the stage that encodes
    return materialize(pieces.encode(docs)).select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"),
                                      F.crc32(again.cast("binary")).alias("decoded_crc32"))


@query
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.learn_and_score(documents(spark, sf_dir))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), F.crc32("ids").alias("ids_crc32"))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(embeddings(spark, sf_dir))


LLM_ORACLES["op8_nearest"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(
        documents(spark, sf_dir), (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(embeddings(spark, sf_dir))


LLM_ORACLES["op10_top_scores"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: The host rules of op11: fixed values.
HOST_RULES = [
    urlrules.HostRule("allow", "org", "/"),
    urlrules.HostRule("block", "example.org", "/es/"),
    urlrules.HostRule("block", "example.org", "/en/1"),
    urlrules.HostRule("allow", "com", "/fr/"),
    urlrules.HostRule("block", "com", "/de/"),
]


@query
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    mined = urlrules.mine(urlrules.labelled_pages(pages, labels))
    return urlrules.judge(pages, HOST_RULES, mined).drop("pattern")


_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
# Every subset of the telling tokens of every bad URL is a candidate; rules that hold a smaller one
# of no less confidence block nothing more, so they need not go.
LLM_ORACLES["op11_url_rules"] = rf"""
WITH u AS (
  SELECT page_id, url, coalesce(url, '') AS w,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), t AS (
  SELECT *, CASE WHEN contains(w, '://') THEN list_distinct(list_filter(
    ['s:' || regexp_replace(lower(string_split(w, '://')[1]), '[0-9]+', '#', 'g')]
    || list_transform(string_split(regexp_replace(host, '[0-9]+', '#', 'g'), '.'), lambda x: 'h:' || x)
    || list_transform(string_split(regexp_replace(lower(path), '[0-9]+', '#', 'g'), '/'), lambda x: 'p:' || x)
    || list_transform(string_split(regexp_replace(lower(regexp_replace(query, '=[^&]*', '', 'g')), '[0-9]+', '#', 'g'), '&'), lambda x: 'q:' || x),
    lambda x: len(x) > 2)) ELSE []::VARCHAR[] END AS tokens FROM u
), label AS (
  SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), known AS (
  SELECT row_number() OVER () AS id, tokens, bad FROM t JOIN label ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)
), whole AS (
  SELECT count(*) AS n, coalesce(sum(bad::INT), 0) AS b, greatest(30, ceil(count(*) / 1000.0)) AS need FROM known
), single AS (
  SELECT token, count(*) AS n, sum(bad::INT) AS b FROM (SELECT unnest(tokens) AS token, bad FROM known) GROUP BY token
  HAVING count(*) >= (SELECT need FROM whole)
), few AS (
  SELECT id, list(token ORDER BY abs(s.b * w.n::DOUBLE - s.n * w.b::DOUBLE) / sqrt(s.n::DOUBLE) DESC, token)[1:12] AS items
  FROM (SELECT id, unnest(tokens) AS token FROM known) JOIN single s USING (token), whole w GROUP BY id
), combo AS (
  SELECT id, list_sort(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS items
  FROM (SELECT id, items, unnest(generate_series(1, (1 << len(items)) - 1)) AS mask FROM few)
), rules AS (
  SELECT items, sum(bad::INT) / count(*) AS confidence FROM combo JOIN known USING (id) GROUP BY items
  HAVING sum(bad::INT) >= (SELECT need FROM whole) AND sum(bad::INT) / count(*) >= 0.5
), hit AS (
  SELECT page_id, url, max(confidence) AS confidence FROM (SELECT DISTINCT page_id, url, tokens FROM t WHERE url IS NOT NULL)
  JOIN rules ON list_has_all(tokens, items) GROUP BY ALL
), listed AS (
  SELECT t.*, r.rule, r.verdict AS said FROM t LEFT JOIN (VALUES {", ".join(f"('{r.host + r.path}', '{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)}) r(rule, h, p, verdict)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(rule) DESC) = 1
)
SELECT listed.page_id, host, path, rule, coalesce(said, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence
FROM listed LEFT JOIN hit ON hit.page_id = listed.page_id AND hit.url = listed.url
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


LLM_ORACLES["op12_collocations"] = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM piece
), gram AS (
  SELECT lang, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w), (VALUES (1), (2), (3), (4)) t(n)
  WHERE i + n - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30
), total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS ws FROM gram WHERE n > 1),
cut AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM c) c
  JOIN gram l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN gram r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:c.n], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM c) g, (VALUES (2), (3)) s(m) WHERE m < g.n AND i + m - 1 <= g.n GROUP BY ALL
), ranked AS (
  SELECT cut.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM cut LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# The checksum of a feature, bit by bit: a byte of the text is taken in, then come eight shifts.
LLM_ORACLES["op13_resample"] = rf"""
WITH doc AS (
  SELECT 0 AS side, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM doc
), feature AS (
  SELECT side, id, unnest(ws || list_transform(list_zip(ws[1:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])) AS f FROM w
), word AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)
), bucket AS (
  SELECT f, xor(list_reduce(flatten(list_transform(generate_series(1, len(h) // 2),
    lambda i: [16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i]) - 1, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END, 4294967295), 4294967295) % 10000 AS b FROM word
), seen AS (
  SELECT side, id, b, count(*) AS n FROM feature JOIN bucket USING (f) GROUP BY ALL
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000)))) AS g
  FROM (SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM seen GROUP BY b),
       (SELECT coalesce(sum(n) FILTER (WHERE side = 0), 0) AS big_s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS big_t FROM seen)
), weight AS (
  SELECT id, sum(n) AS n_features, floor(sum(n * g::BIGINT) / sum(n))::BIGINT AS weight FROM seen JOIN gain USING (b) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, len(ws) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weight USING (id) WHERE side = 0
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (WHERE words >= 20) OVER () AS eligible FROM scored)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
