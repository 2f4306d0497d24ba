"""The operators' registered queries and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers

from . import block_max, byte_bpe, chats, licences, multi_index, packing, quality, repair, sharding, simhash, spelling, surrogates, token_counts
from .common import read

LLM_QUERIES, LLM_ORACLE = {}, {}


def _query(f):
    LLM_QUERIES[f.__name__] = f
    return f


@_query
def op1_multi_index(spark, sf_dir):
    return multi_index.nearest(read(spark, sf_dir, "embeddings"))


@_query
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@_query
def op3_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_sharding(spark, sf_dir):
    return sharding.assign(read(spark, sf_dir, "documents"))


@_query
def op5_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op6_surrogates(spark, sf_dir):
    found = surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.session_key(spark), count_col="n_entities")
    return found.select("doc_id", "text", "n_entities")


@_query
def op7_chats(spark, sf_dir):
    return chats.collapse(read(spark, sf_dir, "conversations"))


LLM_ORACLE["op7_chats"] = """
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, own, list(length(role) || chr(1) || role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS t,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS shown
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM d) GROUP BY conv_id, own
), w AS (
  SELECT conv_id, own, t, shown, array_to_string(t, chr(2)) AS whole FROM c
), p AS (
  SELECT DISTINCT array_to_string(t[1:i], chr(2)) AS whole FROM (SELECT t, unnest(range(1, len(t))) AS i FROM c)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY whole ORDER BY conv_id NULLS LAST, own) AS r FROM w WHERE whole NOT IN (SELECT whole FROM p)
)
SELECT conv_id, CAST(len(t) AS INTEGER) AS n_turns, shown AS text FROM f WHERE r = 1
"""


@_query
def op8_block_max(spark, sf_dir):
    return block_max.top_products(read(spark, sf_dir, "embeddings"))


LLM_ORACLE["op8_block_max"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op9_licences(spark, sf_dir):
    return licences.scan(read(spark, sf_dir, "documents"))


@_query
def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op11_repair(spark, sf_dir):
    return repair.repair(repair.damaged(read(spark, sf_dir, "conversations")), "dropped")


@_query
def op12_token_counts(spark, sf_dir):
    return token_counts.report(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_spelling(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))
