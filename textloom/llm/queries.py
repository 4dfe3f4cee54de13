"""Queries of the operators, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    best_fit,
    contextual_pii,
    hyperminhash,
    language,
    order_minhash,
    permutation_index,
    pieces,
    sharding,
    simhash,
    substrings,
    token_files,
    vector_codes,
    whitening,
)
from textloom.llm.tables import word_count
from textloom.llm.vectors import finite, floored
from textloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
PIECES = "piece_bpe_32k.model"
TOKENIZER, VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    """Where each piece of each document lies in the packed sequences."""
    return best_fit.pack(table(spark, sf_dir, "documents"), "doc_id", word_count(F.col("text")))


SHARDS_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(text)::BIGINT AS bytes, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS h FROM documents
), levels AS (
  SELECT doc_id, h, bytes, d, h >> (60 - d) AS prefix FROM rows, (SELECT unnest(range(0, 61))::INT AS d)
), sums AS (
  SELECT d, prefix, sum(bytes)::BIGINT AS n, count(DISTINCT h) AS hashes FROM levels GROUP BY ALL
), leaf AS (
  SELECT l.doc_id, l.h, l.bytes, coalesce(max(l.d) FILTER (WHERE s.n > {SHARD_BYTES} AND s.hashes > 1) + 1, 0) AS depth
  FROM levels l JOIN sums s USING (d, prefix) GROUP BY ALL
)
SELECT l.doc_id, l.bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard,
  0::BIGINT AS page, s.n AS shard_bytes
FROM leaf l JOIN sums s ON s.d = l.depth AND s.prefix = l.h >> (60 - l.depth)
"""


@query("op9_extendible_sharding", SHARDS_SQL)
def op9(spark, sf_dir):
    """The shard of every document."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES)


@query("op10_token_files")
def op10(spark, sf_dir):
    """Documents as the files of their token ids have them."""
    with open(public_tokenizers.path(TOKENIZER)) as file:
        tokenizer = file.read()
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_ids(
        docs, "doc_id", "text", tokenizer, VOCABULARY, END_ID, token_files.ids_folder(docs)
    )
    return token_files.document_checks(manifest).withColumnRenamed("key", "doc_id")


@query("op5_simhash")
def op5(spark, sf_dir):
    """The fingerprint of every document and the component it lies in."""
    grouped = simhash.groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return grouped.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    """What is left of every document without repeated passages."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.withColumnRenamed("key", "doc_id")


@query("op8_order_minhash")
def op8(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    compared = order_minhash.compare_with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    return compared.withColumnRenamed("key", "doc_id")


@query("op2_language_codes")
def op2(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs.where(~held_out), "text", "lang")
    return language.predict(docs, "text", model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op1_permutation_index")
def op1(spark, sf_dir):
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    found = permutation_index.search(vectors, "vec_id", "embedding", F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query("op3_contextual_pii")
def op3(spark, sf_dir):
    """Personal data of every document."""
    found = contextual_pii.report(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("key", "doc_id")


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    """Every document encoded and decoded again."""
    model = pieces.Pieces.from_file(public_tokenizers.path(PIECES))
    return pieces.encode(table(spark, sf_dir, "documents"), "doc_id", "text", model).withColumnRenamed("key", "doc_id")


@query("op11_cholesky_whitening")
def op11(spark, sf_dir):
    """Every vector in the first 32 whitened components."""
    vectors = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    rows = vectors.select("vec_id", floored(F.col("embedding"), 64, 1_000_000).alias("x"))
    return whitening.report(rows, "vec_id", "x", 32).withColumnRenamed("key", "vec_id")


def _rounds(n: int) -> str:
    """Rounds of assigning parts to entries and averaging, one after the other."""
    steps = []
    for i in range(n + 1):
        steps.append(f"""
far{i} AS MATERIALIZED (
  SELECT rid, part, entry, sum((e.v - b.v) * (e.v - b.v))::BIGINT AS apart
  FROM entries e JOIN book{i} b USING (part, pos) GROUP BY ALL
), near{i} AS MATERIALIZED (
  SELECT rid, part, entry, apart FROM far{i} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY apart, entry) = 1
)""")
        if i < n:
            steps.append(f"""
sums{i} AS MATERIALIZED (
  SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS c FROM near{i} JOIN entries USING (rid, part) GROUP BY ALL
), book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce((s - ((s % c) + c) % c) // c, b.v) AS v
  FROM book{i} b LEFT JOIN sums{i} USING (part, entry, pos)
)""")
    return ",".join(steps)


CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), entries AS MATERIALIZED (
  SELECT rid, (i * 8) // len(x) AS part, i % (len(x) // 8) AS pos, x[i + 1] AS v
  FROM kept, unnest(range(len(x))) AS r(i)
), book0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, pos, v FROM entries WHERE rid <= 16
), {_rounds(6)}, coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error FROM near6 GROUP BY rid
), told AS (
  SELECT string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos) AS numbers FROM book6
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(numbers) AS codebooks_sha256
FROM coded JOIN kept USING (rid), told
"""


@query("op12_vector_codes", CODES_SQL)
def op12(spark, sf_dir):
    """Every vector as eight indexes into learned codebooks."""
    coded = vector_codes.report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return coded.withColumnRenamed("key", "vec_id")


NEAR_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM listed WHERE len(w) > 0
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * met >= 85 * (x.n + y.n - met)
), reached AS (
  SELECT a AS doc_id, a AS component FROM links UNION SELECT b, b FROM links
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.component = l.a
)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, coalesce(min(component), d.doc_id) AS component_id,
  coalesce(min(component), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id) GROUP BY d.doc_id
"""


@query("op13_hyperminhash", NEAR_SQL)
def op13(spark, sf_dir):
    """The near-duplicate component of every document and whether it stays."""
    grouped = hyperminhash.groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return grouped.select(
        F.col("key").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"),
    )
