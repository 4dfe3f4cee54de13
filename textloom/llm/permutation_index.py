"""Nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in order. Each
block of vectors keeps one inverted file per pivot: who has it, and at which place. A
query reads the files of its own pivots and adds up how well the places agree, which
ranks the block by the footrule distance between the orders; the best share of the
block is then ranked by the inner product itself, in double precision.

Equal vectors are one entry, with as many of its smallest ids as an answer can hold, and
equal queries are searched once: copies do not grow the work. Blocks of queries meet
blocks of vectors, and each pair yields a bounded list per query.

The pivots are a sample of ``PIVOTS`` vectors, those with the least hash of their id; all
vectors are indexed. ``SHARE`` of each block, ``LEAST`` at least, is reranked; see the
README for the recall measured.

Defined results: vectors that are null, empty, zero or hold null or non-finite values, and
those of another length than most, take no part, as queries neither; ties go to the
smaller id; with fewer vectors than asked for all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tables import saved

PIVOTS, PREFIX = 256, 64
SHARE, LEAST = 0.12, 1024
BLOCK, QUERIES = 16_384, 4_096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` (doubles) of the vectors that take part."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound & F.exists("vector", lambda x: x != 0), F.lit(False)))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def entries(vectors: DataFrame, kept: int) -> DataFrame:
    """Distinct vectors: ``node`` (least id), ``vector`` and their ``kept`` least ids."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = vectors.withColumn("_place", place).where(F.col("_place") <= kept)
    return few.groupBy("vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; the first pivot wins ties."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _indexing(pivots: np.ndarray, prefix: int):
    def run(batches):
        for batch in batches:
            found = orders(matrix(batch.column("vector")), pivots, prefix)
            offsets = pa.array(np.arange(len(found) + 1) * prefix, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), lists], ["node", "vector", "pivots"])

    return run


class InvertedFiles:
    """Per pivot the vectors that have it among their nearest, and its place."""

    def __init__(self, found: np.ndarray, pivots: int):
        n, self.prefix = found.shape
        flat = found.reshape(-1)
        by_pivot = np.argsort(flat, kind="stable")
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.members = by_pivot // self.prefix
        self.places = (by_pivot % self.prefix).astype(np.int32)
        self.n = n

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Falls with the footrule distance, a pivot outside a prefix counting as last:
        each shared pivot adds the prefix less the later of its two places."""
        total = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(order.tolist()):
            inside = slice(self.bounds[pivot], self.bounds[pivot + 1])
            total[self.members[inside]] += self.prefix - np.maximum(self.places[inside], place)
        return total


FOUND = "query long, node long, score double"


def _searching(top: int, pivots: int, share: float, least: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        nodes = vectors.column("node").to_numpy()
        out_query, out_node, out_score = [], [], []
        if len(nodes) and len(queries):
            values = matrix(vectors.column("vector"))
            files = InvertedFiles(matrix(vectors.column("pivots")), pivots)
            wanted = min(len(nodes), max(least, int(np.ceil(share * len(nodes)))))
            asked = zip(queries.column("node").to_pylist(), matrix(queries.column("vector")), matrix(queries.column("pivots")), strict=True)
            for query, vector, order in asked:
                near = files.agreement(order)
                chosen = np.argpartition(-near, wanted - 1)[:wanted] if wanted < len(nodes) else np.arange(len(nodes))
                scores = values[chosen] @ vector
                best = np.lexsort((nodes[chosen], -scores))[:top]
                out_query.append(np.full(len(best), query))
                out_node.append(nodes[chosen][best])
                out_score.append(scores[best])
        empty = np.empty(0, np.int64)
        return pa.table(
            {
                "query": pa.array(np.concatenate(out_query or [empty]), pa.int64()),
                "node": pa.array(np.concatenate(out_node or [empty]), pa.int64()),
                "score": pa.array(np.concatenate(out_score or [empty.astype(float)]), pa.float64()),
            }
        )

    return run


def search(
    df: DataFrame, key: str, vector: str, is_query: Column, top: int = 20, share: float = SHARE, least: int = LEAST
) -> DataFrame:
    """``query_id, rank, id, score``: for each row where ``is_query`` (an expression on the
    column ``id``) the ``top`` rows, itself excluded, with the largest inner product."""
    vectors = saved(usable(df, key, vector))
    nodes = saved(entries(vectors, top + 1))
    sample = [r["vector"] for r in nodes.orderBy(F.xxhash64("node"), "node").select("vector").limit(PIVOTS).collect()]
    pivots = np.array(sample, dtype=float).reshape(len(sample), len(sample[0]) if sample else 0)
    prefix = min(PREFIX, len(sample))
    index = saved(
        nodes.select("node", "vector").mapInArrow(_indexing(pivots, prefix), "node long, vector array<double>, pivots array<short>")
    )
    asked = saved(vectors.where(is_query).join(nodes.select("vector", "node"), "vector").select("id", "node"))
    queries = saved(index.join(asked.select("node").distinct(), "node", "left_semi"))
    blocks = max(1, -(-index.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    left = index.withColumn("_block", F.pmod(F.xxhash64("node"), F.lit(blocks))).withColumn(
        "_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = queries.withColumn("_group", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    found = (
        left.groupBy("_block", "_group")
        .cogroup(right.groupBy("_block", "_group"))
        .applyInArrow(_searching(top + 1, len(sample), share, least), FOUND)
    )
    # a bounded list per query and block; then ids in place of nodes, and one list per query
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node")))
    named = best.where(F.col("_n") <= top + 1).join(nodes.select("node", "ids"), "node")
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id")))
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, top + 1).alias("_list"))
    answers = asked.join(lists, asked["node"] == lists["query"]).select(
        F.col("id").alias("query_id"), F.slice(F.expr("filter(_list, e -> e.id <> id)"), 1, top).alias("_list")
    )
    return answers.select("query_id", F.posexplode("_list").alias("rank", "_e")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("_e.id").alias("id"), (-F.col("_e.less")).alias("score")
    )
