"""Approximate nearest neighbours with a permutation index over pivot inverted files."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, with_columns, written


def valid(vec: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def pivots_of(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """Unit vectors of about ``n`` of the distinct ``vectors``, ``n`` at most, chosen by a hash."""
    share = min(1.0, 1.5 * n / max(vectors.count(), 1))
    rows = vectors.where(hash_share([F.col("_hash")], f"pivots{seed}") < share)
    found = rows.select("_hash", "_vec").orderBy(F.xxhash64("_hash", F.lit(seed)), "_hash").limit(n).collect()
    found = np.array([r["_vec"] for r in found], dtype=np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def permutations(pivots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The pivots of each vector, nearest first; ties by pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")


def ranked(places: np.ndarray, place: np.ndarray, first: int) -> np.ndarray:
    """The ``first`` rows of least footrule distance: the sum over pivots of how far apart their places are."""
    rule = np.abs(places - place).sum(axis=1, dtype=np.int32)
    return np.argpartition(rule, first - 1)[:first] if first < len(rule) else np.arange(len(rule))


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    pivots: int = 256,
    post: int = 4,
    probe: int = 48,
    block: int = 2048,
    asks: int = 512,
    rerank: float = 0.1,
    seed: int = 41,
) -> DataFrame:
    """``query_id, rank, vec_id, score, ranked``: the ``k`` nearest rows by cosine for each row where ``queries`` holds.

    A vector is represented by all pivots in order of nearness and posted in the
    inverted files of its ``post`` nearest ones. A query reads the files of its ``probe`` nearest
    pivots. What it reads is ranked by the footrule distance of the permutations, the first ``rerank``
    share of a file (``8 * k`` at least) gets the exact cosine, and the ``k`` best of all files are the answer.
    ``ranked`` is the number of postings that were ranked for the query.

    Equal vectors are one entry with their ``k + 1`` smallest ids: further copies can't be among the ``k`` nearest of anything, and a
    vector that many queries share is searched for once. A file is kept in blocks of about ``block`` rows and its queries in blocks of ``asks``,
    dealt by hashes, so a file of any length is spread over tasks of bounded size. The pivots are a bounded sample
    of distinct vectors; every vector is posted.

    Vectors that are null, zero, or hold null or non-finite components, null ids, and vectors of
    another length than most have (the shorter of two equally common ones) take no part. Ties go to the smaller id; an id counts once, by
    its nearest vector, and an id with several vectors asks with the first by hash. With fewer candidates than ``k``, all
    found are returned; an empty table gives an empty one.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec"), F.coalesce(queries, F.lit(False)).alias("_query"))
    base = base.where(F.col("_id").isNotNull() & valid(F.col("_vec")))
    lengths = base.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    spark = vectors.sparkSession
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, ranked long")
    dim = lengths[0]["n"]
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    wide = F.col("_vec").cast("array<double>")
    hash_ = F.xxhash64(wide)
    base = base.where(F.size("_vec") == dim).withColumn("_hash", hash_).withColumn("_key", F.concat(F.hex(hash_), F.hex(F.xxhash64(F.lit("again"), wide))))
    base = base.groupBy("_id", "_key").agg(F.first("_hash").alias("_hash"), F.first("_vec").alias("_vec"), F.max("_query").alias("_query"))
    by = Window.partitionBy("_key").orderBy("_id")
    few = base.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k + 1)
    entries = few.groupBy("_key").agg(F.first("_hash").alias("_hash"), F.first("_vec").alias("_vec"), F.sort_array(F.collect_list("_id")).alias("_ids"))
    entries = written(entries.withColumn("_vec", F.col("_vec").cast("array<float>" if single else "array<double>")))
    asking = base.where("_query").groupBy(F.col("_id").alias("query_id")).agg(F.min("_key").alias("_ask"))
    asking = written(asking)
    pivot = pivots_of(entries, pivots, seed)
    sent = spark.sparkContext.broadcast(pivot)
    small = np.uint8 if len(pivot) <= 256 else np.uint16

    def order(batch: pa.RecordBatch) -> list:
        x = np.array(batch.column("_vec").to_pylist(), dtype=np.float64).reshape(batch.num_rows, dim)
        perm = permutations(sent.value, x)
        place = np.argsort(perm, axis=1).astype(small)
        return [perm.astype(np.int32)[:, : max(post, probe)].tolist(), [p.tobytes() for p in place], [r.tobytes() for r in x.astype(kind)]]

    ordered = written(with_columns(entries, order, "_perm array<int>, _place binary, _x binary", drop=("_vec", "_hash")))
    lists = ordered.select(F.explode(F.slice("_perm", 1, post)).alias("_pivot")).groupBy("_pivot").count()
    readers = ordered.join(asking.select(F.col("_ask").alias("_key")).distinct(), "_key", "left_semi")
    asked = readers.select("_key", "_place", "_x", F.explode(F.slice("_perm", 1, probe)).alias("_pivot"))
    rows_of = {r["_pivot"]: -(-r["count"] // block) for r in lists.collect()}
    asks_of = {r["_pivot"]: -(-r["count"] // asks) for r in asked.groupBy("_pivot").count().collect()}
    many = lambda of: F.element_at(F.array(*[F.lit(int(of.get(i, 0))) for i in range(len(pivot))]), F.col("_pivot") + 1)
    dealt = lambda of: F.pmod(F.xxhash64("_key"), many(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), many(of) - 1))
    posted = ordered.select("_key", "_ids", "_place", "_x", F.lit(False).alias("_asks"), F.explode(F.slice("_perm", 1, post)).alias("_pivot"))
    posted = posted.where(many(asks_of) > 0).withColumn("_block", dealt(rows_of)).withColumn("_asked", spread(asks_of))
    asked = asked.where(many(rows_of) > 0).withColumn("_asks", F.lit(True)).withColumn("_block", spread(rows_of)).withColumn("_asked", dealt(asks_of))

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ask, have = rows[rows["_asks"]], rows[~rows["_asks"]]
        unpack = lambda part, col, kind: np.frombuffer(b"".join(part[col]), kind).reshape(len(part), -1)
        found: list[tuple] = []
        if len(ask) and len(have):
            least = np.array([i[0] for i in have["_ids"]])
            have = have.iloc[np.argsort(least, kind="stable")]
            least = np.sort(least)
            ids, place, x = list(have["_ids"]), unpack(have, "_place", small).astype(np.int16), unpack(have, "_x", kind).astype(np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            some = max(8 * k, int(rerank * len(ids)))
            for q, at, v in zip(ask["_key"], unpack(ask, "_place", small).astype(np.int16), unpack(ask, "_x", kind).astype(np.float64)):
                first = np.sort(ranked(place, at, some))
                cos = (x[first] * v).sum(axis=1) / (norms[first] * np.sqrt((v * v).sum()))
                best = np.lexsort((least[first], -cos))[: k + 1]
                found += [(q, i, cos[b], 0) for b in best for i in ids[first[b]]]
                found.append((q, None, None, len(ids)))
        out = pd.DataFrame(found, columns=["_ask", "vec_id", "score", "ranked"])
        return out.astype({"vec_id": "Int64", "score": "float64", "ranked": "int64"})

    near = posted.unionByName(asked.withColumn("_ids", F.lit(None).cast("array<long>"))).groupBy("_pivot", "_block", "_asked")
    near = near.applyInPandas(search, "_ask string, vec_id long, score double, ranked long")
    # A (key, id) is met once for each file that both read; the counts of files are rows without an id.
    near = near.groupBy("_ask", "vec_id").agg(F.max("score").alias("score"), F.sum("ranked").alias("ranked"))
    near = near.withColumn("ranked", F.sum("ranked").over(Window.partitionBy("_ask"))).where("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("_ask").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n")
    met = asking.join(near, "_ask").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "ranked")
