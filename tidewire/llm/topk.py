"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length over the whole table: a bucket holds lengths within a
factor of ``BUCKET_RATIO``, in blocks of bounded size.  Buckets are searched in waves
from the longest on, each wave about twice as many vectors as those before, and every
query carries its k-th best product from wave to wave: only pairs of a query and a
bucket where the product of the lengths reaches it are dealt out at all.  Within a
block the same threshold, relative to the lengths, is a cosine: where it is low, whole
lengths are pruned; where it is high, candidates whose focus coordinate lies outside
the range that it leaves are pruned too.  What remains is verified by exact integer
products, and the k best of all so far are kept per query.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part; vectors meet only those of their own dimension; rows that repeat an
id are one vector, the smallest in the order of its components; equal scores go to
the smaller id; products are worked out in integers of any size, and OverflowError is
raised if one of the k best doesn't fit a long; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import written

#: Rows in a block of queries and in one of candidates, and candidates that are looked at together.
BLOCK_ROWS = 4_096
BUCKET_ROWS = 512
#: Pairs of a bucket and a block of queries that are broadcast, at most; more are joined.
FEW_ASKED = 100_000
#: The shortest length of a bucket, as a share of its longest.
BUCKET_RATIO = 0.9
#: From this median cosine threshold on, coordinates prune too.
COORDINATE_FROM = 0.5


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as a whole double: those beyond the range of a long are exact too."""
    whole = F.lit(float(1 << 53))

    def floor(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < whole, F.floor(F.when(F.abs(y) < whole, y).otherwise(F.lit(0.0))).cast("double")).otherwise(y)

    return F.transform(embedding, floor)


def _length(v: Column) -> Column:
    most = F.array_max(F.transform(v, F.abs))
    scaled = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + F.pow(x / F.greatest(most, F.lit(1.0)), F.lit(2.0))))
    return F.least(F.greatest(most, F.lit(1.0)) * scaled, F.lit(1.7e308))


def _all_products(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by integers of any size, without pruning."""
    out: list[tuple[int, int, int]] = []
    columns = [(int(i), [int(x) for x in row]) for i, row in zip(c_ids, c.tolist(), strict=True)]
    for i, row in zip(q_ids.tolist(), q.tolist(), strict=True):
        own = [int(x) for x in row]
        scores = sorted((-sum(x * y for x, y in zip(own, other, strict=True)), j) for j, other in columns if j != i)
        out += [(i, j, -s) for s, j in scores[:k]]
    if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in out):
        raise OverflowError("one of the best products doesn't fit a long")
    who, which, score = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
    return who, which, score


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, without its own id: query ids, candidate ids, scores.

    ``known``: scores below which a query looks for none.
    """
    largest = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] if len(q) and len(c) else 0.0
    if largest >= 2**62 or (len(q) and max(float(np.abs(q).max()), float(np.abs(c).max(initial=0))) >= 2**62):
        return _all_products(q_ids, q, c_ids, c, k)
    exact = np.float64 if largest < 2**52 else np.int64
    lengths = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((c_ids, -lengths))
    c_ids, lengths = c_ids[order], lengths[order]
    c, q = c[order].astype(exact), q.astype(exact)
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    unit_q = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.abs(unit_q).argmax(axis=1)
    theta = np.full(len(q), -np.inf) if known is None else known.astype(np.float64)
    rows = np.zeros(0, dtype=np.int64)
    ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=exact)
    at = 0
    while at < len(c):
        end = min(at + BUCKET_ROWS, len(c), at + int(np.searchsorted(-lengths[at:], -BUCKET_RATIO * lengths[at], side="right")))
        end = max(end, at + 1)
        reach = q_len * lengths[at]
        slack = 1e-9 * reach + 1e-6
        active = np.flatnonzero(reach + slack >= theta)
        if not len(active):
            break
        cosine = np.clip(np.where(reach > 0, (theta - slack) / np.maximum(reach, 1e-300), -1), -1, 1)[active]
        if np.median(cosine) < COORDINATE_FROM:
            groups = [(active, np.arange(at, end))]
        else:
            groups = []
            unit_c = c[at:end] / np.maximum(lengths[at:end], 1e-300)[:, None]
            mid = unit_q[active, focus[active]]
            spread = np.sqrt((1 - cosine**2) * (1 - np.minimum(mid**2, 1)))
            # where the query's own coordinate is beyond the threshold, all coordinates on that side can qualify
            low = np.where((cosine <= 0) | (mid <= -cosine), -2, mid * cosine - spread - 1e-9)
            high = np.where((cosine <= 0) | (mid >= cosine), 2, mid * cosine + spread + 1e-9)
            for f in np.unique(focus[active]):
                own = np.flatnonzero(focus[active] == f)
                x = unit_c[:, f]
                inside = np.flatnonzero((x >= low[own].min()) & (x <= high[own].max()) | (lengths[at:end] == 0))
                if len(inside):
                    groups.append((active[own], at + inside))
        for who, which in groups:
            product = q[who] @ c[which].T
            hit_q, hit_c = np.nonzero((product >= theta[who][:, None]) & (q_ids[who][:, None] != c_ids[which][None, :]))
            if not len(hit_q):
                continue
            touched = np.isin(rows, who)
            all_rows = np.concatenate([rows[touched], who[hit_q]])
            all_ids = np.concatenate([ids[touched], c_ids[which[hit_c]]])
            all_scores = np.concatenate([scores[touched], product[hit_q, hit_c]])
            best = np.lexsort((all_ids, -all_scores, all_rows))
            all_rows, all_ids, all_scores = all_rows[best], all_ids[best], all_scores[best]
            new = np.ones(len(all_rows), dtype=bool)
            new[1:] = all_rows[1:] != all_rows[:-1]
            begin = np.flatnonzero(new)
            rank = np.arange(len(all_rows)) - np.repeat(begin, np.diff([*begin, len(all_rows)]))
            top = rank < k
            full = rank == k - 1
            theta[all_rows[full]] = all_scores[full]
            rows = np.concatenate([rows[~touched], all_rows[top]])
            ids = np.concatenate([ids[~touched], all_ids[top]])
            scores = np.concatenate([scores[~touched], all_scores[top]])
        at = end
    return q_ids[rows], ids, scores.astype(np.int64)


def _meeting(k: int) -> Callable:
    def meet(found: pa.Table) -> pa.Table:
        is_query = found["is_query"].to_numpy(zero_copy_only=False)
        ids = found["vec_id"].to_numpy()
        vectors = found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        known = found["theta"].to_numpy(zero_copy_only=False)[is_query]
        who, which, score = search_block(ids[is_query], vectors[is_query], ids[~is_query], vectors[~is_query], k, known)
        return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(which, pa.int64()), "score": pa.array(score, pa.int64())})

    return meet


def waves(buckets: list[tuple[int, int, int, float]], first: int) -> list[list[tuple[int, int, int, float]]]:
    """Buckets (dimension, bucket, vectors, longest) from the longest on; a wave has as many vectors of a dimension as those before it, ``first`` at least."""
    out: list[list[tuple[int, int, int, float]]] = []
    for dim in sorted({b[0] for b in buckets}):
        seen = now = turn = 0
        for b in sorted((b for b in buckets if b[0] == dim), key=lambda b: -b[3]):
            if now and now >= max(first, seen):
                seen, now, turn = seen + now, 0, turn + 1
            if len(out) <= turn:
                out.append([])
            out[turn].append(b)
            now += b[2]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row that is_query picks, against all rows."""
    spark, x = vectors.sparkSession, F.col(vector_col)
    sound = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    own = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), quantised(x).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    own = own.groupBy("vec_id").agg(F.min(F.struct("v", "is_query")).alias("s")).select("vec_id", "s.v", "s.is_query", F.size("s.v").alias("dim"), _length(F.col("s.v")).alias("length"))
    bucket = F.floor(F.log(F.greatest(F.col("length"), F.lit(1.0))) / F.lit(-math.log(BUCKET_RATIO))).cast("int")
    own = written(own.withColumn("bucket", bucket), "vectors")
    # lengths lie in at most some thousand buckets, whatever the number of vectors
    buckets = [tuple(r) for r in own.groupBy("dim", "bucket").agg(F.count("*"), F.max("length")).collect()]
    q_blocks = max(1, math.ceil(own.where("is_query").count() / BLOCK_ROWS))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for wave in waves(buckets, BLOCK_ROWS):
        plan = F.broadcast(spark.createDataFrame([(d, b, math.ceil(n / BLOCK_ROWS), most) for d, b, n, most in wave], "dim int, bucket int, blocks int, longest double"))
        reached = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("many"), F.min("score").alias("worst")).where(F.col("many") >= k).select("vec_id", F.col("worst").cast("double").alias("theta"))
        asking = own.where("is_query").drop("bucket").join(reached, "vec_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
        reach = F.col("length") * F.col("longest")
        asking = asking.join(plan, "dim").where(reach * (1 + 1e-9) + 1e-6 >= F.col("theta")).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"))
        # which blocks of queries ask a bucket: buckets times blocks of queries, broadcast only where that is few rows
        asked = asking.select("dim", "bucket", "q").distinct()
        if len(wave) * q_blocks <= FEW_ASKED:
            asked = F.broadcast(asked)
        columns = ["dim", "bucket", "c", "q", "vec_id", "v", "is_query", "theta"]
        queries = asking.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)
        candidates = own.withColumn("is_query", F.lit(False)).withColumn("theta", F.lit(float("-inf"))).join(plan, ["dim", "bucket"]).withColumn("c", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).join(asked, ["dim", "bucket"]).select(*columns)
        met = candidates.unionByName(queries).groupBy("dim", "bucket", "c", "q").applyInArrow(_meeting(k), "query_id long, vec_id long, score long")
        best = written(best.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "best")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
