"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

For vectors x and y cut into segments of m components with means a, b and deviations s, t,
    x . y = sum of m a b + sum of centred products <= sum of m (a b + s t),
and |x - y|^2 = |x|^2 + |y|^2 - 2 x . y, so this upper bound of the score is the lower bound of the distance that
segment statistics give. Finer segments bound tighter. Each level costs one product of 2 x segments columns.

Corpus and queries are dealt to (corpus block, query block) pairs by key, so a task holds one block of either at a
time, and no pair of rows is ever written out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Segments a level, coarse to fine, for vectors of any length that is padded with zeros to a multiple of the last.
LEVELS = (1, 4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(m) * means, then sqrt(m) * deviations, so that a product of two rows bounds the inner product."""
    parts = x.reshape(len(x), segments, -1)
    mean, root = parts.mean(axis=2), np.sqrt(parts.shape[2])
    return np.hstack([mean, np.sqrt(((parts - mean[:, :, None]) ** 2).mean(axis=2))]) * root


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """A type in which all inner products are exact; refuses vectors whose products leave 64 bits."""
    norm = lambda x: math.sqrt(max((float((r.astype(np.float64) ** 2).sum()) for r in x), default=0.0))
    most = norm(queries) * norm(rows)  # bounds the sum of the products' magnitudes, too
    if most >= 2.0**62:
        raise OverflowError("inner products of more than 62 bits")
    return np.float64 if most < 2.0**52 else np.int64


def top_k_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray | None = None, step: int = 256, alive_by_level: list[int] | None = None) -> pd.DataFrame:
    """The k best rows of a block for each query, not those of its id: query (its number), vec_id, score. Integer matrices.

    least: scores that are known to be reached by k rows elsewhere, by query; lower ones are left out. alive_by_level: is
    filled with the pairs that are left after each level, the first number being all pairs.
    """
    order = np.argsort(row_ids, kind="stable")  # then a stable order by score breaks ties by vec_id
    rows, row_ids = rows[order], row_ids[order]
    wide, exact = -(-max(queries.shape[1], 1) // LEVELS[-1]) * LEVELS[-1], _exact_kind(queries, rows)
    pad = lambda x: np.pad(x.astype(np.float64), ((0, 0), (0, wide - x.shape[1])))
    q_all, r_all = pad(queries), pad(rows)
    levels = [(segment_statistics(q_all, s), segment_statistics(r_all, s)) for s in LEVELS]
    slack = 1e-6 * (1 + np.sqrt((q_all**2).sum(axis=1).max(initial=0) * (r_all**2).sum(axis=1).max(initial=0)))
    q_int, r_int, left = queries.astype(exact), rows.astype(exact), np.zeros(len(LEVELS) + 1, np.int64)
    out = []
    for at in range(0, len(queries), step):
        ids = query_ids[at : at + step]
        other = ids[:, None] != row_ids[None, :]
        bound = np.where(other, levels[0][0][at : at + step] @ levels[0][1].T, -np.inf)
        floor = np.full(len(ids), -np.inf) if least is None else least[at : at + step].astype(np.float64)
        alive = other.copy()
        left[0] += other.sum()
        for level, (own, theirs) in enumerate(levels, 1):
            a, b = np.nonzero(alive) if level > 1 else ((), ())
            if level > 1 and len(a) * 4 < alive.size:  # few left: bound them pair by pair
                for s in range(0, len(a), 500_000):
                    i, j = a[s : s + 500_000], b[s : s + 500_000]
                    alive[i, j] = np.einsum("ij,ij->i", own[at + i], theirs[j]) >= floor[i] - slack
            else:
                if level > 1:
                    bound = np.where(alive, own[at : at + step] @ theirs.T, -np.inf)
                if len(rows) > k:  # exact scores of the rows with the best bounds so far raise each query's threshold
                    first = np.argpartition(-bound, k, axis=1)[:, : k + 1]
                    known = np.einsum("qd,qkd->qk", q_all[at : at + step], r_all[first])
                    known[~np.take_along_axis(alive, first, axis=1)] = -np.inf
                    floor = np.maximum(floor, np.sort(known, axis=1)[:, 1])  # the k-th of k + 1
                alive &= bound >= floor[:, None] - slack
            left[level] += alive.sum()
        for n in range(len(ids)):
            j = np.nonzero(alive[n])[0]
            score = (r_int[j] @ q_int[at + n]).astype(np.int64)
            best = np.argsort(-score, kind="stable")[:k]
            if least is not None:
                best = best[score[best] >= least[at + n]]
            out.append(pd.DataFrame({"query": at + n, "vec_id": row_ids[j[best]], "score": score[best]}))
    if alive_by_level is not None:
        alive_by_level[:] = left.tolist()
    return pd.concat(out) if out else pd.DataFrame({"query": [], "vec_id": [], "score": []}, dtype="int64")


_LEAST = -(2**63)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """For each row of queries the k highest integer inner products among rows with another vec_id: query_id, rank, vec_id, score.

    rows and queries: vec_id long, v array<long>; shorter ones count as padded with zeros. Ties go to the smaller vec_id.
    A null v takes no part. Fewer than k rows: all of them. Repeated rows each count, and repeated queries each have a
    result. An empty table gives an empty result. Products of more than 62 bits are an error; all others are exact.

    One block of rows gives each query a first threshold, which it carries to all other blocks.
    """
    named = lambda d: d.where("v is not null").select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v")
    rows, queries = settle(named(rows)), settle(named(queries))
    row_blocks, query_blocks = (max(1, -(-d.count() // n)) for d, n in ((rows, block), (queries, query_block)))
    dealt = lambda d, n, name, salt: d.withColumn(name, F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(n)).cast("int"))
    spread = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    rows, queries = dealt(rows, row_blocks, "rb", 1), dealt(queries, query_blocks, "qb", 2)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(a["v"].map(len).max(), b["v"].map(len).max())
        least = b["least"].to_numpy() if (b["least"] > _LEAST).any() else None
        found = top_k_block(_matrix(b["v"], width), b["vec_id"].to_numpy(), _matrix(a["v"], width), a["vec_id"].to_numpy(), k, least)
        at = found["query"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"uid": b["uid"].to_numpy()[at], "query_id": b["vec_id"].to_numpy()[at], "vec_id": found["vec_id"], "score": found["score"]})

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.withColumn("qb", spread(0, query_blocks))
        return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, "uid long, query_id long, vec_id long, score long")

    everyone = queries.withColumn("least", F.lit(_LEAST))
    found = met(rows.where("rb = 0"), everyone.withColumn("rb", F.lit(0)))
    if row_blocks > 1:
        found = settle(found)
        floor = found.groupBy("uid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("uid").alias("_uid"), "least")
        informed = queries.join(floor, F.col("uid") == F.col("_uid"), "left").withColumn("least", F.coalesce("least", F.lit(_LEAST))).drop("_uid")
        found = found.union(met(rows.where("rb > 0"), informed.withColumn("rb", spread(1, row_blocks))))
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component as double; rows null or with null or non-finite components go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.where(F.col("embedding").isNotNull() & ~bad & F.col("vec_id").isNotNull())
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
