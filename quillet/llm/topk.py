"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into bounded blocks. A first look at the longest vectors gives each query a lower
bound of its k-th score. Per block, the bound divided by the lengths is the local cosine threshold: a block whose
longest vector cannot reach it is skipped before any row is sent; in the others the threshold decides whether
candidates are cut by length or by the feasible ranges of the query's largest coordinates; the products of the
remaining ones are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .embedding_dedup import matrix_of
from .util import materialize

#: Rows of a block about; queries that meet a block at once; length classes; rows of the first look.
BLOCK_ROWS, QUERY_ROWS, CLASSES, SEED_ROWS = 8192, 4096, 16, 2048
#: Cosine threshold from which coordinates prune, and how many; lengths whose product is exact in doubles.
COORDINATE_FROM, FOCUS, EXACT = 0.7, 3, float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<long>, norm): floor(256 * x) of each row that has an id and a usable vector."""
    x = F.col(vector_col)
    top = float(np.finfo(np.float64).max) / 256
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= top)), F.lit(False))
    ints = vectors.where(fine & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"))
    return ints.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _whole_products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers, for components so large that doubles would round; kept within a long."""
    most = (1 << 63) - 1
    return np.array([min(max(sum(a * b for a, b in zip(r, q.tolist())), -most), most) for r in v.tolist()], np.int64)


def _padded(rows, width: int, dtype=np.float64) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): for each query the k highest integer inner products.

    queries: rows of the same form, each compared with every row of vectors whose id is not its own; ties go to
    the smaller id; all candidates, if fewer than k. Rows that repeat an id are candidates of their own, and may both
    be listed; they are left out together for a query of that id; queries that share an id share their k places.
    Vectors that are null or hold null or non-finite components and rows without an id take no part; shorter vectors
    count as padded by zeros; a product beyond a long counts as the nearest long. Other columns are ignored, whatever
    their names. No rows give no rows.
    """
    base = materialize(quantised(vectors, id_col, vector_col))
    asked = quantised(queries, id_col, vector_col).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
    stats = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = stats["width"] or 1
    steps = [i / CLASSES for i in range(1, CLASSES)] if stats["n"] > BLOCK_ROWS else []
    bounds = sorted(set(base.approxQuantile("norm", steps, 0.01))) if steps else []
    cls = F.lit(0)
    for b in bounds:
        cls = cls + F.when(F.col("norm") >= b, 1).otherwise(0)
    classed = base.withColumn("cls", cls)
    sizes = {r["cls"]: r for r in classed.groupBy("cls").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    block_of = F.lit(None).cast("int")
    first, blocks = 0, []  # at most CLASSES + n / BLOCK_ROWS pairs of numbers
    for c, r in sorted(sizes.items()):
        n = -(-r["n"] // BLOCK_ROWS)
        block_of = F.when(F.col("cls") == c, F.lit(first) + F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).otherwise(block_of)
        blocks.append((first, first + n, float(r["most"])))
        first += n
    blocked = classed.select(block_of.alias("block"), "id", "v", "norm")

    seed = base.orderBy(F.desc("norm"), "id").limit(SEED_ROWS).select("id", "v").collect()
    seed_ids, seed_v = np.array([r["id"] for r in seed]), _padded([r["v"] for r in seed], width)

    @F.arrow_udf("double")
    def lower_bound(ids: pa.Array, v: pa.Array) -> pa.Array:
        q = ids.to_numpy(zero_copy_only=False)
        scores = _padded(v.to_pylist(), width) @ seed_v.T
        scores -= np.abs(scores) * 1e-12  # a bound may be lower than the product, not higher
        scores[q[:, None] == seed_ids[None, :]] = -np.inf
        if scores.shape[1] < k:
            return pa.array(np.full(len(q), -np.inf))
        return pa.array(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])

    chunks = 1 + asked.count() // QUERY_ROWS
    asked = asked.withColumn("bound", lower_bound("qid", "qv")).withColumn("chunk", F.pmod(F.xxhash64("qid", "qv"), F.lit(chunks)).cast("int"))
    reach = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("most")) for a, b, m in blocks] or [F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("most"))])
    sent = asked.withColumn("r", F.explode(reach)).where("r.b > r.a AND bound <= qnorm * r.most * (1 + 1e-12)")
    sent = sent.withColumn("block", F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1))).select("block", "chunk", "qid", "qv", "qnorm", "bound")
    sent = materialize(sent) if chunks > 1 else sent
    # each block goes once to each lot of queries, some of which it may answer
    id_type = base.schema["id"].dataType
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.LongType())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(-left.column("norm").to_numpy(), kind="stable")
        ids, norms = left.column("id").to_numpy()[order], left.column("norm").to_numpy()[order]
        listed = left.column("v").to_pylist()
        v = _padded(listed, width)[order] if len(left) else np.zeros((0, width))
        whole = None
        got_q, got_v, got_s = [], [], []
        for at in range(0, len(right) if len(left) else 0, 256):
            part = right.slice(at, 256)
            qids, q = part.column("qid").to_numpy(), _padded(part.column("qv").to_pylist(), width)
            qn, bound = part.column("qnorm").to_numpy(), part.column("bound").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(bound > 0, bound / (qn * norms[0]), -1.0) * (1 - 1e-9)
                need = np.where(bound > 0, bound / qn, 0.0) * (1 - 1e-9)
            reach = np.searchsorted(-norms, -need, side="right")  # longest first: those that are long enough
            by_length = np.flatnonzero(local < COORDINATE_FROM)
            products = q[by_length] @ v[: reach[by_length].max(initial=0)].T
            rows = {int(i): (np.arange(reach[i]), products[n, : reach[i]]) for n, i in enumerate(by_length)}
            for i in np.flatnonzero(local >= COORDINATE_FROM):
                unit_q, t = q[i] / qn[i], min(1.0, local[i])
                keep = np.arange(reach[i])
                for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
                    x = v[keep, f] / np.maximum(norms[keep], 1e-300)
                    off = np.sqrt((1 - t * t) * max(0.0, 1 - unit_q[f] ** 2)) + 1e-9
                    keep = keep[(x >= unit_q[f] * t - off if unit_q[f] > 0 else x >= unit_q[f] - off) & (x <= (unit_q[f] if unit_q[f] > 0 else unit_q[f] * t) + off)] if t < 1 else keep
                rows[int(i)] = (keep, v[keep] @ q[i])
            for i, (keep, s) in rows.items():
                if len(norms) and qn[i] * norms[0] > EXACT:
                    whole = _padded(listed, width, np.int64)[order] if whole is None else whole
                    s = _whole_products(whole[keep], _padded([part.column("qv")[int(i)].as_py()], width, np.int64)[0])
                fits = (s >= bound[i]) & (ids[keep] != qids[i])
                keep, s = keep[fits], s[fits]
                best = _best(s, ids[keep], k)
                got_q.append(np.full(len(best), qids[i]))
                got_v.append(ids[keep][best])
                got_s.append(s[best].astype(np.int64))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(got_q), "vec_id": cat(got_v), "score": cat(got_s)})

    lots = sent.select(F.col("block").alias("of_block"), F.col("chunk").alias("lot")).distinct()
    met = blocked.join(lots, F.col("block") == F.col("of_block")) if chunks > 1 else blocked.withColumn("lot", F.lit(0))
    found = met.groupBy("block", "lot").cogroup(sent.groupBy("block", "chunk")).applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
