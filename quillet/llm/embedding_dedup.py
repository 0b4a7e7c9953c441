"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation that makes balanced 64-bit sign codes is learned on a bounded sample. Every vector's code is cut into
four 16-bit substrings; in each table a vector stands under its substring and its 16 one-bit neighbours, so that
substrings up to two bits apart share a bucket. Codes alone go through the buckets first: a vector stays in those
where some code is within FAR bits. Only there the original vectors are brought in and reranked in double precision.
A pair at cosine 0.9 differs in about 9 of the 64 bits (hardly ever in more than FAR), hence in at most two bits of
some substring with a probability of about 0.97; closer pairs are found nearly always (the tests measure recall).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import with_block_pairs
from .components import components
from .runs import whole_runs
from .util import discard, materialize

COSINE = 0.9
SAMPLE_ROWS = 16384
ITERATIONS = 40
TABLES, WIDTH, VARIANTS = 4, 16, 17
BLOCK_ROWS = 2048
#: Differing bits of two codes beyond which their vectors are not compared.
FAR = 20


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    top = float(np.finfo(np.float64).max)
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= top))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_rotation(rows: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): PCA followed by the ITQ rotation, 64 columns; rows: sample of unit vectors."""
    d = rows.shape[1]
    rng = np.random.default_rng(7)
    mean = rows.mean(0)
    centred = rows - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(d))
    parts, bits = [], TABLES * WIDTH
    for _ in range(math.ceil(bits / d)):
        k = min(d, bits)
        base = axes[:, ::-1][:, :k]
        v = centred @ base
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(iterations):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(base @ r)
    return mean, np.concatenate(parts, 1)[:, :bits]


def unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix_of(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def hash_codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (unit(vectors) - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _canonical(x: np.ndarray, y: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether this bucket is the one of all that the codes x and y share in which the pair counts."""
    diff, todo, own = x ^ y, np.ones(len(x), bool), np.zeros(len(x), bool)
    for t in range(TABLES):
        cut = lambda v: (v >> np.uint64(WIDTH * t)) & np.uint64((1 << WIDTH) - 1)
        d, a, b = cut(diff), cut(x), cut(y)
        bits = np.bitwise_count(d)
        low = d & (~d + np.uint64(1))
        chosen = np.where(bits < 2, np.minimum(a, b), np.minimum(a ^ low, b ^ low))
        here = todo & (bits <= 2)
        own |= here & (table == t) & (chosen == key)
        todo &= ~here
    return own


def _small(rows: np.ndarray, unit_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of positions within each row of positions."""
    out = []
    step = max(1, 400_000 // rows.shape[1] ** 2)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        v = unit_rows[part]
        r, i, j = np.nonzero(np.triu(v @ v.transpose(0, 2, 1) >= COSINE, 1))
        out.append((part[r, i], part[r, j]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _near_codes(batches):
    """(uid, key, lo, hi): the places where a code has another within FAR bits for which this bucket counts."""
    for table, starts in whole_runs(batches, ["key", "lo", "hi"]):
        n = len(table)
        sizes = np.diff(np.append(starts, n))
        code, key, blk = table.column("code").to_numpy().view(np.uint64), table.column("key").to_numpy(), table.column("blk").to_numpy()
        two_blocks = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        own = np.zeros(n, bool)

        def mark(i, j):
            fits = ~two_blocks[i] | (blk[i] != blk[j])
            i, j = i[fits], j[fits]
            fits = _canonical(code[i], code[j], key[i] >> WIDTH, (key[i] & ((1 << WIDTH) - 1)).astype(np.uint64))
            own[i[fits]] = own[j[fits]] = True

        for g in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():
            rows = starts[sizes == g][:, None] + np.arange(g)
            for at in range(0, len(rows), max(1, 400_000 // g**2)):
                part = rows[at : at + max(1, 400_000 // g**2)]
                near = np.bitwise_count(code[part][:, :, None] ^ code[part][:, None, :]) <= FAR
                r, i, j = np.nonzero(near & np.triu(np.ones((g, g), bool), 1))
                mark(part[r, i], part[r, j])
        for s, g in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            run = code[s : s + g]
            for at in range(0, g, 256):
                i, j = np.nonzero(np.triu(np.bitwise_count(run[at : at + 256, None] ^ run[None]) <= FAR, at + 1))
                mark(i + s + at, j + s)
        if own.any():
            yield from table.select(["uid", "key", "lo", "hi", "blk"]).filter(pa.array(own)).to_batches()


def _rerank(batches):
    """Per bucket: (uid, n, root): links counted here, and a vector of its bucket that it is connected with."""
    for table, starts in whole_runs(batches, ["key", "lo", "hi"]):
        n = len(table)
        sizes = np.diff(np.append(starts, n))
        if not (sizes > 1).any():
            continue
        code, uid, mult = table.column("code").to_numpy().view(np.uint64), table.column("uid").to_numpy(), table.column("mult").to_numpy()
        key, blk = table.column("key").to_numpy(), table.column("blk").to_numpy()
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        v = unit(matrix_of(table.column("embedding")))
        links, root = np.zeros(n, np.int64), np.arange(n)
        linked = np.zeros(n, bool)

        def count(i, j):
            fits = (lo[i] == hi[i]) | (blk[i] != blk[j])
            fits &= _canonical(code[i], code[j], key[i] >> WIDTH, (key[i] & ((1 << WIDTH) - 1)).astype(np.uint64))
            np.add.at(links, i[fits], mult[j[fits]])
            np.add.at(links, j[fits], mult[i[fits]])

        edges = []
        for g in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():
            i, j = _small(starts[sizes == g][:, None] + np.arange(g), v)
            if len(i):
                count(i, j)
                edges.append((i, j))
        for s, g in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            near = np.zeros((g, g), bool)
            for at in range(0, g, 1024):
                near[at : at + 1024] = v[s + at : s + min(g, at + 1024)] @ v[s : s + g].T >= COSINE
            np.fill_diagonal(near, True)
            for at in range(0, g, 256):
                i, j = np.nonzero(np.triu(near[at : at + 256], at + 1))
                count(i + s + at, j + s)
            label = np.arange(g)
            while True:
                new = np.concatenate([np.where(near[at : at + 1024], label, g).min(1) for at in range(0, g, 1024)])
                if (new == label).all():
                    break
                label = new
            i = np.arange(g)
            edges.append((i[label != i] + s, label[label != i] + s))
        a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        own = np.flatnonzero(links)
        if len(a) or len(own):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([uid[own], uid[a]])),
                pa.array(np.concatenate([links[own], np.zeros(len(a), np.int64)])),
                pa.array(np.concatenate([uid[own], uid[b]]))], names=["uid", "n", "root"])


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept (long, as the ids, boolean).

    n_links: other rows found with cosine >= 0.9 (in double precision), exact copies included; component_id: least
    id reachable over links, its own included; kept: it is that one. Vectors that are null, zero, hold null or
    non-finite components, or have another length than most of the sample link with nothing: 0, their own id.
    Rows that repeat an id are rows of their own, linked as their vectors are; a row whose id is null takes part
    and has a null component_id only if no id is in its component, and kept null. No rows give no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    sample = [r[0] for r in own.where(usable(F.col("embedding"))).select("embedding").distinct()
              .orderBy(F.xxhash64("embedding")).limit(SAMPLE_ROWS).collect()]
    lengths = [len(x) for x in sample]
    if not lengths:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    d = max(set(lengths), key=lambda n: (lengths.count(n) if len(set(lengths)) > 1 else 1, n))
    mean, projection = fit_rotation(unit(np.array([x for x in sample if len(x) == d], np.float64)))

    @F.arrow_udf("long")
    def code_of(x: pa.Array) -> pa.Array:
        return pa.array(hash_codes(matrix_of(x), mean, projection).view(np.int64))

    fits = usable(F.col("embedding")) & (F.size("embedding") == d)
    distinct = own.where(fits).groupBy("embedding").agg(F.count("*").alias("mult"), F.min("id").alias("first"))
    distinct = materialize(distinct.withColumn("uid", F.monotonically_increasing_id()).withColumn("code", code_of("embedding")))
    keys = [(F.shiftrightunsigned("code", WIDTH * t).bitwiseAND(F.lit((1 << WIDTH) - 1)).bitwiseXOR(F.lit(flip)) + F.lit(t << WIDTH)).cast("int")
            for t in range(TABLES) for flip in [0, *(1 << i for i in range(WIDTH))]]
    keyed = distinct.select("uid", "code", F.explode(F.array(*keys)).alias("key"))
    keyed = with_block_pairs(keyed, "key", "uid", BLOCK_ROWS)
    place = ["key", "lo", "hi"]
    dealt = keyed.repartition(*place).sortWithinPartitions(*place).select(*place, "blk", "uid", "code")
    near = materialize(dealt.mapInArrow(_near_codes, "uid long, key int, lo int, hi int, blk int"))
    full = near.join(distinct.select("uid", "mult", "code", "embedding"), "uid").repartition(*place).sortWithinPartitions(*place)
    full = full.select(*place, "blk", "uid", "mult", "code", "embedding")
    found = materialize(full.mapInArrow(_rerank, "uid long, n long, root long").groupBy("uid", "root").agg(F.sum("n").alias("n")))
    discard(near)
    n_links = found.groupBy("uid").agg(F.sum("n").alias("n")).withColumnRenamed("uid", "of")
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = distinct.join(roots, F.col("uid") == F.col("node"), "left").join(n_links, F.col("uid") == F.col("of"), "left")
    named = named.select("embedding", "first", F.coalesce("root", "uid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select(F.col("embedding").alias("of"), "n_links", "component_id", F.lit(True).alias("used"))
    return own.join(label, fits & (F.col("embedding") == F.col("of")), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("used"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))
