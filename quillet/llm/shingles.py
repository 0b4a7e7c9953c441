"""Near copies by the shingles they share: MinHash bands propose pairs, exact Jaccard of the shingle sets decides.

A text's set holds the 64-bit hashes of its runs of SHINGLE lower-case words (of all its words, if it has fewer).
BANDS keys of ROWS minima each bring texts together: a pair of similarity s shares a key with chance
1 - (1 - s ** ROWS) ** BANDS, which is 0.998 at 0.8. Within a key each text is first paired with the NEAREST of those
with smaller ids that look most like it by a sketch of its minima, so a large group costs pairs in proportion to
its members. What these links leave in different components is paired in full (remaining), but for pairs whose sizes,
or counts of hashes by bins, do not allow the similarity; so every pair that shares a key is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import with_block_pairs
from .runs import whole_runs
from .util import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
SEED = 42
#: Bytes of a sketch; texts paired with each one in a key; rows of a block of a hot key.
SKETCH, NEAREST, BLOCK_ROWS = 32, 3, 4096
#: Bins of a text's hashes, a byte each; pairs that leave a task together.
BINS, PAIRS = 256, 65536
_RANDOM = np.random.default_rng(SEED)
_TIMES, _PLUS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_TIMES |= np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _PLACE[i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(keys, sketch): BANDS longs and SKETCH bytes; no shingles give no keys."""
    if not len(shingles):
        return np.zeros(0, np.int64), bytes(SKETCH)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _TIMES + _PLUS).min(0))
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64)
    return keys.view(np.int64), (least[:SKETCH] >> np.uint64(56) ^ least[:SKETCH] >> np.uint64(20)).astype(np.uint8).tobytes()


def binned(shingles: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of BINS bins, 255 at most: two sets share no more than the lesser counts add up to."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def shingles_of(text: Column, shingle: int = SHINGLE) -> Column:
    """shingle_set of a text as an array of longs; null counts as empty."""
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t or b"", shingle).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(sets, "array<long>")(text)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_runs(batches, ["key", "lo", "hi"]):
        ids = table.column("id").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        sizes = np.diff(np.append(starts, len(ids)))
        two = starts[sizes == 2]
        a, b = [ids[two]], [ids[two + 1]]
        for s, g in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            order = s + np.argsort(ids[s : s + g], kind="stable")
            look = sketch[order]
            for at in range(1, g, 64):
                rows = np.arange(at, min(g, at + 64))
                same = (look[rows, None] == look[None, : rows[-1]]).sum(2, dtype=np.int16)
                same[np.arange(rows[-1])[None] >= rows[:, None]] = -1
                best = np.argsort(-same, axis=1, kind="stable")[:, :NEAREST]
                n, m = np.nonzero(np.take_along_axis(same, best, 1) >= 0)
                a.append(ids[order[best[n, m]]])
                b.append(ids[order[rows[n]]])
        x, y = np.concatenate(a), np.concatenate(b)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of signed (id, keys, sketch; ids distinct) that share a key and are to be verified."""
    keyed = signed.select("id", "sketch", F.explode("keys").alias("key"))
    keyed = with_block_pairs(keyed, "key", "id", BLOCK_ROWS)
    dealt = keyed.select("key", "lo", "hi", "id", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    kind = signed.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(_near, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _across(similarity: float):
    """Pairs of a key whose components differ and whose sizes and bins allow the similarity; small keys were paired in full before."""
    def of_group(ids: np.ndarray, own: np.ndarray, n: np.ndarray, bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(n, kind="stable")
        ids, own, n, bins = ids[order], own[order], n[order], bins[order]
        beyond = n - bins.sum(1, dtype=np.int64)  # what full bins leave out
        first = np.searchsorted(n, similarity * n)  # a smaller set is at least this part of the larger one
        for i in range(1, len(ids)):
            j = first[i] + np.flatnonzero(own[first[i] : i] != own[i])
            common = np.minimum(bins[j], bins[i]).sum(1, dtype=np.int64) + np.minimum(beyond[j], beyond[i])
            j = j[common >= similarity * (n[j] + n[i] - common)]
            if len(j):
                yield ids[j], np.full(len(j), ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key", "lo", "hi"]):
            ids, own, n = (table.column(c).to_numpy() for c in ("id", "root", "n"))
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
            a, b, held = [], [], 0
            for s, g in zip(starts.tolist(), np.diff(np.append(starts, len(ids))).tolist()):
                if g <= NEAREST + 1 or (own[s : s + g] == own[s]).all():
                    continue
                for x, y in of_group(*(v[s : s + g] for v in (ids, own, n, bins))):
                    a.append(x)
                    b.append(y)
                    held += len(x)
                    if held >= PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                        a, b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    return run


def remaining(signed: DataFrame, pairs: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: what candidates() left out of signed (id, keys, n, bins) and may link what pairs' links, with roots (node, root), left apart."""
    own = signed.join(roots, F.col("id") == F.col("node"), "left").select("id", "keys", "n", "bins", F.coalesce("root", "id").alias("root"))
    keyed = own.select("id", "root", F.explode("keys").alias("key"))
    mixed = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).where((F.col("rows") > NEAREST + 1) & (F.col("least") < F.col("most")))
    open_ = materialize(keyed.join(mixed.select("key"), "key", "left_semi"))
    keyed = with_block_pairs(open_, "key", "id", BLOCK_ROWS).join(signed.select("id", "n", "bins"), "id")
    dealt = keyed.select("key", "lo", "hi", "id", "root", "n", "bins").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    kind = signed.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(_across(similarity), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) whose sets (id, shingles) have a Jaccard similarity of at least that."""
    one, other = (sets.select(F.col("id").alias(f"id_{c}"), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    met = pairs.join(one, F.col("a") == F.col("id_a")).join(other, F.col("b") == F.col("id_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(both >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")
