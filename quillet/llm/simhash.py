"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints within 4 bits, cut into 3 segments, differ by at most one bit in some segment. Each fingerprint is
therefore indexed under every segment with one bit wiped out (64 keys), equal keys are brought together, and
the whole fingerprints of a key are verified. Inside a key only a spanning forest of the links is emitted, so a
large group of near copies costs edges in proportion to its members, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import with_block_pairs
from .components import components
from .runs import whole_runs
from .shingles import SHINGLE as SHINGLES
from .shingles import SIMILARITY, binned, candidates, remaining, shingle_set, shingles_of, signature, similar
from .util import discard, free_name, materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK_ROWS = 16384
#: First bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint_of(text: bytes) -> int:
    """The unsigned 64-bit SimHash of one text, by words of 4-word shingles; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: 1 - SHINGLE].tolist()
    stops = (ends - 1)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    over = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(over * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint_of(t or b"") for t in text.cast(pa.binary()).to_pylist()), np.uint64, len(text))
    return pa.array(values.view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint of a text as a (signed) long; null counts as an empty text."""
    return F.arrow_udf(_fingerprints, "long")(F.coalesce(text, F.lit("")))


def variant_keys(fp: Column) -> Column:
    """64 integer keys of a fingerprint: each segment without one of its bits, marked with that bit's place."""
    keys = []
    for first, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        keys += [(segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))) + F.lit((first + i) << 22)).cast("int") for i in range(width)]
    return F.array(*keys)


def forest(codes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges (positions) that connect exactly what links of at most limit differing bits connect."""
    left, edges = np.arange(len(codes)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            p = todo.pop()
            hit = np.bitwise_count(codes[left] ^ codes[p]) <= limit
            if hit.any():
                near = left[hit].tolist()
                edges += [(p, x) for x in near]
                todo += near
                left = left[~hit]
    return edges


def _verify(batches):
    for table, starts in whole_runs(batches, ["key", "lo", "hi"]):
        codes = table.column("fp").to_numpy().view(np.uint64)
        sizes = np.diff(np.append(starts, len(codes)))
        a, b = [], []
        for g in np.unique(sizes[(sizes > 1) & (sizes <= 6)]).tolist():
            rows = starts[sizes == g][:, None] + np.arange(g)
            for i in range(g):
                for j in range(i):
                    x, y = codes[rows[:, i]], codes[rows[:, j]]
                    near = np.bitwise_count(x ^ y) <= MAX_BITS
                    a.append(x[near])
                    b.append(y[near])
        for s, g in zip(starts[sizes > 6].tolist(), sizes[sizes > 6].tolist()):
            run = np.sort(codes[s : s + g])
            found = forest(run, MAX_BITS)
            if found:
                x, y = np.array(found).T
                a.append(run[x])
                b.append(run[y])
        if a and (n := sum(map(len, a))):
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of fps (fp long) that connect all within MAX_BITS bits."""
    keyed = fps.select("fp", F.explode(variant_keys(F.col("fp"))).alias("key"))
    keyed = with_block_pairs(keyed, "key", "fp", BLOCK_ROWS)
    dealt = keyed.select("key", "lo", "hi", "fp").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = dealt.mapInArrow(_verify, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 lowercase hex digits), component_id.

    component_id is the least id reachable over links of at most 4 differing bits, the row's own included.
    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows and texts stay
    rows of their own in one component. Ids that are null never become a component_id, unless the whole component
    has none: then it is null. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    own = materialize(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")))
    return _labelled(own).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(own: DataFrame) -> DataFrame:
    """own (id, fp, further columns) with component_id."""
    fps = materialize(own.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(fingerprint_links(fps))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return own.join(label, F.col("fp") == F.col("of")).drop("of")


def _signed(shingle: int):
    """Per row (id, own, text): id, own, fingerprint, MinHash keys and sketch, size and bins of its shingles, from one look at the text."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fps = np.fromiter(map(fingerprint_of, texts), np.uint64, len(texts)).view(np.int64)
            told = [(*signature(h), len(h), binned(h)) for h in (shingle_set(t, shingle) for t in texts)]
            keys, sketch, n, bins = zip(*told) if told else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(n, pa.int64()), pa.array(bins, pa.binary())],
                                             names=["id", "own", "fp", "keys", "sketch", "n", "bins"])
    return run


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLES, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of near copies: that of the least doc_id; columns as they were.

    Near copies are texts within MAX_BITS bits, as in simhash_components; then, among those that stay, texts whose
    sets of shingle words have an exact Jaccard similarity of at least similarity (all pairs that share a MinHash key
    are decided, see shingles.py). What is compared are distinct texts, so two texts under one doc_id are told apart and both stay if
    they differ. Null and blank texts are near copies of each other. Rows without a doc_id stay; rows that repeat
    doc_id and text of the kept one are reduced to one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), "text")
    signed = text.mapInArrow(_signed(shingle), f"id {kind}, own long, fp long, keys array<long>, sketch binary, n long, bins binary")
    texts = materialize(signed.groupBy("own").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in ("sketch", "n", "bins")]))
    roots = components(fingerprint_links(texts.select("fp").distinct()))
    named = texts.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first", "own")
    least = named.groupBy("root").agg(F.min(F.struct("first", "own")).alias("f")).select(F.col("f.own").alias("id"))
    kept = materialize(texts.withColumnRenamed("own", "id").join(least, "id", "left_semi").select("id", "first", "keys", "sketch", "n", "bins"))
    discard(texts)
    pairs = materialize(candidates(kept))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("own")).distinct().join(kept.select(F.col("id").alias("own"), F.col("first").alias("id")), "own")
    sets = text.join(asked, ["id", "own"], "left_semi").dropDuplicates(["own"]).select(F.col("own").alias("id"), shingles_of(F.col("text"), shingle).alias("shingles"))
    sets = materialize(sets)
    links = materialize(similar(pairs, sets, similarity))
    more = materialize(similar(remaining(kept, pairs, components(links), similarity), sets, similarity))
    roots = components(links.unionByName(more))
    discard(sets)
    one = kept.join(roots, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(F.struct("first", "id")).alias("f"))
    of_id, of_text, own = (free_name(docs.columns, c) for c in ("kept_id", "kept_text", "own_text"))
    stay = one.select(F.col("f.first").alias(of_id), F.col("f.id").alias(of_text))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    named = keyed.join(stay, (F.col("doc_id") == F.col(of_id)) & (F.col(own) == F.col(of_text)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return named.unionByName(docs.where("doc_id IS NULL"))
