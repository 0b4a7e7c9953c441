"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's ids are cut into pieces of the whole capacity, then the rest into pieces of capacity / 2, / 4, ...
down to LEAST_PIECE, and a tail. A piece of length l belongs to the reciprocal class k = capacity div l, and every
bin of a class takes exactly k pieces. Halves, quarters and so on fill their bins without padding; tails leave
less than a piece. Pieces are numbered by class within each task and offset by the tasks before it, so bins need
no coordination. What each class has left at the end, less than k pieces, is first split by powers of two
(classes without padding) or fitted together in one small task (the tails: about 4 * capacity pieces at most).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import materialize

CAPACITY = 2048
LEAST_PIECE = 32
END_ID = 1
#: Words, and parts of words, whose ids a worker remembers: the first ones seen. After REFRESH others it starts anew.
CACHE_WORDS = 500_000
REFRESH = 8_000_000

#: Letters of Latin scripts, which need no normalisation and whose lower case is one character each.
_LATIN = "a-zA-ZÀ-ÖØ-öø-įı-ɏ"
_SIMPLE = re.compile(rf"[\x21-\x7e{_LATIN}]+")
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}ɐ-ʯⱠ-Ɀ]+|[0-9]|[^0-9{_LATIN}]+")


class WordTokenizer:
    """Ids of whole texts as uint32 bytes (little-endian machines), by the word-end BPE of a tokenizers file.

    White space separates its tokens, so a text is tokenised word by word and words are remembered. Words of
    ASCII and Latin letters are split and lower-cased here and go to the file's BPE model directly, which gives
    the same ids (the tests compare); any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.visible = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.missed = 0

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
            tokens = self.model.tokenize(seen)
            found = array("I", [t.id for t in tokens]).tobytes()
            if len(self.parts) < CACHE_WORDS and len(part) <= 64:
                self.parts[part] = found
        return found

    def word(self, raw: bytes) -> bytes:
        found = self.words.get(raw)
        if found is None:
            word = raw.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(word) and "<|" not in word:
                found = b"".join([self._part(p) for p in _PRE.findall(word.lower())])
            else:
                found = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
            if len(self.words) < CACHE_WORDS:
                if len(raw) <= 64:
                    self.words[raw] = found
            else:
                self.missed += 1
                if self.missed > REFRESH:
                    self.words, self.parts, self.missed = {}, {}, 0
        return found

    def ids(self, text: bytes) -> bytes:
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in text.split()])


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST_PIECE) -> list[int]:
    """Lengths of the pieces of n tokens, in order: whole sequences, halves, quarters, ..., a tail below least."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


def _pieces(path: str, capacity: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, rank = WordTokenizer(path), {}
        part = TaskContext.get().partitionId()
        row = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lot = batch.slice(at, 256)
                texts = lot.column(1).cast(pa.binary()).to_pylist()
                which, cols = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "doc_tokens", "k", "nth")}
                end = np.array([END_ID], "<u4").tobytes()
                for i, text in enumerate(texts):
                    ids = tokenizer.ids(text or b"") + end
                    total, start = len(ids) // 4, 0
                    for n, length in enumerate(cuts(total, capacity, least)):
                        k = capacity // length
                        nth = rank[k] = rank.get(k, -1) + 1
                        which.append(i)
                        for c, x in zip(cols, (n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, k, nth)):
                            cols[c].append(x)
                        start += length
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [lot.column(0).take(pa.array(which, pa.int64())), pa.array([part] * len(which), pa.int32()), *(pa.array(cols[c], pa.int64()) for c in cols)],
                    names=["id", "part", *cols])
    return run


def _fit_tails(capacity: int):
    """First-fit of the classes' last pieces, longest first; gives bin and place."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "k", "rank"], ascending=[False, True, True])
        room, first, bins, places = [], {}, [], []
        for length in rows["length"]:
            at = first.get(length, 0)  # no bin before it has room for this length
            while at < len(room) and room[at] < length:
                at += 1
            if at == len(room):
                room.append(capacity)
            first[length] = at
            bins.append(at)
            places.append(capacity - room[at])
            room[at] -= length
        return pd.DataFrame({"k": rows["k"], "rank": rows["rank"], "bin": bins, "place": places})
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, least: int = LEAST_PIECE) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (long but for the id).

    tokenizer: path of the tokenizers file on the executors. Each document's ids end with id 1, so null and empty
    texts have one token. Sequences hold capacity tokens at most, without gaps from offset 0; they are filled up,
    end at a power of two, or are the last of the tails. Ids may repeat or be null: each row is packed on its own.
    No rows give no rows; other columns are ignored.
    """
    if capacity & (capacity - 1) or least & (least - 1):
        raise ValueError("capacity and least are powers of two")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    pieces = materialize(own.mapInArrow(
        _pieces(tokenizer, capacity, least),
        f"id {id_type}, part int, piece long, start long, length long, ids_crc32 long, doc_tokens long, k long, nth long"))
    counts = pieces.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("k").alias("of_k"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"),
                           F.sum("n").over(Window.partitionBy("k")).alias("total"))
    ranked = pieces.join(counts, (F.col("k") == F.col("of_k")) & (F.col("part") == F.col("of_part")))
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before"))
    ranked = ranked.withColumn("full", F.col("rank") < F.col("total") - F.col("total") % F.col("k"))
    exact = F.expr(f"k * length = {capacity}") & (F.col("length") >= least)

    # sequence ids: (bin, class) interleaved, so that no bin needs to know of another class
    def named(bin_, kind):
        return (bin_ * F.lit(4 * capacity) + kind).cast("long")

    halves = ranked.where(exact)
    rest = F.col("total") % F.col("k")
    left = F.col("rank") - (F.col("total") - rest)  # place among the last, less than k pieces
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1), rest.bitwiseXOR(left)).cast("double")))).cast("long")
    # the binary digits of rest, from the highest, cut the last pieces into runs of powers of two
    run_start = rest - rest % (power * 2)
    whole_bin = F.floor(F.col("rank") / F.col("k"))
    halves = halves.select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(F.col("full"), named(whole_bin, F.col("k"))).otherwise(named(power, F.lit(capacity) + F.col("k"))).alias("sequence_id"),
        (F.when(F.col("full"), F.col("rank") % F.col("k")).otherwise(left - run_start) * F.col("length")).alias("offset"))

    tails = ranked.where(~exact)
    last = tails.where("NOT full").select("k", "rank", "length")
    fitted = last.groupBy(F.lit(0).alias("one")).applyInPandas(_fit_tails(capacity), "k long, rank long, bin long, place long")
    fitted = fitted.select(F.col("k").alias("of_k"), F.col("rank").alias("of_rank"), "bin", "place")
    ended = tails.where("NOT full").drop("of_k").join(fitted, (F.col("k") == F.col("of_k")) & (F.col("rank") == F.col("of_rank")))
    cols = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    ended = ended.select(*cols, named(F.col("bin"), F.lit(3 * capacity)).alias("sequence_id"), F.col("place").alias("offset"))
    within = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    kept = tails.where("full").withColumn("sequence_id", named(whole_bin, F.col("k")))
    kept = kept.withColumn("offset", F.coalesce(within, F.lit(0))).select(*cols, "sequence_id", "offset")
    return halves.unionByName(kept).unionByName(ended).withColumn("offset", F.col("offset").cast("long")).withColumnRenamed("id", id_col)
