"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is shuffled by a hash and cut into blocks of equal word counts. Slot i of the schedule gets the
point frac((i + 1) / golden ratio), mapped through the cumulative weights of the sources' slots; the slots of a
source are ranked, and rank r takes the source's block r modulo its number of blocks. Slots are joined with
blocks by (source, block), so a hot source is spread over its blocks. Sources may be many: they are numbered, given
their targets and looked up by joins; only sums over them reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .util import discard, free_name, materialize, unit_hash, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Words of a block at most, and blocks of a source at least (while it has that many words).
BLOCK_WORDS, LEAST_BLOCKS = 2048, 256
CHUNK_ROWS, CHUNK_SLOTS, CHUNK_SOURCES = 8192, 65536, 4096
#: Sources up to which their table is broadcast; slots that a cell of the lookup by cumulative weights holds about.
FEW_SOURCES, CELL_SLOTS = 50_000, 64
GOLDEN = 0.6180339887498949
SEED = 17


def _running(df: DataFrame, by: list[str], chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """df plus out: the sum of value over the earlier rows of its group by; two levels, so that no group meets in one task."""
    sums = df.groupBy(*by, chunk).agg(F.sum(value).alias("chunk_sum"))
    before = F.sum("chunk_sum").over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(c).alias(f"of_{c}") for c in [*by, chunk]), F.coalesce(before, F.lit(0)).alias("before"))
    on = [F.col(c) == F.col(f"of_{c}") for c in [*by, chunk]]
    within = F.sum(value).over(Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(sums, on).withColumn(out, F.col("before") + F.coalesce(within, F.lit(0))).drop("before", *(f"of_{c}" for c in [*by, chunk]))


def with_targets(sources: DataFrame) -> DataFrame:
    """sources (s, size: s from 0 in their order) plus target: SHARE of all words by WEIGHTS, none above MOST times its size.

    What sources beyond MOST leave is dealt out again by weight. The share of a unit of weight only grows from one
    round to the next, so each round is one sum over the sources that this share fills.
    """
    weighted = sources.withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int")))
    whole = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight = SHARE * (whole["size"] or 0), whole["weight"] or 1

    def share() -> Column:
        return F.lit(left) * F.col("weight") / F.lit(weight)

    while True:
        full = weighted.where(share() > MOST * F.col("size")).agg(F.sum(MOST * F.col("size")).alias("size"), F.sum("weight").alias("weight")).first()
        now = SHARE * (whole["size"] or 0) - (full["size"] or 0.0), (whole["weight"] or 1) - (full["weight"] or 0)
        if now == (left, weight) or not now[1]:
            break
        left, weight = now
    return weighted.withColumn("target", F.least(share(), MOST * F.col("size")).cast("double")).drop("weight")


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source of sized (source, size): s (its place by code point, null last), source_size, target, block, blocks, slots."""
    last = F.col("source").asc_nulls_last()
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(last).withColumn("part", F.spark_partition_id()))
    counts, upto = {r["part"]: r["count"] for r in sums.groupBy("part").count().collect()}, 0  # one per partition
    first = []
    for part in range(max(counts, default=0) + 1):
        first.append(upto)
        upto += counts.get(part, 0)
    numbered = sums.withColumn("s", F.element_at(F.lit(first), F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("size") / LEAST_BLOCKS))).cast("long")
    told = with_targets(numbered.select(F.col("s").cast("long"), "source", "size")).withColumn("block", block).withColumn("blocks", F.ceil(F.col("size") / F.col("block")).cast("long"))
    laps = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    rest = F.rint((F.col("target") - laps * F.col("size")) / F.col("block"))
    slots = (laps * F.col("blocks") + F.least(F.col("blocks"), rest)).cast("long")
    plan = materialize(told.select("s", "source", F.col("size").alias("source_size"), "target", "block", "blocks", slots.alias("slots")))
    discard(sums)
    return plan


def schedule(plan: DataFrame) -> DataFrame:
    """(s, block_no, times): how often the schedule takes each block of each source."""
    spark = plan.sparkSession
    taken = plan.where("slots > 0").select("s", "slots", "blocks", F.floor(F.col("s") / CHUNK_SOURCES).alias("chunk"))
    r = taken.agg(F.sum("slots").alias("slots"), F.count("*").alias("n")).first()
    total = r["slots"] or 0
    if not total:
        return spark.createDataFrame([], "s long, block_no long, times long")
    cells = max(1, total // CELL_SLOTS)

    def cell(x: Column) -> Column:
        return F.floor(x * F.lit(float(cells)) / F.lit(float(total)))

    # the cumulative weights, by the cells they reach into: a slot meets the sources of its own cell only
    spans = _running(taken, [], "chunk", [F.col("s")], F.col("slots"), "low").withColumn("high", F.col("low") + F.col("slots"))
    spans = spans.withColumn("of_cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("s", "slots", "blocks", "low", "high", "of_cell")
    # some slots more than needed: the golden-ratio sequence gives a source its share up to a few slots
    slots = spark.range(total + total // 50 + 64 * r["n"])
    slots = slots.withColumn("x", F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)) * F.lit(float(total))).withColumn("cell", cell(F.col("x")))
    met = slots.join(spans, (F.col("cell") == F.col("of_cell")) & (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    met = met.select("id", "s", "slots", "blocks", F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"))
    ranked = _running(met, ["s"], "chunk", [F.col("id")], F.lit(1), "rank").where("rank < slots")
    return ranked.groupBy("s", F.expr("rank % blocks").alias("block_no")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, and the columns named in extra.

    size: words of the text (null and empty: 0); target: words the mix should take of the row's source, taken:
    those it takes of the row, repeats counted, never above 2 * size. A null source is a source, ordered last.
    Repeated rows are rows of their own (among equal rows, which is taken may not be told apart). An empty table,
    or one without words, gives taken 0; other columns do not matter, whatever their names. Reruns agree.
    """
    extra = extra or []
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                                    *(F.col(c).alias(f"extra_{c}") for c in extra)))
    plan = source_plan(sized)
    chunks = max(1, sized.count() // CHUNK_ROWS)
    named = plan.withColumnRenamed("source", "of")
    named = F.broadcast(named) if plan.count() <= FEW_SOURCES else named
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    place = unit_hash(F.lit(SEED), F.col("id"), F.col("size"))
    placed = placed.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") * chunks).cast("int"))
    order = [F.col("place"), F.col("id"), F.col("size"), *(F.col(f"extra_{c}") for c in extra)]
    lined = _running(placed, ["s"], "chunk", order, F.col("size"), "start")
    spans = lined.where("size > 0").withColumn("no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    cut = spans.withColumn("part", F.least(F.col("start") + F.col("size"), (F.col("no") + 1) * F.col("block")) - F.greatest("start", F.col("no") * F.col("block")))
    times = schedule(plan).withColumnRenamed("s", "of_s")
    met = cut.join(times, (F.col("s") == F.col("of_s")) & (F.col("no") == F.col("block_no")), "left")
    own = ["id", "s", "size", "source_size", "target", "start", *(f"extra_{c}" for c in extra)]
    took = met.groupBy(*own).agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = lined.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return took.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"),
                                         *(F.col(f"extra_{c}").alias(c) for c in extra))


def first_words(text: Column, n: Column) -> Column:
    """The text's beginning up to its n-th word; n at least 1."""
    return F.call_function("regexp_extract", text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+")), F.lit(0))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row per pass over a document, the last one cut after the words taken.

    Documents of which nothing is taken go; columns stay, n_chars follows the text where there is one. A document
    cut by the end of its source's share keeps its first words.
    """
    size = word_count(F.col("text"))
    key, of_id, of_key, words, taken, n = (free_name(docs.columns, c) for c in ("row_key", "mix_id", "mix_key", "mix_size", "mix_taken", "mix_words"))
    keyed = docs.withColumn(key, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("doc_id", "text", "source")]))
    told = mix(keyed, extra=[key])
    # equal rows share a key: their words taken are pooled and dealt out again, one row after the other
    pool = told.where("taken > 0").groupBy(F.col("doc_id").alias(of_id), F.col(key).alias(of_key), F.col("size").alias(words)).agg(F.sum("taken").alias(taken))
    rows = keyed.dropDuplicates(["doc_id", key]) if _repeats(told, key) else keyed
    met = rows.join(pool, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)))
    passes = F.expr(f"transform(sequence(1, cast(ceil({taken} / {words}) as int)), i -> least({words}, {taken} - (i - 1) * {words}))")
    out = met.withColumn(n, F.explode(passes))
    out = out.withColumn("text", F.when(F.col(n) < size, first_words(F.col("text"), F.col(n))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def _repeats(told: DataFrame, key: str) -> bool:
    return not told.groupBy("doc_id", key).count().where("count > 1").isEmpty()
