"""What keeps queries from growing faster than their tables."""

from pyspark.sql import functions as F

from quillet.functions import predicates as P
from quillet.operators import profile as prof
from quillet.operators.histogram import histogram
from quillet.plans import audit_queries, record_queries
from quillet.sources.written import settings

SF = "/root/testdata/sf0.001"


def test_files_are_as_many_as_their_input_has_parts(spark, tmp_path):
    """F11, F16: no task writes a fixed share of a table, and each file begins with the header."""
    with settings(spark, spark__sql__files__maxPartitionBytes="4096", spark__sql__files__openCostInBytes="1"):
        docs = audit_queries.dealt(spark.read.parquet(f"{SF}/documents.parquet"))
        assert docs.rdd.getNumPartitions() > audit_queries.PARTS
        read = audit_queries.short_orders(spark, SF, str(tmp_path))
    assert len(read["tables"]) > audit_queries.PARTS
    rows = sum(df.count() for df in read["tables"].values()) + read["rejects"].count()
    assert rows == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {d.columns[0] for d in read["tables"].values()} == {"o_orderkey"}


def test_sizes_measure_no_columns(spark):
    """rows of files are counted without a histogram of their cells."""
    tables = {"a": spark.range(3).selectExpr("cast(id as string) AS x"), "b": spark.createDataFrame([], "y string")}
    assert sorted(tuple(r) for r in prof.sizes(tables).collect()) == [("a", 3, None), ("b", 0, None)]


def test_references_count_the_tables_once(spark, monkeypatch):
    """orphans come from the histogram of the profile."""
    seen = []
    monkeypatch.setattr(record_queries, "histogram", lambda t: seen.append(sorted(t)) or histogram(t))
    record_queries.inferred_references(spark, SF).collect()
    assert len(seen) == 1


def test_cells_are_counted_before_tables_meet(spark):
    """no row is written for a union of cells."""
    tables = {"a": spark.range(9).selectExpr("cast(id % 2 as string) AS x"), "b": spark.range(4).selectExpr("cast(id as string) AS y", "'z' AS z")}
    h = histogram(tables)
    below = str(h._jdf.queryExecution().optimizedPlan()).split("Union", 1)[1]
    assert below.count("Aggregate") == 2
    assert {tuple(r) for r in h.select("table", "column", "value", "n").collect()} == {("a", "x", "0", 5), ("a", "x", "1", 4), *(("b", "y", str(i), 1) for i in range(4)), ("b", "z", "z", 4)}


def test_few_texts_reach_casts_that_fail(spark):
    """whatever the gates keep back, the casts refuse, too."""
    words = ["t", "TRUE", "Yes", "1", "f", "no", "0", "01", "tru", "10", "ſ", ""]
    texts = [a + w + b for w in words for a in ("", "\t", "\x00", "\x7f", " ") for b in ("", "\n", "\r\n", "\x1f", "\x85")]
    texts += [t + e for y in ("0000", "2024") for m in ("0", "00", "2", "02", "12", "13") for d in ("00", "1", "29", "31", "32") for s in ("-", "/", ".", "")
              for t in (f"{y}{s}{m}{s}{d}", f"{d}{s}{m}{s}{y}", f"{d} Jan {y}", f"Feb {d}, {y}", f"{m}/{d}/{y[2:]}") for e in ("", "\n", "x")]
    df = spark.createDataFrame([(t,) for t in {*texts}] + [(None,)], "v string")
    assert df.where(f"NOT ((try_cast(trim(v) AS BOOLEAN) IS NOT NULL) <=> {P.is_boolean('v')})").isEmpty()
    for i, (_, pattern, shape) in enumerate(P.DATE_FORMATS):
        plain = f"CASE WHEN {P.full_match('trim(v)', shape)} THEN try_to_timestamp(trim(v), {P.literal(pattern)}) END"
        assert df.where(f"NOT (({plain}) <=> ({P.parse_date('v', i)}))").isEmpty()
    numbers = spark.range(10_000_000, 99_999_999, 9973).select(F.col("id").cast("string").alias("v"))
    assert numbers.where(P.full_match("v", P.BOOLEAN)).isEmpty()
    assert numbers.where(P.full_match("v", P.DATE_SHAPES[7])).count() < numbers.count() / 20


def test_shapes_of_ascii_texts_are_those_of_all_texts(spark):
    df = spark.createDataFrame([(chr(i) + "a1 \tZ",) for i in range(1, 0x800)] + [(None,), ("",)], "v string")
    plain = r"regexp_replace(regexp_replace(regexp_replace(v, '\\p{Nd}', '9'), '\\p{L}', 'X'), '\\s', ' ')"
    assert df.where(f"NOT (({plain}) <=> ({P.shape('v')}))").isEmpty()
