"""Every profiler query with its DuckDB counterpart.

The test tables hold no nulls, so queries about missing values derive them alike on both sides.
Floats are rounded alike; every tie has an order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bytes_per_row, counted, number, safe
from ..operators import correlations, extremes, frequency, histogram, interactions, logical_types, missing, passes, rows
from ..operators.metrics import registry, sample_kurtosis
from ..operators.quantiles import by_narrowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
DERIVED_EVENTS = "SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN value > 50 THEN NULL WHEN value < 1 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS note FROM events"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls, NaN and empty strings, by the same rule as ``DERIVED_EVENTS``."""
    e, v, kind, user = table(spark, sf_dir, "events"), F.col("value"), F.col("event_type"), F.col("user_id")
    value = F.when(v > 50, None).when(v < 1, F.lit(float("nan"))).otherwise(v)
    note = F.when(user % 7 == 0, "").when(user % 5 == 0, None).otherwise(kind)
    return e.select("event_id", "ts", "user_id", F.nullif(kind, F.lit("error")).alias("event_type"), value.alias("value"), note.alias("note"))


def each(columns, select: str, source: str) -> str:
    """UNION ALL of ``select`` over columns; ``{c}`` is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.format(c=c)} FROM {source}" for c in columns)


def rounded(build, digits: int = 6):
    return lambda c, k: F.round(build(c, k).cast("double"), digits)


def profiled(df: DataFrame, **options):
    """A finished report."""
    from ..profiler import profile

    return profile(df, **options).finalize()


def significant(x: float | int | None) -> tuple[float, int]:
    """Seven digits and a power of ten, as numbers of all sizes are compared alike."""
    if not x:
        return 0.0, 0
    power = math.floor(math.log10(abs(x)))
    return round(x / 10.0**power, 6), power


def of(name: str, digits: int | None = None, cast: str | None = None):
    """A registered metric as a part of ``long_form``."""
    m = registry[name]

    def build(c, k):
        e = m.build(c, k)
        e = e.cast(cast) if cast else e
        return F.round(e.cast("double"), digits) if digits is not None else e

    return build


# --- first pass ---

@query(each(LINEITEM, "count(*) AS n, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zeros, sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END)::BIGINT AS n_negative", "lineitem"))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the scalar metrics of every numeric column in one aggregation."""
    return passes.long_form(table(spark, sf_dir, "lineitem"), LINEITEM, {"n": lambda c, k: F.count(F.lit(1)), "n_missing": of("missing"), "mean": of("mean", 6), "std": of("std", 6), "min": of("min", cast="double"), "max": of("max", cast="double"), "n_zeros": of("zeros"), "n_negative": of("n_negative")})


@query(each(LINEITEM, "round(sum({c})::DOUBLE, 2) AS total, round(var_samp({c}::DOUBLE) / 1000, 4) AS variance_k", "lineitem"))
def sums_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.long_form(table(spark, sf_dir, "lineitem"), LINEITEM, {"total": of("sum", 2), "variance_k": lambda c, k: F.round(F.var_samp(number(c, k)) / 1000, 4)})


QUANTILE_SQL = ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {q}), 6) AS q{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


def quantile_rows(df: DataFrame, columns) -> DataFrame:
    """All five quantiles of a column are one aggregate over its value counts."""
    names, shares = F.array(*[F.lit(c) for c in columns]), [0.05, 0.25, 0.5, 0.75, 0.95]
    out = None
    for f in frequency.frequencies(df, list(columns)):
        part = f.where("v is not null").groupBy("k").agg(F.percentile(F.col("v").cast("double"), F.lit(shares), F.col("n")).alias("q"))
        out = part if out is None else out.unionByName(part)
    return out.select(F.element_at(names, F.col("k") + 1).alias("column_name"), *[F.round(F.col("q")[i], 6).alias(f"q{round(q * 100)}") for i, q in enumerate(shares)])


@query(each(LINEITEM, QUANTILE_SQL, "lineitem"))
def quantiles_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_rows(table(spark, sf_dir, "lineitem"), LINEITEM)


@query(each(("p_size", "p_retailprice"), QUANTILE_SQL, "part"))
def quantiles_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_rows(table(spark, sf_dir, "part"), ("p_size", "p_retailprice"))


@query(each(("l_extendedprice", "l_orderkey", "l_discount"), QUANTILE_SQL, "lineitem"))
def quantiles_by_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for tables too large for the percentile aggregate: the same values from narrowing counts."""
    found = by_narrowing(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_orderkey", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95])
    names = ["q5", "q25", "q50", "q75", "q95"]
    out = spark.createDataFrame([(c, *v) for c, v in found.items()], "column_name string, " + ", ".join(f"{n} double" for n in names))
    return out.select("column_name", *[F.round(n, 6).alias(n) for n in names])


@query("SELECT round(kurtosis(o_totalprice), 6) AS kurtosis_sample FROM orders")
def kurtosis_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.round(sample_kurtosis(F.col("o_totalprice")), 6).alias("kurtosis_sample"))


@query("SELECT round(kurtosis_pop(o_totalprice), 6) AS kurtosis_pop FROM orders")
def kurtosis_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.round(F.kurtosis("o_totalprice"), 6).alias("kurtosis_pop"))


@query(f"WITH e AS ({DERIVED_EVENTS}), s AS (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS x FROM e) SELECT count(*) - count(x) AS n_missing, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, count(DISTINCT x) AS n_distinct, sum(CASE WHEN isinf(1e308 * 10 * (value - 2)) THEN 1 ELSE 0 END)::BIGINT AS n_infinite FROM s")
def nan_and_infinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived_events(spark, sf_dir)
    c, k = F.col("value"), T.DoubleType()
    far = F.lit(1e308) * 10 * (c - 2)
    return e.agg(registry["missing"].build(c, k).alias("n_missing"), F.round(registry["mean"].build(c, k), 6).alias("mean"), registry["min"].build(c, k).alias("min"), registry["max"].build(c, k).alias("max"), registry["n_distinct"].build(c, k).alias("n_distinct"), registry["infinite"].build(far, k).alias("n_infinite"))


TEXTS = ("text", "lang", "source")


@query(each(TEXTS, "round(avg(length({c})), 6) AS mean_length, min(length({c}))::BIGINT AS min_length, max(length({c}))::BIGINT AS max_length, sum(CASE WHEN {c} = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty", "documents"))
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.long_form(table(spark, sf_dir, "documents"), TEXTS, {"mean_length": of("mean_length", 6), "min_length": of("min_length", cast="long"), "max_length": of("max_length", cast="long"), "n_empty": of("n_empty")})


@query(f"WITH e AS ({DERIVED_EVENTS}) SELECT sum(CASE WHEN note = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty, sum(CASE WHEN note IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing, round(avg(length(note)), 6) AS mean_length FROM e")
def empty_and_missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("note"), T.StringType()
    return derived_events(spark, sf_dir).agg(registry["n_empty"].build(c, k).alias("n_empty"), registry["missing"].build(c, k).alias("n_missing"), F.round(registry["mean_length"].build(c, k), 6).alias("mean_length"))


@query("SELECT min(o_orderdate)::VARCHAR AS first_date, max(o_orderdate)::VARCHAR AS last_date FROM orders")
def temporal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = o.schema["o_orderdate"].dataType
    return o.agg(*[registry[m].build(F.col("o_orderdate"), k).cast("string").alias(a) for m, a in (("min", "first_date"), ("max", "last_date"))])


# --- second pass ---

@query("WITH m AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders) SELECT round(avg(power((o_totalprice - mu) / sd, 3)), 6) AS skewness FROM orders, m")
def skewness_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    moments = {"o_totalprice": o.agg(F.avg("o_totalprice"), F.stddev_samp("o_totalprice")).first()}
    found = passes.second_pass(o, moments)
    return spark.createDataFrame([(round(found["o_totalprice", "skewness"], 6),)], "skewness double")


@query("WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders) SELECT round(avg(abs(o_totalprice - mu)), 4) AS mad FROM orders, m")
def mean_absolute_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    found = passes.second_pass(o, {"o_totalprice": (o.agg(F.avg("o_totalprice")).first()[0], None)})
    return spark.createDataFrame([(round(found["o_totalprice", "mad"], 4),)], "mad double")


# --- frequencies ---

EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")
CUSTOMERS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def distinct_sql(columns, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM {source}) AS n_distinct, (SELECT count(*) FROM (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS n_unique" for c in columns)


@query(distinct_sql(EVENTS, "events"))
def n_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.long_distinct(table(spark, sf_dir, "events"), list(EVENTS))


@query(distinct_sql(CUSTOMERS, "customer"))
def n_distinct_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.long_distinct(table(spark, sf_dir, "customer"), list(CUSTOMERS))


@query(distinct_sql((*LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"), "lineitem"))
def n_distinct_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.long_distinct(table(spark, sf_dir, "lineitem"), [*LINEITEM, "l_returnflag", "l_linestatus", "l_shipdate"])


@query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: the counts are approximate by design, so only rows can be compared."""
    return passes.long_form(table(spark, sf_dir, "lineitem"), LINEITEM, {"n_distinct": lambda c, k: F.approx_count_distinct(safe(c, k), 0.02)})


@query(f"WITH e AS ({DERIVED_EVENTS}), g AS (SELECT note AS v, count(*) AS n FROM e GROUP BY note), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v NULLS LAST) AS place FROM g) SELECT 'note' AS column_name, CASE WHEN v IS NULL THEN 'None' WHEN v = '' THEN '(Empty)' ELSE v END AS label, n, place::INT AS place FROM r WHERE place <= 20")
def top_values_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.long_top(derived_events(spark, sf_dir), ["note"])


def top_sql(columns, source: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {c}::VARCHAR AS label, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, {c}))::INT AS place FROM {source} GROUP BY {c}) WHERE place <= 20" for c in columns)


@query(top_sql(("p_brand", "p_type", "p_size"), "part"))
def top_values_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.long_top(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


def extreme_sql(column: str, source: str, distinct: bool) -> str:
    d = "DISTINCT" if distinct else ""
    side = "SELECT '{s}' AS side, (row_number() OVER (ORDER BY v {o}))::INT AS place, v FROM (SELECT {d} {c} AS v FROM {t} WHERE {c} IS NOT NULL)"
    parts = [f"SELECT * FROM ({side.format(s=s, o=o, d=d, c=column, t=source)}) WHERE place <= 5" for s, o in (("smallest", "ASC"), ("largest", "DESC"))]
    return " UNION ALL ".join(parts)


def _extremes(spark: SparkSession, sf_dir: str, name: str, column: str, distinct: bool) -> DataFrame:
    return extremes.extremes(table(spark, sf_dir, name), {column: distinct}).select("side", "place", "v")


@query(extreme_sql("l_extendedprice", "lineitem", False))
def extremes_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(spark, sf_dir, "lineitem", "l_extendedprice", False)


@query(extreme_sql("l_quantity", "lineitem", True))
def extremes_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(spark, sf_dir, "lineitem", "l_quantity", True)


@query(extreme_sql("p_name", "part", False))
def extremes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(spark, sf_dir, "part", "p_name", False)


@query("WITH g AS (SELECT length(text) AS length, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT length, n, row_number() OVER (ORDER BY n DESC, length) AS place FROM g) SELECT length::INT AS length, n, place::INT AS place FROM r WHERE place <= 10")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.lengths(table(spark, sf_dir, "conversations"), ["text"]).select("length", "n", "place")


# --- histograms ---

def histogram_sql(columns, source: str, value: str = "{c}::DOUBLE") -> str:
    part = "SELECT '{c}' AS column_name, b.bin::INT AS bin, coalesce(h.n, 0)::BIGINT AS n FROM range(20) b(bin) LEFT JOIN (SELECT least(greatest(floor((x - lo) / (hi - lo) * 20), 0), 19) AS bin, count(*) AS n FROM (SELECT {v} AS x FROM {t}) d, (SELECT min({v}) AS lo, max({v}) AS hi FROM {t}) m WHERE x IS NOT NULL GROUP BY 1) h ON h.bin = b.bin"
    return " UNION ALL ".join(part.format(c=c, t=source, v=value.format(c=c)) for c in columns)


@query(histogram_sql(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"), "lineitem"))
def numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.long_histogram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"])


@query(histogram_sql(("o_orderdate",), "orders", "floor(epoch({c}))::DOUBLE"))
def datetime_histogram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.long_histogram(table(spark, sf_dir, "orders"), ["o_orderdate"])


@query(histogram_sql(("ts",), "events", "floor(epoch({c}))::DOUBLE"))
def datetime_histogram_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.long_histogram(table(spark, sf_dir, "events"), ["ts"])


@query("SELECT min(x)::VARCHAR AS label, count(x) AS n FROM (SELECT CASE WHEN l_linenumber > 0 THEN 7 END AS x FROM lineitem)")
def constant_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 0, 7).alias("x"))
    shape = histogram.shaped({}, *x.agg(F.min("x"), F.max("x"), F.count("x")).first())
    return spark.createDataFrame([(shape["bins"][0], shape["counts"][0])], "label string, n long")


# --- rows ---

@query("SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n_distinct_rows FROM events")
def duplicate_rows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distinct_rows(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query("SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM conversations)) AS n_distinct_rows FROM conversations")
def duplicate_rows_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distinct_rows(table(spark, sf_dir, "conversations"))


@query("WITH l AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER w AS pa, -o_orderkey AS b, lag(-o_orderkey) OVER w AS pb, o_totalprice AS c, lag(o_totalprice) OVER w AS pc FROM orders WINDOW w AS (ORDER BY o_orderkey)) SELECT bool_and(a >= pa OR pa IS NULL) AS inc0, bool_and(a <= pa OR pa IS NULL) AS dec0, bool_and(b >= pb OR pb IS NULL) AS inc1, bool_and(b <= pb OR pb IS NULL) AS dec1, bool_and(c >= pc OR pc IS NULL) AS inc2, bool_and(c <= pc OR pc IS NULL) AS dec2 FROM l")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("a"), (-F.col("o_orderkey")).alias("b"), F.col("o_totalprice").alias("c"))
    return rows.monotonic(o, ["a", "b", "c"], "o_orderkey")


# --- correlations and missing values ---

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def pairs_sql(columns, source: str, x: str = "{c}") -> str:
    e = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(covar_pop({x.format(c=a)}, {x.format(c=b)}) / nullif(stddev_pop({x.format(c=a)}) * stddev_pop({x.format(c=b)}), 0), 6) AS r FROM {source}" for a, b in e)


def _rounded(m: DataFrame) -> DataFrame:
    return m.select("column_a", "column_b", F.round("r", 6).alias("r"))


@query(pairs_sql(NUMBERS, "lineitem"))
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlations.long_matrix(correlations.values(table(spark, sf_dir, "lineitem"), list(NUMBERS)), list(NUMBERS)))


WITH_NULLS = "(SELECT CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_extendedprice END AS b, l_discount AS c FROM lineitem)"


@query(pairs_sql(("a", "b", "c"), WITH_NULLS))
def pearson_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.when(~(F.col("l_quantity") > 45), F.col("l_quantity")).alias("a"), F.when(~(F.col("l_tax") < 0.02), F.col("l_extendedprice")).alias("b"), F.col("l_discount").alias("c"))
    return _rounded(correlations.long_matrix(correlations.values(x, ["a", "b", "c"]), ["a", "b", "c"]))


@query(pairs_sql(("p_size", "p_retailprice", "p_partkey"), "(SELECT rank() OVER (ORDER BY p_size NULLS LAST)::DOUBLE AS p_size, rank() OVER (ORDER BY p_retailprice NULLS LAST)::DOUBLE AS p_retailprice, rank() OVER (ORDER BY p_partkey NULLS LAST)::DOUBLE AS p_partkey FROM part)"))
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["p_size", "p_retailprice", "p_partkey"]
    return _rounded(correlations.long_matrix(correlations.ranks(table(spark, sf_dir, "part"), names), names))


@query("SELECT v, min(r)::BIGINT AS rank, count(*) AS n FROM (SELECT p_size::DOUBLE AS v, rank() OVER (ORDER BY p_size) AS r FROM part) GROUP BY v")
def distributed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations.spread_ranks(correlations.values(table(spark, sf_dir, "part"), ["p_size"]), 1).select("v", F.col("rank").cast("long").alias("rank"), "n")


MISSING = ("event_type", "value", "note")


@query(f"WITH e AS ({DERIVED_EVENTS}) " + each(MISSING, "sum(CASE WHEN {c} IS NULL OR {c}::VARCHAR = 'nan' THEN 1 ELSE 0 END)::BIGINT AS n_missing", "e"))
def nullity_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.long_form(derived_events(spark, sf_dir), MISSING, {"n_missing": of("missing")})


@query(f"WITH e AS ({DERIVED_EVENTS}), m AS (SELECT (event_type IS NULL)::INT::DOUBLE AS event_type, (value IS NULL OR isnan(value))::INT::DOUBLE AS value, (note IS NULL)::INT::DOUBLE AS note FROM e) " + pairs_sql(MISSING, "m"))
def nullity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlations.long_matrix(correlations.masks(derived_events(spark, sf_dir), list(MISSING)), list(MISSING)))


@query(f"WITH e AS ({DERIVED_EVENTS}) SELECT event_type IS NULL AS c0, value IS NULL OR isnan(value) AS c1, note IS NULL AS c2 FROM e WHERE event_id < 250")
def nullity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 250 rows in a stated order, as a table has none of its own."""
    return missing.pattern(derived_events(spark, sf_dir).where("event_id < 250"), list(MISSING))


@query("SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def interactions_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of one pair; the report takes about a thousand of them."""
    p = table(spark, sf_dir, "part")
    return interactions.sampled(p, ["p_size", "p_retailprice"], p.count(), 42, points=p.count()).select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


# --- types ---

def java_sql(pattern: str) -> str:
    """DuckDB's engine takes ``$`` as the very end already; quotes are doubled."""
    return pattern.replace("'", "''")


def logical_sql(column: str, source: str) -> str:
    """CASE in order of priority for a text column."""
    whens = []
    for t in logical_types.types:
        if t.name in logical_types.PATTERNS:
            test = f"regexp_matches({column}, '{java_sql(logical_types.PATTERNS[t.name])}', 's')"
        elif t.name in logical_types.VOCABULARIES:
            test = f"lower({column}) IN ({', '.join(repr(v.lower()) for v in logical_types.VOCABULARIES[t.name])})"
        elif t.name == "Ordinal":  # any one of the vocabularies
            groups = [f"coalesce(bool_and(lower({column}) IN ({', '.join(map(repr, g))}) OR {column} IS NULL), false)" for g in logical_types.ORDERS]
            whens.append(f"WHEN coalesce(bool_or({column} IS NOT NULL), false) AND ({' OR '.join(groups)}) THEN '{t.label}'")
            continue
        elif t.name == "Categorical":
            n, total = f"count(DISTINCT {column})", "count(*)"
            whens.append(f"WHEN {total} > 0 AND ({n} < 20 OR {n} / {total} < 0.05) AND {n} < CASE WHEN {total} < 50 THEN {total} * 0.5 ELSE {total} * 0.8 END THEN '{t.label}'")
            continue
        elif t.name == "String":
            whens.append(f"WHEN true THEN '{t.label}'")
            continue
        else:
            continue
        whens.append(f"WHEN coalesce(bool_or({column} IS NOT NULL), false) AND coalesce(bool_and({test} OR {column} IS NULL), false) THEN '{t.label}'")
    return f"SELECT '{column}' AS column_name, CASE {' '.join(whens)} END AS logical_type FROM {source}"


def _logical(name: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logical_types.long_verdicts(table(spark, sf_dir, name), columns)

    run.__name__ = f"logical_types_{name}"
    run.__doc__ = f"The semantic types of {name}'s text columns, from all rows."
    return run


for _name, _columns in (("customer", ["c_name", "c_mktsegment"]), ("events", ["event_type", "props"]), ("documents", ["lang", "source"]), ("pages", ["url"]), ("orders", ["o_orderstatus", "o_orderpriority"]), ("lineitem", ["l_returnflag", "l_linestatus"]), ("part", ["p_name", "p_brand", "p_type"])):
    query(" UNION ALL ".join(logical_sql(c, _name) for c in _columns))(_logical(_name, _columns))

def _inferred(name: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name).select(*columns)
        found = logical_types.infer(df, sample=df.count())
        return spark.createDataFrame([(c, found[c].label) for c in columns], "column_name string, logical_type string")

    run.__name__ = f"logical_types_of_head_{name}"
    run.__doc__ = f"The types that a profile infers for {name}'s text columns from a bounded head, here all rows."
    return run


for _name, _columns in (("customer", ["c_name", "c_mktsegment"]), ("events", ["event_type", "props"]), ("pages", ["url"]), ("part", ["p_name", "p_brand", "p_type"])):
    query(" UNION ALL ".join(logical_sql(c, _name) for c in _columns))(_inferred(_name, _columns))

#: One matching and one other value for each type; each pair is a small table of its own.
SAMPLES = {
    "CreditCard": ("4111 1111 1111 1111", "1234567890"), "SSN": ("123-45-6789", "000-45-6789"), "Email": ("a@b.com", "invalid-email"), "IBAN": ("GB29NWBK60161331926819", "GB29NWBK"),
    "SWIFT": ("NWBKGB2L", "ABCD"), "TaxID": ("12-3456789", "12-345678"), "ISIN": ("US0378331005", "ABCDEFGHIJKL"), "JSON": ('{"a": 1}', '{"missing": 1'), "URL": ("http://domain.co.uk/path?q=1", "not a url"),
    "IPAddress": ("192.168.1.1", "not an ip"), "DateTime": ("2023-01-01T12:00:00Z", "yesterday"), "USZipCode": ("90210-1234", "12345-678"), "PhoneNumber": ("+1-541-754-3010", "not a phone"), "MACAddress": ("00:1A:2B:3C:4D:5E", "00:1A:2B:3C:4D"),
    "USState": ("CA", "California"), "USTerritory": ("PR", "Puerto Rico"), "USMilitaryMail": ("AA", "APO box"), "CountryCode": ("USA", "united states"), "FilePath": ("/var/log/syslog", "var/log"), "Complex": ("1+2j", "1+2i"),
    "Geometry": ("POINT (30 10)", "CIRCLE (10 10, 5)"), "Currency": ("$100.00", "US$100"), "Boolean": ("yes", "perhaps"), "Ordinal": ("Medium", "huge"), "Count": ("17", "1.5"), "UUID": ("123e4567-e89b-12d3-a456-426614174000", "123e4567"),
    "CUID": ("cjld2cyuq0000t3pz76272639", "not-a-cuid"), "NanoID": ("V1StGXR8_Z5jdHi6B-myT", "contains!invalid@char"), "Passport": ("ZE123456", "not-a-passport"), "LanguageCode": ("en", "english"), "Gender": ("Non-binary", "just a string"),
    "Integer": ("-3", "2.5"), "Decimal": ("1e-5", "not a number"), "StockTicker": ("APPL", "aapl"), "String": ("free text, of any kind", ""),
}


def _sample_rows(spark: SparkSession) -> DataFrame:
    rows_ = [(t, good, bad) for t, (good, bad) in SAMPLES.items()]
    return spark.createDataFrame(rows_, "type_name string, good string, bad string")


def _matches(column: str) -> list[tuple[str, str]]:
    """(type, DuckDB test) for each pattern and vocabulary."""
    out = [(n, f"regexp_matches({column}, '{java_sql(p)}', 's')") for n, p in logical_types.PATTERNS.items()]
    return out + [(n, f"lower({column}) IN ({', '.join(repr(v.lower()) for v in vs)})") for n, vs in logical_types.VOCABULARIES.items()]


def _sample_sql() -> str:
    values = ", ".join(f"('{t}', '{g}', '{b}')" for t, (g, b) in SAMPLES.items())
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, type_name, {test} AS good_matches, {test.replace('(good', '(bad')} AS bad_matches FROM (VALUES {values}) s(type_name, good, bad)" for n, test in _matches("good"))


@query(_sample_sql())
def logical_rules_on_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern and vocabulary on every sample value."""
    s, parts = _sample_rows(spark), []
    for name, pattern in logical_types.PATTERNS.items():
        parts.append(F.struct(F.lit(name).alias("rule"), *[F.col(c).rlike(logical_types.java(pattern)).alias(f"{c}_matches") for c in ("good", "bad")]))
    for name, values in logical_types.VOCABULARIES.items():
        parts.append(F.struct(F.lit(name).alias("rule"), *[F.lower(c).isin([v.lower() for v in values]).alias(f"{c}_matches") for c in ("good", "bad")]))
    return s.select("type_name", F.inline(F.array(*parts)))


#: The label of a column that holds only the sample value, three times, where it isn't the type's name: written out, not derived
#: from the rules. One value of three rows is categorical, which comes before tickers and free text.
EXPECTED = {
    "CreditCard": "Credit Card", "SWIFT": "SWIFT/BIC", "TaxID": "Tax ID (EIN)", "IPAddress": "IP Address", "DateTime": "Date Time", "USZipCode": "US Zip Code", "PhoneNumber": "Phone Number", "MACAddress": "MAC Address",
    "USState": "US State", "USTerritory": "US Territory", "USMilitaryMail": "US Military Mail", "CountryCode": "Country Code", "FilePath": "File Path", "LanguageCode": "Language Code", "StockTicker": "Categorical", "String": "Categorical",
}


def _one_type(name: str):
    good, bad = SAMPLES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.createDataFrame([(good,)] * 3, "v string")
        return logical_types.long_verdicts(own, ["v"])

    run.__name__ = f"logical_type_{name.lower()}"
    run.__doc__ = f"The type inferred for a column that only holds {good!r}."
    return run


for _name in SAMPLES:
    query(f"SELECT 'v' AS column_name, '{EXPECTED.get(_name, _name)}' AS logical_type")(_one_type(_name))


@query("SELECT 'p_size' AS column_name, CASE WHEN bool_and(p_size IN (0, 1)) THEN 'Boolean' WHEN bool_and(p_size BETWEEN 0 AND 120) AND avg((p_size > 14)::INT) > 0.5 THEN 'Age' WHEN bool_and(p_size >= 0) THEN 'Count' ELSE 'Integer' END AS logical_type FROM part UNION ALL SELECT 'p_partkey', CASE WHEN bool_and(p_partkey IN (0, 1)) THEN 'Boolean' WHEN bool_and(p_partkey BETWEEN 0 AND 120) AND avg((p_partkey > 14)::INT) > 0.5 THEN 'Age' WHEN bool_and(p_partkey >= 0) THEN 'Count' ELSE 'Integer' END FROM part UNION ALL SELECT 'p_retailprice', 'Decimal'")
def logical_types_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical_types.long_verdicts(table(spark, sf_dir, "part"), ["p_size", "p_partkey", "p_retailprice"])


@query("SELECT 'l_linenumber' AS column_name, CASE WHEN count(DISTINCT l_linenumber) BETWEEN 1 AND 19 THEN 'Categorical' ELSE 'Numeric' END AS report_type FROM lineitem UNION ALL SELECT 'l_quantity', 'Numeric' UNION ALL SELECT 'l_orderkey', CASE WHEN count(DISTINCT l_orderkey) BETWEEN 1 AND 19 THEN 'Categorical' ELSE 'Numeric' END FROM lineitem UNION ALL SELECT 'l_shipdate', 'DateTime' UNION ALL SELECT 'l_returnflag', 'Categorical'")
def report_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report types of a profile, after reclassification of whole numbers with few values."""
    df = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", "l_shipdate", "l_returnflag")
    found = profiled(df, minimal=True).variables
    return spark.createDataFrame([(c, v["type"]) for c, v in found.items()], "column_name string, report_type string")


# --- derived ---

@query("SELECT count(*) AS n, count(*) * (8 * 8 + 2 * 20 + 16) AS memory_size, (8 * 8 + 2 * 20 + 16)::DOUBLE AS record_size FROM lineitem")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    size = sum(bytes_per_row(f.dataType) for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * size).alias("memory_size"), F.lit(float(size)).alias("record_size"))


@query(f"WITH e AS ({DERIVED_EVENTS}), x AS (SELECT CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM e) SELECT round(1 - count(v) / count(*), 6) AS p_missing, round(count(DISTINCT v) / count(*), 6) AS p_distinct, round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(stddev_samp(v) / avg(v), 6) AS cv FROM x")
def derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profiled(derived_events(spark, sf_dir).select("value"), minimal=True).variables["value"]
    return spark.createDataFrame([tuple(round(v[c], 6) for c in ("p_missing", "p_distinct", "range", "iqr", "cv"))], "p_missing double, p_distinct double, range double, iqr double, cv double")


@query(f"WITH e AS ({DERIVED_EVENTS}) SELECT sum((event_type IS NULL)::INT + (value IS NULL OR isnan(value))::INT + (note IS NULL)::INT)::BIGINT AS n_cells_missing, round(sum((event_type IS NULL)::INT + (value IS NULL OR isnan(value))::INT + (note IS NULL)::INT) / (count(*) * 6), 6) AS p_cells_missing, sum(CASE WHEN note = '' THEN 1 ELSE 0 END + CASE WHEN event_type = '' THEN 1 ELSE 0 END)::BIGINT AS n_cells_empty FROM e")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = profiled(derived_events(spark, sf_dir), minimal=True).table
    return spark.createDataFrame([(t["n_cells_missing"], round(t["p_cells_missing"], 6), t["n_cells_empty"])], "n_cells_missing long, p_cells_missing double, n_cells_empty long")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 10")
def head_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a profile; the table is sorted, as it has no order of its own."""
    head = profiled(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), minimal=True).sample["head"]
    return spark.createDataFrame(list(zip(head["r_regionkey"], head["r_name"], strict=True)), "r_regionkey long, r_name string")


@query("WITH s AS (SELECT 'user_id' AS column_name, count(DISTINCT user_id) AS d, 0.0 AS p_missing, 'Numeric' AS kind FROM events UNION ALL SELECT 'event_type', count(DISTINCT nullif(event_type, 'error')), avg((event_type = 'error')::INT), 'Categorical' FROM events UNION ALL SELECT 'props', count(DISTINCT props), 0.0, 'Categorical' FROM events UNION ALL SELECT 'one', 1, 0.0, 'Categorical'), a AS (SELECT column_name, CASE WHEN d = 1 THEN 'CONSTANT' WHEN d = (SELECT count(*) FROM events) AND (kind = 'Categorical' OR d < 1000000) THEN 'UNIQUE' WHEN kind = 'Categorical' AND d / (SELECT count(*) FROM events) > 0.5 THEN 'HIGH_CARDINALITY' END AS alert_type FROM s UNION ALL SELECT column_name, CASE WHEN p_missing > 0.05 THEN 'MISSING' END FROM s) SELECT column_name, alert_type FROM a WHERE alert_type IS NOT NULL")
def alerts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a full profile, one row for each column and kind."""
    from ..profiler import profile

    e = table(spark, sf_dir, "events").select("user_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "props", F.lit("x").alias("one"))
    report = profile(e, minimal=True).finalize()
    found = [(c, a["alert_type"]) for a in report.alerts for c in a["fields"]]
    return spark.createDataFrame(found, "column_name string, alert_type string")


@query("SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM part UNION ALL SELECT 'n_var', 6 UNION ALL SELECT 'p_size_mean', round(avg(p_size), 4) FROM part UNION ALL SELECT 'p_retailprice_median', round(quantile_cont(p_retailprice, 0.5), 4) FROM part UNION ALL SELECT 'p_brand_distinct', count(DISTINCT p_brand)::DOUBLE FROM part UNION ALL SELECT 'n_duplicates', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)))::DOUBLE FROM part")
def full_profile_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete profile, reduced to a few of its values."""
    from ..profiler import profile

    d = profile(table(spark, sf_dir, "part")).to_dict()
    v, t = d["variables"], d["table"]
    found = [("n", t["n"]), ("n_var", t["n_var"]), ("p_size_mean", round(v["p_size"]["mean"], 4)), ("p_retailprice_median", round(v["p_retailprice"]["50%"], 4)), ("p_brand_distinct", v["p_brand"]["n_distinct"]), ("n_duplicates", t["n_duplicates"])]
    return spark.createDataFrame([(k, float(x)) for k, x in found], "metric string, value double")


# --- whole profiles, value by value ---

#: Report keys with their SQL over x (a number without nulls), n rows, and the means and deviations of ``m``.
STATISTICS = {
    "mean": "avg(x)", "std": "stddev_samp(x)", "variance": "var_samp(x)", "min": "min(x)", "max": "max(x)", "sum": "sum(x)", "5%": "quantile_cont(x, 0.05)", "25%": "quantile_cont(x, 0.25)", "50%": "quantile_cont(x, 0.5)", "75%": "quantile_cont(x, 0.75)", "95%": "quantile_cont(x, 0.95)",
    "kurtosis": "kurtosis(x)", "skewness": "avg(power((x - mu) / sd, 3))", "mad": "avg(abs(x - mu))", "n_zeros": "count(*) FILTER (WHERE x = 0)", "n_negative": "count(*) FILTER (WHERE x < 0)", "n_missing": "count(*) - count(x)", "n_distinct": "count(DISTINCT x)", "range": "max(x) - min(x)", "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "cv": "stddev_samp(x) / avg(x)", "p_zeros": "count(*) FILTER (WHERE x = 0) / count(*)", "p_distinct": "count(DISTINCT x) / count(*)", "p_missing": "1 - count(x) / count(*)",
}


def statistics_sql(columns, source: str) -> str:
    """(column_name, metric, digits, power) of every statistic."""
    picked = ", ".join(f"({e})::DOUBLE AS \"{k}\"" for k, e in STATISTICS.items())
    rows_ = " UNION ALL ".join(f"SELECT * FROM (UNPIVOT (SELECT '{c}' AS column_name, {picked} FROM (SELECT {c}::DOUBLE AS x, avg({c}::DOUBLE) OVER () AS mu, stddev_samp({c}::DOUBLE) OVER () AS sd FROM {source})) ON COLUMNS(* EXCLUDE column_name) INTO NAME metric VALUE value)" for c in columns)
    return f"SELECT column_name, metric, CASE WHEN value = 0 THEN 0 ELSE round(value / pow(10, floor(log10(abs(value)))), 6) END AS digits, CASE WHEN value = 0 THEN 0 ELSE floor(log10(abs(value)))::BIGINT END AS power FROM ({rows_})"


def statistics(spark: SparkSession, df: DataFrame, columns) -> DataFrame:
    v = profiled(df, cardinality_threshold=0, correlations=False, compute_duplicates=False).variables
    found = [(c, k, *significant(float(v[c][k]))) for c in columns for k in STATISTICS]
    return spark.createDataFrame(found, "column_name string, metric string, digits double, power long")


@query(statistics_sql(LINEITEM, "lineitem"))
def profile_statistics_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statistic of every numeric column, as a full profile reports it."""
    return statistics(spark, table(spark, sf_dir, "lineitem"), LINEITEM)


@query(f"WITH e AS ({DERIVED_EVENTS}), d AS (SELECT user_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM e) " + statistics_sql(("user_id", "value"), "d"))
def profile_statistics_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark, derived_events(spark, sf_dir).select("user_id", "value"), ("user_id", "value"))


@query(f"WITH e AS ({DERIVED_EVENTS}) " + statistics_sql(("price",), "(SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)"))
def profile_statistics_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, which are read from the table rather than from value counts."""
    return statistics(spark, table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("price")), ("price",))


@query(histogram_sql(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey"), "lineitem"))
def profile_histograms_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey"]
    v = profiled(table(spark, sf_dir, "lineitem").select(*names), minimal=True, cardinality_threshold=0).variables
    return spark.createDataFrame([(c, i, n) for c in names for i, n in enumerate(v[c]["histogram"]["counts"])], "column_name string, bin int, n long")


@query(histogram_sql(("ts",), "events", "floor(epoch({c}))::DOUBLE"))
def profile_time_histogram_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profiled(table(spark, sf_dir, "events").select("ts"), minimal=True).variables
    return spark.createDataFrame([("ts", i, n) for i, n in enumerate(v["ts"]["time_histogram"]["counts"])], "column_name string, bin int, n long")


def either_sql(c: str, source: str) -> str:
    """Extremes of a column, each value once if at most half of the values are distinct."""
    share = f"(SELECT count(DISTINCT {c}) / count(*) FROM {source})"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, side, place, v::VARCHAR AS v FROM ({extreme_sql(c, source, d)}) WHERE {share} {test} 0.5" for d, test in ((True, "<="), (False, ">")))


@query(" UNION ALL ".join(either_sql(c, "part") for c in ("p_partkey", "p_size", "p_brand", "p_name")))
def profile_extremes_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats show only in columns most of whose values are distinct."""
    names = ["p_partkey", "p_size", "p_brand", "p_name"]
    v = profiled(table(spark, sf_dir, "part").select(*names), minimal=True).variables
    found = [(c, s, i + 1, str(x)) for c in names for s in ("smallest", "largest") for i, x in enumerate(v[c][f"extreme_values_{s}"])]
    return spark.createDataFrame(found, "column_name string, side string, place int, v string")


@query(f"WITH e AS ({DERIVED_EVENTS}), g AS (SELECT 'note' AS c, note AS v, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY 2), r AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, v NULLS LAST) AS place FROM g) SELECT c AS column_name, CASE WHEN v IS NULL THEN 'None' WHEN v = '' THEN '(Empty)' ELSE v END AS label, n, place::INT AS place FROM r WHERE place <= 20")
def profile_top_values_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = profiled(derived_events(spark, sf_dir).select("note", "event_type"), minimal=True).variables
    return spark.createDataFrame([(c, x, n, i + 1) for c in ("note", "event_type") for i, (x, n) in enumerate(zip(v[c]["histogram"]["bins"], v[c]["histogram"]["counts"], strict=True))], "column_name string, label string, n long, place int")


def report_matrix(spark: SparkSession, df: DataFrame, kind: str, **options) -> DataFrame:
    m = profiled(df, compute_duplicates=False, **options).correlations[kind]
    names = m["columns"]
    found = [(names[i], names[j], round(m["matrix"][i][j], 6)) for i in range(len(names)) for j in range(i + 1, len(names))]
    return spark.createDataFrame(found, "column_a string, column_b string, r double")


@query(pairs_sql(("a", "b", "c"), WITH_NULLS))
def profile_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of a report, of columns with missing values."""
    x = table(spark, sf_dir, "lineitem").select(F.when(~(F.col("l_quantity") > 45), F.col("l_quantity")).alias("a"), F.when(~(F.col("l_tax") < 0.02), F.col("l_extendedprice")).alias("b"), F.col("l_discount").alias("c"))
    return report_matrix(spark, x, "pearson")


@query(pairs_sql(("p_partkey", "p_size", "p_retailprice"), "(SELECT rank() OVER (ORDER BY p_size NULLS LAST)::DOUBLE AS p_size, rank() OVER (ORDER BY p_retailprice NULLS LAST)::DOUBLE AS p_retailprice, rank() OVER (ORDER BY p_partkey NULLS LAST)::DOUBLE AS p_partkey FROM part)"))
def profile_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_matrix(spark, table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "spearman")


@query(pairs_sql(("p_partkey", "p_size", "p_retailprice"), "(SELECT rank() OVER (ORDER BY p_size NULLS LAST)::DOUBLE AS p_size, rank() OVER (ORDER BY p_retailprice NULLS LAST)::DOUBLE AS p_retailprice, rank() OVER (ORDER BY p_partkey NULLS LAST)::DOUBLE AS p_partkey FROM part)"))
def spearman_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for samples too large for one task: ranks from value counts, joined back to the rows."""
    names = ["p_partkey", "p_size", "p_retailprice"]
    return _rounded(correlations.long_matrix(correlations.spread_rank_rows(correlations.values(table(spark, sf_dir, "part"), names), 3), names))


@query("SELECT * FROM (VALUES ('ok', 'SKEWED', 'far'), ('ok', 'ZEROS', 'far'), ('ok', 'CONSTANT', 'one'), ('ok', 'EMPTY', 'gaps'), ('ok', 'MISSING', 'holes'), ('ok', 'UNIQUE', 'key'), ('ok', 'HIGH_CARDINALITY', 'most')) t(state, alert_type, column_name)")
def alerts_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each alert, made from the events; the expected alerts are written out."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    far = F.when(i % 500 == 0, i + 1e9).otherwise(F.lit(0.0))
    d = e.select(far.alias("far"), F.lit("x").alias("one"), F.when(i % 3 == 0, "").otherwise("a").alias("gaps"), F.when(i % 4 != 0, "b").when(i % 8 == 0, "c").alias("holes"), F.concat(F.lit("k"), i.cast("string")).alias("key"), F.concat(F.lit("m"), F.when(i % 3 == 0, i - 1).otherwise(i).cast("string")).alias("most"))
    report = profiled(d, correlations=False, compute_duplicates=False)
    return spark.createDataFrame([("ok", a["alert_type"], c) for a in report.alerts for c in a["fields"]], "state string, alert_type string, column_name string")


@query("SELECT 'rows' AS name, 1 AS within UNION ALL SELECT 'same seed', 1 UNION ALL SELECT 'eligible', 1 UNION ALL SELECT 'truncated', 1")
def samples_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli samples are about as large as asked and repeat with their seed; correlations are limited to the columns they may take."""
    df = table(spark, sf_dir, "lineitem")
    n = df.count()
    a, b = (interactions.sampled(df, ["l_orderkey", "l_linenumber"], n, 42).collect() for _ in (0, 1))
    names = correlations.eligible(df)
    few, cut = correlations.selected(names, {}, 3)
    found = [("rows", int(abs(len(a) - interactions.POINTS) < 200)), ("same seed", int(a == b)), ("eligible", int(names == list(LINEITEM))), ("truncated", int(cut and len(few) == 3))]
    return spark.createDataFrame(found, "name string, within int")
