"""End-to-end profiles of tiny tables with exact expectations, and the report's shape."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tablescope import ProfileConfig, ProfileReport, profile
from tablescope.operators.metrics import Metric, Registry, registry
from tablescope.profiler import Profiler


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, 1.1, "a", dt.datetime(2023, 1, 1)), (2, 2.2, "b", dt.datetime(2023, 1, 2)), (3, 3.3, "c", dt.datetime(2023, 1, 3)), (None, 4.4, "a", dt.datetime(2023, 1, 4))]
    return spark.createDataFrame(rows, "int_col long, float_col double, str_col string, date_col timestamp")


def test_small_mixed_table(mixed):
    d = profile(mixed, cardinality_threshold=0).to_dict()
    v = d["variables"]
    assert (v["int_col"]["n_missing"], v["int_col"]["n_distinct"], v["int_col"]["n_unique"], v["int_col"]["min"], v["int_col"]["max"], v["int_col"]["mean"]) == (1, 3, 3, 1, 3, 2.0)
    assert (v["str_col"]["n_distinct"], v["str_col"]["n_unique"]) == (3, 2) and "mean" not in v["str_col"]
    assert v["date_col"]["min"].startswith("2023-01-01") and v["date_col"]["max"].startswith("2023-01-04")
    assert v["str_col"]["histogram"] == {"bins": ["a", "b", "c"], "counts": [2, 1, 1]}
    assert v["int_col"]["extreme_values_smallest"] == [1, 2, 3] and v["int_col"]["extreme_values_largest"] == [3, 2, 1]
    assert sum(v["date_col"]["time_histogram"]["counts"]) == 4
    assert d["table"]["n"] == 4 and d["table"]["n_var"] == 4 and d["table"]["n_duplicates"] == 0
    assert set(d) == {"analysis", "table", "variables", "correlations", "interactions", "missing", "alerts", "sample", "package"}
    json.loads(json.dumps(d))


def test_empty_table(spark):
    v = profile(spark.createDataFrame([], "a long, b string")).to_dict()
    assert v["table"]["n"] == 0 and v["variables"]["a"]["n"] == 0
    assert v["variables"]["a"]["n_missing"] is None and v["variables"]["a"]["n_distinct"] == 0
    assert v["variables"]["a"]["is_unique"] is False


def test_singletons(spark):
    cols = {"all_unique": [1, 2, 3, 4, 5], "all_duplicates": [1] * 5, "mixed": [1, 2, 2, 3, 3], "with_nulls": [1, 2, None, 1, None], "all_nulls": [None] * 5, "single_row": [42, None, None, None, None]}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} long" for c in cols))
    v = profile(df).to_dict()["variables"]
    assert [v[c]["n_unique"] for c in cols] == [5, 0, 1, 1, 0, 1]


def test_shares_are_of_all_rows(spark):
    v = profile(spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 6, 7, 7, 8]], "x long")).to_dict()["variables"]["x"]
    assert (v["n_unique"], v["n_distinct"], v["p_unique"], v["p_distinct"]) == (6, 8, 0.6, 0.8)


def test_empty_strings_and_alerts(spark):
    df = spark.createDataFrame([("a", "", "a"), ("", "", "b"), (None, "", "c"), ("b", "", "d"), ("", "", "e"), ("", "", "f")], "mixed string, all_empty string, no_empty string")
    d = profile(df).to_dict()
    v = d["variables"]["mixed"]
    assert (v["n_empty"], v["n_missing"], v["p_empty"]) == (3, 1, 0.5) and v["p_missing"] == pytest.approx(1 / 6)
    assert v["histogram"]["counts"][v["histogram"]["bins"].index("(Empty)")] == 3
    assert "None" in v["histogram"]["bins"]
    assert {"alert_type": "EMPTY", "fields": ["all_empty", "mixed"], "level": "info"} in d["alerts"]
    assert any(a["alert_type"] == "CONSTANT" and a["fields"] == ["all_empty"] for a in d["alerts"])
    order = [(a["level"] != "warning", a["alert_type"]) for a in d["alerts"]]
    assert order == sorted(order)


def test_quantiles_and_ranges(spark):
    v = profile(spark.createDataFrame([(float(x),) for x in range(1, 101)], "x double")).to_dict()["variables"]["x"]
    assert [round(v[k], 6) for k in ("5%", "25%", "50%", "75%", "95%", "range", "iqr")] == [5.95, 25.75, 50.5, 75.25, 95.05, 99.0, 49.5]
    assert len(v["histogram"]["bins"]) == 20 and sum(v["histogram"]["counts"]) == 100
    assert v["mad"] == 25.0 and abs(v["skewness"]) < 1e-12


def test_nan_is_missing_and_infinity_has_no_histogram(spark):
    d = profile(spark.createDataFrame([(1.0, 1.0), (math.nan, math.inf), (None, 2.0), (3.0, 3.0)], "x double, y double")).to_dict()
    assert d["variables"]["x"]["n_missing"] == 2 and d["variables"]["x"]["max"] == 3.0 and d["variables"]["x"]["n_distinct"] == 2
    assert d["variables"]["y"]["n_infinite"] == 1 and "histogram" not in d["variables"]["y"]
    assert any("infinite" in w for w in d["analysis"]["warnings"])


def test_monotonicity_needs_an_order(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (3, 30.0, 1.0), (2, 20.0, 10.0)], "id long, up double, none double")
    skipped = profile(df, cardinality_threshold=0).to_dict()["variables"]
    assert skipped["up"]["monotonic_increasing"] == "Skipped"
    v = profile(df, cardinality_threshold=0, monotonicity_order_by="id").to_dict()["variables"]
    assert (v["up"]["monotonic_increasing"], v["up"]["monotonic_decreasing"]) == (True, False)
    assert (v["none"]["monotonic_increasing"], v["none"]["monotonic_decreasing"]) == (False, False)
    assert profile(df, monotonicity_order_by="absent", cardinality_threshold=0).to_dict()["variables"]["up"]["monotonic_increasing"] == "Skipped"


def test_reclassification(spark):
    df = spark.createDataFrame([(1 + i % 2, i) for i in range(10)], "low long, high long")
    d = profile(df, cardinality_threshold=5).to_dict()
    assert d["variables"]["low"]["type"] == "Categorical" and "mean" not in d["variables"]["low"] and d["variables"]["low"]["histogram"]["bins"] == ["1", "2"]
    assert d["variables"]["high"]["type"] == "Numeric" and d["table"]["types"] == {"Categorical": 1, "Numeric": 1}


def test_thresholds(spark):
    df = spark.createDataFrame([(str(i % 100), "1") for i in range(200)], "high string, low string")
    d = profile(df, n_unique_threshold=50, duplicates_threshold=10).to_dict()
    assert d["variables"]["high"]["n_unique"] == "Skipped" and d["variables"]["high"]["top_values"] == "Skipped" and d["variables"]["high"]["warnings"]
    assert d["variables"]["low"]["n_unique"] == 0 and d["table"]["n_duplicates"] == "Skipped"
    forced = profile(df, compute_duplicates=True, duplicates_threshold=10).to_dict()
    assert forced["table"]["n_distinct_rows"] == 100 and forced["table"]["p_duplicates"] == 0.5


def test_odd_names_and_nested_columns(spark):
    df = spark.createDataFrame([(1, [1], {"a": 1}, "A", 1.5), (2, [2], {"b": 2, "a": 1}, "B", 2.5), (2, [2], {"a": 1, "b": 2}, "B", 2.5)], "`a.b` long, arr array<int>, `m__m` map<string,int>, count string, `tick``ed` double")
    d = profile(df).to_dict()
    assert d["variables"]["arr"]["type"] == "Unsupported" and d["variables"]["arr"]["hashable"] is False and d["variables"]["m__m"]["n_distinct"] == 0
    assert d["variables"]["count"]["histogram"] == {"bins": ["B", "A"], "counts": [2, 1]}
    assert d["variables"]["tick`ed"]["mean"] == pytest.approx(13 / 6) and d["table"]["n_distinct_rows"] == 2


def test_decimals_and_large_sums(spark):
    df = spark.createDataFrame([("34071996840314972.0", 2**62), ("1.0", 2**62)], "d string, n long").select(F.col("d").cast("decimal(20,1)").alias("d"), "n")
    v = profile(df, cardinality_threshold=0).to_dict()["variables"]
    assert v["d"]["max"] == 34071996840314972.0 and v["n"]["sum"] == 2**63


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, math.nan, float((i * 37) % 11)) for i in range(1, 30)], "a double, b double, constant double, nothing double, other double")
    d = profile(df, cardinality_threshold=0).to_dict()
    for kind in ("pearson", "spearman"):
        m = d["correlations"][kind]["matrix"]
        i, cols = {r: k for k, r in enumerate(d["correlations"][kind]["columns"])}, d["correlations"][kind]["columns"]
        assert m[i["a"]]["b"] == pytest.approx(1.0) and m[i["a"]]["a"] == 1.0
        assert m[i["constant"]]["a"] is None and m[i["nothing"]]["a"] is None
        assert all(m[i[x]][y] == m[i[y]][x] for x in cols for y in cols)
    cut = profile(df, cardinality_threshold=0, correlations_max_columns=2).to_dict()
    assert cut["correlations"]["_metadata"] == {"truncated": True, "original_count": 5, "limit": 2}
    assert any("truncated" in w for w in cut["analysis"]["warnings"])


def test_sampled_correlations_repeat_with_their_seed(spark):
    df = spark.range(5000, numPartitions=2).select(F.col("id").cast("double").alias("x"), (0.5 * F.col("id") + F.col("id") * 37 % 101).alias("y"))
    runs = [profile(df, correlations_sampling_threshold=1000, correlations_sample_size=800, sample_seed=s).to_dict() for s in (1, 1, 2)]
    assert runs[0]["correlations"] == runs[1]["correlations"] != runs[2]["correlations"]
    assert runs[0]["interactions"] == runs[1]["interactions"] and runs[0]["correlations"]["pearson"]["sampled"]


def test_missing_section_and_interactions(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, 2, 2.0), (3, 3, 3.0)], "a long, b long, c double")
    d = profile(df, cardinality_threshold=0).to_dict()
    assert d["missing"]["bar"]["matrix"] == {"columns": ["a", "b", "c"], "counts": [1, 1, 0]}
    assert d["missing"]["matrix"]["matrix"]["matrix"][0] == {"a": False, "b": True, "c": False}
    assert d["missing"]["heatmap"]["matrix"]["matrix"][0]["b"] == pytest.approx(-0.5)
    assert d["interactions"]["a"]["c"] == [{"x": 1.0, "y": 1.0}, {"x": 3.0, "y": 3.0}]


def test_minimal_mode(mixed):
    d = profile(mixed, minimal=True).to_dict()
    assert d["correlations"] == {} and d["interactions"] == {} and d["missing"] == {} and "n_duplicates" not in d["table"]
    assert "skewness" not in d["variables"]["float_col"] and "kurtosis" in d["variables"]["float_col"] and d["variables"]["str_col"]["histogram"]


def test_sketches(mixed):
    v = profile(mixed, use_sketches=True, cardinality_threshold=0).to_dict()["variables"]
    assert v["int_col"]["n_distinct"] == 3 and v["float_col"]["50%"] in (2.2, 3.3)


def test_progress_sums_to_a_hundred(mixed):
    steps = []
    profile(mixed, on_progress=lambda n, label: steps.append(n))
    assert sum(steps) == 100


def test_batches_agree(mixed):
    a, b = (profile(mixed, global_batch_size=n).to_dict()["variables"] for n in (1, 500))
    assert a == b


def test_registry_is_open(mixed):
    own = Registry()
    for m in registry:
        own.register(m)
    own.register(Metric("spread", lambda k: k.typeName() == "double", lambda c, k: F.max(c) - F.min(c)))
    report = Profiler(mixed, registry=own).run()
    assert report.variables["float_col"]["spread"] == pytest.approx(3.3) and "spread" not in report.variables["str_col"]


def test_facade_warns_of_unknown_options(mixed, tmp_path):
    with pytest.warns(UserWarning, match="nonsense"):
        report = ProfileReport(mixed, minimal=True, nonsense=1)
    report.to_file(str(tmp_path / "r.json"))
    report.to_file(str(tmp_path / "r.html"))
    assert json.loads((tmp_path / "r.json").read_text())["table"]["n"] == 4 and "<html" in (tmp_path / "r.html").read_text()
    assert report.get_description()["table"] == report.to_dict()["table"]


def test_finalize_twice(mixed):
    report = profile(mixed)
    assert report.finalize().to_dict() == report.finalize().to_dict()


def test_config():
    c = ProfileConfig.resolve(n_rows=30_000_000, n_columns=2, correlations_sample_size=0, correlations_max_columns=1, n_unique_threshold=None, minimal=True, monotonicity=True)
    assert c.correlations_sample_size == 1_000_000 and c.warnings and c.correlations_max_columns == 2 and c.n_unique_threshold == 3_000_000
    assert c.wants("monotonicity") and not c.wants("correlations") and c.insists("monotonicity") and c.global_batch_size == 100 // 2 or c.global_batch_size == 100
