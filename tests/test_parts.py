"""Operators, types, page, sources and command line by themselves."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import cli, profile, render
from tablescope.alerts import alerts
from tablescope.functions.columns import bytes_per_row, hashable, report_kind
from tablescope.operators import correlations, logical_types, rows
from tablescope.operators.quantiles import by_narrowing
from tablescope.plans import catalogue
from tablescope.report import plain
from tablescope.sources import readers
from tablescope.streaming.microbatch import profile_stream, running_counts, windowed_counts

INVALID = {name: bad for name, (_, bad) in catalogue.SAMPLES.items() if bad}


def test_the_37_types_in_order():
    assert [t.name for t in logical_types.built_in()] == logical_types.PRIORITY and len(logical_types.PRIORITY) == 37


def test_types_of_samples(spark):
    names = list(catalogue.SAMPLES)
    df = spark.createDataFrame([tuple(catalogue.SAMPLES[n][0] for n in names), tuple(None for _ in names)], ", ".join(f"`{n}` string" for n in names))
    got = {c: t.name for c, t in logical_types.infer(df, sample=None).items()}
    differ = {n: g for n, g in got.items() if n != g}
    # Where an earlier rule matches the sample too, priority decides.
    order = logical_types.PRIORITY
    assert all(order.index(g) < order.index(n) for n, g in differ.items()) and len(differ) <= 6


def test_types_of_other_values(spark):
    names = list(INVALID)
    df = spark.createDataFrame([tuple(INVALID[n] for n in names)], ", ".join(f"`{n}` string" for n in names))
    assert all(c != t.name for c, t in logical_types.infer(df, sample=None).items())


@pytest.mark.parametrize(
    "values,kind,name",
    [
        ([0, 1, 1], "long", "Boolean"), ([25, 30, 0, 120], "int", "Age"), ([0, 1, 2, 100], "long", "Count"), ([0, 1, -1], "long", "Integer"), ([-1, 150], "int", "Integer"), ([1.5], "double", "Decimal"), ([True], "boolean", "Boolean"),
        (["123456789"], "string", "SSN"), (["CA", "NY"], "string", "USState"), (["USA", "FRA"], "string", "CountryCode"), (["42\n"], "string", "String"), (["A", "B", "A", "B", "C"] * 20, "string", "Categorical"), ([None, None], "string", "Categorical"), (["jan", "DEC"], "string", "Ordinal"),
    ],
)
def test_priorities(spark, values, kind, name):
    assert logical_types.infer(spark.createDataFrame([(v,) for v in values], f"v {kind}"))["v"].name == name


def test_a_rule_of_your_own(spark, monkeypatch):
    own = logical_types.rule("Code", pattern=r"^X-\d+$")
    monkeypatch.setattr(logical_types, "types", [own, *logical_types.built_in()])
    assert logical_types.infer(spark.createDataFrame([("X-1",), ("X-22",)], "v string"))["v"].label == "Code"
    with pytest.raises(ValueError):
        logical_types.rule("Both", pattern="a", values=["b"])


def test_physical_kinds():
    assert report_kind(T.StringType(), "Integer") == "Numeric" and report_kind(T.StringType(), "Date Time") == "Categorical"
    assert report_kind(T.ArrayType(T.LongType()), None) == "Unsupported" and not hashable(T.VariantType())
    assert [bytes_per_row(k) for k in (T.LongType(), T.BooleanType(), T.StringType(), T.DateType())] == [8, 1, 20, 16]


@pytest.mark.parametrize("few", [1, 4096])
def test_quantiles_by_narrowing_are_exact(spark, few):
    rng = random.Random(2)
    data = [(rng.gauss(0, 1), float(rng.randint(0, 5)), 3.0, None if rng.random() < 0.3 else rng.expovariate(1e-6)) for _ in range(3001)]
    df = spark.createDataFrame(data, "g double, few double, constant double, skewed double")
    q = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    want = df.agg(*[F.percentile(c, F.lit(q)).alias(c) for c in df.columns]).first()
    got = by_narrowing(df, df.columns, q, bins=16, few=few)
    for c in df.columns:
        assert got[c] == pytest.approx(want[c], rel=1e-12)
    assert by_narrowing(df.limit(0), ["g"], q) == {"g": [None] * 7}


def test_ranks_without_a_single_sort(spark):
    df = spark.createDataFrame([(x,) for x in [3.0, 1.0, None, 2.0, 2.0, None, 5.0]], "x double").repartition(3)
    assert {(r.v, r["rank"], r.n) for r in correlations.spread_ranks(correlations.values(df, ["x"]), 1).collect()} == {(1.0, 1, 1), (2.0, 2, 2), (3.0, 4, 1), (5.0, 5, 1), (None, 6, 2)}


def test_monotonic_across_tasks(spark):
    df = spark.range(2000, numPartitions=5).select("id", (F.col("id") / 10).cast("int").alias("up"), (-F.col("id")).alias("down"), F.when(F.col("id") == 1001, 0).otherwise(F.col("id")).alias("dip"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("gaps"))
    r = rows.monotonic(df, ["up", "down", "dip", "gaps"], "id").first()
    assert tuple(r) == (True, False, False, True, False, False, True, True)
    assert tuple(rows.monotonic(df.limit(0), ["up"], "id").first()) == (None, None)


def test_alerts():
    v = {"c": {"type": "Numeric", "n_distinct": 1}, "u": {"type": "Categorical", "n_distinct": 100}, "m": {"type": "Numeric", "n_distinct": 5, "p_missing": 0.9}, "z": {"type": "Numeric", "n_distinct": 5, "n_zeros": 90, "skewness": -11.0}, "h": {"type": "Categorical", "n_distinct": 80}}
    got = {a["alert_type"]: a["fields"] for a in alerts({"n": 100}, v)}
    assert got == {"CONSTANT": ["c"], "UNIQUE": ["u"], "HIGH_CARDINALITY": ["h"], "MISSING": ["m"], "ZEROS": ["z"], "SKEWED": ["z"]}


def test_plain_values():
    assert plain({"a": float("nan"), "b": [float("inf"), 1]}) == {"a": None, "b": [None, 1]}
    assert plain(object()).startswith("__unsupported_type__:object:")


def test_page_is_closed_and_escaped():
    data = {"analysis": {"title": "</title><script>alert(1)</script>"}, "x": "</script>"}
    for theme in render.THEMES:
        page = render.page(data, theme)
        assert "<script>alert" not in page and page.count("</script>") == 2 and "Content-Security-Policy" in page and "{{" not in page
        assert "http://www.w3.org" in page and "https://" not in page
    assert "grid-template-columns" in render.page(data, "ydata-like") and "grid-template-columns" not in render.page(data)
    assert render.page(data) != render.page(data)  # another nonce
    for bad in ("../render", "/etc/passwd", "none"):
        with pytest.raises(ValueError):
            render.page(data, bad)


def test_sources_and_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "a,\nb"), (2, "c")], "n long, t string")
    df.toPandas().to_csv(tmp_path / "t.csv", index=False)
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "odd.data"))
    df.toPandas().to_csv(tmp_path / "odd.txt", index=False)
    for name in ("t.csv", "t.parquet", "odd.data", "odd.txt"):
        assert readers.read_any(spark, str(tmp_path / name), multiline=True).count() == 2
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).count() == 3  # without multiline a line break ends a row
    (tmp_path / "lines.csv").write_text('n,t\n1,"a,\nb"\n2,c\n')
    assert readers.read_any(spark, str(tmp_path / "lines.csv"), multiline=True).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_any(spark, str(tmp_path / "absent"))
    out = tmp_path / "r.json"
    assert cli.main(["-f", str(tmp_path / "t.csv"), "-o", str(out), "--minimal", "--no-duplicates", "-t", "mine"]) == 0
    assert json.loads(out.read_text())["analysis"]["title"] == "mine"
    assert cli.main(["-f", str(tmp_path / "t.parquet"), "-o", str(tmp_path / "x.json"), "--format", "html", "--minimal"]) == 0
    assert (tmp_path / "x.json").read_text().startswith("<!DOCTYPE html>")
    assert cli.main(["-f", str(tmp_path / "absent.parquet"), "-o", str(out)]) == 1 and "Error" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["-f", "x", "--correlations-max-columns", "1"])


def test_types_of_a_head_are_those_of_the_plan(spark):
    values = [v for pair in catalogue.SAMPLES.values() for v in pair] + ["42\n", "\u00e9", "\u0661\u0662", "A\u00a0B", "12 34", "$5\n"]
    for a in range(0, len(values), 20):
        own = values[a : a + 20]
        df = spark.createDataFrame([tuple(own)] * 3, ", ".join(f"c{i} string" for i in range(len(own))))
        assert [t.name for t in logical_types.infer(df).values()] == list(logical_types.verdicts(df, df.columns).first())
    df = spark.createDataFrame([(1, 0, 200, -1, 1.5, None, "low", None), (0, 16, 3, 5, 2.5, None, "High", "a"), (1, 90, None, 6, 3.0, None, None, "b")], "b int, a long, cnt int, i short, d double, nul string, o string, t string")
    assert [t.name for t in logical_types.infer(df).values()] == [x or "String" for x in logical_types.verdicts(df, df.columns).first()]
    assert {t.name for t in logical_types.infer(df.limit(0)).values()} == {x or "String" for x in logical_types.verdicts(df.limit(0), df.columns).first()}


def test_tables_in_memory(spark):
    import pandas as pd
    import pyarrow as pa



    frame = pd.DataFrame({"n": [1, 2, 2], "t": ["a", "b", None]})
    for data in (frame, pa.Table.from_pandas(frame)):
        v = profile(data, minimal=True).to_dict()["variables"]
        assert v["n"]["n_distinct"] == 2 and v["t"]["n_missing"] == 1


def test_excel_needs_an_engine(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    path.write_bytes(b"not a sheet")
    with pytest.raises((ImportError, ValueError)):
        readers.read_any(spark, str(path))


def test_streams(spark, tmp_path):
    spark.range(20).selectExpr("id", "timestamp_seconds(id * 600) AS at", "CASE WHEN id = 3 THEN NULL ELSE double(id) END AS x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, x double").parquet(str(tmp_path / "in"))
    seen = []
    profile_stream(stream, lambda r, n: seen.append(r.table["n"]), str(tmp_path / "c1"), minimal=True).awaitTermination()
    assert sum(seen) == 20
    totals = []
    add = running_counts(lambda t, n: totals.append((t["n"], t["variables"]["x"]["n_missing"], t["variables"]["x"]["mean"], t["variables"]["x"]["max"])))
    batches = spark.read.parquet(str(tmp_path / "in"))
    for i, part in enumerate((batches.where("id < 7"), batches.where("id >= 7"))):
        add(profile(part, minimal=True, cardinality_threshold=0), i)
    add(profile(batches.where("id >= 7"), minimal=True, cardinality_threshold=0), 1)  # delivered again
    assert totals[-1] == totals[-2] == (20, 1, (190 - 3) / 19, 19.0)
    q = windowed_counts(stream, "at", "x").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    got = sorted((r.n, r.n_missing) for r in spark.table("w").collect())
    assert sum(n for n, _ in got) == 20 and sum(m for _, m in got) == 1


def test_every_query_has_a_counterpart_or_a_reason():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"approx_distinct"}
