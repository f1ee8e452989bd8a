"""Summaries, cross-tables, balance, uniqueness and column types."""

import pytest

from millrace import api
from millrace.functions.formatting import make_unique
from millrace.operators import summary


def row(df):
    return df.first().asDict()


@pytest.fixture
def groups(spark):
    return spark.createDataFrame([(x,) for x in ("Zulu", "Zulu", "Alpha", "Bravo")], "group string")


def test_top_n_before_display_order(groups):
    got = api.category_summary(groups, "group", top_n=1, sort_levels="alpha")
    assert got.columns == ["group", "Zulu", "Other", "Total"]
    assert tuple(got.first()) == ("Count n(%)", "2 (50.0%)", "2 (50.0%)", "4 (100.0%)")


def test_other_collides(spark):
    df = spark.createDataFrame([(x,) for x in ("Other", "Other", "Alpha", "Bravo")], "group string")
    assert api.category_summary(df, "group", top_n=1).columns == ["group", "Other", "Other_1", "Total"]


def test_empty_and_missing_categories(spark):
    empty = spark.createDataFrame([], "group string")
    assert tuple(api.category_summary(empty, "group").first()) == ("Count n(%)", "0 (0.0%)")
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "x double")
    assert [(r["level"], r["n"]) for r in api.category_levels(df, "x").orderBy("ord").collect()] == [("1", 2), ("Missing", 2)]
    assert api.category_levels(df, "x", include_missing=False).count() == 1
    levels = api.category_levels(spark.createDataFrame([("b",), ("a",), ("c",)], "g string"), "g", sort_levels="levels", levels=["c", "b"])
    assert [r["level"] for r in levels.orderBy("ord").collect()] == ["c", "b", "a"]


def test_continuous_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (None,)], "value double")
    got = row(api.continuous_summary(df, "value", probs=[0.2, 0.8]))
    assert (got["P20"], got["P80"], got["Missing"], got["N"], got["NonMissing"], got["NonFinite"], got["Analyzed"]) == ("1.20", "1.80", 1, 4, 3, 1, 2)
    assert got["Mean_SD"] == "1.50 (0.71)" and got["Min_Max"] == "1.00 - 2.00" and got["MissingPct"] == 25.0
    one = row(api.continuous_summary(spark.createDataFrame([(3,)], "v int"), "v"))
    assert one["Mean_SD"] == "3.00 (NA)"
    none = row(api.continuous_summary(spark.createDataFrame([], "v double"), "v"))
    assert none["N"] == 0 and none["MissingPct"] is None and none["Mean_SD"] is None
    with pytest.raises(TypeError):
        api.continuous_summary(spark.createDataFrame([("a",)], "v string"), "v")
    with pytest.raises(ValueError):
        api.continuous_stats(df, "value", probs=[0.5, 0.5])


def test_distributed_quantiles(spark, monkeypatch):
    df = spark.range(0, 1003, 1, 7).selectExpr("case when id % 10 = 0 then null else cast((id * 7919) % 500 as double) / 3 end as v")
    a, b = (row(api.continuous_stats(df, "v", distributed=d)) for d in (False, True))
    monkeypatch.setattr(summary, "MAX_HELD", 100)
    assert row(api.continuous_stats(df, "v"))["median"] == pytest.approx(b["median"])
    assert api.continuous_summary(df, "v", distributed=True).collect() == api.continuous_summary(df, "v", distributed=False).collect()
    assert a.keys() == b.keys() and a["quantiles"] == pytest.approx(b["quantiles"]) and a["median"] == pytest.approx(b["median"])
    assert row(api.continuous_stats(df.limit(0), "v", distributed=True))["median"] is None


@pytest.fixture
def sexes(spark):
    rows = [("Female", "Control"), ("Female", "Treatment"), ("Male", "Control"), ("Male", "Treatment"), ("Male", "Treatment"), (None, "Control")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, sex string, group string")


def test_cross_table(sexes):
    how = {"row_levels": ["Female", "Male"], "col_levels": ["Control", "Treatment"]}
    got = {r["sex"]: r.asDict() for r in api.cross_table(sexes, "sex", "group", **how).collect()}
    assert [got[k]["Control"] for k in ("Female", "Male", "Missing", "Total")] == ["1 (50.0%)", "1 (33.3%)", "1 (100.0%)", "3 (50.0%)"]
    cols = api.cross_table(sexes, "sex", "group", percent="column", include_missing=False, **how).collect()
    assert [r["Control"] for r in cols] == ["1 (50.0%)", "1 (50.0%)", "2 (100.0%)"]
    plain = api.cross_table(sexes, "sex", "group", percent="none", include_total=False, order_by="at").collect()
    assert [tuple(r) for r in plain] == [("Female", "1", "1"), ("Male", "1", "2"), ("Missing", "1", "0")]
    unused = api.cross_table(sexes, "sex", "group", row_levels=["Other", "Male", "Female"], col_levels=["Control", "Treatment"]).collect()
    assert unused[0]["Control"] == "0 (0.0%)" and unused[0]["Total"] == "0 (0.0%)"
    with pytest.raises(ValueError):
        api.cross_table(sexes, "nope", "group")
    with pytest.raises(ValueError):
        api.cross_table(sexes, "sex", "group", percent="cell")


def test_balance(spark):
    schema = "x double, g string, w double, b boolean"
    a = spark.createDataFrame([(1.0, "p", 1.0, True), (3.0, "q", 3.0, False), (None, "p", 1.0, None)], schema)
    b = spark.createDataFrame([(2.0, "p", 1.0, True), (6.0, "r", 1.0, True), (float("nan"), None, 1.0, True)], schema)
    plain = {(r["variable"], r["level"]): r for r in api.compare_balance(a, b, ["x", "g", "b"], include_smd=True).collect()}
    x = plain["x", None]
    assert (x["n1"], x["mean1"], x["sd1"], x["mean2"], x["diff"], x["miss_n2"], x["miss_pct1"]) == (2, 2.0, 1.4142, 4.0, 2.0, 1, 33.3333)
    assert x["smd"] == pytest.approx(2 / ((2 + 8) / 2) ** 0.5, abs=1e-4)
    assert plain["g", "p"]["prop1"] == 0.6667 and plain["g", "p"]["prop2"] == 0.5 and plain["g", "q"]["prop2"] == 0.0
    assert plain["b", "FALSE"]["prop1"] == 0.5 and plain["b", "TRUE"]["prop2"] == 1.0
    many = api.compare_balance(a, b, ["x", "w"] * 5)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert many.count() == 10 and plan.count("LogicalRDD") == 2  # one relation a side
    assert api.compare_balance(a.limit(0), b.limit(0), ["x", "g"]).count() == 2
    heavy = {(r["variable"], r["level"]): r for r in api.compare_balance(a, b, ["x", "g"], weights1="w", weights2="w").collect()}
    assert heavy["x", None]["mean1"] == 2.5 and heavy["x", None]["sd1"] == pytest.approx(0.75**0.5, abs=1e-4)
    assert heavy["g", "p"]["prop1"] == 0.4
    lone = api.compare_balance(a, b.drop("x"), ["x"]).collect()
    assert [r["level"] for r in lone][:2] == ["FALSE", "TRUE"] and {r["type"] for r in lone} == {"categorical"}
    with pytest.raises(ValueError):
        api.compare_balance(a, b, ["nope"])


def test_uniqueness(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,)], "k string")
    got = row(api.check_unique(df, "k"))
    assert (got["n_rows"], got["n_missing"], got["n_unique"], got["is_unique"], got["duplicates"]) == (5, 2, 3, False, [None, "a"])
    got = row(api.check_unique(df, "k", na_rm=True))
    assert (got["n_unique"], got["is_unique"], got["duplicates"]) == (2, False, ["a"])
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "k double")
    assert api.count_unique_categories(nan, "k").first()[0] == 1 and api.count_unique_categories(nan, "k", True).first()[0] == 2


def test_duplicates(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("b", nan, 3), ("b", None, 4), ("c", 2.0, 5)], "k1 string, k2 double, v int")
    got = api.get_duplicates(df, "k1", "k2").collect()
    assert [(r["v"] in (1, 2, 3, 4), r[".n"]) for r in got] == [(True, 2)] * 4 + [(False, None)]
    few = api.get_duplicates(df, ["k1"], 1, keep_all=False).collect()
    assert [(r["k1"], r["k2"], r[".n"]) for r in few] == [("a", 1.0, 2), ("b", None, 2)]
    assert api.get_duplicates(df, "k1", "k2", na_rm=True).count() == 3
    assert api.get_duplicates(df).filter("`.n` is not null").count() == 0
    with pytest.raises(ValueError):
        api.get_duplicates(df, "zz")


def test_types(spark):
    df = spark.createDataFrame([], "a double, b string, c date, d int, e boolean, f timestamp, g array<int>, h timestamp_ntz, i decimal(9,2)")
    assert list(api.data_types(df).values()) == ["continuous", "categorical", "date", "continuous", "categorical", "date", "other", "date", "continuous"]
    assert api.data_types(df, []) == {} and list(api.data_types(df, ["d", "b"])) == ["d", "b"]
    with pytest.raises(ValueError):
        api.data_types(df, ["zz"])


def test_aliases():
    assert api.mill_category_summary is api.category_summary and len(api.ALIASES) == len(api.__all__) / 2
    assert make_unique(["a", "a", "a_1", "a"]) == ["a", "a_2", "a_1", "a_3"]


def test_collation_and_many_levels(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "A", "a", "B", "é", "z", "z")], "v string")
    order = lambda **how: [r["level"] for r in api.category_levels(df, "v", sort_levels="alpha", **how).orderBy("ord").collect()]
    assert order() == ["A", "B", "a", "b", "z", "é"] and order(collation="UNICODE") == ["a", "A", "b", "B", "é", "z"]
    many = spark.range(50_000).selectExpr("cast(id % 40000 as string) as v")
    got = api.category_levels(many, "v", top_n=2).orderBy("ord").collect()
    assert [(r["level"], r["n"], r["is_other"]) for r in got] == [("0", 2, False), ("1", 2, False), ("Other", 49_996, True)]


def test_repeated_values_as_rows(spark):
    df = spark.createDataFrame([(x,) for x in ("a", "a", "b", None, None)], "v string")
    assert sorted((str(r["value"]), r["n"]) for r in api.duplicate_values(df, "v").collect()) == [("None", 2), ("a", 2)]
    assert [r["value"] for r in api.duplicate_values(df, "v", na_rm=True).collect()] == ["a"]
    few, none = (api.check_unique(df, "v", max_listed=n).first() for n in (2, 1))
    assert few["n_duplicates"] == none["n_duplicates"] == 2 and few["duplicates"] == [None, "a"] and none["duplicates"] is None


def test_repeated_values_in_one_cell_are_whole(spark):
    got = api.check_unique(spark.range(2_002_002).selectExpr("nullif(id % 1001001, 7) as v"), "v").selectExpr("n_duplicates", "size(duplicates)", "duplicates[0]", "duplicates[1]", "duplicates[8]", "duplicates[1001000]").first()
    assert list(got) == [1_001_001, 1_001_001, None, 0, 8, 1_001_000]  # more than the million that was listed at most
    some = spark.createDataFrame([(x,) for x in ([2, None], [1], [1], [2, None], None)], "v array<int>")
    assert api.check_unique(some, "v").first()["duplicates"] == [[1], [2, None]]
    assert api.check_unique(some.limit(0), "v").first()["duplicates"] == []
