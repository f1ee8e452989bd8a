"""Dates, linkage ids, cleaning, health numbers and names in text."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import api
from millrace.functions.person_names import default_rules
from millrace.operators.boost import name_type


def column(spark, values, kind, make):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"), df.schema["x"].dataType)).collect()]


def test_text_dates(spark):
    d = dt.date(2024, 1, 5)
    cases = {
        "2024-01-05": d, " 2024/1/5 ": d, "2024.01.05": d, "20240105": d, "01/05/2024": d, "01.05.2024": d, "5 Jan 2024": d, "January 5, 2024": d, "jan 05, 2024": d,
        "13/02/2024": dt.date(2024, 2, 13), "2024-01-05 junk": d, "2024-01-05 25:00": d, "2024-01-05T13:30+05:00": d, "2024-01-05T10:11:12Z": d, "20240105 10:00": d,
        "202401051330": d, "45296": d, "2024-02-30": None, "NA": None, " none ": None, "": None, None: None, "words": None,
        "01-05-2024": None, "05-Jan-2024": None, "01-05-2024 10:00": d,
    }
    got = column(spark, list(cases), "string", api.to_date)
    assert dict(zip(cases, got)) == cases
    assert column(spark, ["03/04/2024"], "string", lambda c, k: api.to_date(c, k, day_first=True)) == [dt.date(2024, 4, 3)]


def test_text_times(spark):
    cases = {
        "2024-01-05 13:30:15": "13:30:15.0", "2024-01-05T13:30": "13:30:00.0", "2024-01-05 1:30 PM": "01:30:00.0", "2024-01-05T13:30:00+05:00": "13:30:00.0",
        "20240105T133000": None, "202401051330": "13:30:00.0", "2024-01-05 10:20:30.5": "10:20:30.5", "Jan 5, 2024 7:08": "07:08:00.0",
    }
    assert column(spark, list(cases), "string", lambda c, k: F.date_format(api.to_datetime(c, k), "HH:mm:ss.S")) == list(cases.values())
    pm = column(spark, ["2024-01-05 1:30 PM", "2024-01-05 12:05 am"], "string", lambda c, k: F.date_format(api.to_datetime(c, k, honor_ampm=True), "HH:mm"))
    assert pm == ["13:30", "00:05"]


def test_numbers(spark):
    x = [20240105.0, 45296.0, 202401051330.0, 1704450600.0, 19727.0, -1.0, 5e9, float("nan"), None, float("inf"), 70000.0]
    assert column(spark, x, "double", api.to_date) == [dt.date(2024, 1, 5)] * 5 + [dt.date(1969, 12, 31)] + [None] * 5
    assert column(spark, [45296.5], "double", lambda c, k: F.date_format(api.to_datetime(c, k, numeric_origin="excel"), "yyyy-MM-dd HH")) == ["2024-01-05 12"]
    assert column(spark, ["2024-01-05 23:30"], "string", lambda c, k: F.date_format(api.to_datetime(c, k, tz="America/Edmonton"), "dd HH")) == ["06 06"]
    with pytest.raises(TypeError):
        column(spark, [True], "boolean", api.to_date)


def test_boost(spark):
    rows = [("2024-01-05", "2024-01-05 10:00", "note 1", 45296.0, 45000.0, "20240105"), ("2024-01-06", "2024-01-06 11:00", "note 2", 45297.0, 45001.0, "n/a")]
    df = spark.createDataFrame(rows, "visit string, created_at string, note string, event_date double, score double, dob string")
    got = api.boost_data(df)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["date", "timestamp", "string", "date", "double", "date"]
    mixed = spark.createDataFrame([("2024-01-05",)] * 4 + [("junk",)], "d string")
    assert api.detect_dates(mixed) == {"d": "date"} and api.detect_dates(mixed, min_success=0.9) == {}
    assert [name_type(x) for x in ("createdAt", "DateOfBirth", "visit_date", "timeStamp", "update", "score")] == ["timestamp", "date", "date", "timestamp", "none", "none"]
    assert api.boost_data(spark.createDataFrame([], "a int, b string")).columns == ["a", "b"]


def test_linkage(spark):
    rows = [("O'Neil", "Smith", "2000/01/02", "m"), ("Al", "Bo", "03/14/1999", "Female"), ("É", "Bo", "1999-01-01", "F"), ("Al", None, "1999-01-01", "F"), ("Al", "Bo", "bad", "F"), ("Al", "Bo", "18-Sep-2025", "x"), ("Al", "Bo", "20240230", "x"), ("Élan", "Bo", "19990101", "F")]
    df = spark.createDataFrame(rows, "a string, b string, d string, g string")
    c = [F.col(x) for x in "abdg"]
    assert [r[0] for r in df.select(api.linkage_id(*c, dob_type=T.StringType())).collect()] == ["ONSM20000102M", "ALBO19990314F", "Invalid SID", "Invalid SID", "Invalid SID", "ALBO20250918X", "Invalid SID", "LABO19990101F"]
    assert df.select(api.linkage_id(*c, dob_type=T.StringType(), strip_accents=True)).collect()[7][0] == "ELBO19990101F"


def test_cleaning(spark):
    df = spark.createDataFrame([("“it’s” ‘ok’ `x`", 1)], ["Col (1)", "Name's-Age"])
    fixed = api.fix_column_names(api.strip_quotes(df))
    assert fixed.columns == ["Col_1", "NamesAge"] and fixed.first()[0] == "its ‘ok x"
    assert api.today_labels("2024-01-05") == {"underscore": "2024_01_05", "compact": "20240105"}
    with pytest.raises(ValueError):
        api.today_labels("nope")


def test_health_numbers(spark):
    cases = {
        "PHN: 123456789": "PHN: [PHN]", "phn 12345-6789.": "phn [PHN].", "12345 - 6789 is the PHN": "[PHN] is the PHN", "PHN 123456789 987654321": "PHN [PHN] 987654321",
        "SPHN 123456789": "SPHN 123456789", "PHN 1234567890": "PHN 1234567890", "PHN\n123456789": "PHN\n123456789", "no label 123456789": "no label 123456789", "": "", None: None,
        "PHN of this very long way 123456789": "PHN of this very long way 123456789",
    }
    assert dict(zip(cases, column(spark, list(cases), "string", lambda c, k: api.mask_phn(c)))) == cases
    flags = column(spark, list(cases), "string", lambda c, k: api.flag_phn(c))
    assert flags == [int(k != v) for k, v in cases.items()]
    assert column(spark, ["PHN 123456789"], "string", lambda c, k: api.mask_phn(c, "$5\\")) == ["PHN $5\\"]
    assert column(spark, ["PHN of this very long way 123456789"], "string", lambda c, k: api.flag_phn(c, 30)) == [1]
    with pytest.raises(ValueError):
        api.flag_phn(F.lit("x"), -1)


def test_known_names(spark):
    rows = [("ALICE SMITH called alice.", "Alice", "Smith"), ("Spoke to Tremblay, Jean-Paul.", "Jean-Paul", "Tremblay"), ("Joann spoke to o'neil.", "Ann", "O'Neil"), ("Heart Transplant was listed.", "Heart", "Transplant"), ("ann arrived", "Bob", "Jones"), ("Status unknown", "Unknown", None), (None, "Sarah", "Brown")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, comments string, first_name string, last_name string")
    names = ["first_name", "last_name"]
    want = ["[NAME] called [NAME].", "Spoke to [NAME].", "Joann spoke to [NAME].", "[NAME] was listed.", "ann arrived", "Status unknown", None]
    assert [r["masked_text"] for r in api.mask_person_names(df, "comments", name_columns=names).orderBy("i").collect()] == want
    assert [r["name_flag"] for r in api.flag_person_names(df, "comments", name_columns=names).orderBy("i").collect()] == [1, 1, 1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        api.flag_person_names(df, "comments", name_columns=["zz"])


def test_similar_names(spark):
    rows = [("Jonathon Smyth called.", "Jonathan", "Smith"), ("Alice Martin called Peter Brown.", "Alice", "Martin"), ("Tremblay, Jean-Paul reviewed.", "Jean-Paul", "Tremblay"), ("ONEIL arrived.", "Anne", "O'Neil"), ("Jon called.", "John", "Doe"), ("Peter Brown called.", "Sarah", "Johnson"), (None, "Alice", "Martin")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, comments string, first_name string, last_name string")
    mask = lambda **how: [r["masked_text"] for r in api.mask_known_names(df, "comments", **how).orderBy("i").collect()]
    flag = lambda **how: [r["name_flag"] for r in api.flag_known_names(df, "comments", **how).orderBy("i").collect()]
    assert mask() == ["[NAME] [NAME] called.", "[NAME] called Peter Brown.", "[NAME] reviewed.", "[NAME] arrived.", "Jon called.", "Peter Brown called.", None]
    assert flag() == [1, 1, 1, 1, 0, 0, 0]
    assert mask(max_distance=0)[0] == rows[0][0] and flag(min_chars=4)[4] == 1
    with pytest.raises(ValueError):
        flag(max_distance=4)


@pytest.fixture(scope="module")
def engine():
    return default_rules().engine()


def test_detected_names(engine):
    for x in ("Follow Up", "Social Work", "Air Canada", "Black Ice"):
        assert engine.mask(x) == "[NAME]" and engine.mask(x, sensitivity="balanced") == x == engine.mask(x, sensitivity="high_precision")
        assert engine.flag(x, "balanced") == 0
    assert [engine.mask(x, sensitivity="balanced") for x in ("Spoke with John Smith.", "Sarah Johnson stated she was ready.")] == ["Spoke with [NAME].", "[NAME] stated she was ready."]
    assert [engine.mask(x, sensitivity="high_precision") for x in ("Dr. John Smith", "Smith, John", "Pt John Smith", "Reviewed by John Smith")] == ["[NAME]", "[NAME]", "Pt [NAME]", "Reviewed by [NAME]"]
    for x in ("Smith, John", "SMITH, JOHN", "Smith, John Paul", "Smith, J.", "Smith,John", "O'Neil, Anne-Marie", "St-Pierre, Jean"):
        assert engine.mask(x) == "[NAME]" == engine.rules_mask(x, "[NAME]") and engine.flag(x) == 1 and engine.detect(x)[0][2] == x
    assert [engine.mask(x) for x in ("Pt", "Pt Syncopal", "Pt Smith", "Pt. Sarah Johnson", "RN Johnson")] == ["Pt", "Pt Syncopal", "Pt [NAME]", "Pt. [NAME]", "[NAME]"]


@pytest.mark.parametrize("text", ["Peter Lougheed Centre", "Grand Manor", "Centre High", "The Academy at King Edward", "Private Residence", "West Side", "Costco Store", "Fort McMurry", "Reviewed by Fort McMurry.", "Edmonton International Airport", "Vancouver, BC", "AVENUE,CALGARY", "Route, Red Deer", "Pain, Chest", "Abilify Maintena was administered.", "Non Small Cell Lung", "65 Years Old", "IFT Requested", "HEAT EXHAUSTION", "Nursing Care Centre", "Opioid Overdose", None, " "])
def test_no_names(engine, text):
    assert engine.mask(text) == text and engine.flag(text) == 0 and engine.detect(text) == []


def test_names_among_registers(engine):
    cases = {"John Smith received Abilify Maintena.": "[NAME] received Abilify Maintena.", "King Edward met Sarah Johnson.": "[NAME] met [NAME].", "John Smith visited Peter Lougheed Centre.": "[NAME] visited Peter Lougheed Centre."}
    assert [engine.mask(x) for x in cases] == list(cases.values()) and all(engine.flag(x) for x in cases)


def test_detect_rows(spark):
    df = spark.createDataFrame([(7, "John Smith."), (8, None), (9, "é Dr. Ann Lee and Bob Ray")], "id long, note string")
    got = api.detect_person_names(df, "note", "id", explain=True).orderBy("row_id", "start").collect()
    assert [tuple(r) for r in got] == [(7, "John Smith", 1, 10, "title_case_pair", "low"), (9, "Dr. Ann Lee", 3, 13, "titled_name", "high"), (9, "Bob Ray", 19, 25, "title_case_pair", "low")]
    assert api.detect_person_names(df, "note", "id").columns == ["row_id", "detected_name", "start", "end"]


def test_health_numbers_at_the_end_of_stored_texts(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["plain", 'token = "94a272397683e"', "zip 12345-6789", "987654321", "9" * 10, "line\n", "", None, "the PHN"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["masked"], r["flag"]) for r in entry.queries()["phn_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"{t} Their PHN: [PHN] was on file.", 1) for i, t in enumerate(texts[:7])}  # as its SQL has it
    # in one line with the label such digits are a number beside it
    assert column(spark, ['token = "94a272397683e" Their PHN: 123456789.'], "string", lambda c, k: api.mask_phn(c)) == ['token = "94a[PHN]e" Their PHN: [PHN].']


def test_name_patterns_are_tried_at_few_places():
    engine = default_rules().engine()
    prose = "The onshin thnd heart, rate 12 was (ok). Then éaire\n" * 200
    texts = [prose, "Doe , Jane seen; xDoe, Jane; _Doe, J. and A.B, C or O'Neil-Smith,\nANNE Marie", "Jane  Q. Doe, MacDonald Ann-Marie\tDoe ÉJane Doe 1Jane Doe", "A-B-C-D, E", "", "JANE", "Jane,", "Jane, É"]
    for rule in ("last_first", "title_case_pair"):
        guided = engine.patterns[rule]
        assert sum(1 for _ in guided.begin.finditer(prose)) == 0  # the pattern isn't run at any word of such a text
        for t in texts:
            assert [m.span() for m in guided.finditer(t)] == [m.span() for m in guided.pattern.finditer(t)]
            for at in range(len(t)) if len(t) < 100 else [0]:
                a, b = guided.search(t, at), guided.pattern.search(t, at)
                assert (a and a.span()) == (b and b.span())
    assert [engine.flag(t) for t in (prose, prose + "Jane Doe", "Not Feeling Well", "NOT  FEELING, Bus Stop", "signed by Doe")] == [0, 1, 0, 0, 1]


def test_known_names_of_one_file_are_masked_in_many_tasks(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(1000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("known_mask", "known_flag"):
        out = entry.queries()[name](spark, str(tmp_path))
        sizes = out.rdd.glom().map(len).collect()
        assert sum(sizes) == 1000 and max(sizes) <= 200
    odd = spark.createDataFrame([("Jonathon O'Neill, ONEIL; nname", "Jonathan", "O'Neil"), (" ", "Jane", "Smith"), (None, "Jane", "Smith"), ("Names of N/A", "N/A", None)], "text string, first_name string, last_name string")
    assert [r[0] for r in api.mask_known_names(odd, "text", replacement="nname").select("masked_text").collect()] == ["nname nname, nname; nname", " ", None, "Names of N/A"]
    assert [r[0] for r in api.flag_known_names(odd, "text").select("name_flag").collect()] == [1, 0, 0, 0]
