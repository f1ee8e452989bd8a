"""Importing, storing, routing, engine choice and streams."""

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.operators import routing
from millrace.sources.importing import list_files
from millrace.streaming import text as stream


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("First Name,Value/Score\nx,1\n")
    (tmp_path / "b.csv").write_text("Second Name,Value-Score\nNA,2.5\n\"\",NA\n")
    (tmp_path / "ignore.txt").write_text("no")
    got = api.read_csv(spark, str(tmp_path), prefix="imp")
    assert list(got) == ["imp_001", "imp_002"] and got["imp_001"].columns == ["First_Name", "Value_Score"] and got["imp_002"].columns == ["Second_Name", "ValueScore"]
    assert got["imp_001"].dtypes[1][1] == "int" and got["imp_002"].dtypes[1][1] == "double"
    assert spark.table("imp_002").count() == 2
    with pytest.raises(ValueError):
        api.read_csv(spark, str(tmp_path), prefix="imp")
    api.read_csv(spark, str(tmp_path), prefix="imp", overwrite=True)
    assert api.read_csv(spark, str(tmp_path), file_name="a.CSV", clean_names=False).columns == ["First Name", "Value/Score"]
    with pytest.raises(FileNotFoundError):
        api.read_csv(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        api.read_csv(spark, str(tmp_path / "ignore.txt"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A0.csv").write_text("x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in list_files(spark, str(tmp_path), "csv", True)] == ["a.CSV", "A0.csv", "b.csv"]


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('d,l,i,s,q\n2024-01-05,TRUE,7,,"a,""b"\n2024-01-06,F,NA,x,\n')
    df = api.read_csv(spark, str(tmp_path / "t.csv"))
    assert [k for _, k in df.dtypes] == ["string", "boolean", "int", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [("2024-01-05", True, 7, "", 'a,"b'), ("2024-01-06", False, None, "x", "")]


def workbook(path, sheets, shared=("plain", "Given Name"), date1904=False):
    """A workbook by hand: sheets as {name: xml of rows}."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><workbookPr date1904='{int(date1904)}'/><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}><numFmts><numFmt numFmtId='170' formatCode='yyyy\\-mm\\-dd'/><numFmt numFmtId='171' formatCode='0.0 \"days\"'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='170'/><xf numFmtId='22'/><xf numFmtId='171'/></cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_xlsx_without_an_engine(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>When/At</t></is></c><c r="C1" t="inlineStr"><is><t>x</t></is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row>'
    rows = head + '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" s="1"><v>45296</v></c><c r="C2" s="3"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c><c r="AB2"><v>7</v></c></row><row r="3"><c r="B3" s="2"><v>45296.5</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="AB3" t="str"><v>seven</v></c></row><row r="4"/>'
    workbook(tmp_path / "a.XLSX", {"first": "<row><c><v>3</v></c></row>", "second": rows})
    df = api.read_xlsx(spark, str(tmp_path / "a.XLSX"), sheet=2)
    assert df.columns[:4] == ["Given_Name", "When_At", "x", "ok"] and len(df.columns) == 28 and df.columns[-1] == "far"
    assert [k for _, k in df.dtypes[:4]] == ["string", "timestamp", "double", "boolean"] and df.dtypes[-1][1] == "string"
    got = df.selectExpr("Given_Name", "cast(When_At as string)", "x", "ok", "far").collect()
    assert [tuple(r) for r in got] == [("plain", "2024-01-05 00:00:00", 1.5, True, "7"), (None, "2024-01-05 12:00:00", None, None, "seven")]
    assert api.read_xlsx(spark, str(tmp_path), sheet="first", prefix="book")["book_001"].columns == ["3"]
    with pytest.raises(ValueError, match="sheet"):
        api.read_xlsx(spark, str(tmp_path / "a.XLSX"), sheet="third")
    with pytest.raises(ValueError):
        api.read_xlsx(spark, str(tmp_path), sheet=0)


def test_csv_from_any_file_system_and_broken_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    got = api.read_csv(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in got["imported_data_001"].collect()] == [(1, "two\nlines"), (2, "x")]
    assert api.read_csv(spark, f"file://{tmp_path}", file_name="m.csv").count() == 2
    (tmp_path / "m.csv").write_text('a,b\n1,"two ""lines"""\n2,x\n')
    assert api.read_csv(spark, str(tmp_path / "m.csv")).filter("b = 'two \"lines\"'").count() == 1


def test_scratch_folder_goes_after_stop(tmp_path):
    import subprocess
    import sys

    code = f"""
from millrace.session import build_session
from millrace.scratch import discard, scratch_root, written
import os
s = build_session("x", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
a, b = written(s.range(3), "a"), written(s.range(4), "b")
discard(a)
assert b.count() == 4 and len(os.listdir(scratch_root(s))) == 1
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=__file__.rsplit("/tests/", 1)[0])
    assert not list(tmp_path.glob("millrace*"))


def test_model_engine(spark):
    """A model of one's own finds names in batches; rules add their passes."""

    def load():
        sizes = []

        def find(texts, batch_size):
            sizes.append(batch_size)
            return [[(i, i + 5) for i in [t.find("zorba")] if i >= 0 and batch_size == 3] for t in texts]

        return find

    engine = api.setup_engine("regex", load=load)
    rows = [(1, "then zorba came"), (2, "Smith, John"), (3, None), (4, " "), (5, "Follow Up"), (1, "then zorba came")]
    df = spark.createDataFrame(rows, "id int, note string")
    how = {"engine": engine, "batch_size": 3}
    masked = api.mask_person_names(df, "note", **how)
    assert [r["masked_text"] for r in masked.collect()] == ["then [NAME] came", "[NAME]", None, " ", "Follow Up", "then [NAME] came"]
    assert api.mask_person_names(df, "note", keep_original=False, **how).columns == ["id", "note"] and api.mask_person_names(df, "note", keep_original=False, **how).first()["note"] == "then [NAME] came"
    assert [r["name_flag"] for r in api.flag_person_names(df, "note", **how).collect()] == [1, 1, 0, 0, 0, 1]
    found = api.detect_person_names(df.limit(5), "note", "id", explain=True, **how).collect()
    assert [tuple(r) for r in found] == [(1, "zorba", 6, 10, "model_person", "model"), (2, "Smith, John", 1, 11, "last_first", "high")]
    assert api.mask_person_names(df, "note").filter("masked_text = '[NAME]'").count() == 2
    assert api.mask_person_names(df.withColumnRenamed("note", "__known"), "__known", name_columns=["__known"]).count() == 6


def test_save_and_load(spark, tmp_path):
    df = spark.range(5)
    path = api.save_table(df, str(tmp_path / "t"))
    assert path.endswith("t.parquet") and api.load_table(spark, str(tmp_path / "t")).count() == 5
    with pytest.raises(FileExistsError):
        api.save_table(df, path, overwrite=False)
    with pytest.raises(FileNotFoundError):
        api.save_table(df, str(tmp_path / "no" / "t"))
    with pytest.raises(ValueError):
        api.save_table(df, path, compress="xz")
    assert list(api.read_tables(spark, str(tmp_path), prefix="tab")) == ["tab_001"]


TRIPS = [(1, 51.0, -114.0, 53.5, -113.5), (2, 51.0, -114.0, 53.5, -113.5), (3, None, -114.0, 53.5, -113.5), (4, 95.0, -114.0, 53.5, -113.5), (5, 50.0, -113.0, 53.5, -113.5)]


def test_travel(spark, tmp_path):
    df = spark.createDataFrame(TRIPS, "i int, a double, b double, c double, d double")
    calls = str(tmp_path / "calls")

    def route(lo0, la0, lo1, la1):
        with open(calls, "a") as f:
            f.write("x")
        return 10000, 1000

    got = api.travel(df, "a", "b", "c", "d", route=route, delay=0).orderBy("i").collect()
    assert [(r["travel_distance"], r["travel_time"]) for r in got] == [(10000, 1000)] * 2 + [(None, None)] * 2 + [(10000, 1000)]
    assert len(open(calls).read()) == 2

    def fails(*at):
        raise RuntimeError("down")

    assert api.travel(df, "a", "b", "c", "d", route=fails, delay=0, on_error="na").filter("travel_time is not null").count() == 0
    with pytest.raises(Exception, match="down"):
        api.travel(df, "a", "b", "c", "d", route=fails, delay=0, on_error="stop").count()
    clash = df.withColumn("travel_time", F.lit(1))
    with pytest.raises(ValueError, match="already exist"):
        api.travel(clash, "a", "b", "c", "d", route=route)
    assert api.travel(clash, "a", "b", "c", "d", route=route, delay=0, overwrite=True).columns.count("travel_time") == 1


def test_requests():
    r = routing.osrm_request(-114, 51, -113.5, 53.5, server="https://h/", username="u", password="p")
    assert r.full_url == "https://h/route/v1/driving/-114,51;-113.5,53.5?overview=false&steps=false&alternatives=false" and r.headers["Authorization"].startswith("Basic ")
    for bad in ({"server": "ftp://h"}, {"server": "https://u:p@h"}, {"server": "http://h", "username": "u", "password": "p"}, {"server": "https://h", "username": "u"}):
        with pytest.raises(ValueError):
            routing.osrm_request(0, 0, 0, 0, **bad)
    g = routing.google_request(1, 2, 3, 4, api_key="k", routing_preference="TRAFFIC_AWARE")
    assert g.full_url == routing.GOOGLE + "/directions/v2:computeRoutes" and b"TRAFFIC_AWARE" in g.data
    assert b"routingPreference" not in routing.google_request(1, 2, 3, 4, travel_mode="WALK", api_key="k").data
    with pytest.raises(ValueError):
        routing.google_request(1, 2, 3, 4, api_key="k", server="https://elsewhere")
    assert routing.google_parse({"routes": [{"duration": "74s", "distanceMeters": 9}]}) == (9.0, 74.0)
    assert routing.osrm_parse({"code": "Ok", "routes": [{"distance": 1, "duration": 2}]}) == (1.0, 2.0)
    for bad in ({}, {"routes": []}, {"routes": [{"duration": "x"}]}):
        with pytest.raises(RuntimeError):
            routing.google_parse(bad)
    with pytest.raises(RuntimeError):
        routing.osrm_parse({"code": "NoRoute"})


def test_google_travel(spark, monkeypatch):
    df = spark.createDataFrame(TRIPS, "i int, a double, b double, c double, d double")
    monkeypatch.delenv("GOOGLE_MAPS_API_KEY", raising=False)
    with pytest.raises(ValueError, match="key is required"):
        api.google_travel(df, "a", "b", "c", "d")
    with pytest.raises(ValueError):
        api.google_travel(df, "a", "b", "c", "d", api_key="k", travel_mode="FLY")
    got = api.google_travel(df, "a", "b", "c", "d", api_key="k", route=lambda *at: (1, 2), delay=0)
    assert got.filter("travel_time = 2").count() == 3


def test_engine_choice():
    assert api.setup_engine("regex").engine == "regex" and api.setup_engine("auto").engine in ("regex", "spacy")
    status = api.check_engine()
    assert status["ready"] and status["engine"] == "regex" and status["error"] is None
    assert api.require_modules(["json", "no_such_module"]) == {"json": True, "no_such_module": False}
    with pytest.raises(ValueError):
        api.setup_engine("magic")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "PHN 123456789 of John Smith"), (2, "nothing here"), (3, None)], "id long, note string")
    df.write.parquet(str(tmp_path / "in"))
    s = stream.read_stream(spark, str(tmp_path / "in"), str(tmp_path / "in"), 1)
    query = stream.write_stream(stream.flags(stream.private_text(s, "note"), "note"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = {r["id"]: (r["masked_text"], r["phn_flag"], r["name_flag"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("PHN [PHN] of [NAME]", 1, 1), 2: ("nothing here", 0, 0), 3: (None, 0, 0)}
