"""CSV, spreadsheet and Parquet files, one or a folder of them, as named DataFrames."""

from __future__ import annotations

import logging
import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..scratch import file_system

log = logging.getLogger(__name__)


def clean_csv_name(name: str) -> str:
    """Blanks and slashes become underscores; brackets, commas and hyphens go."""
    return re.sub(r"[(),\-]", "", re.sub(r"[ /]", "_", name))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def resolve(spark: SparkSession, path: str, file_name: str | None, extension: str) -> tuple[bool, str]:
    """(is it one file, its path or the folder's), on any storage that Spark reads. The extension's case doesn't count."""
    checks.label(path, "path")
    full = f"{path.rstrip('/')}/{file_name}" if file_name is not None else path
    if file_name is not None and not _is_folder(spark, path):
        raise FileNotFoundError(f"Directory does not exist: {path}")
    if full.lower().rstrip("/").endswith(f".{extension}") and _exists(spark, full):
        return True, full
    if file_name is None and _is_folder(spark, path):
        return False, path
    if not _exists(spark, full):
        raise FileNotFoundError(f"{'File' if file_name or posixpath.splitext(full)[1] else 'Directory'} does not exist: {full}")
    raise ValueError(f"The file must have the extension .{extension}: {full}")


def list_files(spark: SparkSession, folder: str, extension: str, recursive: bool = False) -> list[str]:
    """Files of that extension in the order of their lower-cased names, then paths; a folder so named is a file of parts."""
    found, folders = [], [folder]
    while folders:
        fs, at = file_system(spark, folders.pop())
        for s in fs.listStatus(at):
            p = s.getPath().toString()
            if p.lower().endswith(f".{extension}"):
                found.append(p)
            elif s.isDirectory() and recursive:
                folders.append(p)
    return sorted(found, key=lambda p: (posixpath.basename(p).lower(), p.lower()))


def import_files(spark: SparkSession, read: Callable[[str], DataFrame], path: str, extension: str, *, file_name: str | None = None, prefix: str = "imported_data", recursive: bool = False, overwrite: bool = False) -> DataFrame | dict[str, DataFrame]:
    """One DataFrame for a file; for a folder a dict of them, registered as views ``prefix_001`` and so on."""
    if not isinstance(prefix, str) or not prefix.isidentifier():
        raise ValueError("`prefix` must be a valid name.")
    checks.flag(recursive, "recursive")
    checks.flag(overwrite, "overwrite")
    single, place = resolve(spark, path, file_name, extension)
    if single:
        return read(place)
    paths = list_files(spark, place, extension, recursive)
    if not paths:
        raise FileNotFoundError(f"No .{extension} files found in: {place}")
    names = [f"{prefix}_{i:03d}" for i in range(1, len(paths) + 1)]
    taken = [n for n in names if spark.catalog.tableExists(n)]
    if taken and not overwrite:
        raise ValueError(f"Already there: {', '.join(taken)}. Use `overwrite=True` to replace them.")
    out = {}
    for name, p in zip(names, paths):
        out[name] = read(p)
        out[name].createOrReplaceTempView(name)
        log.info("%s is imported as %s", posixpath.basename(p), name)
    return out


def infer_columns(raw: DataFrame) -> DataFrame:
    """Text columns with the type that all their values fit: logical, int, double, else text. "NA" is null everywhere, an
    empty field is null but in text, dates stay text. One aggregation over all columns."""
    if not raw.columns:
        return raw
    aggs = []
    for i, c in enumerate(raw.columns):
        v = F.btrim(checks.q(c))
        there = v.isNotNull() & (v != "") & (v != "NA")
        aggs += [F.count_if(there).alias(f"n{i}"), F.count_if(there & v.isin("T", "F", "TRUE", "FALSE", "true", "false", "True", "False")).alias(f"b{i}"), F.count_if(there & v.rlike(r"^[+-]?\d+$") & v.try_cast("int").isNotNull()).alias(f"i{i}"), F.count_if(there & (v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | v.isin("Inf", "-Inf", "NaN")))
                 .alias(f"d{i}")]
    s = raw.agg(*aggs).first()
    out = []
    for i, c in enumerate(raw.columns):
        v, n = F.btrim(checks.q(c)), s[f"n{i}"]
        some = F.when((v != "") & (v != "NA"), v)
        if s[f"b{i}"] == n:
            out.append(F.upper(F.substring(some, 1, 1)).__eq__("T").alias(c))
        elif s[f"i{i}"] == n:
            out.append(some.try_cast("int").alias(c))
        elif s[f"d{i}"] == n:
            out.append(F.when(some == "Inf", float("inf")).when(some == "-Inf", float("-inf")).otherwise(some.try_cast("double")).alias(c))
        else:
            x = checks.q(c)
            out.append(F.when(x == "NA", None).otherwise(F.coalesce(x, F.lit(""))).alias(c))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, *, file_name: str | None = None, prefix: str = "imported_data", recursive: bool = False, overwrite: bool = False, clean_names: bool = True, schema: T.StructType | str | None = None, **options) -> DataFrame | dict[str, DataFrame]:
    """CSV with a header. Types are found in one pass unless ``schema`` gives them; further options go to the reader.

    A file is read whole by one task (``multiLine``) only where a line of it has an odd number of quotes, so that a quoted
    field may go on in the next; all others are split over tasks.
    """
    checks.flag(clean_names, "clean_names")

    def read(p: str) -> DataFrame:
        quote = options.get("quote", '"')
        broken = options["multiLine"] if "multiLine" in options else bool(quote) and bool(spark.read.text(p).filter(F.regexp_count("value", F.lit(re.escape(quote))) % 2 == 1).take(1))
        r = spark.read.options(**({"header": True, "multiLine": broken, "escape": '"', "emptyValue": ""} | options))
        df = r.schema(schema).csv(p) if schema is not None else infer_columns(r.csv(p, inferSchema=False))
        return df.toDF(*[clean_csv_name(c) for c in df.columns]) if clean_names else df

    return import_files(spark, read, path, "csv", file_name=file_name, prefix=prefix, recursive=recursive, overwrite=overwrite)


def sheet_cells(data: bytes, sheet: str | int) -> list[list[object]]:
    """Rows of one sheet of a workbook, by its standard parts alone: shared and inline strings, numbers, logicals, and numbers
    under a date format as dates."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        part = lambda n: ElementTree.fromstring(z.read(n))
        book = part("xl/workbook.xml")
        sheets = [(s.get("name"), s.get(f"{{{ns['r']}}}id")) for s in book.iterfind("m:sheets/m:sheet", ns)]
        hits = [r for n, r in sheets if n == sheet] if isinstance(sheet, str) else [r for _, r in sheets[sheet - 1 : sheet]]
        if not hits:
            raise ValueError(f"There is no sheet {sheet!r}.")
        target = next(r.get("Target") for r in part("xl/_rels/workbook.xml.rels") if r.get("Id") == hits[0])
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{ns['m']}}}t"))
        strings = [text(e) for e in part("xl/sharedStrings.xml").iterfind("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = part("xl/styles.xml")
            own = {f.get("numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in styles.iterfind("m:numFmts/m:numFmt", ns)}
            is_date = lambda i: i in own and bool(re.search("[dymhs]", own[i].lower())) or i not in own and (14 <= int(i) <= 22 or 45 <= int(i) <= 47)
            dated = [is_date(x.get("numFmtId", "0")) for x in styles.iterfind("m:cellXfs/m:xf", ns)]
        start = dt.datetime(1904, 1, 1) if book.find("m:workbookPr[@date1904='1']", ns) is not None else dt.datetime(1899, 12, 30)
        out: list[list[object]] = []
        for row in part("xl/" + target.removeprefix("/xl/").removeprefix("/")).iterfind("m:sheetData/m:row", ns):
            cells: list[object] = []
            for c in row.iterfind("m:c", ns):
                letters = re.sub(r"\d", "", c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                kind, v = c.get("t", "n"), c.findtext("m:v", None, ns)
                value: object = text(c.find("m:is", ns)) if kind == "inlineStr" else v
                if v is not None and kind == "s":
                    value = strings[int(v)]
                elif v is not None and kind == "b":
                    value = v == "1"
                elif kind == "e":
                    value = None
                elif v is not None and kind == "n":
                    number = float(v)
                    value = start + dt.timedelta(seconds=round(number * 86400)) if dated and dated[int(c.get("s", 0))] else number
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value
            if any(x is not None for x in cells):
                out.append(cells)
        return out


def read_xlsx(spark: SparkSession, path: str, *, sheet: str | int = 1, file_name: str | None = None, prefix: str = "imported_data", recursive: bool = False, overwrite: bool = False, clean_names: bool = True) -> DataFrame | dict[str, DataFrame]:
    """One sheet, by name or number from 1, of each workbook, its first row as names. A sheet has at most 1,048,576 rows and is
    read on the driver without a spreadsheet engine. A column of one kind has that type, any other is text."""
    checks.flag(clean_names, "clean_names")
    if isinstance(sheet, bool) or not isinstance(sheet, (str, int)) or sheet == "" or isinstance(sheet, int) and sheet < 1:
        raise ValueError("`sheet` must be one sheet name or a positive number.")
    kinds = {float: "double", bool: "boolean", dt.datetime: "timestamp", str: "string"}

    def shown(x: object) -> str | None:
        return None if x is None else f"{x:.15g}" if isinstance(x, float) else str(x).upper() if isinstance(x, bool) else str(x)

    def read(p: str) -> DataFrame:
        rows = sheet_cells(bytes(spark.read.format("binaryFile").load(p).select("content").first()[0]), sheet)
        if not rows:
            return spark.createDataFrame([], T.StructType([]))
        width = max(map(len, rows))
        head, *body = [r + [None] * (width - len(r)) for r in rows]
        names = [shown(x) or f"...{i + 1}" for i, x in enumerate(head)]
        fields = []
        for i, n in enumerate(names):
            types = {type(r[i]) for r in body if r[i] is not None}
            kind = kinds[types.pop()] if len(types) == 1 else "boolean" if not types else "string"
            if kind == "string":
                for r in body:
                    r[i] = shown(r[i])
            fields.append(T.StructField(clean_csv_name(n) if clean_names else n, T._parse_datatype_string(kind)))
        return spark.createDataFrame([tuple(r) for r in body], T.StructType(fields))

    return import_files(spark, read, path, "xlsx", file_name=file_name, prefix=prefix, recursive=recursive, overwrite=overwrite)


def read_tables(spark: SparkSession, path: str, *, file_name: str | None = None, prefix: str = "imported_data", recursive: bool = False, overwrite: bool = False) -> DataFrame | dict[str, DataFrame]:
    """Saved tables: Parquet files or folders named ``.parquet``."""
    return import_files(spark, lambda p: spark.read.parquet(p), path, "parquet", file_name=file_name, prefix=prefix, recursive=recursive, overwrite=overwrite)
