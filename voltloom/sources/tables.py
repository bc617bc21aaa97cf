"""Tables from CSV files, workbooks and map metadata."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.functions.values import timestamp
from voltloom.operators.frames import resolve_columns
from voltloom.sources.archives import csv_cells, decode, delimiter_of, ends_quoted

#: Rows of a parsed file that a task hands on at once.
SLICE = 2_000
#: Columns of price exports, which may lack their header (fixed values).
PRICE_COLUMNS = "DATETIME DAYOFWEEK OBJECTID OBJECTNAME DATATYPE AGG_LEVEL MINVALUE MAXVALUE AVGVALUE TIMEZONE COUNTVALUE SUMVALUE STDDEVVALUE HOURENDING MARKETDAY PEAKTYPE MONTH YEAR".split()


@dataclass(frozen=True)
class Dialect:
    """How a file is written: its delimiter and its columns in order."""

    delimiter: str
    columns: tuple[str, ...]


def first_records(spark: SparkSession, path: str, n: int, *, delimiter: str | None = None, encoding: str = "UTF-8") -> tuple[str, list[list[str]]]:
    """Delimiter and cells of a file's first ``n`` records; no more of the file is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
    mark, text, found = delimiter, "", []
    try:
        for line in iter(lines.readLine, None):
            text = f"{text}\n{line}" if text else line
            own = mark or delimiter_of(text)
            if ends_quoted(text, own):
                continue
            if text.strip():
                mark = own
                found.append(next(csv.reader(io.StringIO(text, newline=""), delimiter=mark), []))
                if len(found) == n:
                    break
            text = ""
    finally:
        lines.close()
    return mark or ",", found


def _named(header: Sequence[str]) -> tuple[str, ...]:
    """Column names of a header: white space and byte order mark gone, repeats numbered."""
    names: list[str] = []
    for k, cell in enumerate(header):
        name = base = cell.lstrip("\ufeff").strip() or f"column_{k}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return tuple(names)


def dialects(spark: SparkSession, path: str | Sequence[str], *, delimiter: str | None = None, encoding: str = "UTF-8", **options: str) -> dict[Dialect, list[str]]:
    """The files of a path by their dialect, both in order of path; empty files are left out.

    Looks at each file's header alone, many files at a time.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = sorted(spark.read.options(**{k: v for k, v in options.items() if k in ("pathGlobFilter", "recursiveFileLookup")}).text(paths).inputFiles())

    def header(file: str) -> Dialect | None:
        mark, rows = first_records(spark, file, 1, delimiter=delimiter, encoding=encoding)
        return Dialect(mark, _named(rows[0])) if rows else None

    found: dict[Dialect, list[str]] = {}
    with ThreadPoolExecutor(32) as pool:
        for file, dialect in zip(files, pool.map(header, files), strict=True):
            if dialect is not None:
                found.setdefault(dialect, []).append(file)
    return found


def read_csv(spark: SparkSession, path: str | Sequence[str], *, required: dict[str, Sequence[str]] | None = None, schema: T.StructType | None = None, delimiter: str | None = None, encoding: str = "UTF-8", columns: int = 200_000, **options: str) -> DataFrame:
    """A CSV table; text columns unless a schema is given, so that no pass infers types.

    Every file has its own header and delimiter. Files of one dialect are read
    together, and the parts are united by name: columns are those of the schema,
    or else of all files in the order of their first file; what a file lacks is
    null. ``required`` names columns with their aliases (see
    ``resolve_columns``), in each dialect. The input is never changed.
    """
    kinds = {f.name: f.dataType for f in schema} if schema else {}
    made = None
    for dialect, files in dialects(spark, path, delimiter=delimiter, encoding=encoding, **options).items():
        own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in dialect.columns])
        reader = spark.read.option("header", True).option("sep", dialect.delimiter).option("encoding", encoding).option("maxColumns", columns).options(**options)
        part = reader.schema(own).csv(files)
        part = resolve_columns(part, required) if required else part
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    if made is None:
        if schema is None:
            raise ValueError(f"no file with a header in {path}")
        return spark.createDataFrame([], schema)
    if schema is None:
        return made
    return made.select(*[F.col(f"`{f.name}`") if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


#: Types from the narrowest to the widest, with what their texts look like.
_LATTICE = (("boolean", re.compile(r"(?i)true|false")), ("bigint", re.compile(r"[+-]?\d{1,18}")), ("double", re.compile(r"(?i)[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|[+-]?(?:inf|infinity)|nan")), ("string", re.compile(r"(?s).*")))


def infer_types(spark: SparkSession, path: str | Sequence[str], *, window: int = 100, encoding: str = "UTF-8", **options: str) -> dict[str, str]:
    """The type of every column from the first ``window`` rows of each file, widened until all of them fit.

    Whole numbers fit doubles; any other mixture is text, and so is a column
    without a value.
    """
    kinds: dict[str, str] = {}
    rank = [name for name, _ in _LATTICE]
    for dialect, files in dialects(spark, path, encoding=encoding, **options).items():
        with ThreadPoolExecutor(32) as pool:
            for _, rows in pool.map(lambda f: first_records(spark, f, window + 1, delimiter=dialect.delimiter, encoding=encoding), files):
                for row in rows[1:]:
                    for name, cell in zip(dialect.columns, row, strict=False):
                        if not cell.strip():
                            continue
                        kind = next(n for n, look in _LATTICE if look.fullmatch(cell.strip()))
                        held = kinds.get(name, kind)
                        mixed = "string" if "boolean" in (kind, held) and kind != held else max(kind, held, key=rank.index)
                        kinds[name] = mixed
    return kinds


def read_typed(spark: SparkSession, path: str | Sequence[str], *, window: int = 100, mismatched: str = "mismatched", encoding: str = "UTF-8", **options: str) -> DataFrame:
    """A CSV table with types from a bounded window of each file.

    ``mismatched`` names the columns of a row whose text does not fit the type
    (their value is null), so that what lies beyond the window is reported.
    """
    kinds = infer_types(spark, path, window=window, encoding=encoding, **options)
    df = read_csv(spark, path, encoding=encoding, **options)
    typed = {c: kinds.get(c, "string") for c in df.columns}
    text = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns}
    cast = {c: F.col(f"`{c}`") if k == "string" else text[c].try_cast(k) for c, k in typed.items()}
    odd = [F.when(text[c].isNotNull() & cast[c].isNull(), F.lit(c)) for c, k in typed.items() if k != "string"]
    report = F.array_compact(F.array(*odd)) if odd else F.array().cast("array<string>")
    return df.select(*[v.alias(c) for c, v in cast.items()], report.alias(mismatched))


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table in UTF-8, or in Latin-1 where its bytes are no UTF-8; every file of the path decides for itself.

    Columns are those of the first file by path; other files may have them in
    another order, and what a file lacks is null.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                reader = csv.reader(io.StringIO(decode(content.as_py())))
                header = [c.lstrip("\ufeff").strip() for c in next(reader, [])]
                yield batch_of(name.as_py(), header, [header])
                while rows := list(islice(reader, SLICE)):
                    yield batch_of(name.as_py(), header, rows)

    def batch_of(name: str, header: list[str], rows: list[list[str]]) -> pa.RecordBatch:
        cells = [list(zip(header, row, strict=False)) for row in rows]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([rows[0] is header] * len(rows)), pa.array(cells, pa.map_(pa.string(), pa.string()))], names=["path", "is_header", "cells"])

    names = files.select("path").orderBy("path").limit(1).join(files, "path").mapInArrow(lines, "path string, is_header boolean, cells map<string,string>").filter("is_header").select(F.map_keys("cells").alias("names")).first()
    rows = files.mapInArrow(lines, "path string, is_header boolean, cells map<string,string>").filter("not is_header")
    return rows.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in (names["names"] if names else [])])


def read_price_exports(spark: SparkSession, path: str) -> DataFrame:
    """Price exports with or without header: the first line that equals the column names is no row."""
    df = spark.read.option("header", False).schema(", ".join(f"`{c}` string" for c in PRICE_COLUMNS)).csv(path)
    return df.filter(~F.col(PRICE_COLUMNS[0]).eqNullSafe(PRICE_COLUMNS[0]))


def read_named(spark: SparkSession, path: str, pattern: str, out: str, kind: str = "int", **options: object) -> DataFrame:
    """Files of a directory with a value from their names (the pattern's first group); files without it are left out."""
    made = None
    for dialect, files in dialects(spark, path).items():
        names = [f for f in files if re.search(pattern, unquote(f.rsplit("/", 1)[-1]))]
        if names:
            part = read_csv(spark, names, delimiter=dialect.delimiter, **options).withColumn(out, F.regexp_extract("_metadata.file_name", pattern, 1).cast(kind))
            made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    if made is None:
        raise ValueError(f"no file of {path} matches {pattern}")
    return made


def metric_of(file_name: str | F.Column) -> F.Column:
    """Struct of metric and step from a file's name: HSL, MW k, PRICE k or OTHER; dash, underscore and space alike."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    curve = r"(?i)Curve[-_ ]?(MW|Price)[-_ ]?(\d+)"
    kind = F.upper(F.regexp_extract(name, curve, 1))
    step = F.regexp_extract(name, curve, 2)
    return F.struct(F.when(kind != "", kind).when(name.rlike(r"(?i)\bHSL\b|_HSL"), "HSL").otherwise("OTHER").alias("metric"), F.when(step != "", step.cast("int")).alias("step"))


def wide_to_long(spark: SparkSession, path: str, ids: Sequence[str] = ("Resource Name", "Resource Type")) -> DataFrame:
    """Long rows of files with one column per timestamp, however many columns there are.

    Each cell with a value becomes a row ``resource_name, resource_type, ts,
    metric, step, value``. A file's header is parsed once and meets its lines as
    an array of timestamps; lines are split and exploded one at a time, in native
    expressions. Columns whose header is no timestamp are left out.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_name").withColumn("delimiter", F.lit(","))
    is_header = F.lower(F.regexp_replace("value", r'^\ufeff?"?', "")).startswith(ids[0].lower())
    headers = lines.filter(is_header).select("file_path", F.transform(csv_cells("value"), lambda c: F.trim(F.regexp_replace(c, "^\ufeff", ""))).alias("header"))
    headers = headers.select("file_path", F.transform("header", lambda c: timestamp(c)).alias("times"), *[F.array_position("header", F.lit(i)).cast("int").alias(f"at{k}") for k, i in enumerate(ids)])
    rows = lines.filter(~is_header).withColumn("cells", csv_cells("value")).join(headers, "file_path")
    name, kind = (F.try_element_at("cells", F.when(F.col(c) > 0, F.col(c))) for c in ("at0", "at1"))
    rows = rows.select(name.alias("resource_name"), kind.alias("resource_type"), metric_of("file_name").alias("metric"), F.explode(F.arrays_zip("times", "cells")).alias("cell"))
    rows = rows.select("resource_name", "resource_type", F.col("cell.times").alias("ts"), F.col("metric.metric").alias("metric"), F.col("metric.step").alias("step"), F.col("cell.cells").try_cast("double").alias("value"))
    return rows.filter("ts is not null and value is not null")


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Texts of a workbook's first sheet."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        name = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(book.read(name)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                v, inline = c.find("m:v", ns), c.find("m:is/m:t", ns)
                text = inline.text if inline is not None else v.text if v is not None else None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_workbook(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Text columns of the first sheet of one or more workbooks, found by their first row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = sheet_rows(content.as_py())
                header = [str(c or "").strip() for c in rows[0]] if rows else []
                at = [header.index(c) if c in header else None for c in columns]
                table = [[r[k] if k is not None and k < len(r) else None for r in rows[1:]] for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in table], names=list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns))


def read_map_tables(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of map tables (``.tab``): version, charset, type, fields, and which of the files beside them exist."""
    texts = spark.read.option("pathGlobFilter", "*.[tT][aA][bB]").text(path, wholetext=True).select("value", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"))
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("_metadata.file_name", r"\.([^.]*)$", 1)).alias("kind"))
    parts = files.groupBy("stem").agg(F.array_sort(F.collect_set("kind")).alias("files"))
    n = F.regexp_extract("value", r"(?im)^\s*Fields\s+(\d+)", 1)
    lines = F.transform(F.split(F.regexp_extract("value", r"(?is)\bFields\s+\d+\s*[\r\n]+(.*)", 1), r"\r?\n"), lambda x: F.trim(x))
    fields = F.transform(F.slice(F.filter(lines, lambda x: x != ""), F.lit(1), F.coalesce(n.try_cast("int"), F.lit(0))), lambda x: F.struct(F.substring_index(x, " ", 1).alias("name"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^\S+\s*", ""), r"\s*;\s*$", "")).alias("type")))
    made = texts.select(
        "stem", F.regexp_extract("value", r"(?im)^\s*!version\s+(\S+)", 1).alias("version"), F.regexp_extract("value", r'(?im)^\s*!charset\s+"?([^"\r\n]+)"?', 1).alias("charset"),
        F.regexp_extract("value", r"(?im)^\s*Type\s+(\S+)", 1).alias("type"), fields.alias("fields"),
    )
    need = F.array(*[F.lit(k) for k in ("dat", "id", "map", "tab")])
    return made.join(parts, "stem").withColumn("complete", F.size(F.array_except(need, "files")) == 0)


def read_by_year(spark: SparkSession, files: dict[int, str], day: str, value: str) -> DataFrame:
    """One table of ``year, ts, value`` from a file for each year; a file without the columns is an error."""
    made = None
    for year, path in sorted(files.items()):
        rows = read_csv(spark, path, required={day: [], value: []})
        part = rows.select(F.lit(year).alias("year"), timestamp(F.col(day)).alias("ts"), F.col(value).try_cast("double").alias("value"))
        made = part if made is None else made.unionByName(part)
    if made is None:
        raise ValueError("no files")
    return made


def read_bundle(spark: SparkSession, paths: dict[str, str], required: dict[str, dict[str, Sequence[str]]] | None = None) -> dict[str, DataFrame]:
    """Several CSV tables by name, each with its required columns."""
    return {name: read_csv(spark, path, required=(required or {}).get(name)) for name, path in paths.items()}
