"""Lines of CSV files inside nested ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "latin-1")
#: Delimiters told apart by the header line.
DELIMITERS = (",", "|", "\t", ";")


def decode(data: bytes) -> str:
    for name in ENCODINGS[:-1]:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode(ENCODINGS[-1])


def delimiter_of(header: str) -> str:
    """The first delimiter that parts the header outside quotes, or a comma."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", header)
    return next((d for d in DELIMITERS if d in bare), ",")


def ends_quoted(line: str, mark: str, quoted: bool = False) -> bool:
    """Whether a line ends inside a quoted cell; ``quoted`` says whether it begins in one."""
    at = 0
    while True:
        if not quoted:
            if line.startswith('"', at):
                quoted, at = True, at + 1
                continue
            at = line.find(mark, at) + 1
            if at == 0:
                return False
        else:
            at = line.find('"', at) + 1
            if at == 0:
                return True
            if line.startswith('"', at):  # a doubled quote is one of the cell's own
                at += 1
                continue
            quoted = False
            at = line.find(mark, at) + 1
            if at == 0:
                return False


def records(text: str) -> Iterator[tuple[str, str]]:
    """Delimiter and text of every record: lines ended by LF or CRLF, taken together while a quoted cell is open."""
    mark, held = "", []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if not mark and not held:
            mark = delimiter_of(line) if line.count('"') % 2 == 0 else ""
        quoted = ends_quoted(line, mark or ",", bool(held)) if held or '"' in line else False
        held.append(line)
        if not quoted:
            record, held = "\n".join(held), []
            mark = mark or delimiter_of(record)
            yield mark, record
    if held:
        yield mark or ",", "\n".join(held)


def members(data: bytes, name: str, pattern: str, low: int, high: int, depth: int = 1) -> Iterator[tuple[str, bytes]]:
    """Files whose base name matches, in archives from depth ``low`` to ``high``, by path; broken archives are passed over."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with archive:
        for inner in sorted(archive.namelist()):
            path = f"{name}!{inner}"
            if inner.lower().endswith(".zip"):
                if depth < high:
                    yield from members(archive.read(inner), path, pattern, low, high, depth + 1)
            elif depth >= low and re.search(pattern, inner.rsplit("/", 1)[-1], re.I):
                yield path, archive.read(inner)


@F.udtf(returnType=T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("line_no", T.IntegerType()), ("delimiter", T.StringType()), ("line", T.StringType()))]))
class Unzip:
    """Records of matching members of an archive, empty lines left out."""

    def eval(self, path: str, content: bytes, pattern: str, low: int, high: int) -> Iterator[tuple]:
        for name, data in members(bytes(content), path, pattern, low, high):
            for k, (mark, line) in enumerate(records(decode(data))):
                if line.strip():
                    yield name, k, mark, line


def zipped_lines(spark: SparkSession, path: str, *, pattern: str = r"\.csv$", min_depth: int = 1, max_depth: int = 8, limit: int | None = None) -> DataFrame:
    """``source, line_no, delimiter, line`` of all matching files in the archives under a path.

    ``min_depth = max_depth = 2`` reads archives within archives alone; ``limit``
    takes the first outer archives by path. One task holds one outer archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if limit is not None:
        first = files.select("path").orderBy("path").limit(limit)
        files = files.join(F.broadcast(first), "path", "left_semi")
    return archived_lines(files, pattern=pattern, min_depth=min_depth, max_depth=max_depth)


def archived_lines(files: DataFrame, *, pattern: str = r"\.csv$", min_depth: int = 1, max_depth: int = 8) -> DataFrame:
    """The same of archives in a table ``path, content``."""
    rows = files.lateralJoin(Unzip(F.col("path").outer(), F.col("content").outer(), F.lit(pattern), F.lit(min_depth), F.lit(max_depth)))
    return rows.select("source", "line_no", "delimiter", "line")


def csv_cells(line: str) -> F.Column:
    """The cells of a CSV record; quoted ones may hold the delimiter, doubled quotes and line breaks."""
    found = F.array().cast("array<string>")
    for mark in DELIMITERS:
        cell = re.escape(mark) + r'("(?:[^"]|"")*"|[^' + re.escape(mark) + "]*)"
        found = F.when(F.col("delimiter") == mark, F.regexp_extract_all(F.concat("delimiter", line), F.lit(cell), F.lit(1))).otherwise(found)
    quoted = r'^"(?:[^"]|"")*"$'
    return F.transform(found, lambda c: F.when(c.rlike(quoted), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def zipped_table(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of the zipped files, found by their headers, with ordinals of file and row.

    Files may have other columns and another order; what a file lacks is null.
    File ordinals follow the paths.
    """
    header = lines.filter("line_no = 0").select("source", F.transform(csv_cells("line"), lambda c: F.lower(F.trim(c))).alias("header"))
    files = header.withColumn("file_ord", F.rank().over(W.orderBy("source")) - 1)
    rows = lines.filter("line_no > 0").withColumn("cells", csv_cells("line")).join(files, "source")

    def cell(name: str) -> F.Column:
        at = F.array_position("header", F.lit(name.lower())).cast("int")
        return F.nullif(F.trim(F.try_element_at("cells", F.when(at > 0, at))), F.lit("")).alias(name)

    return rows.select(*[cell(c) for c in columns], "source", "file_ord", F.col("line_no").alias("row_ord"))
