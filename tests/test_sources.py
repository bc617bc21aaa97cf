"""Files that were misread: other column orders, delimiters, quotes and line ends; types, amended files, settings."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import types as T

from voltloom.operators import linkage
from voltloom.sources import archives, config, sinks, tables
from voltloom.sources.store import BatchStore, keep_values


def save(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_every_file_has_its_own_dialect(spark, tmp_path):
    path = save(tmp_path, a__csv="name,mw\nA,1\n", b__csv="mw,name\n2,B\n", c__csv="\ufeffname;mw;extra\n\"C;c\";3;x\n", d__csv="", e__csv='"name, full"|mw\nE|5\n')
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"mw\tname\n6\tF\n"))
    rows = tables.read_csv(spark, path)
    assert rows.columns == ["name", "mw", "extra", "name, full"]
    got = sorted(((r["name"] or "", r["mw"], r["extra"], r["name, full"]) for r in rows.collect()), key=lambda r: r[1])
    assert got == [("A", "1", None, None), ("B", "2", None, None), ("C;c", "3", "x", None), ("", "5", None, "E"), ("F", "6", None, None)]
    schema = T.StructType([T.StructField("mw", T.DoubleType()), T.StructField("none", T.StringType()), T.StructField("name", T.StringType())])
    typed = tables.read_csv(spark, path, schema=schema)
    assert typed.schema == schema and sorted(r["mw"] for r in typed.collect()) == [1.0, 2.0, 3.0, 5.0, 6.0]
    named = tables.read_csv(spark, path + "/[abc].csv", required={"Name": ["name"], "mw": []})
    assert sorted(r["Name"] for r in named.collect()) == ["A", "B", "C;c"]


def test_headers_with_quotes_repeats_and_line_breaks(spark, tmp_path):
    path = save(tmp_path, a__csv='"first\nname",x,x,\n1,2,3,4\n')
    assert tables.first_records(spark, f"{path}/a.csv", 5) == (",", [["first\nname", "x", "x", ""], ["1", "2", "3", "4"]])
    assert tables.read_csv(spark, path, multiLine="true").columns == ["first\nname", "x", "x.1", "column_3"]


def test_zipped_records_end_at_line_breaks_outside_quotes(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.csv", "name,fuel,mw\r\nCaf\xe9\x85 plant,GAS,5\r\n\"X\nY\",GAS,5\r\n".encode("latin-1"))
        z.writestr("b.csv", '"name, full"|fuel|mw\nB\u2028b|SUN|1\n"q""|uote"|WIND|2\n5" pipe|GAS|3\n')
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    got = archives.zipped_table(archives.zipped_lines(spark, str(tmp_path)), ["name", "name, full", "fuel", "mw"]).collect()
    assert {(r["name"], r["name, full"], r["fuel"], r["mw"]) for r in got} == {("Caf\xe9\x85 plant", None, "GAS", "5"), ("X\nY", None, "GAS", "5"), (None, "B\u2028b", "SUN", "1"), (None, 'q"|uote', "WIND", "2"), (None, '5" pipe', "GAS", "3")}


def test_types_widen_over_files_and_mismatches_are_reported(spark, tmp_path):
    path = save(tmp_path, a__csv="k,n,x,s,b\n1,1,1,1,true\n2,2,2,2,false\n", b__csv="x,k,s,n,b\n2.5,3,y,-7,TRUE\n", c__csv="k,n\n4,\n5,6\n6,late\n")
    assert tables.infer_types(spark, path, window=2) == {"k": "bigint", "n": "bigint", "x": "double", "s": "string", "b": "boolean"}
    rows = {r["k"]: r for r in tables.read_typed(spark, path, window=2).collect()}
    assert (rows[3]["x"], rows[3]["s"], rows[3]["n"], rows[1]["x"], rows[2]["b"]) == (2.5, "y", -7, 1.0, False)
    assert rows[6]["n"] is None and {k: r["mismatched"] for k, r in rows.items() if r["mismatched"]} == {6: ["n"]}


def test_amended_files_are_swapped_in_one_by_one(spark, tmp_path):
    path = save(tmp_path, a__csv="id,name,w\n1,A,x\n2,B,y\n", b__csv="w;id;name\nz;3;C\n")
    lookup = spark.createDataFrame([("A", "GAS"), ("C", "SUN")], "name string, fuel string")
    assert sinks.amend_files(lookup, path, "name", "fuel", after="name") == 2
    assert (tmp_path / "a.csv").read_text().splitlines() == ["id,name,fuel,w", "1,A,GAS,x", "2,B,,y"]
    assert (tmp_path / "b.csv").read_text().splitlines() == ["w;id;name;fuel", "z;3;C;SUN"]
    broken = lookup.selectExpr("name", "raise_error('broken') as fuel")
    with pytest.raises(Exception, match="broken"):
        sinks.amend_files(broken, path, "name", "fuel")
    assert (tmp_path / "a.csv").read_text().splitlines()[1] == "1,A,GAS,x" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.csv", "b.csv"]
    sinks.amend_files(lookup, f"{path}/a.csv", "name", "fuel", suffix="_amended")
    assert (tmp_path / "a_amended.csv").exists()


def test_settings_and_summary(spark, tmp_path):
    text = "# note\nexport INPUTS='/a, /b'\nON_CONFLICT=\"overwrite\"\nMAX_DEPTH=2\n\nnothing\nX_KEY=1"
    made = config.Settings.of(config.parse_env(text))
    assert (made.inputs, made.policy, made.max_depth, made.extra, made.values) == (("/a", "/b"), "overwrite", 2, {"X_KEY": "1"}, ("Base Point",))
    with pytest.raises(ValueError, match="ON_CONFLICT"):
        config.Settings.of({"ON_CONFLICT": "drop"})
    sinks.write_summary(spark.createDataFrame([(1, None, "x")], "a int, b int, c string"), str(tmp_path / "s"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "s")).collect()] == [{"a": 1, "c": "x"}]


def test_price_exports_and_named_files(spark, tmp_path):
    row = ",".join(str(k) for k in range(len(tables.PRICE_COLUMNS)))
    path = save(tmp_path, p1__csv=",".join(tables.PRICE_COLUMNS) + f"\n{row}\n", p2__csv=row + "\n")
    assert [r["OBJECTID"] for r in tables.read_price_exports(spark, path).collect()] == ["2", "2"]
    folder = tmp_path / "steps"
    folder.mkdir()
    named = tables.read_named(spark, save(folder, **{"mw_1__csv": "a,b\n1,2\n", "mw_2__csv": "b;a\n4;3\n", "other__csv": "a\n9\n"}), r"mw_(\d+)", "step")
    assert sorted((r["a"], r["b"], r["step"]) for r in named.collect()) == [("1", "2", 1), ("3", "4", 2)]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>mw</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row><c r="C3"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Al</t></r><r><t>pha</t></r></si></sst>")
    assert [tuple(r) for r in tables.read_workbook(spark, str(tmp_path), ["mw", "name", "none"]).collect()] == [("2.5", "Alpha", None), ("3", None, None)]


def test_storage_and_lifecycle(spark):
    from pyspark.sql import functions as F

    matches = spark.createDataFrame([("p", "OLD", "PWRSTR"), ("q", "Q", "GAS"), ("r", "R", "PWRSTR")], "plant string, name string, kind string")
    resources = spark.createDataFrame([("p", "N1", "ESR", 1, 5.0), ("p", "N2", "ESR", 2, None), ("q", "N3", "ESR", 9, 1.0)], "plant string, name string, kind string, score int, base double")
    got = {r["plant"]: (r["name"], r["kind"], r["alternative"]) for r in linkage.prefer_storage(matches, resources, plant="plant", name="name", kind="kind", score="score", base="base").collect()}
    assert got == {"p": ("N2", "ESR", "OLD"), "q": ("Q", "GAS", None), "r": ("R", "PWRSTR", None)}
    state = linkage.lifecycle([(F.col("name") == "OLD", "Cancelled"), (F.col("kind") == "PWRSTR", "Planned")])
    assert [r[0] for r in matches.select(state).collect()] == ["Cancelled", "Operating", "Planned"]


def test_batches_are_written_once_and_merged_when_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store = BatchStore(spark, path, keep_values(["k"], "v"), compact_after=3)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v double")
    values = lambda s, v=None: {r["k"]: r["v"] for r in s.read(v).collect()}
    with pytest.raises(ValueError, match="no batch"):
        store.read()
    first = store.append(rows(("a", 1.0), ("b", None), (None, 7.0)), 0)
    size = sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    second = store.append(rows(("a", 9.0), ("b", 2.0)), 1)
    assert values(store) == {"a": 1.0, "b": 2.0, None: 7.0}
    assert values(BatchStore(spark, path, keep_values(["k"], "v", "overwrite"))) == {"a": 9.0, "b": 2.0, None: 7.0}
    # a batch writes its own rows only, and counts once
    assert sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet")) < 2.5 * size
    assert store.append(rows(("c", 5.0)), 1) == second and "c" not in values(store)
    store.append(rows(("c", 5.0)), 0, source="other")
    store.append(rows(("b", 3.0), ("d", 4.0)), 2)
    assert values(store) == {"a": 1.0, "b": 2.0, None: 7.0, "c": 5.0, "d": 4.0}
    assert store.manifest()["base"] and not store.manifest()["parts"]  # compacted by now
    assert values(store, first) == {"a": 1.0, "b": None, None: 7.0}  # older versions stay readable
    store.append(rows(("e", 6.0)), 3)
    store.vacuum()
    assert values(store) == {"a": 1.0, "b": 2.0, None: 7.0, "c": 5.0, "d": 4.0, "e": 6.0} and len(store.versions()) == 1


def test_lost_rows_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", None)], "n string, v int")
    kept, counts = sinks.required(rows, "lost", ["n", "v"], blank=True)
    sinks.write(kept, str(tmp_path / "out"))
    assert counts.get == {"rows": 4, "lacks_0": 2, "lacks_1": 1} and spark.read.parquet(str(tmp_path / "out")).count() == 1
