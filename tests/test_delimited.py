"""Reading messy text files, and the cleaned CSV sink."""

import datetime as dt

import pytest

from profila import DataLoadError, load_csv
from profila.plans import views
from profila.plans.report import build_report
from profila.sources.cleaned import preview, write_cleaned_csv
from profila.sources.delimited import clean_headers, detect_layout, line_shapes, steadiest

MESSY = {
    "latin1.csv": "name,city,score\nJosé,São Paulo,5\nRené,Zürich,7\nAna,Köln,9\n".encode("latin-1"),
    "windows.csv": "name;price\nMüller;€5\n“Q”;€7\n".encode("cp1252"),
    "undefined.csv": b"a,b\nx\x81y,1\nz,2\n",
    "utf8_bom.csv": "a,b\n1,x\n".encode("utf-8-sig"),
    "utf16.txt": "a\tb\n1\tx\n2\ty\n3\tz\n".encode("utf-16"),
    "decimal.csv": b"name;val\nA;1,5\nB;2,5\nC;3,75\n",
    "bad_rows.csv": b"a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12\n",
    "no_header.csv": b"1,2,3\n4,5,6\n7,8,9\n",
    "currency.csv": "item,price\nA,\"₹1,200\"\nB,$300\nC,450\nD,(50)\n".encode(),
    "timezones.csv": b"ts,v\n2024-01-01T10:00:00Z,1\n2024-01-02T11:00:00+05:30,2\n2024-01-03T12:00:00Z,3\n",
    "markers.csv": b"a,b\n1,NA\n2,?\n3,-\n4,5\n",
    "quoted.csv": b'id,words\n1,"two\nlines, one ""cell"""\n2,plain\n',
    "blanks.csv": b"a,b,c\n 1 ,  x ,\n\n,,\n2,y\xc2\xa0,\n   \n3,z,--\n",
    "only.tsv": b"a,b\tc\n1,5\t2\n",
    "dates.csv": b"d,n\n" + b"".join(b"%02d/03/2024,%d\n" % (i, i * i) for i in range(1, 13)),
}


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("messy")
    done = {}

    def loaded(name):
        if name not in done:
            path = folder / name
            path.write_bytes(MESSY[name])
            done[name] = load_csv(spark, str(path))
        return done[name]

    return loaded


def rows(ds):
    return [tuple(r)[1:] for r in ds.table.orderBy("_row").collect()]


def report(ds):
    return ds.load_report.first()


@pytest.mark.parametrize("name, encoding, first", [
    ("latin1.csv", "Windows-1252", ("José", "São Paulo", 5.0)),
    ("windows.csv", "Windows-1252", ("Müller", 5.0)),
    ("undefined.csv", "Latin-1", ("x\x81y", 1.0)),
    ("utf8_bom.csv", "UTF-8", (1.0, "x")),
    ("utf16.txt", "UTF-16", (1.0, "x")),
])
def test_encodings(load, name, encoding, first):
    ds = load(name)
    assert report(ds)["encoding"] == encoding
    assert rows(ds)[0] == first
    if name == "windows.csv":
        assert rows(ds)[1] == ("“Q”", 7.0)


def test_decimal_comma(load):
    ds = load("decimal.csv")
    assert rows(ds) == [("A", 1.5), ("B", 2.5), ("C", 3.75)]
    assert report(ds)["delimiter"] == "semicolon"
    assert report(ds)["notes"] == ["Commas were read as decimal separators (e.g. 3,5 = 3.5)."]


def test_malformed_rows_are_skipped_and_short_ones_kept(load):
    ds = load("bad_rows.csv")
    assert rows(ds) == [(1.0, 2.0, 3.0), (4.0, 5.0, None), (10.0, 11.0, 12.0)]
    assert report(ds)["skipped_rows"] == 1 and report(ds)["rows_read"] == 3


def test_headerless(load):
    ds = load("no_header.csv")
    assert ds.names() == ["column_1", "column_2", "column_3"] and ds.rows == 3
    assert report(ds)["header_generated"]


def test_currency(load):
    ds = load("currency.csv")
    assert [r[1] for r in rows(ds)] == [1200.0, 300.0, 450.0, -50.0]
    assert ds.column("price").notes == ["Currency or % symbols were removed to read the numbers."]


def test_zones_become_utc(load):
    ds = load("timezones.csv")
    assert [r[0] for r in rows(ds)] == [
        dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 5, 30), dt.datetime(2024, 1, 3, 12)]
    assert ds.column("ts").date_format == "auto-detected"


def test_missing_markers(load):
    b = load("markers.csv").column("b")
    assert (b.type, b.missing, b.non_null) == ("numeric", 3, 1)


def test_quoted_line_breaks(load):
    assert rows(load("quoted.csv")) == [(1.0, 'two\nlines, one "cell"'), (2.0, "plain")]


def test_blanks_empty_rows_and_columns(load):
    ds = load("blanks.csv")
    r = report(ds)
    assert rows(ds) == [(1.0, "x"), (2.0, "y"), (3.0, "z")]
    assert (r["empty_rows_removed"], r["empty_columns_removed"], r["rows_read"]) == (1, ["c"], 4)
    # leading blanks go while parsing; " 1 " keeps its trailing one, "y" a no-break space
    assert ds.column("a").whitespace_fixed == 1 and ds.column("b").whitespace_fixed == 2
    # the removed row keeps its number
    assert [x["_row"] for x in ds.table.orderBy("_row").collect()] == [1, 3, 4]


def test_tsv_forces_tab(load):
    assert load("only.tsv").names() == ["a,b", "c"]


def test_ambiguous_dates(load):
    d = load("dates.csv").column("d")
    assert d.date_format == "%d/%m/%Y" and d.max_date == dt.datetime(2024, 3, 12)
    assert d.notes == ["Day and month order is ambiguous in this column; it was read as day/month/year."]


@pytest.mark.parametrize("content, words", [
    (b"", "The file is empty."), (b"\n  \n", "The file is empty."), (b"a,b,c\n", "does not contain any data rows"),
    (b"PK\x03\x04xx", "Excel"), (b"a\x00b\x00" * 20, "binary"),
])
def test_rejected(spark, tmp_path, content, words):
    path = tmp_path / "bad.csv"
    path.write_bytes(content)
    with pytest.raises(DataLoadError, match=words):
        load_csv(spark, str(path))


def test_rows_are_numbered_over_file_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("n,s\n" + "".join(f"{i},s{i % 7}{',extra' if i % 100 == 50 else ''}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ds = load_csv(spark, str(path))
        got = [(r["_row"], r["n"]) for r in ds.table.orderBy("_row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [i for i in range(20_000) if i % 100 != 50]
    assert got == [(k + 1, float(i)) for k, i in enumerate(want)]


def test_cleaned_csv(spark, load, tmp_path):
    ds = load("dates.csv")
    doubled = type(ds)("dates.csv", ds.table.unionByName(ds.table.selectExpr("_row + 12 as _row", "d", "n")),
                       ds.columns, 24, ds.load_report)
    target = write_cleaned_csv(doubled, str(tmp_path), remove_duplicates=True)
    assert target.endswith("dates_cleaned.csv")
    lines = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("*/part-*.csv"))).decode("utf-8").splitlines()
    assert lines[0] == "﻿d,n" and lines[1] == "2024-03-01,1.0"
    assert [x for x in lines if not x.startswith("﻿")] == [f"2024-03-{i:02d},{i * i}.0" for i in range(1, 13)]
    again = load_csv(spark, target)
    assert again.rows == 12 and again.names() == ["d", "n"]


def test_preview(load):
    shown = [tuple(r)[1:] for r in preview(load("timezones.csv"), 2).collect()]
    assert shown == [("2024-01-01 10:00", "1"), ("2024-01-02 05:30", "2")]


def test_headers():
    assert clean_headers(["a", " a", "", "Unnamed: 3", "nan", "x \n y", "a", "a"]) == [
        "a", "a_2", "column_3", "column_4", "column_5", "x y", "a.1", "a.2"]


def test_delimiters(spark):
    def found(*lines):
        return steadiest(line_shapes(spark.createDataFrame([(x,) for x in lines], "value string")))

    assert found("a;b;c", "1,5;2;3") == ";"
    assert found('"x,y"|2', "a|b") == "|"
    assert found("word", "other") == ","
    assert found(*["a,b,c,d;1"] * 200, *[f"note {i};{i}" for i in range(300)]) == ";"


def test_late_decimal_comma(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a;b\n" + "".join(f"x;{i}\n" for i in range(80)) + "y;119,5\nz;Smith, John\n")
    ds = load_csv(spark, str(path))
    assert ds.table.where("a = 'y'").first()["b"] == 119.5
    path = tmp_path / "thousands.csv"
    path.write_text("a;b\n" + "".join(f"x;1,{i:03d}.5\n" for i in range(80)) + "y;1,000\n")
    assert load_csv(spark, str(path)).table.where("a = 'y'").first()["b"] == 1000.0


def test_odd_headers(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("S.No,price.usd,a,a,A,b`t,x.y.z\n" + "".join(f"{i},{i * i % 37 * 2},{i * 5 % 17},{i * 7 % 23},{-i % 13},t{i % 3},d\n" for i in range(1, 40)))
    ds = load_csv(spark, str(path))
    assert [c.name for c in ds.columns] == ["S.No", "price.usd", "a", "a.1", "A", "b`t", "x.y.z"]
    report = build_report(ds)
    assert report["statistics"].where("column = 'price.usd'").first()["max"] == 72.0
    assert views.crosstab(ds, "b`t", "x.y.z").test().first()["n"] == 39
    assert views.scatter_matrix(ds, ["price.usd", "a.1", "A"]).count() == 39
    assert preview(ds).columns[1] == "S.No"
    assert write_cleaned_csv(ds, str(tmp_path), remove_duplicates=True)


def test_layout_looks_at_the_head_only_once(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b"a,b\n1,2\n")
    assert detect_layout(spark, str(path)).names == ["a", "b"]
