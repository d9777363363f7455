import re
from urllib.parse import unquote

import pytest

from quarryline.sources.csv import clean_name, clean_names, csv_files, drop_empty_rows, export_snapshot, scan_csv


def scan(spark, tmp_path, text, **options):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    table = scan_csv(spark, str(path), **options)
    return table.columns, [tuple(r) for r in table.collect()]


CASES = {
    "quoted comma": ('name,notes\nAda,"loves x, y"\n', ["name", "notes"], [("Ada", "loves x, y")]),
    "escaped quote and newline": ('a,b\n1,"x ""y""\nz"\n', ["a", "b"], [("1", 'x "y"\nz')]),
    "byte order mark and CRLF": ("﻿a,b\r\n1,2\r\n", ["a", "b"], [("1", "2")]),
    "short and long row": ("a,b\n1\n2,3,4\n", ["a", "b"], [("1", None), ("2", "3")]),
    "all-empty row": ("a,b\n,\n1,2\n", ["a", "b"], [("1", "2")]),
    "leading digit": ("2024,x\n1,2\n", ["c_2024", "x"], [("1", "2")]),
    "blanks are kept": ("a,b\n 5, \n", ["a", "b"], [(" 5", " ")]),
    "mixed line ends": ('a,b\n1,2\r\n3,"4\r\n5"\n', ["a", "b"], [("1", "2"), ("3", "4\n5")]),
    "quoted empty": ('a,b\n"",2\n', ["a", "b"], [(None, "2")]),
    "old line ends": ("a,b\r1,2\r3,4\r", ["a", "b"], [("1", "2"), ("3", "4")]),
    "newline in header": ('"first\nname",b\n1,2\n', ["first_name", "b"], [("1", "2")]),
}


@pytest.mark.parametrize("case", CASES)
def test_scan(spark, tmp_path, case):
    text, columns, expected = CASES[case]
    assert scan(spark, tmp_path, text) == (columns, expected)


@pytest.mark.parametrize("text", ["My Col,My-Col\n1,2\n", "a,a\n1,2\n", "a,A\n1,2\n", 'a,""\n1,2\n'])
def test_bad_headers_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        scan(spark, tmp_path, text)


@pytest.mark.parametrize("text", ["a,b\n", "\n"])
def test_a_file_needs_data(spark, tmp_path, text):
    with pytest.raises(ValueError, match="at least one data row"):
        scan(spark, tmp_path, text)


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, str(tmp_path / "in")).collect()


def test_a_folder_is_one_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "2.csv").write_text('a,b\n3,"4\n5"\n')
    assert sorted(map(tuple, scan_csv(spark, str(tmp_path / "in")).collect())) == [("1", "2"), ("3", "4\n5")]


@pytest.mark.parametrize("note", ["plain", '"two\r\nlines"'])
def test_files_of_other_systems_go_together(spark, tmp_path, note):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_bytes(f"\ufeffa,b\r\n1,{note}\r\n".encode())
    (tmp_path / "in" / "2.csv").write_bytes(b"\xef\xbb\xbfa,b\n2,x\n")
    text = note.strip('"').replace("\r\n", "\n")
    assert sorted(map(tuple, scan_csv(spark, str(tmp_path / "in")).collect())) == [("1", text), ("2", "x")]


def test_clean_names():
    assert clean_name("  Unit Price (USD) ") == "Unit_Price_USD_"
    assert clean_names(["A b", "9"]) == ["A_b", "c_9"]


def test_drop_empty_rows(rows):
    df = rows([(1, None, None), (2, "x", None), (3, None, "y"), (4, "", None)], "id int, a string, b string")
    assert [r.id for r in drop_empty_rows(df, ["a", "b"]).collect()] == [2, 3, 4]


def test_export_reads_back(spark, rows, tmp_path):
    df = rows(
        [(1, 'say "hi", x\ny', 1.5, None), (2, " padded ", 1.0e10, "2026-07-01"), (3, None, 1.0e-5, None)],
        "id int, note string, amount double, day string",
    ).selectExpr("id", "note", "amount", "cast(day as timestamp_ntz) as day")
    export_snapshot(df, str(tmp_path / "out"))
    back = sorted(map(tuple, scan_csv(spark, str(tmp_path / "out")).collect()))
    assert back == [
        ("1", 'say "hi", x\ny', "1.5", None),
        ("2", " padded ", "10000000000.0", "2026-07-01 00:00:00"),
        ("3", None, "0.00001", None),
    ]


def test_export_limit_and_columns(spark, rows, tmp_path):
    df = rows([(i, i * 2) for i in range(50)], "a int, b int")
    export_snapshot(df, str(tmp_path / "out"), columns=["b"], limit=10)
    table = scan_csv(spark, str(tmp_path / "out"))
    assert table.columns == ["b"] and table.count() == 10


def test_one_stray_quote_costs_one_file(spark, tmp_path):
    """Ninety-nine plain files and one whose cell holds a line end, under a name that is no plain path."""
    folder = tmp_path / "drop [x] 100%"
    folder.mkdir()
    for i in range(99):
        (folder / f"f{i}.csv").write_text(f"id,note\n{i},plain {i}\n")
    (folder / "odd {1} é*.csv").write_text('id,note\n99,"two\r\nlines"\n100,"it said ""so"""\n')
    files = csv_files(spark, str(folder).replace("[", "\\[").replace("]", "\\]")).collect()
    assert len(files) == 100 and [unquote(f.file).rsplit("/", 1)[1] for f in files if f.spans_lines] == ["odd {1} é*.csv"]
    table = scan_csv(spark, str(folder).replace("[", "\\[").replace("]", "\\]"))
    found = {r.id: r.note for r in table.collect()}
    assert found == {str(i): f"plain {i}" for i in range(99)} | {"99": "two\nlines", "100": 'it said "so"'}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert sorted(re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan)) == ["1", "99"]


def test_files_of_both_sorts_must_agree_on_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n1,x\n")
    (tmp_path / "b.csv").write_text('id,text\n2,"a\nb"\n')
    with pytest.raises(Exception):
        scan_csv(spark, str(tmp_path)).collect()
