import json

import pytest

from quarryline.functions.cells import to_rectangular
from quarryline.sources.generate import Field, synthetic_rows, synthetic_table
from quarryline.sources.payloads import page_warnings, stitch_pages, unnest_json_tables
from quarryline.sources.uploads import label_source, plan_uploads

PAYLOADS = {
    "plain": ('{"columns": ["a", "b"], "rows": [["1", "2"]]}', [("ok", 0, ["a", "b"], ["1", "2"])]),
    "fenced with prose": (
        'Sure!\n```json\n{"columns": [" a ", "b"], "rows": [["1", "2"], ["3", "4"]]}\n```\nBye',
        [("ok", 0, ["a", "b"], ["1", "2"]), ("ok", 1, ["a", "b"], ["3", "4"])],
    ),
    "short and long rows": (
        '{"columns": ["a", "b"], "rows": [["1"], ["1", "2", "3"]]}',
        [("ok", 0, ["a", "b"], ["1", ""]), ("ok", 1, ["a", "b"], ["1", "2"])],
    ),
    "null cell, number, truth": (
        '{"columns": ["a", "b"], "rows": [[null, 2.50], [true, 7]]}',
        [("ok", 0, ["a", "b"], ["", "2.5"]), ("ok", 1, ["a", "b"], ["true", "7"])],
    ),
    "rows that are none": (
        '{"columns": ["a"], "rows": ["x", null, [], ["1"], {"y": 1}]}',
        [("ok", 0, ["a"], ["1"])],
    ),
    "no rows": ('{"columns": ["a"], "rows": []}', [("no tabular data", None, ["a"], None)]),
    "no columns": ('{"columns": [], "rows": [["1"]]}', [("no tabular data", None, [], None)]),
    "rows are text": ('{"columns": ["a"], "rows": "x"}', [("no tabular data", None, ["a"], None)]),
    "other object": ("{}", [("no tabular data", None, [], None)]),
    "not json": ("I could not find any.", [("not json", None, [], None)]),
    "two objects": ('{"columns": ["a"]} and {"rows": [["1"]]}', [("not json", None, [], None)]),
    "empty": ("", [("not json", None, [], None)]),
    "null": (None, [("not json", None, [], None)]),
}


@pytest.mark.parametrize("case", PAYLOADS)
def test_payload(rows, case):
    payload, expected = PAYLOADS[case]
    found = unnest_json_tables(rows([(1, payload)], "id int, payload string"), "payload", ["id"])
    assert [(r.status, r.row_no, r.columns, r.cells) for r in found.orderBy("row_no").collect()] == expected


def test_rectangular(rows):
    df = rows([(1, ["x", None, "z"]), (2, []), (3, None)], "id int, cells array<string>")
    found = to_rectangular(df, ["a", "b"], keep=("id",)).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "x", ""), (2, "", ""), (3, None, None)]


PAGE = "doc_id int, page int, columns array<string>, rows array<array<string>>"


def test_stitch(rows):
    pages = rows(
        [
            (1, 1, [], []),
            (1, 2, ["a", "b"], [["1", "2"]]),
            (1, 3, ["x", "y", "z"], [["3", "4", "5"], ["6"]]),
            (1, 4, [], [["7", None]]),
            (2, 1, ["q"], [["8"]]),
            (3, 1, [], [["lost"]]),
        ],
        PAGE,
    )
    found = [(r.doc_id, r.page, r.row_no, r.columns, r.cells) for r in stitch_pages(pages).collect()]
    assert sorted(found) == [
        (1, 2, 0, ["a", "b"], ["1", "2"]),
        (1, 3, 0, ["a", "b"], ["3", "4"]),
        (1, 3, 1, ["a", "b"], ["6", ""]),
        (1, 4, 0, ["a", "b"], ["7", ""]),
        (2, 1, 0, ["q"], ["8"]),
    ]
    assert {tuple(r) for r in page_warnings(pages).collect()} == {
        (1, 3, "page 3 had 3 columns vs 2"),
        (3, 0, "no table found on any page"),
    }


def test_one_document_may_own_most_pages(spark):
    pages = spark.range(6000).selectExpr(
        "if(id % 3 = 0, -1, id) as doc_id", "id as page", "array('a') as columns", "array(array(string(id))) as rows"
    )
    found = stitch_pages(pages)
    assert found.count() == 6000 and found.filter("doc_id = -1").count() == 2000


def test_upload_names(rows):
    files = [
        ("2026_q3_export_signups_v2.csv", "q3_export_signups"),
        ("20260701_signups_latest.csv", "signups"),
        ("Report-Invoices_final.pdf", "invoices"),
        ("2024.csv", "my_table"),
        ("signups.CSV", "signups"),
        ("copy of budget.csv", "budget"),
        ("x" * 60 + ".csv", "x" * 40),
        ("---.csv", "my_table"),
    ]
    found = {r.file_name: r for r in plan_uploads(rows([(f,) for f, _ in files], "file_name string")).collect()}
    assert {name: found[name].table_name for name, _ in files} == dict(files)
    assert found["signups.CSV"].clash and found["signups.CSV"].n_files == 2 and not found["copy of budget.csv"].clash


@pytest.mark.parametrize(
    "text, label",
    [
        ("20 fake customers", "synthetic"),
        ("Top 10 countries by GDP", "real"),
        ("customers", "ask"),
        ("fake but real", "ask"),
        ("population in 2026", "real"),
        ("éreal figures", "real"),
        ("unreal figures", "ask"),
        ("made-up names", "synthetic"),
    ],
)
def test_label_source(rows, text, label):
    assert label_source(rows([(text,)], "t string"), "t").first().source_label == label


def test_synthetic_rows_do_not_change(spark, rows):
    fields = [Field("kind", "choice", choices=("x", "y")), Field("n", "number", low=5, high=9)]
    requests = rows([(1, 25_000), (2, None), (3, 0)], "id long, n_rows long")
    made = synthetic_rows(requests, fields, "id", "n_rows")
    counts = {r["id"]: r["count"] for r in made.groupBy("id").count().collect()}
    assert counts == {1: 25_000, 2: 20}
    assert made.select("id", "row_no").distinct().count() == 25_020
    assert made.filter("n not between 5 and 9 or kind not in ('x', 'y')").count() == 0
    assert synthetic_table(spark, fields).count() == 20 and synthetic_table(spark, fields, 3).columns == ["kind", "n"]
    assert made.exceptAll(synthetic_rows(requests.repartition(3), fields, "id", "n_rows")).isEmpty()


def test_payload_as_sent_by_json_dumps(rows):
    body = {"columns": ["q\"uote", "line\nbreak"], "rows": [["a}b", "{c"], ["é", "```"]]}
    found = unnest_json_tables(rows([(1, json.dumps(body))], "id int, payload string"), "payload", ["id"])
    assert [r.cells for r in found.orderBy("row_no").collect()] == [["a}b", "{c"], ["é", ""]]


def test_long_payloads_are_read_whole(rows):
    body = {"columns": ["n", "text"], "rows": [[str(i), "{é} " * 50] for i in range(5000)]}
    reply = "words " * 50_000 + "```json\n" + json.dumps(body, ensure_ascii=False) + "\n```" + " words" * 50_000
    df = rows([(1, reply), (2, "{" * 300_000), (3, "}" * 300_000 + "{")], "id int, payload string")
    found = unnest_json_tables(df, "payload", ["id"])
    assert found.filter("id = 1").count() == 5000
    assert {r.status for r in found.filter("id > 1").collect()} == {"not json"}
    assert found.filter("id = 1 and (columns[0] <> 'n' or cells[1] <> repeat('{é} ', 50))").count() == 0
