import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators.commands import apply_filters, apply_in_force, commands_since, filters_in_force, normalize_commands
from quarryline.operators.dialog import digest_nothing, spoken_digest, transcripts
from quarryline.sources.versions import StoredTable
from quarryline.streaming.drops import stream_bronze, stream_commands, stream_filters


def test_transcripts(rows):
    turns = rows(
        [
            (1, 2, "human", "bye"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello\nthere"), (1, 3, "user", ""),
            (2, 0, "user", ""), (2, 1, "assistant", None), (3, 0, "system", "rules"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    found = {tuple(r) for r in transcripts(turns).collect()}
    assert found == {
        (1, 0, "You: hi\nAgent: hello\nthere\nYou: bye", 3),
        (2, 0, "_(empty transcript)_", 0),
        (3, 0, "Agent: rules", 1),
    }


def test_message_goes_before_text(rows):
    turns = rows([(1, 0, "user", "a", "b"), (1, 1, "user", "c", None)], "conv_id long, turn long, role string, text string, message string")
    assert transcripts(turns, message="message").first().transcript == "You: b\nYou: c"


def test_a_long_conversation_goes_on_in_parts(spark):
    turns = spark.range(9000).selectExpr(
        "if(id % 3 = 0, -1, id) as conv_id", "id as turn", "'user' as role", "string(id) as text"
    )
    parts = transcripts(turns, turns_per_part=500).filter("conv_id = -1").orderBy("part").collect()
    assert len(parts) == 6
    assert "\n".join(p.transcript for p in parts) == "\n".join(f"You: {i}" for i in range(0, 9000, 3))


def test_digest(rows):
    df = rows([("a", i, f"n{i}") for i in range(5)] + [("b", 1, None), (None, 9, "x")], "g string, n int, name string")
    found = {r.g: r.digest for r in spoken_digest(df, "g", ["name", "n"], [F.desc("n")], F.lit("Best.")).collect()}
    assert found == {
        "a": "Best. Top results: name n4, n 4; name n3, n 3; name n2, n 2. And 2 more.",
        "b": "Best. Top results: name null, n 1.",
        None: "Best. Top results: name x, n 9.",
    }
    single = {r.g: r.digest for r in spoken_digest(df, "g", ["n"], [F.desc("n")]).collect()}
    assert single["b"] == "The answer is 1." and single["a"].startswith("Top results: n 4; n 3; n 2.")
    assert digest_nothing("Best.") == "Best. No rows matched."


BODIES = [
    ({"command_type": "set_filter", "command_value": "Won"}, ("set_filter", "Stages", "Stage", "Won")),
    ({"action": "set_filter", "worksheet": "W", "field": "f", "value": "v"}, ("set_filter", "W", "f", "v")),
    ({"action": "clear"}, ("clear", "Stages", "Stage", None)),
    ({"parameters": {"worksheet": "W", "field": "f", "value": 7}}, ("set_filter", "W", "f", "7")),
    ({"parameters": {"action": "x", "field": ""}}, ("x", "Stages", "Stage", None)),
    (
        {"command_type": "t", "command_value": "flat", "action": "a", "parameters": {"value": "p"}},
        ("set_filter", "Stages", "Stage", "flat"),
    ),
    ({"command_type": "t", "action": "a", "value": "v"}, ("a", "Stages", "Stage", "v")),
    ({"parameters": "none"}, ("set_filter", "Stages", "Stage", None)),
    ({}, ("set_filter", "Stages", "Stage", None)),
]


def sent(rows, bodies):
    data = [(i, f"cmd_{i}", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return rows(data, "seq long, command_id string, body string")


def test_normalize(rows):
    found = normalize_commands(sent(rows, [b for b, _ in BODIES] + ["oops"])).orderBy("seq").collect()
    wanted = [("ok", *expected) for _, expected in BODIES] + [("not json", None, None, None, None)]
    assert [tuple(r)[2:] for r in found] == wanted
    assert [r.seq for r in found] == list(range(len(BODIES) + 1))


def test_since(rows):
    commands = normalize_commands(sent(rows, [{}, {}, {}]))
    assert [r.seq for r in commands_since(commands, "cmd_0").orderBy("seq").collect()] == [1, 2]
    assert commands_since(commands, "cmd_2").count() == 0
    assert commands_since(commands, "cmd_9").count() == 3
    odd = commands.withColumn("seq", F.when(F.col("seq") == 0, -5).when(F.col("seq") == 1, None).otherwise(F.col("seq")))
    assert commands_since(odd, "cmd_9").count() == 3
    assert {r.command_id for r in commands_since(odd, "cmd_0").collect()} == {"cmd_1", "cmd_2"}  # no seq: behind all others


def test_filters(rows):
    deals = rows([("Won", 1, "x"), ("Lost", 2, "x"), ("Won", 2, None)], "stage string, size int, note string")

    def command(field, value, worksheet="W", action="set_filter"):
        return {"action": action, "worksheet": worksheet, "field": field, "value": value}

    def left(*bodies, fields=None):
        found = apply_filters(deals, normalize_commands(sent(rows, list(bodies))), "W", fields)
        return {tuple(r) for r in found.collect()}

    everything = {tuple(r) for r in deals.collect()}
    assert left(command("stage", "Lost"), command("stage", "Won")) == {("Won", 1, "x"), ("Won", 2, None)}
    assert left(command("stage", "Won"), command("size", 2)) == {("Won", 2, None)}
    assert left(command("stage", "Nothing")) == set()
    assert left(command("stage", "Lost", worksheet="Other")) == everything
    assert left(command("stage", "Lost", action="clear")) == everything
    assert left(command("unknown", "Lost")) == everything
    assert left(command("stage", "Won"), command("size", 2), fields=["size"]) == {("Lost", 2, "x"), ("Won", 2, None)}


def test_filters_by_type_reach_the_scan(spark, rows, tmp_path):
    data = [(10.0, "2026-01-01", "a"), (7.0, "2026-01-02", "b"), (None, None, None)]
    rows(data, "n double, d string, t string").withColumn("d", F.col("d").cast("timestamp")).write.parquet(str(tmp_path / "t"))
    deals = spark.read.parquet(str(tmp_path / "t"))

    def left(field, value):
        body = {"action": "set_filter", "worksheet": "W", "field": field, "value": value}
        return apply_filters(deals, normalize_commands(sent(rows, [body])), "W")

    assert [r.t for r in left("n", "10").collect()] == ["a"]
    assert [r.t for r in left("D", "2026-01-02").collect()] == ["b"]
    assert left("n", "many").count() == 0
    assert "EqualTo(n,10.0)" in left("N", "10")._jdf.queryExecution().executedPlan().toString()


def test_transcripts_go_by_position(rows):
    turns = [(1, 9999, "user", "b"), (1, 10000, "user", "c"), (1, None, "user", "a"), (1, 9999, "human", "a"), (None, 1, "x", "q")]
    found = {r.conv_id: r for r in transcripts(rows(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1].transcript == "You: a\nYou: a\nYou: b\nYou: c" and (found[1].part, found[1].n_lines) == (0, 4)
    assert found[None].transcript == "Agent: q"


def test_a_stream_refuses_another_header(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text("id,qty\n1,10\n")
    arguments = (spark, str(drop), {"id": "INT", "qty": "INT"}, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    stream_bronze(*arguments)
    (drop / "b.csv").write_text("qty,id\n20,2\n")
    with pytest.raises(Exception, match="b.csv"):
        stream_bronze(*arguments)
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10)]


def test_stream_bronze(spark, tmp_path):
    drop, out, checkpoint = tmp_path / "drop", str(tmp_path / "bronze"), str(tmp_path / "checkpoint")
    drop.mkdir()
    types = {"id": "INT", "note": "VARCHAR(32)"}
    (drop / "a.csv").write_text('id,note\n1,"x\ny"\n,\n2,\n')
    stream_bronze(spark, str(drop), types, out, checkpoint, multi_line=True)
    (drop / "b.csv").write_text("id,note\n3,z\n")
    for _ in range(2):
        stream_bronze(spark, str(drop), types, out, checkpoint, multi_line=True)
    bronze = spark.read.parquet(out)
    assert {tuple(r) for r in bronze.select("id", "note", "_source").collect()} == {
        (1, "x\ny", "a.csv"), (2, None, "a.csv"), (3, "z", "b.csv"),
    }
    assert bronze.count() == 3 and bronze.filter("_ingested_at is null").count() == 0


def test_stream_commands(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()

    def post(name, *bodies):
        lines = [json.dumps({"seq": seq, "command_id": f"cmd_{seq}", "body": json.dumps(body)}) for seq, body in bodies]
        (inbox / name).write_text("\n".join(lines) + "\n")
        stream_commands(spark, str(inbox), out, checkpoint)

    post("1.json", (1, {"action": "set_filter", "field": "f", "value": "a"}), (2, {}))
    post("2.json", (3, {"parameters": {"value": "b"}}))
    found = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.seq, r.field, r.value) for r in found] == [(1, "f", "a"), (2, "Stage", None), (3, "Stage", "b")]


def test_streamed_filters_equal_the_batch_after_a_restart(spark, rows, tmp_path, monkeypatch):
    inbox, out, checkpoint = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    deals, posted = rows([("Won", 1), ("Lost", 2), ("Won", 2), (None, 3)], "stage string, size int"), []

    def post(name, *commands):
        posted.extend((seq, f"cmd_{seq}", json.dumps({"action": "set_filter", "worksheet": w, "field": f, "value": v})) for seq, w, f, v in commands)
        lines = [json.dumps(dict(zip(("seq", "command_id", "body"), p))) for p in posted[-len(commands) :]]
        (inbox / name).write_text("\n".join(lines) + "\n")

    def in_force():
        stream_filters(spark, str(inbox), out, checkpoint)
        sent_so_far = normalize_commands(rows(posted, "seq long, command_id string, body string"))
        found = StoredTable(spark, out).read()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, filters_in_force(sent_so_far).collect()))
        left = apply_in_force(deals, found, "W")
        assert sorted(map(repr, left.collect())) == sorted(map(repr, apply_filters(deals, sent_so_far, "W").collect()))
        return {(r.worksheet, r.field): r.value for r in found.collect()}

    post("1.json", (5, "W", "Stage", "Won"), (6, "V", "size", "2"))
    assert in_force() == {("W", "stage"): "Won", ("V", "size"): "2"}
    post("2.json", (3, "W", "stage", "Lost"), (5, "W", "Stage", "Won"), (7, "W", "SIZE", "2"))  # late, again, new
    with monkeypatch.context() as patch:
        patch.setattr(StoredTable, "replace", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            stream_filters(spark, str(inbox), out, checkpoint)
    assert in_force() == {("W", "stage"): "Won", ("V", "size"): "2", ("W", "size"): "2"}
    post("3.json", (8, "W", "stage", None), (9, "V", "size", "x"))
    assert in_force() == {("W", "stage"): None, ("V", "size"): "x", ("W", "size"): "2"}
    versions = StoredTable(spark, out).versions()
    stream_filters(spark, str(inbox), out, checkpoint)
    assert StoredTable(spark, out).versions() == versions  # nothing new, nothing done
