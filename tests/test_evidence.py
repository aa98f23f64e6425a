"""Literal cases of checks, places in texts, packets and connectors."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import spans as S
from quillmark.operators import evidence as E
from quillmark.sources import io as sources


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_anchors_must_stand_once(spark):
    text = "The  Start\nhere and the END of it"
    assert one(spark, text, lambda t: S.anchored(t, "the start")) == 0
    assert one(spark, text, lambda t: S.anchored(t, "the")) is None and one(spark, text, lambda t: S.anchored(t, "(x")) is None
    assert tuple(one(spark, text, lambda t: S.work_bounds(t, "Start here", "the end"))) == (5, 20)
    assert one(spark, "end then start", lambda t: S.work_bounds(t, "start", "end")) is None


def test_places(spark):
    assert tuple(one(spark, "abcdef", lambda t: S.context(t, F.lit(2), F.lit(4), 1))) == ("b", "cd", "e")
    assert one(spark, "abc", lambda t: S.context(t, F.lit(2), F.lit(4))) is None
    assert [one(spark, "one two three", lambda t, k=k: S.word_index(t, F.lit(k))) for k in (0, 1, 4, 5, 13)] == [0, 1, 1, 2, 3]


def test_packets_are_read_strictly(spark):
    assert one(spark, "a ```` b", S.fence) == "`````text\na ```` b\n`````\n"
    made = one(spark, "a `b`", lambda t: S.packet(F.lit(7), {"Original": t}, ["tone", "notes"]))
    assert "## Item 7" in made
    fields = ["tone", "notes"]
    assert one(spark, made.replace("tone: ", "tone: 2").replace("notes: ", "notes: fine: yes"), lambda t: S.answers(t, fields)) == {"tone": "2", "notes": "fine: yes"}
    assert one(spark, made.replace("tone: ", ""), lambda t: S.answers(t, fields)) is None
    assert one(spark, "tone: 2\nnotes: x", lambda t: S.answers(t, fields)) is None
    assert spark.createDataFrame([("a|b", None)], "x string, y int").select(S.markdown_row([F.col("x"), F.col("y")]).alias("r")).first().r == "| a\\|b |  |"


@pytest.mark.parametrize(("words", "sentences", "want"), [(449, 9, "candidate_fail_length"), (450, 4, "candidate_fail_low_sentence_count"), (650, 5, "candidate_pass_length"), (651, 5, "candidate_fail_length")])
def test_candidates(spark, words, sentences, want):
    assert spark.range(1).select(S.candidate_status(F.lit(words), F.lit(sentences)).alias("c")).first().c.status == want


def test_an_absent_author_is_not_estimable(spark):
    rows = spark.createDataFrame([("c", "a", "a", "a"), ("c", "b", "b", "a"), ("d", "a", "a", "b")], "condition string, author string, original string, rewrite string")
    labels = spark.createDataFrame([("a",), ("b",)], "author string")
    got = {r.condition: r for r in E.paired_sensitivity(rows, F.lit(True), ["condition"], labels, "all").collect()}
    assert got["c"].status == "estimable" and got["c"].original_macro_f1 == 1 and got["c"].rewrite_macro_f1 == pytest.approx(1 / 3) and got["c"].macro_f1_loss == pytest.approx(2 / 3)
    assert got["d"].status == "not_estimable" and got["d"].macro_f1_loss is None
    none = E.paired_sensitivity(rows, F.lit(False), ["condition"], labels, "none").collect()
    assert {(r.rows, r.status, r.original_macro_f1) for r in none} == {(0, "not_estimable", None)}


def test_refusals_without_outcome(spark):
    events = spark.createDataFrame([(1, 1, 10, 400, "content_filter"), (2, 1, 5, 400, "content_filter"), (3, 2, 1, 400, "other"), (4, 3, 1, 400, "content_filter"), (5, 9, 1, 400, "content_filter")], "event_id int, request_id int, timestamp int, http_status int, error_code string")
    requests, done = spark.createDataFrame([(1, 500), (2, 500), (3, 500)], "request_id int, original_words int"), spark.createDataFrame([(3,)], "request_id int")
    got = {r.request_id: (r.event_id, r.problem, r.rewritten_text, r.qc_status) for r in E.refusals(requests, events, done).collect()}
    assert got == {1: (2, None, "", "fail"), 9: (5, "unknown_request", "", "fail")}


def test_corrections_name_their_problems(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, text string")
    new = spark.createDataFrame([("1", "x", "r"), ("2", "b", "r"), ("3", "y", "r"), ("3", "z", "r"), ("8", "q", "r")], "id string, text string, reason string")
    got = {r.old_key: (r.id, r.text, r.problem) for r in E.corrected(rows, new, "id", F.concat("id", F.lit("'"))).collect()}
    assert got == {"1": ("1'", "x", None), "2": ("2'", "b", "not_changed"), "3": ("3'", "y", "replaced_twice"), "8": ("8'", "q", "unknown_target")}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as box:
        box.writestr("ok.json", "{}")
        box.writestr("other.txt", "x")
        box.writestr("../up", "x")
        box.writestr("big", "x" * 100)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "b.zip").write_bytes(b"no zip")
    at = whole.index(b"{}")
    (tmp_path / "c.zip").write_bytes(whole[:at] + b"[]" + whole[at + 2 :])
    got = {(r.path[-5:], r.member): r.problem for r in sources.read_zip(spark, str(tmp_path), ["ok.json", "absent"], 50).collect()}
    assert got == {("a.zip", "ok.json"): None, ("a.zip", "other.txt"): "unexpected", ("a.zip", "../up"): "unsafe", ("a.zip", "big"): "large", ("a.zip", "absent"): "missing", ("b.zip", None): "damaged"} | {
        ("c.zip", k): v for k, v in {"ok.json": "damaged", "other.txt": "unexpected", "../up": "unsafe", "big": "large", "absent": "missing"}.items()
    }


def test_json_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"k": 1}\r\n\n{"k": \n{"k": 2}\n[]\n')
    schema = spark.createDataFrame([], "k int").schema
    got = [(r.line, r.row and r.row.k, r.corrupt) for r in sources.numbered_jsonl(spark, str(tmp_path / "a.jsonl"), schema).orderBy("line").collect()]
    assert got[0] == (1, 1, None) and got[1] == (3, None, '{"k": ') and got[2] == (4, 2, None)
    sources.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")).strip() == '{"a":1,"b":null}'
