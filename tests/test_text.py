import pytest
from pyspark.sql import functions as F

from quillmark.functions import passages as P
from quillmark.functions import text as T
from quillmark.operators import logs, qc


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, "A  line[3]\r\nof text.\r\n \r\n\r\nNext (*12) one[A].\n\n \n", T.clean_paragraphs) == "A line of text.\n\nNext one."
    assert one(spark, "exam-\nple and A-\nB", T.join_hyphenated) == "example and A-\nB"
    assert one(spark, "a \t b \n\n\n\n\nc\n", T.squeeze_white_space) == "a b\n\n\nc\n"
    assert one(spark, " x/y z! ", T.slug) == "x_y_z"


def test_tokens(spark):
    assert one(spark, "Don’t stop—it's a well-known café 😀.", T.words) == ["Don’t", "stop", "it's", "a", "well-known", "café"]
    assert one(spark, "The 12.5 dogs can't", T.ascii_tokens) == ["the", "12.5", "dogs", "can't"]
    assert one(spark, "One two. Three! … Four", T.sentence_lengths) == [2, 1, 1]
    assert one(spark, "aB  cd", lambda t: T.char_grams(t, 3)) == ["ab ", "b c", " cd"]
    assert one(spark, "a😀bc", lambda t: T.char_grams(t, 3)) == ["a😀b", "😀bc"]
    assert one(spark, "ab", lambda t: T.char_grams(t, 3)) == []


@pytest.mark.parametrize(("text", "seconds"), [("7.66s", 7.66), ("2m59.5s", 179.5), ("1h2m3s", 3723.0), ("250ms", 0.25), ("12", 12.0), ("soon", None)])
def test_durations(spark, text, seconds):
    assert one(spark, text, T.duration_seconds) == (pytest.approx(seconds) if seconds else None)


def test_empty_text_has_zero_measures(spark):
    row = spark.createDataFrame([("",)], "t string").select(F.col("t"), T.words("t").alias("w")).select(*(v.alias(k) for k, v in T.stylometry(F.col("t"), F.col("w")).items())).first()
    assert set(row) == {0.0}


def test_jaccard_of_empty_sets(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in rows.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_crops():
    text = "One, two; three. Four five!"
    assert P.crop_span(text, 5, "prefix") == (0, len(text))
    assert text[slice(*P.crop_span(text, 2, "prefix"))] == "One, two; "
    assert text[slice(*P.crop_span(text, 2, "suffix"))] == "Four five!"
    assert text[slice(*P.crop_span(text, 3, "middle"))] == "two; three. Four "
    assert P.crop_span(text, 6, "prefix") is None


def test_windows_do_not_overlap_and_keep_their_bounds():
    text = " ".join(f"{'Mr. ' if i % 7 == 0 else ''}Word{i} goes on and on here." for i in range(400))
    found = P.greedy_windows(text, 45, 65)
    assert found and all(45 <= n <= 65 for _, _, n in found)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert not any(text[:end].rstrip().endswith("Mr.") for _, end, _ in found)
    gapped = P.gapped_windows(text, 50, 40, 65, 20)
    assert gapped and all(n >= 40 for _, _, n in gapped) and all(a[1] <= b[0] for a, b in zip(gapped, gapped[1:]))


def test_brackets_and_offsets():
    assert P.bracket_spans("a [Illustration: b [c] d] e") == [(2, 25)]
    with pytest.raises(ValueError):
        P.bracket_spans("[Illustration")
    flat, places = P.flat_offsets("  a \n b\tcd ")
    assert flat == "a b cd" and places[0] == 2 and places[-1] == 9 and len(places) == len(flat)
    assert P.packed_parts([4, 4, 4, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_rewrite_qc(spark):
    ok = '{"request_id": "r", "rewritten_text": "one two three four"}'
    rows = [("r", ok, "stop", "m", "m", "x", 4), ("r", "no json", "stop", "m", "m", "x", 4), ("q", ok, "length", "n", "m", "x", 4), ("r", ok, "stop", "m", "m", "x", 5), ("r", '{"request_id": "r"}', "stop", "m", "m", "x", 4)]
    out = qc.rewrite_qc(spark.createDataFrame(rows, "request_id string, content string, finish_reason string, model string, requested_model string, source_sha256 string, original_words int")).collect()
    assert [r.qc_status for r in out] == ["pass", "fail", "fail", "warning", "fail"]
    assert "invalid_json" in out[1].qc_flags and "schema_mismatch" in out[4].qc_flags
    assert {"request_id_mismatch", "incomplete_generation", "returned_model_mismatch"} <= set(out[2].qc_flags)


def test_salvaged_json(spark):
    rows = ['{"rewritten_text": "a"}', 'Sure: {"rewritten_text": "b"} done', '```json\n{"rewritten_text": "c"}\n```', '{"passage_id": "p", "condition": "c", "rewritten_text": "loose "quote" here"}', "plain"]
    status, text = qc.salvage_json(F.col("t"))
    out = spark.createDataFrame([(r,) for r in rows], "t string").select(status.alias("s"), text.alias("x")).collect()
    assert [r.s for r in out] == ["json_ok", "json_extracted", "json_ok", "json_repaired_loose_rewritten_text", "json_parse_failed_used_raw_content"]
    assert [r.x for r in out] == ["a", "b", "c", 'loose "quote" here', "plain"]


def test_ratings(spark):
    rows = [(0, 0, 0, 0, 0, 5, "yes", ""), (1, 0, 0, 0, 0, 5, "yes", ""), (1, 0, 0, 0, 0, 2, "no", "why"), (7, 0, 0, 0, None, 5, "maybe", "")]
    out = qc.rating_errors(spark.createDataFrame(rows, "added_facts int, omitted_facts int, order_changed int, relationships_changed int, tone_drift int, meaning_preservation int, usable string, notes string")).collect()
    assert [sorted(r.errors) for r in out] == [[], ["note_required"], [], ["invalid_added_facts", "invalid_tone_drift", "invalid_usable"]]


def test_response_shapes(spark):
    bodies = [("messages", '{"status":"completed","model":"m","id":"1","output":[{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":"a"},{"type":"output_text","text":"b"}]}]}'), ("candidates", '{"modelVersion":"v","responseId":"2","candidates":[{"finishReason":"STOP","content":{"parts":[{"text":"t","thought":true},{"text":"c"}]}}]}'), ("chat", '{"model":"x","id":"3","choices":[{"finish_reason":"length","message":{"content":"d"}}]}')]
    out = spark.createDataFrame(bodies, "api string, body string").select(logs.response_view(F.col("api"), F.col("body")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in out] == [("ab", "stop", "m", "1"), ("c", "stop", "v", "2"), ("d", "length", "x", "3")]


def test_paragraph_issues(spark):
    rows = {"CHAPTER I. It began": "section_heading", "[Illustration: x]": "editorial_or_illustration", "[3] a note": "note_body", "A QUIET PLACE": "uppercase_heading_or_insert", "short\nlines\nhere": "verse_table_or_short_line_insert", "## 1234567890 @@ 1234567890 == 1234": "nonprose_or_cipher", "A plain sentence of prose.": ""}
    out = spark.createDataFrame([(k,) for k in rows], "t string").select("t", qc.paragraph_issue(F.col("t")).alias("i")).collect()
    assert {r.t: r.i for r in out} == rows
