"""Terms that give entities away are found across whole documents and marked wherever they stand."""

import random
import re
import time

import pyarrow as pa

from quillmark.llm import pii
from quillmark.llm.pii import find_pii


def spans_of(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in find_pii(made).orderBy("doc_id").collect()]


PLAIN = [f"the usual words of every text {i}" for i in range(300)]
FAR = " the usual words of every text" * 12


def test_a_term_far_from_an_entity_of_two_documents(spark):
    texts = [f"zörro{FAR} ann@x.org", f"the Zörro{FAR} ann@x.org zörro", *PLAIN]
    got = spans_of(spark, texts)
    at = texts[0].index("ann")
    assert got[0] == f"term:0:5,email:{at}:{at + 9}"
    at = texts[1].index("ann")
    assert got[1] == f"term:4:9,email:{at}:{at + 9},term:{at + 10}:{at + 15}"
    assert not any(got[2:])


def test_a_term_where_its_entity_is_absent(spark):
    texts = [f"é zorro {i}{FAR} ann@x.org" for i in range(6)] + ["日本 zorro stands here alone", *PLAIN]
    got = spans_of(spark, texts)
    assert all(x.startswith("term:0:1,term:2:7,email:") for x in got[:6]) and got[6] == "term:3:8" and not any(got[7:])


def test_entities_of_one_document_have_the_terms_of_their_class(spark):
    texts = [f"mailbox{FAR} a{i}@x.org" for i in range(4)] + PLAIN
    got = spans_of(spark, texts)
    assert all(x.startswith("term:0:7,email:") and x.count(":") == 4 for x in got[:4]) and not any(got[4:])


def test_words_beside_spans_equal_a_plain_search():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ä", "word", "ann@x.org", "10.0.0.1", "+49 30 1234 5678", "4111 1111 1111 1111", "x"]) for _ in range(n)) for n in (0, 1, 7, 60, 300)]
    spans = [[("k", a, min(len(t), a + rng.randint(1, 30))) for a in sorted(rng.sample(range(len(t)), min(len(t), 9)))] for t in texts]
    got = {}
    for row, hashes, start, end in pii.free_words(pa.array(texts), spans):
        got.setdefault(row, []).extend(zip(start.tolist(), end.tolist()))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [m.span() for m in re.finditer(r"\S+", t) if all(m.end() <= a or m.start() >= b for _, a, b in spans[i])]


def test_a_text_of_addresses_takes_time_in_proportion():
    text = " ".join(f"user{i}@example.org said" for i in range(200_000))
    began = time.process_time()
    (found,) = pii.free_words(pa.array([text]), [pii.base_spans(text)])
    assert len(found[1]) == 200_000 and time.process_time() - began < 30


def test_common_words_are_ruled_out_before_all_documents_are_counted(spark, monkeypatch):
    kept, keep = [], pii.keep_terms

    def noted(terms):
        kept.append(terms.select("term").distinct().count())
        return keep(terms)

    monkeypatch.setattr(pii, "keep_terms", noted)
    texts = [f"mailbox{FAR} a{i}@x.org" for i in range(4)] + PLAIN
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.entity for r in pii.disclosing(made).collect()} == {"email:"}
    assert kept[-1] == 1
