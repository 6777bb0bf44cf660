import itertools

import numpy as np
import pytest

from loomgraph.llm import pii, pii_table


@pytest.fixture(scope="module")
def crf():
    return pii.trained()


def score(crf, table):
    hit = wrong = missed = 0
    for (_, spans), got in zip(table, pii.entities(crf, [t for t, _ in table])):
        a, b = set(spans), set(got)
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    return hit / (hit + wrong), hit / (hit + missed)


def found(crf, text):
    return {(k, text[a:b]) for a, b, k in pii.entities(crf, [text])[0]}


def test_held_out_fillers(crf):
    precision, recall = score(crf, pii_table.rows(500, seed=77))
    assert precision > 0.98 and recall > 0.98


def test_held_out_frames():
    """Neither the frames of a fold nor its fillers were seen in training."""
    crf = pii.Crf().fit(pii_table.rows(3000, fold=1))
    precision, recall = score(crf, pii_table.rows(500, seed=78, fold=1, held=True))
    assert precision > 0.85 and recall > 0.85


def test_decoding_is_the_best_path(crf):
    text = "Ask Bo Li."
    cut = pii.tokens([text])
    em = crf.scores(cut)[cut.text >= 0]
    n = len(em)
    score = lambda y: sum(em[i, k] for i, k in enumerate(y)) + sum(crf.trans[a, b] for a, b in zip((0, *y), y))
    best = max(itertools.product(range(pii.L), repeat=n), key=score)
    assert np.isclose(score(best), score(crf.label(cut, 1e9)[cut.text >= 0].tolist()), atol=1e-3)


def test_stretches_lose_nothing(crf):
    texts = [t for t, _ in pii_table.rows(400, seed=79)]
    texts.append(" ".join(texts[:200]))
    assert pii.entities(crf, texts) == pii.entities(crf, texts, slack=1e9)


def test_tokens_are_those_of_the_pattern():
    import regex

    text = "Jiří O’Connor-X4\n\n 12a_b́ +1\x00z 😀é"
    cut = pii.tokens(["", text, "x"])
    own = cut.text == 1
    want = [(m.start(), m.end()) for m in regex.finditer(r"(?:\p{L}|\p{M})+|\d+|[^\s]", text)]
    assert list(zip(cut.start[own].tolist(), cut.end[own].tolist())) == want
    assert (cut.text == 2).sum() == 1 and (cut.text == 0).sum() == 0


def test_forms_outside_the_frames(crf):
    assert found(crf, "The invoice was signed by Sarah Johnson and Miguel Ángel Torres on Friday.") == {("person_name", "Sarah Johnson"), ("person_name", "Miguel Ángel Torres")}
    assert found(crf, "My SSN is 123456789") == {("identity_number", "123456789")}
    assert found(crf, "my passport number is AB1234567") == {("identity_number", "AB1234567")}
    assert found(crf, "He lives at 221B Baker Street, London NW1 6XE") == {("street_address", "221B Baker Street, London NW1 6XE")}
    assert found(crf, "call +1 (415) 555-2671 today") == {("phone", "+1 (415) 555-2671")}
    assert found(crf, "write to john.doe+tag@sub.example.co.uk please") == {("email", "john.doe+tag@sub.example.co.uk")}
    assert found(crf, "My IBAN is long") == set()
    assert found(crf, "seen by Jiří Šimůnek and Seán O’Connor") == {("person_name", "Jiří Šimůnek"), ("person_name", "Seán O’Connor")}
    assert found(crf, "Сергей Иванов ответил") == {("person_name", "Сергей Иванов")}
    assert found(crf, "Tax id AB-1234-5") == {("identity_number", "AB-1234-5")}
    assert found(crf, "jdoe AT example DOT com or jdoe (AT) example.com") == {("email", "jdoe AT example DOT com"), ("email", "jdoe (AT) example.com")}


def test_known_forms(crf):
    text = "Mail Ada Lindqvist (ada.lindqvist [at] mail.example.com) about it.\nOur number is +44 7700 900321 until noon. A seed row holds 912-45-6789 as tax number. Bring the token to 12 Oakmoor Road, Apt 4, Westbay 00012, care of B. Kovacs."
    assert found(crf, text) == {("person_name", "Ada Lindqvist"), ("email", "ada.lindqvist [at] mail.example.com"), ("phone", "+44 7700 900321"), ("identity_number", "912-45-6789"), ("street_address", "12 Oakmoor Road, Apt 4, Westbay 00012"), ("person_name", "B. Kovacs")}


def test_plain_and_odd_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "git@git.example.net:a/b.git and image@sha256:0881ff", 0), (4, "word " * 60_000 + "Just dial 332-555-0151 before noon.", 0), (None, "Just dial 332-555-0151", 0), (5, "\n\n @ \x00", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type int")
    got = pii.find_pii(df).collect()
    assert [(x["doc_id"], x["pii_type"], x["pii_text"]) for x in got] == [(4, "phone", "332-555-0151")]
    shown = {x["doc_id"]: x["text"] for x in pii.redact_pii(df).collect()}
    assert shown[1] is None and shown[2] == "" and shown[3] == rows[2][1] and shown[4].endswith("Just dial [PHONE] before noon.")
    assert pii.find_pii(df.limit(0)).count() == 0
