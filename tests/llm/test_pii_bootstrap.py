"""What operator 10 learns beyond its base patterns."""

import hashlib

import pytest

from fleetcases.llm import pii

SCHEMA = "doc_id long, text string"
FILL = "the letter went out and nobody asked why the harbour stayed quiet that morning"


def _hex(k, n=32):
    return hashlib.md5(str(k).encode()).hexdigest()[:n]


def _keys(spark, texts, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(parts)
    return [sorted(texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "key")
            for r in sorted(pii.span_lists(df).collect(), key=lambda r: r.doc_id)]


def _corpus():
    texts, want = [], []

    def add(text, *found):
        texts.append(f"{FILL} {text} {FILL}")
        want.append(sorted(found))
    for k in range(60):                                       # seeds and, in the same place, values without their shape
        add(f"password={_hex(k)} and", _hex(k))
    for k in range(12):
        add(f"password=hunter{k}22 or so", f"hunter{k}22")
        add(f'api_key="sk-proj-{_hex(k, 16)}" done', f"sk-proj-{_hex(k, 16)}")
        add(f'"secret": "tom_{k:03}.x", next', f"tom_{k:03}.x")     # no seed here: known by another pattern only
        add(f"password=tom_{k:03}.x again", f"tom_{k:03}.x")
        add(f"passport AB{1234567 + k} was", f"AB{1234567 + k}")
        add(f"password=AB{1234567 + k} was", f"AB{1234567 + k}")
        add(f"{_hex(k + 90)} credential is", _hex(k + 90))
        add(f"on page {100000 + 7 * k} and in 2023-01-{k + 10} or room: {300000 + k}")       # clean digits
        add(f"the u{k}@mail.example.org wrote, and the {200000 + k} followed")          # a common word learns nothing
    return texts, want


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


def test_patterns_of_all_sides_are_learned(spark, corpus):
    texts, want = corpus
    assert _keys(spark, texts) == want


def test_patterns_and_their_scores(spark, corpus):
    texts, _ = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = pii._found(docs, "doc_id", "text")
    base = found.filter(found.kind.isin(*pii.KINDS))
    got = {r.pattern: r for r in pii.learn_patterns(pii._contexts(found), base, docs.select("text")).collect()}
    sure = {p for p, r in got.items() if r.score >= pii.CONFIDENT}
    assert sure >= {"password=", 'api_key="', 'secret": "', "passport _", "_ credential"}
    assert not sure & {"page _", "in _", "_ and", "_ or", "room: ", "the _", "_ followed"}
    assert all(0 <= r.score < 1 for r in got.values())


def test_result_is_the_same_for_repeated_rows_and_partitions(spark, corpus):
    texts, want = corpus
    assert _keys(spark, texts + texts, 1) == want + want


def test_words_in_a_marked_place_speak_against_it(spark):
    texts = [f"note: {_hex(k)} end" for k in range(6)] + [f"note: word{'abcdefghijklmnopqrst'[k]} end" for k in range(20)]
    assert _keys(spark, texts) == [[]] * 26


def test_no_pattern_no_key(spark):
    assert _keys(spark, ["", "only words here", "a1 b2 c3", "token = \"" + _hex(1) + "\""]) == [[], [], [], []]
