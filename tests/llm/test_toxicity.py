"""Spelling, the risk, and held-out accuracy on the reviewed texts."""

import os

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import toxicity as T

REVIEWS = "/root/testdata/sf0.001/review_samples.parquet"


@pytest.mark.parametrize(
    "text, want",
    [
        ("You p1g!", "you pig!"),
        ("H-A-R-D-C-O-R-E now", "spelledout hardcore now"),
        ("un c a b r ó n, todos", "un spelledout cabron, todos"),
        ("n@k3d and c@brón", "naked and cabron"),
        ("sс​um", "scum"),
        ("Wi?chse?r", "wichser"),
        ("you b*****d", "you maskedword maskedbd"),
        ("soooo baaaad", "so bad"),
        ("в 1995 году", "в 1995 году"),
        ("", ""),
    ],
)
def test_common_spelling(text, want):
    assert T.plain(text) == want


def test_passages():
    assert T.passages("") == T.passages(" \n ") == []
    assert T.passages("One two. Three four!\nfive") == [["one", "two"], ["three", "four"], ["five"]]
    assert [len(p) for p in T.passages("aa bb " * 50)] == [40, 40, 20]


def worst(model, text):
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["_text"])
    return next(T._score_lists(model)(T._passage_lists(iter([batch])))).column("score")[0].as_py()


def test_all_of_a_long_run_of_letters_counts():
    weights = np.zeros(T.DIM)
    for c in T.word_codes("stupidpig")[3:-1]:
        weights[c & (T.DIM - 1)] = 2.0
    model = T.Model(weights, 0.0)
    clean = "abcdefghij" * 8
    assert worst(model, clean) < T.THRESHOLD
    for at in range(0, len(clean) + 1, 5):
        assert worst(model, clean[:at] + "stupidpig" + clean[at:]) > T.THRESHOLD


def test_a_phrase_counts_wherever_it_lies_in_a_long_passage():
    phrase = "you are one of them so go away".split()
    codes = np.array([T.word_codes(w)[0] for w in phrase], np.int64)
    weights = np.zeros(T.DIM)
    weights[T._pairs(codes)] = 1.0
    model = T.Model(weights, 0.0)
    scores = {round(worst(model, " ".join(["filler"] * at + phrase + ["filler"] * (90 - at))), 6) for at in range(0, 60)}
    assert len(scores) == 1 and min(scores) > T.THRESHOLD


def test_swapped_letters_share_a_key():
    assert T.word_codes("porn")[1] == T.word_codes("ponr")[1] != T.word_codes("pore")[1]


def test_scorer_agrees_with_the_features():
    rng = np.random.default_rng(0)
    m = T.Model(rng.normal(size=T.DIM), 0.3)
    rows = [["one", "two", "three"], ["x"], ["12", "ab", "ab"], ["a" * 100, "word"]]
    x = T.Features(rows)
    assert np.allclose(m.scorer()(rows), x.margins(m.weights) + m.bias)
    d, w = rng.normal(size=len(rows)), rng.normal(size=T.DIM)
    assert np.isclose(x.gradient(d) @ w, x.margins(w) @ d)
    assert len(m.scorer()([])) == 0


def test_unlabelled_positives_keep_a_high_score():
    pos = [f"you are a nasty zorg number {i}" for i in range(40)]
    hidden = [f"what a nasty zorg {i} you are" for i in range(10)]
    plain = [f"the garden near {w} was painted on day {i}" for i, w in enumerate("abcdefghij" * 40)]
    model = T.fit(pos, [], [(p, 1) for t in hidden + plain for p in T.passages(t)], prior=0.1)
    s = model.scorer()
    assert s([p for t in hidden for p in T.passages(t)]).min() > s([p for t in plain for p in T.passages(t)]).max()
    with pytest.raises(ValueError):
        T.fit([], [], [])


def test_sure_passages_join_until_none_is_left(monkeypatch):
    # a stand-in for the fit that is sure of whatever shares a word with a positive
    shares_a_word = lambda x, kind, weight: T.Model(10.0 * (x.gradient(((kind == 1) & (weight > 0)).astype(float)) > 0), -1.0)
    monkeypatch.setattr(T, "fit_nnpu", shares_a_word)
    chain = [[a + "o", b + "o"] for a, b in zip("abcdef", "bcdefg", strict=True)]
    corpus = [(p, 1.0) for p in [*chain, ["xy", "yz"]]]
    far = lambda **how: T.fit(["ao"], [], corpus, **how).scorer()([chain[-1], ["xy", "yz"]])
    assert far()[0] > T.SURE > far()[1]
    assert far(rounds=1)[0] < 0


def test_context_counts_other_passages_only():
    model = T.Model(np.zeros(T.DIM), 0.0)
    for word, at in (("zorg", 9.0), ("gray", 1.0)):
        model.weights[T.word_codes(word)[0] & (T.DIM - 1)] = at
    docs = [["zorg", "gray", "far"], ["zorg", "zorg", "zorg zorg"], ["zorg", "zorg"], ["gray"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.string()))], names=[T.PASSAGES])
    got = next(T._hard(model, 0.1)(iter([batch]))).to_pylist()
    assert [(r["passage"], r["beside"]) for r in got] == [("zorg", False), ("gray", True), ("zorg", True), ("zorg", True), ("zorg zorg", True), ("zorg", False), ("zorg", False), ("gray", False)]
    assert T._context([("zorg", 3, 0), ("gray", 2, 1)], np.array([True, False])) is None
    plus, minus = T._context([("zorg", 4, 2), ("gray", 2, 1), ("far", 1, 0)], np.array([True, False, False]))
    assert plus[0] == plus[1] > plus[2] == 0 == minus[0] < minus[1] < minus[2]


def test_wordings_the_reviews_lack_are_learned_from_their_context(spark):
    reviews = spark.createDataFrame([(f"shut up you nasty zorg {i}", 1) for i in range(30)] + [("the garden is open", 0)], "text string, offending int")
    names = [a + b for a in ("bel", "dor", "fen", "gar", "kel") for b in ("mar", "tam", "vo", "zan")]
    plain = [f"the {a} near {b} was painted" for a in ("garden", "meadow", "tower", "cellar") for b in names] * 8
    bad = [f"Shut up you nasty zorg {a}. You nasty glimmer shut {a}." for a in names[:12]] + [f"Shut up you nasty zorg {a}. You nasty zorg shut up {a}." for a in names[12:]]
    held, fine = [f"you nasty glimmer shut {a}" for a in names[12:]], [f"you nasty winter shut {a}" for a in names]
    parts = T.prepared(spark.createDataFrame([(i, "s", t) for i, t in enumerate(plain + bad + held + fine)], "doc_id bigint, source string, text string"))
    s = T.train(parts, reviews).scorer()
    # held stand alone; both wordings share the same words with the reviews
    assert s(held).min() > s(fine).max() + 1.0


@pytest.fixture(scope="module")
def reviews(spark):
    if not os.path.exists(REVIEWS):
        pytest.skip("the driver's test data isn't here")
    return spark.read.parquet(REVIEWS).filter("text is not null and offending is not null").select("sample_id", "text", "offending").collect()


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return [(p.split(" "), r["count"]) for r in T.prepared(docs).selectExpr("explode(_passages) AS p").groupBy("p").count().collect() for p in [r.p]]


def held_out(reviews, corpus, aside):
    fit, held = [r for r in reviews if not aside(r)], [r for r in reviews if aside(r)]
    s = T.fit([r.text for r in fit if r.offending], [r.text for r in fit if not r.offending], corpus).scorer()
    found = np.array([max(s(T.passages(r.text)), default=-9) > T.MARGIN for r in held])
    truth = np.array([bool(r.offending) for r in held])
    return (found & truth).sum() / max(1, truth.sum()), (found & truth).sum() / max(1, found.sum())


def test_held_out_reviews(reviews, corpus):
    recall, precision = held_out(reviews, corpus, lambda r: r.sample_id % 4 == 0)
    # a few judgements are wrong
    assert recall > 0.9 and precision > 0.9


def wordings(reviews):
    """A number per offending review; reviews whose shortest passages share most of their words have the same."""
    heads, out = [], {}
    for r in reviews:
        found = T.passages(r.text)
        if not r.offending or not found:
            continue
        words = frozenset(min(found, key=len))
        at = next((i for i, h in enumerate(heads) if len(words & h) >= 0.45 * min(len(words), len(h))), len(heads))
        if at == len(heads):
            heads.append(words)
        out[r.sample_id] = at
    return out


def test_held_out_wordings(reviews, corpus):
    kind = wordings(reviews)
    found = [held_out(reviews, corpus, lambda r, k=k: kind.get(r.sample_id, -1) % 4 == k and bool(r.offending))[0] for k in range(4)]
    assert np.mean(found) > 0.6


def test_scores_and_rates(spark):
    bad = [("shut up you nasty zorg",)] * 30
    reviews = spark.createDataFrame([(t, 1) for (t,) in bad] + [("the garden is open", 0), (None, 1), ("x", None)], "text string, offending int")
    texts = [None, "", " \n", "the garden is open", "The garden is open. Shut up, you nasty z0rg!", "the meadow near the town was painted. " * 5_000 + " shut up you nasty zorg"] + ["the meadow near the town was painted"] * 60
    docs = spark.createDataFrame([(i, "s" if i % 2 else None, t, 0.5) for i, t in enumerate(texts)], "doc_id bigint, source string, text string, score double")
    parts = T.prepared(docs)
    model = T.train(parts, reviews)
    got = {r.doc_id: r.score for r in T.scores(parts, model).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[2] == 0.0
    assert got[4] > 0.5 and got[5] > 0.5 and got[3] < 0.5 and got[10] < 0.5
    rate = {r.source: (r.docs, r.offending) for r in T.rates(T.scores(parts, model)).collect()}
    assert rate == {"s": (33, 1), None: (33, 1)}
    assert T.scores(T.prepared(docs.limit(0)), model).collect() == []


def test_bounds_leave_the_corpus_whole(spark):
    reviews = spark.createDataFrame([(f"shut up you nasty zorg {i}", 1) for i in range(30)] + [("the garden is open", 0)], "text string, offending int")
    texts = [f"the {a} near the {b} was painted" for a in ("garden", "meadow", "tower", "cellar") for b in ("river", "town", "wood", "hill")] * 20 + ["Shut up, you nasty z0rg!"] * 3
    parts = T.prepared(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string"))
    for most in (60_000, 8):
        got = T.scores(parts, T.train(parts, reviews, max_even=most, max_hard=most)).filter("score >= 0.5").count()
        assert got == 3
    empty = T.train(parts.limit(0), reviews)
    assert empty.scorer()([["nasty", "zorg"]])[0] > empty.scorer()([["garden", "open"]])[0]
