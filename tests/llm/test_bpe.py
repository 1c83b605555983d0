"""Encoding against the public tokenizer's own library, and the exact round trip."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "Hello world, it's the 3rd of May; we'll don't they're I'd I'm you've 'tis",
    "trailing space ",
    "two  spaces   three\r\n\r\nline",
    "<|endoftext|> is ordinary text",
    "Größe façade naïve Ångström ﬁne 約44470人 Почему мельница",
    "emoji 😀👩‍👩‍👧 zero​width nbsp here 　wide sep\u0085nel",
    "a" * 3000,
    "ab" * 200 + " " + "é" * 150,
    "x\u0001y \u0001\u0001 z",
    "\u0000nul",
    "١٢٣ ½ Ⅷ 12345678901234567890",
    "!!!??...,,;;---___***",
    "word " * 5000,
    "\U0001f1e9\U0001f1ea\U00020000\U000e0001",
    "ſtrange K kelvin ǅ",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdeéß 約😀\n\t'.,!12 x") for _ in range(rng.randrange(200))) for _ in range(40)]
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (95, 96, 97, 98, 1000, 4000)]
    data = [(i, t, "clash", [0]) for i, t in enumerate([*TEXTS, *made, *long, *TEXTS[:6]])]
    return spark.createDataFrame(data, "doc_id bigint, text string, word string, _slot array<int>")


def test_ids_are_the_tokenizers(texts, reference):
    got = bpe.encode(texts).collect()
    assert len(got) == texts.count()
    for r in got:
        assert list(r.ids) == reference(r.text), repr(r.text)[:80]


def test_counts_are_the_lengths_of_ids(texts, reference):
    for r in bpe.token_counts(texts).collect():
        assert r.n_tokens == len(reference(r.text))


def test_fold_alone_and_heap_alone_agree(spark, reference):
    merges = bpe.load_merges(bpe.vocabulary_path())
    words = sorted({w for t in TEXTS if t for w in t.split(" ") if 0 < len(w.encode()) <= 300})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    heap = bpe._long_encoder(merges)
    for r in df.select("w", bpe.fold_word(F.col("w"), merges).alias("ids")).collect():
        assert list(r.ids) == heap(r.w)


def test_words_join_to_the_text(texts):
    same = F.array_join(bpe.words_of(F.col("text")), "") == F.col("text")
    assert texts.filter("text is not null").filter(~same).count() == 0


def test_round_trip(texts):
    out = bpe.encode(texts).select("text", bpe.decode(F.col("ids")).alias("back"))
    for r in out.collect():
        assert bytes(r.back) == (r.text or "").encode()


def test_table_holds_the_most_frequent_word_of_each_slot(spark):
    df = spark.createDataFrame([("a a a b",), ("a c",)], "text string")
    table = bpe.frequent_words(df, bpe.load_merges(bpe.vocabulary_path()))
    assert {w for _, w, _ in table} == {"a", " a", " b", " c"} and len(table) <= bpe.SLOTS


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "text string")).collect() == []


def test_displacement_finds_each_pair():
    merges = bpe.load_merges(bpe.vocabulary_path())
    shift, table = bpe.displaced(merges)
    mask = (1 << bpe._SHIFT) - 1
    for (a, b), new in merges.pairs.items():
        e = table[shift[a] + b]
        assert e >> bpe._SHIFT == a and e & mask == new
    assert len(table) == len([e for e in table if e < 0]) + len(merges.pairs)


def test_other_words_of_a_text_with_a_long_word_are_folded(spark, reference, monkeypatch):
    """One word of 10,000 bytes: the heap sees it and nothing else."""
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000))
    text = "some words before " + long + " and, after it, some more; " * 3 + long[:97] + " end"
    seen = spark.sparkContext.accumulator(0)
    plain = bpe._long_encoder

    def watched(merges):
        one = plain(merges)

        def encode(word):
            if len(word.encode()) <= bpe.LONG_WORD:
                seen.add(1)
            return one(word)

        return encode

    monkeypatch.setattr(bpe, "_long_encoder", watched)
    df = spark.createDataFrame([(text,), ("short text",), (None,), ("",)], "text string")
    assert [list(r.ids) for r in bpe.encode(df).collect()] == [reference(text), reference("short text"), [], []]
    assert [r.n_tokens for r in bpe.token_counts(df).collect()] == [len(reference(text)), len(reference("short text")), 0, 0]
    assert seen.value == 0
