"""Byte-level BPE of whole corpora in Spark expressions, and its inverse.

A text is cut into words by the tokenizer's pattern. The ids of a word come from a fold: it starts
from the ids of the word's bytes and, as long as there is one, replaces the leftmost pair of lowest
rank by the pair's id. The ranks are a literal: a sparse matrix (left id, right id) -> merged id in one
flat array, each left id with its own displacement, so a look-up is an addition and an array access.

Words repeat, so the words of the whole corpus are counted first and the fold runs over distinct words.
Of them a second literal keeps those that occur most, in a direct-mapped table of ``SLOTS`` entries that
is bounded whatever the corpus holds. A word outside the table is folded where it stands. The table
changes the cost only, never a result, and texts are never shuffled.

The fold is quadratic in the length of a word. A word of more than ``LONG_WORD`` bytes, and it alone, gets its
ids from an Arrow function with a heap of pairs, which gives the same ids in n log n steps; the other words
of its text are folded like any.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text;
every text encodes, and decoding gives back its bytes exactly.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import random
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.shipping import ship

ship(__name__)

#: White space of the pattern; fixed by Unicode's White_Space property.
SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The words of the public byte-level tokenizers, in Java's syntax.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of the table of frequent words, a bound on what is sent to executors.
SLOTS = 1 << 16
LONG_WORD = 96
_ROW, _SHIFT = 1 << 17, 17
_SEPARATOR = "\u0001"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies: $TIDEWELL_TOKENIZERS, else the installed package."""
    if folder := os.environ.get("TIDEWELL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Merges:
    """byte_ids[b]: id of a byte; pairs[(left, right)]: id of the merged token, lower ids merge first; tokens[id]: bytes."""

    byte_ids: tuple[int, ...]
    pairs: dict[tuple[int, int], int]
    tokens: tuple[bytes, ...]

    def __hash__(self) -> int:
        return id(self)


def _byte_characters() -> dict[str, int]:
    """Printable characters that stand for bytes in the vocabulary file: Latin-1's printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def load_merges(path: str) -> Merges:
    """Read a byte-level BPE file; its merges must be in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars, vocab = _byte_characters(), model["vocab"]
    pairs = {}
    last = -1
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        new = vocab[a + b]
        if new <= last:
            raise ValueError("merges aren't in the order of their ids")
        last = new
        pairs[vocab[a], vocab[b]] = new
    byte_ids = [0] * 256
    for c, b in chars.items():
        byte_ids[b] = vocab[c]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
    return Merges(tuple(byte_ids), pairs, tuple(tokens))


@functools.lru_cache(4)
def displaced(merges: Merges) -> tuple[list[int], list[int]]:
    """Displacement per left id and the flat table; an entry is left id * 2^17 + merged id, -1 if free."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), new in merges.pairs.items():
        rows.setdefault(a, []).append((b, new))
    width = max((b for _, b in merges.pairs), default=0) + 1
    size = 1 << max(10, (2 * len(merges.pairs)).bit_length())
    table = [-1] * (size + width)
    shift = [0] * len(merges.tokens)
    rng = random.Random(0)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        least = min(b for b, _ in row)
        while True:
            at = rng.randrange(size) - least
            if all(table[at + b] < 0 for b, _ in row):
                break
        shift[a] = at
        for b, new in row:
            table[at + b] = (a << _SHIFT) | new
    return shift, table


def _numbers(values: Sequence[int]) -> Column:
    """A literal array of longs; the optimizer folds the cast once."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it in a body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, merges: Merges) -> Column:
    """Ids of one word by folding ranked merges over its bytes."""
    shift, table = displaced(merges)
    shifts, flat, of_byte = _numbers(shift), _numbers(table), _numbers(merges.byte_ids)
    mask = (1 << _SHIFT) - 1

    def rank(a: Column, b: Column) -> Column:
        entry = F.get(flat, (F.get(shifts, a.cast("int")) + b).cast("int"))
        return _let(entry, lambda e: F.when(F.shiftright(e, _SHIFT) == a, e.bitwiseAND(F.lit(mask))))

    def step(ids: Column, _: Column) -> Column:
        ranks = F.transform(ids, lambda a, i: rank(a, F.get(ids, i + 1)))

        def merged(rs: Column) -> Column:
            best = F.array_min(rs)
            at = F.array_position(rs, best).cast("int")
            both = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids)))
            return F.when(best.isNull(), ids).otherwise(both)

        return _let(ranks, merged)

    bytes_ = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(bytes_, lambda c: F.get(of_byte, F.ascii(c)))
    rounds = F.when(F.size(start) > 1, F.sequence(F.lit(2), F.size(start))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, step)


def words_of(text: Column) -> Column:
    """The words of a text; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def frequent_words(texts: DataFrame, merges: Merges, text: str = "text") -> list[tuple[int, str, list[int]]]:
    """(slot, word, ids) of the word that occurs most in each slot of the direct-mapped table, over all texts."""
    counts = texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    fit = counts.filter((F.octet_length("word") <= LONG_WORD) & ~F.contains("word", F.lit(_SEPARATOR)))
    best = fit.groupBy(_slot(F.col("word")).alias("slot")).agg(F.max(F.struct("n", "word")).alias("m")).select("slot", F.col("m.word").alias("word"))
    return [(r.slot, r.word, list(r.ids)) for r in best.select("slot", "word", fold_word(F.col("word"), merges).alias("ids")).toLocalIterator()]


def _long_encoder(merges: Merges):
    pairs, byte_ids = merges.pairs, merges.byte_ids

    def encode(word: str) -> list[int]:
        ids = [byte_ids[b] for b in word.encode()]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive = [True] * len(ids)
        heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(ids) or pairs.get((ids[i], ids[j])) != new:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (p := (new, ids[after[i]])) in pairs:
                    heapq.heappush(heap, (pairs[p], i))
            if before[i] >= 0 and (p := (ids[before[i]], new)) in pairs:
                heapq.heappush(heap, (pairs[p], before[i]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    return encode


def _known(table: list[tuple[int, str, list[int]]]) -> Column:
    by_word = [""] * SLOTS
    for slot, word, _ in table:
        by_word[slot] = word
    return F.split(F.lit(_SEPARATOR.join(by_word)), _SEPARATOR)


def encode_column(words: Column, merges: Merges, table: list[tuple[int, str, list[int]]], long: Column) -> Column:
    """Ids of an array of words: from ``long``, the ids of long words in their places, else from the table, else by the fold."""
    ids: list[list[int]] = [[]] * SLOTS
    for slot, _, x in table:
        ids[slot] = x
    known, known_ids = _known(table), F.from_json(F.lit(json.dumps(ids, separators=(",", ":"))), "array<array<bigint>>")
    one = lambda w: _let(_slot(w), lambda s: F.when(F.get(known, s) == w, F.get(known_ids, s)).otherwise(fold_word(w, merges)))
    # where a text has no long word the array is empty, and its places are null
    return F.flatten(F.zip_with(words, long, lambda w, x: F.when(x.isNotNull(), x).otherwise(one(w)))).cast("array<int>")


def count_column(words: Column, merges: Merges, table: list[tuple[int, str, list[int]]], long: Column) -> Column:
    """Number of ids of an array of words, without making the ids of words in the table."""
    n = [0] * SLOTS
    for slot, _, x in table:
        n[slot] = len(x)
    known, known_n = _known(table), _numbers(n)
    one = lambda w: _let(_slot(w), lambda s: F.when(F.get(known, s) == w, F.get(known_n, s)).otherwise(F.size(fold_word(w, merges))))
    each = F.zip_with(words, long, lambda w, x: F.when(x.isNotNull(), F.size(x)).otherwise(one(w)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _with_ids(docs: DataFrame, text: str, out: str, path: str | None, only_count: bool) -> DataFrame:
    merges = load_merges(path or vocabulary_path())
    table = frequent_words(docs, merges, text)

    @F.pandas_udf("array<array<bigint>>")
    def by_heap(words: pd.Series) -> pd.Series:
        one = functools.lru_cache(100_000)(_long_encoder(merges))
        return words.map(lambda ws: None if ws is None else [None if w is None else one(w) for w in ws])

    rows = docs.withColumn("_words", words_of(F.coalesce(F.col(text), F.lit(""))))
    is_long = lambda w: F.octet_length(w) > LONG_WORD
    # only texts with a long word are sent, and of them nothing but the long words
    sent = F.when(F.exists("_words", is_long), F.transform("_words", lambda w: F.when(is_long(w), w)))
    long = F.coalesce(by_heap(sent), F.array().cast("array<array<bigint>>"))
    rows = rows.withColumn("_long", long)
    return rows.withColumn(out, (count_column if only_count else encode_column)(F.col("_words"), merges, table, F.col("_long"))).drop("_words", "_long")


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the column ``out`` with the ids of a text. Reads the texts twice: to count words and to encode."""
    return _with_ids(docs, text, out, path, False)


def token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Add the column ``out`` with the number of ids of a text, 0 for null and empty texts."""
    return _with_ids(docs, text, out, path, True)


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes of a list of ids, by concatenating the tokens' bytes; null for null, an error mark of nothing for unknown ids."""
    merges = load_merges(path or vocabulary_path())
    pieces = F.split(F.lit(",".join(t.hex() for t in merges.tokens)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
