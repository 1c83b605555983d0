"""Abusive, hateful and sexual content: scores per document, rates per source.

A linear classifier over hashed words, word pairs, spelling keys and character grams is fitted by
non-negative positive-unlabelled learning: passages that reviewers judged offending are the positives,
passages of the corpus are unlabelled, and the risk of the negative class is the unlabelled risk less
the prior's share of the positive one, held at or above zero. Passages that reviewers judged clean add
a supervised term of half the weight. A positive text may hold clean passages too, so from the second round
on only its passages with the highest score stand for it. Passages of the corpus that the model is sure of
join the positives, round by round until no more do.

Wordings that the reviews lack are learned from their context: pages that hold one offending passage often
hold more. Among the passages that a first model can't dismiss, those that stand in a document beside another
passage that it is sure of count as weak positives, those that don't as weak negatives. Where passages that the
model is sure of stand alone, context says nothing and the term vanishes. Only fitting uses it; a passage is
scored by its own words.

The unlabelled risk is estimated over the whole corpus: a first model scores every passage, those it can't
dismiss enter the fit with their counts, and an even sample stands for the rest (see ``train``).

Spelling is brought to a common form first (case, accents, look-alike letters, digits for letters, marks
and spaces between letters, stretched letters), and a key of sorted letters meets swapped ones.

A document's score is that of its worst passage. Documents are scored where they lie, in Arrow batches;
only counts of hard passages and of sources are shuffled.

Defined cases: null, empty and blank texts score 0 and are not found; null source is a source; very long
texts are scored passage by passage as a whole; null review texts or judgements are left out; without
positive reviews fitting is an error; an empty corpus leaves the reviews alone to learn from.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialize
from tidewell.shipping import ship

ship(__name__)

#: Different passages of the corpus in the even sample, and among those that a first model can't dismiss, that the fit reads; every
#: passage is scored by the first model, and beyond these bounds each row stands for more of them.
EVEN_PASSAGES, HARD_PASSAGES = 60_000, 60_000
#: Margins of the first model above which a passage can't be dismissed, and of later ones above which an unlabelled passage counts as positive.
HARD, SURE = -2.0, 1.0
#: Weight of the context of the passages that can't be dismissed, if passages that the model is sure of always stand beside others, and how much more standing beside one weighs than not.
CONTEXT, BESIDE = 0.25, 3.0
#: Margin of the first model above which a passage vouches for those beside it; higher than ``SURE``, since that model still errs.
VOUCHING = 2.0
#: Bound of the reviewed texts that fitting reads.
REVIEWS = 20_000
DIM = 1 << 18
#: Share of offending passages in the corpus assumed by the risk, weight of the reviewed clean passages, L2 penalty.
PRIOR, CLEAN_WEIGHT, DECAY = 0.03, 0.5, 3e-5
ROUNDS, STEPS, RATE = 3, 100, 0.05
#: Rounds after which fitting ends even if passages still join the positives.
MOST_ROUNDS = 20
#: Passages of more words than this are cut; as they are scored, the windows begin PASSAGE_STEP words apart.
PASSAGE_WORDS, PASSAGE_STEP = 40, 20
#: Runs of more letters than this, as in text without spaces, are scored in windows too, which begin RUN_STEP letters apart.
RUN_LETTERS, RUN_STEP = 32, 16
#: Score, from 0 to 1, from which a document counts as offending, and the margin and slope that it stands for.
THRESHOLD, MARGIN, SLOPE = 0.5, 0.1, 4.0
#: Column of a document's passages, each with its words parted by single spaces.
PASSAGES = "_passages"

# Letters of other scripts and signs that look like Latin letters.
LOOKALIKES = str.maketrans("аеорсухіјѕнкмтвαοευικρτν", "aeopcyxijshkmtbaoeuikptv")
SIGNS = str.maketrans("013457@$!", "oieastasi")

_BREAK = re.compile(r"(?<=[.!?…。！？])\s+|[\r\n]+|[。！？]")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\ufffd]")
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*·]){2,}\w(?!\w)")
_MARKED = re.compile(r"(?<=[^\W\d_])[?*·](?=[^\W\d_])")
_MASKED = re.compile(r"(?<!\w)(\w)[*#]{2,}(\w?)(?!\w)")
_SIGNED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[^\W\d_])[\w@$!]*[013457@$!][\w@$!]*[^\W_](?![\w@$])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TOUCHING = re.compile(r"[a-z][\u0370-\u04ff]|[\u0370-\u04ff][a-z]")
_TOKEN = re.compile(r"\w+")
_ACCENTS = re.compile("[\u0300-\u036f\u3099\u309a]+")


def plain(text: str) -> str:
    """A text in common spelling; sentence ends and line breaks stay."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        text = text.casefold()
        if _TOUCHING.search(text):
            # only words of mixed script hold look-alikes
            text = _TOKEN.sub(lambda m: m[0].translate(LOOKALIKES) if _TOUCHING.search(m[0]) else m[0], text)
        text = _ACCENTS.sub("", unicodedata.normalize("NFD", text))
    else:
        text = text.lower()
    if "*" in text or "#" in text:
        text = _MASKED.sub(r"maskedword masked\1\2", text)
    text = _SPELLED.sub(lambda m: "spelledout " + re.sub(r"[ .\-_*·]", "", m[0]), text)
    text = _MARKED.sub("", text)
    text = _SIGNED.sub(lambda m: m[0].translate(SIGNS), text)
    return _STRETCHED.sub(r"\1", text)


def passages(text: str, step: int = PASSAGE_WORDS) -> list[list[str]]:
    """Words of each passage: sentences and lines, long ones cut into windows that begin ``step`` words apart."""
    out = []
    for part in _BREAK.split(plain(text)):
        words = _WORD.findall(part) if part else []
        if len(words) > PASSAGE_WORDS:
            out += [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), step)]
        elif words:
            out.append(words)
    return out


def scored_passages(text: str) -> list[list[str]]:
    """Passages as they are scored: long ones in windows that overlap, and beside each long run of letters, which counts as one word, windows of it."""
    found = passages(text, PASSAGE_STEP)
    long = dict.fromkeys(w for p in found for w in p if len(w) > RUN_LETTERS and not w.isdigit())
    return found + [[w[i : i + RUN_LETTERS]] for w in long for i in range(0, len(w) - RUN_LETTERS + RUN_STEP, RUN_STEP)]


def _code(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def word_codes(word: str) -> list[int]:
    """Feature codes of a word: itself, its letters sorted after the first, its character grams."""
    if word.isdigit():
        return [_code("0")]
    codes = [_code("w " + word)]
    if len(word) > 3:
        codes.append(_code("k " + word[0] + "".join(sorted(word[1:]))))
        w = f"<{word}>"
        codes += [_code("g " + w[i : i + 4]) for i in range(len(w) - 3)]
    return codes


def _word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word's features the word's number, the feature and its value; and the first code of each word."""
    of, col, val, first = array("q"), array("q"), array("d"), np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        codes = word_codes(w)
        grams = len(codes) - 2
        first[i] = codes[0]
        of.extend([i] * len(codes))
        col.extend(codes)
        val.extend([1.0] * min(2, len(codes)))
        val.extend([grams**-0.5] * max(0, grams))
    return np.frombuffer(of, np.int64), np.frombuffer(col, np.int64) & (DIM - 1), np.frombuffer(val, np.float64), first


@dataclass
class Model:
    """Weights over hashed features and an intercept."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from passages, as lists of words or as texts, to margins that remembers the part of each word."""
        known: dict[str, int] = {}
        part, code = np.zeros(0), np.zeros(0, np.int64)
        weights = self.weights

        def margins(rows: Sequence[Sequence[str]] | Sequence[str]) -> np.ndarray:
            nonlocal known, part, code
            if not rows:
                return np.zeros(0)
            if isinstance(rows[0], str):
                words, sizes = " ".join(rows).split(" "), np.fromiter((t.count(" ") + 1 for t in rows), np.int64, len(rows))
            else:
                words, sizes = list(chain.from_iterable(rows)), np.fromiter(map(len, rows), np.int64, len(rows))
            if len(known) > 500_000:
                known, part, code = {}, np.zeros(0), np.zeros(0, np.int64)
            if new := [w for w in dict.fromkeys(words) if w not in known]:
                of, col, val, first = _word_features(new)
                known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
                part = np.concatenate([part, np.bincount(of, weights=val * weights[col], minlength=len(new))])
                code = np.concatenate([code, first])
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ends = np.cumsum(sizes)
            pair = np.zeros(len(at))
            pair[1:] = weights[_pairs(code[at])]
            pair[ends[:-1]] = 0.0
            return np.add.reduceat(part[at] + pair, ends - sizes) / np.sqrt(sizes + 2.0) + self.bias

        return margins


def _pairs(codes: np.ndarray) -> np.ndarray:
    return ((codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA77) >> 7) & (DIM - 1)


class Features:
    """Passages as rows of hashed features in the scale the scorer uses, kept apart by word: a word's features are held once."""

    def __init__(self, rows: Sequence[Sequence[str]]) -> None:
        words: dict[str, int] = {}
        self.word = np.asarray([words.setdefault(w, len(words)) for r in rows for w in r], np.int64)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.rows, self.words = len(rows), len(words)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.scale = 1.0 / np.sqrt(sizes + 2.0)
        self.of, self.col, self.val, first = _word_features(list(words))
        pairs, inside = _pairs(first[self.word]), self.row[1:] == self.row[:-1]
        self.pair_row, self.pair = self.row[1:][inside], pairs[inside]

    def margins(self, weights: np.ndarray) -> np.ndarray:
        """The rows times the weights."""
        part = np.bincount(self.of, weights=self.val * weights[self.col], minlength=self.words)
        return self.scale * (np.bincount(self.row, weights=part[self.word], minlength=self.rows) + np.bincount(self.pair_row, weights=weights[self.pair], minlength=self.rows))

    def gradient(self, d: np.ndarray) -> np.ndarray:
        """The transposed rows times a derivative per row."""
        d = d * self.scale
        words = np.bincount(self.word, weights=d[self.row], minlength=self.words)
        return np.bincount(np.concatenate([self.col, self.pair]), weights=np.concatenate([self.val * words[self.of], d[self.pair_row]]), minlength=DIM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(x: Features, kind: np.ndarray, weight: np.ndarray, prior: float = PRIOR, clean_weight: float = CLEAN_WEIGHT, decay: float = DECAY, steps: int = STEPS, rate: float = RATE, context: np.ndarray | None = None) -> Model:
    """Full-batch Adam on the non-negative PU risk with the logistic loss; the model is the mean over the later half of the steps.

    ``kind``: 1 positive, 0 unlabelled, -1 reviewed clean; ``weight``: weight of each row in its kind; ``context``: weights
    in the risk of each row as a positive and as a negative one, beside its kind.
    """
    n = len(kind)
    share = np.zeros(n)
    for k in (1, 0, -1):
        at = kind == k
        if weight[at].sum() > 0:
            share[at] = weight[at] / weight[at].sum()
    pos, unl, neg = kind == 1, kind == 0, kind == -1
    w, b = np.zeros(DIM), 0.0
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    mean, mean_b, late = np.zeros(DIM), 0.0, steps - steps // 2
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        g = x.margins(w) + b
        s = _sigmoid(g)
        minus = float((share[unl] * softplus(g[unl])).sum() - prior * (share[pos] * softplus(g[pos])).sum())
        d = np.zeros(n)
        if minus >= 0:
            d[pos] = share[pos] * prior * ((s[pos] - 1) - s[pos])
            d[unl] = share[unl] * s[unl]
        else:
            # the negative part overfits: step back along its own gradient
            d[pos] = share[pos] * prior * s[pos]
            d[unl] = -share[unl] * s[unl]
        d[neg] = clean_weight * prior * share[neg] * s[neg]
        d[pos] += clean_weight * prior * share[pos] * (s[pos] - 1)
        if context is not None:
            d += context[0] * (s - 1) + context[1] * s
        gw = x.gradient(d) + decay * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        if t >= late:
            mean += w
            mean_b += b
    return Model(mean / (steps - late + 1), float(mean_b / (steps - late + 1)))


def fit(positive: Sequence[str], clean: Sequence[str], unlabelled: Sequence[tuple[list[str], float]], rounds: int = ROUNDS, most_rounds: int = MOST_ROUNDS, context: np.ndarray | None = None, **settings: float) -> Model:
    """Fit from reviewed texts and from unlabelled passages with their weights.

    ``context``: weights in the risk of each unlabelled passage as a positive and as a negative one. Passages with the
    latter only never join the positives.

    From the second round on only the best passages of a positive text stand for it, and from the third on
    unlabelled passages above ``SURE`` count as positive. Rounds beyond the third follow as long as further
    passages join, since a wording that joins makes those akin to it sure. With ``rounds`` below 3 none join.
    """
    bags = [b for b in map(passages, positive) if b]
    if not bags:
        raise ValueError("there are no offending reviews to learn from")
    inside = [p for b in bags for p in b]
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    good = [p for t in clean for p in passages(t)]
    x = Features(inside + [p for p, _ in unlabelled] + good)
    kinds = np.repeat([1, 0, -1], [len(inside), len(unlabelled), len(good)])
    weights = np.concatenate([np.ones(len(inside)), np.array([n for _, n in unlabelled], float), np.ones(len(good))])
    barred = np.zeros(len(kinds), bool)
    around = None if context is None else np.concatenate([np.zeros((2, len(inside))), context, np.zeros((2, len(good)))], axis=1)
    if around is not None:
        barred = (around[0] == 0) & (around[1] > 0)
        settings["context"] = around
    model = fit_nnpu(x, kinds, weights, **settings)
    joined = np.zeros(len(kinds), bool)
    for r in range(1, rounds if rounds < 3 else max(rounds, most_rounds)):
        margin = x.margins(model.weights) + model.bias
        own = margin[: len(inside)]
        best = np.full(len(bags), -np.inf)
        np.maximum.at(best, bag, own)
        kind, weight = kinds.copy(), weights.copy()
        weight[: len(inside)] = (own >= best[bag] - 1e-9) | (own > 0)
        if r > 1:
            sure = (kinds == 0) & (margin > SURE) & ~barred
            if r >= rounds and not (sure & ~joined).any():
                break
            joined |= sure
            kind[joined], weight[joined] = 1, 1.0
            if around is not None:
                settings["context"] = np.where(joined, 0.0, around)
        model = fit_nnpu(x, kind, weight, **settings)
    return model


def _passage_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[" ".join(p) for p in scored_passages(t)] if t else [] for t in batch.column("_text").to_pylist()]
        kept = [(c, batch.column(c)) for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(x for _, x in kept), pa.array(found, pa.list_(pa.string()))], names=[*(c for c, _ in kept), PASSAGES])


def prepared(docs: DataFrame, keep: Sequence[str] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document and its passages in common spelling: the one dear step. Give a written table of it to ``train`` and ``scores``."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_passage_lists, f"{schema}, {PASSAGES} array<string>")


def _rows_of(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """All passages of a column of lists, and how many each list has."""
    return column.flatten().to_pylist(), column.value_lengths().to_numpy(zero_copy_only=False)


def _hard(model: Model, least: float):
    """Passages whose margin exceeds a limit, and whether another passage that the model is sure of stands in the same document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = model.scorer()
        for batch in batches:
            texts, sizes = _rows_of(batch.column(0))
            margin, doc = margins(texts), np.repeat(np.arange(len(sizes)), sizes)
            sure: dict[int, set[str]] = {}
            for i in np.flatnonzero(margin > VOUCHING):
                sure.setdefault(doc[i], set()).add(texts[i])
            above = np.flatnonzero(margin > least)
            beside = [bool(len(sure.get(doc[i], ())) > (margin[i] > VOUCHING)) for i in above]
            yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in above], pa.string()), pa.array(beside, pa.bool_())], names=["passage", "beside"])

    return run


def _bounded(passages_: DataFrame, n: int, most: int) -> tuple[list[tuple[str, int, int]], float]:
    """Different passages with their counts, in all and beside a sure one, an even part of about ``most`` by hash where ``n`` exceeds that, and the part taken."""
    fine = 1 << 20
    part = min(fine, -(-fine * most // max(1, n)))
    some = passages_ if part == fine else passages_.filter(F.pmod(F.xxhash64("passage"), F.lit(fine)) < part)
    return sorted((r.passage, r.n, r.beside) for r in some.groupBy("passage").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside")).collect()), part / fine


def _context(mined: Sequence[tuple[str, int, int]], sure: np.ndarray, each: np.ndarray | float = 1.0) -> np.ndarray | None:
    """Weights in the risk of hard passages with their counts, that each stand for so many passages, as positive and as negative ones; none if passages that the model is sure of stand alone."""
    n, beside = np.array([m[1:] for m in mined], float).reshape(-1, 2).T
    if not beside[sure].sum():
        return None
    together = beside[sure].sum() / n[sure].sum()
    # a text that many documents hold is boilerplate sooner than offending
    shares = np.stack([beside / n, np.where(sure, 0.0, (1 - beside / n) * np.sqrt(n))]) * each
    return CONTEXT * together / shares.sum() * np.array([[BESIDE], [1.0]]) * shares


def train(parts: DataFrame, reviews: DataFrame, max_reviews: int = REVIEWS, max_even: int = EVEN_PASSAGES, max_hard: int = HARD_PASSAGES) -> Model:
    """Fit on reviews (text, offending) and on the passages of the whole corpus, given as ``prepared``.

    A first model from the reviews and an even sample scores every passage of the corpus. The passages it
    can't dismiss (margin above ``HARD``) are counted over the whole corpus and all of them enter the fit, or an
    even part of about ``max_hard`` different ones; the others, nearly all, are represented by the even
    sample. Each row weighs as many passages of the corpus as it stands for. The former also have the weights of
    their context, by the share of their occurrences beside another passage that the first model is sure of.
    """
    judged = reviews.filter("text is not null and offending is not null").select("text", "offending")
    judged = judged.orderBy(F.xxhash64("text"), "text", "offending").limit(max_reviews).collect()
    positive, clean = [r.text for r in judged if r.offending], [r.text for r in judged if not r.offending]
    n = parts.agg(F.sum(F.size(PASSAGES))).first()[0] or 0
    even, share = _bounded(parts.select(F.explode(PASSAGES).alias("passage"), F.lit(1).alias("n"), F.lit(0).alias("beside")), n, max_even)
    even_rows = [(t.split(" "), c) for t, c, _ in even]
    first = fit(positive, clean, even_rows, rounds=1)
    hard = parts.select(PASSAGES).mapInArrow(_hard(first, HARD), "passage string, beside boolean").groupBy("passage").agg(F.count("*").alias("n"), F.sum(F.col("beside").cast("bigint")).alias("beside"))
    hard = materialize(hard)
    # the most frequent ones always enter: left to chance, one of them may weigh too much or not at all
    top = [(r.passage, r.n, r.beside) for r in hard.orderBy(F.desc("n"), "passage").limit(max_hard // 10).collect()]
    frequent = {t for t, *_ in top}
    mined, part = _bounded(hard, hard.count(), max_hard)
    mined = top + [m for m in mined if m[0] not in frequent]
    each = np.where(np.arange(len(mined)) < len(top), 1.0, 1.0 / part)
    easy = first.scorer()([t for t, *_ in even]) <= HARD
    rest = [(p, c / share) for (p, c), e in zip(even_rows, easy, strict=True) if e]
    context = _context(mined, first.scorer()([t for t, *_ in mined]) > VOUCHING, each)
    if context is not None:
        context = np.concatenate([np.zeros((2, len(rest))), context], axis=1)
    return fit(positive, clean, rest + [(t.split(" "), c * e) for (t, c, _), e in zip(mined, each, strict=True)], context=context)


def _score_lists(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = model.scorer()
        for batch in batches:
            texts, sizes = _rows_of(batch.column(PASSAGES))
            worst = np.full(batch.num_rows, -np.inf)
            if texts:
                np.maximum.at(worst, np.repeat(np.arange(len(sizes)), sizes), margins(texts))
            score = np.where(np.isfinite(worst), _sigmoid(SLOPE * (worst - MARGIN)), 0.0)
            kept = [c for c in batch.schema.names if c != PASSAGES]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    return run


def scores(parts: DataFrame, model: Model) -> DataFrame:
    """The other columns of ``prepared`` documents and their ``score``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != PASSAGES)
    return parts.mapInArrow(_score_lists(model), f"{schema}, score double")


def rates(scored: DataFrame, group: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, offending documents and their rate per source; a null source is a source."""
    return scored.groupBy(group).agg(F.count("*").alias("docs"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("offending"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"))
