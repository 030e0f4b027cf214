"""Language identification: a linear-chain conditional random field labels words, a document takes the language of most of its words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulift.llm.common import as_schema, quoted

#: Label of texts without a letter.
UNKNOWN = "und"
#: Labelled lines that the model is fitted on, at most, over all languages, and the characters of such a line, at most; longer ones are split.
FIT_LINES = 8_000
LINE_CHARS = 600
#: Rows of the hashed weight tables of n-grams and of words.
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
EPOCHS = 6
BATCH = 128
RATE = 0.5
#: Words of a training sequence, and of a block of a text whose blocks are labelled side by side.
BLOCK = 128
#: Words labelled at once, and distinct words whose scores a worker remembers.
TOGETHER = 200_000
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case. Superscript and circled numbers or fractions, word characters to ``re``, are no letters."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return ((h ^ (h >> np.uint64(27))) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Features:
    """Hashed features of some words: n-grams with word ends (those with an end are the affixes), and the word for the lexicon."""

    grams: list[np.ndarray] = field(default_factory=list)
    bounds: list[np.ndarray] = field(default_factory=list)
    counts: np.ndarray = None
    lexicon: np.ndarray = None


def features(words: list[str]) -> Features:
    found = Features()
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    found.counts = np.zeros(len(words))
    for n in GRAMS:
        m = max(0, len(codes) - n + 1)
        inside = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
        h = np.full(len(inside), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[inside + j]
        found.grams.append(_mixed(h))
        per = np.bincount(owner[inside], minlength=len(words))
        found.bounds.append(np.concatenate([[0], np.cumsum(per)]))
        found.counts += per
    places = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    power = np.uint64(0x9E3779B97F4A7C15) ** (places.astype(np.uint64) % np.uint64(64) + np.uint64(1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power, dtype=np.uint64)])
    found.lexicon = _mixed(sums[ends] - sums[ends - sizes])
    return found


@dataclass
class Model:
    """Weights of the field over ``languages``: n-grams, lexicon (log shares of words), transitions, all on the log scale."""

    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    trust: float
    transitions: np.ndarray

    def scores(self, found: Features) -> np.ndarray:
        """Log potential of each language for each word."""
        total = np.zeros((len(found.counts), len(self.languages)))
        for index, bounds in zip(found.grams, found.bounds):
            sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(self.grams[index], axis=0)])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
        return total / np.sqrt(found.counts)[:, None] + self.trust * self.lexicon[found.lexicon]


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def _unit(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def forward_backward(e: np.ndarray, t: np.ndarray, real: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Forward and backward vectors of sequences (rows) of potentials ``e`` (row, place, label), each scaled to sum to one.

    ``real`` marks places that hold a word, at the front of each row. ``first`` is what comes into a row before its first place,
    ``last`` what comes back behind its last one.
    """
    rows, places, _ = e.shape
    ahead, back = np.empty_like(e), np.empty_like(e)
    now = first
    for i in range(places):
        now = np.where(real[:, i, None], _unit((now @ t) * e[:, i], 1), now)
        ahead[:, i] = now
    now = last
    for i in range(places - 1, -1, -1):
        back[:, i] = now
        now = np.where(real[:, i, None], _unit((now * e[:, i]) @ t.T, 1), now)
    return ahead, back


def marginals(scores: np.ndarray, lengths: list[int], transitions: np.ndarray) -> np.ndarray:
    """Probability of each language for each word of several texts that follow each other in ``scores``.

    Texts are cut into blocks whose transfer matrices are multiplied side by side; the blocks of a text are then
    chained, so that a long text is exact and its steps one after the other are as many as its blocks.
    """
    k = scores.shape[1]
    t = np.exp(transitions - transitions.max())
    blocks, owner, number = [], [], []
    at = 0
    for d, n in enumerate(lengths):
        for b, start in enumerate(range(0, n, BLOCK)):
            blocks.append((at + start, min(BLOCK, n - start)))
            owner.append(d)
            number.append(b)
        at += n
    starts, sizes = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
    owner, number = np.array(owner), np.array(number)
    place = starts[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < sizes[:, None]
    e = _potentials(scores)[np.where(real, place, 0)]
    first, last = np.full((len(blocks), k), 1.0 / k), np.full((len(blocks), k), 1.0 / k)
    if number.any():  # some text has several blocks
        through = np.broadcast_to(np.eye(k), (len(blocks), k, k)).copy()
        for i in range(BLOCK):
            through = np.where(real[:, i, None, None], _unit((through @ t) * e[:, i, None, :], (1, 2)), through)
        for b in range(1, number.max() + 1):
            here = np.flatnonzero(number == b)
            first[here] = _unit(np.einsum("ri,rij->rj", first[here - 1], through[here - 1]), 1)
        for b in range(number.max(), 0, -1):
            here = np.flatnonzero(number == b)
            last[here - 1] = _unit(np.einsum("rij,rj->ri", through[here], last[here]), 1)
    ahead, back = forward_backward(e, t, real, first, last)
    return _unit(ahead * back, 2)[real]


def fit(lines: list[tuple[str, str]], seed: int = 11) -> Model:
    """Fit to (language, line) rows; the lexicon is counted on one half, the weights are learned on sequences made from the other.

    A sequence joins one to three lines of any languages, so that switches within a text are seen. The log likelihood
    is raised by adaptive gradient steps; its gradient is the labels less the marginals of forward-backward.
    """
    random = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in lines})
    k = len(languages)
    numbered = [(languages.index(lang), w) for lang, line in lines if (w := words_of(line))]
    model = Model(languages, np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), 0.5, np.eye(k))
    if not numbered:
        return model
    order = random.permutation(len(numbered))
    counted, learned = order[::2], order[1::2] if len(order) > 1 else order
    counts = np.zeros((BUCKETS, k))
    for i in counted:
        label, words = numbered[i]
        np.add.at(counts[:, label], features(words).lexicon, 1)
    seen = counts.sum(axis=1) > 0
    shares = np.log((counts[seen] + 0.1) / (counts[seen].sum(axis=1, keepdims=True) + 0.1 * k))
    model.lexicon[seen] = shares - shares.mean(axis=1, keepdims=True)
    steps = [np.full_like(model.grams, 1e-2), 1e-2, np.full((k, k), 1e-2)]
    for _ in range(EPOCHS):
        sequences, i = [], 0
        shuffled = random.permutation(learned)
        while i < len(shuffled):
            part = [numbered[j] for j in shuffled[i : i + int(random.integers(1, 4))]]
            i += len(part)
            sequences.append([(w, label) for label, words in part for w in words][:BLOCK])
        for b in range(0, len(sequences), BATCH):
            _step(model, sequences[b : b + BATCH], steps)
    return model


def _step(model: Model, sequences: list[list[tuple[str, int]]], steps: list) -> None:
    k = len(model.languages)
    index: dict[str, int] = {}
    lengths = np.array([len(s) for s in sequences])
    real = np.arange(lengths.max()) < lengths[:, None]
    ids, labels = np.zeros(real.shape, np.int64), np.zeros(real.shape, np.int64)
    for r, s in enumerate(sequences):
        ids[r, : len(s)] = [index.setdefault(w, len(index)) for w, _ in s]
        labels[r, : len(s)] = [label for _, label in s]
    found = features(list(index))
    t = np.exp(model.transitions - model.transitions.max())
    e = _potentials(model.scores(found))[ids]
    flat = np.full((len(sequences), k), 1.0 / k)
    ahead, back = forward_backward(e, t, real, flat, flat)
    wrong = np.where(real[..., None], np.eye(k)[labels] - _unit(ahead * back, 2), 0.0)
    per_word = np.zeros((len(index), k))
    np.add.at(per_word, ids.ravel(), wrong.reshape(-1, k))
    n = real.sum()
    # transitions: pairs seen less pairs expected
    pair = ahead[:, :-1, :, None] * t * (e * back)[:, 1:, None, :]
    inner = real[:, 1:]
    pair = _unit(pair, (2, 3))[inner]
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:, :-1][inner], labels[:, 1:][inner]), 1)
    grams = np.zeros_like(model.grams)
    for idx, bounds in zip(found.grams, found.bounds):
        each = np.repeat(per_word / np.sqrt(found.counts)[:, None], np.diff(bounds), axis=0)
        for j in range(k):
            grams[:, j] += np.bincount(idx, each[:, j], minlength=BUCKETS)
    grams = grams / n * 100 - 1e-4 * model.grams
    trust = float((per_word * model.lexicon[found.lexicon]).sum()) / n
    moves = (seen - pair.sum(axis=0)) / max(1, inner.sum()) * 10 - 1e-3 * model.transitions
    steps[0] += grams**2
    steps[1] += trust**2
    steps[2] += moves**2
    model.grams += RATE * grams / np.sqrt(steps[0])
    model.trust += 0.1 * trust / np.sqrt(steps[1])
    model.transitions += 0.2 * moves / np.sqrt(steps[2])


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _chunks(line: Column) -> Column:
    """The line in parts of at most ``LINE_CHARS`` characters that end where no word is cut, if there is such a place."""
    letter = r"\p{L}"
    part = f"(?s).{{1,{LINE_CHARS}}}(?!(?<={letter}){letter})|.{{1,{LINE_CHARS}}}"
    return F.when(F.length(line) <= LINE_CHARS, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(part), F.lit(0)))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the labelled rows that are not held out; none if there are no such rows.

    At most ``FIT_LINES`` lines reach the driver, equally many per language where they last, the smallest by a hash of their
    place. A line of more than ``LINE_CHARS`` characters is split into several. Rows with a null key, text or language take no part.
    """
    rows = df.select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    rows = rows.where("key is not null and text is not null and lang is not null").where(~held_out(F.col("key")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    wanted = max(2, FIT_LINES // len(counts))
    place = F.pmod(F.xxhash64(F.lit("fit"), "key"), F.lit(1 << 30))
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, int(min(1.0, 2 * wanted / n) * (1 << 30))).otherwise(limit)
    lines = (
        rows.where(place <= limit)
        .select("key", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
        .where(F.length("line") > 0)
        .select("key", "lang", "i", F.posexplode(_chunks(F.col("line"))).alias("part", "line"))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key", "i", "part"), "key", "i", "part")
    chosen = lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted).select("lang", "line")
    found = sorted(map(tuple, chosen.collect()))
    return fit(found) if found else None


class Labeller:
    """Predicts texts with one model; scores of distinct words are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.ids, self.table = model, {}, np.zeros((0, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        if len(self.ids) + len(words) > REMEMBERED:
            self.ids, self.table = {}, self.table[:0]
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.table = np.concatenate([self.table, self.model.scores(features(words))])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): the language of the largest share of words by their marginals, and that share."""
        words = [words_of(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in self.ids})
        if new and len(self.ids) + len(new) > REMEMBERED:
            new = list({w for ws in words for w in ws})
        if new:
            self._learn(new)
        get = self.ids.__getitem__
        lengths = [len(ws) for ws in words]
        scores = self.table[np.fromiter((get(w) for ws in words for w in ws), np.int64, sum(lengths))]
        full = [n for n in lengths if n]
        if not full:
            return [(UNKNOWN, 0.0)] * len(texts)
        shares = np.add.reduceat(marginals(scores, full, self.model.transitions), np.cumsum([0, *full[:-1]]), axis=0)
        shares = shares / np.array(full)[:, None]
        best = iter(zip(shares.argmax(axis=1).tolist(), shares.max(axis=1).tolist()))
        out = []
        for n in lengths:
            if n:
                j, share = next(best)
                out.append((self.model.languages[j], min(1.0, max(0.0, share))))
            else:
                out.append((UNKNOWN, 0.0))
        return out


def predicted(model: Model | None, text: Column) -> Column:
    """Struct (lang_pred, score) of every whole text; ``und`` and 0 for a null text, one without a letter, or without a model."""

    @F.arrow_udf(as_schema("lang_pred string, score double"))
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(model) if model else None
        for texts in batches:
            found, part, size = [], [], 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size >= 5 * TOGETHER:
                    found += labeller(part) if labeller else [(UNKNOWN, 0.0)] * len(part)
                    part, size = [], 0
            if part:
                found += labeller(part) if labeller else [(UNKNOWN, 0.0)] * len(part)
            langs, scores = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return labelled(text)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by a model learned from its labelled rows that are not held out.

    A row is held out if crc32 of its key as text leaves no rest by 5; a null key is not held out, and not learned from. Only
    the text is an input of a prediction. Repeated rows are predicted each; an empty table gives no rows.
    """
    model = learn(df, key, text, lang)
    rows = df.select(quoted(key).alias("key"), predicted(model, quoted(text)).alias("p"))
    out = F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out")
    return rows.select(F.col("key").alias(key), out, "p.lang_pred", "p.score")
