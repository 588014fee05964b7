"""Toxicity by compression distance.

zstandard dictionaries are trained on toxic and on ordinary text.  A window of a document is compressed with
both; its margin is the number of bytes by which the toxic dictionary does better.  Windows come in two
sizes side by side, each with a pair of dictionaries of its own: ``SHORT``, of one word, and ``LONG``, of
``LONG_WORDS`` words, which overlap by LONG_WORDS - LONG_STEP so that a phrase of a few words always lies whole in one.
A document's largest margins of each size, summed, and its length go through a logistic curve that is
calibrated on labelled documents; so a phrase of words that are ordinary one by one counts, too.

Choices that make the distance sharp:

* In short windows each UTF-16 unit is written as three bytes before compression, so that a stretch which a
  dictionary lacks costs several times what a reference to it costs; without that, margins of short words
  vanish.  Such a window is compressed doubled, so that both encoders have to write one sequence in any
  case and the frame's fixed costs cancel.
* Toxic documents are mostly ordinary text.  The toxic dictionary of short windows is trained on those windows
  of toxic documents that hold a character gram which is ``ratio`` times as frequent in toxic as in
  ordinary documents; of RATIOS the calibration texts choose one.  The other three dictionaries are trained on all windows of their documents.
* The largest of many margins is large by chance.  The curve therefore knows the logarithm of the number of distinct
  words, LEAST_WORDS at least, since few labelled documents are shorter.

Training reads at most ``max_docs`` labelled texts of each class, the first by a hash of their id, and of these at
most ``max_long`` of more than ``max_chars`` characters; scoring reads every word of every document.

Edge cases: a null text counts as empty; a text without words has no windows and margins of zero; a document
of any length is scored whole; ids labelled both toxic and not are not learnt from; without both classes
among the training rows nothing can be learnt and every score is 0.  Repeated rows are scored alike; of texts
that share an id each is learnt from, within the bounds above.  Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import ByPlace, cut, pick, shared

#: Margins of each size of window that make up a document's statistic.
TOP = 2
#: Words of a long window, and words from one to the next.
LONG_WORDS, LONG_STEP = 16, 12
#: Distinct words that a document counts as having at least.
LEAST_WORDS = 100
#: How much more frequent a gram has to be in toxic documents, of which calibration chooses.
RATIOS = (12.0, 6.0)

_UNITS = (np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
#: Three bytes for each UTF-16 unit, from a multiplicative hash.
_CODES = np.stack([(_UNITS >> np.uint64(shift)) & np.uint64(255) for shift in (16, 8, 0)], axis=1).astype(np.uint8)


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries (toxic, ordinary) of short and long windows, and the curve's weights of both statistics, of log length, and 1."""

    short: tuple[bytes, bytes] = (b"", b"")
    long: tuple[bytes, bytes] = (b"", b"")
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def score(self, statistics: tuple[float, float, float]) -> float:
        if not any(self.weights):
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, (*statistics, 1.0)))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def long_windows(words: list[str]) -> list[bytes]:
    """Runs of LONG_WORDS words, LONG_STEP apart; the whole text if it is shorter."""
    last = max(1, len(words) - (LONG_WORDS - LONG_STEP))
    return [" ".join(words[i : i + LONG_WORDS]).encode("utf-8", "surrogatepass") for i in range(0, last, LONG_STEP)] if words else []


def _wide(text: str) -> bytes:
    return _CODES[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")].tobytes()


def _compressor(dictionary: bytes, strong: bool) -> zstd.ZstdCompressor:
    """strong: the optimal parser, whose lengths are comparable for a few bytes; else a fast one."""
    form = {"format": zstd.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    if strong:
        params = zstd.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=14, search_log=5, min_match=6, target_length=32, strategy=zstd.STRATEGY_BTOPT, **form
        )
    else:
        params = zstd.ZstdCompressionParameters.from_level(5, source_size=128, dict_size=len(dictionary), **form)
    content = zstd.ZstdCompressionDict(dictionary)
    content.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=content, compression_params=params)


class Scorer:
    """Statistics of texts; margins of short windows are remembered in two generations of at most memory words each."""

    def __init__(self, model: ToxicityModel, memory: int = 200_000):
        self.model, self.memory = model, memory
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.short = [_compressor(d, True).compress for d in model.short] if all(model.short) else None
        self.long = [_compressor(d, False).compress for d in model.long] if all(model.long) else None

    def learn(self, words: set[str]) -> None:
        """Make known the margins of all these short windows, the new ones with one dictionary after the other."""
        if len(self.known) + len(words) > self.memory:  # what is used goes on, what is not falls away
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for w in words.difference(known):
            margin = older.get(w)
            if margin is None:
                fresh.append(w)
            else:
                known[w] = margin
        whole, at, raw = _wide(" ".join([f" {w} {w} " for w in fresh])), 0, []
        for w in fresh:
            end = at + 6 * (len(w) if w.isascii() else len(w.encode("utf-16-le", "surrogatepass")) // 2) + 9
            raw.append(whole[at:end])
            at = end + 3
        toxic, ordinary = (list(map(len, map(compress, raw))) for compress in self.short)
        known.update(zip(fresh, map(int.__sub__, ordinary, toxic)))

    def long_margins(self, words: list[str]) -> list[int]:
        toxic, ordinary = self.long
        return [len(ordinary(window)) - len(toxic(window)) for window in long_windows(words)]

    def statistics(self, docs: Iterable[list[str]]) -> Iterator[tuple[float, float, float]]:
        """Of each document, given as words: sums of the TOP largest positive margins of distinct short windows and of long ones, and the
        log of the number of distinct words."""
        for group in _groups(docs):
            distinct = list(map(set, group))
            if self.short:
                self.learn(set().union(*distinct))
            margin = self.known.__getitem__
            for words, own in zip(group, distinct):
                yield (
                    _largest(map(margin, own)) if self.short else 0.0, _largest(self.long_margins(words)) if self.long else 0.0,
                    math.log(max(LEAST_WORDS, len(own))),
                )

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        return [self.model.score(s) for s in self.statistics(map(words_of, texts))]


def _groups(docs: Iterable[list[str]], words: int = 50_000) -> Iterator[list[list[str]]]:
    """Documents in groups of about so many words."""
    group, held = [], 0
    for ws in docs:
        group.append(ws)
        held += len(ws)
        if held >= words:
            yield group
            group, held = [], 0
    yield group


def _largest(margins: Iterable[int]) -> float:
    return float(sum(heapq.nlargest(TOP, [m for m in margins if m > 0])))


@lru_cache(maxsize=1)
def scorer(model: ToxicityModel) -> Scorer:
    """One for each model and process, so that what is remembered serves the process's later tasks."""
    return Scorer(model)


def _grams(window: str, size: int) -> set[str]:
    padded = f" {window} "
    return {padded[i : i + size] for i in range(len(padded) - size + 1)}


def _telling(toxic: list[list[str]], ordinary: list[list[str]], gram: int, least_docs: int, ratio: float, sigmas: float = 4.0) -> set[str]:
    """Grams whose document frequency in toxic documents is at least ratio times that in ordinary ones."""
    counts = []
    for docs in (toxic, ordinary):
        df: Counter[str] = Counter()
        for ws in docs:
            df.update(set().union(*(_grams(w, gram) for w in set(ws))) if ws else ())
        counts.append(df)
    a, b = counts
    share = max(1, len(toxic)) / max(1, len(ordinary))
    expected = {g: share * (b[g] + 0.5) for g in a}
    return {g for g, n in a.items() if n >= least_docs and n >= ratio * expected[g] and n - expected[g] >= sigmas * math.sqrt(expected[g] + 0.25)}


def _without_copies(docs: list[list[str]], sketch: int = 16, alike: float = 0.7) -> list[list[str]]:
    """Training documents, as lists of words, without those much like an earlier one.

    Groups of copies would make whatever they hold by chance look telling.  Two documents are alike if
    they share most of the words whose hashes are smallest.
    """
    held: dict[int, list[int]] = {}
    out = []
    for n, ws in enumerate(docs):
        marks = heapq.nsmallest(sketch, {zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in ws})
        shared = Counter(i for mark in marks for i in held.get(mark, ()))
        if shared and shared.most_common(1)[0][1] >= alike * len(marks):
            continue
        for mark in marks:
            held.setdefault(mark, []).append(n)
        out.append(ws)
    return out


def _dictionary(raw: list[bytes], size: int, segment: int = 64) -> bytes:
    """A trained dictionary; where there are too few samples to train one, they are repeated until there are enough."""
    raw = [r * (1 + 16 // len(r)) for r in raw]
    if not raw:
        return b""
    while sum(map(len, raw)) < 4 * 1024 or len(raw) < 32:
        raw = raw * 2
    total = sum(map(len, raw))
    for goal in (size, total // 4, total // 8, 1024, 512, 256):
        try:
            return zstd.train_dictionary(max(256, min(size, goal)), raw, k=segment, d=8, level=19).as_bytes()
        except zstd.ZstdError:
            continue
    return b""


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the last weight is that of 1."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(design.shape[1]), 1e-2 * np.eye(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Weights of the two statistics, of log length, and 1; a statistic that would speak against its label is left out."""
    use = [c for c in (0, 1) if x[:, c].any()]
    while use:
        columns = [*use, 2]
        beta = _logistic(x[:, columns], y)
        against = [c for c, b in zip(use, beta) if b <= 0]
        if not against:
            whole = np.zeros(4)
            whole[[*columns, 3]] = beta
            return tuple(whole.tolist())
        use.remove(min(against, key=lambda c: beta[use.index(c)]))
    return 0.0, 0.0, 0.0, 0.0


def fit(
    texts: list[str], labels: list[int], gram: int = 5, dict_size: int = 65536, ratios: tuple[float, ...] = RATIOS, least_share: float = 0.01
) -> ToxicityModel:
    """Train dictionaries on two thirds of the labelled texts, calibrate on the last third (on all, if that lacks a class).

    Of ratios the one is used whose curve has the smallest logarithmic loss on the calibration texts; without
    any, the toxic dictionary of short windows is trained on all of them, too.
    """
    docs = [words_of(t) for t in texts]
    part = {y: _without_copies([d for d, label in zip(docs, labels) if label == y]) for y in (0, 1)}
    if not part[0] or not part[1]:
        return ToxicityModel()
    train = {y: p[: max(1, 2 * len(p) // 3)] for y, p in part.items()}
    held = {y: p[len(train[y]) :] or p for y, p in part.items()}
    y = np.array([label for label in (0, 1) for _ in held[label]])
    words = {label: [w for ws in train[label] for w in sorted(set(ws))] for label in (0, 1)}
    ordinary = _dictionary([_wide(f" {w} ") for w in words[0]], dict_size)
    long = tuple(_dictionary([x for ws in train[label] for x in long_windows(ws)], dict_size) for label in (1, 0))
    best = (math.inf, ToxicityModel())
    for ratio in ratios or (0.0,):
        chosen = words[1]
        if ratio:
            keys = _telling(train[1], train[0], gram, max(2, math.ceil(least_share * len(train[1]))), ratio)
            chosen = [w for w in chosen if not keys.isdisjoint(_grams(w, gram))]
        short = (_dictionary([_wide(f" {w} ") for w in chosen], dict_size), ordinary)
        model = ToxicityModel(*[p if all(p) else (b"", b"") for p in (short, long)])
        own = Scorer(model)
        x = np.array(list(own.statistics([*held[0], *held[1]])))
        model = replace(model, weights=_calibrated(x, y))
        p = np.clip([model.score(tuple(row)) for row in x.tolist()], 1e-6, 1 - 1e-6)
        best = min(best, (float(-np.log(np.where(y == 1, p, 1 - p)).mean()), model), key=lambda b: b[0])
    return best[1]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = 1500, max_chars: int = 20_000, max_long: int = 100, ratios: tuple[float, ...] = RATIOS,
) -> ToxicityModel:
    """Fit on at most max_docs labelled texts of each class, those first by a hash of id; of each, max_long may have more than max_chars characters.

    The ids are chosen from the labels alone, so that documents meet a table of at most 2 * max_docs
    rows, which is broadcast, and no text is shuffled but those of the chosen ids.
    """
    known = pick(labels, id_col, label_col).toDF("id", "y").filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other").withColumn("h", F.xxhash64("id", F.lit("toxicity")))
    chosen = [known.filter(F.col("y") == y).orderBy("h", "id").limit(max_docs) for y in (0, 1)]
    texts = pick(docs, id_col, text_col).toDF("doc", "text").filter(F.col("text").isNotNull())
    both = texts.join(F.broadcast(chosen[0].union(chosen[1])), F.col("doc") == F.col("id"))
    both = cut(both.select("h", F.xxhash64("text").alias("t"), "text", "y").distinct())
    found = []
    for y in (0, 1):
        for which, most in ((F.length("text") <= max_chars, max_docs), (F.length("text") > max_chars, max_long)):
            found += both.filter(which & (F.col("y") == y)).orderBy("h", "t").limit(most).collect()
    found = sorted(found)
    return fit([r.text for r in found], [r.y for r in found], ratios=ratios)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    out = pick(docs, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_column(text: Column, model: ToxicityModel) -> Column:
    """The score of each whole text, from 0 to 1."""
    told = shared(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer(told.value)
        for texts in batches:
            yield pd.Series(own.scores(texts), dtype="float64")

    return scored(text)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, all its columns, without the rows whose text scores threshold or more."""
    own = ByPlace(docs)
    return own.back(own.df.filter(score_column(F.col(own.name(text_col)), model) < threshold))
