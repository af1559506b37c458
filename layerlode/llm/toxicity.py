"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.llm.boosting import Boosted, Isotonic
from layerlode.llm.common import bounded_sample, small_batches, tidy

#: At most so many labelled documents, in the order of a hash, are fitted on; every fifth calibrates.
TRAIN_ROWS, THRESHOLD, NEAR = 6000, 0.5, 8
_WINDOW = 50
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros ti tuyo tus".split())
_TOKEN = re.compile(r"[^\W_][\w'@$*!]*")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
_ODD = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
_SPACED = re.compile(r"(?:\b[^\W\d_]\b[ .\-_*]){3,}")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_PREFIXES = range(4, 9)
_CACHE = 1 << 18
FEATURES = ("weight_rate", "hit_rate", "window_weight", "word_rate", "prefix_rate", "near_you_rate", "you_rate", "masked_hit_rate", "odd_rate", "spaced_rate", "repeat_rate", "capitals", "shouted_rate", "exclaim_rate", "question_rate", "punctuation", "digits", "log_tokens", "distinct_hits")


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of word beginnings that toxic texts use more."""

    words: dict[str, float]
    prefixes: dict[str, float]

    def weigh(self, word: str) -> tuple[float, int]:
        """(weight, 1 for a whole word or 2 for a beginning or 0)."""
        if word in self.words:
            return self.words[word], 1
        return max(((self.prefixes[word[:k]], 2) for k in _PREFIXES if word[:k] in self.prefixes), default=(0.0, 0))


def build_lexicon(texts: list[str], toxic: np.ndarray, least_docs: int = 4, least_odds: float = 1.5, chance: float = 0.05) -> Lexicon:
    """Words and beginnings of 4 to 8 letters that toxic texts hold more often.

    One is taken if ``least_docs`` different toxic texts hold it, its odds are e^``least_odds`` times as high in them and
    the likelihood ratio statistic of its presence is one that, over all words tried, comes up by chance with a probability
    under ``chance``; its weight is the logarithm of the odds ratio. A beginning covers words only where it has more evidence than each.
    """
    held: list[Counter] = [Counter(), Counter()]
    totals = [0, 0]
    for text, kind in {t: int(k) for t, k in zip(texts, toxic, strict=True)}.items():
        own = {t.lower() for t in _TOKEN.findall(text)}
        totals[kind] += 1
        held[kind].update(own)
        held[kind].update({"^" + w[:k] for w in own for k in _PREFIXES if len(w) > k})
    names = [w for w, n in held[1].items() if n >= least_docs]
    a, b = np.array([held[1][w] for w in names], dtype=float), np.array([held[0][w] for w in names], dtype=float)
    odds = np.log((a + 0.5) / (totals[1] - a + 0.5)) - np.log((b + 0.5) / (totals[0] - b + 0.5))
    share = (a + b) / max(sum(totals), 1)
    evidence = np.zeros(len(names))
    for n, total in ((a, totals[1]), (b, totals[0])):
        for part, expected in ((n, total * share), (total - n, total * (1 - share))):
            evidence += 2 * part * np.log(np.where(part > 0, part / np.maximum(expected, 1e-12), 1))
    words: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    good = np.flatnonzero((odds >= least_odds) & (evidence >= 2 * np.log(max(len(names), 1) / chance)))
    for i in sorted(good.tolist(), key=lambda i: (-evidence[i], -len(names[i]), names[i])):
        name = names[i].removeprefix("^")
        if any(name[:k] in prefixes for k in _PREFIXES if k <= len(name)) or (name != names[i] and any(w.startswith(name) for w in (*words, *prefixes))):
            continue
        (words if name == names[i] else prefixes)[name] = float(odds[i])
    return Lexicon(words, prefixes)


class Featuriser:
    """Dense features of texts, with a bounded memory of words seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: dict[str, int] = {}
        self.weights: list[tuple[float, int]] = []

    def _code(self, token: str) -> int:
        """0 for an ordinary word, 1 for one that addresses the reader, else where its weight is."""
        low = token.lower()
        weight, kind = self.lexicon.weigh(low)
        if not kind and not low.isalpha():
            weight, kind = self.lexicon.weigh(low.translate(_PLAIN))
            kind = 3 if kind else 0
        if kind:
            self.weights.append((weight, kind))
            code = len(self.weights) + 1
        else:
            code = 1 if low in SECOND_PERSON else 0
        if len(self.seen) >= _CACHE:
            self.seen.clear()
            self.weights = [(weight, kind)] if kind else []
            code = 2 if kind else code
        self.seen[token] = code
        return code

    def features(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text)
        n, chars = max(len(tokens), 1), max(len(text), 1)
        get, codes = self.seen.get, []
        for t in tokens:
            c = get(t)
            codes.append(self._code(t) if c is None else c)
            if c is None and len(self.seen) == 1:  # the memory was emptied: codes from before it mean nothing now
                return self.features(text) if len(set(tokens)) < _CACHE else self._plain(text, tokens)
        return self._row(text, tokens, np.array(codes, dtype=np.int64), self.weights, n, chars)

    def _plain(self, text: str, tokens: list[str]) -> list[float]:
        """As above without the memory, for a text with more words than it holds."""
        weights: list[tuple[float, int]] = []
        codes = []
        for t in tokens:
            low = t.lower()
            weight, kind = self.lexicon.weigh(low)
            if not kind and not low.isalpha():
                weight, kind = self.lexicon.weigh(low.translate(_PLAIN))
                kind = 3 if kind else 0
            if kind:
                weights.append((weight, kind))
            codes.append(len(weights) + 1 if kind else int(low in SECOND_PERSON))
        return self._row(text, tokens, np.array(codes, dtype=np.int64), weights, max(len(tokens), 1), max(len(text), 1))

    @staticmethod
    def _row(text: str, tokens: list[str], codes: np.ndarray, table: list[tuple[float, int]], n: int, chars: int) -> list[float]:
        at = np.flatnonzero(codes > 1)
        you = np.flatnonzero(codes == 1)
        held = [table[c - 2] for c in codes[at]]
        weights, kinds = np.array([w for w, _ in held]), np.array([k for _, k in held], dtype=np.int64)
        window = near = 0.0
        if len(at):
            sums = np.concatenate([[0.0], np.cumsum(weights)])
            window = float((sums[np.searchsorted(at, at + _WINDOW)] - sums[np.arange(len(at))]).max())
        if len(at) and len(you):
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = float((gap <= NEAR).sum())
        upper = sum(map(str.isupper, tokens))
        raw = text.encode("utf-8", errors="replace")
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
        marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        masks = int(counts[[42, 64, 36, 33]].sum() + counts[48:58].sum())
        odd = len(_ODD.findall(text)) if masks else 0
        return [
            float(weights.sum()) / n, len(at) / n, window, float((kinds == 1).sum()) / n, float((kinds == 2).sum()) / n,
            near / n, len(you) / n, float((kinds == 3).sum()) / n, odd / n, len(_SPACED.findall(text)) / n, len(_REPEAT.findall(text)) / n,
            float(counts[65:91].sum()) / letters, upper / n, float(counts[33]) / chars, float(counts[63]) / chars, marks / chars,
            float(counts[48:58].sum()) / chars, float(np.log1p(len(tokens))), float(len({tokens[i].lower() for i in at})),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.features(t or "") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.predict(self.trees.margin(x))


def fit_texts(texts: list[str], toxic: np.ndarray) -> ToxicityModel | None:
    """Fit on texts in this order: lexicon and trees on four of five, calibration on every fifth.

    Trees see each half of their rows through the lexicon of the other half, so that densities are those of new texts;
    the lexicon of both halves is kept. Null if either class is missing from a part.
    """
    part = np.arange(len(texts)) % 5
    kinds = [(part == 0) | (part == 2), (part == 1) | (part == 3), part == 4]
    if any(len(np.unique(toxic[k])) < 2 for k in kinds):
        return None
    own = [([t for t, k in zip(texts, kind, strict=True) if k], toxic[kind]) for kind in kinds]
    rows = [Featuriser(build_lexicon(*own[1 - i])).matrix(own[i][0]) for i in (0, 1)]
    trees = Boosted().fit(np.concatenate(rows), np.concatenate([own[0][1], own[1][1]]))
    lexicon = build_lexicon(own[0][0] + own[1][0], np.concatenate([own[0][1], own[1][1]]))
    return ToxicityModel(lexicon, trees, Isotonic().fit(trees.margin(Featuriser(lexicon).matrix(own[2][0])), own[2][1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel | None:
    """Fit on at most ``train_rows`` labelled documents, the first in the order of a hash of their ids.

    Labels other than 0 and 1, null ids and null texts aren't used; an id with both labels counts as toxic, and of
    texts with the same id the least is used.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known, train_rows, F.xxhash64("doc_id"), known.count()).drop("_hash")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.toArrow().to_pandas() if train_rows else None
    if rows is None or rows.empty:
        return None
    order = np.argsort([hash_order(i) for i in rows["doc_id"]], kind="stable")
    rows = rows.iloc[order]
    return fit_texts(rows["text"].tolist(), rows["toxic"].to_numpy("int64"))


def hash_order(doc_id: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id))


def _chunks(texts: pa.Array, most: int = 256) -> Iterator[list[str | None]]:
    for i in range(0, len(texts), most):
        yield texts.slice(i, most).to_pylist()


def _predict(shared, column: int, threshold: float | None):
    """With a threshold the rows under it, else (doc_id, probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        featuriser = Featuriser(model.lexicon)
        for batch in batches:
            texts = batch.column(column)
            parts = [model.probabilities(featuriser.matrix(x)) for x in _chunks(texts)]
            p = np.concatenate(parts) if parts else np.zeros(0)
            if threshold is None:
                null = texts.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, mask=null)], names=["doc_id", "toxic_probability"])
            else:
                yield batch.filter(pa.array((p < threshold) | texts.is_null().to_numpy(zero_copy_only=False)))

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Probability that each document is toxic, and whether it reaches ``threshold``.

    Features are computed over whole texts: densities of a lexicon learnt from labelled rows (words and beginnings of
    words, also behind characters that stand for letters), the densest stretch of 50 tokens, hits within ``NEAR``
    tokens of a word that addresses the reader, capitals, punctuation, digits and rates of obfuscation. Boosted trees
    give a margin, isotonic regression a probability. Model and lexicon are fitted on at most ``train_rows`` labelled
    documents of which ``docs`` has the text; every row is scored.

    One row for each row: doc_id, toxic_probability, is_toxic. A null text has a null probability and isn't toxic; an
    empty one is scored. Without labels of both kinds every probability is null. Repeated rows score alike, null ids
    are kept, an empty table gives no rows, and other columns aren't read.
    """
    small_batches(docs.sparkSession)
    model = fit_toxicity(docs, labels, train_rows)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(None).cast("double").alias("toxic_probability"), F.lit(False).alias("is_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = spread(narrow).mapInArrow(tidy(_predict(shared, 1, None)), "doc_id bigint, toxic_probability double")
    return scored.withColumn("is_toxic", F.coalesce(F.col("toxic_probability") >= threshold, F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't toxic as ``toxicity_scores`` has it. Rows pass through one task;
    nothing is joined or moved. Without a model all stay."""
    small_batches(docs.sparkSession)
    model = fit_toxicity(docs, labels, train_rows)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return spread(docs).mapInArrow(tidy(_predict(shared, docs.columns.index("text"), threshold)), docs.schema)


__all__ = ["ToxicityModel", "build_lexicon", "drop_toxic", "fit_texts", "fit_toxicity", "toxicity_scores"]
