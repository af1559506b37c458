"""Vocabulary of word n-grams and counts of its terms in each object."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.functions.text import STOP_WORDS, ngrams, words
from layerlode.operators.clustering import places
from layerlode.operators.embedders import Embedder, embed_texts
from layerlode.operators.grams import gram_cells, packed, top_grams, unpacked
from layerlode.sources.store import written

#: A vocabulary of at most so many terms is broadcast to where texts are counted.
BROADCAST_TERMS = 200_000


def tokens_of(objects: DataFrame) -> DataFrame:
    """(object_id, tokens): the words of each text, in order."""
    return spread(objects.select("object_id", "text"), "object_id").select("object_id", words(F.col("text")).alias("tokens"))


def grams_of(tokens: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS) -> DataFrame:
    """(object_id, term), a row for each occurrence of an n-gram of ``tokens(object_id, tokens)``."""
    return tokens.select("object_id", F.explode(ngrams(F.col("tokens"), low, high, stop)).alias("term"))


def grams(objects: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS) -> DataFrame:
    """(object_id, term), a row for each occurrence."""
    return grams_of(tokens_of(objects), low, high, stop)


def vocabulary(occurrences: DataFrame, max_features: int = 50_000, min_occurrences: int = 1) -> DataFrame:
    """(term_id, term, occurrences): the most frequent terms, ties in the order of the term. Counts are exact."""
    counted = occurrences.groupBy("term").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= min_occurrences)
    return _numbered(counted, max_features)


def _numbered(counted: DataFrame, max_features: int) -> DataFrame:
    top = counted.orderBy(F.desc("occurrences"), "term").limit(max_features)
    order = Window.orderBy(F.desc("occurrences"), "term")
    return top.select((F.row_number().over(order) - 1).cast("int").alias("term_id"), "term", "occurrences")


def term_counts(occurrences: DataFrame, terms: DataFrame, max_features: int = 50_000) -> DataFrame:
    """(object_id, term_id, n): a sparse matrix by its cells. The vocabulary's size is known to be ``max_features``.

    Terms become numbers and are summed within each object before anything moves; where the objects already lie by the
    hash of their id nothing moves at all.
    """
    side = terms.select("term", "term_id")
    side = F.broadcast(side) if max_features <= BROADCAST_TERMS else side
    return occurrences.join(side, "term").groupBy("object_id", "term_id").agg(F.count("*").alias("n"))


def vocabulary_of(tokens: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS, max_features: int = 50_000, min_occurrences: int = 1) -> DataFrame:
    """As ``vocabulary`` of the n-grams of ``tokens(object_id, tokens)``, whose words hold no spaces; only those that can be
    among the most frequent become strings."""
    counted = top_grams(tokens, low, high, stop, max_features, min_occurrences)
    return vocabulary(grams_of(tokens, low, high, stop), max_features, min_occurrences) if counted is None else _numbered(counted, max_features)


def packed_counts_of(tokens: DataFrame, terms: DataFrame, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS, max_features: int = 50_000) -> DataFrame:
    """(object_id, term_ids, ns): ``term_counts`` of the n-grams of ``tokens(object_id, tokens)``, whose words hold no spaces,
    the cells of an object in one row. Only where rows share an object's id do cells move."""
    if max_features > BROADCAST_TERMS:
        return packed(term_counts(grams_of(tokens, low, high, stop), terms, max_features))
    cells = gram_cells(tokens, terms, low, high, stop)
    if tokens.groupBy("object_id").count().where("count > 1").isEmpty():
        return cells
    return packed(unpacked(cells, "object_id").groupBy("object_id", "term_id").agg(F.sum("n").alias("n")))


def tie_keeping_top_of(tokens: DataFrame, most: int, low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS) -> DataFrame:
    """As ``tie_keeping_top`` of the counts of the n-grams of ``tokens(object_id, tokens)``."""
    counted = top_grams(tokens, low, high, stop, most)
    if counted is None:
        counted = grams_of(tokens, low, high, stop).groupBy("term").agg(F.count("*").alias("occurrences"))
    return tie_keeping_top(written(counted, "terms"), most)


def trimmed_counts(counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(layer, cluster, object_id, term_id, n) of clustered objects; empty rows and columns have no cells."""
    own = packed(counts).join(places(assignments).select("object_id", "places").hint("shuffle_hash"), "object_id")
    every = own.select(F.explode("places").alias("p"), "object_id", "term_ids", "ns").select("p.layer", "p.cluster", "object_id", "term_ids", "ns")
    return unpacked(every, "layer", "cluster", "object_id")


def tie_keeping_top(counted: DataFrame, most: int) -> DataFrame:
    """Terms whose count reaches the ``most``-th largest; ties at the end stay. The count at the end is found by a
    distributed top-k, so no task ranks them all."""
    least = F.broadcast(counted.select("occurrences").orderBy(F.desc("occurrences")).limit(most).agg(F.min("occurrences").alias("_least")))
    return counted.crossJoin(least).where(F.col("occurrences") >= F.col("_least")).drop("_least")


def custom_tokens(objects: DataFrame, tokenizer: Callable[[str], list[str]]) -> DataFrame:
    """As ``tokens_of`` with tokens from a callable, applied to Arrow batches of texts."""

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenizer(t) if t is not None else [])

    return spread(objects.select("object_id", "text"), "object_id").select("object_id", tokens("text").alias("tokens"))


def custom_grams(objects: DataFrame, tokenizer: Callable[[str], list[str]], low: int = 1, high: int = 4, stop: Collection[str] = STOP_WORDS, join: str = " ") -> DataFrame:
    """As ``grams`` with tokens from a callable."""
    found = grams_of(custom_tokens(objects, tokenizer), low, high, stop)
    return found if join == " " else found.withColumn("term", F.replace("term", F.lit(" "), F.lit(join)))


@dataclass(frozen=True)
class KeyphraseBuilder:
    """Settings of a vocabulary. ``object_to_text`` makes a text column from the objects' frame."""

    low: int = 1
    high: int = 4
    max_features: int = 50_000
    min_occurrences: int = 2
    stop_words: tuple[str, ...] = STOP_WORDS
    tokenizer: Callable[[str], list[str]] | None = None
    object_to_text: Callable[[DataFrame], Column] | None = None
    embedder: Embedder | None = None

    def fit_transform(self, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vocabulary, term counts), the vocabulary written. Texts are cut into words once. An empty vocabulary raises
        ``ValueError``."""
        own = objects.withColumn("text", self.object_to_text(objects)) if self.object_to_text else objects
        tokens = written(custom_tokens(own, self.tokenizer) if self.tokenizer else tokens_of(own), "tokens")
        setting = (self.low, self.high, self.stop_words, self.max_features)
        found = grams_of(tokens, *setting[:3])
        terms = written(vocabulary(found, self.max_features, self.min_occurrences) if self.tokenizer else vocabulary_of(tokens, *setting, self.min_occurrences), "vocabulary")
        if terms.isEmpty():
            raise ValueError("no term occurs often enough for the vocabulary")
        return terms, term_counts(found, terms, self.max_features) if self.tokenizer else unpacked(packed_counts_of(tokens, terms, *setting), "object_id")

    def fit_embed(self, objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """As ``fit_transform``, and (term_id, vector) of all terms by ``embedder`` or the offline one."""
        terms, counts = self.fit_transform(objects)
        return terms, counts, embed_texts(terms.select("term_id", F.col("term").alias("text")), ["term_id"], self.embedder)
