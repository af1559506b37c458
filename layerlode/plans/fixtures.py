"""Frames that the registered queries start from: objects, layers, counts and simple topics of the tables in a folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerlode.operators import clustering, exemplars, grams, keyphrases, prompts, ranking
from layerlode.operators.phrases import ordered_lists
from layerlode.sources import corpus, store

KEYPHRASES, EXEMPLARS, MIN_OCCURRENCES = 10, 3, 2


class Fixture:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return corpus.read(self.spark, self.folder, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").withColumnRenamed("doc_id", "object_id")

    @cached_property
    def objects(self) -> DataFrame:
        """Every document, with a vector."""
        return corpus.objects(self.table("documents"), self.table("embeddings"), shared=True)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.objects.select("object_id", "embedding")

    @cached_property
    def assignments(self) -> DataFrame:
        return corpus.label_layers(self.objects.select("object_id", "label"))

    @cached_property
    def edges(self) -> DataFrame:
        return clustering.cluster_tree(self.assignments)

    # Scores read the counts several times over: they are written once, so texts aren't cut into n-grams for each reading.

    @cached_property
    def tokens(self) -> DataFrame:
        return store.written(keyphrases.tokens_of(self.documents), "tokens")

    @cached_property
    def terms(self) -> DataFrame:
        return store.written(keyphrases.vocabulary_of(self.tokens, min_occurrences=MIN_OCCURRENCES), "vocabulary")

    @cached_property
    def cells(self) -> DataFrame:
        """(object_id, term_ids, ns): the counts, packed."""
        return store.written(keyphrases.packed_counts_of(self.tokens, self.terms), "term_counts")

    @cached_property
    def counts(self) -> DataFrame:
        return grams.unpacked(self.cells, "object_id")

    @cached_property
    def classes(self) -> DataFrame:
        return store.written(ranking.class_counts(self.cells, self.assignments), "class_counts")

    @cached_property
    def term_vectors(self) -> DataFrame:
        return ranking.term_vectors(self.cells, self.vectors)

    @cached_property
    def frequent(self) -> DataFrame:
        """(layer, cluster, rank, term): the most frequent terms of each cluster, a few for each."""
        own = self.classes.join(self.terms.select("term_id", "term"), "term_id")
        order = Window.partitionBy("layer", "cluster").orderBy(F.desc("c"), "term")
        top = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEYPHRASES)
        return store.written(top.select("layer", "cluster", "rank", "term"), "frequent")

    @cached_property
    def names(self) -> DataFrame:
        return self.frequent.where("rank = 1").select("layer", "cluster", F.col("term").alias("name"))

    @cached_property
    def samples(self) -> DataFrame:
        chosen = exemplars.random_exemplars(self.assignments, EXEMPLARS)
        return ordered_lists(chosen.join(self.documents.select("object_id", "text"), "object_id"), "text", "exemplars")

    @cached_property
    def clusters(self) -> DataFrame:
        """What a prompt is made of, for every cluster."""
        base = clustering.cluster_sizes(self.assignments)
        low = self.names.where("layer = 0").select(F.col("cluster").alias("sub_cluster"), "name")
        from layerlode.operators.subtopics import co_occurring

        subs = co_occurring(self.assignments).join(low, "sub_cluster").groupBy("layer", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_cluster", "name"))), lambda s: s["name"]).alias("subtopics"))
        keys = ["layer", "cluster"]
        out = base.join(self.names, keys, "left").join(ordered_lists(self.frequent, "term", "keyphrases"), keys, "left").join(self.samples, keys, "left").join(subs, keys, "left")
        out = out.join(prompts.major_minor(self.edges, self.names), keys, "left").join(prompts.inherited_names(self.edges, self.names).withColumnRenamed("name", "inherited"), keys, "left")
        return store.written(out.join(F.broadcast(prompts.detail_levels(base).select("layer", "kind_index")), "layer"), "clusters")

    @cached_property
    def topics(self) -> DataFrame:
        """A row for each cluster with its prompt's text, as reports read it; written, as each part of it is read again."""
        prompt = prompts.name_prompts(self.clusters).select("layer", "cluster", F.col("prompt.combined").alias("prompt"))
        return store.written(self.clusters.select("layer", "cluster", "name", "size", "keyphrases", "exemplars", "subtopics").join(prompt, ["layer", "cluster"]), "topics")
