"""From objects with vectors to named layers of topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.operators import clustering, density, exemplars, naming, phrases, prompts, subtopics
from layerlode.operators.embedders import Embedder, HashedNgrams, embed_texts
from layerlode.operators.keyphrases import KeyphraseBuilder
from layerlode.operators.ranking import missing_vectors
from layerlode.operators.trees import TopicTree
from layerlode.sources import store
from layerlode.sources.corpus import joined_texts


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of a fit. ``method``: density, persistence or k_means; ``prompt_format``: combined or system_user."""

    method: str = "density"
    min_clusters: int = 6
    min_samples: int = 5
    base_min_cluster_size: int | None = 10
    base_clusters: int | None = None
    quantile: float = 0.85
    max_layers: int | None = None
    keyphrase_builder: KeyphraseBuilder = KeyphraseBuilder()
    exemplar_method: str = "central"
    keyphrase_method: str = "information_weighted"
    subtopic_method: str = "central"
    n_exemplars: int = 8
    n_keyphrases: int = 16
    n_subtopics: int = 16
    lowest_detail: float = 0.0
    highest_detail: float = 1.0
    object_description: str = "documents"
    corpus_description: str = "a collection"
    wording: str = "default"
    prompt_format: str = "combined"
    delimiters: tuple[str, str] = ('"', '"')
    namer: naming.Namer = field(default_factory=naming.TemplateNamer)
    embedder: Embedder = field(default_factory=HashedNgrams)
    object_to_text: object = None
    #: Where every request, its reply and what was wrong with it are written as lines of JSON; null: nowhere.
    events: str | None = None


@dataclass(repr=False)
class TopicModel:
    """Frames of a fitted model. topics: layer, cluster, name, summary, explanation, size, keyphrases, exemplars, subtopics, prompt."""

    assignments: DataFrame
    tree_edges: DataFrame
    centroids: DataFrame
    vocabulary: DataFrame
    topics: DataFrame
    n_layers: int

    def __repr__(self) -> str:
        """Counts alone, as a job each on tables that are written."""
        return f"TopicModel(n_samples={self.assignments.where('layer = 0').count()}, n_topics={self.topics.count()}, n_layers={self.n_layers})"

    def names_of_objects(self) -> DataFrame:
        return naming.names_of_objects(self.assignments, self.topics)

    def names_wide(self) -> DataFrame:
        return naming.names_wide(self.assignments, self.topics, self.n_layers)

    def tree(self, prune_duplicates: bool = True) -> TopicTree:
        return TopicTree.of(self.tree_edges, self.topics, self.assignments.select("object_id").distinct().count(), prune_duplicates)

    def tables(self) -> dict[str, DataFrame]:
        return {"assignments": self.assignments, "tree_edges": self.tree_edges, "centroids": self.centroids, "vocabulary": self.vocabulary, "topics": store.topic_rows(self.topics), "memberships": store.membership(self.assignments)}

    def write(self, path: str) -> None:
        store.write_model(self.tables(), path)


def cluster(vectors: DataFrame, config: PipelineConfig, metric: str = "cosine") -> DataFrame:
    """(object_id, layer, cluster) by the configured method."""
    c = config
    if c.method == "density":
        return density.density_layers(vectors, c.min_clusters, c.min_samples, c.base_min_cluster_size, c.base_clusters, c.quantile, c.max_layers, metric=metric)
    if c.method == "persistence":
        return density.persistent_layers(vectors, c.min_clusters, c.min_samples, c.base_min_cluster_size or 10, c.max_layers or 10, metric=metric).drop("persistence")
    if c.method == "k_means":
        return clustering.k_means_layers(vectors, c.base_clusters or 1024, c.min_clusters)
    raise ValueError(f"no such clustering method: {c.method}")


def _asked(config: PipelineConfig, requests: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Replies to prompts, written at once so that no reply is asked for twice."""
    found = store.written(naming.replies(requests, config.namer, prompts.prompt_text(config.prompt_format), keys), name)
    if config.events is not None:
        asked = requests.select(*keys, prompts.prompt_text(config.prompt_format).alias("prompt"))
        told = found.join(asked, keys).withColumns({"event": F.lit(name), "namer": F.lit(type(config.namer).__name__), "error": F.when(F.col("reply").isNull() | (F.col("reply") == ""), F.lit("no reply"))})
        store.write_events(told, config.events)
    return found


def _named(config: PipelineConfig, requests: DataFrame) -> DataFrame:
    """(layer, cluster, name, summary, explanation); skipped prompts carry their name."""
    pattern = naming.SUMMARY_REPLY if config.wording == "summary" else naming.NAME_REPLY
    found = _asked(config, requests.where(~F.col("prompt.skip")), ["layer", "cluster"], "replies")
    fields = {"name": "topic_name", "summary": "topic_summary", "explanation": "topic_analysis"}
    parsed = found.select("layer", "cluster", *[naming.parsed_field(F.col("reply"), f, pattern).alias(k) for k, f in fields.items()])
    skipped = requests.where("prompt.skip").select("layer", "cluster", F.col("prompt.user").alias("name"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("explanation"))
    return parsed.withColumn("name", F.coalesce("name", F.lit(""))).unionByName(skipped)


def _told_apart(config: PipelineConfig, names: DataFrame, facts: DataFrame) -> DataFrame:
    """Names after alike ones were sent back in groups; a name that three topics share is sent back once more."""
    own = names.select("layer", "cluster", "name")
    for again in (False, True):
        if again and naming.repeated_names(own).isEmpty():
            break
        vectors = embed_texts(own.select("layer", "cluster", F.col("name").alias("text")), ["layer", "cluster"], config.embedder).withColumnRenamed("vector", "v")
        groups = naming.chunked_groups(naming.rename_groups(own, vectors))
        known = facts.select("layer", "cluster", "keyphrases", "exemplars", "kind_index", *[c for c in ("major", "minor", "subtopics") if c in facts.columns])
        told = groups.join(own, ["layer", "cluster"]).join(known, ["layer", "cluster"])
        requests = store.written(prompts.rename_prompts(told, config.object_description, config.corpus_description, prompts.WORDINGS[config.wording]), "rename_prompts")
        if requests.isEmpty():
            break
        keys = ["layer", "group_id", "chunk"]
        replies = _asked(config, requests, keys, "renames").join(requests, keys)
        own = store.written(naming.apply_renames(own, replies.select("layer", "clusters", naming.renamed(F.col("reply"), F.col("old_names")).alias("new_names"))), "names")
    return own


def fit(objects: DataFrame, config: PipelineConfig | None = None, assignments: DataFrame | None = None) -> TopicModel:
    """Cluster ``objects(object_id, text, embedding)`` in layers and name every cluster.

    ``assignments`` of an earlier clustering are used as they are. A column ``map`` of few dimensions is clustered in place
    of the embeddings. What doesn't depend on names is computed for all
    layers at once; only subtopics, prompts and names go layer by layer, from fine to coarse.
    """
    config = config or PipelineConfig()
    keys = ["layer", "cluster"]
    vectors = objects.select("object_id", "embedding")
    if assignments is None and "map" in objects.columns:
        assignments = cluster(objects.select("object_id", F.col("map").cast("array<double>").alias("embedding")), config, "euclidean")
    layers = store.written(assignments if assignments is not None else cluster(vectors, config), "assignments")
    n_layers = layers.agg(F.max("layer")).first()[0]
    if n_layers is None:
        raise ValueError("there are no layers")
    n_layers += 1
    edges = store.written(clustering.cluster_tree(layers), "tree_edges")
    centroids = store.written(clustering.centroids(layers, vectors), "centroids")
    chosen = store.written(exemplars.exemplars(layers, vectors, config.n_exemplars, config.exemplar_method), "exemplars")
    if config.object_to_text is not None:
        objects = joined_texts(objects, chosen, config.object_to_text)
    terms, counts = config.keyphrase_builder.fit_transform(objects)
    counts = store.written(counts, "term_counts")
    ranked = store.written(phrases.candidates(counts, layers, terms, terms, config.n_keyphrases, "information_weighted"), "candidates") if config.keyphrase_method == "information_weighted" else None
    needed = terms.join(ranked.select("term_id").distinct(), "term_id", "left_semi") if ranked is not None else terms
    empty = needed.limit(0).select("term_id", F.array().cast("array<double>").alias("vector"))
    held = store.written(embed_texts(missing_vectors(needed, empty).select("term_id", F.col("term").alias("text")), ["term_id"], config.embedder), "term_vectors")
    keyphrases = phrases.ordered_lists(phrases.keyphrases(counts, layers, terms, held, config.n_keyphrases, config.keyphrase_method), "term", "keyphrases")
    samples = phrases.ordered_lists(chosen.join(objects.select("object_id", "text"), "object_id"), "text", "exemplars")
    sizes = clustering.cluster_sizes(layers)
    detail = F.broadcast(prompts.detail_levels(layers, config.lowest_detail, config.highest_detail).select("layer", "kind_index"))
    facts = store.written(sizes.join(keyphrases, keys, "left").join(samples, keys, "left").join(detail, "layer"), "facts")
    names, subs, asked = None, None, None
    none = F.array().cast("array<string>")
    for layer in range(n_layers):
        own = facts.where(F.col("layer") == layer)
        if layer == 0:
            own = own.withColumns({"subtopics": none, "major": none, "minor": none, "inherited": F.lit(None).cast("string")})
        else:
            low = names.where("layer = 0")
            vectors_low = embed_texts(low.select(F.col("cluster").alias("sub_cluster"), F.col("name").alias("text")), ["sub_cluster"], config.embedder).withColumnRenamed("vector", "v")
            picked = subtopics.subtopics(layers.where(F.col("layer").isin(0, layer)), vectors_low, config.n_subtopics, config.subtopic_method)
            item = F.concat_ws("\n", "name", "summary", "explanation") if config.wording == "summary" else F.col("name")
            listed = phrases.ordered_lists(picked.join(low.select(F.col("cluster").alias("sub_cluster"), item.alias("item")), "sub_cluster"), "item", "subtopics")
            inherited = prompts.inherited_names(edges.where(F.col("parent_layer") == layer), names).withColumnRenamed("name", "inherited")
            own = own.join(listed, keys, "left").join(prompts.major_minor(edges.where(F.col("parent_layer") == layer), names), keys, "left").join(inherited, keys, "left")
        own = store.written(own, "described")
        requests = store.written(prompts.name_prompts(own, config.object_description, config.corpus_description, prompts.WORDINGS[config.wording], delimiters=config.delimiters), "prompts")
        found = store.written(_named(config, requests), "names")
        apart = _told_apart(config, found, own)
        found = store.written(found.drop("name").join(apart, keys), "names")
        names = found if names is None else names.unionByName(found)
        texts = requests.select(*keys, F.col("prompt.combined").alias("prompt"))
        asked = texts if asked is None else asked.unionByName(texts)
        told = own.select(*keys, "subtopics")
        subs = told if subs is None else subs.unionByName(told)
    topics = facts.drop("kind_index").join(names, keys).join(store.written(subs, "subtopics"), keys, "left").join(asked, keys, "left")
    topics = topics.select("layer", "cluster", "name", "summary", "explanation", "size", "keyphrases", "exemplars", "subtopics", "prompt")
    return TopicModel(layers, edges, centroids, terms, store.written(topics, "topics"), n_layers)


def fit_predict(objects: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """object_id and a column of names for each layer."""
    return fit(objects, config).names_wide()
