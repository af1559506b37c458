"""Report tables on a fitted model. ``topics`` has a row for each cluster: layer, cluster, name, size, keyphrases, exemplars
(texts), subtopics, prompt (text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def cluster_members(assignments: DataFrame, layer: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(layer, cluster, object_id), with the text of ``texts(object_id, text)`` where given: the long form of what an audit
    lists, for clusters of any size."""
    own = assignments.where("cluster >= 0") if layer is None else assignments.where((F.col("cluster") >= 0) & (F.col("layer") == layer))
    own = own.select("layer", "cluster", "object_id")
    return own if texts is None else own.join(texts.select("object_id", "text"), "object_id", "left").select("layer", "cluster", "object_id", "text")


def cluster_audit(
    topics: DataFrame,
    assignments: DataFrame,
    layer: int | None = None,
    include_all_docs: bool = False,
    max_docs_per_cluster: int | None = None,
    original_texts: DataFrame | None = None,
    indices: bool = True,
) -> DataFrame:
    """What led to each name, and the ids of the cluster's objects. ``layer`` None: all layers.

    ``include_all_docs`` adds the texts of ``original_texts(object_id, text)`` in the order of ids: document_texts of
    clusters with at most ``max_docs_per_cluster`` members, for larger ones the first so many as document_sample beside
    total_docs_in_cluster. A row that lists members holds all of them; for clusters too large for one
    row ask without ``indices`` and read ``cluster_members``.
    """
    if include_all_docs and original_texts is None:
        raise ValueError("include_all_docs needs original_texts")
    own = topics if layer is None else topics.where(F.col("layer") == layer)
    first = F.get(_list("exemplars"), F.lit(0))
    prompt = F.coalesce("prompt", F.lit(""))
    columns = [
        "layer",
        F.col("cluster").alias("cluster_id"),
        F.col("size").alias("num_documents"),
        F.array_join(F.slice(_list("keyphrases"), 1, 5), ", ").alias("top_5_keyphrases"),
        _list("keyphrases").alias("all_keyphrases"),
        F.size(_list("keyphrases")).alias("num_keyphrases"),
        F.size(_list("exemplars")).alias("num_exemplars"),
        F.coalesce(F.concat(F.substring(first, 1, 300), F.lit("...")), F.lit("")).alias("first_exemplar"),
        F.slice(_list("subtopics"), 1, 5).alias("subtopics_list"),
        F.array_join(F.slice(_list("subtopics"), 1, 5), ", ").alias("subtopics_text"),
        F.when(F.length(prompt) > 500, F.concat(F.substring(prompt, 1, 500), F.lit("..."))).otherwise(prompt).alias("prompt_preview"),
        F.length(prompt).alias("prompt_length"),
        F.coalesce("name", F.lit("")).alias("llm_topic_name"),
    ]
    if indices:
        members = cluster_members(assignments, layer).groupBy("layer", "cluster").agg(F.array_sort(F.collect_list("object_id")).alias("document_indices"))
        own = own.join(members, ["layer", "cluster"], "left")
        columns.append(F.coalesce("document_indices", F.array().cast("array<bigint>")).alias("document_indices"))
    if include_all_docs:
        told = cluster_members(assignments, layer, original_texts)
        total = Window.partitionBy("layer", "cluster")
        told = told.withColumns({"_n": F.count("*").over(total), "_r": F.row_number().over(total.orderBy("object_id"))})
        if max_docs_per_cluster is not None:
            told = told.where(F.col("_r") <= max_docs_per_cluster)
        listed = told.groupBy("layer", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda s: s["text"]).alias("_texts"), F.first("_n").alias("_n"))
        own = own.join(listed, ["layer", "cluster"], "left")
        cut = F.col("_n") > max_docs_per_cluster if max_docs_per_cluster is not None else F.lit(False)
        columns += [F.when(~cut, F.col("_texts")).alias("document_texts"), F.when(cut, F.col("_texts")).alias("document_sample"), F.when(cut, F.col("_n")).alias("total_docs_in_cluster")]
    return own.select(*columns)


def comparison(topics: DataFrame, assignments: DataFrame, layer: int | None = 0) -> DataFrame:
    own = cluster_audit(topics, assignments, layer, indices=False)
    return own.select(
        F.col("cluster_id").alias("Cluster ID"), F.col("num_documents").alias("Document Count"), F.col("top_5_keyphrases").alias("Extracted Keyphrases (Top 5)"),
        F.col("num_exemplars").alias("Exemplar Count"), F.col("subtopics_text").alias("Child Subtopics"), F.col("llm_topic_name").alias("Final LLM Topic Name"),
    )


def keyphrase_analysis(topics: DataFrame, layer: int = 0, most: int = 10) -> DataFrame:
    """Whether each of a cluster's first keyphrases occurs in its name."""
    own = topics.where(F.col("layer") == layer).select("cluster", "name", F.posexplode(F.slice(_list("keyphrases"), 1, most)).alias("position", "keyphrase"))
    return own.select(F.col("cluster").alias("cluster_id"), "position", "keyphrase", F.col("name").alias("llm_topic_name"), F.contains(F.lower("name"), F.lower("keyphrase")).alias("keyphrase_in_topic"))


def prompt_analysis(topics: DataFrame, mark: str = "Sample:") -> DataFrame:
    """Lengths of prompts and names, and how many samples and keyphrases a prompt holds."""
    low = F.lower("prompt")
    inside = F.size(F.filter(F.slice(_list("keyphrases"), 1, 10), lambda k: F.contains(low, F.lower(k))))
    marks = ((F.length("prompt") - F.length(F.replace("prompt", F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    return topics.where("prompt is not null").select("layer", F.col("cluster").alias("cluster_id"), F.length("prompt").alias("prompt_length"), marks.alias("num_exemplars_in_prompt"), inside.alias("num_keyphrases_in_prompt"), F.col("name").alias("topic_name"), F.length("name").alias("topic_name_length"))


def layer_summary(topics: DataFrame) -> DataFrame:
    return topics.groupBy("layer").agg(
        F.count("*").alias("num_clusters"),
        F.avg("size").alias("avg_cluster_size"),
        F.min("size").alias("min_cluster_size"),
        F.max("size").alias("max_cluster_size"),
        F.count_distinct("name").alias("unique_topic_names"),
        (F.count("name") - F.count_distinct("name")).alias("duplicate_topic_names"),
        F.max(F.size(_list("subtopics")) > 0).alias("has_subtopics"),
    )


def cluster_documents(assignments: DataFrame, objects: DataFrame, layer: int, cluster: int, most: int | None = None) -> DataFrame:
    """(object_id, text, total_count) of a cluster's objects in the order of ids, the first ``most``."""
    own = assignments.where((F.col("layer") == layer) & (F.col("cluster") == cluster)).select("object_id")
    total = F.broadcast(own.agg(F.count("*").alias("total_count")))
    chosen = own if most is None else own.orderBy("object_id").limit(most)
    return chosen.join(objects.select("object_id", "text"), "object_id").crossJoin(total).select("object_id", "text", "total_count")


def cluster_details(topics: DataFrame, layer: int, cluster: int) -> DataFrame:
    own = topics.where((F.col("layer") == layer) & (F.col("cluster") == cluster))
    return own.select("layer", "cluster", F.coalesce("name", F.lit("N/A")).alias("name"), "size", _list("keyphrases").alias("keyphrases"), _list("exemplars").alias("exemplars"), _list("subtopics").alias("subtopics"), F.coalesce("prompt", F.lit("")).alias("prompt"))
