"""Registered queries by name, and their SQL for another engine where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerlode.functions import ids
from layerlode.functions.text import truncate_middle, words
from layerlode.functions.vectors import cosine_distance
from layerlode.operators import audit, clustering, density, exemplars, keyphrases, naming, phrases, prompts, ranking, subtopics, trees
from layerlode.operators.embedders import embed_texts
from layerlode.plans.fixtures import Fixture
from layerlode.plans.sql import query
from layerlode.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Callable[[Fixture], DataFrame]], Callable[[Fixture], DataFrame]]:
    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Fixture(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- the flagship: a row for each finest cluster, from texts and vectors alone ----------------------------------


@registered(
    query(
        """, weights as (
    select term_id, pow(greatest(held + greatest(1 - covered, 0) * 0.1 / (n + 0.1) * ln(0.1 / (n + 0.1)), 0), 2) as weight from (
        select term_id, sum((c + 0.1 * q) / (n + 0.1) * ln((c + 0.1 * q) / (n + 0.1) / q)) as held, sum(q) as covered, any_value(n) as n from (
            select term_id, c, q, sum(c) over (partition by term_id) as n from d4_classes join (
                select cluster, sum(c) / sum(sum(c)) over () as q from d4_classes where layer = 0 group by cluster) using (cluster) where layer = 0) group by term_id)
), ranked as (
    select cluster, term, row_number() over (partition by cluster order by score desc, term) as r from (
        select cluster, term, round(s * weight, 6) as score from d4_classes join weights using (term_id) join d4_terms using (term_id) where layer = 0) where score > 0
), top as (
    select cluster, string_agg(term, ', ' order by r) as keyphrases, string_agg(term, ' / ' order by r) filter (where r <= 3) as name from ranked where r <= 5 group by cluster
), central as (
    select cluster, min_by(object_id, distance * 1e9 + object_id) as exemplar from far where layer = 0 group by cluster
)
select s.cluster, size, keyphrases, name, exemplar, parent_layer, parent_cluster from sizes s left join top using (cluster) left join central using (cluster)
    left join edges on child_layer = 0 and child_cluster = s.cluster where s.layer = 0""",
        "d4_classes", "d4_terms", "sizes", "far", "edges",
    ).replace("\n, weights", ", weights")
)
def flagship(f: Fixture) -> DataFrame:
    """Size, five keyphrases, a name, the central exemplar and the parent of every finest cluster."""
    low = f.assignments.where("layer = 0")
    scores = ranking.information_scores(f.classes.where("layer = 0"))
    lists = phrases.ordered_lists(ranking.top_terms(scores, f.terms, 5), "term", "k")
    best = Window.partitionBy("cluster").orderBy("distance", "object_id")
    central = exemplars.distances_to_centroid(low, f.vectors).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("cluster", F.col("object_id").alias("exemplar"))
    tree = f.edges.where("child_layer = 0").select(F.col("child_cluster").alias("cluster"), "parent_layer", "parent_cluster")
    named = lists.select("cluster", F.array_join("k", ", ").alias("keyphrases"), F.array_join(F.slice("k", 1, 3), " / ").alias("name"))
    return clustering.cluster_sizes(low).drop("layer").join(named, "cluster", "left").join(central, "cluster", "left").join(tree, "cluster", "left")


# ---- sources ------------------------------------------------------------------------------------------------------


@registered(query("select object_id, lang, source, label, length(text) as n_chars, len(v) as dims from objects", "objects"))
def corpus_objects(f: Fixture) -> DataFrame:
    return f.objects.select("object_id", "lang", "source", "label", F.length("text").alias("n_chars"), F.size("embedding").alias("dims"))


@registered(query("select object_id, layer, cluster, 255 as strength from assignments where cluster >= 0", "assignments"))
def membership_matrix(f: Fixture) -> DataFrame:
    return store.membership(f.assignments).withColumnRenamed("member", "strength")


@registered(
    """select doc_id, case when length(text) <= 2000 then text else substr(text, 1, 1000) || ' ...[' || (length(text) - 2000) || ' characters left out]... ' || right(text, 1000) end as text
    from documents"""
)
def log_truncate(f: Fixture) -> DataFrame:
    return f.table("documents").select("doc_id", truncate_middle(F.col("text"), 2000).alias("text"))


@registered()
def model_round_trip(f: Fixture) -> DataFrame:
    """The model written, read again and compared: (table, rows, same)."""
    return store.round_trip(f.spark, {"assignments": f.assignments, "tree_edges": f.edges, "topics": f.topics})


# ---- texts, vocabulary, counts -------------------------------------------------------------------------------------


@registered(query("select object_id, count(*) as n_tokens, count(distinct w) as n_distinct, md5(string_agg(w, ' ' order by pos)) as tokens from d4_tok group by object_id", "d4_tok"))
def tokens_per_doc(f: Fixture) -> DataFrame:
    own = f.documents.select("object_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    return own.select("object_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("tokens"))


@registered(query("select term_id, term, occurrences from d4_terms", "d4_terms"))
def vocabulary(f: Fixture) -> DataFrame:
    return f.terms


@registered(query("select term, count(*) as occurrences from d4_grams group by term qualify rank() over (order by count(*) desc) <= 1000", "d4_grams"))
def vocabulary_with_ties(f: Fixture) -> DataFrame:
    return keyphrases.tie_keeping_top_of(f.tokens, 1000)


@registered(query("select object_id, term_id, n from d4_counts", "d4_counts"))
def term_counts_coo(f: Fixture) -> DataFrame:
    return f.counts


@registered(query("select layer, cluster, object_id, term_id, n from d4_counts join assignments using (object_id) where cluster >= 0", "d4_counts", "assignments"))
def term_counts_trimmed(f: Fixture) -> DataFrame:
    return keyphrases.trimmed_counts(f.cells, f.assignments)


@registered()
def tokenizer_ngrams(f: Fixture) -> DataFrame:
    """Counts of n-grams of a callable tokenizer: here runs of characters up to white space, marks kept."""
    found = keyphrases.custom_grams(f.documents, str.split, 1, 2, ())
    return found.groupBy("term").agg(F.count("*").alias("occurrences"))


@registered(
    query(
        """select object_id, case when rank is null then '' else html end as text from (select page_id as object_id, html from pages)
    left join (select *, row_number() over (partition by k order by md5('s-' || page_id), page_id) as rank from (select page_id, split_part(url, '/', 3) as k from pages) qualify rank <= 3) c on c.page_id = object_id"""
    )
)
def exemplar_texts_of_pages(f: Fixture) -> DataFrame:
    """Objects that aren't texts: only exemplars of each host are turned into text, the others are empty."""
    from layerlode.sources.corpus import joined_texts

    pages = f.table("pages").select(F.col("page_id").alias("object_id"), "url", "html")
    hosts = pages.select("object_id", F.lit(0).alias("layer"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    order = Window.partitionBy("host").orderBy(F.md5(F.concat(F.lit("s-"), F.col("object_id").cast("string"))), "object_id")
    chosen = hosts.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return joined_texts(pages, chosen, lambda df: F.col("html")).select("object_id", "text")


# ---- clusters and their tree ---------------------------------------------------------------------------------------


@registered(query("select layer, cluster, size from sizes", "sizes"))
def cluster_sizes(f: Fixture) -> DataFrame:
    return clustering.cluster_sizes(f.assignments)


@registered(query("select layer, cluster, cast(pos - 1 as int) as pos, round(m, 6) as value from centres", "centres"))
def cluster_centroids(f: Fixture) -> DataFrame:
    own = clustering.centroids(f.assignments, f.vectors)
    return own.select("layer", "cluster", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@registered(query("select cast(pos - 1 as int) as pos, round(m, 6) as value from overall", "overall"))
def null_topic(f: Fixture) -> DataFrame:
    return clustering.null_topic(f.vectors).select(F.posexplode("null_topic").alias("pos", "value")).withColumn("value", F.round("value", 6))


@registered(query("select parent_layer, parent_cluster, child_layer, child_cluster from edges", "edges"))
def cluster_tree(f: Fixture) -> DataFrame:
    return f.edges


@registered(query("select layer, cast(floor(quantile_cont(size, 0.8)) as bigint) as next_size from sizes group by layer", "sizes"))
def next_min_cluster_size(f: Fixture) -> DataFrame:
    return clustering.next_min_cluster_size(f.assignments)


@registered(
    """with a as (select doc_id as object_id, 0 as layer, case when lang = 'en' then -1 else cast(replace(source, 'src', '') as int) * 3 + 1 end as cluster from documents where source like 'src%'),
    k as (select cluster, row_number() over (order by cluster) - 1 as new from (select distinct cluster from a where cluster >= 0))
    select object_id, 0 as layer, cast(coalesce(new, -1) as int) as cluster from a left join k using (cluster)"""
)
def relabel_contiguous(f: Fixture) -> DataFrame:
    number = F.replace("source", F.lit("src"), F.lit("")).cast("int") * 3 + 1
    own = f.documents.where(F.col("source").startswith("src")).select("object_id", F.lit(0).alias("layer"), F.when(F.col("lang") == "en", F.lit(-1)).otherwise(number).alias("cluster"))
    return clustering.relabel(own)


@registered(
    query(
        """select a as object_id, round(d, 6) as core_distance from (select x.object_id as a, sqrt(greatest(2 - 2 * list_cosine_similarity(x.v, y.v), 0)) as d,
    row_number() over (partition by x.object_id order by list_cosine_similarity(x.v, y.v) desc) as r from objects x join objects y on x.object_id <> y.object_id) where r = 5""",
        "objects",
    )
)
def knn_core_distance(f: Fixture) -> DataFrame:
    """Distance to the fifth neighbour, on vectors of unit length."""
    return density.core_distances(density.unit_vectors(f.vectors), 5).select("object_id", F.round("core_distance", 6).alias("core_distance"))


@registered()
def mutual_reachability_tree(f: Fixture) -> DataFrame:
    """Edges of the minimum spanning tree under mutual reachability."""
    return density.spanning_tree(density.unit_vectors(f.vectors), 5)


@registered()
def density_layers(f: Fixture) -> DataFrame:
    return density.density_layers(f.vectors, min_clusters=1, min_samples=3, base_min_cluster_size=4)


@registered()
def persistent_layers(f: Fixture) -> DataFrame:
    """Layers at the peaks of total leaf persistence, with the persistence of each layer."""
    return density.persistent_layers(f.vectors, min_clusters=1, min_samples=3, base_min_cluster_size=4)


@registered()
def k_means_layers(f: Fixture) -> DataFrame:
    return clustering.k_means_layers(f.vectors, base_clusters=64, min_clusters=4)


# ---- vectors -------------------------------------------------------------------------------------------------------


@registered(query("select layer, cluster, object_id, distance from far", "far"))
def cosine_to_centroid(f: Fixture) -> DataFrame:
    return exemplars.distances_to_centroid(f.assignments, f.vectors).select("layer", "cluster", "object_id", "distance")


@registered(
    query(
        """select a.layer, a.cluster, b.cluster as other, round(1 - list_cosine_similarity(a.c, b.c), 6) as distance
    from (select layer, cluster, list(m order by pos) as c from centres group by layer, cluster) a join (select layer, cluster, list(m order by pos) as c from centres group by layer, cluster) b
    on a.layer = b.layer and a.cluster < b.cluster""",
        "centres",
    )
)
def pairwise_cosine(f: Fixture) -> DataFrame:
    """Distances between all centroids of a layer: as many pairs as topics squared, none of objects."""
    a = clustering.centroids(f.assignments, f.vectors).select("layer", "cluster", "centroid")
    b = a.select("layer", F.col("cluster").alias("other"), F.col("centroid").alias("c"))
    return a.join(b, "layer").where("cluster < other").select("layer", "cluster", "other", F.round(cosine_distance(F.col("centroid"), F.col("c")), 6).alias("distance"))


@registered(
    query(
        """select term_id, cast(pos - 1 as int) as pos, round(sum(n * x) / sum(n), 6) as value from d4_counts join cells using (object_id) group by term_id, pos""",
        "d4_counts", "cells",
    ),
)
def term_vectors(f: Fixture) -> DataFrame:
    own = ranking.term_vectors(f.cells, f.vectors)
    return own.select("term_id", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@registered(query("select term_id, term, occurrences from d4_terms where occurrences < 10", "d4_terms"))
def missing_term_vectors(f: Fixture) -> DataFrame:
    """Terms to embed where only those that occur ten times or more have vectors."""
    known = f.terms.where("occurrences >= 10").select("term_id", F.array(F.lit(1.0)).alias("vector"))
    return ranking.missing_vectors(f.terms, known)


@registered()
def embedded_names(f: Fixture) -> DataFrame:
    """Vectors of topic names by the offline embedder."""
    return embed_texts(f.names.select("layer", "cluster", F.col("name").alias("text")), ["layer", "cluster"])


# ---- keyphrases ----------------------------------------------------------------------------------------------------


@registered(query("select layer, cluster, term_id, c, round(s, 6) as s from d4_classes", "d4_classes"))
def class_term_counts(f: Fixture) -> DataFrame:
    return f.classes.withColumn("s", F.round("s", 6))


_BM25 = """, dl as (select layer, cluster, sum(c) as dl from d4_classes group by layer, cluster), l as (select layer, count(*) as classes, avg(dl) as avgdl from dl group by layer),
scored as (select layer, cluster, term, round(c / (1.5 * (0.25 + 0.75 * dl / avgdl) + c) * ln(1 + (classes - df + 0.5) / (df + 0.5)), 6) as score
    from (select *, count(*) over (partition by layer, term_id) as df from d4_classes) join dl using (layer, cluster) join l using (layer) join d4_terms using (term_id))
select layer, cluster, cast(rank as int) as rank, term, score from (select *, row_number() over (partition by layer, cluster order by score desc, term) as rank from scored where score > 0) where rank <= 16"""


@registered(query(_BM25, "d4_classes", "d4_terms").replace("\n, dl", ", dl"))
def bm25_scores(f: Fixture) -> DataFrame:
    return ranking.top_terms(ranking.bm25(f.classes), f.terms, 16).drop("term_id")


_WEIGHTS = """, shares as (select layer, cluster, sum(c) / sum(sum(c)) over (partition by layer) as q from d4_classes group by layer, cluster),
weights as (select layer, term_id, pow(greatest(held + greatest(1 - covered, 0) * 0.1 / (n + 0.1) * ln(0.1 / (n + 0.1)), 0), 2) as weight from (
    select layer, term_id, sum((c + 0.1 * q) / (n + 0.1) * ln((c + 0.1 * q) / (n + 0.1) / q)) as held, sum(q) as covered, any_value(n) as n
    from (select *, sum(c) over (partition by layer, term_id) as n from d4_classes) join shares using (layer, cluster) group by layer, term_id))
"""


@registered(query(_WEIGHTS + "select layer, term_id, round(weight, 6) as weight from weights", "d4_classes").replace("\n, shares", ", shares"))
def information_weights(f: Fixture) -> DataFrame:
    return ranking.information_weights(f.classes).withColumn("weight", F.round("weight", 6))


@registered(
    query(
        _WEIGHTS
        + """select layer, cluster, cast(rank as int) as rank, term, score from (select *, row_number() over (partition by layer, cluster order by score desc, term) as rank from (
        select layer, cluster, term, round(s * weight, 6) as score from d4_classes join weights using (layer, term_id) join d4_terms using (term_id)) where score > 0) where rank <= 64""",
        "d4_classes", "d4_terms",
    ).replace("\n, shares", ", shares")
)
def information_scores(f: Fixture) -> DataFrame:
    return ranking.top_terms(ranking.information_scores(f.classes), f.terms, 64).drop("term_id")


@registered(
    query(
        """, vecs as (select term_id, pos, sum(n * x) / sum(n) as x from d4_counts join cells using (object_id) group by term_id, pos),
centred as (select term_id, pos, x - avg(x) over (partition by pos) as x from vecs),
mid as (select layer, cluster, pos, sum(c * x) / sum(c) as m from d4_classes join centred using (term_id) group by layer, cluster, pos),
apart as (select layer, cluster, term_id, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as distance from d4_classes join centred using (term_id) join mid using (layer, cluster, pos) group by layer, cluster, term_id)
select layer, cluster, cast(rank as int) as rank, term_id, term, distance from (select *, row_number() over (partition by layer, cluster order by distance, term) as rank from apart join d4_terms using (term_id)) where rank <= 64""",
        "d4_counts", "d4_classes", "d4_terms", "cells",
    ).replace("\n, vecs", ", vecs"),
)
def central_keyphrase_order(f: Fixture) -> DataFrame:
    return ranking.central_terms(f.classes, f.term_vectors, f.terms, 8)


def _keyphrases(method: str) -> Callable[[Fixture], DataFrame]:
    def run(f: Fixture) -> DataFrame:
        return phrases.keyphrases(f.cells, f.assignments, f.terms, f.term_vectors, 8, method)

    run.__name__ = f"keyphrases_{method}"
    return run


for _method in phrases.METHODS:
    registered()(_keyphrases(_method))


@registered()
def longest_keyphrases(f: Fixture) -> DataFrame:
    return phrases.longest_only(ranking.top_terms(ranking.information_scores(f.classes), f.terms, 64))


# ---- exemplars -----------------------------------------------------------------------------------------------------


@registered(query("select layer, cluster, cast(r as int) as rank, object_id, distance from (select *, row_number() over (partition by layer, cluster order by distance, object_id) as r from far) where r <= 16", "far"))
def central_exemplar_top16(f: Fixture) -> DataFrame:
    return exemplars.central_candidates(f.assignments, f.vectors, 4).select("layer", "cluster", "rank", "object_id", "distance")


@registered(query("select layer, cluster, rank, object_id from chosen where rank <= 4", "chosen"))
def exemplars_random(f: Fixture) -> DataFrame:
    return exemplars.exemplars(f.assignments, f.vectors, 4, "random")


@registered(
    query(
        """, units as (select object_id, pos, x / sqrt(sum(x * x) over (partition by object_id)) as u from cells),
sums as (select layer, cluster, pos, sum(u) as t from units join assignments using (object_id) where cluster >= 0 group by layer, cluster, pos),
totals as (select a.layer, a.cluster, object_id, round(sum(u * t), 6) as total from assignments a join units using (object_id) join sums using (layer, cluster, pos) group by a.layer, a.cluster, object_id)
select layer, cluster, object_id, total from (select *, row_number() over (partition by layer, cluster order by total desc, object_id) as r from totals) where r = 1""",
        "cells", "assignments",
    ).replace("\n, units", ", units")
)
def medoid(f: Fixture) -> DataFrame:
    return exemplars.medoids(f.assignments, f.vectors)


def _exemplars(method: str) -> Callable[[Fixture], DataFrame]:
    def run(f: Fixture) -> DataFrame:
        return exemplars.exemplars(f.assignments, f.vectors, 4, method)

    run.__name__ = f"exemplars_{method}"
    return run


for _method in exemplars.METHODS:
    if _method != "random":
        registered()(_exemplars(_method))


# ---- subtopics -----------------------------------------------------------------------------------------------------


def _name_vectors(f: Fixture) -> DataFrame:
    """Vectors of layer 0: here its clusters' centroids, which SQL can follow."""
    return clustering.centroids(f.assignments, f.vectors).where("layer = 0").select(F.col("cluster").alias("sub_cluster"), F.col("centroid").alias("v"))


@registered(
    query(
        """, subs as (select cluster as sub_cluster, pos, m - avg(m) over (partition by pos) as x from centres where layer = 0),
mid as (select layer, cluster, pos, avg(x) as m from co join subs using (sub_cluster) group by layer, cluster, pos),
apart as (select layer, cluster, sub_cluster, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as distance from co join subs using (sub_cluster) join mid using (layer, cluster, pos) group by layer, cluster, sub_cluster)
select layer, cluster, cast(row_number() over (partition by layer, cluster order by distance, sub_cluster) as int) as rank, sub_cluster, distance from apart""",
        "centres", "co",
    ).replace("\n, subs", ", subs")
)
def subtopic_candidates(f: Fixture) -> DataFrame:
    return subtopics.central_order(f.assignments, _name_vectors(f)).select("layer", "cluster", "rank", "sub_cluster", "distance")


@registered(query("select layer, sub_cluster, max(cluster) as cluster from co group by layer, sub_cluster", "co"))
def subtopic_owner(f: Fixture) -> DataFrame:
    return subtopics.owners(f.assignments)


def _subtopics(method: str) -> Callable[[Fixture], DataFrame]:
    def run(f: Fixture) -> DataFrame:
        return subtopics.subtopics(f.assignments, _name_vectors(f), 4, method)

    run.__name__ = f"subtopics_{method}"
    return run


for _method in subtopics.METHODS:
    registered()(_subtopics(_method))


@registered(
    query(
        """select layer, cluster, string_agg(name || chr(10) || 'About ' || name || chr(10) || 'n = ' || s.size, chr(10) || '--' || chr(10) order by sub_cluster) as items
    from co join names n on n.layer = 0 and n.cluster = sub_cluster join sizes s on s.layer = 0 and s.cluster = sub_cluster group by co.layer, co.cluster""".replace("select layer, cluster", "select co.layer, co.cluster"),
        "co", "names", "sizes",
    ),
)
def summary_subtopics(f: Fixture) -> DataFrame:
    """Name, summary and explanation of each subtopic as one text."""
    own = f.names.join(clustering.cluster_sizes(f.assignments), ["layer", "cluster"])
    told = own.select("layer", "cluster", "name", F.concat(F.lit("About "), "name").alias("summary"), F.concat(F.lit("n = "), F.col("size").cast("string")).alias("explanation"))
    chosen = subtopics.co_occurring(f.assignments).withColumn("rank", F.col("sub_cluster"))
    return subtopics.summary_items(chosen, told).select("layer", "cluster", F.array_join("items", "\n--\n").alias("items"))


# ---- prompts -------------------------------------------------------------------------------------------------------


@registered(query("select layer, round(detail, 6) as detail, kind_index from levels", "levels"))
def detail_levels(f: Fixture) -> DataFrame:
    return prompts.detail_levels(f.assignments).withColumn("detail", F.round("detail", 6))


@registered(query("select layer, cluster, name from inherited", "inherited"))
def skip_prompts(f: Fixture) -> DataFrame:
    return prompts.inherited_names(f.edges, f.names)


@registered(query("select layer, cluster, array_to_string(major, '|') as major, array_to_string(minor, '|') as minor from major_minor", "major_minor"))
def major_minor_subtopics(f: Fixture) -> DataFrame:
    return prompts.major_minor(f.edges, f.names).select("layer", "cluster", F.array_join("major", "|").alias("major"), F.array_join("minor", "|").alias("minor"))


@registered(query("select layer, cluster, skip, prompt from prompts", "prompts"))
def topic_prompt_text(f: Fixture) -> DataFrame:
    return prompts.name_prompts(f.clusters).select("layer", "cluster", "prompt.skip", F.col("prompt.combined").alias("prompt"))


@registered(
    query(
        """select layer, case when len(n) = 0 then 'topics found in a collection' when len(n) = 1 then n[1] else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end as larger
    from (select layer, list_sort(list_distinct(list(name)))[1:3] as n from names group by layer)""",
        "names",
    ),
)
def larger_topic(f: Fixture) -> DataFrame:
    return f.names.groupBy("layer").agg(prompts.larger_topic(F.collect_list("name")).alias("larger"))


# ---- naming --------------------------------------------------------------------------------------------------------


@registered(query("select layer, name, count(*) as n from names group by layer, name having count(*) >= 2", "names"))
def duplicate_names(f: Fixture) -> DataFrame:
    return naming.repeated_names(f.names, 2)


@registered(
    """select layer, group_id, cast((r - 1) // 12 as int) as chunk, cast((r - 1) % 12 + 1 as int) as position, cluster from (
    select 0 as layer, cast(replace(lang, 'x', '') = 'en' as int) as group_id, doc_id as cluster, row_number() over (partition by lang = 'en' order by doc_id) as r from documents where lang is not null)"""
)
def rename_chunks(f: Fixture) -> DataFrame:
    own = f.table("documents").where("lang is not null").select(F.lit(0).alias("layer"), (F.col("lang") == "en").cast("int").alias("group_id"), F.col("doc_id").alias("cluster"))
    return naming.chunked_groups(own)


_REPLY = """case lang when 'en' then 'Sure. {"topic_name": "' || w || '", "topic_specificity": 0.5} Bye.' when 'de' then '{"topic_name": "\\q' || w || '\\\\", "topic_specificity": 0.5}'
    when 'fr' then 'no reply for ' || w else '{"topic_name": "a\\"b ' || w || '", "topic_specificity": high}' end"""


@registered(
    r"""with r as (select doc_id, """
    + _REPLY
    + r""" as reply from (select doc_id, lang, source as w from documents)),
    f as (select doc_id, regexp_extract(reply, '(?s)\{\s*"topic_name".*?"topic_specificity"\s*:\s*[^\s{}]+\s*\}', 0) as j from r),
    p as (select doc_id, j, replace(replace(replace(replace(replace(j, '\\', chr(1)), '\"', chr(2)), '\', '\\'), chr(2), '\"'), chr(1), '\\') as fixed from f)
    select doc_id, case when json_valid(j) then json_extract_string(j, '$.topic_name') when json_valid(fixed) then json_extract_string(fixed, '$.topic_name') end as name from p"""
)
def llm_json_parse(f: Fixture) -> DataFrame:
    """Names out of replies with text around them, lone backslashes, or no JSON."""
    w = F.col("source")
    reply = (
        F.when(F.col("lang") == "en", F.concat(F.lit('Sure. {"topic_name": "'), w, F.lit('", "topic_specificity": 0.5} Bye.')))
        .when(F.col("lang") == "de", F.concat(F.lit('{"topic_name": "\\q'), w, F.lit('\\\\", "topic_specificity": 0.5}')))
        .when(F.col("lang") == "fr", F.concat(F.lit("no reply for "), w))
        .otherwise(F.concat(F.lit('{"topic_name": "a\\"b '), w, F.lit('", "topic_specificity": high}')))
    )
    return f.table("documents").select("doc_id", naming.parsed_field(reply, "topic_name").alias("name"))


@registered(
    """select doc_id, case when lang = 'en' then 'new ' || source || '|' || 'by index|' || lang when lang = 'de' then 'x|y|z' end as names from documents"""
)
def rename_mapping(f: Fixture) -> DataFrame:
    """Renamed lists from mappings: by "i. old name", by "i.", by position, and none."""
    old = F.array("source", F.lit("b"), "lang")
    by_key = F.concat(F.lit('{"new_topic_name_mapping": {"1. '), "source", F.lit('": "new '), "source", F.lit('", "2.": "by index", "other": "z"}, "topic_specificities": [0.1]}'))
    by_position = F.lit('{"new_topic_name_mapping": {"1. q": "x", "1. q": "y", "3. r": "z",}, "topic_specificities": [0.1]}')
    reply = F.when(F.col("lang") == "en", by_key).when(F.col("lang") == "de", by_position).otherwise(F.lit("none"))
    return f.table("documents").select("doc_id", F.array_join(naming.renamed(reply, old), "|").alias("names"))


@registered(query("select object_id, a.layer, coalesce(name, 'Unlabelled') as name from assignments a left join names n on n.layer = a.layer and n.cluster = a.cluster", "assignments", "names"))
def topic_name_vector(f: Fixture) -> DataFrame:
    return naming.names_of_objects(f.assignments, f.names)


@registered()
def rename_groups(f: Fixture) -> DataFrame:
    """Topics whose names the offline embedder puts close together."""
    vectors = embed_texts(f.names.select("layer", "cluster", F.col("name").alias("text")), ["layer", "cluster"])
    return naming.rename_groups(f.names, vectors.withColumnRenamed("vector", "v"))


# ---- trees, identifiers, reports -----------------------------------------------------------------------------------


@registered(query("select layer, cluster, replace(replace(to_base64(unhex(lpad(to_hex((layer << 10) | (cluster + 1)), 6, '0'))), '+', '-'), '/', '_') as uid from sizes", "sizes"))
def topic_uid(f: Fixture) -> DataFrame:
    return clustering.cluster_sizes(f.assignments).select("layer", "cluster", ids.topic_uid(F.col("layer"), F.col("cluster")).alias("uid"))


@registered(query("select layer, cluster, layer as uid_layer, cluster as uid_cluster from sizes", "sizes"))
def uid_decode(f: Fixture) -> DataFrame:
    own = clustering.cluster_sizes(f.assignments).withColumn("uid", ids.topic_uid(F.col("layer"), F.col("cluster")))
    return own.select("layer", "cluster", ids.uid_layer(F.col("uid")).alias("uid_layer"), ids.uid_cluster(F.col("uid")).alias("uid_cluster"))


_LABELS = """select layer, cluster, layer || '_' || cluster || ': ' || name || ' (' || size || ' objects) [' || printf('%.2f', size / (select count(*) from objects) * 100) || '%]' as label
    from sizes join names using (layer, cluster)"""


def _labels(f: Fixture) -> DataFrame:
    total = F.broadcast(f.objects.agg(F.count("*").alias("n_objects")))
    own = clustering.cluster_sizes(f.assignments).join(f.names, ["layer", "cluster"]).crossJoin(total)
    return own.select("layer", "cluster", "name", "size", "n_objects", trees.topic_label(F.col("layer"), F.col("cluster"), F.col("name"), F.col("size"), F.col("n_objects")).alias("label"))


@registered(query(_LABELS, "sizes", "names", "objects"))
def topic_label(f: Fixture) -> DataFrame:
    return _labels(f).select("layer", "cluster", "label")


@registered(
    query(
        f", labels as ({_LABELS})" + trees.TREE_SQL.replace("with recursive walk", ", walk"), "sizes", "names", "objects", "edges"
    ).replace("\n, labels", ", labels"),
)
def tree_text(f: Fixture) -> DataFrame:
    return trees.tree_lines(f.edges, _labels(f))


@registered(
    query(
        """select 'L' || child_layer || '_C' || child_cluster as id, 'L' || parent_layer || '_C' || parent_cluster as parent, name as label, size as value
    from edges join sizes s on s.layer = child_layer and s.cluster = child_cluster join names n on n.layer = child_layer and n.cluster = child_cluster
    union all select 'L' || top || '_C0', '', 'Everything | ' || sum(size) || '/' || (select count(*) from objects) || ' clustered (' || printf('%.2f', sum(size) / (select count(*) from objects) * 100) || '%)', cast(sum(size) as bigint)
    from sizes, tops where layer = top - 1 group by top""",
        "edges", "sizes", "names", "objects", "tops",
    ),
)
def treemap(f: Fixture) -> DataFrame:
    return trees.treemap(f.edges, _labels(f))


@registered(query("select layer, count(*) as num_clusters, avg(size) as avg_cluster_size, min(size) as min_cluster_size, max(size) as max_cluster_size, count(distinct name) as unique_topic_names, count(name) - count(distinct name) as duplicate_topic_names, bool_or(len(coalesce(subtopics, [])) > 0) as has_subtopics from topics group by layer", "topics"))
def layer_summary(f: Fixture) -> DataFrame:
    return audit.layer_summary(f.topics)


_AUDIT = """select t.layer, t.cluster as cluster_id, size as num_documents, coalesce(array_to_string(keyphrases[1:5], ', '), '') as top_5_keyphrases,
    array_to_string(coalesce(keyphrases, []), '|') as all_keyphrases, cast(len(coalesce(keyphrases, [])) as int) as num_keyphrases, cast(len(coalesce(exemplars, [])) as int) as num_exemplars,
    coalesce(substr(exemplars[1], 1, 300) || '...', '') as first_exemplar, coalesce(array_to_string(subtopics[1:5], ', '), '') as subtopics_text,
    case when length(prompt) > 500 then substr(prompt, 1, 500) || '...' else prompt end as prompt_preview, cast(length(prompt) as int) as prompt_length, coalesce(name, '') as llm_topic_name, document_indices
    from topics t join (select layer, cluster, string_agg(cast(object_id as varchar), ',' order by object_id) as document_indices from assignments where cluster >= 0 group by layer, cluster) d on d.layer = t.layer and d.cluster = t.cluster"""


def _flat_audit(own: DataFrame) -> DataFrame:
    joined = own.withColumns({"all_keyphrases": F.array_join("all_keyphrases", "|"), "document_indices": F.array_join(F.col("document_indices").cast("array<string>"), ",")})
    return joined.drop("subtopics_list")


@registered(query(_AUDIT, "topics", "assignments"))
def audit_all_layers(f: Fixture) -> DataFrame:
    return _flat_audit(audit.cluster_audit(f.topics, f.assignments))


@registered(query(_AUDIT + " where t.layer = 1", "topics", "assignments"))
def audit_clusters(f: Fixture) -> DataFrame:
    return _flat_audit(audit.cluster_audit(f.topics, f.assignments, 1))


@registered(
    query(
        """select cluster as "Cluster ID", size as "Document Count", coalesce(array_to_string(keyphrases[1:5], ', '), '') as "Extracted Keyphrases (Top 5)", cast(len(coalesce(exemplars, [])) as int) as "Exemplar Count",
    coalesce(array_to_string(subtopics[1:5], ', '), '') as "Child Subtopics", coalesce(name, '') as "Final LLM Topic Name" from topics where layer = 1""",
        "topics",
    ),
)
def audit_comparison(f: Fixture) -> DataFrame:
    return audit.comparison(f.topics, f.assignments, 1)


@registered(
    query(
        """select cluster as cluster_id, cast(i - 1 as int) as position, k as keyphrase, name as llm_topic_name, contains(lower(name), lower(k)) as keyphrase_in_topic
    from (select cluster, name, unnest(keyphrases) as k, generate_subscripts(keyphrases, 1) as i from topics where layer = 0)""",
        "topics",
    ),
)
def audit_keyphrases(f: Fixture) -> DataFrame:
    return audit.keyphrase_analysis(f.topics, 0)


@registered(
    query(
        """select layer, cluster as cluster_id, cast(length(prompt) as int) as prompt_length, cast((length(prompt) - length(replace(prompt, 'Sample:', ''))) // 7 as int) as num_exemplars_in_prompt,
    cast(len(list_filter(keyphrases[1:10], lambda k: contains(lower(prompt), lower(k)))) as int) as num_keyphrases_in_prompt, name as topic_name, cast(length(name) as int) as topic_name_length from topics""",
        "topics",
    ),
)
def audit_prompts(f: Fixture) -> DataFrame:
    return audit.prompt_analysis(f.topics)


@registered(query("select object_id, text, (select count(*) from assignments where layer = 2 and cluster = 0) as total_count from assignments join objects using (object_id) where layer = 2 and cluster = 0", "assignments", "objects"))
def cluster_documents(f: Fixture) -> DataFrame:
    return audit.cluster_documents(f.assignments, f.objects, 2, 0)


@registered(query("select layer, cluster, name, size, array_to_string(keyphrases, '|') as keyphrases, array_to_string(exemplars, '|') as exemplars, array_to_string(subtopics, '|') as subtopics, prompt from topics where layer = 2 and cluster = 1", "topics"))
def cluster_details(f: Fixture) -> DataFrame:
    own = audit.cluster_details(f.topics, 2, 1)
    return own.withColumns({c: F.array_join(c, "|") for c in ("keyphrases", "exemplars", "subtopics")})


@registered(query("select layer, string_agg(name, '|' order by cluster) as names from names group by layer", "names"))
def names_per_layer(f: Fixture) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("cluster", "name")))
    return f.names.groupBy("layer").agg(F.array_join(F.transform(items, lambda s: s["name"]), "|").alias("names"))


@registered()
def fit_end_to_end(f: Fixture) -> DataFrame:
    """The whole pipeline, from texts and vectors to the names of every object in each layer."""
    from layerlode.plans.pipeline import PipelineConfig, fit

    model = fit(f.objects.select("object_id", "text", "embedding"), PipelineConfig(method="k_means", base_clusters=16, min_clusters=4))
    return model.names_wide()
