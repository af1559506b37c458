"""Requests for a topic's name, built as expressions over all clusters of a layer at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the most detailed to the plainest; a layer's level of detail picks one.
KINDS = (
    "expert, 8 to 15 words",
    "detailed and exact, 6 to 12 words",
    "specific, 4 to 8 words",
    "clear, 3 to 6 words",
    "brief, 2 to 5 words",
    "bare core, 1 to 4 words",
    "plain, 1 or 2 words",
)
FORMATS = ("combined", "system_user")


@dataclass(frozen=True)
class Wording:
    """The fixed parts of a request, by language."""

    task: str
    about: str
    keywords: str
    major: str
    minor: str
    other: str
    samples: str
    reply: str
    rename: str
    rename_reply: str


ENGLISH = Wording(
    "You name groups of {objects} taken from {corpus}. Give the group below a name that is {kind}.",
    "What is known of the group:",
    "Keywords",
    "Main subtopics",
    "Lesser subtopics",
    "Further subtopics",
    "Sample",
    'Answer with JSON alone: {"topic_name": "...", "topic_specificity": 0.0}',
    "The groups below, of {objects} on {larger}, were given names that are too alike. Give each a name of its own that is {kind}.",
    'Answer with JSON alone: {"new_topic_name_mapping": {"1. old name": "new name"}, "topic_specificities": [0.0]}',
)
FRENCH = Wording(
    "Vous nommez des groupes de {objects} tirés de {corpus}. Donnez au groupe suivant un nom {kind}.",
    "Ce que l'on sait du groupe :",
    "Mots-clés",
    "Sous-thèmes principaux",
    "Sous-thèmes secondaires",
    "Autres sous-thèmes",
    "Extrait",
    'Répondez par du JSON seul : {"topic_name": "...", "topic_specificity": 0.0}',
    "Les groupes suivants, de {objects} sur {larger}, ont des noms trop proches. Donnez à chacun un nom {kind}.",
    'Répondez par du JSON seul : {"new_topic_name_mapping": {"1. ancien": "nouveau"}, "topic_specificities": [0.0]}',
)
SUMMARY = Wording(**(ENGLISH.__dict__ | {"reply": 'Answer with JSON alone: {"topic_analysis": "...", "topic_summary": "...", "topic_name": "...", "topic_specificity": 0.0}'}))
WORDINGS = {"default": ENGLISH, "french": FRENCH, "summary": SUMMARY}


def detail_levels(layers: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(layer, detail, kind_index): levels evenly spaced from ``low`` to ``high``; halves go to the even index."""
    last = F.broadcast(layers.agg(F.max("layer").alias("_last")))
    detail = F.when(F.col("_last") > 0, F.lit(low) + F.col("layer") * (F.lit(high - low) / F.col("_last"))).otherwise(F.lit(low))
    own = layers.select("layer").distinct().crossJoin(last).select("layer", detail.alias("detail"))
    return own.withColumn("kind_index", F.bround(F.col("detail") * (len(KINDS) - 1)).cast("int"))


def kind_of(kind_index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind_index + 1)


def inherited_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(layer, cluster, name): clusters above layer 0 with one child, whose name isn't empty, keep that name."""
    only = edges.groupBy(F.col("parent_layer").alias("layer"), F.col("parent_cluster").alias("cluster")).agg(F.count("*").alias("n"), F.first("child_layer").alias("cl"), F.first("child_cluster").alias("cc"))
    child = names.select(F.col("layer").alias("cl"), F.col("cluster").alias("cc"), "name")
    return only.where("n = 1").join(child, ["cl", "cc"]).where("name <> ''").select("layer", "cluster", "name")


def _below(edges: DataFrame, names: DataFrame) -> DataFrame:
    child = names.select(F.col("layer").alias("child_layer"), F.col("cluster").alias("child_cluster"), "name")
    own = edges.join(child, ["child_layer", "child_cluster"])
    return own.select(F.col("parent_layer").alias("layer"), F.col("parent_cluster").alias("cluster"), (F.col("parent_layer") - F.col("child_layer")).alias("down"), F.col("child_layer").alias("l"), F.col("child_cluster").alias("c"), "name")


def major_minor(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(layer, cluster, major, minor): names of children one layer down, and two layers down.

    With one main child or none the lesser ones join it, and children further down become the lesser ones. Children
    come by layer from above, then by label.
    """
    own = _below(edges, names)

    def listed(condition: Column) -> Column:
        items = F.array_sort(F.collect_list(F.when(condition, F.struct((-F.col("l")).alias("k"), "c", "name"))))
        return F.transform(items, lambda s: s["name"])

    found = own.groupBy("layer", "cluster").agg(listed(F.col("down") == 1).alias("one"), listed(F.col("down") == 2).alias("two"), listed(F.col("down") > 2).alias("more"))
    few = F.size("one") <= 1
    return found.select("layer", "cluster", F.when(few, F.concat("one", "two")).otherwise(F.col("one")).alias("major"), F.when(few, F.col("more")).otherwise(F.col("two")).alias("minor"))


def _filled(text: str, **parts: Column | str) -> Column:
    """``text`` with its {slots} taken by columns."""
    out: list[Column] = []
    rest = text
    while "{" in rest and (slot := next((k for k in parts if "{" + k + "}" in rest), None)):
        slot = min((k for k in parts if "{" + k + "}" in rest), key=lambda k: rest.index("{" + k + "}"))
        before, _, rest = rest.partition("{" + slot + "}")
        value = parts[slot]
        out += [F.lit(before), F.lit(value) if isinstance(value, str) else value]
    return F.concat(*out, F.lit(rest))


def _section(title: str, items: Column, most: int, separator: str = "; ") -> Column:
    own = F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most)
    return F.when(F.size(own) > 0, F.concat(F.lit(title + ": "), F.array_join(own, separator), F.lit("\n"))).otherwise(F.lit(""))


def name_prompts(
    clusters: DataFrame,
    objects: str = "documents",
    corpus: str = "a collection",
    wording: Wording = ENGLISH,
    max_keyphrases: int = 32,
    max_subtopics: int = 16,
    max_exemplars: int = 128,
    delimiters: tuple[str, str] = ('"', '"'),
) -> DataFrame:
    """(layer, cluster, prompt struct<skip, system, user, combined>) of ``clusters(layer, cluster, kind_index, keyphrases,
    exemplars, subtopics, major, minor, inherited)``.

    Where ``inherited`` isn't null the prompt is skipped and the name is the user text. Further subtopics appear above
    layer 1 only.
    """
    none = F.array().cast("array<string>")
    first, last = delimiters
    samples = F.transform(F.slice(F.coalesce("exemplars", none), 1, max_exemplars), lambda x: F.concat(F.lit(f"{wording.samples}: {first}"), x, F.lit(f"{last}\n")))
    user = F.concat(
        F.lit(wording.about + "\n"),
        _section(wording.keywords, F.col("keyphrases"), max_keyphrases, ", "),
        _section(wording.major, F.col("major"), max_subtopics),
        _section(wording.minor, F.col("minor"), max_subtopics),
        F.when(F.col("layer") > 1, _section(wording.other, F.col("subtopics"), max_subtopics)).otherwise(F.lit("")),
        F.array_join(samples, ""),
    )
    system = F.concat(_filled(wording.task, objects=objects, corpus=corpus, kind=kind_of(F.col("kind_index"))), F.lit("\n" + wording.reply))
    skip = F.col("inherited").isNotNull()
    text = F.when(skip, F.col("inherited")).otherwise(user)
    prompt = F.struct(skip.alias("skip"), F.when(~skip, system).alias("system"), text.alias("user"), F.when(skip, F.col("inherited")).otherwise(F.concat(system, F.lit("\n\n"), user)).alias("combined"))
    return clusters.select("layer", "cluster", prompt.alias("prompt"))


def prompt_text(format: str) -> Column:
    """What a namer is given: one text, or a system and a user part as JSON."""
    if format not in FORMATS:
        raise ValueError(f"no such prompt format: {format}; there are {', '.join(FORMATS)}")
    return F.col("prompt.combined") if format == "combined" else F.to_json(F.struct("prompt.system", "prompt.user"))


def larger_topic(names: Column, corpus: str = "a collection") -> Column:
    """A phrase for a group of topics: up to three different names, joined with commas and "and"."""
    own = F.slice(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), 1, 3)
    head = F.array_join(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), ", ")
    return F.when(F.size(own) == 0, F.lit(f"topics found in {corpus}")).when(F.size(own) == 1, own[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(own, -1)))


def rename_prompts(
    groups: DataFrame, objects: str = "documents", corpus: str = "a collection", wording: Wording = ENGLISH, max_keyphrases: int = 8, max_exemplars: int = 4, max_subtopics: int = 16
) -> DataFrame:
    """(layer, group_id, chunk, old_names, prompt): ``groups(layer, group_id, chunk, position, cluster, name, keyphrases,
    exemplars, kind_index)`` as one request for each chunk of a group. Main and lesser subtopics (``major``, ``minor``) and,
    above layer 1, further ones (``subtopics``) are told where there are such columns."""
    none = F.array().cast("array<string>")
    told = [(wording.major, "major"), (wording.minor, "minor"), (wording.other, "subtopics")]
    subs = [_section(title, F.when(F.col("layer") > 1, F.col(c)) if c == "subtopics" else F.col(c), max_subtopics) for title, c in told if c in groups.columns]
    line = F.concat(
        F.lit("\n"), F.col("position").cast("string"), F.lit(". "), F.col("name"), F.lit("\n"),
        _section(wording.keywords, F.col("keyphrases"), max_keyphrases, ", "), *subs,
        F.array_join(F.transform(F.slice(F.coalesce("exemplars", none), 1, max_exemplars), lambda x: F.concat(F.lit(f'{wording.samples}: "'), x, F.lit('"\n'))), ""),
    )
    items = F.array_sort(F.collect_list(F.struct("position", "cluster", "name", line.alias("line"))))
    own = groups.groupBy("layer", "group_id", "chunk").agg(items.alias("i"), F.first("kind_index").alias("k"))
    names = F.transform("i", lambda s: s["name"])
    system = F.concat(_filled(wording.rename, objects=objects, larger=larger_topic(names, corpus), kind=kind_of(F.col("k"))), F.lit("\n" + wording.rename_reply))
    user = F.array_join(F.transform("i", lambda s: s["line"]), "")
    prompt = F.struct(F.lit(False).alias("skip"), system.alias("system"), user.alias("user"), F.concat(system, F.lit("\n"), user).alias("combined"))
    return own.select("layer", "group_id", "chunk", F.transform("i", lambda s: s["cluster"]).alias("clusters"), names.alias("old_names"), prompt.alias("prompt"))
