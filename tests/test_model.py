import random

import pytest
from pyspark.sql import functions as F

from layerlode.functions import ids
from layerlode.functions.text import ngrams, truncate_middle, words
from layerlode.operators import audit, exemplars, keyphrases, naming, phrases, subtopics
from layerlode.operators.prompts import FRENCH, name_prompts, prompt_text
from layerlode.plans.pipeline import PipelineConfig, fit, fit_predict
from layerlode.sources import store

THEMES = {"cats": "whisker paw kitten purr claw litter", "ships": "anchor sail harbor mast deck rudder", "bread": "yeast flour oven crust dough knead", "stars": "nebula orbit comet galaxy quasar planet"}


@pytest.fixture(scope="module")
def objects(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        k = i % 4
        text = " ".join(r.choices(list(THEMES.values())[k].split(), k=12))
        rows.append((i, text, [float(k == j) * 3 + r.gauss(0, 0.2) for j in range(4)] + [r.gauss(0, 0.2), float(k < 2)]))
    return spark.createDataFrame(rows, "object_id bigint, text string, embedding array<double>")


@pytest.fixture(scope="module")
def layers(spark):
    rows = [(i, 0, i % 4) for i in range(120)] + [(i, 1, i % 4 // 2) for i in range(120)]
    return spark.createDataFrame(rows, "object_id bigint, layer int, cluster int")


@pytest.fixture(scope="module")
def model(objects, layers):
    return fit(objects, PipelineConfig(n_keyphrases=5, n_exemplars=3, wording="summary"), layers)


def test_fit_names_clusters_by_their_words(model):
    rows = {(r["layer"], r["cluster"]): r for r in model.topics.collect()}
    assert len(rows) == 6 and all(r["name"] and r["prompt"] and len(r["exemplars"]) == 3 for r in rows.values())
    for k, text in enumerate(THEMES.values()):
        assert set(" ".join(rows[0, k]["keyphrases"]).split()) <= set(text.split())
        assert rows[0, k]["summary"] and rows[0, k]["explanation"]
    assert all(len(rows[1, c]["subtopics"]) == 2 for c in range(2))
    assert len({r["name"] for r in rows.values()}) >= 4
    wide = model.names_wide()
    assert wide.columns == ["object_id", "layer_0", "layer_1"] and wide.count() == 120
    assert "Topic tree:" in str(model.tree())


def test_model_is_written_and_read(spark, model, tmp_path):
    model.write(f"{tmp_path}/m")
    again = store.read_model(spark, f"{tmp_path}/m")
    for name, df in model.tables().items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again[name].collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        model.write(f"{tmp_path}/m")
    spark.createDataFrame([("0", ["x"])], "serial_version string, tables array<string>").write.parquet(f"{tmp_path}/old/metadata")
    with pytest.raises(ValueError, match="version"):
        store.read_model(spark, f"{tmp_path}/old")
    sheets = {"Layer Summary": audit.layer_summary(model.topics), "Full Audit": audit.cluster_audit(model.topics, model.assignments), "Comparison": audit.comparison(model.topics, model.assignments), "Keyphrases": audit.keyphrase_analysis(model.topics)}
    store.write_reports(sheets, f"{tmp_path}/audit", "csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/audit/layer_summary").count() == 2
    events = spark.createDataFrame([("x" * 5000, "y")], "prompt string, reply string")
    store.write_events(events, f"{tmp_path}/log")
    assert len(spark.read.json(f"{tmp_path}/log").first()["prompt"]) < 2100


@pytest.mark.parametrize("method", ["density", "persistence", "k_means"])
def test_fit_clusters_by_itself(objects, method):
    config = PipelineConfig(method=method, min_clusters=2, min_samples=3, base_min_cluster_size=5, base_clusters=4 if method == "k_means" else None, exemplar_method="facility_location", keyphrase_method="bm25", subtopic_method="facility_location", prompt_format="system_user")
    wide = fit_predict(objects, config)
    assert wide.count() == 120 and "layer_0" in wide.columns


def test_a_map_is_clustered_in_place_of_embeddings(objects):
    own = objects.withColumn("map", F.array((F.col("object_id") % 4 * 10).cast("double"), F.col("object_id").cast("double") / 1000))
    config = PipelineConfig(min_clusters=2, min_samples=3, base_min_cluster_size=10)
    layers = fit(own, config).assignments.where("layer = 0").collect()
    groups = {}
    for r in layers:
        if r["cluster"] >= 0:
            groups.setdefault(r["cluster"], set()).add(r["object_id"] % 4)
    assert len(groups) >= 4 and all(len(g) == 1 for g in groups.values())


def test_objects_that_are_no_texts(objects, layers):
    config = PipelineConfig(object_to_text=lambda df: F.concat(F.lit("thing "), (F.col("object_id") % 4).cast("string"), F.lit(" item")), n_exemplars=3)
    rows = fit(objects.drop("text"), config, layers).topics.where("layer = 0").collect()
    assert len(rows) == 4 and all(r["name"] for r in rows)


@pytest.mark.parametrize("method", phrases.METHODS)
def test_keyphrase_methods(objects, layers, method):
    found = keyphrases.grams(objects, 1, 2)
    terms = keyphrases.vocabulary(found, min_occurrences=2)
    counts = keyphrases.term_counts(found, terms)
    from layerlode.operators.ranking import term_vectors

    rows = phrases.keyphrases(counts, layers, terms, term_vectors(counts, objects), 4, method).where("layer = 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], []).append(r["term"])
    for k, text in enumerate(THEMES.values()):
        assert 1 <= len(by[k]) <= 4 and all(set(t.split()) <= set(text.split()) for t in by[k])


def test_a_cluster_without_terms_says_so(spark, objects, layers):
    found = keyphrases.grams(objects.where("object_id % 4 <> 3"), 1, 1)
    terms = keyphrases.vocabulary(found)
    vectors = terms.select("term_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    rows = phrases.keyphrases(keyphrases.term_counts(found, terms), layers, terms, vectors, 4).where("layer = 0 and cluster = 3").collect()
    assert [r["term"] for r in rows] == ["No notable keyphrases"]


@pytest.mark.parametrize("n", [1, 4, 40])
@pytest.mark.parametrize("method", exemplars.METHODS)
def test_exemplars_are_members(objects, layers, method, n):
    rows = exemplars.exemplars(layers, objects, n, method).collect()
    member = {(r["layer"], r["cluster"], r["object_id"]) for r in layers.collect()}
    assert rows and all((r["layer"], r["cluster"], r["object_id"]) in member for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault((r["layer"], r["cluster"]), []).append((r["rank"], r["object_id"]))
    for own in groups.values():
        assert sorted(k for k, _ in own) == list(range(1, len(own) + 1)) and len({i for _, i in own}) == len(own) <= n


@pytest.mark.parametrize("method", subtopics.METHODS)
def test_subtopic_methods(spark, layers, method):
    names = spark.createDataFrame([(0, [1.0, 0.1, 0.0]), (1, [0.9, 0.2, 0.1]), (2, [0.0, 1.0, 0.2]), (3, [0.1, 0.9, 0.0])], "sub_cluster int, v array<double>")
    rows = subtopics.subtopics(layers, names, 2, method).collect()
    for r in rows:
        assert r["layer"] == 1 and (method == "central_from_all" or r["sub_cluster"] // 2 == r["cluster"])
    with pytest.raises(ValueError):
        subtopics.subtopics(layers, names, 2, "none")


def test_counts_don_t_depend_on_partitions(objects):
    def cells(df):
        found = keyphrases.grams(df, 1, 3)
        terms = keyphrases.vocabulary(found, min_occurrences=2)
        return sorted(map(tuple, terms.collect())), sorted(map(tuple, keyphrases.term_counts(found, terms).collect()))

    assert cells(objects) == cells(objects.repartition(7))


def test_words_and_grams_equal_plain_python(spark):
    import re

    texts = ["The cat's re-run of a-b- 12 x éé_z Don't stop", "", None, "one", "of the", "ÀB cd  ef\tgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", words(F.col("text")).alias("w"))
    stop = ("the", "of", "don't")
    for r in df.select("i", "w", ngrams(F.col("w"), 1, 3, stop).alias("g")).collect():
        want = re.findall(r"\w[-'\w]*\w", (texts[r["i"]] or "").lower())
        assert (r["w"] or []) == want
        grams = [" ".join(want[i : i + n]) for n in (1, 2, 3) for i in range(len(want) - n + 1) if want[i] not in stop and want[i + n - 1] not in stop]
        assert sorted(r["g"] or []) == sorted(grams)


def test_builder_rejects_an_empty_vocabulary(objects):
    with pytest.raises(ValueError):
        keyphrases.KeyphraseBuilder(min_occurrences=10_000).fit_transform(objects)
    terms, _ = keyphrases.KeyphraseBuilder(high=2, tokenizer=str.split).fit_transform(objects)
    assert terms.count() > 0


def test_identifiers(spark):
    df = spark.createDataFrame([(0, 0), (2, 5), (9, -1), (0, 1022), (0, 1023), (16383, 7)], "l int, c int").withColumn("uid", ids.topic_uid(F.col("l"), F.col("c")))
    rows = {(r["l"], r["c"]): r["uid"] for r in df.collect()}
    assert rows[2, 5] == "AAgG" and rows[0, 1023] is None
    back = df.where("uid is not null").select("l", "c", ids.uid_layer(F.col("uid")).alias("a"), ids.uid_cluster(F.col("uid")).alias("b")).collect()
    assert all((r["l"], r["c"]) == (r["a"], r["b"]) for r in back)


def test_truncation_and_prompts(spark):
    df = spark.createDataFrame([("a" * 10 + "b" * 10,), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(truncate_middle(F.col("t"), 10)).collect()] == ["aaaaa ...[10 characters left out]... bbbbb", "short", None]
    none = F.lit(None).cast("array<string>")
    c = spark.createDataFrame([(0, 0, 3)], "layer int, cluster int, kind_index int").select("*", none.alias("keyphrases"), none.alias("exemplars"), none.alias("subtopics"), none.alias("major"), none.alias("minor"), F.lit(None).cast("string").alias("inherited"))
    row = name_prompts(c, wording=FRENCH, corpus="un corpus").select("prompt.*", prompt_text("system_user").alias("both")).first()
    assert "un corpus" in row["system"] and row["combined"].startswith(row["system"]) and '"system"' in row["both"]
    with pytest.raises(ValueError):
        prompt_text("other")
    assert naming.TemplateNamer().reply(["x"])


def test_streamed_objects_get_the_nearest_topic(spark, objects, layers, tmp_path):
    from layerlode.operators.clustering import centroids
    from layerlode.streaming.assign import assign_nearest, windowed_counts

    own = objects.select("object_id", "embedding", F.timestamp_seconds(F.col("object_id") * 60).alias("ts"))
    own.repartition(3).write.parquet(f"{tmp_path}/in")
    centres = centroids(layers, objects)
    stream = spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in")
    run = assign_nearest(stream, centres).writeStream.format("memory").queryName("placed").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table("placed").collect()
    assert len(rows) == 120 and all(r["cluster"] == r["object_id"] % 4 for r in rows)
    counts = windowed_counts(assign_nearest(stream, centres)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 120
