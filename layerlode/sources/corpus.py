"""Objects with vectors and layers, from tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def objects(documents: DataFrame, embeddings: DataFrame, shared: bool = False) -> DataFrame:
    """Documents with the vector and label of the same id: object_id, text, lang, source, embedding, label.

    With ``shared`` a document whose id is past the last vector's has that of its id modulo their number, so that no
    document is left out where vectors are numbered from 0.
    """
    own = spread(documents, "doc_id").select(F.col("doc_id").alias("object_id"), "text", "lang", "source")
    vectors = embeddings.select(F.col("vec_id").alias("_vector"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    if shared:
        many = F.broadcast(embeddings.agg((F.max("vec_id") + 1).alias("_many")))
        own = own.crossJoin(many).withColumn("_vector", F.pmod("object_id", F.col("_many"))).drop("_many")
    else:
        own = own.withColumn("_vector", F.col("object_id"))
    return own.join(vectors, "_vector").drop("_vector")


def label_layers(labels: DataFrame) -> DataFrame:
    """Three layers from one label: the label, pairs of labels, and fours of labels with 8 and 9 as noise."""
    clusters = F.array(F.col("label"), F.expr("label div 2"), F.expr("case when label >= 8 then -1 else label div 4 end"))
    return labels.select("object_id", F.posexplode(F.transform(clusters, lambda c: c.cast("int"))).alias("layer", "cluster"))


def joined_texts(objects: DataFrame, exemplars: DataFrame, to_text) -> DataFrame:
    """Texts of objects that have none of their own: ``to_text(object column)`` for exemplars, empty for the others."""
    chosen = exemplars.select("object_id").distinct().withColumn("_chosen", F.lit(True))
    own = objects.join(chosen, "object_id", "left")
    return own.withColumn("text", F.when(F.col("_chosen"), to_text(own)).otherwise(F.lit(""))).drop("_chosen")
