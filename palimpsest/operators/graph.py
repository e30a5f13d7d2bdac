"""Graph and clusters of claims: two principal components, k-means, labels, relationships."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS = 6


def projected(claims: DataFrame, k: int = CLUSTERS, seed: int = 0) -> DataFrame:
    """(id, cluster, x, y, explained) of claims (id, embedding): mean-centred PCA and k-means, both Spark ML jobs."""
    rows = claims.filter("embedding is not null").select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    pca = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    labelled = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(pca.transform(centred))
    p = vector_to_array("p")
    return labelled.select("id", "cluster", p[0].alias("x"), p[1].alias("y"), F.lit(float(sum(pca.explainedVariance.toArray()))).alias("explained"))


def cluster_summary(points: DataFrame, claims: DataFrame) -> DataFrame:
    """(cluster, size, x, y, label): the label is the most frequent entity, else the most frequent word of four letters or more."""
    named = points.join(claims.select("id", "entity", "content"), "id")
    most = lambda rows, c: rows.groupBy("cluster", c).agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by(c, F.struct("n", c)).alias(c))
    words = named.select("cluster", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    sums = points.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return sums.join(most(named.filter("entity is not null"), "entity"), "cluster", "left").join(most(words, "word"), "cluster", "left").select("cluster", "size", "x", "y", F.coalesce("entity", "word").alias("label"))


def nodes(points: DataFrame, claims: DataFrame) -> DataFrame:
    """Node rows for display: label, cluster, place, and a size from the claim's importance."""
    label = F.coalesce("entity", F.left("content", F.lit(40)))
    return points.join(claims.select("id", "entity", "content", "authority"), "id").select("id", label.alias("label"), "cluster", "x", "y", (4 * F.sqrt("authority") + 2).alias("size"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def relationships(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, entity, n_similar, n_same) of every claim: its similarity edges, and how many further claims share its entity.

    The entity is the class that relates claims; its members are counted, never paired. ``related`` lists the pairs of asked claims.
    """
    c = claims.select("user_id", "entity", "id")
    ends = _both_ways(edges).join(c.select("id", F.col("entity").alias("mine")), "id").join(c.select(F.col("id").alias("other"), F.col("entity").alias("theirs")), "other")
    linked = ends.groupBy("id").agg(F.count("*").alias("n_similar"), F.count_if(F.col("mine") == F.col("theirs")).alias("same"))
    sizes = c.groupBy("user_id", "entity").agg(F.count("*").alias("size"))
    none = lambda x: F.coalesce(x, F.lit(0))
    rows = c.join(linked, "id", "left").join(sizes, ["user_id", "entity"], "left")
    return rows.select("id", "entity", none("n_similar").alias("n_similar"), none(F.col("size") - 1 - none("same")).alias("n_same"))


def related(asked: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other, kind) of the asked ids, a few that someone looks at: similar claims, and those of the same entity that no edge names."""
    ids = asked.select("id").distinct()
    similar = _both_ways(edges).join(ids, "id", "left_semi")
    c = claims.filter("entity is not null").select("user_id", "entity", "id")
    same = c.join(ids, "id", "left_semi").join(c.withColumnRenamed("id", "other"), ["user_id", "entity"]).filter("id <> other").select("id", "other")
    return similar.withColumn("kind", F.lit("similar")).unionByName(same.join(similar, ["id", "other"], "left_anti").withColumn("kind", F.lit("entity")))
