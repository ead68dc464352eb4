"""What the corpus operators share: stored steps, column checks, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.session import shared_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Intermediate tables of one operator, in the shared folder.

    Each is written once, which cuts the lineage and survives lost executors. A step's
    shuffle files are freed when it has been written, and ``drop`` frees a table that no
    later step reads. The tables that the result still reads stay, as the result is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/wardwise-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, *results: str) -> DataFrame:
    """``docs`` without the columns that a result column of the same name replaces."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results])


def components(edges: DataFrame, steps: Steps, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): ``root`` is the smallest node that it reaches.

    Each round points every node at its smallest neighbour and contracts the graph to those; rounds
    grow with the logarithm of the longest path. Only the shrinking edges are written again.
    """
    both = edges.select("a", "b").where("a <> b")
    edge = steps.write(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges0")
    jumps: list[DataFrame] = []
    while not edge.isEmpty():
        k = len(jumps)
        up = steps.write(
            edge.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"{name}-up{k}"
        )
        jumps.append(up)
        left = edge.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = left.join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        new = ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edge = steps.write(new, f"{name}-edges{k + 1}")
        steps.drop(f"{name}-edges{k}")
    if not jumps:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = jumps[0]
    for up in jumps[1:]:
        nxt = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return out
