"""Choosing a model for a live prompt by what became of the prompts nearest to it.

The index is a pivot tree in a folder, in numbered versions. A stream may go on while a new version is
written: every batch notes the version it takes before it starts, so a batch that is repeated after a
failure sees the same index, and the next one the newest.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from answerflow.functions.costs import CostModel
from answerflow.operators.neighbours import PivotTree, search_tree
from answerflow.session import scratch_path
from answerflow.streaming.prompts import route_prompts

ROOT = "cell int, pivot array<double>, size bigint, reach double, key_type string, block_rows int"


def index_versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions in the folder, in order."""
    try:
        roots = spark.read.option("basePath", path).parquet(f"{path}/version=*/root")
    except AnalysisException:
        return []
    # One row per version.
    return sorted(r[0] for r in roots.select(F.col("version").cast("int")).distinct().collect())


def publish_index(tree: PivotTree, path: str) -> int:
    """Write the index as the next version and return its number.

    The root is written last; until then the version is not seen by readers.
    """
    spark = tree.blocks.sparkSession
    version = max(index_versions(spark, path), default=0) + 1
    folder = f"{path}/version={version}"
    tree.blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    tree.cells.write.mode("overwrite").parquet(f"{folder}/cells")
    # One row per cell, as many as the driver holds pivots.
    root = [
        (int(name), pivot.tolist(), int(size), float(reach), tree.key_type, tree.block_rows)
        for name, pivot, size, reach in zip(tree.names, tree.pivots, tree.sizes, tree.reach)
    ]
    spark.createDataFrame(root, ROOT).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/root")
    return version


def read_index(spark: SparkSession, path: str, version: int) -> PivotTree:
    """A version of the index."""
    folder = f"{path}/version={version}"
    root = spark.read.schema(ROOT).parquet(f"{folder}/root").orderBy("cell").collect()
    return PivotTree(
        spark.read.parquet(f"{folder}/blocks"),
        spark.read.parquet(f"{folder}/cells"),
        np.array([r["cell"] for r in root]),
        np.array([r["pivot"] for r in root]),
        np.array([r["size"] for r in root]),
        np.array([r["reach"] for r in root]),
        root[0]["key_type"],
        root[0]["block_rows"],
    )


def usable(vector: str) -> Column:
    """Whether there is a vector and all of it is finite."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def score_by_neighbours(prompts: DataFrame, tree: PivotTree, k: int = 5, vector: str = "embedding") -> DataFrame:
    """Add `p`, the mean label of the k nearest rows of the index.

    Equal vectors are searched for once, however often they are asked. Prompts without a vector, or
    with components that are null or not finite, get null.
    """
    content = F.when(usable(vector), F.sha2(F.col(vector).cast("string"), 256))
    hashed = prompts.withColumn("_content", content)
    asked = hashed.where(F.col("_content").isNotNull()).select("_content", vector).dropDuplicates(["_content"])
    near = search_tree(tree, asked, k, key="_content", vector=vector)
    p = near.groupBy(F.col("id").alias("_content")).agg(F.avg("label").alias("p"))
    return hashed.drop("p").join(p, "_content", "left").drop("_content")


def select_models(
    prompts: DataFrame,
    index: str,
    label: str = "selected",
    path: str | None = None,
    k: int = 5,
    vector: str = "embedding",
    model: CostModel | None = None,
    use_utility: bool = True,
) -> DataFrame:
    """Route everything available of a stream by its neighbours, into a parquet table.

    Adds `p` (the neighbours' mean label: how likely the prompt is too hard for the small model),
    `route` and `index_version`; columns of these names are replaced. A prompt without a usable vector
    goes to the large model. `path` as in `append_available`; each batch writes its own folder, so a
    repeated one replaces its rows.
    """
    spark = prompts.sparkSession
    table = path or scratch_path(spark, label)
    if not index_versions(spark, index):
        raise ValueError(f"no index in {index}")

    def version_of(epoch: int) -> int:
        note = f"{table}-index/{epoch:010d}"
        try:
            return spark.read.schema("version int").parquet(note).first()["version"]
        except AnalysisException:
            newest = index_versions(spark, index)[-1]
            spark.createDataFrame([(newest,)], "version int").coalesce(1).write.parquet(note)
            return newest

    def write(batch: DataFrame, epoch: int) -> None:
        version = version_of(epoch)
        scored = score_by_neighbours(batch, read_index(spark, index, version), k, vector)
        routed = route_prompts(scored, model, use_utility)
        route = F.when(F.col("p").isNull(), F.lit("llm")).otherwise(F.col("route"))
        found = routed.withColumns({"route": route, "index_version": F.lit(version)})
        found.select(schema.names).write.mode("overwrite").parquet(f"{table}/{epoch:010d}")

    given = [f for f in prompts.schema.fields if f.name not in ("p", "route", "index_version")]
    added = [StructField("p", DoubleType()), StructField("route", StringType()), StructField("index_version", IntegerType())]
    schema = StructType([*given, *added])
    query = (
        prompts.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{table}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        return spark.read.schema(schema).parquet(f"{table}/[0-9]*")
    except AnalysisException:
        return spark.createDataFrame([], schema)
