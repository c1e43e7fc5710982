"""How well embeddings separate difficulty: spread, cluster indices and rank correlation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from answerflow.functions.vectors import distance, dot, l2_normalize
from answerflow.operators.blocks import compare_blocks, matrix, squared_distances
from answerflow.operators.labels import quantile_bins
from answerflow.operators.ordering import below_cut, hash_cuts, ordered_totals, row_hash, same
from answerflow.session import durable


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly `rows` rows (or all, if there are fewer), the same for the same seed."""
    cuts = hash_cuts(df, (), key, seed, F.least(F.col("_size"), F.lit(rows)))
    return below_cut(df, cuts, (), key, seed, "_picked").where("_picked").drop("_picked")


def mean_cosine_spread(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance, each row also with itself.

    The mean over all pairs equals 1 - |sum of unit vectors|^2 / n^2: one pass, no pairs.
    """
    summed = df.agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector(l2_normalize(F.col(vector))))).alias("s"),
    )
    n = F.col("n").cast("double")
    return summed.select("n", (F.lit(1.0) - dot(F.col("s"), F.col("s")) / (n * n)).alias("mean_cosine_distance"))


def centroids(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector and row count per label."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    return df.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(as_double))).alias("centroid"),
        F.count(F.lit(1)).alias("n"),
    )


def davies_bouldin(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centroid distance; of coincident
    centroids it is 0. A single cluster fails the job."""
    centres = centroids(df, label, vector)
    near = df.alias("l").join(centres.alias("r"), same("l", "r", [label])).select(
        f"l.{label}", distance(F.col(f"l.{vector}"), F.col("r.centroid")).alias("d")
    )
    spread = near.groupBy(label).agg(F.avg("d").alias("s"))
    scatter = durable(
        spread.alias("l").join(centres.alias("r"), same("l", "r", [label])).select(
            F.col(f"l.{label}").cast("string").alias("label"), "s", "centroid"
        )
    )

    def work(a: dict, b: dict) -> pd.DataFrame:
        gaps = np.sqrt(((matrix(a["centroid"])[:, None, :] - matrix(b["centroid"])[None, :, :]) ** 2).sum(2))
        other = np.asarray(a["label"])[:, None] != np.asarray(b["label"])[None, :]
        both = np.asarray(a["s"])[:, None] + np.asarray(b["s"])[None, :]
        # Coincident centroids count as 0.
        ratios = np.divide(both, gaps, out=np.zeros(gaps.shape), where=other & (gaps > 0))
        ratios[~other] = -np.inf
        return pd.DataFrame({"label": a["label"], "worst": ratios.max(axis=1)})

    columns = ["label", "s", "centroid"]
    worst = compare_blocks(scatter, scatter, "label", columns, columns, work, "label string, worst double", block_rows=256)
    found = worst.groupBy("label").agg(F.max("worst").alias("worst")).agg(
        F.count(F.lit(1)).alias("clusters"), F.avg("worst").alias("davies_bouldin")
    )
    alone = F.raise_error(F.lit("the index needs two clusters")).cast("double")
    return found.select("clusters", F.when(F.col("clusters") == 1, alone).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"))


def silhouette(df: DataFrame, label: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Mean silhouette with squared Euclidean distances over all rows.

    The mean squared distance to a cluster follows from its row count, mean vector and mean
    squared length, so rows meet clusters instead of each other.
    """
    as_double = F.transform(vector, lambda x: x.cast("double"))
    rows = durable(df.select(key, as_double.alias("v"), F.col(label).cast("string").alias("label")))
    clusters = durable(
        rows.groupBy("label").agg(
            vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean"), F.avg(dot(F.col("v"), F.col("v"))).alias("length"),
            F.count(F.lit(1)).alias("n"),
        )
    )

    def work(a: dict, b: dict) -> pd.DataFrame:
        x, means, n = matrix(a["v"]), matrix(b["mean"]), np.asarray(b["n"], dtype=float)
        gaps = np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ means.T) + np.asarray(b["length"])[None, :], 0.0)
        own = np.asarray(a["label"])[:, None] == np.asarray(b["label"])[None, :]
        mine = np.where(own, gaps * (n / np.maximum(n - 1, 1)), -1.0).max(axis=1)
        size = np.where(own, n, 0.0).max(axis=1)
        return pd.DataFrame({"id": a[key], "size": size, "a": mine, "b": np.where(own, np.inf, gaps).min(axis=1)})

    key_type = dict(rows.dtypes)[key]
    partial = compare_blocks(
        rows, clusters, key, [key, "v", "label"], ["label", "mean", "length", "n"], work,
        f"id {key_type}, size double, a double, b double", right_key="label",
    )
    per_row = partial.groupBy("id").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.min("b").alias("b"))
    worst = F.greatest("a", "b")
    value = F.when((F.col("size") <= 1) | (worst == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / worst)
    return per_row.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("silhouette"))


def sampled_silhouette(
    df: DataFrame, label: str, sample: int, key: str = "id", vector: str = "embedding", seed: int = 42
) -> DataFrame:
    """Mean Euclidean silhouette over a seeded sample of `sample` rows, with the rows used and all rows.

    Distances have no linear form, so the work grows with the square of the sample.
    """
    rows = durable(
        seeded_sample(df, key, sample, seed).select(key, vector, F.col(label).cast("string").alias("label"))
    )

    def work(a: dict, b: dict) -> pd.DataFrame:
        gaps = np.sqrt(squared_distances(matrix(a[vector]), matrix(b[vector])))
        ids_a, ids_b = np.asarray(a[key]), np.asarray(b[key])
        gaps[ids_a[:, None] == ids_b[None, :]] = 0.0
        own = np.asarray(a["label"])
        labels, members = np.unique(np.asarray(b["label"]), return_inverse=True)
        sums = gaps @ np.eye(len(labels))[members]
        counts = np.bincount(members, minlength=len(labels))
        return pd.DataFrame(
            {
                "id": np.repeat(ids_a, len(labels)),
                "own": np.repeat(own, len(labels)),
                "other": np.tile(labels, len(ids_a)),
                "total": sums.ravel(),
                "n": np.tile(counts, len(ids_a)),
            }
        )

    key_type = dict(rows.dtypes)[key]
    partial = compare_blocks(
        rows, rows, key, [key, vector, "label"], [key, vector, "label"], work,
        f"id {key_type}, own string, other string, total double, n bigint",
    )
    per_cluster = partial.groupBy("id", "own", "other").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("other")
    per_row = per_cluster.groupBy("id").agg(
        F.max(F.when(mine, F.col("n"))).alias("size"),
        F.max(F.when(mine & (F.col("n") > 1), F.col("t") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("t") / F.col("n"))).alias("b"),
    )
    worst = F.greatest("a", "b")
    value = F.when((F.col("size") == 1) | (worst == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / worst)
    return per_row.agg(
        F.count(F.lit(1)).alias("rows_used"), df.agg(F.count(F.lit(1))).scalar().alias("rows_total"), F.avg(value).alias("silhouette")
    )


def _average_ranks(counts: DataFrame, value: str, rank: str) -> DataFrame:
    """Tie-averaged ranks of the distinct values of a weighted list."""
    totals = counts.groupBy(value).agg(F.sum("n").alias("_n"))
    upto = ordered_totals(totals, [F.col(value).asc()], {"_upto": F.col("_n")})
    return upto.select(value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(rank))


def distance_label_spearman(
    df: DataFrame,
    label: str,
    sample: int,
    key: str = "id",
    vector: str = "embedding",
    seed: int = 42,
    digits: int = 6,
) -> DataFrame:
    """Spearman correlation of pairwise cosine distance and label difference, over the pairs of
    different vectors in a seeded sample of `sample` rows, with the rows used and all rows.

    The work grows with the square of the sample. Distances are told apart at `digits`
    decimals, by default about the resolution of float32 embeddings. Tasks return counts per
    (distance, difference); equal distances share their average rank.
    """
    rows = durable(
        seeded_sample(df, key, sample, seed).select(key, vector, F.col(label).cast("double").alias("label"))
    )

    def work(a: dict, b: dict) -> pd.DataFrame:
        va, vb = matrix(a[vector]), matrix(b[vector])
        va /= np.maximum(np.linalg.norm(va, axis=1, keepdims=True), 1e-300)
        vb /= np.maximum(np.linalg.norm(vb, axis=1, keepdims=True), 1e-300)
        far = np.rint(np.clip(1.0 - va @ vb.T, 0.0, 2.0) * 10.0**digits).astype(np.int64)
        # Few distinct labels make few distinct gaps; each gets a number.
        labels_a, code_a = np.unique(np.asarray(a["label"]), return_inverse=True)
        labels_b, code_b = np.unique(np.asarray(b["label"]), return_inverse=True)
        gaps, code = np.unique(np.round(np.abs(labels_a[:, None] - labels_b[None, :]), 12), return_inverse=True)
        gap = code.reshape(len(labels_a), len(labels_b))[code_a[:, None], code_b[None, :]]
        _, which = np.unique(np.concatenate([va, vb]), axis=0, return_inverse=True)
        keep = which[: len(va), None] != which[None, len(va) :]
        if a["block"] == b["block"]:
            keep &= np.triu(np.ones(far.shape, dtype=bool), 1)
        pairs, n = np.unique(far[keep] * len(gaps) + gap[keep], return_counts=True)
        return pd.DataFrame({"d": pairs // len(gaps), "g": gaps[pairs % len(gaps)], "n": n})

    counts = compare_blocks(
        rows, rows, key, [key, vector, "label"], [key, vector, "label"], work,
        "d bigint, g double, n bigint", symmetric=True,
    )
    # Read four times below, computed once.
    counts = durable(counts.groupBy("d", "g").agg(F.sum("n").alias("n")))
    ranked = counts.join(_average_ranks(counts, "d", "rd"), "d").join(_average_ranks(counts, "g", "rg"), "g")
    total = counts.agg(F.sum("n")).scalar()
    middle = (total + 1) / 2.0
    x, y, w = F.col("rd") - middle, F.col("rg") - middle, F.col("n")
    sums = ranked.agg(
        F.sum("n").alias("n_pairs"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy")
    )
    return sums.select(
        "n_pairs", rows.agg(F.count(F.lit(1))).scalar().alias("rows_used"), df.agg(F.count(F.lit(1))).scalar().alias("rows_total"),
        (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("spearman"),
    )


def _correlated_ranks(far: np.ndarray, gap: np.ndarray) -> float:
    """Pearson correlation of tie-averaged ranks; NaN if one side is all the same."""
    def ranks(values: np.ndarray) -> np.ndarray:
        _, code, n = np.unique(values, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2.0)[code]

    x, y = ranks(far), ranks(gap)
    x, y = x - x.mean(), y - y.mean()
    size = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / size) if size > 0 else float("nan")


def distance_label_spearman_estimate(
    df: DataFrame,
    label: str,
    block_rows: int = 1024,
    key: str = "id",
    vector: str = "embedding",
    seed: int = 42,
    digits: int = 6,
) -> DataFrame:
    """`distance_label_spearman` estimated from every row, with a standard error.

    Rows in the order of a seeded hash are cut into blocks of equal size, `block_rows` at most;
    each block's pairs give one correlation. As blocks are random and share no rows, the mean
    (weighted by pairs) is an estimate over the table, and the spread between blocks its error.
    The work grows in proportion to the rows, a task holds the pairs of one block. One block
    has all pairs: the exact value, without an error. Rows without vector or label are left out.
    """
    rows = durable(df.select(
        F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).cast("double").alias("label"), row_hash(key, seed).alias("hash")
    ).where(F.col("vector").isNotNull() & F.col("label").isNotNull()))
    n, total = rows.count(), df.agg(F.count(F.lit(1))).scalar()
    blocks = max(1, -(-n // block_rows))
    # Rows alike in all of it can be in any order.
    order = [F.col(c).asc() for c in ("hash", "key", "label", "vector")]
    placed = ordered_totals(rows, order, {"upto": F.lit(1)})
    placed = placed.select("vector", "label", F.floor((F.col("upto") - 1) * blocks / F.lit(max(n, 1))).alias("block"))

    def one(block: pd.DataFrame) -> pd.DataFrame:
        unit = matrix(block["vector"])
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        _, same_vector = np.unique(unit, axis=0, return_inverse=True)
        labels = block["label"].to_numpy()
        i, j = np.triu_indices(len(unit), 1)
        other = same_vector[i] != same_vector[j]
        i, j = i[other], j[other]
        far = np.rint(np.clip(1.0 - (unit @ unit.T)[i, j], 0.0, 2.0) * 10.0**digits).astype(np.int64)
        gap = np.round(np.abs(labels[i] - labels[j]), 12)
        return pd.DataFrame({"n": [len(i)], "r": [_correlated_ranks(far, gap) if len(i) else float("nan")]})

    per_block = durable(placed.groupBy("block").applyInPandas(one, "n long, r double").where(~F.isnan("r")))
    w = F.col("n").cast("double")
    mean = per_block.agg((F.sum(w * F.col("r")) / F.sum(w)).alias("mean")).scalar()
    sums = per_block.withColumn("mean", mean).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("blocks"), F.max("mean").alias("spearman"),
        F.sqrt(F.sum((w * (F.col("r") - F.col("mean"))) ** 2)).alias("_off"), F.sum(w).alias("_all"),
    )
    error = F.when(F.col("blocks") > 1, F.col("_off") / F.col("_all") * F.sqrt(F.col("blocks") / (F.col("blocks") - 1.0)))
    return sums.select(
        "n_pairs", "blocks", F.lit(n).alias("rows_used"), F.lit(total).alias("rows_total"), "spearman", error.alias("standard_error")
    )


def embedding_report(
    encoders: dict[str, DataFrame], sample: int, key: str = "id", vector: str = "embedding", seed: int = 42
) -> DataFrame:
    """One row per encoder, subset and task. Rows need `label`, `slm_accuracy_fraction`, `is_simple`.

    `sample` bounds the rows of the rank correlation only; all else is over all rows.
    """

    def line(encoder: str, subset: str, task: str, sil: Column, name: str, value: Column, spark) -> DataFrame:
        return spark.range(1).select(
            F.lit(encoder).alias("encoder"), F.lit(subset).alias("subset"), F.lit(task).alias("task"),
            sil.cast("double").alias("silhouette"), F.lit(name).alias("measure"), value.cast("double").alias("value"),
        )

    lines = []
    for encoder, df in encoders.items():
        spark = df.sparkSession
        for subset, rows in (("combined", df), ("main", df.where(~F.col("is_simple")))):
            lines.append(line(
                encoder, subset, "classification",
                silhouette(rows, "label", key, vector).select("silhouette").scalar(),
                "davies_bouldin", davies_bouldin(rows, "label", vector).select("davies_bouldin").scalar(), spark,
            ))
            binned = quantile_bins(rows, "slm_accuracy_fraction", 4, "bin")
            lines.append(line(
                encoder, subset, "regression",
                silhouette(binned, "bin", key, vector).select("silhouette").scalar(),
                "spearman",
                distance_label_spearman(rows, "slm_accuracy_fraction", sample, key, vector, seed=seed).select("spearman").scalar(),
                spark,
            ))
        spread = mean_cosine_spread(df.where("is_simple"), vector).select("mean_cosine_distance").scalar()
        lines.append(line(encoder, "simple", "spread", F.lit(None), "mean_cosine_distance", spread, spark))
    return reduce(DataFrame.unionByName, lines)
