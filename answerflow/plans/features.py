"""Question text to feature vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T


def text_features(text: str = "question", dims: int = 1024, output: str = "features") -> Pipeline:
    """Hashed TF-IDF of unit length: the encoder that needs no download."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol=output),
        ]
    )


def encode(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
    batch_size: int = 64,
) -> DataFrame:
    """Unit vectors from any batch encoder, loaded once per Python worker.

    `make_encoder` returns a function from an array of texts to an (n, d) array.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encoder = make_encoder()

        def unit(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(encoder(texts), dtype=np.float64)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)

        return unit

    vectorize = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(output, vectorize(F.col(text)))


def vector_column(df: DataFrame, vector: str = "embedding", output: str = "features") -> DataFrame:
    """An array column as the vector type the ML stages take."""
    return df.withColumn(output, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def pca(components: int = 300, features: str = "features", output: str = "pca_features") -> Pipeline:
    """Centre, then project onto the leading components."""
    return Pipeline(
        stages=[
            StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False),
            PCA(inputCol="_centred", outputCol=output, k=components),
        ]
    )


def fit_pca(df: DataFrame, components: int = 300, features: str = "features") -> PipelineModel:
    """A fitted projection."""
    first = df.select(features).first()
    if first is None:
        raise ValueError("no rows to fit on")
    if components > first[0].size:
        raise ValueError(f"{components} components of {first[0].size} dimensions")
    return pca(components, features).fit(df)
