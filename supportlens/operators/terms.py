"""TF-IDF weights, text clusters and their names."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IDF,
    IDFModel,
    Normalizer,
    PCA,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from supportlens import constants as C
from supportlens.functions import text as X
from supportlens.operators.ordered import first_n_per_group
from supportlens.session import materialize


def with_terms(df: DataFrame, cleaned: str) -> DataFrame:
    """Add ``terms``, the array that the operators below count."""
    return df.withColumn("terms", X.term_tokens(F.coalesce(cleaned, F.lit(""))))


def vocabulary(df: DataFrame, size: int = C.MAX_TERMS) -> list[str]:
    """The ``size`` most frequent terms, alphabetical among equals, in sorted order."""
    top = (
        df.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(size)
    )
    return sorted(row.term for row in top.select("term").collect())


class TfidfModel:
    """Smoothed TF-IDF with unit rows: tf * (ln((1 + n) / (1 + df)) + 1)."""

    def __init__(self, terms: list[str], weights: list[float]):
        self.terms = terms
        self.weights = weights

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add a sparse vector per row; every step works row by row."""
        counts = CountVectorizerModel.from_vocabulary(self.terms, "terms", "_counts")
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.weights), inputCol="_counts", outputCol="_weighted"
        )
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
        return unit.transform(weigh.transform(counts.transform(df))).drop("_counts", "_weighted")


def fit_tfidf(df: DataFrame, size: int = C.MAX_TERMS) -> TfidfModel:
    """Choose the terms, then learn their document frequencies in one pass.

    ``df`` is read twice here and once more by ``transform``, so store the terms
    first where they are expensive to make.
    """
    chosen = vocabulary(df, size)
    counts = CountVectorizerModel.from_vocabulary(chosen, "terms", "_counts").transform(df.select("terms"))
    model: IDFModel = IDF(inputCol="_counts", outputCol="_idf").fit(counts)
    return TfidfModel(chosen, [float(w) + 1.0 for w in model.idf])


def tfidf_weights(df: DataFrame, id_column: str, size: int = C.MAX_TERMS) -> DataFrame:
    """Long table (id, term, weight) of the non-zero weights."""
    rows = df.select(id_column, "terms")
    model = fit_tfidf(rows, size)
    return vector_entries(model.transform(rows), [id_column], model.terms)


def vector_entries(df: DataFrame, keys: list[str], terms: list[str], vector: str = "features") -> DataFrame:
    """Entries of sparse vectors as rows, with the term in place of its index."""
    stored = F.unwrap_udt(F.col(vector))
    names = F.array(*[F.lit(t) for t in terms])
    return (
        df.select(*keys, F.explode(F.arrays_zip(stored.indices, stored.values)).alias("_entry"))
        .select(
            *keys,
            F.element_at(names, F.col("_entry.indices") + 1).alias("term"),
            F.col("_entry.values").alias("weight"),
        )
        .where(F.col("weight") > 0)
    )


def top_terms_per_cluster(
    weights: DataFrame, cluster: str = "cluster", n: int = C.TOP_CLUSTER_TERMS
) -> DataFrame:
    """The ``n`` terms with the largest summed weight per cluster.

    Sums are compared at six decimals, so that equal terms tie and the alphabet decides.
    """
    sums = weights.groupBy(cluster, "term").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return first_n_per_group(sums, cluster, [F.desc("weight"), "term"], n)


def name_clusters(top_terms: DataFrame, cluster: str = "cluster") -> DataFrame:
    """First category, in list order, one of whose name parts is a top term of the cluster."""
    matches = [
        F.when(F.col("term").isin(category.split("_")), F.lit(rank))
        for rank, category in enumerate(C.CATEGORIES)
    ]
    hits = F.array_compact(F.array(*matches))
    best = F.min(F.array_min(hits))
    names = F.array(*[F.lit(c) for c in C.CATEGORIES])
    return top_terms.groupBy(cluster).agg(best.alias("_best")).select(
        cluster,
        F.coalesce(F.get(names, F.col("_best")), F.lit(C.DEFAULT_CATEGORY)).alias("category"),
    )


def cluster_texts(
    df: DataFrame, k: int = len(C.CATEGORIES), size: int = C.MAX_TERMS
) -> tuple[DataFrame, TfidfModel]:
    """Add ``features`` and ``cluster`` by k-means over the TF-IDF rows."""
    model = fit_tfidf(df, size)
    features = materialize(model.transform(df).drop("terms"), "features")
    kmeans = KMeans(k=k, seed=C.SEED, featuresCol="features", predictionCol="cluster")
    return kmeans.fit(features.select("features")).transform(features), model


def cluster_categories(df: DataFrame) -> DataFrame:
    """Give uncategorised rows the category of their cluster."""
    clustered, model = cluster_texts(df)
    entries = vector_entries(clustered, ["cluster"], model.terms)
    names = name_clusters(top_terms_per_cluster(entries))
    # At most one row per cluster, of which there are k.
    return (
        clustered.drop("features")
        .join(F.broadcast(names), "cluster", "left")
        .withColumn("category", F.coalesce("category", F.lit(C.DEFAULT_CATEGORY)))
    )


def categorize_pairs(analyzed: DataFrame) -> DataFrame:
    """Give analyzed pairs a category by clustering, unless they have one."""
    if "category" in analyzed.columns:
        return analyzed
    both = analyzed.withColumn("_both", F.concat_ws(" ", "question_clean", "answer_clean"))
    stored = materialize(with_terms(both, "_both").drop("_both"), "pairs")
    return cluster_categories(stored).drop("cluster")


def pca_features(df: DataFrame, components: int = 50) -> DataFrame:
    """Project the TF-IDF rows on their first principal components."""
    model = fit_tfidf(df)
    k = max(1, min(components, len(model.terms) - 1))
    features = materialize(model.transform(df).drop("terms"), "features")
    pca = PCA(k=k, inputCol="features", outputCol="components").fit(features.select("features"))
    return pca.transform(features).drop("features")
