"""Fitted text-feature extractor (TXT-8..10, SRC-6): TF-IDF, uncentred SVD and min-max bounds learned once, applied to any rows.

``TextFeatures`` is a Spark ML estimator; its model keeps three tables that
grow with the vocabulary alone -- vocabulary (term, idx, df, freq, idf),
basis (comp, idx, loading) and bounds (comp, lo, hi) -- and saves, loads and
chains like any pipeline stage.  New texts pass through the same
normalisation, terms outside the vocabulary count for nothing, and scaled
components of new texts may lie outside [0, 1].  Only terms of the vocabulary
are shuffled, never whole texts.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import ml as ML, text as TX
from ledgerlens.operators.fitted import TableModel, _param
from ledgerlens.session import materialize


class TextParams(Params):
    keyCol = _param("keyCol", "unique key of a document", TypeConverters.toString)
    textCol = _param("textCol", "text to read", TypeConverters.toString)
    maxFeatures = _param("maxFeatures", "terms of the vocabulary", TypeConverters.toInt)
    maxDf = _param("maxDf", "largest share of documents that have a term", TypeConverters.toFloat)
    minDf = _param("minDf", "least number of documents that have a term", TypeConverters.toInt)
    maxNgram = _param("maxNgram", "words of the longest term", TypeConverters.toInt)
    components = _param("components", "most SVD components", TypeConverters.toInt)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def normalized(self, docs: DataFrame) -> DataFrame:
        """(key, text) with FN-5 texts; without the text column every text is empty."""
        key, text = self.value("keyCol"), self.value("textCol")
        t = F.col(text) if text in docs.columns else F.lit("")
        return docs.select(F.col(key).alias("key"), F.coalesce(TX.normalize_feature_text(t), F.lit("")).alias("text"))

    def tokens(self, normalized: DataFrame) -> DataFrame:
        """(key, tokens) of the texts."""
        return TX.doc_tokens(normalized, "key")

    def terms(self, tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(key, term, tf) of the vocabulary's terms, one count per document and term."""
        known = [r["term"] for r in vocabulary.select("term").collect()]       # maxFeatures rows
        return TX.doc_terms(tokens, "key", ngram=(1, self.value("maxNgram")), partition=False, tokens=True, terms=known)


class TextFeaturesModel(TableModel, TextParams):
    """Adds ``tfidf_svd_{i}`` and the named domain features (TXT-5..7) to documents."""

    def feature_names(self) -> list[str]:
        return [f"tfidf_svd_{i}" for i in range(self._size())] + list(TX.DOMAIN_COLUMNS)

    def _size(self) -> int:
        return self.tables["bounds"].count()

    def tfidf(self, docs: DataFrame) -> DataFrame:
        """Long TF-IDF weights (key, term, idx, weight) with L2 norm 1 in a document (TXT-8)."""
        w = self._weighted(self.terms(self.tokens(self.normalized(docs)), self.tables["vocabulary"]))
        norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # partitioned by key already
        return w.join(norm, "key").select(F.col("key").alias(self.value("keyCol")), "term", "idx", (F.col("w") / F.col("norm")).alias("weight"))

    def _weighted(self, terms: DataFrame) -> DataFrame:
        """tf * idf of the vocabulary's terms; maxFeatures rows bound the broadcast."""
        vocabulary = F.broadcast(self.tables["vocabulary"].select("term", "idx", "idf"))
        found = terms.join(vocabulary, "term")
        return found.repartition("key").select("key", "term", "idx", (F.col("tf") * F.col("idf")).alias("w"))

    def components_of(self, docs: DataFrame, scaled: bool = True, terms: DataFrame | None = None) -> DataFrame:
        """key and the components of every document (``terms``: its terms, if they are at hand); the ones without a
        known term are the zero row before scaling."""
        k = self._size()
        if not k:                                  # fitted without a term
            return docs.select(self.value("keyCol"))
        loadings = self.tables["basis"].groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("comp", "loading"))), lambda x: x["loading"]).alias("loadings"))
        terms = self.terms(self.tokens(self.normalized(docs)), self.tables["vocabulary"]) if terms is None else terms
        w = self._weighted(terms).join(F.broadcast(loadings), "idx")   # maxFeatures rows of k numbers
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
        sums = w.groupBy("key").agg(*[(F.sum(F.col("w") * F.col("loadings")[i]) / norm).alias(f"c{i}") for i in range(k)])
        every = docs.select(F.col(self.value("keyCol")).alias("key")).join(sums, "key", "left").na.fill(0.0, [f"c{i}" for i in range(k)])
        out = [F.col(f"c{i}") for i in range(k)]
        if scaled:
            bounds = {r["comp"]: (r["lo"], r["hi"]) for r in self.tables["bounds"].collect()}   # k rows
            out = [(F.col(f"c{i}") - lo) / (hi - lo) if hi > lo else F.lit(0.0) for i, (lo, hi) in sorted(bounds.items())]
        return every.select(F.col("key").alias(self.value("keyCol")), *[c.alias(f"tfidf_svd_{i}") for i, c in enumerate(out)])

    def _transform(self, docs: DataFrame) -> DataFrame:
        key = self.value("keyCol")
        domain = TX.domain_features(self.normalized(docs), text="text", normalized=True)
        features = self.components_of(docs).join(domain.select(F.col("key").alias(key), *TX.DOMAIN_COLUMNS), key)
        return docs.join(features, key)


class TextFeatures(Estimator, TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """TXT-10 fit.  Texts are normalised and cut into terms once; document frequencies, the terms x terms Gram matrix
    and the components' bounds are aggregates, and the eigenvectors of at most maxFeatures terms are found on the driver."""

    def __init__(self, **params):
        super().__init__()
        self._setDefault(keyCol="doc_id", textCol="text", maxFeatures=100, maxDf=0.8, minDf=1, maxNgram=3, components=50)
        self._set(**params)

    def _fit(self, docs: DataFrame) -> TextFeaturesModel:
        spark, model = docs.sparkSession, TextFeaturesModel()
        for param in self.params:
            model._set(**{param.name: self.getOrDefault(param)})
        normalized = self.normalized(docs)
        n_docs = normalized.count()
        tokens = materialize(self.tokens(normalized), "tokens")
        limits = self.value("maxFeatures"), self.value("maxDf"), self.value("minDf")
        frequent = TX.frequent_terms(tokens, n_docs, "key", (1, self.value("maxNgram")), *limits)
        model.tables = {"vocabulary": materialize(TX.fit_tfidf(frequent, n_docs, *limits), "vocabulary")}
        terms = materialize(self.terms(tokens, model.tables["vocabulary"]), "terms")
        weights = TX.transform_tfidf(terms, model.tables["vocabulary"], "key")
        basis, _ = ML.tfidf_svd(weights, model.tables["vocabulary"].count(), n_docs, "key", self.value("components"))
        k = 1 + max((c for c, _, _ in basis), default=-1)
        model.tables["basis"] = materialize(spark.createDataFrame(basis, "comp int, idx int, loading double"), "basis")
        model.tables["bounds"] = spark.createDataFrame([(i, 0.0, 0.0) for i in range(k)], "comp int, lo double, hi double")
        if k:
            plain = model.components_of(docs, scaled=False, terms=terms)
            row = plain.agg(*[F.struct(F.min(f"tfidf_svd_{i}"), F.max(f"tfidf_svd_{i}")).alias(f"b{i}") for i in range(k)]).first()
            model.tables["bounds"] = spark.createDataFrame([(i, *(x or 0.0 for x in row[f"b{i}"])) for i in range(k)], "comp int, lo double, hi double")
        model.tables["bounds"] = materialize(model.tables["bounds"], "bounds")
        return model
