"""Text classifiers of the usual kinds, from Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, Binarizer, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, UnivariateFeatureSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.terms import most_frequent

CLASSIFIERS = ("logreg", "svm", "nb", "rf", "gbt")


def terms_of(rows: DataFrame, max_features: int = 50_000, min_df: int = 2) -> list[str]:
    """The most frequent of ``_terms``, in ``min_df`` texts and in no more than 0.9 of them; ties by term.

    Terms are counted in one aggregation: ``CountVectorizer``, given a share as a limit, keeps
    the terms of all texts in memory, many times the texts.
    """
    lists = F.array(*(F.struct(c.alias("terms"), F.lit(n).alias("n"), F.lit(df).alias("df")) for c, n, df in ((F.col("_terms"), 1, 0), (F.array_distinct("_terms"), 0, 1))))
    each = rows.select(F.explode(lists).alias("l")).select(F.explode("l.terms").alias("term"), "l.n", "l.df")
    found = most_frequent(each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), rows.count(), min_df, 0.9, max_features)
    return [r.term for r in sorted(found.select("term", "n").collect(), key=lambda r: (-r.n, r.term))]


def vectorizer(train: DataFrame, max_features: int = 50_000, min_df: int = 2) -> list:
    """Words and word pairs, stop words removed, raw counts times idf, unit length. The vocabulary, found in ``train``, is sent to the driver."""
    words = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+", minTokenLength=2),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]
    counts = CountVectorizerModel.from_vocabulary(terms_of(PipelineModel(words).transform(train), max_features, min_df), inputCol="_terms", outputCol="_counts")
    counts.set(counts.vocabSize, max_features)
    return [*words, counts, IDF(inputCol="_counts", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features", p=2.0)]


def classifier(name: str):
    if name == "logreg":
        return LogisticRegression(labelCol="label", maxIter=50, regParam=1e-3)
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=30, regParam=1e-3), labelCol="label")
    if name == "nb":
        return NaiveBayes(labelCol="label", modelType="complement")
    if name == "rf":
        return RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=10, seed=1)
    if name == "gbt":
        return OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=1), labelCol="label")
    raise ValueError(f"unknown classifier {name!r}; expected one of {CLASSIFIERS}")


def chosen_terms(k: int) -> list:
    """After the vectorizer: the k terms whose presence depends most on the label, by chi-squared, in ``features``."""
    select = UnivariateFeatureSelector(featuresCol="_present", labelCol="label", outputCol="features", selectionMode="numTopFeatures")
    return [Binarizer(inputCol="_counts", outputCol="_present", threshold=0.5), select.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)]


def fit_baseline(train: DataFrame, name: str = "logreg", max_features: int = 50_000, best_terms: int | None = None):
    """A fitted pipeline from rows with text and a numeric label.

    With ``best_terms``, as trees need it, the classifier sees the presence of so many
    terms, chosen by chi-squared, instead of the weights of all.
    """
    rows = train.select("text", "label").na.fill({"text": ""})
    terms = vectorizer(rows, max_features)
    stages = terms if best_terms is None else [*terms[:-2], *chosen_terms(best_terms)]
    return Pipeline(stages=[*stages, classifier(name)]).fit(rows)
