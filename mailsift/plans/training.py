"""Training as a chain of jobs: dataset, features, models, evaluation, registry and experiment log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions import text as T
from mailsift.operators import evaluation as E, features as FE, registry as G, training as TR
from mailsift.operators.sampling import exact_sample, stratified_split
from mailsift.operators.vectors import to_vectors
from mailsift.session import materialise
from mailsift.sources.loaders import clean_labels


@dataclass
class Prepared:
    """Fitted vocabulary with vectorised training and test rows ``doc_id, label, target, features``."""

    vectorizer: FE.Vectorizer
    vocabulary: DataFrame
    size: int
    train: DataFrame
    test: DataFrame


@dataclass
class Run:
    prepared: Prepared
    models: dict
    scores: DataFrame
    metrics: DataFrame
    failed: dict[str, str]


def prepare(docs: DataFrame, method: str = "tfidf", sample: int | None = None, key: str = "doc_id",
            **overrides) -> Prepared:
    """From ``doc_id, text, label``: optional exact sample, label cleaning, text preparation, split, vocabulary, vectors."""
    if sample:
        docs = exact_sample(docs, key, sample)
    cleaned = clean_labels(docs).select(key, T.preprocess(F.col("text")).alias("text"), "label")
    split = stratified_split(cleaned.select(key, "label"), key, "label")
    v = FE.get_vectorizer(method, **overrides)
    # Tokens feed the vocabulary and both sets of vectors.
    tokens = materialise(FE.with_tokens(cleaned.select(key, "text"), v).join(split, key), "tokens")
    train = tokens.filter(~F.col("is_test"))
    vocabulary = materialise(FE.fit(train, v), "vocabulary")
    size = vocabulary.count()
    vecs = FE.vectors(tokens, vocabulary, v, key).join(split, key)
    rows = to_vectors(TR.with_target(vecs), max(size, 1))
    return Prepared(v, vocabulary, size, rows.filter(~F.col("is_test")).drop("is_test"),
                    rows.filter(F.col("is_test")).drop("is_test"))


def run(docs: DataFrame, method: str = "tfidf", names: list[str] | None = None, params: dict[str, dict] | None = None,
        ensemble: str | None = None, model_dir: str | None = None, failed: dict[str, str] | None = None, **options) -> Run:
    """The whole chain. Only fitted models and the tables of metrics reach the driver.

    A model that fails to train fails the run, unless ``failed`` is given to name it.
    """
    p = prepare(docs, method, **options)
    models: dict = TR.train_all(p.train, names, params, model_dir, failed)
    scores = TR.score_all(models, p.test, "doc_id", "label")
    if ensemble:
        combined = TR.train_ensemble(p.train, ensemble, [n for n in TR.BASE_MODELS if n in models], params, trained=models)
        models[f"ensemble_{ensemble}"] = combined
        labels = p.test.select("doc_id", "label")
        scores = scores.unionByName(combined.score(p.test).join(labels, "doc_id").select(
            "doc_id", "label", F.lit(f"ensemble_{ensemble}").alias("model"), "p_spam", "prediction"))
    scores = materialise(scores, "scores")
    return Run(p, models, scores, E.metrics(scores, "model"), failed or {})


def experiment_entry(model_metrics: DataFrame, vectorizer: str, at: Column | None = None) -> DataFrame:
    """Experiment-log row ``timestamp, vectorizer, best_model, results`` from the metrics of one run."""
    ranked = E.leaderboard(model_metrics)
    results = F.array_sort(F.collect_list(F.struct("model", *E.METRICS)))
    return ranked.agg(F.max(F.when(F.col("is_best"), F.col("model"))).alias("best_model"), results.alias("results")).select(
        (at if at is not None else F.current_timestamp()).alias("timestamp"), F.lit(vectorizer).alias("vectorizer"),
        "best_model", "results")


def registry_entries(model_metrics: DataFrame, dataset_version: str, model_dir: str = "models",
                     at: Column | None = None) -> DataFrame:
    """Registry rows of one run, all active, versions within the run."""
    rows = model_metrics.select(
        F.col("model").alias("model_name"), F.col("model").alias("algorithm"),
        F.lit(dataset_version).alias("dataset_version"), F.create_map().cast("map<string,string>").alias("parameters"),
        F.struct(*E.METRICS, "confusion_matrix").alias("metrics"),
        F.concat(F.lit(f"{model_dir}/"), F.col("model")).alias("file_path"), F.lit("active").alias("status"),
        (at if at is not None else F.current_timestamp()).alias("registered_at"))
    return G.with_versions(rows)
