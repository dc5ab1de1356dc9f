"""Models on a small separable corpus."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators import features as FE, training as TR
from mailsift.plans import training as P
from mailsift.sources import generate

SMALL = {"svm": {"max_iter": 10}, "random_forest": {"n_estimators": 5, "max_depth": 4},
         "gradient_boosting": {"max_iter": 5, "max_leaf_nodes": 8}}


@pytest.fixture(scope="module")
def docs(spark):
    return generate.corpus(spark.range(200).toDF("doc_id"), "doc_id")


def test_all_models_learn(docs, tmp_path):
    run = P.run(docs, params=SMALL, model_dir=str(tmp_path))
    rows = {r["model"]: r for r in run.metrics.collect()}
    assert set(rows) == set(TR.DEFAULTS)
    assert all(0 <= r[m] <= 1 for r in rows.values() for m in ("accuracy", "precision", "recall", "f1_score"))
    assert rows["naive_bayes"]["f1_score"] > 0.8
    for name in TR.DEFAULTS:
        again = TR.load(str(tmp_path / name), name).score(run.prepared.test).select("doc_id", "p_spam").collect()
        first = run.models[name].score(run.prepared.test).select("doc_id", "p_spam").collect()
        assert len(again) == 40 and dict(map(tuple, again)) == pytest.approx(dict(map(tuple, first)))


def test_one_class_is_refused(docs):
    with pytest.raises(ValueError):
        P.run(docs.filter("label = 'ham'"), names=["naive_bayes"])


def test_unknown_names(docs):
    with pytest.raises(ValueError):
        FE.get_vectorizer("nope")
    with pytest.raises(ValueError):
        TR.build("nope", 1)


def test_corpus_is_balanced_and_stable(docs):
    assert docs.filter(F.col("label") == "spam").count() == 100
    assert docs.filter(F.col("text").contains("{")).count() == 0


def test_queries_train_with_the_defaults(spark):
    """The registered chain on real rows: five models, a search over all of them, and the stacked ensemble."""
    from mailsift.plans import models as M
    sf = "/root/testdata/sf0.001"
    ranked = M.train_all(spark, sf).collect()
    assert {r["model"] for r in ranked} == set(TR.DEFAULTS) and all(r["failure"] is None for r in ranked)
    assert sum(bool(r["is_best"]) for r in ranked) == 1
    stacked = M.stack(spark, sf).collect()
    assert stacked and all(0 <= r["p_spam"] <= 1 for r in stacked)
    tuned = {r["model"]: r for r in M.tune(spark, sf).collect()}
    assert set(tuned) == set(TR.SPACES) and all(0 <= r["macro_f1"] <= 1 for r in tuned.values())
    assert set(tuned["gradient_boosting"]["parameters"]) == {"max_iter", "learning_rate", "max_leaf_nodes", "l2_regularization"}


def test_failed_models_are_named(docs, monkeypatch):
    def broken(*args, **options):
        raise MemoryError("no room")
    rows = P.prepare(docs).train
    monkeypatch.setattr(TR, "train_in_passes", broken)
    failed = {}
    with pytest.warns(UserWarning):
        kept = TR.train_all(rows, ["naive_bayes", "svm", "gradient_boosting"], failed=failed)
    assert set(kept) == {"naive_bayes"} and set(failed) == {"svm", "gradient_boosting"} and "no room" in failed["svm"]


def test_a_failed_model_fails_the_run(docs, monkeypatch):
    def broken(*args, **options):
        raise MemoryError("no room")
    monkeypatch.setattr(TR, "train_in_passes", broken)
    with pytest.raises(MemoryError):
        P.run(docs, names=["naive_bayes", "svm"])
    with pytest.raises(MemoryError):
        P.run(docs, names=["naive_bayes", "gradient_boosting"], ensemble="voting")
    failed = {}
    with pytest.warns(UserWarning):
        kept = P.run(docs, names=["naive_bayes", "svm"], failed=failed)
    assert set(kept.models) == {"naive_bayes"} and set(kept.failed) == set(failed) == {"svm"}


def test_scored_emails_name_the_words(spark, docs):
    from mailsift.operators import blocklist as BL
    from mailsift.plans.scoring import score_emails
    p = P.prepare(docs)
    mails = docs.select(F.col("doc_id").alias("email_id"), F.col("text").alias("body"), F.lit("").alias("raw_headers"))
    for name in ("naive_bayes", "svm"):
        rows = score_emails(mails, BL.seeds(spark), p, TR.train(p.train, name), name).collect()
        spam = [r["threat_explanation"] for r in rows if r["prediction"] == "spam"]
        assert len(rows) == 200 and spam and any("semantic patterns identified around: " in x for x in spam)
