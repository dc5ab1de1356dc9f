"""Global order and top-N against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import ranking as R


@pytest.fixture(scope="module")
def terms(spark):
    rng = random.Random(1)
    counts = [rng.choice([1, 1, 1, 2, 2, 3, 7, 511, 512, 513, 5000, 5001, 1 << 40]) for _ in range(3000)]
    rows = [(f"t{i * 7919 % 3000:05d}", c) for i, c in enumerate(counts)]
    return rows, spark.createDataFrame(rows, "term string, cf long").repartition(6).cache()


def test_rank(terms):
    rows, df = terms
    got = {r["term"]: r["place"] for r in R.global_rank(df, "place", F.col("cf").desc(), F.col("term")).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {t: i for i, (t, _) in enumerate(want)}


@pytest.mark.parametrize("n", [0, 1, 250, 1000, 2999, 3000, 9000])
def test_most_frequent(terms, n):
    rows, df = terms
    got = {tuple(r) for r in R.most_frequent(df, n, "cf", "term").collect()}
    assert got == set(sorted(rows, key=lambda r: (-r[1], r[0]))[:n])


def test_nothing_to_rank(terms):
    none = terms[1].limit(0)
    assert R.global_rank(none, "place", F.col("term")).count() == 0 and R.most_frequent(none, 5, "cf", "term").count() == 0


def test_no_stage_takes_all_terms(terms):
    plan = R.most_frequent(terms[1], 1000, "cf", "term")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan
