"""Stores, registry, metrics, samples and neighbours."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import evaluation as E, features as FE, feedback as FB, neighbours as N, registry as G, retention as RT
from mailsift.operators.sampling import exact_sample, stratified_split
from mailsift.sources import stores


def test_metrics_golden(spark):
    rows = [("spam", "spam")] * 93 + [("ham", "spam")] * 7 + [("ham", "ham")] * 100
    m = E.metrics(spark.createDataFrame(rows, "prediction STRING, label STRING")).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"]) == (0.965, 1.0, 0.93, 0.9637)
    assert m["confusion_matrix"] == [[100, 0], [7, 93]]
    one = E.metrics(spark.createDataFrame([("ham", "ham")], "prediction STRING, label STRING")).first()
    assert (one["accuracy"], one["f1_score"], one["confusion_matrix"]) == (1.0, 0.0, [[1]])


def test_versions(spark, tmp_path):
    store = stores.DatasetVersions(spark, str(tmp_path))
    assert store.register(spark.range(3), source="a") == "v1"
    assert store.register(spark.range(5)) == "v2"
    assert {r["version"]: r["num_samples"] for r in store.list().collect()} == {"v1": 3, "v2": 5}
    assert store.read("v2").count() == 5
    with pytest.raises(ValueError):
        store.read("v9")


def test_feature_store_last_write_wins(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path))
    long = spark.createDataFrame([(1, 0, .5), (2, 7, .5)], "doc_id LONG, term_id INT, weight DOUBLE")
    store.save(long, "a")
    store.save(long.filter("doc_id = 1"), "a", "v2")
    assert store.exists("a") and not store.exists("b") and store.load("a").count() == 1
    meta = store.list().collect()
    assert len(meta) == 1 and meta[0]["name"] == "a" and meta[0]["shape"] == [1, 1]
    with pytest.raises(KeyError):
        store.load("b")


def test_registry(spark):
    cols = "model_name STRING, version INT, dataset_version STRING, f1_score DOUBLE, status STRING, registered_at TIMESTAMP"
    base = spark.createDataFrame([], cols)
    ts = [F.to_timestamp(F.lit(f"2024-01-0{i} 00:00:00")) for i in (1, 2, 3)]
    new = [spark.range(1).select(F.lit("nb").alias("model_name"), F.lit(f"v{i}").alias("dataset_version"),
                                 F.lit(f).cast("double").alias("f1_score"), F.lit("active").alias("status"), t.alias("registered_at"))
           for i, (t, f) in enumerate(zip(ts, (.9, .9, None)))]
    reg = G.register(G.register(G.register(base, new[0]), new[1]), new[2])
    assert sorted(r["version"] for r in reg.collect()) == [1, 2, 3]
    assert G.best_active(reg).first()["version"] == 1
    assert G.best_active(G.archive(reg, "nb", 1)).first()["version"] == 2
    assert G.latest_active(reg).first()["version"] == 3
    assert G.default_model(base).first()[0] == "naive_bayes"


def test_retention_and_trigger(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01")], "id LONG, d STRING").select(
        "id", F.to_timestamp("d").alias("timestamp"))
    as_of = F.to_timestamp(F.lit("2024-03-02"))
    assert [r["id"] for r in RT.kept(rows, as_of).collect()] == [2]
    assert RT.audit(rows, as_of).first()["details"] == "Deleted 1 expired records (older than 30 days)"
    assert RT.audit(rows.filter("id = 2"), as_of).count() == 0
    assert FB.retrain_trigger(rows, "2024-02-01").first() == (2, 1, False, False)


def test_split_is_exact_and_disjoint(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "spam").otherwise("ham").alias("label"))
    split = stratified_split(rows, "id", "label", n_buckets=8)
    got = {(r["label"], r["is_test"]): r["n"] for r in split.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    assert got == {("spam", True): 20, ("spam", False): 80, ("ham", True): 180, ("ham", False): 720}
    assert split.select("id").distinct().count() == 1000
    by_hash = sorted(range(1000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for n in (0, 1, 37, 1000, 2000):
        assert {r["id"] for r in exact_sample(rows, "id", n).collect()} == set(by_hash[:n])


def test_sample_of_repeated_keys_is_exact(spark):
    rows = spark.range(500).select(F.lit(7).alias("id"), F.col("id").alias("x"))
    assert exact_sample(rows, "id", 123).count() == 123
    assert exact_sample(rows.filter("x < 0"), "id", 5).count() == 0


def test_terms_are_counted_within_the_row(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb aa"), (2, ""), (3, None)], "doc_id LONG, text STRING")
    v = FE.get_vectorizer("bow", min_df=1, max_df=1.0)
    got = {r["doc_id"]: r["terms"] for r in FE.with_terms(docs, v).collect()}
    assert {t["term"]: t["tf"] for t in got[1]} == {"aa": 3, "bb": 2, "aa bb": 2, "bb aa": 2}
    assert not got[2] and not got[3]
    vocab, vecs = FE.fit_transform(docs, "bow", min_df=1, max_df=1.0)
    assert {r["term"]: (r["df"], r["cf"]) for r in vocab.collect()} == {
        "aa": (1, 3), "bb": (1, 2), "aa bb": (1, 2), "bb aa": (1, 2)}
    assert {r["doc_id"]: len(r["entries"]) for r in vecs.collect()} == {1: 4, 2: 0, 3: 0}


@pytest.mark.parametrize("method", ["tfidf", "tfidf_char"])
def test_weights_of_any_documents_without_a_row_per_occurrence(spark, monkeypatch, method):
    """Against plain counting: copies of keys, null keys and texts, chunks of a few terms, and a vocabulary that is joined."""
    from collections import Counter

    from mailsift.operators import termcounts
    monkeypatch.setattr(termcounts, "ENTRIES", 5)
    texts = ["aa bb aa", "bb aa cc", "", None, "ää aa bb x", "cc cc cc cc", "bb aa"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (5, texts[5]), (6, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")

    def terms(text):
        words = (text or "").replace("ä", "a").split()
        if method == "tfidf":
            words = [w for w in words if len(w) > 1]
            return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        return Counter(p[i:i + n] for p in (f" {w} " for w in words) for n in (3, 4, 5) for i in range(len(p) - n + 1))
    bags = [terms(t) for t in texts]
    df = Counter(t for b in bags for t in b)
    cf = sum(bags, Counter())
    kept = sorted(t for t in df if df[t] >= 2)
    want = {}
    for (k, _), bag in zip(rows, bags):
        want.setdefault(k, []).extend(
            (kept.index(t), (np.log(n) + 1) * (np.log(8 / (df[t] + 1)) + 1)) for t, n in bag.items() if t in kept)
    for most in (100, 200_000):
        vocab, vecs = FE.fit_transform(docs, method, min_df=2, max_df=1.0, max_features=most)
        assert [(r["term"], r["df"], r["cf"]) for r in vocab.orderBy("term_id").collect()] == [(t, df[t], cf[t]) for t in kept]
        got = {r["doc_id"]: r["entries"] for r in vecs.collect()}
        assert set(got) == set(want)
        for k, entries in want.items():
            norm = np.sqrt(sum(w * w for _, w in entries))
            assert [e["term_id"] for e in got[k]] == [i for i, _ in sorted(entries)]
            assert np.allclose([e["weight"] for e in got[k]], [w / norm for _, w in sorted(entries)])
    unique, v = docs.filter("doc_id > 1"), FE.get_vectorizer(method, min_df=1, max_df=1.0)
    tokens = FE.with_tokens(unique, v)
    plan = FE.vectors(tokens, FE.fit(tokens, v), v)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan  # rows with keys of their own are not shuffled


@pytest.mark.parametrize("exclude_self,block", [(True, 4096), (False, 16)])
def test_neighbours_equal_brute_force(spark, exclude_self, block):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(120, 8)).astype("float32")
    data[:50] = data[0]  # equal vectors make up a large part
    data = np.round(data, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id LONG, embedding ARRAY<FLOAT>")
    got = {}
    for r in N.nearest(df, df, 3, exclude_self=exclude_self, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbour_id"]))
    exact = data.astype("float64")
    for i in range(len(data)):
        d = ((exact[i] - exact) ** 2).sum(1).round(6)
        best = sorted((x, j) for j, x in enumerate(d) if not (exclude_self and j == i))[:3]
        assert [(x, j) for _, x, j in sorted(got[i])] == best


def test_neighbours_copy_a_row_once_per_block_of_the_other_side(spark):
    """Without a cell to rule out, a query visits one group of cells for every block, however many cells there are."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 6)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    pivots = N.choose_pivots(df, "vec_id", 30)
    summary = N.cell_summary(N.assign_cells(df, pivots, "vec_id"), 4)
    for block in (16384, 300, 10):
        group = N.cell_groups(pivots[summary["cell"].to_numpy()], summary["n"].to_numpy(), block)
        held = np.bincount(group, summary["n"].to_numpy())
        assert all(n <= block or (group == g).sum() == 1 for g, n in enumerate(held))
        assert len(held) <= 1 + 2 * 900 // block
        visits = N.route(df, pivots, summary, 4, "vec_id", group).collect()
        assert max(len(r["targets"]) for r in visits) <= len(held)
    for k, x in ((1, data), (4, data), (7, np.repeat(data[:30], 9, axis=0))):
        found = N._nearest_in_block(x, np.arange(len(x)), x, np.arange(len(x)), k)
        for i, own in found.groupby("_first"):
            d = ((x[i] - x) ** 2).sum(1).round(6)
            assert list(zip(own["distance"], own["neighbour_id"])) == sorted(zip(d, range(len(x))))[:k]


def test_words_of_a_large_batch_are_counted_in_small_parts():
    """Counting these 600,000 words held 81 MB of numpy arrays at once when up to 4,000,000 occurrences were sorted together."""
    import tracemalloc

    import pyarrow as pa

    from mailsift.operators import termcounts
    words = pa.array([f"w{i}" for i in range(50_000)])
    code = np.random.default_rng(1).integers(0, len(words), 600_000)
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, 600_001, 300, dtype=np.int32)), words.take(pa.array(code)))
    tracemalloc.start()
    seen = total = 0
    for c in termcounts.counts(tokens, "word", (1, 2)):
        assert c.first == seen and c.tf.sum() <= termcounts.ENTRIES
        seen, total = seen + c.n, total + c.tf.sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2000 and total == 2000 * (300 + 299) and peak < 60e6


def test_top_shares_in_small_parts(spark, monkeypatch):
    from mailsift.operators import naive_bayes as NB
    rng = np.random.default_rng(2)
    rows = [(i, [(int(t), float(w)) for t, w in zip(np.sort(rng.choice(40, i % 9, replace=False)), rng.random(9))]) for i in range(60)]
    vecs = spark.createDataFrame(rows, "doc_id LONG, entries ARRAY<STRUCT<term_id: INT, weight: DOUBLE>>").coalesce(1)
    value = {t: float(v) for t, v in enumerate(rng.normal(size=40))}
    coefs = spark.createDataFrame([(t, f"t{t}", v) for t, v in value.items()], "term_id INT, term STRING, coefficient DOUBLE")
    for most in (7, 1 << 18):
        monkeypatch.setattr(NB, "_ENTRIES", most)
        got = {r["doc_id"]: [k["word"] for k in r["keywords"]] for r in NB.contributions(vecs, coefs, 3).collect()}
        for i, entries in rows:
            want = sorted(((t, round(w * value[t], 4)) for t, w in entries), key=lambda x: (-abs(x[1]), f"t{x[0]}"))
            assert got.get(i, []) == [f"t{t}" for t, x in want if x][:3]


def test_distances_of_a_block_are_bounded_in_single_precision():
    """Half the memory and time of double precision, which held 24 MB here; where single precision cannot tell, the answer stays exact."""
    import tracemalloc
    rng = np.random.default_rng(5)

    def brute(x, k):
        d = np.array([((x - row) ** 2).sum(1).round(6) for row in x])
        return [(i, int(j), d[i, j]) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]]
    for x in (rng.normal(size=(700, 8)), 1000 + 1e-2 * rng.normal(size=(700, 8)), 1e18 * rng.normal(size=(300, 8)),
              rng.normal(size=(700, 8)) * 10.0 ** rng.integers(-3, 4, (700, 1)), np.round(rng.normal(size=(700, 3)), 1)):
        got = N._nearest_in_block(x, np.arange(len(x)), x, np.arange(len(x)), 3)
        assert list(got.itertuples(index=False, name=None)) == brute(x, 3)
    x = rng.normal(size=(4096, 64))
    tracemalloc.start()
    N._nearest_in_block(x[:512], np.arange(512), x, np.arange(4096), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
