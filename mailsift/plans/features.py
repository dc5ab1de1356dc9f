"""Queries on vocabularies, term weights, naive Bayes and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P, text as T
from mailsift.operators import blocklist as B, decision as D, features as FE, naive_bayes as NB, risk as R
from mailsift.functions.rows import inline_rows
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.session import materialise
from mailsift.sources import derived
from mailsift.sources.emails import emails, table


def corpus(spark, sf_dir):
    """Preprocessed email texts."""
    return emails(spark, sf_dir).select(F.col("email_id").alias("doc_id"), T.preprocess(F.col("body")).alias("text"))


def labelled_corpus(spark, sf_dir):
    return emails(spark, sf_dir, labelled=True).filter("label IS NOT NULL").select(
        F.col("email_id").alias("doc_id"), T.preprocess(F.col("body")).alias("text"), "label")


_FLAT = "strip_accents(lower(text))"
_TOKENS = f"regexp_extract_all({_FLAT}, '[{P.WORD}]{{2,}}')"


def _docs(where: str = "") -> str:
    return f"{S.EMAILS}, docs AS (SELECT email_id AS doc_id, {S.preprocess('body')} AS text, label FROM emails {where})"


def _word_terms(docs: str = "docs", out: str = "uses") -> str:
    return f"""{out}_tok AS (SELECT doc_id, {_TOKENS} AS t FROM {docs}),
{out} AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {out}_tok)"""


_CHAR_TERMS = f"""words AS (SELECT doc_id, ' ' || unnest({S.tokens(_FLAT)}) || ' ' AS w FROM docs),
uses AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))) AS term FROM words WHERE length(w) >= {n}"
    for n in (3, 4, 5)) + ")"


def _vocab_sql(min_df: int, cap: int) -> str:
    return f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM uses GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM docs),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, cf,
  ln((1.0::DOUBLE + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1
  HAVING count(*) >= {min_df} AND count(*) <= 0.95 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT {cap}))"""


_WEIGHTS = """raw AS (SELECT doc_id, term_id, (1.0::DOUBLE + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
weights AS (SELECT doc_id, term_id, w / norm AS weight FROM raw JOIN norms USING (doc_id))"""


@query("vocab", f"WITH {_docs()}, {_word_terms()}, {_vocab_sql(2, 100_000)} SELECT term, CAST(term_id AS INT) AS term_id, df, cf, round(idf, 6) AS idf FROM vocab")
def vocab(spark, sf_dir):
    v = FE.get_vectorizer("tfidf")
    return FE.fit(FE.with_tokens(corpus(spark, sf_dir), v), v).withColumn("idf", F.round("idf", 6))


@query("bow", f"""WITH {_docs()}, {_word_terms()}, {_vocab_sql(2, 100_000)}
SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS DOUBLE) AS total, CAST(sum(tf * (term_id % 1000)) AS DOUBLE) AS id_sum FROM tf JOIN vocab USING (term) GROUP BY 1""")
def bow(spark, sf_dir):
    _, vecs = FE.fit_transform(corpus(spark, sf_dir), "bow")
    return FE.long_form(vecs).groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("weight").alias("total"),
        F.sum(F.col("weight") * (F.col("term_id") % 1000)).alias("id_sum"))


_PER_DOC = """SELECT doc_id, count(*) AS n_terms, round(sum(weight), 5) AS total, round(max(weight), 5) AS top FROM weights GROUP BY 1"""


def _per_doc(vecs):
    return FE.long_form(vecs).groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("top"))


@query("tfidf", f"WITH {_docs()}, {_word_terms()}, {_vocab_sql(2, 100_000)}, {_WEIGHTS} {_PER_DOC}")
def tfidf(spark, sf_dir):
    return _per_doc(FE.fit_transform(corpus(spark, sf_dir), "tfidf")[1])


@query("tfidf_char", f"WITH {_docs()}, {_CHAR_TERMS}, {_vocab_sql(5, 80_000)}, {_WEIGHTS} {_PER_DOC}")
def tfidf_char(spark, sf_dir):
    return _per_doc(FE.fit_transform(corpus(spark, sf_dir), "tfidf_char")[1])


@query("tfidf_transform", f"""WITH {_docs()}, {_word_terms()}, {_vocab_sql(2, 100_000)},
new_docs AS (SELECT item_id AS doc_id, {S.preprocess('text')} AS text FROM benchmark), {_word_terms('new_docs', 'new_uses')},
new_tf AS (SELECT doc_id, term, count(*) AS tf FROM new_uses GROUP BY 1, 2),
{_WEIGHTS.replace('FROM tf JOIN', 'FROM new_tf JOIN')}
SELECT doc_id, CAST(term_id AS INT) AS term_id, round(weight, 5) AS weight FROM weights""")
def tfidf_transform(spark, sf_dir):
    """Other texts with the fitted vocabulary."""
    v = FE.get_vectorizer("tfidf")
    vocabulary = materialise(FE.fit(FE.with_tokens(corpus(spark, sf_dir), v), v), "vocabulary")
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), T.preprocess(F.col("text")).alias("text"))
    vecs = FE.vectors(FE.with_tokens(new, v), vocabulary, v)
    return FE.long_form(vecs).withColumn("weight", F.round("weight", 5))


_NB = f"""WITH {_docs('WHERE label IS NOT NULL')}, {_word_terms()}, {_vocab_sql(2, 100_000)}, {_WEIGHTS},
sums AS (SELECT term_id, term, coalesce(sum(weight) FILTER (WHERE label = 'spam'), 0) AS spam, coalesce(sum(weight) FILTER (WHERE label = 'ham'), 0) AS ham
  FROM vocab LEFT JOIN weights USING (term_id) LEFT JOIN docs USING (doc_id) GROUP BY 1, 2),
model AS (SELECT term_id, term, ln(spam + 0.1) - ln((SELECT sum(spam + 0.1) FROM sums)) - ln(ham + 0.1) + ln((SELECT sum(ham + 0.1) FROM sums)) AS coefficient FROM sums),
gaps AS (SELECT doc_id, coalesce(sum(weight * coefficient), 0)
  + ln((SELECT count(*) FILTER (WHERE label = 'spam') / count(*) FILTER (WHERE label = 'ham')::DOUBLE FROM docs)) AS gap
  FROM docs LEFT JOIN weights USING (doc_id) LEFT JOIN model USING (term_id) GROUP BY 1)"""


def _fitted(spark, sf_dir):
    """(vectors, naive Bayes model, labels) of the labelled emails."""
    docs = labelled_corpus(spark, sf_dir)
    vocabulary, vecs = FE.fit_transform(docs, "tfidf")
    vecs = materialise(vecs, "vectors")  # read for the fit and for the scores
    labels = materialise(docs.select("doc_id", "label"), "labels")
    long = inline_rows(vecs.join(labels, "doc_id"), "entries", "term_id", "label")
    return vecs, NB.fit(long, vocabulary), labels


@query("nb_scores", f"{_NB} SELECT doc_id, round(1.0::DOUBLE / (1.0 + exp(-gap)), 4) AS p_spam, CASE WHEN gap > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM gaps")
def nb_scores(spark, sf_dir):
    vecs, model, labels = _fitted(spark, sf_dir)
    return NB.predict(vecs, model, labels).withColumn("p_spam", F.round("p_spam", 4))


_TOP = """, shares AS (SELECT doc_id, term, round_even(weight * coefficient, 4) AS impact FROM weights JOIN model USING (term_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(impact) DESC, term) AS rank FROM shares WHERE impact <> 0)"""


@query("top_contributions", f"{_NB}{_TOP} SELECT doc_id, CAST(rank - 1 AS INT) AS pos, term AS word, impact FROM top WHERE rank <= 5")
def top_contributions(spark, sf_dir):
    vecs, model, _ = _fitted(spark, sf_dir)
    top = NB.contributions(vecs, NB.coefficients(model))
    return top.select("doc_id", F.posexplode("keywords").alias("pos", "k")).select("doc_id", "pos", "k.word", "k.impact")


@query("explanation", f"""{_NB.replace(S.EMAILS, S.RISK, 1)}{_TOP}, {S.EVIDENCE}, best AS (SELECT doc_id, list(term ORDER BY rank) FILTER (WHERE impact > 0) AS words FROM top WHERE rank <= 5 GROUP BY 1),
final AS (SELECT r.email_id, {S.DECIDE} AS prediction, len(threat_reasons) AS n, list_slice(words, 1, 3) AS words FROM risk r
  JOIN evidence USING (email_id) LEFT JOIN best ON doc_id = r.email_id),
f AS (SELECT *, concat_ws(' ', CASE WHEN n > 0 THEN 'Detected ' || n || ' security threats.' END,
  CASE WHEN len(words) > 0 THEN 'Suspicious semantic patterns identified around: ' || array_to_string(words, ', ') || '.' END) AS factors FROM final)
SELECT email_id, CASE WHEN prediction = 'spam' THEN 'Classified as SPAM. ' || CASE WHEN factors = '' THEN 'Based on deep model confidence patterns.' ELSE factors END
  ELSE 'Classified as HAM (Safe). No significant threats detected.' END AS summary FROM f""")
def explanation(spark, sf_dir):
    vecs, model, _ = _fitted(spark, sf_dir)
    words = NB.contributions(vecs, NB.coefficients(model)).withColumnRenamed("doc_id", "email_id")
    analysed = R.analyse(emails(spark, sf_dir), B.seeds(spark)).select(
        "email_id", "risk_score", F.size("threat_reasons").alias("n_reasons"))
    decided = analysed.withColumns(derived.evidence()).withColumn("prediction", D.decide())
    none = F.array().cast("array<struct<word: string, impact: double>>")
    return decided.join(words, "email_id", "left").select("email_id", D.explain(
        F.col("prediction"), F.col("n_reasons"), F.coalesce("keywords", none)).alias("summary"))
