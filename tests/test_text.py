"""Text helpers on literal rows."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions import headers as H, text as T, urls as U
from mailsift.operators import decision as D, stemming
from mailsift.sources import loaders, mime


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x STRING").select(expr(F.col("x")).alias("y")).first()["y"]


def test_cleaning(spark):
    assert one(spark, "FREE money!! Win $500 NOW", T.clean) == "free money win now"
    assert one(spark, "See http://a.com/x or mail me@b.org", T.clean) == "see urltoken or mail emailtoken"
    assert one(spark, "Hello, World!", T.remove_punctuation) == "Hello World"
    assert one(spark, "Win 1000 dollars", T.remove_numbers) == "Win  dollars"
    assert one(spark, "", T.preprocess) == ""
    assert one(spark, "this is a test email", T.preprocess) == "test email"
    assert one(spark, "Win $1000, don't wait", T.clean_fast) == "win dont wait"


def test_anonymise(spark):
    text = "Write Jane Doe at jane.doe@example.com or 555-123-4567, see https://x.org/a"
    assert one(spark, text, T.anonymize) == "Write [NAME] at [EMAIL] or [PHONE], see [URL]".replace(
        "Write [NAME]", "[NAME]")


def test_url_extraction(spark):
    urls = one(spark, "Check this out: http://evil.com and https://192.168.1.1/login", U.extract)
    assert urls == ["http://evil.com", "https://192.168.1.1/login"]
    assert one(spark, "bit.ly/x and example.comé and plain.net.", U.extract) == ["plain.net"]


@pytest.mark.parametrize("url,host,path", [
    ("HTTP.example.com/A/", "http.example.com", "/A"), ("http://www.A.com:80/x/;p?q=1#f", "a.com", "/x"),
    ("https://a.com:443/", "a.com", ""), ("http://a.com:443", "a.com:443", ""),
    ("http://a.com/a%20b+c%zz", "a.com", "/a b+c%zz"), ("http://u:p@a.com", "u:p@a.com", "")])
def test_url_normal_form(spark, url, host, path):
    n = one(spark, url, U.normalize)
    assert (n["normalized_host"], n["path"]) == (host, path)


def test_broken_host(spark):
    n = one(spark, "http://[x/", U.normalize)
    assert n["normalized_host"] == "http://[x/" and n["path"] is None


def test_headers_last_key_wins(spark):
    raw = "From: a@b.com\nfrom: c@d.com\nno colon\nX:  y: z "
    assert one(spark, raw, lambda x: H.as_map(H.entries(x))) == {"from": "c@d.com", "x": "y: z"}


@pytest.mark.parametrize("word,stem", [
    ("running", "run"), ("played", "play"), ("happily", "happili"), ("caresses", "caress"), ("ponies", "poni"),
    ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("dying", "die"), ("agreed", "agre"),
    ("generalization", "gener"), ("adjustment", "adjust"), ("is", "is"), ("enjoy", "enjoy"), ("rate", "rate")])
def test_porter(word, stem):
    assert stemming.porter(word) == stem


def test_stemmed_text_keeps_order(spark):
    df = spark.createDataFrame([(1, "running dogs running"), (2, "")], "id LONG, text STRING")
    assert {r["id"]: r["text"] for r in stemming.stem_texts(df, "id").collect()} == {1: "run dog run", 2: ""}


def test_texts_are_stemmed_where_they_are(spark):
    rows = [(1, "running dogs running"), (2, None), (3, " "), (None, "dogs"), (5, "the skies fell"), (5, "dogs")]
    df = spark.createDataFrame(rows, "id LONG, text STRING")
    got = sorted(map(tuple, stemming.stem_texts(df, "id").collect()), key=str)
    assert got == sorted([(1, "run dog run"), (2, ""), (3, ""), (None, ""), (5, "dog the sky fell"), (5, "dog the sky fell")], key=str)
    unique = stemming.stem_texts(df.filter("id < 5"), "id")
    assert "hashpartitioning" not in unique._jdf.queryExecution().executedPlan().toString()


def test_column_aliases(spark):
    df = spark.createDataFrame([("spam", "hello")], "`V1` STRING, ` Message ` STRING")
    out = loaders.resolve_columns(df)
    assert out.select("text", "label").first() == ("hello", "spam")
    assert loaders.resolve_columns(df.select(F.lit("x").alias("note"))).first()["label"] == "ham"
    with pytest.raises(ValueError):
        loaders.resolve_columns(spark.range(1))


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Category,Message\nham,"two\nlines, one ""field"""\n')
    row = loaders.read_csv(spark, str(tmp_path / "m.csv")).first()
    assert (row["label"], row["text"]) == ("ham", 'two\nlines, one "field"')


def test_admission(spark):
    df = spark.createDataFrame([("",), ("  ",), ("x" * 50_001,), (" a ",), (None,)], "body STRING")
    assert sorted(r["body"] for r in loaders.accepted(df).collect()) == ["", "a"]
    assert loaders.rejected(df).count() == 3


def test_mime_body(spark):
    df = spark.range(1).select(F.lit("grüße?>").alias("t"))
    enc = mime.encode_base64url(F.col("t"))
    part = F.struct(F.lit("text/plain").alias("mimeType"), enc.alias("data"))
    none = F.lit(None)
    assert df.select(mime.body(F.array(part), none.cast("string"))).first()[0] == "grüße?>"


DECISIONS = [  # ml, ml_conf, dl, dl_conf, close spam neighbours, risk, verdict
    ("ham", .9, None, None, 0, 0, "ham"), ("ham", .9, "spam", .71, 0, 0, "spam"), ("ham", .9, "spam", .7, 0, 0, "ham"),
    ("spam", .6, "ham", .7, 0, 0, "ham"), ("spam", .6, "ham", .5, 0, 0, "spam"), ("ham", .9, "ham", .99, 2, 0, "spam"),
    ("ham", .9, None, None, 1, 80, "ham"), ("ham", .9, None, None, 0, 81, "spam")]


def test_decisions(spark):
    rows = [(i, ml, mc, dl, dc, [(0.1, "spam")] * n + [(0.9, "spam")], risk)
            for i, (ml, mc, dl, dc, n, risk, _) in enumerate(DECISIONS)]
    df = spark.createDataFrame(rows, "i INT, ml_prediction STRING, ml_confidence DOUBLE, dl_prediction STRING, "
                               "dl_confidence DOUBLE, similar_threats ARRAY<STRUCT<distance: DOUBLE, label: STRING>>, risk_score INT")
    got = {r["i"]: r["p"] for r in df.select("i", D.decide().alias("p")).collect()}
    assert got == {i: d[-1] for i, d in enumerate(DECISIONS)}
