"""Functions and setting tables from SQL."""

import pytest
from pyspark.sql import functions as F

from mailsift.functions import urls as U
from mailsift.plans import sqlsurface as Q


@pytest.fixture(scope="module")
def sql(spark):
    Q.register(spark)
    return spark


def test_levels_and_domains(sql):
    got = sql.sql("SELECT risk_level(75), risk_level(76), risk_level(30), risk_level(31), url_domain('HTTP://www.A.com:80/x'), "
                  "url_domain(NULL), risk_level(NULL)").first()
    assert tuple(got)[:6] == ("SUSPICIOUS", "HIGH RISK", "LOW", "SUSPICIOUS", "a.com:80", None)


def test_urls_as_rows_equal_the_column_expression(sql):
    texts = ["see http://a.com and www.b.org/x?y=1 or c.io", "nothing", "", None, "https://é.com/ü it's 'quoted' \\ http://d.com"]
    df = sql.createDataFrame(list(enumerate(texts)), "id int, text string")
    df.createOrReplaceTempView("some_texts")
    got = sql.sql("SELECT id, u.pos, u.url FROM some_texts, LATERAL urls_of(text) u").collect()
    want = df.select("id", F.posexplode(U.extract(F.col("text"))).alias("pos", "url")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 4


def test_a_setting_can_be_replaced(sql):
    sql.createDataFrame([("reward", "zebra")], "kind string, word string").createOrReplaceTempView("mail_words")
    sql.sql("SELECT 'a Zebra' AS body").createOrReplaceTempView("two_mails")
    assert sql.sql("SELECT w.word FROM two_mails m JOIN mail_words w ON contains(lower(m.body), w.word)").first()[0] == "zebra"
    Q.register(sql)
    assert sql.table("mail_words").count() == sum(map(len, Q.WORDS.values())) and sql.table("mail_brands").count() == 8
