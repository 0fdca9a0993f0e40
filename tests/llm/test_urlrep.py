import duckdb
import pytest
from pyspark.sql import functions as F

from leafwork.llm import urlrep

KIND = "page_id long, url string, fits string, host string"


def pages(spark):
    urls = [None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "https://m.example.com/en/1",
            "https://example.com/de/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/en/", "x://http://b.net/es/", "http://com/", "http://notcom/", "http://É.org/en/", "http://h.org#a://b"]
    urls += [f"http://bad.site.net/es/{i}" for i in range(40)] + ["http://bad.site.net/en/1", "http://other.site.net/en/2"]
    return [(i, u, "clash", None) for i, u in enumerate(urls)] + [(3, "http://a.com/", None, None)]


def test_rules_and_verdicts(spark):
    rows = pages(spark)
    got = urlrep.judge(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id != 3}
    assert (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by[7].rule == by[8].rule == "example.com/en/" and by[7].verdict == "block"
    assert (by[4].path, by[4].rule) == ("", None)
    assert by[9].rule == "com/" and by[9].verdict == "allow"
    assert by[15].rule is None and by[14].rule == "com/"
    assert (by[13].host, by[17].host) == ("http:", "h.org")
    assert all(by[i].host == "" and by[i].path == "" for i in (0, 1, 2))
    assert by[16].host == "É.org"
    assert (by[58].rule, by[58].verdict) == (None, "block")
    assert by[12].verdict == "block"  # all labelled pages of its host are blocked


def test_against_sql(spark):
    rows = pages(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(i, u, "") for i, u, *_ in rows])
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlrep.judge_sql()})").fetchall()
    got = [tuple(r) for r in urlrep.judge(spark.createDataFrame(rows, KIND)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_shrinkage(spark):
    rows = [("a.x.org", 1)] * 30 + [("b.x.org", 1)] + [("c.y.org", 0)] * 200 + [("d.y.org", None)]
    got = {r.host: r for r in urlrep.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.org"].mean > got["b.x.org"].mean > got["d.y.org"].mean
    assert got["d.y.org"].n == 0
    assert all(r.lower <= r.mean <= r.upper for r in got.values())


def test_pages_without_a_rule_say_nothing(spark):
    rows = [(i, f"http://a.b.org/{k}/{i}", None, None) for i, k in enumerate("x" * 30 + "y" * 30 + "z" * 400)]
    rules = [("a.b.org", "/x", "block"), ("a.b.org", "/y", "allow")]
    got = urlrep.judge(spark.createDataFrame(rows, KIND), rules).collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow"}
    got = urlrep.judge(spark.createDataFrame(rows, KIND), rules[:1]).collect()
    assert {r.verdict for r in got if r.rule is None} == {"block"}


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "uk", "a.b.org", "org", ""]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", urlrep.domain_of(F.col("host")).alias("d"), urlrep.suffix_of(F.col("host")).alias("s")).collect()
    assert [(r.d, r.s) for r in got] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("b.org", "org"), ("org", "org"), ("", "")]


def test_empty_table(spark):
    assert urlrep.judge(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("rules", [[]])
def test_no_rules(spark, rules):
    got = urlrep.judge(spark.createDataFrame([(1, "http://a.b/c", None, None)], KIND), rules).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")]
