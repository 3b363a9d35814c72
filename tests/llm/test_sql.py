"""Queries that SQL can express, against DuckDB."""

import pytest

from civicspark.llm import queries as Q
from civicspark.llm import url_rules
from oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, key):
    ok, n, _, detail = compare(spark, duck, key, Q.queries()[key], Q.oracle_sql()[key], SF)
    assert ok and n > 0, detail


@pytest.mark.parametrize("url", ["https://a.net/?goto=https://b.net/", "http://a.net/x?k=1&url=http%3A%2F%2Fb", "https://a.net/?redirect=https%3Ab"])
def test_redirects_are_found_in_both_schemes(spark, url):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert [r.pattern for r in url_rules.url_verdicts(pages, url_rules.PATTERNS).collect()] == ["~click-redirect"]


def test_phrases_are_filed_under_their_rarest_token(spark):
    urls = [(k, f"https://shop{k}.net/account/x{k}") for k in range(6)] + [(10, "https://a.net/account/login?x=1"), (11, "https://a.net/login-account/"), (12, "https://A.net/Wp-Login.PHP"),
                                                                             (13, "https://a.net/xadd-to-cart"), (14, "https://ad.doubleclick.net/a"), (15, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    index = {r.name: r.token for r in url_rules.rule_index(url_rules.PATTERNS, pages.filter("url is not null"), "url").collect()}
    assert index["~account/login"] == "login" and index["~wp-login.php"] in ("php", "wp") and index["~pixel-image"] == ""
    got = {r.page_id: r.pattern for r in url_rules.url_verdicts(pages, url_rules.PATTERNS).collect()}
    assert got[10] == "~account/login" and got[12] == "~login" and got[13] == "~cart" and got[14] == "~ad" and got[0] is None and got[15] is None
    assert url_rules.url_verdicts(pages.limit(0), url_rules.PATTERNS).count() == 0
