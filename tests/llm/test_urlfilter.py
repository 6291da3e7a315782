"""Rules and character models of the URL filter."""

import math
from collections import Counter, defaultdict

import pytest

from faultline.llm import queries, urlfilter

SCHEMA = "page_id long, url string, html string, n long, host int, _found string"
ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://EXAMPLE.net"), (6, "http://example.net/EN/"),
    (7, "http://a.example.net/en/x?y#z"), (8, "http://notexample.net/en/"), (9, "x://y://example.com/de/"), (10, "http://org/fr/é"),
    (11, "http://org?/fr/"), (12, "http://org#/fr/"), (13, "http://a.b.org/fr/" + "long/" * 60_000), (None, "http://u.org/fr/"),
    (14, "http://日本.example.com/\n/x"), (14, "http://日本.example.com/\n/x"), (15, "HTTP://Shop.Net:80/"), (16, "http:///path"),
]


def report(spark, rows):
    df = spark.createDataFrame([(i, u, "", 1, 2, "x") for i, u in rows], SCHEMA)
    return urlfilter.url_report(df)


def test_rules_hosts_and_paths(spark):
    got = sorted((r.page_id or 0, r.host, r.path[:9], r.rule) for r in report(spark, ODD).collect())
    assert got == sorted([
        (1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "", "", None), (5, "example.net", "", None),
        (6, "example.net", "/EN/", "net/"), (7, "a.example.net", "/en/x", "example.net/en/"), (8, "notexample.net", "/en/", "net/"),
        (9, "y:", "//example", None), (10, "org", "/fr/é", "org/fr/"), (11, "org", "", None), (12, "org", "", None),
        (13, "a.b.org", "/fr/long/", "org/fr/"), (0, "u.org", "/fr/", "org/fr/"), (14, "日本.example.com", "/\n/x", None),
        (14, "日本.example.com", "/\n/x", None), (15, "shop.net:80", "/", None), (16, "", "/path", None),
    ])


def test_verdicts_of_odd_rows(spark):
    got = {r.page_id: (r.verdict, r.score) for r in report(spark, ODD).collect()}
    assert got[6][0] == "block" and got[7][0] == "allow" and got[10][0] == "allow"
    assert got[1] == got[2] == got[3] == ("block", None)
    assert all(score is not None for page, (_, score) in got.items() if page not in (1, 2, 3))


def test_without_examples_of_one_side(spark):
    rows = [(1, "http://a.org/fr/"), (2, "http://b.com/x"), (3, None), (4, "http://b.com/x")]
    assert sorted((r.page_id, r.verdict, r.score) for r in report(spark, rows).collect()) == [
        (1, "allow", 0.0), (2, "allow", 0.0), (3, "block", None), (4, "allow", 0.0),
    ]
    assert report(spark, []).count() == 0


def chance(counts, context, symbol):
    """Witten-Bell with whole contexts in dictionaries, from the shortest to the longest."""
    p = 1 / urlfilter.ALPHABET
    for k in range(len(context) + 1):
        after = counts[context[len(context) - k :]]
        if after:
            total, kinds = sum(after.values()), len(after)
            p = (after[symbol] + kinds * p) / (total + kinds)
    return p


def test_scores_equal_dictionaries(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = urlfilter.distinct_urls(pages, urlfilter.ORDER).collect()
    models = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for r in urls:
        if r.is_accepted is None or r.held_out:
            continue
        for at in range(urlfilter.ORDER, len(r.text)):
            for k in range(urlfilter.ORDER + 1):
                models[r.is_accepted][r.text[at - k : at]][r.text[at]] += 1
    got = {r.url: r.score for r in urlfilter.judged_urls(pages).collect()}
    assert len(got) == len(urls)
    for r in urls:
        ratios = [
            math.log(chance(models[True], r.text[at - 4 : at], r.text[at]) / chance(models[False], r.text[at - 4 : at], r.text[at]))
            for at in range(urlfilter.ORDER, len(r.text))
        ]
        assert got[r.url] == pytest.approx(sum(ratios) / len(ratios), abs=2e-6)


def test_chances_sum_to_one(spark):
    rows = [("ab", 3, 0), ("ac", 1, 2), ("bb", 0, 5), ("ba", 2, 2), ("ca", 0, 0)]
    df = spark.createDataFrame(rows, "gram string, accepted long, rejected long")
    level = urlfilter.shorter(df)
    below = urlfilter.chances(level, None)
    p = {r.gram: (r.p_accepted, r.p_rejected) for r in below.collect()}
    for m in (0, 1):
        met = sum(r[1 + m] for r in rows)
        kinds = len({r[0][1] for r in rows if r[1 + m]})
        unseen = kinds / urlfilter.ALPHABET / (met + kinds)
        assert sum(v[m] for v in p.values()) + unseen * (urlfilter.ALPHABET - len(p)) == pytest.approx(1)


def test_held_out_urls_are_told_apart(spark):
    """The mark separates labelled URLs that taught nothing."""
    table = queries.QUERIES["op11_url_filter"](spark, "/root/testdata/sf0.1").filter("rule IS NOT NULL")
    rows = table.collect()
    good = sorted(r.score for r in rows if r.verdict == "allow")
    bad = sorted(r.score for r in rows if r.verdict == "block")
    assert len(good) > 300 and len(bad) > 300 and good[len(good) // 50] > bad[-len(bad) // 50]


@pytest.mark.parametrize("order", [1, 6])
def test_other_orders(spark, order):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert urlfilter.url_report(pages, order).count() == pages.count()
