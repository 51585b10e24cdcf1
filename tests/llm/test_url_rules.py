"""URL rules against a rule-by-rule test of each url."""

import random

import pytest

from cohortlens.llm import queries, url_rules
from helpers import SF, rows_of, tuples, with_clashes


def brute(pages, rules, default="allow"):
    out = []
    for page_id, url in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            if rest[end : end + 1] == "/":
                path = rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, rule, verdict = max(fit, default=(0, 0, None, default))
        out.append((page_id, host, path, rule, verdict))
    return sorted(out, key=repr)


ODD = [
    (1, "http://www.Example.COM/en/x?q#f"), (2, None), (3, ""), (4, "no scheme"), (5, "http://example.com"), (6, "http://example.com?x=/en/"),
    (7, "https://notexample.com/en/"), (8, "ftp://a.b.net/es/1#/fr/"), (9, "http://u:p@net:80/es/"), (10, "x://net/fr/"), (11, "://com/"),
    (12, "a://b://com/x"), (13, "http:///en/"), (None, "http://example.com/en/1"), (14, "http://com/a\nb/é"), (15, "http://..com//"),
    (1, "http://www.Example.COM/en/x?q#f"), (16, "http://example.com/en/" + "y" * 100_000), (17, "http://net./es/"),
]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_odd_urls(spark, parts):
    pages = with_clashes(spark.createDataFrame([(i, u, "h", "v") for i, u in ODD * 3], "page_id LONG, url STRING, host STRING, verdict STRING"))
    got = url_rules.judge(pages, url_rules.rule_table(spark, queries.URL_RULES), parts=parts, sample=5)
    assert tuples(got) == brute(ODD * 3, queries.URL_RULES)


def test_all_pages(spark):
    assert tuples(queries.op4_url_rules(spark, SF)) == brute(rows_of("pages", "page_id, url"), queries.URL_RULES)


def test_many_nested_rules(spark):
    rng = random.Random(6)
    labels, paths = ["a", "b", "c", "a-b"], ["", "/", "/x", "/x/", "/xy"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(120)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, f"http://{host()}{rng.choice(paths)}") for i in range(500)]
    got = url_rules.judge(spark.createDataFrame(pages, "page_id LONG, url STRING"), url_rules.rule_table(spark, rules), default="block", parts=5, sample=10)
    assert tuples(got) == brute(pages, rules, "block")


def test_empty_tables_and_double_rules(spark):
    none = spark.createDataFrame([], "page_id LONG, url STRING")
    rules = url_rules.rule_table(spark, [("com", "/", "allow"), ("COM", "/", "block"), (None, "/", "block")])
    assert url_rules.judge(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/")], "page_id LONG, url STRING")
    assert tuples(url_rules.judge(one, url_rules.rule_table(spark, []))) == [(1, "x.com", "/", None, "allow")]
    assert tuples(url_rules.judge(one, rules)) == [(1, "x.com", "/", "com/", "block")]
