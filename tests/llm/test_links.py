from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shoplore.llm.queries import QUERIES, URL_RULES
from shoplore.llm.quotes import chat_line, normalised, own_text, reply_ordered
from shoplore.llm.urls import page_links, url_node, url_verdicts

SMALL = "/root/testdata/sf0.001"


# URLs

def verdicts(spark, pages, redirects=None, columns="page_id long, url string, html string"):
    return {r["page_id"]: r for r in url_verdicts(spark.createDataFrame(pages, columns), URL_RULES, redirects=redirects).collect()}


def test_hosts_paths_and_longest_rules(spark):
    urls = {1: "http://A.Example.COM/en/x?y#z", 2: "https://www.example.com/en/", 3: "http://x.www.example.com/en/a", 4: "http://example.com/de/",
            5: "ftp://q.net/es/1", 6: "http://net/fr/", 7: "http://notnet/fr/", 8: "http://a.org", 9: None, 10: "no scheme", 11: "://h.net?x=/es/",
            12: "http://e.com", 13: "", 14: "x://y.net/fr/a://b"}
    got = verdicts(spark, [(k, u, None) for k, u in urls.items()])
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"), 4: ("example.com", "/de/", "com/", "allow"),
        5: ("q.net", "/es/1", "net/es/", "block"), 6: ("net", "/fr/", "net/fr/", "block"), 7: ("notnet", "/fr/", None, "allow"),
        8: ("a.org", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("h.net", "", None, "allow"),
        12: ("e.com", "", None, "allow"), 13: ("", "", None, "allow"), 14: ("y.net", "/fr/a://b", "net/fr/", "block")}


def test_blocks_reach_aliases_and_allows_win(spark):
    def link(target):
        return f"<head><LINK href='{target}' rel=canonical></head>"

    pages = [
        (1, "http://a.org/1", link("http://a.net/es/1")), (2, "http://b.org/1", '<meta http-equiv="refresh" content="0; URL=http://a.org/1">'),
        (3, "http://c.org/1", link("http://b.org/1/?utm_source=x#top")), (4, "http://d.org/1", "<link rel=\"next\" href='http://a.org/1'>"),
        (5, "http://e.org/1", link("http://f.net/fr/2")), (6, "http://g.org", link("http://e.org/1")), (7, "http://h.com/x", link("http://e.org/1")),
        (8, "http://i.org/p/q", link("r")), (9, "http://i.org/p/r", link("//k.net/es/")), (10, "http://c.org/1", None), (11, "https://b.org/1#f", "")]
    redirects = spark.createDataFrame([("http://old.org/z", "http://k.net/es/"), (None, "http://a.org/1")], "a string, b string")
    got = verdicts(spark, pages + [(12, "http://old.org/z", None), (13, "http://a.com/1", link("http://a.net/es/1"))], redirects)
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "allow",
        12: "block", 13: "allow"}  # 13 is explicitly allowed and frees 1, 2 and 3; 7 frees 5 and 6
    got = verdicts(spark, pages, redirects)
    assert sorted(k for k, r in got.items() if r["verdict"] == "block") == [1, 2, 3, 8, 9, 10, 11]


def test_url_edge_cases(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/", "<p>", "v"), (1, "http://a.net/es/", "<p>", "v")], "page_id long, url string, html string, verdict string")
    got = url_verdicts(df, URL_RULES)
    assert got.columns == ["page_id", "url", "html", "verdict", "host", "path", "rule", "verdict_"]
    assert [r["verdict_"] for r in got.collect()] == ["block", "block"] and url_verdicts(df.limit(0), URL_RULES).count() == 0
    assert page_links(df).count() == 0
    node = spark.createDataFrame([("HTTP://X.org/a//?ref=1&b=2&utm_z=3#f",), ("http://x.org?utm_a=1",)], "u string").select(url_node(F.col("u"))).collect()
    assert [r[0] for r in node] == ["x.org/a?b=2", "x.org"]


# quotes

def test_quotes_are_linked_at_every_level(spark):
    mail = [
        (1, 0, "user", "Hello there.\n\nHow do I join two tables?"),
        (1, 1, "assistant", "On Monday user wrote:\n> How do I  join two tables?\nUse a join."),
        (1, 2, "user", "> Use a JOIN.\n>> How do I join two tables?\n\nThanks, works."),
        (1, 3, "user", "> nothing that anybody wrote\nHm."),
        (1, 4, "assistant", ">> Hello there.\nGood morning."),
        (1, 5, "user", "> Hello there.\n> Good\nFirst line only."),
        (2, 0, "user", "> Use a join.\nother conversation"),
        (2, None, "user", "no turn"), (None, 3, None, "> no turn\nx"), (2, 1, "user", None), (2, 1, "user", ""), (2, 1, "user", "")]
    df = spark.createDataFrame(mail, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))
    got = {(r["conv_id"], r["turn"]): r for r in reply_ordered(df).collect()}
    assert {k[1]: (r["reply_to"], r["thread"], r["depth"], r["position"], r["text"]) for k, r in got.items() if k[0] == 1} == {
        0: (None, 0, 0, 0, "Hello there.\n\nHow do I join two tables?"), 1: (0, 0, 1, 1, "Use a join."), 4: (0, 0, 1, 2, "Good morning."),
        5: (0, 0, 1, 3, "First line only."), 2: (1, 0, 2, 4, "Thanks, works."), 3: (None, 3, 0, 5, "Hm.")}
    assert got[2, 0]["reply_to"] is None and got[2, 0]["quote_levels"] == 1 and got[1, 2]["quote_levels"] == 2
    assert got[2, None]["position"] is not None and got[None, 3]["text"] == "x" and reply_ordered(df).count() == len(mail)
    assert reply_ordered(df.limit(0)).count() == 0
    assert "Python" not in reply_ordered(df)._jdf.queryExecution().toString()


def test_latest_source_wins_over_many_turns(spark):
    n = 9000
    rows = [(7, t, "user", "same words" if t % 4000 == 0 else f"line {t}") for t in range(n)] + [(7, n, "user", "> same words\nyes")]
    rows += [(7, n + 1 + k, "user", "> yes\nno") for k in range(3)]
    got = {r["turn"]: r for r in reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("reply_to IS NOT NULL").collect()}
    assert {t: (r["reply_to"], r["depth"]) for t, r in got.items()} == {n: (8000, 1), n + 1: (n, 2), n + 2: (n, 2), n + 3: (n, 2)}


def test_columns_of_text(spark):
    df = spark.createDataFrame([("a > b\nc",), ("  > > q\nmine",), (None,), ("She wrote:\nx",), ("He wrote:\n> x",)], "t string")
    assert [r[0] for r in df.select(own_text(F.col("t"))).collect()] == ["a > b\nc", "mine", None, "She wrote:\nx", ""]
    assert df.select(normalised(F.lit("  A \u00a0b\n"))).first()[0] == "a b"
    assert df.select(chat_line(F.lit("user"), F.lit("hi"))).first()[0] == "<|user|>\nhi\n<|end|>\n"


@pytest.mark.parametrize("name", ["op7_quotes", "op4_urls", "quoted_replies"])
def test_queries_stay_native(spark, name):
    plan = QUERIES[name].run(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
