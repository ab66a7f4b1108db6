from helpers import stored

from tidemark.llm.url_filters import HostRule, judge_urls, rule_table


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org/en/1x", "https://example.org/en/2", "http://org/",
            "http://org", "http://borg/", "x://y.com/fr/", "x://y.com/FR/", "x://y.com/de/?q=://z.org/", "://b.org/a://c", "http://casino-x.net/",
            "http://free-bets.net/en/1", "http://www.spam-farm.example.org/en/2", "http://h.com:80/fr/1", "http://h.com#/fr/", "http://exÀmple.ORG/É/",
            "https://casino.example", "https://casino.example?x=1", "https://www.adult.net#a", "https://a.net/casino", "http://casino.net/" + "a/" * 50_000]
    df = stored(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in judge_urls(df).collect()}
    want = {0: ("", "", None, "allow", None), 1: ("", "", None, "allow", None), 2: ("", "", None, "allow", None), 3: ("", "", None, "allow", None),
            4: ("a.example.org", "/es/1", "example.org/es/", "block", None), 5: ("example.org", "/en/1x", "example.org/en/1", "block", None),
            6: ("example.org", "/en/2", "org/", "allow", None), 7: ("org", "/", "org/", "allow", None), 8: ("org", "", None, "allow", None),
            9: ("borg", "/", None, "allow", None), 10: ("y.com", "/fr/", "com/fr/", "allow", None), 11: ("y.com", "/FR/", None, "allow", None),
            12: ("y.com", "/de/", "com/de/", "block", None), 13: ("b.org", "/a://c", "org/", "allow", None),
            14: ("casino-x.net", "/", None, "block", "casino"), 15: ("free-bets.net", "/en/1", None, "block", "betting"),
            16: ("www.spam-farm.example.org", "/en/2", "org/", "allow", None), 17: ("h.com:80", "/fr/1", None, "allow", None),
            18: ("h.com", "", None, "allow", None), 19: ("exÀmple.org", "/É/", "org/", "allow", None),
            20: ("casino.example", "", None, "block", "casino"), 21: ("casino.example", "", None, "block", "casino"), 22: ("www.adult.net", "", None, "block", "adult"),
            23: ("a.net", "/casino", None, "allow", None), 24: ("casino.net", "/" + "a/" * 50_000, None, "block", "casino")}
    assert got == want
    assert judge_urls(df.limit(0)).count() == 0
    twice = judge_urls(spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/"), (1, "x")], "page_id long, url string"))
    assert sorted((r.page_id or 0, r.verdict, r.rule or "") for r in twice.collect()) == [(0, "allow", "org/"), (0, "allow", "org/"), (1, "allow", "")]


def test_a_large_rule_table_with_rules_on_path_and_query(spark):
    rules = [(i, f"r{i}", rf"^(?:[^/]*\.)?\Qh{i}.net/\E", 10, "block", ["net", f"h{i}"]) for i in range(60_000)]
    rules += [(60_000, "track", r"/pixel/\d+", 0, "block", ["pixel"]), (60_001, "but not", r"^h5\.net/ok", 99, "allow", ["h5", "ok"])]
    table = spark.createDataFrame(rules, "no int, rule string, pattern string, weight long, verdict string, tokens array<string>")
    urls = ["http://h5.net/", "http://a.h59999.net/x", "http://h60000.net/", "http://x.org/pixel/77", "http://x.org/pixel/a", "http://h5.net/ok"]
    df = stored(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r.page_id: r.verdict for r in judge_urls(df, rules=table).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_rules_need_a_literal(spark):
    try:
        rule_table(spark, [HostRule("é", "/", "block")], [])
    except ValueError:
        return
    raise AssertionError
