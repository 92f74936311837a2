from pyspark.sql import functions as F

from lotwise.llm.url_filter import host_of, judge, mine, parsed, path_of

URLS = [
    (1, "http://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://a.example.org/en/1?q#f", "a.example.org", "/en/1", "example.org/en/1", "block"),
    (3, "http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    (4, "https://shop.com/de/?x=/fr/", "shop.com", "/de/", "com/de/", "block"),
    (5, "https://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
    (6, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (7, "http://example.org", "example.org", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme/path", "", "", None, "allow"),
    (10, "x://É.ORG?a/b", "É.org", "", None, "allow"),
    (11, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (12, "://\n.com/fr/\n?", "\n.com", "/fr/\n", "com/fr/", "allow"),
    (13, "", "", "", None, "allow"),
]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in URLS], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, labels).collect()}
    assert got == {i: tuple(rest) for i, _, *rest in URLS}


def labelled(spark):
    urls, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        kind = "casino" if i % 8 == 0 else "news"
        ending = "?promo=1" if bad else "?id=2" if i % 3 else ""
        urls.append((i, f"http://{kind}{i % 5}.example.net/{'win' if bad else 'read'}/{i}{ending}"))
        marks.append((i, 0 if bad and i % 16 else 1, 1 if i % 16 == 0 else 0))
    urls += [(1000, "http://x.example.net/win/9"), (1001, "http://x.example.net/read/9"), (1002, None)]
    return (spark.createDataFrame(urls, "page_id long, url string"),
            spark.createDataFrame(marks + [(3, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int"))


def test_mined_rules_match_brute_force(spark):
    pages, labels = labelled(spark)
    rules = mine(parsed(pages), labels, min_confidence=0.6, min_count=20)
    assert ("path:win",) in [a for a, _ in rules]
    rows = parsed(pages).collect()
    marks = [(r.doc_id, r.quality == 0 or r.toxic == 1) for r in labels.collect()]
    sets = {r.page_id: set(r.tokens) for r in rows}
    for antecedent, confidence in rules:
        on = [bad for i, bad in marks if i in sets and set(antecedent) <= sets[i]]
        assert abs(sum(on) / len(on) - confidence) < 1e-9 and confidence >= 0.6
    verdicts = {r.page_id: r.mined for r in judge(pages, labels, min_confidence=0.6, min_count=20).collect()}
    assert verdicts == {i: any(set(a) <= s for a, _ in rules) for i, s in sets.items()}
    assert verdicts[1000] and not verdicts[1001] and not verdicts[1002]


def test_a_bad_host_is_mined_at_every_size(spark):
    hosts = [(i, f"http://spam.example.net/a{i}") for i in range(30)]
    for others in (0, 200, 12000):
        pages = spark.createDataFrame(hosts + [(1000 + i, f"https://h{i % 50}.example.net/b/{i}") for i in range(others)],
                                      "page_id long, url string")
        labels = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") < 1000, 0).otherwise(1)
                              .alias("quality"), F.lit(0).alias("toxic"))
        got = {r.page_id: r.verdict for r in judge(pages, labels).collect()}
        assert all(got[i] == ("block" if i < 1000 else "allow") for i in got) and len(got) == 30 + others


def test_too_few_labels_mine_nothing(spark):
    pages, labels = labelled(spark)
    assert mine(parsed(pages), labels.limit(10)) == []


def test_empty_table(spark):
    pages, labels = labelled(spark)
    assert judge(pages.where("false"), labels).collect() == []


def test_host_and_path_expressions(spark):
    frame = spark.createDataFrame([("ftp://U:P@H.x:80/p;a?b",)], "url string")
    assert tuple(frame.select(host_of("url"), path_of("url")).first()) == ("u:p@h.x:80", "/p;a")


def test_many_shared_tokens_are_mined_in_seconds(spark):
    """60 bad URLs share 30 path words, which good URLs have too, so none is a rule by itself."""
    import time
    from itertools import product
    words = "/".join("".join(c) for c in list(product("abcdef", repeat=3))[:30])
    urls = [(i, f"http://a.example.net/{words}/bad?x={i}") for i in range(60)]
    urls += [(100 + i, f"http://a.example.net/{words}/good?y={i}") for i in range(90)]
    urls += [(300, f"http://a.example.net/{words}/bad/new"), (301, "http://a.example.net/bad"), (302, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in urls[:150]], "doc_id long, quality int, toxic int")
    began = time.time()
    rules = mine(parsed(pages), labels)
    assert time.time() - began < 60
    assert [a for a, _ in rules] == [("key:x",), ("path:bad",)]
    got = {r.page_id: r.mined for r in judge(pages, labels).collect()}
    assert got[0] and got[300] and got[301] and not got[100] and not got[302]


def test_combinations_of_two_and_of_tokens_that_stand_together(spark):
    urls, marks = [], []
    for i in range(400):
        a, b = i % 2, i // 2 % 2
        path = "/".join(["left/leftside"] * a + ["right"] * b + ["all"])
        urls.append((i, f"http://h.example.net/{path}"))
        marks.append((i, 0 if a and b else 1, 0))
    urls.append((900, "http://h.example.net/left/right"))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = mine(parsed(pages), labels, min_confidence=0.9)
    assert [a for a, _ in rules] == [("path:left", "path:leftside", "path:right")]
    got = {r.page_id: r.mined for r in judge(pages, labels, min_confidence=0.9).collect()}
    assert all(got[i] == (i % 2 and i // 2 % 2 == 1) for i in range(400)) and not got[900]
