import random

import pytest
from helpers import same
from meridion.llm.url_filter import OP7_SQL, judge, op7_url_filter


def test_query_equals_sql(spark, sf_dir):
    same(op7_url_filter(spark, sf_dir), sf_dir, OP7_SQL, ("pages",))


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h and p is not None and a is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(f[:2] for f in fits)
    same_rule = [f for f in fits if f[:2] == best]
    return host, path, same_rule[0][2], "allow" if all(f[3] for f in same_rule) else "block"


RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True), ("a.example.net", "", False), ("net", "/en/x/y/z/long", True), ("org", "/fr/", False), ("com", "", True), (None, "/", False), ("", "/", False), ("b.com", None, True)]


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_any_cut_of_the_sweep(spark, partitions):
    rng = random.Random(3)
    hosts = ["example.net", "A.example.NET", "x.a.example.net", "notexample.net", "example.com", "q.example.com", "org", "w.org", "worg", "com", "net.com", "", ".net", "net.", "example.net:80", "b.com"]
    paths = ["", "/", "/en/", "/en/x/y/z/longer", "/de/1?x=/fr/", "/fr/#/de/", "?q=1", "#f", "/FR/", "/fr"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme", "http:/x", "a://b://c/d", "x\ny://net/\n/a", "http://hot.example.net/en/1"] + ["http://hot.example.net/en/1"] * 200
    df = spark.createDataFrame([(i % 100, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'c' AS host", "1 AS bucket", "2 AS row")
    rules = spark.createDataFrame(RULES, "host string, path string, allowed boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(((r.row.page_id, r.row.url, r.host, r.path, r.rule, r.verdict) for r in judge(df, rules).collect()), key=repr)
        assert judge(df.limit(0), rules).count() == 0
        assert {r.verdict for r in judge(df, rules.limit(0)).collect()} == {"allow"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(((i % 100, u, *plain(u, RULES)) for i, u in enumerate(urls)), key=repr)
