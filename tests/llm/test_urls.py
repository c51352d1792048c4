import random
import re

import duckdb

from eventloom.llm import urls


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(found)[2:] if found else (None, "allow")))


def test_against_all_rules(spark, monkeypatch):
    r = random.Random(1)
    host = lambda: ".".join(r.choice(["a", "b", "co", "org", "com", "example", "x1"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 5)))
    rules = list({(h, p): (h, p, v) for h, p, v in ((host(), path(), r.choice(["allow", "block"])) for _ in range(200))}.values())
    rows = [(i, r.choice(["http://", "HTTPS://", "x"]) + host().upper() + r.choice(["", path(), path() + "?q=/a", "#/a/", "?/a"])) for i in range(3000)]
    rows += [(3001, None), (3002, ""), (3003, "no scheme"), (3004, "://"), (3005, "http://a.org\n/x\n?"), (3005, "http://a.org\n/x\n?"), (3006, "http://a\x01b/a"), (3007, "http://b\x02.a\x01/a"), (3008, "http://a\x02\x02b/"), (None, "http://A.co/")]
    rules += [("a\x01b", "/a", "block"), ("a\x02\x02b", "/", "block"), ("a", "/a", "block")]
    rules = list({r[:2]: r for r in rules}.values())
    rows += [(i, "http://hot.example.com/a/b") for i in range(4000, 5000)]  # a url that repeats
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    want = sorted((i or -1, *map(str, brute(u, rules))) for i, u in rows)
    for run in (10**6, 17):
        monkeypatch.setattr(urls, "RUN", run)
        assert sorted((x[0] or -1, *map(str, x[1:])) for x in urls.judge(df, rules).collect()) == want
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted((x[0] or -1, *map(str, x[1:])) for x in urls.judge(df, table).collect()) == want
    assert {x["verdict"] for x in urls.judge(df, []).collect()} == {"allow"}


def test_pages_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    cur = con.execute(urls.ORACLE)
    assert [d[0] for d in cur.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in urls.op6_url_filter(spark, "/root/testdata/sf0.01").collect())
