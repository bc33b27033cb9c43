from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from casewright.llm.queries import URL_RULES
from casewright.llm.url_filter import Rule, build_cascade, host_and_path, judge_urls, key_hashes

URLS = [
    None,
    "",
    "no scheme",
    "http://COM",
    "http://com/",
    "https://Example.com/en/x?q=/fr/",
    "https://a.b.example.com/en/",
    "https://www.example.com/en/1#x",
    "https://deep.www.example.com/en/1",
    "https://www.example.com/EN/1",
    "https://notexample.com/en/x",
    "http://x.net/es/",
    "http://net/fr/a",
    "http://x.net/fr",
    "http://x.net?y=/fr/",
    "ftp://x.org/a://b.net/es/",
    "://net/es/",
    "http:///es/",
    "http://x.net\n/es/1",
    "http://..com/",
    "http://ÄB.com/",
    "http://" + "a." * 3000 + "net/es/" + "p" * 5000,
]


def brute(url, rules, unlisted="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else unlisted


def test_rules_against_brute_force(spark):
    many = [*URL_RULES, Rule("block", "b.example.com", "/en/"), Rule("allow", "org", "/a"), Rule("block", "x.net", "/"), Rule("allow", "notexample.com", "")]
    df = spark.createDataFrame([(n, u, "x") for n, u in enumerate([*URLS, *URLS])], "page_id long, url string, _host string")
    for rules in (URL_RULES, many):
        found = {r["page_id"]: r for r in judge_urls(df, rules).collect()}
        assert len(found) == 2 * len(URLS)
        for n, url in enumerate([*URLS, *URLS]):
            assert tuple(found[n][c] for c in ("host", "path", "rule", "verdict")) == brute(url, rules)
            assert found[n]["_host"] == "x"


def test_empty_table_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    assert one.columns + ["host", "path", "rule", "verdict"] == judge_urls(one, []).columns
    assert judge_urls(one, [], unlisted="block").first()["verdict"] == "block"


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"))
    hashes = universe.select("key", key_hashes(F.col("key")).alias("h")).select("key", "h.a", "h.b")
    for listed in (range(0, 20_000, 13), range(0), range(20_000), range(3)):
        cascade = build_cascade([f"host{n}" for n in listed], hashes.select("a", "b"))
        rows = hashes.toPandas()
        keys = np.stack([rows["a"].to_numpy(), rows["b"].to_numpy()], axis=1).view(np.uint64)
        found = set(rows["key"][cascade.holds(keys)])
        assert found == {f"host{n}" for n in listed}
    assert sum(len(level.bits) for level in build_cascade([f"host{n}" for n in range(0, 20_000, 13)], hashes.select("a", "b")).levels) < 16 * 1539


def test_host_and_path(spark):
    df = spark.createDataFrame([("HTTP://A.b/C?d",)], "url string").select(*host_and_path("url"))
    assert tuple(df.first()) == ("a.b", "/C")
