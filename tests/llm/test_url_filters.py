"""The posterior bound against sums of its density, simulated hosts, and odd urls and columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import url_filters as U


def plain_above(limit: float, a: float, b: float) -> float:
    x = (np.arange(400_000) + 0.5) / 400_000
    f = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return float(f[x > limit].sum() / f.sum())


def test_beta_distribution(spark):
    rows = [(0.1, 3.0, 20.0), (0.5, 3.0, 20.0), (0.142, 50.0, 300.0), (0.2, 50.0, 300.0), (0.01, 1.5, 90.0), (0.9, 400.0, 30.0), (0.3, 3000.0, 7000.0), (0.31, 3000.0, 7000.0)]
    got = spark.createDataFrame(rows, "x double, a double, b double").select("*", U.beta_above(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert abs(r.p - plain_above(r.x, r.a, r.b)) < 1e-4


def test_bad_hosts_are_blocked_and_good_ones_are_not(spark):
    """Of 200 hosts every tenth has a rate of 0.6, the others 0.1; with 30 labelled pages each."""
    rng = np.random.default_rng(4)
    rows = [(f"http://h{i}.site{i % 37}.{('com', 'net')[i % 2]}/p{j}", int(rng.random() < (0.6 if i % 10 == 0 else 0.1))) for i in range(200) for j in range(30)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = outcomes.select(F.monotonically_increasing_id().alias("page_id"), "url")
    got = U.judge(pages, outcomes, ()).groupBy("host").agg(F.max("verdict").alias("says"), F.first("rate").alias("rate"), F.first("above").alias("above")).collect()
    bad = [x for x in got if int(x.host[1:].split(".")[0]) % 10 == 0]
    assert sum(x.says == "block" for x in bad) >= 0.95 * len(bad)
    assert sum(x.says == "block" for x in got if x not in bad) <= 0.05 * len(got)


def test_a_host_is_judged_by_its_domain_before_it_has_outcomes(spark):
    rows = [(f"http://h{i}.{'bad' if i % 2 else 'good'}.com/", int(i % 2 == 1 and i % 20 != 1)) for i in range(400)]
    pages = spark.createDataFrame([(1, "http://new.bad.com/"), (2, "http://new.good.com/")], "page_id long, url string")
    got = {x.page_id: x for x in U.judge(pages, spark.createDataFrame(rows, "url string, bad int"), ()).collect()}
    assert got[1].rate > 0.5 > got[2].rate and got[2].verdict == "allow"


def test_odd_urls_columns_and_empty_tables(spark):
    long = "http://long.example.org/es/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "://"), (4, "http://A.b?x")], "page_id long, url string")
    for name in ("n", "bad", "rate", "low", "above", "rule", "verdict", "host", "path", "_host"):
        pages = pages.withColumn(name, F.lit("mine"))
    outcomes = spark.createDataFrame([("http://A.b/", 1)], "url string, bad int")
    got = U.judge(pages, outcomes, (("block", "example.org/es/"),))
    rows = got.collect()
    assert len(rows) == 5 and got.columns.count("bad") == 1 and {x.low for x in rows} == {"mine"}
    assert [x.verdict for x in rows if x.page_id == 1] == ["block", "block"] and {x.host for x in rows} == {"long.example.org", "", "a.b"}
    assert U.judge(pages.limit(0), outcomes, ()).count() == 0 and {x.verdict for x in U.judge(pages, outcomes.limit(0), ()).collect()} == {"allow"}


def test_levels_of_hosts(spark):
    """Ports, user names, closing dots, addresses, and suffixes of several labels."""
    want = {
        "www.a.co.uk": ("a.co.uk", "co.uk"), "a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "shop.example.com:8080": ("example.com", "com"), "u:p@x.example.com": ("example.com", "com"),
        "me.github.io": ("me.github.io", "github.io"), "example.com.": ("example.com", "com"), "example.com.:80": ("example.com", "com"), "10.0.0.1": ("10.0.0.1", U.ADDRESS), "10.0.0.1:443": ("10.0.0.1", U.ADDRESS),
        "[::1]:8080": ("[::1]", U.ADDRESS), "localhost": ("localhost", "localhost"), "": ("", ""), "1.2.3.4.example.com": ("example.com", "com"), "u@x.com": ("x.com", "com"),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = U.levels(F.col("host"))
    assert {r.host: (r.d, r.s) for r in rows.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want
    domain, suffix = U.levels(F.col("host"), ())
    assert {r.s for r in rows.where("host = 'a.co.uk'").select(suffix.alias("s")).collect()} == {"uk"}


def test_verdicts_by_hand(spark, smoke):
    """The posterior of every host of the query, by plain arithmetic over its levels, and the verdict of every page without a rule."""
    from lattica.llm import queries as Q

    pages = spark.read.parquet(f"{smoke}/pages.parquet").collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{smoke}/labels.parquet").collect()}
    host = {p.page_id: (p.url.split("://", 1)[1] if p.url and "://" in p.url else "").split("/")[0].split("?")[0].split("#")[0].lower() for p in pages}
    counts: dict = {}
    for p in pages:
        n, bad = counts.get(host[p.page_id], (0, 0))
        r = labels.get(p.page_id)
        if r is not None and (r.quality is not None or r.toxic is not None):
            n, bad = n + 1, bad + int((1 if r.quality is None else r.quality) == 0 or (r.toxic or 0) == 1)
        counts[host[p.page_id]] = n, bad
    every = (sum(b for _, b in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)

    def shrunk(units: dict, up) -> tuple[dict, float]:
        rho_top = sum((b - n * up(u)) ** 2 - n * up(u) * (1 - up(u)) for u, (n, b) in units.items() if n > 1 and 0 < up(u) < 1)
        rho_low = sum(n * (n - 1) * up(u) * (1 - up(u)) for u, (n, b) in units.items() if n > 1 and 0 < up(u) < 1)
        rho = rho_top / rho_low if rho_low else 0
        k = 1000.0 if rho <= 1 / 1001 else max(2.0, 1 / rho - 1)
        return {u: (b + k * up(u)) / (n + k) for u, (n, b) in units.items()}, k

    def grouped(of) -> dict:
        out: dict = {}
        for h, (n, b) in counts.items():
            m, c = out.get(of(h), (0, 0))
            out[of(h)] = m + n, c + b
        return out

    last = lambda k: lambda h: ".".join(h.split(".")[-k:])
    by_suffix, _ = shrunk(grouped(last(1)), lambda s: every)
    by_domain, _ = shrunk(grouped(last(2)), lambda d: by_suffix[last(1)(d)])
    _, k = shrunk(counts, lambda h: by_domain[last(2)(h)])
    for r in Q.op3_url_filters(spark, smoke).where("rule is null").collect():
        n, bad = counts[r.host]
        p = by_domain[last(2)(r.host)]
        above = plain_above(every, bad + k * p, n - bad + k * (1 - p))
        if abs(above - 0.95) > 1e-3:
            assert r.verdict == ("block" if above > 0.95 else "allow")
