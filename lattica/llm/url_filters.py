"""URL filters: host and path rules, and empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted for each host, registered
domain and suffix.  A suffix's rate of bad pages is shrunk towards the rate of
all pages, a domain's towards its suffix's, a host's towards its domain's, each
through a beta-binomial prior whose strength is estimated from the counts (by
moments) at that level.  A host is blocked if its posterior, a beta distribution,
puts its rate above a limit with at least the probability ``sure``; that is, if
even the lower bound of its rate is above the limit, which is the rate of
all pages unless named.  Only built-in functions are used; the beta distribution
function is a continued fraction.

For the levels a host is taken without user name, port and closing dots.  The
suffix is its longest ending among ``suffixes`` (``SUFFIXES`` unless others are
named), otherwise its last label; the registered domain has one label more.  A
host that is a suffix itself is its own domain.  An address (four numbers, or in
brackets) is its own domain, and all addresses share the suffix ``(address)``.
A null url, or one without ``://``,
has an empty host and path, fits no rule and is judged by the empty host's
outcomes.  Urls of any length are read whole.  Null outcomes are not counted.  Repeated rows are judged alike, and
each counts as an outcome.  A host without outcomes has its domain's rate, and
so on; without any outcomes at all every page is allowed.  Tables without rows
give none.  Columns named as those that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, small

# Public suffixes of more than one label, under which anyone may register or get a name.
SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "net.uk", "ltd.uk", "plc.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "go.kr", "ac.kr",
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.tw", "org.tw", "edu.tw", "com.hk", "org.hk", "edu.hk", "com.sg", "edu.sg", "com.my", "co.th", "ac.th", "co.id", "ac.id", "or.id", "com.ph", "com.vn",
    "co.in", "net.in", "org.in", "ac.in", "gov.in", "com.pk", "com.bd", "com.np",
    "com.br", "net.br", "org.br", "gov.br", "edu.br", "com.ar", "gob.ar", "com.mx", "org.mx", "gob.mx", "com.co", "com.pe", "com.ve", "com.ec", "com.uy",
    "co.za", "org.za", "ac.za", "co.ke", "com.ng", "com.eg", "com.gh",
    "com.tr", "org.tr", "gov.tr", "edu.tr", "co.il", "org.il", "ac.il", "com.sa", "com.ua", "com.ru", "com.pl", "net.pl", "org.pl", "com.es", "com.pt", "com.gr", "co.at", "or.at", "ac.at", "gv.at", "asso.fr", "gouv.fr",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "appspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "azurewebsites.net", "cloudfront.net",
)
ADDRESS = "(address)"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, SPLIT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_columns(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.

    ``rules`` holds (verdict, ``host/path``); it is a short list that goes into
    the plan as one conditional, longest rule first.
    """
    rule, verdict = None, None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(:[^:\]]*|\.+)+$", "")
    address = F.rlike(bare, F.lit(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\]?)$"))
    parts = F.split(bare, r"\.")
    known = F.array(*[F.lit(s) for s in suffixes]) if suffixes else F.array().cast("array<string>")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.least(n, k)), ".")
    longest = max((s.count(".") + 1 for s in suffixes), default=1)
    labels = F.lit(1)
    for k in range(2, longest + 1):
        labels = F.when((n >= k) & F.array_contains(known, last(F.lit(k))), k).otherwise(labels)
    suffix = F.when(address, ADDRESS).otherwise(last(labels))
    return F.when(address, bare).otherwise(last(labels + 1)), suffix


def _strength(counts: DataFrame, prior: str, low: float = 2.0, high: float = 1000.0) -> float:
    """Prior strength of a level, by moments, from each unit's n, bad and prior mean; one number."""
    p = F.col(prior)
    got = counts.where((F.col("n") > 1) & (p > 0) & (p < 1)).agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) - F.col("n") * p * (1 - p)).alias("extra"),
        F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("scale"),
    ).first()
    if not got or not got.scale:
        return high
    rho = got.extra / got.scale  # the correlation between outcomes of one unit
    return high if rho <= 1 / (high + 1) else max(low, 1 / rho - 1)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which stands in the expression and is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, then down again."""
    y = x + 7
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6))


def beta_above(limit: Column, a: Column, b: Column) -> Column:
    """Probability that a Beta(a, b) variable exceeds ``limit``, strictly between 0 and 1; a and b positive.

    Lentz's continued fraction on the side where it converges, within some
    multiple of the root of the larger parameter.
    """
    upper = limit < (a + 1) / (a + b + 2)  # the fraction gives the part below the limit
    given = F.struct(F.when(upper, a).otherwise(b).alias("a"), F.when(upper, b).otherwise(a).alias("b"), F.when(upper, limit).otherwise(1 - limit).alias("x"), upper.alias("upper"))

    def fraction(g: Column) -> Column:
        a, b, x = g["a"], g["b"], g["x"]
        first = 1 / (1 - (a + b) * x / (a + 1))
        begin = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

        def half(acc: Column, term: Column) -> Column:
            return _let(F.struct(acc["h"].alias("h"), (1 + term / acc["c"]).alias("c"), (1 / (1 + term * acc["d"])).alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["h"] * n["c"] * n["d"]).alias("h")))

        def step(acc: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
            return half(half(acc, even), odd)

        terms = F.sequence(F.lit(1), (F.ceil(4 * F.sqrt(F.greatest(a, b))) + 40).cast("int"))
        h = F.aggregate(F.transform(terms, lambda m: m.cast("double")), begin, step, lambda acc: acc["h"])
        part = F.exp(a * F.log(x) + b * F.log(1 - x) + _ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b)) * h / a
        return F.when(g["upper"], 1 - part).otherwise(part)

    return _let(given, fraction)


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, limit: float | None = None) -> DataFrame:
    """One row for each host of ``pages(host)`` or ``outcomes(host, bad)``.

    Columns: host, n, bad, rate (posterior mean) and above (the posterior
    probability that the rate exceeds ``limit``, by default that of all pages).
    """
    both = outcomes.where("bad is not null").select("host", F.lit(1).alias("n"), F.col("bad").cast("long").alias("bad"))
    seen = pages.select("host", F.lit(0).alias("n"), F.lit(0).cast("long").alias("bad"))
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = cut(both.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("domain", domain).withColumn("suffix", suffix))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n:
        return hosts.select("host", "n", "bad", F.lit(0.0).alias("rate"), F.lit(0.0).alias("above"))
    every = (float(total.bad) + 0.5) / (float(total.n) + 1)
    by_suffix = cut(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("up", F.lit(every)))
    k = _strength(by_suffix, "up")
    by_suffix = by_suffix.withColumn("suffix_rate", (F.col("bad") + k * F.col("up")) / (F.col("n") + k)).select("suffix", "suffix_rate")
    by_domain = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(small(cut(by_suffix)), "suffix"))
    k = _strength(by_domain, "suffix_rate")
    by_domain = by_domain.withColumn("domain_rate", (F.col("bad") + k * F.col("suffix_rate")) / (F.col("n") + k)).select("domain", "domain_rate")
    hosts = cut(hosts.join(small(cut(by_domain)), "domain"))
    k = _strength(hosts, "domain_rate")
    a, b = F.col("bad") + k * F.col("domain_rate"), F.col("n") - F.col("bad") + k * (1 - F.col("domain_rate"))
    above = beta_above(F.lit(every if limit is None else float(limit)), F.col("_a"), F.col("_b"))
    return hosts.select("host", "n", "bad", a.alias("_a"), b.alias("_b")).select("host", "n", "bad", (F.col("_a") / (F.col("_a") + F.col("_b"))).alias("rate"), above.alias("above"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], sure: float = 0.95, suffixes: Sequence[str] = SUFFIXES, limit: float | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's n, bad, rate and above.

    ``outcomes`` holds (url, bad).  A fitting rule decides; the host's
    reputation decides for the others.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "n", "bad", "rate", "above", "_host")
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    outcomes = outcomes.select(host_of(F.col("url")).alias("host"), "bad")
    known = small(cut(reputation(pages, outcomes, suffixes, limit).withColumnRenamed("host", "_host")))
    rule, says = rule_columns(rules, F.col("host"), F.col("path"))
    out = pages.join(known, F.col("host") == F.col("_host"), "left").drop("_host")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(says, F.when(F.col("above") >= sure, "block").otherwise("allow")))
