"""The registered queries of :mod:`lattica.operators.variation`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moments as M
from ..operators import statistics as S
from ..operators import temporal as T
from ..operators import variation as V
from ..sources.tables import EVENT_STEPS, LINE_STEPS, table
from .models import EXPONENTS
from .panel import QUERIES, SQL, query, r, states_of, with_

#: Lengths of the wrapped windows, and numbers of edited nodes.
LENGTHS, SIZES = (10, 30, 60), (2, 4, 8)


@query(with_("pairs", then="""
, w AS (SELECT subject, step // 30 AS win, i, j, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) /
  nullif(sqrt(CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE)) * sqrt(CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE)), 0) AS fc FROM pairs GROUP BY ALL)
SELECT subject, i, j, round(var_samp(fc), 6) AS variance, round(max(fc) - min(fc), 6) AS span FROM w GROUP BY ALL"""))
def fc_over_scans(spark, sf_dir):
    scans = T.tumbling(states_of(spark, sf_dir), 30, EVENT_STEPS).withColumnRenamed("window", "scan")
    return V.over_scans(scans).select("subject", "i", "j", r("variance"), r("span"))


@query(with_("moments", then="SELECT subject, round(CAST(count_if(abs(product) > 0.3) AS DOUBLE) / count(*), 6) AS density FROM moments GROUP BY ALL"))
def graph_density(spark, sf_dir):
    return V.density(M.product_mean(states_of(spark, sf_dir)), ["subject"], "product", 0.3).select("subject", r("density"))


@query(f"""
WITH a AS (SELECT l_returnflag AS subject, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS run, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL)
SELECT s.subject, t.range AS run, a.total, a.total IS NULL AS missing
FROM (SELECT DISTINCT subject FROM a) s CROSS JOIN range({LINE_STEPS}) t LEFT JOIN a ON a.subject = s.subject AND a.run = t.range""")
def runs_with_gaps(spark, sf_dir):
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("subject"), month.cast("long").alias("run")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return V.with_gaps(rows, ["subject"], "run", 0, LINE_STEPS - 1)


@query(with_("states", then="""
, k AS (SELECT subject, node, state, row_number() OVER (PARTITION BY subject, node ORDER BY step) AS r FROM states),
s AS (SELECT subject, node, CAST(count_if(state = 1) AS BIGINT) AS n1, CAST(count_if(state = -1) AS BIGINT) AS n0, CAST(sum(CASE WHEN state = 1 THEN r END) AS DOUBLE) AS s FROM k GROUP BY ALL)
SELECT subject, node, n1, n0, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, round((s - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n0 / 2.0::DOUBLE) / nullif(sqrt(CAST(n1 AS DOUBLE) * n0 * (n1 + n0 + 1) / 12), 0), 5) AS z FROM s"""))
def time_trend(spark, sf_dir):
    return V.time_trend(states_of(spark, sf_dir)).select("subject", "node", "n1", "n0", "u", r("z", 5))


WRAPPED = " UNION ALL ".join(
    f"SELECT subject, node, step, CAST({n} AS BIGINT) AS length, sum(state) OVER (PARTITION BY subject, node ORDER BY step ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS s FROM d" for n in LENGTHS
)


@query(with_("states", then=f"""
, d AS (SELECT subject, node, step, state FROM states UNION ALL SELECT subject, node, step + {EVENT_STEPS}, state FROM states),
w AS ({WRAPPED}), m AS (SELECT subject, node, CAST(sum(state) AS DOUBLE) / count(*) AS m FROM states GROUP BY ALL),
e AS (SELECT subject, length, step, sqrt(avg((CAST(s AS DOUBLE) / length - m) * (CAST(s AS DOUBLE) / length - m))) AS e FROM w JOIN m USING (subject, node) WHERE step < {EVENT_STEPS} GROUP BY ALL)
SELECT subject, length, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS sd, round(min(e), 6) AS least, round(max(e), 6) AS greatest FROM e GROUP BY ALL"""))
def wrapped_windows(spark, sf_dir):
    found = V.wrapped_windows(states_of(spark, sf_dir), LENGTHS, EVENT_STEPS)
    return found.select("subject", "length", r("mean"), r("sd"), r("least"), r("greatest"))


@query(with_("states", then=f"""
, m AS (SELECT subject, node, CAST(sum(state) AS DOUBLE) / count(*) AS h FROM states GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(h) DESC, node) AS n FROM m),
e AS (SELECT k.*, CAST(s.s AS BIGINT) AS edited FROM k CROSS JOIN (SELECT unnest([{', '.join(map(str, SIZES))}]) AS s) s)
SELECT subject, edited, node, round(CASE WHEN n <= edited THEN avg(CASE WHEN n <= edited THEN h END) OVER (PARTITION BY subject, edited) ELSE h END, 6) AS h FROM e"""))
def homogenized_fields(spark, sf_dir):
    fields = M.state_mean(states_of(spark, sf_dir)).withColumnRenamed("mean", "h")
    return V.homogenized(fields, ["subject"], "node", "h", [F.abs("h").desc(), F.col("node")], SIZES).select("subject", "edited", "node", r("h"))


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n_customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS customer_cents FROM customer GROUP BY ALL),
s AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS supplier_cents FROM supplier GROUP BY ALL),
j AS (SELECT n_nationkey AS nation, n_name AS name, n_customers, customer_cents, n_suppliers, supplier_cents FROM nation JOIN c ON c.nation = n_nationkey JOIN s ON s.nation = n_nationkey)
SELECT *, row_number() OVER (ORDER BY customer_cents DESC, nation) AS customer_rank, row_number() OVER (ORDER BY supplier_cents DESC, nation) AS supplier_rank FROM j""")
def comparison_table(spark, sf_dir):
    def of(name: str, p: str, n: str, cents: str):
        total = F.sum(F.round(F.col(f"{p}_acctbal") * 100).cast("long"))
        return table(spark, sf_dir, name).groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(F.count("*").alias(n), total.alias(cents))

    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    rows = V.wide([names, of("customer", "c", "n_customers", "customer_cents"), of("supplier", "s", "n_suppliers", "supplier_cents")], ["nation"])
    # one row a nation
    place = lambda c: F.expr(f"CAST(row_number() OVER (ORDER BY {c} DESC, nation) AS BIGINT)")
    return rows.select("*", place("customer_cents").alias("customer_rank"), place("supplier_cents").alias("supplier_rank"))


@query()
def powerlaw_bootstrap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    counts = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.ceil(F.col("o_totalprice") / 20000).cast("long").alias("v")).agg(F.count("*").alias("n"))
    fits = S.power_law_grid(counts, ["priority"], "v", "n", 1, EXPONENTS, 200)
    sizes = counts.groupBy("priority").agg(F.sum("n").alias("n"))
    return V.power_law_bootstrap(fits.join(sizes, "priority"), ["priority"], "n", 1, 200, EXPONENTS, 100)


__all__ = ["QUERIES", "SQL"]
