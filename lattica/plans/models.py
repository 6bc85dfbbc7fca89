"""The registered queries of models, power laws and kernels.

Queries of seeded kernels have no SQL; tests hold them against exact results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binarize as B
from ..operators import models as P
from ..operators import moments as M
from ..operators import sampling as K
from ..operators import spectra as X
from ..operators import statistics as S
from ..operators import temporal as T
from ..sources.tables import event_panel, table
from .panel import QUERIES, SQL, query, r, states_of, with_

#: Nodes of the small exact model.
FEW_NODES = 8

PARTS = """
, hs AS (SELECT subject, node, CAST(sum(state) AS DOUBLE) / count(*) AS h FROM states GROUP BY ALL), ws AS (SELECT subject, i, j, product AS w FROM moments)
"""


def mean_model(spark, sf_dir):
    """States, and the model whose fields and couplings are the mean states and products."""
    states = states_of(spark, sf_dir)
    return states, P.mean_fields(M.state_mean(states)), P.mean_couplings(M.product_mean(states))


@query(with_("moments", then=PARTS + """
, a AS (SELECT subject, step, sum(h * state) AS h FROM states JOIN hs USING (subject, node) GROUP BY ALL), b AS (SELECT subject, step, sum(w * x * y) AS w FROM pairs JOIN ws USING (subject, i, j) GROUP BY ALL)
SELECT subject, step, round(h + w, 5) AS neg_energy FROM a JOIN b USING (subject, step)"""))
def neg_energy_series(spark, sf_dir):
    return P.negative_energy(*mean_model(spark, sf_dir)).select("subject", "step", r("neg_energy", 5))


LOCAL = PARTS + """
, bw AS (SELECT subject, i AS node, j AS other, w FROM ws UNION ALL SELECT subject, j, i, w FROM ws),
lf AS (SELECT s.subject, s.step, bw.node, sum(w * s.state) AS p FROM states s JOIN bw ON bw.subject = s.subject AND bw.other = s.node GROUP BY ALL),
loc AS (SELECT s.subject, s.step, s.node, s.state, h + p AS l FROM states s JOIN hs USING (subject, node) JOIN lf USING (subject, step, node))
"""


@query(with_("moments", then=LOCAL + "SELECT subject, step, node, round(-2 * state * l, 5) AS change FROM loc"))
def flip_change(spark, sf_dir):
    return P.flip_change(*mean_model(spark, sf_dir)).select("subject", "step", "node", r("change", 5))


@query(with_("moments", then=PARTS + "SELECT subject, i, j, round(sum(4 * w * x * y), 4) AS total FROM pairs JOIN ws USING (subject, i, j) GROUP BY ALL"))
def second_change(spark, sf_dir):
    states, _, couplings = mean_model(spark, sf_dir)
    return P.second_change(states, couplings).groupBy("subject", "i", "j").agg(F.sum("change").alias("total")).select("subject", "i", "j", r("total", 4))


@query(with_("moments", then=LOCAL + """
, e AS (SELECT *, state - tanh(l) AS e FROM loc)
SELECT subject AS model, node AS i, node AS j, round(any_value(h) + 0.1 * avg(e), 5) AS value FROM e JOIN hs USING (subject, node) GROUP BY ALL
UNION ALL SELECT a.subject, a.node, b.node, round(any_value(w) + 0.1 * avg(a.e * b.state + b.e * a.state), 5)
FROM e a JOIN e b ON a.subject = b.subject AND a.step = b.step AND a.node < b.node JOIN ws ON ws.subject = a.subject AND ws.i = a.node AND ws.j = b.node GROUP BY ALL"""))
def pl_update(spark, sf_dir):
    """One step of pseudolikelihood from the mean model: fields (i = j) and couplings."""
    h, w = P.pseudolikelihood_step(*mean_model(spark, sf_dir), rate=0.1)
    rows = h.select("model", F.col("node").alias("i"), F.col("node").alias("j"), F.col("h").alias("value")).unionByName(w.select("model", "i", "j", F.col("w").alias("value")))
    return rows.select("model", "i", "j", r("value", 5))


ENUM = PARTS + f"""
, c AS (SELECT m.subject AS model, g.range AS code FROM (SELECT DISTINCT subject FROM hs) m CROSS JOIN range({2**FEW_NODES}) g),
a AS (SELECT model, code, sum(h * CASE WHEN (code >> CAST(node AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END) AS h FROM c JOIN hs ON hs.subject = model AND node < {FEW_NODES} GROUP BY ALL),
b AS (SELECT model, code, sum(w * CASE WHEN (code >> CAST(i AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END * CASE WHEN (code >> CAST(j AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM c JOIN ws ON ws.subject = model AND j < {FEW_NODES} GROUP BY ALL),
x AS (SELECT model, code, exp(h + w) AS x FROM a JOIN b USING (model, code)), pr AS (SELECT model, code, x / sum(x) OVER (PARTITION BY model) AS p FROM x)
"""


def small_model(spark, sf_dir):
    _, fields, couplings = mean_model(spark, sf_dir)
    return fields.where(F.col("node") < FEW_NODES), couplings.where(F.col("j") < FEW_NODES)


@query(with_("moments", then=ENUM + "SELECT model, code, round(p, 8) AS p FROM pr"))
def exact_enumeration(spark, sf_dir):
    return P.enumerate_states(*small_model(spark, sf_dir), FEW_NODES).select("model", "code", r("p", 8))


@query(with_("moments", then=ENUM + f"""
SELECT model, i.range AS i, j.range AS j, round(sum(p * CASE WHEN (code >> CAST(i.range AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END * CASE WHEN i.range = j.range THEN 1 WHEN (code >> CAST(j.range AS INTEGER)) & 1 = 1 THEN 1 ELSE -1 END), 6) AS value
FROM pr CROSS JOIN range({FEW_NODES}) i JOIN range({FEW_NODES}) j ON i.range <= j.range GROUP BY ALL"""))
def expected_observables(spark, sf_dir):
    return P.expected(P.enumerate_states(*small_model(spark, sf_dir), FEW_NODES), FEW_NODES).select("model", "i", "j", r("value"))


@query(with_("states", then="""
, m AS (SELECT subject, node, CAST(sum(state) AS DOUBLE) / count(*) AS m FROM states GROUP BY ALL)
SELECT subject AS model, node, round(CASE WHEN abs(m) < 1 THEN ln((1 + m) / (1 - m)) / 2 END, 5) AS h FROM m"""))
def independent_model(spark, sf_dir):
    return P.independent_model(M.state_mean(states_of(spark, sf_dir))).select("model", "node", r("h", 5))


@query(with_("states", then="""
, ks AS (SELECT subject, step, string_agg(CASE WHEN state = 1 THEN '+' ELSE '-' END, '' ORDER BY node) AS key FROM states GROUP BY ALL), u AS (SELECT subject, key, count(*) AS n FROM ks GROUP BY ALL),
x AS (SELECT subject, node.range AS node, ln(n) AS l, substr(key, CAST(node.range AS INTEGER) + 1, 1) AS c FROM u CROSS JOIN range(16) node)
SELECT subject, node, round((avg(CASE WHEN c = '+' THEN l END) - avg(CASE WHEN c = '-' THEN l END)) / 2, 5) AS h FROM x GROUP BY ALL"""))
def state_log_estimate(spark, sf_dir):
    return P.from_state_counts(T.unique_states(states_of(spark, sf_dir))).select("subject", "node", r("h", 5))


@query("""
WITH c AS (SELECT l_returnflag AS flag, l_linenumber AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT flag, v, n / sum(n) OVER (PARTITION BY flag) AS p FROM c), g AS (SELECT v, avg(p) AS q FROM s GROUP BY ALL)
SELECT flag, round(sum(p * ln(p / q)), 8) AS kl, round(avg((p - q) * (p - q)), 8) AS mse, round(max(abs(p - q)), 8) AS greatest, round(min(abs(p - q)), 8) AS least FROM s JOIN g USING (v) GROUP BY ALL""")
def kl_divergence(spark, sf_dir):
    """Distribution of line numbers of each flag against the mean one."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("subject"), F.col("l_linenumber").alias("v")).agg(F.count("*").alias("n"))
    p = P.shares(counts)
    rows = p.join(p.groupBy("v").agg(F.avg("p").alias("q")), "v").withColumnRenamed("subject", "flag")
    return S.divergence(rows, ["flag"], "p", "q").select("flag", r("kl", 8), r("mse", 8), r("greatest", 8), r("least", 8))


EXPONENTS = [1.2 + 0.1 * k for k in range(24)]


@query("""
WITH c AS (SELECT o_orderpriority AS pr, CAST(ceil(o_totalprice / 20000) AS BIGINT) AS v, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY ALL),
s AS (SELECT pr, sum(n) AS n, sum(n * ln(v)) AS l FROM c GROUP BY ALL), g AS (SELECT 1.2::DOUBLE + 0.1::DOUBLE * range AS a FROM range(24)),
z AS (SELECT a, (SELECT sum(k.range ** (-a)) FROM range(1, 201) k) + 201.0::DOUBLE ** (1 - a) / (a - 1) + 201.0::DOUBLE ** (-a) / 2 + a * 201.0::DOUBLE ** (-a - 1) / 12 AS z FROM g),
t AS (SELECT pr, a, z, n, -n * ln(z) - a * l AS k FROM s CROSS JOIN z), b AS (SELECT pr, arg_max(struct_pack(a := a, z := z, n := n, k := k), struct_pack(k := round(k, 6), o := -a)) AS b FROM t GROUP BY ALL),
q AS (SELECT c.pr, c.v, b.b.a AS a, b.b.z AS z, b.b.n AS n, b.b.k AS k, sum(c.n) OVER (PARTITION BY c.pr ORDER BY c.v) AS cum FROM c JOIN b ON b.pr = c.pr),
f AS (SELECT *, 1 - ((SELECT sum(x.range ** (-a)) FROM range(1, 500) x WHERE x.range BETWEEN v + 1 AND v + 200) + (v + 201.0::DOUBLE) ** (1 - a) / (a - 1) + (v + 201.0::DOUBLE) ** (-a) / 2 + a * (v + 201.0::DOUBLE) ** (-a - 1) / 12) / z AS cdf FROM q)
SELECT pr AS priority, round(any_value(a), 4) AS exponent, round(any_value(k), 3) AS likelihood, round(max(abs(CAST(cum AS DOUBLE) / n - cdf)), 5) AS ks FROM f GROUP BY ALL""")
def powerlaw_grid_mle(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    counts = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.ceil(F.col("o_totalprice") / 20000).cast("long").alias("v")).agg(F.count("*").alias("n"))
    return S.power_law_grid(counts, ["priority"], "v", "n", 1, EXPONENTS, 200).select("priority", r("exponent", 4), r("likelihood", 3), r("ks", 5))


# --- kernels


def assembled(spark, sf_dir):
    _, fields, couplings = mean_model(spark, sf_dir)
    return K.assemble(fields.withColumn("h", F.col("h") / 10), couplings.withColumn("w", F.col("w") / 10))


def targets_of(states):
    """Mean states and the full matrix of mean products of each subject, as arrays."""
    square = B.mirrored(M.product_mean(states), ["subject"], "product", 1.0)
    ordered = lambda v, *keys: F.transform(F.sort_array(F.collect_list(F.struct(*keys, v))), lambda x: x[v])
    m = M.state_mean(states).groupBy("subject").agg(ordered("mean", "node").alias("m"))
    p = square.groupBy("subject").agg(ordered("product", "i", "j").alias("p"))
    return m.join(p, "subject").withColumnRenamed("subject", "model")


@query()
def metropolis_means(spark, sf_dir):
    return K.simulated_means(assembled(spark, sf_dir), 200)


@query()
def simulated_avalanches(spark, sf_dir):
    """Runs of activity in simulated series: the sampler and the panel operators together."""
    series = K.simulated_series(assembled(spark, sf_dir), 200).drop("beta")
    return T.runs(T.activations(series), censored=True)


@query()
def fit_boltzmann(spark, sf_dir):
    return K.fit_by_simulation(assembled(spark, sf_dir), targets_of(states_of(spark, sf_dir)), 40, 20, 0.05)



@query(with_("panel", then="""
, s AS (SELECT subject, node, f.range AS f, sum(value * cos(2 * pi() * f.range * step / 120)) AS a, sum(value * sin(2 * pi() * f.range * step / 120)) AS b FROM panel CROSS JOIN range(61) f GROUP BY ALL)
SELECT subject, node, round(f / 30.0::DOUBLE, 6) AS frequency, round((a * a + b * b) * 0.25 / 120 * CASE WHEN f BETWEEN 1 AND 59 THEN 2 ELSE 1 END / 1e6, 4) AS power FROM s"""))
def power_spectrum(spark, sf_dir):
    """Power of the values in units of a million."""
    out = K.power_spectrum(event_panel(spark, sf_dir), 0.25)
    return out.select("subject", "node", r("frequency"), F.round(F.col("power") / 1e6, 4).alias("power"))


@query()
def phase_surrogate(spark, sf_dir):
    return X.phase_surrogate(event_panel(spark, sf_dir))



@query()
def precision_matrix(spark, sf_dir):
    cov = M.pair_moments(states_of(spark, sf_dir)).select("subject", "i", "j", "cov", "sd_i", "sd_j")
    nodes = cov.select("subject", F.explode(F.array(F.struct(F.col("i").alias("n"), F.col("sd_i").alias("s")), F.struct(F.col("j").alias("n"), F.col("sd_j").alias("s")))).alias("x")).select("subject", "x.*").distinct()
    off = cov.select("subject", "i", "j", "cov").unionByName(cov.select("subject", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    square = off.unionByName(nodes.groupBy("subject", "n").agg(F.max("s").alias("s")).select("subject", F.col("n").alias("i"), F.col("n").alias("j"), (F.col("s") * F.col("s")).alias("cov")))
    return K.inverse(square, "cov")


@query()
def eigenvectors(spark, sf_dir):
    return K.eigen(B.mirrored(M.product_mean(states_of(spark, sf_dir)), ["subject"], "product", 1.0), "product")



@query()
def clusters(spark, sf_dir):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return KMeans(k=10, seed=1, featuresCol="v").fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


__all__ = ["QUERIES", "SQL"]
