"""The registered queries of selections, grids, correlation families, linear models and fits.

``study`` holds a feature (mean and spread of the values) and a parameter (the
mean state) of each subject and node of the event panel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binarize as B
from ..operators import cluster as C
from ..operators import fitting as Fit
from ..operators import inference as I
from ..operators import moments as M
from ..operators import networks as N
from ..operators import permutation as Perm
from ..operators import pooled as Pool
from ..operators import relate as R
from ..operators import sampling as K
from ..operators import spectra as X
from ..operators import subspace as Sub
from ..operators import temporal as T
from ..operators.blocked import pair_sums
from ..sources.tables import embedding_features, event_panel, table
from .models import assembled, targets_of
from .panel import CTE, NEEDS, QUERIES, SQL, query, r, states_of, with_

CTE["study"] = """study AS (SELECT p.subject, p.node, avg(CAST(value AS DOUBLE)) AS x, stddev_samp(value) AS x2, avg(CAST(state AS DOUBLE)) AS y FROM panel p JOIN states s USING (subject, node, step) GROUP BY ALL)"""
NEEDS["study"] = ("states",)
PERMUTATIONS, ALPHA = 200, 0.05
CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def study_of(spark, sf_dir):
    panel = B.by_mean(event_panel(spark, sf_dir))
    v = F.col("value").cast("double")
    return panel.groupBy("subject", "node").agg(F.avg(v).alias("x"), F.stddev_samp(v).alias("x2"), F.avg(F.col("state").cast("double")).alias("y"))


# --- selections, views and look-ups


@query(with_("panel", then="SELECT subject, node, step, value FROM panel WHERE node IN (1, 3, 5) AND step >= 20 AND step < 60"))
def selected_panel(spark, sf_dir):
    """A range of steps and a subset of nodes; both filters stand below the grid's join."""
    return event_panel(spark, sf_dir).where("node in (1, 3, 5) and step >= 20 and step < 60")


@query("""
WITH l AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS place FROM customer WHERE c_custkey % 7 = 0)
SELECT place, o_orderkey AS order_id, o_custkey AS id FROM orders JOIN l ON l.id = o_custkey""")
def reindexed(spark, sf_dir):
    """Orders of the customers of a list, by their place in it."""
    ids = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("perm"))
    listed = R.ranked_by_digest(ids.withColumn("_o", F.md5(F.col("id").cast("string").cast("binary"))), "perm", "_o", "id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("id"))
    return orders.join(listed.select("id", (F.col("rank") - 1).alias("place")), "id").select("place", "order_id", "id")


@query(with_("states", then="""
, k AS (SELECT subject, step, string_agg(CASE WHEN state = 1 THEN '+' ELSE '-' END, '' ORDER BY node) AS key FROM states GROUP BY ALL),
d AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS code FROM (SELECT DISTINCT key FROM k WHERE step < 40))
SELECT subject, code, count(*) AS n FROM k JOIN d USING (key) GROUP BY ALL"""))
def state_lookup(spark, sf_dir):
    """How often each subject visits the states of a dictionary, those of all nodes seen in the first 40 steps."""
    states = states_of(spark, sf_dir)
    keyed = states.groupBy("subject", "step").agg(F.array_sort(F.collect_list(F.struct("node", "state"))).alias("s"))
    keyed = keyed.select("subject", "step", F.array_join(F.transform("s", lambda x: F.when(x["state"] == 1, "+").otherwise("-")), "").alias("key"))
    known = keyed.where("step < 40").select("key").distinct()
    known = known.select("key", F.expr("CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT)").alias("code"))
    return keyed.join(known, "key").groupBy("subject", "code").agg(F.count("*").alias("n"))


@query(with_("fc", then="SELECT subject, i, j, round(fc, 6) AS fc, row_number() OVER (PARTITION BY subject ORDER BY round(fc, 6) DESC, i, j) AS place FROM fc WHERE fc IS NOT NULL"))
def sorted_results(spark, sf_dir):
    """Each subject's pairs with their place in the order of connectivity."""
    fc = M.functional_connectivity(states_of(spark, sf_dir)).where("fc is not null").select("subject", "i", "j", r("fc"))
    return fc.withColumn("place", F.expr("CAST(row_number() OVER (PARTITION BY subject ORDER BY fc DESC, i, j) AS BIGINT)"))


@query("""
WITH c AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINES' ELSE c_mktsegment END AS segment, c_acctbal FROM customer)
SELECT segment, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM c GROUP BY ALL""")
def cleaned_labels(spark, sf_dir):
    rows = B.relabelled(table(spark, sf_dir, "customer"), "c_mktsegment", {"MACHINERY": "MACHINES"})
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query(with_("study", then="SELECT subject, node, round(x, 5) AS x, round(x2, 5) AS x2, round(x * x2, 3) AS x_x2, 1.0::DOUBLE AS one FROM study"))
def augmented_features(spark, sf_dir):
    """Features with a product of two of them and the intercept's column."""
    return B.augmented(study_of(spark, sf_dir), ["x", "x2"]).select("subject", "node", r("x", 5), r("x2", 5), r("x_x2", 3), "one")


@query(with_("study", then="""
, m AS (SELECT subject, node, abs(y) AS size, 0.5 * y AS scaled, log10(x + 1 - min(x) OVER (PARTITION BY subject)) AS shifted FROM study)
SELECT subject, node, round(size, 6) AS size, round(scaled, 6) AS scaled, round(shifted, 6) AS shifted FROM m"""))
def parameter_views(spark, sf_dir):
    """Absolute and scaled parameters, and the logarithm of a feature moved to 1 and up."""
    rows = B.views(study_of(spark, sf_dir), ["subject"], "y", 0.5, "x")
    return rows.select("subject", "node", r("size"), r("scaled"), r("shifted"))


@query(with_("panel", then="""
, m AS (SELECT subject, node, quantile_disc(value, 0.5) AS m FROM panel GROUP BY ALL)
SELECT subject, node, step, CASE WHEN value > m THEN 1 WHEN value < m THEN -1 ELSE 1 END AS filled_up, CASE WHEN value > m THEN 1 WHEN value < m THEN -1 ELSE 0 END AS kept_zero, CASE WHEN value > 500 THEN 1 WHEN value < 500 THEN -1 ELSE -1 END AS fixed
FROM panel JOIN m USING (subject, node)"""))
def binarize_mode(spark, sf_dir):
    """States by median or a fixed threshold, with ties filled by 1, 0 or -1."""
    panel = event_panel(spark, sf_dir)
    up = B.by_mode(panel, "median", 1).withColumnRenamed("state", "filled_up")
    zero = B.by_mode(up, "median", 0).withColumnRenamed("state", "kept_zero")
    return B.by_mode(zero, 500.0, -1).select("subject", "node", "step", "filled_up", "kept_zero", F.col("state").alias("fixed"))


@query(with_("panel", then="""
, b AS (SELECT subject, node, step, CASE WHEN value > avg(value) OVER w + 0.5 * stddev_samp(value) OVER w THEN 1 ELSE -1 END AS s FROM panel WINDOW w AS (PARTITION BY subject, node)),
q AS (SELECT subject, a.node AS i, b.node AS j, avg(CAST(a.s * b.s AS DOUBLE)) AS p, avg(CAST(a.s AS DOUBLE)) AS m FROM b a JOIN b USING (subject, step) WHERE a.node <= b.node GROUP BY ALL)
SELECT i, j, round(avg(CASE WHEN i = j THEN m ELSE p END), 6) AS value FROM q GROUP BY ALL"""))
def strict_group_moments(spark, sf_dir):
    """Mean states (i = j) and products over subjects of states strictly above mean + z sd."""
    states = B.by_score(event_panel(spark, sf_dir), 0.5, inclusive=False).drop("value")
    return M.group_moments(states).select("i", "j", r("value"))


@query(with_("fc", then="""
, h AS (SELECT subject, i, j, CAST(sum(x * y) AS DOUBLE) / count(*) AS p FROM pairs WHERE step < 60 GROUP BY ALL),
g AS (SELECT subject, sqrt(avg((h.p - m.product) * (h.p - m.product))) AS rmse FROM h JOIN moments m USING (subject, i, j) GROUP BY ALL)
SELECT subject, i, j, round(fc, 6) AS fc FROM fc JOIN g USING (subject) WHERE rmse < 0.09"""))
def accepted_models(spark, sf_dir):
    """Connectivity of the subjects whose half series tells their products to within 0.09."""
    states = states_of(spark, sf_dir)
    half = M.product_mean(states.where("step < 60")).withColumnRenamed("product", "half")
    error = M.product_mean(states).join(half, ["subject", "i", "j"]).groupBy("subject").agg(M.rmse(F.col("half"), F.col("product")).alias("rmse"))
    return B.accepted(M.functional_connectivity(states), error, ["subject"], "rmse", 0.09).select("subject", "i", "j", r("fc"))


# --- grids, categories and sources


@query(with_("study", then="""
, z AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS z),
g AS (SELECT p.subject, p.node, z.z, avg(CASE WHEN p.value >= m.m + z.z * m.s THEN 1.0 ELSE -1.0 END::DOUBLE) AS y FROM panel p JOIN (SELECT subject, node, avg(value) AS m, stddev_samp(value) AS s FROM panel GROUP BY ALL) m USING (subject, node) CROSS JOIN z GROUP BY ALL)
SELECT subject, z AS threshold, round(""" + CORR.format(a="x2", b="g.y") + """, 5) AS corr FROM g JOIN study USING (subject, node) GROUP BY ALL"""))
def threshold_grid(spark, sf_dir):
    """Correlation over nodes of a feature with the mean state at each threshold of a grid."""
    grid = B.over_thresholds(event_panel(spark, sf_dir), [0.0, 0.5, 1.0])
    means = grid.groupBy("subject", "node", "threshold").agg(F.avg(F.col("state").cast("double")).alias("y"))
    rows = means.join(study_of(spark, sf_dir).select("subject", "node", "x2"), ["subject", "node"])
    return rows.groupBy("subject", "threshold").agg(M.correlation(F.col("x2"), F.col("y")).alias("corr")).select("subject", "threshold", r("corr", 5))


@query(with_("study", then="""
, a AS (SELECT node, unnest(CASE WHEN node % 4 < 2 THEN ['front', 'all'] ELSE ['back', 'all'] END) AS area FROM (SELECT DISTINCT node FROM study))
SELECT area, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd FROM study JOIN a USING (node) GROUP BY ALL"""))
def category_sets(spark, sf_dir):
    """Parameters by sets of categories that overlap, from a mapping of categories to sets."""
    sets = {0: ("front", "all"), 1: ("front", "all"), 2: ("back", "all"), 3: ("back", "all")}
    rows = M.in_sets(study_of(spark, sf_dir), F.col("node") % 4, sets, "area")
    return rows.groupBy("area").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd")).select("area", "n", r("mean"), r("sd"))


@query(with_("study", then="SELECT node, round(avg(x), 5) AS x_mean, round(stddev_samp(x), 5) AS x_sd, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_sd FROM study GROUP BY ALL"))
def study_mean_sd(spark, sf_dir):
    out = I.by_mean_over(study_of(spark, sf_dir), "subject", ["node"], ["x", "y"])
    return out.select("node", r("x_mean", 5), r("x_sd", 5), r("y_mean"), r("y_sd"))


HALF = """
, c AS (SELECT 'whole' AS source, * FROM pairs UNION ALL SELECT CASE WHEN step < 60 THEN 'first' ELSE 'second' END, * FROM pairs),
f AS (SELECT source, subject, i, j, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS fc FROM c GROUP BY ALL)
"""


@query(with_("pairs", then=HALF + "SELECT source, i, j, round(avg(fc), 5) AS mean, round(stddev_samp(fc), 5) AS sd FROM f GROUP BY ALL"))
def fc_sources(spark, sf_dir):
    """Mean and spread over subjects of connectivity from three sources."""
    states = states_of(spark, sf_dir)
    half = states.withColumn("source", F.when(F.col("step") < 60, "first").otherwise("second"))
    fc = M.functional_connectivity(half.unionByName(states.withColumn("source", F.lit("whole"))), keys=("source", "subject"))
    return fc.groupBy("source", "i", "j").agg(F.avg("fc").alias("mean"), F.stddev_samp("fc").alias("sd")).select("source", "i", "j", r("mean", 5), r("sd", 5))


@query(with_("states", then="""
SELECT subject, a.node AS i, b.node AS j, round(covar_pop(a.state, b.state), 6) AS information FROM states a JOIN states b USING (subject, step) WHERE a.node <= b.node GROUP BY ALL"""))
def fisher_fields(spark, sf_dir):
    """The block of the fields alone: the covariance of the nodes' states, diagonal included."""
    return M.fisher_fields(states_of(spark, sf_dir)).select("subject", "i", "j", r("information"))


@query(with_("emb", then="SELECT a.label AS subject, a.feature AS i, b.feature AS j, round(" + CORR.format(a="a.value", b="b.value") + ", 6) AS fc FROM emb a JOIN emb b USING (vec_id) WHERE a.feature < b.feature GROUP BY ALL"))
def fc_embeddings(spark, sf_dir):
    """Correlation of the embeddings' components within each label: a panel whose steps grow with the table."""
    rows = embedding_features(spark, sf_dir).select(F.col("label").alias("subject"), F.col("feature").alias("node"), F.col("vec_id").alias("step"), "value")
    return M.functional_connectivity(rows, "value").select("subject", "i", "j", r("fc"))


def _leading_sql(c: int, squarings: int = 13) -> str:
    """The leading eigenvalue of f{c} by repeated squaring, and f{c + 1} without it."""
    out = f", t{c} AS (SELECT subject, sum(x) AS t FROM f{c} WHERE a = b GROUP BY ALL), q{c}_0 AS (SELECT subject, a, b, x / t AS x FROM f{c} JOIN t{c} USING (subject))"
    for k in range(squarings):
        out += f""", p{c}_{k} AS MATERIALIZED (SELECT l.subject, l.a, r.b, sum(l.x * r.x) AS x FROM q{c}_{k} l JOIN q{c}_{k} r ON l.subject = r.subject AND l.b = r.a GROUP BY ALL),
q{c}_{k + 1} AS MATERIALIZED (SELECT p.subject, a, b, x / t AS x FROM p{c}_{k} p JOIN (SELECT subject, sum(x) AS t FROM p{c}_{k} WHERE a = b GROUP BY ALL) USING (subject))"""
    return out + f""", e{c} AS (SELECT f.subject, sum(f.x * q.x) AS v FROM f{c} f JOIN q{c}_{squarings} q ON q.subject = f.subject AND q.a = f.b AND q.b = f.a GROUP BY ALL),
f{c + 1} AS (SELECT f.subject, f.a, f.b, f.x - v * q.x AS x FROM f{c} f JOIN q{c}_{squarings} q USING (subject, a, b) JOIN e{c} USING (subject))"""


@query(with_("states", then="""
, o AS (SELECT a.subject, a.step, a.node * 100 + b.node AS a, CASE WHEN a.node = b.node THEN a.state ELSE a.state * b.state END AS x FROM states a JOIN states b ON a.subject = b.subject AND a.step = b.step AND a.node <= b.node),
f0 AS (SELECT l.subject, l.a, r.a AS b, covar_pop(l.x, r.x) AS x FROM o l JOIN o r USING (subject, step) GROUP BY ALL)""" + _leading_sql(0) + _leading_sql(1) + """
SELECT subject, 0 AS component, round(v, 3) AS eigenvalue, round(v / t, 4) AS share FROM e0 JOIN t0 USING (subject) UNION ALL SELECT subject, 1, round(v, 3), round(v / t, 4) FROM e1 JOIN t0 USING (subject)"""))
def fisher_leading(spark, sf_dir):
    """The two leading eigenvalues of each subject's Fisher information, and their shares of its trace, without the matrix."""
    blocks, nodes = Pool.step_blocks(states_of(spark, sf_dir))
    out = []
    for s in sorted(r.subject for r in blocks.select("subject").distinct().collect()):
        found = Sub.fisher_leading(blocks.where(F.col("subject") == s), len(nodes), 2, tolerance=1e-5)
        out += [(s, c, float(v), float(v / found.trace) if found.trace else None) for c, v in enumerate(found.values)]
    return spark.createDataFrame(out, "subject string, component int, eigenvalue double, share double").select("subject", "component", r("eigenvalue", 3), r("share", 4))


@query()
def stable_components(spark, sf_dir):
    """Components of the embeddings, as many as it takes for the error of their reconstruction to be stable."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    _, found = Sub.until_stable(rows, Sub.vectors_in("v"), 64, 0.01)
    return spark.createDataFrame(found, "n_components int, explained double, rmse double, stable boolean")


# --- correlation families and their nulls


@query(with_("study", then="""
, m AS (SELECT node, avg(x2) AS x, avg(y) AS y FROM study GROUP BY ALL)
SELECT -1 AS node, round(""" + CORR.format(a="x", b="y") + """, 5) AS corr FROM m UNION ALL SELECT node, round(""" + CORR.format(a="x2", b="y") + """, 5) FROM study GROUP BY ALL"""))
def direct_correlations(spark, sf_dir):
    """Group (node -1: over nodes, of means over subjects) and individual (over subjects, at each node) correlations."""
    rows = study_of(spark, sf_dir)
    group = I.group_correlation(rows, "node", [], "x2", "y").select(F.lit(-1).cast("long").alias("node"), "corr")
    return group.unionByName(I.individual_correlation(rows, "node", [], "x2", "y").select("node", "corr")).select("node", r("corr", 5))


def _null_sql(moved: str) -> str:
    return f"""
, o AS (SELECT subject, node, x2 - avg(x2) OVER (PARTITION BY node) AS x, y - avg(y) OVER (PARTITION BY node) AS y FROM study),
nk AS (SELECT node, row_number() OVER (ORDER BY md5(CAST(node AS VARCHAR)), node) AS place FROM (SELECT DISTINCT node FROM o)),
nd AS (SELECT node, p.range AS perm, row_number() OVER (PARTITION BY p.range ORDER BY md5(concat('n', node, '-', p.range)), node) AS place FROM (SELECT DISTINCT node FROM o) CROSS JOIN range({PERMUTATIONS}) p),
nm AS (SELECT nd.perm, nk.node, nd.node AS partner FROM nk JOIN nd USING (place)),
sk AS (SELECT subject, row_number() OVER (ORDER BY md5(subject), subject) AS place FROM (SELECT DISTINCT subject FROM o)),
sd AS (SELECT subject, p.range AS perm, row_number() OVER (PARTITION BY p.range ORDER BY md5(concat('s', subject, '-', p.range)), subject) AS place FROM (SELECT DISTINCT subject FROM o) CROSS JOIN range({PERMUTATIONS}) p),
sm AS (SELECT sd.perm, sk.subject, sd.subject AS partner FROM sk JOIN sd USING (place)),
{moved}"""


NODE_NULL = _null_sql("""nul AS (SELECT r.subject, perm, round(covar_pop(l.x, r.y) / nullif(stddev_pop(l.x) * stddev_pop(r.y), 0), 9) AS c FROM o l JOIN nm ON nm.node = l.node JOIN o r ON r.subject = l.subject AND r.node = nm.partner GROUP BY ALL),
seen AS (SELECT subject, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 9) AS c FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY abs(c) DESC, perm) AS n FROM nul)
SELECT subject, round(any_value(seen.c), 5) AS corr, round(CAST(count_if(abs(k.c) >= abs(seen.c)) AS DOUBLE) / count(*), 6) AS p, round(max(CASE WHEN n = 2 THEN abs(k.c) END), 5) AS critical,
round(least(1.0, 5 * CAST(count_if(abs(k.c) >= abs(seen.c)) AS DOUBLE) / count(*)), 6) AS p_corrected FROM k JOIN seen USING (subject) GROUP BY ALL""")


@query(with_("study", then=NODE_NULL))
def offset_permutations(spark, sf_dir):
    """Offsets from each node's mean: correlation over nodes against moved nodes, with the Bonferroni critical value."""
    rows = I.offsets(study_of(spark, sf_dir).select("subject", "node", F.col("x2").alias("x"), "y"), ["node"], ["x", "y"])
    found = Perm.permuted_summary(rows, "node", ["subject"], "x", "y", PERMUTATIONS, Perm.critical_place(PERMUTATIONS, 5, ALPHA), draw="digest", tags=("n", ""), digits=9)
    return Perm.tested(found, PERMUTATIONS, 5, ALPHA).select("subject", r("corr", 5), r("p"), r("critical", 5), r("p_corrected"))


THRESHOLD_NULL = """
, z AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS z),
t AS (SELECT p.subject, p.node, z.z, avg(CASE WHEN p.value >= m.m + z.z * m.s THEN 1.0 ELSE -1.0 END::DOUBLE) AS y FROM panel p JOIN (SELECT subject, node, avg(value) AS m, stddev_samp(value) AS s FROM panel GROUP BY ALL) m USING (subject, node) CROSS JOIN z GROUP BY ALL),
tx AS (SELECT t.subject, t.node, z, x2 AS x, t.y FROM t JOIN study USING (subject, node)),
nul AS (SELECT r.subject, r.z, perm, round(covar_pop(l.x, r.y) / nullif(stddev_pop(l.x) * stddev_pop(r.y), 0), 9) AS c FROM tx l JOIN nm ON nm.node = l.node JOIN tx r ON r.subject = l.subject AND r.z = l.z AND r.node = nm.partner GROUP BY ALL),
seen AS (SELECT subject, z, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 9) AS c FROM tx GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY subject, z ORDER BY abs(c) DESC, perm) AS n FROM nul)
SELECT subject, z AS threshold, round(any_value(seen.c), 5) AS corr, round(CAST(count_if(abs(k.c) >= abs(seen.c)) AS DOUBLE) / count(k.c), 6) AS p, round(max(CASE WHEN n = 3 THEN abs(k.c) END), 5) AS critical,
round(least(1.0, 3 * CAST(count_if(abs(k.c) >= abs(seen.c)) AS DOUBLE) / count(k.c)), 6) AS p_corrected FROM k JOIN seen USING (subject, z) GROUP BY ALL"""


@query(with_("study", then=_null_sql(THRESHOLD_NULL.lstrip("\n, "))))
def threshold_pvalues(spark, sf_dir):
    """Beside each threshold's correlation of a feature with the mean state: p over moved nodes, Bonferroni over thresholds, and the critical value."""
    grid = B.over_thresholds(event_panel(spark, sf_dir), [0.0, 0.5, 1.0])
    means = grid.groupBy("subject", "node", "threshold").agg(F.avg(F.col("state").cast("double")).alias("y"))
    rows = means.join(study_of(spark, sf_dir).select("subject", "node", "x2"), ["subject", "node"])
    found = Perm.permuted_summary(rows, "node", ["subject", "threshold"], "x2", "y", PERMUTATIONS, Perm.critical_place(PERMUTATIONS, 3, ALPHA), draw="digest", tags=("n", ""), digits=9)
    return Perm.tested(found, PERMUTATIONS, 3, ALPHA).select("subject", "threshold", r("corr", 5), r("p"), r("critical", 5), r("p_corrected"))


BOTH_NULL = _null_sql("""a AS (SELECT 'subjects' AS shuffle, sm.perm, l.x, r.y FROM o l JOIN sm ON sm.subject = l.subject JOIN o r ON r.subject = sm.partner AND r.node = l.node
UNION ALL SELECT 'nodes', nm.perm, l.x, r.y FROM o l JOIN nm ON nm.node = l.node JOIN o r ON r.subject = l.subject AND r.node = nm.partner
UNION ALL SELECT 'both', nm.perm, l.x, r.y FROM o l JOIN nm ON nm.node = l.node JOIN sm ON sm.subject = l.subject AND sm.perm = nm.perm JOIN o r ON r.subject = sm.partner AND r.node = nm.partner)
SELECT shuffle, perm, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 5) AS corr FROM a GROUP BY ALL""")


@query(with_("study", then=BOTH_NULL))
def shuffled_correlations(spark, sf_dir):
    """The nulls of one correlation over all subjects and nodes, with subjects, nodes or both moved."""
    rows = I.offsets(study_of(spark, sf_dir).select("subject", "node", F.col("x2").alias("x"), "y"), ["node"], ["x", "y"])
    out = None
    for how in ("subjects", "nodes", "both"):
        one = I.permuted_correlations(rows, "subject", "node", [], "x", "y", PERMUTATIONS, how).select(F.lit(how).alias("shuffle"), "perm", r("corr", 5))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_("study", then="""
, l AS (SELECT l_suppkey % 16 AS node, stddev_samp(l_quantity) AS b FROM lineitem GROUP BY ALL), a AS (SELECT node, stddev_samp(x) AS a FROM study GROUP BY ALL)
SELECT count(*) AS n, round(""" + CORR.format(a="a", b="b") + """, 5) AS corr FROM a JOIN l USING (node)"""))
def variance_correlation(spark, sf_dir):
    other = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("node"), F.col("l_quantity").alias("x"))
    return I.variance_correlation(study_of(spark, sf_dir), other, "node", "x").select("n", r("corr", 5))


# --- linear models and matrices


@query("""
WITH s AS (SELECT l_linestatus AS status, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, var_pop(y) AS yy,
covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS bq, covar_pop(c, y) AS cy
FROM (SELECT l_linestatus, l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem) GROUP BY ALL),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
o AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (bq * cc - bc * cy) + ac * (bq * bc - bb * cy)) / det AS b1, (aa * (bq * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bq * ac)) / det AS b2,
(aa * (bb * cy - bq * bc) - ab * (ab * cy - bq * ac) + ay * (ab * bc - bb * ac)) / det AS b3 FROM d)
SELECT status, n, round(b1, 3) AS b_l_quantity, round(b2, 2) AS b_l_discount, round(b3, 2) AS b_l_tax, round(my - b1 * ma - b2 * mb - b3 * mc, 2) AS intercept, round((b1 * ay + b2 * bq + b3 * cy) / yy, 6) AS r2 FROM o""")
def lstsq_many(spark, sf_dir):
    """Price by quantity, discount and tax in each status."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "status")
    out = I.least_squares_many(rows, ["status"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("status", "n", r("b_l_quantity", 3), r("b_l_discount", 2), r("b_l_tax", 2), r("intercept", 2), r("r2"))


SPLIT_FITS = """
, own AS (SELECT concat_ws('-', subject, node) AS key, x, x2, y FROM study),
sp AS (SELECT range AS split FROM range(20)),
pl AS (SELECT key, row_number() OVER (ORDER BY md5(key), key) AS place FROM own),
dr AS (SELECT key, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat('null', key, '-', split)), key) AS place FROM own CROSS JOIN sp),
mv AS (SELECT dr.split, pl.key, dr.key AS partner FROM pl JOIN dr USING (place)),
al AS (SELECT 'own' AS features, split, key, x, x2, y FROM own CROSS JOIN sp UNION ALL SELECT 'moved', mv.split, r.key, l.x, l.x2, r.y FROM mv JOIN own l ON l.key = mv.key JOIN own r ON r.key = mv.partner),
pt AS (SELECT *, CAST(concat('0x', substr(md5(concat(key, '-', split)), 1, 8)) AS BIGINT) < 2147483648 AS train FROM al),
cv AS (SELECT features, split, avg(x) AS ma, avg(x2) AS mb, avg(y) AS my, var_pop(x) AS aa, var_pop(x2) AS bb, covar_pop(x, x2) AS ab, covar_pop(x, y) AS ay, covar_pop(x2, y) AS b_y FROM pt WHERE train GROUP BY ALL),
co AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS b1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM cv),
pr AS (SELECT features, split, y, my + b1 * (x - ma) + b2 * (x2 - mb) AS p FROM pt JOIN co USING (features, split) WHERE NOT train)
SELECT features, split, round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 4) AS corr, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0), 4) AS r2 FROM pr GROUP BY ALL"""


@query(with_("study", then=SPLIT_FITS))
def split_fits(spark, sf_dir):
    """Two features on random halves of the subjects' nodes, and the same with moved features."""
    rows = study_of(spark, sf_dir).withColumn("key", F.concat_ws("-", "subject", "node"))
    found = I.split_fits(rows, "key", [], ["x", "x2"], "y", 20).withColumn("features", F.lit("own"))
    out = found.unionByName(I.split_fits(rows, "key", [], ["x", "x2"], "y", 20, null=True).withColumn("features", F.lit("moved")))
    return out.select("features", "split", r("corr", 4), r("rmse", 5), r("r2", 4))


@query(with_("study", then="""
, m AS (SELECT node, avg(x) AS x, avg(x2) AS x2, avg(y) AS y FROM study GROUP BY ALL),
c AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(x2) AS mx2, stddev_samp(x2) AS sx2, avg(y) AS my, stddev_samp(y) AS sy, var_pop(x) AS aa, var_pop(x2) AS bb, covar_pop(x, x2) AS ab, covar_pop(x, y) AS ay, covar_pop(x2, y) AS b_y FROM m),
b AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS b1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM c)
SELECT subject, node, round(y, 5) AS y, round(my + b1 * (x - mx) + b2 * (x2 - mx2), 5) AS prediction FROM study CROSS JOIN b"""))
def group_on_individuals(spark, sf_dir):
    return I.group_coefficients_on_individuals(study_of(spark, sf_dir), "subject", "node", ["x", "x2"], "y").select("subject", "node", r("y", 5), r("prediction", 5))


@query(with_("moments", then="""
, jac AS (SELECT subject, CAST(floor(step / 30) AS BIGINT) AS f, node AS k, avg(CAST(state AS DOUBLE)) AS x FROM states GROUP BY ALL),
mid AS (SELECT subject, i AS k, j AS l, product AS x FROM moments UNION ALL SELECT subject, j, i, product FROM moments UNION ALL SELECT DISTINCT subject, node, node, 1.0::DOUBLE FROM states)
SELECT a.subject, a.f, b.f AS g, round(sum(a.x * m.x * b.x), 5) AS x FROM jac a JOIN mid m ON m.subject = a.subject AND m.k = a.k JOIN jac b ON b.subject = a.subject AND b.k = m.l GROUP BY ALL"""))
def structure_information(spark, sf_dir):
    """J M J' of the nodes' means in four quarters and their products."""
    states = states_of(spark, sf_dir)
    jac = states.groupBy("subject", F.floor(F.col("step") / 30).cast("long").alias("f"), F.col("node").alias("k")).agg(F.avg(F.col("state").cast("double")).alias("x"))
    mid = B.mirrored(M.product_mean(states), ["subject"], "product", 1.0).select("subject", F.col("i").alias("k"), F.col("j").alias("l"), F.col("product").alias("x"))
    return I.sandwiched(jac, mid, ["subject"]).select("subject", "f", "g", r("x", 5))


def _embedding_vectors(spark, sf_dir):
    """Covariance of the embeddings' components, and their eigenvectors as a long table."""
    rows = embedding_features(spark, sf_dir).select(F.lit("all").alias("subject"), F.col("feature").alias("node"), F.col("vec_id").alias("step"), "value")
    sums = pair_sums(rows, "value", ("subject",), diagonal=True)
    cov = sums.select("subject", "i", "j", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.col("n")).alias("cov"))
    square = cov.unionByName(cov.where("i != j").select("subject", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    found = K.eigen(square, "cov")
    return rows, found, found.select("subject", "component", F.posexplode("vector").alias("node", "v")).withColumn("node", F.col("node").cast("long"))


@query()
def principal_components(spark, sf_dir):
    """Coordinates along the first four eigenvectors of the covariance, of vectors moved to their mean."""
    rows, _, vectors = _embedding_vectors(spark, sf_dir)
    moved = I.offsets(rows, ["subject", "node"], ["value"])
    return I.projected(moved, vectors.where("component < 4"), ["subject"]).select(F.col("step").alias("vec_id"), "component", "coordinate")


@query()
def reconstruction(spark, sf_dir):
    """Error of the first components, and from which number on it is stable."""
    _, found, _ = _embedding_vectors(spark, sf_dir)
    return I.reconstruction(found, ["subject"], 0.01)


@query()
def clustered_series(spark, sf_dir):
    """Nodes of each subject merged two by two where the summed series' squares are greatest."""
    return C.merged_tree(states_of(spark, sf_dir))


@query()
def network_grid(spark, sf_dir):
    """Each subject's parameter by both features over nodes: linear, deep and skipping networks on two splits."""
    rows = study_of(spark, sf_dir)
    settings = [(f"{w}x{d}{'s' if skip else ''}", w, d, 0.02, 8, skip, split) for w, d, skip in ((1, 0, False), (8, 2, False), (8, 3, True)) for split in (0, 1)]
    grid = spark.createDataFrame(settings, "setting string, width int, depth int, rate double, batch int, skip boolean, split long")
    curves = N.learning_curves(rows, ["subject"], ["x", "x2"], "y", grid, epochs=60, patience=15)
    return N.best_settings(curves, ["subject"])


@query(with_("fc", "study", then="""
, e AS (SELECT subject, i AS node, j AS other, fc AS w FROM fc WHERE fc > 0 UNION ALL SELECT subject, j, i, fc FROM fc WHERE fc > 0),
a AS (SELECT e.subject, e.node, sum(w * x) / sum(w) AS p FROM e JOIN study s ON s.subject = e.subject AND s.node = e.other GROUP BY ALL),
b AS (SELECT e.subject, e.node, sum(w * p) / sum(w) AS p FROM e JOIN a ON a.subject = e.subject AND a.node = e.other GROUP BY ALL)
SELECT s.subject, s.node, round(x, 3) AS pass_0, round(a.p, 3) AS pass_1, round(b.p, 3) AS pass_2 FROM study s LEFT JOIN a USING (subject, node) LEFT JOIN b USING (subject, node)"""))
def convolved_features(spark, sf_dir):
    """A feature after one and two passes of messages over each subject's positive connectivity."""
    edges = M.functional_connectivity(states_of(spark, sf_dir)).where("fc > 0")
    return N.convolved(edges, study_of(spark, sf_dir), ["subject"], "fc", "x", 2).select("subject", "node", r("pass_0", 3), r("pass_1", 3), r("pass_2", 3))


# --- power laws


def _order_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    return orders.groupBy(F.col("o_orderpriority").alias("priority"), F.ceil(F.col("o_totalprice") / 20000).cast("long").alias("v")).agg(F.count("*").alias("n"))


def _refined_sql(source: str, key: str, name: str) -> str:
    """CTEs that end in {name}({key}, n, exponent, likelihood): the bracket of I.power_law_refined over {source}({key}, n, logs), eight passes of nine tries."""
    zeta = "list_sum(list_transform(range(1, 65), lambda k: pow(k::DOUBLE, -a))) - pow(65.0::DOUBLE, 1 - a) / (1 - a) + pow(65.0::DOUBLE, -a) / 2 + a * pow(65.0::DOUBLE, -a - 1) / 12"
    out = f"{name}_0 AS (SELECT {key}, n, logs, 1.0001::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0.0::DOUBLE AS exponent, 0.0::DOUBLE AS likelihood FROM {source})"
    for k in range(8):
        out += f""",
{name}_t{k} AS (SELECT *, -n * ln({zeta}) - a * logs AS l FROM (SELECT *, i.range AS i, lo + i.range * (hi - lo) / 8 AS a FROM {name}_{k} CROSS JOIN range(9) i)),
{name}_b{k} AS (SELECT {key}, n, logs, lo, hi, arg_max(a, struct_pack(l := l, i := -i)) AS a, arg_max(i, struct_pack(l := l, i := -i)) AS i, max(l) AS l FROM {name}_t{k} GROUP BY ALL),
{name}_{k + 1} AS (SELECT {key}, n, logs, greatest(a - (hi - lo) / 8, 1.0001) AS lo, CASE WHEN i = 8 AND hi >= 10 THEN 2 * a ELSE a + (hi - lo) / 8 END AS hi, a AS exponent, l AS likelihood FROM {name}_b{k})"""
    return out + f", {name} AS (SELECT {key}, n, exponent, likelihood FROM {name}_8)"


@query("""
WITH c AS (SELECT o_orderpriority AS priority, CAST(ceil(o_totalprice / 20000) AS BIGINT) AS v, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY ALL),
s AS (SELECT priority, CAST(sum(n) AS DOUBLE) AS n, sum(n * ln(v)) AS logs FROM c GROUP BY ALL),
""" + _refined_sql("s", "priority", "p") + " SELECT priority, n, round(exponent, 5) AS exponent, round(likelihood, 2) AS likelihood FROM p")
def powerlaw_refined(spark, sf_dir):
    counts = _order_counts(spark, sf_dir)
    sums = counts.groupBy("priority").agg(F.lit(1).cast("long").alias("first"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.log("v")).alias("logs"))
    return I.power_law_refined(sums, ["priority"], 8, 9).select("priority", "n", r("exponent", 5), r("likelihood", 2))


@query()
def powerlaw_intervals(spark, sf_dir):
    """The exponent and distance on every interval of values with at least five of them."""
    counts = _order_counts(spark, sf_dir)
    fits = I.power_law_refined(I.interval_sums(counts, ["priority"], "v", "n", 4, 5), ["priority"], 8, 9, low=-5.0)
    return I.interval_distance(fits, counts, ["priority"], "v", "n")


@query(with_("actives", then="""
, b AS (SELECT *, CASE WHEN (n_active > 0) = lag(n_active > 0) OVER w THEN 0 ELSE 1 END AS new FROM actives WINDOW w AS (PARTITION BY subject ORDER BY step)),
g AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY step) AS run FROM b), ru AS (SELECT subject, run, count(*) AS duration, sum(n_active) AS size FROM g WHERE n_active > 0 GROUP BY ALL),
sd AS (SELECT subject, CAST(count(*) AS DOUBLE) AS n, sum(ln(duration)) AS logs FROM ru GROUP BY ALL), ss AS (SELECT subject, CAST(count(*) AS DOUBLE) AS n, sum(ln(size)) AS logs FROM ru GROUP BY ALL),
m AS (SELECT subject, duration, avg(size) AS size FROM ru GROUP BY ALL), sc AS (SELECT subject, covar_pop(ln(duration), ln(size)) / nullif(var_pop(ln(duration)), 0) AS scaling FROM m GROUP BY ALL),
""" + _refined_sql("sd", "subject", "d") + ", " + _refined_sql("ss", "subject", "z") + """
SELECT subject, round(d.exponent, 4) AS duration_exponent, round(z.exponent, 4) AS size_exponent, round(scaling, 4) AS scaling, round((d.exponent - 1) / nullif(z.exponent - 1, 0) - scaling, 4) AS distance FROM d JOIN z USING (subject) JOIN sc USING (subject)"""))
def criticality(spark, sf_dir):
    """Exponents of durations and sizes of runs of activity, of mean size by duration, and their distance."""
    runs = T.runs(T.activations(states_of(spark, sf_dir)), censored=True).where("active")

    def exponent(value: str):
        counts = runs.groupBy("subject", F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
        sums = counts.groupBy("subject").agg(F.lit(1).cast("long").alias("first"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.log("v")).alias("logs"))
        return I.power_law_refined(sums, ["subject"], 8, 9).select("subject", F.col("exponent").alias(f"{value}_exponent"))

    x, y = F.log(F.col("duration").cast("double")), F.log(F.col("size").cast("double"))
    scaling = runs.groupBy("subject", "duration").agg(F.avg("size").alias("size")).groupBy("subject").agg((F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0))).alias("scaling"))
    rows = exponent("duration").join(exponent("size"), "subject").join(scaling, "subject")
    out = I.criticality_distance(rows, "duration_exponent", "size_exponent", "scaling")
    return out.select("subject", *[r(c, 4) for c in ("duration_exponent", "size_exponent", "scaling", "distance")])


# --- series


@query()
def band_pass(spark, sf_dir):
    """Chebyshev's second kind, forwards and backwards."""
    return X.band_pass(event_panel(spark, sf_dir), 0.2, 1.0, 0.25)


@query(with_("panel", then="SELECT DISTINCT subject, node, true AS same FROM panel"))
def phase_round_trip(spark, sf_dir):
    """Each series through its transform and back, with its own phases: whether all values come back to within 1e-6."""
    panel = event_panel(spark, sf_dir)
    back = X.phase_surrogate(panel, shuffle=False).withColumnRenamed("value", "_b")
    return panel.join(back, ["subject", "node", "step"]).groupBy("subject", "node").agg((F.max(F.abs(F.col("value") - F.col("_b"))) < 1e-6).alias("same"))


# --- fits


def _wanted(spark, sf_dir):
    states = states_of(spark, sf_dir)
    flips = T.flip_rate(states).groupBy("subject").agg(F.avg("flip_rate").alias("flip_rate")).withColumnRenamed("subject", "model")
    return states, targets_of(states).join(flips, "model")


def _beta_query(measure: str):
    def search(spark, sf_dir):
        return Fit.search_beta(assembled(spark, sf_dir), _wanted(spark, sf_dir)[1], measure, 3, 7, 200)

    search.__name__ = f"beta_by_{measure}"
    search.__doc__ = f"The inverse temperature of each subject's model by {measure}, refined in three rounds."
    return query()(search)


for _measure in ("cov_rmse", "fc_corr", "flip_distance", "product_rmse"):
    _beta_query(_measure)


@query()
def beta_sweep(spark, sf_dir):
    return Fit.goodness(K.over_betas(assembled(spark, sf_dir), [0.2, 0.4, 0.6, 0.8, 1.0]), _wanted(spark, sf_dir)[1], [300])


@query()
def fitted_pseudolikelihood(spark, sf_dir):
    """Fits on each subject's series, and how far their simulations lie from the data after 100, 300 and 1000 steps."""
    states, want = _wanted(spark, sf_dir)
    fitted = Fit.fit_pseudolikelihood(Fit.initial(want, "means"), states, 150, 0.1)
    return Fit.goodness(fitted, want, [100, 300, 1000])


def _pass_sql(k: int) -> str:
    """One gradient pass in SQL: fields h{k} and couplings w{k} (both directions) to those of k + 1."""
    return f"""
, l{k} AS (SELECT s.subject, s.step, s.node, s.state, s.state - tanh(any_value(h.h) + sum(w.w * o.state)) AS e FROM states s JOIN h{k} h ON h.node = s.node JOIN states o ON o.subject = s.subject AND o.step = s.step AND o.node <> s.node JOIN w{k} w ON w.i = s.node AND w.j = o.node GROUP BY s.subject, s.step, s.node, s.state),
g{k} AS (SELECT a.node AS i, b.node AS j, avg(a.e * b.state + b.e * a.state) AS g FROM l{k} a JOIN l{k} b ON a.subject = b.subject AND a.step = b.step AND a.node <> b.node GROUP BY ALL),
h{k + 1} AS (SELECT node, any_value(h.h) + 0.1 * avg(l.e) AS h FROM l{k} l JOIN h{k} h USING (node) GROUP BY node), w{k + 1} AS (SELECT i, j, w + 0.1 * g AS w FROM w{k} JOIN g{k} USING (i, j))"""


@query(with_("states", then="""
, h0 AS (SELECT node, avg(CAST(state AS DOUBLE)) AS h FROM states GROUP BY ALL),
w0 AS (SELECT a.node AS i, b.node AS j, avg(CAST(a.state * b.state AS DOUBLE)) AS w FROM states a JOIN states b ON a.subject = b.subject AND a.step = b.step AND a.node <> b.node GROUP BY ALL)"""
+ _pass_sql(0) + _pass_sql(1) + """
SELECT 'group' AS model, node AS i, node AS j, round(h, 5) AS value FROM h2 UNION ALL SELECT 'group', i, j, round(w, 5) FROM w2 WHERE i < j"""))
def pooled_pseudolikelihood(spark, sf_dir):
    """One model of all subjects' steps, two gradient passes from its mean states and products: fields (i = j) and couplings."""
    states = states_of(spark, sf_dir).select(F.lit("group").alias("subject"), F.concat_ws("-", "subject", "step").alias("step"), "node", "state")
    start = Fit.initial(targets_of(states), "means")
    fitted, _ = Pool.fit_pooled(start, states_of(spark, sf_dir), 2, 0.1)
    n = F.size("h")
    own = fitted.select("model", F.posexplode("h").alias("i", "value")).select("model", "i", F.col("i").alias("j"), "value")
    pairs = fitted.select("model", n.alias("n"), F.posexplode("w").alias("k", "value")).select("model", F.floor(F.col("k") / F.col("n")).alias("i"), (F.col("k") % F.col("n")).alias("j"), "value").where("i < j")
    return own.unionByName(pairs).select("model", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r("value", 5))


@query()
def individual_fits(spark, sf_dir):
    """The mean subject's model by simulation, and from it each subject's, with its own rate."""
    _, want = _wanted(spark, sf_dir)
    group = M.mean_arrays(want, ["m", "p"]).select(F.lit("group").alias("model"), "m", "p")
    start = K.fit_by_simulation(Fit.initial(group, "centred"), group, 30, 50, 0.05)
    members = want.select("model", F.lit("group").alias("group"))
    own = Fit.individual(start, members).withColumn("rate", F.lit(0.05))
    return Fit.goodness(K.fit_by_simulation(own, want, 30, 50), want, [500])


@query()
def window_fits(spark, sf_dir):
    """Fits window by window, fixed, sliding and at random, and how far they lie from the whole series."""
    states, want = _wanted(spark, sf_dir)
    out = None
    for how in ("fixed", "sliding", "random"):
        fitted = Fit.fit_windows(Fit.initial(want, "centred"), states, 20, 0.05, how, n_epochs=2, every=10)
        one = Fit.goodness(fitted, want, [300]).withColumn("windows", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def transition_fits(spark, sf_dir):
    """Models of eight nodes from the flips that follow each state."""
    return Fit.fit_transitions(Fit.transition_table(states_of(spark, sf_dir).where("node < 8")), 200, 0.02)


@query()
def schedules(spark, sf_dir):
    """Goodness of the same models by sweeps, by nodes drawn one at a time, and by all nodes at once."""
    _, want = _wanted(spark, sf_dir)
    models, out = assembled(spark, sf_dir), None
    for how, n in (("sweep", 200), ("random_node", 3200), ("synchronous", 200)):
        one = Fit.goodness(models, want, [n], how).withColumn("schedule", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def update_rules(spark, sf_dir):
    """Boltzmann learning by each rule, and without fields."""
    _, want = _wanted(spark, sf_dir)
    start, out = Fit.initial(want, "centred"), None
    for rule, rate in (("linear", 0.05), ("power", 0.01), ("cubic", 0.5), ("log", 0.01), ("no_fields", 0.05)):
        plain = rule if rule != "no_fields" else "linear"
        fitted = K.fit_by_simulation(start, want, 20, 40, rate, rule=plain, with_fields=rule != "no_fields")
        one = Fit.goodness(fitted, want, [200]).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def retested_edits(spark, sf_dir):
    """Goodness of each subject's model as it is, with equal fields, and without fields or couplings."""
    _, want = _wanted(spark, sf_dir)
    models, out = assembled(spark, sf_dir), None
    for how in ("none", "mean_h", "zero_h", "zero_w"):
        one = Fit.goodness(models if how == "none" else Fit.overridden(models, how), want, [300]).withColumn("edit", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def running_bursts(spark, sf_dir):
    return Fit.running_bursts(assembled(spark, sf_dir), 300)


@query()
def simulated_connectivity(spark, sf_dir):
    return Fit.simulated_connectivity(K.simulated_means(assembled(spark, sf_dir), 300))


@query()
def folded_fits(spark, sf_dir):
    """Models of blocks of eight nodes, fitted by logarithmic updates from the temperature that a doubling search finds."""
    states = Fit.folded(states_of(spark, sf_dir), 8)
    want = targets_of(states)
    start = Fit.initial(want, "means")
    found = Fit.search_beta(start, want, "fc_rmse", 2, 5, 200, doubling=True)
    return Fit.goodness(K.fit_by_simulation(Fit.at_best_beta(start, found, False), want, 20, 50, 0.01, rule="log"), want, [300])


__all__ = ["QUERIES", "SQL"]
