"""Fitted numbers against SQL: coefficients, probabilities and trees, each found a second time by DuckDB.

The logistic optimum is unique, so SQL may reach it by its own road: bound optimisation with the fixed curvature X'X/4,
whose inverse is one Gauss-Jordan elimination.  Trees are grown again from the same cuts, bags and feature choices.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from renewcast.catalog.modelling import KEY, _prep
from renewcast.catalog.prep import _LEVELS, _MAPPED, _SCALED, NUMERIC, _ms_sql
from renewcast.operators import forest as G
from renewcast.operators import models as ML
from renewcast.operators import prep as PR
from renewcast.plans import training as T
from renewcast.registry import query

_K = ", ".join(KEY)
#: Largest violation of the optimality conditions that counts as none, in units of the weights' penalty.
CERTIFIED = 1e-3
TIGHT = 1e-12

_DUMMIES = f"""SELECT m.msno, m.membership_start_date, m.membership_expire_date, l.col || '_' || l.lv AS name, CAST(coalesce(m.v = l.lv, false) AS DOUBLE) AS x
FROM ({_MAPPED}) m JOIN ({_LEVELS} UNION ALL SELECT 'is_auto_renew', '1' UNION ALL SELECT 'is_cancel', '1') l ON l.col = m.col"""


def _logistic_sql(body: str, C: float = 1.0, penalise_intercept: bool = False, rounds: int = 90) -> str:
    """``body`` may read names (name, j), best (w: list by j, the intercept is called _intercept) and rx (key, x: list by j)."""
    columns = ", ".join(NUMERIC)
    return _ms_sql(f"""
SELECT * FROM (
WITH RECURSIVE
scaled AS (SELECT m.msno, m.membership_start_date, m.membership_expire_date, {_SCALED} FROM ms m),
xl AS (
  SELECT {_K}, name, x FROM scaled UNPIVOT (x FOR name IN ({columns}))
  UNION ALL {_DUMMIES}
  UNION ALL SELECT {_K}, '_intercept', 1.0::DOUBLE FROM ms),
names AS (SELECT name, row_number() OVER (ORDER BY name) AS j,
                 CASE WHEN name = '_intercept' THEN {float(penalise_intercept)} ELSE 1.0 END::DOUBLE AS pen FROM (SELECT DISTINCT name FROM xl)),
dim AS (SELECT count(*)::INTEGER AS d, list(pen ORDER BY j) AS pens FROM names),
rx AS (SELECT {_K}, list(x ORDER BY name) AS x FROM xl GROUP BY ALL),
fx AS MATERIALIZED (SELECT x, CAST(churn AS DOUBLE) AS y FROM rx JOIN fit USING ({_K})),
h AS (SELECT a.j AS i, b.j AS j, {C}::DOUBLE / 4 * sum(x[a.j] * x[b.j]) + CASE WHEN a.j = b.j THEN any_value(a.pen) ELSE 0 END AS v
      FROM fx, names a, names b GROUP BY 1, 2),
aug AS (SELECT i, list(v ORDER BY j) AS r FROM (
          SELECT i, j, v FROM h UNION ALL SELECT a.j, b.j + d, CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END::DOUBLE FROM names a, names b, dim) GROUP BY i),
gj AS (
  SELECT 0 AS k, list(r ORDER BY i) AS m FROM aug
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
           ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj, dim WHERE k < d),
inv AS MATERIALIZED (SELECT list_transform(m, lambda r: r[d + 1:2 * d]) AS m FROM gj, dim WHERE k = d),
it AS (
  SELECT 0 AS t, list_transform(pens, lambda p: 0.0::DOUBLE) AS w FROM dim
  UNION ALL
  SELECT t + 1, list_transform(w, lambda v, i: v - list_dot_product(m[i], list_transform(g, lambda s, q: {C}::DOUBLE * s + pens[q] * w[q])))
  FROM (SELECT t, w, list(s ORDER BY j) AS g FROM (
          SELECT t, w, names.j, sum(e * x[names.j]) AS s
          FROM (SELECT t, w, x, 1 / (1 + exp(-list_dot_product(w, x))) - y AS e FROM it, fx WHERE t < {rounds}), names GROUP BY ALL) GROUP BY ALL),
       inv, dim),
best AS (SELECT w FROM it WHERE t = {rounds})
{body})""")


def _certified(spark, sf, params: dict):
    """Feature by feature: the fitted weight and whether the certificate holds there."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", params | {"tol": TIGHT})
    names, weights, intercept = ML.coefficients(b.model)
    proof = ML.optimality(p.matrix(p.fit), names, weights, intercept, params["C"], params["penalty"],
                          penalise_intercept=params.get("penalise_intercept", False))
    return proof.select("name", F.round("weight", 3).alias("weight"), (F.col("violation") < CERTIFIED).alias("optimal"))


@query("train_logistic__coefficients", _logistic_sql("SELECT name, round(w[j], 3) AS weight, true AS optimal FROM names, best"))
def train_logistic_coefficients(spark, sf):
    """Weights and intercept (L2, C = 1) with their optimality certificate."""
    return _certified(spark, sf, {"C": 1.0, "penalty": "l2"})


@query("train_logistic__penalised_intercept", _logistic_sql("SELECT name, round(w[j], 3) AS weight, true AS optimal FROM names, best", 0.5, True))
def train_logistic_penalised_intercept(spark, sf):
    """The same with the intercept penalised like any weight (C = 0.5)."""
    return _certified(spark, sf, {"C": 0.5, "penalty": "l2", "penalise_intercept": True})


@query("train_logistic__certificate", _logistic_sql("""
SELECT penalty, CASE WHEN name = '_intercept' THEN 'intercept' ELSE 'weight' END AS kind, count(*)::BIGINT AS n, true AS optimal
FROM names, (VALUES ('l1'), ('l2')) v(penalty) GROUP BY ALL"""))
def train_logistic_certificate(spark, sf):
    """Largest violation of the optimality conditions for both penalties, weights and intercept apart, against its bound."""
    p = _prep(spark, sf)
    X = T.materialize(spark, p.matrix(p.fit), "certificate_matrix")
    parts = []
    for penalty in ("l1", "l2"):
        b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": penalty, "tol": TIGHT})
        proof = ML.optimality(X, *ML.coefficients(b.model), 1.0, penalty)
        kind = F.when(F.col("name") == ML.INTERCEPT, "intercept").otherwise("weight")
        parts.append(proof.groupBy(kind.alias("kind")).agg(
            F.count(F.lit(1)).alias("n"), (F.max("violation") < 10 * CERTIFIED).alias("optimal")).select(
            F.lit(penalty).alias("penalty"), "kind", "n", "optimal"))
    return parts[0].unionByName(parts[1])


CV_DRAWS = [{"C": 1.0, "penalty": "l2"}, {"C": 0.2, "penalty": "l2"}]


def _cv_sql(body: str, rounds: int = 90) -> str:
    """Every (trial, fold) problem at once: ``body`` may read scored (trial, fold, part, y, p)."""
    f = _logistic_sql("SELECT 1", 1.0)
    head, _, rest = f.partition("fx AS MATERIALIZED")
    folds = """
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY churn ORDER BY md5(concat_ws('|', msno, CAST(membership_start_date AS VARCHAR),
                          CAST(membership_expire_date AS VARCHAR), '42'))) - 1) % 3 AS INTEGER) AS fold FROM fit),"""
    trials = " UNION ALL ".join(f"SELECT {t} AS trial, {d['C']}::DOUBLE AS c, {k} AS out_fold" for t, d in enumerate(CV_DRAWS) for k in range(3))
    return head + f"""{folds}
grp AS (SELECT *, trial * 3 + out_fold AS g FROM ({trials})),
ax AS MATERIALIZED (SELECT x, CAST(churn AS DOUBLE) AS y, fold FROM rx JOIN folded USING ({_K})),
fx AS MATERIALIZED (SELECT g, c, x, y FROM ax, grp WHERE fold <> out_fold),
h AS (SELECT g, a.j AS i, b.j AS j, any_value(c) / 4 * sum(x[a.j] * x[b.j]) + CASE WHEN a.j = b.j THEN any_value(a.pen) ELSE 0 END AS v
      FROM fx, names a, names b GROUP BY 1, 2, 3),
aug AS (SELECT g, i, list(v ORDER BY j) AS r FROM (
          SELECT g, i, j, v FROM h UNION ALL SELECT g, a.j, b.j + d, CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END::DOUBLE FROM names a, names b, dim, grp) GROUP BY g, i),
gj AS (
  SELECT g, 0 AS k, list(r ORDER BY i) AS m FROM aug GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
           ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj, dim WHERE k < d),
inv AS MATERIALIZED (SELECT g, list_transform(m, lambda r: r[d + 1:2 * d]) AS m FROM gj, dim WHERE k = d),
it AS (
  SELECT g, 0 AS t, list_transform(pens, lambda p: 0.0::DOUBLE) AS w FROM dim, grp
  UNION ALL
  SELECT z.g, t + 1, list_transform(w, lambda v, i: v - list_dot_product(m[i], list_transform(gr, lambda s, q: s + pens[q] * w[q])))
  FROM (SELECT g, t, w, list(s ORDER BY j) AS gr FROM (
          SELECT g, t, w, names.j, sum(e * x[names.j]) AS s
          FROM (SELECT it.g, t, w, x, c * (1 / (1 + exp(-list_dot_product(w, x))) - y) AS e FROM it JOIN fx ON fx.g = it.g WHERE t < {rounds}), names GROUP BY ALL)
        GROUP BY ALL) z JOIN inv ON inv.g = z.g, dim),
scored AS (SELECT trial, out_fold AS fold, CASE WHEN ax.fold = out_fold THEN 'validation' ELSE 'train' END AS part, y,
                  1 / (1 + exp(-list_dot_product(w, x))) AS p FROM it JOIN grp USING (g), ax WHERE t = {rounds})
{body})"""


@query("cv_report__values", _cv_sql("""
SELECT trial::INTEGER AS trial, part, round(avg(auc), 3) AS auc, round(avg(f), 3) AS f1_5, round(avg(fnr), 3) AS fn_rate FROM (
  SELECT trial, fold, part, (sum(rk) FILTER (y = 1) - any_value(np) * (any_value(np) + 1) / 2) / (any_value(np) * any_value(nn)) AS auc,
         3.25 * sum(hit * y) / (3.25 * sum(hit * y) + 2.25 * sum((1 - hit) * y) + sum(hit * (1 - y))) AS f,
         coalesce(sum((1 - hit) * y) / nullif(sum(1 - hit), 0), 0) AS fnr
  FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
               rank() OVER (PARTITION BY trial, fold, part ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY trial, fold, part, round(p, 9)) - 1) / 2 AS rk,
               sum(y) OVER (PARTITION BY trial, fold, part) AS np, sum(1 - y) OVER (PARTITION BY trial, fold, part) AS nn FROM scored)
  GROUP BY trial, fold, part) GROUP BY trial, part"""))
def cv_report_values(spark, sf):
    """Mean AUC, F1.5 and FN rate over three folds of two draws, against fold problems that DuckDB solves itself."""
    p = _prep(spark, sf)
    X = T.materialize(spark, p.matrix(p.fit, extra=["fold"]), "cv_matrix")
    r = ML.cv_report(X, p.names, lambda d, n: ML.logistic(n, d["C"], d["penalty"], tol=TIGHT), CV_DRAWS, k=3)
    return r.select(F.col("trial").cast("int").alias("trial"), "part", *[F.round(c, 3).alias(c) for c in ("auc", "f1_5", "fn_rate")])


@query("score_batch__values", _logistic_sql(f"""
SELECT {_K}, round(1 / (1 + exp(-list_dot_product(w, x))), 3) AS probability FROM rx JOIN ms USING ({_K}), best WHERE split = 'inference'"""))
def score_batch_values(spark, sf):
    """Probabilities of the inference rows from the compiled model."""
    p = _prep(spark, sf)
    b = T.fit_bundle(spark, p, "logistic", {"C": 1.0, "penalty": "l2", "tol": TIGHT})
    scored = T.score_batch(b, p.model_set.where(F.col("split") == "inference"))
    return scored.select(*KEY, F.round("probability", 3).alias("probability"))


# ------------------------------------------------------------------ forests

FOREST = {"num_trees": 3, "max_depth": 4, "min_split": 40, "min_leaf": 3, "feature_subset": "sqrt", "rule": "gini", "seed": 42}
CUT_BINS = 16


def _forest_sql(body: str) -> str:
    """``body`` may read nodes (tree, node, feature, cut, gain, rows, weight, ones) and a_last (key, tree, node) of all rows of the model set."""
    f = FOREST
    key = "concat_ws('|', msno, CAST(membership_start_date AS VARCHAR), CAST(membership_expire_date AS VARCHAR), "
    weight = " ".join(f"WHEN h < '{x}' THEN {k}" for k, x in enumerate(G.POISSON))
    levels = []
    for d in range(f["max_depth"]):
        levels.append(f"""
n{d} AS (SELECT tree, node, count(*) AS rows, sum(w) AS weight, sum(w * y) AS ones FROM a{d} WHERE w > 0 AND node >= {1 << d} GROUP BY 1, 2),
sub{d} AS (
  SELECT tree, node, name FROM (
    SELECT tree, node, name, row_number() OVER (PARTITION BY tree, node ORDER BY md5('{f["seed"]}|' || tree || '|' || node || '|' || name)) AS k
    FROM n{d}, names WHERE rows >= {f["min_split"]} AND ones > 0 AND ones < weight) WHERE k <= (SELECT floor(sqrt(count(*))) FROM names)),
hist{d} AS (
  SELECT s.tree, s.node, s.name, b.bin, count(*) AS rows, sum(a.w) AS weight, sum(a.w * a.y) AS ones
  FROM a{d} a JOIN sub{d} s USING (tree, node) JOIN binned b ON b.id = a.id AND b.name = s.name WHERE a.w > 0 GROUP BY ALL),
cum{d} AS (
  SELECT tree, node, name, bin, sum(rows) OVER u AS lr, sum(weight) OVER u AS lw, sum(ones) OVER u AS lo,
         sum(rows) OVER e AS r, sum(weight) OVER e AS w, sum(ones) OVER e AS o FROM hist{d}
  WINDOW u AS (PARTITION BY tree, node, name ORDER BY bin ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY tree, node, name)),
best{d} AS (
  SELECT tree, node, name, bin, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, name, bin) AS k FROM (
      SELECT tree, node, name, bin, round(gini(o, w) - lw / w * gini(lo, lw) - (w - lw) / w * gini(o - lo, w - lw), 10) AS gain
      FROM cum{d} WHERE lr >= {f["min_leaf"]} AND r - lr >= {f["min_leaf"]}) WHERE gain > 0) WHERE k = 1),
a{d + 1} AS (
  SELECT a.id, a.tree, a.w, a.y, CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + CASE WHEN b.bin > s.bin THEN 1 ELSE 0 END END AS node
  FROM a{d} a LEFT JOIN best{d} s USING (tree, node) LEFT JOIN binned b ON b.id = a.id AND b.name = s.name)""")
    last = f["max_depth"]
    levels.append(f"""
n{last} AS (SELECT tree, node, count(*) AS rows, sum(w) AS weight, sum(w * y) AS ones FROM a{last} WHERE w > 0 AND node >= {1 << last} GROUP BY 1, 2),
nodes AS (
  {" UNION ALL ".join(f"SELECT n.*, s.name AS feature, c.c AS cut, s.gain FROM n{d} n LEFT JOIN best{d} s USING (tree, node) "
                      f"LEFT JOIN cuts c ON c.name = s.name AND c.k = s.bin" for d in range(last))}
  UNION ALL SELECT *, NULL, NULL, NULL FROM n{last})""")
    rounded = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in NUMERIC)
    return _ms_sql(f"""
SELECT * FROM (
WITH ids AS (SELECT {_K}, row_number() OVER (ORDER BY {_K}) AS id FROM ms),
xl AS (
  SELECT id, name, x FROM (SELECT {_K}, {rounded} FROM ms) UNPIVOT (x FOR name IN ({", ".join(NUMERIC)})) JOIN ids USING ({_K})
  UNION ALL SELECT id, name, x FROM ({_DUMMIES}) JOIN ids USING ({_K})),
names AS (SELECT DISTINCT name FROM xl),
train AS (SELECT id, churn AS y, {", ".join(f"md5({key}'{f['seed']}|{t}'))[1:8] AS h{t}" for t in range(f["num_trees"]))} FROM fit JOIN ids USING ({_K})),
cuts AS (SELECT name, c, row_number() OVER (PARTITION BY name ORDER BY c) - 1 AS k FROM (
           SELECT DISTINCT name, unnest(quantile_disc(x, [{", ".join(f"{i / CUT_BINS!r}" for i in range(1, CUT_BINS))}])) AS c
           FROM xl JOIN train USING (id) GROUP BY name)),
binned AS (SELECT id, name, count(*) FILTER (c < x) AS bin FROM xl JOIN cuts USING (name) GROUP BY 1, 2),
bags AS ({" UNION ALL ".join(f"SELECT id, y, {t} AS tree, h{t} AS h FROM train" for t in range(f["num_trees"]))}),
a0 AS (SELECT ids.id, tree, CASE {weight} ELSE {len(G.POISSON)} END AS w, y, 1 AS node FROM ids JOIN bags USING (id)
       UNION ALL SELECT id, tree, 0, 0, 1 FROM ids, range({f["num_trees"]}) t(tree) WHERE id NOT IN (SELECT id FROM train)),
{",".join(levels)},
a_last AS (SELECT * FROM a{last})
{body})""".replace("gini(o, w)", _gini("o", "w")).replace("gini(lo, lw)", _gini("lo", "lw")).replace("gini(o - lo, w - lw)", _gini("(o - lo)", "(w - lw)")))


def _gini(ones: str, weight: str) -> str:
    p = f"({ones} / {weight}::DOUBLE)"
    return f"(1 - {p} * {p} - (1 - {p}) * (1 - {p}))"


def _raw_matrix(p, df):
    """Features as they are, numbers to six decimals, and the dummies of the training levels."""
    m = PR.feature_matrix(df, {}, p.vocabulary, list(NUMERIC), keep=[*KEY, "churn", "split"])
    return m.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in NUMERIC})


def _grown(spark, sf):
    p = _prep(spark, sf)
    X = _raw_matrix(p, p.fit)
    cuts = G.candidate_cuts(X, p.names, CUT_BINS)
    return p, G.grow_forest(X, p.names, "churn", KEY, cuts=cuts, **FOREST)


@query("train_forest__grown", _forest_sql("""
SELECT tree::INTEGER AS tree, node::INTEGER AS node, feature, round(cut, 6) AS cut, round(gain, 6) AS gain, rows::BIGINT AS rows,
       weight::BIGINT AS weight, ones::BIGINT AS ones FROM nodes"""))
def train_forest_grown(spark, sf):
    """Every node of a forest grown level by level, no node of fewer than 40 rows split."""
    return _grown(spark, sf)[1].node_table(spark)


@query("train_forest__scores", _forest_sql(f"""
SELECT {_K}, round(avg(ones / weight::DOUBLE), 6) AS probability
FROM a_last JOIN nodes USING (tree, node) JOIN ids USING (id) JOIN ms USING ({_K}) WHERE split = 'inference' GROUP BY ALL"""))
def train_forest_scores(spark, sf):
    """The inference rows scored by that forest as column expressions."""
    p, forest = _grown(spark, sf)
    X = _raw_matrix(p, p.model_set.where(F.col("split") == "inference"))
    return ML.churn_probability(forest, X).select(*KEY, F.col("p_churn").alias("probability"))
