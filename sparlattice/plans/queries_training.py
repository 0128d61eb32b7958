"""Training, design and selection queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as col
from ..operators import design
from ..operators import training as tr
from ..tables import table
from .registered import query

_LP = "lp AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * p_retailprice AS p, l_linenumber AS sites FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"), F.col("l_linenumber").alias("sites"))


def _rounded(df, *names, digits=4):
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


_STATS = "count(*) AS n, round(avg(abs({e})), 4) AS mae, round(sqrt(avg(({e}) * ({e}))), 4) AS rmse, round(max(abs({e})), 4) AS max_abs"


@query(f"WITH {_LP} SELECT {_STATS.format(e='y - p')} FROM lp")
def error_stats(spark, sf_dir):
    return _rounded(tr.error_stats(_pairs(spark, sf_dir), F.col("y"), F.col("p")), "mae", "rmse", "max_abs")


@query(f"WITH {_LP} SELECT l_returnflag, {_STATS.format(e='(y - p) / sites')} FROM lp GROUP BY 1")
def error_stats_by_group(spark, sf_dir):
    return _rounded(tr.error_stats(_pairs(spark, sf_dir), F.col("y"), F.col("p"), ["l_returnflag"], F.col("sites")), "mae", "rmse", "max_abs")


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round(pow(n, -0.5) * (SELECT sum(n) / sum(n * pow(n, -0.5)) FROM g), 6) AS weight FROM g""")
def balance_weights(spark, sf_dir):
    return _rounded(tr.balance_weights(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], 0.5), "weight", digits=6)


@query("SELECT o_orderstatus, o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, round(max(o_totalprice) - min(o_totalprice), 4) AS width FROM orders GROUP BY 1, 2")
def energy_span_by_group(spark, sf_dir):
    return _rounded(tr.span(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "width")


_WIDE = "wide AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i))"


@query(f"WITH {_WIDE} SELECT CAST(feature AS INTEGER) AS feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, stddev_pop(x) <= 1e-12 AS constant FROM wide GROUP BY 1")
def column_moments(spark, sf_dir):
    return _rounded(tr.column_moments(table(spark, sf_dir, "embeddings"), "embedding"), "mean", "std", digits=6)


def _gram_sql(weight: str, keys: str = "", on: str = "") -> str:
    return f"""WITH {_WIDE} SELECT {keys} CAST(a.feature AS INTEGER) AS i, CAST(b.feature AS INTEGER) AS j, round(sum({weight} a.x * b.x), 6) AS g
FROM wide a JOIN wide b ON a.vec_id = b.vec_id AND a.feature <= b.feature {on} GROUP BY ALL"""


@query(_gram_sql(""))
def gram_matrix(spark, sf_dir):
    return _rounded(tr.gram_rows(table(spark, sf_dir, "embeddings"), "embedding").drop("fold"), "g", digits=6)


@query(_gram_sql("(1 + a.y) *"))
def weighted_gram(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("w", 1.0 + F.col("label"))
    return _rounded(tr.gram_rows(rows, "embedding", weight="w").drop("fold"), "g", digits=6)


def _folded(spark, sf_dir):
    return tr.folds(table(spark, sf_dir, "embeddings"), "vec_id")


_FOLD = "CAST(CAST('0x' || substr(md5('0:' || {}vec_id), 1, 8) AS BIGINT) % 5 AS INTEGER)"


@query(f"SELECT vec_id, {_FOLD.format('')} AS fold FROM embeddings")
def fold_assignment(spark, sf_dir):
    return _folded(spark, sf_dir).select("vec_id", "fold")


@query(_gram_sql("", f"{_FOLD.format('a.')} AS fold,"))
def fold_gram(spark, sf_dir):
    return _rounded(tr.gram_rows(_folded(spark, sf_dir), "embedding", fold="fold"), "g", digits=6)


_COEF = [((i * 37) % 11 - 5) / 10 for i in range(64)]


@query(f"WITH {_WIDE} SELECT vec_id, round(sum(x * (((feature * 37) % 11) - 5) / 10.0), 6) AS predicted FROM wide GROUP BY 1")
def predict_dot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(col.dot(F.col("embedding"), _COEF), 6).alias("predicted"))


@query(f"""WITH {_LP}, s AS (SELECT l_returnflag, sqrt(avg((y - p) * (y - p))) AS base, sqrt(avg((y - p * 1.01) * (y - p * 1.01))) AS refined FROM lp GROUP BY 1)
SELECT l_returnflag, round(base, 4) AS base, round(refined, 4) AS refined,
CASE WHEN abs(refined - base) <= greatest(1e-6, 1e-8 * abs(base)) THEN 'same' WHEN refined < base THEN 'refined better' ELSE 'base better' END AS verdict FROM s""")
def compare_models_verdict(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    base = tr.error_stats(rows, F.col("y"), F.col("p"), ["l_returnflag"]).withColumnRenamed("rmse", "error")
    refined = tr.error_stats(rows, F.col("y"), F.col("p") * 1.01, ["l_returnflag"]).withColumnRenamed("rmse", "error")
    return _rounded(tr.verdicts(base, refined, "l_returnflag"), "base", "refined")


def _solved(grams: str) -> str:
    """SQL of ridge coefficients: Gauss-Jordan elimination, a column a step, of
    ``gram`` (fold, i, j, g), whose column 64 is X'y."""
    return f"""WITH RECURSIVE {_WIDE},
xy AS (SELECT vec_id, feature, x FROM wide UNION ALL SELECT vec_id, CAST(len(embedding) AS BIGINT), CAST(label AS DOUBLE) FROM embeddings),
own AS (SELECT {_FOLD.format('a.')} AS fold, a.feature AS i, b.feature AS j, sum(a.x * b.x) AS g FROM xy a JOIN xy b ON a.vec_id = b.vec_id WHERE a.feature < 64 GROUP BY ALL),
whole AS (SELECT i, j, sum(g) AS g FROM own GROUP BY ALL),
gram AS ({grams}),
steps AS (SELECT CAST(-1 AS BIGINT) AS k, fold, i, j, g + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM gram
UNION ALL SELECT k + 1, fold, i, j, CASE WHEN i = k + 1 THEN v / corner ELSE v - down * across / corner END FROM
(SELECT *, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY fold, i) AS down, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY fold, j) AS across,
 max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY fold) AS corner FROM steps WHERE k < 63)),
solved AS (SELECT fold, i AS feature, v AS coefficient FROM steps WHERE k = 63 AND j = 64)"""


@query(_solved("SELECT 0 AS fold, i, j, g FROM whole") + " SELECT CAST(feature AS INTEGER) AS feature, round(coefficient, 7) AS coefficient FROM solved")
def ridge_fit(spark, sf_dir):
    b = tr.fit(table(spark, sf_dir, "embeddings"), "embedding", "label", kind="ridge", alpha=1.0)
    return spark.createDataFrame([(i, round(float(c), 7)) for i, c in enumerate(b)], "feature int, coefficient double")


#: Sweeps of coordinate descent in SQL: some ten more than it takes to converge.
_SWEEPS = 60


@query(f"""WITH RECURSIVE {_WIDE},
products AS (SELECT a.feature AS j, b.feature AS i, sum(a.x * b.x) AS g, sum(a.x * a.y) AS xy FROM wide a JOIN wide b USING (vec_id) GROUP BY ALL),
lines AS MATERIALIZED (SELECT j, list(g ORDER BY i) AS g, max(g) FILTER (WHERE i = j) AS own, any_value(xy) AS xy FROM products GROUP BY j),
penalty AS (SELECT 0.01 * count(*) * 0.5 AS p FROM embeddings),
steps AS (SELECT CAST(0 AS BIGINT) AS t, list_transform(generate_series(1, 64), lambda v: 0.0::DOUBLE) AS b
UNION ALL SELECT t + 1, list_transform(b, lambda v, i: CASE WHEN i = j + 1 THEN sign(rho) * greatest(abs(rho) - p, 0) / (own + p) ELSE v END) FROM
(SELECT s.t, s.b, l.j, l.own, l.xy - list_dot_product(l.g, s.b) + l.own * s.b[l.j + 1] AS rho, p FROM steps s JOIN lines l ON l.j = s.t % 64, penalty WHERE s.t < 64 * {_SWEEPS}))
SELECT CAST(i - 1 AS INTEGER) AS feature, round(b[i], 7) AS coefficient FROM (SELECT b FROM steps WHERE t = 64 * {_SWEEPS}), (SELECT unnest(generate_series(1, 64)) AS i)""")
def elasticnet_fit(spark, sf_dir):
    b = tr.fit(table(spark, sf_dir, "embeddings"), "embedding", "label", kind="elasticnet", alpha=0.01, l1_ratio=0.5)
    return spark.createDataFrame([(i, round(float(c), 7)) for i, c in enumerate(b)], "feature int, coefficient double")


@query(_solved("SELECT o.fold, i, j, w.g - o.g AS g FROM whole w JOIN own o USING (i, j)") + f""",
predicted AS (SELECT vec_id, {_FOLD.format('')} AS fold, y, sum(x * coefficient) AS p FROM wide JOIN solved ON solved.fold = {_FOLD.format('')} AND solved.feature = wide.feature GROUP BY ALL)
SELECT fold, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(max(abs(y - p)), 6) AS max_abs FROM predicted GROUP BY fold""")
def cv_stats(spark, sf_dir):
    rows = tr.cross_validated(tr.folds(table(spark, sf_dir, "embeddings"), "vec_id"), "embedding", "label", kind="ridge", alpha=1.0)
    return _rounded(tr.error_stats(rows, F.col("label"), F.col("predicted"), ["fold"]), "mae", "rmse", "max_abs", digits=6)


# Determinant and inverse by elimination; extreme singular values by repeated squaring of the matrix and of its inverse.
@query(f"""WITH RECURSIVE {_WIDE},
scaled AS (SELECT vec_id, feature, sqrt(1 + y) * x AS x FROM wide),
moments AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM scaled GROUP BY feature),
z AS MATERIALIZED (SELECT vec_id, feature, (x - mean) / CASE WHEN std <= 1e-9 THEN 1 ELSE std END AS z FROM scaled JOIN moments USING (feature)),
gram AS MATERIALIZED (SELECT a.feature AS i, b.feature AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
beside AS (SELECT i, j, v FROM gram UNION ALL SELECT a.feature, b.feature + 64, CASE WHEN a.feature = b.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM moments a, moments b),
steps AS (SELECT CAST(-1 AS BIGINT) AS k, i, j, v FROM beside
UNION ALL SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN v / corner ELSE v - down * across / corner END FROM
(SELECT *, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY i) AS down, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY j) AS across,
 max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER () AS corner FROM steps WHERE k < 63)),
inverse AS MATERIALIZED (SELECT i, j - 64 AS j, v FROM steps WHERE k = 63 AND j >= 64),
pivots AS (SELECT sum(ln(v)) AS logdet FROM steps WHERE i = k + 1 AND j = k + 1),
starts AS (SELECT 'max' AS kind, i, j, v FROM gram UNION ALL SELECT 'min', i, j, v FROM inverse),
squares AS (SELECT kind, 0 AS k, i, j, v / max(abs(v)) OVER (PARTITION BY kind) AS v FROM starts
UNION ALL SELECT kind, k + 1, i, j, v / max(abs(v)) OVER (PARTITION BY kind) FROM (SELECT a.kind, a.k, a.i, b.j, sum(a.v * b.v) AS v FROM squares a JOIN squares b ON a.kind = b.kind AND a.j = b.i WHERE a.k < 24 GROUP BY ALL)),
vectors AS (SELECT s.kind, s.i, s.v FROM squares s JOIN (SELECT kind, max_by(i, v) AS c FROM squares WHERE k = 24 AND i = j GROUP BY kind) d ON d.kind = s.kind AND s.j = d.c WHERE s.k = 24),
values AS (SELECT a.kind, sum(a.v * s.v * b.v) / any_value(n.n) AS value FROM vectors a JOIN starts s ON s.kind = a.kind AND s.i = a.i JOIN vectors b ON b.kind = a.kind AND b.i = s.j
 JOIN (SELECT kind, sum(v * v) AS n FROM vectors GROUP BY kind) n ON n.kind = a.kind GROUP BY a.kind),
sigmas AS (SELECT sqrt(max(value) FILTER (WHERE kind = 'max')) AS high, 1 / sqrt(max(value) FILTER (WHERE kind = 'min')) AS low FROM values),
leverages AS (SELECT a.vec_id, sum(a.z * v * b.z) AS h FROM z a JOIN inverse ON i = a.feature JOIN z b ON b.vec_id = a.vec_id AND b.feature = j GROUP BY a.vec_id)
SELECT (SELECT count(*) FROM embeddings) AS n_samples, CAST(64 AS BIGINT) AS n_features, CAST(64 AS BIGINT) AS rank, round(high, 6) AS sigma_max, round(low, 6) AS sigma_min, round(high / low, 6) AS condition_number, round(logdet, 6) AS logdet_xtx,
 (SELECT round(64.0::DOUBLE / count(*), 9) FROM embeddings) AS leverage_mean, (SELECT round(max(h), 9) FROM leverages) AS leverage_max, (SELECT round(quantile_cont(h, 0.95), 9) FROM leverages) AS leverage_p95,
 (SELECT count(*) FROM moments WHERE std <= 1e-9) AS zero_variance_features, TRUE AS weighting_applied, TRUE AS standardized FROM sigmas, pivots""")
def design_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("w", 1.0 + F.col("label"))
    out = design.metrics_frame(spark, design.design_metrics(rows, "embedding", "w"))
    out = _rounded(out, "sigma_max", "sigma_min", "condition_number", "logdet_xtx", digits=6)
    return _rounded(out, "leverage_mean", "leverage_max", "leverage_p95", digits=9)


#: As many as the budget, so that no larger table has more endpoints than picks.
_ENDPOINTS = list(range(0, 2000, 100))


def _pools(spark, sf_dir):
    """One design a label, as each composition's samples are one pool."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    codes = F.transform("embedding", lambda v: F.rint(v.cast("double") * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("pool"), F.col("vec_id").alias("id"), F.col("vec_id").isin(_ENDPOINTS).alias("is_seed"), F.col("label").cast("string").alias("grp"),
        F.floor(F.col("embedding")[0] * 10).cast("long").alias("bin"), col.occ_hash(codes).alias("occ_hash"), x.alias("x"),
    )


@query()
def dopt_select(spark, sf_dir):
    return design.select_d_optimal(_pools(spark, sf_dir), 20)


@query(f"SELECT CAST(label AS BIGINT) AS pool, count(*) AS n_candidates, count(DISTINCT label) AS n_groups, CAST(max(len(embedding)) AS INTEGER) AS p, count(*) FILTER (WHERE vec_id IN ({', '.join(map(str, _ENDPOINTS))})) AS seed_size FROM embeddings GROUP BY 1")
def selection_sizes(spark, sf_dir):
    return design.selection_sizes(_pools(spark, sf_dir))


#: Coefficients of stored models, by model and the fold that they leave out (-1: none). Fixed values.
_STORED = """stored_models AS (SELECT m AS model, CASE WHEN f >= 0 THEN f END AS fold, feature, ((feature * 37 + m * 5 + (f + 1) * 3) % 11 - 5) / 100.0 AS c FROM
 (SELECT CAST(unnest(generate_series(0, 2)) AS INTEGER) AS m), (SELECT CAST(unnest(generate_series(-1, 4)) AS INTEGER) AS f), (SELECT CAST(unnest(generate_series(0, 63)) AS INTEGER) AS feature))"""


def _stored_models(spark):
    rows = [(m, f if f >= 0 else None, [((i * 37 + m * 5 + (f + 1) * 3) % 11 - 5) / 100 for i in range(64)]) for m in range(3) for f in range(-1, 5)]
    return spark.createDataFrame(rows, "model int, fold int, coefficients array<double>")


_VERIFIED = f"""WITH {_WIDE}, {_STORED},
dots AS (SELECT vec_id, s.model, coalesce(s.fold, -1) AS fold, any_value(y) AS y, sum(x * c) AS p FROM wide w JOIN stored_models s ON s.feature = w.feature AND s.model = w.vec_id % 3 GROUP BY ALL),
parts AS (SELECT model, 'in_sample' AS part, CAST(y AS INTEGER) AS grp, (y - p) / 4 AS e FROM dots WHERE fold = -1
UNION ALL SELECT model, 'cv', CAST(y AS INTEGER), (y - p) / 4 FROM dots WHERE fold = {_FOLD.format('')}),
now AS (SELECT model, part, CASE WHEN grouping(grp) = 1 THEN 'all' ELSE 'group' END AS scope, grp, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, max(abs(e)) AS max_abs FROM parts GROUP BY GROUPING SETS ((model, part, grp), (model, part)))
SELECT model, part, scope, grp, n, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(max_abs, 9) AS max_abs,
CASE WHEN scope = 'group' AND grp = 7 THEN 'not stored' WHEN model = 1 AND part = 'cv' THEN 'differs' ELSE 'same' END AS verdict FROM now"""


@query(_VERIFIED)
def verified_models(spark, sf_dir):
    """Three stored models verified at once: their figures as they were stored, but for one
    model's cross-validation, which is off by more than the tolerance, and a composition that wasn't stored."""
    rows = _folded(spark, sf_dir).select((F.col("vec_id") % 3).cast("int").alias("model"), F.col("label").cast("int").alias("grp"), "fold", F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"))
    models = _stored_models(spark)
    now = tr.model_statistics(rows, models, 4.0)
    off = F.when((F.col("model") == 1) & (F.col("part") == "cv"), 1e-5).otherwise(1e-7)
    stored = now.where(~F.col("grp").eqNullSafe(F.lit(7))).withColumn("rmse", F.col("rmse") + off)
    return _rounded(tr.verification(stored, rows, models, 4.0).drop("stored_mae", "stored_rmse", "stored_max_abs"), "mae", "rmse", "max_abs", digits=9)
