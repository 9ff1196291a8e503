"""Queries over the prediction and class tables."""

from pyspark.sql import functions as F

from gridloom.operators import verify as V
from gridloom.plans import fixtures as X

_P = X.SQL_PREDICTIONS
_K = "CAST(floor(y_pred * {n} + 1e-9) AS INT)"
_TH = 100


def _sweep_sql(n, extra=""):
    return f"""WITH {_P}, both_ AS (SELECT lead, y_true, y_pred FROM predictions UNION ALL SELECT 0, y_true, y_pred FROM predictions),
c AS (SELECT lead, {_K.format(n=n)} AS k, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM both_ GROUP BY ALL),
g AS (SELECT lead, CAST(k AS INT) AS k FROM (SELECT DISTINCT lead FROM c), (SELECT unnest(range(0, {n} + 1)) AS k)),
w AS (SELECT lead, k, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM g LEFT JOIN c USING (lead, k)),
sweep AS (SELECT lead, k, k / {n}::DOUBLE AS threshold, CAST(sum(pos) OVER a AS BIGINT) AS tp, CAST(sum(neg) OVER a AS BIGINT) AS fp, CAST(sum(pos) OVER p - sum(pos) OVER a AS BIGINT) AS fn, CAST(sum(neg) OVER p - sum(neg) OVER a AS BIGINT) AS tn
  FROM w WINDOW p AS (PARTITION BY lead), a AS (PARTITION BY lead ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)){extra}"""


_E = "1e-10"
_D = "d AS (SELECT lead, k, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, (tp + fp)::DOUBLE * (tp + fn)::DOUBLE / ((tp + fp + fn + tn)::DOUBLE + 1e-10) AS ch FROM sweep)"
_CURVE = f"c2 AS (SELECT lead, k, round(1 - fp / (tp + fp + {_E}), 6) AS precision, round(tp / (tp + fn + {_E}), 6) AS recall, round(fp / (fp + tn + {_E}), 6) AS fpr FROM d)"


def _sweep(s, d, n=_TH):
    return V.confusion_sweep(V.with_overall(X.predictions(s, d)), n, ["lead"])


def _auc_sql(x, y):
    return _sweep_sql(_TH) + f", {_D}, {_CURVE}, t AS (SELECT lead, {x} - lag({x}) OVER o AS dx, ({y} + lag({y}) OVER o) / 2 AS mid FROM c2 WINDOW o AS (PARTITION BY lead ORDER BY {x}, {y})) SELECT lead, round(coalesce(sum(dx * mid), 0), 6) AS auc FROM t GROUP BY lead"


_CL = f"WITH {X.SQL_CLASSES}, both_ AS (SELECT lead, t, p FROM classes UNION ALL SELECT 0, t, p FROM classes), n AS (SELECT lead, t, p, count(*) AS n FROM both_ GROUP BY ALL)"
_Q = "greatest(1e-7, least(1 - 1e-7, y_pred))"
_BCE = f"(-(y_true * ln({_Q}) + (1 - y_true) * ln(1 - {_Q})))"
_W = "(CASE WHEN y_true = 1 THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END)"
_B = "round_even(y_pred, 0)"


def _coalitions(s, d):
    """Subsets of sources: an order's set of kinds of lines, its score the mean discount."""
    rows = X.table(s, d, "lineitem")
    sets = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", (F.col("l_linenumber") % 3).cast("string")))).alias("coalition"), F.avg(F.col("l_discount").cast("double")).alias("score"))
    return sets.groupBy("coalition").agg(F.round(F.avg("score"), 9).alias("score"))


_XI = "row_number() OVER (PARTITION BY lead ORDER BY {0}, id)"
QUERIES = {
    "confusion_sweep": (_sweep, _sweep_sql(_TH) + " SELECT * FROM sweep"),
    "confusion_sweep_fine": (lambda s, d: _sweep(s, d, 1000).drop("threshold"), _sweep_sql(1000) + " SELECT lead, k, tp, fp, fn, tn FROM sweep"),
    "binary_confusion": (lambda s, d: V.binary_confusion(X.predictions(s, d), 0.3), f"WITH {_P} SELECT lead, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), 6) AS {n}" for n, c in {"tp": "y_pred >= 0.3 AND y_true = 1", "fp": "y_pred >= 0.3 AND y_true = 0", "fn": "y_pred < 0.3 AND y_true = 1", "tn": "y_pred < 0.3 AND y_true = 0"}.items()) + " FROM predictions GROUP BY lead"),
    "skill_scores": (
        lambda s, d: V.score_table(_sweep(s, d), ["lead"]),
        _sweep_sql(_TH) + f", {_D} SELECT lead, k, round(tp / (tp + fp + fn + {_E}), 6) AS csi, round(tp / (tp + fn + {_E}), 6) AS pod, round(fp / (tp + fp + {_E}), 6) AS far, round(fp / (fp + tn + {_E}), 6) AS fpr, round((tp - ch) / (tp + fp + fn - ch + {_E}), 6) + 0 AS ets, round(2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + {_E}), 6) + 0 AS hss, round(tp / (tp + fn + {_E}) - fp / (fp + tn + {_E}), 6) + 0 AS pss FROM d",
    ),
    "best_threshold": (lambda s, d: V.best_threshold(_sweep(s, d)), _sweep_sql(_TH) + f", {_D}, s AS (SELECT lead, k, round(tp / (tp + fp + fn + {_E}), 6) AS csi FROM d) SELECT lead, k, csi FROM s QUALIFY row_number() OVER (PARTITION BY lead ORDER BY csi DESC, k) = 1"),
    "best_score_by_lead": (lambda s, d: V.score_table(_sweep(s, d), ["lead"]).groupBy("lead").agg(F.max("hss").alias("hss"), F.max("pss").alias("pss")), _sweep_sql(_TH) + f", {_D} SELECT lead, max(round(2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + {_E}), 6)) AS hss, max(round(tp / (tp + fn + {_E}) - fp / (fp + tn + {_E}), 6)) AS pss FROM d GROUP BY lead"),
    "curve_points": (lambda s, d: V.curve_points(_sweep(s, d), ["lead"]), _sweep_sql(_TH) + f", {_D}, {_CURVE} SELECT * FROM c2"),
    "roc_auc": (lambda s, d: V.area_under(V.curve_points(_sweep(s, d), ["lead"]), "fpr", "recall", ["lead"]), _auc_sql("fpr", "recall")),
    "pr_auc": (lambda s, d: V.area_under(V.curve_points(_sweep(s, d), ["lead"]), "recall", "precision", ["lead"]), _auc_sql("recall", "precision")),
    "sweep_median": (lambda s, d: V.sweep_median(_sweep(s, d)), _sweep_sql(_TH) + " SELECT lead, median(tp) AS tp, median(fp) AS fp, median(fn) AS fn, median(tn) AS tn FROM sweep GROUP BY lead"),
    "reliability": (lambda s, d: V.reliability(X.predictions(s, d), 10, True, ["lead"]), f"WITH {_P}, c AS (SELECT lead, least({_K.format(n=10)}, 9) AS bin, count(*) AS n, avg(y_true) AS rate FROM predictions GROUP BY ALL), g AS (SELECT lead, CAST(b AS INT) AS bin FROM (SELECT DISTINCT lead FROM predictions), (SELECT unnest(range(0, 10)) AS b)) SELECT lead, bin, (bin + 0.5::DOUBLE) / 10 AS centre, coalesce(n, 0) AS n, round(rate, 6) AS rate FROM g LEFT JOIN c USING (lead, bin)"),
    "reliability_open": (lambda s, d: V.reliability(X.predictions(s, d), 10, False, ["lead"]), f"WITH {_P}, c AS (SELECT lead, {_K.format(n=10)} AS bin, count(*) AS n, avg(y_true) AS rate FROM predictions WHERE y_pred < 1 GROUP BY ALL), g AS (SELECT lead, CAST(b AS INT) AS bin FROM (SELECT DISTINCT lead FROM predictions), (SELECT unnest(range(0, 10)) AS b)) SELECT lead, bin, (bin + 0.5::DOUBLE) / 10 AS centre, coalesce(n, 0) AS n, round(coalesce(rate, 0), 6) AS rate FROM g LEFT JOIN c USING (lead, bin)"),
    "calibrated": (
        lambda s, d: V.calibrated(X.predictions(s, d), V.reliability(X.predictions(s, d), 10)),
        f"WITH {_P}, c AS (SELECT least({_K.format(n=10)}, 9) AS bin, round(avg(y_true), 6) AS r FROM predictions GROUP BY 1), g AS (SELECT bin, (bin + 0.5::DOUBLE) / 10 AS centre, r AS r0, lead(r) OVER (ORDER BY bin) AS r1 FROM c), s AS (SELECT id, y_pred, CAST(greatest(0, least(8, floor(y_pred * 10 - 0.5 + 1e-9))) AS INT) AS bin FROM predictions) SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, r0 + (r1 - r0) * (y_pred - centre) * 10)), 6) AS p_cal FROM s JOIN g USING (bin)",
    ),
    "class_confusion": (lambda s, d: V.class_confusion(X.classes(s, d)), _CL + " SELECT lead, t, p, n, round(n / sum(n) OVER (PARTITION BY lead, t), 6) AS share FROM n"),
    "class_scores": (
        lambda s, d: V.class_scores(X.classes(s, d)),
        _CL + ", a AS (SELECT lead, t AS class, sum(n) AS o, sum(n) FILTER (t = p) AS h FROM n GROUP BY ALL), b AS (SELECT lead, p AS class, sum(n) AS o, sum(n) FILTER (t = p) AS h FROM n GROUP BY ALL), f AS (SELECT lead, class, coalesce(coalesce(b.h, 0)::DOUBLE / b.o, 0) AS pr, coalesce(coalesce(a.h, 0)::DOUBLE / a.o, 0) AS re, coalesce(a.o, 0) AS support, coalesce(a.h, 0) AS hit FROM a FULL JOIN b USING (lead, class)) SELECT lead, class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support, round(sum(hit) OVER (PARTITION BY lead)::DOUBLE / sum(support) OVER (PARTITION BY lead), 6) AS accuracy FROM f",
    ),
    "errors_by_lead": (lambda s, d: V.errors_by_lead(X.predictions(s, d)), f"WITH {_P} SELECT lead, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse, round(avg({_BCE}), 6) AS cross_entropy, round(avg(abs({_B} - y_true)), 6) AS binary_error FROM predictions GROUP BY lead"),
    "losses": (lambda s, d: V.losses(X.predictions(s, d)), f"WITH {_P} SELECT lead, round(avg({_W} * pow(1 - (CASE WHEN y_true = 1 THEN {_Q} ELSE 1 - {_Q} END), 2) * {_BCE}), 6) AS focal, round(avg({_W} * {_BCE}), 6) AS weighted_bce, round(avg({_W} * pow(y_pred - y_true, 2)), 6) AS weighted_mse, round((2 * sum(y_true * y_pred) + 1) / (sum(y_true) + sum(y_pred) + 1), 6) AS dice, round(sum(y_true * y_pred) / (sum(y_true) + sum(y_pred) - sum(y_true * y_pred)), 6) AS soft_iou, round(sum(y_true * {_B}) / (sum(y_true) + sum({_B}) - sum(y_true * {_B})), 6) AS iou FROM predictions GROUP BY lead"),
    "banded_loss": (lambda s, d: V.banded_loss(X.predictions(s, d), [1, 2, 3, 5, 8, 13, 21]), f"WITH {_P} SELECT lead, round(avg(([1, 2, 3, 5, 8, 13, 21])[least({_K.format(n=7)}, 6) + 1]::DOUBLE * pow(y_true - y_pred, 2)), 6) AS loss FROM predictions GROUP BY lead"),
    "xi_correlation": (
        lambda s, d: V.xi_correlation(X.predictions(s, d), "y_pred", "y_true", "id", ["lead"]),
        f"WITH {_P}, r AS (SELECT *, {_XI.format('y_true')} AS ry FROM predictions), t AS (SELECT lead, abs(ry - lag(ry) OVER (PARTITION BY lead ORDER BY y_pred, id)) AS st FROM r), u AS (SELECT lead, sum(st)::DOUBLE AS s, count(*)::DOUBLE AS n FROM t GROUP BY lead) SELECT lead, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - s / (2 * n * n / 3))), 6) AS xi FROM u",
    ),
    "xi_published": (
        lambda s, d: V.xi_correlation(X.predictions(s, d), "y_pred", "y_true", "id", ["lead"], "published"),
        f"WITH {_P}, r AS (SELECT *, {_XI.format('y_true')} AS ry FROM predictions), t AS (SELECT lead, abs(ry - lag(ry) OVER (PARTITION BY lead ORDER BY y_pred, id)) AS st FROM r), u AS (SELECT lead, sum(st)::DOUBLE AS s, count(*)::DOUBLE AS n FROM t GROUP BY lead) SELECT lead, round(1 - 3 * s / (n * n - 1), 6) AS xi FROM u",
    ),
    "quantile_map": (
        lambda s, d: V.quantile_map(X.predictions(s, d).withColumn("target", F.sqrt("y_pred")), "y_pred", "target", ["lead"]),
        f"WITH {_P}, q AS (SELECT CAST(k AS INT) AS q, k / 20::DOUBLE AS f FROM (SELECT unnest(range(0, 21)) AS k)), l AS (SELECT lead, list(y_pred ORDER BY y_pred) AS s, list(sqrt(y_pred) ORDER BY y_pred) AS t, count(*) AS n FROM predictions GROUP BY lead), x AS (SELECT lead, q, s, t, n, f * (n - 1) AS pos, CAST(floor(f * (n - 1)) AS BIGINT) AS lo, CAST(ceil(f * (n - 1)) AS BIGINT) AS hi FROM l, q) SELECT lead, q, round(s[lo + 1] + (pos - lo) * (s[hi + 1] - s[lo + 1]), 6) AS source_q, round(t[lo + 1] + (pos - lo) * (t[hi + 1] - t[lo + 1]), 6) AS target_q FROM x",
    ),
    "monotone_coupling": (
        lambda s, d: V.monotone_coupling(X.predictions(s, d).withColumn("target", F.col("id") % 97 / 97), "y_pred", "target", "id", ["lead"]),
        f"WITH {_P}, s AS (SELECT lead, id, {_XI.format('y_pred')} AS k FROM predictions), t AS (SELECT lead, id % 97 / 97::DOUBLE AS mapped, {_XI.format('id % 97 / 97::DOUBLE')} AS k FROM predictions) SELECT lead, s.id, round(mapped, 6) AS mapped FROM s JOIN t USING (lead, k)",
    ),
    "shapley": (
        lambda s, d: V.shapley(_coalitions(s, d)),
        "WITH o AS (SELECT list_sort(list(DISTINCT l_returnflag || (l_linenumber % 3))) AS c, avg(CAST(l_discount AS DOUBLE)) AS score FROM lineitem GROUP BY l_orderkey), sc AS (SELECT c, round(avg(score), 9) AS score FROM o GROUP BY c), e AS (SELECT c, score, unnest(c) AS source FROM sc), g AS (SELECT e.source, len(e.c) AS k, avg(e.score - sc.score) AS g FROM e JOIN sc ON sc.c = list_filter(e.c, lambda x: x <> e.source) GROUP BY ALL) SELECT source, round(avg(g), 6) AS value, count(*) AS sizes FROM g GROUP BY source",
    ),
    "ensemble_gram": (
        lambda s, d: V.gram_matrix(X.predictions(s, d).select("y_true", F.col("y_pred").alias("a"), F.sqrt("y_pred").alias("b"), F.pow("y_pred", F.lit(2)).alias("c")), ["a", "b", "c"], "y_true").select(*[F.round(x, 6).alias(x) for x in ("a_a", "a_b", "a_c", "b_b", "b_c", "c_c", "a_y_true", "b_y_true", "c_y_true")]),
        f"WITH {_P}, w AS (SELECT y_true, y_pred AS a, sqrt(y_pred) AS b, pow(y_pred, 2) AS c FROM predictions) SELECT " + ", ".join(f"round(avg({x} * {y}), 6) AS {x}_{y}" for x, y in [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"), ("a", "y_true"), ("b", "y_true"), ("c", "y_true")]) + " FROM w",
    ),
}
