"""Metrics, calibration, alerting and model comparison over the score view."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import effective_score, r6
from telemill.operators import metrics as mt
from telemill.operators.alerts import AlertPolicy, apply_policy, sticky_alerts
from telemill.operators.joins import lookup
from telemill.operators.runs import step_index
from telemill.operators.series import time_series
from telemill.plans import evaluate as ev
from telemill.sources import views

from .registry import SCORES, query, r

KEYS = ["model_name", "run_id", "segment_id"]


def scored(spark, folder):
    s = views.scores(spark, folder)
    series = time_series(s, KEYS)
    return step_index(s, series), series


def hits(df, cut=0.5):
    return df.withColumn("predicted", (F.col("leak_score") >= cut).cast("int"))


@query("confusion_matrix", "A11", f"""
WITH {SCORES} SELECT model_name, target AS actual, CASE WHEN leak_score >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM scores GROUP BY ALL""")
def confusion_matrix(spark, folder):
    s = hits(views.scores(spark, folder)).withColumnRenamed("target", "actual")
    return mt.confusion(s, "actual", "predicted", ["model_name"])


_CELLS = """
cells AS (
  SELECT model_name, c.class, count(*) FILTER (WHERE (target = c.class) AND (hit = c.class)) AS tp,
         count(*) FILTER (WHERE (target <> c.class) AND (hit = c.class)) AS fp, count(*) FILTER (WHERE (target = c.class) AND (hit <> c.class)) AS fn
  FROM (SELECT *, CASE WHEN leak_score >= 0.5 THEN 1 ELSE 0 END AS hit FROM scores), (SELECT 0 AS class UNION ALL SELECT 1) c GROUP BY ALL),
prf AS (
  SELECT model_name, class, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, tp + fn AS support FROM cells),
rep AS (SELECT *, coalesce(2 * p * rc / nullif(p + rc, 0), 0) AS f FROM prf),
report AS (
  SELECT model_name, CAST(class AS VARCHAR) AS class, p AS precision, rc AS recall, f AS f1, support FROM rep
  UNION ALL SELECT model_name, 'macro avg', avg(p), avg(rc), avg(f), sum(support) FROM rep GROUP BY model_name
  UNION ALL SELECT model_name, 'weighted avg', sum(p * support) / sum(support), sum(rc * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM rep GROUP BY model_name)"""


@query("classification_report", "A12", f"""
WITH {SCORES}, {_CELLS} SELECT model_name, class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM report""")
def classification_report(spark, folder):
    rep = mt.classification_report(hits(views.scores(spark, folder)), "target", "predicted", ["model_name"])
    return rep.select("model_name", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("report_transposed", "R2", f"""
WITH {SCORES}, {_CELLS}, long AS (SELECT model_name, class, 'precision' AS metric, precision AS v FROM report UNION ALL SELECT model_name, class, 'recall', recall FROM report UNION ALL SELECT model_name, class, 'f1', f1 FROM report)
SELECT model_name, metric, {', '.join(r(f"max(CASE WHEN class = '{c}' THEN v END)", n) for c, n in [('0', 'normal'), ('1', 'leak'), ('macro avg', 'macro'), ('weighted avg', 'weighted')])}
FROM long GROUP BY model_name, metric""")
def report_transposed(spark, folder):
    rep = mt.classification_report(hits(views.scores(spark, folder)), "target", "predicted", ["model_name"])
    t = mt.transpose_report(rep, ["model_name"])
    return t.select("model_name", "metric", *[r6(F.col(f"`{c}`")).alias(n) for c, n in
                    [("0", "normal"), ("1", "leak"), ("macro avg", "macro"), ("weighted avg", "weighted")]])


_ROC = """
pts AS (SELECT model_name, leak_score, sum(target) AS pos, sum(1 - target) AS neg FROM scores GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY model_name ORDER BY leak_score DESC) AS tp, sum(neg) OVER (PARTITION BY model_name ORDER BY leak_score DESC) AS fp,
               sum(pos) OVER (PARTITION BY model_name) AS p, sum(neg) OVER (PARTITION BY model_name) AS n FROM pts),
roc AS (SELECT model_name, leak_score, fp / n AS fpr, tp / p AS tpr, coalesce(lag(fp / n) OVER (PARTITION BY model_name ORDER BY leak_score DESC), 0) AS fpr0,
               coalesce(lag(tp / p) OVER (PARTITION BY model_name ORDER BY leak_score DESC), 0) AS tpr0 FROM cum),
auc AS (SELECT model_name, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc_auc FROM roc GROUP BY model_name)"""


@query("roc_auc_exact", "A13", f"WITH {SCORES}, {_ROC} SELECT model_name, {r('roc_auc', 'roc_auc')} FROM auc")
def roc_auc_exact(spark, folder):
    return mt.roc_auc(views.scores(spark, folder), "leak_score", "target", ["model_name"]).select(
        "model_name", r6("roc_auc").alias("roc_auc"))


@query("roc_curve", "A13", f"WITH {SCORES}, {_ROC} SELECT model_name, {r('leak_score', 'threshold')}, {r('fpr', 'fpr')}, {r('tpr', 'tpr')} FROM roc")
def roc_curve(spark, folder):
    out = mt.roc_curve(views.scores(spark, folder), "leak_score", "target", ["model_name"])
    return out.select("model_name", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def bundle_sql(source: str, keys: str) -> str:
    """Metric bundle per ``keys`` as SQL over a table of (keys, target, leak_score)."""
    return f"""
h AS (SELECT {keys}, target, leak_score, leak_score >= 0.5 AS hit FROM {source}),
c AS (SELECT {keys}, count(*) FILTER (WHERE target = 1 AND hit) AS tp, count(*) FILTER (WHERE target = 0 AND hit) AS fp,
             count(*) FILTER (WHERE target = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE target = 0 AND NOT hit) AS tn FROM h GROUP BY {keys}),
g AS (SELECT {keys}, leak_score, sum(target) AS pos, sum(1 - target) AS neg FROM {source} GROUP BY {keys}, leak_score),
w AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY leak_score) - neg / 2 AS below FROM g),
u AS (SELECT {keys}, sum(pos * below) / nullif(sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY {keys}),
q AS (SELECT c.*, auc, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM c JOIN u USING ({keys})),
bundle AS (SELECT {keys}, {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy', 4)}, {r('p', 'precision', 4)}, {r('rc', 'recall', 4)},
                  {r('coalesce(2 * p * rc / nullif(p + rc, 0), 0)', 'f1', 4)}, {r('auc', 'roc_auc', 4)}, tn, fp, fn, tp FROM q)"""


@query("binary_metric_bundle", "A14", f"WITH {SCORES}, {bundle_sql('scores', 'model_name')} SELECT * FROM bundle")
def binary_metric_bundle(spark, folder):
    return mt.binary_metrics(views.scores(spark, folder), "leak_score", "target", ["model_name"])


_FOLDED = "folded AS (SELECT *, CAST(segment_id % 5 AS INTEGER) AS fold FROM scores)"


def folded(spark, folder):
    return views.scores(spark, folder).withColumn("fold", (F.col("segment_id") % 5).cast("int"))


@query("out_of_fold_metrics", "V10", f"""
WITH {SCORES}, {_FOLDED}, {bundle_sql('folded', 'model_name, fold')} SELECT * FROM bundle""")
def out_of_fold_metrics(spark, folder):
    return mt.binary_metrics(folded(spark, folder), "leak_score", "target", ["model_name", "fold"])


@query("cross_validation_summary", "A15", f"""
WITH {SCORES}, {_FOLDED}, {bundle_sql('folded', 'model_name, fold')}
SELECT model_name, {', '.join(r(f'avg({c})', f'{c}_cv_mean', 4) + ', ' + r(f'stddev_pop({c})', f'{c}_cv_std', 4) for c in mt.CV_KEYS)} FROM bundle GROUP BY model_name""")
def cross_validation_summary(spark, folder):
    return mt.fold_summary(mt.binary_metrics(folded(spark, folder), "leak_score", "target", ["model_name", "fold"]), ["model_name"])


@query("fold_sizes", "A16", f"""
WITH {SCORES}, {_FOLDED}, f AS (SELECT fold, count(*) AS n, count(DISTINCT run_id) AS g FROM folded GROUP BY fold),
s AS (SELECT sum(n) AS r, sum(g) AS g, count(*) AS k FROM f)
SELECT CAST(round(r - r / k) AS BIGINT) AS avg_train_rows, CAST(round(r / k) AS BIGINT) AS avg_test_rows,
       CAST(round(g - g / k) AS BIGINT) AS avg_train_scenarios, CAST(round(g / k) AS BIGINT) AS avg_test_scenarios FROM s""")
def fold_sizes(spark, folder):
    return mt.fold_sizes(folded(spark, folder), "fold", "run_id")


_V1 = "v1 AS (SELECT model_name, scenario_key, avg(CASE WHEN leak_score >= thr THEN 1.0 ELSE 0.0 END) AS fpr FROM t WHERE target = 0 GROUP BY ALL)"
_V2 = """
onset AS (SELECT model_name, run_id, min(step) AS onset FROM t WHERE scenario_key = 'slow_seep' AND target = 1 GROUP BY ALL),
found AS (SELECT o.model_name, o.run_id, o.onset, min(t.step) AS found FROM onset o LEFT JOIN t ON t.model_name = o.model_name AND t.run_id = o.run_id
          AND t.step >= o.onset AND t.leak_score >= t.thr GROUP BY ALL),
v2 AS (SELECT model_name, avg(found - onset) AS delay, avg(CASE WHEN found IS NULL THEN 0.0 ELSE 1.0 END) AS detection_rate FROM found GROUP BY model_name)"""
_V3 = """
v3 AS (SELECT model_name, coalesce(avg(CASE WHEN leak_score >= thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE target = 1 AND leak_severity < 0.3),
                                   avg(CASE WHEN leak_score >= thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE target = 1 AND scenario_key = 'micro_leak')) AS sensitivity FROM t GROUP BY model_name)"""
_V4 = """
flip AS (SELECT model_name, run_id, target, abs(CASE WHEN leak_score >= thr THEN 1 ELSE 0 END - lag(CASE WHEN leak_score >= thr THEN 1 ELSE 0 END)
                OVER (PARTITION BY model_name, run_id ORDER BY step)) AS flip FROM t),
per_run AS (SELECT model_name, run_id, coalesce(sum(flip), 0) / count(*) AS rate FROM flip GROUP BY ALL HAVING max(target) = 1),
v4 AS (SELECT model_name, avg(rate) AS toggle_rate FROM per_run GROUP BY model_name)"""
_FIXED = "t AS (SELECT *, 0.5 AS thr FROM steps)"
_V6 = """
ceil_ AS (SELECT model_name, quantile_cont(leak_score, 0.95) FILTER (WHERE scenario_key = 'steady_state') AS ss,
                 quantile_cont(leak_score, 0.9) FILTER (WHERE scenario_key = 'demand_shock') AS ds FROM scores GROUP BY model_name),
v6 AS (SELECT model_name, round(greatest(0.02, least(0.85, (0.7 * coalesce(ss, 0) + 0.3 * coalesce(ds, 0)) * 1.10 + 0.005)), 4) AS threshold FROM ceil_)"""


def fixed(spark, folder):
    s, series = scored(spark, folder)
    return ev.with_threshold(s, 0.5), series


@query("false_positive_rates", "V1", f"WITH {SCORES}, {_FIXED}, {_V1} SELECT model_name, scenario_key, {r('fpr', 'fpr')} FROM v1")
def false_positive_rates(spark, folder):
    return ev.false_positive_rates(fixed(spark, folder)[0]).select("model_name", "scenario_key", r6("fpr").alias("fpr"))


@query("detection_delay", "V2", f"WITH {SCORES}, {_FIXED}, {_V2} SELECT model_name, {r('delay', 'delay')}, {r('detection_rate', 'detection_rate')} FROM v2")
def detection_delay(spark, folder):
    return ev.detection(fixed(spark, folder)[0]).select("model_name", r6("delay").alias("delay"), r6("detection_rate").alias("detection_rate"))


@query("micro_leak_sensitivity", "V3", f"WITH {SCORES}, {_FIXED}, {_V3} SELECT model_name, {r('sensitivity', 'sensitivity')} FROM v3")
def micro_leak_sensitivity(spark, folder):
    return ev.micro_sensitivity(fixed(spark, folder)[0]).select("model_name", r6("sensitivity").alias("sensitivity"))


@query("alert_stability", "V4", f"WITH {SCORES}, {_FIXED}, {_V4} SELECT model_name, {r('toggle_rate', 'toggle_rate')} FROM v4")
def alert_stability(spark, folder):
    s, series = fixed(spark, folder)
    return ev.alert_stability(s, series).select("model_name", r6("toggle_rate").alias("toggle_rate"))


@query("calibrated_thresholds", "V6", f"WITH {SCORES}, {_V6} SELECT * FROM v6")
def calibrated_thresholds(spark, folder):
    return ev.calibrate(views.scores(spark, folder))


_TABLE = f"""{SCORES}, {_V6}, t AS (SELECT s.*, v6.threshold AS thr FROM steps s JOIN v6 USING (model_name)), {_V1}, {_V2}, {_V3}, {_V4},
metrics AS (
  SELECT v6.model_name, threshold, (SELECT fpr FROM v1 WHERE v1.model_name = v6.model_name AND scenario_key = 'steady_state') AS fpr_steady_state,
         (SELECT fpr FROM v1 WHERE v1.model_name = v6.model_name AND scenario_key = 'demand_shock') AS fpr_demand_shock,
         delay, detection_rate, sensitivity, toggle_rate
  FROM v6 LEFT JOIN v2 USING (model_name) LEFT JOIN v3 USING (model_name) LEFT JOIN v4 USING (model_name))"""
_METRICS = ["fpr_steady_state", "fpr_demand_shock", "delay", "detection_rate", "sensitivity", "toggle_rate"]


def metric_rows(spark, folder):
    s, series = scored(spark, folder)
    return ev.metric_table(ev.with_threshold(s, ev.calibrate(s)), series)


@query("model_metric_table", "V5", f"WITH {_TABLE} SELECT model_name, threshold, {', '.join(r(c, c) for c in _METRICS)} FROM metrics")
def model_metric_table(spark, folder):
    return metric_rows(spark, folder).select("model_name", "threshold", *[r6(c).alias(c) for c in _METRICS])


@query("leaderboard", "V8", f"""
WITH {_TABLE} SELECT model_name, row_number() OVER (ORDER BY fpr_steady_state, coalesce(delay, 999), model_name) AS rank, {r('delay', 'delay')} FROM metrics""")
def leaderboard(spark, folder):
    return ev.leaderboard(metric_rows(spark, folder)).select("model_name", "rank", r6("delay").alias("delay"))


@query("leaderboard_by_quality", "V8", f"""
WITH {SCORES}, {bundle_sql('scores', 'model_name')}
SELECT model_name, roc_auc, f1, row_number() OVER (ORDER BY roc_auc DESC NULLS LAST, f1 DESC NULLS LAST, model_name) AS rank FROM bundle""")
def leaderboard_by_quality(spark, folder):
    from telemill.operators.metrics import binary_metrics

    metrics = binary_metrics(views.scores(spark, folder), "leak_score", "target", ["model_name"])
    return ev.rank_by_quality(metrics).select("model_name", "roc_auc", "f1", "rank")


@query("threshold_lookup", "V13", f"""
WITH {SCORES}, {_V6}, m AS (SELECT DISTINCT model_name FROM scores UNION ALL SELECT DISTINCT event_type FROM events)
SELECT model_name, coalesce(threshold, 0.5) AS threshold FROM m LEFT JOIN v6 USING (model_name)""")
def threshold_lookup(spark, folder):
    s = views.scores(spark, folder)
    kinds = views.table(spark, folder, "events").select(F.col("event_type").alias("model_name")).distinct()
    return ev.thresholds_for(s.select("model_name").distinct().union(kinds), ev.calibrate(s))


_SUMMARY = """
per AS (SELECT o_orderpriority AS run, o_orderstatus AS model, round(avg(o_totalprice) / 500000.0, 4) AS auc, round(max(o_totalprice) / 1000000.0, 4) AS acc,
               round(min(o_totalprice) / 5000.0, 4) AS f1 FROM orders GROUP BY ALL)"""


def summaries(spark, folder):
    """Run summaries as JSON text, one per order priority, each with a map of models; parsed back to columns."""
    o = views.table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.round(F.avg("o_totalprice") / 500000.0, 4).alias("roc_auc"), F.round(F.max("o_totalprice") / 1000000.0, 4).alias("accuracy"),
        F.round(F.min("o_totalprice") / 5000.0, 4).alias("f1_score"))
    packed = o.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct(
        "o_orderstatus", F.struct("roc_auc", "accuracy", "f1_score")))).alias("models"))
    text = packed.select(F.concat(F.lit("runs/"), "o_orderpriority", F.lit("/summary.json")).alias("path"),
                         F.to_json(F.struct(F.col("o_orderpriority").alias("run_label"), "models")).alias("json"))
    schema = f"run_label string, best_model struct<name: string>, models {ev.SUMMARY_MODELS}"
    parsed = text.select("path", F.from_json("json", schema).alias("s"))
    return parsed.select("path", "s.run_label", F.col("s.best_model.name").alias("best_model"), "s.models")


@query("compare_runs", "V9 T5", f"""
WITH {_SUMMARY} SELECT run AS run_label, model, auc AS roc_auc, acc AS accuracy, f1,
       row_number() OVER (PARTITION BY run ORDER BY auc DESC, model) = 1 AS is_best_model FROM per""")
def compare_runs(spark, folder):
    s = summaries(spark, folder)
    return ev.compare_runs(s.union(s)).select("run_label", "model", "roc_auc", "accuracy", "f1", "is_best_model")


@query("harvest_metrics", "V14", f"""
WITH {_SUMMARY} SELECT model, round(max_by(auc, run), 3) AS roc_auc, round(max_by(f1, run), 3) AS f1 FROM per GROUP BY model""")
def harvest_metrics(spark, folder):
    return ev.harvest_metrics(summaries(spark, folder))


@query("visible_models", "V11", f"""
WITH {SCORES}, {_FOLDED}, {bundle_sql('folded', 'model_name, fold')} SELECT model_name, fold, roc_auc FROM bundle WHERE coalesce(roc_auc, 1) >= 0.5""")
def visible_models(spark, folder):
    b = mt.binary_metrics(folded(spark, folder), "leak_score", "target", ["model_name", "fold"])
    return ev.visible_models(b, 0.5).select("model_name", "fold", "roc_auc")


@query("baseline_gap", "J10", f"""
WITH {SCORES}, {_FOLDED}, {bundle_sql('folded', 'model_name, fold')}
SELECT b.model_name, b.fold, b.roc_auc, s.roc_auc AS source_roc_auc, {r('b.roc_auc - s.roc_auc', 'auc_gap')}
FROM bundle b LEFT JOIN (SELECT model_name, roc_auc FROM bundle WHERE fold = 0 AND model_name = 'a') s USING (model_name)""")
def baseline_gap(spark, folder):
    b = mt.binary_metrics(folded(spark, folder), "leak_score", "target", ["model_name", "fold"])
    base = b.where((F.col("fold") == 0) & (F.col("model_name") == "a"))
    out = ev.baseline_gap(b.select("model_name", "fold", "roc_auc"), base)
    return out.select("model_name", "fold", "roc_auc", "source_roc_auc", r6("auc_gap").alias("auc_gap"))


def policy_cte(source: str, mode: str = "persistence") -> str:
    """The alert policy as a recursive CTE over (model_name, run_id, segment_id, seq, step, target, above)."""
    bits = "(((hist * 2) % 32) + CASE WHEN o.above THEN 1 ELSE 0 END)"
    count = " + ".join(f"((({bits}) // {2**i}) % 2)" for i in range(5))
    ready = "p.cooling = 0 AND NOT p.waiting"
    if mode == "persistence":
        fire = f"({ready} AND o.above AND p.streak + 1 >= 3)"
    else:
        fire = f"({ready} AND ({count.replace('hist', 'p.hist')}) >= 3)"
    bits = bits.replace("hist", "p.hist")
    done = "(p.cooling = 0 AND p.waiting AND NOT o.above AND p.below + 1 >= 10)"
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY model_name, run_id, segment_id ORDER BY timestamp, seq) AS rn FROM {source}),
pol AS (
  SELECT DISTINCT model_name, run_id, segment_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, 0 AS target, 0 AS streak, 0 AS cooling, false AS waiting, 0 AS below, 0 AS hist, false AS alert FROM o
  UNION ALL
  SELECT o.model_name, o.run_id, o.segment_id, o.rn, o.seq, o.target,
         CASE WHEN {fire} OR {done} THEN 0 WHEN {ready} THEN CASE WHEN o.above THEN p.streak + 1 ELSE 0 END ELSE p.streak END,
         CASE WHEN {fire} THEN 10 WHEN p.cooling > 0 THEN p.cooling - 1 ELSE 0 END,
         CASE WHEN {fire} THEN true WHEN {done} THEN false ELSE p.waiting END,
         CASE WHEN {fire} OR {done} THEN 0 WHEN p.cooling = 0 AND p.waiting THEN CASE WHEN o.above THEN 0 ELSE p.below + 1 END ELSE p.below END,
         CASE WHEN {fire} THEN 0 ELSE {bits} END,
         {fire}
  FROM pol p JOIN o ON o.model_name = p.model_name AND o.run_id = p.run_id AND o.segment_id = p.segment_id AND o.rn = p.rn + 1),
fired AS (SELECT * FROM pol WHERE rn > 0)"""


_ABOVE = "ab AS (SELECT *, leak_score >= 0.4 AS above FROM scores)"

@query("alerts_persistence", "P1", f"WITH RECURSIVE {SCORES}, {_ABOVE}, {policy_cte('ab')} SELECT model_name, seq, alert AS model_alert FROM fired")
def alerts_persistence(spark, folder):
    s = views.scores(spark, folder)
    return apply_policy(s, time_series(s, KEYS), AlertPolicy(threshold=0.4)).select("model_name", "seq", "model_alert")


@query("alerts_confirmation", "P2", f"WITH RECURSIVE {SCORES}, {_ABOVE}, {policy_cte('ab', 'confirmation')} SELECT model_name, seq, alert AS model_alert FROM fired")
def alerts_confirmation(spark, folder):
    s = views.scores(spark, folder)
    return apply_policy(s, time_series(s, KEYS), AlertPolicy(threshold=0.4, mode="confirmation")).select("model_name", "seq", "model_alert")


_CONTEXT = "CASE WHEN seq % 3 = 0 THEN 'leak_progression' ELSE 'nominal' END"
_GATED = f"""
hist AS (SELECT segment_id, timestamp, leak_severity AS sev, {_CONTEXT} AS ctx FROM telemetry WHERE event_type <> 'view'),
gated AS (SELECT s.*, CASE WHEN sev IS NULL THEN leak_score WHEN ctx LIKE '%leak%' THEN CASE WHEN sev >= 0.03 THEN leak_score ELSE 0.0 END
                 WHEN sev >= 0.55 THEN leak_score ELSE 0.0 END AS effective FROM scores s LEFT JOIN hist h ON h.segment_id = s.segment_id AND h.timestamp = s.timestamp)"""


def gated(spark, folder):
    t = views.telemetry(spark, folder).where(F.col("event_type") != "view")
    hist = t.select("segment_id", "timestamp", "seq", F.col("leak_severity").alias("sev"),
                    F.when(F.col("seq") % 3 == 0, "leak_progression").otherwise("nominal").alias("ctx"))
    s = lookup(views.scores(spark, folder), hist, ["segment_id", "timestamp"], ["seq"], ["sev", "ctx"])
    return s.withColumn("effective", effective_score(F.col("leak_score"), F.col("sev"), F.col("ctx")))


@query("effective_scores", "D30 J4", f"WITH {SCORES}, {_GATED} SELECT model_name, seq, {r('effective', 'effective')} FROM gated")
def effective_scores(spark, folder):
    return gated(spark, folder).select("model_name", "seq", r6("effective").alias("effective"))


_P3 = f"{SCORES}, {_GATED}, ab AS (SELECT *, effective >= 0.2 AS above FROM gated), {policy_cte('ab')}"


def gated_alerts(spark, folder):
    g = gated(spark, folder)
    return apply_policy(g, time_series(g, KEYS), AlertPolicy(threshold=0.2), score="effective")


@query("alerts_gated", "P3", f"WITH RECURSIVE {_P3} SELECT model_name, seq, alert AS model_alert FROM fired")
def alerts_gated(spark, folder):
    return gated_alerts(spark, folder).select("model_name", "seq", "model_alert")


@query("alerts_sticky", "P9 W29", f"""
WITH RECURSIVE {SCORES}, {_ABOVE}, {policy_cte('ab')},
z AS (SELECT f.*, s.leak_score, row_number() OVER (PARTITION BY f.model_name, f.segment_id ORDER BY f.rn DESC) AS back FROM fired f JOIN scores s USING (model_name, seq))
SELECT model_name, segment_id, count(*) AS alerts, {r('max_by(leak_score, rn)', 'leak_score')} FROM z WHERE back <= 30 AND alert GROUP BY ALL""")
def alerts_sticky(spark, folder):
    s = views.scores(spark, folder)
    fired = apply_policy(s, time_series(s, KEYS), AlertPolicy(threshold=0.4))
    out = sticky_alerts(fired, ["model_name", "segment_id"], ["timestamp", "seq"])
    return out.select("model_name", "segment_id", "alerts", r6("leak_score").alias("leak_score"))


@query("policy_toggle_rates", "V7", f"""
WITH RECURSIVE {SCORES}, ab AS (SELECT *, leak_score >= 0.5 AS above FROM scores), {policy_cte('ab')},
tog AS (SELECT model_name, run_id, target, alert, abs(CAST(alert AS INTEGER) - lag(CAST(alert AS INTEGER)) OVER (PARTITION BY model_name, run_id ORDER BY rn)) AS flip FROM fired),
tr AS (SELECT model_name, run_id, coalesce(sum(flip), 0) / count(*) AS rate FROM tog GROUP BY ALL HAVING max(target) = 1),
{_FIXED}, {_V4}
SELECT model_name, {r('v4.toggle_rate', 'raw_toggle_rate')}, {r('avg(rate)', 'policy_toggle_rate')} FROM tr JOIN v4 USING (model_name) GROUP BY model_name, v4.toggle_rate""")
def policy_toggle_rates(spark, folder):
    s, series = fixed(spark, folder)
    out = ev.policy_stability(s, series)
    return out.select("model_name", r6("raw_toggle_rate").alias("raw_toggle_rate"), r6("policy_toggle_rate").alias("policy_toggle_rate"))


@query("incremental_scores", "P6", f"""
WITH {SCORES} SELECT model_name, seq, {r("CASE WHEN target = 1 THEN leak_score ELSE leak_score / 2 END", 'leak_score')} FROM scores""")
def incremental_scores(spark, folder):
    from telemill.operators.joins import latest_per_key, matching, missing

    s = views.scores(spark, folder)
    key = ["model_name", "segment_id", "timestamp", "seq"]
    cached = s.where(F.col("target") == 1).select(*key, "leak_score")
    current = s.select(*key)
    fresh = missing(s, cached, key).select(*key, (F.col("leak_score") / 2).alias("leak_score"))
    merged = matching(cached, current, key).withColumn("arrival", F.lit(0)).unionByName(fresh.withColumn("arrival", F.lit(1)))
    return latest_per_key(merged, key, ["arrival"]).select("model_name", "seq", r6("leak_score").alias("leak_score"))
