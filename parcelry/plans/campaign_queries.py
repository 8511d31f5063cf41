"""E: campaigns and metrics; F: costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as c
from ..operators import costs, metrics
from ..sources import store
from . import fixtures as fx
from .registry import R, query

EX = ["model", *costs.EXPERIMENT]
KEYS = "model, train_size, resolution, split"


def joined(spark, d, model="a"):
    """pid, tile_id (resolution 10), prob, label of one model."""
    rows = fx.preds(spark, d).select("pid", F.col(f"prob_{model}").alias("prob"), "label")
    return rows.join(fx.tiles10(spark, d).select("pid", "tile_id"), "pid").select("pid", "tile_id", "prob", "label")


def test_rows(spark, d):
    return fx.predictions(spark, d).filter("role = 'test'").join(fx.labels(spark, d), "pid").select(*EX, "pid", "prob", "label")


def campaigns(spark, d):
    return costs.dig_data(fx.predictions(spark, d).filter("role = 'test'"), fx.labels(spark, d), fx.tiles(spark, d))


TEST = "(SELECT model, train_size, resolution, split, pid, prob, label FROM test_a)"


@query(f"SELECT {KEYS}, {R('coalesce(sum(label) FILTER (WHERE prob > 0.5e0)::DOUBLE / nullif(count(*) FILTER (WHERE prob > 0.5e0), 0), 0)', 'hit_rate')} FROM {TEST} GROUP BY ALL")
def e1_hit_rate(spark, d):
    return metrics.hit_rate(test_rows(spark, d), EX)


@query(f"SELECT {KEYS}, pid, {R('prob')}, label, row_number() OVER w - 1 AS pos, {R('sum(label) OVER w / (row_number() OVER w)::DOUBLE', 'hit_rate')} FROM {TEST} WINDOW w AS (PARTITION BY {KEYS} ORDER BY prob DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def e2_hit_rate_curve(spark, d):
    return c.hit_rate_curve(test_rows(spark, d), EX)


@query(f"SELECT dig_index AS pos, pid, tile_id, {R('prob')}, label, {R('hit_rate')} FROM campaign_a")
def e3_campaign(spark, d):
    return c.campaign(joined(spark, d)).select(F.col("dig_index").alias("pos"), "pid", "tile_id", "prob", "label", "hit_rate")


@query(f"SELECT {KEYS}, pid, tile_id, {R('prob')}, label, dig_batch, {R('dig_threshold')}, dig_index, {R('hit_rate')} FROM campaigns")
def e4_dig_metadata(spark, d):
    return campaigns(spark, d)


def fold_sql(choose: str, least: int) -> str:
    """A campaign with a minimum of digs, or with tiles chosen by another score, sweep after sweep: what each tile has left is all up to `low`."""
    sweeps = c.schedule(min_digs=least)
    parts = ["src AS MATERIALIZED (SELECT p.pid, t.tile_id, p.label, prob_a AS prob, prob_b FROM preds p JOIN tiles10 t ON p.pid = t.pid)"]
    before = "(SELECT DISTINCT tile_id, 1e9 AS low FROM src)"
    for k, (t, m) in enumerate(sweeps):
        parts.append(
            f"w{k} AS MATERIALIZED (SELECT tile_id, want, want >= greatest({m}, 1) AS fires, CASE WHEN want >= greatest({m}, 1) THEN least(low, {t!r}::DOUBLE) ELSE low END AS low "
            f"FROM (SELECT b.tile_id, b.low, count(r.pid) AS want FROM {before} b LEFT JOIN src r ON r.tile_id = b.tile_id AND r.{choose} > {t!r}::DOUBLE AND r.prob <= b.low GROUP BY b.tile_id, b.low))"
        )
        before = f"w{k}"
    fired = " UNION ALL ".join(f"SELECT {k} AS k, {t!r}::DOUBLE AS t, tile_id, want FROM w{k} WHERE fires" for k, (t, _) in enumerate(sweeps))
    order = "(ORDER BY dig_batch, prob DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    extra = ", prob_b AS tile_prob" if choose != "prob" else ""
    return f"""WITH {", ".join(parts)}, visits AS (SELECT *, row_number() OVER (ORDER BY k, want DESC, tile_id) - 1 AS dig_batch FROM ({fired})),
mine AS (SELECT r.pid, min(k) AS k FROM src r JOIN visits v ON r.tile_id = v.tile_id AND r.prob > v.t GROUP BY r.pid),
dug AS (SELECT r.*, v.dig_batch, v.t FROM src r JOIN mine USING (pid) JOIN visits v ON v.tile_id = r.tile_id AND v.k = mine.k)
SELECT pid, tile_id, {R("prob")}, label{extra.replace("prob_b AS tile_prob", R("prob_b", "tile_prob"))}, dig_batch, {R("t", "dig_threshold")}, row_number() OVER {order} - 1 AS dig_index, {R("sum(label) OVER " + order + " / (row_number() OVER " + order + ")::DOUBLE", "hit_rate")} FROM dug"""


@query(fold_sql("prob", 3))
def e3_campaign_min_digs(spark, d):
    """The campaign with at least 3 digs a visit at first."""
    return c.campaign(joined(spark, d), min_digs=3)


@query(fold_sql("prob_b", 1))
def e5_ablation(spark, d):
    """Tiles chosen by model b's scores, parcels in them dug by model a's."""
    other = fx.preds(spark, d).select("pid", F.col("prob_b").alias("tile_prob"))
    return c.campaign(joined(spark, d).join(other, "pid"), choose="tile_prob")


@query(f"SELECT pid, tile_id, dig_batch, dig_index, {R('prob_b')}, {R('m', 'median_prob')} FROM campaign_a JOIN (SELECT pid, prob_b FROM preds) USING (pid) JOIN (SELECT dig_batch, quantile_cont(prob_b, 0.5) AS m FROM campaign_a JOIN preds USING (pid) GROUP BY dig_batch) USING (dig_batch)")
def e6_visit_medians(spark, d):
    dug = c.campaign(joined(spark, d)).join(fx.preds(spark, d).select("pid", "prob_b"), "pid")
    return c.visit_medians(dug, "prob_b").select("pid", "tile_id", "dig_batch", "dig_index", "prob_b", "median_prob")


@query(f"""SELECT {R('k * (1e0/499)', 'threshold')}, pos, {R('h', 'hit_rate')} FROM (SELECT k, coalesce(max(dig_index), 0) AS pos FROM range(0, 499) t(k) LEFT JOIN campaign_a ON prob > k * (1e0/499) GROUP BY k)
JOIN (SELECT dig_index AS pos, hit_rate AS h FROM campaign_a) USING (pos)""")
def e7_by_threshold(spark, d):
    curve = c.campaign(joined(spark, d)).withColumn("pos", F.col("dig_index"))
    return metrics.curve_by_threshold(curve, n=500)


@query(f"SELECT {KEYS}, pid, dig_index AS pos, {R('100e0 * dig_index / count(*) OVER (PARTITION BY ' + KEYS + ')', 'percent')}, (sum(label) OVER (PARTITION BY {KEYS}))::BIGINT AS n_positive FROM campaigns")
def e8_axes(spark, d):
    curve = campaigns(spark, d).select(*EX, "pid", "label", F.col("dig_index").alias("pos"))
    return metrics.with_axes(curve, EX).drop("label")


@query(f"SELECT 'a' AS model, pid, dig_index, {R('hit_rate')} FROM campaign_a UNION ALL SELECT 'b', pid, dig_index, round(hit_rate, 6) + 0e0 FROM campaign_b")
def e9_every_model(spark, d):
    rows = joined(spark, d).withColumn("model", F.lit("a")).unionByName(joined(spark, d, "b").withColumn("model", F.lit("b")))
    return metrics.every_model(rows, c.campaign, mode="partition").select("model", "pid", "dig_index", "hit_rate")


AUC = "(sum(CASE WHEN label = 1 THEN r END) - np*(np+1)/2e0) / (np*nn)"


@query(f"SELECT {R('(s - np*(np+1)/2e0) / (np*nn)', 'auc')} FROM (SELECT sum(r) FILTER (WHERE label = 1) AS s, (count(*) FILTER (WHERE label = 1))::DOUBLE AS np, (count(*) FILTER (WHERE label = 0))::DOUBLE AS nn FROM (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1)/2e0 AS r FROM scores_big))")
def e10_roc_auc(spark, d):
    return metrics.roc_auc(fx.scores_big(spark, d))


@query(f"SELECT least(floor(prob*10), 9)::BIGINT AS bin, {R('avg(label)', 'mean_label')}, {R('avg(prob)', 'mean_prob')}, count(*) AS n FROM scores_big GROUP BY 1")
def e11_calibration(spark, d):
    return metrics.calibration(fx.scores_big(spark, d))


@query(f"""SELECT bin, {R('avg(label)', 'mean_label')}, {R('avg(prob)', 'mean_prob')}, count(*) AS n FROM (SELECT s.*, len(list_filter(c, lambda x: x <= prob)) AS bin FROM scored s, (SELECT quantile_cont(prob, [0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS c FROM scored)) GROUP BY bin""")
def e11_calibration_quantile(spark, d):
    return metrics.calibration(fx.scored(spark, d), strategy="quantile")


PR = "(SELECT prob AS threshold, cp / cc AS precision, cp / sum(p) OVER () AS recall FROM (SELECT prob, p, sum(p) OVER w::DOUBLE AS cp, sum(n) OVER w::DOUBLE AS cc FROM (SELECT prob, sum(label) AS p, count(*) AS n FROM scores_big GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)) UNION ALL SELECT NULL, 1e0, 0e0)"


@query(f"SELECT {R('threshold')}, {R('precision')}, {R('recall')} FROM {PR}")
def e12_precision_recall(spark, d):
    return metrics.precision_recall(fx.scores_big(spark, d))


@query(f"SELECT {R('sum(a)', 'area')} FROM (SELECT (recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2 AS a FROM {PR} WINDOW w AS (ORDER BY coalesce(threshold, 2e0) DESC))")
def e12_precision_recall_area(spark, d):
    return metrics.precision_recall_area(fx.scores_big(spark, d))


LOSS = "avg(-(label*ln(greatest(least(prob, 1 - 1e-15), 1e-15)) + (1-label)*ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15))))"


@query(f"SELECT {KEYS}, {R(LOSS, 'log_loss')} FROM {TEST} GROUP BY ALL")
def e13_log_loss(spark, d):
    return metrics.log_loss(test_rows(spark, d), EX)


@query(f"SELECT {KEYS}, {R('sum(hit_rate) - (arg_min(hit_rate, dig_index) + arg_max(hit_rate, dig_index))/2', 'area')} FROM campaigns GROUP BY ALL")
def e14_curve_area(spark, d):
    return metrics.curve_area(campaigns(spark, d).withColumn("pos", F.col("dig_index")), EX)


@query(f"SELECT {KEYS}, {R('avg(((CASE WHEN prob > 0.5e0 THEN 1 ELSE 0 END) = label)::INT)', 'accuracy')} FROM {TEST} GROUP BY ALL")
def e15_accuracy(spark, d):
    return metrics.accuracy(test_rows(spark, d), EX)


@query(f"SELECT {KEYS}, " + ", ".join(f"count(*) FILTER (WHERE (CASE WHEN prob > 0.5e0 THEN 1 ELSE 0 END) = {s} AND label = {y}) AS {n}" for n, s, y in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1))) + f" FROM {TEST} GROUP BY ALL")
def e16_confusion(spark, d):
    return metrics.confusion(test_rows(spark, d), EX)


@query(f"SELECT base_right, count(*) AS n, {R('avg(prob_a)', 'mean_base')}, {R('avg(prob_b)', 'mean_other')} FROM (SELECT *, (CASE WHEN prob_a > 0.5e0 THEN 1 ELSE 0 END) = label AS base_right FROM preds) GROUP BY base_right")
def e17_right_and_wrong(spark, d):
    rows = fx.preds(spark, d)
    side = lambda m: rows.select("pid", "label", F.col(f"prob_{m}").alias("prob"))
    return metrics.right_and_wrong(side("a"), side("b").drop("label"))


@query(f"SELECT train_size, {R('avg(x) FILTER (WHERE resolution = 5)', 'res_5')}, {R('avg(x) FILTER (WHERE resolution = 10)', 'res_10')} FROM (SELECT {KEYS}, {LOSS} AS x FROM {TEST} WHERE model = 'b' GROUP BY ALL) GROUP BY train_size")
def e18_metric_grid(spark, d):
    losses = metrics.log_loss(test_rows(spark, d).filter("model = 'b'"), EX)
    return metrics.metric_grid(losses, "log_loss", fx.RESOLUTIONS)


@query(f"SELECT {KEYS}, role, pid, {R('prob')} FROM predictions WHERE role = 'test' AND model IN ('b')")
def f1_chosen_predictions(spark, d):
    return costs.chosen_predictions(fx.predictions(spark, d), ["b"])


@query(f"SELECT {KEYS}, count(*) AS digs, {R('sum(dig_index * hit_rate)', 'moment')}, max(dig_batch) AS last_batch FROM campaigns GROUP BY ALL")
def f2_dig_data(spark, d):
    return campaigns(spark, d).groupBy(*EX).agg(F.count("*").alias("digs"), F.sum(F.col("dig_index") * F.col("hit_rate")).alias("moment"), F.max("dig_batch").alias("last_batch"))


def curves(spark, d):
    return store.held(costs.cost_curve(campaigns(spark, d), EX))


@query(f"SELECT {KEYS}, lead_digs::BIGINT AS lead_digs, digs, {R('prob_thres')}, {R('cost')}, {R('cost_avg')} FROM curves")
def f3_cost_curve(spark, d):
    return curves(spark, d)


@query(f"SELECT {KEYS}, lead_digs::BIGINT AS lead_digs, digs, {R('cost')}, {R('cost_avg')}, {R('savings')}, {R('savings_avg')} FROM savings")
def f4_savings(spark, d):
    return costs.add_savings(curves(spark, d), "a").drop("prob_thres")


POOLED = f"model, train_size, resolution, lead_digs::BIGINT AS lead_digs, {R('cost')}, {R('cost_avg')}, {R('savings')}, {R('savings_avg')}"


@query(f"SELECT {POOLED} FROM pooled")
def f5_pooling(spark, d):
    return costs.pooled(costs.add_savings(curves(spark, d), "a"), ["cost", "cost_avg", "savings", "savings_avg"])


@query(f"SELECT {POOLED} FROM pooled")
def f6_compute_costs(spark, d):
    return costs.compute_costs(fx.predictions(spark, d), fx.labels(spark, d), fx.tiles(spark, d), "a", ["b"])


def pooled(spark, d):
    return store.held(f5_pooling.__wrapped__(spark, d))


def lowess_sql() -> str:
    """Four rounds of local lines over the first 90 % of each pooled curve, residuals weighing the points of the next."""
    g = "train_size, resolution"
    on = "a.train_size = b.train_size AND a.resolution = b.resolution"
    parts = [
        f"z AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {g}) AS n0 FROM pooled) WHERE lead_digs <= floor(0.9e0*n0))",
        f"p AS (SELECT {g}, lead_digs, cost_avg AS y, lead_digs - min(lead_digs) OVER g AS i, count(*) OVER g AS n FROM z WINDOW g AS (PARTITION BY {g}))",
        "k AS (SELECT *, least(greatest(2, floor(0.05e0*n + 1e-10)), n)::BIGINT AS k FROM p)",
        "s AS MATERIALIZED (SELECT *, least(greatest(i - k // 2, 0), n - k)::BIGINT AS s FROM k)",
        f"x AS MATERIALIZED (SELECT a.train_size, a.resolution, a.i, b.i AS j, (b.i - a.i)::DOUBLE AS d, b.y, pow(1 - pow(abs(b.i - a.i) / greatest(a.i - a.s, a.s + a.k - 1 - a.i, 1)::DOUBLE, 3), 3) AS w FROM s a JOIN s b ON {on} AND b.i BETWEEN a.s AND a.s + a.k - 1)",
        f"r0 AS (SELECT {g}, i AS j, 1e0 AS r FROM s)",
    ]
    for n in range(4):
        parts += [
            f"t{n} AS (SELECT {g}, i, sum(w*r) AS a, sum(w*r*d) AS b, sum(w*r*d*d) AS c, sum(w*r*y) AS p, sum(w*r*d*y) AS q FROM x JOIN r{n} USING ({g}, j) GROUP BY ALL)",
            f"f{n} AS MATERIALIZED (SELECT {g}, i, lead_digs, y, CASE WHEN a > 0 THEN CASE WHEN a*c - b*b > 1e-12*a*a THEN (p*c - q*b)/(a*c - b*b) ELSE p/a END ELSE y END AS fit FROM s JOIN t{n} USING ({g}, i))",
            f"r{n + 1} AS MATERIALIZED (SELECT {g}, i AS j, pow(1 - t*t, 2) AS r FROM (SELECT {g}, i, CASE WHEN m = 0 THEN (o > 0)::INT::DOUBLE ELSE least(o / (6*m), 1e0) END AS t FROM (SELECT *, abs(y - fit) AS o, quantile_cont(abs(y - fit), 0.5) OVER (PARTITION BY {g}) AS m FROM f{n})))",
        ]
    return "WITH " + ",\n".join(parts[:-1]) + f" SELECT {g}, lead_digs::BIGINT AS lead_digs, {R('fit', 'cost_avg_smooth')} FROM f3"


@query(lowess_sql())
def f7_lowess(spark, d):
    by = ["train_size", "resolution"]
    return costs.lowess(costs.zoomed(pooled(spark, d), by), "lead_digs", "cost_avg", by)


@query(f"SELECT train_size, resolution, lead_digs::BIGINT AS lead_digs, {R('cost_avg')}, {R('100e0*lead_digs/n', 'percent_x')} FROM (SELECT *, count(*) OVER (PARTITION BY train_size, resolution) AS n FROM pooled) WHERE lead_digs <= floor(0.9e0*n)")
def f8_zoom(spark, d):
    return costs.zoomed(pooled(spark, d), ["train_size", "resolution"]).select("train_size", "resolution", "lead_digs", "cost_avg", "percent_x")
