"""Training-set, metric and model queries."""

from pyspark.sql import functions as F

from launchlens.functions import rounded

from launchlens.models import metrics, prepare, training
from launchlens.operators import features, joins as join_ops, labels as label_ops
from launchlens.plans import query
from launchlens.plans.features import GRID, SEEN, family_cte, family_sql, on_grid, base, snapshots
from launchlens.plans.labels import FWD, GROUPING, LABELS, MGRID, MIG, NOW, POST, POST_SQL, SNAP_CTES, migration_rows, resolved, snapshot_inputs
from launchlens.sources import files, tables as t

KEY = features.KEY

def row_key():
    return F.col("mint_address").cast("long") * 10_000 + F.col("snapshot_age_sec")



def labelled(spark, sf):
    m = t.mints(spark, sf).select("mint_address", "created_ms")
    x = snapshot_inputs(spark, sf).join(resolved(spark, sf), KEY).join(m, "mint_address")
    return x.withColumn("snapshot_ts", F.col("created_ms") + F.col("snapshot_age_sec") * 1000).withColumn("row_key", row_key())


@query("s14_export_training_set", t.oracle(f"""
SELECT mint_address, snapshot_age_sec, cut AS snapshot_ts, round(p, 6) AS last_price_sol, peaked_100, local_top_60s FROM (
  SELECT mint_address, snapshot_age_sec, cut, p, {', '.join(f'{LABELS[n][1]} AS {n}' for n in ('labels_resolved_at', 'peaked_100', 'local_top_60s'))} FROM fwd {GROUPING})
WHERE labels_resolved_at IS NOT NULL AND p > 1e-9 AND snapshot_age_sec IN (60, 120, 300) AND local_top_60s IS NOT NULL""", *SNAP_CTES, FWD))
def _(spark, sf):
    out = prepare.export_training_set(labelled(spark, sf), ages=[60, 120, 300], target="local_top_60s")
    return rounded(out.select(*KEY, "snapshot_ts", "last_price_sol", "peaked_100", "local_top_60s"))


def anchored_only(df):
    """Context columns on the age-0 row only, as they are captured."""
    cols = prepare.anchor_columns(df.columns)
    return df.select(*[F.when(F.col("snapshot_age_min") == 0, F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


PRE_COUNT = "(SELECT count(*) FROM trades x WHERE x.mint_address = g.mint_address AND x.ts_ms <= g.t0)"


@query("j10_forward_fill_anchor", t.oracle(f"SELECT g.mint_address, g.age AS snapshot_age_min, {PRE_COUNT} AS pre_mig_trade_count, length(m.name)::int AS name_length FROM mgrid g JOIN mints m USING (mint_address)", MIG, MGRID))
def _(spark, sf):
    x = anchored_only(migration_rows(spark, sf).select("mint_address", "snapshot_age_min", "pre_mig_trade_count", "name_length"))
    return join_ops.forward_fill_anchor(x, ["pre_mig_trade_count", "name_length"])


@query("s15_export_postmig_training_set", t.oracle(f"""
SELECT g.mint_address, g.age AS snapshot_age_min, g.cut AS snapshot_ts, {PRE_COUNT} AS pre_mig_trade_count, round(least(y.peak, 5.0::double), 6) AS post_mig_peak_pct, y.up AS post_mig_hits_2x
FROM mgrid g JOIN (SELECT x.mint_address, {POST_SQL['post_mig_peak_pct'][1]} AS peak, {POST_SQL['post_mig_hits_2x'][1]} AS up
  FROM (SELECT mig.*, t.ts_ms, t.trade_id, t.price_sol, t.sol_amount, t.ts_ms - t0 AS d FROM mig LEFT JOIN trades t ON t.mint_address = mig.mint_address AND t.ts_ms > t0) x GROUP BY x.mint_address, t0, p, rugged_ms, last_trade_ms) y USING (mint_address)
WHERE g.age IN (0, 2, 4) AND y.up IS NOT NULL""", MIG, MGRID))
def _(spark, sf):
    lab = label_ops.post_migration_labels(t.trades(spark, sf), t.mints(spark, sf), NOW, POST, chunk_ms=60_000)
    out = prepare.export_postmig_training_set(anchored_only(migration_rows(spark, sf)), lab, [0, 2, 4], "post_mig_hits_2x", cap=5.0)
    return rounded(out.select("mint_address", "snapshot_age_min", "snapshot_ts", "pre_mig_trade_count", "post_mig_peak_pct", "post_mig_hits_2x"))


@query("f11_select_features", family_sql("a1_flow_features"))
def _(spark, sf):
    wide = on_grid(spark, sf, features.core_features(base(spark, sf), t.AGES), "a1_flow_features").withColumn("not_a_feature", F.lit(1))
    return prepare.select_features(wide, "lean", KEY)


@query("a32_dataset_summary", t.oracle("""
SELECT 'all' AS section, '' AS name, s AS stat, v AS value FROM (SELECT unnest(['rows', 'tokens', 'first_ts', 'last_ts']) AS s, unnest([count(*)::double, count(DISTINCT mint_address)::double, min(cutoff)::double, max(cutoff)::double]) AS v FROM x)
UNION ALL SELECT 'age', snapshot_age_sec::varchar, 'rows', count(*)::double FROM x GROUP BY 2
UNION ALL SELECT 'label', n, unnest(['mean', 'sum', 'n', 'max']), unnest([round(avg(v), 6), sum(v), count(v)::double, max(v)]) FROM (SELECT 'buy_count' AS n, buy_count::double AS v FROM x UNION ALL SELECT 'sell_count', sell_count::double FROM x) GROUP BY n
UNION ALL SELECT 'feature', n, unnest(['mean', 'std', 'min', 'max']), unnest([round(avg(v), 6), round(stddev_samp(v), 6), round(min(v), 6), round(max(v), 6)]) FROM (SELECT 'trade_count' AS n, trade_count::double AS v FROM x) GROUP BY n""",
    GRID, SEEN, family_cte("a1_flow_features"), "x AS (SELECT f.*, m.created_ms + snapshot_age_sec * 1000 AS cutoff FROM f_a1_flow_features f JOIN mints m USING (mint_address))"))
def _(spark, sf):
    m = t.mints(spark, sf).select("mint_address", "created_ms")
    x = features.core_features(base(spark, sf), t.AGES).join(m, "mint_address").withColumn("snapshot_ts", F.col("created_ms") + F.col("snapshot_age_sec") * 1000)
    return rounded(prepare.dataset_summary(x, ["buy_count", "sell_count"], ["trade_count"])).withColumn(
        "value", F.when(F.col("stat").isin("rows", "tokens", "first_ts", "last_ts", "sum", "n") | ((F.col("section") == "label") & (F.col("stat") == "max")), F.round("value")).otherwise(F.col("value"))
    )


def grid_rows(spark, sf):
    return features.snapshot_grid(t.mints(spark, sf), t.AGES).select("mint_address", "snapshot_age_sec", F.col("cutoff_ms").alias("snapshot_ts")).withColumn("row_key", row_key())


def split_sql(frac, gap):
    return t.oracle(f"""
SELECT mint_address, snapshot_age_sec, split FROM (SELECT *, CASE WHEN rn <= cut THEN 'train' ELSE 'val' END AS split,
    count(*) FILTER (rn > cut AND cutoff >= last + {gap}) OVER () AS n_late FROM (
  SELECT *, max(cutoff) FILTER (rn <= cut) OVER () AS last FROM (
    SELECT mint_address, age AS snapshot_age_sec, cutoff, row_number() OVER (ORDER BY cutoff, mint_address * 10000 + age) AS rn, floor(count(*) OVER () * {frac}::double) AS cut FROM grid)))
WHERE split = 'train' OR {gap} = 0 OR n_late < 50 OR cutoff >= last + {gap}""")


@query("m1_time_split", split_sql(0.8, 60_000))
def _(spark, sf):
    return prepare.time_split(grid_rows(spark, sf), 0.8, 60_000).select(*KEY, "split")


@query("m2_time_split_lean", split_sql(0.85, 0))
def _(spark, sf):
    return prepare.time_split(grid_rows(spark, sf), 0.85, 0).select(*KEY, "split")


@query("m3_transform_target", t.oracle("""
SELECT id, round(sign(realized_pnl_pct) * ln(1 + abs(realized_pnl_pct)), 6) + 0.0::double AS signed_log, round(realized_pnl_pct, 6) AS back, round(greatest(realized_pnl_pct, 0.0), 6) + 0.0::double AS clipped
FROM positions WHERE status = 'closed'"""))
def _(spark, sf):
    p = t.positions(spark, sf).filter("status = 'closed'").withColumn("y", prepare.transform_target(F.col("realized_pnl_pct"), "hold_1h_pct"))
    return rounded(p.select("id", F.col("y").alias("signed_log"), prepare.inverse_target(F.col("y"), "hold_1h_pct").alias("back"), prepare.transform_target(F.col("realized_pnl_pct"), "unique_buyers_next_60s").alias("clipped")))


@query("m6_binary_metrics", t.oracle("""
SELECT count(*) AS n, round((SELECT sum(neg * (above + pos / 2.0::double)) / (sum(pos) * sum(neg)) FROM g), 6) AS auc_roc, round((SELECT sum(pos * (above + pos) / (above + pos + nabove + neg)) / sum(pos) FROM g), 6) AS auc_pr,
  round(avg(y) FILTER (p >= c), 6) AS precision_top10, round(avg(y), 6) AS baseline_rate, round(avg(y) FILTER (p >= c) / avg(y), 6) AS lift, round(avg((p - y) * (p - y)), 6) AS brier,
  count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp
FROM s""", "s0 AS (SELECT prob AS p, is_buy::double AS y FROM predictions JOIN trades ON trade_id = prediction_id)", "s AS (SELECT *, (SELECT quantile_cont(p, 0.9) FROM s0) AS c FROM s0)",
    """g AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS above, coalesce(sum(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS nabove
  FROM (SELECT p, count(*) FILTER (y = 1)::double AS pos, count(*) FILTER (y = 0)::double AS neg FROM s0 GROUP BY 1))"""))
def _(spark, sf):
    x = t.predictions(spark, sf).join(t.trades(spark, sf).select(F.col("trade_id").alias("prediction_id"), F.col("is_buy").alias("label")), "prediction_id")
    return rounded(metrics.binary_metrics(x))


@query("m7_regression_metrics", t.oracle("""SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(median(abs(y - p)), 6) AS median_ae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2
FROM (SELECT sol_amount AS y, token_amount * 10 AS p FROM trades)"""))
def _(spark, sf):
    x = t.trades(spark, sf).select(F.col("sol_amount").alias("label"), (F.col("token_amount") * 10).alias("prediction"))
    return rounded(metrics.regression_metrics(x))


@query("m10_train_gate", t.oracle("""SELECT target, n_usable, (SELECT count(*) FROM trades) AS n_rows, true AS stale, n_usable >= least AS train FROM (
  SELECT 'post_mig_hits_2x' AS target, cast(sum(is_buy) AS bigint) AS n_usable, 50 AS least FROM trades UNION ALL SELECT 'post_mig_rugs_1h', cast(count(*) FILTER (trade_id % 400 = 0) AS bigint), 50 FROM trades
  UNION ALL SELECT 'post_mig_peak_pct', count(*) FILTER (is_buy = 1), 100 FROM trades)"""))
def _(spark, sf):
    x = t.trades(spark, sf).select(
        F.col("is_buy").alias("post_mig_hits_2x"), F.when(F.col("trade_id") % 400 == 0, 1).otherwise(0).alias("post_mig_rugs_1h"),
        F.when(F.col("is_buy") == 1, F.col("sol_amount")).alias("post_mig_peak_pct"),
    )
    return prepare.train_gate(x, prepare.ACTIVE_TARGETS).select("target", "n_usable", "n_rows", "stale", "train")


GAP = 5_000
# Targets trained on snapshots before migration.
LEAN_TARGETS = [
    "peaked_30", "peaked_100", "peaked_300", "will_rug", "will_die_fast", "will_migrate", "hits_2x_within_1h", "local_top_60s", "drawdown_from_peak_pct",
    "alive_at_1h", "alive_at_4h", "buy_pressure_continues_60s", "pump_durability_5min", "peak_within_5min", "price_up_60s", "price_up_300s",
    "drawdown_20pct_300s", "rug_within_5min", "migrates_within_15min", "unique_buyers_next_60s", "unique_sellers_next_60s",
]


def pre_rows(spark, sf):
    """Wide snapshots with their labels, written once as a table."""
    def build():
        wide = snapshots(spark, sf)
        lab = resolved(spark, sf)
        shared = [c for c in lab.columns if c in wide.columns and c not in KEY]
        return wide.join(lab.drop(*shared), KEY).withColumn("row_key", row_key())

    return t.stored(spark, sf, "training_pre", build)


def post_rows(spark, sf):
    """Migration snapshots with their labels, written once as a table."""
    def build():
        lab = label_ops.post_migration_labels(t.trades(spark, sf), t.mints(spark, sf), NOW, POST, 145.0, t.pairs_feed(spark, sf), chunk_ms=60_000)
        rows = prepare.export_postmig_training_set(anchored_only(migration_rows(spark, sf)), lab.drop("snapshot_ts", *prepare.FEATURES["post"]))
        return rows.withColumn("row_key", F.col("mint_address").cast("long") * 10_000 + F.col("snapshot_age_min"))

    return t.stored(spark, sf, "training_post", build)


_TRAINED = {}


def trained(spark, sf):
    """(registry folder, outcomes of all pre and post targets), trained once per application by the whole job with its defaults."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        root = files.work_dir(spark, "registry")
        pre = training.retrain(pre_rows(spark, sf), dict.fromkeys(LEAN_TARGETS, 0), prepare.FEATURES["pre"] + prepare.FEATURES["lean"], f"{root}/pre", NOW, force=True, gap_ms=GAP)
        post = training.retrain(post_rows(spark, sf), prepare.ACTIVE_TARGETS, prepare.FEATURES["post"], f"{root}/post", NOW, force=True, gap_ms=GAP)
        _TRAINED[key] = (root, pre, post)
    return _TRAINED[key]


def metric_rows(spark, outcomes, kind):
    names = {"binary": ["auc_roc", "auc_pr", "precision_top10", "baseline_rate", "lift", "brier"], "regression": ["mae", "median_ae", "r2", "r2_log"]}[kind]
    rows = [(o.target, o.kind, o.model.metrics.get("n"), o.model.metrics["n_train"], *[o.model.metrics.get(k) for k in names]) for o in outcomes if o.model and o.kind == kind]
    return rounded(spark.createDataFrame(rows, "target string, kind string, n_val long, n_train long, " + ", ".join(f"{k} double" for k in names)))


@query("m4_train_binary")
def _(spark, sf):
    _, pre, post = trained(spark, sf)
    return metric_rows(spark, pre + post, "binary")


@query("m5_train_regression")
def _(spark, sf):
    _, pre, post = trained(spark, sf)
    return metric_rows(spark, pre + post, "regression")


@query("m13_train_many")
def _(spark, sf):
    _, pre, post = trained(spark, sf)
    return training.training_report(spark, pre + post)


def _usable_sql():
    lab = [x for x in LEAN_TARGETS if x in LABELS]
    one = lambda x, binary: f"SELECT '{x}' AS target, count({x})::bigint AS n_usable, " + (f"(count(*) FILTER ({x} = 1))::bigint" if binary else "NULL::bigint") + " AS n_pos FROM labels_of_rows"
    body = " UNION ALL ".join(one(x, x not in prepare.REGRESSION_TARGETS) for x in lab)
    shown = ", ".join(f"{LABELS[n][1]} AS {n}" for n in lab)
    return t.oracle(body, *SNAP_CTES, FWD, f"""labels_of_rows AS (SELECT * FROM (SELECT mint_address, snapshot_age_sec, {shown} FROM fwd {GROUPING}) JOIN grid ON grid.mint_address = fwd_mint AND grid.age = snapshot_age_sec)""".replace("SELECT * FROM (SELECT mint_address,", "SELECT x.* FROM (SELECT mint_address AS fwd_mint, mint_address,").replace(") JOIN grid", ") x JOIN grid"))


@query("m13_usable_labels", _usable_sql())
def _(spark, sf):
    lab = [x for x in LEAN_TARGETS if x in LABELS]
    x = pre_rows(spark, sf).select(*[training.usable(c).alias(c) for c in lab])
    counts = x.agg(*[F.struct(F.count(c).alias("n"), F.count(F.when(F.col(c) == 1, 1)).alias("p")).alias(c) for c in lab])
    pos = F.when(~F.col("target").isin(sorted(prepare.REGRESSION_TARGETS)), F.col("v.p"))
    return counts.unpivot([], lab, "target", "v").select("target", F.col("v.n").alias("n_usable"), pos.alias("n_pos"))


def explained(outcomes, wanted="peaked_100"):
    """The model to explain: that of the wanted target, of the first binary target with one where it has too few rows of a class, or None."""
    found = [o for o in outcomes if o.model is not None and o.kind == "binary"]
    return next((o.model for o in sorted(found, key=lambda o: o.target != wanted)), None)


@query("m8_permutation_importance")
def _(spark, sf):
    _, pre, _ = trained(spark, sf)
    m = explained(pre)
    return rounded(training.permutation_importance(m, pre_rows(spark, sf), m.target if m else "", gap_ms=GAP))


@query("m9_score_all")
def _(spark, sf):
    root = trained(spark, sf)[0]
    out = training.score_all(pre_rows(spark, sf), training.load_models(spark, f"{root}/pre/models"))
    post = training.load_models(spark, f"{root}/post/models")
    if post:
        out = out.unionByName(training.score_all(post_rows(spark, sf), post, age="snapshot_age_min"))
    return rounded(out)


@query("m11_model_history")
def _(spark, sf):
    root = trained(spark, sf)[0]
    found = [f"{root}/{k}/history" for k in ("pre", "post") if files.folder_exists(spark, f"{root}/{k}/history")]
    return rounded(spark.read.schema(training.HISTORY).parquet(*found))
