"""A small tree ensemble as a model file, and queries that score, explain and replay with it. Both engines read the same JSON text,
so forecasts and attributions are compared value by value."""

import json

from pyspark.sql import functions as F

from contract import data as d
from contract.model_side import serving
from contract.spark_side import r6
from contract.sql_side import B, C, CONSOLE, D, RISK, SERVING, T, TELE, rd, regime, w
from plantpulse.functions.latency import RANKED_ATTRIBUTIONS, ranked_attributions
from plantpulse.operators import attribution, policy, tree_model
from plantpulse.plans import online
from plantpulse.schemas import BUFFER, LABEL, MODEL_FEATURES, ROW_ID
from plantpulse.session import scratch_folder

TREES, BASE = 12, 45.0
# Range from which the rule below takes the conditions on each feature.
RANGES = {T: (5, 95), D: (0.1, 5), B: (5, 95), C: (41, 69), LABEL: (0, 2), "lag_latency_1": (38, 70), "lag_latency_2": (38, 70),
          "throughput_slope": (-4, 4), "buffer_peak": (50, 100)}


def tree(t):
    """Node arrays of tree ``t``: depth three, with one early leaf in every third tree. All values follow from the numbers of
    tree and node."""
    names = list(MODEL_FEATURES)
    early = {2} if t % 3 == 1 else set()
    nodes = {}

    def grow(k, depth):
        leaf = depth == 3 or k in early
        if leaf:
            nodes[k] = [-1, -1, 0, ((t * 29 + k * 31) % 61 - 30) / 10 + 0.0137, 0, float(10 + (t * 7 + k * 13) % 50)]
        else:
            grow(2 * k + 1, depth + 1), grow(2 * k + 2, depth + 1)
            f = (t * 4 + k * 5) % len(names)
            low, high = RANGES[names[f]]
            cut = low + (high - low) * (((t * 37 + k * 53 + 11) % 97) / 97)
            nodes[k] = [2 * k + 1, 2 * k + 2, f, cut, (t + k) % 2, nodes[2 * k + 1][5] + nodes[2 * k + 2][5]]

    grow(0, 0)
    order = {k: i for i, k in enumerate(sorted(nodes))}
    columns = list(zip(*([order.get(n[0], -1), order.get(n[1], -1), *n[2:]] for _, n in sorted(nodes.items())), strict=True))
    keys = ("left_children", "right_children", "split_indices", "split_conditions", "default_left", "sum_hessian")
    return dict(zip(keys, map(list, columns), strict=True))


def model_json():
    return json.dumps({"learner": {
        "feature_names": list(MODEL_FEATURES), "learner_model_param": {"base_score": str(BASE), "num_feature": str(len(MODEL_FEATURES))},
        "gradient_booster": {"name": "gbtree", "model": {"trees": [tree(t) for t in range(TREES)]}}}})


def model_path(spark):
    path = scratch_folder(spark, "model-file")
    spark.createDataFrame([(model_json(),)], "value string").coalesce(1).write.text(path)
    return path


def model(spark):
    return tree_model.load(spark, model_path(spark))


def a12(spark, sf):
    """Raw forecasts of raw frames, some without a throughput: missing values take the default side of each test."""
    rows = d.telemetry(spark, sf).transform(policy.with_regime).withColumns({
        "lag_latency_1": F.col("k") + 20.0, "lag_latency_2": F.when(F.col(ROW_ID) % 13 != 0, F.col("k") + 10.0),
        "throughput_slope": F.lit(0.5), "buffer_peak": F.col(BUFFER)})
    return r6(tree_model.predict(model(spark), rows).select(ROW_ID, "prediction"))


def f6(spark, sf):
    out = tree_model.score_batch(model(spark), serving(spark, sf))
    return out.select(ROW_ID, policy.PRED, "sla_violation_expected")


def f7(spark, sf):
    out = tree_model.attributions(serving(spark, sf).transform(policy.with_regime), model(spark))
    return out.select(ROW_ID, F.explode("attributions").alias("feature", "ms"))


def f9(spark, sf):
    out = tree_model.attributions(serving(spark, sf).transform(policy.with_regime), model(spark))
    return r6(out.select(ROW_ID, F.explode(ranked_attributions(F.col("attributions"))).alias("r")).select(ROW_ID, "r.*"))


def h6(spark, sf):
    out = policy.replay(d.frames(spark, sf), tree_model.scorer(model(spark)), largest=d.largest(spark, sf))
    return r6(out.select(ROW_ID, "pred_before", "mitigation_active", policy.PRED))


def p2(spark, sf):
    """Raw frames to diagnosis with the model; the evidence quotes the model's own attributions."""
    out = online.score_frames(d.telemetry(spark, sf).select(*d.RAW), tree_model.scorer(model(spark)), largest=d.largest(spark, sf))
    return r6(out.select(ROW_ID, policy.PRED, "risk_level", F.element_at("attributions", B).alias("buffer_ms"),
                         F.element_at("attributions", D).alias("drop_ms"), F.element_at("attributions", attribution.BIAS).alias("bias_ms")))


QUERIES = {
    "A12_model_file": a12, "F6_file_scoring": f6, "F7_file_attribution": f7, "F9_file_attribution_rank": f9,
    "H6_policy_replay_file": h6, "P2_model_diagnosis": p2,
}

# --- SQL ---------------------------------------------------------------------------------------------------

NODES = f"""mdl as (select '{model_json()}'::json as m),
trs as (select t.i as tree, m->'$.learner.gradient_booster.model.trees'->cast(t.i as integer) as j from mdl, range(0, {TREES}) t(i)),
nds as (select tree, n.i as node, cast(j->'$.left_children'->>cast(n.i as integer) as integer) as l, cast(j->'$.right_children'->>cast(n.i as integer) as integer) as r,
  cast(j->'$.split_indices'->>cast(n.i as integer) as integer) as f, cast(j->'$.split_conditions'->>cast(n.i as integer) as double) as c,
  cast(j->'$.default_left'->>cast(n.i as integer) as integer) = 1 as dl, cast(j->'$.sum_hessian'->>cast(n.i as integer) as double) as cover
  from trs, range(0, 15) n(i) where n.i < json_array_length(j->'$.left_children'))"""

# Leaves with the nodes on their way: one row per leaf and test, then up to three distinct features per leaf with their product of shares.
LEAVES = NODES + """, way as (select tree, node as leaf, node as pos, c as value from nds where l < 0),
up as (select tree, leaf, pos, value from way union all select u.tree, u.leaf, p.node, u.value from up u join nds p on p.tree = u.tree and (p.l = u.pos or p.r = u.pos)),
tst as (select u.tree, u.leaf, u.value, p.f, p.c, p.dl, p.l = u.pos as left_side, k.cover / p.cover as z
  from up u join nds p on p.tree = u.tree and (p.l = u.pos or p.r = u.pos) join nds k on k.tree = u.tree and k.node = u.pos),
per as (select tree, leaf, any_value(value) as value, f, product(z) as z, list({'c': c, 'dl': dl, 'ls': left_side}) as tests from tst group by tree, leaf, f)"""


def walked(source, features, name):
    """CTEs that walk every tree for the rows of ``source`` (event_id); ``name`` gets the raw prediction."""
    xs = ", ".join(f"cast({f} as double)" for f in features)
    return f""", {name}_x as (select event_id, [{xs}] as x from {source}),
{name}_w as (select event_id, x, tree, 0 as node from {name}_x, trs
  union all select s.event_id, s.x, s.tree, case when (case when s.x[n.f + 1] is null then n.dl else s.x[n.f + 1] < n.c end) then n.l else n.r end
  from {name}_w s join nds n on n.tree = s.tree and n.node = s.node where n.l >= 0),
{name} as (select s.event_id, {BASE}::double + sum(n.c) as raw from {name}_w s join nds n on n.tree = s.tree and n.node = s.node where n.l < 0 group by s.event_id)"""


def features(label="label", t=T, drop=D, b=B, c=C, slope="throughput_slope", peak="buffer_peak"):
    return [t, drop, b, c, label, "lag_latency_1", "lag_latency_2", slope, peak]


LABELED = f", fl as (select *, {regime()} as label from feat)"
FLOORED = "greatest(5.0::double, " + rd("raw", 2) + ")"
SHAP = LABELED + f""", px as (select event_id, [{', '.join(f'cast({f} as double)' for f in features())}] as x from fl),
ps as (select event_id, tree, leaf, f, value, z, cast(len(list_filter(tests, lambda q: (case when x[f + 1] is null then q.dl else x[f + 1] < q.c end) <> q.ls)) = 0 as integer) as p from px, per),
ot as (select a.event_id, a.tree, a.leaf, a.f, a.value, a.p, a.z, count(b.f) as k,
  coalesce(product(case when b.f is not null then b.p end), 1) as pp, coalesce(product(case when b.f is not null then b.z end), 1) as zz,
  coalesce(sum(b.p), 0) as sp, coalesce(sum(b.z), 0) as sz, coalesce(sum(b.p * b.z), 0) as spz
  from ps a left join ps b on a.event_id = b.event_id and a.tree = b.tree and a.leaf = b.leaf and a.f <> b.f group by all),
co as (select event_id, f, sum(value * (p - z) * case k when 0 then 1 when 1 then (pp + zz) / 2 else pp / 3 + zz / 3 + (sp * sz - spz) / 6 end) as ms from ot group by event_id, f),
bi as (select {BASE}::double + sum(value * z) as ms from (select tree, leaf, any_value(value) as value, product(z) as z from per group by tree, leaf)),
nm as (select unnest(range(0, 9)) as f, unnest([{', '.join(f"'{f}'" for f in MODEL_FEATURES)}]) as feature),
sh as (select x.event_id, n.feature, {rd('coalesce(c.ms, 0)', 3)} as ms from px x cross join nm n left join co c on c.event_id = x.event_id and c.f = n.f
  union all select event_id, '{attribution.BIAS}', {rd('ms', 3)} from px, bi)"""

_SHED = CONSOLE + f""", r1 as (select *, case when {C} > 68 then {C} - 3.5 else {C} end as temp_after, case when {D} > 1.8 then 0.12::double else {D} end as active_drop from cons),
r2 as (select *, {regime(T, 'active_drop', B, 'temp_after')} as lb, {T} * 0.82 as st, active_drop * 0.35 as sd, {B} * 0.7 as sb, throughput_slope * 0.82 as ss from r1),
r3 as (select *, {regime('st', 'sd', 'sb', 'temp_after')} as ls from r2)"""

SQL = {
    "A12_model_file": w("recursive " + TELE + f""", a1 as (select *, {regime()} as label, k + 20.0 as lag_latency_1, case when event_id % 13 <> 0 then k + 10.0 end as lag_latency_2,
      0.5 as throughput_slope, {B} as buffer_peak from tele), """ + NODES + walked("a1", features(), "sc"), f"select event_id, {rd('raw', 6)} as prediction from sc"),
    "F6_file_scoring": w("recursive " + SERVING + LABELED + ", " + NODES + walked("fl", features(), "sc"),
                         f"select event_id, {FLOORED} as predicted_latency_ms, {FLOORED} >= 60 as sla_violation_expected from sc"),
    "F7_file_attribution": w("recursive " + SERVING + ", " + LEAVES + SHAP, "select event_id, feature, ms from sh"),
    "F9_file_attribution_rank": w("recursive " + SERVING + ", " + LEAVES + SHAP, "select event_id, rank, label as feature, round(ms, 6) as value, "
      "case when ms > 0 then '+' else '' end as sign, cast(least(100, floor(" + rd("abs(ms) / 8 * 100", 6) + ")) as integer) as bar_pct from sh join (values "
      + ", ".join(f"({i}, '{label}', '{key}')" for i, (label, key, _) in enumerate(RANKED_ATTRIBUTIONS, 1)) + ") r(rank, label, key) on feature = key"),
    "H6_policy_replay_file": w("recursive " + _SHED + ", " + NODES + walked("r3", features("lb", drop="active_drop", c="temp_after"), "s1")
      + walked("r3", features("ls", "st", "sd", "sb", "temp_after", "ss", "sb"), "s2")
      + f", pr as (select event_id, {FLOORED.replace('raw', 's1.raw')} as pred_before, {FLOORED.replace('raw', 's2.raw')} as pred_shed from s1 join s2 using (event_id))",
      "select event_id, pred_before, pred_before >= 55 as mitigation_active, case when pred_before >= 55 then pred_shed else pred_before end as predicted_latency_ms from pr"),
    "P2_model_diagnosis": w("recursive " + SERVING + ", " + LEAVES + SHAP + walked("fl", features(), "sc")
      + f", pd as (select event_id, {FLOORED} as pred from sc), wide as (select event_id, max(ms) filter (feature = '{B}') as buffer_ms, max(ms) filter (feature = '{D}') as drop_ms, "
      + f"max(ms) filter (feature = '{attribution.BIAS}') as bias_ms from sh group by event_id)",
      f"select event_id, pred as predicted_latency_ms, {RISK} as risk_level, buffer_ms, drop_ms, bias_ms from pd join wide using (event_id)"),
}
