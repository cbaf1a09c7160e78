"""The same queries as SQL for an independent engine."""

from plantpulse.functions import diagnosis as dg
from plantpulse.functions.latency import RANKED_ATTRIBUTIONS
from plantpulse.schemas import MODEL_FEATURES


def rd(x, n):
    return f"cast(round(cast(round({x}, 9) as decimal(28,9)), {n}) as double)"


def txt(x, n):
    return f"printf('%.{n}f', {rd(x, n)})"


def r6(*cols):
    return ", ".join(f"{rd(c, 6)} as {c}" for c in cols)


T, D, B, C, R = (
    "throughput_mbps", "packet_drop_percentage", "buffer_utilization_percentage", "node_temperature_celsius",
    "actual_rtt_latency_ms",
)
G = [T, D, B, C]
GS = ", ".join(G)


def regime(t=T, d=D, b=B, c=C):
    def dist(a):
        return " + ".join(f"({x} - {v}::double) * ({x} - {v}::double)" for x, v in zip((t, d, b, c), a))

    a0, a1, a2 = dist((50, 0.2, 35, 42)), dist((35, 1.2, 75, 52)), dist((15, 4.5, 92, 72))
    return f"""(case when {d} >= 2.5 or {c} >= 68 then 2 when {b} >= 65 or {d} >= 0.8 then 1
      when {d} < 0.8 and {b} < 65 and {c} < 60 then 0
      when {t} is null or {d} is null or {b} is null or {c} is null then 0
      when {a0} <= {a1} and {a0} <= {a2} then 0 when {a1} <= {a2} then 1 else 2 end)"""


def forecast(d=D, label="label", c=C):
    return f"greatest(5.0::double, {rd(f'38 + 12 * {d} + 6.5 * {label} + 0.1 * {c}', 2)})"


LABEL_TRAIN = f"(case when {D} >= 2.5 or {C} >= 65 then 2 when {B} >= 65 or {D} >= 0.8 then 1 else 0 end)"
SYNTH = f"greatest(0.5::double, {rd(f'38 + 8.5 * {D} + 25 * power({B} / 100, 2)', 3)})"

TELE = f"""tele as (select concat('NODE_', cast(user_id as varchar)) as device_id, event_id, epoch_us(ts) // 1000 as t,
  case event_type when 'click' then 'mqtt' when 'view' then 'modbus_tcp' when 'purchase' then 'opcua'
    when 'signup' then 'coap' else 's7' end as protocol,
  case when event_id % 17 <> 0 then value end as {T},
  k * k / 2000::double as {D}, (event_id * 37 % 1001) / 10::double as {B}, 40::double + (event_id * 13 % 301) / 10::double as {C},
  case when event_type <> 'error' then 38::double + k * 0.3::double end as {R}, event_type, k
  from (select *, cast(json_extract_string(props, '$.k') as double) as k from events))"""

VALID = f"""{T} between 0 and 10000 and {D} between 0 and 100 and {B} between 0 and 100 and {C} between -20 and 125
  and ({R} is null or {R} between 0 and 5000)"""

CANON = TELE + f""", canon as (select device_id, protocol, event_id, t as timestamp_epoch_ms, {GS}, coalesce({R}, {SYNTH}) as {R},
  sha256(concat_ws('|', device_id, cast(t as varchar), cast(event_id as varchar))) as correlation_id
  from tele where {VALID})"""

FAULTY = TELE + f""", faulty as (select case when event_id % 29 = 0 then '   ' else '  node_' || substr(device_id, 6) || ' ' end as device_id,
  case when event_id % 31 <> 0 then protocol end as protocol, event_id, t as timestamp_epoch_ms,
  {T} * (case when event_id % 37 = 0 then -1 else 1 end) as {T}, {D} + (case when event_id % 41 = 0 then 98 else 0 end) as {D}, {B},
  {C} + (case when event_id % 43 = 0 then 60 else 0 end) as {C}, {R} + (case when event_id % 47 = 0 then 4970 else 0 end) as {R} from tele)"""

ORD = "partition by device_id order by timestamp_epoch_ms, event_id"
CANON_COLS = f"device_id, protocol, event_id, timestamp_epoch_ms, {r6(*G, R)}, correlation_id"

SERVING = CANON + f""", nb as (select *, row_number() over ({ORD}) as rn from canon),
feat as (select *, avg({T}) over w60 as throughput_mean, avg({D}) over w60 as packet_drop_mean, max({B}) over w60 as buffer_peak,
  cast(count(*) over w60 as integer) as samples_in_window,
  {rd(f"case when count(*) over w60 >= 3 then regr_slope({T}, rn) over w60 else 0 end", 4)} as throughput_slope,
  coalesce(lag({R}, 1) over w, {R}) as lag_latency_1, coalesce(lag({R}, 2) over w, lag({R}, 1) over w, {R}) as lag_latency_2
  from nb window w as ({ORD}), w60 as ({ORD} rows between 59 preceding and current row))"""

LAB = CANON + f""", lab as (select *, 38 + 10.5 * {D} + 0.22 * {B} + 8 * {LABEL_TRAIN} as y from canon),
tr as (select *, coalesce(lag(y, 1) over w, first_value(y) over w) as lag_latency_1, coalesce(lag(y, 2) over w, first_value(y) over w) as lag_latency_2,
  coalesce({T} - lag({T}, 1) over w, 0) as throughput_slope, max({B}) over (w rows between 9 preceding and current row) as buffer_peak
  from lab window w as ({ORD}))"""

CONSOLE = CANON + f""", cons as (select *, coalesce(lag({R}, 1) over w, 42) as lag_latency_1, coalesce(lag({R}, 2) over w, lag({R}, 1) over w, 42) as lag_latency_2,
  coalesce({T} - lag({T}, 1) over w, 0) as throughput_slope, greatest({B}, max({B}) over (w rows between 5 preceding and 1 preceding)) as buffer_peak
  from canon window w as ({ORD}))"""

SCORED = CANON + f""", lbl as (select *, {regime()} as label from canon), scored as (select *, {forecast()} as pred from lbl)"""

REPLAY = CONSOLE + f""", r1 as (select *, {C} > 68 as core_throttled, case when {C} > 68 then {C} - 3.5 else {C} end as temp_after,
  {D} > 1.8 as failover_active, case when {D} > 1.8 then 0.12::double else {D} end as active_drop,
  case when {C} > 68 then 1.2::double else 0::double end as throttle_delay_ms from cons),
r2 as (select *, {regime(T, 'active_drop', B, 'temp_after')} as lb from r1),
r3 as (select *, {forecast('active_drop', 'lb', 'temp_after')} as pred_before, {T} * 0.82 as st, active_drop * 0.35 as sd, {B} * 0.7 as sb from r2),
r4 as (select *, {regime('st', 'sd', 'sb', 'temp_after')} as ls, pred_before >= 55 as mitigation_active from r3),
rep as (select *, case when mitigation_active then {forecast('sd', 'ls', 'temp_after')} else pred_before end as predicted_latency_ms,
  case when mitigation_active then st else {T} end as throughput_after, case when mitigation_active then sd else active_drop end as drop_after,
  case when mitigation_active then sb else {B} end as buffer_after from r4)"""

# Log of a device: recursion over its cycles in order, the state being the last logged tag.
STEP = """case when f and s <> 1 then 1 when q and s <> 2 then 2 when b and s <> 3 then 3 else s end"""
SOE = "recursive " + REPLAY + f""", cyc as (select device_id, timestamp_epoch_ms, event_id, {D}, predicted_latency_ms,
  failover_active as f, mitigation_active as q, predicted_latency_ms >= 60 as b,
  row_number() over ({ORD}) as rn from rep),
walk as (select device_id, 0::bigint as rn, 0 as s, 0 as was from (select distinct device_id from cyc)
  union all select c.device_id, c.rn, {STEP}, w.s from walk w join cyc c on c.device_id = w.device_id and c.rn = w.rn + 1),
soe as (select c.device_id, c.timestamp_epoch_ms, c.event_id,
  case s when 1 then 'PLC_FAILOVER' when 2 then 'QOS_SHAPER' else 'LAT_SLA_BREACH' end as tag,
  case s when 1 then 'ALM-2041' when 2 then 'ALM-3012' else 'ALM-4089' end as alarm_id,
  case s when 2 then 'P2-WARN' else 'P1-CRIT' end as priority,
  case s when 1 then 'FAILOVER_0x02' when 2 then 'MITIGATED_0x01' else 'BAD_0x03' end as quality,
  case s when 1 then 'HA Failover actuated: Packet drop ' || {txt(D, 2)} || '% exceeded limit 1.80%. Standby Node Delta active.'
    when 2 then 'Linux tc traffic shaper applied. Bounded latency to ' || {txt('predicted_latency_ms', 2)} || ' ms.'
    else 'Latency limit breach: ' || {txt('predicted_latency_ms', 2)} || ' ms exceeded threshold 60.0 ms.' end as event
  from walk w join cyc c using (device_id, rn) where w.s <> w.was)"""

CMD = TELE + f""", cmd as (select case event_type when 'purchase' then 'traffic_shedding' when 'signup' then 'ha_failover' when 'view' then 'reset'
    when 'error' then 'traffic_shedding' else 'thermal_regulation' end as action, device_id as target_device,
  'eth' || cast(event_id % 4 as varchar) as target_interface,
  case when event_id % 5 = 0 then 0::double when event_id % 5 <> 1 then (event_id % 90 + 10) / 100::double end as shedding_factor,
  case when event_id % 7 = 0 then {T} end as target_rate_mbps,
  case when event_id % 11 <> 0 then 'PLC_NODE_DELTA' when event_id % 2 = 0 then 'PLC_NODE_EPSILON' end as standby_node,
  event_type = 'error' and event_id % 3 <> 0 as waits, event_type <> 'click' as supported, t // 100000 as t, event_id from tele),
resolved as (select *, case when action = 'traffic_shedding' then
  greatest(1::double, {rd("coalesce(nullif(target_rate_mbps, 0), 100 * coalesce(nullif(shedding_factor, 0), 0.82))", 2)}) end as rate_mbps from cmd)"""

DECIDED = "recursive " + CMD + """, ord as (select *, row_number() over (partition by target_device order by t, event_id) as rn from resolved),
walk as (select target_device, 0::bigint as rn, -100000000::bigint as last_t, -100000000::bigint as prev_t from (select distinct target_device from ord)
  union all select o.target_device, o.rn, case when o.t - w.last_t >= 5000 and supported and not waits then o.t else w.last_t end, w.last_t
  from walk w join ord o on o.target_device = w.target_device and o.rn = w.rn + 1),
decided as (select o.*, case when o.t - w.prev_t < 5000 then 'rate_limited' when waits then 'pending_approval' when not supported then 'rejected' else 'applied' end as status,
  case when o.t - w.prev_t < 5000 then (5000 - (o.t - w.prev_t)) / 1000::double end as wait_sec from walk w join ord o using (target_device, rn))"""

SIDES = CANON + f""", base as (unpivot (select {GS} from canon where timestamp_epoch_ms < 1705363200000) on {GS} into name feature value value),
cur as (unpivot (select {rd(f'{T} * 1.2 + 3', 6)} as {T}, {D}, {B}, {rd(f'{C} + 0.7', 6)} as {C} from canon where timestamp_epoch_ms >= 1705363200000) on {GS}
  into name feature value value)"""

PSI = SIDES + """, edges as (select feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from base group by feature),
bb as (select feature, len([x for x in e if x <= value]) as bucket, 1 as is_base from base join edges using (feature)
  union all select feature, len([x for x in e if x <= value]), 0 from cur join edges using (feature)),
shares as (select f.feature, s.bucket,
  greatest(coalesce(sum(case when is_base = 1 and b.bucket = s.bucket then 1 end), 0) / sum(is_base)::double, 0.0001) as bp,
  greatest(coalesce(sum(case when is_base = 0 and b.bucket = s.bucket then 1 end), 0) / sum(1 - is_base)::double, 0.0001) as cp, sum(1 - is_base)::bigint as n_current
  from edges f cross join range(10) s(bucket) join bb b on b.feature = f.feature group by f.feature, s.bucket),
psi as (select feature, any_value(n_current) as n_current, """ + rd("greatest(0, sum((cp - bp) * ln(cp / bp)))", 4) + """ as psi from shares group by feature)"""

KS = """, vals as (select feature, value, sum(b)::double as b, sum(c)::double as c from
  (select feature, value, 1 as b, 0 as c from base union all select feature, value, 0, 1 from cur) group by feature, value),
ks as (select feature, """ + rd("max(abs(cb / n - cc / m))", 4) + """ as ks_statistic from
  (select feature, sum(b) over w as cb, sum(c) over w as cc, sum(b) over (partition by feature) as n, sum(c) over (partition by feature) as m
   from vals window w as (partition by feature order by value)) group by feature)"""

CAPS = """caps as (select concat('NODE_', cast(user_id as varchar)) as device_id, event_id, epoch_us(ts) // 1000 as timestamp_epoch_ms,
  case when event_id % 2 = 0 then 'TX' else 'RX' end as dir,
  upper(case when event_id % 3 = 0 then substr(sha256(props), 1, 16) else sha256(props) end) as hx from events)"""

JSONP = TELE + f""", pl as (select event_id, case when event_id % 13 = 0 then '{{"device_id": ' else '{{' || concat_ws(',',
  case when event_id % 5 <> 0 then '"device_id":"' || device_id || '"' end,
  '"{T}":' || cast({T} as varchar),
  case when event_id % 11 <> 0 then '"{D}":' || cast({D} as varchar) end,
  case when event_id % 7 = 0 then '"{B}":"' || cast({B} as varchar) || '"' else '"{B}":' || cast({B} as varchar) end,
  case when event_id % 19 = 0 then '"{C}":null' else '"{C}":' || cast({C} as varchar) end) || '}}' end as p from tele),
ok as (select event_id, p, json_valid(p) as decode_ok, case when json_valid(p) then p else '{{}}' end as j from pl)"""


def _json_gauge(g, default):
    return (
        f"case when not decode_ok then null when json_exists(j, '$.{g}') then round(try_cast(json_extract_string(j, '$.{g}') as double), 6)"
        f" else {default}::double end as {g}"
    )


DECODED = f"""select event_id, case when not decode_ok then null when json_exists(j, '$.device_id') then json_extract_string(j, '$.device_id') else 'PLC_NODE_ALPHA' end as device_id,
  'mqtt' as protocol, {", ".join(_json_gauge(g, v) for g, v in zip(G, (50.0, 0.2, 35.0, 42.0)))}, decode_ok from ok"""

BAD = f"""device_ok is null or protocol is null or {T} is null or {D} is null or {B} is null or {C} is null or not ({VALID})"""

ERRS = [
    ("device_id:missing", "trim(device_id) = '' or device_id is null"), ("protocol:missing", "protocol is null"),
]
for _g, _lo, _hi in ((T, 0, 10000), (D, 0, 100), (B, 0, 100), (C, -20, 125)):
    ERRS += [(f"{_g}:missing", f"{_g} is null"), (f"{_g}:out_of_range", f"{_g} < {_lo} or {_g} > {_hi}")]
ERRS.append((f"{R}:out_of_range", f"{R} < 0 or {R} > 5000"))
ERR_LIST = "[x for x in [" + ", ".join(f"case when {c} then '{n}' end" for n, c in ERRS) + "] if x is not null]"


def attr(i):
    label, key, default = RANKED_ATTRIBUTIONS[i]
    have = {D: rd(f"12 * {D}", 2), "dynamic_operational_label": rd("6.5 * label", 2), C: rd(f"0.1 * {C}", 2)}
    return label, have.get(key, f"{default}::double")


def _attr_rows():
    parts = []
    for i in range(5):
        label, value = attr(i)
        parts.append(f"select event_id, {i + 1} as rank, '{label}' as feature, {value} as v from scored")
    return " union all ".join(parts)


IMPACT_D, IMPACT_B = txt(rd(f"12 * {D}", 2), 1), "'4.2'"
E_LINK = f"'Frame drop rate (' || {txt(D, 2)} || '%) exceeds safety threshold (1.8%). TreeSHAP impact: +' || {{impact}} || ' ms.'"
E_QUEUE = f"'Buffer capacity utilization at ' || {txt(B, 1)} || '%. High risk of packet jitter and tail-drop. TreeSHAP impact: +4.2 ms.'"
E_HEAT = f"""'Die temperature (' || {txt(C, 1)} || ' °C) exceeded limit (68.0 °C). Compute clock throttling induced ' || {txt(f'{C} * 0.1', 1)} || ' ms latency penalty.'"""
E_SURGE = f"'Ingress data rate (' || {txt(T, 1)} || ' Mbps) exceeds baseline capacity.'"


def findings_sql(impact):
    rows = [
        (f"{D} >= 1.8", dg.V_LINK, E_LINK.format(impact=impact), "'HIGH'"),
        (f"{B} >= 65", dg.V_QUEUE, E_QUEUE, f"case when {B} < 85 then 'MEDIUM' else 'CRITICAL' end"),
        (f"{C} >= 68", dg.V_HEAT, E_HEAT, "'HIGH'"),
        (f"{T} > 110", dg.V_SURGE, E_SURGE, "'MEDIUM'"),
        (f"{D} < 1.8 and {B} < 65 and {C} < 68 and {T} <= 110", dg.V_NONE, f"'{dg.E_NONE}'", "'INFO'"),
    ]
    return " union all ".join(
        f"select *, {i} as ord, '{v}' as vector, {e} as evidence, {s} as severity from scored where {c}"
        for i, (c, v, e, s) in enumerate(rows)
    )


RISK = "case when pred >= 60 then 'CRITICAL_BREACH' when pred >= 52 then 'WARNING_APPROACHING_LIMIT' else 'NOMINAL_STABLE' end"
ACTION = f"case when {D} >= 1.8 then 'ha_failover' when {B} >= 65 or {C} >= 68 then 'traffic_shedding' else 'none' end"

FOLDS = CANON + """, o as (select *, row_number() over (order by timestamp_epoch_ms, event_id) - 1 as i, count(*) over () as n from canon),
f as (select fold, n, n - (6 - fold) * (n // 6) as a, n - (5 - fold) * (n // 6) as z from range(1, 6) r(fold), (select distinct n from o))"""


def fold_side(name, cond):
    return f"""select f.fold, count(*) as {name}_rows, min(timestamp_epoch_ms) as {name}_from, max(timestamp_epoch_ms) as {name}_to,
      cast(sum(event_id) as bigint) as {name}_ids from f join o on {cond} group by f.fold"""


ROUTES = """, sw as (select target_device as device_id, t, event_id, case when action = 'ha_failover' then coalesce(nullif(standby_node, ''), 'PLC_NODE_DELTA') else 'PLC_NODE_ALPHA' end as route,
  action = 'ha_failover' as is_failover from decided where status = 'applied' and action in ('ha_failover', 'reset'))"""

HIST = [0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0]


def w(ctes, body):
    return f"with {ctes} {body}"


SQL = {
    "A1_decode_json": w(JSONP, DECODED),
    "A2_decode_registers": w(TELE + f""", rg as (select device_id, event_id, [cast(floor({rd(f'{T}*10', 6)}) as integer), cast(floor({rd(f'{D}*100', 6)}) as integer),
      cast(floor({rd(f'{B}*10', 6)}) as integer), cast(floor({rd(f'{C}*10', 6)}) as integer)][1:event_id % 5] as r from tele)""",
      f"""select device_id, event_id, 'modbus_tcp' as protocol, round(case when len(r) > 0 then r[1] / 10::double else 50 end, 6) as {T},
      round(case when len(r) > 1 then r[2] / 100::double else 0.2 end, 6) as {D}, round(case when len(r) > 2 then r[3] / 10::double else 40 end, 6) as {B},
      round(case when len(r) > 3 then r[4] / 10::double else 42 end, 6) as {C} from rg"""),
    "A3_decode_nodes": w(TELE, f"""select device_id, event_id, 'opcua' as protocol, round(case when event_id % 3 <> 0 then {T} else 55 end, 6) as {T},
      round(case when event_id % 5 <> 0 then {D} else 0.15 end, 6) as {D}, round(case when event_id % 7 <> 0 then {B} else 45 end, 6) as {B},
      round(case when event_id % 11 <> 0 then {C} else 43.5 end, 6) as {C} from tele"""),
    "A4_capture_log": w(CAPS, """select device_id, event_id, timestamp_epoch_ms, dir, cast(length(hx) / 2 as integer) as bytes,
      trim(regexp_replace(substr(hx, 1, 32), '(..)', '\\1 ', 'g')) || case when length(hx) > 32 then '...' else '' end as hex from caps"""),
    "A4_capture_totals": w(CAPS, "select dir, count(*) as frames_total from caps group by dir"),
    "A5_last_captures": w(CAPS, """select * from (select device_id, event_id, timestamp_epoch_ms, dir,
      cast(row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) as integer) as recency from caps) where recency <= 20"""),
    "A6_decode_record": w(TELE, f"""select event_id, 50 as header_1, 3 as header_2, 0 as header_3, round(cast(cast({T} as float) as double), 6) as {T},
      round(cast(cast({D} as float) as double), 6) as {D}, round(cast(cast({C} as float) as double), 6) as {C},
      round(cast(cast({B} as float) as double), 6) as {B}, 95 as gpio_mask from tele"""),
    "A7_jsonl_replay": w(CANON, f"select {CANON_COLS} from canon"),
    "A8_recent_frames": w(CANON, f"select {CANON_COLS} from canon order by timestamp_epoch_ms desc, event_id desc limit 50"),
    "A10_csv_handoff": w(CANON, f"select {CANON_COLS} from canon"),
    "A11_export_log": w(SOE, "select * from soe"),
    "B1_quality_gate": w(FAULTY, f"select event_id, cast(len({ERR_LIST}) as integer) as n_errors, array_to_string({ERR_LIST}, ';') as errors from faulty"),
    "B2_device_id": w(FAULTY, "select event_id, nullif(upper(trim(device_id)), '') as device from faulty"),
    "B3_canonical": w(FAULTY + f""", pr as (select device_id as target, count({R}) as n, coalesce(median({R}), 0) as m from tele group by device_id),
      pb as (select upper(target) as device_id, case when n % 2 = 0 then m end as probe_rtt from pr),
      ok as (select upper(trim(f.device_id)) as device_id, protocol, event_id, timestamp_epoch_ms, {GS}, {R} from faulty f where trim(f.device_id) <> '' and protocol is not null and {VALID})""",
      f"""select ok.device_id, protocol, event_id, timestamp_epoch_ms, {r6(*G)}, round(coalesce({R}, probe_rtt, {SYNTH}), 6) as {R},
      sha256(concat_ws('|', ok.device_id, cast(timestamp_epoch_ms as varchar), cast(event_id as varchar))) as correlation_id from ok left join pb using (device_id)"""),
    "B4_synthetic_rtt": w(TELE, f"select event_id, {SYNTH} as rtt from tele"),
    "B5_request_contract": w(FAULTY, f"""select event_id, {r6(*G)}, round(coalesce(case when event_id % 3 = 0 then {R} end, 42), 6) as lag_latency_1,
      round(coalesce(case when event_id % 4 = 0 then {R} end, 42), 6) as lag_latency_2, case when event_id % 5 = 0 then 0.5::double else 0::double end as throughput_slope,
      round(case when event_id % 6 = 0 then 99 else {B} end, 6) as buffer_peak from faulty
      where {T} >= 0 and {D} between 0 and 100 and {B} between 0 and 100 and {C} between -20 and 120"""),
    "B6_prediction_request": w(SERVING, f"""select device_id, event_id, timestamp_epoch_ms, {r6(*G)}, 1 as dynamic_operational_label,
      {r6('throughput_slope', 'buffer_peak', 'lag_latency_1', 'lag_latency_2')} from feat"""),
    "C1_forward_fill": w(TELE, "select device_id, event_id, t as timestamp_epoch_ms, " + ", ".join(
      f"round(last_value({g} ignore nulls) over w, 6) as {g}" for g in G) + " from tele window w as (partition by device_id order by t, event_id)"),
    "C1_forward_fill_one_series": w(TELE, "select event_id, t as timestamp_epoch_ms, " + ", ".join(
      f"round(last_value({g} ignore nulls) over w, 6) as {g}" for g in G) + " from tele window w as (order by t, event_id)"),
    "C2_min_max_scale": w(TELE + ", mm as (select " + ", ".join(f"min({g}) as lo_{i}, max({g}) as hi_{i}" for i, g in enumerate(G)) + " from tele)",
      "select event_id, " + ", ".join(rd(f"({g} - lo_{i}) / (hi_{i} - lo_{i})", 6) + f" as {g}" for i, g in enumerate(G)) + " from tele, mm"),
    "C3_invert_scaler": w(TELE, f"select event_id, {r6(*G)} from tele"),
    "D1_rolling": w(SERVING, f"select event_id, {r6('throughput_mean', 'packet_drop_mean', 'buffer_peak')}, samples_in_window from feat"),
    "D2_slope": w(SERVING, "select event_id, throughput_slope from feat"),
    "D3_lags": w(SERVING, f"select event_id, {r6('lag_latency_1', 'lag_latency_2')} from feat"),
    "D4_latest": w(SERVING, f"""select device_id, protocol, event_id, timestamp_epoch_ms, {r6(*G, R)}, {r6('throughput_mean', 'throughput_slope', 'packet_drop_mean', 'buffer_peak', 'lag_latency_1', 'lag_latency_2')}, samples_in_window
      from feat qualify row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) = 1"""),
    "D5_training_lags": w(LAB, f"select event_id, {r6('lag_latency_1', 'lag_latency_2')} from tr"),
    "D6_training_slope": w(LAB, f"select event_id, {r6('throughput_slope')} from tr"),
    "D7_training_peak": w(LAB, f"select event_id, {r6('buffer_peak')} from tr"),
    "D8_console": w(CONSOLE, f"select event_id, {r6('lag_latency_1', 'lag_latency_2', 'throughput_slope', 'buffer_peak')} from cons"),
    "D9_window_summary": w(CANON + f""", lastn as (select * from canon qualify row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) <= 30),
      u as (unpivot (select device_id, {GS} from lastn) on {GS} into name signal value value)""",
      "select device_id, signal, round(avg(value), 6) as mean, round(max(value), 6) as peak, round(stddev_samp(value), 6) as std_dev from u group by device_id, signal"),
    "E1_live_regime": w(TELE, f"""select event_id, {regime()} as dynamic_operational_label,
      case {regime()} when 2 then 'Anomaly Vector' when 1 then 'Congestion State' else 'Nominal Regime' end as cluster_regime from tele"""),
    "E2_training_label": w(TELE, f"select event_id, {LABEL_TRAIN} as dynamic_operational_label from tele"),
    "F1_targets": w(TELE, f"""select event_id, round(38 + 10.5 * {D} + 0.22 * {B} + 8 * {LABEL_TRAIN}, 6) as network_latency_ms,
      round(40 + 35 * {D} + 12 * abs({LABEL_TRAIN}), 6) as scaled_target from tele"""),
    "F3_time_folds": w(FOLDS, f"""select cast(fold as integer) as fold, train_rows, train_from, train_to, train_ids, test_rows, test_from, test_to, test_ids
      from ({fold_side('train', 'o.i < f.a')}) join ({fold_side('test', 'o.i >= f.a and o.i < f.z')}) using (fold)"""),
    "F5_metrics": w(SCORED, f"""select round(sqrt(avg(({R} - pred) * ({R} - pred))), 6) as rmse, round(avg(abs({R} - pred)), 6) as mae,
      round(1 - sum(({R} - pred) * ({R} - pred)) / (var_pop({R}) * count(*)), 6) as r2 from scored"""),
    "F8_analytic": w(SCORED, f"""select event_id, pred as predicted_latency_ms, {rd(f'12 * {D}', 2)} as drop_ms, {rd('6.5 * label', 2)} as regime_ms,
      {rd(f'0.1 * {C}', 2)} as temp_ms, 38::double as bias_ms, pred >= 60 as sla_violation_expected from scored"""),
    "F9_ranked_attributions": w(SCORED + f", att as ({_attr_rows()})", """select event_id, rank, feature, round(v, 6) as value, case when v > 0 then '+' else '' end as sign,
      cast(least(100, floor(""" + rd("abs(v) / 8 * 100", 6) + """)) as integer) as bar_pct from att"""),
    "F10_horizons": w(CONSOLE + f", l2 as (select *, {regime()} as label from cons), s2 as (select *, {forecast()} as pred from l2), h as (" + " union all ".join(
      f"select event_id, {s} as horizon_sec, pred + {sw} * throughput_slope + {dw} * {D} as m, {bd}::double as b from s2" for s, sw, dw, bd in ((5, 0.5, 0, 1.2), (15, 1.5, 2, 2.8), (30, 3, 4.5, 4.5))) + ")",
      f"select event_id, horizon_sec, round(m, 6) as forecast_ms, round(m - b, 6) as low_ms, round(m + b, 6) as high_ms, {rd('m', 9)} >= 60 as breach from h"),
    "G1_psi": w(PSI, "select feature, n_current, psi from psi"),
    "G2_ks": w(SIDES + KS, "select feature, ks_statistic from ks"),
    "G3_drift_report": w(PSI + KS, "select feature, n_current, psi, ks_statistic, psi > 0.2 as drift_detected from psi join ks using (feature) where n_current >= 20"),
    "G3_drift_summary": w(PSI, "select max(psi) as overall_max_psi, 0.2::double as psi_threshold, bool_or(psi > 0.2) as retrain_recommended from psi where n_current >= 20"),
    "G4_drift_band": w(PSI, "select feature, case when psi < 0.1 then 'STABLE' when psi < 0.25 then 'MODERATE SHIFT' else 'SIGNIFICANT DRIFT' end as drift_band from psi"),
    "G5_set_baseline": w(SIDES, f"""select feature, count(*) as n, round(sum(value), 6) as total from
      (select * from base where feature <> '{C}' union all select * from cur where feature = '{C}') group by feature"""),
    "H1_risk_level": w(SCORED, f"""select event_id, {RISK} as risk_level, case when pred >= 60 then 'IMMEDIATE_ACTION_REQUIRED' when pred >= 52 then 'PROACTIVE_REGULATION_RECOMMENDED'
      else 'NO_ACTION_NEEDED' end as urgency from scored"""),
    "H2_findings": w(SCORED + f", fd as ({findings_sql(IMPACT_D)})", """select event_id, cast(row_number() over (partition by event_id order by ord) - 1 as integer) as position, vector, evidence, severity from fd"""),
    "H3_action": w(SCORED, f"""select event_id, {ACTION} as mitigation_action, case when {ACTION} <> 'none' then 'PLC_NODE_ALPHA' end as target_device,
      case when {D} >= 1.8 then 'PLC_NODE_DELTA' end as standby_node,
      case when {D} >= 1.8 then null when {B} >= 65 then 0.82::double when {C} >= 68 then 0.65::double end as shedding_factor,
      case when {D} >= 1.8 then 'Automated failover due to frame drop rate of ' || {txt(D, 2)} || '%'
        when {B} >= 65 then 'Dynamic traffic attenuation to relieve queue saturation (' || {txt(B, 1)} || '%)'
        when {C} >= 68 then 'Thermal throttling mitigation at ' || {txt(C, 1)} || ' °C' end as reason from scored"""),
    "H4_narrative": w(SCORED + f", fd as ({findings_sql(IMPACT_D)}), p1 as (select * from fd qualify row_number() over (partition by event_id order by ord) = 1)",
      f"""select event_id, vector as primary_vector, case when pred >= 52 then '**Root Cause Identified**: `' || vector || '`. ' || evidence || ' Forecasted latency is **' || {txt('pred', 1)}
        || ' ms** against the **60 ms** SLA constraint.' else '{dg.S_STABLE}' end as diagnosis_summary,
      case when pred >= 52 then 'Recommended action: **' || upper({ACTION}) || '** on `PLC_NODE_ALPHA`. Anticipated latency reduction: **-' || {txt('pred * (1 - 0.82)', 1)} || ' ms**.'
        else '{dg.R_STABLE}' end as recommendation_text, round(pred * (1 - 0.82), 6) as expected_reduction_ms, 0.95::double as confidence_score from p1"""),
    "H5_risk_index": w(SCORED, "select event_id, round(least(99, greatest(5, pred / 60 * 100)), 6) as risk_index from scored"),
    "H6_policy_replay": w(REPLAY, f"""select event_id, core_throttled, round(temp_after, 6) as temp_after, failover_active, round(active_drop, 6) as active_drop, pred_before, mitigation_active,
      {r6('throughput_after', 'drop_after', 'buffer_after')}, predicted_latency_ms, throttle_delay_ms from rep"""),
    "H7_mitigation_counts": w(REPLAY, """select device_id, count(*) filter (mitigation_active) as mitigation_checks,
      count(*) filter (mitigation_active and pred_before >= 60 and predicted_latency_ms < 60) as mitigations_successful, count(*) filter (failover_active) as failover_events
      from rep group by device_id"""),
    "H8_debounce": w(DECIDED, f"select event_id, status = 'rate_limited' as rate_limited, {rd('wait_sec', 2)} as retry_after_sec from decided"),
    "H9_approval": w(DECIDED, "select event_id, status from decided"),
    "H10_resolution": w(CMD, "select event_id, action, supported, rate_mbps from resolved"),
    "H11_route_of_frames": w(DECIDED + ROUTES, f"""select c.event_id, coalesce((select arg_max(s.route, s.t * 1000000000 + s.event_id) from sw s where s.device_id = c.device_id and s.t <= c.t // 100000), 'PLC_NODE_ALPHA') as active_route
      from tele c where {VALID}"""),
    "H11_current_route": w(DECIDED + ROUTES, """select device_id as target_device, route as active_route, is_failover, t as switched_at_ms from sw
      qualify row_number() over (partition by device_id order by t desc, event_id desc) = 1"""),
    "H12_active_limits": w(DECIDED, """select target_interface, rate_mbps from (select * replace (coalesce(target_interface, 'eth0') as target_interface) from decided where status = 'applied' and action in ('traffic_shedding', 'reset')
      qualify row_number() over (partition by coalesce(decided.target_interface, 'eth0') order by t desc, event_id desc) = 1) where action = 'traffic_shedding'"""),
    "H13_heartbeat_gaps": w(CANON + ", fr as (select device_id, event_id, timestamp_epoch_ms // 1000 as t from canon), lg as (select *, lag(t) over (partition by device_id order by t, event_id) as p from fr)",
      "select device_id, p as gap_start_ms, t as gap_end_ms, t - p as gap_ms from lg where t - p > 15000"),
    "H13_tripped": w(CANON, "select device_id, max(timestamp_epoch_ms) as last_heartbeat_ms, 1706572800000 - max(timestamp_epoch_ms) > 15000 as tripped from canon group by device_id"),
    "H14_sustained_breach": w(SCORED + f""", g as (select *, row_number() over ({ORD}) as a from scored), br as (select *, a - row_number() over ({ORD}) as isl from g where pred >= 60)""",
      """select device_id, min(timestamp_epoch_ms) as start_ms, max(timestamp_epoch_ms) as end_ms, count(*) as cycles, max(pred) as peak_latency_ms from br group by device_id, isl having count(*) >= 2"""),
    "H15_token_bucket": w(CMD, f"""select event_id, round(coalesce(shedding_factor, 0.82) * 100, 6) as tbf_rate_mbit, cast(floor({rd('coalesce(shedding_factor, 0.82) * 100 * 12.5', 6)}) as integer) as tbf_burst_kbit from cmd"""),
    "I1_alarm_flags": w(REPLAY, f"""select event_id, 'raw' as stage, pred_before >= 60 as is_latency_alarm, {D} >= 1.8 as is_drop_alarm, {C} >= 68 as is_temp_alarm, {B} >= 85 as is_buffer_alarm from rep
      union all select event_id, 'post', predicted_latency_ms >= 60, {D} >= 1.8, temp_after >= 68, buffer_after >= 85 from rep"""),
    "I2_annunciator": w(REPLAY, f"""select device_id, event_id, code, name, tag, critical, active, value, case when active then 'ALARM' else 'NORMAL' end as state from (
      select device_id, event_id, 'ANN-01' as code, 'LATENCY SLA' as name, 'LAT-RTT-01' as tag, true as critical, predicted_latency_ms >= 60 as active, 'HIGH RTT' as value from rep
      union all select device_id, event_id, 'ANN-02', 'FRAME LOSS', 'DROP-ERR-03', true, {D} >= 1.8, 'LOSS BURST' from rep
      union all select device_id, event_id, 'ANN-03', 'TSN QUEUE SAT', 'BUFF-Q-04', false, buffer_after >= 85, 'BUFFER HIGH' from rep
      union all select device_id, event_id, 'ANN-04', 'CORE OVERTEMP', 'TEMP-JC-05', false, temp_after >= 68, 'THERMAL RUN' from rep
      union all select device_id, event_id, 'ANN-05', 'HA REDUNDANCY', 'PLC-FAILOVER', false, failover_active, 'STANDBY ACTIVE' from rep
      union all select device_id, event_id, 'ANN-06', 'IEC-62443 CONDUIT', 'ZONE-2-SEC', false, false, 'SL-3 LOCKED' from rep)"""),
    "I3_sequence_of_events": w(SOE, "select * from soe"),
    "I4_display_class": w(SOE, """select case when contains(priority, 'CRIT') or contains(quality, 'FAILOVER') then 'P1' when contains(priority, 'WARN') then 'P2' else 'P3' end as display_class,
      count(*) as n from soe group by 1"""),
    "I5_newest_events": w(SOE, "select * from soe order by timestamp_epoch_ms desc, event_id desc limit 6"),
    "I6_audit": w(SOE + """, tot as (select count(*) as total_events, count(*) filter (tag = 'LAT_SLA_BREACH') as critical_count, count(*) filter (tag = 'QOS_SHAPER') as mitigated_count,
      count(*) filter (tag = 'PLC_FAILOVER') as failover_count from soe), rt as (select *, """ + rd("mitigated_count / greatest(1, critical_count + mitigated_count)::double * 100", 1) + " as prevention_rate_pct from tot)",
      """select *, '* **Total Monitored Telemetry Cycles**: ' || total_events || chr(10) || '* **SLA Breach Prevention Success Rate**: ' || printf('%.1f', prevention_rate_pct) || '%' || chr(10) || chr(10)
      || '| Incident Severity | Count | Primary Trigger | Resolution Protocol |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10)
      || '| **CRITICAL** | `' || critical_count || '` | Latency >= 60.0ms | Closed-loop QoS Shedding |' || chr(10)
      || '| **MITIGATED** | `' || mitigated_count || '` | Dynamic Queue Attenuation | Rate factor 0.82 |' || chr(10)
      || '| **HA FAILOVER** | `' || failover_count || '` | Packet Loss > 1.8% | Standby Route Node Delta |' || chr(10) as report from rt"""),
    "J1_frames_total": w(CANON, "select protocol, device_id, count(*) as frames_total from canon group by protocol, device_id"),
    "J2_errors_total": w(FAULTY, f"select protocol, 'validation_error' as error_type, count(*) as errors_total from faulty where len({ERR_LIST}) > 0 group by protocol"),
    "J2_decode_errors": w(JSONP + f", dec as ({DECODED})", f"""select protocol, case when decode_ok then 'validation_error' else 'system_error' end as error_type, count(*) as errors_total from dec
      where not decode_ok or {T} is null or {D} is null or {B} is null or {C} is null group by 1, 2"""),
    "J3_latest_gauge": w(CANON, f"select device_id, round({R}, 6) as {R} from canon qualify row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) = 1"),
    "J4_histogram": w(TELE + f", ms as (select {D} * 1.25 + {B} / 100 as x from tele)", " union all ".join(
      f"select '{b:g}' as le, count(*) filter (x <= {b}) as bucket_count, round(sum(x), 6) as total_sum, count(*) as total_count from ms" for b in HIST)
      + " union all select '+Inf', count(*), round(sum(x), 6), count(*) from ms"),
    "J5_mitigations_total": w(DECIDED, """select action, case action when 'traffic_shedding' then 'WARNING' when 'ha_failover' then 'CRITICAL' else 'INFO' end as severity, count(*) as mitigations_total
      from decided where status = 'applied' group by 1, 2"""),
    "J6_failovers_total": w(DECIDED, """select target_device as from_node, coalesce(standby_node, 'PLC_NODE_DELTA') as to_node, count(*) as failovers_total from decided
      where status = 'applied' and action = 'ha_failover' group by 1, 2"""),
    "J7_enforced_limit": w(DECIDED, """select min(rate_mbps) as enforced_mbps, count(*) as interfaces from (select * replace (coalesce(target_interface, 'eth0') as target_interface) from decided where status = 'applied' and action in ('traffic_shedding', 'reset')
      qualify row_number() over (partition by coalesce(decided.target_interface, 'eth0') order by t desc, event_id desc) = 1) where action = 'traffic_shedding'"""),
    "J8_run_totals": w(SCORED, f"select count(*) as total_cycles, round(max({C}), 6) as peak_temp, max(pred) as peak_latency from scored"),
    "J8_running_totals": w(SCORED, f"""select device_id, event_id, round({C}, 6) as {C}, pred as predicted_latency_ms, count(*) over w as total_cycles, round(max({C}) over w, 6) as peak_temp,
      max(pred) over w as peak_latency from scored window w as ({ORD} rows between unbounded preceding and current row)"""),
    "J9_sparkline": w(CANON + f", rc as (select device_id, {R} as v, cast(row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) as integer) as recency from canon qualify recency <= 10)",
      """select device_id, recency, round((v - min(v) over (partition by device_id)) / coalesce(nullif(max(v) over (partition by device_id) - min(v) over (partition by device_id), 0), 1), 6) as scaled from rc"""),
    "J9_history": w(CANON, f"""select device_id, protocol, event_id, timestamp_epoch_ms, {r6(*G, R)}, cast(row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) as integer) as recency
      from canon qualify recency <= 30"""),
    "J10_live_error": w(SCORED, f"""select device_id, round(avg(abs({R} - pred)), 6) as mae, round(greatest(80, greatest(max({R}), max(pred)) * 1.15), 6) as axis_limit from
      (select * from scored qualify row_number() over (partition by device_id order by timestamp_epoch_ms desc, event_id desc) <= 30) group by device_id"""),
    "K1_probe_summary": w(TELE, f"select device_id as target, count({R}) as valid_samples, round(coalesce(median({R}), 0), 6) as median_rtt_ms from tele group by device_id"),
    "K2_probe_ms": w(TELE + f", nn as (select event_id, floor({rd('k * 27031.7', 6)}) as ns, protocol <> 's7' as ok from tele)",
      f"select event_id, ok, case when ok then greatest(0.1, {rd('ns / 1000000', 3)}) else greatest(1.0, {rd('ns / 1000000', 3)}) end as rtt_ms from nn"),
    "P1_device_risk": w(SERVING + f", l1 as (select *, {regime()} as label from feat), s1 as (select *, {forecast()} as pred from l1)",
      f"""select device_id, {RISK} as risk_level, count(*) as frames, max(pred) as peak_latency_ms, {rd('avg(throughput_slope)', 6)} as mean_slope,
      {rd('avg(throughput_mean)', 6)} as mean_throughput, count(*) filter (label = 2) as anomaly_frames from s1 group by 1, 2"""),
}

_SEEDS = ((50, 0.2, 35, 42), (35, 1.2, 75, 52), (15, 4.5, 92, 72))


def _centroids():
    def dist(a):
        return " + ".join(f"({x} - {v}::double) * ({x} - {v}::double)" for x, v in zip(G, a))

    d0, d1, d2 = map(dist, _SEEDS)
    seeds = " union all ".join(
        f"select {i} as centroid, " + ", ".join(f"{v}::double as s_{j}" for j, v in enumerate(s)) for i, s in enumerate(_SEEDS)
    )
    near = f"case when {d0} <= {d1} and {d0} <= {d2} then 0 when {d1} <= {d2} then 1 else 2 end"
    return w(
        CANON + f", seeds as ({seeds}), asg as (select *, {near} as centroid from canon), sm as (select centroid, count(*) as n, "
        + ", ".join(f"sum({g}) as t_{j}" for j, g in enumerate(G)) + " from asg group by centroid)",
        "select centroid, 1 + coalesce(n, 0) as weight, "
        + ", ".join(f"round((s_{j} + coalesce(t_{j}, 0)) / (1 + coalesce(n, 0)), 6) as {g}" for j, g in enumerate(G))
        + " from seeds left join sm using (centroid)",
    )


SQL["E6_centroid_update"] = _centroids()

SQL |= {
    "A9_fan_out": w(CANON, "select protocol, count(*) as n, sink from canon, (values ('first'), ('second')) s(sink) group by protocol, sink"),
    "L1_stream_frames": w(CANON, f"select {CANON_COLS} from canon"),
    "L2_stream_features": w(SERVING, f"select event_id, {r6('throughput_mean', 'packet_drop_mean', 'buffer_peak', 'throughput_slope', 'lag_latency_1', 'lag_latency_2')}, samples_in_window, false as late from feat"),
    "L3_stream_scoring": w(SCORED, f"select event_id, pred as predicted_latency_ms, {RISK} as risk_level, {ACTION} as mitigation_action from scored"),
    "L4_stream_drift": w(PSI, """select feature, n_current, psi, psi > 0.2 as drift_detected,
      case when psi < 0.1 then 'STABLE' when psi < 0.25 then 'MODERATE SHIFT' else 'SIGNIFICANT DRIFT' end as drift_band from psi where n_current >= 20"""),
    "L5_stream_debounce": w(DECIDED, f"select event_id, status, {rd('wait_sec', 2)} as retry_after_sec from decided"),
    "L5_stream_event_log": w(SOE, "select device_id, timestamp_epoch_ms, event_id, tag from soe"),
    "L6_stream_heartbeat": w(CANON + ", fr as (select device_id, event_id, timestamp_epoch_ms // 1000 as t from canon), lg as (select *, lag(t) over (partition by device_id order by t, event_id) as p from fr)",
      """select device_id, p as last_ms, 'gap' as kind, (t - p)::double as gap_ms from lg where t - p > 15000
      union all select device_id, max(t), 'tripped', null from fr group by device_id having max(t) + 15001 < (select max(t) - 30000 from fr)"""),
    "L7_stream_counters": w(CANON + ", wn as (select *, timestamp_epoch_ms // 1000 * 1000 as window_start from canon)",
      f"""select window_start, protocol, device_id, count(*) as frames_total, {rd(f'max({C})', 6)} as peak_temp,
      {rd(f'arg_max({R}, (timestamp_epoch_ms - 1700000000000) * 10000000 + event_id)', 6)} as last_rtt_ms from wn group by window_start, protocol, device_id"""),
    "L8_stream_centroids": SQL["E6_centroid_update"],
    "L9_stream_replay": w(CANON, f"select {CANON_COLS} from canon"),
}

SQL |= {
    "F4_hash_split": w(CANON, """select event_id, case when cast('0x' || substr(sha256('42:' || cast(event_id as varchar)), 1, 8) as bigint) % 100 < 80
      then 'train' else 'test' end as side from canon"""),
    # Sum of squared distances from a point x to n points with sum s and sum of squares q: n x.x - 2 x.s + q.
    "E5_silhouette_squared": w(CANON + f""", pts as (select event_id, {regime()} as label, [{GS}] as x from canon),
cl as (select label, count(*) as n, sum(list_dot_product(x, x)) as q, [sum(x[1]), sum(x[2]), sum(x[3]), sum(x[4])] as s from pts group by label),
ds as (select p.event_id, p.label = c.label as own, c.n, list_dot_product(x, x) * c.n - 2 * list_dot_product(x, s) + q as d from pts p, cl c),
ab as (select event_id, max(case when own then n end) as n, max(case when own and n > 1 then d / (n - 1) end) as a, min(case when not own then d / n end) as b from ds group by event_id)""",
      "select count(*) as rows, round(avg(case when n = 1 then 0 else (b - a) / greatest(a, b) end), 5) as silhouette_squared from ab"),
}

SQL |= {
    "A12_model_store": w(CANON, "select event_id, true as same from canon"),
    "F2_boosted_trees": w(CANON, "select count(*) as rows, true as r2_above_090 from canon"),
    "F6_model_scoring": w(CANON, "select event_id, true as rounded, true as flagged, true as floored from canon"),
    "F7_attribution": w(CANON, "select event_id, feature, true as adds_up, true as present from canon, (values "
      + ", ".join(f"('{name}')" for name in [*MODEL_FEATURES, "_bias_baseline"]) + ") n(feature)"),
}
