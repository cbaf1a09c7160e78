"""Root-cause rules: risk level, findings, action, narrative."""

from pyspark.sql import functions as F

from plantpulse.functions.numbers import dp, fixed
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DROP, TEMP, THROUGHPUT

# Texts and limits of the diagnosis.
PRIMARY_NODE = "PLC_NODE_ALPHA"
STANDBY_NODE = "PLC_NODE_DELTA"
V_LINK = "Physical Link Degradation / Packet Loss Burst"
V_QUEUE = "TSN Socket Queue Depth Saturation"
V_HEAT = "Processor Core Thermal Load Throttling"
V_SURGE = "Ingress Network Bandwidth Surge"
V_NONE = "Nominal Operation"
E_NONE = "All sensor telemetry channels operating within deterministic engineering bounds."
S_STABLE = (
    "All communication channels and node queues are operating deterministically within nominal parameters."
)
R_STABLE = "No mitigation required. System is running with optimal deterministic QoS."
CONFIDENCE = 0.95
QUEUE_LIMIT = 65.0
QUEUE_CRITICAL = 85.0
SURGE_LIMIT = 110.0
THERMAL_SHED = 0.65
WARN_MARGIN_MS = 8.0
IMPACT_DEFAULT = {DROP: 8.5, BUFFER: 4.2}


def risk_level(pred, p=DEFAULTS):
    return (
        F.when(F.col(pred) >= p.sla_latency_ms, F.lit("CRITICAL_BREACH"))
        .when(F.col(pred) >= p.sla_latency_ms - WARN_MARGIN_MS, F.lit("WARNING_APPROACHING_LIMIT"))
        .otherwise(F.lit("NOMINAL_STABLE"))
    )


def urgency(pred, p=DEFAULTS):
    return (
        F.when(F.col(pred) >= p.sla_latency_ms, F.lit("IMMEDIATE_ACTION_REQUIRED"))
        .when(F.col(pred) >= p.sla_latency_ms - WARN_MARGIN_MS, F.lit("PROACTIVE_REGULATION_RECOMMENDED"))
        .otherwise(F.lit("NO_ACTION_NEEDED"))
    )


def _finding(vector, evidence, severity):
    return F.struct(
        F.lit(vector).alias("vector"), evidence.alias("evidence"), severity.alias("severity")
    )


def _impact(attributions, key):
    value = F.lit(IMPACT_DEFAULT[key])
    if attributions is not None:
        value = F.coalesce(F.try_element_at(F.col(attributions), F.lit(key)), value)
    return fixed(value, 1)


def findings(attributions=None, p=DEFAULTS):
    """``array<struct<vector,evidence,severity>>`` in fixed order, never empty."""
    drop, buf, temp, rate = F.col(DROP), F.col(BUFFER), F.col(TEMP), F.col(THROUGHPUT)
    link = _finding(
        V_LINK,
        F.concat(
            F.lit("Frame drop rate ("), fixed(drop, 2),
            F.lit(f"%) exceeds safety threshold ({p.failover_drop:.1f}%). TreeSHAP impact: +"),
            _impact(attributions, DROP), F.lit(" ms."),
        ),
        F.lit("HIGH"),
    )
    queue = _finding(
        V_QUEUE,
        F.concat(
            F.lit("Buffer capacity utilization at "), fixed(buf, 1),
            F.lit("%. High risk of packet jitter and tail-drop. TreeSHAP impact: +"),
            _impact(attributions, BUFFER), F.lit(" ms."),
        ),
        F.when(buf < QUEUE_CRITICAL, F.lit("MEDIUM")).otherwise(F.lit("CRITICAL")),
    )
    heat = _finding(
        V_HEAT,
        F.concat(
            F.lit("Die temperature ("), fixed(temp, 1),
            F.lit(f" °C) exceeded limit ({p.throttle_temp:.1f} °C). Compute clock throttling induced "),
            fixed(temp * 0.1, 1), F.lit(" ms latency penalty."),
        ),
        F.lit("HIGH"),
    )
    surge = _finding(
        V_SURGE,
        F.concat(F.lit("Ingress data rate ("), fixed(rate, 1), F.lit(" Mbps) exceeds baseline capacity.")),
        F.lit("MEDIUM"),
    )
    rules = [
        (drop >= p.failover_drop, link), (buf >= QUEUE_LIMIT, queue), (temp >= p.throttle_temp, heat),
        (rate > SURGE_LIMIT, surge),
    ]
    nothing = F.lit(True)
    for broken, _ in rules:
        nothing = nothing & ~F.coalesce(broken, F.lit(False))
    rules.append((nothing, _finding(V_NONE, F.lit(E_NONE), F.lit("INFO"))))
    return F.filter(F.array(*[F.when(c, f) for c, f in rules]), lambda f: f.isNotNull())


def action(p=DEFAULTS):
    return (
        F.when(F.col(DROP) >= p.failover_drop, F.lit("ha_failover"))
        .when(F.col(BUFFER) >= QUEUE_LIMIT, F.lit("traffic_shedding"))
        .when(F.col(TEMP) >= p.throttle_temp, F.lit("traffic_shedding"))
        .otherwise(F.lit("none"))
    )


def action_params(p=DEFAULTS):
    """``struct<target_device,standby_node,shedding_factor,reason>``; null when there is no action."""
    drop, buf, temp = F.col(DROP), F.col(BUFFER), F.col(TEMP)

    def params(standby, factor, reason):
        return F.struct(
            F.lit(PRIMARY_NODE).alias("target_device"),
            F.lit(standby).cast("string").alias("standby_node"),
            F.lit(factor).cast("double").alias("shedding_factor"),
            reason.alias("reason"),
        )

    return (
        F.when(
            drop >= p.failover_drop,
            params(
                STANDBY_NODE, None,
                F.concat(F.lit("Automated failover due to frame drop rate of "), fixed(drop, 2), F.lit("%")),
            ),
        )
        .when(
            buf >= QUEUE_LIMIT,
            params(
                None, p.shedding_factor,
                F.concat(
                    F.lit("Dynamic traffic attenuation to relieve queue saturation ("),
                    fixed(buf, 1), F.lit("%)"),
                ),
            ),
        )
        .when(
            temp >= p.throttle_temp,
            params(
                None, THERMAL_SHED,
                F.concat(F.lit("Thermal throttling mitigation at "), fixed(temp, 1), F.lit(" °C")),
            ),
        )
    )


def expected_reduction(pred, p=DEFAULTS):
    return F.col(pred) * F.lit(1.0 - p.shedding_factor)


def summary_text(pred, risk, vector, evidence, p=DEFAULTS):
    return F.when(
        risk != "NOMINAL_STABLE",
        F.concat(
            F.lit("**Root Cause Identified**: `"), vector, F.lit("`. "), evidence,
            F.lit(" Forecasted latency is **"), fixed(F.col(pred), 1),
            F.lit(f" ms** against the **{p.sla_latency_ms:.0f} ms** SLA constraint."),
        ),
    ).otherwise(F.lit(S_STABLE))


def recommendation_text(pred, risk, act, p=DEFAULTS):
    return F.when(
        risk != "NOMINAL_STABLE",
        F.concat(
            F.lit("Recommended action: **"), F.upper(act), F.lit(f"** on `{PRIMARY_NODE}`. "),
            F.lit("Anticipated latency reduction: **-"), fixed(dp(expected_reduction(pred, p), 9), 1),
            F.lit(" ms**."),
        ),
    ).otherwise(F.lit(R_STABLE))
