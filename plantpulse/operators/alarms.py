"""Alarm flags, annunciator, sequence-of-events log, audit."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.numbers import dp, fixed
from plantpulse.operators.blockscan import entry_states
from plantpulse.operators.policy import PRED
from plantpulse.operators.series import BLOCK, OWN, open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import BUFFER, DEVICE, DROP, EPOCH_MS, ROW_ID, TEMP

BUFFER_ALARM = 85.0

# Annunciator tiles as (flag, code, name, tag, critical, state shown when active).
TILES = [
    ("is_latency_alarm", "ANN-01", "LATENCY SLA", "LAT-RTT-01", True, "HIGH RTT"),
    ("is_drop_alarm", "ANN-02", "FRAME LOSS", "DROP-ERR-03", True, "LOSS BURST"),
    ("is_buffer_alarm", "ANN-03", "TSN QUEUE SAT", "BUFF-Q-04", False, "BUFFER HIGH"),
    ("is_temp_alarm", "ANN-04", "CORE OVERTEMP", "TEMP-JC-05", False, "THERMAL RUN"),
    ("failover_active", "ANN-05", "HA REDUNDANCY", "PLC-FAILOVER", False, "STANDBY ACTIVE"),
    (None, "ANN-06", "IEC-62443 CONDUIT", "ZONE-2-SEC", False, "SL-3 LOCKED"),
]

# Event kinds in order of precedence as (tag, alarm id, priority, quality).
EVENTS = [
    ("PLC_FAILOVER", "ALM-2041", "P1-CRIT", "FAILOVER_0x02"),
    ("QOS_SHAPER", "ALM-3012", "P2-WARN", "MITIGATED_0x01"),
    ("LAT_SLA_BREACH", "ALM-4089", "P1-CRIT", "BAD_0x03"),
]
OTHER = 0  # last tag is none of the three


def alarm_flags(replayed, stage="post", p=DEFAULTS):
    """Alarm booleans of a replayed frame. ``stage='post'`` looks at latency, buffer and temperature after the
    policy acted, ``'raw'`` before; packet drop is always the measured one."""
    post = stage == "post"
    latency, buffer, temp = (PRED, "buffer_after", "temp_after") if post else ("pred_before", BUFFER, TEMP)
    return replayed.withColumns(
        {
            "is_latency_alarm": F.col(latency) >= p.sla_latency_ms,
            "is_drop_alarm": F.col(DROP) >= p.failover_drop,
            "is_temp_alarm": F.col(temp) >= p.throttle_temp,
            "is_buffer_alarm": F.col(buffer) >= BUFFER_ALARM,
        }
    )


def annunciator(flagged):
    """One row per frame and tile. The six tiles are an in-row array, so there is no join."""
    tiles = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(tag).alias("tag"),
                F.lit(crit).alias("critical"), (F.col(flag) if flag else F.lit(False)).alias("active"),
                F.lit(text).alias("value"),
            )
            for flag, code, name, tag, crit, text in TILES
        ]
    )
    return (
        flagged.select(DEVICE, EPOCH_MS, ROW_ID, F.explode(tiles).alias("tile"))
        .select(DEVICE, EPOCH_MS, ROW_ID, "tile.*")
        .withColumn("state", F.when(F.col("active"), F.lit("ALARM")).otherwise(F.lit("NORMAL")))
    )


def _transitions():
    """``table[code][state]``: state after a cycle. Codes 0-7 hold the three flags as bits in order of
    precedence, code 8 is a fixed event that sets the last tag to something else."""
    table = np.zeros((9, 4), dtype="int64")
    for code in range(8):
        for state in range(4):
            wanted = [i + 1 for i in range(3) if code >> i & 1 and state != i + 1]
            table[code, state] = wanted[0] if wanted else state
    table[8] = OTHER
    return table


TRANSITIONS = _transitions()


def state_maps(codes):
    """For each cycle the map from the state before the first cycle to the state after this one."""
    maps, shift = TRANSITIONS[codes], 1
    while shift < len(maps):
        maps = np.concatenate([maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift], axis=1)])
        shift *= 2
    return maps


def segment_maps(codes, begins):
    """``state_maps`` of many keys at once: ``begins`` marks the first cycle of each; no map reaches back beyond it."""
    maps, segment, shift = TRANSITIONS[codes], np.cumsum(begins), 1
    while shift < len(maps):
        same = segment[shift:] == segment[:-shift]
        if not same.any():
            break
        joined = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)
        maps = np.concatenate([maps[:shift], np.where(same[:, None], joined, maps[shift:])])
        shift *= 2
    return maps


def sequence_of_events(replayed, fixed_events=None, keys=(DEVICE,), p=DEFAULTS, largest=None):
    """At most one event per cycle: failover, else shedding, else breach, each only when the last logged tag is a
    different one. ``fixed_events(keys.., timestamp_epoch_ms, event_id, alarm_id, priority, tag, event, quality)``
    are logged as they are and also become the last tag.

    The log of a key is a four-state machine. The keys of a partition run through one Python call in order, all state maps being
    composed at once; a larger key runs block by block, each block being summarised by its state map."""
    keys = list(keys)
    code = (
        F.col("failover_active").cast("int")
        + F.col("mitigation_active").cast("int") * 2
        + (F.col(PRED) >= p.sla_latency_ms).cast("int") * 4
    )
    cycles = replayed.select(*keys, EPOCH_MS, ROW_ID, DROP, PRED, code.alias("code"))
    if fixed_events is not None:
        cycles = cycles.unionByName(fixed_events.withColumn("code", F.lit(8)), allowMissingColumns=True)
    # Code 0 changes nothing, so such cycles need not be ordered.
    s = open_series(cycles.where("code > 0"), keys, EPOCH_MS, ROW_ID, 0, p.max_python_group_rows, largest)
    df = s.df
    if s.split:
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

        def summarise(pdf):
            codes = pdf.sort_values([EPOCH_MS, ROW_ID])["code"].to_numpy()
            return pdf.iloc[:1][keys + [BLOCK]].assign(lo=[np.arange(4)], out=[state_maps(codes)[-1]])

        functions = (
            df.select(*keys, BLOCK, EPOCH_MS, ROW_ID, "code")
            .groupBy(*keys, BLOCK)
            .applyInPandas(summarise, f"{types}, {BLOCK} int, lo array<long>, out array<long>")
        )
        df = df.join(entry_states(functions, keys, OTHER), keys + [BLOCK])
    else:
        df = df.withColumn("entry", F.lit(OTHER).cast("long"))
    schema = T.StructType(df.schema.fields + [T.StructField("logged", T.IntegerType())])

    group = s.group_keys

    def run(batches):
        last, carried = None, OTHER
        for batch in batches:
            if not len(batch):
                continue
            codes, entry = (batch.column(c).to_numpy() for c in ("code", "entry"))
            key = [batch.column(k).to_pylist() for k in group]
            begins = np.ones(len(codes), dtype=bool)
            begins[1:] = np.any([[a != b for a, b in zip(k[1:], k[:-1], strict=True)] for k in key], axis=0)
            if last is not None and [k[0] for k in key] == last:  # the key goes on from the batch before
                begins[0], entry = False, entry.copy()
                entry[:int(np.argmax(begins)) if begins.any() else None] = carried
            after = np.take_along_axis(segment_maps(codes, begins), entry[:, None], axis=1)[:, 0]
            before = np.where(begins, entry, np.concatenate([[carried], after[:-1]]))
            last, carried = [k[-1] for k in key], after[-1]
            logged = np.where(codes == 8, 8, np.where(after != before, after, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logged, pa.int32())], names=[*batch.schema.names, "logged"])

    ordered = df.repartition(*group).sortWithinPartitions(*group, EPOCH_MS, ROW_ID)
    events = ordered.mapInArrow(run, schema).where("logged > 0").drop("entry", BLOCK, OWN)
    texts = [
        F.concat(
            F.lit("HA Failover actuated: Packet drop "), fixed(F.col(DROP), 2),
            F.lit(f"% exceeded limit {p.failover_drop:.2f}%. Standby Node Delta active."),
        ),
        F.concat(
            F.lit("Linux tc traffic shaper applied. Bounded latency to "), fixed(F.col(PRED), 2), F.lit(" ms."),
        ),
        F.concat(
            F.lit("Latency limit breach: "), fixed(F.col(PRED), 2),
            F.lit(f" ms exceeded threshold {p.sla_latency_ms:.1f} ms."),
        ),
    ]
    names = ("tag", "alarm_id", "priority", "quality", "event")

    def column(i, name):
        out = F.col(f"_{name}") if fixed_events is not None else F.lit(None).cast("string")
        for state, event in enumerate(EVENTS, 1):
            value = texts[state - 1] if name == "event" else F.lit(event[i])
            out = F.when(F.col("logged") == state, value).otherwise(out)
        return out.alias(name)

    if fixed_events is not None:
        events = events.withColumnsRenamed({n: f"_{n}" for n in names})
    return events.select(*keys, EPOCH_MS, ROW_ID, *[column(i, n) for i, n in enumerate(names)])


def display_class(events):
    """P1, P2 or P3 of a logged event."""
    crit = F.col("priority").contains("CRIT") | F.coalesce(F.col("quality").contains("FAILOVER"), F.lit(False))
    return events.withColumn(
        "display_class",
        F.when(crit, F.lit("P1")).when(F.col("priority").contains("WARN"), F.lit("P2")).otherwise(F.lit("P3")),
    )


def newest(events, n=6):
    """Newest events first; ``n=None`` sorts the whole log."""
    ordered = events.orderBy(F.col(EPOCH_MS).desc(), F.col(ROW_ID).desc())
    return ordered if n is None else ordered.limit(n)


def severity(events):
    """Severity of a logged event: CRITICAL, MITIGATED, FAILOVER or INFO."""
    return events.withColumn(
        "severity",
        F.when(F.col("quality").contains("FAILOVER"), F.lit("FAILOVER"))
        .when(F.col("quality").contains("MITIGATED"), F.lit("MITIGATED"))
        .when(F.col("priority").contains("CRIT"), F.lit("CRITICAL"))
        .otherwise(F.lit("INFO")),
    )


def audit_summary(incidents, column="severity", p=DEFAULTS):
    """One row: totals per severity, prevention rate, report text."""
    count = lambda name: F.count_if(F.col(column) == name)
    totals = incidents.agg(
        F.count(F.lit(1)).alias("total_events"), count("CRITICAL").alias("critical_count"),
        count("MITIGATED").alias("mitigated_count"), count("FAILOVER").alias("failover_count"),
    )
    handled = F.greatest(F.lit(1), F.col("critical_count") + F.col("mitigated_count"))
    rate = dp(F.col("mitigated_count") / handled * 100.0, 1)
    text = F.format_string(
        "* **Total Monitored Telemetry Cycles**: %d\n"
        "* **SLA Breach Prevention Success Rate**: %.1f%%\n\n"
        "| Incident Severity | Count | Primary Trigger | Resolution Protocol |\n"
        "| :--- | :--- | :--- | :--- |\n"
        f"| **CRITICAL** | `%d` | Latency >= {p.sla_latency_ms}ms | Closed-loop QoS Shedding |\n"
        f"| **MITIGATED** | `%d` | Dynamic Queue Attenuation | Rate factor {p.shedding_factor} |\n"
        f"| **HA FAILOVER** | `%d` | Packet Loss > {p.failover_drop}%% | Standby Route Node Delta |\n",
        "total_events", "prevention_rate_pct", "critical_count", "mitigated_count", "failover_count",
    )
    return totals.withColumn("prevention_rate_pct", rate).withColumn("report", text)
