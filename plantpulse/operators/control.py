"""Mitigation commands: debounce, approval, resolution, active route and rate limit, heartbeat gaps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.diagnosis import PRIMARY_NODE, STANDBY_NODE
from plantpulse.functions.numbers import dp, falsy_default
from plantpulse.operators.blockscan import KEEP, NEVER, compress, entry_states
from plantpulse.operators.series import BLOCK, OWN, open_series
from plantpulse.params import DEFAULTS
from plantpulse.schemas import DEVICE, EPOCH_MS, ROW_ID

# Supported actions and the severity each is counted under.
ACTION_SEVERITY = {"traffic_shedding": "WARNING", "ha_failover": "CRITICAL", "reset": "INFO"}

APPLIED, LIMITED, PENDING, REJECTED = "applied", "rate_limited", "pending_approval", "rejected"


# Fixed value: interface of commands that name none.
DEFAULT_INTERFACE = "eth0"


def resolve(commands, p=DEFAULTS):
    """Requested rate (null unless shedding), approval and support flags of each command."""
    factor = falsy_default(F.col("shedding_factor"), p.shedding_factor)
    rate = falsy_default(F.col("target_rate_mbps"), F.lit(100.0) * factor)
    approved = F.coalesce(F.length("approved_by") > 0, F.lit(False))
    return commands.withColumns(
        {
            "supported": F.coalesce(F.col("action").isin(*ACTION_SEVERITY), F.lit(False)),
            "awaits_approval": F.coalesce(F.col("requires_approval"), F.lit(False)) & ~approved,
            "rate_mbps": F.when(F.col("action") == "traffic_shedding", F.greatest(F.lit(1.0), dp(rate, 2))),
        }
    )


def next_allowed(times, wait):
    """For sorted distinct times: index of the first one at least ``wait`` after each (len(times) if none)."""
    return np.searchsorted(times, times + wait, side="left")


def debounce_summary(times, wait):
    """Step function from the last applied time before the block to the last applied time after it."""
    if len(times) == 0:
        return np.array([NEVER]), np.array([KEEP])
    nxt = next_allowed(times, wait)
    last = np.where(nxt < len(times), nxt, np.arange(len(times)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    lo = np.concatenate([[NEVER], times - wait + 1])
    out = np.concatenate([times[last], [KEEP]])
    reachable = lo < times[0]
    return compress(lo[reachable], out[reachable])


def applied_positions(times, wait, entry):
    """Indexes that are applied, given the last applied time on entry."""
    nxt = next_allowed(times, wait)
    at, picked = int(np.searchsorted(times, entry + wait, side="left")), []
    while at < len(times):
        picked.append(at)
        at = int(nxt[at])
    return np.array(picked, dtype="int64")


def debounce(commands, key="target_device", time=EPOCH_MS, tie=ROW_ID, p=DEFAULTS, largest=None):
    """Status of every command: ``rate_limited`` when less than the debounce interval has passed since the last
    *applied* one, then ``pending_approval``, then ``rejected``, else ``applied``. ``key=None`` keeps one timer
    for all commands.

    Only applied commands restart the timer, so the outcome is sequential per key. A key of ordinary size is
    one group. A larger key runs block by block, the blocks being linked by :mod:`blockscan`."""
    wait = int(round(p.debounce_sec * 1000))
    rows = resolve(commands, p)
    if key is None:
        rows, keys = rows.withColumn("_timer", F.lit(0)), ["_timer"]
    else:
        keys = [key]
    s = open_series(rows, keys, time, tie, 0, p.max_python_group_rows, largest)
    df = s.df

    def free_times(table):
        free = np.asarray(table["supported"].to_numpy(zero_copy_only=False), dtype=bool) & ~np.asarray(
            table["awaits_approval"].to_numpy(zero_copy_only=False), dtype=bool
        )
        return table[time].to_numpy(), free

    if s.split:
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

        def summarise(pdf):
            free = pdf["supported"] & ~pdf["awaits_approval"]
            lo, out = debounce_summary(np.unique(pdf.loc[free, time].to_numpy("int64")), wait)
            return pdf.iloc[:1][keys + [BLOCK]].assign(lo=[lo], out=[out])

        functions = (
            df.select(*keys, BLOCK, time, "supported", "awaits_approval")
            .groupBy(*keys, BLOCK)
            .applyInPandas(summarise, f"{types}, {BLOCK} int, lo array<long>, out array<long>")
        )
        df = df.join(entry_states(functions, keys, NEVER), keys + [BLOCK])
    else:
        df = df.withColumn("entry", F.lit(NEVER).cast("long"))

    schema = T.StructType(
        df.schema.fields
        + [T.StructField("status", T.StringType()), T.StructField("retry_after_sec", T.DoubleType())]
    )

    def decide(table):
        table = table.sort_by([(time, "ascending"), (tie, "ascending")])
        ts, free = free_times(table)
        entry = table["entry"][0].as_py()
        free_rows = np.flatnonzero(free)
        distinct, first = np.unique(ts[free_rows], return_index=True)
        applied = free_rows[first[applied_positions(distinct, wait, entry)]]
        previous = np.searchsorted(applied, np.arange(len(ts)), side="left") - 1
        before = np.concatenate([[entry], ts[applied]])[previous + 1]
        elapsed = ts - before
        limited = elapsed < wait
        pending = table["awaits_approval"].to_numpy(zero_copy_only=False)
        supported = table["supported"].to_numpy(zero_copy_only=False)
        status = np.where(
            limited, LIMITED, np.where(pending, PENDING, np.where(supported, APPLIED, REJECTED))
        )
        left = np.where(limited, (wait - elapsed) / 1000.0, np.nan)
        return table.append_column("status", pa.array(status.tolist(), pa.string())).append_column(
            "retry_after_sec", pa.array(left, pa.float64(), from_pandas=True)
        )

    out = df.groupBy(*s.group_keys).applyInArrow(decide, schema).drop("entry", BLOCK, OWN)
    out = out.withColumn("retry_after_sec", dp(F.col("retry_after_sec"), 2))
    return out.drop("_timer") if key is None else out


def route_changes(decided):
    """Applied commands that set the route: failover to the standby, reset to the primary."""
    to = F.when(
        F.col("action") == "ha_failover",
        falsy_text("standby_node", STANDBY_NODE),
    ).when(F.col("action") == "reset", F.lit(PRIMARY_NODE))
    return (
        decided.where((F.col("status") == APPLIED) & F.col("action").isin("ha_failover", "reset"))
        .withColumn("active_route", to)
        .withColumn("is_failover", F.col("action") == "ha_failover")
    )


def falsy_text(col, default):
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


def current_route(decided, key="target_device"):
    """Route after the last applied command, and since when."""
    stamp = F.struct(EPOCH_MS, ROW_ID)
    return route_changes(decided).groupBy(key).agg(
        F.max_by("active_route", stamp).alias("active_route"),
        F.max_by("is_failover", stamp).alias("is_failover"),
        F.max(EPOCH_MS).alias("switched_at_ms"),
    )


def route_of_frames(frames, decided, time=EPOCH_MS, p=DEFAULTS, largest=None):
    """Route that was active when each frame arrived; a command at the same time comes first.

    As-of join by union and carry-forward: one shuffle on the device, no range join."""
    changes = route_changes(decided).select(
        F.col("target_device").alias(DEVICE), F.col(EPOCH_MS).alias("_t"), F.col(ROW_ID).alias("_id"),
        F.lit(0).alias("_kind"), "active_route", F.lit(None).cast(frames.schema.simpleString()).alias("_frame"),
    )
    rows = frames.select(
        DEVICE, F.col(time).alias("_t"), F.col(ROW_ID).alias("_id"), F.lit(1).alias("_kind"),
        F.lit(None).cast("string").alias("active_route"), F.struct(*frames.columns).alias("_frame"),
    )
    merged = changes.unionByName(rows).withColumn("_tie", F.struct("_kind", "_id"))
    s = open_series(merged, [DEVICE], "_t", "_tie", 0, p.max_group_rows, largest)
    out = s.close(s.carry({"active_route": F.col("active_route")})).where(F.col("_kind") == 1)
    return out.select("_frame.*", F.coalesce("active_route", F.lit(PRIMARY_NODE)).alias("active_route"))


def active_limits(decided):
    """Rate limit in force per interface: the last applied shed, gone after a reset. A command without an interface
    means the default one."""
    stamp = F.struct(EPOCH_MS, ROW_ID)
    return (
        decided.where((F.col("status") == APPLIED) & F.col("action").isin("traffic_shedding", "reset"))
        .groupBy(F.coalesce("target_interface", F.lit(DEFAULT_INTERFACE)).alias("target_interface"))
        .agg(F.max_by(F.struct("action", "rate_mbps"), stamp).alias("last"))
        .where(F.col("last.action") == "traffic_shedding")
        .select("target_interface", F.col("last.rate_mbps").alias("rate_mbps"))
    )


def heartbeat_gaps(frames, time=EPOCH_MS, p=DEFAULTS, largest=None):
    """Silences longer than the heartbeat timeout; every frame counts as a heartbeat."""
    s = open_series(frames.select(DEVICE, time, ROW_ID), [DEVICE], time, ROW_ID, 1, p.max_group_rows, largest)
    limit = int(p.heartbeat_timeout_sec * 1000)
    out = s.df.withColumn("gap_start_ms", F.lag(time).over(s.window))
    return (
        s.close(out)
        .withColumn("gap_ms", F.col(time) - F.col("gap_start_ms"))
        .where(F.col("gap_ms") > limit)
        .select(DEVICE, "gap_start_ms", F.col(time).alias("gap_end_ms"), "gap_ms")
    )


def tripped_at(frames, now_ms, time=EPOCH_MS, p=DEFAULTS):
    """Dead-man's switch per device at one instant."""
    limit = int(p.heartbeat_timeout_sec * 1000)
    return frames.groupBy(DEVICE).agg(F.max(time).alias("last_heartbeat_ms")).withColumn(
        "tripped", F.lit(now_ms) - F.col("last_heartbeat_ms") > limit
    )


def token_bucket(factor, line_rate=100.0):
    """Rate and burst of the shaping filter for a shedding factor column."""
    rate = F.col(factor) * line_rate
    return rate.alias("tbf_rate_mbit"), F.floor(dp(rate * 12.5, 6)).cast("int").alias("tbf_burst_kbit")
