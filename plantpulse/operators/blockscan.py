"""Entry states for a state machine that runs over one key in several blocks.

Each block is summarised as a step function from the state on entry to the state on exit. Functions are
combined ``FAN_IN`` blocks at a time, level by level, and the entry states then flow back down. No task sees
more than ``FAN_IN`` block summaries, however long the key is.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plantpulse.operators.series import BLOCK
from plantpulse.session import checkpointed

FAN_IN = 64
NEVER = -(1 << 62)
KEEP = -(1 << 62) - 1  # output of a piece that leaves the state as it was


def step_value(lo, out, x):
    """Value of the step function: ``out[i]`` on ``lo[i] <= x < lo[i+1]``."""
    v = out[np.searchsorted(lo, x, side="right") - 1]
    return np.where(v == KEEP, x, v)


def compress(lo, out):
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    return lo[keep], out[keep]


def then(f, g):
    """The step function that applies ``f`` and then ``g``."""
    (f_lo, f_out), (g_lo, g_out) = f, g
    los, outs = [], []
    upper = np.append(f_lo[1:], np.iinfo(np.int64).max)
    for lo, hi, out in zip(f_lo, upper, f_out):
        if out != KEEP:
            los.append([lo])
            outs.append(step_value(g_lo, g_out, np.array([out])))
        else:
            inner = (g_lo > lo) & (g_lo < hi)
            at = np.searchsorted(g_lo, lo, side="right") - 1
            los.append(np.concatenate([[lo], g_lo[inner]]))
            outs.append(np.concatenate([[g_out[at]], g_out[inner]]))
    return compress(np.concatenate(los).astype("int64"), np.concatenate(outs).astype("int64"))


def _pieces(row):
    return np.asarray(row.lo, dtype="int64"), np.asarray(row.out, dtype="int64")


def entry_states(functions, keys, initial, fan_in=FAN_IN):
    """``functions(keys, _block, lo, out)`` to ``(keys, _block, entry)``."""
    keys = list(keys)
    spark_keys = functions.select(*keys).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark_keys.fields)
    level = checkpointed(functions.withColumnRenamed(BLOCK, "pos").withColumn("pos", F.col("pos").cast("long")))
    count = level.agg(F.max("pos")).first()[0] + 1
    below = []

    def combine(pdf):
        pdf = pdf.sort_values("pos")
        f = None
        for row in pdf.itertuples():
            f = _pieces(row) if f is None else then(f, _pieces(row))
        head = pdf.iloc[0]
        return pd.DataFrame([{**{k: head[k] for k in keys}, "pos": head["parent"], "lo": f[0], "out": f[1]}])

    def descend(pdf):
        pdf = pdf.sort_values("pos")
        state, entries = int(pdf["entry"].iloc[0]), []
        for row in pdf.itertuples():
            entries.append(state)
            state = int(step_value(*_pieces(row), np.array([state]))[0])
        return pdf[keys + ["pos"]].assign(entry=entries)

    while count > 1:
        grouped = level.withColumn("parent", F.floor(F.col("pos") / fan_in))
        below.append(grouped)
        level = checkpointed(
            grouped.groupBy(*keys, "parent").applyInPandas(
                combine, f"{types}, pos long, lo array<long>, out array<long>"
            )
        )
        count = -(-count // fan_in)

    entries = level.select(*keys, "pos", F.lit(initial).cast("long").alias("entry"))
    for grouped in reversed(below):
        seeded = grouped.join(entries.withColumnRenamed("pos", "parent"), keys + ["parent"])
        entries = seeded.groupBy(*keys, "parent").applyInPandas(descend, f"{types}, pos long, entry long")
    return entries.select(*keys, F.col("pos").cast("int").alias(BLOCK), "entry")
