"""Console cycle: policy replay, alarm flags, event log, audit, over a table of frames."""

from plantpulse.operators import alarms, policy
from plantpulse.params import DEFAULTS


def run(frames, scorer=policy.analytic_score, p=DEFAULTS, largest=None):
    """``(replayed frames with alarm flags, event log)``."""
    replayed = policy.replay(frames, scorer, p, largest)
    return alarms.alarm_flags(replayed, p=p), alarms.sequence_of_events(replayed, p=p, largest=largest)


def audit(frames, scorer=policy.analytic_score, p=DEFAULTS, largest=None):
    _, log = run(frames, scorer, p, largest)
    return alarms.audit_summary(alarms.severity(log), p=p)
