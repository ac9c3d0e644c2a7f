"""Circuit states of providers from their calls: a stateful processor with timers, and the same rule as a replay in batch."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# How good a call with this outcome is, and outcomes that are failures.
QUALITY = {"success": 1.0, "empty": 0.5, "timeout": 0.1, "rate_limited": 0.15, "captcha": 0.0, "error": 0.2}
FAILURES = ["timeout", "captcha", "rate_limited", "error"]
#: The circuit and its window of calls, one array for each of their fields: one value to read and one to write.
CIRCUIT = StructType([StructField("circuit", StringType()), StructField("opens", LongType()), StructField("until", DoubleType()), StructField("failures", LongType())])
CALLS = StructType([StructField("t", ArrayType(DoubleType())), StructField("outcome", ArrayType(StringType())), StructField("ms", ArrayType(DoubleType())), StructField("results", ArrayType(LongType()))])
NAMES = ["event_id", "t", "admission", "circuit", "opens", "until", "failures", "score", "status"]
OUT = "event_id long, t double, admission string, circuit string, opens long, until double, failures long, score double, status string"
FIRST = ("closed", 0, None, 0)


@dataclass(frozen=True)
class Rules:
    """When a circuit opens: that many failures in a row, a low score of `score_calls` calls or more, or a share of captchas of `captcha_calls` or more.

    It stays open for `cooldown` seconds, twice as long each time that it opens again without having closed, max_cooldown
    at most; then one call probes it. Calls count while they are among the last `window` and not older than `seconds`.
    """

    window: int = 64
    seconds: float = 1800.0
    failures: int = 3
    open_score: float = 0.30
    healthy_score: float = 0.70
    score_calls: int = 5
    captcha_rate: float = 0.5
    captcha_calls: int = 4
    cooldown: float = 300.0
    max_cooldown: float = 1800.0
    results: float = 5.0
    latency_ms: float = 3000.0


class Calls:
    """The calls that count, in the order in which they came: a list for each field, as whole lists are summed and sorted fast."""

    __slots__ = ("t", "outcome", "ms", "results", "quality")

    def __init__(self, t=(), outcome=(), ms=(), results=()):
        self.t, self.outcome, self.ms, self.results = list(t), list(outcome), list(ms), list(results)
        self.quality = [QUALITY.get(o, QUALITY["error"]) for o in self.outcome]

    def add(self, t: float, outcome: str, ms: float, results: int, rules: Rules) -> None:
        """Takes a call in, and leaves out those that are too old for it or more than the window."""
        for values, value in zip(self._lists(), (t, outcome, ms, results, QUALITY.get(outcome, QUALITY["error"]))):
            values.append(value)
        least, old = t - rules.seconds, 0
        while self.t[old] < least:
            old += 1
        old = max(old, len(self.t) - rules.window)
        if min(self.t) < least and min(self.t[old:]) < least:  # calls that came late
            kept = [i for i, at in enumerate(self.t) if at >= least][-rules.window :]
            for values in self._lists():
                values[:] = [values[i] for i in kept]
        elif old > 0:
            for values in self._lists():
                del values[:old]

    def _lists(self) -> tuple[list, ...]:
        return self.t, self.outcome, self.ms, self.results, self.quality

    def fields(self) -> tuple[list, ...]:
        return self._lists()[:4]


def score(calls: Calls, rules: Rules) -> float:
    """0.55 quality + 0.20 results + 0.15 median latency + 0.10 calls without captcha, each 1 at best."""
    n = len(calls.t)
    median = sorted(calls.ms)[min(n - 1, round(0.5 * (n - 1)))]
    fast = 1.0 if median <= max(rules.latency_ms, 0.0) else rules.latency_ms / median
    captchas = calls.outcome.count("captcha") / n
    parts = 0.55 * sum(calls.quality) / n + 0.20 * min(1.0, sum(calls.results) / n / rules.results) + 0.15 * fast + 0.10 * (1.0 - captchas)
    return max(0.0, min(1.0, parts))


def advance(state: tuple, calls: Calls, call: tuple, rules: Rules) -> tuple[tuple, str, float]:
    """(state, admission, score) after a call (t, outcome, ms, results), which calls take in: admission is what the circuit had said to it.

    An open circuit denies; a call that was on its way all the same counts, and changes nothing else. After the cooldown
    the next call is the probe: success or an empty answer closes the circuit, a failure opens it again for longer.
    """
    circuit, opens, until, failures = state
    now, failed = call[0], call[1] in FAILURES
    if circuit == "open" and now >= until:
        circuit = "half_open"
    admission = {"closed": "allow", "open": "deny", "half_open": "probe"}[circuit]
    calls.add(*call, rules)
    failures = failures + 1 if failed else 0
    value, n = score(calls, rules), len(calls.t)
    if circuit == "closed":
        captchas = calls.outcome.count("captcha")
        trips = failures >= rules.failures or (n >= rules.score_calls and value < rules.open_score) or (n >= rules.captcha_calls and captchas >= rules.captcha_rate * n)
    else:
        trips = circuit == "half_open" and failed
        if circuit == "half_open" and not failed:
            circuit, opens, until = "closed", 0, None
    if trips:
        circuit, opens = "open", opens + 1
        until = now + min(rules.max_cooldown, rules.cooldown * 2 ** (opens - 1))
    return (circuit, opens, until, failures), admission, value


def status(value: float, rules: Rules) -> str:
    return "healthy" if value >= rules.healthy_score else "degraded" if value >= rules.open_score else "unhealthy"


def _rows(rows, state: tuple, calls: Calls, rules: Rules) -> tuple[list[tuple], tuple]:
    """(the fields of NAMES after each of a key's rows (t, event_id, outcome, ms, results) in order, state); calls take them in."""
    out = []
    for t, event, outcome, ms, results in rows:
        t = float(t)
        state, admission, value = advance(state, calls, (t, str(outcome), math.nan if ms is None else float(ms), int(results)), rules)
        out.append((int(event), t, admission, *state, value, status(value, rules)))
    return out, state


class Circuit(StatefulProcessor):
    """The circuit of a key and its window of calls; a timer at the end of a cooldown tells that the circuit is half open."""

    def __init__(self, rules: Rules):
        self.rules, self.row = rules, Row("key", *NAMES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("circuit", StructType(CIRCUIT.fields + CALLS.fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.state.get()
        state, calls = (tuple(known[:4]), Calls(*known[4:])) if known else (FIRST, Calls())
        was = state[2]
        made = sorted(((r.t, r.event_id, r.outcome, r.ms, r.results) for r in rows), key=lambda r: r[:2])
        out, state = _rows(made, state, calls, self.rules)
        self.state.update((*state, *calls.fields()))
        if state[2] != was:
            if was is not None:
                self.handle.deleteTimer(int(was * 1000))
            if state[2] is not None:
                self.handle.registerTimer(int(state[2] * 1000))
        for r in out:
            yield self.row(key[0], *r)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.state.get()
        state = tuple(known[:4])
        if state[0] == "open" and int(state[2] * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            state = ("half_open", *state[1:])
            self.state.update((*state, *known[4:]))
            value = score(Calls(*known[4:]), self.rules)
            yield self.row(key[0], None, state[2], "probe", *state, value, status(value, self.rules))

    def close(self) -> None:
        pass


def circuits(calls: DataFrame, key: str, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """key and the circuit after each call of a stream (at, t in seconds, event_id, outcome, ms, results), and a row without event_id when a cooldown ends.

    Calls of a batch are taken in order of time; a call later than the watermark is taken as it comes. Outcomes are those of QUALITY,
    others count like errors of no failure; calls that were not made (disabled) are left out. Needs the RocksDB provider.
    """
    made = calls.filter("outcome <> 'disabled'").withWatermark("at", late)
    made = made.select(key, "at", "t", "event_id", "outcome", "ms", "results")
    return made.groupBy(key).transformWithState(Circuit(rules), f"key {calls.schema[key].dataType.simpleString()}, {OUT}", "Update", "EventTime")


def replay(calls: DataFrame, key: str, rules: Rules = Rules()) -> DataFrame:
    """The same rows for each call of a table. A key's calls are read as a stream in order of time, so a key with many calls needs no more memory than its window."""

    def stream(it):
        at, state, held = object(), FIRST, Calls()
        for pdf in it:
            out = []
            for k, rows in groupby(zip(*(pdf[c].tolist() for c in ("key", "t", "event_id", "outcome", "ms", "results"))), key=lambda r: r[0]):
                if k != at:
                    at, state, held = k, FIRST, Calls()
                made, state = _rows((r[1:] for r in rows), state, held, rules)
                out += [(k, *r) for r in made]
            yield pd.DataFrame(out, columns=["key", *NAMES]).astype({"until": "float64"})

    rows = calls.filter(f"outcome <> 'disabled' AND {key} IS NOT NULL").select(F.col(key).alias("key"), "t", "event_id", "outcome", "ms", "results")
    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(stream, f"key {calls.schema[key].dataType.simpleString()}, {OUT}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
