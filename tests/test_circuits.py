"""Circuit states: worked cases, and the stream against the replay of the same log."""

import pytest

from placeloom.queries import flow_queries, registry  # noqa: F401
from placeloom.streaming import circuits, jobs

SF = "/root/testdata/sf0.001"
SCHEMA = "key string, t double, event_id long, outcome string, ms double, results long"


def states(spark, log, rules=circuits.Rules()):
    rows = [("p", float(t), i, outcome, 100.0, 5) for i, (t, outcome) in enumerate(log)]
    got = circuits.replay(spark.createDataFrame(rows, SCHEMA).repartition(3), "key", rules).collect()
    return [(r.admission, r.circuit, r.opens, r.until) for r in sorted(got, key=lambda r: r.event_id)]


def test_failures_in_a_row_open_and_probes_decide(spark):
    log = [(0, "error"), (1, "timeout"), (2, "success"), (3, "error"), (4, "error"), (5, "rate_limited"), (6, "success"), (304, "error"), (305, "error"), (904, "captcha"), (3000, "error"), (5000, "empty"), (5001, "error")]
    assert states(spark, log) == [
        ("allow", "closed", 0, None), ("allow", "closed", 0, None), ("allow", "closed", 0, None), ("allow", "closed", 0, None), ("allow", "closed", 0, None),
        ("allow", "open", 1, 305.0),  # the third in a row
        ("deny", "open", 1, 305.0),  # was on its way
        ("deny", "open", 1, 305.0),
        ("probe", "open", 2, 905.0),  # failed: 600 s now
        ("deny", "open", 2, 905.0),
        ("probe", "open", 3, 4200.0),  # 1200 s
        ("probe", "closed", 0, None),  # an empty answer is an answer
        ("allow", "closed", 0, None),
    ]


def test_captchas_and_low_scores_open(spark):
    log = [(0, "captcha"), (1, "success"), (2, "captcha"), (3, "success"), (4, "success")]
    assert [s[1] for s in states(spark, log)] == ["closed", "closed", "closed", "open", "open"]  # half of four
    slow = circuits.Rules(failures=99, captcha_calls=99)
    rows = [("p", float(i), i, "timeout" if i % 2 else "error", 60_000.0, 0) for i in range(6)]
    got = sorted(circuits.replay(spark.createDataFrame(rows, SCHEMA), "key", slow).collect(), key=lambda r: r.event_id)
    assert [r.circuit for r in got] == ["closed"] * 4 + ["open"] * 2 and got[-1].status == "unhealthy"
    # calls leave the window with time and number
    old = [(0, "captcha"), (1, "captcha"), (2000, "success"), (2001, "success"), (2002, "captcha"), (2003, "captcha")]
    assert [s[1] for s in states(spark, old)] == ["closed"] * 5 + ["open"]
    assert states(spark, [(i, "disabled") for i in range(5)]) == []


def test_cooldown_has_a_limit(spark):
    log = [(0, "error"), (0, "error"), (0, "error")] + [(10_000 * k, "error") for k in range(1, 6)]
    assert [s[3] for s in states(spark, log)][2:] == [300.0, 10_600.0, 21_200.0, 31_800.0, 41_800.0, 51_800.0]


def test_stream_equals_replay(spark):
    cols = ["key", "event_id", "admission", "circuit", "opens", "until", "failures", "score", "status"]
    row = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))
    streamed = {row(r) for r in registry.QUERIES["g4_circuits"](spark, SF).collect()}
    replayed = [row(r) for r in registry.QUERIES["g4_circuit_replay"](spark, SF).collect()]
    assert len(replayed) == len(streamed) and streamed == set(replayed) and {r[3] for r in replayed} >= {"open", "closed"}


@pytest.mark.parametrize("files", [1, 3])
def test_state_goes_on_over_batches_and_timers_end_cooldowns(spark, tmp_path, files):
    calls = [(1e6 + t, i, o) for i, (t, o) in enumerate([(0, "error"), (1, "error"), (2, "error"), (100, "success"), (303, "success"), (304, "error"), (5000, "success")])]
    schema = "key string, at timestamp, t double, event_id long, outcome string, ms double, results long"
    import datetime
    import time

    for k in range(files):
        part = [c for j, c in enumerate(calls) if j * files // len(calls) == k]
        rows = [("p", datetime.datetime.fromtimestamp(t, datetime.UTC), t, i, o, 10.0, 5) for t, i, o in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = flow_queries.with_rocks(spark, lambda: jobs.run_once(spark, circuits.circuits(stream, "key"), "update", "circuits")).collect()
    assert [(r.admission, r.circuit) for r in sorted((r for r in got if r.event_id is not None), key=lambda r: r.event_id)] == [("allow", "closed")] * 2 + [("allow", "open"), ("deny", "open"), ("probe", "closed"), ("allow", "closed"), ("allow", "closed")]
    if files == 3:  # the second file's calls pass the end of the cooldown before the third's
        assert all(r.circuit == "half_open" for r in got if r.event_id is None)
