"""Watch sessions as a stream: any split and order of arrival, restarts from the checkpoint, late rows."""

import random

import pandas as pd
import pytest

from tarn.streaming import streams, watches

SCHEMA = "k long, ts timestamp, number long, command string"
ENDS = {"stop": "completed", "cancel": "cancelled", "restart": "interrupted"}


def plain(rows, seconds, until):
    out, held = [], {}
    for at, number, key, command in sorted((r[1], r[2], r[0], r[3]) for r in rows):
        if at >= until:
            continue
        w = held.get(key)
        if w and at >= w["started"] + seconds:
            out.append((key, w["started"], w["started"] + seconds, "expired", w["markers"], w["refused"]))
            w = held.pop(key) and None
        if w is None:
            if command == "start":
                held[key] = {"started": at, "markers": 0, "refused": 0}
        elif command in ENDS:
            out.append((key, w["started"], at, ENDS[command], w["markers"], w["refused"]))
            del held[key]
        elif command == "mark":
            w["markers"] += 1
        elif command == "start":
            w["refused"] += 1
    out += [(key, w["started"], w["started"] + seconds, "expired", w["markers"], w["refused"]) for key, w in held.items() if w["started"] + seconds < until]
    return sorted(out)


def write(spark, rows, folder, name):
    frame = pd.DataFrame([(k, pd.Timestamp(at, unit="s", tz="UTC"), n, c) for k, at, n, c in rows], columns=["k", "ts", "number", "command"])
    spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, pattern, folder, files=1):
    with watches.state_in_rocksdb(spark):
        stream = streams.event_stream(spark, pattern, SCHEMA, lateness="60 seconds", files=files)
        out = streams.drain(watches.watches(stream, "k", 90), "append", folder, "watch")
    return sorted((r["k"], r["started"] // 10**6, r["ended"] // 10**6, r["status"], r["markers"], r["refused"]) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_arrival_and_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 4), rng.randint(0, 1500), n, rng.choice(["start", "start", "mark", "mark", "stop", "cancel", "restart"])) for n in range(220)]
    # Rows come at most 50 seconds behind the newest one before them, so none is late.
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 49)
    cuts = sorted(rng.sample(range(1, len(arrival)), 4))
    parts = [arrival[a:b] for a, b in zip([0, *cuts], [*cuts, len(arrival)], strict=True)]
    for k, part in enumerate(parts[:3]):
        write(spark, part, str(tmp_path / "in"), f"a{k}")
    first = run(spark, str(tmp_path / "in" / "*"), str(tmp_path / "state"))
    newest = max(r[1] for p in parts[:3] for r in p)
    assert first == plain([r for p in parts[:3] for r in p], 90, newest - 60)
    for k, part in enumerate(parts[3:]):
        write(spark, part, str(tmp_path / "in"), f"b{k}")
    again = run(spark, str(tmp_path / "in" / "*"), str(tmp_path / "state"))  # goes on from the checkpoint
    assert again == plain(rows, 90, max(r[1] for r in rows) - 60) and len(again) > len(first)


class Held:
    """State and timers of one key, counted."""

    def __init__(self):
        self.value, self.rows, self.timers, self.reads = None, [], set(), 0
        self.exists, self.update, self.clear = lambda: self.value is not None, lambda v: setattr(self, "value", v), lambda: (setattr(self, "value", None), self.rows.clear())
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard
        self.appendValue, self.appendList, self.put = self.rows.append, self.rows.extend, lambda rows: setattr(self, "rows", list(rows))

    def get(self):
        self.reads += 1
        return self.value if self.value is not None else iter(self.rows)

    def getListState(self, *_):
        self.waiting = Held()
        return self.waiting

    def getValueState(self, *_):
        return Held()

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_key_has_one_timer():
    """However many commands wait, so that the list of them is read once a batch and not once a command."""
    held, made = Held(), watches.Watches("k", 90)
    made.init(held)
    held.now = 0
    frame = pd.DataFrame({"at": [i * 1_000_000 for i in range(1, 1001)], "number": range(1000), "command": ["start", "mark"] * 500})
    assert list(made.handleInputRows((1,), iter([frame[500:], frame[:500]]), held)) == []
    assert len(held.timers) == 1
    held.now, at = 700_500, held.timers.pop()
    ended = pd.concat(made.handleExpiredTimer((1,), held, None))
    assert at == 1001 and held.waiting.reads == 1 and len(held.waiting.rows) == 300 and ended["status"].eq("expired").all() and len(ended) == 7
    assert held.timers == {701_001}


def test_grants_expire_in_any_arrival(spark, tmp_path):
    """Rows that come behind others renew and open what they would have in order; a renewal at the last moment counts."""
    rng = random.Random(3)
    times = [(0, 100), (0, 130), (0, 161), *((rng.randint(1, 5), rng.randint(0, 3000)) for _ in range(300)), (9, 4000)]
    arrival = sorted(times, key=lambda r: r[1] + rng.random() * 49)
    for k in range(0, len(arrival), 80):
        write(spark, [(key, at, k, "") for key, at in arrival[k : k + 80]], str(tmp_path / "in"), f"a{k:03}")
    stream = streams.event_stream(spark, str(tmp_path / "in" / "*"), SCHEMA, lateness="60 seconds", files=1)
    out = streams.drain(streams.expire(stream, "k", 30), "append", str(tmp_path / "state"), "grants")
    want = []
    for key in range(10):
        held = []
        for at in sorted(t for k, t in times if k == key):
            if held and at - held[-1] > 30:
                want.append((key, held[0], len(held) - 1))
                held = []
            held.append(at)
        if held and held[-1] + 30 <= 4000 - 60:
            want.append((key, held[0], len(held) - 1))
    assert sorted((r["k"], int(r["opened"].timestamp()), r["renewals"]) for r in out.collect()) == sorted(want)
