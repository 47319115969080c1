import datetime
import random

import numpy as np
import pandas as pd
import pytest

from packwright.streaming import stateful
from packwright.streaming.stateful import PROVIDER, BlockBuilder, Packing, packed_stream, start
from test_packing import blocks_of

LENGTH = 8
SCHEMA = "data_type string, subset_name string, doc_id bigint, ts timestamp, token_ids array<int>, tgt_mask array<int>"
BEGIN = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def made(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for key in range(n):
        size = draw.randrange(12)
        rows.append((draw.choice("aab"), key, [draw.randrange(99) for _ in range(size)], [draw.randrange(2) for _ in range(size)]))
    return rows


def write(spark, path, rows, seconds=lambda key: key):
    """Event time in seconds after the beginning; ``None`` rows push the watermark past everything."""
    data = [("text", s, k, BEGIN + datetime.timedelta(seconds=seconds(k)), i, m) for s, k, i, m in (r for r in rows if r)]
    if None in rows:
        data.append(("end", "end", 0, BEGIN + datetime.timedelta(days=30), [], []))
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture()
def run(spark, tmp_path):
    before = spark.conf.get(PROVIDER, None)
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))

    def go(rows, packing, **options):
        write(spark, source, rows, **options)
        start(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, packing).awaitTermination()
        return spark.read.parquet(out).collect()

    yield go
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def blocks(found):
    return {(r.subset_name, r.block_idx): (list(r.token_ids), list(r.tgt_mask)) for r in found if r.block_idx is not None}


def test_out_of_order_over_restarts_is_the_batch(run):
    """Arrivals shuffled within the delay, in three starts of the stream, give the batch's blocks."""
    rows, draw = made(120), random.Random(2)
    order = sorted(rows, key=lambda r: r[1] + draw.uniform(-20, 20))
    packing = Packing(LENGTH, delay="100 seconds")
    seen = {}
    for part in (order[:40], order[40:80], [*order[80:], None]):
        seen = run(part, packing)
    assert blocks(seen) == blocks_of(rows, LENGTH)
    assert [(r.data_type, r.lane) for r in seen] == [("text", 0)] * len(seen) and not any(r.late for r in seen)


def test_nothing_is_laid_down_before_its_time(run):
    rows = made(60, 3)
    packing = Packing(LENGTH, delay="1000 seconds")
    assert blocks(run(rows, packing)) == {}
    assert blocks(run([None], packing)) == blocks_of(rows, LENGTH)


def test_too_late_is_counted_and_left_out(run):
    rows = made(80, 4)
    early, rest = rows[:5], rows[5:]
    packing = Packing(LENGTH, delay="5 seconds")
    first = run(rest, packing)
    done = run([*early, None], packing)
    assert blocks(done) == blocks_of(rest, LENGTH)
    assert all(blocks(done)[k] == v for k, v in blocks(first).items())


def test_ties_go_by_key_and_then_as_they_came(run):
    rows = made(50, 5)
    done = run([*reversed(rows), None], Packing(LENGTH, delay="10 seconds"), seconds=lambda key: 7)
    assert blocks(done) == blocks_of(rows, LENGTH)


def test_lanes_share_a_subset(run):
    rows = made(200, 6)
    packing = Packing(LENGTH, delay="500 seconds", lanes=3, lane_keys=10)
    got = run([*rows, None], packing)
    by_lane = [(f"{s}{k // 10 % 3}", k, i, m) for s, k, i, m in rows]
    want = blocks_of(by_lane, LENGTH)
    assert {(f"{r.subset_name}{r.lane}", r.block_idx): (list(r.token_ids), list(r.tgt_mask)) for r in got} == want
    assert len({r.lane for r in got}) == 3


def test_one_exchange_and_one_state(spark, tmp_path):
    write(spark, str(tmp_path / "in"), made(3))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert packed_stream(stream, Packing(LENGTH)).isStreaming
    assert packed_stream(stream, Packing(LENGTH)).columns == ["data_type", "subset_name", "lane", "block_idx", "token_ids", "tgt_mask", "late"]


class Kept(dict):
    """A state in memory that counts the calls."""

    calls = 0

    def exists(self):
        return bool(self)

    def get(self):
        return dict.get(self, "value")

    def update(self, value):
        self["value"] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def state(self, name, *_):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState = state

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


def builder():
    made = BlockBuilder(LENGTH, ["data_type", "subset_name"], "doc_id", "ts")
    made.init(Handle())
    return made


def frame(rows):
    ids, masks = ([np.array(r[i], dtype=np.int32) for r in rows] for i in (2, 3))
    return pd.DataFrame({"ts": pd.to_datetime([r[1] for r in rows], unit="s"), "doc_id": [r[1] for r in rows], "token_ids": ids, "tgt_mask": masks})


def test_the_state_is_touched_by_parts_and_not_by_examples():
    rows = [("a", k, i, m) for _, k, i, m in made(4000, 7)]
    draw, states = random.Random(8), builder()
    shuffled = draw.sample(rows, len(rows))
    got = []
    for part in (shuffled[:1500], shuffled[1500:]):
        got += states.handleInputRows(("text", "a", 0), iter([frame(part)]), Clock(-1))
    assert not got and states.handle.timers == [0]
    got += states.handleExpiredTimer(("text", "a", 0), Clock(5000), None)
    found = pd.concat(got)
    want = blocks_of(rows, LENGTH)
    assert {("a", b): (list(i), list(m)) for b, i, m in zip(found.block_idx, found.token_ids, found.tgt_mask)} == want
    assert not states.handle.states["runs"] and states.handle.states["runs"].calls < 20


def test_runs_of_many_parts_are_laid_down_bit_by_bit(monkeypatch):
    """Parts of a few examples, blocks handed on a few at a time, a watermark that cuts through parts."""
    monkeypatch.setattr(stateful, "PART_TOKENS", 40)
    monkeypatch.setattr(stateful, "OUT_TOKENS", 24)
    rows = [("a", k, i, m) for _, k, i, m in made(300, 9)]
    draw, states = random.Random(10), builder()
    shuffled = draw.sample(rows, len(rows))
    got = list(states.handleInputRows(("text", "a", 0), iter([frame(shuffled[:100]), frame(shuffled[100:])]), Clock(-1)))
    for until in (37, 38, 150, 299):
        got += states.handleExpiredTimer(("text", "a", 0), Clock(until), None)
        waiting = [r[1] for r in rows if r[1] > until]
        assert states.handle.timers == ([min(waiting) * 1000] if waiting else [])
    assert max(len(f) for f in got) <= 5
    found = pd.concat(got)
    assert list(found.block_idx) == list(range(len(found)))
    want = blocks_of(rows, LENGTH)
    assert {("a", b): (list(i), list(m)) for b, i, m in zip(found.block_idx, found.token_ids, found.tgt_mask)} == want
    assert not states.handle.states["runs"]


def test_a_null_id_or_a_mask_of_another_length_is_an_error():
    for ids, mask in ((np.array([1, np.nan]), [1, 1]), ([1, 2], [1])):
        with pytest.raises(ValueError):
            list(builder().handleInputRows(("text", "a", 0), iter([frame([])._append({"ts": pd.Timestamp(9, unit="s"), "doc_id": 1, "token_ids": ids, "tgt_mask": np.array(mask)}, ignore_index=True)]), Clock(0)))
