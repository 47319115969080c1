import json
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from packwright.sources.claims import Claims, pending_in, run_pending


@pytest.fixture()
def plan(spark):
    rows = [(f"eval_m{m}_{s}.json", m, s) for m in range(3) for s in ("arc", "mmlu", "gsm8k")]
    return spark.createDataFrame(rows, "path string, model int, suite string")


def markers(folder):
    return sorted(f for f in os.listdir(folder) if "running" in f and not f.endswith(".crc"))


def test_one_holder_at_a_time(spark, tmp_path):
    a, b = Claims(spark, str(tmp_path), "a"), Claims(spark, str(tmp_path), "b")
    claim = a.take(f"{tmp_path}/x.json")
    assert claim and b.take(f"{tmp_path}/x.json") is None and a.take(f"{tmp_path}/x.json") is None
    assert markers(tmp_path) == ["x.json.running"] and a.holds(claim) and not b.holds(claim)
    a.release(claim)
    taken = b.take(f"{tmp_path}/x.json")
    a.release(claim)  # no longer a's: nothing happens
    assert b.holds(taken)
    b.publish(taken, "{}")
    b.release(taken)
    assert a.take(f"{tmp_path}/x.json") is None and markers(tmp_path) == []
    assert (tmp_path / "x.json").read_text() == "{}"


def test_the_marker_goes_after_an_error(spark, tmp_path):
    claims = Claims(spark, str(tmp_path))
    with pytest.raises(RuntimeError, match="broken"):
        with claims.claimed(f"{tmp_path}/x.json") as claim:
            assert claim and markers(tmp_path)
            raise RuntimeError("broken")
    assert markers(tmp_path) == [] and claims.take(f"{tmp_path}/x.json")


def test_of_many_only_one_creates_the_marker(spark, tmp_path):
    gate = threading.Barrier(8)

    def go(number):
        claims = Claims(spark, str(tmp_path), f"w{number}")
        gate.wait()
        return [bool(claims.take(f"{tmp_path}/r{i}.json")) for i in range(10)]

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(go, range(8)))
    assert [sum(g[i] for g in got) for i in range(10)] == [1] * 10


def test_a_dead_holder_is_replaced_by_one(spark, tmp_path):
    now = [1000.0]
    dead = Claims(spark, str(tmp_path), "dead", lease=60, clock=lambda: now[0])
    old = dead.take(f"{tmp_path}/x.json")
    now[0] += 59
    others = [Claims(spark, str(tmp_path), f"w{i}", lease=60, clock=lambda: now[0]) for i in range(6)]
    assert not any(c.take(f"{tmp_path}/x.json") for c in others)
    old = dead.renew(old)
    now[0] += 59
    assert not any(c.take(f"{tmp_path}/x.json") for c in others)
    now[0] += 2
    with ThreadPoolExecutor(6) as pool:
        got = [c for c in pool.map(lambda c: c.take(f"{tmp_path}/x.json"), others) if c]
    assert len(got) == 1 and markers(tmp_path) == ["x.json.running"]
    for lost in (lambda: dead.renew(old), lambda: dead.publish(old, "late")):
        with pytest.raises(RuntimeError, match="no longer held"):
            lost()
    dead.release(old)
    assert markers(tmp_path) == ["x.json.running"]


def test_markers_without_a_word_count_as_running_for_a_lease(spark, tmp_path):
    (tmp_path / "x.json.running").write_text("")
    claims = Claims(spark, str(tmp_path), lease=3600)
    assert claims.take(f"{tmp_path}/x.json") is None
    os.utime(tmp_path / "x.json.running", (time.time() - 7200,) * 2)
    assert claims.take(f"{tmp_path}/x.json")


def test_two_workers_share_and_a_failure_is_pending_again(spark, tmp_path, plan):
    (tmp_path / "eval_m0_arc.json").write_text('{"by": "before"}')
    (tmp_path / "eval_m0_mmlu.json.running").write_text(json.dumps({"owner": "else", "until": time.time() + 999}))
    failing, made_by = {"eval_m1_gsm8k.json"}, []

    def make(row):
        if row.path in failing:
            raise ValueError("no room")
        made_by.append(row.path)
        time.sleep(0.05)
        return json.dumps({"model": row.model})

    with ThreadPoolExecutor(2) as pool:
        outcomes = [f.result() for f in [pool.submit(run_pending, spark, plan, str(tmp_path), make) for _ in range(2)]]
    made = [p for o in outcomes for p in o.made]
    assert sorted(made) == sorted(made_by) and len(made) == len(set(made)) == 6
    assert {p for o in outcomes for p in o.failed} == failing
    assert "ValueError: no room" in {e for o in outcomes for e in o.failed.values()}
    assert markers(tmp_path) == ["eval_m0_mmlu.json.running"]
    assert [r.path for r in pending_in(spark, plan, str(tmp_path)).collect()] == ["eval_m1_gsm8k.json"]
    failing.clear()
    assert run_pending(spark, plan, str(tmp_path), make).made == ["eval_m1_gsm8k.json"]
    assert run_pending(spark, plan, str(tmp_path), make).made == []
    assert json.loads((tmp_path / "eval_m0_arc.json").read_text()) == {"by": "before"}
    assert not [f for f in os.listdir(tmp_path) if "draft" in f and not f.endswith(".crc")]


def test_a_folder_that_is_not_there_yet(spark, tmp_path, plan):
    folder = str(tmp_path / "none" / "yet")
    assert pending_in(spark, plan, folder).count() == 9
    assert len(run_pending(spark, plan.where("model = 2"), folder, lambda row: "{}").made) == 3
