"""The whole analysis with its files on disk, and the life of a backfill."""

import json
import random

import pytest

from caldrift.functions.expr import HOUR, MINUTE
from caldrift import cli
from caldrift.plans import backfill
from caldrift.plans.analysis import run_analysis

BEGIN = 1_700_000_000_000_000 // HOUR * HOUR
OBS = "backend string, component_type string, component_id string, property_key string, property_name string, unit string, t long, observed long, value double"


def tables(spark):
    rng = random.Random(3)
    rows = []
    for device in ("left", "right"):
        for c in range(3):
            t = BEGIN
            for _ in range(9):
                t += rng.randrange(1, 200) * MINUTE
                rows += [(device, "qubit", str(c), f"{n}[us]", n, "us", t, t + MINUTE, rng.uniform(10, 90)) for n in ("T1", "T2")]
    obs = spark.createDataFrame(rows, OBS)
    status = spark.createDataFrame([(d, BEGIN + k * 17 * MINUTE, rng.randrange(40)) for d in ("left", "right") for k in range(90)], "backend string, t long, pending_jobs int")
    cover = spark.createDataFrame([(d, BEGIN, BEGIN + 20 * HOUR, 90) for d in ("left", "right")], "backend string, study_start long, study_end long, successful_fetch_count long")
    return obs, status, cover


def test_analysis_writes_what_it_returns(spark, tmp_path):
    obs, status, cover = tables(spark)
    out = run_analysis(obs, status, cover, windows=(3, 5), lags=(-1, 0, 2), tolerance_minutes=30, min_n=4, output=f"file://{tmp_path}/run")
    meta = json.loads((tmp_path / "run" / "run_metadata.json").read_text())
    assert meta["parameters"]["windows"] == [3, 5] and meta["caveats"] and set(meta["row_counts"]) == set(out)
    # 21 grid hours, two devices of three components; every reading has its own place in its series
    assert (meta["row_counts"]["property_drift"], meta["row_counts"]["calibration_frequency"], meta["row_counts"]["device_load"], meta["row_counts"]["component_cadence"]) == (108, 126, 42, 6)
    for name, n in meta["row_counts"].items():
        assert spark.read.csv(f"file://{tmp_path}/run/{name}", header=True).count() == n
    assert all(r.t.endswith("Z") and r.t[10] == "T" for r in spark.read.csv(f"file://{tmp_path}/run/device_load", header=True).select("t").collect())
    for bad in ((obs.limit(0), status, cover), (obs, status, cover.limit(0))):
        with pytest.raises(ValueError):
            run_analysis(*bad)


def cycles(spark, n):
    return spark.createDataFrame([(100 + k, "abc"[k % 3], 10 * k, 10 * k + 1, k % 5 != 4) for k in range(n)], "cycle long, backend string, started long, finished long, success boolean")


def test_a_dry_run_previews_the_whole_job(spark, tmp_path):
    known = cycles(spark, 20)
    got = backfill.dry_run(known, lambda items: items.select("cycle", "prev"))
    run = backfill.execute(spark, f"{tmp_path}/real", known, lambda items: items.select("cycle", "prev"), batch_size=6)
    done = spark.read.parquet(f"{tmp_path}/real/metrics/{run}").select("cycle", "prev")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, done.collect()), key=str) and got.count() == 16


def test_one_runner_at_a_time(spark, tmp_path):
    clock = [100.0]
    lease = lambda: backfill.Lease(spark, f"{tmp_path}", 50, lambda: clock[0])
    with lease() as first:
        with pytest.raises(RuntimeError):
            lease().__enter__()
        clock[0] = 140
        first.renew()
        clock[0] = 189
        with pytest.raises(RuntimeError):
            lease().__enter__()
        clock[0] = 191  # the first runner is taken for dead
        with lease():
            with pytest.raises(RuntimeError):
                first.renew()
    assert not (tmp_path / "lease").exists()
    with pytest.raises(ValueError):
        backfill.execute(spark, f"{tmp_path}", cycles(spark, 3), lambda items: items, max_batches=0)
    run = backfill.execute(spark, f"{tmp_path}", cycles(spark, 20), lambda items: items.select("cycle"), batch_size=5, max_batches=2)
    assert backfill.runs(spark, f"{tmp_path}").first().last_sequence_no == 10
    assert backfill.execute(spark, f"{tmp_path}", cycles(spark, 0), lambda items: items.select("cycle"), batch_size=5) == run


def test_command_lines(spark, tmp_path, capsys):
    for bad in (["backfill", "--root", "x", "--cycles", "y", "--new-run", "--run-id", "z"], ["backfill", "--root", "x", "--cycles", "y", "--batch-size", "0"], ["backfill", "--root", "x"], ["analysis", "--observations", "o"], ["collect", "--url", "u", "--backends", "b", "--target", "t", "--interval", "0"], []):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)
    capsys.readouterr()
    cycles(spark, 20).write.parquet(f"{tmp_path}/cycles")
    spark.createDataFrame([(100 + k, k % 4, f"{k % 4}-{k % 4 + 1}", 1000 + k) for k in range(20)], "cycle long, qubit int, edge_id string, date long").write.parquet(f"{tmp_path}/properties")
    job = ["backfill", "--root", f"{tmp_path}/bf", "--cycles", f"{tmp_path}/cycles", "--properties", f"{tmp_path}/properties", "--batch-size", "7"]
    assert cli.main([*job, "--dry-run"], spark) == 0 and not (tmp_path / "bf").exists()
    assert cli.main([*job, "--max-batches", "1"], spark) == 0 and cli.main(job, spark) == 0
    capsys.readouterr()
    assert cli.main(["backfill", "--root", f"{tmp_path}/bf", "--status"], spark) == 0
    state = json.loads(capsys.readouterr().out.splitlines()[0])
    assert (state["status"], state["total"], state["last_sequence_no"]) == ("completed", 16, 16)


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    root, seen = f"{tmp_path}/bf", []

    def failing(after):
        def compute(items):
            if len(seen) == after:
                raise ConnectionError("gone")
            seen.append(items.count())
            return items.select("cycle", "prev")

        return compute

    for stop in (1, 2):
        with pytest.raises(ConnectionError):
            backfill.execute(spark, root, cycles(spark, 20), failing(stop), batch_size=5)
    state = backfill.runs(spark, root).first()
    assert (state.status, state.last_sequence_no, state.total) == ("failed", 10, 16) and "gone" in state.error
    run = backfill.execute(spark, root, cycles(spark, 0), failing(99), batch_size=5)  # its inputs were frozen when it began
    done = spark.read.parquet(f"{root}/metrics/{run}")
    assert run == state.run_id and sum(seen) == 16 and done.count() == done.select("cycle").distinct().count() == 16
    assert backfill.runs(spark, root).first().status == "completed"


def test_any_run_can_be_named(spark, tmp_path):
    root = f"{tmp_path}/many"
    known = [backfill.start(spark, root, cycles(spark, 3), new_run=True)[0] for _ in range(12)]
    assert backfill.runs(spark, root).count() == 10
    assert backfill.start(spark, root, cycles(spark, 3), run_id=known[0]) == (known[0], 0)  # older than the ten that are shown
    with pytest.raises(LookupError):
        backfill.start(spark, root, cycles(spark, 3), run_id="nobody")
    with pytest.raises(ValueError):
        backfill.start(spark, root, cycles(spark, 3), run_id=known[0], new_run=True)


def test_retries():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 5:
            raise TimeoutError
        return "ok"

    assert backfill.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1, 2, 4, 8]
    with pytest.raises(OSError):
        backfill.with_retries(lambda: (_ for _ in ()).throw(OSError()), most=7, sleep=waits.append)
    assert waits[-1] == 60
    with pytest.raises(KeyError):
        backfill.with_retries(lambda: {}["x"], sleep=waits.append)
