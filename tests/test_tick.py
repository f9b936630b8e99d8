"""The tick: every row once, also over a restart."""

import os

import pyarrow.parquet as pq

from cadenza.streaming import jobs


def test_tick_takes_each_row_once_and_goes_on_where_it_stopped(spark, sf, tmp_path):
    total, seen, at = spark.read.parquet(f"{sf}/events.parquet").count(), [], str(tmp_path / "checkpoint")

    def step(batch, number):
        seen.append((number, batch.count()))

    for _ in range(2):
        q = jobs.tick(jobs.events(spark, sf), step, at, every="1 second")
        q.processAllAvailable()
        q.stop()
    assert sum(n for _, n in seen) == total and len({number for number, _ in seen}) == len(seen)


def test_a_step_that_failed_is_run_again(spark, sf, tmp_path):
    total, seen, at, fail = spark.read.parquet(f"{sf}/events.parquet").count(), [], str(tmp_path / "checkpoint"), [True]

    def step(batch, number):
        if fail and fail.pop():
            raise ValueError("lost")
        seen.append((number, batch.count()))

    for _ in range(2):
        q = jobs.tick(jobs.events(spark, sf), step, at, every="1 second")
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        q.stop()
    assert sum(n for _, n in seen) == total


def in_files(sf, folder, again=0):
    """The log in seven files by time, each with the first rows of the next one too."""
    log = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    step = -(-log.num_rows // 7)
    for i in range(7):
        name = folder / ("events.parquet" if i == 0 else f"event_{i}.parquet")
        pq.write_table(log.slice(i * step, step + again), name)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_state_goes_over_batches(spark, sf, tmp_path):
    """Sessions and slots of a log that comes in seven files are those of one file."""
    at = in_files(sf, tmp_path)
    for job in (jobs.sessions, jobs.slot_counts):
        whole, parts = jobs.drained(job(jobs.events(spark, sf))), jobs.drained(job(jobs.events(spark, at)))
        assert parts.select("batch").distinct().count() > 1
        rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.drop("batch").collect())
        assert rows(parts) == rows(whole) and rows(whole)


def test_rows_delivered_again_count_once(spark, sf, tmp_path):
    """A row that the next file holds too is known still, or late."""
    ids = [r["event_id"] for r in jobs.drained(jobs.deduplicated(jobs.events(spark, in_files(sf, tmp_path, again=4)), ["event_id"])).select("event_id").collect()]
    assert sorted(ids) == sorted(r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect())
