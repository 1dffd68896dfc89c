"""Locks of shards, shards taken over from lost owners, and unlocks that happen once."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lexaria.sources import locks


def test_one_of_many_wins(spark, tmp_path):
    owners = [locks.Locks(spark, f"{tmp_path}/l", f"o{i}", 60) for i in range(8)]
    for name in ("a", "a.b"):
        with ThreadPoolExecutor(8) as pool:
            got = list(pool.map(lambda o, n=name: o.take(n), owners))
        assert sorted(x for x in got if x) == [1]
        winner = owners[[i for i, x in enumerate(got) if x][0]]
        assert all(o.take(name) is None for o in owners)
        winner.release(name, 1)
        assert owners[0].take(name) == 2 and owners[1].take(name) is None


def test_an_expired_lock_is_taken_over(spark, tmp_path):
    now = [1000.0]
    first, second = (locks.Locks(spark, f"{tmp_path}/l", o, 10, lambda: now[0]) for o in "ab")
    assert first.take("x") == 1 and second.take("x") is None
    now[0] += 11
    assert second.take("x") == 2 and first.take("x") is None
    (tmp_path / "l" / "y.1").write_text("")  # an owner that was lost while it made the lock
    assert second.take("y") is None or now[0] > 1e9


def test_two_sessions_share_a_plan(spark, tmp_path):
    """Both run at the same time: every cell is worked out once, whoever does it."""
    plan = spark.range(200).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("config"))

    def session(name):
        own = locks.Locks(spark, f"{tmp_path}/locks", name, 60)
        work = lambda part: part.select("config", "id", F.lit(name).alias("by"))
        return locks.run_shards(plan, ["config", "id"], str(tmp_path), work, 6, own)

    with ThreadPoolExecutor(2) as pool:
        left = list(pool.map(session, ["a", "b"]))
    assert min(left) == 0
    got = locks.cells(spark, str(tmp_path), "config string, id long, by string")
    assert got.count() == 200 and got.select("id").distinct().count() == 200


def test_a_lost_owner_changes_nothing(spark, tmp_path):
    plan, now = spark.range(20).select("id"), [0.0]
    lost, next_ = (locks.Locks(spark, f"{tmp_path}/locks", o, 10, lambda: now[0]) for o in ("lost", "next"))
    work = lambda by: lambda part: part.select("id", F.lit(by).alias("by"))

    def late(part):
        """While it works its lock expires, and another session does all shards."""
        now[0] += 11
        assert locks.run_shards(plan, ["id"], str(tmp_path), work("next"), 2, next_) == 0
        return work("lost")(part)

    locks.run_shards(plan, ["id"], str(tmp_path), late, 2, lost)
    got = locks.cells(spark, str(tmp_path), "id long, by string").collect()
    assert len(got) == 20 and {r.by for r in got} == {"next"}


def test_a_failed_shard_is_left(spark, tmp_path):
    plan = spark.range(10).select("id")
    own = locks.Locks(spark, f"{tmp_path}/locks", "a", 60)
    assert locks.cells(spark, str(tmp_path), "id long").count() == 0
    assert locks.run_shards(plan, ["id"], str(tmp_path), lambda p: p, 3, own, deadline=0) == 3
    assert locks.run_shards(plan, ["id"], str(tmp_path), lambda p: p, 3, own) == 0
    assert locks.cells(spark, str(tmp_path), "id long").count() == 10


def test_unlock_once(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: locks.unlock_once(spark, str(tmp_path), "test", f"w{i}"), range(6)))
    assert sum(got) == 1 and locks.unlocked_by(spark, str(tmp_path), "test") == f"w{got.index(True)}"
    assert locks.unlocked_by(spark, str(tmp_path), "other") is None
