"""Streams over several micro-batches against plain Python."""

import datetime as dt

import pytest

from gavel.streaming import jobs
from gavel.streaming.sources import drain_append
from gavel.streaming.state import use_durable_state

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # each is a state store
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_cooldown_over_batches(spark, tmp_path):
    hours = [[0, 1, 5], [23, 24, 25], [49, 60, 73]]
    batches = [[(1, "t", T0 + dt.timedelta(hours=h)) for h in b] for b in hours]
    s = _stream(spark, tmp_path, batches, "user_id bigint, trigger string, ts timestamp")
    got = sorted(r.fired_at for r in drain_append(jobs.cooldown(s, 24), "cd").collect())
    assert got == [T0 + dt.timedelta(hours=h) for h in (0, 24, 49, 73)]


def test_price_drop_resets_baseline(spark, tmp_path):
    prices = [[100.0, 97.0], [94.0, 90.0], [89.0, 85.0, 120.0]]
    t, batches = 0, []
    for b in prices:
        rows = []
        for p in b:
            rows.append((1, 7, T0 + dt.timedelta(hours=t), p, 100.0, 5.0))
            t += 1
        batches.append(rows)
    s = _stream(spark, tmp_path, batches, "user_id bigint, listing_id bigint, ts timestamp, price double, baseline_price double, target_drop_percent double")
    got = sorted((r.old_price, r.new_price) for r in drain_append(jobs.price_drops(s), "pd").collect())
    # 100 → 94 alerts (6 %), then 94 → 89 (5.3 %); 90 and 85 stay under 5 %.
    assert got == [(94.0, 89.0), (100.0, 94.0)]


PROFILE = "id bigint, user_id bigint, ts timestamp, action string, intent string, context_key string, context_value string"


def _profile_rows():
    return [(i, i % 3, T0 + dt.timedelta(minutes=(i * 7) % 30), "callback" if i % 4 == 0 else "message", f"i{i}" if i % 2 else None, f"k{i % 2}", f"v{i}") for i in range(30)]


def test_profiles_over_batches(spark, tmp_path):
    rows = _profile_rows()  # late rows too: later batches hold older times
    s = _stream(spark, tmp_path, [rows[:10], rows[10:20], rows[20:]], PROFILE)
    changes = drain_append(jobs.profile_changes(s), "pk")
    got = jobs.profiles(changes).collect()
    assert len(got) == 3
    for r in got:
        mine = sorted((x for x in rows if x[1] == r.user_id), key=lambda x: (x[2], x[0]))
        assert r.total_callbacks == sum(x[3] == "callback" for x in mine) and r.total_messages + r.total_callbacks == len(mine)
        assert r.first_seen == mine[0][2] and r.last_seen == mine[-1][2]
        assert r.last_intent == [x[4] for x in mine if x[4]][-1]
        assert r.context == {x[5]: x[6] for x in mine}
    # merged twice, or compacted, they say the same
    assert sorted(jobs.profiles(changes.unionByName(changes)).collect()) == sorted(got)


RULES = [(1, "sale", None, 0.0, None, 0), (2, None, "A", None, 500.0, 3)]


def _rules(spark):
    return spark.createDataFrame(RULES, "uid int, deal_type string, area string, min_price double, max_price double, last_listing_id bigint")


def test_alert_cursor_moves(spark, tmp_path):
    rows = [(i, "sale" if i % 2 else "rent", "A" if i % 3 else "B", float(i * 100)) for i in range(1, 10)]
    s = _stream(spark, tmp_path, [rows[:4], rows[4:]], "id bigint, deal_type string, area string, price double")
    m = jobs.alert_matches(_rules(spark), s, "uid", ["deal_type", "area"], top=2)
    got = sorted((r.uid, r.id) for r in drain_append(m, "am").collect())
    assert got == [(1, 1), (1, 3), (1, 7), (1, 9), (2, 4), (2, 5)]


def _jobs(spark):
    hours = [[0, 1, 5], [23, 24, 25], [49, 60, 73], [74, 97, 200]]
    listings = [[(i, "sale", "A", float(i)) for i in ids] for ids in ([5, 9], [7, 8, 9], [12, 3], [13])]
    prices = [[(1, 7, T0 + dt.timedelta(hours=4 * b + k), p, 100.0, 5.0) for k, p in enumerate(ps)] for b, ps in enumerate(([100.0, 97.0], [94.0, 90.0], [89.0, 85.0], [80.0, 70.0]))]
    profile = _profile_rows()
    return {
        "cooldown": ("user_id bigint, trigger string, ts timestamp", [[(1, "t", T0 + dt.timedelta(hours=h)) for h in b] for b in hours], lambda s: jobs.cooldown(s, 24)),
        "silence": ("key string, ts timestamp", [[("a", T0 + dt.timedelta(hours=h)) for h in b] for b in hours], lambda s: jobs.silence_alerts(s, "key", 20)),
        "drops": ("user_id bigint, listing_id bigint, ts timestamp, price double, baseline_price double, target_drop_percent double", prices, jobs.price_drops),
        "alerts": ("id bigint, deal_type string, area string, price double", listings, lambda s: jobs.alert_matches(_rules(spark), s, "uid", ["deal_type", "area"], top=2)),
        "profiles": (PROFILE, [profile[:8], profile[8:16], profile[16:24], profile[24:]], jobs.profile_changes),
    }


@pytest.mark.parametrize("name", ["cooldown", "silence", "drops", "alerts", "profiles"])
def test_killed_and_restarted_is_one_run(spark, tmp_path, name):
    schema, batches, job = _jobs(spark)[name]
    read = lambda at: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(at))
    def write(at, i):
        spark.createDataFrame(batches[i], schema).coalesce(1).write.parquet(f"{at}/part={i}")

    for i in range(len(batches)):
        write(tmp_path / "whole", i)
    once = drain_append(job(read(tmp_path / "whole")), name, str(tmp_path / "once"))
    # stopped after a batch, killed inside one, then run to the end, each time with a new query on the same checkpoint
    folder = str(tmp_path / "again")
    write(tmp_path / "in", 0)
    drain_append(job(read(tmp_path / "in")), name, folder)
    write(tmp_path / "in", 1)
    query = job(read(tmp_path / "in")).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start()
    while not query.lastProgress and query.isActive and not query.status["isTriggerActive"]:
        pass
    query.stop()
    for i in range(2, len(batches)):
        write(tmp_path / "in", i)
    again = drain_append(job(read(tmp_path / "in")), name, folder)
    rows = (lambda df: jobs.profiles(df)) if name == "profiles" else (lambda df: df)
    assert sorted(map(str, rows(again).collect())) == sorted(map(str, rows(once).collect())) != []


@pytest.mark.parametrize("gap_h", [48])
def test_silence(spark, tmp_path, gap_h):
    a = [(("a"), T0 + dt.timedelta(hours=h)) for h in (0, 10, 100)]
    b = [(("b"), T0 + dt.timedelta(hours=h)) for h in (0, 40, 80, 110)]
    s = _stream(spark, tmp_path, [a + b], "k string, ts timestamp")
    got = {(r.key, r.last_seen) for r in drain_append(jobs.silence_alerts(s, "k", gap_h), "si").collect()}
    assert ("a", T0 + dt.timedelta(hours=10)) in got and all(k != "b" for k, _ in got)


def test_bus_delivers_once(spark, tmp_path):
    rows = [(i % 5, "x", T0 + dt.timedelta(minutes=i)) for i in range(20)]
    s = _stream(spark, tmp_path, [rows[:10], rows[10:]], "id bigint, event_type string, ts timestamp")
    out = drain_append(jobs.event_bus(s, ["x"]), "bus")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4]


def test_many_keys_are_few_state_entries(spark, tmp_path):
    """Keys share slots of the state: its entries and handler calls do not grow with the keys, which stay exact."""
    users = [None, 2**60 + 1, *range(300)]
    batches = [[(u, "t", T0 + dt.timedelta(hours=h)) for u in users] for h in (0, 30)]
    fired = jobs.cooldown(_stream(spark, tmp_path, batches, "user_id bigint, trigger string, ts timestamp"), 24, slots=4)
    use_durable_state(spark)
    q = fired.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * 3  # an entry and two of its timer
    got = sorted(str(r.user_id) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == sorted(map(str, users * 2))
