import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodlark.operators import feed
from moodlark.operators.ranks import placed
from moodlark.sources import messages, pool
from moodlark.streaming import replay
from moodlark.workspace import new_path

ROWS = "idx long, id int, source string, target string, tweet string"


def stored(spark, n, rows_in_range=10):
    rows = spark.createDataFrame([(i, i * 2, f"s{i}", "T", f"text {i}") for i in range(n)], ROWS).repartition(3)
    return pool.store_pool(rows, new_path(spark, "pool"), rows_in_range)


def draws_of(spark, draws):
    return spark.createDataFrame([(d,) for d in draws], "draw long")


def test_a_draw_reads_one_range_however_large_the_pool_is(spark):
    for n in (35, 350):
        found = stored(spark, n).drawn(draws_of(spark, [24, 24, 21]))
        assert sorted(r.idx for r in found.collect()) == [20, 23]
        assert len(found.inputFiles()) == 1
        assert re.search(r"PushedFilters: \[[^\]]*In\(idx, \[", found._jdf.queryExecution().executedPlan().toString())


def test_draws_beyond_the_pool_and_none(spark):
    kept = stored(spark, 35)
    assert [r.idx for r in kept.drawn(draws_of(spark, [0, 36, 35, None])).collect()] == [34]
    assert kept.drawn(draws_of(spark, [])).count() == 0
    assert kept.drawn(draws_of(spark, [-5, 99])).count() == 0
    empty = stored(spark, 0)
    assert (empty.rows, empty.drawn(draws_of(spark, [1])).count()) == (0, 0)


@pytest.mark.parametrize("named", [3, 1000])
def test_many_draws_give_the_same_posts(spark, monkeypatch, named):
    monkeypatch.setattr(pool, "NAMED", named)
    kept, draw = stored(spark, 120), random.Random(3)
    for draws in ([5, 6, 7, 8], [draw.randrange(-2, 125) for _ in range(200)]):
        for compat in (False, True):
            drawn = draws_of(spark, draws)
            found = replay.replay(drawn, kept.drawn(drawn), compat)
            assert sorted(map(str, found.collect())) == sorted(map(str, replay.replay(drawn, kept.read(spark), compat).collect()))


def test_a_text_is_shaped_once_however_often_it_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(replay, "REPEATS_IN_ROW", 40)
    kept = stored(spark, 5)
    drawn = draws_of(spark, [2] * 130 + [4] * 40 + [9, 9, None, None])
    for compat, others in ((False, {}), (True, {9: 2, None: 2})):
        found = replay.replay(drawn, kept.drawn(drawn), compat)
        assert Counter(r.id for r in found.collect()) == Counter({2: 130, 4: 40} | others)
        chosen = replay._selected(drawn, kept.drawn(drawn), compat).collect()
        assert Counter((r.id, r.repeats) for r in chosen) == Counter([(2, 40)] * 3 + [(2, 10), (4, 40), *others.items()])
    assert replay.replay(draws_of(spark, []), kept.read(spark)).count() == 0


def test_stream_of_draws(spark):
    kept = stored(spark, 50)
    drawn = replay.ticks(spark).select(replay.random_draw(F.col("value"), 7, draws=50).alias("draw"))
    topic, log = new_path(spark, "topic"), new_path(spark, "log")
    for _ in range(2):
        replay.replay_stream(drawn, kept, {"path": topic}, log, "parquet").trigger(availableNow=True).start().awaitTermination()
    rows = messages.parse_messages(spark.read.schema(messages.MESSAGE).parquet(topic)).collect()
    assert 1 <= len(rows) <= 2
    assert all(r.source == f"s{r.id - 1}" for r in rows)


def test_a_batch_that_comes_again_is_sent_once_to_files(spark):
    kept, topic = stored(spark, 50), new_path(spark, "topic")
    for _ in range(2):
        messages.publish_batch(messages.to_messages(replay.replay(draws_of(spark, [3]), kept.read(spark))), 4, {"path": topic}, "parquet")
    assert spark.read.schema(messages.MESSAGE).parquet(topic).count() == 1


def test_first_rows_read_the_first_ranges(spark):
    kept = stored(spark, 95)
    shown = feed.first_stored(spark, kept, 12)
    assert len(shown.inputFiles()) == 2
    assert shown.orderBy("row_no").collect() == feed.first_rows(kept.read(spark), "idx", 12).orderBy("row_no").collect()
    assert feed.first_stored(spark, kept, 1000).count() == 95


def test_a_pool_is_found_again(spark):
    kept = stored(spark, 20)
    assert pool.is_stored(spark, kept.path)
    assert pool.open_pool(spark, kept.path) == kept
    assert not pool.is_stored(spark, new_path(spark, "pool"))


def test_places(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", "b", "b", "é"]), draw.random(), "x") for _ in range(500)]
    found = placed(spark.createDataFrame(rows, "g string, v double, _other string").repartition(7), "g", ["v"]).collect()
    for group in ("a", "b", "é"):
        own = sorted((r["place"], r["v"]) for r in found if r["g"] == group)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, v in own] == sorted(v for _, v in own)
