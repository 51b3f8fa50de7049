import pytest
from pyspark.sql import functions as F

from moodlark.operators import feed
from moodlark.schemas import PREDICTION
from moodlark.sources import published, stores
from moodlark.workspace import new_path


def batch_of(spark, text, n=3):
    rows = [(f"{text} {i}", ["w"], "T", 1.0, float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "tweet string, filtered_words array<string>, target string, label double, prediction double")


def store(spark, path, batch_id, text, n=3):
    stores.append_predictions(batch_of(spark, text, n).coalesce(1), path, batch_id)


def texts(spark, path):
    return sorted(r.tweet for r in stores.read_predictions(spark, path).collect())


def test_a_replayed_batch_is_seen_old_or_new(spark, monkeypatch):
    path = new_path(spark, "predictions")
    assert texts(spark, path) == []
    store(spark, path, 0, "zero")
    store(spark, path, 1, "old")
    reader = stores.read_predictions(spark, path)
    with monkeypatch.context() as stopped:
        stopped.setattr(published, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            store(spark, path, 1, "new")
        # Written, but not published.
        assert [t for t in texts(spark, path) if t.startswith("new")] == []
        assert len(texts(spark, path)) == 6
    store(spark, path, 1, "new", 2)
    assert texts(spark, path) == ["new 0", "new 1", "zero 0", "zero 1", "zero 2"]
    # A reader from before still has its copy.
    assert sorted(r.tweet for r in reader.collect())[:3] == ["old 0", "old 1", "old 2"]
    assert published.remove_unlisted(spark, path) == 0
    # The list before the last is still honoured, so only the unpublished folder goes.
    assert published.remove_unlisted(spark, path, older_than=0) == 1
    assert len(texts(spark, path)) == 5


def test_a_draft_that_was_not_renamed_is_no_list(spark, monkeypatch):
    path = new_path(spark, "predictions")
    store(spark, path, 0, "old")
    with monkeypatch.context() as stopped:
        # The draft is written, its renaming is not reached.
        stopped.setattr(published, "_list_path", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError, match="driver lost"):
            published._put(spark, path, 0, [])
    system, at = published._file_system(spark, f"{path}/lists/.draft")
    system.create(at, False).close()
    assert texts(spark, path) == ["old 0", "old 1", "old 2"]
    store(spark, path, 0, "new")
    assert texts(spark, path) == ["new 0", "new 1", "new 2"]


def test_two_writers_of_one_version_fail(spark, monkeypatch):
    path = new_path(spark, "predictions")
    store(spark, path, 0, "a")
    store(spark, path, 1, "b")
    monkeypatch.setattr(published, "_versions", lambda *_: {0: [0]})
    with pytest.raises(RuntimeError, match="another job"):
        store(spark, path, 2, "c")


def test_finished_ranges_are_merged(spark, monkeypatch):
    monkeypatch.setattr(published, "BATCHES_IN_RANGE", 4)
    path = new_path(spark, "predictions")
    for batch_id in range(10):
        store(spark, path, batch_id, f"b{batch_id}", 2)
    before = [tuple(r) for r in feed.prediction_feed(stores.read_predictions(spark, path)).collect()]
    reader = stores.read_predictions(spark, path)
    assert published.merge(spark, path) == 2
    assert published.merge(spark, path) == 0
    held = published.entries(spark, path)
    assert [(e.first, e.last, e.rows) for e in held] == [(0, 3, 8), (4, 7, 8), (8, 8, 2), (9, 9, 2)]
    after = stores.read_predictions(spark, path)
    assert [tuple(r) for r in feed.prediction_feed(after).collect()] == before
    # One file for each merged range and for each batch of the last one; old files serve readers that have them.
    assert len(after.inputFiles()) == 4
    assert reader.count() == 20
    with pytest.raises(ValueError, match="final"):
        store(spark, path, 2, "late")
    store(spark, path, 9, "again", 1)
    assert stores.stored_predictions_count(spark, path) == 19
    # Only what was refused goes, until the next list of a range: then its batches' folders are not needed.
    assert published.remove_unlisted(spark, path, older_than=0) == 1
    published._put(spark, path, 0, held[:1])
    assert published.remove_unlisted(spark, path, older_than=0) == 4
    assert texts(spark, path)[0] == "again 0" and len(texts(spark, path)) == 19


def test_merged_files_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(published, "BATCHES_IN_RANGE", 5)
    path = new_path(spark, "predictions")
    for batch_id in range(6):
        store(spark, path, batch_id, f"b{batch_id}", 7)
    published.merge(spark, path, rows_in_file=10)
    merged = published.read(spark, path, PREDICTION, published.entries(spark, path)[:1])
    assert 2 <= len(merged.inputFiles()) <= 4
    spans = merged.groupBy(F.input_file_name()).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:], strict=False))


def test_merged_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(published, "BATCHES_IN_RANGE", 5)
    path = new_path(spark, "predictions")
    for batch_id in range(6):
        store(spark, path, batch_id, f"b{batch_id}", 7)
    before = texts(spark, path)
    listed = published.entries(spark, path)[:5]
    size = published._stored_bytes(spark, path, listed)
    assert size > 5 * 100
    published.merge(spark, path, bytes_in_file=-(-size // 4))
    merged = published.read(spark, path, PREDICTION, published.entries(spark, path)[:1])
    assert 3 <= len(merged.inputFiles()) <= 5
    assert texts(spark, path) == before


def test_newest_rows_read_the_last_batches_only(spark, monkeypatch):
    monkeypatch.setattr(published, "BATCHES_IN_RANGE", 3)
    path = new_path(spark, "predictions")
    assert feed.newest_stored(spark, path).count() == 0
    for batch_id in range(8):
        store(spark, path, batch_id, f"b{batch_id}", 2)
    published.merge(spark, path)
    newest = stores.read_newest_predictions(spark, path, 3)
    assert len(newest.inputFiles()) == 2
    everything = stores.read_predictions(spark, path)
    for n in (1, 5, 30):
        shown = feed.newest_stored(spark, path, n).orderBy("row_no").collect()
        assert shown == feed.newest_predictions(everything, n).orderBy("row_no").collect()
