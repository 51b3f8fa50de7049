import csv
import random
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moodlark.schemas import CORRUPT_RECORD, POST
from moodlark.sources import messages, posts_csv, quoted_csv, stores
from moodlark.workspace import group, new_path, remove_group, remove_run_folder, shared_dir, written


def csv_file(folder, *lines, name="posts.csv"):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(row) for row in df.collect()]


def test_training_csv(spark, tmp_path):
    path = csv_file(tmp_path, '1,E,Positive,"he said ""hi"", ok"', '2,E,Neutral,"two', 'lines"', "x,E,T,t", "4,E", "5,E,T,t,extra")
    assert rows(posts_csv.read_posts(spark, path, line_breaks=True)) == [
        (1, "E", "Positive", 'he said "hi", ok'),
        (2, "E", "Neutral", "two\nlines"),
        (None, "E", "T", "t"),
        (4, "E", None, None),
        (5, "E", "T", "t"),
    ]


def test_training_csv_compat(spark, tmp_path):
    path = csv_file(tmp_path, '1,E,Positive,"he said ""hi"", ok"', '2,E,Neutral,"two', 'lines"')
    found = rows(posts_csv.read_posts(spark, path, compat=True))
    assert found[0] == (1, "E", "Positive", '"he said ""hi""')
    assert len(found) == 3
    assert found[2] == (None, None, None, None)


HEADER = ("id", "e", "s", "t")


def test_every_dashboard_file_needs_its_header(spark, tmp_path):
    csv_file(tmp_path, "Tweet ID,Entity,Sentiment,Tweet content", "1,E,T,a", name="a.csv")
    assert rows(posts_csv.read_dashboard_posts(spark, str(tmp_path))) == [(1, "E", "T", "a")]
    csv_file(tmp_path, "2,b,Positive,y", "3,b,Positive,z", name="b.csv")
    with pytest.raises((PySparkException, Py4JJavaError), match="header"):
        posts_csv.read_dashboard_posts(spark, str(tmp_path)).collect()


def test_posts_split_at_lines_by_default(spark, tmp_path):
    path = csv_file(tmp_path, *[f'{i},E,T,"a ""{i}"", b"' for i in range(500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = posts_csv.read_posts(spark, path)
        assert found.rdd.getNumPartitions() > 3
        assert sorted(rows(found)) == [(i, "E", "T", f'a "{i}", b') for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dashboard_csv(spark, tmp_path):
    path = csv_file(tmp_path, "id,e,s,t", '1,E,Positive,"he said ""hi"", ok"', '2,E,Neutral,"two', 'lines"', "3,,Neutral,")
    expected = [(1, "E", "Positive", 'he said "hi", ok'), (2, "E", "Neutral", "two\nlines"), (3, "", "Neutral", "")]
    options = {"header": HEADER, "line_breaks": True}
    assert rows(posts_csv.read_dashboard_posts(spark, path, **options)) == expected
    good, bad = posts_csv.quarantine_dashboard_posts(spark, path, **options)
    assert rows(good) == expected
    assert bad.count() == 0


@pytest.mark.parametrize("line", ["1,E,T", "1,E,T,t,extra", "x,E,T,t", ",E,T,t"])
def test_malformed_dashboard_row(spark, tmp_path, line):
    path = csv_file(tmp_path, "id,e,s,t", "7,E,T,t", line)
    strict = posts_csv.read_dashboard_posts(spark, path, header=HEADER)
    # Also when a query asks for none of the columns that are wrong.
    for query in (strict, strict.select("target"), strict.groupBy().count()):
        with pytest.raises(PySparkException, match="malformed post row"):
            query.collect()
    good, bad = posts_csv.quarantine_dashboard_posts(spark, path, header=HEADER)
    assert rows(good) == [(7, "E", "T", "t")]
    assert good.count() == 1
    assert bad.count() == 1
    if not line.startswith(","):
        assert bad.first()[CORRUPT_RECORD] == line


def test_positions_follow_the_files(spark, tmp_path):
    expected = []
    for part in range(6):
        texts = [f"{part}-{i}" for i in range(part * 7 % 5 + 1)]
        csv_file(tmp_path, *[f"1,E,T,{t}" for t in texts], name=f"part-{part}.csv")
        expected += texts
    pool = posts_csv.read_replay_pool(spark, str(tmp_path))
    found = sorted((row.idx, row.tweet) for row in pool.collect())
    assert found == list(enumerate(expected))


def test_positions_in_split_files(spark, tmp_path):
    path = csv_file(tmp_path, *[f"{i},E,T,{'x' * (i % 50)}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scan = posts_csv.read_posts(spark, path, compat=True)
        assert scan.rdd.getNumPartitions() > 3
        numbered = posts_csv.with_position(scan)
        assert numbered.count() == 5000
        assert numbered.where(F.col("idx") != F.col("id")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_csv_reads_back_whole(spark, posts_of):
    posts = posts_of([(1, " s ", "T", ' a "q", \\ b\n\nc\r\n '), (2, "s", "T", 'ends with "'), (3, "s", "T", ",")])
    path = new_path(spark, "csv")
    posts_csv.write_posts(posts, path)
    assert sorted(rows(posts_csv.read_posts(spark, path, line_breaks=True))) == sorted(rows(posts))


def test_parse_messages(spark):
    bodies = ['{"id":"5","tweet":"x"}', '{"id":1.5,"tweet":7}', "not json", None, '{"id":3,"other":1,"target":"T"}']
    sent = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, value string").orderBy("i")
    parsed = messages.parse_messages(sent.select(F.col("value").cast("binary").alias("value")))
    assert parsed.schema == POST
    nothing = (None, None, None, None)
    assert rows(parsed) == [(None, None, None, "x"), (None, None, None, "7"), nothing, nothing, (3, None, "T", None)]


def test_messages_keep_null_fields(spark, posts_of):
    sent = messages.to_messages(posts_of([(1, "s", None, 'é "q"\n')]))
    assert sent.first().value == '{"id":1,"source":"s","target":null,"tweet":"é \\"q\\"\\n"}'


def test_kafka_options():
    assert messages.kafka_options("b:1", "t") == {"kafka.bootstrap.servers": "b:1", "subscribe": "t"}


def test_defaults(spark):
    records = spark.createDataFrame([("a", None), (None, 2.0)], "tweet string, f1 double")
    defaults = {"tweet": F.lit(""), "accuracy": F.lit(0.0), "f1": F.lit(0.0)}
    assert rows(stores.with_defaults(records, defaults)) == [("a", 0.0, 0.0), ("", 0.0, 2.0)]


def test_prediction_table(spark):
    path = new_path(spark, "predictions")
    scored = spark.createDataFrame(
        [("a b", ["a", "b"], "T", 1.0, 0.0, [1.0])],
        "tweet string, filtered_words array<string>, target string, label double, prediction double, extra array<double>",
    )
    stores.append_predictions(scored.union(scored), path, 0)
    stores.append_predictions(scored, path, 1)
    stores.append_predictions(scored, path, 1)
    stored = stores.read_predictions(spark, path)
    assert sorted(rows(stored.groupBy("batch_id").count())) == [(0, 2), (1, 1)]
    assert stored.where("scored_at is null").count() == 0
    assert stored.where("batch_id = 0").select("seq").distinct().count() == 2
    assert "extra" not in stored.columns


def test_metrics_table(spark):
    path = new_path(spark, "metrics")
    measured = spark.createDataFrame([(0.5, 0.25)], "accuracy double, f1 double")
    stores.append_metrics(measured, path, "m1", datetime(2024, 1, 1))
    stores.append_metrics(measured, path, "m2", datetime(2024, 1, 2))
    assert rows(stores.read_metrics(spark, path).select("model_id", "f1").orderBy("trained_at")) == [("m1", 0.25), ("m2", 0.25)]


def test_shared_folder_comes_from_the_session(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark) + "/moodlark-")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_run_folder_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("moodlark.workspace.run_folder", lambda _: f"{tmp_path}/run")
    assert written(spark.range(3), "t").count() == 3
    assert (tmp_path / "run").exists()
    remove_run_folder(spark)
    assert not (tmp_path / "run").exists()


def test_groups_of_tables_are_removed(spark):
    with group("stage") as name:
        inside = written(spark.range(3), "t")
    outside = written(spark.range(4), "t")
    assert inside.count() == 3
    remove_group(spark, name)
    assert outside.count() == 4
    with pytest.raises((PySparkException, Py4JJavaError)):
        inside.count()


PIECES = ["1", "x", "", '"a"', '"a ""b"" c"', '"two\nlines"', '"x,\r\n\n""y"",\n"', '5" pipe', 'a"b"c', '""', '""""', '"\n"', '"' + "long\n" * 40 + '"', "é", '"é\n"']


def written_by_chance(draw, n, end):
    return end.join(",".join(draw.choices(PIECES, k=draw.randrange(1, 6))) for _ in range(n)) + end * draw.randrange(3)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, small_splits, end):
    draw = random.Random(len(end))
    contents = [written_by_chance(draw, n, end) for n in (400, 1, 0, 150)]
    for i, content in enumerate(contents):
        (tmp_path / f"{i}.csv").write_bytes(content.encode())
    schema = ", ".join(f"c{i} string" for i in range(5))
    # All kinds of rows are told from one another by their raw texts.
    raw = quoted_csv.records(spark, str(tmp_path)).orderBy("file_path", "start", "row").collect()
    expected = []
    for content in contents:
        record, inside = [], False
        for line in content.split("\n"):
            record.append(line)
            for field in line.split(","):
                if inside or field.startswith('"'):
                    inside ^= field.count('"') % 2 == 1
            if not inside:
                expected.append("\n".join(record).removesuffix("\r"))
                record = []
    assert [r["value"] for r in raw] == [x for x in expected if x]
    assert len({(r["file_path"], r["start"]) for r in raw}) > 10
    # Without quotes inside of plain fields, Spark's own reader agrees, which reads each file in one task.
    whole = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(str(tmp_path))
    fields = StructType([StructField(f"c{i}", StringType()) for i in range(5)])
    split = posts_csv.read_posts(spark, str(tmp_path), fields, line_breaks=True)
    if end == "\n":
        assert sorted(map(str, rows(split))) == sorted(map(str, rows(whole)))
    assert split.rdd.getNumPartitions() > 10


def test_positions_of_records_with_line_breaks(spark, tmp_path, small_splits):
    texts = [f"{i}\n" * (i % 9) + 'q"' * (i % 2) for i in range(300)]
    for part in range(3):
        with (tmp_path / f"part-{part}.csv").open("w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows([i, "E", "T", texts[i]] for i in range(part * 100, part * 100 + 100))
    pool = posts_csv.read_replay_pool(spark, str(tmp_path), line_breaks=True)
    found = sorted((r["idx"], r["id"], r["tweet"] or "") for r in pool.collect())
    assert found == [(i, i, t) for i, t in enumerate(texts)]


def test_quote_that_is_never_closed(spark, tmp_path, small_splits):
    lines = [f"{i},E,T,t" for i in range(100)]
    csv_file(tmp_path, *lines, '100,E,T,"open', *lines, name="a.csv")
    csv_file(tmp_path, *lines, name="b.csv")
    found = [r["value"] for r in quoted_csv.records(spark, str(tmp_path)).orderBy("file_path", "start", "row").collect()]
    assert found == [*lines, "\n".join(['100,E,T,"open', *lines]), *lines]


def test_blocks_meet_their_states_without_a_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(quoted_csv, "SENT_BLOCKS", 0)
    path = csv_file(tmp_path, *[f'{i},E,T,"a\n{i}"' for i in range(200)])
    assert sorted(r["id"] for r in posts_csv.read_posts(spark, path, line_breaks=True).collect()) == list(range(200))


def test_dashboard_headers_with_line_breaks(spark, tmp_path):
    csv_file(tmp_path, "Tweet ID,Entity,Sentiment,Tweet content", '1,E,T,"a', 'b"', name="a.csv")
    assert rows(posts_csv.read_dashboard_posts(spark, str(tmp_path), line_breaks=True)) == [(1, "E", "T", "a\nb")]
    csv_file(tmp_path, "2,b,Positive,y", name="b.csv")
    with pytest.raises((PySparkException, Py4JJavaError), match="header"):
        posts_csv.read_dashboard_posts(spark, str(tmp_path), line_breaks=True).collect()


@pytest.mark.parametrize("line", ["1,E,T", "1,E,T,t,extra", "x,E,T,t", ",E,T,t"])
def test_malformed_dashboard_row_with_line_breaks(spark, tmp_path, line):
    path = csv_file(tmp_path, "id,e,s,t", '7,E,T,"t', '"', line)
    good, bad = posts_csv.quarantine_dashboard_posts(spark, path, header=HEADER, line_breaks=True)
    assert rows(good) == [(7, "E", "T", "t\n")]
    assert bad.count() == 1
    with pytest.raises(PySparkException, match="malformed post row"):
        posts_csv.read_dashboard_posts(spark, path, header=HEADER, line_breaks=True).collect()
