from moodlark import jobs
from moodlark.operators import features
from moodlark.sources import messages, stores
from moodlark.streaming import dashboard
from moodlark.workspace import new_path

TARGETS = ["Positive", "Negative", "Neutral", "Irrelevant"]


def test_the_programs_work_together(spark, tmp_path):
    posts = tmp_path / "posts.csv"
    lines = [f'{i},Game {i % 3},{TARGETS[i % 4]},"word{i % 4}, dogs and dog {i}"' for i in range(200)]
    posts.write_text("\n".join(lines))
    model, metrics_path = new_path(spark, "model"), new_path(spark, "metrics")
    training = jobs.train(spark, str(posts), metrics_path, model, features.TOKENS, vocabulary=30)
    stored = stores.read_metrics(spark, metrics_path).first()
    assert stored.accuracy == round(training.metrics.first().accuracy, 2)
    assert stored.model_id == training.model.uid

    topic, log = new_path(spark, "topic"), new_path(spark, "log")
    for _ in range(3):
        query = jobs.send(spark, str(posts), "parquet", {"path": topic}, log, trigger={"availableNow": True})
        query.awaitTermination()
    sent = messages.parse_messages(spark.read.parquet(topic))
    assert sent.count() >= 1
    assert {row.source for row in sent.collect()} == {"Game"}

    predictions, summaries = new_path(spark, "predictions"), new_path(spark, "summaries")
    stream = messages.subscribe(spark, {"path": topic}, "parquet", messages.MESSAGE)
    jobs.score(
        spark, model, stream, predictions, summaries, new_path(spark, "log"), trigger={"availableNow": True}
    ).awaitTermination()
    kept = dashboard.read_summaries(spark, summaries)
    assert dashboard.shown_count(kept).first().predictions == sent.count()
    jobs.show(spark, summaries, metrics_path)


def test_report(spark, tmp_path):
    posts = tmp_path / "posts.csv"
    lines = [f'{i},Game {i % 3},{TARGETS[i % 4]},"dogs and a dog {i}"' for i in range(150)]
    posts.write_text("\n".join(["Tweet ID,Entity,Sentiment,Tweet content", *lines]))
    tables = jobs.report(spark, str(posts), new_path(spark, "report"))
    assert sum(row.n for row in tables["entity_counts"].collect()) == 150
    assert tables["entity_chart"].count() == 3
    assert {row.pct for row in tables["sentiment_shares"].collect()} <= {38 / 1.5, 37 / 1.5, 38 / 150 * 100, 37 / 150 * 100}
    top = {(row.sentiment, row.word): row.n for row in tables["top_words"].where("rank = 1").collect()}
    assert top == {("positive", "dog"): 76, ("negative", "dog"): 76, ("neutral", "dog"): 74}
    first = tables["first_rows"].orderBy("row_no").collect()
    assert [row["Tweet ID"] for row in first] == list(range(100))
    assert list(first[0].asDict()) == ["row_no", "Tweet ID", "Entity", "Sentiment", "Tweet content"]


def test_arguments():
    args = jobs._arguments(["replay", "--posts", "p", "--checkpoint", "c"])
    assert (args.bootstrap_server, args.topic, args.format) == ("localhost:9092", "posts", "kafka")
    assert jobs._options(["path=/a=b", "x=1"]) == {"path": "/a=b", "x": "1"}
