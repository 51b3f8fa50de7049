"""The four programs: train, score, replay, report.

    spark-submit --packages org.apache.spark:spark-sql-kafka-0-10_2.13:4.1.2 \\
        moodlark/jobs.py train --posts posts/ --model model/ --metrics metrics/

Each one builds its DataFrames and hands them to the operators; a program can
be run against files instead of Kafka with ``--format`` and ``--option``.
"""

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.functions.lexicon import DASHBOARD_STOP_WORDS
from moodlark.operators import counts, features, feed, metrics
from moodlark.operators import model as classifier
from moodlark.operators.top_words import top_words
from moodlark.schemas import DASHBOARD_NAMES
from moodlark.sources import messages, posts_csv, stores
from moodlark.sources.pool import is_stored, open_pool, store_pool
from moodlark.streaming import dashboard, replay, scorer
from moodlark.workspace import new_path, remove_run_folder


def train(
    spark: SparkSession,
    posts: str,
    metrics_path: str,
    model: str | None = None,
    terms: str = features.BIGRAMS,
    vocabulary: int = classifier.DEFAULT_VOCABULARY,
    compat: bool = False,
    line_breaks: bool = False,
) -> classifier.Training:
    """Fit the classifier on a post CSV, keep it, and store its rounded metrics."""
    pipeline = classifier.sentiment_pipeline(terms, vocabulary)
    training = classifier.train(posts_csv.read_posts(spark, posts, compat=compat, line_breaks=line_breaks), pipeline)
    if model:
        classifier.save_model(training.model, model)
    stores.append_metrics(metrics.rounded(training.metrics), metrics_path, training.model.uid)
    return training


def score(
    spark: SparkSession,
    model: str,
    stream: DataFrame,
    predictions: str,
    summaries: str,
    checkpoint: str,
    strict: bool = False,
    trigger: dict | None = None,
    rejected: str | None = None,
):
    """Score a message stream with a stored model and keep the dashboard summaries."""
    scoring = scorer.model_scorer(classifier.load_model(model), strict)
    posts = messages.parse_messages(stream)
    return scorer.start_scoring(
        posts, scoring, predictions, checkpoint, summaries, trigger=trigger, rejected_path=rejected
    )


def send(
    spark: SparkSession,
    posts: str,
    sink_format: str,
    sink_options: dict[str, str],
    checkpoint: str,
    seed: int = 0,
    compat: bool = False,
    trigger: dict | None = None,
    draws: int | None = None,
    line_breaks: bool = False,
    pool: str | None = None,
):
    """Replay random posts of a CSV as messages, one every ten seconds.

    Each is drawn from the first ``draws`` posts; by default from all of them,
    in compat mode from the first 899. The posts are stored by position first,
    in ``pool`` if given: then a later start finds them there.
    """
    at = pool or new_path(spark, "pool")
    if pool and is_stored(spark, at):
        stored = open_pool(spark, at)
    else:
        stored = store_pool(posts_csv.read_replay_pool(spark, posts, line_breaks=line_breaks), at)
    rows = draws or (replay.POOL_ROWS if compat else stored.rows)
    drawn = replay.ticks(spark).select(replay.random_draw(F.col("value"), seed, rows, compat).alias("draw"))
    writer = replay.replay_stream(drawn, stored, sink_options, checkpoint, sink_format, compat)
    return writer.trigger(**(trigger or replay.pace())).start()


def report(
    spark: SparkSession,
    posts: str,
    out: str,
    stop_words: Sequence[str] = DASHBOARD_STOP_WORDS,
    header: Sequence[str] = tuple(DASHBOARD_NAMES.values()),
    line_breaks: bool = False,
) -> dict[str, DataFrame]:
    """Write the dashboard tables of a post CSV. The file is parsed once for all of them."""
    read = posts_csv.read_dashboard_posts(spark, posts, header=header, line_breaks=line_breaks)
    stored = posts_csv.with_position(read)
    first = feed.first_rows(stored).drop("idx").withColumnsRenamed(DASHBOARD_NAMES)
    tables = {
        "entity_counts": counts.count_by_entity(stored),
        "entity_chart": counts.chart_by_entity(stored),
        "sentiment_shares": counts.sentiment_shares(stored),
        "top_words": top_words(stored, position="idx", stop_words=stop_words),
        "first_rows": first,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{out}/{name}")
    return tables


def show(spark: SparkSession, summaries: str, metrics_path: str) -> None:
    """Print what the dashboard's front page shows."""
    kept = dashboard.read_summaries(spark, summaries)
    dashboard.shown_newest(kept).orderBy(F.desc("row_no")).show(truncate=60)
    dashboard.shown_count(kept).show()
    feed.latest_metrics(stores.read_metrics(spark, metrics_path)).show()


def _options(pairs: Sequence[str]) -> dict[str, str]:
    return dict(pair.split("=", 1) for pair in pairs)


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Sentiment analytics over labelled posts")
    commands = parser.add_subparsers(dest="command", required=True)

    command = commands.add_parser("train", help=train.__doc__)
    command.add_argument("--posts", required=True)
    command.add_argument("--metrics", required=True)
    command.add_argument("--model")
    command.add_argument("--terms", choices=(features.BIGRAMS, features.TOKENS), default=features.BIGRAMS)
    command.add_argument("--vocabulary", type=int, default=classifier.DEFAULT_VOCABULARY)
    command.add_argument("--compat", action="store_true")
    command.add_argument("--line-breaks", action="store_true", help="quoted fields hold line breaks")

    command = commands.add_parser("score", help=score.__doc__)
    for name in ("--model", "--predictions", "--summaries", "--checkpoint"):
        command.add_argument(name, required=True)
    command.add_argument("--strict", action="store_true")
    command.add_argument("--rejected", help="table of posts without text, by default beside the predictions")

    command = commands.add_parser("replay", help=send.__doc__)
    command.add_argument("--posts", required=True)
    command.add_argument("--checkpoint", required=True)
    command.add_argument("--seed", type=int, default=0)
    command.add_argument("--compat", action="store_true")
    command.add_argument("--draws", type=int, help="number of posts, from the first, that are drawn from")
    command.add_argument("--line-breaks", action="store_true")
    command.add_argument("--pool", help="where the posts are stored by position, for later starts too")

    for name in ("score", "replay"):
        command = commands.choices[name]
        # Option names and local default known from the connector.
        command.add_argument("--bootstrap-server", default="localhost:9092")
        command.add_argument("--topic", default="posts")
        command.add_argument("--format", default=messages.KAFKA)
        command.add_argument("--option", action="append", default=[], help="name=value for another format")

    command = commands.add_parser("report", help=report.__doc__)
    command.add_argument("--posts", required=True)
    command.add_argument("--out", required=True)
    command.add_argument("--header", nargs=4, default=list(DASHBOARD_NAMES.values()))
    command.add_argument("--line-breaks", action="store_true")

    command = commands.add_parser("show", help=show.__doc__)
    command.add_argument("--summaries", required=True)
    command.add_argument("--metrics", required=True)
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    spark = SparkSession.builder.appName(f"moodlark-{args.command}").getOrCreate()
    try:
        _run(spark, args)
    finally:
        remove_run_folder(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "train":
        train(
            spark, args.posts, args.metrics, args.model, args.terms, args.vocabulary, args.compat, args.line_breaks
        )
        feed.latest_metrics(stores.read_metrics(spark, args.metrics)).show()
    elif args.command == "score":
        if args.format == messages.KAFKA:
            stream = messages.subscribe(spark, messages.kafka_options(args.bootstrap_server, args.topic))
        else:
            stream = messages.subscribe(spark, _options(args.option), args.format, messages.MESSAGE)
        score(
            spark, args.model, stream, args.predictions, args.summaries, args.checkpoint, args.strict,
            rejected=args.rejected,
        ).awaitTermination()
    elif args.command == "replay":
        if args.format == messages.KAFKA:
            options = messages.kafka_sink_options(args.bootstrap_server, args.topic)
        else:
            options = _options(args.option)
        send(
            spark, args.posts, args.format, options, args.checkpoint, args.seed, args.compat,
            draws=args.draws, line_breaks=args.line_breaks, pool=args.pool,
        ).awaitTermination()
    elif args.command == "report":
        report(spark, args.posts, args.out, header=args.header, line_breaks=args.line_breaks)
    else:
        show(spark, args.summaries, args.metrics)


if __name__ == "__main__":
    main()
