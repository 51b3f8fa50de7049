"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
from moodlark.operators.top_words import count_words
from moodlark.plans.posts import labelled_posts

SF_DIR = "/root/testdata/sf0.001"

# Queries that only build a plan, without writing tables or training first.
LAZY = [
    "a1_entity_counts", "a2_entity_chart", "a3_sentiment_shares", "a5_prediction_count", "l1_first_rows",
    "l3_newest_predictions", "l4_latest_metrics", "m1_bigram_counts", "m2_token_counts",
    "m4_idf_weights", "m9_hash_split", "m10_accuracy", "m11_weighted_f1", "m13_class_names",
    "p1_parsed_props", "p2_flattened_messages", "p3_posts_with_text", "p5_charted_posts", "p6_record_defaults",
    "t1_cleaned_text", "t5_tokens", "t6_filtered_words", "t7_bigrams", "t8_word_tokens", "t10_content_words",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_workers_and_no_cross_joins(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    for banned in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in plan


@pytest.mark.parametrize("name", ["a1_entity_counts", "a3_sentiment_shares", "a5_prediction_count", "m11_weighted_f1"])
def test_counts_never_read_the_text(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(contract.queries()[name](spark, SF_DIR)))
    assert schemas
    assert not any("text" in schema for schema in schemas)


def test_counts_are_reduced_before_the_shuffle(spark):
    plan = plan_of(contract.queries()["a1_entity_counts"](spark, SF_DIR))
    assert re.search(r"HashAggregate.*\n.*Exchange hashpartitioning\(source.*\n.*HashAggregate.*partial_count", plan)


@pytest.mark.parametrize("name", ["l1_first_rows", "l3_newest_predictions", "l4_latest_metrics"])
def test_limits_keep_the_top_rows_of_each_task(spark, name):
    assert "TakeOrderedAndProject" in plan_of(contract.queries()[name](spark, SF_DIR))


def test_words_are_hash_aggregated(spark):
    plan = plan_of(count_words(labelled_posts(spark, SF_DIR)))
    assert plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["m1_bigram_counts", "m2_token_counts"])
def test_texts_are_tokenized_once(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    assert not re.search(r"Filter .*UDF", plan)


def test_top_words_keep_the_top_of_each_task(spark):
    plan = plan_of(contract.queries()["a4_top_words"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") == 2




def test_no_large_limit_in_one_task(spark):
    assert "TakeOrdered" not in plan_of(contract.queries()["m3_capped_vocabulary"](spark, SF_DIR))


def test_feed_sorts_stored_words(spark):
    assert "UDF" not in plan_of(contract.queries()["l2_prediction_feed"](spark, SF_DIR))


def test_latest_metrics_scan_posts_once(spark):
    assert "documents.parquet" not in plan_of(contract.queries()["l4_latest_metrics"](spark, SF_DIR))


def test_long_form_scores_meet_terms_once(spark):
    plan = plan_of(contract.queries()["m7_long_form_scores"](spark, SF_DIR))
    assert plan.count("Join") == 1
