"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    found = contract.queries()[name](spark, SF_DIR)
    expected = tables.execute(contract.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(names, expected.fetchall())


@pytest.fixture
def as_if_large(spark):
    """No join side is small enough to broadcast; skew is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "80kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


JOINING = [
    "a1_entity_counts",
    "a4_top_words",
    "l4_latest_metrics",
    "m2_token_vectors",
    "m4_tf_idf",
    "m7_long_form_scores",
    "p6_record_defaults",
    "s4_replay_pool",
    "t11_lemmas",
    "x2_replayed_posts_compat",
]


@pytest.mark.parametrize("name", JOINING)
def test_joins_without_broadcasts(spark, tables, as_if_large, name):
    test_query_equals_its_sql(spark, tables, name)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in contract.oracle_sql()])
def test_query_without_sql_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["source", "target", "n"]
    assert found.count() > 0
