import pytest

from brindle.plans.registry import ORACLE, QUERIES

from .oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_repeats(spark, sf_dir, name):
    one, two = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one == two and one


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10  # ids divisible by 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
