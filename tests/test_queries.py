import pytest

from quernel import queries
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    sql = queries.oracle_sql().get(name)
    if sql:
        same_rows(df, sql, sf_dir)
    else:
        assert df.count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parity_is_audited_over_all_parts(spark, sf_dir):
    r = queries.queries()["style_parity_audit_all"](spark, sf_dir).groupBy().sum("n_structured").first()[0]
    outcomes = {x["outcome"] for x in queries.queries()["style_parity_audit_all"](spark, sf_dir).select("outcome").distinct().collect()}
    assert r == spark.read.parquet(f"{sf_dir}/part.parquet").count() and outcomes == {"ambiguous", "paired", "unpaired"}


def test_shuffle_has_every_document(spark, sf_dir):
    rows = queries.queries()["seeded_shuffle_all"](spark, sf_dir).collect()
    assert [r["rank"] for r in rows] == list(range(spark.read.parquet(f"{sf_dir}/documents.parquet").count()))
    assert len({r["doc_id"] for r in rows}) == len(rows)
