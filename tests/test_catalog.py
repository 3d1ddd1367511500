"""Every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from tidelark import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: round(x + 0.0, 5) if isinstance(x, float) else x).values.tolist()))
    assert text(got) == text(want)


def test_flagship(spark):
    assert catalog.flagship(spark, FOLDER).count() == 4


def test_recipe_on_a_stream(spark):
    from tidelark.operators.steps import step_center
    from tidelark.plans.recipe import Recipe
    from tidelark.streaming.bake import bake_stream

    t = spark.read.parquet(f"{FOLDER}/events.parquet")
    fitted = Recipe().add(step_center(["value"])).prep(t)
    stream = spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    q = bake_stream(stream, fitted).writeStream.format("memory").queryName("baked").start()
    q.processAllAvailable()
    q.stop()
    assert abs(spark.table("baked").agg({"value": "avg"}).first()[0]) < 1e-9
