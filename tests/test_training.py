import duckdb

from tessera.operators import training as T
from tessera.plans import registry


def test_summary_and_comparison(spark):
    log = spark.createDataFrame([("beta", 1, 5.0), ("beta", 2, 3.0), ("band", 2, 3.0), ("band", 1, 9.0), ("band", 3, None), ("other", 1, 4.0)], "run string, step int, loss double")
    got = {r.run: r for r in T.compare_runs(T.run_summary(log)).collect()}
    assert [(k, r.position) for k, r in sorted(got.items(), key=lambda x: x[1].position)] == [("band", 1), ("beta", 2), ("other", 3)]
    assert (got["band"].first_loss, got["band"].last_loss, got["band"].n_steps) == (9.0, 3.0, 2)
    assert [k for k, r in got.items() if r.best] == ["band"]
    assert T.compare_runs(T.run_summary(log.limit(0))).count() == 0


def test_token_weighted_loss(spark):
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 3), ("a", None, 9), ("b", 2.0, 0)], "k string, loss double, n_tokens int")
    got = {r.k: (r.tokens, r.weighted_loss) for r in T.token_weighted_loss(d, ["k"]).collect()}
    assert got == {"a": (4, 2.5), "b": (0, None)}


def test_queries_agree_with_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    for name in ("run_comparison", "token_weighted_loss"):
        df = registry.queries()[name](spark, at)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=str), name
