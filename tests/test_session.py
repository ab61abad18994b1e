from datetime import UTC, datetime

from prospecta import session as SS


def test_rows_df_is_jvm_side_and_typed(spark):
    df = SS.rows_df(spark, [("a", 1, datetime(2024, 1, 2, 3, 4, 5, 6)), ("b", None, None)], "k string, n bigint, t timestamp_ntz")
    assert df.schema.simpleString() == "struct<k:string,n:bigint,t:timestamp_ntz>"
    assert [tuple(r) for r in df.collect()] == [("a", 1, datetime(2024, 1, 2, 3, 4, 5, 6)), ("b", None, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    assert SS.rows_df(spark, [], "k string").count() == 0
    inst = SS.rows_df(spark, [(datetime(2024, 1, 1, tzinfo=UTC),)], "t timestamp").first().t
    assert inst.replace(tzinfo=None) == datetime(2024, 1, 1)  # session time zone is UTC here


def test_scratch_under_checkpoint_root(spark):
    root = SS.checkpoint_root(spark)
    a, b = SS.scratch_path(spark, "x"), SS.scratch_path(spark, "x")
    assert a.startswith(root) and b.startswith(root) and a != b
