"""The checkpoint folder comes from the session; scratch tables are written under it."""

from contactlift.session import ensure_checkpoint_dir, scratch_path, sized


def test_checkpoint_dir_is_read_from_the_session(spark):
    ck = ensure_checkpoint_dir(spark)
    assert ck and ck == ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "x")
    assert path.startswith(ck.rstrip("/")) and "contactlift-x-" in path


def test_small_tables_are_broadcast_by_their_bytes(spark):
    small = sized(spark.range(10).toDF("id"))
    plan = spark.range(1000).join(small, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and small.count() == 10
