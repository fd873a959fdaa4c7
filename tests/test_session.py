import os

from spanops.session import clear_scratch, materialize, scratch_path, shared_dir


def test_scratch_lies_below_the_named_folder_and_can_be_cleared(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark), shared_dir(spark) + "/")
    root = os.path.dirname(scratch_path(spark, "x"))
    assert root.startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")
    frame = materialize(spark.range(10))
    assert frame.count() == 10 and os.listdir(root)
    clear_scratch(spark)
    assert not os.path.exists(root)
