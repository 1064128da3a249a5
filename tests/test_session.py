import os
import threading

from factloom import session


def folder(df):
    return df.inputFiles()[0].removeprefix("file://")


def test_working_copies_go_with_their_job(spark):
    kept = session.cut_lineage(spark.range(3))
    with session.working_copies(spark):
        gone = session.cut_lineage(spark.range(4))
        files = session.scratch_path(spark, "files")
        spark.range(2).write.parquet(files)
        assert gone.count() == 4 and os.path.exists(folder(gone))
    assert not os.path.exists(folder(gone)) and not os.path.exists(files.removeprefix("file:")) and kept.count() == 3


def test_jobs_at_once_leave_each_other_alone(spark):
    made = threading.Event()
    over = threading.Event()
    seen = {}

    def other():
        with session.working_copies(spark):
            seen["df"] = session.cut_lineage(spark.range(5))
            made.set()
            over.wait(60)
            seen["n"] = seen["df"].count()

    job = threading.Thread(target=other)
    job.start()
    with session.working_copies(spark):
        session.cut_lineage(spark.range(6))
        made.wait(60)
    over.set()
    job.join(60)
    assert seen["n"] == 5 and not os.path.exists(folder(seen["df"]))
