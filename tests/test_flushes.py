"""Flushes of a stream: whole after a failure, once each, in files of so many records."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from lectern.streaming.flushes import flush_every, flushed


@pytest.mark.parametrize("when", ["before", "after"])
def test_rows_are_once_after_a_failure(spark, tmp_path, when):
    """The second batch fails before or after its files are complete; a restart goes on from there."""
    for i in range(4):
        spark.range(100 * i, 100 * i + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def stream():
        return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    writer = flush_every(stream(), out, mark, 30)
    whole = []

    def failing(batch, number):
        if number == 1 and when == "before":
            batch.limit(10).write.mode("overwrite").parquet(f"{out}/batch={number}")
            raise RuntimeError("lost")
        batch.write.mode("overwrite").option("maxRecordsPerFile", 30).parquet(f"{out}/batch={number}")
        whole.append(number)
        if number == 1:
            raise RuntimeError("lost")

    broken = writer.foreachBatch(failing).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        broken.awaitTermination()
    assert whole == ([0] if when == "before" else [0, 1])
    again = flush_every(stream(), out, mark, 30).trigger(availableNow=True).start()
    again.awaitTermination()
    got = flushed(spark, out)
    assert sorted(r.id for r in got.collect()) == list(range(400)) and got.select("batch").distinct().count() == 4
    assert all(pq.read_metadata(f).num_rows <= 30 for f in glob.glob(f"{out}/*/*.parquet"))
    more = flush_every(stream(), out, mark, 30).trigger(availableNow=True).start()
    more.awaitTermination()
    assert flushed(spark, out).count() == 400
