"""Text tables and dumps."""

import os

from pyspark.sql import functions as F

from tidemark.operators import tokens
from tidemark.sinks import dumps
from tidemark.streaming import keyed


def lines_of(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


# fixed value: a dump of token totals
TOKENS = """\
family     input  output  note
------  --------  ------  ----
Opus    12345678      90  漢字
Haiku          7       -  a b
Other          0       1"""


def test_table(spark, tmp_path):
    rows = spark.createDataFrame([("Haiku", 7, None, "a\nb"), ("Opus", 12345678, 90, "漢字"), ("Other", 0, 1, "")], "family string, input long, output long, note string")
    made = dumps.table_lines(rows, [F.desc("input")])
    assert [r.value for r in made.orderBy("place").collect()] == TOKENS.splitlines()
    spark.dataSource.register(dumps.DumpSink)
    made.write.format("dump").mode("append").save(str(tmp_path / "out"))
    (folder,) = os.listdir(tmp_path / "out")
    assert lines_of(tmp_path / "out" / folder) == TOKENS.splitlines()
    assert [r.value for r in dumps.table_lines(rows.limit(0), ["family"], ["family", "input"]).orderBy("place").collect()] == ["family  input", "------  -----"]


def test_table_of_many_partitions_is_in_order(spark, tmp_path):
    spark.dataSource.register(dumps.DumpSink)
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("n")).repartition(9)
    dumps.table_lines(rows, ["n"]).write.format("dump").mode("append").save(str(tmp_path / "out"))
    (folder,) = os.listdir(tmp_path / "out")
    assert [int(x) for x in lines_of(tmp_path / "out" / folder)[2:]] == list(range(2000))


class Task:
    def __init__(self, part):
        self.part = part

    def partitionId(self):
        return self.part


def test_a_batch_done_twice_is_written_once(tmp_path, monkeypatch):
    import pyspark

    def attempt(tasks):
        writer = dumps.DumpStreamWriter({"path": str(tmp_path)})
        out = []
        for part, lines in tasks:
            monkeypatch.setattr(pyspark.TaskContext, "get", lambda part=part: Task(part))
            out.append(writer.write(iter([(x,) for x in lines])))
        return writer, out

    writer, (b, lost, a) = attempt([(1, ["c"]), (0, ["x", "y"]), (0, ["a", None])])
    writer.commit([b, a, None], 3)  # the first attempt at part 0 was lost
    assert lines_of(tmp_path / "batch-00000003") == ["a", "", "c"]
    again, messages = attempt([(0, ["other"])])
    again.commit(messages, 3)
    assert lines_of(tmp_path / "batch-00000003") == ["a", "", "c"]
    failed, messages = attempt([(0, ["z"])])
    failed.abort(messages, 4)
    empty, messages = attempt([(0, [])])
    empty.commit(messages, 5)
    assert sorted(os.listdir(tmp_path)) == ["batch-00000003", "batch-00000005"] and not lines_of(tmp_path / "batch-00000005")


def test_stream_to_a_dump(spark, tmp_path):
    """A restart that repeats a batch (its commit went) adds nothing."""
    spark.dataSource.register(dumps.DumpSink)
    source = tmp_path / "in"
    spark.createDataFrame([(f"line {k}",) for k in range(5)], "value string").coalesce(1).write.text(str(source))

    def run():
        stream = spark.readStream.text(str(source))
        stream.writeStream.format("dump").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    run()
    os.remove(tmp_path / "ck" / "commits" / "0")
    crc = tmp_path / "ck" / "commits" / ".0.crc"
    if crc.exists():
        os.remove(crc)
    run()
    assert [f for f in os.listdir(tmp_path / "out")] == ["batch-00000000"]
    assert lines_of(tmp_path / "out" / "batch-00000000") == [f"line {k}" for k in range(5)]
    assert tokens.FIELDS and keyed.LEAST_MS == 250
