"""Growing log files: every whole line once, wherever micro-batches and byte ranges cut."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.sources import follow
from palisade.sources.follow import follow_lines_at, read_lines_at
from palisade.sources.lines import read_log_lines
from palisade.sources.normalize import parse_lines, valid_events
from palisade.sources.store import read_store
from palisade.streaming import ingest

LINE = "Oct  2 06:30:{:02d} quay sshd[9]: Failed password for invalid user bo from 172.20.1.{} port 9 ssh2"


class Follower:
    def __init__(self, spark, folder, target, **options):
        self.spark, self.folder, self.target, self.options = spark, str(folder), str(target), options
        self.seen = 0

    def new(self):
        """Lines of the micro-batches since the last call; the query starts again from its checkpoint each time."""
        lines = follow_lines_at(self.spark, self.folder, **self.options)
        writer = lines.writeStream.format("parquet").option("path", f"{self.target}/out").option("checkpointLocation", f"{self.target}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        rows = self.spark.read.schema(lines.schema).parquet(f"{self.target}/out").collect()
        found = sorted((r.source_uri.rsplit("/", 1)[1], int(r.position), r.raw) for r in rows)
        fresh = found[:]
        for old in getattr(self, "all", []):
            fresh.remove(old)
        self.all = found
        return fresh


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def test_append_restart_and_shrink(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log, other = tmp_path / "logs" / "a.log", tmp_path / "logs" / "b.log"
    append(log, "one\ntwo\n")
    f = Follower(spark, tmp_path / "logs", tmp_path / "t")
    assert f.new() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert f.new() == []
    append(log, "thr")
    append(other, "\n  \nalone\r\nunfinished")
    assert f.new() == [("b.log", 4, "alone")]
    append(log, "ee\nfour")
    assert f.new() == [("a.log", 8, "three")]
    append(log, "\n")
    append(other, " line\n")
    assert f.new() == [("a.log", 14, "four"), ("b.log", 11, "unfinished line")]
    # Shorter than before: another file.
    log.write_bytes(b"new\n")
    assert f.new() == [("a.log", 0, "new")]
    append(log, "next\n")
    assert f.new() == [("a.log", 4, "next")]
    # As long as before or longer, but it begins otherwise.
    log.write_bytes(b"rotated away\nand longer\n")
    assert f.new() == [("a.log", 0, "rotated away"), ("a.log", 13, "and longer")]
    log.write_bytes(b"")
    assert f.new() == []
    append(log, "again\n")
    other.unlink()
    assert f.new() == [("a.log", 0, "again")]


def test_from_end_and_pattern(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name in ("a.log", "a.gz", ".hidden.log"):
        append(tmp_path / "logs" / name, "old\n")
    f = Follower(spark, tmp_path / "logs", tmp_path / "t", pattern="*.log", from_end=True)
    assert f.new() == []
    append(tmp_path / "logs" / "a.log", "fresh\n")
    append(tmp_path / "logs" / "a.gz", "no log\n")
    assert f.new() == [("a.log", 4, "fresh")]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_lines_do_not_depend_on_the_ranges(spark, tmp_path, monkeypatch, size):
    r = random.Random(3)
    texts = ["".join(r.choice("ab é\n\n") for _ in range(r.randrange(0, 300))) for _ in range(3)] + ["", "\n", "no end", "x" * 90 + "\ny"]
    want, seqs = [], []
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.log").write_bytes(text.encode())
        at = 0
        for line in text.encode().split(b"\n"):
            if line.strip():
                want.append((f"{i}.log", at, line.decode().strip()))
            at += len(line) + 1
    monkeypatch.setattr(follow, "BLOCK", max(size, 3))
    rows = read_lines_at(spark, str(tmp_path), range_bytes=size).orderBy("seq").collect()
    assert [(x.source_uri.rsplit("/", 1)[1], int(x.position), x.raw) for x in rows] == want
    assert len({x.seq for x in rows}) == len(rows)


def test_empty_folder_and_single_file(spark, tmp_path):
    assert read_lines_at(spark, str(tmp_path)).collect() == []
    (tmp_path / "x.log").write_text("a\nb")
    assert [r.raw for r in read_lines_at(spark, str(tmp_path / "x.log")).orderBy("seq").collect()] == ["a", "b"]


def test_no_shuffle_and_the_lines_of_the_text_source(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.log").write_text("\n".join(LINE.format(k, k % 3) for k in range(40)) + "\n")
    lines = read_lines_at(spark, str(tmp_path), range_bytes=100)
    assert "Exchange" not in valid_events(parse_lines(lines, reference_year=2026))._jdf.queryExecution().toString()
    plain = read_log_lines(spark, str(tmp_path), number_copies=False)
    assert sorted(r.raw for r in lines.select("raw").collect()) == sorted(r.raw for r in plain.select("raw").collect())


def test_growing_files_into_the_store(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for turn in range(3):
        for name in ("a.log", "b.log"):
            append(tmp_path / "logs" / name, LINE.format(turn, 1) + "\n" + LINE.format(turn, 1) + "\n{bad json\n")
        lines = follow_lines_at(spark, str(tmp_path / "logs"))
        ingest.ingest_lines(lines, str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / "checkpoint"), reference_year=2026).awaitTermination()
    stored = read_store(spark, str(tmp_path / "store"))
    batch = valid_events(parse_lines(read_lines_at(spark, str(tmp_path / "logs")), reference_year=2026))
    assert stored.count() == 12 and {r.id for r in stored.select("id").collect()} == {r.id for r in batch.select("id").collect()}
    # Arrival order: by micro-batch, then by file and place.
    order = [r.timestamp.second for r in stored.orderBy("seq").select("timestamp").collect()]
    assert order == sorted(order)
    assert spark.read.parquet(str(tmp_path / "bad")).agg(F.count("*")).first()[0] == 6
