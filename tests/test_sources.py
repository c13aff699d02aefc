"""Sources: byte ranges, resuming streams, CSV round trips, manifests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lixivium.sources import files
from lixivium.sources.lines import JsonLines, after, look_up, with_line_numbers
from lixivium.streaming import windows


def write(path, n, start=0):
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{path.name} - Line {i} é\n" for i in range(start, start + n))


def test_byte_ranges_give_every_line_once(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"test_file_{i}.jsonl", 100)
    spark.dataSource.register(JsonLines)
    for step in (7, 100, 10_000):
        rows = spark.read.format("jsonlines").option("splitBytes", str(step)).load(str(tmp_path)).collect()
        assert len(rows) == 300
        assert len({r["text"] for r in rows}) == 300
        for r in rows[:5]:
            with open(r["file"], "rb") as f:
                f.seek(r["position"])
                assert f.readline().decode().strip() == r["text"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(JsonLines)
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    write(src / "a.jsonl", 50)

    def drain():
        stream = spark.readStream.format("jsonlines").load(str(src))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
        return [r["text"] for r in spark.read.parquet(str(out)).collect()]

    assert len(drain()) == 50
    write(src / "a.jsonl", 20, 50)
    write(src / "b.jsonl", 10)
    with open(src / "b.jsonl", "a") as f:
        f.write("half a line")  # still being written
    rows = drain()
    assert len(rows) == len(set(rows)) == 80


def test_drained_goes_on_from_its_folder(spark, tmp_path):
    """The same folder given again: nothing is read twice, large files come in ranges, a finished file's last line comes without an end."""
    spark.dataSource.register(JsonLines)
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.jsonl", 200)

    def drain(finished):
        stream = spark.readStream.format("jsonlines").option("splitBytes", "100").option("finished", finished).load(str(src))
        return sorted(r["text"] for r in windows.drained(stream, "lines", base=str(tmp_path / "base")).collect())

    assert len(drain("false")) == 200
    write(src / "b.jsonl", 3)
    with open(src / "b.jsonl", "a") as f:
        f.write("the last line")
    assert len(drain("false")) == 203
    rows = drain("true")
    assert len(rows) == len(set(rows)) == 204
    assert "the last line" in rows


def test_a_completed_stream_closes_its_windows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    build = lambda marker: windows.counts(windows.events(spark, sf, marker=marker))
    whole = windows.completed(spark, build, "whole", base=str(tmp_path / "w"))
    assert whole.groupBy().sum("n").first()[0] == n
    assert whole.groupBy("start", "event_type").count().where("count > 1").count() == 0
    open_ = windows.drained(windows.counts(windows.events(spark, sf)), "open", base=str(tmp_path / "o"))
    assert open_.groupBy().sum("n").first()[0] < n


def test_line_numbers_and_offsets(spark, tmp_path):
    write(tmp_path / "a.jsonl", 50)
    write(tmp_path / "b.jsonl", 20)
    spark.dataSource.register(JsonLines)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = with_line_numbers(spark.read.format("jsonlines").option("splitBytes", "64").load(path))
        assert all(r["text"] == f"{r['file'].rsplit('/', 1)[1]} - Line {r['line_number']} é" for r in rows.collect())
        wanted = rows.where("line_number in (3, 19)").select("file", "line_number")
        assert look_up(rows, wanted.unionByName(wanted)).count() == 4
        offsets = rows.where(F.col("file").endswith("a.jsonl") & (F.col("line_number") == 40)).select("file", "position", "line_number")
        assert after(rows, files.offsets_of(files.offset_states(offsets))).count() == 10 + 20


def test_settings_in_yaml():
    text = "a: 1\nb:\n  c: [x, 2]\n  d: 'q # r' # note\ne:\n- 1\n- two\nf: ~\ng: 1e-4\n"
    assert files.parse_yaml(text) == {"a": 1, "b": {"c": ["x", 2], "d": "q # r"}, "e": [1, "two"], "f": None, "g": 1e-4}
    assert files.parse_yaml("# nothing\n") == {}
    for bad in ("- 1\n", "a: 1\n- 2\n", "word\n", "a: 1\n   b: 2\n"):
        with pytest.raises(ValueError, match="key|mapping|item"):
            files.parse_yaml(bad)


def test_upsert_and_run_log(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert files.latest(spark, path) is None
    files.upsert(spark, path, row((1, "a"), (2, "b")), "k")
    assert sorted(map(tuple, files.upsert(spark, path, row((2, "c"), (3, "d")), "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.latest(spark, path) == 1
    for step in (1, 2):
        files.track(spark.createDataFrame([(step, 0.5, None)], "s int, a double, b double"), str(tmp_path / "m"), "r", F.col("s"), "a", "b")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "quoted", text\nwith a line', "C", 0.5, 0.25), ("", "N", None, 1.0)]
    files.write_samples(spark.createDataFrame(rows, files.SAMPLES), str(tmp_path / "s"))
    back = sorted(tuple(r) for r in files.read_samples(spark, str(tmp_path / "s")).collect())
    assert back == sorted(rows)


def test_manifest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = files.manifest(spark, str(tmp_path)).first()
    assert (r["file"], r["size"], r["md5"]) == ("x.bin", 3, hashlib.md5(b"abc").hexdigest())


def test_named_splits_settings_and_lines(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d"))
    assert files.named_splits(spark, str(tmp_path / "d")).first()["split"] == "part"
    (tmp_path / "c.json").write_text('{"a": 2}')
    assert files.settings(str(tmp_path / "c.json"), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    (tmp_path / "c.yaml").write_text("a: 3\n")
    assert files.settings(str(tmp_path / "c.yaml"), {"a": 1}) == {"a": 3}
    assert files.synthetic_lines(spark, 2, 5).count() == 10


def test_late_rows_and_windows(spark):
    out = windows.drained(windows.counts(windows.events(spark, "/root/testdata/sf0.001"), "1 hour", "30 minutes"), "sliding")
    assert out.groupBy().sum("n").first()[0] > 0
