"""Queries that run a pipeline: document assembly, search rounds, sources and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.operators import assembly, search
from lixivium.plans import evaluation
from lixivium.session import new_path, table
from lixivium.sources import files
from lixivium.sources.lines import JsonLines, after, look_up, with_line_numbers
from lixivium.streaming import windows


def assemble_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assay_compounds").select("record_id", "SMILES", "CID", "source", "assays")
    return assembly.assemble(rows, 256).where("kind = 'compound'")


def pack_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assay_compounds").select("record_id", "SMILES", "CID", "source", "assays")
    return assembly.assemble(rows, 512).where("kind = 'packed'")


def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search with the stand-in generator; an atom-counting expression scores."""
    score = lambda c: F.round(F.length(F.regexp_replace(c, "[^CcN]", "")) / F.length(c), 4)
    _, log = search.search(spark, score)
    return log


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.manifest(spark, sf_dir, "*.parquet")


def _as_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events' properties as JSON-lines files in the shared folder."""
    path = new_path(spark, "lines")
    table(spark, sf_dir, "events").select("props").write.option("lineSep", "\n").text(path)
    return path


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read by the source with byte offsets, counted with what they hold."""
    spark.dataSource.register(JsonLines)
    rows = spark.read.format("jsonlines").option("path", _as_lines(spark, sf_dir)).option("pathGlobFilter", "*.txt").option("splitBytes", "65536").load()
    return rows.groupBy(F.get_json_object("text", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") < 0).alias("n_bad"))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that resumes by byte offsets, large files in ranges."""
    spark.dataSource.register(JsonLines)
    rows = spark.readStream.format("jsonlines").option("path", _as_lines(spark, sf_dir)).option("pathGlobFilter", "*.txt").option("splitBytes", "65536").option("finished", "true").load()
    out = windows.drained(rows.select(F.get_json_object("text", "$.k").cast("bigint").alias("k")), "lines")
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def resumed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic files read up to stored offsets, then from these on by line number: per file the lines of both parts, those that
    the numbers looked up again give, and those in both parts."""
    spark.dataSource.register(JsonLines)
    path = new_path(spark, "synthetic")
    files.synthetic_lines(spark, 5, 100, path)
    parts = []
    for part in range(5):
        read = spark.read.format("jsonlines").option("path", f"{path}/part={part}").option("pathGlobFilter", "*.txt").load()
        parts.append(read.withColumn("part", F.lit(part).cast("bigint")))
    rows = with_line_numbers(reduce(DataFrame.unionByName, parts))
    offsets = rows.where(F.col("line_number") == 10 * (F.col("part") + 1)).select("file", "position", "line_number")
    stored = files.offset_states(offsets)  # as a checkpoint has them
    rest = after(rows, files.offsets_of(stored))
    begun = rows.join(rest.select("file", "position"), ["file", "position"], "left_anti")
    again = look_up(rows, rest.select("file", "line_number"))
    one = lambda df, kind: df.select("part", F.lit(kind).alias("kind"), "text")
    return one(begun, "read").unionByName(one(rest, "left")).unionByName(one(again, "again")).groupBy("part").pivot("kind", ["read", "left", "again"]).agg(F.countDistinct("text"))


def csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as CSV and read back by schema, counted per first letter."""
    rows = table(spark, sf_dir, "compounds").dropDuplicates(["record_id"]).where(F.coalesce("SMILES", F.lit("")) != "")
    path = new_path(spark, "samples")
    files.write_samples(rows.select(F.concat(F.lit("</s>[START_SMILES]"), "SMILES", F.lit("[END_SMILES]\n")).alias("samples"), F.col("SMILES").alias("smiles"), F.col("QED").alias("qed"), F.lit(0.5).alias("morgan_sim_to_lead")), path)
    back = files.read_samples(spark, path)
    return back.groupBy(F.substring("smiles", 1, 1).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("qed"), 6).alias("mean_qed"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.completed(spark, lambda marker: windows.counts(windows.events(spark, sf_dir, marker=marker)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.completed(spark, lambda marker: windows.sessions(windows.events(spark, sf_dir, marker=marker)), "sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.once(windows.events(spark, sf_dir), "event_id"), "once").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.purchases_after_views(windows.events(spark, sf_dir), windows.events(spark, sf_dir)), "join")


def stream_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.drained(windows.running_best(windows.events(spark, sf_dir)), "best")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("best").alias("best"))


def offset_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file the offsets of a resume table, written as the JSON that a checkpoint stores and read back from the shared folder."""
    rows = table(spark, sf_dir, "raw_lines").dropDuplicates(["line_id"]).groupBy("file").agg(F.max("line_number").alias("line_number"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("position"))
    path = new_path(spark, "offsets")
    files.offset_states(rows).write.parquet(path)
    return files.offsets_of(spark.read.parquet(path))


QUERIES = {f.__name__: f for f in (assemble_docs, pack_incomplete, search_rounds, file_manifest, json_lines, stream_lines, resumed_lines, csv_samples, stream_windows, stream_sessions, stream_once, stream_join, stream_running_best, offset_checkpoint)}

SQL = {
    "json_lines": "select (props ->> '$.k')::bigint as k, count(*) as n, 0::bigint as n_bad from events group by 1",
    "stream_lines": "select (props ->> '$.k')::bigint as k, count(*) as n from events group by 1",
    "resumed_lines": "select range as part, 10 * (range + 1) as read, 100 - 10 * (range + 1) as left, 100 - 10 * (range + 1) as again from range(5)",
    "stream_windows": evaluation.SQL["event_windows"],
    "stream_sessions": """
        with e as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as end, count(*) as n from s group by user_id, k""",
    "csv_samples": "select substr(SMILES, 1, 1) as first, count(*) as n, round(avg(QED), 6) as mean_qed from (select distinct on (record_id) * from compounds order by record_id) where coalesce(SMILES, '') <> '' group by 1",
    "stream_once": "select event_type, count(*) as n from events group by 1",
    "stream_join": "select v.user_id, v.event_id as view_id, p.event_id as purchase_id from events v join events p on v.user_id = p.user_id and p.ts > v.ts and p.ts <= v.ts + interval 1 hour where v.event_type = 'view' and p.event_type = 'purchase'",
    "stream_running_best": "select user_id, count(*) as n, max(value) as best from events group by 1",
    "offset_checkpoint": "select file, max(line_number) as line_number, sum(coalesce(strlen(text), 0) + 1)::bigint as position from (select distinct line_id, file, line_number, text from raw_lines) group by 1",
}
