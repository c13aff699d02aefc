"""Plain sources and sinks: text and CSV with a given schema, manifests of checksums, settings, synthetic lines."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.operators.grid import overlay, tag_pairs
from lixivium.sources.lines import open_file

# Fixed value: the columns of a file of accepted samples.
SAMPLES = "samples string, smiles string, qed double, morgan_sim_to_lead double"
_NULL = "\\N"  # empty texts stay empty, nulls stay null


def text_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, text: every line of the files, stripped; a directory's files by name pattern."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text"))


PIECE = 8 << 20  # bytes of a file that are held at once


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, size, md5 of every regular file below a directory; files of any size, read in pieces through Arrow's file systems."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")  # no content

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["md5"] = [_digest(p) for p in batch["path"]]
            yield batch

    parts = max(1, spark.sparkContext.defaultParallelism)
    summed = listed.repartition(parts, "path").mapInPandas(digests, "path string, length bigint, md5 string")
    return summed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), "md5")


def _digest(path: str) -> str:
    found = hashlib.md5()
    with open_file(path) as f:
        while piece := f.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def write_samples(df: DataFrame, path: str) -> None:
    """Accepted samples as CSV with a header; texts are quoted and escaped so that any comes back."""
    df.select("samples", "smiles", "qed", "morgan_sim_to_lead").write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", _NULL).csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The same back, by its schema; multi-line texts are allowed."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", _NULL).schema(SAMPLES).csv(path)


def named_splits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All split files of a directory in one table; the split is the file's name up to its first dot or hyphen."""
    rows = spark.read.format(fmt).load(path)
    return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1))


def settings(path: str, defaults: dict | None = None) -> dict:
    """A file of settings, YAML or JSON by its name, laid over defaults entry by entry; the path may name any store Arrow knows."""
    with open_file(path) as f:
        text = f.read().decode()
    return {**(defaults or {}), **(json.loads(text) if path.endswith(".json") else parse_yaml(text))}


def parse_yaml(text: str) -> dict:
    """The YAML of settings: nested mappings by indentation, lists as - items or in brackets, plain and quoted scalars, comments."""
    lines = []
    for raw in text.splitlines():
        body = _COMMENT.sub("", raw).rstrip()
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip(" ")), body.strip()))
    value, at = _block(lines, 0, lines[0][0] if lines else 0)
    if at < len(lines) or not isinstance(value, dict | type(None)):
        raise ValueError("settings must be one mapping")
    return value or {}


_COMMENT = re.compile(r"(?:^|\s)#(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$).*$")


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The mapping or list of the lines from at on that are indented like the first."""
    out: dict | list | None = None
    while at < len(lines) and lines[at][0] == indent:
        body = lines[at][1]
        if body.startswith("- ") or body == "-":
            out = [] if out is None else out
            if not isinstance(out, list):
                raise ValueError(f"a list item among keys: {body}")
            out.append(scalar(body[1:].strip()))
            at += 1
            continue
        if isinstance(out, list):
            break
        key, colon, rest = body.partition(":")
        if not colon:
            raise ValueError(f"no key: {body}")
        out = {} if out is None else out
        at += 1
        if rest.strip():
            out[str(scalar(key))] = scalar(rest.strip())
        elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
            out[str(scalar(key))], at = _block(lines, at, lines[at][0])
        else:
            out[str(scalar(key))] = None
    return out, at


def scalar(text: str) -> object:
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def token_map(spark: SparkSession, path: str, field: str = "additional_special_tokens") -> DataFrame:
    """start_tag, end_tag from a JSON file whose field lists all start tags, then all end tags; the molecule's pair is added."""
    tokens = spark.read.option("multiLine", True).schema(f"`{field}` array<string>").json(path)
    both = overlay(tag_pairs(F.col(field)), F.create_map(F.lit("[START_SMILES]"), F.lit("[END_SMILES]")))
    return tokens.select(F.explode(both).alias("start_tag", "end_tag"))


def offset_states(offsets: DataFrame) -> DataFrame:
    """file, state: position and line_number of each file as the JSON object that a checkpoint stores."""
    return offsets.select("file", F.to_json(F.struct("position", "line_number")).alias("state"))


def offsets_of(states: DataFrame) -> DataFrame:
    """file, position, line_number back from stored states; a state that can't be read starts its file anew."""
    s = F.from_json("state", "position bigint, line_number bigint")
    return states.select("file", s.alias("s")).select("file", F.coalesce("s.position", F.lit(0)).cast("bigint").alias("position"), F.coalesce("s.line_number", F.lit(0)).cast("bigint").alias("line_number"))


def append_run_log(df: DataFrame, path: str) -> None:
    """Appends rows to a history table: one directory, any number of runs."""
    df.write.mode("append").parquet(path)


METRICS = "run string, step bigint, metric string, value double"


def track(df: DataFrame, path: str, run: str, step: Column, *metrics: str) -> None:
    """Appends the named columns of df as rows (run, step, metric, value) to a metrics table; nulls are left out."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(F.lit(run).alias("run"), step.cast("bigint").alias("step"), F.inline(values)).where(F.col("value").isNotNull())
    append_run_log(rows.select(*[c.split()[0] for c in METRICS.split(", ")]), path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, *keys: str) -> DataFrame:
    """The keyed table at path with rows put in, those of known keys in place of the old; each state is a folder of its own.

    Returns the new state. rows must have one row a key. A reader of an older state is not disturbed.
    """
    number = latest(spark, path)
    if number is not None:
        old = spark.read.parquet(f"{path}/v={number}")
        rows = old.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
    new = f"{path}/v={0 if number is None else number + 1}"
    rows.write.parquet(new)
    return spark.read.parquet(new)


def latest(spark: SparkSession, path: str) -> int | None:
    """The number of the last state written whole below path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    names = [s.getPath() for s in store.listStatus(at)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def synthetic_lines(spark: SparkSession, files: int, lines: int, path: str | None = None) -> DataFrame:
    """part, number, text: reproducible hashed lines for tests of readers; with a path they are written below it, a folder a part."""
    rows = spark.range(files * lines).select(F.expr(f"id div {lines}").alias("part"), F.expr(f"id % {lines}").alias("number"))
    made = rows.select("part", "number", F.sha2(F.concat_ws("/", F.lit("line"), "part", "number"), 256).alias("text"))
    if path is not None:
        made.repartition("part").sortWithinPartitions("part", "number").select("part", "text").write.partitionBy("part").option("lineSep", "\n").text(path)
    return made
