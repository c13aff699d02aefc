"""The search loop: propose from the pool, generate, parse, drop what is known, score, merge; bounded by a budget.

The model and the scorer are plug-ins: a generator maps prompts to texts batch by batch, an oracle is a column expression
or a vectorised function of the candidates. Each round is one plan; its result is written before the next begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lixivium.det import order_key
from lixivium.functions.tags import last_between
from lixivium.operators import metrics, pool
from lixivium.session import new_path, stage

Generator = Callable[[list[str]], list[str]]


def echo_generator(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: completes each prompt with letters drawn from a hash of it."""
    letters = "CNOSFcn"
    return [p + "".join(letters[b % len(letters)] for b in hashlib.md5(p.encode()).digest()[: 4 + len(p) % 8]) + "[END_SMILES]" for p in prompts]


@dataclass(frozen=True)
class Property:
    """A value that prompts carry beside the score: how an entry's is written, and what is asked of the entry to come."""

    start: str
    end: str
    value: Callable[[Column], Column]  # of an entry's key
    wished: Callable[[Column], Column]


@dataclass
class Oracle:
    """A scorer with a budget: score maps the key of a candidate, or with takes_entry its struct (key, properties), to a number.

    Each candidate is scored once and counts as one call; known ones come from the log. After every so many calls a report of
    the best scores is due, see reports.
    """

    score: Callable[[Column], Column]
    budget: int
    most: float = 1.0  # the highest score possible, or an upper bound
    takes_entry: bool = False
    properties: dict[str, Property] = field(default_factory=dict)
    report_every: int = 100
    log: DataFrame | None = None
    calls: int = 0

    @property
    def finish(self) -> bool:
        return self.calls >= self.budget

    def __len__(self) -> int:
        return self.calls

    def entry(self, key: Column) -> Column:
        """The entry of a candidate: its key and its properties as texts with their tags."""
        props = [F.struct(F.lit(p.start).alias("start"), p.value(key).cast("string").alias("value"), F.lit(p.end).alias("end")) for p in self.properties.values()]
        return F.struct(key.alias("key"), (F.array(*props) if props else F.array().cast("array<struct<start:string,value:string,end:string>>")).alias("properties"))

    def wishes(self, key: Column) -> Column:
        """The properties asked for in a generation prompt."""
        return F.concat(F.lit(""), *[F.concat(F.lit(p.start), p.wished(key).cast("string"), F.lit(p.end)) for p in self.properties.values()])

    def scored(self, candidates: DataFrame) -> DataFrame:
        """candidates (key, ...) with score; what the scorer can't score gets 0."""
        asked = self.entry(F.col("key")) if self.takes_entry else F.col("key")
        return candidates.withColumn("score", F.coalesce(self.score(asked).cast("double"), F.lit(0.0)))

    def reports(self) -> DataFrame:
        """calls, top_1, top_10, top_100 after every report_every calls."""
        if self.log is None:
            raise ValueError("nothing has been scored")
        return metrics.reports(self.log.select("call_idx", "score"), self.report_every)


@dataclass
class Settings:
    pool_size: int = 10
    per_round: int = 50
    prompts_per_round: int = 100
    num_similars: int = 3
    budget: int = 300
    validation_share: float = 0.2
    temperature: tuple[float, float] = (1.0, 1.5)
    most_rounds: int | None = None  # none: only the budget, or idle rounds, end a search
    idle_rounds: int = 10  # rounds in a row without a new candidate after which it ends


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """pos, prompt, output of prompts (pos, prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["output"] = generator(batch["prompt"].tolist())
            yield batch

    return prompts.select("pos", "prompt").mapInPandas(run, "pos bigint, prompt string, output string")


def parse(outputs: DataFrame, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """pos, key: the molecule between the last tags; outputs without both, empty and invalid ones are dropped."""
    rows = outputs.select("pos", last_between(F.col("output"), "[START_SMILES]", "[END_SMILES]").alias("key")).where(F.col("key") != "")
    return rows.where(valid(F.col("key"))) if valid else rows


def round_prompts(spark: SparkSession, current: DataFrame, s: Settings, number: int) -> DataFrame:
    """pos, prompt: each with its own draw of similars from the pool, which has at most pool_size rows."""
    each = spark.range(s.prompts_per_round).withColumnRenamed("id", "pos")
    members = current.agg(F.array_sort(F.collect_list("key")).alias("keys"))  # one row of at most pool_size keys
    drawn = each.join(F.broadcast(members), F.lit(True), "left").select("pos", F.posexplode_outer("keys").alias("i", "key"))
    ranked = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("pos").orderBy(order_key(f"round{number}", F.col("pos"), F.col("key")))))
    few = ranked.where((F.col("rn") <= s.num_similars) & F.col("key").isNotNull())
    text = few.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "key"))), lambda x: F.concat(F.lit("[SIMILAR]"), x["key"], F.lit(" 0.95[/SIMILAR]"))), "").alias("sims"))
    return each.join(text, "pos", "left").select("pos", F.concat(F.lit("</s>"), F.coalesce("sims", F.lit("")), F.lit(f"[ROUND]{number}-"), F.col("pos").cast("string"), F.lit("[/ROUND][START_SMILES]")).alias("prompt"))


@dataclass
class Outcome:
    """pool (key, score, status), log (round, call_idx, key, score) and why the search ended: budget, rounds or idle."""

    pool: DataFrame
    log: DataFrame
    reason: str

    def __iter__(self):
        return iter((self.pool, self.log))


def search(spark: SparkSession, score: Callable[[Column], Column] | Oracle, generator: Generator = echo_generator, settings: Settings | None = None) -> Outcome:
    """Rounds until the oracle's budget is spent; a plain scorer gets the budget of the settings.

    Each round's log is a file of one folder, which is read as one table however many rounds there were.
    """
    s = settings or Settings()
    oracle = score if isinstance(score, Oracle) else Oracle(score, s.budget)
    current = spark.createDataFrame([], "key string, score double, status int")
    schema = "round int, call_idx bigint, key string, score double"
    log, folder = spark.createDataFrame([], schema), new_path(spark, "search-log")
    number = idle = 0
    reason = "budget"
    while not oracle.finish:
        if s.most_rounds is not None and number >= s.most_rounds:
            reason = "rounds"
            break
        if idle >= s.idle_rounds:
            reason = "idle"
            break
        found = parse(generate(round_prompts(spark, current, s, number), generator))
        new = pool.novel(found, log.select("key")).orderBy("pos").limit(min(s.per_round, oracle.budget - oracle.calls))
        ranked = new.withColumn("call_idx", F.row_number().over(Window.orderBy("pos")) + oracle.calls)  # at most per_round rows
        oracle.scored(ranked).select(F.lit(number).alias("round"), F.col("call_idx").cast("bigint").alias("call_idx"), "key", "score").write.mode("append").parquet(folder)
        log = spark.read.schema(schema).parquet(folder)
        batch = log.where(F.col("round") == number)
        n = batch.count()
        current = stage(spark, pool.assign_statuses(pool.merge(current, batch, s.pool_size), s.pool_size, s.validation_share), "search-pool")
        oracle.calls, oracle.log, number = oracle.calls + n, log, number + 1
        idle = 0 if n else idle + 1
    return Outcome(current, log, reason)
