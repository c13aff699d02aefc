"""Queries of evaluation: rankings, areas, errors, perplexities, streaks, rollups, schedules, grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.functions import arrays
from lixivium.operators import grid, metrics
from lixivium.session import table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("call_idx"), F.col("value").alias("score"))


def topn_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topn_means(_log(spark, sf_dir), 5000)


def top_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four settings: a full log, one cut short, one that finished early, one of a single checkpoint."""
    log, out = _log(spark, sf_dir), None
    for name, n, freq, most, finish in (("full", 10, 1000, 10000, False), ("cut", 1, 700, 5000, False), ("finished", 10, 1000, 12345678, True), ("coarse", 100, 20000, 30000, False)):
        row = metrics.top_auc(log, n, freq, most, finish).select(F.lit(name).alias("setting"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    guess = F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * 1500)
    return metrics.regression(rows, F.col("l_extendedprice"), guess, "l_returnflag")


def numeric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of values parsed from text against those stored: CLOGP in related documents' tags against the compound's."""
    from lixivium.functions.tags import first_between

    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("[CLOGP]")).select("doc_id", "cid", first_between(F.col("text"), "[CLOGP]", "[/CLOGP]").try_cast("double").alias("guess"))
    truth = table(spark, sf_dir, "compounds").where(F.col("CID") > 0).groupBy("CID").agg(F.max("CLOGP").alias("truth"))
    # one cid may have a tenth of the documents: they are dealt to salts, and so is the one truth of each asked cid
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    asked = salted.select("cid", "salt").distinct().join(truth.withColumnRenamed("CID", "cid"), "cid")
    return metrics.regression(salted.join(asked, ["cid", "salt"], "left"), F.col("truth"), F.col("guess"))


def property_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") / 100).alias("loss"))
    return metrics.perplexities(rows, "user_id", "event_type", "loss")


def tag_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    return metrics.pair_tags(rows, "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


def loss_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
    return metrics.loss_plateau(log, 1000, 20, 0.1, 256).select("step", F.round("far", 6).alias("far"), F.round("near", 6).alias("near"), "doubled", "accumulation")


def patience_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("run", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM")))
    return metrics.patience_streaks(rows, "run", "event_id", "value", 0.5)


def tolerance_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tolerance_levels(table(spark, sf_dir, "events").select(F.col("event_id").alias("call_idx"), F.col("value").alias("score")), 200)


def step_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the last event and words so far, per day, summed up. The steps of a day are those between its first and last
    event, whatever lies between: a day's events are reduced where they lie, none is ordered."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), us.alias("us")).groupBy("day").agg(F.count("us").alias("n"), (F.max("us") - F.min("us")).alias("span"))
    steps = F.nullif(F.col("n") - 1, F.lit(0))
    return days.select("day", (F.col("n") - 1).alias("n_steps"), F.round(F.col("span") / steps / 1e6, 6).alias("mean_seconds"), (F.col("n") * 2048).alias("words"), F.round(F.lit(2048.0) * steps / (F.nullif(F.col("span"), F.lit(0)) / 1e6), 6).alias("words_per_second"))


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_state(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


def tensor_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 2").alias("pair"), "embedding")
    two = rows.groupBy("pair").agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b")).where("a is not null and b is not null")
    return two.select("pair", *[c.alias(n) for n, c in metrics.array_difference(F.col("a"), F.col("b")).items()])


def flop_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts per region, nation and in all: the shape of counts per module and ancestor."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().cast("bigint").alias("level"))


def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


_SHAPES = "values (0, array(64L, 32L), array(32L, 16L)), (1, array(8L, 64L, 32L), array(32L, 128L)), (2, array(1L, 7L), array(7L, 1L))"
_CONVS = "values (0, array(2L, 3L, 32L, 32L), array(8L, 3L, 3L, 3L), array(2L, 8L, 30L, 30L), false), (1, array(2L, 8L, 15L, 15L), array(8L, 3L, 2L, 2L), array(2L, 3L, 30L, 30L), true)"


def flop_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplications of matrix products and convolutions by their shapes."""
    a = spark.sql(f"select * from {_SHAPES} as t(i, a, b)").select(F.lit("matmul").alias("op"), "i", arrays.matmul_ops(F.col("a"), F.col("b")).alias("ops"))
    b = spark.sql(f"select * from {_CONVS} as t(i, x, w, o, t)").select(F.lit("conv").alias("op"), "i", arrays.conv_ops(F.col("x"), F.col("w"), F.col("o"), F.col("t")).alias("ops"))
    return a.unionByName(b)


def peak_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak operations of a set of devices, looked up by name; unknown names count 0."""
    peaks = spark.createDataFrame([("A6000", 40.0), ("A100", 312.0)], "device string, tera double")
    have = table(spark, sf_dir, "events").select(F.element_at(F.array(F.lit("A6000"), F.lit("A100"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int")).alias("device"))
    return have.join(F.broadcast(peaks), "device", "left").groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("tera", F.lit(0.0))).alias("tera"))


def score_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scores: suppression of seen tokens, and the length-dependent penalty."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"), F.array((F.col("vec_id") % 64).cast("int"), F.lit(3)).alias("seen"), (F.col("vec_id") % 40).alias("n"))
    suppressed = arrays.suppress_seen(F.col("s"), F.col("seen"), [3, 5, 7])
    decayed = arrays.decay_penalty(F.col("s"), F.col("n"), 2, 1.02, 10)
    return rows.select("vec_id", F.size(F.filter(suppressed, lambda x: x == float("-inf"))).cast("bigint").alias("n_suppressed"), F.round(decayed[2], 6).alias("decayed"))


_AXES = [
    grid.Axis("", "seed", [11, 12, 13, 14]),
    grid.Axis("pool", "kept", [20, 40, 80, 160]),
    grid.Axis("pool", "held_out", [0.1, 0.25]),
    grid.Axis("prompt", "neighbours", [1, 4, 8]),
    grid.Axis("prompt", "examples", [0, 2]),
    grid.Axis("sampling", "ramp", ["0.7-1.1", "0.9-1.3", "1.0-2.0"]),
    grid.Axis("fit", "rate", ["2e-4", "5e-5"]),
    grid.Axis("fit", "passes", [2, 4, 6]),
]


def hparam_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the axes, one column each."""
    return grid.product(spark, _AXES)


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same combinations as the settings of runs: a JSON object per group of axes, counted per object."""
    rows = grid.product(spark, _AXES)
    each = F.array(*[F.struct(F.lit(g).alias("part"), F.to_json(c).alias("settings")) for g, c in grid.by_group(_AXES).items()])
    return rows.select(F.inline(each)).groupBy("part", "settings").agg(F.count(F.lit(1)).alias("n_runs"))


_DEFAULTS = {"pool_size": "10", "num_mols": "0", "eos": "</s>", "resume": "false", "profile": "true"}


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(*[F.lit(x) for kv in _DEFAULTS.items() for x in kv])
    rows = spark.sql("select * from values (1, map('pool_size', '30')), (2, map('eos', '<eos>', 'num_mols', '5')), (3, cast(map() as map<string,string>)) as t(run, changes)")
    merged = grid.overlay(base, F.col("changes"))
    return rows.select("run", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"), F.array_join(grid.arguments(merged), " ").alias("arguments"))


def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(*[F.lit(x) for x in ("[A]", "[B]", "[C]", "[/A]", "[/B]", "[/C]")])
    both = grid.overlay(grid.tag_pairs(tokens), F.create_map(F.lit("[START_SMILES]"), F.lit("[END_SMILES]")))
    return spark.range(1).select(F.explode(both).alias("start_tag", "end_tag"))


def resume_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file how many lines are read and the line to resume at: the one after the last read."""
    rows = table(spark, sf_dir, "raw_lines").dropDuplicates(["line_id"])
    return rows.groupBy("file").agg(F.count_if("is_read").alias("n_read"), F.count_if(~F.coalesce("is_read", F.lit(False))).alias("n_unread"), F.coalesce(F.max(F.when(F.col("is_read"), F.col("line_number"))) + 1, F.lit(0)).alias("resume_line"))


def temperature_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(50).select(F.col("id").alias("iteration"), F.round(grid.temperature(F.col("id"), 200, 10000, 1.0, 1.5), 9).alias("temperature"))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 1201, 10).select(F.col("id").alias("step"), F.round(grid.learning_rate(F.col("id"), 1e-4, 100, 1000), 12).alias("rate"))


def run_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id % 7 <> 3").select(F.concat(F.lit("default-"), (F.col("event_id") % 7).cast("string")).alias("name"), "event_type")
    return rows.groupBy("event_type").agg(grid.next_version(F.col("name"), "default").cast("bigint").alias("next_version"))


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names from paths: the parent's first six characters and the last part."""
    path = F.concat(F.lit("/runs/"), F.col("file"), F.lit("/checkpoint-"), F.max("line_number").cast("string"))
    rows = table(spark, sf_dir, "raw_lines").groupBy("file").agg(path.alias("path"))
    parts = F.split("path", "/")
    return rows.select("path", F.concat_ws("-", F.substring(F.element_at(parts, -2), 1, 6), F.element_at(parts, -1)).alias("short_name"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user that end after six quiet hours."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def rank_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest parts of each brand by every ranking function; quartiles follow from the brand's count and the rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    v = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc())
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    counts = parts.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    salted = Window.partitionBy("p_brand", F.pmod(F.xxhash64("p_partkey"), F.lit(64))).orderBy(F.col("p_retailprice").desc(), "p_partkey")
    few = parts.withColumn("_rn", F.row_number().over(salted)).where("_rn <= 10").drop("_rn")  # of each salt of a brand; ranks above ten don't change
    ranked = few.select("p_brand", "p_partkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rank"), F.dense_rank().over(v).alias("dense")).where("rn <= 10")
    small, more = F.expr("n div 4"), F.col("n") % 4  # the first quartiles have one part more
    quartile = F.when(F.col("rn") <= more * (small + 1), F.expr("(rn - 1) div (n div 4 + 1)")).otherwise(more + F.floor((F.col("rn") - 1 - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return ranked.join(counts, "p_brand").select("p_brand", "p_partkey", "rn", "rank", "dense", quartile.cast("int").alias("quartile"))


def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys ordered in each quarter only: unions, intersections and differences of sets."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    a, r = (items.where(F.col("l_returnflag") == x).select("l_partkey").distinct() for x in "AR")
    sizes = [("both", a.intersect(r)), ("either", a.union(r).distinct()), ("only_a", a.subtract(r))]
    out = None
    for name, df in sizes:
        row = df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (topn_means, top_auc, regression_metrics, numeric_answers, property_perplexity, tag_pairing, loss_plateau, patience_streak, tolerance_level, step_throughput, model_selection, tensor_diff_stats, flop_rollup, segment_cube, flop_formulas, peak_flops, score_penalties, hparam_grid, run_settings, config_overlay, tag_pairs, resume_progress, temperature_schedule, lr_schedule, run_version, path_names, event_windows, event_sessions, rank_functions, split_sets)}

_L = "l as (select event_id + 1 as c, value as s from events)"


def _auc_sql(name: str, n: int, freq: int, most: int, finish: bool) -> str:
    return f"""(with {_L}, z as (select count(*) as n from l), p as (select unnest(range({freq}, least(n, {most}), {freq})) as k from z union all select null),
        j as (select k, s, row_number() over (partition by k order by s desc) as rn from p join l on k is null or c <= k), m as (select k, avg(s) as m from j where rn <= {n} group by 1),
        q as (select k, m, coalesce(lag(m) over (order by k nulls last), 0) as prev, coalesce(lag(k) over (order by k nulls last), 0) as called from m)
        select '{name}' as setting, round(sum(case when k is null then (n - called) * (m + prev) / 2 + case when {finish} and n < {most} then ({most} - n) * m else 0 end else {freq} * (m + prev) / 2 end) / {most}, 6) as auc from q, z)"""


SQL = {
    "topn_means": f"with {_L}, r as (select s, row_number() over (order by s desc) as rn from l where c > (select max(c) from l) - 5000) select round(avg(s) filter (rn <= 1), 6) as top_1, round(avg(s) filter (rn <= 10), 6) as top_10, round(avg(s) filter (rn <= 100), 6) as top_100 from r",
    "top_auc": " union all ".join("select * from " + _auc_sql(*x) for x in (("full", 10, 1000, 10000, False), ("cut", 1, 700, 5000, False), ("finished", 10, 1000, 12345678, True), ("coarse", 100, 20000, 30000, False))),
    "regression_metrics": "with r as (select l_returnflag, l_extendedprice as t, case when l_linenumber < 7 then l_quantity * 1500 end as g from lineitem) select l_returnflag, count(g) as n_valid, count(*) - count(g) as n_invalid, round(sqrt(avg(power(t - g, 2))), 6) as rmse, round(avg(abs(t - g)), 6) as mae, round(corr(t, g), 6) as pearson from r group by 1",
    "numeric_answers": """
        with a as (select cid, substr(text, position('[CLOGP]' in text) + 7) as t from documents where contains(text, '[CLOGP]')),
        g as (select cid, case when contains(t, '[/CLOGP]') then try_cast(substr(t, 1, position('[/CLOGP]' in t) - 1) as double) end as g from a),
        c as (select CID as k, max(CLOGP) as t from compounds where CID > 0 group by 1), r as (select case when g is not null then t end as t, case when t is not null then g end as g from g left join c on cid = k)
        select count(g) as n_valid, count(*) - count(g) as n_invalid, round(sqrt(avg(power(t - g, 2))), 6) as rmse, round(avg(abs(t - g)), 6) as mae, round(corr(t, g), 6) as pearson from r""",
    "property_perplexity": """
        with e as (select user_id, event_type, sum(value / 100) as s, count(*) as k from events group by 1, 2), w as (select user_id, sum(s) as s, sum(k) as k from e group by 1)
        select event_type as property, round(sum(power(2, s / k / ln(2))) / greatest(count(*), 1), 6) as perplexity, count(*) as n from e group by 1
        union all select 'perplexity', round(sum(power(2, s / k / ln(2))) / greatest(count(*), 1), 6), count(*) from w""",
    "tag_pairing": "select user_id, s.event_id as start_pos, (select min(e.event_id) from events e where e.user_id = s.user_id and e.event_type = 'purchase' and e.event_id > s.event_id) as end_pos from events s where event_type = 'view' and exists (select 1 from events e where e.user_id = s.user_id and e.event_type = 'purchase' and e.event_id > s.event_id)",
    "loss_plateau": """
        with l as (select event_id + 1 as step, value as loss from events),
        f as (select step, sum(loss) over (order by step rows between 399 preceding and 380 preceding) / 20 as far, sum(loss) over (order by step rows between 19 preceding and current row) / 20 as near from l),
        k as (select step, far, near, coalesce(far - near < far * 0.1, false) as doubled from f where step % 1000 = 0)
        select step, round(far, 6) as far, round(near, 6) as near, doubled, least(256, power(2, sum(doubled::int) over (order by step)))::bigint as accumulation from k""",
    "patience_streak": """
        with r as (select concat_ws('-', user_id, strftime(ts, '%Y-%m')) as run, list({'b': value, 's': 0::bigint} order by event_id) as xs from events group by 1),
        f as (select run, list_reduce(xs, lambda a, x: case when x.b >= a.b - 0.5::double then {'b': a.b, 's': a.s + 1} else {'b': x.b, 's': 0::bigint} end, {'b': 'infinity'::double, 's': 0::bigint}) as f from r)
        select run, f.s as streak, f.b as best from f""",
    "tolerance_level": """
        with i as (select event_id // 200 as iteration, max(value) as best from events group by 1),
        p as (select *, coalesce(best > max(best) over (order by iteration rows between unbounded preceding and 1 preceding), true) as improved, max(best) over (order by iteration) as running_best from i),
        g as (select *, sum(improved::int) over (order by iteration) as island from p)
        select iteration, best, running_best, improved, row_number() over (partition by island order by iteration) - 1 as tolerance from g""",
    "step_throughput": """
        with e as (select strftime(ts, '%Y-%m-%d') as day, epoch_us(ts) - lag(epoch_us(ts)) over (partition by strftime(ts, '%Y-%m-%d') order by ts) as us from events)
        select day, count(us) as n_steps, round(avg(us) / 1e6, 6) as mean_seconds, count(*) * 2048 as words, round(case when count(us) > 0 then 2048.0::double * count(us) / (sum(us) / 1e6) end, 6) as words_per_second from e group by 1""",
    "model_selection": "with r as (select user_id, value, event_id, row_number() over (partition by user_id order by value, event_id desc) as rn from events) select user_id, value as best_loss, event_id as best_pos from r where rn = 1",
    "tensor_diff_stats": """
        with p as (select a.vec_id // 2 as pair, list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double)) as d from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
        select pair, round(list_min(d), 6) as least, round(list_max(d), 6) as most, round(list_avg(d), 6) as mean, round(list_median(d), 6) as median, len(list_filter(d, lambda x: x > 0)) as n_differ from p""",
    "flop_rollup": "select r_name, n_name, count(*) as n_customers, round(sum(c_acctbal), 2) as balance, grouping(r_name, n_name)::bigint as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "segment_cube": "select c_mktsegment, c_nationkey, count(*) as n_customers, round(avg(c_acctbal), 4) as mean_balance from customer group by cube (c_mktsegment, c_nationkey)",
    "flop_formulas": """
        select 'matmul' as op, i, list_product(a)::bigint * b[-1] as ops from (values (0, [64, 32], [32, 16]), (1, [8, 64, 32], [32, 128]), (2, [1, 7], [7, 1])) t(i, a, b)
        union all select 'conv', i, x[1] * list_product(w)::bigint * list_product(case when t then x[3:] else o[3:] end)::bigint from (values (0, [2, 3, 32, 32], [8, 3, 3, 3], [2, 8, 30, 30], false), (1, [2, 8, 15, 15], [8, 3, 2, 2], [2, 3, 30, 30], true)) t(i, x, w, o, t)""",
    "peak_flops": "with h as (select ['A6000', 'A100', 'unknown'][event_id % 3 + 1] as device from events) select device, count(*) as n, count(*) * case device when 'A6000' then 40.0::double when 'A100' then 312.0::double else 0.0::double end as tera from h group by 1",
    "score_penalties": "select vec_id, (1 + (vec_id % 64 in (5, 7))::int)::bigint as n_suppressed, round(embedding[3]::double + case when vec_id % 40 > 10 then abs(embedding[3]::double) * (power(1.02::double, vec_id % 40 - 10) - 1) else 0 end, 6) as decayed from embeddings",
    "hparam_grid": "select * from " + ", ".join(f"(select unnest([{', '.join(repr(str(v)) for v in a.values)}]) as \"{a.column}\")" for a in _AXES),
    "run_settings": " union all ".join(
        f"select '{g}' as part, concat('{{', {' , '.join(chr(39) + (',' if i else '') + chr(34) + a.name + chr(34) + ':' + chr(34) + chr(39) + ', ' + a.column + ', ' + chr(39) + chr(34) + chr(39) for i, a in enumerate(own))}, '}}') as settings, {math.prod(len(a.values) for a in _AXES) // math.prod(len(a.values) for a in own)}::bigint as n_runs from (select 1) "
        + " ".join(f", (select unnest([{', '.join(repr(str(v)) for v in a.values)}]) as {a.column})" for a in own)
        for g, own in ((g, [a for a in _AXES if (a.group or "run") == g]) for g in dict.fromkeys(a.group or "run" for a in _AXES))
    ),
    "config_overlay": """select * from (values
        (1, 'eos=</s>,num_mols=0,pool_size=30,profile=true,resume=false', '--eos </s> --num_mols 0 --pool_size 30 --profile'),
        (2, 'eos=<eos>,num_mols=5,pool_size=10,profile=true,resume=false', '--eos <eos> --num_mols 5 --pool_size 10 --profile'),
        (3, 'eos=</s>,num_mols=0,pool_size=10,profile=true,resume=false', '--eos </s> --num_mols 0 --pool_size 10 --profile')) t(run, settings, arguments)""",
    "tag_pairs": "select * from (values ('[A]', '[/A]'), ('[B]', '[/B]'), ('[C]', '[/C]'), ('[START_SMILES]', '[END_SMILES]')) t(start_tag, end_tag)",
    "resume_progress": "with l as (select distinct line_id, file, line_number, is_read from raw_lines) select file, count(*) filter (is_read) as n_read, count(*) filter (not coalesce(is_read, false)) as n_unread, coalesce(max(line_number) filter (is_read) + 1, 0) as resume_line from l group by 1",
    "temperature_schedule": "select range as iteration, round(1.0::double + range * (200.0::double / 9800.0::double * 0.5::double), 9) as temperature from range(50)",
    "lr_schedule": "select range as step, round(case when range < 100 then range * 1e-6::double when range > 1000 then 0 else 1e-4::double * (1 - (range - 100) / 900.0::double) end, 12) as rate from range(0, 1201, 10)",
    "run_version": "with s as (select event_type, list(distinct event_id % 7) as v from events where event_id % 7 <> 3 group by 1) select event_type, list_min(list_filter(range(8), lambda i: not list_contains(v, i))) as next_version from s",
    "path_names": "with p as (select file, concat('/runs/', file, '/checkpoint-', max(line_number)) as path from raw_lines group by 1) select path, concat(substr(string_split(path, '/')[-2], 1, 6), '-', string_split(path, '/')[-1]) as short_name from p",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """
        with e as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""",
    "rank_functions": """
        with r as (select p_brand, p_partkey, row_number() over w::int as rn, rank() over v::int as rank, dense_rank() over v::int as dense, ntile(4) over w::int as quartile from part
        window w as (partition by p_brand order by p_retailprice desc, p_partkey), v as (partition by p_brand order by p_retailprice desc)) select * from r where rn <= 10""",
    "split_sets": "with a as (select distinct l_partkey from lineitem where l_returnflag = 'A'), r as (select distinct l_partkey from lineitem where l_returnflag = 'R') select 'both' as kind, count(*) as n from (select * from a intersect select * from r) union all select 'either', count(*) from (select * from a union select * from r) union all select 'only_a', count(*) from (select * from a except select * from r)",
}
