"""Metrics over scored logs: top-n means and areas, regression errors, perplexities, plateaus, streaks, pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topn_means(log: DataFrame, max_calls: int, tops: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """One row: the mean of the n best scores among the last max_calls calls, for each n. log has call_idx, score."""
    last = log.agg(F.max("call_idx").alias("last"))
    some = log.join(F.broadcast(last), F.col("call_idx") > F.col("last") - max_calls).orderBy(F.col("score").desc()).limit(max(tops))
    ranked = some.withColumn("rn", F.row_number().over(Window.orderBy(F.col("score").desc())))  # max(tops) rows
    return ranked.agg(*[F.round(F.avg(F.when(F.col("rn") <= n, F.col("score"))), 6).alias(f"top_{n}") for n in tops])


SPAN = 1024  # buckets that are folded together


def running_tops(log: DataFrame, freq: int, tops: tuple[int, ...]) -> DataFrame:
    """b, means: after each bucket of freq calls (call_idx from 1) the means of the so many best scores of all calls so far.

    Each bucket is cut to its best scores, each span of buckets likewise; a span's buckets are then folded onto what the spans
    before leave, so that no task holds more than a span's buckets, or one row a span.
    """
    most = max(tops)
    keep = lambda a: F.slice(F.sort_array(a, asc=False), 1, most)
    scored = log.where(F.col("score").isNotNull()).select(F.expr(f"(call_idx - 1) div {freq}").alias("b"), "score")
    buckets = scored.groupBy("b").agg(keep(F.collect_list("score")).alias("s")).withColumn("span", F.expr(f"b div {SPAN}"))  # of freq calls each
    spans = buckets.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("bs")).withColumn("top", keep(F.flatten(F.transform("bs", lambda x: x["s"]))))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span, of the best scores only
    starts = spans.select("span", keep(F.flatten(F.collect_list("top").over(earlier))).alias("start"))
    mean = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0.0), lambda t, x: t + x) / F.least(F.size(a), F.lit(n))
    state = F.struct(F.col("start").alias("a"), F.array().cast("array<struct<b:bigint,means:array<double>>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = keep(F.concat(s["a"], x["s"]))
        return F.struct(a.alias("a"), F.concat(s["out"], F.array(F.struct(x["b"].cast("bigint").alias("b"), F.array(*[mean(a, n) for n in tops]).alias("means")))).alias("out"))

    return spans.join(starts, "span").select(F.inline(F.aggregate("bs", state, step, lambda s: s["out"])))


def top_auc(log: DataFrame, top_n: int, freq: int, max_calls: int, finish: bool) -> DataFrame:
    """One row, auc: trapezoids under the mean of the top_n best scores so far, at every freq-th call, by max_calls.

    log has call_idx from 1. Calls beyond max_calls count in the tail, as does the rest of the budget when the search finished early.
    """
    size = log.agg(F.count(F.lit(1)).alias("n"), F.expr(f"max((call_idx - 1) div {freq})").alias("last"))
    means = running_tops(log, freq, (top_n,)).select("b", F.col("means")[0].alias("m")).join(F.broadcast(size))
    checks = means.where((F.col("b") + 1) * freq < F.least("n", F.lit(max_calls))).select("n", ((F.col("b") + 1) * freq).alias("c"), "m")
    points = checks.unionByName(means.where(F.col("b") == F.col("last")).select("n", F.lit(None).cast("bigint").alias("c"), "m"))  # the tail over all calls
    steps = Window.orderBy(F.col("c").asc_nulls_last())  # one row a checkpoint
    area = points.withColumn("prev", F.coalesce(F.lag("m").over(steps), F.lit(0.0))).withColumn("called", F.coalesce(F.lag("c").over(steps), F.lit(0)))
    rest = F.when(F.lit(finish) & (F.col("n") < max_calls), (F.lit(max_calls) - F.col("n")) * F.col("m")).otherwise(0.0)
    part = F.when(F.col("c").isNull(), (F.col("n") - F.col("called")) * (F.col("m") + F.col("prev")) / 2 + rest).otherwise(F.lit(freq) * (F.col("m") + F.col("prev")) / 2)
    return area.agg(F.round(F.sum(part) / max_calls, 6).alias("auc"))


def reports(log: DataFrame, every: int, tops: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """calls, top_1, top_10, ...: the means of the best scores after every so many calls (call_idx from 1), complete reports only."""
    n = log.agg(F.count(F.lit(1)).alias("n"))
    rows = running_tops(log, every, tops).join(F.broadcast(n)).where((F.col("b") + 1) * every <= F.col("n"))
    return rows.select(((F.col("b") + 1) * every).alias("calls"), *[F.round(F.col("means")[i], 6).alias(f"top_{t}") for i, t in enumerate(tops)])


#: Metrics by the name that settings give: aggregates over a truth and a guess.
HOOKS = {
    "n": lambda t, g: F.count_if(t.isNotNull() & g.isNotNull()),
    "mae": lambda t, g: F.avg(F.abs(t - g)),
    "rmse": lambda t, g: F.sqrt(F.avg((t - g) * (t - g))),
    "bias": lambda t, g: F.avg(g - t),
    "exact": lambda t, g: F.avg((t == g).cast("double")),
}


def hooked(df: DataFrame, truth: Column, guess: Column, names: list[str], *groups: str, preprocess=lambda c: c, hooks: dict | None = None) -> DataFrame:
    """A column per named metric; preprocess shapes the guesses before any metric sees them. hooks adds metrics to those known."""
    known = {**HOOKS, **(hooks or {})}
    if missing := [n for n in names if n not in known]:
        raise KeyError(f"no metric {missing[0]}; there are {', '.join(known)}")
    rows = df.select(*groups, truth.alias("_t"), preprocess(guess).alias("_g"))
    return rows.groupBy(*groups).agg(*[known[n](F.col("_t"), F.col("_g")).alias(n) for n in names])


def regression(df: DataFrame, truth: Column, guess: Column, *groups: str) -> DataFrame:
    """n_valid, n_invalid, rmse, mae, pearson; rows without both numbers are counted as invalid and left out."""
    rows = df.select(*groups, truth.alias("t"), guess.alias("g"))
    good = F.col("t").isNotNull() & F.col("g").isNotNull()
    t, g = F.when(good, F.col("t")), F.when(good, F.col("g"))
    return rows.groupBy(*groups).agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_invalid"), F.round(F.sqrt(F.avg(F.pow(t - g, F.lit(2.0)))), 6).alias("rmse"), F.round(F.avg(F.abs(t - g)), 6).alias("mae"), F.round(F.corr(t, g), 6).alias("pearson"))


def perplexities(df: DataFrame, group: str, prop: str, loss: str) -> DataFrame:
    """property, perplexity, n: the mean over sequences of 2^(mean loss / ln 2), per property and, as 'perplexity', overall.

    Null losses are padding. df has one row a token.
    """
    each = df.where(F.col(loss).isNotNull()).groupBy(group, prop).agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("k"))
    power = lambda s, k: F.pow(F.lit(2.0), s / k / F.log(F.lit(2.0)))
    by_prop = each.groupBy(F.col(prop).alias("property")).agg(F.sum(power(F.col("s"), F.col("k"))).alias("p"), F.count(F.lit(1)).alias("n"))
    whole = each.groupBy(group).agg(F.sum("s").alias("s"), F.sum("k").alias("k")).agg(F.sum(power(F.col("s"), F.col("k"))).alias("p"), F.count(F.lit(1)).alias("n")).select(F.lit("perplexity").alias("property"), "p", "n")
    return by_prop.unionByName(whole).select("property", F.round(F.col("p") / F.greatest(F.col("n"), F.lit(1)), 6).alias("perplexity"), "n")


PAIR_SPAN = 65_536  # positions of a group that one task pairs


def pair_tags(df: DataFrame, group: str, pos: str, is_start: Column, is_end: Column) -> DataFrame:
    """group, start_pos, end_pos: for each start the first end strictly after it in its group; an end may serve several starts.

    A group is cut into spans of positions: each start looks in its own span, those that find nothing there take the first end
    of the next span that has one, so a group of any size is many tasks.
    """
    rows = df.select(group, F.col(pos).alias("start_pos"), is_start.alias("s"), F.when(is_end, F.col(pos)).alias("e"), F.expr(f"{pos} div {PAIR_SPAN}").alias("_span"))
    after = Window.partitionBy(group, "_span").orderBy(F.col("start_pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_own", F.last("e", ignorenulls=True).over(after)).where("s")
    later = Window.partitionBy(group).orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    firsts = rows.groupBy(group, "_span").agg(F.min("e").alias("_e")).withColumn("_next", F.last("_e", ignorenulls=True).over(later)).drop("_e")
    both = here.join(firsts, [group, "_span"]).withColumn("end_pos", F.coalesce("_own", "_next"))
    return both.where(F.col("end_pos").isNotNull()).select(group, "start_pos", "end_pos")


def loss_plateau(log: DataFrame, patience: int, delta: int, share: float, most: int, start: int = 1) -> DataFrame:
    """step, far, near, doubled, accumulation at every patience-th step of a log (step from 1, loss).

    far and near are sums over the delta steps that end 19 deltas before, and at, the step, by delta. Accumulation doubles, up
    to most, where far - near < far * share. Each row of the log joins at most two sums, so nothing is ordered but the checks.
    """
    at = lambda back: F.expr(f"cast(ceil((step + {back * delta}) / {patience}) * {patience} as bigint)")
    kinds = F.array(*[F.struct(at(b).alias("check"), F.lit(k).alias("kind"), F.lit(b * delta).alias("back")) for b, k in ((19, "far"), (0, "near"))])
    last = log.agg(F.max("step").alias("last"))
    each = log.select("step", "loss", F.inline(kinds)).where((F.col("check") - F.col("back") - F.col("step")).between(0, delta - 1))
    sums = each.join(F.broadcast(last), F.col("check") <= F.col("last")).groupBy(F.col("check").alias("step")).agg((F.sum(F.when(F.col("kind") == "far", F.col("loss"))) / delta).alias("far"), (F.sum(F.when(F.col("kind") == "near", F.col("loss"))) / delta).alias("near"))
    flat = F.coalesce(F.col("far") - F.col("near") < F.col("far") * share, F.lit(False))
    so_far = F.sum(F.col("doubled").cast("int")).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # one row a check
    return sums.withColumn("doubled", flat).withColumn("accumulation", F.least(F.lit(float(most)), F.pow(F.lit(2.0), so_far) * start).cast("bigint"))


def patience_streaks(log: DataFrame, group: str, pos: str, loss: str, threshold: float) -> DataFrame:
    """group, streak, best: after the last evaluation of each run, how many in a row didn't beat the best by the threshold.

    Sequential by nature: each run's losses are folded in order; a run's log must fit a row.
    """
    runs = df_sorted(log, group, pos, loss)
    start = F.struct(F.lit(float("inf")).cast("double").alias("best"), F.lit(0).alias("streak"))
    fold = F.aggregate("losses", start, lambda a, x: F.when(x >= a["best"] - threshold, F.struct(a["best"].alias("best"), (a["streak"] + 1).alias("streak"))).otherwise(F.struct(x.alias("best"), F.lit(0).alias("streak"))))
    return runs.select(group, fold.alias("f")).select(group, F.col("f.streak").cast("bigint").alias("streak"), F.col("f.best").alias("best"))


def df_sorted(log: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    return log.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda s: s["v"]).alias("losses"))


def tolerance_levels(log: DataFrame, per_iteration: int) -> DataFrame:
    """iteration, best, running_best, improved, tolerance: iterations since the last new best.

    The log (call_idx from 0, score) is reduced to one row an iteration before anything is ordered.
    """
    its = log.groupBy(F.expr(f"call_idx div {per_iteration}").alias("iteration")).agg(F.max("score").alias("best"))
    before = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    rows = its.withColumn("prev", F.max("best").over(before)).withColumn("improved", F.coalesce(F.col("best") > F.col("prev"), F.lit(True))).withColumn("running_best", F.max("best").over(upto)).withColumn("island", F.sum(F.col("improved").cast("int")).over(upto))
    return rows.withColumn("tolerance", F.row_number().over(Window.partitionBy("island").orderBy("iteration")) - 1).select("iteration", "best", "running_best", "improved", F.col("tolerance").cast("bigint").alias("tolerance"))


def best_state(log: DataFrame, group: str, pos: str, loss: str) -> DataFrame:
    """group, best_loss, best_pos: the lowest loss, and of equal ones the latest."""
    return log.groupBy(group).agg(F.min(F.struct(F.col(loss).alias("l"), (-F.col(pos)).alias("p"))).alias("m")).select(group, F.col("m.l").alias("best_loss"), (-F.col("m.p")).alias("best_pos"))


def by_module(counts: DataFrame, module: str, ops: str) -> DataFrame:
    """module, n_calls, ops: the calls and operations of each module with those of all modules inside it.

    module is a path joined by dots; each call counts once for every part of its path, the modules that were open around it.
    """
    sums = counts.groupBy(module).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(ops).alias("ops"))  # a row a leaf before it is spread
    parts = F.split(F.col(module), r"\.")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return sums.select(F.explode(paths).alias("module"), "n_calls", "ops").groupBy("module").agg(F.sum("n_calls").alias("n_calls"), F.sum("ops").alias("ops"))


def array_difference(a: Column, b: Column) -> dict[str, Column]:
    """Least, most, mean and median absolute difference of two arrays' elements, and how many differ."""
    d = F.array_sort(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    n = F.size(d)
    mid = (F.element_at(d, F.floor((n + 1) / 2).cast("int")) + F.element_at(d, F.floor((n + 2) / 2).cast("int"))) / 2
    return {"least": F.round(F.element_at(d, 1), 6), "most": F.round(F.element_at(d, -1), 6), "mean": F.round(F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n, 6), "median": F.round(mid, 6), "n_differ": F.size(F.filter(d, lambda x: x > 0)).cast("bigint")}
