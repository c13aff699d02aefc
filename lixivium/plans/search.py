"""Queries of candidate search: similarity, the pool, novelty, scoring, prompts, rejection sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.functions import similarity
from lixivium.functions.tags import two_decimals
from lixivium.operators import pool
from lixivium.operators import similarity_search as ss
from lixivium.session import table


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", similarity.sign_bits(F.col("embedding"), 64).alias("bits"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return rows.where(F.col("vec_id") % 50 == 0)


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "compounds").dropDuplicates(["record_id"])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an oracle's log: call index, candidate, score."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("key"), F.col("value").alias("score"))


def tanimoto_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir)
    return ss.top_k(_asked(rows), rows, 10, 2).select("query", "match", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def agg_tanimoto_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows (ids not divisible by 50) as the stock: how near its nearest is to each asked one, which isn't part of it."""
    rows = _bits(spark, sf_dir)
    return ss.mean_score(ss.aggregate_similarity(_asked(rows), rows.where(F.col("vec_id") % 50 != 0), 2, "max"))


def agg_tanimoto_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir)
    return ss.mean_score(ss.aggregate_similarity(_asked(rows), rows, 2, "mean"))


def agg_tanimoto_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir)
    return ss.mean_score(ss.aggregate_similarity(_asked(rows), rows, 2, "mean", 2.0))


def internal_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir)
    return ss.internal_diversity(_asked(rows), rows, 2)


def ngram_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = similarity.hashed_ngram_bits(F.col("SMILES"))
    return _compounds(spark, sf_dir).where(F.col("SMILES").isNotNull()).select("record_id", F.size(bits).cast("bigint").alias("n_bits"), F.array_join(bits, ",").alias("bits"))


def lead_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every control compound, a fixed few, as lead: the compounds most like it by hashed n-grams."""
    pack = lambda c: similarity.pack_numbers(similarity.hashed_ngram_bits(c))
    leads = F.broadcast(table(spark, sf_dir, "control_compounds").select(F.col("CID").alias("lead"), pack(F.col("SMILES")).alias("lead_bits")))  # eight rows, fixed
    rows = _compounds(spark, sf_dir).where(F.coalesce("SMILES", F.lit("")) != "").select("record_id", pack(F.col("SMILES")).alias("bits"), F.lit(1).alias("one"))
    near = rows.join(leads.withColumn("one", F.lit(1)), "one").withColumn("similarity", similarity.tanimoto(F.col("bits"), F.col("lead_bits"), 8))
    return near.groupBy("lead").agg(F.count_if(F.col("similarity") >= 0.4).alias("n_similar"), F.round(F.max("similarity"), 6).alias("most_similar"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def pool_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    first = pool.merge(log.where("pos % 2 = 0").withColumn("status", F.lit(pool.NONE)), log.limit(0), 50)
    return pool.merge(first, log.where("pos % 2 = 1"), 50).select("key", "score")


def pool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    first = pool.assign_statuses(pool.merge(log.where("pos % 2 = 0").withColumn("status", F.lit(pool.NONE)), log.limit(0), 50), 50, 0.2)
    return pool.assign_statuses(pool.merge(first, log.where("pos % 2 = 1"), 50), 50, 0.2).select("key", "score", "status")


def pool_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir).select(F.col("vec_id").alias("key"), (F.col("label") + F.col("vec_id") % 7 / 10.0).cast("double").alias("score"), "bits")
    return pool.diverse(rows, 50, 0.4, 2)


def novel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of test records, by SMILES, that no training record has, at their first record."""
    rows = _compounds(spark, sf_dir).select("record_id", "SMILES", F.lower(F.trim("split")).alias("s"))
    new = rows.where(F.col("s") == "test").select(F.col("SMILES").alias("key"), F.col("record_id").alias("pos"))
    return pool.novel(new, rows.where(F.col("s").startswith("train") & F.col("SMILES").isNotNull()).select(F.col("SMILES").alias("key"))).select("key", "pos")


def cached_oracle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all compounds, gated: heavy ones and ones of few rings score 0; known ones come from the buffer."""
    rows = _compounds(spark, sf_dir)
    fresh = F.when((F.col("WEIGHT") >= 350) | (F.col("RINGCOUNT") < 2), F.lit(0.0)).otherwise(F.coalesce("TPSA", F.lit(0.0)))
    asked = rows.where(F.col("WEIGHT").isNotNull() & F.col("RINGCOUNT").isNotNull()).select(F.col("record_id").alias("key"), fresh.alias("fresh"))
    buffer = rows.where((F.col("record_id") % 3 == 0) & F.col("QED").isNotNull()).select(F.col("record_id").alias("key"), F.col("QED").alias("score"))
    return pool.cached_scores(asked, buffer, F.col("fresh"))


def call_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates in order of their first call, and every hundredth of them."""
    from lixivium.functions.ordering import numbered

    first = _log(spark, sf_dir).groupBy("key").agg(F.min("pos").alias("pos"))
    rows = numbered(first, F.expr("pos div 8192"), F.col("pos"), name="call_idx")
    return rows.select("key", "call_idx", (F.col("call_idx") % 100 == 0).alias("logged"))


def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _log(spark, sf_dir).select("key").distinct()
    return pool.random_subset(keys, 20, "42").select("key", F.col("rank").cast("bigint").alias("rank"))


def similars_without_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of eight prompts, of the eight best entries, a subset of five of the pool, the prompt's own entry dropped: five or four similars."""
    log = _log(spark, sf_dir)
    best = pool.merge(log.withColumn("status", F.lit(0)), log.limit(0), 30)  # thirty rows
    from pyspark.sql import Window

    from lixivium.det import order_key

    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("key").desc())) - 1
    own = best.select(place.cast("bigint").alias("prompt"), F.col("key").alias("entry")).where("prompt < 8")
    prompts = best.select("key").join(F.broadcast(own))  # eight rows
    drawn = prompts.withColumn("rn", F.row_number().over(Window.partitionBy("prompt").orderBy(order_key("42", F.col("prompt"), F.col("key")), "key"))).where("rn <= 5")
    return drawn.groupBy("prompt").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("key") != F.col("entry"), F.col("key")))), ",").alias("similars"))


def unique_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _log(spark, sf_dir).groupBy("key").agg(F.max("score").alias("score"))
    return best.orderBy(F.col("score").desc(), F.col("key").desc()).limit(15)


def rejection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the records with a high score and a related molecule that is similar enough, and whether there is any."""
    near = F.array_max(F.transform(F.filter("related", lambda r: r["similarity"].isNotNull()), lambda r: r["similarity"]))
    good = F.coalesce((F.col("QED") >= 0.9) & (near >= 0.4), F.lit(False))
    return _compounds(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(good).alias("n_good"), F.bool_or(good).alias("any_good"))


def rejection_samples(spark: SparkSession, sf_dir: str, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Per record the sample text: similar molecules, score, target; targets among their similars are dropped.

    So are samples of more than 500 tokens, if count gives the tokens of texts; without a tokenizer samples of any length stay.
    """
    rows = _compounds(spark, sf_dir).where((F.coalesce("SMILES", F.lit("")) != "") & F.col("QED").isNotNull())
    sims = F.filter("related", lambda r: r["SMILES"].isNotNull() & r["similarity"].isNotNull())
    top = F.slice(F.array_sort(F.transform(sims, lambda r: F.struct((-r["similarity"]).alias("s"), r["SMILES"].alias("SMILES"), r["similarity"].alias("similarity")))), 1, 5)
    text = F.concat(F.lit("</s>"), pool.similars_text(top), F.lit("[QED]"), two_decimals(F.col("QED")), F.lit("[/QED][START_SMILES]"), F.col("SMILES"), F.lit("[END_SMILES]</s>"))
    member = F.coalesce(F.exists(top, lambda r: r["SMILES"] == F.col("SMILES")), F.lit(False))
    samples = rows.where(~member).select("record_id", text.alias("sample"))
    return pool.within_tokens(samples, "sample", 500, count) if count else samples


def contains_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split the records whose own molecule is among their related ones, and those whose isn't."""
    inside = F.coalesce(F.exists("related", lambda r: r["SMILES"] == F.col("SMILES")), F.lit(False))
    return _compounds(spark, sf_dir).groupBy(F.lower(F.trim("split")).alias("split")).agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def optim_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts and generation prompts of both strategies."""
    rows = _compounds(spark, sf_dir).where((F.coalesce("SMILES", F.lit("")) != "") & F.col("QED").isNotNull())
    sims = F.slice(F.filter(F.coalesce("related", F.array().cast("array<struct<SMILES:string,similarity:double>>")), lambda r: r["SMILES"].isNotNull() & r["similarity"].isNotNull()), 1, 3)
    args = (sims, F.col("SMILES"), F.col("QED"), F.col("record_id"))
    return rows.select(
        "record_id",
        pool.prompt(*args, generation=False).alias("train_text"),
        pool.prompt(*args, generation=False, strategy="rej-sample-v2", with_score=True).alias("train_scored"),
        pool.prompt(*args, generation=True, strategy="rej-sample-v2", with_score=True, score_range=(F.col("QED"), 1.0)).alias("generation_prompt"),
    )


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score plus similarity of the nearest related molecule, summed up per source."""
    near = F.coalesce(F.array_max(F.transform(F.filter("related", lambda r: r["similarity"].isNotNull()), lambda r: r["similarity"])), F.lit(-1.0))
    return _compounds(spark, sf_dir).where(F.col("QED").isNotNull()).groupBy("source").agg(F.round(F.max(F.col("QED") + near), 6).alias("best"), F.round(F.avg(F.col("QED") + near), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (tanimoto_topk, agg_tanimoto_max, agg_tanimoto_mean, agg_tanimoto_power, internal_diversity, ngram_fingerprint, lead_similarity, pool_update, pool_status, pool_diverse, novel_candidates, cached_oracle_scores, call_index, random_subset, similars_without_self, unique_topk, rejection_filter, rejection_samples, contains_entry, optim_prompts, composite_score)}

_ONE = "(select distinct on (record_id) * from compounds order by record_id)"
_E = "e as (select vec_id, label, list_transform(embedding, lambda x: case when x > 0 then 1.0::double else 0.0::double end) as b, list_sum(list_transform(embedding, lambda x: case when x > 0 then 1.0::double else 0.0::double end)) as n from embeddings)"
_PAIRS = "p as (select q.vec_id as query, r.vec_id as match, case when q.n + r.n - list_inner_product(q.b, r.b) = 0 then 1.0 else list_inner_product(q.b, r.b) / (q.n + r.n - list_inner_product(q.b, r.b)) end as s from e q, e r where q.vec_id % 50 = 0)"
_LOG = "l as (select event_id as pos, concat('m', user_id) as key, value as score from events)"
_TOP = "select key, max(score) as score from l {} group by 1 order by 2 desc, 1 desc limit 50"
_GRAMS = "list_sort(list_distinct(list_transform(range(1, length(SMILES) - 1), lambda i: concat('0x', substr(md5(substr(SMILES, i, 3)), 1, 2))::int)))"
_NEAR = "list_max(list_transform(list_filter(related, lambda r: r.similarity is not null), lambda r: r.similarity))"
_SIMS = "list_filter(related, lambda r: r.SMILES is not null and r.similarity is not null)"
_UNI = "(concat('0x', substr(md5({}), 1, 8))::ubigint / 4294967296.0::double)"


def _sims_text(similars: str, value: str) -> str:
    return f"coalesce(array_to_string(list_transform({similars}, lambda r, i: concat('[SIMILAR]', r.SMILES, ' ', printf('%.2f', {value}), '[/SIMILAR]')), ''), '')"


_STATUS_1 = f"{_LOG}, t1 as ({_TOP.format('where pos % 2 = 0')}), s1 as (select key, score, case when row_number() over (order by score desc, key desc) <= 11 then 2 else 1 end as status from t1)"
_STATUS_2 = "t2 as (select key, max(score) as score, max(status) as status from (select key, score, status from s1 union all select key, score, 0 from l where pos % 2 = 1) group by 1 order by 2 desc, 1 desc limit 50), r2 as (select *, row_number() over (partition by status order by score desc, key desc) as rn, count(*) filter (status = 2) over () as have from t2)"

SQL = {
    "tanimoto_topk": f"with {_E}, {_PAIRS}, r as (select *, row_number() over (partition by query order by round(s, 12) desc, match) as rank from p where query <> match) select query, match, round(s, 6) as similarity, rank from r where rank <= 10",
    "agg_tanimoto_max": f"with {_E}, {_PAIRS}, g as (select query, max(s) as s from p where match % 50 <> 0 group by 1) select count(*) as n_queries, round(avg(s), 6) as score from g",
    "agg_tanimoto_mean": f"with {_E}, {_PAIRS}, g as (select query, avg(s) as s from p group by 1) select count(*) as n_queries, round(avg(s), 6) as score from g",
    "agg_tanimoto_power": f"with {_E}, {_PAIRS}, g as (select query, sqrt(avg(s * s)) as s from p group by 1) select count(*) as n_queries, round(avg(s), 6) as score from g",
    "internal_diversity": f"with {_E}, {_PAIRS} select round(1 - avg(s), 6) as diversity from p",
    "ngram_fingerprint": f"select record_id, len({_GRAMS}) as n_bits, array_to_string({_GRAMS}, ',') as bits from {_ONE} where SMILES is not null",
    "lead_similarity": f"""
        with c as (select record_id, {_GRAMS} as g from {_ONE} where coalesce(SMILES, '') <> ''), d as (select CID as lead, {_GRAMS} as h from control_compounds),
        s as (select lead, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) as s from c, d)
        select lead, count(*) filter (s >= 0.4) as n_similar, round(max(s), 6) as most_similar, round(avg(s), 6) as mean_similarity from s group by 1""",
    "pool_update": f"with {_LOG} select key, max(score) as score from l group by 1 order by 2 desc, 1 desc limit 50",
    "pool_status": f"with {_STATUS_1}, {_STATUS_2} select key, score, case when status <> 0 then status when rn <= greatest(0, 11 - have) then 2 else 1 end::int as status from r2",
    "novel_candidates": f"with o as {_ONE} select SMILES as key, min(record_id) as pos from o where lower(trim(split)) = 'test' and coalesce(SMILES, '') <> '' and SMILES not in (select SMILES from o where lower(trim(split)) like 'train%' and SMILES is not null) group by 1",
    "cached_oracle_scores": f"select record_id as key, case when record_id % 3 = 0 and QED is not null then QED when WEIGHT >= 350 or RINGCOUNT < 2 then 0.0 else coalesce(TPSA, 0.0) end as score, record_id % 3 = 0 and QED is not null as cached from {_ONE} where WEIGHT is not null and RINGCOUNT is not null",
    "call_index": f"with {_LOG}, f as (select key, min(pos) as pos from l group by 1), n as (select key, row_number() over (order by pos) as call_idx from f) select key, call_idx, call_idx % 100 = 0 as logged from n",
    "random_subset": f"with {_LOG}, k as (select distinct key from l), r as (select key, row_number() over (order by md5(concat('42#', key)), key) as rank from k) select * from r where rank <= 20",
    "similars_without_self": f"""
        with {_LOG}, b as (select key, row_number() over (order by max(score) desc, key desc) - 1 as place from l group by 1 order by 2 limit 30),
        o as (select place as prompt, key as entry from b where place < 8),
        r as (select prompt, entry, key, row_number() over (partition by prompt order by md5(concat_ws('#', '42', prompt, key)), key) as rn from b, o)
        select prompt, coalesce(string_agg(key, ',' order by key) filter (key <> entry), '') as similars from r where rn <= 5 group by 1""",
    "pool_diverse": """
        with e as (select vec_id as key, (label + vec_id % 7 / 10.0::double)::double as score, list_transform(embedding, lambda x: case when x > 0 then 1.0::double else 0.0::double end) as b, list_sum(list_transform(embedding, lambda x: case when x > 0 then 1.0::double else 0.0::double end)) as n from embeddings),
        l as (select list({'key': key, 'score': score, 'b': b, 'n': n} order by score desc, key desc) as xs from e),
        k as (select list_reduce(xs, lambda kept, x: case when len(kept) >= 50 or len(list_filter(kept, lambda m: case when m.n + x.n = list_inner_product(m.b, x.b) then 1.0::double else list_inner_product(m.b, x.b) / (m.n + x.n - list_inner_product(m.b, x.b)) end > 0.4::double)) > 0 then kept else list_append(kept, x) end, []) as kept from l),
        o as (select unnest(kept) as m, unnest(range(1, len(kept) + 1)) as rank from k)
        select m.key as key, m.score as score, rank::int as rank from o""",
    "unique_topk": f"with {_LOG} select key, max(score) as score from l group by 1 order by 2 desc, 1 desc limit 15",
    "rejection_filter": f"select source, count(*) as n_records, count(*) filter (coalesce(QED >= 0.9 and {_NEAR} >= 0.4, false)) as n_good, bool_or(coalesce(QED >= 0.9 and {_NEAR} >= 0.4, false)) as any_good from {_ONE} group by 1",
    "rejection_samples": f"""
        with o as (select record_id, SMILES, QED, list_sort(list_transform({_SIMS}, lambda r: {{'s': -r.similarity, 'SMILES': r.SMILES, 'similarity': r.similarity}}))[1:5] as t from {_ONE} where coalesce(SMILES, '') <> '' and QED is not null),
        x as (select record_id, concat('</s>', {_sims_text("t", "r.similarity")}, '[QED]', printf('%.2f', QED), '[/QED][START_SMILES]', SMILES, '[END_SMILES]</s>') as sample from o where not coalesce(list_contains(list_transform(t, lambda r: r.SMILES), SMILES), false))
        select * from x""",
    "contains_entry": f"with x as (select lower(trim(split)) as split, coalesce(list_contains(list_transform(related, lambda r: r.SMILES), SMILES), false) as i from {_ONE}) select split, count(*) filter (i) as n_inside, count(*) filter (not i) as n_outside from x group by 1",
    "optim_prompts": f"""
        with o as (select record_id, SMILES, QED, coalesce({_SIMS}, [])[1:3] as t from {_ONE} where coalesce(SMILES, '') <> '' and QED is not null)
        select record_id, concat('</s>', {_sims_text("t", "r.similarity")}, '[START_SMILES]', SMILES, '[END_SMILES]</s>') as train_text,
            concat('</s>', {_sims_text("t", "r.similarity")}, '[PROPERTY]oracle_score ', printf('%.2f', QED), '[/PROPERTY][START_SMILES]', SMILES, '[END_SMILES]</s>') as train_scored,
            concat('</s>', {_sims_text("t", "0.9::double + " + _UNI.format("concat_ws('#', '42#sim', record_id, i - 1)") + " * 0.08999999999999997::double")}, '[PROPERTY]oracle_score ', printf('%.2f', QED + {_UNI.format("concat_ws('#', '42#score', record_id)")} * (1.0::double - QED)), '[/PROPERTY][START_SMILES]') as generation_prompt from o""",
    "composite_score": f"select source, round(max(QED + coalesce({_NEAR}, -1)), 6) as best, round(avg(QED + coalesce({_NEAR}, -1)), 6) as mean from {_ONE} where QED is not null group by 1",
}
