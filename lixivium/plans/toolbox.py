"""Queries of the remaining tools: training rows by kind, samplers, prompts with examples, plug-ins, settings, sinks, hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium import det
from lixivium.functions import arrays, tags
from lixivium.operators import assembly, blocks, chem, grid, metrics, pipeline, pool, search
from lixivium.plans import corpus
from lixivium.session import new_path, table
from lixivium.sources import files
from lixivium.sources.lines import files_of


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "compounds").dropDuplicates(["record_id"])


def _assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "assay_compounds").select("record_id", "SMILES", "CID", "source", "assays")


def training_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of token ids with mask and labels."""
    items = table(spark, sf_dir, "encoded_items").where(F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    rows = blocks.training_blocks(items, "item_id", "input_ids", "attention_mask", 256)
    h = lambda c: F.md5(F.array_join(c, ",", "-"))
    return rows.select("batch_id", "block_no", h("input_ids").alias("ids_hash"), h("attention_mask").alias("mask_hash"), h("labels").alias("labels_hash"))


def pipeline_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed compounds from records to training rows, per batch."""
    rows = pipeline.training_rows(_compounds(spark, sf_dir), "computed", 128)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.size("tokens")).alias("n_tokens"))


def pipeline_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay compounds from records to training rows, per batch: all of the full length."""
    rows = pipeline.training_rows(_assays(spark, sf_dir), "assay", 256)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("tokens") != 256).alias("n_odd"))


def assembly_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch the assay tokens that go into documents, and those of them that the table of losses doesn't account for: none."""
    rows = assembly.losses(_assays(spark, sf_dir), 256)
    gone = F.col("in_full") + F.col("in_packed") + F.col("lost_no_room") + F.col("lost_cut") + F.col("lost_rest")
    return rows.select("batch_id", "n_content", (F.col("n_content") - gone).alias("n_unaccounted"), (F.least("in_full", "in_packed", "lost_no_room", "lost_cut", "lost_rest") < 0).alias("negative"))


def assembly_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch the assay tokens written and lost, by reason."""
    return assembly.losses(_assays(spark, sf_dir), 256)


def sampler_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of each rank: whole batches in turn, and batches split among the ranks, both made even."""
    docs, out = table(spark, sf_dir, "documents").select("doc_id"), None
    for name, split in (("turns", False), ("split", True)):
        rows = pipeline.rank_rows(docs, "doc_id", 32, 4, split_batches=split)
        one = rows.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"), F.max("place").cast("bigint").alias("last")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def uneven_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of each rank without rows that are used again."""
    rows = pipeline.rank_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32, 4, even_batches=False)
    return rows.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def folder_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of training data with the kind of each."""
    lists = spark.sql("select array('a', 'b', 'c') as folders, array('computed', 'assay', 'computed') as kinds")
    return lists.select(F.inline(pipeline.paired(F.col("folders"), F.col("kinds"))))


def example_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three compounds: two whole examples, then the one asked for, with a property beside the score."""
    rows = _compounds(spark, sf_dir).where((F.coalesce("SMILES", F.lit("")) != "") & F.col("QED").isNotNull() & F.col("record_id").isNotNull())
    good = F.filter(F.coalesce("related", F.array().cast("array<struct<SMILES:string,similarity:double>>")), lambda r: r["SMILES"].isNotNull() & r["similarity"].isNotNull())
    weight = F.when(F.col("WEIGHT").isNotNull(), F.array(F.struct(F.lit("[WEIGHT]").alias("start"), tags.two_decimals(F.col("WEIGHT")).alias("value"), F.lit("[/WEIGHT]").alias("end"))))
    entry = F.struct(F.col("SMILES").alias("smiles"), F.col("QED").alias("score"), F.slice(good, 1, 2).alias("similars"), weight.alias("properties"))
    threes = rows.groupBy(F.expr("(record_id - 1) div 3").alias("prompt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("record_id", entry.alias("e")))), lambda x: x["e"]).alias("es"))
    last, examples = F.element_at("es", -1), F.expr("slice(es, 1, size(es) - 1)")
    give = lambda **kw: pool.example_prompt(examples, last, F.col("prompt"), **kw)
    return threes.select("prompt", give(generation=False).alias("train_text"), give(generation=False, strategy="rej-sample-v2").alias("train_scored"), give(generation=True, strategy="rej-sample-v2").alias("generation_prompt"))


def first_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the compound of the highest QED that isn't too heavy."""
    rows = _compounds(spark, sf_dir).select("source", F.col("record_id").alias("key"), F.col("QED").alias("score"), "WEIGHT")
    return pool.first_acceptable(rows, "source", "key", "score", F.coalesce(F.col("WEIGHT") < 350, F.lit(False)))


def oracle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oracle's report after every 2,500 calls."""
    oracle = search.Oracle(lambda key: F.lit(0.0), 10**9, report_every=2500)
    oracle.log = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("call_idx"), F.col("value").alias("score"))
    return oracle.reports()


def oracle_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored as entries with a property, and what a prompt asks of it."""
    count = lambda key: F.length(F.regexp_replace(key, "[^NO]", ""))
    polar = search.Property("[POLAR]", "[/POLAR]", count, lambda key: F.least(count(key) + 1, F.lit(9)))
    oracle = search.Oracle(lambda e: F.element_at(e["properties"], 1)["value"].cast("double") / F.length(e["key"]), 1000, takes_entry=True, properties={"polar": polar})
    rows = _compounds(spark, sf_dir).where(F.coalesce("SMILES", F.lit("")) != "").select("record_id", F.col("SMILES").alias("key"))
    return oracle.scored(rows).select("record_id", F.round("score", 9).alias("score"), oracle.wishes(F.col("key")).alias("asked"))


def chemistry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the plug-in point without a toolkit."""
    rows = chem.Toolkit().add(_compounds(spark, sf_dir), "canonical", "qed", "tpsa", "weight", "rings", "sas", "inchi", "fingerprint")
    return rows.select("record_id", *[f"chem_{n}" for n in ("canonical", "qed", "tpsa", "weight", "rings", "sas", "inchi")], F.size("chem_fingerprint").cast("bigint").alias("n_bits"))


def legacy_assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assays in the older bracket grammar, longest description first."""
    rows = table(spark, sf_dir, "assay_compounds").dropDuplicates(["record_id"]).select("record_id", F.posexplode(tags.usable_assays(F.col("assays"))).alias("place", "a"))
    return rows.select("record_id", F.col("place").cast("bigint").alias("place"), F.md5(tags.legacy_assay_text(F.col("a"))).alias("text_hash"))


_YAML = """# settings of a run
pool_size: 30
rates: [1e-4, 0.5]
resume: false   # not yet
tokenizer:
  path: "tok # 1"
  eos: '</s>'
kinds:
  - computed
  - assay
"""


def _written(spark: SparkSession, text: str, name: str) -> str:
    """One text as a file below the shared folder; its path."""
    path = new_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return next(p for p, n in files_of({"path": path, "pathglobfilter": "part-*"}) if n)


def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML file of settings laid over defaults."""
    merged = files.settings(_written(spark, _YAML, "settings"), {"pool_size": 10, "eos": "</s>"})
    return spark.createDataFrame([(k, str(v)) for k, v in merged.items()], "name string, value string")


def token_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end tags from a JSON file of special tokens."""
    path = _written(spark, '{"additional_special_tokens": ["[A]", "[B]", "[/A]", "[/B]"], "other": 1}', "tokens")
    return files.token_map(spark, path)


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text files, stripped, counted by what they hold."""
    path = new_path(spark, "text")
    table(spark, sf_dir, "events").select(F.concat(F.lit("  "), "props", F.lit(" "))).write.text(path)
    rows = files.text_lines(spark, path, "part-*")
    return rows.groupBy(F.get_json_object("text", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != F.trim("text")).alias("n_blank"))


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' metrics appended to one table and read back."""
    path = new_path(spark, "metrics")
    for run, part in (("even", 0), ("odd", 1)):
        rows = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part).groupBy(F.expr("event_id div 1000").alias("k")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
        files.track(rows, path, run, F.col("k"), "least", "most")
    return spark.read.parquet(path).groupBy("run", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user after two upserts, and totals per state."""
    path = new_path(spark, "status")
    rows = table(spark, sf_dir, "events")
    state = None
    for part in (0, 1):
        last = rows.where((F.col("user_id") + F.col("event_id")) % 3 == part).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("state"))
        state = files.upsert(spark, path, last, "user_id")
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n_users"), F.sum("user_id").alias("user_sum"))


def metric_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by name, with one of our own and guesses shaped first."""
    rows = table(spark, sf_dir, "lineitem")
    own = {"above": lambda t, g: F.count_if(g > t)}
    out = metrics.hooked(rows, F.col("l_extendedprice"), F.col("l_quantity"), ["n", "mae", "rmse", "bias", "above"], "l_returnflag", preprocess=lambda c: c * 1500, hooks=own)
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias")], "above")


def logits_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scores through a chain of processors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"), F.array((F.col("vec_id") % 64).cast("int"), F.lit(5), F.lit(3)).alias("seen"))
    out = arrays.processed(F.col("s"), F.col("seen"), [{"name": "suppress_seen", "tokens": [7]}, {"name": "sequential_decay", "tokens": [2, 5], "factors": [1.02, 1.1]}, {"name": "length_decay", "token": 9, "factor": 2.0, "start": 1}])
    return rows.select("vec_id", *[F.round(out[i], 6).alias(f"s{i}") for i in (2, 5, 9)], (out[7] == float("-inf")).alias("out7"))


_BACK = "values (0, array(2L, 8L, 30L, 30L), array(2L, 3L, 32L, 32L), array(8L, 3L, 3L, 3L), false, true, true), (1, array(2L, 3L, 30L, 30L), array(2L, 8L, 15L, 15L), array(8L, 3L, 2L, 2L), true, true, false)"


def gradient_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiplications of connected layers, batched products and the gradients of convolutions; the share of a peak they are."""
    a = spark.sql("select * from values (0, array(16L, 64L), array(64L, 10L)) as t(i, a, b)").select(F.lit("addmm").alias("op"), "i", arrays.addmm_ops(F.col("a"), F.col("b")).alias("ops"))
    b = spark.sql("select * from values (0, array(4L, 16L, 64L), array(4L, 64L, 10L)) as t(i, a, b)").select(F.lit("bmm").alias("op"), "i", arrays.bmm_ops(F.col("a"), F.col("b")).alias("ops"))
    c = spark.sql(f"select * from {_BACK} as t(i, g, x, w, t, dx, dw)").select(F.lit("conv_back").alias("op"), "i", arrays.conv_backward_ops(*[F.col(k) for k in ("g", "x", "w", "t", "dx", "dw")]).alias("ops"))
    rows = a.unionByName(b).unionByName(c)
    return rows.withColumn("mfu", F.round(arrays.utilisation(F.col("ops").cast("double"), F.lit(0.5), F.lit(1e6)), 4))


def random_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudorandom whole numbers from 0 to 9, one an event."""
    rows = table(spark, sf_dir, "events").select(det.whole("42#whole", 0, 9, F.col("event_id")).alias("k"), "event_id")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run a checkpoint's path belongs to, its step, and the name of the samples drawn with it."""
    path = F.concat(F.lit("/runs/"), F.col("file"), F.lit("/checkpoint-"), F.max("line_number").cast("string"))
    rows = table(spark, sf_dir, "raw_lines").groupBy("file").agg(path.alias("path"))
    parts = F.split("path", "/")
    run, step = F.element_at(parts, -2), F.substring_index(F.element_at(parts, -1), "-", -1)
    return rows.select("path", run.alias("run"), step.alias("step"), F.concat(F.lit("round-2."), F.substring(run, 1, 6), F.lit(".step-"), step, F.lit(".csv")).alias("samples"))


def module_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations counted at the leaves of a tree of modules, added up for each module and every module around it."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.by_module(rows.select(F.concat_ws(".", F.lit("model"), "r_name", "n_name", "c_mktsegment").alias("module"), F.lit(3).alias("ops")), "module", "ops")


def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a generator read and checked by a predicate: documents that end in a molecule with a ring and no bromine."""
    outputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("output"))
    return search.parse(outputs, lambda key: key.contains("1") & ~key.contains("Br"))


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty new candidates in the order they came."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("m"), "user_id").alias("key"), "event_type")
    return pool.novel(log.select("key", "pos"), log.where(F.col("event_type") == "purchase").select("key").distinct()).select("key", "pos").orderBy("pos").limit(40)


def pool_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training and the validation part of a pool."""
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), "user_id").alias("key"), F.col("value").alias("score"))
    whole = pool.assign_statuses(pool.merge(log.withColumn("status", F.lit(pool.NONE)), log.limit(0), 40), 40, 0.25)
    train, valid = pool.train_valid(whole)
    return train.select(F.lit("train").alias("part"), "key", "score").unionByName(valid.select(F.lit("valid").alias("part"), "key", "score"))


def step_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimiser steps of a fine-tuning round for several pools."""
    rows = [(n, e, grid.train_steps(n, 0.2, e, 8)) for n in (10, 50, 200) for e in (1, 5)]
    return spark.createDataFrame(rows, "pool_size bigint, epochs bigint, steps bigint")


QUERIES = {f.__name__: f for f in (module_operations, valid_candidates, first_candidates, pool_parts, step_budgets, training_blocks, pipeline_computed, pipeline_assay, assembly_content, assembly_losses, sampler_shards, uneven_shards, folder_kinds, example_prompts, first_acceptable, oracle_reports, oracle_entries, chemistry_values, legacy_assays, settings_file, token_map_file, text_scan, metrics_log, status_upsert, metric_hooks, logits_chain, gradient_ops, random_whole, path_forms)}

_ONE = "(select distinct on (record_id) * from compounds order by record_id)"
_UNI = "(concat('0x', substr(md5({}), 1, 8))::ubigint / 4294967296.0::double)"
_GRAMS = "list_distinct(list_transform(range(1, length(SMILES) - 1), lambda i: substr(md5(substr(SMILES, i, 3)), 1, 2)))"
_WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _n(text: str) -> str:
    return f"len(list_filter(string_split(regexp_replace({text}, '{_WS}', ' ', 'g'), ' '), lambda w: w <> ''))"


def _shards(kind: str, size: int, step: int, part: int) -> str:
    return f"""select (pos % {step} // {part})::int as rank, pos // {step} as step, count(*) as n, sum(doc_id)::bigint as id_sum, max(pos % {part}) as last, '{kind}' as kind
        from (select doc_id, pos from r union all select doc_id, n + pos + k * n from r, (select unnest(range({step})) as k) where pos < {step} and pos + k * n < ({step} - n % {step}) % {step}) group by 1, 2"""


def _entry(e: str, similars: str, score: str, scored: bool, smiles: str) -> str:
    told = f"'[PROPERTY]oracle_score ', printf('%.2f', {score}), '[/PROPERTY]', " if scored else ""
    return f"concat({similars}, case when {e}.w is not null then concat('[WEIGHT]', printf('%.2f', {e}.w), '[/WEIGHT]') else '' end, {told}{smiles})"


def _prompt(scored: bool, generation: bool) -> str:
    own = lambda e: f"coalesce(array_to_string(list_transform({e}.t, lambda r: concat('[SIMILAR]', r.SMILES, ' ', printf('%.2f', r.similarity), '[/SIMILAR]')), ''), '')"
    shown = f"coalesce(array_to_string(list_transform(es[1:-2], lambda e: concat('</s>', {_entry('e', own('e'), 'e.q', scored, chr(39) + '[START_SMILES]' + chr(39) + ', e.s, ' + chr(39) + '[END_SMILES]' + chr(39))})), ''), '')"
    if not generation:
        return f"concat({shown}, '</s>', {_entry('z', own('z'), 'z.q', scored, chr(39) + '[START_SMILES]' + chr(39) + ', z.s, ' + chr(39) + '[END_SMILES]' + chr(39))}, '</s>')"
    sim = _UNI.format("concat_ws('#', '42#sim', prompt, i - 1)")
    wished = f"coalesce(array_to_string(list_transform(z.t, lambda r, i: concat('[SIMILAR]', r.SMILES, ' ', printf('%.2f', 0.9::double + {sim} * 0.08999999999999997::double), '[/SIMILAR]')), ''), '')"
    score = f"z.q + {_UNI.format(chr(99) + 'oncat_ws(' + chr(39) + '#' + chr(39) + ', ' + chr(39) + '42#score' + chr(39) + ', prompt)')} * (1.0::double - z.q)"
    return f"concat({shown}, '</s>', {_entry('z', wished, score, scored, chr(39) + '[START_SMILES]' + chr(39))})"


SQL = {
    "module_operations": """
        with m as (select r_name, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
        a as (select unnest(['model', concat('model.', r_name), concat('model.', r_name, '.', n_name), concat('model.', r_name, '.', n_name, '.', c_mktsegment)]) as module from m)
        select module, count(*) as n_calls, (3 * count(*))::bigint as ops from a group by 1""",
    "valid_candidates": f"with x as ({corpus.SQL['extract_last_tag']}) select doc_id as pos, smiles as key from x where contains(smiles, '1') and not contains(smiles, 'Br')",
    "first_candidates": "with l as (select concat('m', user_id) as key, min(event_id) as pos from events where user_id not in (select user_id from events where event_type = 'purchase') group by 1) select key, pos from l order by pos limit 40",
    "pool_parts": "with t as (select concat('m', user_id) as key, max(value) as score from events group by 1), r as (select *, row_number() over (order by score desc, key desc) as rn from t) select case when rn <= 11 then 'valid' else 'train' end as part, key, score from r where rn <= 40",
    "step_budgets": "select n as pool_size, e as epochs, greatest(1, (n - (floor(n * 0.2) + 1)::bigint) * e // 8)::bigint as steps from (select unnest([10, 50, 200])::bigint as n), (select unnest([1, 5])::bigint as e)",
    "training_blocks": """
        with i as (select distinct on (item_id) item_id, coalesce(input_ids, []) as a, attention_mask as m from encoded_items where item_id is not null order by item_id),
        d as (select item_id, (row_number() over (order by item_id) - 1) // 50 as batch_id, a, list_transform(range(1, len(a) + 1), lambda k: coalesce(m[k], 1)) as m from i),
        b as (select batch_id, list_concat([1], flatten(list(a order by item_id))) as a, list_concat([1], flatten(list(m order by item_id))) as m from d group by 1),
        e as (select *, unnest(range(len(a) // 256)) as block_no from b),
        h as (select batch_id, block_no, md5(array_to_string(list_transform(a[block_no * 256 + 1 : (block_no + 1) * 256], lambda x: coalesce(x::varchar, '-')), ',')) as ids_hash, md5(array_to_string(m[block_no * 256 + 1 : (block_no + 1) * 256], ',')) as mask_hash from e)
        select *, ids_hash as labels_hash from h""",
    "pipeline_computed": f"""
        with f as ({corpus.SQL["format_compound"]}), d as (select (row_number() over (order by record_id) - 1) // 50 as batch_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) as n from f),
        g as (select batch_id, (sum(n) + 1)::bigint as n from d group by 1) select batch_id, n // 128 as n_blocks, n // 128 * 128 as n_tokens from g where n >= 128""",
    "assembly_content": rf"""
        with o as (select distinct on (record_id) record_id, assays from assay_compounds where record_id is not null order by record_id),
        b as (select record_id, assays, (row_number() over (order by record_id) - 1) // 30 as batch_id from o),
        a as (select batch_id, unnest(assays) as a from b),
        v as (select batch_id, {_n("concat('[ASSAY_NAME]', a.name, '[/ASSAY_NAME]')")} + {_n("concat('[ASSAY_DESC]', a.description, '[/ASSAY_DESC]')")} + coalesce(list_sum(list_transform(a.variables, lambda v:
            {_n("concat(" + ", ".join(f"case when coalesce(v.{c}, '') <> '' then concat('[{t}]', v.{c}, '[/{t}]') else '' end" for c, t in (("name", "VAR_NAME"), ("description", "VAR_DESC"), ("unit", "VAR_UNIT"), ("value", "VAR_VAL"))) + ")")})), 0) as n
            from a where a is not null and coalesce(length(a.description), 0) <= 2500)
        select batch_id, coalesce(sum(n), 0)::bigint as n_content, 0::bigint as n_unaccounted, false as negative from (select distinct batch_id from b) left join v using (batch_id) group by 1""",
    "sampler_shards": "with r as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents) " + _shards("turns", 32, 128, 32) + " union all " + _shards("split", 32, 32, 8),
    "uneven_shards": "with r as (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents) select (pos % 128 // 32)::int as rank, pos // 128 as step, count(*) as n, sum(doc_id)::bigint as id_sum from r group by 1, 2",
    "folder_kinds": "select * from (values ('a', 'computed'), ('b', 'assay'), ('c', 'computed')) t(folder, kind)",
    "example_prompts": f"""
        with o as (select record_id, {{'s': SMILES, 'q': QED, 'w': WEIGHT, 't': coalesce(list_filter(related, lambda r: r.SMILES is not null and r.similarity is not null), [])[1:2]}} as e from {_ONE} where coalesce(SMILES, '') <> '' and QED is not null and record_id is not null),
        g as (select (record_id - 1) // 3 as prompt, list(e order by record_id) as es from o group by 1), p as (select prompt, es, es[-1] as z from g)
        select prompt, {_prompt(False, False)} as train_text, {_prompt(True, False)} as train_scored, {_prompt(True, True)} as generation_prompt from p""",
    "first_acceptable": f"with r as (select source, record_id as key, QED as score, row_number() over (partition by source order by QED desc, record_id desc) as rn from {_ONE} where WEIGHT < 350 and QED is not null and record_id is not null) select source, key, score from r where rn = 1",
    "oracle_reports": """
        with l as (select event_id + 1 as c, value as s from events), k as (select unnest(range(2500, (select count(*) from l) + 1, 2500)) as k),
        r as (select k, s, row_number() over (partition by k order by s desc) as rn from k join l on c <= k)
        select k as calls, round(avg(s) filter (rn <= 1), 6) as top_1, round(avg(s) filter (rn <= 10), 6) as top_10, round(avg(s) filter (rn <= 100), 6) as top_100 from r group by 1""",
    "oracle_entries": f"with o as (select record_id, SMILES, length(regexp_replace(SMILES, '[^NO]', '', 'g')) as n from {_ONE} where coalesce(SMILES, '') <> '') select record_id, round(n::double / length(SMILES), 9) as score, concat('[POLAR]', least(n + 1, 9), '[/POLAR]') as asked from o",
    "chemistry_values": f"select record_id, nullif(regexp_extract(SMILES, '^\\s*(\\S*)', 1), '') as chem_canonical, QED as chem_qed, TPSA as chem_tpsa, WEIGHT as chem_weight, RINGCOUNT as chem_rings, SAS as chem_sas, null::varchar as chem_inchi, case when SMILES is null then 0 else len({_GRAMS}) end as n_bits from {_ONE}",
    "legacy_assays": """
        with o as (select distinct on (record_id) record_id, assays from assay_compounds order by record_id),
        e as (select record_id, unnest(range(len(assays))) as i, unnest(assays) as a from o),
        r as (select record_id, a, row_number() over (partition by record_id order by coalesce(length(a.description), 0) desc, i desc) - 1 as place from e where a is not null and coalesce(length(a.description), 0) <= 2500)
        select record_id, place, md5(concat('[ASSNAME ', a.name, '][ASSDESC ', a.description, ']', coalesce(array_to_string(list_transform(a.variables, lambda v: concat('[VAR ', v.name, ' DESC ', v.description, ' VAL ', v.value, ']')), ''), ''))) as text_hash from r""",
    "settings_file": "select * from (values ('pool_size', '30'), ('eos', '</s>'), ('rates', '[0.0001, 0.5]'), ('resume', 'False'), ('tokenizer', '{''path'': ''tok # 1'', ''eos'': ''</s>''}'), ('kinds', '[''computed'', ''assay'']')) t(name, value)",
    "token_map_file": "select * from (values ('[A]', '[/A]'), ('[B]', '[/B]'), ('[START_SMILES]', '[END_SMILES]')) t(start_tag, end_tag)",
    "text_scan": "select (props ->> '$.k')::bigint as k, count(*) as n, 0::bigint as n_blank from events group by 1",
    "metrics_log": """
        with e as (select case when event_id % 2 = 0 then 'even' else 'odd' end as run, event_id // 1000 as k, min(value) as least, max(value) as most from events group by 1, 2), u as (select run, 'least' as metric, least as v from e union all select run, 'most', most from e)
        select run, metric, count(*) as n, round(sum(v), 4) as total from u group by 1, 2""",
    "status_upsert": """
        with e as (select user_id, event_type, row_number() over (partition by user_id, (user_id + event_id) % 3 order by event_id desc) as rn, (user_id + event_id) % 3 as part from events), l as (select user_id, event_type, row_number() over (partition by user_id order by part desc) as k from e where rn = 1 and part < 2)
        select event_type as state, count(*) as n_users, sum(user_id)::bigint as user_sum from l where k = 1 group by 1""",
    "metric_hooks": "with r as (select l_returnflag, l_extendedprice as t, l_quantity * 1500 as g from lineitem) select l_returnflag, count(*) as n, round(avg(abs(t - g)), 4) as mae, round(sqrt(avg((t - g) * (t - g))), 4) as rmse, round(avg(g - t), 4) as bias, count(*) filter (g > t) as above from r group by 1",
    "logits_chain": """
        with e as (select vec_id, embedding[3]::double as a, embedding[6]::double as b, embedding[10]::double as c, vec_id % 64 as f from embeddings)
        select vec_id, round(a + abs(a) * (power(1.02::double, 3) - 1), 6) as s2, round(b + case when f = 2 then abs(b) * (power(1.1::double, 2) - 1) else 0 end, 6) as s5, round(c + abs(c) * 3, 6) as s9, f = 7 as out7 from e""",
    "gradient_ops": """
        with r as (select 'addmm' as op, 0 as i, 16 * 64 * 10 as ops union all select 'bmm', 0, 4 * 16 * 64 * 10
            union all select 'conv_back', 0, 2 * (8 * 3 * 3 * 3) * (30 * 30) + 3 * (2 * 8 * 30 * 30) * (3 * 3)
            union all select 'conv_back', 1, 2 * (8 * 3 * 2 * 2) * (15 * 15))
        select op, i, ops::bigint as ops, round(ops / 0.5::double / 1e6::double * 100, 4) as mfu from r""",
    "random_whole": f"select floor({_UNI.format("concat_ws('#', '42#whole', event_id)")} * 10)::int as k, count(*) as n, sum(event_id)::bigint as id_sum from events group by 1",
    "path_forms": "with p as (select file, max(line_number) as step from raw_lines group by 1) select concat('/runs/', file, '/checkpoint-', step) as path, string_split(file, '/')[-1] as run, step::varchar as step, concat('round-2.', substr(string_split(file, '/')[-1], 1, 6), '.step-', step, '.csv') as samples from p",
}
