"""Queries of the problems of training-data preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.llm import mix, overlap, packing, reading, split, tokenize
from lixivium.plans import search
from lixivium.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cut_items(packing.plan(packing.items_of(table(spark, sf_dir, "encoded_items"))))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its items and fill."""
    return packing.blocks(packing.plan(packing.items_of(table(spark, sf_dir, "encoded_items"))))


def p1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's tokens, and of which item each is."""
    items = table(spark, sf_dir, "encoded_items")
    return packing.block_tokens(packing.plan(packing.items_of(items)), items)


def p1_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item its placed tokens, the pieces it was cut into, and whether its pieces lie one after the other in full."""
    planned = packing.plan(packing.items_of(table(spark, sf_dir, "encoded_items")))
    per = planned.groupBy("item_id").agg(F.sum("size").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.countDistinct("piece").alias("k"), F.max("piece").alias("last"), F.count_if((F.col("at") < 0) | (F.col("at") + F.col("size") > packing.CAPACITY)).alias("n_outside"))
    return per.select("item_id", "n_tokens", "n_pieces", ((F.col("k") == F.col("n_pieces")) & (F.col("last") + 1 == F.col("k"))).alias("complete"), "n_outside")


def p1_overfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with more tokens than they hold, or whose items overlap: none; and the tokens in all blocks."""
    planned = packing.plan(packing.items_of(table(spark, sf_dir, "encoded_items")))
    per = planned.groupBy("block_id").agg(F.sum("size").alias("n"), F.max(F.col("at") + F.col("size")).alias("end"), F.min("at").alias("start"), F.countDistinct("at").alias("k"), F.count(F.lit(1)).alias("items"))
    odd = (F.col("n") > packing.CAPACITY) | (F.col("n") != F.col("end")) | (F.col("start") != 0) | (F.col("k") != F.col("items"))
    return per.agg(F.count_if(odd).alias("n_odd"), F.sum("n").alias("n_tokens"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.pairs(overlap.staged(table(spark, sf_dir, "compounds")))


def p2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per evaluation record that overlaps training."""
    return overlap.overlaps(overlap.staged(table(spark, sf_dir, "compounds")))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives, exact and near, with the numbers of records of both."""
    return overlap.class_links(overlap.staged(table(spark, sf_dir, "compounds")))


def p2_cid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these the pairs by CID."""
    return p2_links(spark, sf_dir).where(F.col("field") == "cid").select(F.col("e_class").alias("class_id"), "same", "n_eval", "n_train")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of each record, by its text and by its CID."""
    return overlap.members(overlap.staged(table(spark, sf_dir, "compounds")))


def p2_cid_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these the classes by CID."""
    return p2_members(spark, sf_dir).where(F.col("field") == "cid")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per split and source."""
    return overlap.report(overlap.staged(table(spark, sf_dir, "compounds")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(table(spark, sf_dir, "assay_compounds"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text above the limit."""
    return split.split_records(table(spark, sf_dir, "assay_compounds"))


def p3_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text above the limit its length, and whether its pieces cover it from end to end, none too long, none sharing too much."""
    parts = p3_pieces(spark, sf_dir)
    per = parts.groupBy("record_id", "assay_pos", "field").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("p"))  # the pieces of one text
    joints = F.zip_with(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p))"), lambda a, b: (b["start"] <= a["end"]) & (a["end"] - b["start"] <= split.OVERLAP) & (b["start"] > a["start"]) & (b["end"] > a["end"]))
    whole = (F.element_at("p", 1)["start"] == 0) & F.forall(joints, lambda x: x) & F.forall("p", lambda x: (x["end"] - x["start"]).between(1, split.LIMIT))
    return per.select("record_id", F.col("assay_pos").cast("bigint").alias("assay_pos"), "field", F.element_at("p", -1)["end"].cast("bigint").alias("n"), whole.alias("covered"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whether decoding the document's ids gives its text back; null texts come back empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokenize.decode(tokenize.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus, one row per block."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_overused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target the documents of the mixed corpus that are used more often than allowed: none."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed = mix.mix(table(spark, sf_dir, "documents"), targets)
    uses = mixed.select("source", "block", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).groupBy("source", "block", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    often = uses.groupBy(F.col("source").alias("key")).agg(F.max("n").alias("most"))
    both = targets.join(often, mix.source_key(F.col("source")) == F.col("key"), "left")
    return both.select("source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("overused"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source are of each level."""
    docs = table(spark, sf_dir, "documents")
    rows = reading.found(docs, table(spark, sf_dir, "reading_labels"))
    return rows.join(docs.select("doc_id", mix.source_key(F.col("source")).alias("source")), "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"))


def rejection_samples_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core's rejection_samples with a tokenizer: samples of at most 500 tokens."""
    return search.rejection_samples(spark, sf_dir, tokenize.counts)


QUERIES = {f.__name__: f for f in (p1_found, p1_blocks, p1_tokens, p1_placed, p1_overfull, p2_found, p2_overlaps, p2_links, p2_cid_links, p2_members, p2_cid_members, p2_report, p3_found, p3_pieces, p3_covered, p7_ids, p7_round_trip, p8_mix, p8_shares, p8_overused, p9_found, p9_profile, rejection_samples_500)}

_KEPT = "len(list_filter(range(1, coalesce(len(input_ids), 0) + 1), lambda i: input_ids[i] is not null and coalesce(attention_mask[i], 1) = 1))"

SQL = {
    "p1_found": f"select distinct item_id from encoded_items where item_id is not null and {_KEPT} > 2048",
    "p1_placed": f"with i as (select distinct on (item_id) item_id, {_KEPT} as n from encoded_items where item_id is not null order by item_id) select item_id, n::bigint as n_tokens, ((n + 2047) // 2048)::bigint as n_pieces, true as complete, 0::bigint as n_outside from i where n > 0",
    "p1_overfull": f"with i as (select distinct on (item_id) item_id, {_KEPT} as n from encoded_items where item_id is not null order by item_id) select 0::bigint as n_odd, sum(n)::bigint as n_tokens from i",
    "p2_cid_members": """
        with c as (select distinct on (record_id) record_id, CID, lower(trim(split)) as s from compounds where record_id is not null order by record_id)
        select record_id, case when s like 'train%' then 'train' when s like 'val%' or s = 'dev' then 'validation' else 'test' end as part, 'cid' as field, md5(concat('cid:', CID)) as class_id from c where CID > 0 and (s like 'train%' or s like 'val%' or s = 'dev' or s like 'test%')""",
    "p2_cid_links": """
        with c as (select distinct on (record_id) record_id, CID, lower(trim(split)) as s from compounds where record_id is not null order by record_id),
        k as (select CID, count(*) filter (s like 'train%') as n_train, count(*) filter (s like 'val%' or s = 'dev' or s like 'test%') as n_eval from c where CID > 0 group by 1)
        select md5(concat('cid:', CID)) as class_id, true as same, n_eval, n_train from k where n_train > 0 and n_eval > 0""",
    "p3_covered": """
        with a as (select distinct record_id, unnest(range(len(assays))) as assay_pos, unnest(assays) as x from assay_compounds where record_id is not null),
        t as (select record_id, assay_pos, 'description' as field, length(x.description) as n from a
            union all select record_id, assay_pos, 'variables', length(array_to_string(list_transform(x.variables, lambda v: array_to_string([c for c in [v.name, v.description, v.value, v.unit] if c is not null], ' | ')), chr(10))) from a)
        select *, true as covered from t where n > 2500""",
    "p7_round_trip": "select doc_id, true as same from documents",
    "p8_overused": "select source, false as overused from mix_targets",
    "p3_found": """
        with a as (select distinct record_id, unnest(range(len(assays))) as assay_pos, unnest(assays) as x from assay_compounds where record_id is not null),
        v as (select record_id, assay_pos, x.description as d, coalesce(list_sum(list_transform(x.variables, lambda v:
            coalesce(length(v.name), 0) + coalesce(length(v.description), 0) + coalesce(length(v.value), 0) + coalesce(length(v.unit), 0))), 0) as n from a)
        select record_id, assay_pos, 'description' as field from v where length(d) > 2500
        union all select record_id, assay_pos, 'variables' as field from v where n > 2500""",
}
