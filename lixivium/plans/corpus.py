"""Queries of corpus building: packing, sharding, mixing, tagged text, decoding, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lixivium.det import bernoulli
from lixivium.functions import arrays, names, tags
from lixivium.operators import blocks, ingest
from lixivium.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", blocks.words(F.col("text")).alias("tokens"))


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "compounds").dropDuplicates(["record_id"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_lines").dropDuplicates(["line_id"])


def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.group_texts(_docs(spark, sf_dir), "doc_id", "tokens", 128)
    return rows.select("batch_id", F.col("block_no").cast("bigint").alias("block_no"), F.md5(F.array_join("tokens", " ")).alias("block_hash"))


def packing_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.packing_loss(_docs(spark, sf_dir), "doc_id", "tokens", 128)


def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.micro_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 30)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("n_chars"))


def rank_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.rank_shards(_lines(spark, sf_dir).select("line_id", "file", "line_number"), "file", "line_number", 8)
    return rows.groupBy("file", "rank").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_number").alias("first_line"), F.sum("line_id").alias("id_sum"))


def shard_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file the lines, the (shard, line) pairs, and the lines in more than one shard: none."""
    rows = blocks.rank_shards(_lines(spark, sf_dir).select("line_id", "file", "line_number"), "file", "line_number", 8)
    each = rows.groupBy("file", "line_id").agg(F.countDistinct("rank").alias("k"))
    return each.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("k").alias("n_pairs"), F.count_if(F.col("k") > 1).alias("n_shared"))


def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", names.source_key(F.col("source")).alias("source")).where(F.col("source").isNotNull())
    return blocks.interleave(docs, "source", "doc_id").select("position", "source", "doc_id")


def fixed_batches_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks.shuffled_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("id_sum"), F.min("doc_id").alias("first_doc"))


def format_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compounds(spark, sf_dir).select("record_id", tags.compound_text(F.col("record_id")).alias("text"))


def smiles_first_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = bernoulli("42#first", 0.5, F.col("record_id"))
    return _compounds(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(first).alias("n_first"))


def related_sample10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compounds(spark, sf_dir).where(F.size("related") > 0)
    return rows.select("record_id", F.size("related").cast("bigint").alias("n_related"), tags.related_text(F.col("related"), F.col("record_id")).alias("text"))


def assay_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assay_compounds").dropDuplicates(["record_id"]).select("record_id", F.posexplode(tags.usable_assays(F.col("assays"))).alias("place", "a"))
    text = F.concat(tags.assay_head(F.col("a")), F.array_join(F.transform(F.coalesce("a.variables", F.array().cast("array<struct<name:string,description:string,value:string,unit:string>>")), tags.variable_text), ""))
    return rows.select("record_id", F.col("place").cast("bigint").alias("place"), text.alias("text"))


def legacy_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compounds(spark, sf_dir).select("record_id", tags.legacy_text().alias("text"))


def decode_double_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.decoded(_lines(spark, sf_dir).select("line_id", "text"))
    return rows.select("line_id", "status", F.get_json_object("object", "$.SMILES").alias("smiles"), F.get_json_object("object", "$.CID").alias("cid"))


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.decoded(_lines(spark, sf_dir).select("line_id", "file", "text"))
    return rows.groupBy("file", "status").agg(F.count(F.lit(1)).alias("n_lines"))


def extract_last_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tags.last_between(F.col("text"), "[START_SMILES]", "[END_SMILES]").alias("smiles"))
    return rows.where(F.col("smiles") != "")


def extract_first_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tags.first_between(F.col("text"), "[SYNONYM]", "[/SYNONYM]").alias("synonym"))
    return rows.where(F.col("synonym").isNotNull())


def parsed_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a tag; texts that are none are filtered out, never an error."""
    value = tags.first_between(F.col("text"), "[WEIGHT]", "[/WEIGHT]").try_cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("weight")).where(F.col("weight").isNotNull())


def sft_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compounds(spark, sf_dir).where((F.coalesce("SMILES", F.lit("")) != "") & F.col("QED").isNotNull())
    head = F.concat(F.lit("</s>[START_SMILES]"), F.col("SMILES"), F.lit("[END_SMILES][PROPERTY]activity "))
    return rows.select("record_id", F.concat(head, tags.two_decimals(F.col("QED")), F.lit("[/PROPERTY]</s>")).alias("train_text"), head.alias("eval_prompt"))


def tag_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag to index and back, the name a tag has in metrics, and its documents in the corpus."""
    reg = tags.registry(spark)
    metric = F.when(F.col("field") == "SMILES", F.lit("SMILES")).otherwise(F.expr("substring(start_tag, 2, length(start_tag) - 2)"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[[A-Z_]+\]"), F.lit(0)))).alias("start_tag")).groupBy("start_tag").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(reg).join(found, "start_tag", "right").where(F.col("tag_index").isNotNull()).select("tag_index", "start_tag", "end_tag", metric.alias("metric"), F.col("n").alias("n_documents"))


def nonempty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records keep each field after empty lists and texts are removed."""
    fields = ["SMILES", "IUPAC", "formula", "synonyms", "related", "experimental"]
    as_text = F.create_map(*[x for f in fields for x in (F.lit(f), F.to_json(f) if f in tags.LISTS else F.col(f))])
    kept = table(spark, sf_dir, "compounds").dropDuplicates(["record_id"]).select(F.explode(F.map_keys(ingest.without_empty(as_text))).alias("field"))
    return kept.groupBy("field").agg(F.count(F.lit(1)).alias("n_records"))


def token_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head truncation, left truncation of prompts, and dropping tokens before the last one."""
    rows = table(spark, sf_dir, "encoded_items").dropDuplicates(["item_id"]).where(F.size("input_ids") > 0)
    ids = F.col("input_ids")
    h = lambda a: F.md5(F.array_join(a, ","))
    return rows.select("item_id", h(arrays.head(ids, 64)).alias("head_hash"), h(arrays.tail(ids, 48)).alias("tail_hash"), h(arrays.drop_before_last(ids, 5)).alias("drop_hash"))


def exact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept because their first 64 tokens fill the context exactly."""
    rows = table(spark, sf_dir, "encoded_items").dropDuplicates(["item_id"]).withColumn("ids", arrays.head(F.col("input_ids"), 64)).where(F.size("ids") == 64)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.expr("aggregate(ids, 0L, (a, x) -> a + coalesce(x, 0))")).alias("token_sum"))


def tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag is opened and closed, per kind of tag."""
    all_tags = F.regexp_extract_all("text", F.lit(r"\[/?[A-Z_]+\]"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select(F.explode(all_tags).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (pack_blocks, packing_loss, micro_batches, rank_shard, shard_disjointness, interleave_sources, fixed_batches_drop_last, format_compound, smiles_first_share, related_sample10, assay_tags, legacy_format, decode_double_json, quarantine_counts, extract_last_tag, extract_first_tag, parsed_property, sft_prompt, tag_registry, nonempty_fields, token_truncations, exact_context, tag_spans)}

_WORDS = "list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')"
_LINES = "(select distinct line_id, file, line_number, text from raw_lines)"
_ONE = "(select distinct on (record_id) * from compounds order by record_id)"
_KEY = "md5(concat_ws('#', '42', record_id, '{}'))"
_UNIFORM = "(concat('0x', substr(md5({}), 1, 8))::ubigint / 4294967296.0::double)"
_RELATED = """(select list_filter(coalesce(related, []), lambda r: r.SMILES is not null and r.similarity is not null) as g)"""


def _tag_sql(f: str) -> str:
    text = f"printf('%.2f', {f})" if f in tags.DECIMAL else f"{f}::varchar"
    return f"case when {f} is not null and {f}::varchar <> '' then concat('{tags.open_tag(f)}', {text}, '{tags.close_tag(f)}') else '' end"


_SYN_SQL = "coalesce(array_to_string(list_transform(list_filter(list_transform(synonyms, lambda s: s.name), lambda n: coalesce(n, '') <> ''), lambda n: concat('[SYNONYM]', n, '[/SYNONYM]')), ''), '')"
_EXP_SQL = "coalesce(array_to_string(list_transform(list_filter(experimental, lambda e: e.PROPERTY_NAME is not null and e.PROPERTY_VALUE is not null), lambda e: concat('[PROPERTY]', e.PROPERTY_NAME, ' ', e.PROPERTY_VALUE, '[/PROPERTY]')), ''), '')"
_GOOD_SQL = "list_filter(related, lambda r: r.SMILES is not null and r.similarity is not null)"
_SAMPLE_SQL = f"case when len({_GOOD_SQL}) > 10 then list_transform(list_sort(list_transform({_GOOD_SQL}, lambda r, i: {{'k': md5(concat_ws('#', '42#related', record_id, i - 1)), 'i': i, 'x': r}}))[1:10], lambda s: s.x) else {_GOOD_SQL} end"
_REL_SQL = f"coalesce(array_to_string(list_transform({_SAMPLE_SQL}, lambda r: concat('[SIMILAR]', r.SMILES, ' ', printf('%.2f', r.similarity), '[/SIMILAR]')), ''), '')"
_PARTS = {f: _tag_sql(f) for f in tags.SCALARS} | {"synonyms": _SYN_SQL, "related": _REL_SQL, "experimental": _EXP_SQL}
_FIRST = _UNIFORM.format("concat_ws('#', '42#first', record_id)") + " < 0.5"
_ITEMS = ", ".join("{'k': " + (f"case when {_FIRST} then '' else {_KEY.format(f)} end" if f == "SMILES" else _KEY.format(f)) + f", 't': {t}}}" for f, t in _PARTS.items())
_LEGACY = "concat(" + ", ".join(["coalesce(array_to_string(list_transform(list_filter(list_transform(synonyms, lambda s: s.name), lambda n: coalesce(n, '') <> ''), lambda n: concat('[SYNONYM ', n, ']')), ''), '')", f"coalesce(array_to_string(list_transform({_GOOD_SQL}, lambda r: concat('[SIMILARITY ', printf('%.2f', r.similarity), ' SMILES ', r.SMILES, ']')), ''), '')", "coalesce(array_to_string(list_transform(list_filter(experimental, lambda e: e.PROPERTY_NAME is not null and e.PROPERTY_VALUE is not null), lambda e: concat('[EXPERIMENTAL ', e.PROPERTY_NAME, ' ', e.PROPERTY_VALUE, ']')), ''), '')", *(f"case when {f} is not null and {f}::varchar <> '' then concat('[{f.upper()} ', {f}::varchar, ']') else '' end" for f in tags.SCALARS if f not in tags.DECIMAL | {"SMILES"})]) + ")"
_VAR = "concat(" + ", ".join(f"case when coalesce(v.{c}, '') <> '' then concat('[{t}]', v.{c}, '[/{t}]') else '' end" for c, t in (("name", "VAR_NAME"), ("description", "VAR_DESC"), ("unit", "VAR_UNIT"), ("value", "VAR_VAL"))) + ")"
_DECODE = f"""
    (with l as (select line_id, file, regexp_replace(regexp_replace(coalesce(text, ''), '^[\\s\\x{{FEFF}}]+', ''), '[\\s\\x{{FEFF}}]+$', '') as s from {_LINES}),
    u as (select line_id, file, s, case when s like '"%' then try_cast(s as json) ->> '$' else s end as o from l)
    select line_id, file, case when s = '' then 'empty' when o is null or not json_valid(o) then 'broken' when not starts_with(ltrim(o), '{{') then 'not_object' else 'ok' end as status, o from u)"""

SQL = {
    "pack_blocks": f"""
        with d as (select doc_id, (row_number() over (order by doc_id) - 1) // 50 as batch_id, {_WORDS} as t from documents),
        b as (select batch_id, list_concat(['</s>'], flatten(list(t order by doc_id))) as t from d group by 1),
        e as (select batch_id, t, unnest(range(len(t) // 128)) as block_no from b)
        select batch_id, block_no, md5(array_to_string(t[block_no * 128 + 1 : (block_no + 1) * 128], ' ')) as block_hash from e""",
    "packing_loss": f"""
        with d as (select (row_number() over (order by doc_id) - 1) // 50 as batch_id, len({_WORDS}) as n from documents),
        b as (select batch_id, (sum(n) + 1)::bigint as n_tokens from d group by 1)
        select batch_id, n_tokens, n_tokens // 128 as n_blocks, n_tokens % 128 as n_dropped from b""",
    "micro_batches": "with d as (select doc_id, n_chars, (row_number() over (order by doc_id) - 1) // 30 as batch_id from documents) select batch_id, count(*) as n_docs, min(doc_id) as first_doc, sum(n_chars)::bigint as n_chars from d group by 1",
    "rank_shard": f"with r as (select *, ((row_number() over (partition by file order by line_number) - 1) % 8)::int as rank from {_LINES}) select file, rank, count(*) as n_lines, min(line_number) as first_line, sum(line_id)::bigint as id_sum from r group by 1, 2",
    "shard_disjointness": f"with r as (select *, (row_number() over (partition by file order by line_number) - 1) % 8 as rank from {_LINES}), e as (select file, line_id, count(distinct rank) as k from r group by 1, 2) select file, count(*) as n_lines, sum(k)::bigint as n_pairs, count(*) filter (k > 1) as n_shared from e group by 1",
    "interleave_sources": r"""
        with d as (select doc_id, regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') as source from documents where source is not null),
        r as (select *, row_number() over (partition by source order by doc_id) as rn, dense_rank() over (order by source) as s from d),
        m as (select min(c) as rounds, count(*) as k from (select source, count(*) as c from d group by 1))
        select (rn - 1) * k + s as position, source, doc_id from r, m where rn <= rounds""",
    "fixed_batches_drop_last": """
        with r as (select doc_id, row_number() over (order by md5(concat('42#', doc_id)), doc_id) as rn, count(*) over () as n from documents)
        select (rn - 1) // 32 as batch_id, count(*) as n_docs, sum(doc_id)::bigint as id_sum, min(doc_id) as first_doc from r where rn <= n // 32 * 32 group by 1""",
    "format_compound": f"select record_id, concat(array_to_string(list_transform(list_sort([{_ITEMS}]), lambda i: i.t), ''), '</s>') as text from {_ONE}",
    "smiles_first_share": f"select source, count(*) as n_records, count(*) filter ({_FIRST}) as n_first from {_ONE} group by 1",
    "related_sample10": f"select record_id, len(related) as n_related, {_REL_SQL} as text from {_ONE} where len(related) > 0",
    "assay_tags": f"""
        with o as (select distinct on (record_id) record_id, assays from assay_compounds order by record_id),
        e as (select record_id, unnest(range(len(assays))) as i, unnest(assays) as a from o),
        r as (select record_id, a, row_number() over (partition by record_id order by coalesce(length(a.description), 0) desc, i desc) - 1 as place from e where a is not null and coalesce(length(a.description), 0) <= 2500)
        select record_id, place, concat('[ASSAY_NAME]', a.name, '[/ASSAY_NAME][ASSAY_DESC]', a.description, '[/ASSAY_DESC]', coalesce(array_to_string(list_transform(a.variables, lambda v: {_VAR}), ''), '')) as text from r""",
    "legacy_format": f"select record_id, {_LEGACY} as text from {_ONE}",
    "decode_double_json": f"select line_id, status, case when status = 'ok' then o::json ->> '$.SMILES' end as smiles, case when status = 'ok' then o::json ->> '$.CID' end as cid from {_DECODE}",
    "quarantine_counts": f"select file, status, count(*) as n_lines from {_DECODE} group by 1, 2",
    "extract_last_tag": """
        with p as (select doc_id, text, length(text) - position(reverse('[START_SMILES]') in reverse(text)) + 2 as s, length(text) - position(reverse('[END_SMILES]') in reverse(text)) - length('[END_SMILES]') + 2 as e
            from documents where contains(text, '[START_SMILES]') and contains(text, '[END_SMILES]'))
        select doc_id, substr(text, s, e - s) as smiles from p where e > s""",
    "extract_first_tag": """
        with a as (select doc_id, substr(text, position('[SYNONYM]' in text) + 9) as t from documents where contains(text, '[SYNONYM]'))
        select doc_id, substr(t, 1, position('[/SYNONYM]' in t) - 1) as synonym from a where contains(t, '[/SYNONYM]')""",
    "parsed_property": """
        with a as (select doc_id, substr(text, position('[WEIGHT]' in text) + 8) as t from documents where contains(text, '[WEIGHT]')),
        b as (select doc_id, try_cast(substr(t, 1, position('[/WEIGHT]' in t) - 1) as double) as weight from a where contains(t, '[/WEIGHT]'))
        select * from b where weight is not null""",
    "sft_prompt": f"select record_id, concat('</s>[START_SMILES]', SMILES, '[END_SMILES][PROPERTY]activity ', printf('%.2f', QED), '[/PROPERTY]</s>') as train_text, concat('</s>[START_SMILES]', SMILES, '[END_SMILES][PROPERTY]activity ') as eval_prompt from {_ONE} where coalesce(SMILES, '') <> '' and QED is not null",
    "tag_registry": """
        with f as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\\[[A-Z_]+\\]'))) as start_tag from documents), n as (select start_tag, count(*) as n_documents from f group by 1),
        r as (select * from (values """
    + ", ".join(f"({i}, '{f}', '{tags.open_tag(f)}', '{tags.close_tag(f)}')" for i, f in enumerate((*tags.SCALARS, "SYNONYM", "RELATED", "SIMILAR", "PROPERTY", "VAR_NAME", "VAR_DESC", "VAR_UNIT", "VAR_VAL", "ASSAY_NAME", "ASSAY_DESC")))
    + ") t(tag_index, field, start_tag, end_tag)) select tag_index, start_tag, end_tag, case when field = 'SMILES' then 'SMILES' else start_tag[2:-2] end as metric, n_documents from r join n using (start_tag)",
    "nonempty_fields": f"""
        with o as {_ONE}, k as (select unnest([{", ".join(f"case when {f} is not null and " + (f"len({f}) > 0" if f in tags.LISTS else f"{f} <> ''") + f" then '{f}' end" for f in ("SMILES", "IUPAC", "formula", "synonyms", "related", "experimental"))}]) as field from o)
        select field, count(*) as n_records from k where field is not null group by 1""",
    "token_truncations": """
        with i as (select distinct on (item_id) item_id, input_ids as a, len(input_ids) as n from encoded_items order by item_id)
        select item_id, md5(array_to_string(a[1:64], ',')) as head_hash, md5(array_to_string(a[greatest(n - 47, 1):n], ',')) as tail_hash,
            md5(array_to_string(list_concat(a[1:greatest(n - 6, 0)], a[n:n]), ',')) as drop_hash from i where n > 0""",
    "exact_context": "with i as (select distinct on (item_id) item_id, source, input_ids as a from encoded_items order by item_id) select source, count(*) as n_items, sum(list_sum(a[1:64]))::bigint as token_sum from i where len(a) >= 64 group by 1",
    "tag_spans": "with t as (select unnest(regexp_extract_all(text, '\\[/?[A-Z_]+\\]')) as tag from documents) select tag, count(*) as n from t group by 1",
}
