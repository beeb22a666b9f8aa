"""The given tables read as a read archive: one SQL text per relation, for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RELATIONS = {
    # one row per read
    "reads": """select o_orderkey as read_id, cast(o_custkey as int) as channel, cast(o_custkey % 4 + 1 as int) as well, o_orderkey as read_number,
        case o_orderpriority when '1-URGENT' then 'signal_positive' when '2-HIGH' then 'signal_negative' when '3-MEDIUM' then 'mux_change'
             when '4-NOT SPECIFIED' then 'not specified' else 'unblock_mux_change' end as end_reason,
        o_orderstatus as pore_type, cast(floor(o_totalprice) as bigint) as num_samples, o_orderkey * 4000 as start_sample,
        floor(o_totalprice) / 1000 + 0.0001 as median_before, cast(o_custkey % 7 as int) as run_info, concat('acq', cast(o_custkey % 5 as string)) as acquisition_id,
        concat('file', cast(o_orderkey % 4 as string)) as source_file, cast(floor(o_orderkey / 1000) as int) as batch_idx, cast(o_orderkey % 1000 as int) as row_idx
        from {orders}""",
    # one row per signal chunk
    "signal": """select l_orderkey as read_id, cast(l_linenumber as int) as chunk_idx, cast(sum(l_quantity) as bigint) as samples from {lineitem} group by l_orderkey, l_linenumber""",
    # one row per alignment
    "alignments": """select l_orderkey as read_id, cast(l_linenumber * 10000000 + l_partkey as bigint) as ord, case when l_linenumber = 7 then null else cast(l_quantity as int) end as mapq,
        l_returnflag <> 'N' as mapped, l_linestatus = 'F' and l_linenumber > 3 as reverse, l_linenumber = 5 as secondary, l_linenumber = 6 as supplementary,
        l_partkey as start, l_partkey + cast(l_quantity as bigint) as end_pos from {lineitem}""",
    # one numeric array per read
    "vectors": """select vec_id as id, embedding as x, label from {embeddings}""",
    # samples of one signal per entity
    "samples": """select user_id as id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i, value as v from {events}""",
    # nullable labels of reads
    "labels": """select doc_id as read_id, case when quality = 1 then 'BC01' when toxic = 1 then 'BC02' else '' end as barcode from {labels}""",
    # two classifications of the same reads
    "calls": """select l_orderkey as read_id, l_linenumber as ord, concat('BC', cast(l_suppkey % 4 as string)) as reference,
        concat('BC', cast(case when l_quantity < 40 then l_suppkey % 4 else l_partkey % 4 end as string)) as ours,
        l_discount * 10 as confidence, l_tax * 12 as our_confidence, cast(l_partkey % 100 as bigint) - cast(l_suppkey % 100 as bigint) as difference from {lineitem}""",
    # a small design table
    "design": """select distinct p_size as well, concat('C', cast(p_size % 3 as string)) as condition, case when p_size = 2 then '' else 'r1' end as replicate from {part} where p_size <= 3""",
}
TABLES = {"orders", "lineitem", "embeddings", "events", "labels", "part", "customer", "nation", "supplier", "region"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RELATIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_relations(sql: str) -> str:
    """Oracle SQL: ``sql`` with the relations it names in angle brackets in front."""
    named = [n for n in RELATIONS if f"<{n}>" in sql]
    parts = [f"b_{n} as ({RELATIONS[n].format(**{t: t for t in TABLES})})" for n in named]
    for n in named:
        sql = sql.replace(f"<{n}>", f"b_{n}")
    if sql.startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {sql.removeprefix('with recursive ')}" if parts else sql
    if sql.startswith("with "):  # a query's own tables come after the relations
        return f"with {', '.join(parts)}, {sql.removeprefix('with ')}" if parts else sql
    return f"with {', '.join(parts)} {sql}" if parts else sql
