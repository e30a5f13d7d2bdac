"""The library's tables as views of the driver's tables, in Spark and in DuckDB SQL (the WITH clause of every oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("method"), F.col("props").alias("path"), "value")


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    plan = F.element_at(F.lit(["free", "basic", "pro", "team"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), plan.alias("plan"), (F.expr("timestamp'2024-01-15 00:00:00'") - F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))).alias("created_at"), (F.col("c_custkey") % 10 != 9).alias("is_active"), ((F.col("c_custkey") % 4 + 1) * 2000).alias("quota_bytes"))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Structured claims: each order states its customer's priority, valid until the customer's next order."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("ts"))
    later = Window.partitionBy("o_custkey").orderBy("ts", "o_orderkey")
    o = o.withColumn("valid_to", F.lead("ts").over(later)).withColumn("next_key", F.lead("o_orderkey").over(later))
    authority = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.5)
    entity = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("user_id"), entity.alias("entity"), F.lit("order priority").alias("attribute"), F.col("o_orderpriority").alias("value"),
        F.concat(entity, F.lit(" order priority is "), F.col("o_orderpriority"), F.lit(".")).alias("content"), "ts", F.col("ts").alias("valid_from"), "valid_to", F.col("next_key").alias("superseded_by"), F.col("ts").alias("tx_time"),
        F.lit("orders").alias("source"), authority.alias("authority"), (F.col("o_orderkey") % 97 == 0).alias("pinned"),
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Text claims with vectors: documents that have an embedding."""
    d, e, l = (read(spark, sf, n) for n in ("documents", "embeddings", "labels"))
    ts = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 4000).cast("int"))
    quality = l.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    authority = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.2).otherwise(0.5)
    return d.join(e, d.doc_id == e.vec_id).join(quality, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("user_id"), F.col("text").alias("content"), F.col("source").alias("entity"), F.col("lang").alias("attribute"), "source", authority.alias("authority"), ts.alias("ts"), ts.alias("valid_from"), F.when(F.col("doc_id") % 11 == 0, ts + F.expr("interval 500 hours")).alias("valid_to"), (F.col("doc_id") % 97 == 0).alias("pinned"), "embedding", "label")


def questions(p: DataFrame) -> DataFrame:
    """Every passage whose id is divisible by 50 asks: its whole text, white space made one, and its vector."""
    return p.filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "user_id", F.array_join(F.filter(F.split("content", "[ \\n\\t\\r]+"), lambda w: w != ""), " ").alias("text"), F.col("embedding").alias("vector"), F.expr("timestamp'2024-02-01 00:00:00'").alias("as_of"))


def turns(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    c = read(spark, sf, "conversations")
    if stream:  # as a glob: a table may be one file or a folder of files
        c = spark.readStream.schema(c.schema).parquet(f"{sf}/conversations.parque[t]")
    ts = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval((F.col("conv_id") % 1000).cast("int"), F.lit(0), F.col("turn").cast("int"))
    return c.select("conv_id", F.col("turn").alias("turn_no"), "role", "text", ts.alias("ts"))


def said(spark: SparkSession, sf: str) -> DataFrame:
    """Templated turns over the orders, in the wording that claim extraction is about."""
    o = read(spark, sf, "orders")
    tech = F.element_at(F.lit(["Redis", "Kafka", "PostgreSQL", "Flask", "Heroku", "Docker"]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    old = F.element_at(F.lit(["MySQL", "Jenkins", "Rails"]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("We use "), tech, F.lit(" "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("."), (F.col("o_custkey") % 5).cast("string"), F.lit(" on port "), (F.col("o_custkey") % 8000 + 1000).cast("string"), F.lit(". The billing-svc no longer runs "), old, F.lit(" in production; Priya leads the rollout. Contact ops"), (F.col("o_custkey") % 100).cast("string"), F.lit("@example.com on 2024-03-0"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("."))
    return o.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn_no"), F.when(F.col("o_orderkey") % 2 == 0, "User").otherwise("assistant").alias("role"), text.alias("text"), F.col("o_orderdate").cast("timestamp").alias("ts"))


#: The same views for DuckDB; every oracle begins with the ones it names.
SQL = {
    "activity": "select user_id, ts, event_type as method, props as path, value from events",
    "users": "select c_custkey as user_id, c_name as email, ['free','basic','pro','team'][c_custkey % 4 + 1] as plan, timestamp '2024-01-15' - to_days((c_custkey % 40)::int) as created_at, c_custkey % 10 <> 9 as is_active, (c_custkey % 4 + 1) * 2000 as quota_bytes from customer",
    "claims": """select o_orderkey as id, o_custkey % 8 as user_id, 'customer ' || o_custkey as entity, 'order priority' as attribute, o_orderpriority as value,
        'customer ' || o_custkey || ' order priority is ' || o_orderpriority || '.' as content, o_orderdate as ts, o_orderdate as valid_from,
        lead(o_orderdate) over w as valid_to, lead(o_orderkey) over w as superseded_by, o_orderdate as tx_time, 'orders' as source,
        case o_orderstatus when 'F' then 0.9 when 'O' then 0.7 else 0.5 end::double as authority, o_orderkey % 97 = 0 as pinned
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "passages": """select doc_id as id, doc_id % 4 as user_id, text as content, source as entity, lang as attribute, source, case quality when 1 then 0.9 when 0 then 0.2 else 0.5 end::double as authority,
        timestamp '2024-01-01' + to_hours((doc_id % 4000)::int) as ts, timestamp '2024-01-01' + to_hours((doc_id % 4000)::int) as valid_from,
        case when doc_id % 11 = 0 then timestamp '2024-01-01' + to_hours((doc_id % 4000)::int) + interval 500 hours end as valid_to, doc_id % 97 = 0 as pinned, embedding, label
        from documents join embeddings on doc_id = vec_id left join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id)""",
    "questions": """select id as qid, user_id, array_to_string(list_filter(regexp_split_to_array(content, '[ \\n\\t\\r]+'), lambda w: w <> ''), ' ') as text, embedding as vector, timestamp '2024-02-01' as as_of from passages where id % 50 = 0""",
    "turns": "select conv_id, turn as turn_no, role, text, timestamp '2024-01-01' + to_days((conv_id % 1000)::int) + to_minutes(turn::int) as ts from conversations",
    "said": """select o_custkey as conv_id, o_orderkey as turn_no, case when o_orderkey % 2 = 0 then 'User' else 'assistant' end as role,
        'We use ' || ['Redis','Kafka','PostgreSQL','Flask','Heroku','Docker'][o_orderkey % 6 + 1] || ' ' || (o_orderkey % 9 + 1) || '.' || (o_custkey % 5) || ' on port ' || (o_custkey % 8000 + 1000) || '. The billing-svc no longer runs ' || ['MySQL','Jenkins','Rails'][o_orderkey % 3 + 1]
        || ' in production; Priya leads the rollout. Contact ops' || (o_custkey % 100) || '@example.com on 2024-03-0' || (o_orderkey % 9 + 1) || '.' as text, o_orderdate as ts from orders""",
}
_NEEDS = {"questions": ["passages"]}


def with_views(names: str, sql: str) -> str:
    """A query with the named views (separated by blanks) before it."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, ()), n] if x not in order]
    return "with " + ", ".join(f"{n} as materialized ({SQL[n]})" for n in order) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")
