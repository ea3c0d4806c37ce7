"""The driver's tables seen as the tables of a world: entities, versioned facts and relationships, events, chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.sources.shared import dealt, plain_unions


class World:
    """Tables by name; each is a lazily read DataFrame whose filters and columns reach the Parquet scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        plain_unions(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def entity(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.lower("c_mktsegment").alias("entity_type"), F.col("c_nationkey").cast("long").alias("world_id"))

    def world(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("owner"))

    def fact_version(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        status = F.when(k % 10 == 0, "CONTRADICTED").when((k % 10).isin(1, 2), "SUPERSEDED").otherwise("ACTIVE")
        return self.raw("events").select(
            F.col("event_id").alias("version_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("property_name"), "value",
            F.col("ts").alias("created_at"), F.when(k % 10 != 9, F.dayofmonth("ts")).alias("chapter_number"), status.alias("status"),
        )

    def contradiction(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        status = F.when(k % 3 == 0, "DETECTED").when(k % 3 == 1, "RESOLVED").otherwise("DISMISSED")
        return self.raw("events").where(k % 5 == 0).select(
            F.col("event_id").alias("id"), (F.col("event_id") - 1).alias("old_fact_version_id"), F.col("event_id").alias("new_fact_version_id"), status.alias("status"), (k / 100.0).alias("confidence")
        )

    def relationship_version(self) -> DataFrame:
        kinds = {"1-URGENT": "ENEMY_OF", "2-HIGH": "FRIEND_OF", "3-MEDIUM": "MARRIED_TO", "4-NOT SPECIFIED": "ALLY_OF"}
        kind = F.lit("FATHER_OF")
        for k, v in kinds.items():
            kind = F.when(F.col("o_orderpriority") == k, v).otherwise(kind)
        status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "SUPERSEDED").otherwise("CONTRADICTED")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 50).alias("source_id"), ((F.col("o_orderkey") * 7) % 40).alias("target_id"), kind.alias("relationship_type"),
            F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 11 != 0, F.month("o_orderdate")).alias("chapter_number"), status.alias("status"),
        )

    def event(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            key.alias("event_id"), F.lower("o_orderpriority").alias("event_type"), F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate")).alias("chapter_number"),
            F.when(key % 5 != 0, key % 7).alias("sequence_index"), F.when(cust % 3 != 0, cust % 100).alias("start_position"), F.col("o_orderdate").alias("created_at"), (cust % 25).alias("world_id"),
        )

    def participant(self) -> DataFrame:
        return self.participations().distinct()

    def participations(self) -> DataFrame:
        """Rows of participant, repeats too, for those who reduce them to something smaller anyway. Lines are dealt out by
        event before each becomes two rows: what then goes by event, as distinct rows and joins do, stays where it is."""
        lines = dealt(self.raw("lineitem").select(F.col("l_orderkey").alias("event_id"), "l_suppkey", "l_partkey"), "event_id")
        both = F.explode(F.array(F.struct(F.col("l_suppkey").alias("entity_id"), F.lit("Agent").alias("role")), F.struct((F.col("l_partkey") % 100).alias("entity_id"), F.lit("patient").alias("role"))))
        return lines.select("event_id", both.alias("p")).select("event_id", "p.entity_id", "p.role")

    def mention(self) -> DataFrame:
        return self.raw("events").where("event_type = 'view'").select(F.col("event_id").alias("mention_id"), F.col("user_id").alias("entity_id"), F.dayofmonth("ts").alias("chapter_number"))

    def chapter(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("chapter_id"), F.col("source").alias("manuscript_id"), "lang", F.col("text").alias("content"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

#: The same views in SQL, for the oracle.
SQL = {
    "entity": "SELECT c_custkey AS id, c_name AS canonical_name, lower(c_mktsegment) AS entity_type, CAST(c_nationkey AS BIGINT) AS world_id FROM customer",
    "world": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS owner FROM nation",
    "fact_version": f"""SELECT event_id AS version_id, user_id AS entity_id, event_type AS property_name, value, ts AS created_at,
        CASE WHEN {_K} % 10 <> 9 THEN day(ts) END AS chapter_number,
        CASE WHEN {_K} % 10 = 0 THEN 'CONTRADICTED' WHEN {_K} % 10 IN (1, 2) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM events""",
    "contradiction": f"""SELECT event_id AS id, event_id - 1 AS old_fact_version_id, event_id AS new_fact_version_id,
        CASE {_K} % 3 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'RESOLVED' ELSE 'DISMISSED' END AS status, CAST({_K} AS DOUBLE) / 100 AS confidence FROM events WHERE {_K} % 5 = 0""",
    "relationship_version": """SELECT o_orderkey AS version_id, o_custkey % 50 AS source_id, (o_orderkey * 7) % 40 AS target_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'ENEMY_OF' WHEN '2-HIGH' THEN 'FRIEND_OF' WHEN '3-MEDIUM' THEN 'MARRIED_TO' WHEN '4-NOT SPECIFIED' THEN 'ALLY_OF' ELSE 'FATHER_OF' END AS relationship_type,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 11 <> 0 THEN month(o_orderdate) END AS chapter_number,
        CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'SUPERSEDED' ELSE 'CONTRADICTED' END AS status FROM orders""",
    "event": """SELECT o_orderkey AS event_id, lower(o_orderpriority) AS event_type, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS chapter_number,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS sequence_index, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 100 END AS start_position,
        o_orderdate AS created_at, o_custkey % 25 AS world_id FROM orders""",
    "participant": """SELECT DISTINCT event_id, entity_id, role FROM (SELECT l_orderkey AS event_id, l_suppkey AS entity_id, 'Agent' AS role FROM lineitem
        UNION ALL SELECT l_orderkey, l_partkey % 100, 'patient' FROM lineitem)""",
    "mention": "SELECT event_id AS mention_id, user_id AS entity_id, day(ts) AS chapter_number FROM events WHERE event_type = 'view'",
    "chapter": "SELECT doc_id AS chapter_id, source AS manuscript_id, lang, text AS content FROM documents",
}


def with_views(sql: str, *names: str) -> str:
    """sql with the named views in front as common tables; sql may open with more of them after a leading comma."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
