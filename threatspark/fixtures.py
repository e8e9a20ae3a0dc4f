"""Stand-in views of the reference's inputs, derived from the driver tables.

The reference reads flow, malware and phishing files that are not shipped.
Each function below derives a table of the same shape from the driver's
parquet tables with plain DataFrame expressions, so its size grows with the
input. ``VIEW_SQL`` holds the same derivations as SQL text for the DuckDB
oracle; both sides must stay in step (see FIXTURES.md part B).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .sources.readers import read_parquet
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


# Key of the flows stand-in (unique at sf0.01 and sf0.1).
FLOW_KEY = ["flow_id", "source_port", "part_id", "supp_id"]
# Identifier / metadata columns of the stand-in, dropped like the reference's
# "Flow ID", "Source Port", "Timestamp", ...
FLOW_ID_COLUMNS = ["flow_id", "source_port", "part_id", "supp_id", "flow_ts"]
FLOW_NUMERIC = ["fwd_packet_length_max", "flow_bytes_s", "flow_iat_mean",
                "flow_iat_min", "bwd_urg_flags", "rare_zero"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("flow_id"),
        F.col("l_linenumber").alias("source_port"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_shipdate").alias("flow_ts"),
        F.col("l_quantity").alias("fwd_packet_length_max"),
        F.col("l_extendedprice").alias("flow_bytes_s"),
        F.col("l_discount").alias("flow_iat_mean"),
        F.col("l_tax").alias("flow_iat_min"),
        F.lit(0.0).cast("double").alias("bwd_urg_flags"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.lit(0.0)).alias("rare_zero"),
        F.when(F.col("l_returnflag") == "N", "BENIGN")
         .when(F.col("l_returnflag") == "A", "DDoS")
         .otherwise("PortScan").alias("label"),
    )


def _malware_side(spark: SparkSession, sf_dir: str, attack: bool) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    ev = ev.where(F.col("event_type") == "error") if attack else \
        ev.where(F.col("event_type") != "error")
    digits = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10
    cols = [
        F.col("event_id"),
        F.col("value").alias("tot_bytes"),
        F.nullif(digits, F.lit(0)).cast("double").alias("pkt_rate"),
        F.lit(5.0).cast("double").alias("const_col"),
    ]
    if not attack:
        cols.append(F.col("user_id").cast("double").alias("host_degree"))
    return ev.select(*cols)


def malware_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malware_side(spark, sf_dir, True)


def malware_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malware_side(spark, sf_dir, False)


NODE_CHUNK = 50


def nodes(spark: SparkSession, sf_dir: str, chunk: int = NODE_CHUNK) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").alias("node_id"),
        F.floor(F.col("vec_id") / chunk).cast("bigint").alias("chunk_id"),
        F.col("embedding").alias("features"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"),
    )


def phishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    lb = table(spark, sf_dir, "labels").alias("l")
    return d.join(lb, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.lang").alias("lang"),
        F.col("d.source").alias("source"),
        F.when(F.col("d.n_chars") < 200, "-1").when(F.col("d.n_chars") < 2000, "0")
         .otherwise("1").alias("url_length"),
        F.when(F.col("l.toxic").isNull(), F.lit(None).cast("string"))
         .when(F.col("l.toxic") == 1, "1").otherwise("-1").alias("request_url"),
        F.when(F.col("l.quality") == 1, 1).when(F.col("l.quality") == 0, -1)
         .alias("result"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("packet_id"),
        F.col("ts"),
        (F.lit(900) + (F.col("event_id") * 37) % 9300).cast("int").alias("sport"),
        F.when(F.col("event_type") == "signup", "udp").otherwise("tcp").alias("proto"),
        F.when(F.col("user_id") % 10 == 0, "10.0.0.1").otherwise("127.0.0.1").alias("dst_ip"),
        F.col("value").alias("length"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("label"),
        (((F.col("doc_id") * 7919) % 1000).cast("double") / F.lit(1000.0)
         + F.lit(0.0005)).alias("p"),
    )


# --- SQL text of the same views for the DuckDB oracle -----------------------

VIEW_SQL = {
    "flows": """
SELECT l_orderkey AS flow_id, l_linenumber AS source_port,
       l_partkey AS part_id, l_suppkey AS supp_id, l_shipdate AS flow_ts,
       l_quantity AS fwd_packet_length_max, l_extendedprice AS flow_bytes_s,
       l_discount AS flow_iat_mean, l_tax AS flow_iat_min,
       CAST(0 AS DOUBLE) AS bwd_urg_flags,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(0 AS DOUBLE) END AS rare_zero,
       CASE WHEN l_returnflag = 'N' THEN 'BENIGN'
            WHEN l_returnflag = 'A' THEN 'DDoS' ELSE 'PortScan' END AS label
FROM lineitem""",
    "malware_attack": """
SELECT event_id, value AS tot_bytes,
       CAST(nullif(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10, 0) AS DOUBLE) AS pkt_rate,
       CAST(5 AS DOUBLE) AS const_col
FROM events WHERE event_type = 'error'""",
    "malware_normal": """
SELECT event_id, value AS tot_bytes,
       CAST(nullif(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10, 0) AS DOUBLE) AS pkt_rate,
       CAST(5 AS DOUBLE) AS const_col, CAST(user_id AS DOUBLE) AS host_degree
FROM events WHERE event_type <> 'error'""",
    "nodes": f"""
SELECT vec_id AS node_id, CAST(floor(vec_id / {NODE_CHUNK}) AS BIGINT) AS chunk_id,
       embedding AS features, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label
FROM embeddings""",
    "phishing": """
SELECT d.doc_id AS doc_id, d.lang AS lang, d.source AS source,
       CASE WHEN d.n_chars < 200 THEN '-1' WHEN d.n_chars < 2000 THEN '0' ELSE '1' END AS url_length,
       CASE WHEN l.toxic IS NULL THEN NULL WHEN l.toxic = 1 THEN '1' ELSE '-1' END AS request_url,
       CASE WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN -1 END AS result
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "packets": """
SELECT event_id AS packet_id, ts, CAST(900 + (event_id * 37) % 9300 AS INT) AS sport,
       CASE WHEN event_type = 'signup' THEN 'udp' ELSE 'tcp' END AS proto,
       CASE WHEN user_id % 10 = 0 THEN '10.0.0.1' ELSE '127.0.0.1' END AS dst_ip,
       value AS length
FROM events""",
    "scores": """
SELECT doc_id AS row_id, quality AS label,
       CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000e0 + 0.0005e0 AS p
FROM labels""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named stand-in views."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql
