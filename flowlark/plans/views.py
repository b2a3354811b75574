"""Flow tables and score tables made of the driver's tables. One text serves Spark and the oracle: table names in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Events as flows: a user is a source, an event type a destination, the number in props a port.
EVENT_FLOWS = """
SELECT event_id AS row_id, 'f' || CAST(user_id % 3 AS STRING) AS source_file, 'u' || CAST(user_id AS STRING) AS source_ip,
       event_type AS destination_ip, CAST(event_id * 7 % 60000 AS INT) AS source_port,
       CAST(CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 13 END AS INT) AS destination_port,
       ts AS "timestamp", CAST(event_id % 2 AS INT) AS syn_flag_count, CAST(event_id % 3 AS INT) AS ack_flag_count,
       CAST(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS INT) AS rst_flag_count, CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS fin_flag_count,
       CAST(event_id % 9 AS INT) AS total_fwd_packets, CAST(CASE WHEN event_id % 40 = 3 THEN NULL ELSE event_id % 4 END AS INT) AS total_backward_packets,
       CAST(event_id * 37 % 700 AS BIGINT) AS total_length_of_fwd_packets, CAST(event_id * 11 % 300 AS BIGINT) AS total_length_of_bwd_packets,
       CAST(6 AS INT) AS protocol, CASE WHEN event_id % 10 = 0 THEN 'dos' WHEN event_id % 17 = 0 THEN 'bot' ELSE 'benign' END AS attack_family
FROM {events}
"""
#: Order lines as flows: suppliers ship several lines on a day, so times tie. The table has no key, so its order goes on
#: with ``part`` and the packets; rows that agree in these too are equal in everything that is computed.
LINE_FLOWS = """
SELECT l_suppkey * 1000000000 + l_orderkey * 10 + l_linenumber AS row_id, 'f0' AS source_file, 's' || CAST(l_suppkey AS STRING) AS source_ip,
       'p' || CAST(l_partkey % 12 AS STRING) AS destination_ip, CAST(l_partkey % 9000 AS INT) AS source_port, CAST(l_partkey % 40 * 100 AS INT) AS destination_port,
       l_shipdate AS "timestamp", CAST(l_linenumber % 2 AS INT) AS syn_flag_count, CAST(l_linenumber % 3 AS INT) AS ack_flag_count,
       CAST(l_orderkey % 2 AS INT) AS rst_flag_count, CAST(l_orderkey % 3 AS INT) AS fin_flag_count,
       CAST(l_quantity AS INT) AS total_fwd_packets, CAST(l_linenumber AS INT) AS total_backward_packets,
       CAST(l_orderkey % 900 AS BIGINT) AS total_length_of_fwd_packets, CAST(l_partkey % 500 AS BIGINT) AS total_length_of_bwd_packets, l_partkey AS part
FROM {lineitem}
"""
#: Events as the flows of one host within one hour, some thirty a second at sf0.1: frames hold very many rows.
DENSE_FLOWS = EVENT_FLOWS.replace("'f' || CAST(user_id % 3 AS STRING)", "'f0'").replace("'u' || CAST(user_id AS STRING)", "'h0'").replace(
    'ts AS "timestamp"', "TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id * 7919 % 3600 AS INT) * INTERVAL 1 SECOND AS \"timestamp\""
)
LINE_ORDER = ["timestamp", "row_id", "part", "total_fwd_packets"]
#: Order lines as scored rows of two detectors. Scores are multiples of 1/1024, so sums are exact in any order.
SCORES = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS y,
       CASE WHEN l_returnflag <> 'R' THEN 'benign' WHEN l_linestatus = 'O' OR l_orderkey % 3 = 0 THEN 'dos' ELSE 'bot' END AS family,
       CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 769 + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END AS DOUBLE) / 1024 AS score,
       CAST((l_orderkey * 13 + l_suppkey * 29) % 801 + CASE WHEN l_returnflag = 'R' THEN 150 ELSE 0 END AS DOUBLE) / 64 AS memory_score,
       CASE l_orderkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test_seen' ELSE 'test_zero_day' END AS split
FROM {lineitem}
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text's frame over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text.replace('"timestamp"', "`timestamp`"), **tables)


def oracle(text: str) -> str:
    """A text as the oracle reads it."""
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text
