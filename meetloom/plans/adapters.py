"""Domain tables as plain projections of the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_DAY = "CASE {0} % 6 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' ELSE 'Saturday' END"
_BLOCK = "CASE {0} % 4 WHEN 0 THEN '08:30' WHEN 1 THEN '11:00' WHEN 2 THEN '14:30' ELSE '17:00' END"

#: Numbers of inboxes, meetings and documents grow with the tables, and each keeps its size.
_MEETING = "CAST(floor(l_orderkey / 240) AS BIGINT)"

VIEWS: dict[str, str] = {
    # files of inboxes, some eighty each
    "listing": """
SELECT CAST(floor(o_custkey / 8) AS BIGINT) AS inbox_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'Chair_notes' WHEN 1 THEN 'Ann_notes' WHEN 2 THEN 'Ben_notes' WHEN 3 THEN 'Cleo_sessions'
    WHEN 4 THEN 'Agenda' WHEN 5 THEN 'drafts' WHEN 6 THEN 'misc' WHEN 7 THEN 'Vice_Chair_session' ELSE 'Inbox' END AS folder,
  o_orderkey AS list_pos,
  CASE WHEN o_orderkey % 13 = 0 THEN concat('Agenda_v', lpad(CAST(o_orderkey % 10 AS STRING), 2, '0'), '.pdf')
    WHEN o_orderkey % 17 = 0 THEN concat('RAN1#', CAST(120 + o_custkey % 6 AS STRING), ' chair notes - v', lpad(CAST(o_orderkey % 12 AS STRING), 2, '0'), '.docx')
    WHEN o_orderkey % 19 = 0 THEN 'custom schedule.docx'
    WHEN o_orderkey % 9 = 8 AND o_custkey % 3 = 0 THEN concat('RAN1#', CAST(120 + o_custkey % 6 AS STRING), ' schedule for ', CASE o_orderkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ana' WHEN 2 THEN 'Li' ELSE 'Sam' END, ' sessions_v', lpad(CAST(o_orderkey % 12 AS STRING), 2, '0'), '.docx')
    ELSE concat(CASE WHEN o_orderkey % 23 = 0 THEN 'Draft ' ELSE '' END, 'RAN', CAST(1 + floor((o_custkey % 50) / 49) AS INT), '#', CASE WHEN o_orderkey % 370 = 0 THEN '99999999999' ELSE CAST(120 + o_custkey % 6 AS STRING) END,
      CASE o_orderkey % 5 WHEN 0 THEN 'bis' WHEN 1 THEN '-bis' WHEN 2 THEN ' adhoc' WHEN 3 THEN '-e' ELSE '' END, ' Schedules - v', CASE WHEN o_orderkey % 29 = 0 THEN concat('20240115', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) ELSE lpad(CAST(o_orderkey % 12 AS STRING), 2, '0') END,
      CASE o_orderkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.ZIP' ELSE '.pptx' END) END AS name,
  concat('https://files.example/', CAST(o_orderkey AS STRING)) AS url,
  CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 20 = 3 THEN NULL ELSE o_orderdate END AS uploaded_at
FROM orders""",
    # sources of meetings
    "sources": """
SELECT CAST(floor(o_custkey / 5) AS BIGINT) AS meeting_id, o_orderkey AS ord, concat('Folder_', CAST(o_orderkey % 5 AS STRING)) AS folder,
  CASE o_orderkey % 7 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ana' WHEN 2 THEN '' WHEN 3 THEN 'Li' ELSE NULL END AS person,
  o_orderkey % 8 = 4 AS is_main, concat('https://files.example/', CAST(o_orderkey AS STRING)) AS url,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS uploaded_at
FROM orders""",
    # what was stored, and what is listed now, of inboxes
    "cached": """
SELECT user_id AS inbox_id, event_type AS folder, concat('file', CAST(event_id % 40 AS STRING), '.docx') AS name,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS uploaded_at
FROM events WHERE user_id % 100 > 4""",
    "remote": """
SELECT user_id AS inbox_id, event_type AS folder, concat('file', CAST(event_id % 40 AS STRING), '.docx') AS name,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS uploaded_at
FROM events WHERE user_id % 100 NOT IN (8, 9) AND NOT (user_id % 100 < 40 AND event_id % 29 = 0)
UNION ALL
SELECT user_id, event_type, concat('file', CAST(event_id % 40 AS STRING), '_new.docx'), date_trunc('minute', ts)
FROM events WHERE user_id % 100 >= 70 AND event_id % 31 = 0""",
    # a row per result item of a slot
    "items": f"""
SELECT {_MEETING} AS meeting_id, {_DAY.format("l_orderkey")} AS day, CAST(l_orderkey % 4 AS INT) AS tb, l_orderkey * 10 + l_linenumber AS ord,
  CASE l_suppkey % 6 WHEN 0 THEN 'F1+F2' WHEN 1 THEN 'a1' WHEN 2 THEN 'J1' WHEN 3 THEN 'RAN1_main' WHEN 4 THEN 'ALL_ONLINE' ELSE 'A1 + J1' END AS room_name,
  {_BLOCK.format("l_orderkey")} AS block_start, CASE l_orderkey % 4 WHEN 3 THEN 150 ELSE 120 END AS block_minutes,
  CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE 5 * (CAST(l_quantity AS INT) % 13) END AS duration_minutes,
  CASE WHEN l_partkey % 9 = 0 THEN '14:00' WHEN l_partkey % 9 = 1 THEN 'soon' END AS specified_start_time,
  CASE WHEN l_partkey % 6 = 0 THEN concat('AI 9.', CAST(l_partkey % 12 AS STRING), '.1 ', p_type) WHEN l_partkey % 6 = 1 THEN concat(p_brand, ' part ', p_name) WHEN l_partkey % 6 = 2 THEN concat('.10.', CAST(l_partkey % 7 AS STRING)) ELSE p_name END AS name,
  CASE WHEN l_partkey % 7 = 0 THEN '9.10, 9.2' WHEN l_partkey % 7 = 1 THEN concat('8.', CAST(l_partkey % 11 AS STRING)) END AS agenda_item,
  CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN concat('AI 7.', CAST(l_partkey % 5 AS STRING), '.') ELSE p_brand END AS group_header,
  CASE WHEN l_partkey % 3 = 0 THEN concat('Chair', CAST(l_suppkey % 4 AS STRING)) END AS chair
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l
JOIN part ON p_partkey = l_partkey""",
    # rooms of a meeting's days: two in table 0, then one a table
    "rooms": f"""
SELECT meeting_id, day, CAST(floor(i / 2) AS INT) AS table_index, CAST(i % 2 AS INT) AS room_idx, CAST(i AS INT) AS pos,
  CASE i WHEN 0 THEN 'F1+F2' WHEN 1 THEN 'A1' WHEN 2 THEN 'J1' ELSE 'J2' END AS name
FROM (SELECT DISTINCT {_MEETING} AS meeting_id, {_DAY.format("l_orderkey")} AS day, CAST(l_linenumber AS BIGINT) % 5 AS i FROM lineitem) AS d
WHERE i < 4 AND i <= meeting_id % 5""",
    # sessions with times
    "sessions": """
SELECT meeting_id, day, tb, ord, room_name, name, agenda_item, group_header, chair, duration_minutes,
  concat(lpad(CAST(8 + ord % 12 AS STRING), 2, '0'), ':', lpad(CAST(5 * (ord % 11) AS STRING), 2, '0')) AS start_time,
  concat(lpad(CAST(8 + ord % 12 + CAST(floor((5 * (ord % 11) + duration_minutes) / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST((5 * (ord % 11) + duration_minutes) % 60 AS STRING), 2, '0')) AS end_time,
  CAST(ord % 5 + 1 AS INT) AS room_col_start, CAST(ord % 5 + 2 + ord % 3 AS INT) AS room_col_end, CAST(ord % 4 AS INT) AS n_rooms
FROM items WHERE duration_minutes IS NOT NULL""",
    # raw cells of document tables: a row of a table is an order's linenumbers
    "cells": """
SELECT CAST(floor(l_orderkey / 60) AS BIGINT) AS doc_id, CAST(l_orderkey % 3 AS INT) AS table_idx, CAST(floor((l_orderkey % 60) / 3) AS INT) AS row_idx, CAST(l_linenumber AS INT) AS tc_idx,
  CAST(1 + l_partkey % 4 AS INT) AS grid_span, CASE l_partkey % 10 WHEN 0 THEN 'continue' WHEN 1 THEN 'restart' WHEN 2 THEN '' END AS v_merge,
  CASE l_suppkey % 5 WHEN 0 THEN 'D9D9D9' WHEN 1 THEN '#ffd966 [1943]' WHEN 2 THEN 'auto' WHEN 3 THEN 'D8D8D8' END AS fill,
  CASE WHEN l_linenumber = 1 THEN CASE l_orderkey % 8 WHEN 0 THEN '08:30 ~ 10:30 (120 min)' WHEN 1 THEN '9:00 ~' WHEN 2 THEN '10:30 ~ 11:00' WHEN 3 THEN '14:30' WHEN 4 THEN 'Coffee' WHEN 5 THEN '17:00' ELSE '11:00 ~ 13:00' END
    WHEN l_orderkey % 60 < 3 THEN CASE l_linenumber WHEN 2 THEN 'Monday' WHEN 3 THEN 'TUESDAY (local)' WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'monday' ELSE 'Thursday and Friday' END
    WHEN l_partkey % 10 = 3 THEN '  ' WHEN l_partkey % 50 = 7 THEN 'All sessions end' WHEN l_partkey % 50 = 8 THEN 'Meeting Rooms' ELSE concat('cell ', CAST(l_partkey AS STRING)) END AS text
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l""",
    # cells with days and blocks; sources 0 is the main one
    "slot_cells": f"""
SELECT {_MEETING} AS meeting_id, CAST(l_suppkey % 4 AS INT) AS source, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ann' WHEN 2 THEN 'Ana' ELSE 'Li' END AS person,
  {_DAY.format("l_orderkey")} AS day, CAST(l_orderkey % 4 AS INT) AS tb, l_orderkey * 10 + l_linenumber AS ord, CAST(l_linenumber % 3 AS INT) AS table_index,
  CAST(l_partkey % 3 AS INT) AS room_from, CAST(l_partkey % 3 + l_linenumber % 2 AS INT) AS room_to,
  concat(CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE '' END, 'topic ', CAST(l_partkey % 4 AS STRING), CASE WHEN l_partkey % 5 = 0 THEN chr(10) ELSE '' END) AS text
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS l""",
}


def _needed(sql: str) -> list[str]:
    return [t for t in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the tables of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t: view(spark, sf_dir, t) for t in _needed(sql)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql), **used)


def with_views(sql: str) -> str:
    """Oracle SQL with the domain tables it names in front."""
    order: list[str] = []

    def add(text: str) -> None:
        for t in _needed(text):
            if t in VIEWS and t not in order:
                add(VIEWS[t])
                order.append(t)

    add(sql)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if not order:
        return body
    if body.upper().startswith("WITH "):
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' * recursive}{head},\n{rest}"
    return f"WITH {head}\n{body}"
