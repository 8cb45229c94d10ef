"""Statements for the streaming queries."""

from oracle.lookup import SQL as LOOKUP

SQL: dict[str, str] = {}
SQL["run_log_stream"] = """WITH w AS (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS window_start, event_type AS status, count(*) AS entries FROM events GROUP BY 1, 2)
 SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, status, entries FROM w"""
SQL["memory_stream"] = LOOKUP["memory_upsert"]
