"""Reusable views with parameters, as SQL table functions over the tables of a memory snapshot and a profile.

`install(spark, **tables)` makes the tables views and the functions temporary ones, so `SELECT * FROM device_overview(3)` works in any SQL.
A null device means all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, parameters, columns, tables that it reads, and the query behind.
MACROS = {
    "device_overview": ("device BIGINT", "device_index BIGINT, reserved_bytes BIGINT, allocated_bytes BIGINT, active_bytes BIGINT, frag_pct DOUBLE, segment_count BIGINT, expandable_segments BIGINT", ("segments", "devices"), """
SELECT d.device_index, sum(s.total_size), sum(s.allocated_size), sum(s.active_size), round(CAST((sum(s.total_size) - sum(s.allocated_size)) * 100.0 / nullif(sum(s.total_size), 0) AS DOUBLE), 2), count(s.id), sum(s.is_expandable)
FROM segments s JOIN devices d ON s.device_id = d.id WHERE device_overview.device IS NULL OR d.device_index = device_overview.device GROUP BY d.device_index"""),
    "block_state_dist": ("device BIGINT", "device_index BIGINT, state STRING, block_count BIGINT, total_size BIGINT, avg_size DOUBLE", ("blocks", "segments", "devices"), """
SELECT d.device_index, b.state, count(b.id), sum(b.size), avg(b.size) FROM blocks b JOIN segments s ON b.segment_id = s.id JOIN devices d ON s.device_id = d.id
WHERE block_state_dist.device IS NULL OR d.device_index = block_state_dist.device GROUP BY d.device_index, b.state"""),
    "expansion_timeline": ("device BIGINT, low BIGINT, high BIGINT", "device_index BIGINT, trace_index BIGINT, action STRING, size BIGINT", ("traces", "devices"), """
SELECT d.device_index, t.trace_index, t.action, t.size FROM traces t JOIN devices d ON t.device_id = d.id
WHERE t.action IN ('segment_alloc', 'segment_free', 'segment_map', 'segment_unmap') AND t.trace_index BETWEEN expansion_timeline.low AND expansion_timeline.high AND (expansion_timeline.device IS NULL OR d.device_index = expansion_timeline.device)"""),
}


def install(spark: SparkSession, **tables: DataFrame) -> list[str]:
    """Views of the tables, and those functions whose tables are there; their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    made = [name for name, (_, _, needs, _) in MACROS.items() if set(needs) <= set(tables)]
    for name in made:
        given, columns, _, body = MACROS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({columns}) RETURN {body}")
    return made
