"""The scalar functions, and the ancestors of a path as a table function, for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies that Spark inlines into the plan; no Python runs.
SCALARS = {
    "estimate_tokens(s STRING) RETURNS BIGINT": "CAST(CEIL(COALESCE(LENGTH(s), 0) / 4) AS BIGINT)",
    "repository_id(s STRING) RETURNS STRING": "SUBSTR(SHA2(LOWER(TRIM(s)), 256), 1, 12)",
    "project_id(folder STRING, cwd STRING) RETURNS STRING": "CONCAT(folder, '::', SUBSTR(SHA2(cwd, 256), 1, 8))",
    "format_tokens(n BIGINT) RETURNS STRING": "CASE WHEN n < 1000 THEN CAST(n AS STRING) WHEN n < 10000 THEN CONCAT(CAST(ROUND(CAST(n AS DECIMAL(20, 3)) / 1000, 1) AS DECIMAL(20, 1)), 'k') ELSE CONCAT(CAST(FLOOR(n / 1000 + 0.5) AS STRING), 'k') END",
}
TABLES = {
    "path_ancestors(path STRING) RETURNS TABLE (folder STRING)": "SELECT folder FROM (SELECT ARRAY_JOIN(SLICE(SPLIT(path, '/'), 1, n), '/') AS folder FROM EXPLODE(SEQUENCE(1, GREATEST(SIZE(SPLIT(path, '/')) - 1, 1))) AS t(n)) WHERE folder <> '' AND folder <> path",
}


def register(spark: SparkSession) -> None:
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
