"""SQL functions for a session: register(spark), then SELECT hamming_distance(a, b) and so on. They are inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "hamming_distance(a STRING, b STRING) RETURNS INT": "CASE WHEN length(a) <> length(b) THEN cast(raise_error('strings have different lengths') AS INT) ELSE size(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> x <> y), d -> d)) END",
    "floor_div(a BIGINT, b BIGINT) RETURNS BIGINT": "cast(floor(cast(a AS DECIMAL(38, 0)) / b) AS BIGINT)",
    "block_part(text STRING, i INT, blocks INT) RETURNS STRING": "substr(text, i * (length(text) div blocks) + least(i, length(text) % blocks) + 1, length(text) div blocks + if(i < length(text) % blocks, 1, 0))",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions and give their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
