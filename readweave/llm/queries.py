"""The queries of this package by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing, quality, recompression, secrets, sharding, simhash, suffixes, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_chat": chat.op4_chat,
    "op5_simhash": simhash.op5_simhash,
    "op6_recompression": recompression.op6_recompression,
    "op7_sharding": sharding.op7_sharding,
    "op8_urls": urls.op8_urls,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
}
SQL: dict[str, str] = {"op4_chat": chat.OP4_SQL, "op8_urls": urls.OP8_SQL}
