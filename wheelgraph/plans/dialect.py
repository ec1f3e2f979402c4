"""Input relations for Spark and for DuckDB from one text: relations in braces, integer division as {div}, ordered text aggregation by {join}, SHA-256 by {sha256}."""

from __future__ import annotations

import re

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _listed(sql: str, text: str) -> str:
    """{join:value:order} in the engine's own form; values are joined by a comma and a space."""
    return re.sub(r"\{join:([^:}]*):([^}]*)\}", lambda m: text.format(m[1], m[2]), sql)


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, as both engines would else compute in decimals of their own scale."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def spark_text(sql: str) -> str:
    sql = _listed(_doubles(sql), "listagg({0}, ', ') WITHIN GROUP (ORDER BY {1})")
    sql = re.sub(r"\{sha256:([^}]*)\}", r"sha2(\1, 256)", sql)
    return sql.replace("{div}", "div").replace("{row}", "struct")


def duck_text(sql: str) -> str:
    sql = _listed(_doubles(sql), "string_agg({0}, ', ' ORDER BY {1})")
    sql = re.sub(r"\{sha256:([^}]*)\}", r"sha256(\1)", sql)
    sql = sql.replace("* EXCEPT (", "* EXCLUDE (").replace("{div}", "//").replace("{row}", "row")
    return re.sub(r"\{(\w+)\}", r"\1", sql)
