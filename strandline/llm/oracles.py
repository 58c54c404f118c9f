"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from strandline.llm import decontamination, lines, mixing, ranking


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontamination.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op10_line_dedup": lines.ORACLE,
        "op13_ranked_search": ranking.ORACLE,
    }
