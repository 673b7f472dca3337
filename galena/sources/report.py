"""A sink for reports: small results as markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """The first rows of a small result as a markdown table; pipes are escaped."""
    shown = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in df.limit(rows).collect()])
