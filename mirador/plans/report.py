"""Reports as markdown: formatting of few collected rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(rows: DataFrame, most: int | None = 1000) -> str:
    """A markdown table of the first rows, of all without most; a report's limit is its feature."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    shown = lambda v: f"{v:.4f}" if isinstance(v, float) else "-" if v is None else str(v)
    return "\n".join([head, *("| " + " | ".join(map(shown, r)) + " |" for r in (rows.toLocalIterator() if most is None else rows.limit(most).collect()))])


def checklist(rows: DataFrame) -> str:
    """All 13 checks of all videos with their verdicts, each derived from its value, by video and name."""
    return table(rows.orderBy("video_id", "check_name").selectExpr("video_id", "check_name", "round(value, 4) AS value", "threshold", "CASE WHEN passed THEN 'pass' ELSE 'fail' END AS verdict"), most=None)
