"""Results as files: long-form CSV and JSON of metrics, JSON lines of answers.

CSV and JSON are written by Spark, a folder of parts each; ``one_file`` collects
a report of bounded size (``MOST_ROWS``) into a single file on the same file
system, which a larger one refuses.

Defined cases: nulls are empty in CSV and absent in JSON; an empty table gives
the header, an empty list, or no lines; an existing target is replaced.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlode.operators.evaluate import long_metrics
from simlode.sources import files

MOST_ROWS = 100_000


def write_csv(rows: DataFrame, path: str) -> None:
    """Columns of numbers, texts and times as CSV with a header; nested ones as JSON text."""
    flat = [F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in rows.columns]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)


def one_file(rows: DataFrame, path: str) -> None:
    """A report as one file: CSV if the path ends in ``.csv``, else a JSON list."""
    held = rows.limit(MOST_ROWS + 1).collect()
    if len(held) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows; write it as a folder")
    if path.endswith(".csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(rows.columns)
        writer.writerows(held)
        files.write_text(rows.sparkSession, path, out.getvalue())
    else:
        listed = [{k: v for k, v in r.asDict(True).items() if v is not None} for r in held]
        files.write_text(rows.sparkSession, path, json.dumps(listed, default=str, indent=1))


def write_metrics(wide: DataFrame, name: str, path: str, unit: str = "") -> None:
    """One row a benchmark and metric (``benchmark_name, metric_name, value, unit``), as CSV."""
    write_csv(long_metrics(wide, name, unit), path)
