"""A line service: JSON requests in, JSON responses out, batch or stream, no state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spans import corrected

MAX_CHARS = 20_000


def respond(line: str, corrector: Callable[[str], tuple[str, float]]) -> str:
    """The response to one request line; any fault is an error response, so one bad line stops nothing."""
    rid = None
    try:
        request = json.loads(line)
        if not isinstance(request, dict):
            raise ValueError("invalid-request")
        rid = request.get("id")
        op = str(request.get("op", "propose"))
        if op == "health":
            out: dict[str, object] = {"id": rid, "ok": True, "status": "ready", "offline": True}
        elif op != "propose":
            raise ValueError("unsupported-operation")
        else:
            text = request.get("text")
            if not isinstance(text, str):
                raise ValueError("invalid-request")
            if len(text) > MAX_CHARS:
                raise ValueError("request-too-large")
            lists = {k: request.get(k) or [] for k in ("brands", "addresses")}
            if any(not isinstance(v, list) or any(not isinstance(x, str) for x in v) for v in lists.values()):
                raise ValueError("invalid-request")
            out = {"id": rid, "ok": True, "proposal": corrected(text, corrector, **lists)}
    except json.JSONDecodeError:
        out = {"id": rid, "ok": False, "error": {"code": "worker-error"}}
    except ValueError as e:
        out = {"id": rid, "ok": False, "error": {"code": str(e)}}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def unchanged(text: str) -> tuple[str, float]:
    """The corrector that corrects nothing."""
    return text, 1.0


def responses(lines: DataFrame, corrector: Callable[[str], tuple[str, float]] = unchanged, value: str = "value") -> DataFrame:
    """(line, response) for every non-blank line of a batch or stream."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: respond(t, corrector))

    line = F.regexp_replace(value, "^\\uFEFF+", "")
    return lines.select(line.alias("line")).where(F.trim("line") != "").select("line", run("line").alias("response"))


def serve(spark: SparkSession, source: str, target: str, checkpoint: str, corrector: Callable[[str], tuple[str, float]] = unchanged, *, once: bool = False) -> StreamingQuery:
    """Answers the lines of files that appear in ``source``; a restart goes on from the checkpoint."""
    made = responses(spark.readStream.text(source), corrector).select(F.col("response").alias("value"))
    writer = made.writeStream.format("text").option("checkpointLocation", checkpoint).option("path", target).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
