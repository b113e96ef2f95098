"""Content hashes as column expressions; the JSON forms that Spark can't write have an Arrow UDF."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha256(content: Column) -> Column:
    """Lower-case hex SHA-256 of a binary or text column."""
    return F.sha2(content, 256)


def prefixed_sha256(prefix: str, content: Column) -> Column:
    """SHA-256 of a prefix, a zero byte and the content's bytes."""
    return F.sha2(F.concat(F.encode(F.lit(prefix), "UTF-8"), F.unhex(F.lit("00")), F.encode(content, "UTF-8")), 256)


def json_sha256(**fields: Column) -> Column:
    """SHA-256 of a flat object as compact JSON, keys sorted, UTF-8."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


@F.pandas_udf(StringType())
def ascii_json_sha256(s: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text rewritten compactly, keys sorted, non-ASCII characters escaped."""
    return s.map(lambda t: None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def region_fingerprint(bbox: Column, text: Column) -> Column:
    """What binds a review decision to a box and the (composed) text that was seen in it."""
    return prefixed_sha256("V7_REVIEW_REGION_V1", F.to_json(F.struct(bbox.alias("bbox"), text.alias("selected_text"))))


def path_identity(path: Column) -> Column:
    """SHA-256 of a path, whatever its case and slashes."""
    return F.sha2(F.lower(F.regexp_replace(path, r"\\", "/")), 256)


def pixel_sha256(width: Column, height: Column, pixels: Column, layout: str) -> Column:
    """SHA-256 of row-major pixels with their shape, in the layouts ``rows`` (V7-RGB-U8, height first) and ``canonical`` (width first)."""
    zero = F.unhex(F.lit("00"))
    if layout == "rows":
        head = [F.encode(F.lit("V7-RGB-U8"), "UTF-8"), zero, F.encode(F.concat_ws("x", height.cast("string"), width.cast("string")), "UTF-8"), zero]
    elif layout == "canonical":
        head = [F.encode(F.lit("RESIZE_CANONICAL_SRGB_WHITE_V1"), "UTF-8"), zero, F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":RGB")), "UTF-8"), zero]
    else:
        raise ValueError(layout)
    return F.sha2(F.concat(*head, pixels), 256)


def determinism_errors(seed: Column, input_sha: Column, config_sha: Column, output_sha: Column, real_input: Column, real_output: Column) -> Column:
    """What is missing, malformed or wrong in a run's determinism record, in order."""
    hexed = "^[0-9a-f]{64}$"
    named = (("input_pixel_sha256", input_sha), ("config_sha256", config_sha), ("output_pixel_sha256", output_sha))
    checks = [F.when(seed.isNull(), F.lit("missing:seed"))]
    checks += [F.when(c.isNull(), F.lit(f"missing:{n}")) for n, c in named]
    checks += [F.when(c.isNotNull() & ~c.rlike(hexed), F.lit(f"invalid:{n}")) for n, c in named]
    checks += [F.when(input_sha != real_input, F.lit("mismatch:input_pixel_sha256")), F.when(output_sha != real_output, F.lit("mismatch:output_pixel_sha256"))]
    return F.array_compact(F.array(*checks))
