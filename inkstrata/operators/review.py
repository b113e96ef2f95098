"""Review decisions: fail-closed merges by fingerprint, validation, compare-and-swap updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import region_fingerprint
from ..functions.text import approved_text

HEX64 = "^[0-9a-f]{64}$"
STATUSES, ACTIONS = ("green", "yellow", "red"), ("pending", "replace", "keep", "skip")
# Labels of reason codes.
REASONS = {
    "protected_or_numeric_content_requires_approval": "numbers, prices or codes need a check",
    "no_independent_engine_agreement": "the two readers don't agree",
    "independent_engine_confidence_below_green_gate": "the independent reader is unsure",
    "recognition_confidence_below_green_gate": "recognition is unsure",
    "unreadable_text_requires_user_entry": "too blurred; enter the text",
    "language_model_change_requires_approval": "a correction is proposed; use it only if you confirm",
    "language_proposals_disagree": "the proposed corrections differ",
    "old_text_mask_failed_quality_gate": "the old text can't be removed safely",
}


def fingerprint(bbox: str = "bbox", text: str = "selected_text") -> Column:
    return region_fingerprint(F.col(bbox), F.col(text))


def merge_decisions(current: DataFrame, reviewed: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged, problems). current has fingerprint; reviewed has fingerprint, recomputed (of its own row), action, approved_text.

    merged is every current row with its decision, else pending. problems has one row a fault, and an empty table is the condition for using merged: malformed and
    tampered fingerprints, repeats on either side, and decisive rows that no current row took up (stale).
    """
    keys = keys or []
    by = [*keys, "fingerprint"]
    twice = lambda df, what: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, F.lit(what).alias("problem"))
    bad = reviewed.where(~F.coalesce(F.col("fingerprint").rlike(HEX64), F.lit(False))).select(*by, F.lit("malformed").alias("problem"))
    tampered = reviewed.where(F.col("fingerprint") != F.col("recomputed")).select(*by, F.lit("tampered").alias("problem"))
    decisive = reviewed.where(F.lower(F.trim("action")).isin("replace", "keep", "skip"))
    stale = decisive.join(current.select(*by), by, "left_anti").select(*by, F.lit("stale").alias("problem"))
    problems = bad.union(tampered).union(twice(reviewed, "repeated_review")).union(twice(current, "repeated_current")).union(stale)
    decisions = reviewed.select(*by, F.col("action").alias("_a"), F.col("approved_text").alias("_t"))
    merged = current.join(decisions, by, "left").withColumn("action", F.coalesce("_a", F.lit("pending"))).withColumn("approved_text", F.coalesce("_t", F.lit(""))).drop("_a", "_t")
    return merged, problems


def require_none(problems: DataFrame, what: str) -> None:
    """Raises if there is any problem: nothing is dropped silently."""
    first = problems.limit(5).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in first))


def resolve(regions: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """outcome (replace, keep, unresolved) and text for every region: its first row counts, unknown ids are ignored, regions without a row are unresolved.

    The first row comes from a combining min over a struct. Texts are taken as they are, trimmed; give them in composed form.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(order, F.lower(F.trim(F.coalesce("action", F.lit("pending")))).alias("action"), F.trim(F.coalesce("approved_text", F.lit(""))).alias("text"))).alias("f"))
    j = regions.select(key).distinct().join(first, key, "left")
    act, text = F.col("f.action"), F.col("f.text")
    replaced = (act == "replace") & (text != "")
    return j.select(key, F.when(replaced, "replace").when(act.isin("keep", "skip"), "keep").otherwise("unresolved").alias("outcome"), F.when(replaced, text).alias("text"))


def lock_fidelity(source: DataFrame, final: DataFrame, key: str, scale: float) -> DataFrame:
    """Per id of either side: face, axes and scaled size kept? Missing on one side fails. The sides have path, face_index, axes, size."""
    names = ("path", "face_index", "axes", "size")
    s = source.select(key, *[F.col(n).alias(f"s_{n}") for n in names], F.lit(True).alias("_s"))
    f = final.select(key, *[F.col(n).alias(f"f_{n}") for n in names], F.lit(True).alias("_f"))
    j = s.join(f, key, "full")
    both = F.col("_s").isNotNull() & F.col("_f").isNotNull()
    same = lambda n: F.col(f"s_{n}").eqNullSafe(F.col(f"f_{n}"))
    face, axes = both & same("path") & same("face_index"), both & same("axes")
    size = both & (F.col("f_size") == F.greatest(F.lit(1), F.rint(F.col("s_size") * scale).cast("long")))
    return j.select(key, face.alias("same_face"), axes.alias("same_axes"), F.coalesce(size, F.lit(False)).alias("same_size"), F.coalesce(face & axes & size, F.lit(False)).alias("passed"))


def document_errors(rows: DataFrame, document: str, width: str, height: str) -> DataFrame:
    """(document, region_id, errors) of the rows of review documents: id, box, domains, fingerprint, repeats."""
    w = Window.partitionBy(document, "region_id")
    v = Window.partitionBy(document, "region_fingerprint")
    b = F.col("bbox")
    boxed = (F.size(b) == 4) & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= F.col(width)) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= F.col(height))
    hexed = F.coalesce(F.col("region_fingerprint").rlike(HEX64), F.lit(False))
    checks = F.array(
        F.when(F.coalesce(F.trim("region_id"), F.lit("")) == "", F.lit("region_id_missing")).when(F.count(F.lit(1)).over(w) > 1, F.lit("region_id_repeated")),
        F.when(~F.coalesce(boxed, F.lit(False)), F.lit("bbox_invalid")),
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("status_invalid")),
        F.when(~F.coalesce(F.coalesce(F.col("action"), F.lit("pending")).isin(*ACTIONS), F.lit(False)), F.lit("action_invalid")),
        F.when(~hexed, F.lit("fingerprint_invalid")).when(F.count(F.lit(1)).over(v) > 1, F.lit("fingerprint_repeated")),
        F.when(hexed & (F.col("region_fingerprint") != region_fingerprint(b, F.col("selected_text"))), F.lit("fingerprint_tampered")),
    )
    return rows.select(document, "region_id", F.array_compact(checks).alias("errors")).where(F.size("errors") > 0)


def friendly_reasons(reasons: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(reasons, lambda r: table[r])))


def apply_decisions(table: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Compare-and-swap: (updated, rejected). decisions has key, expected_version, action, approved_text.

    A decision counts only if the row's version is the expected one, the action is the user's to take, and a replacement has a clean text; every change adds one to the version.
    Of several decisions for one row none counts.
    """
    n = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    text = approved_text(F.col("approved_text"))
    d = decisions.join(n, key).select(key, "expected_version", F.lower(F.trim("action")).alias("_action"), text.alias("_text"), "_n")
    j = table.join(d, key, "left")
    why = (
        F.when(F.col("_n") > 1, "conflicting_decisions")
        .when(F.col("expected_version") != F.col("version"), "version_conflict")
        .when(~F.col("_action").isin("replace", "keep", "skip"), "unknown_action")
        .when((F.col("_action") == "replace") & F.col("_text").isNull(), "no_clean_text")
    )
    j = j.withColumn("_why", why)
    ok = F.col("_action").isNotNull() & F.col("_why").isNull()
    updated = j.select(
        *[c for c in table.columns if c not in ("action", "approved_text", "version")],
        F.when(ok, F.col("_action")).otherwise(F.col("action")).alias("action"),
        F.when(ok, F.when(F.col("_action") == "replace", F.col("_text")).otherwise("")).otherwise(F.col("approved_text")).alias("approved_text"),
        F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
    ).distinct()
    unknown = decisions.join(table.select(key), key, "left_anti").select(key, F.lit("unknown_row").alias("why"))
    return updated, j.where(F.col("_why").isNotNull()).select(key, F.col("_why").alias("why")).distinct().union(unknown)


def keep_pending(table: DataFrame) -> DataFrame:
    """Undecided rows keep their pixels; no other row changes."""
    p = F.col("action") == "pending"
    return table.withColumn("approved_text", F.when(p, "").otherwise(F.col("approved_text"))).withColumn("version", F.when(p, F.col("version") + 1).otherwise(F.col("version"))).withColumn("action", F.when(p, "keep").otherwise(F.col("action")))
