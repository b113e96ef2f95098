"""Manifests, caches and bundles: lookups by content hash, comparisons, role resolution, layout plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import path_identity

# The roles of a bundle's files, as patterns over lower-case relative paths.
ROLES = {
    "manifest": r"^(?:technical/)?manifest\.json$",
    "result": r"^(?:result\.png|review_required\.png|[^/]*_repaired_x[^/]*\.png)$",
    "comparison": r"^(?:comparison\.png|[^/]*_before_after\.png)$",
    "editable": r"^(?:editable\.svg|[^/]*_text_editable\.svg)$",
    "source": r"^(?:technical/source\.png|[^/]*_source_normalized\.png)$",
    "clean": r"^(?:technical/clean\.png|[^/]*_clean_base_x[^/]*\.png)$",
    "overlay": r"^(?:technical/overlay\.png|[^/]*_qa_overlay\.png)$",
    "review": r"^(?:technical/)?text_review\.json$",
    "qa": r"^(?:technical/)?qa\.json$",
}
REQUIRED = ("result", "comparison", "source", "clean", "overlay", "review", "qa", "manifest")
TARGETS = {"comparison": "COMPARISON.png", "editable": "EDITABLE.svg", "source": "TECHNICAL/SOURCE.png", "clean": "TECHNICAL/CLEAN.png", "overlay": "TECHNICAL/OVERLAY.png", "review": "TECHNICAL/TEXT_REVIEW.json", "qa": "TECHNICAL/QA.json", "manifest": "TECHNICAL/manifest.json"}


def role_of(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLES.items()):
        out = F.when(p.rlike(pattern), role).otherwise(out)
    return out


def cache_lookup(requests: DataFrame, entries: DataFrame, key: str, equal: list[str], identity: tuple[str, str], order: str) -> DataFrame:
    """The first entry, in its order, that fits each request: all ``equal`` columns, the identity under its new or its legacy name, and an output that still has its recorded hash."""
    e = entries.where(F.col("recorded_sha256") == F.col("actual_sha256")).withColumn("_id", F.coalesce(*identity))
    hit = requests.join(e.select(*equal, F.col("_id").alias(identity[0]), order, "entry"), [*equal, identity[0]])
    best = hit.groupBy(key).agg(F.min(F.struct(order, "entry")).alias("m")).select(key, F.col("m.entry").alias("entry"))
    return requests.join(best, key, "left")


def provenance(natives: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Sources whose hash is among a native's recorded source hashes, where the native's own hash is the recorded one. The list is exploded into an equi-join."""
    fit = natives.where(F.col("recorded_sha256") == F.col("actual_sha256")).select("native", F.explode("source_hashes").alias("sha256"))
    return sources.join(fit.distinct(), "sha256").groupBy(key).agg(F.min("native").alias("native"))


def resolve_components(references: DataFrame, components: DataFrame, document: str) -> DataFrame:
    """References such as sam_0003_cc_002 joined to their components; resolved tells which were found."""
    pattern = r"^sam_([0-9]{4,})_cc_([0-9]{3,})$"
    r = references.withColumn("raw_id", F.regexp_extract("reference", pattern, 1)).withColumn("component_id", F.regexp_extract("reference", pattern, 2))
    r = r.withColumn("raw_id", F.when(F.col("raw_id") != "", F.col("raw_id").cast("int"))).withColumn("component_id", F.when(F.col("component_id") != "", F.col("component_id").cast("int")))
    return r.join(components.withColumn("resolved", F.lit(True)), [document, "raw_id", "component_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def roles(files: DataFrame, bundle: str) -> DataFrame:
    """(bundle, role, path, claims): the one file of each role; path is null where several claim it."""
    r = files.withColumn("role", role_of(F.col("path"))).where(F.col("role").isNotNull())
    return r.groupBy(bundle, "role").agg(F.count(F.lit(1)).alias("claims"), F.min("path").alias("path")).withColumn("path", F.when(F.col("claims") == 1, F.col("path")))


def missing_roles(files: DataFrame, bundle: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Required roles that no file of a bundle has."""
    wanted = files.select(bundle).distinct().select(bundle, F.explode(F.array(*[F.lit(r) for r in required])).alias("role"))
    return wanted.join(roles(files, bundle), [bundle, "role"], "left_anti")


def layout_plan(files: DataFrame, bundle: str, status: str) -> tuple[DataFrame, DataFrame]:
    """(plan, problems): where each file of a bundle goes, and destinations that two files claim or that are also a folder of another."""
    p = F.regexp_replace("path", r"\\", "/")
    role = role_of(F.col("path"))
    target = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    result = F.when(F.col(status) == "PASS", "RESULT.png").otherwise("REVIEW_REQUIRED.png")
    other = F.when(F.lower(p).startswith("technical/"), p).otherwise(F.concat(F.lit("TECHNICAL/_OTHER/"), p))
    plan = files.withColumn("destination", F.when(role == "result", result).when(role.isNotNull(), target[role]).otherwise(other))
    keyed = plan.select(bundle, F.lower("destination").alias("k"))
    twice = keyed.groupBy(bundle, "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(bundle, "k", F.lit("claimed_twice").alias("problem"))
    parts = F.split("k", "/")
    above = keyed.where(F.size(parts) > 1).select(bundle, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("k"))
    folders = keyed.join(above.distinct(), [bundle, "k"], "left_semi").select(bundle, "k", F.lit("file_and_folder").alias("problem"))
    return plan, twice.union(folders)


def owned_by(bundle_source: Column, source: Column, bundle_root: Column, root: Column) -> Column:
    """True if a bundle's recorded source and batch root are these, whatever case and slashes."""
    return F.coalesce((path_identity(bundle_source) == path_identity(source)) & path_identity(bundle_root).eqNullSafe(path_identity(root)), F.lit(False))


def three_way(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are missing, extra or changed (values compared without case), and repeated ones."""
    e = expected.select(key, F.lower(value).alias("_e"), F.lit(True).alias("_ie"))
    f = found.groupBy(key).agg(F.min(F.lower(value)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    j = e.join(f, key, "full")
    kind = F.when(F.col("_n").isNull(), "missing").when(F.col("_ie").isNull(), "extra").when(F.col("_n") > 1, "repeated").when(F.col("_e") != F.col("_f"), "changed")
    return j.withColumn("difference", kind).where(F.col("difference").isNotNull()).select(key, "difference")


def verified(expected: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Every expected file with what is wrong with it: missing, sha256_mismatch or null."""
    got = files.select(key, F.lower("sha256").alias("_got"))
    return expected.join(got, key, "left").withColumn("failure", F.when(F.col("_got").isNull(), "missing").when(F.col("_got") != F.lower("sha256"), "sha256_mismatch")).drop("_got")


def asset_records(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"), (F.octet_length(content) > 0).alias("non_empty"))


def first_seen(candidates: DataFrame, path: str, order: str) -> DataFrame:
    """Each path once, whatever its case, as first seen."""
    k = F.lower(F.regexp_replace(path, r"\\", "/"))
    return candidates.groupBy(k.alias("path_key")).agg(F.min(F.struct(order, path)).alias("m")).select("path_key", F.col(f"m.{path}").alias(path), F.col(f"m.{order}").alias(order))


def member_problems(members: DataFrame, referenced: DataFrame, archive: str, required: tuple[str, ...], first: str) -> DataFrame:
    """(archive, problem, name): members that nothing refers to, references without a member, repeats, missing required members, a wrong first member."""
    m, r = members.select(archive, "name"), referenced.select(archive, "name").distinct()
    fixed = F.col("name").isin(*required, first)
    loose = m.where(~fixed).distinct().join(r, [archive, "name"], "left_anti").select(archive, F.lit("unreferenced").alias("problem"), "name")
    gone = r.join(m, [archive, "name"], "left_anti").select(archive, F.lit("absent").alias("problem"), "name")
    twice = m.groupBy(archive, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(archive, F.lit("repeated").alias("problem"), "name")
    have = members.groupBy(archive).agg(F.collect_set(F.when(fixed, F.col("name"))).alias("have"), F.min_by("name", "ord").alias("head"))
    need = have.select(archive, F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), "have")).alias("name")).select(archive, F.lit("required").alias("problem"), "name")
    head = have.where(F.col("head") != first).select(archive, F.lit("first_member").alias("problem"), F.col("head").alias("name"))
    return loose.union(gone).union(twice).union(need).union(head)


def tree_differences(planned: DataFrame, reopened: DataFrame, document: str) -> DataFrame:
    """Nodes (by path) whose kind, name, visibility, box or order differs, or that one tree lacks."""
    names = ("name", "kind", "visible", "bbox", "ord")
    a = planned.select(document, "path", F.struct(*names).alias("_a"))
    b = reopened.select(document, "path", F.struct(*names).alias("_b"))
    return a.join(b, [document, "path"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(document, "path", F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").otherwise("changed").alias("difference"))


def batch_summary(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of a batch: done, failed, the messages, the exit code. A failed row doesn't stop the others."""
    failed = F.col("error").isNotNull()
    return jobs.groupBy(*keys).agg(F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"), F.sort_array(F.collect_set("error")).alias("messages"), F.when(F.count_if(failed) > 0, 1).otherwise(0).alias("exit_code"))
