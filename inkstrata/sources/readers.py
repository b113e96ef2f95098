"""Readers: image listings, recognition tables, JSON lines and objects, hash manifests, pinned requirements, raw pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import over_white
from ..functions.text import package_name, safe_relative_path

# Fixed values.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
TSV = "level INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, left INT, top INT, width INT, height INT, conf DOUBLE, text STRING"


def image_files(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (), *, content: bool = False) -> DataFrame:
    """Images below a folder, with relative path, size and (on request) bytes, in the order of their relative paths in lower case. Listing reads no content unless asked to."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.regexp_replace(F.lit(folder), "^[a-z]+:/*", "/").cast("string")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.expr("substring(p, length(b) + 2)")
    d = files.withColumn("p", path).withColumn("b", F.rtrim(base, F.lit("/"))).withColumn("relative", rel)
    d = d.where(F.lower("relative").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))
    for x in excluded:
        d = d.where(~F.col("relative").startswith(x.rstrip("/") + "/"))
    keep = ["relative", F.col("length").alias("bytes"), *(["content"] if content else [])]
    return d.select(*keep).orderBy(F.lower("relative"))


def listed(files: DataFrame, path: str) -> DataFrame:
    """The same choice over a table of paths."""
    return files.where(F.lower(path).rlike(rf"\.({'|'.join(EXTENSIONS)})$"))


def ambiguous_stems(files: DataFrame, path: str) -> DataFrame:
    """Stems that several files share: a name without its extension can't tell them apart."""
    stem = F.lower(F.regexp_extract(F.col(path), r"([^/\\]+?)(?:\.[^./\\]+)?$", 1))
    return files.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def recognition_tsv(spark: SparkSession, path: str, *, quoted: bool = False) -> DataFrame:
    """Words of a recogniser's TSV. Quotes are ordinary characters unless ``quoted``: a lone one in a word must not swallow the rows after it. ord is the row's order in its file."""
    reader = spark.read.schema(TSV).option("sep", "\t").option("header", "true").option("mode", "PERMISSIVE")
    reader = reader if quoted else reader.option("quote", "")
    words = reader.csv(path)
    return words.withColumn("ord", F.monotonically_increasing_id()).where((F.col("conf") >= 0) & (F.trim("text") != ""))


def json_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """One row a non-blank line: the parsed request, or ok = false and the line where it is no JSON object. A byte order mark in front is not part of a line."""
    line = F.regexp_replace(value, "^\\uFEFF+", "")
    d = lines.withColumn("line", line).where(F.trim("line") != "")
    parsed = F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = d.withColumn("r", parsed)
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.trim("line").startswith("{")
    return d.select("line", (~bad).alias("ok"), F.when(~bad, F.col("r")).alias("request"), F.when(bad, F.lit("invalid-request")).alias("error"))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects, UTF-8 with or without a byte order mark; ok tells whether the root is an object that fits."""
    files = spark.read.option("wholetext", "true").text(path)
    return json_lines(files, schema)


def hash_manifest(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of lines of SHA-256, two spaces, path; comments and blank lines don't count."""
    t = F.trim(F.col(value))
    d = lines.withColumn("t", t).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    digest, path = F.lower(F.regexp_extract("t", r"^([0-9A-Fa-f]{64})\s{2,}(.+)$", 1)), F.regexp_replace(F.regexp_extract("t", r"^([0-9A-Fa-f]{64})\s{2,}(.+)$", 2), r"\\", "/")
    d = d.select("t", digest.alias("sha256"), path.alias("path"))
    bad = d.where(F.col("sha256") == "").select("t", F.lit("malformed").alias("problem"))
    good = d.where(F.col("sha256") != "")
    unsafe = good.where(~safe_relative_path(F.col("path"))).select("t", F.lit("unsafe_path").alias("problem"))
    twice = good.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")).where("n > 1").select("t", F.lit("repeated").alias("problem"))
    return good.select("path", "sha256"), bad.union(unsafe).union(twice)


def pinned(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(pins, problems) of lines of package==version; names in canonical form."""
    d = lines.withColumn("t", F.trim(F.col(value))).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9_.-]*)==([^\s;]+)$"
    good = d.where(F.col("t").rlike(pattern)).select("t", package_name(F.regexp_extract("t", pattern, 1)).alias("package"), F.regexp_extract("t", pattern, 2).alias("version"))
    bad = d.where(~F.col("t").rlike(pattern)).select("t", F.lit("not_a_pin").alias("problem"))
    twice = good.groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")).where("n > 1").select("t", F.lit("repeated").alias("problem"))
    return good.select("package", "version"), bad.union(twice)


def on_white(r: Column, g: Column, b: Column, alpha: Column) -> list[Column]:
    """RGB over white, in integers."""
    return [over_white(c, alpha) for c in (r, g, b)]


def as_raster(df: DataFrame, vector: str, side: int = 8) -> DataFrame:
    """A vector of -1 to 1 as a square 8-bit raster in long form: y, x, v."""
    v = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("e").cast("double") + 1) / 2)) * 255).cast("long")
    keep = [c for c in df.columns if c != vector]
    return df.select(*keep, F.posexplode(vector).alias("i", "e")).select(*keep, F.floor(F.col("i") / side).cast("int").alias("y"), F.pmod("i", F.lit(side)).cast("int").alias("x"), v.alias("v"))


def recognition_rows(lines: DataFrame, keys: list[str], value: str = "value", *, quoted: bool = False) -> DataFrame:
    """The words in TSV lines that a table holds, by the rules of ``recognition_tsv``; its headers have no confidence and so are no words."""
    quote = {} if quoted else {"quote": ""}
    r = F.from_csv(value, TSV, {"sep": "\t", "mode": "PERMISSIVE", **quote})
    return lines.select(*keys, r.alias("r")).select(*keys, "r.*").where((F.col("conf") >= 0) & (F.trim("text") != ""))


def resolved(tokens: DataFrame, files: DataFrame, folder: str = "INPUT") -> DataFrame:
    """(token, path, problem) of names given by a user against a listing (path, is_dir): the name below ``folder``, then as it is; then, if it has no extension, the one image of that name below ``folder``.

    A directory is taken as it is. Problems: unsupported (a file of another kind), ambiguous, missing (null and empty names too). Tokens are taken once each."""
    t = F.col("token")
    rooted = t.startswith("/")
    bare = ~t.rlike(r"[^/.][^/]*\.[^/.]+/?$")
    place = lambda rank, path: F.struct(F.lit(rank).alias("rank"), path.alias("path"))
    below = F.concat(F.lit(f"{folder}/"), t)
    probes = F.array(*[place(2, F.concat(below, F.lit(f".{x}"))) for x in EXTENSIONS])
    places = F.when(rooted, F.array(place(0, t))).when(bare, F.concat(F.array(place(0, below), place(1, t)), probes)).otherwise(F.array(place(0, below), place(1, t)))
    d = tokens.select("token").distinct().select("token", F.explode_outer(places).alias("c")).select("token", "c.rank", "c.path")
    found = files.select("path", F.col("is_dir").alias("_dir")).distinct()
    hit = F.when(F.col("_dir").isNotNull(), F.struct("rank", "path", "_dir"))
    g = d.join(found.where(F.col("path").isNotNull()), "path", "left").where(~((F.col("rank") == 2) & F.coalesce("_dir", F.lit(False)))).groupBy("token").agg(F.min(hit).alias("h"), F.count(F.when(F.col("rank") == 2, hit)).alias("n"))
    image = F.lower("h.path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")
    problem = F.when(F.col("h").isNull(), "missing").when((F.col("h.rank") == 2) & (F.col("n") > 1), "ambiguous").when(~F.col("h._dir") & ~image, "unsupported")
    return g.select("token", F.when(problem.isNull(), F.col("h.path")).alias("path"), problem.alias("problem"))


def pinned_tools(candidates: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, path, incompatible): the bundled tool where it exists, else the first (by ord) that exists, ran without an error and told a version of the pattern; the fallbacks tried in vain before it, in order.

    candidates: path, bundled, exists, ord, exit_code, output. Nothing is run here."""
    fits = F.col("exists") & (F.col("bundled") | ((F.col("exit_code") == 0) & F.col("output").rlike(pattern)))
    tried = F.col("exists") & ~F.col("bundled") & ~F.coalesce(fits, F.lit(False))
    g = candidates.groupBy(*keys).agg(F.min(F.when(fits, F.struct((~F.col("bundled")).alias("fallback"), "ord", "path"))).alias("b"), F.array_sort(F.collect_list(F.when(tried, F.struct("ord", "path")))).alias("t"))
    before = F.filter("t", lambda x: F.col("b").isNull() | (F.col("b.fallback") & (x["ord"] < F.col("b.ord"))))
    return g.select(*keys, F.col("b.path").alias("path"), F.transform(before, lambda x: x["path"]).alias("incompatible"))
