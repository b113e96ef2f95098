"""Personal data: base identifiers by pattern, further ones by bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# The base kinds and their patterns. Quantifiers are possessive where nothing after them could need a character back, and a match may begin
# only at the end of the one before or where no character of its first class stands in front; both leave the leftmost matches as they are and keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARD = {"email": "@", "ip": None, "card": None, "phone": "+"}
SPAN = "struct<start:int,end:int,text:string>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


RUN = 256  # matches whose places are added up together: a document's cost grows with matches x (RUN + matches / RUN)


def _sums(lengths: Column) -> Column:
    """Running sums of an array of numbers, itself left out: [0, l0, l0 + l1, ...]; in runs, as each append copies its array."""
    fold = lambda numbers, first: F.aggregate(
        numbers,
        F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")),
        lambda acc: acc["all"],
    )
    runs = _once(lengths, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(n) / RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(n, i * RUN + 1, F.lit(RUN))))
    return _once(runs, lambda r: F.flatten(F.zip_with(r, fold(F.transform(r, lambda one: F.aggregate(one, F.lit(0), lambda a, x: a + x)), F.lit(0)), fold)))


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (gap, hit, start): the non-overlapping matches with the text in front of each and their places in code points. A last piece without a hit has the text behind."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    starts = lambda z: _sums(F.transform(z, lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))))
    return _once(zipped, lambda z: F.zip_with(z, starts(z), lambda x, at: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (at + F.char_length(x["gap"])).alias("start"))))


def _matches(text: Column, pattern: str) -> Column:
    """The non-overlapping matches with their places in code points."""
    hits = F.filter(_pieces(text, pattern), lambda p: p["hit"].isNotNull())
    return F.transform(hits, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.char_length(p["hit"])).alias("end"), p["hit"].alias("text")).cast(SPAN))


def luhn(digits: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return ~hit.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, text) of one kind; texts without a character that the kind needs aren't searched."""
    guard = F.contains(text, F.lit(_GUARD[kind])) if _GUARD[kind] else text.rlike("[0-9]")
    return F.when(guard, F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("word")))


# What may be an identifier: an e-mail address, a number in groups, a telephone number, or a word with a digit.
_INSTANCE = (
    r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])[0-9]{2,7}(?:[\x20-][0-9]{2,7}){2,}(?![0-9])"
    r"|(?:\G|(?<![^\s\"'=<>()\[\],;:]))(?=[^\s0-9@\"'=<>()\[\],;:]*+[0-9@])[^\s\"'=<>()\[\],;:]++"
)
_OPENERS, _CLOSERS = " \"'(<[{", " \"')>]}.,;:!?"


def contexts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, start, end, word, seed, patterns) of what may be an identifier in texts with a digit or an @: seed if it holds a base identifier; patterns are the hashes of its lexical contexts.

    Two words l2 l1 in front and r1 r2 behind, in lower case and whole, make seven contexts: l1 _, l2 l1 _, l2 * _, _ r1, _ r1 r2, _ * r2 and l1 _ r1. A neighbour that may be an identifier itself counts as the word #, and
    the text's ends as ^. Words have six letters or digits at least. No shape of the word is looked at.
    """
    docs = docs.select(key, "th", F.col(text).alias("text"), _pieces(F.col(text), _INSTANCE).alias("p"))
    gap = lambda c: F.translate(F.lower(c), "\n\t\r\x0b\x0c", "     ")
    left = lambda p, i: F.concat(F.when(i == 0, F.lit("^ ^ ")).otherwise(F.lit("# # ")), F.ltrim(F.rtrim(gap(p["gap"]), F.lit(_OPENERS))))
    right = lambda p, last: F.concat(F.rtrim(F.ltrim(gap(p["gap"]), F.lit(_CLOSERS))), F.when(last, F.lit(" ^ ^")).otherwise(F.lit(" # #")))
    size = F.size("p")
    found = F.transform(
        F.slice("p", F.lit(1), size - 1),
        lambda p, i: F.struct(
            p["hit"].alias("hit"),
            p["start"].alias("start"),
            F.substring_index(F.rtrim(left(p, i)), " ", -2).alias("l"),
            F.substring_index(F.ltrim(right(F.element_at("p", i + 2), i + 2 == size)), " ", 2).alias("r"),
        ),
    )
    rows = docs.select(key, "th", F.explode(found).alias("s")).select(key, "th", "s.*")
    word = F.regexp_replace("hit", r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    lead = F.char_length(F.regexp_extract("hit", r"^[^\p{L}\p{N}+]*", 0))
    rows = rows.select(key, "th", (F.col("start") + lead).alias("start"), word.alias("word"), "l", "r").where(F.char_length(F.regexp_replace("word", r"[^\p{L}\p{N}]", "")) >= 6)
    seed = F.lit(False)
    for kind in PATTERNS:
        seed = seed | (F.size(base_spans(F.col("word"), kind)) > 0)
    l2, l1 = F.substring_index("l", " ", 1), F.substring_index("l", " ", -1)
    r1, r2 = F.substring_index("r", " ", 1), F.substring_index("r", " ", -1)
    made = {"l1 _": (l1,), "l2 l1 _": (l2, l1), "l2 * _": (l2,), "_ r1": (r1,), "_ r1 r2": (r1, r2), "_ * r2": (r2,), "l1 _ r1": (l1, r1)}
    patterns = F.array(*[F.xxhash64(F.lit(name), *words) for name, words in made.items()])
    return rows.select(key, "th", "start", (F.col("start") + F.char_length("word")).alias("end"), "word", seed.alias("seed"), patterns.alias("patterns"))


def bootstrap(candidates: DataFrame, *, rounds: int = 3, support: int = 3, precision: float = 0.6) -> DataFrame:
    """Words of candidates (word, seed, patterns) that earn the trust of high-confidence patterns: (word, confidence).

    Patterns and words make a graph: a pattern's confidence is the mean confidence of the distinct words that it extracts, a word's confidence that of its best pattern; seeds stay at 1, other words begin at 0.
    Each round scores patterns, then words. A pattern counts from ``support`` distinct words and ``precision`` on; so do words.
    Counts are combined before any shuffle, so a frequent context is no hot key; the graph holds distinct (pattern, word) pairs only.
    """
    graph = written(candidates.select("word", F.explode("patterns").alias("pattern")).distinct(), "pii-graph")
    seed = written(candidates.where("seed").select("word").distinct(), "pii-seeds").withColumn("seed", F.lit(1.0))
    trust = seed.select("word", F.col("seed").alias("trust"))
    for _ in range(rounds):
        known = graph.join(trust, "word", "left")
        rate = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("trust", F.lit(0.0))).alias("good"))
        scored = written(rate.where((F.col("n") >= support) & (F.col("good") >= precision * F.col("n"))).select("pattern", (F.col("good") / F.col("n")).alias("rate")), "pii-patterns")
        gained = graph.join(scored, "pattern").groupBy("word").agg(F.max("rate").alias("trust"))
        trust = written(gained.join(seed, "word", "full").select("word", F.coalesce("seed", "trust").alias("trust")), "pii-trust")
    return trust.where(F.col("trust") >= precision).select("word", F.col("trust").alias("confidence"))


def _apart(added: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The added spans (key, th, span) that overlap no base span of their text: a running maximum of ends and minimum of starts, no pairs."""
    of_base = base.select(key, "th", F.explode("base").alias("span")).select(key, "th", "span", F.lit(0).alias("mine"))
    met = of_base.join(added.select(F.col(key).alias("k2"), F.col("th").alias("th2")).distinct(), F.col(key).eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left_semi").distinct()
    both = met.unionAll(added.select(key, "th", "span", F.lit(1).alias("mine")))
    order = Window.partitionBy(key, "th").orderBy("span.start", "mine")
    ends = F.max(F.when(F.col("mine") == 0, F.col("span.end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(F.col("mine") == 0, F.col("span.start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tested = both.select(key, "th", "span", "mine", ends.alias("e"), starts.alias("s"))
    return tested.where((F.col("mine") == 1) & (F.coalesce("e", F.lit(0)) <= F.col("span.start")) & (F.col("s").isNull() | (F.col("s") >= F.col("span.end")))).select(key, "th", "span")


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of docs: key, n_email, n_ip, n_card, n_phone, base (array of kind, start, end), found (base and further spans; kind ``other`` for these).

    Further spans come from contexts alone: words that high-confidence patterns extract (see contexts() and bootstrap()); they have a digit, or an @, and six letters or digits at least.
    Places are code points, end exclusive. Null and empty texts have no span. Further spans belong to a key and text, so repeated rows get the same. An empty table gives none; further columns of docs go.
    Base spans stay whatever the method adds; an added span never overlaps a base span. Arrays hold the spans of one document.
    """
    src = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = [_of_kind(base_spans(F.col("text"), k), k) for k in PATTERNS]
    rich = F.col("text").rlike("[0-9@]")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,word:string>>")
    # texts without a digit or @ hold none of it: their text goes no further
    held = written(src.select(key, F.when(rich, F.concat(*kinds)).otherwise(empty).alias("base"), F.when(rich, F.xxhash64("text")).alias("th"), F.when(rich, F.col("text")).alias("text")), "pii-base")
    cand = written(contexts(held.where(F.col("text").isNotNull()).select(key, "th", "text"), key, "text"), "pii-candidates")
    trusted = bootstrap(cand)
    added = cand.where("not seed").join(trusted, "word").select(key, "th", F.struct(F.lit("other").alias("kind"), "start", "end", "word").alias("span")).distinct()
    added = written(added, "pii-added")
    more = written(_apart(added, held, key).groupBy(key, "th").agg(F.sort_array(F.collect_list("span")).alias("more")), "pii-more")
    out = held.select(key, "base", "th").join(more.withColumnRenamed(key, "k2").withColumnRenamed("th", "th2"), F.col(key).eqNullSafe(F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(key, *[count(k) for k in PATTERNS], bare("base").alias("base"), bare(F.concat("base", F.coalesce("more", empty))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end by kind as listed (further kinds behind), then start, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate([*PATTERNS, "other"]) for x in (F.lit(k), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the one that begins first is replaced up to where the last one ends."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rest"), s["kind"].alias("kind"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["rest"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.array_append(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text))))
