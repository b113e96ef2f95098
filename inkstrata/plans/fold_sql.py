"""The ordered folds of ``operators.folds`` in SQL: recursive queries that carry what is kept from one row of an image to the next."""

from __future__ import annotations

from .fixtures import AREA, BOXES, COMMON, IOU, A, B

KEPT = "STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, size BIGINT, score DOUBLE, category VARCHAR)[]"
ITEM = "{'id': a.id, 'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': a.y1, 'size': a.size, 'score': a.score, 'category': a.category}"
HELD = f"(CASE WHEN least({A}, {B}) = 0 THEN 0.0 ELSE {COMMON} / least({A}, {B})::DOUBLE END)"
ROWS = f"{BOXES}, c AS (SELECT image, id, x0, y0, x1, y1, size, price AS score, (size % 3)::VARCHAR AS category FROM boxes)"


def fold(name: str, rows: str, order: str, kept: str, key: str = "image") -> str:
    """Queries ``name``_o (rows numbered by key and order), ``name``_f (the kept list after every row) and ``name`` (the last one's items); ``kept`` is the list after row a, from f.kept."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {rows}), {name}_f AS (SELECT {key}, 0::BIGINT AS i, []::{KEPT} AS kept FROM (SELECT DISTINCT {key} FROM {rows}) UNION ALL SELECT {", ".join(f"a.{k.strip()}" for k in key.split(","))}, a.i, {kept} AS kept FROM {name}_f f JOIN {name}_o a ON {" AND ".join(f"a.{k.strip()} = f.{k.strip()}" for k in key.split(","))} AND a.i = f.i + 1),
{name} AS (SELECT unnest(kept).id AS id FROM (SELECT arg_max(kept, i) AS kept FROM {name}_f GROUP BY {key}))"""


def greedy(name: str, rows: str, order: str, duplicate: str) -> str:
    """Rows kept unless they duplicate (a, the row; b, a kept one) one that is."""
    return fold(name, rows, order, f"CASE WHEN len(list_filter(f.kept, lambda b: {duplicate})) = 0 THEN list_append(f.kept, {ITEM}) ELSE f.kept END")


NMS = f"WITH RECURSIVE {ROWS}, {greedy('n', 'c', 'score DESC, (x1 - x0) * (y1 - y0) DESC, id', f'{IOU} >= 0.82 OR ({HELD} >= 0.94 AND least({A}, {B}) / greatest({A}, {B}, 1)::DOUBLE >= 0.72)')} SELECT c.image, c.id AS raw_id, 1 AS component_id, x0, y0, x1, y1, score FROM c JOIN n USING (id)"

DRAFTS = f"""WITH RECURSIVE {ROWS}, {greedy('t', 'c', 'score DESC, y0, x0, id::VARCHAR', f'{IOU} >= 0.55 OR {HELD} >= 0.86')}, l AS (SELECT c.* FROM c JOIN t USING (id)), {greedy('m', 'l', 'id', f'greatest(a.size, b.size) / greatest(1, least(a.size, b.size))::DOUBLE <= 1.35 AND {IOU} > 0.82')}
SELECT image, id, x0, y0, x1, y1, score AS quality, id::VARCHAR AS text, size AS area FROM c JOIN m USING (id)"""

# A better detection takes the place of the first one it overlaps and goes to the end of its label's list.
_FIRST = f"list_position(list_transform(f.kept, lambda b: {IOU} > 0.72), true)"
_BETTER = f"CASE WHEN coalesce({_FIRST}, 0) = 0 THEN list_append(f.kept, {ITEM}) WHEN a.score > f.kept[{_FIRST}].score THEN list_append(list_filter(f.kept, lambda b: b.id <> f.kept[{_FIRST}].id), {ITEM}) ELSE f.kept END"
DETECTIONS = f"""WITH RECURSIVE {ROWS}, {fold('k', 'c', 'id', _BETTER, 'image, category')}, s AS (SELECT c.*, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS rn FROM c JOIN k USING (id)) SELECT image, id, x0, y0, x1, y1, score, category AS label FROM s WHERE rn <= 24"""

_TEXT = "(a.category = 'text_raster')"
_RATIO = f"greatest({A}, {B}) / greatest(1, least({A}, {B}))::DOUBLE"
_INSIDE = f"least({COMMON} / greatest({A}, 1)::DOUBLE, {COMMON} / greatest({B}, 1)::DOUBLE)"
_CONFLICT = f"{_TEXT} = (b.category = 'text_raster') AND ((NOT {_TEXT} AND {IOU} > 0.42 AND {_RATIO} < 2.2) OR (a.category = b.category AND ({IOU} > 0.58 OR {_INSIDE} > 0.88)))"
_PLACE = f"coalesce(list_position(list_transform(f.kept, lambda b: {_CONFLICT}), true), 0)"
_WORTH = f"{A} * a.score > list_extract(list_transform(f.kept, lambda b: {B} * b.score), {_PLACE})"
_TAKEN = f"CASE WHEN {_PLACE} = 0 THEN list_append(f.kept, {ITEM}) WHEN {_WORTH} THEN list_concat(f.kept[:{_PLACE} - 1], [{ITEM}], f.kept[{_PLACE} + 1:]) ELSE f.kept END"
LAYERS = f"""WITH RECURSIVE {BOXES}, c AS (SELECT image, id, x0, y0, x1, y1, size, price / 2000 AS score, CASE size % 4 WHEN 0 THEN 'text_raster' WHEN 1 THEN 'object' ELSE 'detail_group' END AS category FROM boxes), {fold('s', 'c', 'id', _TAKEN)} SELECT image, id, x0, y0, x1, y1, score, category FROM c JOIN s USING (id)"""

_MATCH = f"{COMMON} / greatest(1, {B})::DOUBLE * 0.62::DOUBLE + {COMMON} / greatest(1, {A})::DOUBLE * 0.23::DOUBLE + least({A}, {B}) / greatest({A}, {B})::DOUBLE * 0.15::DOUBLE"
_FREE = "list_filter(d.c, lambda x: NOT list_contains(list_transform(f.kept, lambda b: b.id), x.id))[1]"
OBJECTS = f"""WITH RECURSIVE {BOXES}, p AS (SELECT a.image, a.id AS detection, b.id, b.x0, b.y0, b.x1, b.y1, {_MATCH} AS match FROM boxes a JOIN boxes b ON a.image = b.image AND a.id % 4 = 0 AND b.id % 4 <> 0 AND {COMMON} > 0),
d AS (SELECT image, detection, row_number() OVER (PARTITION BY image ORDER BY detection) AS i, list({{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'detection': detection, 'match': match}} ORDER BY match DESC, id) AS c FROM p GROUP BY image, detection),
f AS (SELECT image, 0::BIGINT AS i, []::STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT, detection BIGINT, match DOUBLE)[] AS kept FROM (SELECT DISTINCT image FROM d) UNION ALL SELECT image, i, CASE WHEN a.match >= 0.43 AND len(list_filter(kept, lambda b: {IOU} > 0.62)) = 0 THEN list_append(kept, a) ELSE kept END FROM (SELECT d.image, d.i, f.kept, {_FREE} AS a FROM f JOIN d ON d.image = f.image AND d.i = f.i + 1)),
k AS (SELECT image, unnest(arg_max(kept, i)) AS k FROM f GROUP BY image) SELECT image, k.detection, k.id AS candidate, k.match, k.x0, k.y0, k.x1, k.y1 FROM k"""

_MIRROR = f"abs((a.x0 + a.x1) / 2.0 + (b.x0 + b.x1) / 2.0 - 120) <= 0.065::DOUBLE * 120 AND abs((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0) <= 0.055::DOUBLE * 106 AND least({A}, {B}) / greatest({A}, {B}, 1)::DOUBLE >= 0.55"
SYMMETRIC = f"""WITH RECURSIVE {BOXES}, c AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY id) AS i FROM boxes), l AS (SELECT a.image, a.i, a.id, a.size % 5 > 0 AS free, coalesce(list(b.id ORDER BY b.id) FILTER (b.id IS NOT NULL), []) AS fits FROM c a LEFT JOIN c b ON a.image = b.image AND b.id > a.id AND a.size % 5 > 0 AND b.size % 5 > 0 AND {_MIRROR} GROUP BY ALL),
f AS (SELECT DISTINCT image, 0::BIGINT AS i, []::BIGINT[] AS taken FROM c UNION ALL SELECT l.image, l.i, CASE WHEN NOT l.free OR list_contains(f.taken, l.id) OR len(list_filter(l.fits, lambda b: NOT list_contains(f.taken, b))) = 0 THEN f.taken ELSE list_concat(f.taken, [l.id, list_filter(l.fits, lambda b: NOT list_contains(f.taken, b))[1]]) END FROM f JOIN l ON l.image = f.image AND l.i = f.i + 1),
t AS (SELECT image, arg_max(taken, i) AS taken FROM f GROUP BY image) SELECT c.image, c.id, x0, y0, x1, y1, CASE WHEN size % 5 = 0 THEN 'standalone_row' ELSE 'standalone_object' END AS role, 120 AS width, 106 AS height, CASE WHEN list_contains(taken, c.id) THEN CASE WHEN list_position(taken, c.id) % 2 = 1 THEN taken[list_position(taken, c.id) + 1] ELSE taken[list_position(taken, c.id) - 1] END END AS partner FROM c JOIN t USING (image)"""

NAMES = """WITH f AS (SELECT 'Scan' || page_id % 40 AS stem, CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.png' END AS suffix, page_id FROM pages), r AS (SELECT *, 'in/' || stem || '.' || page_id || suffix AS relative, count(*) OVER (PARTITION BY lower(stem)) AS n FROM f), s AS (SELECT *, CASE WHEN n > 1 THEN stem || '_' || lower(suffix[2:]) ELSE stem END AS out FROM r)
SELECT relative, CASE WHEN row_number() OVER (PARTITION BY lower(out) ORDER BY lower(relative), relative) > 1 THEN out || '_' || sha1(relative)[:8] ELSE out END AS stem_out FROM s"""

SAFE_NAMES = r"""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(trim(url), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '\s+', ' ', 'g'), ' ._'), 80), ''), 'layer') AS name FROM pages"""

REALIGNED = r"""SELECT conv_id, turn AS ord, true AS aligned, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' ') AS candidate FROM conversations"""

_LOOSE = "b.size % 2 = 0 AND b.size % 3 > 0"
_COVERED = f"list_filter(f.kept, lambda b: {_LOOSE} AND {COMMON} / greatest(1, {B})::DOUBLE >= 0.82)[1].id"
_WEAKEST = f"list_sort(list_transform(list_filter(f.kept, lambda b: {_LOOSE} AND b.size % 5 = 0), lambda b: {{'score': b.score, 'id': b.id}}))[1].id"
_VICTIM = f"coalesce({_COVERED}, CASE WHEN a.score / 2000 >= 0.80::DOUBLE THEN {_WEAKEST} END)"
EVICTIONS = f"""WITH RECURSIVE {ROWS}, d AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score / 2000 DESC, id) AS i FROM c WHERE id % 10 < 4),
f AS (SELECT image, 0::BIGINT AS i, coalesce(list({ITEM} ORDER BY id) FILTER (id % 10 >= 4), [])::{KEPT} AS kept FROM c a GROUP BY image UNION ALL SELECT a.image, a.i, CASE WHEN len(f.kept) < 60 THEN list_append(f.kept, {ITEM}) WHEN {_VICTIM} IS NOT NULL THEN list_append(list_filter(f.kept, lambda x: x.id <> {_VICTIM}), {ITEM}) ELSE f.kept END FROM f JOIN d a ON a.image = f.image AND a.i = f.i + 1),
l AS (SELECT unnest(arg_max(kept, i)).id AS id FROM f GROUP BY image), w AS (SELECT DISTINCT unnest(kept).id AS id FROM f) SELECT image, id, CASE WHEN id IN (FROM l) THEN CASE WHEN id % 10 < 4 THEN 'in' ELSE 'keep' END WHEN id IN (FROM w) THEN 'evicted' ELSE 'out' END AS action FROM c"""

# Clusters are lists of readings; b is a cluster's middle.
_MIDDLE = ", ".join(f"'{e}': round_even(list_aggregate(list_transform(m, lambda z: z.{e}), 'median'), 0)::BIGINT" for e in ("x0", "y0", "x1", "y1"))
_LINE = """greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0))::DOUBLE >= 0.72 AND abs((a.x0 + a.x1) - (b.x0 + b.x1)) / 2.0 <= greatest(1, a.x1 - a.x0, b.x1 - b.x0) * 0.20::DOUBLE
AND least(greatest(1, a.x1 - a.x0), greatest(1, b.x1 - b.x0)) / greatest(1, a.x1 - a.x0, b.x1 - b.x0)::DOUBLE >= 0.55"""
_JOINED = f"list_transform(list_transform(f.kept, lambda m: {{{_MIDDLE}}}), lambda b, j: CASE WHEN {IOU} >= 0.28 OR ({_LINE}) THEN {{'over': {IOU}::DOUBLE, 'at': j}} END)"
READINGS_SQL = f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y0, x0, id) AS i FROM boxes), f AS (SELECT DISTINCT image, 0::BIGINT AS i, []::STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[][] AS kept FROM boxes
UNION ALL SELECT image, i, CASE WHEN best IS NULL THEN list_append(kept, [item]) ELSE list_concat(kept[:best - 1], [list_append(kept[best], item)], kept[best + 1:]) END FROM (SELECT a.image, a.i, f.kept, {{'id': a.id, 'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': a.y1}} AS item, list_reverse_sort(list_filter({_JOINED}, lambda x: x IS NOT NULL))[1].at AS best FROM f JOIN o a ON a.image = f.image AND a.i = f.i + 1)),
l AS (SELECT image, arg_max(kept, i) AS kept FROM f GROUP BY image), u AS (SELECT kept[n] AS m, n - 1 AS cluster FROM l, unnest(range(1, len(kept) + 1)) t(n)), r AS (SELECT unnest(m).id AS id, cluster FROM u) SELECT image, id AS reading, x0, y0, x1, y1, cluster FROM boxes JOIN r USING (id)"""

PAGE_BOXES = """WITH p AS (SELECT p_partkey AS id, 72.0::DOUBLE / 25.4::DOUBLE AS mm, p_size + 100 AS w, p_size + 150 AS h FROM part), b AS (SELECT id, mm, w, h, (w + 6) * mm AS ow, (h + 6) * mm AS oh, 3 * mm AS l, (w + 3) * mm + CASE WHEN id % 7 = 0 THEN 9 ELSE 0 END AS r, (h + 3) * mm AS t FROM p)
SELECT id, CASE WHEN id % 5 = 0 THEN 'media_invalid' ELSE array_to_string(list_filter([CASE WHEN r > ow + 1 OR t > oh + 1 THEN 'bleed_misses_trim' END, CASE WHEN abs(r - l - w * mm) > 1 OR abs(t - l - h * mm) > 1 THEN 'trim_size' END, CASE WHEN abs(l - 3 * mm) > 1 OR abs(ow - r - 3 * mm) > 1 OR abs(oh - t - 3 * mm) > 1 THEN 'bleed_side' END], lambda x: x IS NOT NULL), ';') END AS errors FROM b"""

FONTS = """WITH f(font_id, family, subfamily, path, lo, hi, bonus, plain) AS (VALUES (1, 'arial', 'bold', '/a.ttf', 32, 126, 180.0, 0.0), (2, 'arial', 'regular', '/b.ttf', 32, 126, 180.0, 1.0), (3, 'tahoma', 'italic', '/c.ttf', 32, 90, 175.0, -30.0)), p AS (SELECT DISTINCT n_nationkey AS text_id, ord(unnest(string_split(n_name, ''))) AS p FROM nation),
c AS (SELECT text_id, f.*, avg((p BETWEEN lo AND hi)::INT) AS coverage FROM p, f GROUP BY ALL), s AS (SELECT *, round(coverage * 1000.0 + bonus + plain, 9) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, family DESC, subfamily DESC, path DESC) AS rn FROM s) SELECT text_id, font_id, score::DOUBLE AS score, coverage FROM r WHERE rn = 1"""
