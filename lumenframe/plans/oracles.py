"""DuckDB SQL twins of the registered queries."""

from __future__ import annotations

import hashlib
import math

from lumenframe.plans import fixtures

_IMAGES = r"""images AS (
  SELECT o_orderkey AS seq, 'img_' || (o_orderkey % 9973) AS image_id,
         o_orderpriority || '/img_' || (o_orderkey % 9973)
           || (['.jpg', '.png', '.jpeg', '.bmp', '.tif', '.webp', '.JPG'])[o_orderkey % 7 + 1] AS image_path,
         o_orderpriority AS dataset, CAST(o_custkey % 13 * 100 AS INTEGER) AS width, CAST(o_custkey % 11 * 80 AS INTEGER) AS height,
         CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE '' END AS split
  FROM orders)"""

_BOXES = r"""boxes AS (
  SELECT l_orderkey AS seq,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1
              AS INTEGER) AS object_index,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'NF' THEN 1 WHEN 'NO' THEN 3 WHEN 'RF' THEN 7 WHEN 'AO' THEN -1 ELSE 12 END AS class_id,
         CASE l_returnflag || l_linestatus WHEN 'RO' THEN '' ELSE 'cell-' || l_returnflag || l_linestatus END AS class_name,
         (l_partkey % 1050) / 1000.0::DOUBLE AS xc, (l_suppkey % 104) / 100.0::DOUBLE AS yc,
         (CAST(l_quantity AS BIGINT) % 50) / 64.0::DOUBLE AS w, (l_partkey % 33) / 32.0::DOUBLE AS h,
         round(l_discount * 12, 2) AS confidence, 0.0::DOUBLE AS area
  FROM lineitem)"""

_CORNERS = r"""corners AS (
  SELECT l_orderkey AS seq,
         CAST(l_partkey % 500 AS DOUBLE) AS x1, CAST(l_suppkey % 60 AS DOUBLE) AS y1,
         CAST(l_partkey % 500 + CAST(l_quantity AS BIGINT) - 3 AS DOUBLE) AS x2, CAST(l_suppkey % 60 + 2 * CAST(l_quantity AS BIGINT) - 5 AS DOUBLE) AS y2,
         CAST(l_partkey % 500 + l_linenumber * 4 - 8 AS DOUBLE) AS u1, CAST(l_suppkey % 60 + l_linenumber * 3 - 6 AS DOUBLE) AS v1,
         CAST(l_partkey % 500 + l_linenumber * 4 + 12 AS DOUBLE) AS u2, CAST(l_suppkey % 60 + l_linenumber * 3 + 20 AS DOUBLE) AS v2
  FROM lineitem),
geo AS (
  SELECT *, greatest(0, x2 - x1) AS w1, greatest(0, y2 - y1) AS h1, greatest(0, u2 - u1) AS w2, greatest(0, v2 - v1) AS h2,
         CASE WHEN least(x2, u2) > greatest(x1, u1) AND least(y2, v2) > greatest(y1, v1)
              THEN (least(x2, u2) - greatest(x1, u1)) * (least(y2, v2) - greatest(y1, v1)) ELSE 0.0 END AS inter
  FROM corners)"""

_TILES = r"""tiles AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + 0.5) * 256) AS INTEGER)))) AS pixels
  FROM embeddings),
px AS (SELECT vec_id, label, unnest(range(64)) AS place, unnest(pixels) AS v FROM tiles),
st AS (SELECT vec_id, any_value(label) AS label, count(*) AS n, min(v) AS least, max(v) AS most, sum(v)::DOUBLE AS total, sum(v * v)::DOUBLE AS squares FROM px GROUP BY vec_id),
m AS (SELECT *, total / n AS mean, sqrt(greatest(0.0, squares / n - (total / n) * (total / n))) AS std FROM st)"""

_COUNTED = r"""counted AS (
  SELECT i.*, coalesce(b.n_objects, 0) AS n_objects FROM images i
  LEFT JOIN (SELECT seq, count(*) AS n_objects FROM boxes GROUP BY seq) b USING (seq))"""

_ANNOTATIONS = r"""ann AS (
  SELECT dataset, image_id AS stem, dataset || '/labels/' || image_id || CASE WHEN seq % 2 = 0 THEN '.txt' ELSE '.xml' END AS annotation_path,
         CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS priority
  FROM images WHERE seq % 5 < 3),
idx AS (SELECT dataset, stem, arg_max(annotation_path, (priority, annotation_path)) AS annotation_path FROM ann GROUP BY dataset, stem),
matched AS (
  SELECT i.*, x.annotation_path FROM images i
  LEFT JOIN idx x ON x.dataset = i.dataset AND x.stem = regexp_replace(split_part(i.image_path, '/', -1), '\.[^.]*$', ''))"""


def _with(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


def _issue(rule_no: int, stage: int, rule: str, severity: str, category: str, table: str, condition: str, index: str) -> str:
    return (
        f"SELECT {stage} AS stage, {rule_no} AS rule_no, '{rule}' AS rule_id, '{severity}' AS severity, '{category}' AS category, "
        f"dataset, seq, {index} AS object_index FROM {table} WHERE {condition}"
    )


_EXT = r"regexp_extract(lower(split_part(image_path, '/', -1)), '.(\.[^.]*)$', 1)"
_BAD_EXT = f"coalesce({_EXT}, '') NOT IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff')"
_PLAIN_PATH = r"lower(regexp_replace(regexp_replace(image_path, '/(\./)+', '/', 'g'), '/+', '/', 'g'))"
_REAL_PATH = rf"regexp_replace({_PLAIN_PATH}, '[^/]+/\.\./', '', 'g')"

#: The views with planted defects, over the plain ones.
_PLANTED = r"""images AS (
  SELECT seq,
    CASE k WHEN 9 THEN NULL WHEN 10 THEN '' ELSE image_id END AS image_id,
    CASE k WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '/data/x/Same.JPG' WHEN 4 THEN '/data/./x//same.jpg' WHEN 17 THEN '/data/y/../x/same.jpg'
           WHEN 18 THEN 'odd.gif' ELSE image_path END AS image_path,
    CASE k WHEN 11 THEN NULL WHEN 12 THEN ' ' WHEN 19 THEN '' ELSE dataset END AS dataset,
    CASE k WHEN 5 THEN NULL WHEN 6 THEN 0 WHEN 7 THEN -5 WHEN 20 THEN NULL ELSE width END AS width,
    CASE k WHEN 8 THEN NULL WHEN 20 THEN -1 WHEN 21 THEN 20000 ELSE height END AS height,
    split, k <> 13 AS file_found, CASE k WHEN 14 THEN 0 ELSE seq + 1000 END AS file_length,
    CASE WHEN k IN (13, 15) THEN -1 ELSE 64 END AS decoded_width, CASE k WHEN 15 THEN -1 WHEN 16 THEN 0 ELSE 48 END AS decoded_height
  FROM (SELECT *, seq % 97 AS k FROM plain_images)),
boxes AS (
  SELECT seq, object_index,
    CASE WHEN j = 1 THEN NULL WHEN j = 2 THEN 99 WHEN j IN (18, 19, 25, 32) THEN 0 ELSE class_id END AS class_id,
    CASE j WHEN 3 THEN NULL WHEN 4 THEN '' ELSE class_name END AS class_name,
    CASE WHEN j = 5 THEN NULL WHEN j = 6 THEN 1.2 WHEN j = 7 THEN -0.1 WHEN j IN (18, 19, 25, 32) THEN 0.5 ELSE xc END AS xc,
    CASE WHEN j = 8 THEN 1.5 WHEN j = 21 THEN NULL WHEN j IN (18, 19, 25, 32) THEN 0.5 ELSE yc END AS yc,
    CASE WHEN j = 9 THEN 0 WHEN j = 10 THEN -0.2 WHEN j = 11 THEN 1.4 WHEN j = 22 THEN NULL WHEN j IN (18, 19, 25, 32) THEN 0.25 ELSE w END AS w,
    CASE WHEN j = 12 THEN 0 WHEN j = 13 THEN -0.3 WHEN j = 14 THEN NULL WHEN j IN (18, 19, 25, 32) THEN 0.25 ELSE h END AS h,
    CASE j WHEN 15 THEN 1.5 WHEN 16 THEN NULL WHEN 17 THEN -0.5 ELSE confidence END AS confidence,
    CASE j WHEN 40 THEN 'same' WHEN 41 THEN NULL ELSE seq || '-' || object_index END AS object_id, j
  FROM (SELECT *, (seq * 7 + object_index) % 89 AS j FROM plain_boxes))"""

_OBJECTS = "objects AS (SELECT b.*, i.dataset, i.image_path, i.width, i.height FROM boxes b JOIN images i USING (seq))"


def _views(planted: bool) -> list[str]:
    if not planted:
        return [_IMAGES, _BOXES]
    return [_IMAGES.replace("images AS", "plain_images AS", 1), _BOXES.replace("boxes AS", "plain_boxes AS", 1), _PLANTED]


def _v1_issues(planted: bool = False) -> str:
    path = "image_path IS NOT NULL AND image_path <> ''"
    size = "width IS NOT NULL AND height IS NOT NULL"
    lines = [
        _issue(0, 2, "V1-IMG-PATH", "ERROR", "IMAGE", "facts", "coalesce(image_path, '') = ''", "-1"),
        _issue(2, 2, "V1-IMG-DUPFILE", "WARNING", "IMAGE", "facts", f"{path} AND file_repeat", "-1"),
        _issue(3, 2, "V1-IMG-EXT", "WARNING", "IMAGE", "facts", f"{path} AND {_BAD_EXT}", "-1"),
        _issue(4, 2, "V1-IMG-NOSIZE", "WARNING", "IMAGE", "facts", f"NOT ({size})", "-1"),
        _issue(5, 2, "V1-IMG-SIZE", "ERROR", "IMAGE", "facts", f"{size} AND (width <= 0 OR height <= 0)", "-1"),
        _issue(6, 2, "V1-IMG-ID", "WARNING", "IMAGE", "facts", "coalesce(image_id, '') = ''", "-1"),
        _issue(7, 2, "V1-IMG-NODATASET", "WARNING", "IMAGE", "facts", "coalesce(dataset, '') = ''", "-1"),
        _issue(8, 2, "V1-IMG-DATASET", "WARNING", "IMAGE", "facts", "trim(coalesce(dataset, '')) = ''", "-1"),
        _issue(9, 2, "V1-IMG-EMPTY", "WARNING", "IMAGE", "facts", "n_objects = 0", "-1"),
        _issue(10, 2, "V1-IMG-DUPPATH", "WARNING", "IMAGE", "facts", f"{path} AND path_repeat", "-1"),
        _issue(0, 3, "V1-OBJ-NAME", "WARNING", "OBJECT", "objects", "coalesce(class_name, '') = ''", "object_index"),
        _issue(1, 3, "V1-OBJ-ID", "ERROR", "OBJECT", "objects", "class_id IS NULL OR class_id < 0", "object_index"),
        _issue(3, 3, "V1-OBJ-BOX", "ERROR", "BOUNDING_BOX", "objects", "xc IS NULL OR yc IS NULL OR w IS NULL OR h IS NULL", "object_index"),
        *[
            _issue(4 + n, 4, f"V1-BOX-{c.upper()}", "ERROR", "BOUNDING_BOX", "objects", f"{c} IS NULL OR {c} < 0 OR {c} > 1", "object_index")
            for n, c in enumerate(("xc", "yc", "w", "h"))
        ],
        _issue(8, 4, "V1-BOX-W0", "ERROR", "BOUNDING_BOX", "objects", "w <= 0", "object_index"),
        _issue(9, 4, "V1-BOX-H0", "ERROR", "BOUNDING_BOX", "objects", "h <= 0", "object_index"),
        _issue(10, 4, "V1-BOX-CONF", "WARNING", "BOUNDING_BOX", "objects", "confidence < 0 OR confidence > 1", "object_index"),
    ]
    if planted:
        lines += [
            _issue(1, 2, "V1-IMG-FILE", "ERROR", "IMAGE", "facts", f"{path} AND NOT file_found", "-1"),
            _issue(2, 3, "V1-OBJ-DUP", "WARNING", "OBJECT", "named", "object_id IS NOT NULL AND r > 1", "object_index"),
        ]
    parts = [
        *_views(planted),
        _COUNTED,
        f"facts AS (SELECT *, row_number() OVER (PARTITION BY {_PLAIN_PATH} ORDER BY seq) > 1 AS file_repeat, "
        f"row_number() OVER (PARTITION BY {_REAL_PATH} ORDER BY seq) > 1 AS path_repeat FROM counted)",
        _OBJECTS,
        *(["named AS (SELECT o.*, row_number() OVER (PARTITION BY object_id ORDER BY seq, object_index) AS r FROM objects o)"] if planted else []),
        "issues AS (\n" + "\nUNION ALL ".join(lines) + ")",
    ]
    return ",\n".join(parts)


_V1 = _v1_issues()


def _v2(min_side: int, max_side: int, expected: tuple[str, ...] | None, planted: bool = False, valid: tuple[int, ...] | None = None) -> str:
    known = ", ".join(f"'{e}'" for e in expected or ())
    lacking = (
        f"SELECT seq FROM (SELECT i.seq, count(DISTINCT class_name) FILTER (class_name IN ({known})) AS k FROM images i LEFT JOIN boxes b USING (seq) GROUP BY i.seq) WHERE k < {len(expected)}"
        if expected
        else "SELECT NULL AS seq WHERE FALSE"
    )
    four = "xc IS NOT NULL AND yc IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL"
    lines = [
        _issue(0, 2, "IMG002", "ERROR", "IMAGE", "facts", _BAD_EXT, "-1"),
        _issue(1, 2, "IMG005", "WARNING", "IMAGE", "facts", f"width < {min_side} OR height < {min_side}", "-1"),
        _issue(2, 2, "IMG006", "WARNING", "IMAGE", "facts", f"width > {max_side} OR height > {max_side}", "-1"),
        _issue(3, 2, "IMG007", "WARNING", "DUPLICATE", "facts", "is_repeat", "-1"),
        _issue(4, 3, "OBJ001", "ERROR", "OBJECT", "facts", "n_objects = 0", "-1"),
        _issue(5, 3, "OBJ009", "INFO", "OBJECT", "facts", "n_classes = 1 AND n_objects > 1", "-1"),
        _issue(6, 3, "OBJ008", "INFO", "OBJECT", "facts", "seq IN (SELECT seq FROM lacking)", "-1"),
        _issue(0, 3, "OBJ002", "ERROR", "OBJECT", "objects", "class_id IS NULL", "object_index"),
        _issue(1, 3, "OBJ003", "WARNING", "OBJECT", "objects", "class_name IS NULL", "object_index"),
        _issue(2, 3, "OBJ005", "WARNING", "DUPLICATE", "objects", "is_repeat", "object_index"),
        _issue(3, 3, "OBJ007", "ERROR", "OBJECT", "objects", "confidence < 0 OR confidence > 1", "object_index"),
        _issue(4, 4, "BOX004", "ERROR", "BOUNDING_BOX", "objects", f"NOT ({four})", "object_index"),
        _issue(5, 4, "BOX005", "ERROR", "BOUNDING_BOX", "objects", f"{four} AND (w < 0 OR h < 0)", "object_index"),
        _issue(6, 4, "BOX007", "ERROR", "BOUNDING_BOX", "objects", f"{four} AND (w <= 0 OR h <= 0)", "object_index"),
        _issue(
            7, 4, "BOX010", "ERROR", "BOUNDING_BOX", "objects",
            f"{four} AND (xc < 0 OR xc > 1 OR yc < 0 OR yc > 1 OR w <= 0 OR w > 1 OR h <= 0 OR h > 1)", "object_index",
        ),
        _issue(90, 4, "BOX011", "WARNING", "BOUNDING_BOX", "pairs", "TRUE", "object_index"),
        _issue(91, 4, "BOX012", "WARNING", "BOUNDING_BOX", "crossed", "o / (s - o) >= 0.9", "object_index"),
    ]
    if planted:
        lines += [
            _issue(0, 2, "IMG001", "ERROR", "IMAGE", "facts", "NOT file_found", "-1"),
            _issue(0, 2, "IMG003", "ERROR", "IMAGE", "facts", "file_found AND decoded_width = -1", "-1"),
            _issue(0, 2, "IMG004", "ERROR", "IMAGE", "facts", "file_length = 0", "-1"),
            _issue(0, 2, "IMG008", "ERROR", "METADATA", "facts", "file_found AND (decoded_width <= 0 OR decoded_height <= 0)", "-1"),
            _issue(0, 3, "OBJ006", "ERROR", "OBJECT", "objects", "j IN (50, 51)", "object_index"),
        ]
    if valid:
        lines.append(_issue(0, 3, "OBJ004", "ERROR", "OBJECT", "objects", f"class_id IS NULL OR class_id NOT IN {valid}", "object_index"))
    return ",\n".join(
        [
            *_views(planted),
            _COUNTED,
            "classes AS (SELECT seq, count(DISTINCT class_name) AS n_classes FROM boxes GROUP BY seq)",
            f"lacking AS ({lacking})",
            "facts AS (SELECT c.*, coalesce(k.n_classes, 0) AS n_classes, "
            "row_number() OVER (PARTITION BY image_path ORDER BY seq) > 1 AS is_repeat FROM counted c LEFT JOIN classes k USING (seq))",
            "marked AS (SELECT *, row_number() OVER (PARTITION BY seq, class_id, xc, yc, w, h ORDER BY object_index) > 1 AS is_repeat FROM boxes)",
            "objects AS (SELECT b.*, i.dataset, i.image_path, i.width, i.height FROM marked b JOIN images i USING (seq))",
            "pairs AS (SELECT a.seq, b.object_index AS object_index, i.dataset FROM boxes a JOIN boxes b "
            "ON a.seq = b.seq AND a.xc = b.xc AND a.yc = b.yc AND a.w = b.w AND a.h = b.h AND a.object_index < b.object_index JOIN images i ON i.seq = a.seq)",
            "corner AS (SELECT b.seq, b.object_index, i.dataset, xc - w / 2 AS x1, yc - h / 2 AS y1, xc + w / 2 AS x2, yc + h / 2 AS y2 FROM boxes b JOIN images i USING (seq))",
            "crossed AS (SELECT a.seq, b.object_index, a.dataset, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS o, "
            "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM corner a JOIN corner b ON a.seq = b.seq AND a.object_index < b.object_index "
            "AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))",
            "issues AS (\n" + "\nUNION ALL ".join(lines) + ")",
        ]
    )


_BY_RULE = "SELECT stage, rule_id, severity, category, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_total FROM issues GROUP BY ALL"

_ROLLED = (
    "count(*) AS n_issues, count(*) FILTER (severity = 'INFO') AS n_info, count(*) FILTER (severity = 'WARNING') AS n_warning, "
    "count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'CRITICAL') AS n_critical"
)


def _clamped(part: str, of: str) -> str:
    return f"round(greatest(0.0, least(100.0, 100.0 - {part} * 100.0::DOUBLE / greatest({of}, 1))), 2)"


def _uniform(seed: str, *keys: str) -> str:
    state = seed
    for key in keys:
        state = f"((({state} + {key} % 2147483648) * 1103515245 + 12345) % 2147483648)"
    for shift, factor in ((15, 739982445), (12, 695872825)):
        state = f"((xor(CAST({state} AS BIGINT), CAST({state} AS BIGINT) >> {shift}) * {factor}) % 2147483648)"
    return f"(xor(CAST({state} AS BIGINT), CAST({state} AS BIGINT) >> 15) / 2147483648.0::DOUBLE)"


def _mapped(value: str) -> str:
    return _with(_TILES, then=f"SELECT p.vec_id, CAST(p.place AS INTEGER) AS place, {value} AS value FROM px p JOIN m USING (vec_id)")


def _u8(value: str) -> str:
    return f"CAST(least(255, greatest(0, floor({value}))) AS INTEGER)"


_NEIGHBOURS = ",\n".join(
    [
        "grid AS (SELECT vec_id, place // 8 AS r, place % 8 AS c, v FROM px)",
        "near AS (SELECT g.vec_id, g.r, g.c, g.v, o.dr, o.dc, k.v AS nv FROM grid g, "
        "(SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dr, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dc) o JOIN grid k ON k.vec_id = g.vec_id "
        "AND k.r = CASE WHEN g.r + o.dr < 0 THEN 1 WHEN g.r + o.dr > 7 THEN 6 ELSE g.r + o.dr END "
        "AND k.c = CASE WHEN g.c + o.dc < 0 THEN 1 WHEN g.c + o.dc > 7 THEN 6 ELSE g.c + o.dc END)",
        "filtered AS (SELECT vec_id, r, c, sum(CASE WHEN dr = 0 OR dc = 0 THEN nv ELSE 0 END) - 4 * any_value(v) AS lap, "
        "sum(nv * dc * (CASE WHEN dr = 0 THEN 2 ELSE 1 END)) AS gx, sum(nv * dr * (CASE WHEN dc = 0 THEN 2 ELSE 1 END)) AS gy FROM near GROUP BY vec_id, r, c)",
        "texture AS (SELECT vec_id, round(sum(lap * lap)::DOUBLE / 64 - (sum(lap)::DOUBLE / 64) * (sum(lap)::DOUBLE / 64), 4) AS blur_score, "
        "round(sum(sqrt((gx * gx + gy * gy)::DOUBLE)) / 64, 4) AS sharpness FROM filtered GROUP BY vec_id)",
        "ent AS (SELECT vec_id, round(sum(-(k / 64.0::DOUBLE) * log2(k / 64.0::DOUBLE)), 4) AS entropy "
        "FROM (SELECT vec_id, v, count(*) AS k FROM px GROUP BY vec_id, v) GROUP BY vec_id)",
        "base AS (SELECT vec_id, m.label, round(mean, 4) AS brightness, round(std, 4) AS contrast, most - least AS dynamic_range, entropy, blur_score, sharpness "
        "FROM m JOIN texture USING (vec_id) JOIN ent USING (vec_id))",
    ]
)


_CELLS = "cells AS (SELECT vec_id, place // 8 AS r, place % 8 AS c, CAST(v AS INTEGER) AS v FROM px)"


def _mirror(at: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > 7 THEN 14 - ({at}) ELSE {at} END"


def _around(reach: int) -> str:
    """Every pixel with its neighbours up to ``reach`` away, mirrored at the border: v, nv, dr, dc."""
    steps = ", ".join(map(str, range(-reach, reach + 1)))
    return (
        f"around{reach} AS (SELECT g.vec_id, g.r, g.c, g.v, a.d AS dr, b.d AS dc, k.v AS nv FROM cells g, (SELECT unnest([{steps}]) AS d) a, (SELECT unnest([{steps}]) AS d) b "
        f"JOIN cells k ON k.vec_id = g.vec_id AND k.r = {_mirror('g.r + a.d')} AND k.c = {_mirror('g.c + b.d')})"
    )


def _bell(sigma: float, reach: int) -> str:
    """Weight of a neighbour under a normalised Gaussian."""
    total = sum(math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1))
    return f"exp(-(dr * dr + dc * dc) / {2 * sigma * sigma!r}::DOUBLE) / {total * total!r}::DOUBLE"


def _byte(value: str) -> str:
    return f"least(255, greatest(0, round_even({value}, 0)))::DOUBLE"


def _layers(table: str, *values: str, place: str = "r * 8 + c") -> str:
    return " UNION ALL ".join(
        f"SELECT vec_id, CAST({k} AS INTEGER) AS channel, CAST({place} AS INTEGER) AS place, CAST({v} AS DOUBLE) AS value FROM {table}" for k, v in enumerate(values)
    )


_COLORS = """colors AS (
  SELECT b.vec_id, b.place, CAST(b.v AS INTEGER) AS b, CAST(g.v AS INTEGER) AS g, CAST((b.v * 3 + 40) % 256 AS INTEGER) AS r
  FROM px b JOIN px g ON g.vec_id = b.vec_id AND g.place = 63 - b.place)"""


def _linear(channel: str) -> str:
    x = f"({channel} / 255.0::DOUBLE)"
    return f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92::DOUBLE ELSE pow(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _cie(value: str) -> str:
    return f"CASE WHEN {value} > 0.008856 THEN cbrt({value}) ELSE 7.787::DOUBLE * {value} + 16 / 116.0::DOUBLE END"


_LAB = f"""linear AS (SELECT vec_id, place, {_linear('b')} AS b, {_linear('g')} AS g, {_linear('r')} AS r FROM colors),
xyz AS (SELECT vec_id, place, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE AS x,
  0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE AS z FROM linear),
curve AS (SELECT vec_id, place, {_cie('x')} AS x, {_cie('y')} AS y, {_cie('z')} AS z FROM xyz),
lab AS (SELECT vec_id, place, {_byte('(116 * y - 16) * 2.55::DOUBLE')} AS l, {_byte('500 * (x - y) + 128')} AS a, {_byte('200 * (y - z) + 128')} AS b FROM curve),
spread AS (SELECT vec_id, avg(l) AS ml, stddev_pop(l) AS sl, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM lab GROUP BY vec_id)"""


def _judged(low: float = 20, high: float = 235, contrast: float = 20, blur: float = 200, entropy: float = 3, score: float = 70) -> str:
    """Score and issues of measured tiles under thresholds."""
    light = f"CASE WHEN brightness BETWEEN {low} AND {high} THEN 100.0::DOUBLE ELSE greatest(0.0, 100.0 - least(abs(brightness - {low}), abs(brightness - {high}))) END"
    parts = f"({light}) + least(100.0, 100.0 * contrast / {contrast}) + least(100.0, 100.0 * blur_score / {blur}) + least(100.0, 100.0 * entropy / {entropy})"
    codes = ", ".join(
        f"CASE WHEN {condition} THEN '{code}' END"
        for condition, code in (
            (f"brightness < {low}", "brightness_too_low"),
            (f"brightness > {high}", "brightness_too_high"),
            (f"contrast < {contrast}", "contrast_too_low"),
            (f"blur_score < {blur}", "blurry"),
            (f"entropy < {entropy}", "entropy_too_low"),
            (f"quality_score < {score}", "quality_score_below_threshold"),
        )
    )
    return (
        f"scored AS (SELECT *, round(({parts}) / 4.0, 2) AS quality_score FROM base),\n"
        f"judged AS (SELECT *, list_filter([{codes}], lambda x: x IS NOT NULL) AS issues FROM scored)"
    )


_SPLITS = """free AS (
  SELECT *, {uniform} AS u, {stratum} AS stratum FROM images WHERE {free}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, seq) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM free),
bounds AS (SELECT *, CAST(round_even(n * {train}::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even(n * {val}::DOUBLE, 0) AS BIGINT) AS b FROM placed)"""
_NEW_SPLIT = "CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'val' ELSE 'test' END AS new_split"

_PREDICTED = (
    "p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN label ELSE CAST((vec_id * 7 + label * 3) % 10 AS INTEGER) END AS predicted FROM embeddings)"
)


def _damaged(share: str, seed: int, exclude: str) -> str:
    rolls = [_uniform(str(seed + k), "seq", "object_index") for k in range(1, 7)]
    return (
        f"dealt AS (SELECT seq, row_number() OVER (ORDER BY {_uniform(str(seed), 'seq')}, seq) AS place, count(*) OVER () AS n FROM images WHERE split <> '{exclude}'),\n"
        f"hit AS (SELECT seq FROM dealt WHERE place <= round_even(n * {share}::DOUBLE, 0)),\n"
        f"rolled AS (SELECT b.*, b.seq IN (SELECT seq FROM hit) AS touched, {', '.join(f'{r} AS r{k}' for k, r in enumerate(rolls))} FROM boxes b),\n"
        "others AS (SELECT own.class_name AS own, list_sort(list(DISTINCT b.class_name)) AS names FROM (SELECT DISTINCT class_name FROM boxes) own JOIN boxes b ON b.class_name <> own.class_name GROUP BY own.class_name),\n"
        "damaged AS (SELECT seq, object_index, class_id, confidence,\n"
        "  CASE WHEN touched AND r4 < 0.3 THEN names[CAST(floor(r5 * len(names)) AS INTEGER) + 1] ELSE class_name END AS class_name,\n"
        "  CASE WHEN touched AND r0 < 0.5 AND r1 >= 0.5 THEN least(1.2, xc + 0.3 + 0.3 * r2) ELSE xc END AS xc,\n"
        "  CASE WHEN touched AND r0 < 0.5 AND r1 >= 0.5 THEN least(1.2, yc + 0.3 + 0.3 * r3) ELSE yc END AS yc,\n"
        "  CASE WHEN touched AND r0 < 0.5 AND r1 < 0.5 THEN 0.001 ELSE w END AS w,\n"
        "  CASE WHEN touched AND r0 < 0.5 AND r1 < 0.5 THEN 0.001 ELSE h END AS h,\n"
        "  touched AND (r0 < 0.5 OR r4 < 0.3) AS damaged FROM rolled JOIN others ON own = class_name)"
    )


def _level(name: str, share: str) -> str:
    body = _damaged(share, 42, "test")
    rules = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id FROM damaged WHERE {condition}"
        for rule, condition in (
            ("BOX005", "w < 0 OR h < 0"),
            ("BOX007", "w <= 0 OR h <= 0"),
            ("BOX010", "xc < 0 OR xc > 1 OR yc < 0 OR yc > 1 OR w <= 0 OR w > 1 OR h <= 0 OR h > 1"),
        )
    )
    return f"(WITH {body} SELECT '{name}' AS level, rule_id, count(*) AS n FROM ({rules}) GROUP BY rule_id)"


def _six(prefix: str, *values: str, places: int = 6) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), {places}) AS {prefix}{k}" for k, v in enumerate(values, 1))


def _rows(section: int, *lines: str) -> str:
    """Lines of a section: SQL expressions over the one-row table ``whole``."""
    return " UNION ALL ".join(f"SELECT CAST({section} AS INTEGER) AS section, {line} AS line FROM whole" for line in lines)


def _field(name: str, value: str, width: int = 18, bullet: str = "") -> str:
    head = f"- {name}: " if bullet else f"{name:<{width}}: "
    return f"'{head}' || {value}"


def _places(value: str) -> str:
    return f"printf('%.2f', round(coalesce({value}, 0), 2)::DOUBLE)"


_V1_SCORES = (
    "greatest(0.0::DOUBLE, 100 - 5 * n_error) AS annotation_score, greatest(0.0::DOUBLE, 100 - 2 * (n_error + n_warning)) AS image_score, "
    "greatest(0.0::DOUBLE, 100 - 3 * n_warning) AS class_score, greatest(0.0::DOUBLE, 100 - 4 * (n_error + n_critical)) AS box_score"
)
_V1_FACTS = f"""r AS (SELECT {_ROLLED} FROM issues),
s AS (SELECT *, {_V1_SCORES} FROM r),
whole AS (SELECT s.*, (annotation_score + image_score + class_score + box_score) / 4 AS quality_index, i.*, b.*, round(n_objects::DOUBLE / n_images, 4) AS objects_per_image
  FROM s, (SELECT count(*) AS n_images, avg(width) AS average_width, avg(height) AS average_height FROM images) i,
  (SELECT count(*) AS n_objects, count(DISTINCT class_name) AS n_classes FROM boxes) b)"""


def _v1_sections(markdown: bool) -> list[str]:
    yes = "CASE WHEN n_error + n_critical = 0 THEN 'True' ELSE 'False' END"
    f = lambda name, value: _field(name, value, bullet="-" if markdown else "")
    return [
        _rows(21, f("Total Issues", "n_issues"), f("Critical", "n_critical"), f("Errors", "n_error"), f("Warnings", "n_warning"), f("Information", "n_info"), f("Passed", yes)),
        _rows(31, f("Images", "n_images"), f("Objects", "n_objects"), f("Classes", "n_classes"), f("Objects / Image", _places("objects_per_image")),
              f("Average Width", _places("average_width")), f("Average Height", _places("average_height"))),
        _rows(41, *[f(n, _places(c)) for n, c in (("Annotation Score", "annotation_score"), ("Image Score", "image_score"), ("Class Score", "class_score"), ("Box Score", "box_score"), ("Quality Index", "quality_index"))]),
    ]


def _heads(*heads: tuple[int, tuple[str, ...]]) -> list[str]:
    return [_rows(section, *[f"'{line}'" for line in lines]) for section, lines in heads]


_REASONS = "why AS (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM judged) GROUP BY issue), ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, issue) AS p FROM why)"


def _placed(parts: list[tuple[int, list[str]]]) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({section} AS INTEGER) AS section, CAST({k} AS BIGINT) AS place, {line} AS line FROM whole" for section, lines in parts for k, line in enumerate(lines)
    )


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(columns: str, rows) -> str:
    """Rows written out, with types from the columns' list (name and type, with commas)."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    table = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {table}) t({', '.join(names)})"


_FILES = fixtures.files()
_PICTURES = [n for n in _FILES if n.endswith(".png") and not n.startswith("broken")]
_ANNOTATION_FILES = [n for n in _FILES if n.endswith((".txt", ".xml", ".json", ".csv"))]


def _kind(name: str) -> str:
    return "image" if name.endswith(".png") else "annotation" if name in _ANNOTATION_FILES else "other"


_FOUND = {
    "images": [n for n in _FILES if n.endswith(".png")],
    "annotations": [n for n in _ANNOTATION_FILES if not n.endswith(".csv")],
    "with csv": _ANNOTATION_FILES,
    "top only": ["yolo/data.yaml", "yolo/readme.txt"],
}
_FORMATS = {
    "yolo/data.yaml": "Unknown", "yolo/readme.txt": "Generic TXT", "yolo/train/a.txt": "YOLO", "yolo/valid/b.txt": "Generic TXT", "points/p.txt": "Point TXT", "voc/v.xml": "Pascal VOC",
    "voc/w.xml": "Pascal VOC", "coco/c1.json": "COCO", "coco/c2.json": "COCO", "rowcol/r1.json": "Row/column JSON", "rowcol/r2.json": "Row/column JSON", "classes/Other/none.md": "Unknown",
    "csv/labels.csv": "CSV", "clinical/r.txt": "Generic TXT", "clinical/count.txt": "Counts report", "clinical/smear.txt": "Findings report",
}
#: dataset, image, object_index, class_id, class_name, xc, yc, w, h of what the fixture's annotations say.
_BUILT = (
    ("yolo", "a.png", 0, 0, "cell", 0.5, 0.5, 0.25, 0.5), ("yolo", "a.png", 1, 9, "odd", 0.25, 0.125, 0.1, 0.2),
    ("points", "p.png", 0, 1, "Class_1", 0.5, 0.5, 0.109375, 0.145833), ("points", "p.png", 1, 2, "Class_2", 0.1, 0.1, 0.109375, 0.145833),
    ("voc", "v.png", 0, 2, "Platelets", 0.2, 0.3, 0.2, 0.2), ("voc", "v.png", 1, 0, "RBC", 0.5, 0.5, 1.0, 1.0),
    ("coco", "s.png", 0, 3, "WBC", 0.35, 0.3, 0.2, 0.2), ("coco", "s.png", 1, 7, "Class_7", 0.05, 0.1, 0.1, 0.2), ("coco", "t.png", 0, 1, "A", 0.25, 0.25, 0.5, 0.5),
    ("coco", "u.png", 0, 3, "WBC", 0.2, 0.2, 0.2, 0.2), ("rowcol", "s.png", 0, 0, "RBC", 0.25, 0.25, 0.5, 0.5),
    ("classes", "a.png", 0, 0, "Lymphocyte", 0.5, 0.5, 1.0, 1.0), ("classes", "a.png", 0, 1, "Neutrophil", 0.5, 0.5, 1.0, 1.0),
    ("csv", "001.png", 0, 1, "Class_1", 0.5, 0.5, 1.0, 1.0), ("csv", "002.png", 0, 2, "Class_2", 0.5, 0.5, 1.0, 1.0),
)
_LOGGED = {
    "yolo/train/a.png": 2, "yolo/valid/b.png": 0, "points/p.png": 2, "voc/v.png": 2, "voc/w.png": 0, "coco/s.png": 2, "coco/t.png": 1, "coco/u.png": 1, "coco/x.png": 0, "rowcol/s.png": 1,
    "rowcol/q.png": 0, "classes/Neutrophil/a.png": 1, "classes/Lymphocyte/a.png": 1, "csv/001.png": 1, "csv/002.png": 1,
}
_SHRUNK = (
    "half AS (SELECT vec_id, round_even(avg(v), 0) AS v FROM cells GROUP BY vec_id, r // 2, c // 2), "
    "dark AS (SELECT h.vec_id, avg(h.v) < 126 AS dark, any_value(m.mean) AS mean FROM half h JOIN m USING (vec_id) GROUP BY h.vec_id)"
)


ORACLES: dict[str, str] = {
    "images_view": _with(_IMAGES, then="SELECT * FROM images"),
    "boxes_view": _with(_BOXES, then="SELECT * FROM boxes"),
    "nested_view": _with(
        _IMAGES, _BOXES,
        then="SELECT i.seq, CAST(count(b.seq) AS INTEGER) AS n_objects, round(coalesce(sum(b.w * b.h ORDER BY object_index), 0.0), 6) AS total_area, "
        "coalesce(string_agg(b.class_name, '|' ORDER BY object_index), '') AS names FROM images i LEFT JOIN boxes b USING (seq) GROUP BY i.seq",
    ),
    "path_parts": r"""SELECT page_id, split_part(url, '/', -1) AS filename,
        regexp_replace(split_part(url, '/', -1), '(.)\.[^.]*$', '\1') AS stem,
        lower(regexp_extract(split_part(url, '/', -1), '.(\.[^.]*)$', 1)) AS extension FROM pages""",
    "normalized_class_names": "SELECT translate(lower(trim(p_name)), '- ', '__') AS name, count(*) AS n FROM part GROUP BY 1",
    "null_safe_predicates": _with(
        _IMAGES, _BOXES,
        then="SELECT dataset, count(*) FILTER (width > 0) AS n_positive, count(*) FILTER (w >= 0) AS n_non_negative, "
        "count(*) FILTER (xc BETWEEN 0 AND 1) AS n_normalized, count(*) FILTER (confidence BETWEEN 0.1 AND 0.9) AS n_between, "
        "count(*) FILTER (width > 0 AND height > 0) AS n_valid_size, "
        "count(*) FILTER (xc BETWEEN 0 AND 1 AND yc BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1) AS n_valid_box, "
        "count(*) FILTER (class_name IS NULL OR trim(class_name) = '') AS n_blank FROM images LEFT JOIN boxes USING (seq) GROUP BY dataset",
    ),
    "safe_arithmetic": _with(
        _IMAGES,
        then="SELECT seq, round(CASE WHEN height = 0 THEN 0.0 ELSE width::DOUBLE / height END, 6) AS aspect_ratio, "
        "round(CASE WHEN height = 0 THEN 0.0 ELSE width * 100.0::DOUBLE / height END, 6) AS percent, width::BIGINT * height AS total_pixels FROM images",
    ),
    "sniff_text_formats": r"""WITH l AS (
          SELECT doc_id, list_slice(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), 1, 20) AS head, lower(text) AS low
          FROM documents),
        k AS (SELECT *, list_bool_or(list_transform(head, lambda x: regexp_full_match(x, '[+-]?\d+(\.0*)?(\s+[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?){4}'))) AS yolo,
                     list_bool_or(list_transform(head, lambda x: regexp_full_match(x, '[+-]?\d+\s+[+-]?\d+\s+[+-]?\d+'))) AS points FROM l)
        SELECT CASE WHEN yolo THEN 'YOLO' WHEN points THEN 'Point TXT'
               WHEN contains(low, 'wbc,') AND contains(low, 'rbc,') AND contains(low, 'hgb') THEN 'Counts report'
               WHEN contains(low, 'peripheral smear')::INT + contains(low, 'rbc morphology')::INT + contains(low, 'platelets')::INT
                    + contains(low, 'hypochromic')::INT + contains(low, 'microcytic')::INT >= 2 THEN 'Findings report'
               ELSE 'Generic TXT' END AS format, count(*) AS n FROM k GROUP BY 1""",
    "sniff_keyword_score": "SELECT doc_id, CAST(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ("the", "und", "que", "les", "ción")) + " AS INTEGER) AS score FROM documents",
    "parse_yolo_text": _with(
        _BOXES,
        then="SELECT seq, object_index, class_id, CAST(printf('%.3f', xc) AS DOUBLE) AS xc, CAST(printf('%.2f', yc) AS DOUBLE) AS yc, "
        "CAST(printf('%.6f', w) AS DOUBLE) AS w, CAST(printf('%.5f', h) AS DOUBLE) AS h FROM boxes",
    ),
    "parse_point_text": """SELECT l_linenumber AS class_id, count(*) AS n, round(avg((l_partkey % 640) / 640.0::DOUBLE), 6) AS mean_xc,
        round(avg((l_suppkey % 480) / 480.0::DOUBLE), 6) AS mean_yc, round(70 / 640.0::DOUBLE, 6) AS w FROM lineitem GROUP BY l_linenumber""",
    "parse_key_value_report": """SELECT c_custkey, 13.5::DOUBLE AS hemoglobin, CAST(c_custkey AS DOUBLE) AS balance, 2 AS n_values,
        lower(c_mktsegment) || '|small' AS findings FROM customer""",
    "parse_json_props": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "rowcol_json_to_box": """WITH r AS (
          SELECT CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 0 END AS class_id, (l_partkey % 400)::DOUBLE AS c, (l_suppkey % 300)::DOUBLE AS r, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
        SELECT class_id, count(*) AS n, round(sum((2 * c + 2 * q) / 2.0 / 800), 4) AS sum_xc, round(sum((2 * r + q) / 2.0 / 600), 4) AS sum_yc,
               round(sum((2 * q / 800.0::DOUBLE) * (q / 600.0::DOUBLE)), 6) AS sum_area FROM r WHERE class_id IS NOT NULL GROUP BY class_id""",
    "coco_join": _with(
        _IMAGES, _BOXES,
        then="""SELECT dataset, CASE class_id WHEN 0 THEN 'erythrocyte' WHEN 3 THEN 'parasite' ELSE 'Class_' || class_id END AS class_name, count(*) AS n,
        round(sum(CASE WHEN width * height <> 0 THEN (xc * 100 + w * 100 / 2) / width ELSE 0 END), 4) AS sum_xc,
        round(sum(CASE WHEN width * height <> 0 THEN w * 100 / width ELSE 0 END), 4) AS sum_w,
        count(*) FILTER (width * height = 0 OR w = 0) AS n_flat FROM boxes JOIN images USING (seq) GROUP BY ALL""",
    ),
    "dataset_format_cascade": _with(
        _IMAGES,
        then=f"""SELECT 'YOLO' AS annotation, 'Detection' AS task, mode({_EXT}) FILTER (NOT ({_BAD_EXT})) AS image_suffix,
        count(*) FILTER (NOT ({_BAD_EXT})) AS n_images FROM images""",
    ),
    "filter_by_dataset": _with(_IMAGES, then="SELECT * FROM images WHERE dataset = '1-URGENT'"),
    "filter_by_split": _with(_IMAGES, then="SELECT * FROM images WHERE split = 'val'"),
    "filter_by_class": _with(_IMAGES, _BOXES, then="SELECT * FROM images WHERE seq IN (SELECT seq FROM boxes WHERE class_name = 'cell-RF')"),
    "composite_search": _with(
        _IMAGES, _BOXES, _COUNTED,
        then="SELECT seq, image_id, image_path, dataset, width, height, split FROM counted WHERE dataset = '2-HIGH' AND split = 'train' AND width >= 300 AND height >= 160 "
        "AND n_objects BETWEEN 2 AND 6 AND seq IN (SELECT seq FROM boxes WHERE class_name = 'cell-AF')",
    ),
    "lookup_last_wins": _with(_IMAGES, then="SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq DESC) = 1"),
    "first_match": _with(_IMAGES, then="SELECT * FROM images WHERE width >= 1000 AND split = 'val' ORDER BY seq LIMIT 1"),
    "distinct_ids_first_seen": _with(_IMAGES, then="SELECT image_id, min(seq) AS first_seq FROM images GROUP BY image_id"),
    "point_lookups": _with(
        _IMAGES,
        then="""SELECT 'id' AS what, max(seq) AS value FROM images WHERE image_id = 'img_33' HAVING count(*) > 0
        UNION ALL SELECT 'path', max(seq) FROM images WHERE image_path = '2-HIGH/img_33.tif' HAVING count(*) > 0
        UNION ALL SELECT 'train', count(*) FROM images WHERE split = 'train' UNION ALL SELECT 'val', count(*) FROM images WHERE split = 'val'
        UNION ALL SELECT 'test', count(*) FROM images WHERE split = 'test'""",
    ),
    "box_basic": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, w1 AS width, h1 AS height, w1 * h1 AS area, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, round(sqrt(w1 * w1 + h1 * h1), 6) AS diagonal FROM geo",
    ),
    "box_convert_roundtrip": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, "
        + _six("c", "(x1 + x2) / 2.0 / 640", "(y1 + y2) / 2.0 / 480", "(x2 - x1) / 640", "(y2 - y1) / 480", places=9)
        + ", "
        + _six("b", "x1", "y1", "x2", "y2")
        + " FROM geo",
    ),
    "box_iou_pairs": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, u1, v1, u2, v2, CAST(inter AS DOUBLE) AS intersection, w1 * h1 + w2 * h2 - inter AS union_area, "
        "round(CASE WHEN w1 * h1 + w2 * h2 - inter > 0 THEN inter / (w1 * h1 + w2 * h2 - inter) ELSE 0.0 END, 6) AS iou, "
        "round(CASE WHEN least(w1 * h1, w2 * h2) > 0 THEN inter / least(w1 * h1, w2 * h2) ELSE 0.0 END, 6) AS overlap_ratio, inter > 0 AS intersects FROM geo",
    ),
    "box_contains_clip": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, u1, v1, u2, v2, x1 >= u1 AND y1 >= v1 AND x2 <= u2 AND y2 <= v2 AS contained, "
        "x1 >= 0 AND y1 >= 0 AND x2 <= 400 AND y2 <= 60 AS inside, "
        + _six("k", *[f"greatest(0, least({v}, {most}))" for v, most in (("x1", 400), ("y1", 60), ("x2", 400), ("y2", 60))])
        + " FROM geo",
    ),
    "box_transforms": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, "
        + ", ".join(
            [
                _six("s", "x1 * 2", "y1 * 0.5", "x2 * 2", "y2 * 0.5"),
                _six("t", "x1 + 3", "y1 - 4", "x2 + 3", "y2 - 4"),
                _six("e", "x1 - 2", "y1 - 2", "x2 + 2", "y2 + 2"),
                _six("h", "x1 + 2", "y1 + 2", "x2 - 2", "y2 - 2"),
            ]
        )
        + " FROM geo",
    ),
    "box_distances": _with(
        _CORNERS,
        then="SELECT x1, y1, x2, y2, u1, v1, u2, v2, round(sqrt(((u1 + u2) / 2 - (x1 + x2) / 2) * ((u1 + u2) / 2 - (x1 + x2) / 2) "
        "+ ((v1 + v2) / 2 - (y1 + y2) / 2) * ((v1 + v2) / 2 - (y1 + y2) / 2)), 6) AS distance FROM geo",
    ),
    "box_arrays": """WITH b AS (SELECT l_partkey % 7 AS p, l_suppkey % 5 AS s FROM lineitem), w AS (SELECT *, p > 1 AND s > 0 AS well_formed FROM b)
        SELECT well_formed, count(*) AS n, CAST(sum(CASE WHEN well_formed THEN 3 * s END) AS DOUBLE) AS area, CAST(sum(CASE WHEN well_formed THEN (p + 3) * 2 * s ELSE 0 END) AS DOUBLE) AS sides,
        count(*) FILTER (well_formed) AS n_known FROM w GROUP BY well_formed""",
    "crop_rectangles": _with(
        _IMAGES, _BOXES,
        then="SELECT * FROM (SELECT seq, object_index, "
        + ", ".join(
            f"greatest(0, least(CAST(trunc({c} * {side} {sign} ({s} * {side} * 1.2::DOUBLE) / 2) AS INTEGER), {side})) AS {name}"
            for name, c, s, side, sign in (("x1", "xc", "w", "width", "-"), ("y1", "yc", "h", "height", "-"), ("x2", "xc", "w", "width", "+"), ("y2", "yc", "h", "height", "+"))
        )
        + " FROM boxes JOIN images USING (seq)) WHERE x2 > x1 AND y2 > y1",
    ),
    "class_dim_left_default": _with(
        _BOXES,
        then="SELECT CASE class_id WHEN 0 THEN 'erythrocyte' WHEN 1 THEN 'leukocyte' WHEN 3 THEN 'parasite' ELSE 'Class_' || class_id END AS label, count(*) AS n FROM boxes GROUP BY 1",
    ),
    "stem_match_left": _with(_IMAGES, _ANNOTATIONS, then="SELECT seq, image_path, annotation_path FROM matched"),
    "stem_fallback": """WITH r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'none' END AS exact, CAST(c_custkey % 700 AS VARCHAR) AS short, c_custkey AS ord, c_acctbal AS balance FROM customer),
        e AS (SELECT exact, arg_max(balance, ord) AS b FROM r GROUP BY exact), f AS (SELECT short, arg_min(balance, ord) AS b FROM r GROUP BY short)
        SELECT c_custkey, coalesce(e.b, f.b) AS balance FROM customer LEFT JOIN e ON e.exact = c_name LEFT JOIN f ON f.short = CAST(c_custkey % 900 AS VARCHAR)""",
    "missing_annotation_anti": _with(_IMAGES, then="SELECT seq, image_path FROM images WHERE seq NOT IN (SELECT l_orderkey FROM lineitem)"),
    "missing_labels_anti": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "passing_semi": _with(_IMAGES, then="SELECT seq, image_id FROM images WHERE image_id IN (SELECT image_id FROM images WHERE width >= 500 AND height >= 320)"),
    "dup_pairs_selfjoin": _with(
        _BOXES,
        "b AS (SELECT seq, object_index, floor(xc * 3) AS x, floor(yc * 2) AS y FROM boxes)",
        then="SELECT a.seq, a.object_index AS i, b.object_index AS j FROM b a JOIN b ON a.seq = b.seq AND a.x = b.x AND a.y = b.y AND a.object_index < b.object_index",
    ),
    "overlap_theta_selfjoin": _with(
        _BOXES,
        "c AS (SELECT seq, object_index AS k, xc - w / 2 AS x1, yc - h / 2 AS y1, xc + w / 2 AS x2, yc + h / 2 AS y2 FROM boxes)",
        "p AS (SELECT a.seq, a.k AS i, b.k AS j, CASE WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0 "
        "THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0.0 END AS o, "
        "greatest(0.0, a.x2 - a.x1) * greatest(0.0, a.y2 - a.y1) + greatest(0.0, b.x2 - b.x1) * greatest(0.0, b.y2 - b.y1) AS s FROM c a JOIN c b ON a.seq = b.seq AND a.k < b.k)",
        then="SELECT seq, i, j, round(o / (s - o), 6) AS overlap FROM p WHERE s - o > 0 AND o / (s - o) >= 0.3",
    ),
    "missing_classes_except": _with(
        _BOXES,
        "f AS (SELECT seq, list(DISTINCT class_name) AS found FROM boxes GROUP BY seq)",
        then="SELECT seq, array_to_string(list_filter(['cell-AF', 'cell-NO', 'cell-RF'], lambda x: NOT list_contains(found, x)), ',') AS missing FROM f "
        "WHERE len(list_filter(['cell-AF', 'cell-NO', 'cell-RF'], lambda x: NOT list_contains(found, x))) > 0",
    ),
    "union_sources": """SELECT source, count(*) AS n, CAST(sum(key) AS BIGINT) AS total FROM (SELECT 'customer' AS source, c_custkey AS key FROM customer
        UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY source""",
    "label_union": "SELECT p_type AS label FROM part UNION SELECT p_brand FROM part",
    "unassigned_to_train": _with(_IMAGES, then="SELECT coalesce(nullif(split, ''), 'train') AS split, count(*) AS n FROM images GROUP BY 1"),
    "metadata_update": _with(_IMAGES, then="SELECT seq, dataset, 'clean' AS stage, '-' AS absent, 'a,b' AS tags FROM images"),
    "dataset_statistics": _with(
        _IMAGES, _BOXES, _COUNTED,
        then="""SELECT dataset, count(*) AS n_images, CAST(sum(n_objects) AS BIGINT) AS n_objects, round(avg(n_objects), 3) AS mean_objects, min(n_objects) AS min_objects,
        max(n_objects) AS max_objects, round(avg(nullif(width, 0)), 3) AS mean_width, min(nullif(width, 0)) AS min_width, max(nullif(width, 0)) AS max_width,
        round(avg(nullif(height, 0)), 3) AS mean_height, min(nullif(height, 0)) AS min_height, max(nullif(height, 0)) AS max_height FROM counted GROUP BY dataset""",
    ),
    "class_balance": _with(_BOXES, then="SELECT class_name, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM boxes GROUP BY class_name"),
    "split_counts": _with(_IMAGES, then="SELECT coalesce(nullif(split, ''), 'unassigned') AS split, count(*) AS n FROM images GROUP BY 1"),
    "summary": _with(
        _IMAGES, _BOXES,
        then="SELECT (SELECT count(*) FROM images) AS n_images, (SELECT count(DISTINCT dataset) FROM images) AS n_datasets, count(*) AS n_objects, count(DISTINCT class_name) AS n_classes FROM boxes",
    ),
    "v1_statistics": _with(
        _IMAGES, _BOXES,
        then="""SELECT i.n_images, i.average_width, i.average_height, b.n_objects, b.n_classes, round(b.n_objects::DOUBLE / i.n_images, 4) AS objects_per_image
        FROM (SELECT count(*) AS n_images, round(avg(width), 4) AS average_width, round(avg(height), 4) AS average_height FROM images) i,
             (SELECT count(*) AS n_objects, count(DISTINCT class_name) AS n_classes FROM boxes) b""",
    ),
    "v2_image_stats": _with(
        _IMAGES, _BOXES, _COUNTED,
        then="""SELECT dataset, count(*) AS n_images, CAST(sum(n_objects) AS BIGINT) AS n_objects, min(width) AS min_width, max(width) AS max_width, round(avg(width), 4) AS mean_width,
        min(height) AS min_height, max(height) AS max_height, round(avg(height), 4) AS mean_height, min(n_objects) AS min_objects, max(n_objects) AS max_objects,
        count(*) FILTER (n_objects = 0) AS n_empty FROM counted GROUP BY dataset""",
    ),
    "v2_box_stats": _with(
        _BOXES,
        then="SELECT class_id, count(*) AS n, "
        + ", ".join(
            f"round(min({v}), 6) AS min_{n}, round(max({v}), 6) AS max_{n}, round(avg({v}), 6) AS mean_{n}"
            for n, v in (("w", "w"), ("h", "h"), ("area", "area"), ("side_area", "w * h"))
        )
        + " FROM boxes GROUP BY class_id",
    ),
    "extension_histogram": _with(
        _IMAGES, then="SELECT lower(split_part(image_path, '.', -1)) AS extension, count(*) AS n FROM images WHERE contains(image_path, '.') GROUP BY 1"
    ),
    "modal_extension": _with(
        _IMAGES, then=f"SELECT extension, n FROM (SELECT {_EXT} AS extension, count(*) AS n, min(seq) AS f FROM images GROUP BY 1) ORDER BY n DESC, f LIMIT 1"
    ),
    "distributions": _with(
        _IMAGES, _BOXES,
        then="""SELECT 'dataset' AS kind, dataset AS value, count(*) AS n FROM images GROUP BY dataset UNION ALL
        SELECT 'split', split, count(*) FROM images GROUP BY split UNION ALL SELECT 'class_name', class_name, count(*) FROM boxes GROUP BY class_name""",
    ),
    "object_class_counts": _with(
        _BOXES, then="SELECT CASE WHEN trim(class_name) = '' THEN CAST(class_id AS VARCHAR) ELSE class_name END AS class, count(*) AS n FROM boxes GROUP BY 1"
    ),
    "confusion_matrix": _with(_PREDICTED, then="SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL"),
    "precision_recall_f1": _with(
        _PREDICTED,
        "c AS (SELECT label AS class FROM p UNION SELECT predicted FROM p)",
        "k AS (SELECT class, (SELECT count(*) FROM p WHERE label = class) AS support, (SELECT count(*) FROM p WHERE predicted = class) AS said, "
        "(SELECT count(*) FROM p WHERE label = class AND predicted = class) AS hits FROM c)",
        "q AS (SELECT class, support, CASE WHEN said = 0 THEN 0.0 ELSE hits::DOUBLE / said END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS r FROM k)",
        then="SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1, support FROM q",
    ),
    "accuracy": _with(_PREDICTED, then="SELECT count(*) AS n, round(avg((label = predicted)::INT), 4) AS accuracy FROM p"),
    "correlations": """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rx,
          rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM lineitem)
        SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""",
    "balanced_class_weights": _with(
        _BOXES, then="SELECT class_id, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM boxes GROUP BY class_id"
    ),
    "build_log_report": _with(
        _IMAGES, _ANNOTATIONS,
        then="""SELECT dataset, count(*) AS n_found, count(annotation_path) AS n_built, count(*) - count(annotation_path) AS n_failed,
        round(count(annotation_path) * 100.0::DOUBLE / count(*), 2) AS percent FROM matched GROUP BY dataset""",
    ),
    "assign_splits_stratified": _with(
        _IMAGES,
        _SPLITS.format(uniform=_uniform("42", "seq"), stratum="dataset", free="split IN ('', 'train')", train="0.7", val="0.15"),
        then=f"SELECT seq, dataset, split, {_NEW_SPLIT} FROM bounds UNION ALL SELECT seq, dataset, split, split FROM images WHERE split NOT IN ('', 'train')",
    ),
    "assign_splits_global": _with(
        _IMAGES,
        _SPLITS.format(uniform=_uniform("7", "seq"), stratum="''", free="TRUE", train="0.6", val="0.2"),
        then=f"SELECT seq, {_NEW_SPLIT} FROM bounds",
    ),
    "dup_first_seen": _with(_IMAGES, then="SELECT seq, image_path, row_number() OVER (PARTITION BY lower(image_path) ORDER BY seq) > 1 AS is_repeat FROM images"),
    "content_hash_dedup": "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_repeat FROM documents",
    "capped_per_class": _with(
        _BOXES, then="SELECT seq, object_index, class_id FROM boxes QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY seq, object_index) <= 25"
    ),
    "capped_random_subset": _with(
        _IMAGES, then=f"SELECT dataset, seq FROM images QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {_uniform('42', 'seq')}, seq) <= 40"
    ),
    "contiguous_relabel": _with(
        _BOXES, then="SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS new_id, count(*) AS n FROM boxes GROUP BY class_id"
    ),
    "sequential_issue_ids": "WITH " + _V1 + "\nSELECT printf('VAL-%06d', row_number() OVER (ORDER BY stage, seq, rule_no, object_index)) AS issue_id, stage, seq, rule_id, object_index FROM issues",
    "pixel_cdf": _with(
        _TILES,
        "c AS (SELECT label, v AS value, count(*) AS n FROM px GROUP BY ALL)",
        then="SELECT label, value, n, CAST(sum(n) OVER (PARTITION BY label ORDER BY value) AS BIGINT) AS cumulative FROM c",
    ),
    "rules_v1_counts": "WITH " + _V1 + "\n" + _BY_RULE,
    "rules_v1_rows": "WITH " + _V1 + "\nSELECT rule_id, severity, dataset, seq, object_index FROM issues",
    "rules_v2_counts": "WITH " + _v2(32, 1100, ("cell-AF", "cell-NO")) + "\n" + _BY_RULE,
    "rules_v2_corner_boxes": _with(
        _IMAGES,
        _CORNERS,
        "b AS (SELECT c.seq, c.u1 AS x1, c.v1 AS y1, c.x2, c.y2, i.dataset, i.width, i.height, greatest(0, c.x2 - c.u1) AS bw, greatest(0, c.y2 - c.v1) AS bh FROM corners c JOIN images i USING (seq))",
        "issues AS ("
        + " UNION ALL ".join(
            [
                _issue(0, 4, "BOX006", "ERROR", "BOUNDING_BOX", "b", "x1 < 0 OR y1 < 0 OR x2 < 0 OR y2 < 0", "0"),
                _issue(0, 4, "BOX008", "ERROR", "BOUNDING_BOX", "b", "x2 <= x1 OR y2 <= y1", "0"),
                _issue(0, 4, "BOX009", "ERROR", "BOUNDING_BOX", "b", "NOT (x1 >= 0 AND y1 >= 0 AND x2 <= width AND y2 <= height)", "0"),
                _issue(0, 4, "BOX013", "WARNING", "BOUNDING_BOX", "b", "bw < 3 OR bh < 3", "0"),
                _issue(0, 4, "BOX014", "WARNING", "BOUNDING_BOX", "b", "width * height > 0 AND bw * bh / nullif(width * height, 0) > 0.01", "0"),
                _issue(0, 4, "BOX015", "WARNING", "BOUNDING_BOX", "b", "greatest(bw, bh, 1) / greatest(least(bw, bh), 1) > 4", "0"),
            ]
        )
        + ")",
        then=_BY_RULE,
    ),
    "rules_v2_dataset": _with(
        _IMAGES, _ANNOTATIONS,
        r"""i AS (SELECT image_path AS path, split_part(image_path, '/', -1) AS name, regexp_replace(split_part(image_path, '/', -1), '\.[^.]*$', '') AS stem FROM images)""",
        "k AS (SELECT (SELECT count(*) FROM i) AS n, (SELECT count(*) FROM ann) AS a)",
        """x AS (SELECT 'DS006' AS rule_id, 'WARNING' AS severity, NULL AS path FROM k WHERE n <> a
        UNION ALL SELECT 'DS007', 'ERROR', path FROM i WHERE stem NOT IN (SELECT stem FROM ann)
        UNION ALL SELECT 'DS008', 'WARNING', path FROM (SELECT path, rank() OVER (PARTITION BY name ORDER BY path) AS r FROM i) WHERE r > 1
        UNION ALL SELECT 'DS009', 'ERROR', annotation_path FROM ann WHERE length(stem) = 6)""",
        then="SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS n_paths FROM x GROUP BY ALL",
    ),
    "rules_v1_planted": "WITH " + _v1_issues(planted=True) + "\n" + _BY_RULE,
    "rules_v2_planted": "WITH " + _v2(1, 100000, ("cell-AF", "cell-NO"), True, (0, 1, 3, 7, 12)) + "\n" + _BY_RULE,
    "rules_raw_boxes": _with(
        *_views(True),
        "issues AS ("
        + " UNION ALL ".join(
            f"SELECT 4 AS stage, '{rule}' AS rule_id, 'ERROR' AS severity, 'BOUNDING_BOX' AS category, seq FROM boxes WHERE j IN {cases}"
            for rule, cases in (("BOX001", "(55)"), ("BOX002", "(56, 61)"), ("BOX003", "(57, 59)"), ("BOX004", "(58)"))
        )
        + ")",
        then=_BY_RULE,
    ),
    "rules_dataset_stage": """SELECT * FROM (VALUES
        ('v1 none', 1, 'V1-DS-NONE', 'ERROR', 'DATASET', NULL), ('v1 empty', 1, 'V1-DS-NONAME', 'WARNING', 'DATASET', NULL),
        ('v1 empty', 1, 'V1-DS-NOIMAGES', 'WARNING', 'DATASET', NULL), ('v1 empty', 1, 'V1-DS-NOCLASSES', 'WARNING', 'DATASET', NULL),
        ('v1 no boxes', 1, 'V1-DS-NOCLASSES', 'WARNING', 'DATASET', NULL), ('v2 no root', 1, 'DS001', 'CRITICAL', 'DATASET', NULL),
        ('v2 file as root', 1, 'DS002', 'CRITICAL', 'DATASET', NULL), ('v2 empty', 1, 'DS003', 'ERROR', 'DATASET', NULL),
        ('v2 empty', 1, 'DS004', 'ERROR', 'DATASET', NULL), ('v2 empty', 1, 'DS005', 'CRITICAL', 'DATASET', NULL),
        ('v2 only other', 1, 'DS003', 'ERROR', 'DATASET', NULL), ('v2 only other', 1, 'DS004', 'ERROR', 'DATASET', NULL),
        ('v2 odd', 1, 'DS006', 'WARNING', 'DATASET', NULL), ('v2 odd', 1, 'DS008', 'WARNING', 'DUPLICATE', 'e/a.jpg'),
        ('v2 odd', 1, 'DS009', 'ERROR', 'DATASET', 'd/a.txt'), ('v2 odd', 1, 'DS010', 'ERROR', 'DATASET', 'd/b.txt'),
        ('v2 no name', 1, 'DS011', 'WARNING', 'METADATA', NULL)) t("case", stage, rule_id, severity, category, image_path)""",
    "dataset_names": "SELECT string_agg(d, '+' ORDER BY d) AS dataset_name FROM (SELECT DISTINCT o_orderpriority AS d FROM orders)",
    "stop_on_error": "WITH " + _v2(1, 1100, None) + "\n" + _BY_RULE.replace("FROM issues", "FROM issues WHERE rule_id LIKE 'IMG%' OR rule_id IN ('OBJ001', 'OBJ009')"),
    "issues_as_json": "WITH " + _V1 + """
        SELECT kind, rule_id, dataset, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_total, CAST(sum(object_index) AS BIGINT) AS index_total
        FROM (SELECT 'error' AS kind, * FROM issues WHERE severity = 'ERROR' UNION ALL SELECT 'box', * FROM issues WHERE category = 'BOUNDING_BOX') GROUP BY ALL""",
    "failed_check_issue": """SELECT * FROM (VALUES ('v2', 4, 'ERROR', 'BOUNDING_BOX', 'check_nothing', NULL, NULL, 36), ('v2', 0, 'ERROR', 'UNKNOWN', 'check_rain', 'd', 'p', 36))
        t(engine, stage, severity, category, rule, dataset, image_path, id_length)""",
    "rule_listing": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{stage}', '{prefix}{number:03}', '{severity}')"
        for stage, prefix, severity, numbers in (
            ("image", "IMG", "ERROR", (1, 2, 3, 4, 8)), ("image", "IMG", "WARNING", (5, 6, 7)), ("object", "OBJ", "ERROR", (1, 2, 4, 6, 7)),
            ("object", "OBJ", "WARNING", (3, 5)), ("object", "OBJ", "INFO", (8, 9)), ("box", "BOX", "ERROR", (*range(1, 11),)), ("box", "BOX", "WARNING", (13, 14, 15)),
        )
        for number in numbers
    )
    + ") t(stage, rule_id, severity)",
    "rules_v2_overlaps": _with(
        _IMAGES, _BOXES,
        "c AS (SELECT b.*, i.dataset, xc - w / 2 AS x1, yc - h / 2 AS y1, xc + w / 2 AS x2, yc + h / 2 AS y2 FROM boxes b JOIN images i USING (seq))",
        "p AS (SELECT a.dataset, a.xc = b.xc AND a.yc = b.yc AND a.w = b.w AND a.h = b.h AS same, "
        "CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) "
        "THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0.0 END AS o, "
        "greatest(0.0, a.x2 - a.x1) * greatest(0.0, a.y2 - a.y1) + greatest(0.0, b.x2 - b.x1) * greatest(0.0, b.y2 - b.y1) AS s "
        "FROM c a JOIN c b ON a.seq = b.seq AND a.object_index < b.object_index)",
        then="SELECT 'BOX011' AS rule_id, dataset, count(*) AS n FROM p WHERE same GROUP BY dataset UNION ALL "
        "SELECT 'BOX012', dataset, count(*) FROM p WHERE s - o > 0 AND o / (s - o) >= 0.5 GROUP BY dataset",
    ),
    "issue_rollup": "WITH " + _V1 + f"""
        , r AS (SELECT dataset, {_ROLLED} FROM issues GROUP BY dataset)
        SELECT *, n_error + n_critical = 0 AS passed, round((n_issues - n_error - n_critical) * 100.0::DOUBLE / n_issues, 4) AS success_rate FROM r""",
    "topk_reasons": "WITH " + _V1 + "\nSELECT rule_id, count(*) AS n FROM issues GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5",
    "v1_index": "WITH " + _V1 + f"""
        , r AS (SELECT dataset, {_ROLLED} FROM issues GROUP BY dataset),
        s AS (SELECT dataset, greatest(0.0::DOUBLE, 100 - 5 * n_error) AS annotation_score, greatest(0.0::DOUBLE, 100 - 2 * (n_error + n_warning)) AS image_score,
              greatest(0.0::DOUBLE, 100 - 3 * n_warning) AS class_score, greatest(0.0::DOUBLE, 100 - 4 * (n_error + n_critical)) AS box_score FROM r)
        SELECT *, round((annotation_score + image_score + class_score + box_score) / 4.0, 4) AS quality_index FROM s""",
    "quality_index_by_dataset": "WITH " + _v2(1, 100000, None) + f"""
        , r AS (SELECT dataset, {_ROLLED} FROM issues GROUP BY dataset),
        d AS (SELECT dataset, count(*) AS n_images, CAST(sum(n_objects) AS BIGINT) AS n_objects FROM counted GROUP BY dataset),
        s AS (SELECT d.dataset, n_images, n_objects, coalesce(n_issues, 0) AS n_issues, coalesce(n_info, 0) AS n_info, coalesce(n_warning, 0) AS n_warning,
                     coalesce(n_error, 0) AS n_error, coalesce(n_critical, 0) AS n_critical FROM d LEFT JOIN r USING (dataset)),
        t AS (SELECT *, {_clamped('n_error', 'n_objects')} AS annotation_completeness, {_clamped('n_error', 'n_images')} AS image_integrity,
                     {_clamped('n_warning', 'n_objects')} AS class_consistency, {_clamped('n_issues', 'n_objects')} AS box_validity FROM s),
        u AS (SELECT *, round(round((annotation_completeness + image_integrity + class_consistency + box_validity) * 100) / 4) / 100 AS quality_index FROM t)
        SELECT *, CASE WHEN quality_index >= 95 THEN 'A+' WHEN quality_index >= 90 THEN 'A' WHEN quality_index >= 80 THEN 'B' WHEN quality_index >= 70 THEN 'C'
                       WHEN quality_index >= 60 THEN 'D' ELSE 'F' END AS grade FROM u""",
    "pixel_measures": _with(
        _TILES, _NEIGHBOURS, _judged(),
        then="SELECT vec_id, brightness, contrast, dynamic_range, entropy, blur_score, sharpness, quality_score, array_to_string(issues, ',') AS issues FROM judged",
    ),
    "pixel_histogram_moments": _with(
        _TILES,
        then="SELECT vec_id, least, most, round(mean, 4) AS mean, (SELECT median(v) FROM px WHERE px.vec_id = m.vec_id) AS median, round(greatest(0.0, squares / n - mean * mean), 4) AS variance FROM m",
    ),
    "assessment_report": _with(
        _TILES, _NEIGHBOURS, _judged(),
        then="SELECT label, count(*) AS n_total, count(*) FILTER (len(issues) = 0) AS n_passed, count(*) FILTER (len(issues) > 0) AS n_failed, "
        "round(avg(quality_score), 2) AS mean_score, round(count(*) FILTER (len(issues) = 0) * 100.0::DOUBLE / count(*), 2) AS pass_percent FROM judged GROUP BY label",
    ),
    "gate_report": _with(
        _TILES, _NEIGHBOURS, _judged(),
        then="SELECT label, count(*) AS n_total, count(*) FILTER (quality_score >= 95) AS n_passed, count(*) FILTER (quality_score < 95) AS n_failed, CAST(0 AS BIGINT) AS n_corrupted, "
        "round(avg(quality_score), 2) AS mean_score, min(quality_score) AS min_score, max(quality_score) AS max_score, "
        "round(count(*) FILTER (quality_score >= 95) * 1.0::DOUBLE / count(*), 4) AS pass_rate FROM judged GROUP BY label",
    ),
    "quality_issue_histogram": _with(_TILES, _NEIGHBOURS, _judged(126, 132, 34, 9000, 5.2, 97), then="SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM judged) GROUP BY issue"),
    "sharp_issue_histogram": _with(
        _TILES, _NEIGHBOURS, _judged(),
        then="""SELECT issue, count(*) AS n FROM (SELECT unnest([CASE WHEN brightness < 20 THEN 'brightness_too_low' END, CASE WHEN brightness > 235 THEN 'brightness_too_high' END,
        CASE WHEN contrast < 36 THEN 'contrast_too_low' END, CASE WHEN sharpness < 190 THEN 'sharpness_too_low' END, CASE WHEN blur_score < 200 THEN 'blurry' END,
        CASE WHEN entropy < 3 THEN 'entropy_too_low' END, CASE WHEN quality_score < 70 THEN 'quality_score_below_threshold' END]) AS issue FROM judged) WHERE issue IS NOT NULL GROUP BY issue""",
    ),
    "norm_minmax": _mapped("round(CASE WHEN most > least THEN (v - least)::DOUBLE / (most - least) ELSE least(1.0, greatest(0.0, v)) END, 6)"),
    "norm_unit": _mapped("round(v / 255.0::DOUBLE, 6)"),
    "unit_rows": _mapped("round(CASE WHEN squares > 0 THEN v / sqrt(squares) ELSE v END, 6)"),
    "norm_zscore_clip": _mapped("round(least(1.0, greatest(0.0, CASE WHEN std > 0 THEN (v - mean) / std ELSE v END)), 6)"),
    "norm_standardize": _mapped("round((v / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6)"),
    "contrast_stretch": _mapped(_u8("(v - 64) * (255.0::DOUBLE / 128)")),
    "hist_stretch": _mapped(f"CASE WHEN most > least THEN {_u8('(v - least) * 255.0::DOUBLE / (most - least)')} ELSE v END"),
    "equalize": _with(
        _TILES,
        "c AS (SELECT a.vec_id, a.place, a.v, (SELECT count(*) FROM px b WHERE b.vec_id = a.vec_id AND b.v <= a.v) AS below FROM px a)",
        "f AS (SELECT c.*, first_value(below) OVER (PARTITION BY vec_id ORDER BY v) AS first FROM c)",
        then="SELECT vec_id, CAST(place AS INTEGER) AS place, CASE WHEN 64 > first THEN CAST(round_even((below - first) * 255.0::DOUBLE / (64 - first), 0) AS INTEGER) ELSE v END AS value FROM f",
    ),
    "adjust_contrast": _mapped(_u8(f"({_u8('v + 12.0')} - 127.5::DOUBLE) * 1.5 + 127.5")),
    "brightness_normalize": _mapped(f"CASE WHEN mean > 0 THEN {_u8('v * (128.0::DOUBLE / mean)')} ELSE v END"),
    "od_transform": _mapped("round(-ln(greatest(v, 1) / 255.0::DOUBLE), 6)"),
    "gamma_lut": _mapped(_u8("pow(v / 255.0::DOUBLE, 0.5::DOUBLE) * 255.0")),
    "cdf_match": _with(
        _TILES,
        "c AS (SELECT a.vec_id, a.place, (SELECT count(*) FROM px b WHERE b.vec_id = a.vec_id AND b.v <= a.v) AS below FROM px a)",
        then="SELECT vec_id, CAST(place AS INTEGER) AS place, CAST((below - 1) * 4 + 1 AS INTEGER) AS value FROM c",
    ),
    "channel_histogram": _with(
        _TILES,
        "k AS (SELECT vec_id, unnest(range(16)) AS b FROM tiles)",
        then="SELECT k.vec_id, CAST(k.b AS INTEGER) AS place, round(count(p.v) / 64.0::DOUBLE, 6) AS value FROM k LEFT JOIN px p ON p.vec_id = k.vec_id AND p.v * 16 // 256 = k.b GROUP BY k.vec_id, k.b",
    ),
    "color_histogram": _with(
        _TILES, _COLORS,
        "k AS (SELECT vec_id, unnest(range(48)) AS b FROM tiles)",
        "n AS (SELECT vec_id, b // 16 AS b FROM colors UNION ALL SELECT vec_id, 16 + g // 16 FROM colors UNION ALL SELECT vec_id, 32 + r // 16 FROM colors)",
        then="SELECT k.vec_id, CAST(k.b AS INTEGER) AS place, round(count(n.b) / 64.0::DOUBLE, 6) AS value FROM k LEFT JOIN n ON n.vec_id = k.vec_id AND n.b = k.b GROUP BY k.vec_id, k.b",
    ),
    "pixel_noise": _with(
        _TILES, _CELLS, _around(1),
        f"g AS (SELECT vec_id, r, c, any_value(v) - sum(nv * {_bell(0.8, 1)}) AS d FROM around1 GROUP BY vec_id, r, c)",
        then="SELECT vec_id, round(stddev_pop(d), 4) AS noise_level FROM g GROUP BY vec_id",
    ),
    "kernel_morphology": _with(
        _TILES, _CELLS,
        """e AS (SELECT g.vec_id, g.r, g.c, any_value(g.v) AS v, min(k.v) FILTER (abs(k.r - g.r) <= 1 AND abs(k.c - g.c) <= 1) AS lo, max(k.v) FILTER (abs(k.r - g.r) <= 1 AND abs(k.c - g.c) <= 1) AS hi,
          min(k.v) FILTER (abs(k.r - g.r) + abs(k.c - g.c) <= 1) AS lo_cross, max(k.v) FILTER (abs(k.r - g.r) < 2 OR k.c = g.c) AS hi_ellipse
          FROM cells g JOIN cells k ON k.vec_id = g.vec_id AND abs(k.r - g.r) <= 2 AND abs(k.c - g.c) <= 2 GROUP BY g.vec_id, g.r, g.c)""",
        """o AS (SELECT g.vec_id, g.r, g.c, any_value(g.v) AS v, any_value(g.lo) AS lo, any_value(g.hi) AS hi, any_value(g.lo_cross) AS lo_cross, any_value(g.hi_ellipse) AS hi_ellipse,
          max(k.lo) AS opened, min(k.hi) AS closed FROM e g JOIN e k ON k.vec_id = g.vec_id AND abs(k.r - g.r) <= 1 AND abs(k.c - g.c) <= 1 GROUP BY g.vec_id, g.r, g.c)""",
        then=_layers("o", "lo", "hi", "opened", "closed", "hi - lo", "v - opened", "closed - v", "lo_cross", "hi_ellipse"),
    ),
    "kernel_filters": _with(
        _TILES, _CELLS, _around(1), _around(2),
        "w AS (SELECT *, CASE WHEN abs(dr) + abs(dc) <= 1 THEN exp(-(dr * dr + dc * dc) / 11250.0::DOUBLE) * exp(-((nv - v) * (nv - v)) / 11250.0::DOUBLE) ELSE 0 END AS bw FROM around1)",
        f"a AS (SELECT vec_id, r, c, any_value(v) AS v, list_sort(list(nv))[5] AS middle, sum(nv * {_bell(0.8, 1)}) AS bell, sum(nv * bw) / sum(bw) AS two_sided, "
        "sum(CASE WHEN abs(dr) + abs(dc) = 1 THEN nv ELSE 0 END) AS plus FROM w GROUP BY vec_id, r, c)",
        f"u AS (SELECT vec_id, r, c, {_byte('sum(nv * ' + _bell(1.0, 2) + ')')} AS soft FROM around2 GROUP BY vec_id, r, c)",
        "f AS (SELECT * FROM a JOIN u USING (vec_id, r, c))",
        then=_layers("f", "middle", _byte("bell"), _byte("two_sided"), _byte("5 * v - plus"), _byte("5 * v - plus"), _byte("2 * v - soft")),
    ),
    "kernel_clahe": _with(
        _TILES,
        "k AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY vec_id, v)",
        "o AS (SELECT vec_id, sum(greatest(n - 1.0::DOUBLE, 0)) AS over FROM k GROUP BY vec_id)",
        "t AS (SELECT a.vec_id, a.v, (SELECT sum(least(b.n, 1)) FROM k b WHERE b.vec_id = a.vec_id AND b.v <= a.v) + (a.v + 1) * o.over / 256.0::DOUBLE AS s FROM k a JOIN o USING (vec_id))",
        then=f"SELECT p.vec_id, CAST(0 AS INTEGER) AS channel, CAST(place AS INTEGER) AS place, {_byte('s * 255 / 64')} AS value FROM px p JOIN t ON t.vec_id = p.vec_id AND t.v = p.v",
    ),
    "kernel_clahe_bright": _with(
        _TILES,
        "k AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY vec_id, v)",
        "o AS (SELECT vec_id, sum(greatest(n - 1.0::DOUBLE, 0)) AS over FROM k GROUP BY vec_id)",
        "t AS (SELECT a.vec_id, a.v, (SELECT sum(least(b.n, 1)) FROM k b WHERE b.vec_id = a.vec_id AND b.v <= a.v) + (a.v + 1) * o.over / 256.0::DOUBLE AS s FROM k a JOIN o USING (vec_id))",
        f"c AS (SELECT p.vec_id, place, {_byte('s * 255 / 64')} AS u FROM px p JOIN t ON t.vec_id = p.vec_id AND t.v = p.v)",
        "a AS (SELECT vec_id, avg(u) AS mu FROM c GROUP BY vec_id)",
        then=f"SELECT c.vec_id, CAST(0 AS INTEGER) AS channel, CAST(place AS INTEGER) AS place, {_byte('u * (m.mean / mu)')} AS value FROM c JOIN a USING (vec_id) JOIN m USING (vec_id)",
    ),
    "odd_sizes": _values("size INTEGER, odd INTEGER", [(-3, 1), (0, 1), (1, 1), (2, 3), (3, 3), (8, 9), (9, 9)]),
    "od_inverse": _mapped(_u8("exp(-(-ln(greatest(v, 1) / 255.0::DOUBLE) * 1.1::DOUBLE)) * 255.0::DOUBLE")),
    "color_step": _with(
        _TILES, then=f"SELECT vec_id, CAST(0 AS INTEGER) AS channel, CAST(place AS INTEGER) AS place, {_byte('(least(255, v + 12) - 127.5::DOUBLE) * 1.5::DOUBLE + 127.5::DOUBLE')} AS value FROM px"
    ),
    "step_dispatch": _with(_TILES, then="SELECT CAST(unnest(range(16)) AS INTEGER) AS channel, (SELECT count(*) FROM px) AS n, 0.0::DOUBLE AS difference"),
    "kernel_sizes": _with(
        _TILES, _CELLS,
        "q AS (SELECT vec_id, r // 2 AS r, c // 2 AS c, max(v) FILTER (r % 2 = 0 AND c % 2 = 0) AS first, avg(v) AS mean FROM cells GROUP BY vec_id, r // 2, c // 2)",
        then=_layers("q", "first", _byte("mean"), _byte("mean"), place="r * 4 + c"),
    ),
    "kernel_letterbox": _with(
        _TILES, _CELLS,
        "f AS (SELECT vec_id, unnest(range(96)) AS p FROM tiles)",
        then="SELECT f.vec_id, CAST(0 AS INTEGER) AS channel, CAST(p AS INTEGER) AS place, coalesce(v, 7)::DOUBLE AS value FROM f LEFT JOIN cells k ON k.vec_id = f.vec_id AND k.r = p // 12 AND k.c = p % 12 - 2",
    ),
    "kernel_white_balance": _with(
        _TILES, _COLORS,
        "s AS (SELECT vec_id, avg(b) AS mb, avg(g) AS mg, avg(r) AS mr, min(b) AS lb, max(b) AS hb, min(g) AS lg, max(g) AS hg, min(r) AS lr, max(r) AS hr FROM colors GROUP BY vec_id)",
        "f AS (SELECT * FROM colors JOIN s USING (vec_id))",
        then=_layers(
            "f", *[_byte(f"{x} * ((mb + mg + mr) / 3 / m{x})") for x in "bgr"],
            *[f"CASE WHEN h{x} > l{x} THEN {_byte(f'({x} - l{x}) * 255.0::DOUBLE / (h{x} - l{x})')} ELSE {x} END" for x in "bgr"], place="place",
        ),
    ),
    "kernel_gray_masks": _with(
        _TILES, _COLORS,
        "f AS (SELECT *, (1868 * b + 9617 * g + 4899 * r + 8192) // 16384 AS y FROM colors)",
        then=_layers("f", "y", "(y < 160)::INT", "(-ln(greatest(least(b, g, r), 1) / 255.0::DOUBLE) > 0.9)::INT", place="place"),
    ),
    "kernel_lab": _with(_TILES, _COLORS, _LAB, then=_layers("lab", "l", "a", "b", place="place")),
    "kernel_lab_moments": _with(
        _TILES, _COLORS, _LAB,
        then=" UNION ALL ".join(f"SELECT vec_id, CAST({k} AS INTEGER) AS place, round({m}, 5) AS value FROM spread" for k, m in enumerate(("ml", "ma", "mb", "sl", "sa", "sb"))),
    ),
    "kernel_matched_moments": _with(
        _TILES, _COLORS, _LAB,
        "f AS (SELECT * FROM lab JOIN spread USING (vec_id))",
        then=_layers(
            "f",
            *[
                f"round(least(255, greatest(0, ({x} - m{x}) * ({std}::DOUBLE / greatest(s{x}, 1e-8)) + {mean})), 4)"
                for x, mean, std in (("l", 120, 20), ("a", 130, 5), ("b", 125, 8))
            ],
            place="place",
        ),
    ),
    "kernel_hsv": _with(
        _TILES, _COLORS,
        "m AS (SELECT *, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS d FROM colors)".replace("m AS", "hs AS"),
        "f AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (g - b)::DOUBLE / d WHEN hi = g THEN 2 + (b - r)::DOUBLE / d ELSE 4 + (r - g)::DOUBLE / d END AS h FROM hs)",
        then=_layers(
            "f", "round(CASE WHEN h < 0 THEN h * 30 + 180 ELSE h * 30 END, 4)", "round(CASE WHEN hi > 0 THEN d * 255.0::DOUBLE / hi ELSE 0 END, 4)", "hi",
            "b", "g", "r", "b", "g", "r", "hi", "hi", "hi", place="place",
        ),
    ),
    "kernel_overlay": _with(
        _TILES, _COLORS,
        "h AS (SELECT *, floor(place * 255 / 64.0::DOUBLE) / 255.0::DOUBLE AS x FROM colors)",
        then=_layers("h", *[_byte(f"{_byte(f'greatest(0, least(1, 1.5::DOUBLE - abs(4 * x - {k}))) * 255')} * 0.4::DOUBLE + {c} * 0.6::DOUBLE") for k, c in ((1, "b"), (2, "g"), (3, "r"))], place="place"),
    ),
    "kernel_scales": _with(
        _TILES, _COLORS,
        then=_layers(
            "colors", *[f"round({x} / 255.0::DOUBLE, 3)" for x in "bgr"],
            *[f"round(({x} / 255.0::DOUBLE - {m}::DOUBLE) / {d}::DOUBLE, 3)" for x, m, d in (("b", 0.485, 0.229), ("g", 0.456, 0.224), ("r", 0.406, 0.225))], place="place",
        ),
    ),
    "file_listing": _values("path VARCHAR, kind VARCHAR, length BIGINT", [(n, _kind(n), None if n.endswith(".png") else len(c)) for n, c in _FILES.items()]),
    "file_listings_by_kind": _values("what VARCHAR, path VARCHAR", [(k, n) for k, names in _FOUND.items() for n in names]),
    "file_counts": _values(
        "folder VARCHAR, n_images BIGINT, n_annotations BIGINT, n_files BIGINT", [("yolo", 3, 3, 7), ("voc", 2, 2, 4), ("clinical", 0, 3, 3), ("broken", 2, 0, 2), ("none", 0, 0, 0)]
    ),
    "file_checks": _values(
        "seq BIGINT, file_found BOOLEAN, has_bytes BOOLEAN, width INTEGER, height INTEGER",
        [(0, True, True, -1, -1), (1, True, False, -1, -1), (2, False, False, 0, 0), (3, True, True, 8, 6)],
    ),
    "image_headers": _values(
        "path VARCHAR, width INTEGER, height INTEGER", [(n, 8 + k % 3, 6) for k, n in enumerate(_PICTURES)] + [("broken/bad.png", 0, 0), ("broken/zero.png", 0, 0)]
    ),
    "image_pixels": _values(
        "path VARCHAR, channels INTEGER, blue DOUBLE, green DOUBLE, red DOUBLE",
        [(n, 3, *(round(float(m) + 1e-9, 4) for m in fixtures.picture(8 + k % 3, 6, k).reshape(-1, 3).mean(0))) for k, n in enumerate(_PICTURES)],
    ),
    "split_folders": _values("split VARCHAR, n BIGINT", [("train", 2), ("val", 2), ("test", 1)]),
    "content_digests": _values(
        "path VARCHAR, md5 VARCHAR, sha256 VARCHAR", [(n, hashlib.md5(c).hexdigest(), hashlib.sha256(c).hexdigest()) for n, c in _FILES.items() if not n.endswith(".png")]
    ),
    "detected_formats": _values(
        "path VARCHAR, format VARCHAR, coarse VARCHAR", [(n, f, n.rsplit(".", 1)[1].upper() if n in _ANNOTATION_FILES else "UNKNOWN") for n, f in _FORMATS.items()]
    ),
    "path_checks": _values(
        "name VARCHAR, found BOOLEAN, folder BOOLEAN, file BOOLEAN, outcome VARCHAR",
        [
            ("yolo", True, True, False, "fine"), ("yolo/train/a.png", True, False, True, "NotADirectoryError"), ("clinical", True, True, False, "ValueError"),
            ("absent", False, False, False, "FileNotFoundError"),
        ],
    ),
    "reference_image": _values("height INTEGER, width INTEGER, total DOUBLE, refused BOOLEAN", [(6, 9, float(fixtures.picture(9, 6, 4).sum()), True)]),
    "coerced_values": """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS one,
        CAST(CASE WHEN c_custkey % 3 > 0 THEN len(string_split(c_mktsegment, 'U')) ELSE 0 END AS INTEGER) AS n_parts,
        CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '-' END AS segment, 'none' AS age FROM customer""",
    "catalog_entries": _values(
        "name VARCHAR, annotation VARCHAR, task VARCHAR, status VARCHAR, classes VARCHAR",
        [
            ("yolo", "YOLO", "Detection", "READY", "0=cell|9=odd"), ("voc", "Pascal VOC", "Detection", "READY", "0=RBC|2=Platelets"), ("coco", "COCO", "Detection", "READY", ""),
            ("classes", "None", "Classification", "READY", "0=Lymphocyte|1=Neutrophil"), ("csv", "CSV", "Classification", "READY", ""), ("points", "Point TXT", "Detection", "READY", ""),
            ("rowcol", "Row/column JSON", "Detection", "READY", ""), ("clinical", "Clinical", "Report", "ERROR", ""), ("broken", "YOLO", "Detection", "ERROR", ""),
        ],
    ),
    "built_boxes": _values("dataset VARCHAR, image VARCHAR, object_index INTEGER, class_id INTEGER, class_name VARCHAR, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE", _BUILT),
    "built_log": _values(
        "dataset VARCHAR, image VARCHAR, status VARCHAR, objects BIGINT",
        [(n.split("/")[0], n, "SUCCESS", k) for n, k in _LOGGED.items()]
        + [("yolo", "yolo/test/lonely.png", "FAILED", 0), ("broken", "broken/bad.png", "FAILED", 0), ("broken", "broken/zero.png", "FAILED", 0), ("clinical", "", "ERROR", 0)],
    ),
    "built_images": _values(
        "dataset VARCHAR, image_id VARCHAR, width INTEGER, height INTEGER, split VARCHAR",
        [
            (n.split("/")[0], n.rsplit("/", 1)[1][:-4], 8 + k % 3, 6, "val" if "valid" in n else "train")
            for k, n in enumerate(_PICTURES)
            if n.split("/")[0] in ("yolo", "points", "voc", "coco", "rowcol") and "lonely" not in n
        ],
    ),
    "clinical_reports": _values(
        "dataset VARCHAR, file VARCHAR, counts VARCHAR, findings VARCHAR",
        [("clinical", "r.txt", "Hemoglobin=14.0|WBC=7.2", "target cells|microcytic"), ("clinical", "count.txt", "", ""), ("clinical", "smear.txt", "", "")],
    ),
    "exported_files": "SELECT path, replace(text, '~', chr(10)) AS text FROM ("
    + _values(
        "path VARCHAR, text VARCHAR",
        [
            ("yolo/labels/train/a.txt", "0 0.500000 0.500000 0.250000 0.500000~1 0.250000 0.125000 0.100000 0.200000~"), ("yolo/labels/val/b.txt", ""),
            ("yolo/data.yaml", "train: images/train~val: images/val~test: images/test~nc: 2~names:~  0: cell~  1: odd~"), ("yolo/images/train/a.png", None), ("yolo/images/val/b.png", None),
            ("classes/train/cell/a.png", None), ("classes/val/unlabeled/b.png", None),
        ],
    )
    + ")",
    "exported_log": _values(
        "dataset VARCHAR, image VARCHAR, status VARCHAR, objects VARCHAR, message VARCHAR",
        [("yolo", "yolo/train/a.png", "SUCCESS", "2", ""), ("yolo", "yolo/valid/b.png", "SUCCESS", "0", ""), ("yolo", "yolo/test/lonely.png", "FAILED", "0", "no annotation")],
    ),
    "saved_dataset": _with(
        _IMAGES, _BOXES,
        then="SELECT (SELECT count(*) FROM images) AS n_images, (SELECT count(DISTINCT dataset) FROM images) AS n_datasets, count(*) AS n_objects, count(DISTINCT class_name) AS n_classes FROM boxes",
    ),
    "summary_json": _with(
        _IMAGES, _BOXES,
        then="""SELECT printf('{"n_images":%d,"n_datasets":%d,"n_objects":%d,"n_classes":%d}', (SELECT count(*) FROM images), (SELECT count(DISTINCT dataset) FROM images),
        count(*), count(DISTINCT class_name)) AS report FROM boxes""",
    ),
    "annotation_tasks": _values(
        "annotation VARCHAR, task VARCHAR",
        [(a, "Detection") for a in ("YOLO", "Point TXT", "Pascal VOC", "COCO", "Row/column JSON")] + [("CSV", "Classification"), ("None", "Classification"), ("Clinical", "Report")],
    ),
    "processed_export": _values("path VARCHAR, width INTEGER, height INTEGER", [("voc/v.png", 5, 4), ("voc/w.png", 5, 4), ("broken/bad.png", 0, 0)]),
    "pipeline_rows": _with(
        _TILES, _CELLS, _SHRUNK,
        then="""SELECT vec_id::VARCHAR AS path, 4 AS width, 4 AS height, 'uint8' AS dtype, NOT dark AS passed, CASE WHEN dark THEN 'too dark' END AS error,
        'resize:SUCCESS,check:' || CASE WHEN dark THEN 'FAILED' ELSE 'SUCCESS' END AS steps, round(mean, 4) AS brightness, 16 AS n_bytes FROM dark
        UNION ALL SELECT 'broken', -1, -1, NULL, FALSE, 'corrupted', '', NULL, NULL""",
    ),
    "pipeline_report": _with(
        _TILES, _CELLS, _SHRUNK,
        then="""SELECT count(*) + 1 AS n_images, count(*) FILTER (NOT dark) AS n_passed, count(*) FILTER (dark) + 1 AS n_failed, 2 * count(*) AS n_steps, count(*) FILTER (dark) AS n_failed_steps,
        round(count(*) FILTER (NOT dark) * 100.0::DOUBLE / (count(*) + 1), 2) AS success_percent FROM dark""",
    ),
    "pipeline_summary": _with(
        _TILES, _CELLS, _SHRUNK,
        "whole AS (SELECT count(*) AS n, count(*) FILTER (NOT dark) AS ok FROM dark)",
        then=_placed([
            (10, [f"'{'=' * 60}'", "'Preprocessing Summary'", f"'{'=' * 60}'"]),
            (11, [_field("Processed Images", "ok"), _field("Failed Images", "n + 1 - ok"), _field("Success Rate", _places("round(ok * 100.0::DOUBLE / (n + 1), 2)") + " || '%'"), _field("Applied Steps", "2 * n"), _field("Average Quality", "'0.00'")]),
            (12, [f"'{'=' * 60}'"]),
        ]),
    ),
    "pipeline_records": _with(
        _TILES, _CELLS, _SHRUNK,
        then="SELECT NOT dark AS passed, CASE WHEN dark THEN 'too dark' END AS error, count(*) AS n, 2 * count(*) AS n_steps FROM dark GROUP BY dark UNION ALL SELECT FALSE, 'corrupted', 1, 0",
    ),
    "sidecar_records": _with(
        _TILES, _CELLS, _SHRUNK,
        then="SELECT vec_id::VARCHAR AS path, 4 AS width, NOT dark AS passed, TRUE AS no_pixels, 2 AS n_steps FROM dark UNION ALL SELECT 'broken', -1, FALSE, TRUE, 0",
    ),
    "assessed_images": _with(
        _TILES, _NEIGHBOURS, _judged(126, 132, 34, 9000, 5.2, 97),
        then="""SELECT CASE WHEN vec_id::VARCHAR LIKE '1%' THEN 'cached' ELSE 'measured' END AS source, FALSE AS corrupted, len(issues) = 0 AS passed, count(*) AS n,
        count(*) FILTER (vec_id::VARCHAR LIKE '1%') AS n_taken FROM judged GROUP BY 1, 3 UNION ALL SELECT 'measured', TRUE, FALSE, 1, 0""",
    ),
    "pipeline_editing": _values(
        "state VARCHAR, names VARCHAR",
        [
            ("configured", "resize,sharpen,histogram"), ("extended", "resize,first,sharpen,histogram,last"), ("removed", "first,sharpen,histogram,last"), ("cleared", ""),
            ("registered", "blur,sharp"), ("unregistered", "sharp"), ("known", "sharp"), ("emptied", ""),
        ],
    ),
    "rejected_configs": _values(
        "name VARCHAR, outcome VARCHAR",
        [("fine", "accepted"), ("unknown", "KeyError"), ("operation", "TypeError")] + [(n, "ValueError") for n in ("width", "clip", "kernel", "sharpen", "gamma", "bounds", "reference")],
    ),
    "report_v1_text": "WITH " + _v1_issues(planted=True) + ",\n" + _V1_FACTS + ",\nlines AS ("
    + " UNION ALL ".join(
        [
            *_heads(
                (10, ("=" * 70, "Validation Report", "=" * 70)), (20, ("", "SUMMARY", "-" * 70)), (30, ("", "DATASET STATISTICS", "-" * 70)),
                (40, ("", "QUALITY METRICS", "-" * 70)), (50, ("", "ISSUES", "-" * 70)), (32, ("Dataset Distribution",)), (33, ("Class Distribution",)),
            ),
            *_v1_sections(False),
            "SELECT 32, printf('  %-20s %d', dataset, count(*)) FROM images WHERE dataset IS NOT NULL GROUP BY dataset",
            "SELECT 33, printf('  %-20s %d', class_name, count(*)) FROM boxes WHERE class_name IS NOT NULL GROUP BY class_name",
            "SELECT 52, '[' || severity || '] ' || category FROM issues",
        ]
    )
    + ") SELECT section, line, count(*) AS n FROM lines GROUP BY ALL",
    "report_v1_markdown": "WITH " + _V1 + ",\n" + _V1_FACTS + ",\nlines AS ("
    + " UNION ALL ".join(
        [
            *_heads(
                (10, ("# Validation Report", "")), (20, ("## Summary",)), (30, ("", "## Dataset Statistics")), (40, ("", "## Quality Metrics")), (50, ("", "## Issues")),
            ),
            *_v1_sections(True),
            "SELECT 52, '- **' || severity || '** (' || category || ')' FROM issues",
        ]
    )
    + ") SELECT section, line, count(*) AS n, count(*) AS n_places FROM lines GROUP BY ALL",
    "report_v1_json": "WITH " + _V1 + ",\n" + _V1_FACTS + " SELECT n_issues, n_error, n_objects, class_score FROM whole",
    "report_v2_text": "WITH " + _v2(1, 100000, None, True) + f""",
r AS (SELECT {_ROLLED} FROM issues),
i AS (SELECT count(*) AS n_images, CAST(sum(n_objects) AS BIGINT) AS n_objects, min(width) AS min_width, max(width) AS max_width, avg(width) AS mean_width, min(height) AS min_height,
  max(height) AS max_height, avg(height) AS mean_height, avg(n_objects) AS mean_objects, min(n_objects) AS min_objects, max(n_objects) AS max_objects, count(*) FILTER (n_objects = 0) AS n_empty FROM counted),
b AS (SELECT min(w) AS min_w, max(w) AS max_w, avg(w) AS mean_w, min(h) AS min_h, max(h) AS max_h, avg(h) AS mean_h FROM boxes),
d AS (SELECT string_agg(dataset, '+' ORDER BY dataset) AS dataset_name FROM (SELECT DISTINCT dataset FROM images WHERE dataset IS NOT NULL)),
t AS (SELECT *, {_clamped('n_error', 'n_objects')} AS c1, {_clamped('n_error', 'n_images')} AS c2, {_clamped('n_warning', 'n_objects')} AS c3, {_clamped('n_issues', 'n_objects')} AS c4 FROM r, i, b, d),
whole AS (SELECT *, round(round((c1 + c2 + c3 + c4) * 100) / 4) / 100 AS q FROM t), lines AS (""" + " UNION ALL ".join(
        [
            *_heads(
                (10, ("=" * 79, "Dataset Validation Report", "=" * 79, "")), (20, ("Metadata", "-" * 79)), (30, ("", "Validation Summary", "-" * 79)),
                (40, ("", "Dataset Statistics", "-" * 79)), (50, ("", "Quality Metrics", "-" * 79)), (60, ("", "Validation Issues", "-" * 79)), (70, ("=" * 79,)),
            ),
            _rows(21, _field("Dataset Name", "dataset_name")),
            _rows(31, _field("Validation Passed", "CASE WHEN n_error + n_critical = 0 THEN 'True' ELSE 'False' END"), _field("Total Images", "n_images"), _field("Total Objects", "n_objects"),
                  _field("Total Issues", "n_issues"), _field("Information", "n_info"), _field("Warnings", "n_warning"), _field("Errors", "n_error"), _field("Critical", "n_critical")),
            _rows(41, *[_field(n, v, 27) for n, v in (
                ("Total Images", "n_images"), ("Total Objects", "n_objects"), ("Minimum Width", "min_width"), ("Maximum Width", "max_width"), ("Average Width", _places("mean_width")),
                ("Minimum Height", "min_height"), ("Maximum Height", "max_height"), ("Average Height", _places("mean_height")), ("Average Objects/Image", _places("mean_objects")),
                ("Minimum Objects/Image", "min_objects"), ("Maximum Objects/Image", "max_objects"), ("Empty Images", "n_empty"),
                *[(f"{w} Box {l}", _places(f"{k}_{s}")) for l, s in (("Width", "w"), ("Height", "h")) for w, k in (("Minimum", "min"), ("Maximum", "max"), ("Average", "mean"))])]),
            _rows(51, _field("Completeness", _places("c1")), _field("Image Integrity", _places("c2")), _field("Class Consistency", _places("c3")), _field("Box Validity", _places("c4")), _field("Quality Index", _places("q")),
                  _field("Grade", "CASE WHEN q >= 95 THEN 'A+' WHEN q >= 90 THEN 'A' WHEN q >= 80 THEN 'B' WHEN q >= 70 THEN 'C' WHEN q >= 60 THEN 'D' ELSE 'F' END")),
            "SELECT 62, '[' || severity || '] ' || rule_id FROM issues",
        ]
    )
    + ") SELECT section, line, count(*) AS n FROM lines GROUP BY ALL",
    "report_gate_text": _with(
        _TILES, _NEIGHBOURS, _judged(126, 132, 34, 9000, 5.2, 97), _REASONS,
        "whole AS (SELECT count(*) AS n, count(*) FILTER (quality_score >= 95) AS ok, avg(quality_score) AS m, min(quality_score) AS lo, max(quality_score) AS hi FROM judged)",
        then=_placed([
            (10, [f"'{'=' * 70}'", "'Dataset Quality Report'", f"'{'=' * 70}'"]),
            (11, [_field("Total images", "n"), _field("Corrupted", "0"), _field("Passed", "printf('%d (%.1f%%)', ok, round(round(ok::DOUBLE / n, 4) * 100, 1))"), _field("Failed", "n - ok")]),
            (12, [_field("Quality score", f"'mean=' || {_places('m')} || ' min=' || {_places('lo')} || ' max=' || {_places('hi')}")]),
            (13, ["''", "'Failure reasons:'"]),
        ]) + " UNION ALL SELECT 13, p + 1, printf('  %4d  %s', n, issue) FROM ranked",
    ),
    "report_assessment_text": _with(
        _TILES, _NEIGHBOURS, _judged(126, 132, 34, 9000, 5.2, 97), _REASONS,
        "whole AS (SELECT count(*) AS n, count(*) FILTER (len(issues) = 0) AS ok, avg(quality_score) AS m FROM judged)",
        then=_placed([
            (10, [f"'{'=' * 70}'", "'Quality Assessment'", f"'{'=' * 70}'"]),
            (11, [_field("Total images", "n", 15), _field("Passed", "printf('%d (%.2f%%)', ok, round(ok * 100.0::DOUBLE / n, 2))", 15), _field("Failed", "n - ok", 15), _field("Mean quality", _places("m"), 15)]),
            (13, ["''", "'Issue breakdown:'"]),
        ]) + " UNION ALL SELECT 13, p + 1, printf('  %-30s %d', issue, n) FROM ranked",
    ),
    "failed_tiles": _with(_TILES, _NEIGHBOURS, _judged(126, 132, 34, 9000, 5.2, 97), then="SELECT vec_id FROM judged WHERE len(issues) > 0"),
    "degrade_boxes": _with(
        _IMAGES, _BOXES, _damaged("0.5", 42, "val"),
        then="SELECT seq, object_index, class_id, class_name, round(xc, 6) AS xc, round(yc, 6) AS yc, w, h, damaged FROM damaged",
    ),
    "degradation_index": _with(
        _IMAGES, _BOXES, then="SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_level(n, s) for n, s in (("clean", "0.0"), ("moderate", "0.25"), ("extreme", "0.75")))
    ),
    "training_halves": _with(
        "images AS (SELECT vec_id AS seq, label FROM embeddings)",
        _SPLITS.format(uniform=_uniform("42", "seq"), stratum="label", free="TRUE", train="0.75", val="0.0"),
        "c AS (SELECT label, count(*) FILTER (place <= a) AS n_train, count(*) FILTER (place > a) AS n_test FROM bounds GROUP BY label)",
        then="SELECT label, n_train, n_test, round(sum(n_train) OVER ()::DOUBLE / (count(*) OVER () * n_train), 6) AS weight FROM c",
    ),
    "yolo_label_lines": _with(
        _IMAGES, _BOXES,
        "ids AS (SELECT class_id, row_number() OVER (ORDER BY class_id) - 1 AS new_id FROM (SELECT DISTINCT class_id FROM boxes))",
        "t AS (SELECT seq, string_agg(printf('%d %.6f %.6f %.6f %.6f', new_id, xc, yc, w, h), chr(10) ORDER BY object_index) || chr(10) AS label_text FROM boxes JOIN ids USING (class_id) GROUP BY seq)",
        then=r"SELECT i.seq, coalesce(nullif(split, ''), 'train') AS split, regexp_replace(split_part(image_path, '/', -1), '\.[^.]*$', '') AS stem, coalesce(label_text, '') AS label_text "
        "FROM images i LEFT JOIN t USING (seq)",
    ),
    "manifest_rows": _with(
        _BOXES,
        "ids AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS new_id FROM (SELECT DISTINCT class_id FROM boxes))",
        "f AS (SELECT class_id, arg_min(class_name, (seq, object_index)) AS name FROM boxes WHERE trim(class_name) <> '' GROUP BY class_id)",
        then="SELECT new_id, coalesce(name, 'Class_' || class_id) AS name FROM ids LEFT JOIN f USING (class_id)",
    ),
    "class_folder_paths": _with(
        _IMAGES, _BOXES,
        then="SELECT i.seq, coalesce(nullif(split, ''), 'train') || '/' || coalesce(nullif(b.class_name, ''), 'unlabeled') || '/' || split_part(image_path, '/', -1) AS target "
        "FROM images i LEFT JOIN boxes b ON b.seq = i.seq AND b.object_index = 0",
    ),
}
