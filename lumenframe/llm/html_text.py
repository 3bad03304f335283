"""Main text of pages by nearest-URL page differencing.

Pages of one host are sorted by path; a page's mate is the neighbour whose path shares
the longer prefix with its own. The visible lines of both are aligned by longest common
subsequence, and shared lines are deleted: they belong to the template.

Every page takes part with all its visible lines. Markup then corrects what
differencing cannot know, and nothing else:

* a shared line inside an article (``article``, ``main``, ``role=main``, schema.org
  ``articleBody``) is a passage that two articles quote, and is restored;
* a line that only this page has, but that its markup names as a menu, form, advert,
  notice, reader comment ..., or that stands outside of the page's article, is dropped.

Method
------
1. One scan parses each page and emits its host, path, a key of its raw html and one of
   its lines, and the lines' hashes; texts stay where they are. Pages of a host with
   equal lines are one class, at the least path of its members, so copies are never
   each other's mates.
2. Classes are ranged by (host, path, key), so a host of any size spreads over many
   tasks; the last class before a range and the first one after it are added to the
   range, so mates do not depend on where ranges end.
3. Hashes of mates are aligned in linear memory. The positions of shared lines come
   back as one bitmap for each class that has some.
4. The second scan parses the pages into texts. Pages without a shared line pass
   straight on; the others are joined with their class's bitmap.

Defined results: null or empty html gives an empty text; a page alone on its host, or
without a host, or whose host has no page of other lines, shares nothing; of equal
prefixes the earlier neighbour is the mate; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_bits, discard, materialize, small_batches
from .exact_dedup import group_bitmap, mark_members
from .url_filter import host_and_path

# Element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset(
    "applet audio button canvas datalist dialog embed fieldset footer form frame frameset head header iframe input map math "
    "menu nav noframes noscript object optgroup option script search select style svg template textarea title video".split()
)
ASIDE_TAGS = frozenset(("aside",))
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements whose end tag may be missing: a new one of the group ends the open one.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"br", "button"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
}
# Words of class, id and role that mark blocks beside the article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar "
    "navigation navigation-bar newsletter notice notices pager pagination paywall popup print-only promo promoted promotion "
    "related respond reply replies search share sharing shares sidebar sidebars signup skip-link social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
BESIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_SPACE = re.compile(r"\s+")
OUTSIDE, INSIDE, BESIDE = 0, 1, 2
#: Elements whose text is never visible as lines of the page.
NEVER_SHOWN = frozenset(("applet audio canvas datalist embed frame frameset head iframe input map math noembed noframes noscript object script style svg template textarea title video").split())


def _beside(attrs: dict[str, str]) -> bool:
    if attrs.get("role", "").strip().lower() in BESIDE_ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    for key in ("class", "id"):
        for name in attrs.get(key, "").split():
            lowered = name.lower()
            if lowered in BESIDE_WORDS or any(part in BESIDE_WORDS for part in re.split(r"[-_:]+", lowered)):
                return True
            if any(part.lower() in BESIDE_WORDS for part in _NAME_PART.findall(name)):
                return True
    return False


class _Blocks(HTMLParser):
    """Collects visible lines with their place: inside or outside of an article, or beside it."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        #: Words of the open line, and those that stand beside the article within it.
        self._words: list[str] = []
        self._aside: list[str] = []
        #: Open elements: (tag, text is beside the article, inside an article).
        self._open: list[tuple[str, bool, bool]] = [("", False, False)]
        self._hidden = 0

    def _flush(self) -> None:
        for place, words in ((INSIDE if self._open[-1][2] else OUTSIDE, self._words), (BESIDE, self._aside)):
            text = _SPACE.sub(" ", "".join(words)).strip() if words else ""
            words.clear()
            if text:
                self.blocks.append((place, text))

    def _say(self, data: str) -> None:
        if not self._hidden:
            (self._aside if self._open[-1][1] else self._words).append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self._open) - 1, max(0, len(self._open) - 12), -1):
            name = self._open[k][0]
            if tag in CLOSED_BY.get(name, ()):
                self._close(k)
                break
            if name in BLOCK_TAGS:
                break
        if tag in BLOCK_TAGS:
            self._flush()
        if tag in VOID_TAGS:
            return
        known = {k.lower(): v or "" for k, v in attrs}
        _, dropped, inside = self._open[-1]
        if not dropped:
            if tag in ("html", "body"):
                dropped = False
            elif tag in ARTICLE_TAGS or known.get("role", "").lower() in ("main", "article") or known.get("itemprop") == "articleBody":
                dropped = _comment_like(known)
                inside = inside or not dropped
            elif tag == "header" and inside:
                dropped = False  # an article's own header holds its title
            else:
                dropped = tag in NEVER_TEXT or tag in ASIDE_TAGS or _beside(known)
        self._hidden += tag in NEVER_SHOWN
        self._open.append((tag, dropped, inside))

    def _drop(self, k: int) -> None:
        self._hidden -= sum(tag in NEVER_SHOWN for tag, _, _ in self._open[k:])
        del self._open[k:]

    def _close(self, k: int) -> None:
        self._flush()
        self._drop(k)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                if tag in BLOCK_TAGS or self._open[k][1] != self._open[k - 1][1] or self._open[k][2] != self._open[k - 1][2]:
                    self._close(k)
                else:
                    self._drop(k)
                return
            if self._open[k][0] in ("article", "main", "body", "html", "table") and tag not in ("article", "main", "body", "html", "table"):
                return  # a stray end tag does not close its surroundings
        if tag in ("p", "br"):
            self._flush()

    def handle_data(self, data: str) -> None:
        self._say(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self._say(data[6:])

    def finish(self) -> list[tuple[int, str]]:
        self.close()
        self._flush()
        return self.blocks


def _comment_like(attrs: dict[str, str]) -> bool:
    names = re.split(r"[\s_-]+", f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('itemprop', '')}".lower())
    return bool({"comment", "comments", "reply", "replies", "respond", "ad", "ads", "advert", "promo", "sponsored", "related"} & set(names))


def text_blocks(html: str | None) -> list[tuple[int, str]]:
    """(OUTSIDE, INSIDE or BESIDE of an article, text) of each visible line in page order."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    return parser.finish()


#: Symbols that occur more often than this keep their bit mask while a table row is computed.
_FREQUENT = 64
#: Parts of at most this many cells are aligned by a whole table.
_SMALL = 1 << 12


def _prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of ``x`` with each prefix of ``y``, by bit-parallel rows."""
    places: dict[int, list[int]] = {}
    for k, symbol in enumerate(y):
        places.setdefault(symbol, []).append(k)
    masks = {s: sum(1 << k for k in at) for s, at in places.items() if len(at) > _FREQUENT}
    full = (1 << len(y)) - 1
    row = full
    for symbol in x:
        mask = masks.get(symbol)
        if mask is None:
            mask = sum(1 << k for k in places.get(symbol, ()))
        hit = row & mask
        if hit:
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _table_alignment(x: list[int], y: list[int]) -> list[int]:
    best = [[0] * (len(y) + 1)]
    for symbol in x:
        above, row = best[-1], [0]
        for k, other in enumerate(y):
            row.append(above[k] + 1 if symbol == other else max(above[k + 1], row[k]))
        best.append(row)
    found, i, k = [], len(x), len(y)
    while i and k:
        if best[i][k] == best[i - 1][k]:
            i -= 1
        elif best[i][k] == best[i][k - 1]:
            k -= 1
        else:
            i, k = i - 1, k - 1
            found.append(i)
    return found[::-1]


def common_subsequence(x: list[int], y: list[int]) -> list[int]:
    """Indices of ``x`` in a longest common subsequence with ``y``; memory grows with their lengths only.

    The middle row of the table, computed from both ends, tells where to divide ``y``.
    """
    found: list[int] = []
    parts = [(0, len(x), 0, len(y))]
    while parts:
        a, b, c, d = parts.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            if x[a] in y[c:d]:
                found.append(a)
            continue
        if (b - a) * (d - c) <= _SMALL:
            found += [a + k for k in _table_alignment(x[a:b], y[c:d])]
            continue
        middle = (a + b) // 2
        ahead = _prefix_lengths(x[a:middle], y[c:d])
        behind = _prefix_lengths(x[middle:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(np.argmax(ahead + behind))
        parts += [(a, middle, c, cut), (middle, b, cut, d)]
    return sorted(found)


def shared_lines(mine: list, other: list) -> list[int]:
    """Indices of ``mine`` in a longest common subsequence with ``other``.

    Equal ends are matched first; lines that the other page lacks take no part.
    """
    least = min(len(mine), len(other))
    head = 0
    while head < least and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < least - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    ends = [*range(head), *range(len(mine) - tail, len(mine))]
    common = set(mine[head : len(mine) - tail]) & set(other[head : len(other) - tail])
    at = [k for k in range(head, len(mine) - tail) if mine[k] in common]
    code = {s: k for k, s in enumerate(common)}
    x, y = [code[mine[k]] for k in at], [code[s] for s in other[head : len(other) - tail] if s in common]
    return sorted(ends + [at[k] for k in common_subsequence(x, y)])


def main_text(blocks: list[tuple[int, str]], shared: set[int]) -> tuple[str, int, int]:
    """(text, shared lines that are deleted, shared lines that are restored as quoted)."""
    has_article = any(place == INSIDE for place, _ in blocks)
    wanted = INSIDE if has_article else OUTSIDE
    kept = "\n".join(text for k, (place, text) in enumerate(blocks) if place == wanted and (k not in shared or place == INSIDE))
    quoted = sum(blocks[k][0] == INSIDE for k in shared)
    return kept, len(shared) - quoted, quoted


def line_hashes(blocks: list[tuple[int, str]]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) for _, text in blocks], np.uint64)


def html_key(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def _prints(pages: DataFrame) -> DataFrame:
    """pages: host, path, page_key, html; without html, but with lines_key and lines (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches):
            found = [line_hashes(text_blocks(h.as_py())).tobytes() for h in batch.column(3)]
            keys = [xxhash.xxh3_128_digest(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(found, pa.binary())],
                names=["host", "path", "page_key", "lines_key", "lines"],
            )

    return pages.select("host", "path", "page_key", "html").mapInArrow(
        run, "host string, path string, page_key string, lines_key binary, lines binary"
    )


def with_mates(classes: DataFrame) -> DataFrame:
    """classes: host, path, lines_key, lines; with the lines of the nearest neighbour on the host (``mate``).

    Rows are ranged by (host, path, lines_key). The last row before each range and the
    first one after it are found by their range number, one of each for a range.
    """
    order = ["host", "path", "lines_key"]
    ranged = classes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "pages-ranged")
    place = F.struct(*order)
    ends = {r["part"]: (r["first"], r["last"]) for r in ranged.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).collect()}
    known = sorted(ends)
    borders = [(*ends[a][1], b) for a, b in zip(known, known[1:])] + [(*ends[b][0], a) for a, b in zip(known, known[1:])]
    spark = classes.sparkSession
    kind = "host string, path string, lines_key binary, goes_to int"
    borders = spark.createDataFrame([(h, p, bytes(k), part) for h, p, k, part in borders], kind)
    added = ranged.join(borders, order).select(*order, "lines", F.col("goes_to").alias("part"), F.lit(False).alias("own"))
    rows = ranged.select(*order, "lines", "part", F.lit(True).alias("own")).unionByName(added)
    near = Window.partitionBy("part").orderBy(*order)
    there = F.struct("host", "path", "lines")
    found = rows.select(
        *order, "lines", "own", F.lag(there).over(near).alias("before"), F.lead(there).over(near).alias("after")
    ).filter("own")
    mates = [F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)) for side in ("before", "after")]
    return found.select(
        *order, "lines", *[m[field].alias(f"{side}_{field}") for side, m in zip(("before", "after"), mates) for field in ("path", "lines")]
    ).filter("before_lines IS NOT NULL OR after_lines IS NOT NULL")


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _aligned(classes: DataFrame) -> DataFrame:
    """host, lines_key, shared (int32 positions of lines shared with the mate), where there are any."""
    names = ("host", "lines_key", "path", "lines", "before_path", "before_lines", "after_path", "after_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[], [], []]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                host, key, path, lines, *near = row
                sides = [(p, ls) for p, ls in (near[:2], near[2:]) if ls is not None]
                mate = max(sides, key=lambda side: _common_prefix(side[0], path))[1]
                shared = shared_lines(np.frombuffer(lines, np.uint64).tolist(), np.frombuffer(mate, np.uint64).tolist())
                if shared:
                    for column, value in zip(out, (host, key, np.array(shared, np.int32).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                names=["host", "lines_key", "shared"],
            )

    return classes.select(*names).mapInArrow(run, "host string, lines_key binary, shared binary")


def _texts(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html, shared; one row of results each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [
                main_text(text_blocks(h.as_py()), set(np.frombuffer(at.as_py() or b"", np.int32).tolist()))
                for h, at in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([text for text, _, _ in found], pa.string()),
                    pa.array([len(text) for text, _, _ in found], pa.int64()),
                    pa.array([n for _, n, _ in found], pa.int64()),
                    pa.array([n for _, _, n in found], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_shared", "n_quoted"],
            )

    return pages.select("page_id", "url", "html", "shared").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_shared long, n_quoted long"
    )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and how many lines it shares with its mate:
    n_shared of the template (deleted) and n_quoted of its article (restored)."""
    host, path = host_and_path(F.col(url_col))
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        host.alias("host"),
        path.alias("path"),
        html_key(F.col(html_col)).alias("page_key"),
        F.col(html_col).alias("html"),
    )
    prints = materialize(_prints(source.filter("host <> ''")).filter("length(lines) > 0"), "pages-prints")
    classes = prints.groupBy("host", "lines_key").agg(F.min("path").alias("path"), F.any_value("lines").alias("lines"))
    aligned = materialize(_aligned(with_mates(classes)), "pages-aligned")
    shared = prints.select("host", "page_key", "lines_key").distinct().join(aligned, ["host", "lines_key"])
    shared = materialize(shared.select("host", "page_key", "shared"), "pages-shared")
    discard(prints, aligned)

    slot = F.pmod(F.xxhash64("host", "page_key"), F.lit(bitmap_bits(shared.count()))) + F.lit(1)
    marked = mark_members(source, materialize(group_bitmap(shared, slot), "pages-marked"), slot, "marked")
    joined = marked.filter("marked").join(shared, ["host", "page_key"], "left").select("page_id", "url", "html", "shared")
    alone = marked.filter("NOT marked").select("page_id", "url", "html", F.lit(None).cast("binary").alias("shared"))
    return _texts(alone.unionByName(joined))
