import gzip
import hashlib
import html
import html.entities
import os
import random
import re
import tracemalloc

import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import html_text as H
from lumenframe.llm import warc as W


def text(page):
    return H.main_text(H.text_blocks(page), set())[0]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<article><h1>T&amp;t</h1><p>a  b\n c<p>d<b>e</b>f</article>", "T&t\na b c\ndef"),
        ("<nav>menu</nav><main><p>x</p><aside>s</aside><form>f<p>g</form><p>y</p></main><footer>z</footer>", "x\ny"),
        ("<article><p>x</p><div class='ad-box'>buy</div><section id=comments><p>first!</p></section>y</article>", "x\ny"),
        ("<article><script>var a='</p>';</script><style>p{}</style><p>k&nbsp;l<!-- c --></p><noscript>n</noscript></article>", "k l"),
        ("<div class='cookie-notice'>ok</div><div id=content><p>only</p></div>", "only"),
        ("<article><header><h1>own</h1></header><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "own\n1\n2\na\nb"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("", ""), (None, ""), ("<article></article>", ""), ("plain & simple", "plain & simple"), ("<p>a<br>b</p></div></p>", "a\nb"),
    ],
)
def test_main_text(page, wanted):
    assert text(page) == wanted


def lcs_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            best[i + 1][k + 1] = best[i][k] + 1 if x == y else max(best[i][k + 1], best[i + 1][k])
    return best[-1][-1]


def check_alignment(a, b, shared):
    assert shared == sorted(set(shared))
    rest = iter(b)
    assert all(any(y == a[k] for y in rest) for k in shared)


@pytest.mark.parametrize("seed", range(60))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    n, symbols = (12, 4) if seed < 30 else (200, rng.choice((2, 5, 100)))
    a, b = ([rng.randrange(symbols) for _ in range(rng.randrange(n))] for _ in range(2))
    shared = H.shared_lines(a, b)
    assert len(shared) == lcs_length(a, b)
    check_alignment(a, b, shared)


def test_very_long_pages_need_linear_memory():
    rng = random.Random(4)
    a = list(range(40000))
    b = a[:]
    rng.shuffle(b)
    tracemalloc.start()
    shared = H.shared_lines(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    check_alignment(a, b, shared)
    assert 350 < len(shared) < 450 and most < 64 << 20  # a random order holds an increasing run of about 2 sqrt(n)


def brute_force(rows):
    """Every page's text from its definition: all pages in one place, a plain quadratic alignment."""
    pages = []
    for page_id, url, source in rows:
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        pages.append((host.lower(), path, page_id, url, H.text_blocks(source)))
    out = []
    for host, path, page_id, url, blocks in pages:
        lines = tuple(t for _, t in blocks)
        classes = {}
        for h, p, _, _, other in pages:
            texts = tuple(t for _, t in other)
            if h and h == host and texts:
                classes[texts] = min(p, classes.get(texts, p))
        shared = set()
        if lines in classes:
            ordered = sorted((p.encode(), xxhash.xxh3_128_digest(H.line_hashes([(0, t) for t in ts]).tobytes()), p, ts) for ts, p in classes.items())
            at = [x[3] for x in ordered].index(lines)
            near = [ordered[k] for k in (at - 1, at + 1) if 0 <= k < len(ordered)]
            if near:
                mate = max(near, key=lambda x: len(os.path.commonprefix([x[2], ordered[at][2]])))
                shared = H.shared_lines(list(lines), list(mate[3]))
                assert len(shared) == lcs_length(lines, mate[3])
        out.append((page_id, url, *H.main_text(blocks, set(shared))))
    return sorted(out, key=repr)


def template(body):
    return f"<div>Site name</div><div>Home | News</div>{body}<div>Imprint</div>"


def site():
    rows = [
        (1, "http://h.com/news/1", template("<p>one</p><p>two</p>")), (2, "http://h.com/news/2", template("<p>three</p>")), (3, "http://h.com/zz", template("<p>four</p>")),
        (4, "http://solo.com/a", template("<p>five</p>")), (5, None, None), (6, "http://h.com/news/1", template("<p>one</p><p>two</p>")),
        (7, "http://q.com/1", "<p>Top</p><article><p>quoted</p><p>x</article>"), (8, "http://q.com/2", "<p>Top</p><article><p>quoted</p><p>y</article>"), (8, "http://q.com/2", "<p>Top</p><article><p>quoted</p><p>y</article>"),
        (9, "no scheme", template("<p>z</p>")), (None, "http://H.com/news/3?x", template("<p>three</p>") + "<!-- other html, same lines -->"),
    ]
    return rows + [(100 + k, f"http://many.com/p/{k:03d}", template(f"<p>body {k}</p>")) for k in range(40)]


def extracted(spark, rows, parts):
    pages = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "page_id long, url string, html string, host string, Shared string, marked int").repartition(parts)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(parts))
    spark.conf.set(keys[1], "false")
    try:
        return sorted(((r.page_id, r.url, r.text, r.n_shared, r.n_quoted) for r in H.extract_main_text(pages).collect()), key=repr)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_differencing_does_not_depend_on_partitions(spark, parts):
    rows = site()
    found = extracted(spark, rows, parts)
    assert found == brute_force(rows)
    by_id = {r[0]: r for r in found}
    assert by_id[1][2] == by_id[6][2] == "one\ntwo" and by_id[2][2] == by_id[None][2] == "three" and by_id[3][2] == "four"
    assert by_id[4][2] == by_id[9][2].replace("z", "five") == "Site name\nHome | News\nfive\nImprint" and by_id[5][2] == ""
    assert by_id[7][2:] == ("quoted\nx", 1, 1) and all(by_id[100 + k][2] == f"body {k}" for k in range(40))


def test_long_pages_and_no_pages(spark):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(20000)]
    mixed = rng.sample(lines, len(lines))
    rows = [(1, "http://l.com/1", "".join(f"<p>{t}</p>" for t in lines)), (2, "http://l.com/2", "".join(f"<p>{t}</p>" for t in mixed)), (3, "http://l.com/3", "word " * 500000)]
    found = extracted(spark, rows, 2)
    assert len(found) == 3 and found[0][3] == found[0][2].count("\n") * -1 + 19999 and found[2][2] == ("word " * 500000).strip()
    assert extracted(spark, rows[:0] or [(1, None, None)], 1)[0][2] == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_main_text(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_differencing_acts_on_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = H.extract_main_text(pages).collect()
    assert sum(r.n_shared > 0 for r in found) > 0
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(((r.page_id, r.url, r.text, r.n_shared, r.n_quoted) for r in found), key=repr) == brute_force(rows)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>Hi &amp; bye</p><script>x()</script>"), (2, "http://a/é", None), (None, None, "é" * 200000), (1, "http://a/1", "<p>Hi &amp; bye</p><script>x()</script>")]
    pages = spark.createDataFrame([(*r, "b") for r in rows], "page_id long, url string, html string, block string")
    derived = W.derive(W.responses(pages))
    assert derived.count() == 8
    lines = W.to_warc(derived).collect()
    (tmp_path / "all.warc.gz").write_bytes(b"".join(bytes(r.warc) for r in lines))
    (tmp_path / "plain.warc").write_bytes(b"".join(gzip.decompress(bytes(r.warc)) for r in lines))
    wanted = sorted((r.warc_type, r.record_id, r.refers_to, r.target_uri, r.block_digest, r.block) for r in derived.collect())
    for name in ("all.warc.gz", "plain.warc"):
        got = W.read_warc(spark, str(tmp_path / name)).collect()
        assert sorted((r.warc_type, r.record_id, r.refers_to, r.target_uri or "", r.block_digest, bytes(r.block).decode()) for r in got) == wanted
        assert all(r.content_length == len(r.block) for r in got)
    first = derived.filter("warc_type = 'conversion'").orderBy("content_length").collect()
    assert {r.block for r in first} >= {"Hi & bye", ""}
    assert W.derive(W.responses(pages.limit(0))).count() == 0


def test_plain_text_decodes_every_reference(spark):
    names = sorted(html.entities.html5)
    texts = [f"a &{n} b" if n.endswith(";") else f"a &{n}; b" for n in names] + ["&#233;&#xe9;&#128;&#0;&#x110000;", "&amp;lt; &notit; &nosuch; &", "caf&eacute; &mdash; &rsquo;"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, html string")
    found = {r.id: r.text for r in rows.select("id", W.plain_text(F.col("html")).alias("text")).collect()}
    for k, t in enumerate(texts):
        plain = re.sub(r"[ \t\r\f]+", " ", html.unescape(t).replace("\u00a0", " "))
        assert found[k] == re.sub(r" ?\n[ \n]*", "\n", plain).strip(" \n"), t
    hidden = spark.createDataFrame([("x<textarea>t</textarea><noscript>n</noscript ><SVG a='1'>s</SVG><selection>k</selection><!-- c -->y<script>never closed",)], "html string")
    assert hidden.select(W.plain_text(F.col("html")).alias("t")).first().t == "x k y"


def test_derivatives_of_read_responses(spark, tmp_path):
    pages = {
        "plain": (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Cache: hit\r\nSet-Cookie: a=1\r\n\r\n", "<p>caf\u00e9 &eacute;</p>".encode("latin-1"), "caf\u00e9 \u00e9"),
        "zipped": (b"HTTP/1.0 404 Not Found\r\nContent-Encoding: gzip\r\n\r\n", gzip.compress("<p>z\u00fc</p>".encode()), "z\u00fc"),
        "chunked": (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", b"4\r\n<p>a\r\n6;x=y\r\nb</p>c\r\n0\r\n\r\n", "ab\nc"),
        "false": (b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: x; charset=nonesuch\r\n\r\n", b"<p>not \xff</p>", "not \ufffd"),
        "headless": (b"", b"only text", "only text"),
    }
    raw = b""
    for name, (head, body, _) in pages.items():
        block = head + body
        raw += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-Target-URI: http://x/{name}\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Payload-Digest: sha1:{name}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    raw += b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:q>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "in.warc").write_bytes(raw)
    records = W.read_warc(spark, str(tmp_path / "in.warc"))
    found = {(r.source_id, r.warc_type): r for r in W.derive(W.read_responses(records)).collect()}
    assert len(found) == 10
    for name, (head, body, text) in pages.items():
        conversion, metadata = found[f"<urn:{name}>", "conversion"], found[f"<urn:{name}>", "metadata"]
        assert conversion.block == text and conversion.refers_to == metadata.refers_to == f"<urn:{name}>" and conversion.warc_date == "2020-02-02T00:00:00Z"
        assert conversion.source_payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        if head:
            assert conversion.source_block_digest == "sha256:" + hashlib.sha256(head + body).hexdigest()
        assert f"source-warc-payload-digest: sha1:{name}\r\n" in metadata.block and f"source-payload-length: {len(body)}\r\n" in metadata.block
        for line in head.decode().split("\r\n")[1:]:
            assert not line or f"source-http-{line}\r\n" in metadata.block


def test_broken_warc_raises():
    import io

    with pytest.raises(ValueError):
        list(W.parse_records(io.BytesIO(b"HTTP/1.1 200 OK\r\n")))
