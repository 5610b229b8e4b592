"""Operators on pages and vectors against brute force."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup, html_extract, url_filters, warc
from lectern.llm._common import Scratch, connected_components


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["vertex"]: r["component"] for r in found} == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert len(found) == 73


def links(rows, threshold):
    sound = [k for k, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {k: set() for k in range(len(rows))}
    rows = [(k, label, [x / max(map(abs, v)) for x in v]) if n in sound else None for n, (k, label, v) in enumerate(rows)]
    for a in sound:
        for b in sound:
            x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
            if a != b and rows[a][1] == rows[b][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                out[a].add(b)
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            v = rng.normal(size=16)
            rows += [(len(rows) + k, label, [float(x) for x in v + rng.normal(size=16) * s]) for k, s in enumerate((0, 0.1, 0.3, 0))]
    nan, inf = float("nan"), float("inf")
    rows += [(len(rows) + k, 0, v) for k, v in enumerate(([0.0] * 16, None, [], [nan] * 16, [inf] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [1e-200] * 16))]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<double>, kept string").repartition(3)
    near = links(rows, 0.93)
    component = {}
    for k in range(len(rows)):
        todo, seen = [k], {k}
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        component[k] = min(rows[x][0] for x in seen)
    expected = sorted((rows[k][0], len(near[k]), component[k], rows[k][0] == component[k]) for k in range(len(rows)))
    for tile in (1024, 5):
        got = embedding_dedup.embedding_components(df, tile=tile)
        assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == expected
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 64))
    q, s, e = embedding_dedup.quantise(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert q.dtype == np.int8
    wide = q.astype(np.int64)
    off = np.abs(unit @ unit.T - (wide @ wide.T) * s[:, None] * s)
    assert np.abs(q).max() <= 127 and (off <= e[:, None] + e + e[:, None] * e + 1e-12).all()


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, many of them, all the time.</div>
<div class="layout"><div class="post"><h1>Head &amp; line</h1><p>First, long paragraph\n with  commas, and<b>bold</b> text, &eacute;t&eacute;.<br>More.</p>
<ul><li>point one</li><li>point two</li></ul><p>Second paragraph, which is long enough to be scored too.</p>
<div class="comments"><p>A reader says that this is a fine article, truly, and goes on and on.</p></div></div>
<aside>Related, related, related things that nobody needs here at all.</aside></div>
<form><p>Sign up, please, for our long and tedious letter of news.</p></form><footer>&copy; all</footer></body></html>"""


def test_html():
    expected = "Head & line First, long paragraph with commas, andbold text, été. More. point one point two Second paragraph, which is long enough to be scored too."
    assert html_extract.main_text(PAGE) == expected
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>menu</nav>") == ""
    assert html_extract.main_text("just text") == "just text"
    assert html_extract.main_text("<article><p>Short.</p></article><p class=ad>x</p>") == "Short."
    for broken in ("<div" * 3000, "<p>" * 3000 + "x", "<b>" * 3000 + "<p>y", "</div>" * 3000, "<!--", "<script>", '<a title="', "<" * 3000):
        html_extract.main_text(broken)


def test_html_table(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, "clash"), (2, None, None, "clash")]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert [(r["page_id"], len(r["text"])) for r in out.collect()] == [(r["page_id"], r["n_chars"]) for r in out.collect()]


def test_warc(spark, tmp_path):
    rows = [(5, "http://b.org/x", "same"), (3, "http://a.org/y?q=1#f", "same"), (9, "bad\r\nurl", None), (7, None, ""), (11, "http://a.org/y", "é" * 5000), (12, "http://a.org/y", "\r\n\r\nWARC/1.1\r\n\r\n"), (13, "http://a.org/y", "same")]
    rows += [(100 + k, "http://hot.org/", f"page {k % 50}") for k in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, run string").repartition(3)
    out = warc.archive_pages(df, path=str(tmp_path / "archive")).collect()
    first = {}
    for key, _, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault(text or "", key)
    expected = []
    for key, _, text in rows:
        body = (text or "").encode()
        again = first[text or ""] != key
        expected.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[text or ""] if again else None))
    assert sorted(tuple(r)[:5] for r in out) == sorted(expected)
    keys = [warc.order(tuple(r)) for r in out]
    assert keys == sorted(keys)
    kept = warc.archive_pages(df, min_bytes=6).where("payload_bytes < 6 and record_type = 'revisit'")
    assert kept.count() == 0
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_loser_tree():
    runs = [[1, 4, 4], [], [2], [0, 9], [4]]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == [] and list(warc.LoserTree([[1, 2]], lambda x: x)) == [1, 2]


@pytest.mark.parametrize("n", [0, 1, 1000, (1 << 24) - 1, 1 << 24, (1 << 25) + 5])
def test_members_end_in_zero(n):
    record = (random.Random(n).randbytes(1000) * (n // 1000 + 1))[:n] or b"x"
    packed = warc.members(record)
    assert packed[-1] == 0 and gzip.decompress(packed) == record


def test_records_are_read_alone():
    bodies = [b"", b"a" * 10, b"\r\n\r\nWARC/1.1\r\n\r\n", b"q" * ((1 << 24) + 100), b"z"]
    data = b"".join(warc.members(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n") for b in bodies)
    got = list(warc.records(data))
    assert [x[2] for x in got] == bodies and all(next(warc.records(data[at:]))[2] == body for at, _, body in got)
    for broken in (data[:-1], data[:30], b"x" * 50, warc.members(b"no record")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(broken))


@pytest.mark.parametrize("fan_in", [512, 3, 2])
def test_runs_merged_from_disk(fan_in):
    rng = random.Random(3)
    runs = [[(rng.choice([None, *range(100)]), 1, "d", "response", None, rng.choice("abc"), "t", f"run{k}", i) for i in range(rng.randrange(30))] for k in range(40)]
    stream = [r for run in runs for r in sorted(run, key=warc.order)]
    assert [r for b in warc.merged(warc.batched(iter(stream), 37), fan_in) for r in map(tuple, map(dict.values, b.to_pylist()))] == sorted(stream, key=warc.order)
    assert list(warc.merged(iter([]), fan_in)) == []


def test_warc_of_long_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 100)
    monkeypatch.setattr(warc, "LARGE_FILE", 2500)
    rows = [(k, f"http://h{k % 3}.org/{k}", "x" * (k * 37 % 1100)) for k in range(40)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path=str(tmp_path / "a")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in out) == [(k, len(t)) for k, _, t in rows]
    files = [x for x in (tmp_path / "a").rglob("part-*")]
    assert len(files) > 10
    one = next(r for r in out if r["payload_bytes"] > 900)
    body = next(x for x in files if x.name == one["run"]).read_bytes()[one["offset"] :]
    assert next(warc.records(body))[1]["WARC-Record-ID"] == f"<urn:page:{one['page_id']}>"


def verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, action


def test_urls(spark):
    urls = [None, "", "x", "http://EXAMPLE.com/en/a?b#c", "https://www.example.com/en/", "http://a.net/es/x", "http://net/fr/", "http://notnet/fr/", "http://example.com", "http://m.example.com/en", "ftp://a.b.com/x://y", "http://É.COM/en/", "http://www.example.com/en/../x", "a://?q", "http://a..net/es/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls + urls[3:5])], "page_id long, url string, rule string")
    rules = url_filters.rule_table(spark)
    got = sorted(tuple(r) for r in url_filters.url_filter(df, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [(k, *verdict(u, url_filters.RULES)) for k, u in enumerate(urls + urls[3:5])]
    none = url_filters.url_filter(df, rules.limit(0))
    assert none.where(F.col("verdict") != "allow").count() == 0
    assert url_filters.url_filter(df.limit(0), rules).count() == 0


def test_bloom_passes_all_listed(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    blocks = url_filters.blocked_bloom(keys, 64).collect()
    assert len(blocks) == 64 and all(len(r["words"]) == url_filters.BLOCK_WORDS for r in blocks)
    rules = spark.range(2000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("action"))
    pages = spark.range(4000).select("id", F.concat(F.lit("http://h"), F.col("id"), F.lit(".org/x")).alias("url"))
    out = url_filters.url_filter(pages, rules, max_blocks=16, broadcast_rows=10)  # a filter far too small costs no verdict
    assert out.where("verdict = 'block'").agg(F.min("id"), F.max("id"), F.count("*")).first()[:] == (0, 1999, 2000)
