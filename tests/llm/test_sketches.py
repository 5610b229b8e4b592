"""Sketches against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import sketches

from . import fixtures as fx


def hashes(text, words=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [w[k : k + words] for k in range(len(w) - words + 1)] or [w] * bool(w)
    return {hashlib.md5(" ".join(g).encode()).hexdigest()[:15] for g in grams}


def sketch(text, k=128):
    return sorted(hashes(text))[:k]


def alike(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


@pytest.mark.parametrize(("k", "bucket_bytes"), [(128, sketches.BUCKET_BYTES), (16, 300)])
def test_edited_fingerprints(spark, k, bucket_bytes):
    """Awkward rows, shared ids and a null id among them, in one bucket and in many."""
    docs = fx.documents(spark)
    got = sketches.edited_fingerprints(docs, k=k, bucket_bytes=bucket_bytes).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_chars"]) for r in got) == sorted((i is None, i, len(t)) for i, t in rows)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    assert all(len(set(ts)) == 1 for i, ts in by_id.items())  # rows that share an id here are copies
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    expected = []
    for n, (i, t) in enumerate(order):
        follow = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        a, b, c = (sketch(x, k) for x in (t, edited, follow))
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b, k), alike(a, c, k)))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, expected))


def test_empty_and_single(spark):
    assert sketches.edited_fingerprints(fx.empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    (row,) = sketches.edited_fingerprints(docs).collect()
    assert row["near_next"] == 1.0 and row["n_shingles"] == 2.0


def test_an_id_that_all_rows_share(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a word and "), F.col("id") % 3).alias("text"))
    got = sketches.edited_fingerprints(docs, bucket_bytes=500).collect()
    texts = [f"a word and {k % 3}" for k in range(400)]
    assert len(got) == 400 and sum(r["near_next"] == 0 for r in got) == 3  # where one text's rows end
    assert sorted({r["fingerprint"] for r in got}) == sorted({sketch(t)[0] for t in texts})


def test_estimates(spark):
    rng = fx.random.Random(3)
    words = [f"{rng.choice(fx.WORDS)}{k}" for k in range(6000)]
    texts = {"a": " ".join(words[:4000]), "b": " ".join(words[1000:5000]), "c": " ".join(words[:400]), "d": ""}
    df = sketches.add_sketch(spark.createDataFrame([tuple(texts.values())], "a string, b string, c string, d string"), "a", "sa")
    for name in "bcd":
        df = sketches.add_sketch(df, name, "s" + name)
    sa, sb, sc, sd = (F.col("s" + x) for x in "abcd")
    r = df.select(
        sketches.resemblance(sa, sb).alias("ab"), sketches.containment(sc, sa).alias("ca"), sketches.containment(sa, sc).alias("ac"),
        sketches.distinct_count(sa).alias("n"), sketches.resemblance(sa, sd).alias("ad"), sketches.containment(sd, sa).alias("da"),
        (sketches.merged(sa, sb) == F.array(*(F.lit(int(x, 16)) for x in sorted(hashes(texts["a"]) | hashes(texts["b"]))[:128]))).alias("merged"),
    ).first()
    assert abs(r["ab"] - 0.6) < 0.13 and r["ca"] > 0.6 and abs(r["ac"] - 0.1) < 0.08 and abs(r["n"] - 3996) < 1200
    assert (r["ad"], r["da"], r["merged"]) == (0.0, 1.0, True)


def test_merged_parts(spark):
    rows = [(k % 3 or None, t) for k, t in enumerate(fx.texts())]
    parts = sketches.add_sketch(spark.createDataFrame([(*r, "x") for r in rows], "key long, text string, `a.b` string").repartition(5))
    assert parts.columns == ["key", "text", "a.b", "sketch"]
    got = {r["key"]: [f"{x:015x}" for x in r["sketch"]] for r in sketches.merge_sketches(parts, "key").collect()}
    for key in (None, 1, 2):
        assert got.pop(key) == sorted(set().union(*(hashes(t) for k, t in rows if k == key)))[:128]
    assert not got and sketches.merge_sketches(parts.limit(0), "key").count() == 0
