"""Bottom-k sketches of shingle hashes as document fingerprints, in DataFrame functions alone.

A sketch is the sorted array of the K least distinct hashes of a text's word shingles, each the first 15 hex
digits of its MD5 as a long. Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SPACES, Scratch, aside

K, SHINGLE = 128, 5
#: A-Z in lower case, and every white-space character as a space.
FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + SPACES, "abcdefghijklmnopqrstuvwxyz" + " " * len(SPACES)
#: Text that one task puts in order.
BUCKET_BYTES = 1 << 20
#: Cut points of each of the two levels at most, which bounds what is broadcast.
FAN = 512
#: Hex digits of a hash: as many as a long holds whatever they are.
DIGITS = 15


NONE = "array<bigint>"


def _least(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes of an array, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _sketched(df: DataFrame, text: Column, name: str, k: int = K, words: int = SHINGLE) -> DataFrame:
    """Adds the sketch of `text` under `name`; columns that begin with an underscore are used meanwhile.

    Of a long text only the hashes below twice the expected k-th are put in order; where fewer than k
    distinct ones are there, all are.
    """
    kept = df.columns
    flat = F.translate(F.coalesce(text, F.lit("")), FROM, TO)
    df = df.withColumn("_w", F.array_remove(F.split(flat, " "), "")).withColumn("_n", F.size("_w") - (words - 1))
    window = ", ".join(f"get(_w, i + {j})" for j in range(words))
    many = F.expr(f"transform(sequence(0, _n - 1), i -> left(md5(concat_ws(' ', {window})), {DIGITS}))")
    one = F.array(F.substring(F.md5(F.concat_ws(" ", "_w")), 1, DIGITS))
    df = df.withColumn("_h", F.when(F.col("_n") > 0, many).when(F.size("_w") > 0, one).otherwise(F.array().cast("array<string>")))
    line = F.lpad(F.hex(F.expr(f"bigint(131072L * {k} div _n)")), 4, "0")
    df = df.withColumn("_line", F.when(F.col("_n") > 4 * k, line))
    df = df.withColumn("_low", F.when(F.col("_line").isNotNull(), _least(F.filter("_h", lambda x: x < F.col("_line")), k)))
    df = df.withColumn("_k", F.when(F.size("_low") >= k, F.col("_low")).otherwise(_least(F.col("_h"), k)))
    return df.select(*kept, F.transform("_k", lambda x: F.conv(x, 16, 10).cast("long")).alias(name))


def hex_of(sketch: Column) -> Column:
    """The fingerprint as a string: the hashes' hex digits one after the other."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), "")


def add_sketch(df: DataFrame, text: str = "text", name: str = "sketch", k: int = K, words: int = SHINGLE) -> DataFrame:
    """The columns of `df` and the sketch of its column `text` (array of longs) under `name`.

    Words are parted by white space, A-Z lower-cased, shingles `words` words long; a shorter text is one
    shingle, and a null or blank one has an empty sketch. Equal texts have equal sketches. A text of any
    length is taken whole in its row. A column that has the name of the result is replaced, all others
    come back whatever their names.
    """
    away, back = aside([c for c in df.columns if c != name])
    held = df.select(*away, F.col("`" + text.replace("`", "``") + "`").cast("string").alias("text"))
    return _sketched(held, F.col("text"), "sketch", k, words).select(*back, F.col("sketch").alias(name))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, (k - 1) / the k-th hash as a share from there."""
    share = F.element_at(sketch, F.lit(-1)).cast("double") / float(16**DIGITS)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; 1 where both are empty."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double")
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too; 1 where a is empty."""
    share = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_sketches(parts: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one sketch for each key, of all its parts together.

    Equal hashes of a key collapse before they are shuffled; of the rest each task keeps k for a key before
    they meet, so a key with a third of all parts sends k hashes a task. Null keys are one key, null
    sketches empty; a key without hashes has an empty sketch; an empty table gives none.
    """
    held = parts.select(F.col(key).alias("key"), F.coalesce(F.col(sketch), F.array().cast(NONE)).alias("sketch"))
    each = held.select("key", F.explode_outer("sketch").alias("h")).where("h is not null").distinct()  # outer: else Spark would work the sketches out twice, for a filter
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("h"))).where(F.col("n") <= k)
    found = ranked.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("found"))
    keys = held.select("key").distinct()
    out = keys.join(found.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("key").alias(key), F.coalesce("found", F.array().cast(NONE)).alias(sketch))


# Neighbours in an order ---------------------------------------------------------------------------


def _cut_points(keys: DataFrame, scratch: Scratch, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two small tables of cut points between buckets of some `bucket_bytes`, from a sample of the keys.

    One row with the first cut point of each group; and (group, lower), the others inside each group.
    The sample decides how even buckets are and nothing else; there are FAN * FAN cut points at most.
    """
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    buckets = min(FAN * FAN, (size or 0) // bucket_bytes + 1)
    share = min(1.0, 4.0 * buckets / max(n, 1)) if buckets > 1 else 0.0
    step = max(1, round(n * share / buckets))
    place = F.row_number().over(Window.orderBy("key"))
    cuts = keys.sample(share, seed=7).select("key", place.alias("place")).where(F.col("place") % step == 0)
    cuts = cuts.withColumn("cut", (F.col("place") / step).cast("int")).where(F.col("cut") < FAN * FAN)
    cuts = scratch.write(cuts.select("key", F.expr(f"cut div {FAN}").cast("int").alias("group"), (F.col("cut") % FAN).alias("cut")), "cuts")
    upper = cuts.where("cut = 0").agg(F.sort_array(F.collect_list("key")).alias("upper"))
    lower = cuts.where("cut > 0").groupBy("group").agg(F.sort_array(F.collect_list("key")).alias("lower"))
    return upper, lower


def with_next(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, **how) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch) of every row; the next is that with the next smaller id.

    The text is written once with a number for each row, then dealt to buckets of neighbouring ids, in
    one shuffle. A bucket also gets the row that follows its last one, found among the buckets' own first
    rows, so every row meets its next inside one bucket. Rows that share an id follow each other by a hash
    of their texts, and rows alike in both by number, which no result shows; buckets are cut among them
    too, so an id that many rows share is spread. Null ids come last. After the last row comes the first;
    a single row follows itself.
    """
    held = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.struct("id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    held = scratch.write(held.select("text", key.alias("key"), F.octet_length("text").cast("long").alias("size")), "texts")
    upper, lower = _cut_points(held.select("key", "size"), scratch, bucket_bytes)
    at = lambda cuts: F.size(F.filter(cuts, lambda x: x <= F.col("key")))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("upper", upper.scalar()).withColumn("group", at(F.col("upper"))).drop("upper").join(F.broadcast(lower), "group", "left")
        within = F.when(F.col("lower").isNull(), 0).otherwise(at(F.col("lower")))
        return df.withColumn("bucket", F.col("group") * FAN + within).drop("group", "lower")

    tops = dealt(held.select("key")).groupBy("bucket").agg(F.max("key").alias("top"))
    by_bucket, all_of_them = Window.orderBy("bucket"), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = tops.select("bucket", F.coalesce(F.lag("top").over(by_bucket), F.last("top").over(all_of_them)).alias("top"))
    follow = scratch.write(follow.select("bucket", F.col("top.row").alias("row")), "follow")  # a row for each bucket
    guests = held.withColumn("row", F.col("key.row")).join(F.broadcast(follow), "row").select("bucket", "key", "text", F.lit(True).alias("guest"))
    rows = dealt(held.drop("size")).select("bucket", "key", "text", F.lit(False).alias("guest")).unionByName(guests)
    tasks = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), follow.count() // 4)
    rows = _sketched(rows.repartition(tasks, "bucket"), F.col("text"), "sketch", **how)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("key.id").desc_nulls_last(), F.col("key.hash").desc(), F.col("key.row").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where("not guest").select(F.col("key.id").alias("id"), "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = SHINGLE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of every row of `docs` and of its text with the second half taken from the next row's text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles and kept_share (the estimated share of the text's shingles in the edited text). The last
    n_chars // 2 code points give way to as many of the first of the next text, in descending order of
    ids (see with_next). Null text is empty: its fingerprint is empty, like that of a blank text, and two
    empty fingerprints are alike (1); repeated rows each keep their row; an empty table gives an empty
    result; very long texts are taken whole, one row at a time.
    """
    scratch = Scratch(docs.sparkSession, "sketches")
    rows = with_next(docs, scratch, doc_id, text, bucket_bytes, k=k, words=words)
    half = F.length("text").cast("long")
    rows = rows.withColumn("n_chars", half).withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))"))
    rows = _sketched(rows.drop("text", "next_text"), F.col("edited"), "edited_sketch", k, words)
    own, changed = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        F.col("id").alias(doc_id),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_of(own).alias("fingerprint"),
        hex_of(changed).alias("edited_fingerprint"),
        resemblance(own, changed, k).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        distinct_count(own, k).alias("n_shingles"),
        containment(own, changed, k).alias("kept_share"),
    )


def op11_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: fingerprints of its text and of its edited text, and how alike they are."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_chars FROM documents),
nx AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next_t,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d),
both_ AS (SELECT doc_id, 0 AS edited, t FROM nx UNION ALL SELECT doc_id, 1, t[1:n_chars - n_chars // 2] || CASE WHEN n_chars < 2 THEN '' ELSE next_t[1:n_chars // 2] END FROM nx),
w AS (SELECT *, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM both_),
s AS (SELECT doc_id, edited, sha256(t) AS sha, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [('0x' || left(md5(array_to_string(ws, ' ')), 15))::BIGINT]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: ('0x' || left(md5(array_to_string(ws[i:i + 4], ' ')), 15))::BIGINT) END))[1:128] AS k FROM w),
j AS (SELECT nx.doc_id, nx.n_chars, e.sha AS edited_sha256, a.k AS a, e.k AS e, b.k AS b,
  list_sort(list_distinct(list_concat(a.k, e.k)))[1:128] AS ue, list_sort(list_distinct(list_concat(a.k, b.k)))[1:128] AS ub
  FROM nx JOIN s AS a ON a.doc_id = nx.doc_id AND a.edited = 0 JOIN s AS e ON e.doc_id = nx.doc_id AND e.edited = 1 JOIN s AS b ON b.doc_id = nx.next_id AND b.edited = 0),
r AS (SELECT *, CASE WHEN len(ue) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ue, list_intersect(a, e)))::DOUBLE / len(ue) END AS near_edited,
  CASE WHEN len(ub) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ub, list_intersect(a, b)))::DOUBLE / len(ub) END AS near_next,
  CASE WHEN len(a) < 128 THEN len(a)::DOUBLE ELSE 127 / (a[128]::DOUBLE / 1152921504606846976::DOUBLE) END AS n_shingles,
  CASE WHEN len(ue) < 128 THEN len(ue)::DOUBLE ELSE 127 / (ue[128]::DOUBLE / 1152921504606846976::DOUBLE) END AS n_union FROM j)
SELECT doc_id, n_chars, edited_sha256, array_to_string(list_transform(a, lambda x: printf('%015x', x)), '') AS fingerprint, array_to_string(list_transform(e, lambda x: printf('%015x', x)), '') AS edited_fingerprint, near_edited, near_next, n_shingles,
  CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, near_edited * n_union / n_shingles) END AS kept_share FROM r
"""
