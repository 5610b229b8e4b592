"""URL filter: a blocked Bloom filter before an exact hash join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, aside

#: host, path, action
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words of 64 bits in a block; a key sets one bit in each.
BLOCK_WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A short list of rules as a table, without Python workers."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, action)")


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds host and path; both are empty for null urls and those without `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns(
        {"host": F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), "path": F.regexp_extract(u, URL, 2)}
    )


def blocked_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, words array<long>) of the string column `key`: n_blocks rows of 64 bytes at most."""
    set_bits = [F.expr(f"bit_or(shiftleft(1L, int(shiftrightunsigned(_h, {6 * w}) & 63)))") for w in range(BLOCK_WORDS)]
    hashed = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), F.xxhash64(F.lit("bit"), "key").alias("_h"))
    return hashed.groupBy("block").agg(F.array(*set_bits).alias("words"))


def url_filter(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 1 << 17, broadcast_rows: int = 50_000
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    `rules` (host, path, action): the listed canonical URLs; one fits its host, all subdomains of it, and
    the paths that start with its own. The longest host and path win, then the longer host, then block.
    Canonical prefixes of each distinct URL, of the shapes (host labels, path length) that the list has,
    probe a blocked Bloom filter (max_blocks * 64 bytes at most, so it is broadcast); what passes goes to
    an exact hash join with the list, which removes false positives. A list longer than the filter is
    made for costs more false positives and no wrong verdict.

    Null urls have empty host and path and get the default, as do all without a host, and none of them is
    joined with anything; repeated rows are kept; an empty list leaves the default; an empty table gives an
    empty result; a URL of any length is judged whole in its row. Columns named host, path, rule or verdict
    are replaced, all others come back, whatever their names.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    scratch = Scratch(pages.sparkSession, "urls")
    listed = (
        rules.where("host is not null and path is not null and action is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action")
        .groupBy(F.concat("host", "path").alias("key"), "host", "path")
        .agg(F.max("action").alias("action"))  # block comes after allow
    )
    listed = scratch.write(listed, "listed")
    n = listed.count()
    n_blocks = max(16, min(max_blocks, -(-n * 12 // (64 * BLOCK_WORDS))))
    away, back = aside(kept)
    rows = with_host_path(pages.select(*away, F.col(url).alias("url")), "url").drop("url")
    # The shapes of the list as one value: the path lengths there are for each number of host labels.
    shapes = listed.groupBy(F.size(F.split("host", r"\.")).alias("k")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    shapes = shapes.agg(F.map_from_entries(F.collect_list(F.struct("k", "lengths"))).alias("shapes")).scalar()
    distinct = rows.select("host", "path").where("host <> ''").distinct()
    distinct = distinct.withColumn("shapes", shapes).withColumn("labels", F.split("host", r"\."))
    probes = F.expr(
        "flatten(transform(filter(map_keys(shapes), k -> k <= size(labels)),"
        " k -> transform(filter(shapes[k], m -> m <= length(path)),"
        " m -> struct(array_join(slice(labels, -k, k), '.') as host, substring(path, 1, m) as path))))"
    )
    asked = distinct.select("host", "path", F.explode(probes).alias("probe")).withColumn("key", F.concat("probe.host", "probe.path"))
    bloom = blocked_bloom(listed.select("key"), n_blocks)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).withColumn("_h", F.xxhash64(F.lit("bit"), "key"))
    all_set = " and ".join(f"shiftright(words[{w}], int(shiftrightunsigned(_h, {6 * w}) & 63)) & 1 = 1" for w in range(BLOCK_WORDS))
    passed = asked.join(F.broadcast(bloom), "block").where(F.expr(all_set))
    passed = passed.select("host", "path", F.col("probe.host").alias("rule_host"), F.col("probe.path").alias("rule_path"))
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    exact = F.broadcast(exact) if n <= broadcast_rows else exact.hint("shuffle_hash")
    hits = passed.join(exact, ["rule_host", "rule_path"]).withColumn("rule", F.concat("rule_host", "rule_path"))
    order = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "action", "rule")
    # Written first: a join with an aggregate on its own key could not be split where one URL is hot.
    best = scratch.write(hits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.action"), "best")
    out = rows.where("host <> ''").join(best.hint("merge"), ["host", "path"], "left")  # URLs grow with the table: never broadcast
    none = rows.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    out = out.unionByName(none)
    return out.select(*back, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, host, path, rule, verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH rules(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, action,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
