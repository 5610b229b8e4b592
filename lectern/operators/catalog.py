"""Scrape catalogue: first-wins URLs, known downloads, collisions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import record_language, url_path
from ..functions.references import record_date, record_number, record_title


def is_official(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a URL's host is one of the official ones."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False))


def is_document_url(url: Column) -> Column:
    """Whether a URL's path names a PDF anywhere, whatever the case."""
    return F.lower(url_path(url)).contains(".pdf")


def crawl(pages: DataFrame, links: DataFrame, start: str, limit: int = 20, url: str = "url") -> DataFrame:
    """(url, place) of the pages that a crawl from `start` visits: first come, first served, `limit` at most.

    `pages` are those that can be fetched, `links` (page_url, link) what they point at. A page's links join
    the queue in alphabetical order, each once; what cannot be fetched takes no place. Each round is a level
    of the queue joined with both tables, so there are at most `limit` rounds, and the driver holds at most
    `limit` rows, as the feature says.
    """
    spark = pages.sparkSession
    have = pages.select(F.col(url).alias("url")).distinct()
    level = spark.createDataFrame([(start, 0)], "url string, turn long").join(have, "url").collect()
    visited = [r["url"] for r in level]
    while level and len(visited) < limit:
        turns = spark.createDataFrame([(r["url"], r["turn"]) for r in level], "page_url string, turn long")
        known = spark.createDataFrame([(u,) for u in visited], "url string")
        found = links.join(F.broadcast(turns), "page_url").groupBy(F.col("link").alias("url")).agg(F.min("turn").alias("turn"))
        found = found.join(F.broadcast(known), "url", "left_anti").join(have, "url", "left_semi")
        level = found.orderBy("turn", "url").limit(limit - len(visited)).collect()
        level = [{"url": r["url"], "turn": len(visited) + k} for k, r in enumerate(level)]
        visited += [r["url"] for r in level]
    return spark.createDataFrame([(u, k) for k, u in enumerate(visited)], "url string, place long")


def first_by_url(records: DataFrame, url: str = "pdf_url", order: str = "ordinal") -> DataFrame:
    w = Window.partitionBy(url).orderBy(order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def actions(records: DataFrame, known_urls: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Adds action: skip_url (known URL), duplicate_hash (known or earlier content), download.

    `records`: pdf_url, content_sha256, ordinal. Known tables are joined, not looked up, so either side may be large.
    """
    rows = first_by_url(records)
    rows = rows.join(known_urls.select("pdf_url").distinct().withColumn("_url", F.lit(True)), "pdf_url", "left")
    rows = rows.join(known_hashes.select("content_sha256").distinct().withColumn("_hash", F.lit(True)), "content_sha256", "left")
    # The first of each content by an aggregate and a join, so that one error page sent for all URLs is no hot window.
    fresh = rows.where("_url is null and _hash is null").groupBy("content_sha256").agg(F.min("ordinal").alias("_first"))
    rows = rows.join(fresh, "content_sha256", "left")
    action = F.when(F.col("_url"), "skip_url").when(F.col("_hash") | (F.col("ordinal") > F.col("_first")), "duplicate_hash").otherwise("download")
    return rows.withColumn("action", action).drop("_url", "_hash", "_first")


#: Buckets in which the places of a key's rows are counted.
RANK_BUCKETS = 256


def place_of(rows: DataFrame, by: list[str], order: str, name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds the 1-based place of each row among the rows of its key (`by`), in the order of a number without repeats.

    Keys are cut into buckets at quantiles of `order` over all rows, which one aggregate finds when this is
    called; rows are counted by key and bucket and placed inside their bucket, so a key that a third of
    all rows share is spread over a third of the buckets' tasks. Null keys are keys too.
    """
    at = [k / buckets for k in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx(order, F.array(*map(F.lit, at)), F.lit(10 * buckets)).alias("c")).first()["c"] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x < F.col(order))) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order)))
    same = F.col("_bucket") == F.col("_b")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return rows.join(counts, same).withColumn(name, F.col("_within") + F.col("_before")).drop("_bucket", "_within", "_before", "_b", *[f"_k{k}" for k in range(len(by))])


def unique_names(rows: DataFrame, name: str, digest: str, order: str) -> DataFrame:
    """Adds destination: the first of a name keeps it, others get 8 digits of their hash, then a counter.

    The first of a name comes from an aggregate, the counter from places in buckets (see place_of): one name
    for a third of all rows is no hot window. `order` numbers the rows without repeats.
    """
    first = rows.groupBy(F.col(name).alias("_name")).agg(F.min(order).alias("_first"))
    rows = rows.withColumn("_mark", F.substring(digest, 1, 8)).join(first, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")
    plain = F.col(order) == F.col("_first")  # keeps the name, and so does not count among those of its mark
    rows = place_of(rows.withColumn("_again", ~plain), [name, "_mark", "_again"], order, "_m")
    stem, suffix = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    marked = F.concat(stem, F.lit("_"), "_mark")
    dest = F.when(~F.col("_again"), F.col(name)).when(F.col("_m") <= 1, F.concat(marked, suffix)).otherwise(F.concat(marked, F.lit("_"), F.col("_m").cast("string"), suffix))
    return rows.withColumn("destination", dest).drop("_mark", "_again", "_first", "_m")


def counters(rows: DataFrame) -> DataFrame:
    """One row: records by action and by language, renamed and failed downloads. `rows` may have error, name, destination."""
    ok = F.col("error").isNull() if "error" in rows.columns else F.lit(True)
    moved = F.col("destination") != F.col("name") if "destination" in rows.columns else F.lit(False)
    fetched = F.col("action") == "download"
    return rows.agg(
        F.count("*").alias("discovered"), F.count_if(fetched & ok).alias("download"), F.count_if(fetched & ~ok).alias("failed"),
        F.count_if(F.col("action").isin("skip_url", "duplicate_hash")).alias("skipped"),
        *[F.count_if(F.col("action") == a).alias(a) for a in ("skip_url", "duplicate_hash")],
        F.count_if(fetched & ok & moved).alias("collisions"),
        *[F.count_if(F.col("language") == x).alias(f"language_{x}") for x in ("ar", "fr")],
    )


def metadata_rows(records: DataFrame, root: str) -> DataFrame:
    """Catalogue rows of downloads: `records` has the nine fields with local_path as a full path, which becomes relative to `root`."""
    from ..sources.files import METADATA_FIELDS, relative_to

    rows = records.withColumn("local_path", relative_to(F.col("local_path"), root))
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in METADATA_FIELDS))


def records_from_values(rows: DataFrame) -> DataFrame:
    """Catalogue records of `rows` (values array<string>, pdf_url, page_url); cells `named` by a header come before what is inferred."""
    v, url = F.col("values"), F.col("pdf_url")
    out = rows.withColumn("document_number", record_number(v, url)).withColumn("date", record_date(v, url))
    named = lambda f: F.try_element_at("named", F.lit(f)) if "named" in rows.columns else F.lit(None).cast("string")
    title = record_title(v, F.col("document_number"), F.col("date"))
    out = out.withColumns({"title": F.coalesce(named("title"), title)})
    out = out.withColumns({f: F.coalesce(named(f), F.col(f)) for f in ("document_number", "date")})
    return out.withColumn("language", record_language(F.col("title"), url, F.col("page_url")))
