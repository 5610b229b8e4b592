"""Near-duplicate embeddings by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, connected_components

THRESHOLD = 0.93
#: Distinct vectors of one label in a tile; a task holds two tiles and a product of one with a strip.
TILE = 1024


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither vanish nor overflow; cosines stay the same bit for bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def quantise(vectors: np.ndarray):
    """Unit rows as s * q with q in int8 (-127..127); e bounds the length of what is lost. (q, s, e)"""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-12
    return q, scale, lost


def tile_pairs(a: tuple, b: tuple | None, threshold: float):
    """Strips of index pairs (i, j) by the codes (q, s, e) alone: yields (sure i, sure j, open i, open j).

    With unit u = s q + r, |r| <= e, a cosine differs from s s' (q . q') by e + e' + e e' at most. Pairs
    that are above the threshold by more than that are sure, those within it are open, the rest are apart.
    `b` is another tile, or None for the pairs i < j of `a`. Integer products are exact in single precision
    up to 1,040 dimensions, in double beyond.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b or a
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = qb.astype(kind).T
    for k in range(0, len(qa), 512):
        part = slice(k, k + 512)
        near = (qa[part].astype(kind) @ right) * sa[part, None] * sb - threshold
        off = ea[part, None] + eb + ea[part, None] * eb + 1e-9
        i, j = np.nonzero(near >= -off)
        sure = near[i, j] > off[i, j]
        i += k
        if b is None:
            once = i < j
            i, j, sure = i[once], j[once], sure[once]
        yield i[sure], j[sure], i[~sure], j[~sure]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of rows i of `a` and j of `b`, in double precision, reaches the threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = np.empty(len(i), bool)
    for m in range(0, len(i), 1 << 16):
        x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
        out[m : m + (1 << 16)] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
    return out


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def embedding_components(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`.

    Vectors of equal label (not null) and length link at cosine >= threshold. Equal vectors are collapsed
    to one with a count first, so copies cost one row. The distinct vectors of a label are dealt by hash
    to tiles of about `tile` rows; each pair of tiles is a group of its own, so a hot label is many tasks.
    Tiles travel as int8 codes with a scale and an error bound. Their products decide most pairs; vectors
    with a pair inside the bounds are fetched once for each pair of tiles, in full, and only such pairs are
    computed again. A task gives back, for each vector, the number of vectors it links with, and one link to
    the least vector of its component there: linear in its rows, however many pairs link.

    Rows whose label or vector is null, whose vector is empty, zero, or holds null or non-finite values
    link with nothing; repeated rows and ids keep their rows; a null vec_id never names a component; an empty
    table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = "label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    rows = scratch.write(rows, "rows")
    reps = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")

    def encode(batches):
        for b in batches:
            flat = b.column(3)
            codes = [pa.array([], pa.binary()), pa.array([], pa.float64()), pa.array([], pa.float64())]
            if b.num_rows:
                sizes = np.diff(flat.offsets.to_numpy())
                values, at = flat.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]
                q, s, e = [b""] * b.num_rows, np.empty(b.num_rows), np.empty(b.num_rows)
                for size in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == size)
                    qs, s[rows], e[rows] = quantise(scaled(values[at[rows][:, None] + np.arange(size)]))
                    for k, x in zip(rows.tolist(), qs, strict=True):
                        q[k] = x.tobytes()
                codes = [pa.array(q, pa.binary()), pa.array(s), pa.array(e)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *codes], names=["rep", "grp_label", "copies", "q", "s", "e"])

    of_label = F.xxhash64(F.col("label").cast("string")).alias("grp_label")
    codes = reps.select("rep", of_label, "copies", "v").mapInArrow(encode, "rep long, grp_label long, copies long, q binary, s double, e double")
    codes = scratch.write(codes.withColumn("dim", F.octet_length("q")), "codes")
    # Labels whose hashes agree would share tiles: the label itself is compared where there are such.
    if reps.select("label").distinct().count() != codes.select("grp_label").distinct().count():
        raise ValueError("two labels have one 64-bit hash")
    sizes = codes.groupBy("grp_label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = codes.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["grp_label", "dim"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select(
        F.xxhash64("grp_label", "dim", F.least("tile", "other"), F.greatest("tile", "other")).alias("grp"),
        F.signum(F.col("tile") - F.col("other")).cast("int").alias("side"),  # -1 and 1: two tiles; 0: one with itself
        "rep",
        "copies",
        "q",
        "s",
        "e",
    )

    def tiles_of(side):
        """Rows of the tile or of the two tiles that a group holds; None where there is nothing to compare."""
        if side.all():
            left, over = np.flatnonzero(side < 0), np.flatnonzero(side > 0)
            return (left, over) if len(left) and len(over) else None
        return np.arange(len(side)), None

    def links_of(rep, copies, i, j):
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        at = np.flatnonzero(links)
        low = least_labels(len(rep), i, j) if len(i) else np.arange(len(rep))
        return rep[at], rep[low[at]], links[at].astype(np.int64)

    def coded(table, rows):
        q = np.frombuffer(b"".join(table.column("q").take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1)
        return q, table.column("s").to_numpy()[rows], table.column("e").to_numpy()[rows]

    def compare(table: pa.Table) -> pa.Table:
        """Sure links as (a, b, n); vectors with open pairs as (a, null, null) beside them."""
        rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        i, j, is_open = [], [], np.zeros(len(rep), bool)
        if (tiles := tiles_of(side)) is not None:
            left, over = tiles
            for si, sj, oi, oj in tile_pairs(coded(table, left), None if over is None else coded(table, over), threshold):
                right = left if over is None else over
                i.append(left[si])
                j.append(right[sj])
                is_open[left[oi]] = is_open[right[oj]] = True
        none = np.empty(0, np.int64)
        a, b, n = links_of(rep, copies, np.concatenate([none, *i]), np.concatenate([none, *j]))
        asked = rep[is_open]
        blank = pa.nulls(len(asked), pa.int64())
        return pa.table({
            "grp": pa.array(np.full(len(a) + len(asked), table.column("grp")[0].as_py())),
            "a": pa.array(np.r_[a, asked]),
            "b": pa.concat_arrays([pa.array(b, pa.int64()), blank]),
            "n": pa.concat_arrays([pa.array(n, pa.int64()), blank]),
            "side": pa.array(np.r_[np.zeros(len(a), np.int64), side[is_open]].astype(np.int32)),
        })

    def decide(table: pa.Table) -> pa.Table:
        """Links of the open pairs of a group, from the full vectors."""
        rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        v, i, j = scaled(v), [], []
        if (tiles := tiles_of(side)) is not None:
            left, over = tiles
            right = left if over is None else over
            for *_, oi, oj in tile_pairs(quantise(v[left]), None if over is None else quantise(v[over]), threshold):
                linked = exact(v[left], v[right], oi, oj, threshold)
                i.append(left[oi[linked]])
                j.append(right[oj[linked]])
        none = np.empty(0, np.int64)
        a, b, n = links_of(rep, copies, np.concatenate([none, *i]), np.concatenate([none, *j]))
        return pa.table({"a": a, "b": b, "n": n})

    told = scratch.write(dealt.groupBy("grp").applyInArrow(compare, "grp long, a long, b long, n long, side int"), "told")
    asked = told.where("b is null").select("grp", F.col("a").alias("rep"), "side").join(reps.select("rep", "copies", "v"), "rep")
    more = scratch.write(asked.groupBy("grp").applyInArrow(decide, "a long, b long, n long"), "more")
    found = told.where("b is not null").select("a", "b", "n").unionByName(more)
    comps = connected_components(found.select("a", "b"), scratch)
    degree = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    joined = reps.join(comps.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # Written first: a join with an aggregate on its own key could not be split where one component is large.
    names = scratch.write(joined.groupBy("component").agg(F.min("least_id").alias("component_id")), "names")
    known = joined.join(names, "component").join(degree, "rep", "left")
    known = known.select("label", "v", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    known = scratch.write(known, "known")
    linked = rows.where("sound").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of embeddings: vec_id, n_links, component_id, kept."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.k, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""
