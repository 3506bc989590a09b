"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on PROJECTIONS fixed random directions. For two at
the cosine threshold the difference of a projection is normal with a known
deviation, so the chance to fall into a window of half-width HALF around the
query's projection is known too. A pair is a candidate if it collides in at
least the count that all but MISSES of the pairs at the threshold reach; its
cosine is then computed in double precision.

Pairs are formed only within a label. A label of more than CELL_ROWS vectors is
dealt in cells, several times over: each of its tables cuts as many further
projections into intervals as bring a cell down to about BLOCK vectors, and
there are so many tables that all but LOST of the pairs at the threshold share a
cell in one of them. A vector is one row in each table, 17 of a label of a
million and 58 of one of a thousand million. A pair belongs to the first table
in which it shares a cell. Equal vectors are one row with a count. A cell that
is larger is dealt in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small
from .components import components
from .textkernel import mix

COSINE = 0.98
PROJECTIONS = 24
HALF = 0.3
MISSES = 1e-4
#: Of the pairs at the threshold in a large label, the part that may share no cell.
LOST = 1e-4
#: Width of a cell's intervals; unit vectors' projections have deviation 1.
CELL = 1.0
#: Vectors of a label from which on it is cut into cells, and of a block.
CELL_ROWS = 20_000
BLOCK = 2048
SEED = 20_240_601


@lru_cache(64)
def directions(count: int, dim: int, kind: int = 0) -> np.ndarray:
    return np.random.default_rng([SEED, dim, kind]).standard_normal((count, dim))


def deviation(cosine: float) -> float:
    """Of the difference of the projections of two unit vectors."""
    return math.sqrt(2 * (1 - cosine))


def least_collisions(cosine: float = COSINE) -> int:
    """The greatest count that a pair at the threshold misses with a chance of at most MISSES."""
    p = math.erf(HALF / deviation(cosine) / math.sqrt(2))
    below = 0.0
    for k in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        if below > MISSES:
            return k
    return PROJECTIONS


def same_interval(spread: float) -> float:
    """The chance that two projections, their difference normal with that deviation, share an interval of a random grid."""
    t = CELL / spread
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


@lru_cache(1 << 16)
def tables(rows: int) -> tuple[int, int]:
    """Projections of a cell, and tables, for a label of so many vectors."""
    if rows <= CELL_ROWS:
        return 0, 1
    axes = math.ceil(math.log(rows / BLOCK) / -math.log(same_interval(math.sqrt(2))))
    return axes, math.ceil(math.log(LOST) / math.log(1 - same_interval(deviation(COSINE)) ** axes))


def cell_codes(x: np.ndarray, axes: int, count: int) -> np.ndarray:
    """The cell of each vector in each of the first count tables, as a hash."""
    if not axes or not count:
        return np.zeros((len(x), count), np.int64)
    ways = directions(axes * count, x.shape[1], 1)
    shift = np.random.default_rng(SEED).random(axes * count)
    at = np.floor((x @ ways.T) / CELL + shift).astype(np.int64).reshape(len(x), count, axes).view(np.uint64)
    out = np.zeros((len(x), count), np.uint64)
    for k in range(axes):
        out = mix(out * np.uint64(31) + at[:, :, k] + np.uint64(k + 1))
    return out.view(np.int64)


def unit(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what can't be compared."""
    out = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all():
            out.append(None)
            continue
        top = np.abs(x).max()
        out.append(None if top == 0 else (y := x / top) / math.sqrt(float(y @ y)))
    return out


CELLS = "label string, cell string, vec long, x binary, copies long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, vec, embedding, copies, rows of the label -> one row for each table, with the vector's cell (length, axes, table, code)."""
    for batch in batches:
        groups: dict[tuple[int, int], list] = {}
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for label, vec, x, n, rows in zip(columns[0], columns[1], unit(columns[2]), columns[3], columns[4], strict=True):
            if x is not None:
                groups.setdefault((len(x), *tables(rows)), []).append((label, vec, x, n))
        for (dim, axes, count), found in groups.items():
            for k in range(0, len(found), 1000):
                part = found[k : k + 1000]
                codes = cell_codes(np.stack([x for _, _, x, _ in part]), axes, count)
                out = [(label, f"{dim}:{axes}:{t}:{code}", vec, x.tobytes(), n) for (label, vec, x, n), own in zip(part, codes.tolist(), strict=True) for t, code in enumerate(own)]
                types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["label", "cell", "vec", "x", "copies"])


def collisions(query: np.ndarray, data: np.ndarray, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the indices of the data that collide with it often enough."""
    ways = directions(PROJECTIONS, dim)
    least = least_collisions()
    p, q = data @ ways.T, query @ ways.T
    order = np.argsort(p, axis=0, kind="stable")
    low, high = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
    for j in range(PROJECTIONS):
        line = p[order[:, j], j]
        low[:, j], high[:, j] = np.searchsorted(line, q[:, j] - HALF, "left"), np.searchsorted(line, q[:, j] + HALF, "right")
    order = np.ascontiguousarray(order.T)
    for i in range(len(query)):
        met = np.concatenate([order[j, low[i, j] : high[i, j]] for j in range(PROJECTIONS)])
        yield i, np.flatnonzero(np.bincount(met, minlength=len(data)) >= least)


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Rows (vec, x, copies, side) of a cell, or of two of its blocks, -> for each vector its links, and the least one.

    side 0: all with all; else block 1's with block 2's.
    """
    dim, axes, number, _ = map(int, key[1].as_py().split(":"))
    vec, copies, side = (table[c].to_numpy() for c in ("vec", "copies", "side"))
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(len(vec), dim)
    earlier = cell_codes(x, axes, number)
    query, data = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    out_a, out_b, out_n = [], [], []
    if len(query) and len(data):
        for i, met in collisions(x[query], x[data], dim):
            a = query[i]
            b = data[met]
            b = b[vec[b] > vec[a]] if side[a] == 0 else b
            b = b[x[b] @ x[a] >= COSINE] if len(b) else b
            b = b[~(earlier[b] == earlier[a]).any(1)] if number and len(b) else b
            if len(b):
                out_a.append(np.full(len(b), vec[a]))
                out_b.append(vec[b])
                out_n.append(np.stack([np.full(len(b), copies[a]), copies[b]]))
    if not out_a:
        return pa.table({c: pa.array([], pa.int64()) for c in ("vec", "links", "least")})
    a, b, n = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_n, axis=1)
    # a vector's links in this group, counted with their copies, and the least vector of them
    node = np.concatenate([a, b])
    count = np.concatenate([n[1], n[0]])
    names, at = np.unique(node, return_inverse=True)
    links = np.bincount(at, weights=count, minlength=len(names)).astype(np.int64)
    # all linked within the group are one: the least by repeated minima
    least = names.copy()
    ia, ib = np.searchsorted(names, a), np.searchsorted(names, b)
    while True:
        new = least.copy()
        np.minimum.at(new, ia, least[ib])
        np.minimum.at(new, ib, least[ia])
        new = np.minimum(new, new[np.searchsorted(names, new)])
        if (new == least).all():
            break
        least = new
    return pa.table({"vec": names, "links": links, "least": least})


def near_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and their vectors'
    cosine is at least 0.98. Vectors that are null, empty, zero or hold a null
    or a non-finite component link with nothing, nor do vectors of different
    lengths; a null vec_id takes no part and has a null component. Equal
    vectors, repeated ids too, are linked as any others. Labels of any kind are
    equal if their texts are; vec_id is a whole number, given back as long. An
    empty table gives an empty one. Other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = checkpoint(rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.struct(F.xxhash64("embedding"), F.hash("embedding")))))
    known = rows.where(F.col("key").isNotNull() & F.col("embedding").isNotNull())
    classes = known.groupBy("label", "key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = checkpoint(classes.withColumn("vec", F.monotonically_increasing_id()))  # from here on a class of equal vectors is known by its number
    large = checkpoint(classes.groupBy("label").count().where(F.col("count") > CELL_ROWS).select(F.col("label").alias("l"), "count"))
    cells = classes.join(small(large), F.col("label") == F.col("l"), "left").select("label", "vec", "embedding", "copies", F.coalesce("count", F.lit(0)).alias("rows"))
    cells = checkpoint(cells.mapInArrow(_cells, CELLS))
    large = cells.groupBy(F.col("label").alias("l"), F.col("cell").alias("c")).agg(F.count("*").alias("size"))
    large = checkpoint(large.where(F.col("size") > BLOCK))
    columns = ["label", "cell", "i", "j", "vec", "x", "copies", "side"]
    dealt = cells.join(small(large), (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")), "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    sided = dealt.select("label", "cell", i.alias("i"), j.alias("j"), "vec", "x", "copies", F.when(i == j, 0).when(F.col("own") == i, 1).otherwise(2).alias("side")).select(*columns)
    found = checkpoint(sided.groupBy("label", "cell", "i", "j").applyInArrow(_pairs, "vec long, links long, least long"))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec").alias("a"), F.col("least").alias("b")))
    classes = classes.where("embedding IS NOT NULL").select("label", "key", "vec", "least_id", "copies", comparable(F.col("embedding")).alias("good"))
    classes = classes.join(links, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    classes = checkpoint(classes)
    least = checkpoint(classes.where("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("component_id")))
    classes = classes.join(small(least), "component", "left").withColumn("component_id", F.coalesce("component_id", "least_id"))
    classes = checkpoint(classes.select(F.col("label").alias("l"), F.col("key").alias("k"), "good", "copies", "links", "component_id"))  # a table of its own: Spark can split the rows of a vector with very many copies
    out = rows.join(classes, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    n_links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def comparable(embedding: Column) -> Column:
    """Whether a vector can link: no null or non-finite component, and not all zero."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, finite) & F.exists(embedding, lambda c: c != 0), F.lit(False))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x), least_reached AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least_reached r ON r.x = vec_id
"""
