"""K-means with a VA-file: few-bit cells decide most assignments, vectors the rest.

Every vector is kept twice: whole, and as one cell of CELL_BITS bits per component.
The cells of a component are cut at quantiles. For each round, tables with the least
and the greatest part a cell can have in the distance to a centroid give, summed over
the components, an interval for each distance (less the vector's own square). A vector whose lowest interval overlaps
no other is assigned by its cells alone; only vectors with overlapping intervals, or
that change their cluster, are fetched whole by a join on their row number. Sums
move by what these vectors leave and enter, in whole numbers, so that centroids are
exact. Cell cuts are taken from a sample of SAMPLE vectors; they decide how many
vectors must be fetched, never the result.

Edge cases: vectors of another length, or NULL, or with a NULL or non-finite
component take no part, nor do vectors with a scaled component of 2**27 or more,
whose squared distances would not fit a long; repeated rows are vectors of their
own; rows without a vec_id are clustered but start no centroid unless others run
out; with fewer vectors than centroids there are as many centroids as vectors; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import stored

CELL_BITS = 7
#: Vectors the cell cuts are taken from, and most that reach the driver.
SAMPLE = 4096
#: Scaled components must lie below this, so that squared distances fit a long.
LARGEST = 2**27


def scaled(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """Rows (row, vec_id, v array<long>) of the vectors that take part."""
    x = F.col("x")
    good = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGEST / scale)))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        .where(x.isNotNull() & good)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    )


def cell_edges(vectors: DataFrame, components: int, bits: int):
    """Array (components, cells + 1): cell j of a component holds edge j up to before edge j + 1."""
    import numpy as np

    def extent(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                places = pa.array(np.arange(v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([places, pa.array(v.min(axis=0)), pa.array(v.max(axis=0))], names=["i", "lo", "hi"])

    ends = vectors.select("v").mapInArrow(extent, "i int, lo long, hi long").groupBy("i").agg(F.min("lo"), F.max("hi"))
    ends = {i: (lo, hi) for i, lo, hi in ends.collect()}  # a row per component
    share = F.lit(max(1, vectors.count() // SAMPLE))
    some = np.array([r.v for r in vectors.where(F.pmod(F.xxhash64("row"), share) == 0).select("v").limit(SAMPLE).collect()] or [[lo for _, (lo, _) in sorted(ends.items())]])
    shares = np.arange(1, 2**bits) / 2**bits
    inner = np.ceil(np.quantile(some, shares, axis=0)).astype(np.int64).T
    low, high = (np.array([[ends[i][j]] for i in range(components)]) for j in (0, 1))
    return np.hstack([low, np.clip(inner, low, high + 1), high + 1])


def approximated(vectors: DataFrame, edges, bits: int) -> DataFrame:
    """Rows (row, cells): the cell numbers of all components, bit-packed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            cells = np.empty(v.shape, np.uint8)
            for i in range(v.shape[1]):
                cells[:, i] = np.searchsorted(edges[i, 1:-1], v[:, i], side="right")
            flags = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(v), -1)
            packed = [x.tobytes() for x in np.packbits(flags, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "cells"])

    return vectors.select("row", "v").mapInArrow(run, "row long, cells binary")


def distance_tables(centroids, edges):
    """Least and greatest part of a component in each centroid's distance: (components, cells, centroids).

    The square of the vector's own component is the same for all centroids and left
    out: c * c - 2 * c * x, which makes the intervals much narrower.
    """
    import numpy as np

    first, last = edges[:, :-1, None].astype(np.float64), (edges[:, 1:, None] - 1).astype(np.float64)
    c = centroids.T[:, None, :].astype(np.float64)
    ends = c * c - 2 * c * first, c * c - 2 * c * last
    return np.minimum(*ends), np.maximum(*ends)


def judged(state: DataFrame, centroids, edges, bits: int) -> DataFrame:
    """State rows (row, cells, cluster) with ``now``: the new cluster, NULL if intervals overlap."""
    tables = distance_tables

    def run(batches):
        import numpy as np
        import pyarrow as pa

        least, most = tables(centroids, edges)
        # sums of large products are rounded: some slack keeps the intervals safe
        slack = 1e-12 * float(np.abs(most).max(axis=(1, 2)).sum() + np.abs(least).max(axis=(1, 2)).sum())
        weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            flags = np.unpackbits(packed, axis=1, count=len(edges) * bits).reshape(n, len(edges), bits)
            cells = (flags * weights).sum(axis=2, dtype=np.uint8)
            low, high = np.zeros((n, len(centroids))), np.zeros((n, len(centroids)))
            for i in range(len(edges)):
                low += least[i][cells[:, i]]
                high += most[i][cells[:, i]]
            near = low <= high.min(axis=1, keepdims=True) + slack
            now = pa.array(near.argmax(axis=1).astype(np.int32), mask=near.sum(axis=1) > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, now], names=["row", "cells", "cluster", "now"])

    return state.mapInArrow(run, "row long, cells binary, cluster int, now int")


def _nearest(v, centroids):
    """Nearest centroid (the smaller of equal ones) and squared distance, exactly."""
    import numpy as np

    best, cluster = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int32)
    for k, c in enumerate(centroids):
        d = ((v - c) ** 2).sum(axis=1)
        closer = d < best
        best[closer], cluster[closer] = d[closer], k
    return cluster, best


def resolved(touched: DataFrame, centroids) -> DataFrame:
    """Fetched rows (row, cells, cluster, now, v) with their new cluster, and the moves of sums.

    Rows with ``row`` are the new state. Rows with ``k``, one per task and centroid, say
    by how much the sums of centroid k and, behind them, its count change.
    """
    nearest = _nearest

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, void = ["row", "cells", "cluster", "k", "moves"], lambda kind, size: pa.nulls(size, kind)
        kind = pa.list_(pa.int64())
        moves = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(4).flatten().to_numpy().reshape(n, -1)
            now, known = batch.column(3).fill_null(-1).to_numpy().copy(), ~np.array(batch.column(3).is_null())
            now[~known] = nearest(v[~known], centroids)[0]
            was = batch.column(2).to_numpy()
            entered = np.hstack([v, np.ones((n, 1), np.int64)])
            changed = was != now
            np.add.at(moves, now[changed], entered[changed])
            left = changed & (was >= 0)
            np.subtract.at(moves, was[left], entered[left])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(now.astype(np.int32)), void(pa.int32(), n), void(kind, n)], names=names
            )
        k = np.flatnonzero(moves.any(axis=1))
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [void(pa.int64(), len(k)), void(pa.binary(), len(k)), void(pa.int32(), len(k)), pa.array(k.astype(np.int32)), pa.array(list(moves[k]), kind)],
                names=names,
            )

    return touched.select("row", "cells", "cluster", "now", "v").mapInArrow(run, "row long, cells binary, cluster int, k int, moves array<long>")


def measured(assigned: DataFrame, centroids) -> DataFrame:
    """(vec_id, cluster, distance) of rows (vec_id, now, v); NULL ``now`` is resolved."""
    nearest = _nearest

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(2).flatten().to_numpy().reshape(n, -1)
            cluster = batch.column(1).fill_null(-1).to_numpy().copy()
            todo = cluster < 0
            distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
            cluster[todo], distance[todo] = nearest(v[todo], centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return assigned.select("vec_id", "now", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2", bits: int = CELL_BITS,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Only centroids, their sums and the sample of the cell cuts pass the driver.
    """
    import numpy as np

    spark = vectors.sparkSession
    whole = stored(scaled(vectors, components, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    firsts = whole.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not firsts:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in firsts], np.int64)
    edges = cell_edges(whole, components, bits)
    state = stored(approximated(whole, edges, bits).withColumn("cluster", F.lit(-1)), "cells")
    sums = [[0] * components for _ in firsts]
    counts = [0] * len(firsts)
    for _ in range(rounds):
        told = stored(judged(state, centroids, edges, bits), "judged")
        same = F.col("now").eqNullSafe(F.col("cluster"))
        fetched = stored(resolved(told.where(~same).join(whole.select("row", "v"), "row"), centroids), "fetched")
        moved = fetched.where("k is not null").groupBy("k").agg(*[F.sum(F.get("moves", F.lit(i))) for i in range(components + 1)])
        for j, *more, n in moved.collect():  # a row per centroid
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], more)]
        centroids = np.array([[s // n for s in row] if n else list(c) for row, n, c in zip(sums, counts, centroids.tolist())], np.int64)
        state = told.where(same).select("row", "cells", "cluster").unionByName(fetched.where("row is not null").select("row", "cells", "cluster"))
    last = judged(state, centroids, edges, bits).select("row", "now")
    out = stored(measured(last.join(whole, "row"), centroids), "distances")
    inertia = dict(out.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per centroid
    total = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame(
        [(j, inertia.get(j, 0), total, name) for j, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
