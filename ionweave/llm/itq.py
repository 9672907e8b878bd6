"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On a sample of at most ``SAMPLE`` vectors (the least hashes of their ids) rotations of the centred principal axes are
learned that bring the sign codes close to the data, so their bits are balanced. Codes of several such rotations are
cut into substrings; vectors of one label that share a substring meet in that table's bucket and are ranked again by
the cosine of the original vectors in double precision. Substrings have about as many bits as the count of vectors
asks for, and there are as many tables as bring a pair at the threshold together with probability ``RECALL``, or more
where the vectors share a direction and agree less once it is taken off; buckets stay small at any size. Buckets over ``BLOCK`` vectors are compared block against block. A pair that shares
several buckets counts in the first, so links are summed and never listed.

Equal vectors of a label go on as one with their number. Defined results: vectors that are null, empty, zero or hold
null or non-finite components, and those without label, link with nothing; vectors of different length do not link;
rows without vec_id are left out of the search and come back alone; repeated rows of a vec_id are one vector each time.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, map_runs, stored

COSINE, RECALL, LEAST_RECALL = 0.98, 0.9995, 0.99
TRIED = 4  # rotations that agreement is measured on
SAMPLE, STEPS, BLOCK = 8192, 30, 1024


def fit(sample: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrices): each matrix turns centred vectors so that their signs are a balanced code."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    out = []
    for k in range(rotations):
        turn, _ = np.linalg.qr(np.random.default_rng(k).standard_normal((v.shape[1],) * 2))
        for _ in range(STEPS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append(axes @ turn)
    return mean, np.stack(out)


def agreements(unit: np.ndarray, mean: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """For each sample vector, on what share of the bits it agrees with a random vector at the threshold from it."""
    aside = np.random.default_rng(1).standard_normal(unit.shape)
    aside -= (aside * unit).sum(axis=1)[:, None] * unit
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1)), 1e-12)[:, None]
    near = COSINE * unit + math.sqrt(1 - COSINE * COSINE) * aside
    same = [((unit - mean) @ m >= 0) == ((near - mean) @ m >= 0) for m in matrices]
    return np.concatenate(same, axis=1).mean(axis=1)


def plan(n: int, width: int, agree: np.ndarray | None = None) -> tuple[int, int]:
    """(bits of a substring, tables) for so many vectors.

    Two uncentred vectors at the threshold agree on a bit with probability p. Vectors that share a direction stand wider
    apart once centred: what they agree on is measured on the sample, and tables are added until the mean recall over
    its pairs is ``LEAST_RECALL``.
    """
    bits = max(4, min(width, 24, int(math.log2(max(n, 2)))))
    p = 1 - math.acos(COSINE) / math.pi
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - p ** bits))
    if agree is not None:
        missed = 1 - agree ** bits
        while (missed ** tables).mean() > 1 - LEAST_RECALL:
            tables += -(-tables // 8)
    return bits, tables


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Double vectors, cut or filled with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.all(sizes == width):
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    for i, (a, n) in enumerate(zip(np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist(), sizes.tolist())):
        out[i, :min(n, width)] = flat[a:a + min(n, width)]
    return out


def _links(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """Link counts and a spanning forest of the links of each run that no earlier table has found."""
    ids, times, own, low, high, number = (table.column(c).to_numpy() for c in ("vec_id", "times", "_own", "_i", "_j", "table"))
    lists = table.column("embedding").combine_chunks()
    width = int(np.diff(lists.offsets.to_numpy()).max())
    x = _vectors(lists, width)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    codes = np.array(table.column("codes").to_pylist(), dtype=np.int64)
    sizes, found = np.diff(bounds), []
    small = np.repeat(sizes <= 32, sizes)
    owner = np.repeat(np.arange(sizes.size), sizes)
    for gap in range(1, int(sizes[sizes <= 32].max(initial=0))):
        a = np.flatnonzero(small[:-gap] & (owner[:-gap] == owner[gap:]))
        a = a[np.einsum("ij,ij->i", x[a], x[a + gap]) >= COSINE]
        found.append((a, a + gap))
    for k in np.flatnonzero(sizes > 32):
        rows = np.arange(bounds[k], bounds[k + 1])
        a, b = rows[own[rows] == low[rows[0]]], rows[own[rows] == high[rows[0]]]
        p, q = np.nonzero(x[a] @ x[b].T >= COSINE)
        found.append((a[p], b[q]) if low[rows[0]] != high[rows[0]] else (a[p[p < q]], b[q[p < q]]))
    a, b = (np.concatenate(s) for s in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
    good = (low[a] == high[a]) | (own[a] != own[b])
    before = np.arange(codes.shape[1])[None, :]
    fresh = []
    for i in range(0, a.size, 1 << 16):
        p, q = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
        fresh.append(~((codes[p] == codes[q]) & (before < number[p][:, None])).any(axis=1))
    good &= np.concatenate(fresh) if fresh else good
    a, b = a[good], b[good]
    n = np.bincount(a, weights=times[b], minlength=ids.size) + np.bincount(b, weights=times[a], minlength=ids.size)
    parent, edges = list(range(ids.size)), []
    for p, q in zip(a.tolist(), b.tolist()):
        s, t = p, q
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        while parent[t] != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        if s != t:
            parent[max(s, t)] = min(s, t)
            edges.append((p, q))
    left, right = np.array(edges, dtype=np.int64).reshape(-1, 2).T
    linked = np.flatnonzero(n)
    return pa.table({"a": np.concatenate([ids[linked], ids[left]]), "b": np.concatenate([np.full(linked.size, -1), ids[right]]),
                     "n": np.concatenate([n[linked].astype(np.int64), np.zeros(left.size, dtype=np.int64)]), "edge": np.repeat([False, True], [linked.size, left.size])})


def near_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    keys = ["label", "_h", "_g"]
    usable = every.filter(F.coalesce(fine, F.lit(False))).withColumns({"_h": F.xxhash64("embedding"), "_g": F.hash("embedding")})
    same = stored(usable.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")))
    lone = stored(usable.join(same.hint("merge"), keys).filter("vec_id = rep").dropDuplicates(keys).select("vec_id", "label", "times", "embedding"))
    total, width = lone.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = lone.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    drawn = _vectors(sample, width)
    drawn /= np.sqrt((drawn * drawn).sum(axis=1))[:, None]
    bits, tables = plan(total, width, agreements(drawn, *fit(drawn, TRIED)))
    each = max(1, width // bits)
    model = spark.sparkContext.broadcast(fit(drawn, math.ceil(tables / each)))

    def encode(batches):
        mean, matrices = model.value
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = _vectors(batch.column("embedding"), width)
            x = x / np.sqrt((x * x).sum(axis=1))[:, None] - mean
            parts = [(((x @ m) >= 0)[:, k * bits:(k + 1) * bits] * weight).sum(axis=1) for m in matrices for k in range(each)][:tables]
            codes = pa.array(list(np.stack(parts, axis=1).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "codes"])

    coded = stored(lone.mapInArrow(encode, "vec_id long, label string, times long, embedding array<double>, codes array<int>"))
    at = coded.select("vec_id", "label", F.size("embedding").alias("_width"), F.posexplode("codes").alias("table", "code"))
    at = at.select("vec_id", "table", F.xxhash64("label", "_width", "table", "code").alias("bucket"))
    counts = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    held = at.join(counts.hint("merge"), "bucket")
    blocks = F.ceil(F.col("_members") / BLOCK).cast("int")
    held = (held.withColumn("_own", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")))
    rows = held.drop("_other", "_members").join(coded.select("vec_id", "times", "embedding", "codes").hint("merge"), "vec_id")
    found = stored(map_runs(rows, ["bucket", "_i", "_j"], "a long, b long, n long, edge boolean", _links, most=1 << 12))
    links = found.filter("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("edge").select("a", "b"))
    owners = usable.select("vec_id", *keys).join(same.hint("merge"), keys).select("vec_id", "rep", "times")
    known = owners.join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("_links"), F.coalesce("component", "rep").alias("_low")).dropDuplicates(["vec_id"])
    out = every.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("_low", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
