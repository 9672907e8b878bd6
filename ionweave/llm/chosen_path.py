"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Each of ``TREES`` independent trees sends it down a path: at
every level to the child named by its minimum shingle under that tree's and level's hash. A node of at most ``SMALL``
documents is compared exhaustively; a larger one branches again, down to ``LEVELS``, and what is still large there is
compared exhaustively in blocks. Two sets of similarity s share a child with probability s, so a pair at 0.75 is missed
with probability (1 - 0.75 ** depth) ** TREES: 2e-10 at depth 1, 2e-6 at depth 2.

Inside a node one-bit sketches of the minima leave the plausible pairs, of which a maximum spanning forest goes on
(linear in the node, never all pairs). Plausible links form groups; each text is read once more and sent to its group,
where every pair is decided on full sets. In groups over ``BLOCK`` documents the forest is confirmed on full sets
first; then documents with a plausible partner in another component come back with their sets, block against block.

What grows with the documents is joined by merging, never broadcast.

Defined results: a null, empty or blank text has the empty set and stays alone. Fewer than five words form one
shingle. Rows that repeat a doc_id share its component. Rows without doc_id take the component of an equal set, if one
has an id, and are kept only if none has. Other columns are ignored, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import components, map_runs, stored

TREES, LEVELS = 16, 4
SMALL, BLOCK = 2048, 512
WORDS = 5
#: Sketches agree on (1 + s) / 2 of their bits; pairs under this estimate are implausible at 0.75 (4.5 deviations).
PLAUSIBLE = 0.5
_FACTORS = T.mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    done = 0
    for part in T.slices(batch):
        data, offsets = T.text_bytes(part.column("text"))
        starts, ends = T.word_spans(data, offsets)
        hashes = T.span_hashes(data, starts, ends, fold=True)
        bounds = T.word_ranges(starts, offsets)
        for i in range(part.num_rows):
            own = hashes[bounds[i]:bounds[i + 1]]
            yield done + i, np.unique(T.gram_hashes(own, min(words, own.size))) if own.size else own
        done += part.num_rows


def _minima(shingles: np.ndarray) -> np.ndarray:
    """For each tree and level the mixed hash of the minimum shingle."""
    best = np.full(_FACTORS.size, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 21) // _FACTORS.size)
    for i in range(0, shingles.size, step):
        best = np.minimum(best, (shingles[i:i + step, None] * _FACTORS).min(axis=0))
    return T.mix(best)


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, minima, sketch) of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hi, lo, minima, sketch = [], [], [], [], []
            for _, own in _sets(batch, words):
                best = _minima(own) if own.size else None
                size.append(own.size)
                hi.append(int(T.mix(own).sum().view(np.int64)) if own.size else 0)
                lo.append(int(T.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if own.size else 0)
                minima.append(None if best is None else best.astype(np.uint32).view(np.int32))
                sketch.append(None if best is None else ((best[:, None] >> np.arange(32, 36, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                pa.array(minima, pa.list_(pa.int32())), pa.array([None if x is None else np.packbits(x).tobytes() for x in sketch], pa.binary()),
            ], ["doc_id", "n_shingles", "set_hi", "set_lo", "minima", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_hi long, set_lo long, minima array<int>, sketch binary")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, shingles): the sorted distinct shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                sets = [own.view(np.int64) for _, own in _sets(part, words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _nodes(profile: DataFrame) -> DataFrame:
    """(node, doc_id, _members) for each tree: the node on the document's path where branching ends, if it has company there."""
    at = profile.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.get("minima", t * LEVELS)))).alias("tree", "node"))
    out = None
    for level in range(LEVELS):
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
        held = at.join(sizes.hint("merge"), "node")
        if level == LEVELS - 1:
            return out.unionByName(held.drop("tree"))
        done = held.filter(F.col("_members") <= SMALL).drop("tree")
        out = done if out is None else out.unionByName(done)
        deeper = held.filter(F.col("_members") > SMALL).join(profile.select("doc_id", "minima"), "doc_id")
        at = deeper.select("doc_id", "tree", F.xxhash64("node", F.get("minima", F.col("tree") * LEVELS + level + 1)).alias("node"))


def _block_pairs(members: DataFrame) -> DataFrame:
    """Deal a node's documents into blocks and each block to every pair of blocks it belongs to."""
    blocks = F.greatest(F.ceil(F.col("_members") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    return (members.withColumn("_blocks", blocks).withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels after the given links, and the places of the links that joined something."""
    parent, used = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append(k)
    return np.array([top(x) for x in range(n)], dtype=np.int64), np.array(used, dtype=np.int64)


def _bits(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)


def _plausible(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, estimate): row pairs of the same run whose sketches and sizes allow 0.75."""
    bits, size, ids = _bits(table), table.column("n_shingles").to_numpy(), table.column("doc_id").to_numpy()
    own, low, high = (table.column(c).to_numpy() for c in ("_own", "_i", "_j"))
    width = np.diff(bounds)
    pairs, few = [], np.flatnonzero(width <= 32)
    owner = np.repeat(np.arange(width.size), width)
    small = np.isin(owner, few)
    for gap in range(1, int(width[few].max()) if few.size else 0):
        a = np.flatnonzero(small[:-gap] & (owner[:-gap] == owner[gap:]))
        pairs.append((a, a + gap))
    for k in np.flatnonzero(width > 32):
        rows = np.arange(bounds[k], bounds[k + 1])
        a, b = rows[own[rows] == low[rows[0]]], rows[own[rows] == high[rows[0]]]
        for part in np.array_split(a, max(1, a.size // 64)):
            x, y = np.repeat(part, b.size), np.tile(b, part.size)
            near = 4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y])
            near &= (x < y) if low[rows[0]] == high[rows[0]] else True
            x, y = x[near], y[near]
            close = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int32) <= 32 * bits.shape[1] * (1 - PLAUSIBLE)
            pairs.append((x[close], y[close]))
    if not pairs:
        return (np.zeros(0, dtype=np.int64),) * 3
    x, y = (np.concatenate(side) for side in zip(*pairs))
    fits = (ids[x] != ids[y]) & (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y]))
    fits &= (low[x] == high[x]) | (own[x] != own[y])
    x, y = x[fits], y[fits]
    guess = 1 - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) / (32 * bits.shape[1])
    keep = guess >= PLAUSIBLE
    return x[keep], y[keep], guess[keep]


def _edges(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    a, b = ids[left], ids[right]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _forest(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The plausible links of each run, cut to a spanning forest of the likeliest."""
    left, right, guess = _plausible(table, bounds)
    order = np.argsort(-guess, kind="stable")
    _, used = _roots(table.num_rows, left[order], right[order])
    return _edges(table.column("doc_id").to_numpy(), left[order[used]], right[order[used]])


def _open(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The documents that have a plausible partner of another component in their run."""
    left, right, _ = _plausible(table, bounds)
    part = table.column("component").to_numpy()
    across = part[left] != part[right]
    return table.take(np.unique(np.concatenate([left[across], right[across]])))


def _overlaps(sets: list[np.ndarray], few: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the chosen sets with all sets, from products of 0/1 rows over shared shingles."""
    size = np.array([len(x) for x in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(inverse) > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
    row = np.repeat(np.arange(size.size), size)
    row, place = row[place >= 0], place[place >= 0]
    out, width = np.zeros((few.size, size.size), dtype=np.int64), 4096
    for low in range(0, int(place.max()) + 1 if place.size else 0, width):
        here = (place >= low) & (place < low + width)
        grid = np.zeros((size.size, width), dtype=np.float32)
        grid[row[here], place[here] - low] = 1
        out += np.rint(grid[few] @ grid.T).astype(np.int64)
    return out


def _decide(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The exact links between components in each run, as a spanning forest."""
    ids, part = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    own, low, high = (table.column(c).to_numpy() for c in ("_own", "_i", "_j"))
    lists = table.column("shingles").combine_chunks()
    found = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        here = part[first:last]
        value, count = np.unique(here, return_counts=True)
        few = np.flatnonzero(here != value[np.argmax(count)])  # every pair across components has one of these
        if not few.size:
            continue
        sets = [lists[k].values.to_numpy() for k in range(first, last)]
        size, inter = np.array([len(x) for x in sets]), _overlaps(sets, few)
        linked = 100 * inter >= 75 * (size[few][:, None] + size[None, :] - inter)
        linked &= here[few][:, None] != here[None, :]
        if low[first] != high[first]:
            linked &= own[first:last][few][:, None] != own[first:last][None, :]
        x, y = np.nonzero(linked)
        _, used = _roots(last - first, few[x], y)
        found.append((first + few[x[used]], first + y[used]))
    if not found:
        return _edges(ids, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return _edges(ids, *(np.concatenate(side) for side in zip(*found)))


def _settle(table: pa.Table, bounds: np.ndarray, words: int) -> pa.Table:
    """(node, component) of the texts that are linked inside their run, decided on full sets."""
    ids, left, right = table.column("doc_id").to_numpy(), [], []
    texts = table.select(["text"]).combine_chunks().to_batches()[0]
    sets = [own for _, own in _sets(texts, words)]
    size = np.array([len(x) for x in sets])
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if last - first == 2:
            inter = np.intersect1d(sets[first], sets[last - 1], assume_unique=True).size
            x, y = (np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)) if 100 * inter >= 75 * (size[first] + size[last - 1] - inter) else (np.zeros(0, dtype=np.int64),) * 2
        else:
            inter, own = _overlaps(sets[first:last], np.arange(last - first)), size[first:last]
            x, y = np.nonzero(np.triu(100 * inter >= 75 * (own[:, None] + own[None, :] - inter), 1))
        left.append(first + x)
        right.append(first + y)
    root, _ = _roots(ids.size, np.concatenate(left), np.concatenate(right))
    lowest = np.full(ids.size, np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, ids)
    linked = np.bincount(root, minlength=ids.size)[root] > 1
    return pa.table({"node": ids[linked], "component": lowest[root][linked]})


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stored(profiles(docs, words))
    filled = every.filter("n_shingles > 0 and doc_id is not null")
    first = filled.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("doc_id"))  # equal sets go on as one
    lone = filled.join(first.hint("merge"), ["set_hi", "set_lo", "doc_id"], "left_semi").dropDuplicates(["set_hi", "set_lo"])
    lone = stored(lone.select("doc_id", "n_shingles", "minima", "sketch"))

    members = stored(_nodes(lone))
    light = lone.select("doc_id", "n_shingles", "sketch")
    keys = ["node", "_i", "_j"]
    likely = stored(map_runs(_block_pairs(members.join(light.hint("merge"), "doc_id")), keys, "a long, b long", _forest).distinct())
    group = components(likely).select(F.col("node").alias("doc_id"), F.col("component").alias("_group"))
    group = group.join(group.groupBy("_group").agg(F.count(F.lit(1)).alias("_size")), "_group")
    texts = stored(docs.join(group.hint("merge"), "doc_id"))
    exact = map_runs(texts.filter(F.col("_size") <= BLOCK).select("_group", "doc_id", "text"), ["_group"], "node long, component long", lambda table, bounds: _settle(table, bounds, words), most=1 << 10)

    # larger groups: the forest first, then only what still lies across components
    large = texts.filter(F.col("_size") > BLOCK)
    sets = stored(shingle_sets(large, words))
    members = members.join(sets.select("doc_id").distinct(), "doc_id", "left_semi")
    both = (likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_left")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_right")), "b"))
    inter = F.size(F.array_intersect("_left", "_right"))
    sure = stored(both.filter(100 * inter >= 75 * (F.size("_left") + F.size("_right") - inter)).select("a", "b").distinct())

    parts = components(sure)
    held = members.join(light.hint("merge"), "doc_id").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    held = held.withColumn("component", F.coalesce("component", "doc_id"))
    unsettled = held.groupBy("node").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("node")
    columns = "node long, _i int, _j int, _own int, doc_id long, component long"
    waiting = map_runs(_block_pairs(held.join(unsettled, "node", "left_semi")), keys, columns, _open)
    more = map_runs(waiting.join(sets, "doc_id"), keys, "a long, b long", _decide)
    final = exact.union(components(parts.toDF("a", "b").union(more))).groupBy(F.col("node").alias("_first")).agg(F.min("component").alias("_low"))

    shared = first.join(final, first["doc_id"] == final["_first"], "left").select(
        "set_hi", "set_lo", F.coalesce("_low", "doc_id").alias("component_id"))
    own = every.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hi")).alias("set_hi"), "set_lo")
    out = own.join(shared.hint("merge"), ["set_hi", "set_lo"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
