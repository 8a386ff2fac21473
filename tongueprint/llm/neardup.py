"""Near-duplicate documents by SimHash and vantage-point trees.

A fingerprint has a bit set where more than half of the hashes of a document's word shingles have it. Equal fingerprints
are one node, so copies of a document never meet pair by pair. Nodes within ``radius`` bits are linked; the classes are
the connected components.

The tree cuts the space of fingerprints: each inner node has a vantage point and a distance; what is at most that far
goes left, the rest right. If a lies left and b right and both are within r, the triangle inequality puts a in the last r
distances of the left side. So only such boundary fingerprints visit the right side too, and every pair within r meets
in a leaf. Above the leaves, one tree over a bounded sample says which shards a fingerprint lives in and visits;
each shard then goes on splitting the same way in its own task until few enough are left to compare directly. A shard
gives back a spanning forest of the links it found, never all pairs of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.llm.common import WORD, map_rows, text_or_empty
from tongueprint.llm.components import components
from tongueprint.session import materialize

SHINGLE = 3
RADIUS = 2
# Min-hash keys of a document's shingles, and min-hashes in each: of pairs of similarity 0.8, 99.99% share a key.
KEYS, ROWS = 30, 6
SAMPLE = 50_000
SHARD = 20_000
DIRECT = 256
WORDS = re.compile(WORD.encode())
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of a text, repeats included; of all its words if they are no more than a shingle."""
    words = WORDS.findall(text.encode("utf-8").translate(bytes.maketrans(UPPER, LOWER)))
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:len(words) - shingle]]).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    return np.array([hashed(joined[i:j], 42) for i, j in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority bits of the hashes of all shingles of a text; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        octets = hashes[start:start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@dataclass(frozen=True)
class Node:
    """Inner node: vantage point and distance; a leaf is the number of its shard."""

    point: int
    limit: int
    near: Node | int
    far: Node | int


def split_at(distances: np.ndarray, radius: int) -> int:
    """The limit that leaves both sides a good share with the fewest on the boundary."""
    counts = np.bincount(distances, minlength=66)[:66]
    upto = np.cumsum(counts)
    total, best, chosen = upto[-1], None, -1
    for limit in range(65):
        smaller = min(upto[limit], total - upto[limit])
        if smaller * 4 < total:
            continue
        boundary = counts[max(0, limit - radius + 1):limit + 1].sum()
        if best is None or boundary < best:
            best, chosen = boundary, limit
    if chosen < 0:
        inner = np.minimum(upto[:-1], total - upto[:-1])
        chosen = int(np.argmax(inner)) if inner.max() > 0 else -1
    return chosen


def far_point(points: np.ndarray) -> int:
    """A point at the edge of the set: the one farthest from its first."""
    return int(points[np.argmax(np.bitwise_count(points ^ points[0]))])


def grow(points: np.ndarray, radius: int, size: int, leaves: list[int]) -> Node | int:
    """Tree over a sample, with leaves of at most ``size`` of its points, as far as it can be split."""
    if len(points) > size:
        point = far_point(points)
        distances = np.bitwise_count(points ^ np.uint64(point)).astype(np.int64)
        limit = split_at(distances, radius)
        if limit >= 0:
            near = grow(points[distances <= limit], radius, size, leaves)
            return Node(point, limit, near, grow(points[distances > limit], radius, size, leaves))
    leaves.append(len(leaves))
    return leaves[-1]


def shards_of(tree: Node | int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard each point lives in or visits."""
    rows, shards = [], []
    pending = [(tree, np.arange(len(points)))]
    while pending:
        node, at = pending.pop()
        if not isinstance(node, Node):
            rows.append(at)
            shards.append(np.full(len(at), node))
            continue
        distances = np.bitwise_count(points[at] ^ np.uint64(node.point)).astype(np.int64)
        pending.append((node.near, at[distances <= node.limit]))
        pending.append((node.far, at[distances > node.limit - radius]))
    return np.concatenate(rows), np.concatenate(shards)


def links_within(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of distinct points within the radius, as positions (from, to)."""
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    pending = [np.arange(len(points))]
    while pending:
        at = pending.pop()
        here = points[at]
        if len(at) > DIRECT:
            point = far_point(here)
            distances = np.bitwise_count(here ^ np.uint64(point)).astype(np.int64)
            limit = split_at(distances, radius)
            near, far = at[distances <= limit], at[distances > limit - radius]
            # Points too close to each other to be split are compared in strips instead.
            if limit >= 0 and max(len(near), len(far)) < len(at) * 0.95:
                pending += [near, far]
                continue
        for start in range(0, len(at), DIRECT):
            strip = slice(start, start + DIRECT)
            close = np.bitwise_count(here[strip, None] ^ here[None, start:]) <= radius
            for i, j in zip(*np.nonzero(np.triu(close, 1))):
                a, b = root(int(at[start + i])), root(int(at[start + j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(at[start + i])
                    right.append(at[start + j])
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """Every row with ``out long`` (the 64 bits) in place of its text; null texts count as empty, fingerprint 0."""
    kept = df.drop(out).withColumn(text_col, text_or_empty(text_col))
    others = [c for c in kept.columns if c != text_col]
    picked = kept.select(*others, text_col)
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in picked.dtypes if c != text_col), f"`{out}` long"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(len(others))], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits.view(np.int64))], names=[*others, out])

        return step

    return map_rows(picked, make, schema)


def links(points: DataFrame, column: str, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: links between distinct values of ``column`` that have the same components as all pairs within the radius."""
    distinct = points.select(F.col(column).alias("p")).distinct()
    total = distinct.count()
    wanted = max(1, -(-total // shard))
    seen = distinct.orderBy(F.xxhash64("p"), "p").limit(sample).toPandas()["p"].to_numpy(dtype=np.int64).view(np.uint64)
    leaves: list[int] = []
    tree = grow(seen, radius, max(1, len(seen) // wanted), leaves) if len(seen) and wanted > 1 else 0

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["p"].to_numpy(dtype=np.int64)
            rows, shards = shards_of(tree, values.view(np.uint64), radius)
            yield pd.DataFrame({"p": values[rows], "shard": shards})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(frame["p"].to_numpy(dtype=np.int64))
        left, right = links_within(values.view(np.uint64), radius)
        return pd.DataFrame({"a": values[left], "b": values[right]})

    placed = distinct.mapInPandas(assign, "p long, shard long")
    return placed.groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row: the class is the smallest id reachable over links, itself included.

    Texts without words all have fingerprint zero and link like any others. Rows with equal ids each stay; null ids
    belong to a class but do not name it, unless the class has no other id. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, shingle), "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min(id_col).alias("_least"))
    found = components(links(nodes, "fingerprint", radius), "a", "b")
    placed = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_class")
    )
    named = placed.groupBy("_class").agg(F.min("_least").alias("component_id"))
    classes = placed.join(named, "_class").select(F.col("fingerprint").alias("_f"), "component_id")
    return marked.join(classes, F.col("fingerprint") == F.col("_f")).drop("_f")


def shingle_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(node, fingerprint, keys, shingles)`` of every row: hash of the text, min-hash keys, sorted distinct hashes of its shingles."""
    picked = docs.select(F.xxhash64(text_or_empty(text_col)).alias("node"), text_or_empty(text_col).alias("text"))
    factors = np.random.default_rng(17).integers(0, 1 << 63, KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        def keys_of(hashes: np.ndarray) -> list[int]:
            least = np.array([(hashes * f).min() for f in factors], dtype="<u8").reshape(KEYS, ROWS)
            return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sets, bits = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                sets.append(hashes.view(np.int64))
                bits.append(fingerprint(text, shingle))
                keys.append(keys_of(hashes) if len(hashes) else [0])
            points = pa.array(np.array(bits, dtype=np.uint64).view(np.int64))
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), points, pa.array(keys, kind), pa.array(sets, kind)], names=["node", "fingerprint", "keys", "shingles"]
            )

        return step

    return map_rows(picked, make, "node long, fingerprint long, keys array<long>, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingles have that Jaccard similarity; two empty sets are equal."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    least, most = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    alike = shared + 1e-9 >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)
    return both.where((least + 1e-9 >= F.lit(similarity) * most) & alike).select("a", "b")


def similar_documents(docs: DataFrame, text_col: str, shingle: int, radius: int, similarity: float) -> DataFrame:
    """``(node, component)`` of the texts (``node``: xxhash64) linked to another one by shingle similarity.

    Candidates share a min-hash key or have fingerprints within the radius; the true similarity of their shingles decides. As
    for lines, every text is compared with the smallest one at its keys first, and then only across groups.
    """
    sets = materialize(shingle_sets(docs, text_col, shingle).dropDuplicates(["node"]), "shingles")
    points = sets.groupBy("fingerprint").agg(F.min("node").alias("hub"))
    near = links(points, "fingerprint", radius)
    for end in "ab":
        near = near.join(points.select(F.col("fingerprint").alias(end), F.col("hub").alias(f"hub_{end}")), end).drop(end)
    same = sets.join(points.select(F.col("fingerprint").alias("_f"), "hub"), F.col("fingerprint") == F.col("_f"))
    there = Window.partitionBy("meet")
    met = sets.select("node", F.explode("keys").alias("meet")).withColumns({"hub": F.min("node").over(there), "last": F.max("node").over(there)})
    places = materialize(met.where("hub <> last").select("meet", "node", "hub"), "shingle-places")
    stars = places.select("node", "hub").union(same.select("node", "hub")).union(near.select("hub_a", "hub_b"))
    stars = stars.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    groups = materialize(components(verified(materialize(stars, "shingle-stars"), sets, similarity), "a", "b"), "shingle-groups")
    known = groups.select(F.col("node").alias("_n"), "component")
    placed = places.join(known, F.col("node") == F.col("_n"), "left").select("meet", "node", F.coalesce("component", "node").alias("grp"))
    mixed = placed.withColumns({"low": F.min("grp").over(there), "high": F.max("grp").over(there)}).where("low <> high")
    mixed = materialize(mixed.select("meet", "node", "grp"), "shingle-mixed")
    left, right = mixed.alias("l"), mixed.alias("r")
    across = (F.col("l.meet") == F.col("r.meet")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.grp") != F.col("r.grp"))
    more = left.join(right, across).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    rest = verified(materialize(more, "shingle-pairs"), sets, similarity)
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), "a", "b")


def hex_of(column: str):
    """The 64 bits of a long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
