"""Removal of long repeated byte strings by merging sparse suffix orders.

A byte goes if some string of ``length`` bytes over it also starts anywhere else. A full suffix order of the corpus would
show all of them, but refining it takes one pass over every byte for each of ``length`` symbols. So only suffixes at chosen
places enter: in every run of places as long as a string has anchors, the one whose ``GRAM`` bytes hash smallest. The choice
depends on the bytes of the run alone, so equal strings have an anchor at the same offset, and a string that
repeats is found at it. Every shard of texts lists its anchors and their neighbourhood; the rest is merging:

1. Depth ``GRAM``: anchors whose bytes occur once are dropped; that is a count of hashes.
2. The offsets an anchor can have in a string are cut into ``FAMILIES`` ranges. All strings of a range share the bytes
   between its extremes, so suffixes meet only with those of equal shared bytes, and equal neighbourhoods are one class.
3. Interleave refinement: in each bucket the suffixes are refined by one more symbol to the right and the prefixes by one
   more to the left (the column of preceding symbols, as in a Burrows-Wheeler transform) until the range is covered. A round
   splits buckets by their next symbol and re-sorts nothing else. What still shares a bucket on both sides for one offset
   is a repeated interval.

Buckets with more than ``MANY`` classes are not gathered: their strings are hashed one by one and counted instead.
Copies of a text are worked on once. The texts are written to the shared folder once, bucketed by their key, so the two
joins that need them do not move them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.llm.common import text_or_empty, workers
from tongueprint.session import shared_dir

LENGTH = 400
GRAM = 64
FAMILIES = 4
MANY = 30_000
CHUNK = 20_000
BASE = 0x9E3779B97F4A7C15
OUTSIDE = 256


class Powers:
    """Powers of the hash base and of its inverse, modulo 2^64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            room = max(1 << 16, 2 * size)
            self.up = np.multiply.accumulate(np.full(room, BASE, dtype=np.uint64))
            self.down = np.multiply.accumulate(np.full(room, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        return self.up[:size], self.down[:size]


def gram_hashes(content: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` bytes from every place."""
    up, down = powers.upto(len(content))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(content.astype(np.uint64) * up)])
    places = len(content) - gram + 1
    hashes = (sums[gram:] - sums[:places]) * down[:places]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def anchors(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest hash in each run of ``run`` places, the last one of equals."""
    if len(hashes) < run:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64(0xFFFFFFFF)
    ranked = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    blocks = -(-len(ranked) // run)
    padded = np.full(blocks * run, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(ranked)] = ranked
    grid = padded.reshape(blocks, run)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:len(ranked) - run + 1], ahead[run - 1:len(ranked)])
    changed = np.concatenate([[True], least[1:] != least[:-1]])
    return (low - (least[changed] & low)).astype(np.int64)


def ranges(length: int, gram: int, families: int) -> list[tuple[int, int]]:
    """First offset and width of each range of offsets an anchor can have in a string."""
    edges = [(length - gram + 1) * i // families for i in range(families + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def refined(buckets: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    """Buckets after 0, 1, 2, ... more symbols, one array a depth."""
    out = [buckets]
    for depth in range(symbols.shape[1]):
        out.append(np.unique(out[-1] * (OUTSIDE + 1) + symbols[:, depth], return_inverse=True)[1].astype(np.int64))
    return out


def repeated(buckets: np.ndarray, left: np.ndarray, right: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset (from the first of the range) at which each class repeats; -1 where none does.

    ``left`` and ``right`` hold the symbols outwards from the shared bytes; ``often`` is true for classes met twice.
    """
    before, after = refined(buckets, left), refined(buckets, right)
    least, largest = np.full(len(buckets), -1), np.full(len(buckets), -1)
    width = left.shape[1] + 1
    for offset in range(width):
        depth = width - 1 - offset
        inside = np.ones(len(buckets), dtype=bool)
        if offset:
            inside &= left[:, offset - 1] != OUTSIDE
        if depth:
            inside &= right[:, depth - 1] != OUTSIDE
        both = before[offset] * (len(buckets) + 1) + after[depth]
        _, place, count = np.unique(both, return_inverse=True, return_counts=True)
        hit = inside & ((count[place] > 1) | often)
        least = np.where(hit & (least < 0), offset, least)
        largest = np.where(hit, offset, largest)
    return least, largest


def symbols(parts: list[bytes], width: int, reverse: bool) -> np.ndarray:
    out = np.full((len(parts), width), OUTSIDE, dtype=np.int64)
    for row, part in enumerate(parts):
        codes = np.frombuffer(part, dtype=np.uint8)
        out[row, :len(codes)] = codes[::-1] if reverse else codes
    return out


def merged(intervals: np.ndarray) -> list[tuple[int, int]]:
    """Union of (start, end) rows as maximal runs."""
    out: list[list[int]] = []
    for start, end in intervals[np.lexsort((intervals[:, 1], intervals[:, 0]))].tolist():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def key_of(text_col: str) -> Column:
    """128-bit hash that stands for a text."""
    return F.unhex(F.md5(text_or_empty(text_col)))


def keyed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(key, n_bytes, packed)`` of every row: the key of the text, its size and the compressed text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                contents = [t.as_py().encode("utf-8") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(c) for c in contents], pa.int64()),
                     pa.array([press.compress(c) for c in contents], pa.binary())], names=["key", "n_bytes", "packed"],
                )

    rows = docs.select(key_of(text_col).alias("key"), text_or_empty(text_col).alias("t"))
    return rows.mapInArrow(pack, "key binary, n_bytes long, packed binary")


def stored(texts: DataFrame) -> DataFrame:
    """One row a distinct text with its ``copies``, written bucketed by key."""
    spark, count = texts.sparkSession, workers(texts)
    name = f"texts_{uuid.uuid4().hex}"
    distinct = texts.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed"))
    writer = distinct.repartition(count, "key").write.bucketBy(count, "key").sortBy("key")
    writer.option("path", f"{shared_dir(spark)}/tongueprint/{name}").saveAsTable(name)
    return spark.table(name)


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``(key, place, hash)`` of all anchors of texts of at least ``length`` bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, powers = zstandard.ZstdDecompressor(), Powers()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                keys, places, hashes = [], [], []
                part = batch.slice(start, 500)
                for row, packed in enumerate(part.column(1)):
                    every = gram_hashes(np.frombuffer(unpack.decompress(packed.as_py()), dtype=np.uint8), GRAM, powers)
                    at = anchors(every, length - GRAM + 1)
                    keys.append(np.full(len(at), row))
                    places.append(at)
                    hashes.append(every[at])
                joined = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate([*keys, []]).astype(np.int64))),
                     pa.array(np.concatenate([*places, []]).astype(np.int64)), pa.array(joined)], names=["key", "place", "hash"],
                )

    return texts.where(F.col("n_bytes") >= length).select("key", "packed").mapInArrow(find, "key binary, place long, hash long")


def around(content: bytes, at: int, length: int, cut: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(bucket, class, family, before, after) of an anchor in each range of offsets that fits into the text."""
    for family, (first, width) in enumerate(cut):
        begin, stop = at - first, at + length - first - width + 1
        if begin < 0 or stop > len(content):
            continue
        before, after = content[max(0, begin - width + 1):begin], content[stop:stop + width - 1]
        shared = xxhash.xxh3_64_intdigest(content[begin:stop], family)
        both = xxhash.xxh3_64_intdigest(before + bytes([len(before) & 255]) + after, shared)
        yield shared - (1 << 63), both - (1 << 63), family, before, after


def placed_classes(placed: DataFrame, length: int) -> DataFrame:
    """``(bucket, class, family, key, place)`` from ``(key, packed, places)``: where each class stands."""
    cut = ranges(length, GRAM, FAMILIES)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, packed, places in zip(*[batch.column(i) for i in range(3)]):
                content, name = unpack.decompress(packed.as_py()), key.as_py()
                rows = [(b, c, f, name, at) for at in places.as_py() for b, c, f, _, _ in around(content, at, length, cut)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
                    names = ["bucket", "class", "family", "key", "place"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return placed.select("key", "packed", "places").mapInArrow(lay, "bucket long, class long, family int, key binary, place long")


def classes_of(placed: DataFrame, length: int) -> DataFrame:
    """``(bucket, class, family, n, before, after, classes, members)`` of the buckets with two members or more.

    A task adds up the classes it meets before they travel, so a passage of very many texts moves a few rows a task.
    """
    cut = ranges(length, GRAM, FAMILIES)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), {}

        def flush() -> pa.RecordBatch:
            rows = [(b, c, f, n, before, after) for (b, c), (f, n, before, after) in held.items()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "class", "family", "n", "before", "after"]
            )

        for batch in batches:
            for packed, places in zip(batch.column(1), batch.column(2)):
                content = unpack.decompress(packed.as_py())
                for at in places.as_py():
                    for bucket, kind, family, before, after in around(content, at, length, cut):
                        known = held.get((bucket, kind))
                        held[bucket, kind] = (family, known[1] + 1 if known else 1, before, after)
                if len(held) >= CHUNK:
                    yield flush()
                    held.clear()
        yield flush()

    parts = placed.select("key", "packed", "places").mapInArrow(
        add_up, "bucket long, class long, family int, n long, before binary, after binary"
    )
    grouped = parts.repartition(workers(placed), "bucket").groupBy("bucket", "class").agg(
        F.sum("n").alias("n"), F.first("family").alias("family"), F.first("before").alias("before"), F.first("after").alias("after")
    )
    bucket = Window.partitionBy("bucket")
    sized = grouped.withColumns({"classes": F.count("*").over(bucket), "members": F.sum("n").over(bucket)})
    return sized.where("members > 1")


def refine(classes: DataFrame, length: int) -> DataFrame:
    """``(bucket, class, least, largest)`` of the classes that repeat somewhere, from ``(bucket, class, family, n, before, after)``."""
    cut = ranges(length, GRAM, FAMILIES)

    def work(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for family, (_, width) in enumerate(cut):
            some = [r for r in rows if r[2] == family]
            if some:
                buckets = np.unique(np.array([r[0] for r in some]), return_inverse=True)[1].astype(np.int64)
                left = symbols([r[4] for r in some], width - 1, True)
                right = symbols([r[5] for r in some], width - 1, False)
                least, largest = repeated(buckets, left, right, np.array([r[3] > 1 for r in some]))
                out += [(*some[i][:2], int(least[i]), int(largest[i])) for i in np.flatnonzero(least >= 0)]
        columns = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "class", "least", "largest"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    # The classes are partitioned by bucket already.
    ordered = classes.select("bucket", "class", "family", "n", "before", "after").sortWithinPartitions("bucket", "class")
    return ordered.mapInArrow(stream, "bucket long, class long, least int, largest int")


def counted(classes: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large to gather: each string is hashed by itself, and equal ones are counted."""
    cut = ranges(length, GRAM, FAMILIES)
    width = F.get(F.array(*[F.lit(w) for _, w in cut]), F.col("family"))
    each = classes.withColumn("offset", F.explode(F.sequence(F.lit(0), width - 1))).withColumn("depth", width - 1 - F.col("offset"))
    each = each.where((F.length("before") >= F.col("offset")) & (F.length("after") >= F.col("depth")))
    left = F.expr("substring(before, cast(length(before) - offset + 1 as int), offset)")
    right = F.expr("substring(after, 1, depth)")
    hashed = each.select("bucket", "class", "n", "offset", F.xxhash64(left, right).alias("string"))
    often = hashed.groupBy("bucket", "offset", "string").agg(F.sum("n").alias("_n")).where("_n > 1")
    hits = hashed.join(often, ["bucket", "offset", "string"], "left_semi")
    return hits.groupBy("bucket", "class").agg(F.min("offset").alias("least"), F.max("offset").alias("largest"))


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``(key, spans)``: intervals of bytes to remove from each stored text, unmerged; texts without any are absent."""
    found = anchor_rows(texts, length)
    twice = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("hash", "_hash")
    places = found.join(twice, F.col("hash") == F.col("_hash"), "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    placed = texts.select("key", "packed").join(places, "key")
    met = classes_of(placed, length)
    verdicts = refine(met.where(F.col("classes") <= MANY), length).unionByName(counted(met.where(F.col("classes") > MANY), length))
    verdicts = verdicts.select(F.col("bucket").alias("_b"), F.col("class").alias("_c"), "least", "largest")
    hits = placed_classes(placed, length).join(verdicts, (F.col("bucket") == F.col("_b")) & (F.col("class") == F.col("_c")))
    first = F.get(F.array(*[F.lit(a) for a, _ in ranges(length, GRAM, FAMILIES)]), F.col("family"))
    start = F.col("place") - first - F.col("largest")
    end = F.col("place") - first - F.col("least") + F.lit(length)
    return hits.groupBy("key").agg(F.collect_set(F.struct(start.alias("start"), end.alias("end"))).alias("spans"))


def cut_texts(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, spans, kept binary)``: a row for each distinct text of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else goes, judged on the input; strings do
    not cross rows. ``spans`` are the maximal removed runs, ends exclusive; ``kept`` is what remains. Null texts are
    empty. A text of at least ``length`` bytes that stands in two rows goes whole, whatever their ids.
    """
    if length < GRAM + FAMILIES:
        raise ValueError(f"length must be at least {GRAM + FAMILIES}")
    texts = stored(keyed_texts(docs, text_col))
    spans = repeated_spans(texts, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                keys, sizes, runs, rest = [], [], [], []
                for key, copies, packed, found in zip(*[batch.column(i).slice(begin, 500) for i in range(4)]):
                    content = unpack.decompress(packed.as_py())
                    gone = merged(np.array([(s["start"], s["end"]) for s in found.as_py()])) if found.is_valid else []
                    if copies.as_py() > 1 and len(content) >= length:
                        gone = [(0, len(content))]
                    kept, at = [], 0
                    for start, end in gone:
                        kept.append(content[at:start])
                        at = end
                    keys.append(key.as_py())
                    sizes.append(len(content))
                    runs.append([{"start": a, "end": b} for a, b in gone])
                    rest.append(b"".join([*kept, content[at:]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(rest, pa.binary())],
                    names=["key", "n_bytes", "spans", "kept"],
                )

    joined = texts.join(spans, "key", "left").select("key", "copies", "packed", "spans")
    done = joined.mapInArrow(cut, "key binary, n_bytes long, spans array<struct<start: long, `end`: long>>, kept binary")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return done.select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")


def attach(docs: DataFrame, cuts: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns of ``cuts``, one row a distinct text, next to each row of ``docs`` in place of its text.

    A column of ``docs`` that has the name of one of these is replaced.
    """
    added = [c for c in cuts.columns if c != "key"]
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col and c.lower() not in added]).alias("doc"), key_of(text_col).alias("own"))
    return rows.join(cuts, F.col("own") == F.col("key")).select("doc.*", *added)
