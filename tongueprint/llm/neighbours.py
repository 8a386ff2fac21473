"""Each row next to the row that follows it by id, streamed in order without one global task.

Ids are cut into ranges of about equal counts. A range is sorted and streamed in one task; the first row of a range also
travels to the range before it, the very first row to the last range. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.common import text_or_empty, workers

ROWS = 8_192


def with_next(
    docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str, str], tuple]], schema: str,
) -> DataFrame:
    """``(id, ...)`` with what the function of each task makes of a row's text and the next row's.

    The next row is the one with the next larger id, after the largest the smallest; a single row follows itself. Rows of
    equal id stand in the order of a hash of their text. Ids are whole numbers; a null id comes first. Null texts are empty.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ids = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"))
    total = ids.count()
    wanted = max(workers(docs), -(-total // ROWS))
    cuts = ids.approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if total else []
    bounds = np.unique(np.array(cuts, dtype=np.float64)).astype(np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(place(values)), batch.column(0)], names=["at", "id"])

    def place(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, values, side="right").astype(np.int32)

    # One row a range; ranges are about as many as partitions.
    firsts = {r["at"]: r["id"] for r in ids.mapInArrow(ranges, "at int, id long").groupBy("at").agg(F.min("id").alias("id")).collect()}
    filled = sorted(firsts)
    before = {firsts[at]: filled[i - 1] for i, at in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                at, later, key, tie, packed = [], [], [], [], []
                part = batch.slice(start, 500)
                for row_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    known = -(1 << 63) if row_id is None else row_id
                    content = text.as_py().encode("utf-8")
                    homes = [(int(place(np.array([known]))[0]), False)]
                    if known in before:
                        homes.append((before[known], True))
                    for home, extra in homes:
                        at.append(home)
                        later.append(extra)
                        key.append(row_id)
                        tie.append(xxhash.xxh64_intdigest(content) - (1 << 63))
                        packed.append(press.compress(content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(later, pa.bool_()), pa.array(key, pa.int64()), pa.array(tie, pa.int64()),
                     pa.array(packed, pa.binary())], names=["at", "later", "id", "tie", "packed"],
                )

    dealt = rows.mapInArrow(deal, "at int, later boolean, id long, tie long, packed binary")
    ordered = dealt.repartition(wanted, "at").sortWithinPartitions("at", "later", "id", "tie")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, unpack = make(), zstandard.ZstdDecompressor()
        held, done = None, []
        for batch in batches:
            for at, later, row_id, packed in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                text = unpack.decompress(packed).decode("utf-8")
                # The last row of a range meets the first of the next range, and no further one.
                if held and held[0] == at and not held[1]:
                    done.append((held[2], *work(held[3], text)))
                held = (at, later, row_id, text)
            if done:
                yield table(done)
                done = []

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=names)

    names = [part.split()[0] for part in f"{id_col} {kind}, {schema}".split(",")]
    return ordered.mapInArrow(stream, f"`{id_col}` long, {schema}").withColumn(id_col, F.col(id_col).cast(kind))
