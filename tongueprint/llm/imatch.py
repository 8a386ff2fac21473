"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms that occur in a chosen band of document frequencies (as shares of all documents): neither the
commonest nor the rare ones. A document keeps its distinct lexicon terms in sorted order; one hash of all of them is the
classic signature, which any change of terms breaks. So it is joined by hashes over random parts of the lexicon: part k of
level l holds each term with probability ``4 ** -l``, and its hash survives unless a term of that part changes. Small parts suit
long documents, large ones short documents. Likeness compares part by part, level by level.

The band bounds the lexicon: a term of at least a share f of all documents takes f documents of the term occurrences
there are, so there are at most (mean distinct terms a document) / f of them, however large the corpus. That is
what is broadcast. Document frequencies count every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.common import map_rows, text_or_empty

TERM = re.compile(r"\w+")
LEVELS = 6
PARTS = 12
LOW, HIGH = 0.0005, 0.1
# A level with fewer filled parts than this has no say of its own.
LEAST_PARTS = 6
HELD = 300_000


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the lexicon's terms."""

    terms: np.ndarray


def term_hashes(text: str, hashes: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of a whole text's lower-cased terms."""
    terms = set(TERM.findall(text.lower()))
    return np.unique(np.fromiter(map(hashes.__getitem__, terms), dtype=np.uint64, count=len(terms)))


class Hashes(dict):
    def __missing__(self, term: str) -> int:
        if len(self) >= HELD:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 1)
        return value


def seeds() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"part {k}", 2) | 1 for k in range(LEVELS * PARTS)], dtype=np.uint64)


SEEDS = seeds()
LIMITS = np.repeat([(1 << 64) // 4**level - 1 for level in range(1, LEVELS + 1)], PARTS).astype(np.uint64)


def signature(text: str, lexicon: np.ndarray, hashes: dict[str, int]) -> tuple[bytes, np.ndarray]:
    """The hash of all lexicon terms, and one 32-bit hash for each part (0: the part has no term of the text).

    A text without lexicon terms uses all its terms; one without any term is known by the hash of the text.
    """
    terms = term_hashes(text, hashes)
    places = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1) if len(lexicon) else None
    kept = terms[lexicon[places] == terms] if places is not None else terms[:0]
    kept = kept if len(kept) else terms
    parts = np.zeros(LEVELS * PARTS, dtype=np.uint32)
    if not len(kept):
        return xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"), 3), parts
    whole = xxhash.xxh64_digest(kept.tobytes(), 3)
    for begin in range(0, len(SEEDS), PARTS):
        mixed = kept[:, None] * SEEDS[None, begin:begin + PARTS]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        inside = mixed <= LIMITS[begin]
        for k in np.flatnonzero(inside.any(0)):
            parts[begin + k] = xxhash.xxh32_intdigest(kept[inside[:, k]].tobytes(), begin + int(k)) or 1
    return whole, parts


def as_text(found: tuple[bytes, np.ndarray]) -> str:
    """32-bit parts after the 64-bit hash of all terms, in lower-case hex."""
    return found[0].hex() + found[1].astype(">u4").tobytes().hex()


def likeness(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> float:
    """1 for equal fingerprints; else the best level's share of equal hashes among parts that either text fills."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    filled = ((a[1] != 0) | (b[1] != 0)).reshape(LEVELS, PARTS).sum(1)
    equal = ((a[1] == b[1]) & (a[1] != 0)).reshape(LEVELS, PARTS).sum(1)
    return float(np.max(equal / np.maximum(filled, LEAST_PARTS)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term long, df long)``: in how many rows each hashed term occurs. Tasks add up what they see before it travels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), Counter()

        def flush() -> pa.RecordBatch:
            terms = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 1) for t in seen), np.uint64, len(seen))
            counts = pa.array(np.fromiter(seen.values(), np.int64, len(seen)))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), counts], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(set(TERM.findall(text.as_py().lower())))
                if len(seen) >= 4 * HELD:
                    yield flush()
                    seen.clear()
        yield flush()
        hashes.clear()

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon_of(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> Lexicon:
    """Terms in at least a share ``low`` and at most a share ``high`` of all rows, and in two rows or more."""
    rows = docs.count()
    band = document_frequencies(docs, text_col).where((F.col("df") >= max(2.0, low * rows)) & (F.col("df") <= max(2.0, high * rows)))
    terms = band.select("term").toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64)
    return Lexicon(np.sort(terms))


def fingerprints(df: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Every row with ``out string``: equal texts have equal fingerprints; a null text counts as empty. Columns stay."""
    df = df.drop(out)
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes), f"`{out}` string"])
    place, shipped = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        terms, hashes = shipped.value.terms, Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [as_text(signature(text.as_py() or "", terms, hashes)) for text in batch.column(place)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

        return step

    return map_rows(df, make, schema)
