"""Counts of character n-grams by Arrow batches: windows over code points are packed into numbers, then sorted and counted.

It counts what ``explode_grams`` unfolds from the words of a lower-cased text, without a row or a string per occurrence: an n-gram
becomes a string, or is hashed, once per piece of a batch. Pieces have some ``PIECE`` characters, so memory does not grow with a text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.functions.text import WHITESPACE_CHARS

# Characters counted at a time.
PIECE = 400_000
# Buckets of n-grams a task remembers.
REMEMBERED = 1_000_000
BLANK = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WHITESPACE_CHARS) + "]")
# Kinds of numbers: that of the blank around words is 0.
_CODES = np.array([c for c in range(0x3001) if BLANK.fullmatch(chr(c))])
BEGINS = "_begins"


class Counts:
    """What the n-grams of some groups of texts are: ``group``, place of the feature in ``values``, and how often."""

    def __init__(self, group: np.ndarray, place: np.ndarray, times: np.ndarray, values: pa.Array | None):
        self.group, self.place, self.times, self.values = group, place, times, values

    def features(self) -> pa.Array:
        return pa.array(self.place, pa.int64()) if self.values is None else self.values.take(pa.array(self.place))


class GramCounter:
    """Counts by one or several settings; buckets that are not portable are left to the caller, as n-grams."""

    def __init__(self, specs: Sequence[GramSpec]):
        self.specs, self.known = list(specs), {}

    def count(self, texts: list[str], groups: Sequence[int]) -> list[Counts]:
        """Counts of each setting, by group, then feature. ``groups`` says to which group a text belongs; they ascend."""
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        # Each text after a blank of its own, and one more at the end: the blanks around its words.
        joined = " " + " ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seen = np.bincount(codes)
        seen[_CODES[_CODES < len(seen)]] = 0
        letters = np.flatnonzero(seen)
        bits = int(len(letters)).bit_length()
        highest = max(s.hi for s in self.specs)
        if bits * highest + 1 > 62:
            return [self.one_by_one(texts, groups, spec) for spec in self.specs]
        number = np.zeros(len(seen), np.int64)
        number[letters] = np.arange(1, len(letters) + 1)
        chars = number[codes]
        owner = np.repeat(np.asarray(groups, np.int64), lengths)
        owner = np.append(owner, owner[-1] if len(owner) else 0)
        blank = chars == 0
        last = len(chars) - 1
        upcoming = np.where(blank, np.arange(len(chars)), last)
        following = np.minimum.accumulate(upcoming[::-1])[::-1]
        # How far it is from a place to the next blank behind it; the last blank has none.
        reach = np.append(following[1:], last) - np.arange(len(chars))
        starts, packed = {}, {}
        rolling = np.ones(len(chars), np.int64)
        for n in range(1, highest + 1):
            ahead = chars[n - 1:]
            rolling = (rolling[:len(ahead)] << bits) | ahead
            fits = reach[:len(ahead)] >= n - 1
            if n == 1:
                words = np.flatnonzero(blank[:-1] & ~blank[1:])
                places = np.concatenate([np.flatnonzero(~blank), words, words])
            elif n == 2:
                places = np.flatnonzero(fits & ~(blank[:len(ahead)] & blank[1:]))
            else:
                places = np.flatnonzero(fits)
            starts[n], packed[n] = places, rolling[places]
            whole = np.flatnonzero(blank[:len(ahead)] & (reach[:len(ahead)] == n - 1)) if n > 2 else places[:0]
            starts[-n], packed[-n] = whole, rolling[whole]
        # Sizes of the settings; a negative one stands for whole padded words of that size.
        picks = [[*range(s.lo, s.hi + 1), *(-n for n in range(3, s.lo))] for s in self.specs]
        sizes = sorted({n for pick in picks for n in pick})
        places, distinct = pd.factorize(np.concatenate([packed[n] for n in sizes]))
        ends = np.cumsum([len(packed[n]) for n in sizes])
        part = {n: slice(end - len(packed[n]), end) for n, end in zip(sizes, ends)}
        grams = unpack(distinct, letters, bits, highest)
        out = []
        for spec, pick in zip(self.specs, picks):
            place = np.concatenate([places[part[n]] for n in pick])
            group = np.concatenate([owner[starts[n]] for n in pick])
            values, size = None, len(distinct)
            if self.hashes(spec):
                place, size = self.buckets(grams, spec)[place], spec.buckets
            else:
                values = pa.array(grams, pa.string())
            out.append(counted(group * max(1, size) + place, max(1, size), values))
        return out

    @staticmethod
    def hashes(spec: GramSpec) -> bool:
        return bool(spec.buckets) and spec.portable

    def buckets(self, grams: list[str], spec: GramSpec) -> np.ndarray:
        known = self.known.setdefault(spec.buckets, {})
        if len(known) > REMEMBERED:
            known.clear()
        for gram in grams:
            if gram not in known:
                known[gram] = int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()[:4], "big") % spec.buckets
        return np.fromiter((known[g] for g in grams), np.int64, len(grams))

    def one_by_one(self, texts: list[str], groups: Sequence[int], spec: GramSpec) -> Counts:
        """The same for more letters or longer n-grams than a number holds."""
        found: Counter = Counter()
        for text, group in zip(texts, groups):
            for word in BLANK.split(text):
                padded = f" {word} "
                if word and len(padded) < spec.lo:
                    found[group, padded] += 1
                elif word:
                    found.update((group, padded[i:i + n]) for n in range(spec.lo, spec.hi + 1) for i in range(len(padded) - n + 1))
        grams = sorted({g for _, g in found})
        place = {g: i for i, g in enumerate(grams)}
        size, values = max(1, len(grams)), pa.array(grams, pa.string())
        if self.hashes(spec):
            place, size, values = dict(zip(grams, self.buckets(grams, spec).tolist())), spec.buckets, None
        keys = np.fromiter((group * size + place[g] for group, g in found), np.int64, len(found))
        return counted(keys, size, values, np.fromiter(found.values(), np.int64, len(found)))


def counted(keys: np.ndarray, size: int, values: pa.Array | None, times: np.ndarray | None = None) -> Counts:
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    totals = np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(np.append(times, 0), first) if len(first) else first
    return Counts(keys[first] // size, keys[first] % size, totals, values)


def unpack(packed: np.ndarray, letters: np.ndarray, bits: int, highest: int) -> list[str]:
    """N-grams of their numbers: a leading 1, then ``bits`` for each letter."""
    alphabet = np.concatenate([[32], letters]).astype("<u4")
    out = np.empty(len(packed), object)
    for n in range(1, highest + 1):
        own = np.flatnonzero((packed >> (bits * n)) == 1) if len(packed) else packed
        if bits == 0 or not len(own):
            continue
        digits = (packed[own, None] >> (bits * np.arange(n - 1, -1, -1))) & ((1 << bits) - 1)
        text = alphabet[digits].tobytes().decode("utf-32-le", "surrogatepass")
        out[own] = [text[i:i + n] for i in range(0, len(text), n)]
    return out.tolist()


def portions(texts: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """``(row, text)`` in lists of about ``PIECE`` characters; a longer text is cut between words."""
    held, room = [], PIECE
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > room:
            cut = BLANK.search(text, at + room)
            if cut is None:
                break
            held.append((row, text[at:cut.start()]))
            at = cut.end()
            yield held
            held, room = [], PIECE
        held.append((row, text[at:] if at else text))
        room -= len(text) - at + 1
        if room <= 0:
            yield held
            held, room = [], PIECE
    if held:
        yield held


def feature_field(specs: Sequence[GramSpec]) -> str:
    return "bigint" if all(GramCounter.hashes(s) for s in specs) else "string"


def text_counts(texts: DataFrame, specs: Sequence[GramSpec], column: str) -> DataFrame:
    """``(other columns, _model, feature, _tf)`` of lower-cased texts in ``column``, and one row with a null feature per text and setting.

    ``feature`` is a bucket if all settings have portable ones; otherwise buckets are written out and other features are n-grams.
    A long text may have several rows of one feature.
    """
    others = [c for c in texts.columns if c != column]
    kind = feature_field(specs)
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in texts.select(*others).dtypes), "_model int", f"feature {kind}", "_tf bigint"])
    wanted = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter(specs)
        for batch in batches:
            kept, values = batch.select(others), batch.column(column).to_pylist()
            done = -1
            for portion in portions(values):
                rows = np.array([r for r, _ in portion])
                new = np.unique(rows[rows > done])
                done = int(rows[-1])
                for model, counts in enumerate(counter.count([t for _, t in portion], rows)):
                    at = pa.array(np.concatenate([counts.group, new]))
                    features = pa.concat_arrays([counts.features().cast(wanted), pa.nulls(len(new), wanted)])
                    columns = [pa.array(np.full(len(at), model), pa.int32()), features, pa.array(np.append(counts.times, np.zeros(len(new), np.int64)), pa.int64())]
                    taken = kept.take(at) if others else None
                    yield pa.RecordBatch.from_arrays([*(taken.columns if others else []), *columns], names=[*others, "_model", "feature", "_tf"])

    return texts.mapInArrow(run, schema)


class Vocabulary:
    """Some n-grams with a value each, found by number: 16 bytes an n-gram in every task it is sent to.

    ``packable`` says whether the letters are so few that the numbers are whole; otherwise it finds nothing and is not to be used.
    """

    def __init__(self, grams: Sequence[str], values: np.ndarray, highest: int):
        self.highest = highest
        codes, lengths = self.codes(grams)
        inside = np.arange(highest) < lengths[:, None]
        self.letters = np.unique(codes[inside])
        self.bits = int(len(self.letters)).bit_length()
        self.packable = self.bits * highest + 1 <= 62
        keys = self.packed(grams) if self.packable else np.zeros(0, np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[self.order], np.asarray(values)[self.order] if self.packable else values

    def codes(self, grams: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, grams), np.int64, len(grams))
        # What follows the end of an n-gram is 0 here, but so may be a letter: the lengths tell.
        return np.array(grams, f"<U{self.highest}").view("<u4").reshape(len(grams), self.highest), lengths

    def packed(self, grams: Sequence[str]) -> np.ndarray:
        """A leading 1, then the numbers of the letters; -1 if one of them is in no n-gram of the vocabulary."""
        codes, lengths = self.codes(grams)
        keys = np.ones(len(grams), np.int64)
        for place in range(self.highest):
            own = place < lengths
            at = np.searchsorted(self.letters, codes[:, place])
            known = at < len(self.letters)
            known[known] = self.letters[at[known]] == codes[known, place]
            keys = np.where(own, np.where(known & (keys > 0), (keys << self.bits) | (at + 1), -1), keys)
        return keys

    def find(self, grams: Sequence[str]) -> np.ndarray:
        """Where in ``values`` each of the n-grams is, or -1."""
        if not len(grams) or not len(self.keys):
            return np.full(len(grams), -1)
        wanted = self.packed(grams)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


class Groups:
    """Finished counts as they are made: ``(feature, row, times)`` of whole groups, ``row`` being a row of the batch for each feature."""

    def __init__(self, spec: GramSpec):
        self.counter, self.open, self.first = GramCounter([spec]), [], None

    def of(self, batch: pa.RecordBatch, column: str, others: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """``(other columns, rows in them, values, places in the values, times)``, groups one after the other."""
        kept, begins = batch.select(others), np.asarray(batch.column(BEGINS).to_numpy(zero_copy_only=False), bool)
        done = -1
        for portion in portions(batch.column(column).to_pylist()):
            rows = np.array([r for r, _ in portion])
            fresh = begins[rows] & (rows > done) & np.append(True, rows[1:] != rows[:-1])
            done = int(rows[-1])
            group = np.cumsum(fresh)
            # Group 0, if any, goes on from before; the last one may go on later.
            row_of = np.zeros(group[-1] + 1, np.int64)
            row_of[group[::-1]] = rows[::-1]
            (counts,) = self.counter.count([t for _, t in portion], group)
            values = counts.values
            edges = np.searchsorted(counts.group, [1, group[-1]])
            head, last = int(edges[0]), int(max(edges))
            part = lambda a, b: (counts.features().slice(a, b - a), counts.times[a:b])
            self.open.append(part(0, head))
            if group[-1] > 0:
                yield from self.rest()
                if last > head:
                    if values is None:
                        values, places = counts.features().slice(head, last - head), np.arange(last - head)
                    else:
                        places = counts.place[head:last]
                    yield kept, row_of[counts.group[head:last]], values, places, counts.times[head:last]
                self.open, self.first = [part(last, len(counts.group))], kept.slice(int(row_of[-1]), 1)
            else:
                self.first = kept.slice(int(row_of[0]), 1) if self.first is None else self.first
                if len(self.open) > 16:
                    self.open = [self.joined()]

    def joined(self) -> tuple[pa.Array, np.ndarray]:
        features = pa.chunked_array([f for f, _ in self.open]).combine_chunks().dictionary_encode()
        if isinstance(features, pa.ChunkedArray):
            features = features.combine_chunks()
        times = np.concatenate([t for _, t in self.open])
        return features.dictionary, np.bincount(np.asarray(features.indices), weights=times, minlength=len(features.dictionary)).astype(np.int64)

    def rest(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """The group that is still open, as the last of its task or because another one begins."""
        if any(len(t) for _, t in self.open):
            values, times = self.joined()
            yield self.first, np.zeros(len(times), np.int64), values, np.arange(len(times)), times
        self.open = []


def in_groups(rows: DataFrame, spec: GramSpec, column: str, made, schema: str) -> DataFrame:
    """``made`` of each list of finished groups. Groups lie together; ``_begins`` is true in their first row."""
    others = [c for c in rows.columns if c not in (column, BEGINS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(spec)
        for batch in batches:
            for some in groups.of(batch, column, others):
                yield made(*some)
        for some in groups.rest():
            yield made(*some)

    return rows.mapInArrow(run, schema)


def grouped_columns(rows: DataFrame, column: str) -> tuple[list[str], str]:
    others = [c for c in rows.columns if c not in (column, BEGINS)]
    return others, "".join(f"`{c.replace('`', '``')}` {t}, " for c, t in rows.select(*others).dtypes)


def grouped_counts(rows: DataFrame, spec: GramSpec, column: str) -> DataFrame:
    """``(other columns, feature, tf)``: one row per group and feature. Groups lie together; ``_begins`` is true in their first row.

    What is kept of an unfinished group are its counts.
    """
    others, fields = grouped_columns(rows, column)

    def made(kept: pa.RecordBatch, at: np.ndarray, values: pa.Array, places: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        columns = kept.take(pa.array(at)).columns if others else []
        return pa.RecordBatch.from_arrays([*columns, values.take(pa.array(places)), pa.array(times, pa.int64())], names=[*others, "feature", "tf"])

    return in_groups(rows, spec, column, made, f"{fields}feature {feature_field([spec])}, tf bigint")


def group_frequencies(rows: DataFrame, spec: GramSpec, column: str) -> DataFrame:
    """``(feature, df)``: in how many groups a feature is, added up over the groups counted together; a feature has several rows."""
    def made(kept: pa.RecordBatch, at: np.ndarray, values: pa.Array, places: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        found = np.bincount(places, minlength=len(values))
        some = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([values.take(pa.array(some)), pa.array(found[some], pa.int64())], names=["feature", "df"])

    return in_groups(rows, spec, column, made, f"feature {feature_field([spec])}, df bigint")


def grouped_weights(rows: DataFrame, spec: GramSpec, column: str, vocabulary, most: int | None = None) -> DataFrame:
    """``(other columns, feature, tf, weight)`` of the n-grams in a broadcast ``Vocabulary`` of idf values, each group scaled to length 1.

    With ``most`` only the largest weights of a group are given: at least that many, and all that are the same as one of them up to 1e-6.
    """
    others, fields = grouped_columns(rows, column)

    def made(kept: pa.RecordBatch, at: np.ndarray, values: pa.Array, places: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        known = vocabulary.value.find(values.to_pylist())
        counted = known[places] >= 0
        at, places, times = at[counted], places[counted], times[counted]
        raw = times * (vocabulary.value.values[known[places]] if len(places) else np.zeros(0))
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(at)))
        weight = raw / np.repeat(np.sqrt(np.add.reduceat(raw * raw, begins)), sizes) if len(at) else raw
        if most is not None and len(at):
            order = np.lexsort((-weight, np.repeat(np.arange(len(begins)), sizes)))
            least = weight[order[begins + np.minimum(sizes, most) - 1]] - 2e-6
            large = np.flatnonzero(weight >= np.repeat(least, sizes))
            at, places, times, weight = at[large], places[large], times[large], weight[large]
        columns = kept.take(pa.array(at)).columns if others else []
        return pa.RecordBatch.from_arrays(
            [*columns, values.take(pa.array(places)), pa.array(times, pa.int64()), pa.array(weight)], names=[*others, "feature", "tf", "weight"]
        )

    return in_groups(rows, spec, column, made, f"{fields}feature {feature_field([spec])}, tf bigint, weight double")


def text_vectors(rows: DataFrame, spec: GramSpec, column: str, vocabulary) -> DataFrame:
    """``(other columns, ids array<int>, xs array<double>)``: a row for each row, with the places in a broadcast ``Vocabulary`` of idf
    values of the n-grams its text has, in order, and their weights, scaled to length 1. A text without any has empty arrays."""
    others, fields = grouped_columns(rows, column)

    def vector(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        raw = np.bincount(back, np.concatenate([t for _, t in parts]), len(ids)) * (vocabulary.value.values[ids] if len(ids) else 0.0)
        return ids, raw / (np.sqrt(np.dot(raw, raw)) if len(ids) else 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter([spec])
        for batch in batches:
            kept, held = batch.select(others), {}

            def made(some: list[int]) -> pa.RecordBatch:
                vectors = [vector(held.pop(r)) for r in some]
                ends = pa.array(np.cumsum([0, *(len(ids) for ids, _ in vectors)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([v[i] for v in vectors]), kind)) for i, kind in ((0, pa.int32()), (1, pa.float64()))]
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(some, pa.int64())).columns, *lists], names=[*others, "ids", "xs"])

            for portion in portions(batch.column(column).to_pylist()):
                own = np.array([r for r, _ in portion])
                (counts,) = counter.count([t for _, t in portion], own)
                known = vocabulary.value.find((counts.features() if counts.values is None else counts.values).to_pylist())
                places = known[counts.place if counts.values is not None else np.arange(len(counts.place))]
                for r in np.unique(own).tolist():
                    a, b = np.searchsorted(counts.group, [r, r + 1])
                    some = places[a:b] >= 0
                    held.setdefault(r, []).append((places[a:b][some], counts.times[a:b][some]))
                # A long text may go on in the next portion.
                if finished := [r for r in sorted(held) if r < own[-1]]:
                    yield made(finished)
            if held:
                yield made(sorted(held))

    return rows.mapInArrow(run, f"{fields}ids array<int>, xs array<double>")


def lowered(text: str):
    return F.lower(F.coalesce(F.col(text), F.lit("")))
