"""Token counts of the fields and sections of documents.

A document is its fields one after another, each followed by a separator but the last. It is encoded once, whole,
since cutting it first would change the tokens. Every token covers a span of characters, every section another; both
lists are sorted, so joining them is one binary search per token edge. A token that crosses a boundary is given away by
one of three rules:

* ``start``: to the section of its first character,
* ``most``: to the section with most of its bytes, the earlier one if equal,
* ``share``: to each section in proportion to its bytes.

Counts of a document's sections add up to its tokens under every rule.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.bpe import PIECES
from tongueprint.llm.common import map_rows, text_or_empty

RULES = ("start", "most", "share")
COLUMNS = ("field", "section", "start", "end", "n_tokens", "n_crossing")


@lru_cache(maxsize=2)
def load(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the bytes in each token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(edges: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross out of or into it.

    ``edges`` are the byte offsets where sections begin, then the size of the document; ``ends`` those where tokens end.
    """
    sections = len(edges) - 1
    if not len(ends):
        return np.zeros(sections), np.zeros(sections, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(edges, starts, side="right") - 1
    final = np.searchsorted(edges, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != final)
    counts = np.bincount(first, minlength=sections).astype(float)
    touched = np.zeros(sections, dtype=np.int64)
    for token in crossing:
        inside = np.arange(first[token], final[token] + 1)
        covered = np.minimum(edges[inside + 1], ends[token]) - np.maximum(edges[inside], starts[token])
        touched[inside[covered > 0]] += 1
        if rule == "most":
            counts[first[token]] -= 1
            counts[inside[np.argmax(covered)]] += 1
        elif rule == "share":
            counts[first[token]] -= 1
            counts[inside] += covered / (ends[token] - starts[token])
    return counts, touched


def section_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", fields: Sequence[str] = ("text",), by_line: bool = True,
    rule: str = "start", separator: str = " ",
) -> DataFrame:
    """``(id, field, section, start, end, n_tokens, n_crossing)``: a row for each section of each row of ``df``.

    Sections are the lines of each field, or whole fields; a line keeps its break, a field its separator. ``start`` and ``end`` count
    characters of the joined document, ``section`` from 0 within the field. Null and empty fields are one section
    that holds just their separator. Repeated rows and null ids each give rows of their own; columns that
    are not named are ignored. An id column named like one of the others is returned as that name with ``_id`` behind it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    kind = dict(df.dtypes)[id_col]
    own = f"{id_col}_id" if id_col.lower() in COLUMNS else id_col
    picked = df.select(F.col(id_col).alias("id"), *[text_or_empty(c).cast("string").alias(f"f{i}") for i, c in enumerate(names)])
    schema = f"`{own}` {kind}, field string, section int, start long, `end` long, n_tokens double, n_crossing long"

    def make():
        encoding, sizes = load(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = batch.column(0), list(zip(*[batch.column(1 + i).to_pylist() for i in range(len(names))]))
            owner, field_of, number, begins, finish, tokens, cross = [], [], [], [], [], [], []
            for row, texts in enumerate(rows):
                whole = separator.join(texts)
                lines, origin = [], []
                for place, text in enumerate(texts):
                    ended = text + separator if place + 1 < len(texts) else text
                    cuts = split_lines(ended) if by_line else [ended]
                    lines.extend(cuts)
                    origin.extend((place, n) for n in range(len(cuts)))
                byte_edges = np.cumsum([0, *(len(line.encode()) for line in lines)])
                char_edges = np.cumsum([0, *map(len, lines)])
                ends = np.cumsum(sizes[encoding.encode_to_numpy(whole, disallowed_special=())])
                counts, touched = attribute(byte_edges, ends, rule)
                owner.append(np.full(len(lines), row))
                field_of.extend(names[place] for place, _ in origin)
                number.extend(n for _, n in origin)
                begins.append(char_edges[:-1])
                finish.append(char_edges[1:])
                tokens.append(counts)
                cross.append(touched)
            joined = lambda parts, t: np.concatenate([*parts, []]).astype(t)
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(joined(owner, np.int64))), pa.array(field_of, pa.string()), pa.array(number, pa.int32()),
                 pa.array(joined(begins, np.int64)), pa.array(joined(finish, np.int64)), pa.array(joined(tokens, float)),
                 pa.array(joined(cross, np.int64))],
                names=[own, *COLUMNS],
            )

        return step

    return map_rows(picked, make, schema)


def split_lines(text: str) -> list[str]:
    """Lines with their breaks; a text that ends in a break has no empty line after it."""
    lines = [line + "\n" for line in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] or len(lines) == 1 else lines[:-1]
