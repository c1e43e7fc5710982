"""Packing documents into sequences: cutting stock by column generation.

Documents are tokenized and cut where a sequence is full; what remains is counted by length. A
linear program over patterns (which lengths share a sequence) is solved on that histogram:
knapsack dynamic programming prices new patterns until none helps. Patterns are used as often as
the rounded-down solution says, what is left over is packed by decreasing length, and the pieces,
ranked within their length, take the places of the patterns.

The driver sees only the histogram, which has as many rows whatever the number of documents.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from answerflow.llm.common import numbered, store

# Lengths are counted in this many steps of a sequence.
STEPS = 256
# The linear program ends within this share of its bound.
GAP = 5e-4
# New words after which a worker forgets those it no longer meets.
KNOWN_WORDS = 800_000
TOKEN = 4  # bytes

_tokenizers: dict[int, "Words"] = {}


class Words(dict):
    """Ids of words as bytes, found when first asked for. Those not asked for in the last
    KNOWN_WORDS new ones are forgotten."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            ids = self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        self[word] = found
        return found

    def make_room(self) -> None:
        if len(self) > KNOWN_WORDS:
            self.before = dict(self)
            self.clear()


def word_ids(definition: str) -> Words:
    """The words of a tokenizer that this worker knows."""
    key = zlib.crc32(definition.encode())
    if key not in _tokenizers:
        _tokenizers[key] = Words(definition)
    return _tokenizers[key]


def token_bytes(texts: list[str], definition: str, end: int) -> Iterator[bytes]:
    """Per text its ids and the end id, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token goes across it, so the ids of a text are those
    of its words, and a word is encoded once.
    """
    known = word_ids(definition)
    last = array("I", [end]).tobytes()
    for text in texts:
        yield b"".join(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split())) + last
        known.make_room()


def pieces(docs: DataFrame, definition: str, length: int, end: int, keep_ids: bool) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens (and ids) from rows id, text."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    schema = schema.replace("doc_id long", f"doc_id {docs.schema['id'].dataType.simpleString()}")
    step = length * TOKEN

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            for at in range(0, len(texts), 500):
                out = []
                for id, ids in zip(batch["id"].iloc[at : at + 500], token_bytes(texts[at : at + 500], definition, end)):
                    for a in range(0, len(ids), step):
                        part = ids[a : a + step]
                        row = (id, a // TOKEN, len(part) // TOKEN, zlib.crc32(part), len(ids) // TOKEN)
                        out.append((*row, part) if keep_ids else row)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
                frame = pd.DataFrame(out, columns=names)
                if batch["id"].dtype.kind in "fO" and schema.startswith("doc_id bigint"):
                    frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return docs.mapInPandas(cut, schema)


def best_pattern(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total worth that fits: how often each size is in it (knapsack by
    dynamic programming over the room)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        best[room], pick[room] = best[room - 1], -1
        if fits:
            totals = best[room - sizes[:fits]] + worth[:fits]
            i = int(totals.argmax())
            if totals[i] > best[room] + 1e-12:
                best[room], pick[room] = totals[i], i
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often the linear program uses each.

    Revised simplex: the basis starts with one size per pattern; the dual prices of the basis
    are the worth of the sizes, the best pattern at these prices enters. Value over the
    entering pattern's price bounds the optimum from below.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ demand
    for _ in range(50 * n):
        worth = inverse.sum(axis=0)
        value, entering = best_pattern(worth, sizes, capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ entering
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        used = used - theta * direction
        used[out] = theta
        basis[:, out] = entering
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return basis.T.round().astype(np.int64), np.maximum(used, 0)


@dataclass
class Layout:
    """Places for pieces: place `rank` of a size belongs to the last run that starts at or before
    it; a run has `each` places per sequence, from sequence `first` on."""

    size: np.ndarray
    start: np.ndarray
    each: np.ndarray
    first: np.ndarray

    def sequence(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (self.size.astype(np.int64) << 48) | self.start
        run = np.searchsorted(key, (size.astype(np.int64) << 48) | rank, side="right") - 1
        return self.first[run] + (rank - self.start[run]) // self.each[run]


def layout(histogram: dict[int, int], capacity: int) -> Layout:
    """Whole patterns from the linear program; the rest by decreasing size into the fullest
    sequence that has room. The rest is at most one sequence per pattern."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, used = solve(sizes, demand.astype(float), capacity) if len(sizes) else (np.empty((0, 0), np.int64), [])
    left = demand.copy()
    chosen: list[tuple[np.ndarray, int]] = []
    for pattern, times in sorted(zip(patterns, used), key=lambda x: -x[1]):
        # A pattern may hold more of a size than is left of it.
        has = pattern > 0
        whole = int(min(np.floor(times + 1e-6), (left[has] // pattern[has]).min())) if has.any() else 0
        if whole > 0:
            chosen.append((pattern, whole))
            left -= pattern * whole
    while left.any():
        # Filled greedily; repeated as often as the sizes in it allow.
        room, counts = capacity, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            counts[i] = min(left[i], room // sizes[i])
            room -= counts[i] * sizes[i]
        whole = int((left[counts > 0] // counts[counts > 0]).min())
        chosen.append((counts, whole))
        left -= counts * whole
    at, first, runs = np.zeros(len(sizes), np.int64), 0, []
    for pattern, times in chosen:
        for i in np.flatnonzero(pattern):
            runs.append((sizes[i], at[i], pattern[i], first))
            at[i] += pattern[i] * times
        first += times
    runs.sort()
    return Layout(*(np.array([r[j] for r in runs], np.int64) for j in range(4)))


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", *, length: int = 4096, end: int = 2, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (CRC-32
    of the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset in its
    sequence (from 0, without gaps), and with `keep_ids` the ids in that form.

    `tokenizer` is the path of a definition that the driver can read. Null or empty text is the
    end id alone. Long documents are cut into full sequences and a rest, so every id is in one
    piece. Repeated rows and rows without an id are packed like any other. Extra columns are
    not looked at. An empty table gives an empty result.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    step = -(-length // STEPS)
    capacity = length // step
    cut = pieces(rows, definition, length, end, keep_ids)
    size = F.least(F.ceil(F.col("length") / step), F.lit(capacity)).cast("int")
    cut = store(cut.withColumn("size", size).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    counted = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}
    places = layout(counted, capacity)
    narrow = cut.drop("ids")
    ranked = numbered(narrow, ["size"], ["length", "doc_id", "start", "piece"], "rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = places.sequence(batch["size"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64))
            yield batch.drop(columns=["rank"]).assign(sequence_id=found)

    placed = ranked.mapInPandas(place, narrow.schema.add("sequence_id", "long"))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("size"), F.desc("length"), "piece").rowsBetween(W.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    if keep_ids:
        packed = packed.join(cut.select("piece", "ids"), "piece")
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *(["ids"] if keep_ids else []),
    )
