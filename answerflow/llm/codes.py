"""Vector code compression: product codes over integer vectors, exact throughout.

Components become integers, vectors are cut into equal parts, and each part position gets a
codebook by rounds of assignment and averaging. The nearest entry needs dot products of
integers: they are broken into limbs so short that a float64 matrix product of limbs stays
below 2^53 and is exact, and the products are put together again in int64. The first of the
least distances is the code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerflow.llm.common import join_groups, store

EXACT_BITS = 53  # integers up to 2^53 are exact in float64
ROWS_AT_ONCE = 16_384


def limb_bits(width: int) -> int:
    """Bits a limb may have so that a sum of `width` products of two limbs is at most 2^53."""
    return (EXACT_BITS - max(width - 1, 0).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as limbs of `bits` bits, lowest first, as float64; the last one has the sign."""
    out, rest = [], values
    while rest.size and (rest.max() >= 1 << bits or rest.min() <= -(1 << bits)):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, for int64 matrices whose products fit into int64."""
    bits = limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    rights = limbs(b, bits)
    for i, left in enumerate(limbs(a, bits)):
        for j, right in enumerate(rights):
            total += (left @ right.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first entry of least squared distance, and that distance."""
    squares = np.einsum("ij,ij->i", book, book)
    rest = squares[None, :] - 2 * exact_product(values, book)
    entry = rest.argmin(axis=1)
    return entry, np.einsum("ij,ij->i", values, values) + rest[np.arange(len(values)), entry]


def largest_integer(length: int) -> int:
    """Bound on the integers that keeps the error of a vector of `length` components in int64."""
    return 1 << ((62 - max(length - 1, 0).bit_length()) // 2 - 1)


def edges(length: int, parts: int) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def integer_vectors(vectors: DataFrame, id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """Written rows (id, label, ints) of the vectors kept, and their length."""
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    # NaN is greater than any number, so it fails like an infinite component.
    rows = rows.where(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) * scale < F.lit(float(1 << 31))))
    ).select("id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("ints"))
    written = store(rows, "integers")
    first = written.orderBy(F.col("id").asc_nulls_last(), "ints", F.col("label").asc_nulls_last()).first()
    if first is None:
        return written, 0
    bound = largest_integer(len(first.ints))
    fits = F.forall("ints", lambda x: (x < F.lit(bound)) & (x > F.lit(-bound)))
    return written.where((F.size("ints") == len(first.ints)) & fits), len(first.ints)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def improved(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round. Every task adds up its own parts; the driver gets one sum per
    component of an entry, however many vectors there are."""
    cuts = edges(length, len(books))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                values = matrix(batch.column("ints").slice(at, ROWS_AT_ONCE), length)
                for total, book, (a, b) in zip(sums, books, cuts):
                    entry, _ = nearest(values[:, a:b], book)
                    order = np.argsort(entry, kind="stable")
                    used, starts = np.unique(entry[order], return_index=True)
                    total[used, :-1] += np.add.reduceat(values[order, a:b], starts, axis=0)
                    total[used, -1] += np.bincount(entry, minlength=len(book))[used]
        flat = [(p, e, i, int(v)) for p, t in enumerate(sums) for e, row in enumerate(t) if row[-1] for i, v in enumerate(row)]
        names = ("part", "entry", "place", "value")
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in flat], pa.int32() if i < 3 else pa.int64()) for i in range(4)], names=list(names)
        )

    partial = rows.select("ints").mapInArrow(add, "part int, entry int, place int, value long")
    summed = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = {(r.part, r.entry, r.place): int(r.value) for r in summed.collect()}
    new = [book.copy() for book in books]
    for p, book in enumerate(new):
        for e in range(len(book)):
            count = sums.get((p, e, book.shape[1]), 0)
            if count:
                book[e] = [sums[p, e, i] // count for i in range(book.shape[1])]
    return new


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8,
    entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error, label_error), one per vector kept, and the codebooks.

    A component x becomes floor(scale * x). Codebooks start from the vectors of the smallest
    ids; each of `rounds` rounds assigns every part to its nearest entry (ties: the first) and
    moves each entry to the floored mean of its parts; unused entries stay. `code` holds two
    hexadecimal digits per part, `error` the squared distances summed over the parts,
    `label_error` the errors summed over equal labels. `entries` is at most 256.

    Null vectors and those with null, NaN or infinite components go. So do vectors of another
    length than the one with the smallest id, and those with components so large that squared
    distances would leave 64 bits (with 64 components and scale 4096: 32,768 and more). A length
    that is no multiple of `parts` is cut as evenly as whole numbers allow; empty vectors have
    empty parts and no error. Null ids come after all others; equal ids go by their integers.
    Repeated rows count each. Null labels are one label. With fewer vectors than entries the
    codebooks are shorter; an empty table gives no rows and no codebooks. Other columns, whatever
    their names, don't matter.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows, length = integer_vectors(vectors, id, vector, label, scale)
    cuts = edges(length, parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints", F.col("label").asc_nulls_last()).limit(entries).collect()
    start = np.array([r.ints for r in first], np.int64).reshape(len(first), length)
    books = [start[:, a:b].copy() for a, b in cuts] if first else []
    for _ in range(rounds if first else 0):
        books = improved(rows, books, length)

    kinds = rows.schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                values = matrix(part.column("ints"), length)
                codes = np.empty((len(values), len(cuts)), np.uint8)
                error = np.zeros(len(values), np.int64)
                for p, (a, b) in enumerate(cuts):
                    entry, distance = nearest(values[:, a:b], books[p])
                    codes[:, p] = entry
                    error += distance
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                    names=["id", "label", "code", "error"],
                )

    schema = type(kinds)([kinds["id"], kinds["label"]]).add("code", "string").add("error", "long")
    coded = store(rows.mapInArrow(assign, schema), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_groups(coded, sums, ["label"], "_n").select("id", "label", "code", "error", "label_error"), books
