"""SimHash near-duplicates: candidates by chains of fingerprint segments (pigeonring), then the
full Hamming check.

A fingerprint is cut into `bits + 1` segments in a ring. If two fingerprints differ in at most
`bits` places, some segment starts a chain in which the first one is equal, the first two
differ in at most floor(2 * bits / (bits + 1)) places, and so on: the differences of every
prefix of the chain stay within its share of the budget. Chains of two segments are the
candidate key: equal in the first, at most one place different in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from answerflow.llm.common import shuffle_width, store
from answerflow.llm.components import components, stars

WIDTH = 64
# Fingerprints with one key that one task compares with each other; more are dealt to several.
IN_ONE_TASK = 4_000
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words, repeats included; of all words if
    there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if more than half of the hashes have it; without words the fingerprint is 0."""
    hashes = shingle_hashes(text or "", shingle)
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return int(value.astype(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fingerprint") -> DataFrame:
    """The rows of `docs` with their fingerprint as a signed 64-bit number in place of `text`."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = type(docs.schema)(kept).add(name, "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch[text]]
            yield batch.drop(columns=[text]).assign(**{name: np.array(values, np.int64)})

    return docs.mapInPandas(run, schema)


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, length) of `count` nearly equal segments of a fingerprint."""
    edges = [round(i * WIDTH / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_keys(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, rows, stored) of every chain start: the key a fingerprint is stored under, and the
    keys under which it looks for others.

    Two fingerprints that differ in one place of the second segment meet because the one
    with the 0 there looks under the key with a 1.
    """
    ring = segments(bits + 1)
    prints = prints.astype(np.uint64)
    rows = np.arange(len(prints))
    slack = 2 * bits // (bits + 1)
    for i, (at, size) in enumerate(ring):
        first = (prints >> np.uint64(at)) & np.uint64((1 << size) - 1)
        key = (np.uint64(i) << np.uint64(58)) ^ first
        at2, size2 = ring[(i + 1) % len(ring)]
        second = (prints >> np.uint64(at2)) & np.uint64((1 << size2) - 1)
        # Bits may fall out at the top for few segments; the Hamming check follows anyway.
        shift = np.uint64(size)
        exact = key ^ (second << shift)
        yield exact, rows, True
        yield exact, rows, False
        if slack:
            for bit in range(size2):
                flip = np.uint64(1 << bit)
                zero = np.flatnonzero((second & flip) == 0)
                yield key[zero] ^ ((second[zero] | flip) << shift), zero, False


def links_between(prints: DataFrame, bits: int, name: str = "fingerprint") -> DataFrame:
    """Links (a, b) that connect the same distinct fingerprints as all pairs within `bits`.

    Fingerprints come once each, so copies are no pairs. Keys under which many are stored are
    dealt to several tasks: the stored ones are split, those that look are sent to each part.
    A task returns, for what it has compared, a link from each fingerprint to the smallest one
    connected, so the rows never outgrow its input.
    """
    if bits == 0:
        return prints.select(F.col(name).alias("a"), F.col(name).alias("b")).where("a <> b")
    if bits > 30:
        raise ValueError("bits must be at most 30")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[name].to_numpy(np.int64)
            for at in range(0, len(values), 20_000):
                part = values[at : at + 20_000]
                for keys, rows, stored in chain_keys(part, bits):
                    yield pd.DataFrame({"key": keys.astype(np.int64), "print": part[rows], "stored": stored})

    spark = prints.sparkSession
    rows = store(prints.select(name).mapInPandas(spread, "key long, print long, stored boolean"), "chains")
    crowded = (
        rows.where("stored").groupBy("key").count().where(F.col("count") > IN_ONE_TASK)
        .select("key", F.ceil(F.col("count") / IN_ONE_TASK).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    one = F.array(F.pmod(F.xxhash64("print"), parts).cast("int"))
    dealt = (
        rows.join(crowded, "key", "left")
        .withColumn("part", F.explode(F.when(F.col("stored"), one).otherwise(F.sequence(F.lit(0), parts - 1))))
        .drop("parts")
        .repartition(shuffle_width(spark), "key", "part")
        .sortWithinPartitions("key", "part", F.desc("stored"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches):
            found_a, found_b = [], []
            for x, y in stored_pairs(group):
                near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits
                near &= x != y
                a, b = stars(x[near], y[near])
                found_a.append(a)
                found_b.append(b)
            if found_a:
                a, b = stars(np.concatenate(found_a), np.concatenate(found_b))
                yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(compare, "a long, b long")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, part), cut so that what is stored under a key is always in the same
    frame as those that look there."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = (batch["key"].to_numpy() == batch["key"].iloc[-1]) & (batch["part"].to_numpy() == batch["part"].iloc[-1])
        start = int(np.argmax(last))
        if start:
            yield batch.iloc[:start]
        tail = batch.iloc[start:]
        if len(tail) > 10 * IN_ONE_TASK:
            # Many look under one key: done with these, only the stored ones are kept.
            yield tail
            tail = tail[tail["stored"]]
        held = tail
    if held is not None and len(held):
        yield held


def stored_pairs(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (looking, stored) pair of a key, some at a time."""
    key, part = group["key"].to_numpy(), group["part"].to_numpy()
    prints, stored = group["print"].to_numpy(), group["stored"].to_numpy()
    new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.bincount(number, weights=stored, minlength=len(first)).astype(np.int64)
    look = np.flatnonzero(~stored)
    width = count[number[look]]
    look, width = look[width > 0], width[width > 0]
    upto = np.cumsum(width)
    at = 0
    while at < len(look):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
        w = width[at:end]
        starts = np.cumsum(w) - w
        inner = np.arange(w.sum()) - np.repeat(starts, w)
        other = np.repeat(first[number[look[at:end]]], w) + inner
        yield np.repeat(prints[look[at:end]], w), prints[other]
        at = end


def groups(docs: DataFrame, id: str, text: str, shingle: int, bits: int) -> DataFrame:
    """One row per row of `docs`: doc_id, mark (hash of the text), fingerprint, component (the
    smallest fingerprint of the group) and component_id (its smallest id)."""
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    rows = store(fingerprints(rows, "text", shingle), "fingerprints")
    prints = store(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("lowest")), "prints")
    linked = components(links_between(prints, bits))
    named = prints.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "lowest", F.coalesce("component", "fingerprint").alias("component")
    )
    named = store(named, "named")
    smallest = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    return rows.join(named.join(smallest, "component").drop("lowest"), "fingerprint")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """One row per row of `docs`: its id as `doc_id`, `fingerprint` (a signed 64-bit number) and
    `component_id`, the smallest id reachable over fingerprints within `bits` bits.

    Null or empty text has no words and the fingerprint 0, which links like any other. Rows
    without an id are grouped like others but name no group; a group of such rows only has a
    null component. Repeated rows come back as often as they are there. Other columns of
    `docs` are not looked at. An empty table gives an empty result.
    """
    return groups(docs, id, text, shingle, bits).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The rows and columns of `docs`, one row of each group of near-duplicates: the one with the
    smallest id (rows without an id last, ties by the hash of the text, any of equal ones)."""
    found = groups(docs, id, text, shingle, bits)
    same = found.groupBy("component", F.col("doc_id").isNull().alias("none"), "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    best = store(same.groupBy("component").agg(F.min(F.struct("none", "doc_id", "mark", "n")).alias("best")).select("best.*"), "best")
    rows = docs.select(
        F.col(id).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )

    def chosen(which: str) -> DataFrame:
        few = best.where(which).select(F.col("doc_id").alias("best_id"), F.col("mark").alias("best_mark"))
        return rows.join(few, F.col("key").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark")), "left_semi")

    # Only rows that are there more than once have to meet again.
    kept = chosen("n = 1").unionAll(chosen("n > 1").dropDuplicates(["key", "mark"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def hex_digits(fingerprint: str) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
