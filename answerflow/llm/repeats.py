"""Passages that an earlier document already has: relative Lempel-Ziv parsing.

Documents are factored greedily against reference blocks: a factor is the longest run of words
that occurs in the block. A factor of at least `window` words is a repeated span; a window that
is cut by the boundary of two factors is looked up there. A window of a document can only occur
in a block that holds the window's anchor, its run of `anchor` words with the smallest hash, so
a document visits just the blocks of its anchors: texts are cut into pieces, the words of the
windows with one anchor, and a block holds pieces of the same anchors.

Pieces that are equal are one, so a passage that millions of documents share is factored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from answerflow.llm.common import join_groups, shuffle_width, store

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided by
INVERSE = pow(BASE, -1, 1 << 64)
WORDS_AT_ONCE = 1 << 20
BLOCK_WORDS = 1 << 19
ROWS_AT_ONCE = 10_000
# Different pieces with one anchor that fit into a block; beyond, windows are their own anchors.
IN_ONE_BLOCK = 4_096


class WordHashes(dict):
    """XXH64 of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = value
        return value


def hashed_words(body: bytes, known: WordHashes) -> np.ndarray:
    words = body.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each position on; runs that leave the array are dropped."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    got, length, run, have = None, 0, words, 1
    # Binary digits of `size`, lowest first: runs of 1, 2, 4, ... words are put one after the other.
    while True:
        factor = np.uint64(pow(BASE, have, 1 << 64))
        if size & have:
            n = len(words) - length - have + 1
            got = run if got is None else got[:n] * factor + run[length : length + n]
            length += have
        if 2 * have > size:
            return got
        n = len(words) - 2 * have + 1
        run, have = run[:n] * factor + run[have : have + n], 2 * have


def powers(base: int, count: int) -> np.ndarray:
    """base to the powers 0, 1, ..., modulo 2^64."""
    factors = np.full(count, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def first_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the first smallest of the `size` values from each position on."""
    at, have = np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def cut_pieces(words: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(start, size, hash of the anchor, hash of the piece) of the pieces of some documents.

    `words` are hashed, document after document, `doc` says whose they are. All words of the
    windows that have one anchor are a piece, so pieces overlap and every window is in one.
    """
    none = np.empty(0, np.int64)
    if len(words) < window:
        return none, none, none, none
    grams = run_hashes(words, anchor)
    # Scrambled, as the low bits of a sum of products only depend on low bits.
    grams = grams ^ (grams >> np.uint64(32))
    grams *= np.uint64(BASE)
    grams ^= grams >> np.uint64(29)
    owner = first_smallest(grams, window - anchor + 1)[: len(words) - window + 1]
    inside = doc[: len(owner)] == doc[window - 1 :]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~inside[:-1] | (doc[1 : len(owner)] != doc[: len(owner) - 1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(owner)) - 1
    real = inside[starts]
    starts, stops = starts[real], stops[real]
    # A run of windows ends where they leave the document.
    last = np.maximum.accumulate(np.where(inside, np.arange(len(owner)), -1))
    stops = last[stops]
    sizes = stops - starts + window
    before = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=before[1:])
    pieces = (before[starts + sizes] - before[starts]) * powers(INVERSE, len(words))[starts] + sizes.astype(np.uint64)
    return starts, sizes, grams[owner[starts]].view(np.int64), pieces.view(np.int64)


def chunks(lengths: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, first word, end) of bounded size that hold every window once."""
    group, held = [], 0
    for i, n in enumerate(lengths):
        for start in range(0, max(n - window + 1, 0), WORDS_AT_ONCE):
            end = min(start + WORDS_AT_ONCE + window - 1, n)
            group.append((i, start, end))
            held += end - start
            if held >= WORDS_AT_ONCE:
                yield group
                group, held = [], 0
    if group:
        yield group


def occurrences(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows (anchor, piece, id, text_hash, start, size) of the pieces of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(), batch["text_hash"].to_numpy()
            words = [hashed_words(b, known) for b in batch["body"]]
            for group in chunks([len(w) for w in words], window):
                doc = np.repeat(np.arange(len(group)), [e - s for _, s, e in group])
                joined = np.concatenate([words[i][s:e] for i, s, e in group])
                starts, sizes, anchors, pieces = cut_pieces(joined, doc, window, anchor)
                at = doc[starts]
                origin = np.cumsum([0, *(e - s for _, s, e in group)])[:-1]
                row = np.array([i for i, _, _ in group])[at]
                yield pd.DataFrame({
                    "anchor": anchors, "piece": pieces, "id": ids[row], "text_hash": hashes[row],
                    "start": starts - origin[at] + np.array([s for _, s, _ in group])[at], "size": sizes.astype(np.int32),
                })

    return docs.mapInPandas(run, "anchor long, piece long, id long, text_hash long, start long, size int")


def asked_words(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The words of the pieces `asked` (anchor, piece, id, text_hash, start, size, crowded), once
    for a document and piece with all its places: (anchor, id, text_hash, starts, words).

    Pieces of crowded anchors come as their windows, `anchor` then being the hash of the window
    and `words` null.
    """
    by_doc = asked.distinct().groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "piece", "start", "size", "crowded")).alias("asked")
    )
    names = ["anchor", "id", "text_hash", "starts", "words"]
    met = docs.join(by_doc.withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"}), F.expr("id = of_id and text_hash = of_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            out = []
            for id, text_hash, body, pieces in zip(batch["id"], batch["text_hash"], batch["body"], batch["asked"]):
                words = hashed_words(body, known)
                places: dict = {}
                for p in pieces:
                    places.setdefault((p["anchor"], p["piece"], p["size"], p["crowded"]), []).append(p["start"])
                for (key, _, size, crowded), starts in places.items():
                    part = words[starts[0] : starts[0] + size]
                    if not crowded:
                        out.append((key, id, text_hash, starts, part.tobytes()))
                    else:
                        for i, h in enumerate(run_hashes(part, window).view(np.int64).tolist()):
                            out.append((h, id, text_hash, [s + i for s in starts], None))
                    if len(out) >= ROWS_AT_ONCE:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    rows = met.select("id", "text_hash", "body", "asked")
    return rows.mapInPandas(run, "anchor long, id long, text_hash long, starts array<long>, words binary")


class Index:
    """Suffixes of the pieces of a block in order, and names of their runs of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.ends = ends
        here = np.arange(len(words))
        names = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        self.names, size = [names], 1
        while size < int((ends - here).max(initial=0)):
            after = np.where(here + size < ends, names[np.minimum(here + size, len(words) - 1)], 0)
            names = np.unique(names * (len(words) + 1) + after, return_inverse=True)[1] + 1
            self.names.append(names)
            size *= 2
        self.order = np.argsort(names, kind="stable")

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y share; none where y is negative."""
        length, last = np.zeros(len(x), np.int64), len(self.ends) - 1
        for level in range(len(self.names) - 1, -1, -1):
            a, b = x + length, y + length
            open = (y >= 0) & (a < self.ends[x]) & (b < self.ends[y])
            same = open & (self.names[level][np.minimum(a, last)] == self.names[level][np.clip(b, 0, last)])
            length += same * (1 << level)
        return np.minimum(length, np.minimum(self.ends[x] - x, np.where(y >= 0, self.ends[y] - y, 0)))


def factor_spans(
    index: Index, before: np.ndarray, after: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the repeated spans found by factoring the pieces [firsts, lasts) greedily.

    `before` and `after` name the neighbours in suffix order that are in the reference block;
    one of them shares the longest run with the suffix. All pieces are parsed side by side.
    """

    def longest(at: np.ndarray) -> np.ndarray:
        return np.maximum(index.common(at, before[at]), index.common(at, after[at]))

    spans, cursor, previous, lasts = [], firsts.copy(), firsts.copy(), lasts
    while len(cursor):
        length = longest(cursor)
        long = length >= window
        spans.append((cursor[long], length[long]))
        # Windows that begin in the factor before and can only end in this one.
        low = np.maximum(previous + 1, cursor - window + 1)
        high = np.minimum(cursor - 1, cursor + length - window)
        many = np.maximum(high - low + 1, 0)
        cut = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cut = cut[longest(cut) >= window]
        spans.append((cut, np.full(len(cut), window)))
        previous, cursor = cursor, cursor + np.maximum(length, 1)
        going = lasts - cursor > 0
        cursor, previous, lasts = cursor[going], previous[going], lasts[going]
    return np.concatenate([s for s, _ in spans]), np.concatenate([n for _, n in spans])


def parse_block(pieces: list[np.ndarray], group: np.ndarray, ids: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(piece, start, size) of the spans that a piece of a smaller id, but the same group, has.

    The documents of a group are halved again and again: each right half is factored against
    the reference block of its left half. Two documents are parted exactly once, so a document meets
    every earlier one of its group, in as many blocks as their number has digits.
    """
    sizes = np.array([len(p) for p in pieces])
    lasts = np.cumsum(sizes)
    firsts = lasts - sizes
    of = np.repeat(np.arange(len(pieces)), sizes)
    index = Index(np.concatenate(pieces), lasts[of])
    # Rank of a piece's document within its group.
    order = np.lexsort((ids, group))
    new_group = np.append(True, group[order][1:] != group[order][:-1])
    new_doc = (np.append(True, ids[order][1:] != ids[order][:-1]) | new_group).astype(np.int64)
    counted = np.cumsum(new_doc)
    rank = np.empty(len(pieces), np.int64)
    rank[order] = counted - np.maximum.accumulate(np.where(new_group, counted, 0))
    name = np.unique(group, return_inverse=True)[1].astype(np.int64)
    out, level = [], 0
    while (rank >> level).any():
        half = rank >> level
        node = (name << 32) | (half >> 1)
        # Only halves with a sibling take part.
        mixed = np.unique(node[half & 1 == 1])
        place = np.isin(node, mixed)[of[index.order]]
        suffixes = index.order[place]
        suffixes = suffixes[np.argsort(node[of[suffixes]], kind="stable")]
        n, here = node[of[suffixes]], np.arange(len(suffixes))
        reference = (half[of[suffixes]] & 1) == 0
        edge = np.append(True, n[1:] != n[:-1])
        first = np.maximum.accumulate(np.where(edge, here, 0))
        near = np.maximum.accumulate(np.where(reference, here, -1))
        before = np.full(len(of), -1)
        before[suffixes] = np.where(near >= first, suffixes[np.maximum(near, 0)], -1)
        last = np.minimum.accumulate(np.where(np.append(n[1:] != n[:-1], True), here, len(here))[::-1])[::-1]
        near = np.minimum.accumulate(np.where(reference, here, len(here))[::-1])[::-1]
        after = np.full(len(of), -1)
        after[suffixes] = np.where(near <= last, suffixes[np.minimum(near, len(here) - 1)], -1)
        asking = np.flatnonzero((half & 1 == 1) & (sizes >= window))
        starts, lengths = factor_spans(index, before, after, firsts[asking], lasts[asking], window)
        out += zip(of[starts].tolist(), (starts - firsts[of[starts]]).tolist(), lengths.tolist())
        level += 1
    return out


def factored(words: DataFrame, window: int) -> DataFrame:
    """Spans (id, text_hash, start, size) of the pieces of (anchor, id, text_hash, starts, words)
    that occur in a smaller id's piece of the same anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def spans() -> pd.DataFrame:
            pieces = [np.frombuffer(r[4], np.uint64) for r in held]
            found = parse_block(pieces, np.array([r[0] for r in held]), np.array([r[1] for r in held]), window)
            rows = [(held[p][1], held[p][2], place + start, n) for p, start, n in found for place in held[p][3]]
            return pd.DataFrame(rows, columns=["id", "text_hash", "start", "size"])

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if size >= BLOCK_WORDS and row[0] != held[-1][0]:
                    yield spans()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 8
        if held:
            yield spans()

    dealt = words.repartition(shuffle_width(words.sparkSession), "anchor").sortWithinPartitions("anchor")
    rows = dealt.select("anchor", "id", "text_hash", "starts", "words")
    return rows.mapInPandas(run, "id long, text_hash long, start long, size int")


def identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("body"))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 20) -> DataFrame:
    """Written rows (id, text_hash, start, size): runs of words all of whose windows of `window`
    words also start in a document with a smaller id. Spans may overlap. See `without_repeats`."""
    if not 0 < anchor <= window:
        raise ValueError("anchor must be from 1 to window")
    rows = identified(docs.where(F.col(id).isNotNull()), id, text)
    places = store(occurrences(rows, window, anchor), "pieces")
    pieces = store(
        places.groupBy("anchor", "piece").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")), "piece-ids"
    )
    anchors = pieces.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("variants"), F.min("low").alias("anchor_low"), F.max("low").alias("anchor_high")
    )
    several = join_groups(pieces, store(anchors, "anchors"), ["anchor"], "variants")
    # An anchor whose pieces differ and first come up in different documents may hide shared windows.
    mixed = F.col("anchor_low") < F.col("anchor_high")
    wanted = several.where((F.col("low") < F.col("high")) | mixed).select(
        "anchor", "piece", "low", "n", mixed.alias("mixed"), (F.col("variants") > IN_ONE_BLOCK).alias("crowded")
    )
    wanted = store(wanted, "pieces-shared")
    met = store(join_groups(places, wanted, ["anchor", "piece"], "n"), "places-shared")
    # The whole piece is in an earlier document.
    whole = met.where("id > low").select("id", "text_hash", "start", "size")
    asked = met.where("id = low and mixed").select("anchor", "piece", "id", "text_hash", "start", "size", "crowded")
    words = store(asked_words(rows, asked, window), "words")
    parsed = factored(words.where("words is not null"), window)
    windows = words.where("words is null").select(F.col("anchor").alias("window_hash"), "id", "text_hash", "starts")
    lowest = store(windows.groupBy("window_hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")), "windows")
    crowded = join_groups(windows, lowest.where("low < high"), ["window_hash"], "n").where("id > low").select(
        "id", "text_hash", F.explode("starts").alias("start"), F.lit(window).alias("size")
    )
    return store(whole.unionByName(parsed).unionByName(crowded).distinct(), "spans")


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, anchor: int = 20) -> DataFrame:
    """Rows (id, kept, n_words, n_removed), one per row of `docs`: the text without the words that are
    covered by a run of `window` words which also starts in a document with a smaller id.

    Words are what lies between blanks, tabs and line ends (ASCII), unchanged; `kept` joins them
    by one blank. Windows are judged on the whole input, not on what is left of it. Words and
    runs are told apart by 64-bit hashes.

    Null and empty texts have no words. A null id is neither smaller nor larger than any: its
    document loses nothing and takes nothing from others. Rows with equal ids don't take from
    each other; repeated rows get equal results. Texts of any length are cut into pieces that
    hold all their windows. Texts shorter than a window lose nothing. An empty table gives no
    rows. Other columns, whatever their names, don't matter.
    """
    spans = repeated_spans(docs, id, text, window, anchor)
    by_doc = spans.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.collect_list(F.struct("start", "size")).alias("spans")
    )
    rows = identified(docs, id, text)
    met = rows.join(by_doc, F.expr("id = of_id and text_hash = of_hash"), "left").select("id", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for body, spans in zip(batch.column("body"), batch.column("spans")):
                words = left = body.as_py().split()
                if spans.is_valid:
                    starts = spans.values.field("start").to_numpy()
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + spans.values.field("size").to_numpy(), -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                kept.append(b" ".join(left))
                total.append(len(words))
                removed.append(len(words) - len(left))
            columns = [batch.column("id"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "kept", "n_words", "n_removed"])

    cleaned = met.mapInArrow(run, "id long, kept binary, n_words long, n_removed long")
    return cleaned.withColumn("kept", F.col("kept").cast("string"))
