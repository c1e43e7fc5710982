"""Source divergence audit: how differently the sources of a language use its words.

In-mapper stripes: a task folds whole documents into a hash of stripes, one per (language,
term), holding the number of documents and the occurrences per source; when the hash is full
it is spilled. Spilled stripes are merged by key, and the merged stripes of a group of terms
give the divergences of their sources directly. Integer arithmetic throughout.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from answerflow.llm.common import join_groups, numbered, store

# Bytes that are no part of a term become blanks, A-Z lower case.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
UNIT = 1_000_000_000
HELD_ENTRIES = 1_500_000  # entries of stripes a task holds before it spills
HELD_TERMS = 500_000
SPILLED_TOGETHER = 50_000
TERMS_TOGETHER = 2_048  # terms whose stripes one task turns into divergences at once
TILE = 256  # sources on one side of a table of divergences
AT_ONCE = 1_000_000


class Numbers(dict):
    """Numbers for the terms of a language, given as they come up; `names` has all of a task."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__()
        self.lang, self.names = lang, names

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self.names)
        self.names.append((self.lang, term))
        return number


class Stripes:
    """A hash of stripes: for each (language, term) the occurrences and documents by source.

    Entries are rows of three arrays (stripe * width + source, occurrences, documents); new ones
    are appended and now and then added up.
    """

    def __init__(self):
        self.names: list[tuple[str, bytes]] = []
        self.terms: dict[str, Numbers] = {}
        self.sources: dict[str, int] = {}
        self.pending: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.waiting = 0
        self.entries = np.empty((4, 0), np.int64)  # stripe, source, occurrences, documents

    def add(self, lang: str, source: str, body: bytes) -> None:
        counted = Counter(body.translate(TERM_BYTES).split())
        if not counted:
            return
        terms = self.terms.get(lang)
        if terms is None:
            terms = self.terms[lang] = Numbers(lang, self.names)
        n = len(counted)
        numbers = np.fromiter(map(terms.__getitem__, counted), np.int64, n)
        self.pending.append((numbers, np.fromiter(counted.values(), np.int64, n), self.sources.setdefault(source, len(self.sources))))
        self.waiting += n

    def fold(self) -> int:
        """Add up what has been appended; returns the number of entries."""
        if self.pending:
            numbers, counts = (np.concatenate([p[i] for p in self.pending]) for i in (0, 1))
            sources = np.repeat([p[2] for p in self.pending], [len(p[0]) for p in self.pending])
            new = np.stack([numbers, sources, counts, np.ones(len(numbers), np.int64)])
            rows = np.concatenate([self.entries, new], axis=1)
            key = rows[0] * len(self.sources) + rows[1]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            self.entries = np.concatenate([rows[:2, order[starts]], np.add.reduceat(rows[2:, order], starts, axis=1)])
            self.pending, self.waiting = [], 0
        return self.entries.shape[1]

    def spilled(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        langs, terms = pa.array([n[0] for n in self.names], pa.string()), pa.array([n[1] for n in self.names], pa.binary())
        sources = pa.array(list(self.sources), pa.string())
        for at in range(0, self.entries.shape[1], SPILLED_TOGETHER):
            stripe, source, count, docs = self.entries[:, at : at + SPILLED_TOGETHER]
            columns = [langs.take(pa.array(stripe)), terms.take(pa.array(stripe)), pa.array(docs), sources.take(pa.array(source)), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "source", "count"])


def stripes(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, docs, source, count), spilled by tasks; one term may come from many.

    `docs` is (lang, source, body), body the text's bytes. A document adds its occurrences to
    the stripe's source and 1 to its documents.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for batch in batches:
            for lang, source, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "body"))):
                held.add(lang, source, body)
                if held.waiting >= HELD_ENTRIES and held.fold() >= HELD_ENTRIES or len(held.names) >= HELD_TERMS:
                    yield from held.spilled()
                    held = Stripes()
        yield from held.spilled()

    return docs.mapInArrow(fold, "lang string, term binary, docs long, source string, count long")


def merged(spilled: DataFrame, least_docs: int) -> DataFrame:
    """Written rows (lang, term, total, source, count) of the terms in at least `least_docs`
    documents of their language."""
    by_source = spilled.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("stripe")
    )
    kept = whole.where(F.col("docs") >= least_docs).select("lang", "term", "total", F.explode("stripe").alias("s"))
    return store(kept.select("lang", "term", "total", "s.source", "s.count"), "stripes")


def share(count: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / size), by long division so that no product leaves int64."""
    whole, rest = np.divmod(count + 2, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1_000, size)
        whole = whole * 1_000 + digit
    return 1 + whole


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def against(entries: pd.DataFrame, mine: pd.DataFrame, others: pd.DataFrame, theirs: pd.DataFrame, once: bool) -> np.ndarray:
    """Sums over terms of the divergence of each of `mine` (rows) and `others` (columns), less
    what they would be if nobody had any term.

    `entries` are the occurrences of the terms in `mine`, `theirs` those in `others`. With
    `once`, a term counts only where the other source lacks it.
    """
    none_m, none_o = share(np.zeros(len(mine), np.int64), mine["size"].to_numpy()), share(np.zeros(len(others), np.int64), others["size"].to_numpy())
    base = apart(none_m[:, None], none_o[None, :])
    out = np.zeros(base.shape, np.int64)
    # Terms in the rows of `entries`, and for each the counts in all of `others`.
    step = max(1, AT_ONCE // max(len(others), 1))
    terms, at = np.unique(entries["t"].to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, place, count = at[order], entries["place"].to_numpy()[order], entries["count"].to_numpy()[order]
    where = np.searchsorted(terms, theirs["t"].to_numpy())
    known = where < len(terms)
    known[known] = terms[where[known]] == theirs["t"].to_numpy()[known]
    t_row, t_place, t_count = where[known], theirs["place"].to_numpy()[known], theirs["count"].to_numpy()[known]
    t_order = np.argsort(t_row, kind="stable")
    t_row, t_place, t_count = t_row[t_order], t_place[t_order], t_count[t_order]
    for a in range(0, len(terms), step):
        b = min(a + step, len(terms))
        dense = np.zeros((b - a, len(others)), np.int64)
        x, y = np.searchsorted(t_row, [a, b])
        dense[t_row[x:y] - a, t_place[x:y]] = t_count[x:y]
        q = share(dense, others["size"].to_numpy()[None, :])
        x, y = np.searchsorted(row, [a, b])
        for lo in range(x, y, step):
            hi = min(lo + step, y)
            p = share(count[lo:hi], mine["size"].to_numpy()[place[lo:hi]])
            more = apart(p[:, None], q[row[lo:hi] - a]) - base[place[lo:hi]]
            if once:
                more[dense[row[lo:hi] - a] > 0] = 0
            by_place = np.argsort(place[lo:hi], kind="stable")
            places = place[lo:hi][by_place]
            starts = np.flatnonzero(np.append(True, np.diff(places) != 0))
            out[places[starts]] += np.add.reduceat(more[by_place], starts, axis=0)
    return out


def tile_rows(key: tuple, entries: pd.DataFrame, sources: pd.DataFrame, top: int) -> pd.DataFrame:
    """Divergences between two tiles of sources over some terms, and each source's `top` terms."""
    lang, left, right, salt = key
    columns = ["lang", "source", "part", "item", "value"]
    side = {}
    t, terms = pd.factorize(entries["term"])
    entries = entries.assign(t=t)
    for tile in {left, right}:
        there = sources[sources["tile"] == tile].sort_values("number", ignore_index=True)
        first = int(there["number"].iloc[0])
        mine = entries[entries["tile"] == tile]
        side[tile] = there, mine.assign(place=mine["number"].to_numpy() - first)
    (a, in_a), (b, in_b) = side[left], side[right]
    both = against(in_a, a, b, in_b, False) + against(in_b, b, a, in_a, True).T
    if salt == 0:
        zero = np.zeros(1, np.int64)
        none = apart(share(zero, a["size"].to_numpy())[:, None], share(zero, b["size"].to_numpy())[None, :])
        both += none * int(a["terms"].iloc[0])
    x, y = np.nonzero(np.ones(both.shape, bool))
    if left == right:
        x, y = x[x != y], y[x != y]
    names_a, names_b, values = a["source"].to_numpy(object)[x], b["source"].to_numpy(object)[y], both[x, y]
    out = [pd.DataFrame({"source": names_a, "item": names_b, "value": values, "part": "pair"})]
    if left != right:
        out.append(pd.DataFrame({"source": names_b, "item": names_a, "value": values, "part": "pair"}))
    else:
        p = share(in_a["count"].to_numpy(), a["size"].to_numpy()[in_a["place"].to_numpy()])
        q = share(in_a["total"].to_numpy(), in_a["lang_size"].to_numpy())
        f = apart(p, q)
        best: dict[int, list] = {}
        for i in np.flatnonzero(p > q):
            best.setdefault(int(in_a["place"].iloc[i]), []).append((-int(f[i]), terms[in_a["t"].iloc[i]]))
        found = [(a["source"].iloc[s], term.decode(), -v) for s, all_terms in best.items() for v, term in heapq.nsmallest(top, all_terms)]
        out.append(pd.DataFrame(found, columns=["source", "item", "value"]).assign(part="term"))
    return pd.concat(out).assign(lang=lang)[columns]


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` compares the source with every
    other of its language, part `term` names the `top` terms it uses more than the language.

    A term is a run of letters A-Z, lower-cased, and characters beyond ASCII; a language keeps
    those in at least `least_docs` of its documents, V in number. A source's share of a term it
    has c times among N occurrences of kept terms is p = 1 + floor(10^9 (c + 2) / (N + 2 V)), the
    language's likewise. The value is floor((p - q)^2 / (p + q)), summed over all kept terms for
    a pair. Ranks go by value, the largest first, then by item in UTF-8 order.

    Null text, language and source are read as ''. A source whose texts have no kept term is
    compared with others like any; a language without kept terms has only pairs, of value 0; a
    source alone in its language has no pairs. Repeated rows are documents each. Texts of any
    length are folded whole. An empty table gives no rows. Other columns don't matter.
    """
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source))],
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )
    kept = merged(stripes(rows), least_docs)
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_words")
    )
    words = kept.groupBy("lang", "source").agg(F.sum("count").alias("words"), F.count(F.lit(1)).alias("entries"))
    groups = rows.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_words", F.lit(0)).alias("lang_words"),
    )
    # A language without terms is divided by 1 instead of 0; nothing is summed over its terms.
    groups = numbered(groups, ["lang"], ["source"], "number").select(
        "lang", "source", "number", "entries", "terms", (F.col("number") / TILE).cast("long").alias("tile"),
        F.greatest(F.col("words") + 2 * F.col("terms"), F.lit(1)).alias("size"),
        F.greatest(F.col("lang_words") + 2 * F.col("terms"), F.lit(1)).alias("lang_size"),
    )
    groups = store(groups, "sources")
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    groups = store(groups.join(tiles, "lang"), "sources")

    salts = F.ceil(F.greatest("terms", F.lit(1)) / TERMS_TOGETHER)
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    keys = ["lang", "left", "right", "salt"]

    def in_tiles(df: DataFrame) -> DataFrame:
        """Once for every pair of tiles, the lower first, that holds the row's tile."""
        return df.select("*", pairs.alias("other")).select(
            "*", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right")
        )

    placed = join_groups(kept, groups, ["lang", "source"], "entries").where("entries > 0")
    entries = in_tiles(
        placed.withColumn("salt", F.pmod(F.xxhash64("term"), salts).cast("long"))
    ).select(*keys, "term", "count", "total", "tile", "number", "lang_size")
    members = in_tiles(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))).select(
        *keys, "source", "tile", "number", "size", "terms"
    )
    members = members.toDF(*members.columns)  # names of its own, as both sides come from `groups`
    found = entries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(
        lambda key, e, m: tile_rows(key, e, m, top), "lang string, source string, part string, item string, value long"
    )
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
