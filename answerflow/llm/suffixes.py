"""Language-model scores by a probabilistic suffix tree over words.

The root has the smoothed word frequencies. A node's distribution is its counts, smoothed with its
longest suffix in the tree by as much as it has different next words. A context of one or more
preceding words is a node if its next words diverge from those of that suffix: every occurrence of a
next word is left out in turn and predicted by the others, and the sum of the logarithms of its
probability over the suffix's (the number of occurrences times the estimated Kullback-Leibler
divergence) must exceed a threshold. Leaving out makes up for few counts in a large vocabulary: a
context like its suffix loses. A context that is no node doesn't rule out longer ones; it stands in
the tree with its suffix's distribution. A word is scored in the longest node that its history ends in.

Documents are handled in blocks. A block asks for the counts of the words and contexts it has:
its keys, sorted and packed, are dealt by ranges of their hash, summed up over all blocks and
answered in the same order. So each task holds a block, or one range of keys, and the counts of
the whole corpus are never in one place; they grow with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from answerflow.llm.common import scratch_path, shuffle_width, store

# Tokens after which a block is full, and keys that a range should have.
IN_A_BLOCK = 1_000_000
IN_A_RANGE = 1_500_000
KNOWN_WORDS = 300_000
# Next words are told apart by 40 bits of their hash, within one context.
NEXT = np.uint64((1 << 40) - 1)
# The divergence from the suffix, in nats over all occurrences, from which a context is a node.
DIVERGENCE = 3.0
# Suffixes' probabilities travel as logarithms in steps of this part of a nat, in one byte.
STEPS = 8

_known: dict[bytes, int] = {}


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Compressed steps of sorted 64-bit numbers."""
    return pack(np.diff(values, prepend=np.zeros(1, np.uint64)).astype("<u8"))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u8"), dtype=np.uint64)


def word_hashes(text: str | None) -> list[int]:
    """64-bit hashes of the words (A-Z lower-cased), and of the end."""
    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w, 0)
        out.append(h)
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    out.append(END)
    return out


# No word has a blank.
END = xxhash.xxh64_intdigest(b" ", 0)


def blocks(docs: DataFrame, fold: int, name: str) -> DataFrame:
    """Rows id, text as blocks, in a table of this name: the documents' ids and lengths, whether they are held out, their
    tokens as places in the block's sorted distinct word hashes."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        ids, held, lengths, tokens = [], [], [], []

        def row() -> pd.DataFrame:
            words, place = np.unique(np.concatenate(tokens), return_inverse=True)
            return pd.DataFrame([{
                "block": number, "ids": ids, "held": bytes(held), "lengths": pack(np.array(lengths, "<u4")),
                "tokens": pack(place.astype("<u4")), "words": pack_sorted(words),
            }])

        size = 0
        for batch in batches:
            for id, out, text in zip(batch["id"].astype("Int64"), batch["out"], batch["text"]):
                found = np.array(word_hashes(text), "<u8")
                ids.append(None if id is pd.NA else int(id))
                held.append(int(out))
                lengths.append(len(found))
                tokens.append(found)
                size += len(found)
                if size >= IN_A_BLOCK:
                    yield row()
                    number, size, ids, held, lengths, tokens = number + 1, 0, [], [], [], []
        if ids:
            yield row()

    out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % fold == 0
    rows = docs.select("id", out.alias("out"), "text")
    made = rows.mapInPandas(build, "block long, ids array<long>, held binary, lengths binary, tokens binary, words binary")
    # Kept by block, so that answers meet their block without the blocks being dealt again.
    spark = docs.sparkSession
    made.write.bucketBy(shuffle_width(spark), "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


class Block:
    """A block read back. `train` tells the tokens of documents that are learned from; `grams(k)`
    are the distinct (context of k words, next word) in it."""

    def __init__(self, row) -> None:
        self.number, self.ids = row["block"], row["ids"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.tokens = unpack(row["tokens"], "<u4")
        self.words = unpack_sorted(row["words"])
        self.train = ~np.repeat(self.held, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

    def contexts(self, order: int) -> np.ndarray:
        """Hash of the `order` words before each token; only right where there are as many."""
        hashes = self.words[self.tokens]
        value = np.zeros(len(hashes), np.uint64)
        for back in range(order, 0, -1):
            value = (value ^ np.roll(hashes, back)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value

    def grams(self, order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens `at`: distinct contexts, how many next words each has, these, and for each
        token the place of its (context, next word)."""
        context, which = np.unique(self.contexts(order)[at], return_inverse=True)
        key = (which.astype(np.uint64) << np.uint64(40)) | (self.words[self.tokens[at]] & NEXT)
        key, gram = np.unique(key, return_inverse=True)
        many = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(context))
        return context, many, key & NEXT, gram


def ranges(keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted 64-bit keys."""
    width = (1 << 64) // count + 1
    edges = np.searchsorted(keys, np.array([i * width for i in range(1, count)], np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


WORD_ASK = "block long, part int, words binary, counts binary"
WORD_REPLY = "block long, part int, level int, counts binary, more binary, totals binary, node binary, tokens long, distinct long"
GRAM_ASK = "block long, part int, contexts binary, many binary, next binary, counts binary, suffix binary"


def ask_words(state: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row)
                counts = np.bincount(block.tokens[block.train], minlength=len(block.words)).astype("<u4")
                out = [(block.number, i, pack_sorted(block.words[a:b]), pack(counts[a:b])) for i, a, b in ranges(block.words, parts)]
                yield pd.DataFrame(out, columns=["block", "part", "words", "counts"])

    return state.mapInPandas(run, WORD_ASK)


def per_part(batches: Iterator[pd.DataFrame]) -> Iterator[list[dict]]:
    """The rows of one range after the other, from rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_dict("records"):
            if held and row["part"] != held[0]["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def reply_words(asked: DataFrame) -> DataFrame:
    """Counts over all blocks; the first row of a range also has its sums for the whole corpus."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in per_part(batches):
            words = [unpack_sorted(r["words"]) for r in rows]
            counts = [unpack(r["counts"], "<u4") for r in rows]
            _, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(counts)).astype("<u8")
            ends = np.cumsum([len(w) for w in words])
            out = []
            for i, (row, end, w) in enumerate(zip(rows, ends, words)):
                first = i == 0
                out.append((
                    row["block"], row["part"], 0, pack(total[at[end - len(w) : end]]), None, None, None, int(total.sum()) if first else 0,
                    int((total > 0).sum()) if first else 0,
                ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WORD_REPLY.split(", ")])

    return dealt(asked).mapInPandas(run, WORD_REPLY)


def dealt(asked: DataFrame) -> DataFrame:
    return asked.repartition(shuffle_width(asked.sparkSession), "part").sortWithinPartitions("part")


def divergence(count: np.ndarray, suffix: np.ndarray, of: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Per context the sum over its occurrences of log(probability by the other ones / suffix's).

    `count` and `suffix` (minus the log of the suffix's probability) are per (context, next word),
    `of` says which context, `n` and `more` are its occurrences and different next words.
    """
    at = np.flatnonzero((count > 0) & (n[of] > 1))
    c, q, of = count[at], suffix[at], of[at]
    others = more[of] - (c == 1)
    left = (c - 1 + others * np.exp(-q)) / (n[of] - 1 + others)
    return np.bincount(of, weights=c * (np.log(left) + q), minlength=len(n))


def reply_grams(asked: DataFrame, level: int, last: bool) -> DataFrame:
    """Per (context, next word) its count over all blocks; per context how many different next
    words it has, how many in all, and whether it is a node. At the last level only nodes have counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in per_part(batches):
            contexts = [unpack_sorted(r["contexts"]) for r in rows]
            many = [unpack(r["many"], "<u4").astype(np.int64) for r in rows]
            context, which = np.unique(np.concatenate(contexts), return_inverse=True)
            key = np.repeat(which.astype(np.uint64) << np.uint64(40), np.concatenate(many))
            key |= np.concatenate([unpack(r["next"], "<u8") for r in rows])
            key, at = np.unique(key, return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([unpack(r["counts"], "<u4") for r in rows]))
            of = (key >> np.uint64(40)).astype(np.int64)
            n = np.bincount(of, weights=count, minlength=len(context))
            more = np.bincount(of, weights=count > 0, minlength=len(context))
            suffix = np.zeros(len(key))
            # The same from every block that asks.
            suffix[at] = np.concatenate([unpack(r["suffix"], "u1") for r in rows]) / STEPS
            node = divergence(count, suffix, of, n, more) > DIVERGENCE
            if last:
                count, n, more = count * node[of], n * node, more * node
            count, n, more, node = count.astype("<u8"), n.astype("<u8"), more.astype("<u4"), node.astype("u1")
            out, c, g = [], 0, 0
            for row, has, size in zip(rows, contexts, many):
                mine, entries = which[c : c + len(has)], at[g : g + size.sum()]
                c, g = c + len(has), g + int(size.sum())
                out.append((row["block"], row["part"], level, pack(count[entries]), pack(more[mine]), pack(n[mine]), pack(node[mine]), 0, 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WORD_REPLY.split(", ")])

    return dealt(asked).mapInPandas(run, WORD_REPLY)


def ask_grams(block: Block, order: int, at: np.ndarray, probability: np.ndarray, parts: int) -> pd.DataFrame:
    """What a block asks for, for the tokens `at`, whose probability after their suffix is known."""
    context, many, following, gram = block.grams(order, at)
    counts = np.bincount(gram[block.train[at]], minlength=len(following)).astype("<u4")
    suffix = np.zeros(len(following), "u1")
    suffix[gram] = np.clip(np.rint(-np.log(probability[at]) * STEPS), 0, 255)
    ends = np.cumsum(many)
    out = []
    for i, a, b in ranges(context, parts):
        g, h = int(ends[a] - many[a]), int(ends[b - 1])
        out.append((
            block.number, i, pack_sorted(context[a:b]), pack(many[a:b].astype("<u4")), pack(following[g:h]), pack(counts[g:h]),
            pack(suffix[g:h]),
        ))
    return pd.DataFrame(out, columns=[c.split()[0] for c in GRAM_ASK.split(", ")])


class Tree:
    """What a block knows of the tree after some levels: per token the probability in the longest
    node so far."""

    def __init__(self, block: Block, replies: list, corpus: dict) -> None:
        self.block, self.corpus = block, corpus
        self.replies = {}
        for r in sorted(replies, key=lambda r: (r["level"], r["part"])):
            self.replies.setdefault(r["level"], []).append(r)
        counts = np.concatenate([unpack(r["counts"], "<u8") for r in self.replies[0]]).astype(np.float64)
        n, v = corpus["tokens"], corpus["distinct"]
        self.count = counts[block.tokens]
        self.base = (self.count + 0.1) / (n + 0.1 * (v + 1))
        self.probability = self.base.copy()
        #: How often each token was learned from after the words before it, as many as the level
        #: has; none where that was not asked, as even the words before it come less than twice.
        self.last = self.count
        self.level = 0

    def eligible(self) -> np.ndarray:
        """Tokens whose context of one word more comes twice at least. How often it comes is known from
        the level before, where its last word was a next word after its first ones."""
        at = np.flatnonzero(self.block.place > self.level)
        return at[self.last[at - 1] > 1]

    def grow(self) -> None:
        """Take the next level's replies."""
        order = self.level + 1
        at = self.eligible()
        context, many, following, gram = self.block.grams(order, at)
        self.last = np.zeros(len(self.count))
        if len(at):
            found = self.replies[order]
            count, more, total, node = (
                np.concatenate([unpack(r[c], kind) for r in found]).astype(np.float64)
                for c, kind in (("counts", "<u8"), ("more", "<u4"), ("totals", "<u8"), ("node", "u1"))
            )
            self.last[at] = count[gram]
            which = np.repeat(np.arange(len(context)), many)[gram]
            kept = node[which] > 0
            at, which, gram = at[kept], which[kept], gram[kept]
            mixed = count[gram] + more[which] * self.probability[at]
            self.probability[at] = mixed / (total[which] + more[which])
        self.level = order


def answered(state: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with all their replies."""
    mine = replies.groupBy("block").agg(F.collect_list(F.struct("level", "part", "counts", "more", "totals", "node")).alias("replies"))
    return state.join(mine, "block")


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", *, depth: int = 2, fold: int = 10) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, the last two as log10 probabilities of the text by word frequencies and by the tree.

    Documents whose id (as text, null as empty) has a CRC-32 divisible by `fold` are held out, the
    tree is learned from the others. Tokens are the words and one end; null text has none but the
    end. Contexts have up to `depth` words; a very long text may be a block of its own. Repeated rows are learned from and come back as often
    as they are there. Extra columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    state = blocks(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), fold, name)
    size = state.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    # A compressed token takes about 1.5 bytes.
    parts = max(shuffle_width(spark), int(size / 1.5 / IN_A_RANGE) + 1)
    replies = store(reply_words(ask_words(state, parts)), "word-counts")
    corpus = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct")]).first().asDict()

    def trees(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[Tree]:
        for batch in batches:
            for row in batch.to_dict("records"):
                tree = Tree(Block(row), row["replies"], corpus)
                for _ in range(levels):
                    tree.grow()
                yield tree

    for level in range(depth):
        def ask(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for tree in trees(batches, level):
                at = tree.eligible()
                if len(at):
                    yield ask_grams(tree.block, level + 1, at, tree.probability, parts)

        asked = answered(state, replies).mapInPandas(ask, GRAM_ASK)
        replies = replies.unionAll(store(reply_grams(asked, level + 1, level + 1 == depth), "gram-counts"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tree in trees(batches, depth):
            block = tree.block
            add = lambda x: np.add.reduceat(x, block.starts)
            yield pd.DataFrame({
                "doc_id": pd.array([pd.NA if pd.isna(i) else int(i) for i in block.ids], dtype="Int64"),
                "held_out": block.held, "n_tokens": block.lengths, "n_known": add((tree.count > 0).astype(np.int64)),
                "train_tokens": int(corpus["tokens"]), "base_score": add(np.log10(tree.base)), "score": add(np.log10(tree.probability)),
            })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = store(answered(state, replies).mapInPandas(finish, schema), "scores")
    # Only the name goes; the files stay in the shared folder.
    spark.sql(f"DROP TABLE {name}")
    return scores
