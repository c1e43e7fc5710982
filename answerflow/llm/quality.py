"""Quality classifier: evidence from a document's shape, and from its site by hierarchical
empirical Bayes.

A document's evidence is the sum of log likelihood ratios of binned shape features, counted over
all labelled documents. Sites are hosts and paths below them: a path's share of good documents
is shrunk towards its host's, the host's towards the global one, each as strongly as the spread
between the sites calls for. All of it is grouped sums; the only rows that reach the driver are
one per feature and bin (a fixed number) and three rows of totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from answerflow.llm.common import UPPER, WORD, lower_ascii, store

SYMBOLS = "!#$%&*|@^~<>{}[]=+/_"
#: Feature: number of bins.
BINS = {"upper": 21, "symbols": 21, "variety": 66, "length": 17, "repeats": 5}
WORDS_UPTO = (8, 32, 128, 512, 2048)
WEAKEST, STRONGEST = 1.0, 1e6


def shaped(rows: DataFrame) -> DataFrame:
    """Add the bins of the shape of `text` in place of it, by whole numbers only: share of capitals
    and of symbols, share of different words by length of the document, mean length of a word,
    share of words that are said once more at once."""
    text, words, n = F.col("text"), F.col("words"), F.col("n_words")
    rows = rows.withColumn("text", F.coalesce(text, F.lit("")))
    # Columns of their own, so that the words are found once.
    rows = rows.withColumn("words", F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0))
    rows = rows.withColumn("n_words", F.greatest(F.size(words), F.lit(1)))
    chars = F.greatest(F.length(text), F.lit(1))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    again = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), n), lambda a, b: a == b), lambda same: same))
    band = sum(((n >= upto).cast("int") for upto in WORDS_UPTO), F.lit(0))

    def share(part: Column, whole: Column, steps: int) -> Column:
        return F.floor(part * steps / whole).cast("int")

    bins = {
        "upper": share(upper, chars, 20),
        "symbols": F.least(share(symbols, chars, 40), F.lit(20)),
        "variety": band * 11 + share(F.size(F.array_distinct(words)), n, 10),
        "length": F.least(share(chars, n, 1), F.lit(16)),
        "repeats": share(again, n, 4),
    }
    kept = [c for c in rows.columns if c not in ("text", "words", "n_words")]
    return rows.select(*kept, *[c.alias(name) for name, c in bins.items()])


def bin_evidence(labelled: DataFrame) -> tuple[Column, float]:
    """Column with the summed log likelihood ratio of a row's bins, and the share of good
    documents, smoothed. `labelled` has good (0, 1) and the bins."""
    cells = labelled.select(
        "good", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in BINS])).alias("cell")
    )
    counts = cells.groupBy("cell.feature", "cell.bin").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    first = next(iter(BINS))
    n = sum(c["n"] for c in counts if c["feature"] == first)
    good = sum(c["good"] for c in counts if c["feature"] == first)
    total = F.lit(0.0)
    for feature, bins in BINS.items():
        known = {c["bin"]: (c["good"], c["n"] - c["good"]) for c in counts if c["feature"] == feature}

        def ratio(g: int, b: int) -> Column:
            at = lambda x, of: F.lit(float(x + 1)) / F.lit(float(of + bins))
            return F.ln(at(g, good)) - F.ln(at(b, n - good))

        pairs = [x for bin, (g, b) in sorted(known.items()) for x in (F.lit(bin), ratio(g, b))]
        value = F.try_element_at(F.create_map(*pairs), F.col(feature)) if pairs else F.lit(None).cast("double")
        total = total + F.coalesce(value, ratio(0, 0))
    return total, (good + 1.0) / (n + 2.0)


def strength(total: float, squares: float, spread: float, groups: int, within: float) -> float:
    """How many documents the level above is worth (the sum of the beta prior's parameters), by
    the method of moments: `spread` is the weighted squared deviation between the sites."""
    extra = spread - groups * within
    room = total - squares - groups
    if extra <= 0 or room <= 0:
        return STRONGEST
    return min(max(within / (extra / room) - 1.0, WEAKEST), STRONGEST)


def site(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


class Model:
    """What the labels and all documents say: the evidence of a shape, and how good sites are."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id: str, text: str, host: str, path: str, label: str) -> None:
        base = shaped(docs.select(F.col(id).alias("id"), *placed(text, host, path)))
        self.known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("of")).agg(
            F.min((F.col(label) > 0).cast("int")).alias("label")
        )
        self.rows = store(self.labelled(base), "shapes")
        self.evidence, share = bin_evidence(self.rows.where("label is not null").withColumnRenamed("label", "good"))
        self.prior = F.ln(F.lit(share / (1 - share)))
        rows = self.rows.select("host", "path", F.coalesce(F.col("label").cast("double"), self.guess()).alias("vote"))
        self.paths = store(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("k")), "paths")
        self.hosts = store(
            self.paths.groupBy("host").agg(
                F.sum("n").alias("host_n"), F.sum("k").alias("host_k"), F.count(F.lit(1)).alias("parts"),
                F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"),
            ), "hosts",
        )
        t = self.hosts.agg(
            F.sum("host_n").alias("n"), F.sum("host_k").alias("k"), F.count(F.lit(1)).alias("hosts"), F.sum("parts").alias("paths"),
            F.sum(F.col("host_k") * F.col("host_k") / F.col("host_n")).alias("between"), F.sum("kk").alias("below"),
            F.sum(F.col("host_n").cast("double") * F.col("host_n")).alias("nn"), F.sum(F.col("nn") / F.col("host_n")).alias("nn_below"),
        ).first()
        n = t.n or 0
        self.share = p = (t.k + 1.0) / (n + 2.0) if n else 0.5
        self.host_m = self.path_m = STRONGEST
        if n:
            self.host_m = strength(n, t.nn / n, t.between - t.k * t.k / n, t.hosts - 1, p * (1 - p))
            self.path_m = strength(n, t.nn_below, t.below - t.between, t.paths - t.hosts, p * (1 - p))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """The rows with the label of their id, null without one."""
        return rows.join(self.known, F.col("id") == F.col("of"), "left").drop("of")

    def guess(self) -> Column:
        """How probably good a document is by its shape alone."""
        return 1 / (1 + F.exp(-(self.evidence + self.prior)))

    def judged(self, rows: DataFrame) -> DataFrame:
        """Add evidence, site_good and good to rows with a shape, a label, a host and a path. The
        document's own vote, its label or what its shape says, is taken out of its site."""
        rows = rows.withColumn("evidence", self.evidence)
        rows = rows.withColumn("own", F.coalesce(F.col("label").cast("double"), self.guess()))
        joined = rows.join(self.paths.select("path", "n", "k"), "path").join(self.hosts.select("host", "host_n", "host_k"), "host")
        host_good = (F.col("host_k") - F.col("own") + F.lit(self.host_m * self.share)) / (F.col("host_n") - 1 + F.lit(self.host_m))
        site_good = (F.col("k") - F.col("own") + F.lit(self.path_m) * host_good) / (F.col("n") - 1 + F.lit(self.path_m))
        joined = joined.withColumn("site_good", F.least(F.greatest(site_good, F.lit(1e-9)), F.lit(1 - 1e-9)))
        return joined.withColumn("good", 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("site_good"))))))


def placed(text: str, host: str, path: str) -> list[Column]:
    return [
        F.col(text).alias("text"), site(host).alias("host"), F.concat(site(host), F.lit("/"), site(path)).alias("path"),
    ]


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    label: str = "quality", threshold: float = 0.25,
) -> DataFrame:
    """One row per row of `docs`: id, host, path, evidence, site_good (the path's posterior share of
    good documents, without the document's own vote), good (the probability) and kept.

    Every document counts for its site: with its label if it has one, otherwise with the
    probability its shape gives. Below `threshold` it is rejected; losing a good document counts
    three times as much as keeping a bad one. Null text is empty text. Null hosts and paths are
    sites of their own. Repeated rows count as often as they are there; a document with several
    labels has the lowest. Without labels nothing is known, and all is kept. Extra columns are
    not looked at. Texts of any length are counted whole. An empty table gives an empty result.
    """
    model = Model(docs, labels, id, text, host, path, label)
    judged = model.judged(model.rows)
    return judged.select("id", "host", "path", "evidence", "site_good", "good", (F.col("good") >= threshold).alias("kept"))


def keep(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    label: str = "quality", threshold: float = 0.25,
) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier keeps. A row is judged where it stands:
    only the sites are joined to it."""
    model = Model(docs, labels, id, text, host, path, label)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    shapes = shaped(docs.select(F.col(id).alias("id"), whole, *placed(text, host, path)))
    kept = model.judged(model.labelled(shapes)).where(F.col("good") >= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
