"""The queries of the operators over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from answerflow.llm import (
    codes, divergence, mixing, packing, preferences, private, quality, repeats, search, simhash, suffixes, urls, vectors,
)
from answerflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.withColumn("fingerprint", simhash.hex_digits("fingerprint"))


@query
def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


# The query finds a pair at the threshold itself with probability 0.999; closer ones with more.
ORACLES["op1_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (
  SELECT vec_id AS id, vec_id AS reached FROM v
  UNION
  SELECT l.b, r.reached FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, seed=42)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op5_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2e0 * sum(size) AS cap,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
l AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM s) - clamped) / open_weight AS level
  FROM r WHERE cap >= weight * ((1.5 * (SELECT sum(source_size) FROM s) - clamped) / open_weight)
  ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l)) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(cap, weight * (SELECT level FROM l)) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM r),
c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS more,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN before + size / 2e0 < more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with `bad`: 1 for a toxic or low-quality document, 0 for others, null unlabelled.
    The first number in a page's path is its document."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[^0-9?#]*([0-9]+)', 1) as bigint)")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return pages.select("page_id", "url", number.alias("doc_id")).join(known, "doc_id", "left")


@query
def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ]
    judged = urls.judge(labelled_pages(spark, sf_dir), rules=rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def tree_sql(depth: int, least_pages: int, similar: float) -> str:
    """The levels of the template tree as common table expressions."""
    levels = ["t0 AS (SELECT host, segments, pages, labelled, bad, '' AS template FROM shapes)"]
    for n in range(1, depth + 2):
        levels.append(f"""
c{n} AS (
  SELECT host, template, segments[{n}] AS segment, sum(pages) AS pages, sum(labelled) AS labelled, sum(bad) AS bad
  FROM t{n - 1} WHERE len(segments) >= {n} GROUP BY ALL),
p{n} AS (
  SELECT *, CASE WHEN sum(labelled) OVER w > 0 THEN sum(bad) OVER w / CAST(sum(labelled) OVER w AS DOUBLE) ELSE 0e0 END AS rate
  FROM c{n} WINDOW w AS (PARTITION BY host, template)),
o{n} AS (
  SELECT host, template, segment FROM p{n}
  WHERE pages >= {least_pages} AND labelled > 0 AND segment <> '*'
    AND abs(bad - labelled * rate) > {similar} * sqrt(labelled * rate * (1 - rate))),
t{n} AS (
  SELECT t.host, segments, pages, labelled, bad,
         CASE WHEN len(segments) < {n} THEN t.template ELSE t.template || '/' || coalesce(o.segment, '*') END AS template
  FROM t{n - 1} t LEFT JOIN o{n} o ON t.host = o.host AND t.template = o.template AND t.segments[{n}] = o.segment)""")
    return ",".join(levels)


ORACLES["op9_url_templates"] = rf"""
WITH k AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
u AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest,
         TRY_CAST(regexp_extract(url, '^[^:]*://[^/?#]*/[^0-9?#]*([0-9]+)', 1) AS BIGINT) AS doc_id
  FROM pages),
h AS (
  SELECT page_id, bad, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u LEFT JOIN k ON u.doc_id = k.doc_id),
s AS (
  SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS parts,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h),
b AS (
  SELECT page_id, bad, host, path, rule,
         list_transform(CASE WHEN len(parts) > 4 THEN list_concat(parts[1:4], ['*']) ELSE parts END,
                        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segments
  FROM s),
shapes AS (
  SELECT host, segments, count(*) AS pages, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM b GROUP BY ALL),
{tree_sql(4, 5, 2.0)},
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN 1 - sum(bad) / CAST(sum(labelled) AS DOUBLE) ELSE 1e0 END AS share FROM t5),
j AS (
  SELECT host, template, (sum(labelled - bad) + 10 * (SELECT share FROM prior)) / (sum(labelled) + 10e0) AS purity
  FROM t5 GROUP BY ALL)
SELECT page_id, b.host, b.path, b.rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
       j.template, round(purity, 9) AS purity
FROM b JOIN t5 ON b.host = t5.host AND b.segments = t5.segments JOIN j ON t5.host = j.host AND t5.template = j.template
"""


@query
def op10_private_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private.pseudonymize(docs, secret="answerflow", counted="n_replaced")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("id").alias("doc_id"), *[F.round(c, 6).alias(c) for c in ("evidence", "site_good", "good")], "kept"
    )


ORACLES["op2_quality_classifier"] = r"""
WITH l AS (SELECT doc_id AS of_id, min(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host,
         coalesce('=' || source, '') || '/' || coalesce('=' || lang, '') AS path,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
m AS (
  SELECT doc_id, host, path, greatest(length(text), 1) AS chars, greatest(len(words), 1) AS n, len(list_distinct(words)) AS different,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper,
         length(text) - length(translate(text, '!#$%&*|@^~<>{}[]=+/_', '')) AS symbols,
         coalesce(list_sum(list_transform(list_zip(words, words[2:]), lambda x: CASE WHEN x[1] = x[2] THEN 1 ELSE 0 END)), 0) AS again
  FROM t),
b AS (
  SELECT doc_id, host, path, good, (upper * 20) // chars AS f1, least((symbols * 40) // chars, 20) AS f2,
         ((n >= 8)::INT + (n >= 32)::INT + (n >= 128)::INT + (n >= 512)::INT + (n >= 2048)::INT) * 11 + (different * 10) // n AS f3,
         least(chars // n, 16) AS f4, (again * 4) // n AS f5
  FROM m LEFT JOIN l ON doc_id = of_id),
a AS (SELECT sum(good) AS g, count(good) - sum(good) AS b FROM b),
c AS (
  SELECT feature, bin, sum(good) AS g, count(*) - sum(good) AS b
  FROM (SELECT good, unnest([1, 2, 3, 4, 5]) AS feature, unnest([f1, f2, f3, f4, f5]) AS bin FROM b WHERE good IS NOT NULL) GROUP BY ALL),
w AS (SELECT unnest([1, 2, 3, 4, 5]) AS feature, unnest([21, 21, 66, 17, 5]) AS bins),
z AS (
  SELECT feature, ln(1e0 / (a.g + bins)) - ln(1e0 / (a.b + bins)) AS unseen FROM w, a),
r AS (
  SELECT feature, bin, ln((c.g + 1e0) / (a.g + bins)) - ln((c.b + 1e0) / (a.b + bins)) AS ratio FROM c JOIN w USING (feature), a),
e AS (
  SELECT b.*, coalesce(r1.ratio, (SELECT unseen FROM z WHERE feature = 1)) + coalesce(r2.ratio, (SELECT unseen FROM z WHERE feature = 2))
            + coalesce(r3.ratio, (SELECT unseen FROM z WHERE feature = 3)) + coalesce(r4.ratio, (SELECT unseen FROM z WHERE feature = 4))
            + coalesce(r5.ratio, (SELECT unseen FROM z WHERE feature = 5)) AS evidence
  FROM b LEFT JOIN r r1 ON r1.feature = 1 AND r1.bin = f1 LEFT JOIN r r2 ON r2.feature = 2 AND r2.bin = f2
         LEFT JOIN r r3 ON r3.feature = 3 AND r3.bin = f3 LEFT JOIN r r4 ON r4.feature = 4 AND r4.bin = f4 LEFT JOIN r r5 ON r5.feature = 5 AND r5.bin = f5),
v AS (
  SELECT e.*, 1 / (1 + exp(-(evidence + ln((a.g + 1e0) / (a.b + 1e0))))) AS own,
         coalesce(CAST(e.good AS DOUBLE), 1 / (1 + exp(-(evidence + ln((a.g + 1e0) / (a.b + 1e0)))))) AS vote FROM e, a),
p AS (SELECT host, path, count(*) AS n, sum(vote) AS k FROM v GROUP BY host, path),
h AS (SELECT host, sum(n) AS host_n, sum(k) AS host_k, count(*) AS parts, sum(k * k / n) AS kk, sum(n * n) AS nn FROM p GROUP BY host),
s AS (
  SELECT sum(host_n) AS n, (sum(host_k) + 1e0) / (sum(host_n) + 2e0) AS p,
         sum(host_k * host_k / host_n) - sum(host_k) * sum(host_k) / sum(host_n) AS host_spread, count(*) - 1 AS host_groups,
         sum(CAST(host_n AS DOUBLE) * host_n) / sum(host_n) AS host_squares,
         sum(kk) - sum(host_k * host_k / host_n) AS path_spread, sum(parts) - count(*) AS path_groups, sum(nn / host_n) AS path_squares
  FROM h),
q AS (
  SELECT p, CASE WHEN host_spread - host_groups * p * (1 - p) <= 0 OR n - host_squares - host_groups <= 0 THEN 1e6
                 ELSE least(greatest(p * (1 - p) / ((host_spread - host_groups * (p * (1 - p))) / (n - host_squares - host_groups)) - 1, 1), 1e6) END AS host_m,
         CASE WHEN path_spread - path_groups * p * (1 - p) <= 0 OR n - path_squares - path_groups <= 0 THEN 1e6
              ELSE least(greatest(p * (1 - p) / ((path_spread - path_groups * (p * (1 - p))) / (n - path_squares - path_groups)) - 1, 1), 1e6) END AS path_m
  FROM s),
g AS (
  SELECT doc_id, evidence,
         least(greatest((k - vote + path_m * ((host_k - vote + host_m * p) / (host_n - 1 + host_m))) / (p.n - 1 + path_m), 1e-9), 1 - 1e-9) AS site_good
  FROM v JOIN p USING (path) JOIN h ON h.host = v.host, q)
SELECT doc_id, round(evidence, 6) AS evidence, round(site_good, 6) AS site_good,
       round(1 / (1 + exp(-(evidence + ln(site_good / (1 - site_good))))), 6) AS good,
       1 / (1 + exp(-(evidence + ln(site_good / (1 - site_good))))) >= 0.25 AS kept
FROM g
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=4096, end=2)


def answered_twice(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs: a conversation is chosen over itself with its last answer replaced by that
    of its neighbour (0 and 1, 2 and 3, ...). The chosen one gets twice its number, the other
    one more."""
    conversations = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    last = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    partner = F.col("conv_id") + F.when(F.col("conv_id") % 2 == 0, 1).otherwise(-1)
    other = last.select(partner.alias("conv_id"), F.col("last.text").alias("other"))
    own = last.select("conv_id", F.col("last.turn").alias("last_turn"))
    swaps = own.join(other, "conv_id")
    swapped = conversations.join(swaps, "conv_id", "left")
    here = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    rejected = swapped.select(
        (F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", F.when(here, F.col("other")).otherwise(F.col("text")).alias("text")
    )
    chosen = conversations.select((F.col("conv_id") * 2).alias("conv_id"), "turn", "role", "text")
    ids = conversations.select("conv_id").distinct()
    pairs = ids.select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 2).alias("chosen"), (F.col("conv_id") * 2 + 1).alias("rejected"))
    return chosen.unionAll(rejected), pairs


@query
def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preferences(*answered_twice(table(spark, sf_dir, "conversations")))


ORACLES["op7_preference_pairs"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (
  SELECT conv_id, turn AS last_turn, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM c WHERE role = 'assistant')
  WHERE rn = 1),
s AS (
  SELECT a.conv_id, a.last_turn, b.text AS other
  FROM l a JOIN l b ON b.conv_id = a.conv_id + CASE WHEN a.conv_id % 2 = 0 THEN 1 ELSE -1 END),
t AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL
  SELECT c.conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN other ELSE text END
  FROM c LEFT JOIN s ON c.conv_id = s.conv_id),
r AS (
  SELECT *, '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) AS opening FROM t),
x AS (SELECT *, opening || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rendered FROM r),
n AS (
  SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM x WINDOW w AS (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT conv_id, min(position) AS apart, arg_min(before, position) AS chars FROM (
    SELECT conv_id, position, min(before) AS before FROM n GROUP BY conv_id, position
    HAVING count(*) < 2 OR min(role) IS DISTINCT FROM max(role) OR min(text) IS DISTINCT FROM max(text)
      OR count(role) = 1 OR count(text) = 1)
  GROUP BY conv_id),
o AS (
  SELECT n.*, CASE WHEN apart IS NULL OR position < apart THEN 'prompt' ELSE side END AS part, chars
  FROM n LEFT JOIN p ON n.conv_id = p.conv_id),
q AS (SELECT *, before - CASE WHEN part = 'prompt' THEN 0 ELSE chars END AS start FROM o WHERE NOT (part = 'prompt' AND side = 'rejected'))
SELECT conv_id AS pair_id, part, position, role, rendered AS text, CAST(start AS BIGINT) AS start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(opening) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) END AS BIGINT) AS mask_end
FROM q
"""


@query
def op8_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    found = search.search(docs, asked, k=10)
    return found.withColumn("score", F.round("score", 6))


ORACLES["op8_top_documents"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS average),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM t, s GROUP BY term, n),
r AS (
  SELECT q.doc_id AS query_id, t.doc_id, sum(q.tf * idf * (t.tf * 2.2e0 / (t.tf + 1.2e0 * (0.25e0 + 0.75e0 * len / average)))) AS score
  FROM t q JOIN i USING (term) JOIN t USING (term) JOIN l ON l.doc_id = t.doc_id, s
  WHERE q.doc_id % 20 = 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM o WHERE rank <= 10
"""


@query
def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.score(table(spark, sf_dir, "documents"), depth=2, fold=10)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


ORACLES["op11_source_divergence"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row FROM documents),
w AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce(v.n, 0) AS lang_n, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN v ON v.lang = a.lang LEFT JOIN c ON c.lang = a.lang AND c.source = a.source
  GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS HUGEINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.total + 2)) // (g.lang_n + 2 * g.v) AS HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
u AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.fingerprint(books)).alias("codebooks_sha256")
    )


def rounds_sql(rounds: int) -> str:
    """Assignment and averaging as common table expressions, one pair a round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, x.part, any_value(x.v) AS v,
         min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.entry) AS best
  FROM parts x JOIN b{n} b ON x.part = b.part GROUP BY vec_id, x.part)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (
  SELECT part, CAST(best % 16 AS BIGINT) AS entry, place, CAST(sum(value) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT part, best, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM s{n} GROUP BY part, entry),
b{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry)""")
    return ",".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * 4096) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) - 1 AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, n, p AS part, v[p * 8 + 1 : p * 8 + 8] AS v FROM e, range(8) r(p)),
b0 AS MATERIALIZED (SELECT part, n AS entry, v FROM parts WHERE n < 16),
{rounds_sql(6)},
f AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best % 16 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM a6 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN e ON e.vec_id = f.vec_id, h
"""


@query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.without_repeats(table(spark, sf_dir, "documents"), window=50)
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_repeated_passages"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT row, doc_id, unnest(range(1, len(w) - 48)) AS i,
         unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) AS h
  FROM d WHERE len(w) >= 50),
m AS (SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM g) WHERE low < doc_id),
c AS (SELECT row, list(DISTINCT i + k) AS gone FROM m, range(50) r(k) GROUP BY row),
l AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM d LEFT JOIN c ON c.row = d.row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM l
"""
