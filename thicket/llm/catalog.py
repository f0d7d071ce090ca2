"""Registered queries and their SQL: training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import balanced, groups, leaks, mixing, neighbours, overlap, sentences, vectors
from thicket.plans.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    report = balanced.draw(table(spark, d, "snode"), table(spark, d, "label_target"))[1]
    return report.filter("short").select("plan_id", "truelabel").distinct()


@query
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return balanced.draw(table(spark, d, "snode"), table(spark, d, "label_target"))[0]


@query
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return balanced.draw(table(spark, d, "snode"), table(spark, d, "label_target"))[1]


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


@query
def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_item")
    return leaks.report(leaks.leaks(table(spark, d, "documents"), items), items)


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.compose(mixing.unit_sizes(table(spark, d, "documents")), table(spark, d, "mix_target"))[1]
    return report.filter("short").select("mix_id", "source").distinct()


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix and the report on it, in the unit of p8_found."""
    return mixing.compose(mixing.unit_sizes(table(spark, d, "documents")), table(spark, d, "mix_target"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.in_shard_order(_mix(spark, d)[0])


ORACLE["p2_found"] = """
WITH r AS (SELECT node_id, min((subgraph_id, truelabel)) AS x FROM snode WHERE node_id IS NOT NULL GROUP BY node_id),
c AS (SELECT x[1] AS subgraph_id, x[2] AS truelabel, count(*) AS n FROM r GROUP BY ALL)
SELECT DISTINCT t.plan_id, t.truelabel FROM label_target t LEFT JOIN c ON c.subgraph_id = t.subgraph_id AND c.truelabel = t.truelabel
WHERE coalesce(c.n, 0) < greatest(coalesce(t.min_rows, 0), floor(coalesce(t.share * t.draw_size, 0)))
"""

_UNIT = r"\p{L}+|\p{N}+|[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\p{L}\p{N}]+"
ORACLE["p8_found"] = f"""
WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{_UNIT}')) AS size FROM documents),
s AS (SELECT source, sum(size) AS have FROM d GROUP BY source), t AS (SELECT sum(size) AS total FROM d)
SELECT DISTINCT m.mix_id, m.source FROM mix_target m CROSS JOIN t LEFT JOIN s USING (source)
WHERE coalesce(m.share * m.budget_ratio, 0) * t.total > coalesce(m.max_repeat, 0) * coalesce(s.have, 0)
"""

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
ORACLE["p7_found"] = f"""
WITH p AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_item),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM p, unnest(range(1, len(w) - 10)) AS t(i)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM d, unnest(range(1, len(w) - 10)) AS t(i))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (run)
"""

_LEAKS = f"""
WITH p AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_item),
g AS (SELECT item_id, i AS place, array_to_string(w[i:i + 11], ' ') AS run FROM p, unnest(range(1, len(w) - 10)) AS t(i)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
h AS (SELECT doc_id, i AS pos, array_to_string(w[i:i + 11], ' ') AS run FROM d, unnest(range(1, len(w) - 10)) AS t(i)),
m AS (SELECT doc_id, item_id, pos, place FROM g JOIN h USING (run)),
s AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - place ORDER BY pos) AS island FROM m),
r AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM s GROUP BY doc_id, item_id, pos - place, island),
l AS (SELECT doc_id, item_id, max(n) AS longest_run FROM r GROUP BY ALL),
k AS (SELECT doc_id, item_id, least(12, coalesce(place - lag(place) OVER (PARTITION BY doc_id, item_id ORDER BY place), 12)) AS fresh FROM (SELECT DISTINCT doc_id, item_id, place FROM m)),
c AS (SELECT doc_id, item_id, count(*) AS windows, sum(fresh) AS n FROM k GROUP BY ALL),
f AS (SELECT doc_id, item_id, min(pos) - 1 AS first_word FROM m GROUP BY ALL),
x AS (SELECT doc_id, item_id, windows, first_word, longest_run, c.n / len(p.w) AS covered FROM c JOIN f USING (doc_id, item_id) JOIN l USING (doc_id, item_id) JOIN p USING (item_id))
"""
ORACLE["p7_leaks"] = _LEAKS + "SELECT * FROM x"
ORACLE["p7_report"] = _LEAKS + """, i AS (SELECT item_id, count(*) AS docs, max(covered) AS covered FROM x GROUP BY ALL)
SELECT suite, held_out, count(*) AS items, count(docs) AS leaked, CAST(coalesce(sum(docs), 0) AS BIGINT) AS hits, max(covered) AS most_covered FROM eval_item LEFT JOIN i USING (item_id) GROUP BY ALL"""


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.overlaps(table(spark, d, "snode"), table(spark, d, "subgraph"))
    return found.select(F.least("held_id", "train_id").alias("node_lo"), F.greatest("held_id", "train_id").alias("node_hi")).distinct()


@query
def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "snode"), table(spark, d, "subgraph"))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.report(overlap.overlaps(table(spark, d, "snode"), table(spark, d, "subgraph")))
    return found.withColumn("mean_coverage", F.round("mean_coverage", 6))


# at most two dimensions differ, so one of the first three agrees
_PAIRS = """
WITH s AS (SELECT DISTINCT n.node_id, g.split, n.source, n.feat AS f, len(n.feat) AS d FROM snode n JOIN subgraph g USING (subgraph_id)
           WHERE n.node_id IS NOT NULL AND len(n.feat) >= 16 AND g.split IN ('train', 'eval', 'test')),
t AS (SELECT * FROM s WHERE split = 'train'), h AS (SELECT * FROM s WHERE split <> 'train'),
c AS (""" + " UNION ".join(f"SELECT t.node_id AS t, h.node_id AS h FROM t JOIN h ON t.d = h.d AND t.f[{j}] BETWEEN h.f[{j}] - 0.03 AND h.f[{j}] + 0.03" for j in (1, 2, 3)) + """),
p AS (SELECT h.node_id AS held_id, h.split AS held_split, h.source AS held_source, t.node_id AS train_id, t.source AS train_source, t.d,
        len(list_filter(list_zip(t.f, h.f), lambda z: coalesce(abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) <= 0.02, false))) AS matched
      FROM c JOIN t ON t.node_id = c.t JOIN h ON h.node_id = c.h),
q AS (SELECT * FROM p WHERE matched >= d - 2)
"""
ORACLE["p1_found"] = _PAIRS + "SELECT DISTINCT least(held_id, train_id) AS node_lo, greatest(held_id, train_id) AS node_hi FROM q"
ORACLE["p1_report"] = _PAIRS + """, b AS (SELECT held_split, held_source, train_source, held_id, count(*) AS pairs, max(matched / d) AS c FROM q GROUP BY ALL)
SELECT held_split, held_source, train_source, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS held_records, round(avg(c), 6) AS mean_coverage FROM b GROUP BY ALL"""

_USABLE = """u AS MATERIALIZED (SELECT DISTINCT n.node_id, g.nfeats AS d, CAST(n.feat AS DOUBLE[]) AS f, g.bestk FROM snode n JOIN subgraph g USING (subgraph_id)
  WHERE n.node_id IS NOT NULL AND len(n.feat) = g.nfeats AND len(list_filter(n.feat, lambda v: v IS NULL OR NOT isfinite(v))) = 0)"""
_NEAREST = """, e AS (SELECT q.probe_id, r.node_id, q.bestk, list_distance(q.f, r.f) AS distance FROM q JOIN u r ON r.d = q.d AND r.node_id <> q.node_id),
k AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, node_id) AS rank FROM e QUALIFY rank <= bestk)
"""
ORACLE["p5_found"] = f"WITH {_USABLE}, q AS (SELECT p.probe_id, u.* FROM knn_probe p JOIN u USING (node_id)){_NEAREST}SELECT probe_id, node_id FROM k"
ORACLE["p5_knn"] = f"WITH {_USABLE}, q AS (SELECT node_id AS probe_id, * FROM u WHERE node_id % 50 = 0){_NEAREST}SELECT probe_id AS query_id, node_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM k"

# the smallest id reached; every round, each row takes the least of its own and its neighbours' ids
ORACLE["p4_found"] = f"""WITH RECURSIVE {_USABLE},
l AS MATERIALIZED (SELECT a.node_id AS a, b.node_id AS b FROM u a JOIN u b ON a.d = b.d AND b.f[1] BETWEEN a.f[1] - 2.6 AND a.f[1] + 2.6 AND b.f[2] BETWEEN a.f[2] - 2.6 AND a.f[2] + 2.6
  AND a.node_id <> b.node_id WHERE list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= 6.25),
c(node_id, m) USING KEY (node_id) AS (
  SELECT node_id, node_id FROM u
  UNION (SELECT l.b, min(c.m) FROM c JOIN l ON l.a = c.node_id JOIN recurring.c o ON o.node_id = l.b WHERE c.m < o.m GROUP BY l.b)),
g AS (SELECT m FROM c GROUP BY m HAVING count(*) >= 5)
SELECT c.m AS cluster_id, c.node_id FROM c JOIN g USING (m)"""


def _knn(spark: SparkSession, d: str, probes: DataFrame) -> DataFrame:
    """Neighbours of the samples in ``probes`` (``probe_id, node_id``) among all usable vectors."""
    samples = table(spark, d, "snode")
    usable = vectors.usable(samples, table(spark, d, "subgraph"), "bestk")
    wanted = probes.select("probe_id", F.col("node_id").alias("_n"))
    asked = usable.join(wanted, F.col("node_id") == F.col("_n")).select("probe_id", "node_id", "d", "feat", F.col("bestk").alias("k"))
    return neighbours.neighbours(usable, asked)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, table(spark, d, "knn_probe")).select("probe_id", "node_id")


@query
def p5_knn(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "snode").filter(F.col("node_id") % 50 == 0).select(F.col("node_id").alias("probe_id"), "node_id").distinct()
    return _knn(spark, d, samples).select(F.col("probe_id").alias("query_id"), "node_id", F.round("distance", 6).alias("distance"), "rank")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.linked(vectors.usable(table(spark, d, "snode"), table(spark, d, "subgraph")))


@query
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.describe(vectors.usable(table(spark, d, "snode"), table(spark, d, "subgraph")))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences.sentences(docs.filter("doc_class = 'prose'"), sentences.fit(docs.filter("doc_class = 'prose'"))).distinct()


@query
def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sentences.sentences(docs, sentences.fit(docs.filter("doc_class = 'prose'")))
