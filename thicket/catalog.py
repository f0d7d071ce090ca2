"""Registered queries and their SQL: the core operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.distances import DISTANCES, Distance
from thicket.operators import clustering, evaluate, hierarchy, maxtree, pairwise, parsing, prepare, spanning, supervised
from thicket.plans.runtime import cut, scratch, table
from thicket.sources import ascii as text_form
from thicket.sources import binary
from thicket.sources import samples as data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Split, train, classify and score."""
    train, test = prepare.split(data.embeddings(spark, d), 0.5)
    return evaluate.balanced_accuracy(supervised.classify(supervised.fit(train), test))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.contradictions(table(spark, d, "model_node"))


@query
def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(table(spark, d, "model_node"))


@query
def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.paths(table(spark, d, "model_node")))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rejected(table(spark, d, "raw_line"), table(spark, d, "subgraph"))


@query
def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parsing.strict_load(table(spark, d, "raw_line"), table(spark, d, "subgraph"))


ORACLE["p3_found"] = """
WITH RECURSIVE n AS (SELECT DISTINCT model_id, position, pred, root, pathval FROM model_node WHERE model_id IS NOT NULL AND position IS NOT NULL),
link AS (SELECT a.model_id, a.position, b.position AS up, b.pathval AS c FROM n a JOIN n b ON b.model_id = a.model_id AND b.position = a.pred AND a.pred <> -1),
down AS (
  SELECT model_id, position, position AS top, CAST(NULL AS DOUBLE) AS high FROM n
  WHERE (model_id, position) NOT IN (SELECT (model_id, position) FROM link)
  UNION ALL
  SELECT l.model_id, l.position, d.top, greatest(d.high, l.c) FROM down d JOIN link l ON l.model_id = d.model_id AND l.up = d.position),
stuck AS (SELECT l.* FROM link l ANTI JOIN down d ON d.model_id = l.model_id AND d.position = l.position),
walk AS (
  SELECT model_id, position, up AS here FROM stuck
  UNION
  SELECT w.model_id, w.position, s.up FROM walk w JOIN stuck s ON s.model_id = w.model_id AND s.position = w.here),
onloop AS (SELECT DISTINCT model_id, position FROM walk WHERE here = position)
SELECT s.model_id, s.position, CASE WHEN o.position IS NULL THEN 'astray' ELSE 'cycle' END AS kind
FROM stuck s LEFT JOIN onloop o ON o.model_id = s.model_id AND o.position = s.position
UNION ALL SELECT d.model_id, d.position, 'root' FROM down d JOIN n USING (model_id, position) WHERE n.root IS DISTINCT FROM d.top
UNION ALL SELECT d.model_id, d.position, 'cost' FROM down d JOIN n USING (model_id, position) WHERE n.pathval < d.high
"""

ORACLE["p3_paths"] = """
WITH RECURSIVE n AS (SELECT DISTINCT model_id, position, pred FROM model_node WHERE model_id IS NOT NULL AND position IS NOT NULL),
link AS (SELECT a.model_id, a.position, b.position AS up FROM n a JOIN n b ON b.model_id = a.model_id AND b.position = a.pred AND a.pred <> -1),
down AS (
  SELECT model_id, position, position AS root, CAST(0 AS BIGINT) AS depth, [position] AS path FROM n
  WHERE (model_id, position) NOT IN (SELECT (model_id, position) FROM link)
  UNION ALL
  SELECT l.model_id, l.position, d.root, d.depth + 1, list_append(d.path, l.position) FROM down d JOIN link l ON l.model_id = d.model_id AND l.up = d.position)
SELECT * FROM down
UNION ALL SELECT l.model_id, l.position, NULL, NULL, NULL FROM link l ANTI JOIN down d ON d.model_id = l.model_id AND d.position = l.position
"""

ORACLE["p3_descendants"] = """
WITH RECURSIVE n AS (SELECT DISTINCT model_id, position, pred FROM model_node WHERE model_id IS NOT NULL AND position IS NOT NULL),
link AS (SELECT a.model_id, a.position, b.position AS up FROM n a JOIN n b ON b.model_id = a.model_id AND b.position = a.pred AND a.pred <> -1),
down AS (
  SELECT model_id, position, CAST(0 AS BIGINT) AS depth, [position] AS path FROM n
  WHERE (model_id, position) NOT IN (SELECT (model_id, position) FROM link)
  UNION ALL
  SELECT l.model_id, l.position, d.depth + 1, list_append(d.path, l.position) FROM down d JOIN link l ON l.model_id = d.model_id AND l.up = d.position)
SELECT model_id, path[i] AS ancestor, position AS descendant, depth + 1 - i AS steps
FROM down, unnest(range(1, depth + 1)) AS t(i)
"""

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = r'([ \t]*"([^"]|"")*"[ \t]*|[^",]*)'
_P6 = rf"""
WITH l AS (SELECT r.raw_id, r.subgraph_id, s.nfeats, s.nlabels, lower(coalesce(fmt, 'txt')) = 'csv' AS csv, regexp_replace(coalesce(line, ''), '\r\z', '') AS body
           FROM raw_line r LEFT JOIN subgraph s USING (subgraph_id)),
q AS (SELECT *, csv AND NOT regexp_full_match(body, '{_FIELD}(,{_FIELD})*', 's') AS broken FROM l),
f AS (SELECT *, CASE WHEN broken THEN []
        WHEN csv THEN list_transform(regexp_extract_all(',' || body, ',{_FIELD}', 1, 's'), lambda x: trim(x, E' \t'))
        ELSE list_filter(string_split_regex(body, '[ \t]+'), lambda x: x <> '') END AS parts FROM q),
u AS (SELECT *, list_transform(parts, lambda x: CASE WHEN csv AND x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS fields FROM f),
g AS (SELECT *, fields[(CASE WHEN csv THEN 4 ELSE 3 END):] AS feats FROM u),
j AS (SELECT raw_id, subgraph_id, fields, feats, CASE WHEN broken THEN 'quoting'
   WHEN NOT coalesce(len(fields) = nfeats + CASE WHEN csv THEN 3 ELSE 2 END, false) THEN 'columns'
   WHEN NOT regexp_full_match(fields[1], '[0-9]+') THEN 'ident'
   WHEN NOT regexp_full_match(fields[2], '[0-9]+') OR coalesce(TRY_CAST(fields[2] AS HUGEINT), 99999999999) > nlabels THEN 'label'
   WHEN len(list_filter(feats, lambda x: NOT regexp_full_match(x, '{_NUMBER}') OR coalesce(abs(TRY_CAST(x AS DOUBLE)), 1e39) > 3.4028234663852886e38)) > 0 THEN 'feature' END AS reason FROM g)
"""
ORACLE["p6_found"] = _P6 + "SELECT DISTINCT raw_id, reason FROM j WHERE reason IS NOT NULL"
ORACLE["p6_loaded"] = _P6 + "SELECT raw_id, subgraph_id, CAST(fields[1] AS DECIMAL(38,0)) AS position, CAST(fields[2] AS INTEGER) AS truelabel, CAST(feats AS FLOAT[]) AS feat FROM j WHERE reason IS NULL"


# Reference operators. SQL below reads samples as s(p, y, f).
_EMB = "s AS (SELECT CAST(vec_id AS BIGINT) AS p, label + 1 AS y, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
_EMB_POS = "s AS (SELECT CAST(vec_id AS BIGINT) AS p, label + 1 AS y, list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v)) AS f FROM embeddings)"
_EMB3 = "s AS (SELECT CAST(vec_id AS BIGINT) AS p, 1 + CAST(f[1] > 0 AS INT) + 2 * CAST(f[2] > 0 AS INT) AS y, f[1:3] AS f FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings))"
_LINE = """s AS (SELECT CAST(l_orderkey AS BIGINT) * 16 + CAST(l_linenumber AS BIGINT) AS p, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS y,
  [CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS f FROM lineitem)"""


def _term(expr: str) -> str:
    return f"list_sum(list_transform(list_zip(a.f, b.f), lambda z: {expr}))"


_SQ = _term("(z[1] - z[2]) * (z[1] - z[2])")
_LOG = f"100000 * ln({_SQ} + 1)"

_SQL_DISTANCE = {
    "euclidean_classic": _SQ,
    "euclidean_standard": f"sqrt({_SQ})",
    "euclid_log": _LOG,
    "gaussian(1.0)": f"exp(-sqrt({_SQ}))",
    "chi_square_classic": "sqrt(" + _term("pow(z[1] / list_sum(a.f) - z[2] / list_sum(b.f), 2) / (z[1] + z[2] + 1e-9)") + ")",
    "chi_square_standard": _term("CASE WHEN z[1] + z[2] > 0 THEN (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2]) ELSE 0 END"),
    "manhattan": _term("abs(z[1] - z[2])"),
    "canberra_classic": _term("CASE WHEN abs(z[1] + z[2]) > 0 THEN abs(z[1] - z[2]) / abs(z[1] + z[2]) ELSE 0 END"),
    "canberra_standard": _term("CASE WHEN z[1] + z[2] > 0 THEN abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) ELSE 0 END"),
    "squared_chord": _term("CASE WHEN z[1] >= 0 AND z[2] >= 0 THEN pow(sqrt(greatest(z[1], 0)) - sqrt(greatest(z[2], 0)), 2) ELSE 0 END"),
    "squared_chi_squared": _term("CASE WHEN abs(z[1] + z[2]) > 0 THEN (z[1] - z[2]) * (z[1] - z[2]) / abs(z[1] + z[2]) ELSE 0 END"),
    "bray_curtis_classic": _term("CASE WHEN z[1] + z[2] > 0 THEN abs(z[1] - z[2]) / (z[1] + z[2]) ELSE 0 END"),
    "bray_curtis_standard": _term("abs(z[1] - z[2])") + " / " + _term("z[1] + z[2]"),
}
#: Metrics that are meant for non-negative features.
_POSITIVE = {"chi_square_classic", "chi_square_standard", "squared_chord", "squared_chi_squared", "bray_curtis_classic", "bray_curtis_standard"}


def _distance_query(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = data.embeddings(spark, d, metric in _POSITIVE).select("position", "feat")
        after = s.select((F.col("position") - 1).alias("position"), F.col("position").alias("j"), F.col("feat").alias("other"))
        return s.join(after, "position").select(F.col("position").alias("i"), "j", F.round(DISTANCES[metric].column(F.col("feat"), F.col("other")), 3 if metric == "euclid_log" else 6).alias("d"))

    return run


for _name, _expr in _SQL_DISTANCE.items():
    _key = "dist_" + _name.replace("(1.0)", "")
    QUERIES[_key] = _distance_query(_name)
    ORACLE[_key] = f"WITH {_EMB_POS if _name in _POSITIVE else _EMB} SELECT a.p AS i, b.p AS j, round({_expr}, {3 if _name == 'euclid_log' else 6}) AS d FROM s a JOIN s b ON b.p = a.p + 1"


@query
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.distance_matrix(data.embeddings3(spark, d)).select("i", "j", F.round("d", 6).alias("d"))


@query
def distance_matrix_normalized(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.distance_matrix(data.embeddings3(spark, d), "manhattan", True).select("i", "j", F.round("d", 6).alias("d"))


@query
def distance_matrix_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.symmetric_matrix(data.embeddings3(spark, d)).select("i", "j", F.round("d", 6).alias("d"))


ORACLE["distance_matrix"] = ORACLE["distance_matrix_symmetric"] = f"WITH {_EMB3} SELECT a.p AS i, b.p AS j, round(sqrt({_SQ}), 6) AS d FROM s a, s b"
ORACLE["distance_matrix_normalized"] = f"WITH {_EMB3}, m AS (SELECT a.p AS i, b.p AS j, {_SQL_DISTANCE['manhattan']} AS d FROM s a, s b) SELECT i, j, round(d / (SELECT max(d) FROM m), 6) AS d FROM m"


@query
def info(spark: SparkSession, d: str) -> DataFrame:
    return prepare.info(data.lines(spark, d))


ORACLE["info"] = f"WITH {_LINE} SELECT count(*) AS nnodes, max(y) AS nlabels, max(len(f)) AS nfeats FROM s"


@query
def ascii_export(spark: SparkSession, d: str) -> DataFrame:
    return text_form.to_lines(data.embeddings3(spark, d))


@query
def ascii_parse(spark: SparkSession, d: str) -> DataFrame:
    return text_form.parse_lines(text_form.to_lines(data.embeddings3(spark, d)))


@query
def ascii_check(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_line").filter("fmt = 'txt'").select(F.col("raw_id").alias("line_no"), "line")
    return text_form.check(raw, 20, 8)


@query
def ascii_check_files(spark: SparkSession, d: str) -> DataFrame:
    """Every line by the header of its own file; ``ascii_check`` has one for all, as its SQL does."""
    head = table(spark, d, "subgraph").select("subgraph_id", "nfeats", "nlabels").dropDuplicates(["subgraph_id"])
    raw = table(spark, d, "raw_line").filter("fmt = 'txt'").join(head, "subgraph_id", "left")
    return text_form.check(raw.select(F.col("raw_id").alias("line_no"), "line", "nfeats", "nlabels"), F.col("nfeats"), F.col("nlabels"))


_LINES = "list_transform(f, lambda v: format('{:.6f}', v))"
ORACLE["ascii_export"] = f"WITH {_EMB3} SELECT p AS position, p || ' ' || y || ' ' || array_to_string({_LINES}, ' ') AS line FROM s"
ORACLE["ascii_parse"] = f"WITH {_EMB3} SELECT p AS position, y AS truelabel, CAST({_LINES} AS DOUBLE[]) AS feat FROM s"
ORACLE["ascii_check"] = rf"""
WITH p AS (SELECT raw_id AS line_no, string_split_regex(trim(line, ' '), '[ \t]+') AS p FROM raw_line WHERE fmt = 'txt')
SELECT line_no, coalesce(len(p) = 22 AND regexp_full_match(p[1], '[0-9]+') AND regexp_full_match(p[2], '[0-9]+') AND coalesce(TRY_CAST(p[2] AS BIGINT) BETWEEN 1 AND 8, false)
  AND len(list_filter(p[3:22], lambda x: NOT regexp_full_match(x, '{_NUMBER}'))) = 0, false) AS ok FROM p
"""
ORACLE["ascii_check_files"] = rf"""
WITH p AS (SELECT raw_id AS line_no, nfeats, nlabels, string_split_regex(trim(line, ' '), '[ \t]+') AS p FROM raw_line LEFT JOIN subgraph USING (subgraph_id) WHERE fmt = 'txt')
SELECT line_no, coalesce(len(p) = nfeats + 2 AND regexp_full_match(p[1], '[0-9]+') AND regexp_full_match(p[2], '[0-9]+') AND coalesce(TRY_CAST(p[2] AS BIGINT) BETWEEN 1 AND nlabels, false)
  AND len(list_filter(p[3:nfeats + 2], lambda x: NOT regexp_full_match(x, '{_NUMBER}'))) = 0, false) AS ok FROM p
"""


@query
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return prepare.normalize(data.lines(spark, d)).select("position", F.transform("feat", lambda v: F.round(v, 6)).alias("feat"))


@query
def normalize_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return prepare.normalize(prepare.kfold(data.embeddings3(spark, d), 5), ("fold",)).select("position", "fold", F.transform("feat", lambda v: F.round(v, 6)).alias("feat"))


def _z(by: str) -> str:
    return f"""w AS (SELECT s.*, unnest(range(1, len(f) + 1)) AS j FROM s), t AS (SELECT {by} j, avg(f[j]) AS m, stddev_pop(f[j]) AS sd FROM w GROUP BY ALL),
u AS (SELECT {by} 1 AS one, list(m ORDER BY j) AS ms, list(sd ORDER BY j) AS sds FROM t GROUP BY ALL)
SELECT p AS position, {by} list_transform(list_zip(f, ms, sds), lambda z: round((z[1] - z[2]) / CASE WHEN z[3] > 0 THEN z[3] ELSE 1 END, 6)) AS feat FROM (SELECT *, 1 AS one FROM s) JOIN u USING ({by} one)"""


ORACLE["normalize"] = f"WITH {_LINE}, {_z('')}"
_FOLD = "s AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY p) - 1) % 5 AS fold FROM s0)"
ORACLE["normalize_per_fold"] = f"WITH {_EMB3.replace('s AS', 's0 AS', 1)}, {_FOLD}, {_z('fold, ')}"


@query
def split_two_way(spark: SparkSession, d: str) -> DataFrame:
    a, b = prepare.split(data.lines(spark, d), 0.3)
    return a.select("position", F.lit(1).alias("part")).unionByName(b.select("position", F.lit(2).alias("part")))


@query
def split_three_way(spark: SparkSession, d: str) -> DataFrame:
    return prepare.split3(data.embeddings(spark, d), 0.5, 0.25, 0.25).select("position", "truelabel", "part")


def _sql_split(source: str, out: str, share: str, seed: int) -> str:
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(p || ':{seed}'), p) AS r, count(*) OVER (PARTITION BY y) AS n FROM {source}),
{out} AS (SELECT p, y, f, r <= greatest(CAST(floor(n * CAST({share} AS DOUBLE)) AS BIGINT), 1) AS one FROM {out}_r)"""


ORACLE["split_two_way"] = f"WITH {_LINE}, {_sql_split('s', 'k', '0.3', 1)} SELECT p AS position, CASE WHEN one THEN 1 ELSE 2 END AS part FROM k"
ORACLE["split_three_way"] = f"""WITH {_EMB}, {_sql_split('s', 'k', '0.75', 1)}, rest AS (SELECT p, y, f FROM k WHERE one), {_sql_split('rest', 'm', '0.5::DOUBLE / 0.75::DOUBLE', 2)}
SELECT p AS position, y AS truelabel, 'test' AS part FROM k WHERE NOT one UNION ALL SELECT p, y, CASE WHEN one THEN 'train' ELSE 'eval' END FROM m"""


@query
def kfold_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return prepare.kfold(data.lines(spark, d), 10).select("position", "fold")


@query
def kfold_random(spark: SparkSession, d: str) -> DataFrame:
    return prepare.random_kfold(data.embeddings(spark, d), 4).select("position", "fold")


@query
def merge(spark: SparkSession, d: str) -> DataFrame:
    one = data.parts(spark, d)
    return prepare.merge(one, one.filter("truelabel <= 5")).select("position", "truelabel", F.transform("feat", lambda v: F.round(v, 2)).alias("feat"))


ORACLE["kfold_round_robin"] = f"WITH {_LINE} SELECT p AS position, (row_number() OVER (PARTITION BY y ORDER BY p) - 1) % 10 AS fold FROM s"
ORACLE["kfold_random"] = f"""WITH {_EMB}, r AS (SELECT p, row_number() OVER (PARTITION BY y ORDER BY md5(p || ':1'), p) - 1 AS r, greatest(count(*) OVER (PARTITION BY y) // 4, 1) AS e FROM s)
SELECT p AS position, CAST(least(r // e, 3) AS INT) AS fold FROM r"""
_PART = "s AS (SELECT CAST(p_partkey AS BIGINT) AS p, CAST(('0x' || substr(md5(p_type), 1, 4)) AS INT) % 25 + 1 AS y, [round(CAST(p_size AS DOUBLE), 2), round(CAST(p_retailprice AS DOUBLE), 2)] AS f FROM part)"
ORACLE["merge"] = f"WITH {_PART} SELECT p AS position, y AS truelabel, f AS feat FROM s UNION ALL SELECT p, y, f FROM s WHERE y <= 5"


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a made-up prediction, by quantity and discount."""
    guess = F.when(F.col("feat")[0] < 20, 1).when(F.col("feat")[2] < 0.05, 2).otherwise(3)
    return data.lines(spark, d).withColumn("label", guess)


_GUESS = f"{_LINE}, g AS (SELECT p, y, CASE WHEN f[1] < 20 THEN 1 WHEN f[3] < 0.05 THEN 2 ELSE 3 END AS l FROM s)"


@query
def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.balanced_accuracy(_guessed(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_guessed(spark, d))


@query
def move_misclassified(spark: SparkSession, d: str) -> DataFrame:
    kept, moved, _ = prepare.move_misclassified(_guessed(spark, d), data.lines(spark, d).filter("truelabel = 1"))
    return kept.select("position", F.lit("source").alias("side")).unionByName(moved.select("position", F.lit("target").alias("side")))


@query
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_statistics(table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("value"))).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "runs")


ORACLE["balanced_accuracy"] = f"""WITH {_GUESS}, c AS (SELECT y, count(*) AS n, sum(CASE WHEN l <> y THEN 1 ELSE 0 END) AS miss FROM g GROUP BY y),
e AS (SELECT l, count(*) AS x FROM g WHERE l <> y GROUP BY l)
SELECT round(1 - sum(coalesce(x, 0) / ((SELECT count(*) FROM g) - n) + miss / n) / (2 * count(*)), 6) AS accuracy FROM c LEFT JOIN e ON e.l = c.y"""
ORACLE["confusion_matrix"] = f"WITH {_GUESS} SELECT y AS truelabel, l AS label, count(*) AS n FROM g GROUP BY ALL"
ORACLE["move_misclassified"] = f"WITH {_GUESS} SELECT p AS position, 'source' AS side FROM g WHERE l = y UNION ALL SELECT p, 'target' FROM g WHERE y = 1 UNION ALL SELECT p, 'target' FROM g WHERE l <> y"
ORACLE["run_statistics"] = "SELECT round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(l_quantity AS DOUBLE)), 6) AS std, count(l_quantity) AS runs FROM lineitem"

_KNN = f"""{_EMB}, e AS (SELECT a.p AS i, b.p AS j, {_LOG} AS d FROM s a, s b WHERE a.p <> b.p),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM e QUALIFY rank <= 8)"""


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.knn_graph(data.embeddings(spark, d), 8)


@query
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return _arcs(spark, d).select("i", "j", F.round("d", 3).alias("d"), "rank")


@query
def knn_radius(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.radius(_arcs(spark, d)).select("position", F.round("radius", 3).alias("radius"))


@query
def knn_maxdist_per_k(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.max_per_rank(_arcs(spark, d)).select("rank", F.round("max_d", 3).alias("max_d"))


@query
def pdf(spark: SparkSession, d: str) -> DataFrame:
    return clustering.density(cut(_arcs(spark, d))).select("position", F.round("dens", 6).alias("dens"))


@query
def elim_height(spark: SparkSession, d: str) -> DataFrame:
    return clustering.drop_height(clustering.density(cut(_arcs(spark, d))), 50.0).select("position", F.round("pathval", 6).alias("pathval"))


@query
def plateau_arcs(spark: SparkSession, d: str) -> DataFrame:
    level = data.embeddings(spark, d).select("position", (F.col("position") % 5).cast("double").alias("dens"))
    return pairwise.plateau_arcs(_arcs(spark, d), level).select("i", "j")


@query
def normalized_cut(spark: SparkSession, d: str) -> DataFrame:
    return clustering.normalized_cut(_arcs(spark, d), data.embeddings(spark, d).select("position", F.col("truelabel").alias("label"))).select(F.round("cut", 6).alias("cut"))


_DENS = f"""{_KNN}, raw AS (SELECT i AS position, sum(exp(-d / (2 * (SELECT max(d) FROM k) / 9))) / (count(*) + 1) AS v FROM k GROUP BY i),
dens AS (SELECT position, 999 * (v - (SELECT min(v) FROM raw)) / ((SELECT max(v) FROM raw) - (SELECT min(v) FROM raw)) + 1 AS dens FROM raw)"""
ORACLE["knn_graph"] = f"WITH {_KNN} SELECT i, j, round(d, 3) AS d, rank FROM k"
ORACLE["knn_radius"] = f"WITH {_KNN} SELECT i AS position, round(max(d), 3) AS radius FROM k GROUP BY i"
ORACLE["knn_maxdist_per_k"] = f"WITH {_KNN} SELECT rank, round(max(d), 3) AS max_d FROM k GROUP BY rank"
ORACLE["pdf"] = f"WITH {_DENS} SELECT position, round(dens, 6) AS dens FROM dens"
ORACLE["elim_height"] = f"WITH {_DENS} SELECT position, round(greatest(dens - 50, 0), 6) AS pathval FROM dens"
ORACLE["plateau_arcs"] = f"WITH {_KNN} SELECT j AS i, i AS j FROM k WHERE i % 5 = j % 5 AND (j, i) NOT IN (SELECT (i, j) FROM k)"
ORACLE["normalized_cut"] = f"""WITH {_KNN}, w AS (SELECT a.y AS l, a.y = b.y AS same, 1 / k.d AS w FROM k JOIN s a ON a.p = k.i JOIN s b ON b.p = k.j WHERE k.d > 0),
c AS (SELECT sum(CASE WHEN same THEN 0 ELSE w END) / sum(w) AS c FROM w GROUP BY l) SELECT round(sum(c), 6) AS cut FROM c"""

_PRIM = f"""e AS MATERIALIZED (SELECT a.p AS i, b.p AS j, {_LOG} AS w FROM s a, s b WHERE a.p <> b.p),
prim(node, pred, w, step) USING KEY (node) AS (
  SELECT min(p), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), 0 FROM s
  UNION (SELECT j, i, w, step + 1 FROM (
    SELECT e.j, e.i, e.w, (SELECT max(step) FROM recurring.prim) AS step FROM e JOIN recurring.prim p ON p.node = e.i
    WHERE e.j NOT IN (SELECT node FROM recurring.prim) ORDER BY e.w, least(e.i, e.j), greatest(e.i, e.j) LIMIT 1))),
mst AS MATERIALIZED (SELECT node AS i, pred AS j, w FROM prim WHERE pred >= 0 UNION ALL SELECT pred, node, w FROM prim WHERE pred >= 0)"""
_PROTO = "proto AS MATERIALIZED (SELECT DISTINCT m.i FROM mst m JOIN s a ON a.p = m.i JOIN s b ON b.p = m.j WHERE a.y <> b.y)"
_COST = """cost(node, c) USING KEY (node) AS (
  SELECT i, CAST(0 AS DOUBLE) FROM proto
  UNION (SELECT m.j, min(greatest(k.c, m.w)) FROM cost k JOIN mst m ON m.i = k.node LEFT JOIN recurring.cost r ON r.node = m.j
         WHERE r.c IS NULL OR greatest(k.c, m.w) < r.c GROUP BY m.j))"""
#: The flood of costs, one node taken from the queue in every round.
_FLOOD = """flood(node, c, root, pred, done) USING KEY (node) AS (
  SELECT i, CAST(0 AS DOUBLE), i, CAST(-1 AS BIGINT), false FROM proto
  UNION (SELECT q.node, q.c, q.root, q.pred, q.done FROM (SELECT * FROM recurring.flood WHERE NOT done ORDER BY c, root, pred, node LIMIT 1) t, LATERAL (
    SELECT t.node, t.c, t.root, t.pred, true AS done
    UNION ALL SELECT m.j, greatest(t.c, m.w), t.root, t.node, false FROM mst m LEFT JOIN recurring.flood r ON r.node = m.j
      WHERE m.i = t.node AND (r.node IS NULL OR (NOT r.done AND (greatest(t.c, m.w), t.root, t.node) < (r.c, r.root, r.pred)))) q))"""
_MODEL = "model AS MATERIALIZED (SELECT s.p, s.y, s.f, o.c, o.root, o.pred, r.y AS label FROM flood o JOIN s ON s.p = o.node JOIN s r ON r.p = o.root)"
_S3 = _EMB3.replace("s AS (", "s AS MATERIALIZED (", 1)


@query
def mst_edges(spark: SparkSession, d: str) -> DataFrame:
    return spanning.spanning_tree(data.embeddings3(spark, d)).select("a", "b", F.round("d", 3).alias("d"))


@query
def prototypes(spark: SparkSession, d: str) -> DataFrame:
    s = data.embeddings3(spark, d)
    return spanning.prototypes(s, spanning.spanning_tree(s))


@query
def train_pathval(spark: SparkSession, d: str) -> DataFrame:
    return supervised.fit(data.embeddings3(spark, d)).select("position", F.round("pathval", 3).alias("pathval"))


@query
def train_labels(spark: SparkSession, d: str) -> DataFrame:
    return supervised.fit(data.embeddings3(spark, d)).select("position", "label")


ORACLE["mst_edges"] = f"WITH RECURSIVE {_S3}, {_PRIM} SELECT least(node, pred) AS a, greatest(node, pred) AS b, round(w, 3) AS d FROM prim WHERE pred >= 0"
ORACLE["prototypes"] = f"WITH RECURSIVE {_S3}, {_PRIM}, {_PROTO} SELECT i AS position FROM proto"
ORACLE["train_pathval"] = f"WITH RECURSIVE {_S3}, {_PRIM}, {_PROTO}, {_COST} SELECT node AS position, round(c, 3) AS pathval FROM cost"
ORACLE["train_labels"] = f"WITH RECURSIVE {_S3}, {_PRIM}, {_PROTO}, {_FLOOD}, {_MODEL} SELECT p AS position, label FROM model"


#: The queries above whose SQL fixes the first three dimensions, once more on all 64 and the
#: stored labels, each with the same SQL over the whole vectors.
_WHOLE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "distance_matrix": lambda s: pairwise.distance_matrix(s).select("i", "j", F.round("d", 6).alias("d")),
    "distance_matrix_normalized": lambda s: pairwise.distance_matrix(s, "manhattan", True).select("i", "j", F.round("d", 6).alias("d")),
    "distance_matrix_symmetric": lambda s: pairwise.symmetric_matrix(s).select("i", "j", F.round("d", 6).alias("d")),
    "ascii_export": text_form.to_lines,
    "ascii_parse": lambda s: text_form.parse_lines(text_form.to_lines(s)),
    "normalize_per_fold": lambda s: prepare.normalize(prepare.kfold(s, 5), ("fold",)).select("position", "fold", F.transform("feat", lambda v: F.round(v, 6)).alias("feat")),
    "mst_edges": lambda s: spanning.spanning_tree(s).select("a", "b", F.round("d", 3).alias("d")),
    "prototypes": lambda s: spanning.prototypes(s, spanning.spanning_tree(s)),
    "train_pathval": lambda s: supervised.fit(s).select("position", F.round("pathval", 3).alias("pathval")),
    "train_labels": lambda s: supervised.fit(s).select("position", "label"),
}


def _whole_query(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: run(data.embeddings(spark, d))


_HEADS = [(_S3, _EMB.replace("s AS (", "s AS MATERIALIZED (", 1)), (_EMB3.replace("s AS", "s0 AS", 1), _EMB.replace("s AS", "s0 AS", 1)), (_EMB3, _EMB)]
for _name, _run in _WHOLE.items():
    QUERIES[_name + "_whole"] = _whole_query(_run)
    for _short, _long in _HEADS:
        if _short in ORACLE[_name]:
            ORACLE[_name + "_whole"] = ORACLE[_name].replace(_short, _long)


def _given_model(spark: SparkSession, d: str) -> DataFrame:
    """Half of the samples as a model with made-up costs."""
    half = prepare.split(data.embeddings(spark, d), 0.5)[0]
    cost = (F.col("position") % 7).cast("double") * 1000
    return half.select("position", "feat", cost.alias("pathval"), F.col("truelabel").alias("label"), (F.col("position") + 1).cast("int").alias("rank"), (F.lit(40000.0) + 500 * (F.col("position") % 11)).alias("radius"))


@query
def classify(spark: SparkSession, d: str) -> DataFrame:
    # ranks must follow costs
    model = _given_model(spark, d).withColumn("rank", ((F.col("position") % 7) * 1_000_000 + F.col("position")).cast("int"))
    return supervised.classify(model, data.embeddings(spark, d)).select("position", "label", "conqueror", F.round("cost", 3).alias("cost"))


@query
def classify_precomputed(spark: SparkSession, d: str) -> DataFrame:
    model = _given_model(spark, d).withColumn("rank", ((F.col("position") % 7) * 1_000_000 + F.col("position")).cast("int"))
    s = data.embeddings(spark, d)
    return supervised.classify(model, s, distances=pairwise.distance_pairs(s, "manhattan")).select("position", "label", "conqueror", F.round("cost", 3).alias("cost"))


@query
def radius_classify(spark: SparkSession, d: str) -> DataFrame:
    return clustering.knn_classify(_given_model(spark, d), data.embeddings(spark, d)).select("position", "label")


_HALF = f"{_EMB}, {_sql_split('s', 'k', '0.5', 1)}, m AS (SELECT p, f, y, (p % 7) * 1000 AS c, 40000 + 500 * (p % 11) AS r FROM k WHERE one)"


def _sql_classify(expr: str) -> str:
    return f"""WITH {_HALF}, o AS (SELECT a.p AS position, b.y AS label, b.p AS conqueror, greatest(b.c, CASE WHEN a.p = b.p THEN 0 ELSE {expr} END) AS cost FROM s a, m b)
SELECT position, label, conqueror, round(cost, 3) AS cost FROM o JOIN m ON m.p = conqueror QUALIFY row_number() OVER (PARTITION BY position ORDER BY o.cost, m.c, conqueror) = 1"""


ORACLE["classify"] = _sql_classify(_LOG)
ORACLE["classify_precomputed"] = _sql_classify(_SQL_DISTANCE["manhattan"])
ORACLE["radius_classify"] = f"""WITH {_HALF}, o AS (SELECT a.p, b.y, row_number() OVER (PARTITION BY a.p ORDER BY b.p) AS n FROM s a JOIN m b ON {_LOG} <= b.r)
SELECT s.p AS position, coalesce(o.y, 0) AS label FROM s LEFT JOIN o ON o.p = s.p AND o.n = 1"""


@query
def train_classify_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d).select(F.round("accuracy", 6).alias("accuracy"))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_node").filter("position is not null").select("model_id", "position", F.when(F.col("pred") != -1, F.col("pred")).alias("pred")).distinct()


@query
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    """Marked nodes (positions divisible by 50) of every model, with all their ancestors."""
    lines = hierarchy.paths(_chain(spark, d))
    return lines.filter("position % 50 = 0").select("model_id", F.explode("path").alias("position")).distinct()


@query
def remove_irrelevant(spark: SparkSession, d: str) -> DataFrame:
    kept = ancestor_closure(spark, d)
    return _chain(spark, d).join(kept, ["model_id", "position"], "left_semi").select("model_id", "position")


_UP = """RECURSIVE n AS (SELECT DISTINCT model_id, position, CASE WHEN pred <> -1 THEN pred END AS pred FROM model_node WHERE model_id IS NOT NULL AND position IS NOT NULL),
l AS (SELECT a.model_id, a.position, b.position AS up FROM n a JOIN n b ON b.model_id = a.model_id AND b.position = a.pred),
t AS (SELECT model_id, position FROM n WHERE (model_id, position) NOT IN (SELECT (model_id, position) FROM l)
      UNION SELECT l.model_id, l.position FROM l JOIN t ON t.model_id = l.model_id AND t.position = l.up),
c AS (SELECT model_id, position FROM t WHERE position % 50 = 0 UNION SELECT l.model_id, l.up FROM c JOIN l ON l.model_id = c.model_id AND l.position = c.position)"""
ORACLE["ancestor_closure"] = ORACLE["remove_irrelevant"] = f"WITH {_UP} SELECT model_id, position FROM c"


@query
def best_k(spark: SparkSession, d: str) -> DataFrame:
    return clustering.best_k(data.embeddings(spark, d), 5)[1].select("k", F.round("cut", 6).alias("cut"))


@query
def cluster(spark: SparkSession, d: str) -> DataFrame:
    arcs = cut(pairwise.knn_graph(data.embeddings(spark, d), 10))
    found = clustering.spread(arcs, cut(clustering.density(arcs)))
    return found.withColumns({c: F.round(c, 6) for c in ("dens", "pathval")})


@query
def cluster_root_labels(spark: SparkSession, d: str) -> DataFrame:
    s = data.embeddings(spark, d)
    return clustering.root_labels(cluster(spark, d).join(s.select("position", "truelabel"), "position")).select("position", "label", "root", "root_label")


def _opened(spark: SparkSession, d: str, kind: str, share: float) -> DataFrame:
    arcs = cut(pairwise.knn_graph(data.embeddings(spark, d), 10))
    dens = cut(clustering.density(arcs))
    return maxtree.open_maxima(dens, arcs, kind, clustering.filter_parameter(dens, kind, share))


@query
def elim_area(spark: SparkSession, d: str) -> DataFrame:
    return _opened(spark, d, "area", 0.05)


@query
def elim_volume(spark: SparkSession, d: str) -> DataFrame:
    return _opened(spark, d, "volume", 0.02)


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = cut(prepare.split3(data.embeddings(spark, d), 0.4, 0.3, 0.3))
    return tuple(parts.filter(F.col("part") == p).drop("part") for p in ("train", "eval", "test"))


def _brief(model: DataFrame) -> DataFrame:
    return model.select("position", "label", F.round("pathval", 3).alias("pathval"))


@query
def learn(spark: SparkSession, d: str) -> DataFrame:
    train, evaluation, _ = _three(spark, d)
    return _brief(supervised.learn(train, evaluation, rounds=4)[0])


@query
def agglomerative_learn(spark: SparkSession, d: str) -> DataFrame:
    train, evaluation, _ = _three(spark, d)
    return _brief(supervised.agglomerative_learn(train, evaluation)[0])


@query
def prune(spark: SparkSession, d: str) -> DataFrame:
    train, evaluation, _ = _three(spark, d)
    return _brief(supervised.prune(train, evaluation, 0.4)[0])


@query
def pruning_rate(spark: SparkSession, d: str) -> DataFrame:
    train, evaluation, _ = _three(spark, d)
    rate = supervised.prune(train, evaluation, 0.4)[1]
    return spark.createDataFrame([(round(100 * rate, 6),)], "rate double")


@query
def semi_train(spark: SparkSession, d: str) -> DataFrame:
    train, other, _ = _three(spark, d)
    return supervised.semi(train, other).select("position", "truelabel", "label", F.round("pathval", 3).alias("pathval"))


def _conquering(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A model, and its nodes that conquer evaluation rows with all their ancestors."""
    train, evaluation, _ = _three(spark, d)
    model = supervised.fit(train)
    marked = supervised.classify(model, evaluation).select(F.col("conqueror").alias("position"))
    return model, supervised.ancestor_closure(model, marked)


@query
def ancestor_closure_conquerors(spark: SparkSession, d: str) -> DataFrame:
    return _conquering(spark, d)[1]


@query
def remove_irrelevant_conquerors(spark: SparkSession, d: str) -> DataFrame:
    return supervised.keep_relevant(*_conquering(spark, d)).select("position", "label", F.round("pathval", 3).alias("pathval"))


# Programs: the training set is s, the rows to be classified are t, the model is model.
_ALL = _EMB.replace("s AS (", "s0 AS (", 1)
_HALVES = f"{_ALL}, {_sql_split('s0', 'h', '0.5', 1)}, s AS MATERIALIZED (SELECT p, y, f FROM h WHERE one), t AS (SELECT p, y, f FROM h WHERE NOT one)"
_THIRDS = f"""{_ALL}, {_sql_split('s0', 'h', '0.7', 1)}, h1 AS (SELECT p, y, f FROM h WHERE one), {_sql_split('h1', 'h2', '0.4::DOUBLE / 0.7::DOUBLE', 2)},
s AS MATERIALIZED (SELECT p, y, f FROM h2 WHERE one), t AS (SELECT p, y, f FROM h2 WHERE NOT one)"""
_TRAINED = f"{_PRIM}, {_PROTO}, {_FLOOD}, {_MODEL}"
_TAKEN = f"""taken AS MATERIALIZED (SELECT a.p, a.y, b.label AS l, b.p AS conqueror FROM t a, model b
  QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY greatest(b.c, {_LOG}), b.c, b.p) = 1)"""
ORACLE["train_classify_accuracy"] = f"""WITH RECURSIVE {_HALVES}, {_TRAINED}, {_TAKEN},
n AS (SELECT y, count(*) AS n, sum(CASE WHEN l <> y THEN 1 ELSE 0 END) AS miss FROM taken GROUP BY y), w AS (SELECT l, count(*) AS x FROM taken WHERE l <> y GROUP BY l)
SELECT round(1 - sum(coalesce(x, 0) / ((SELECT count(*) FROM taken) - n) + miss / n) / (2 * count(*)), 6) AS accuracy FROM n LEFT JOIN w ON w.l = n.y"""
_CLOSED = f"{_THIRDS}, {_TRAINED}, {_TAKEN}, up AS (SELECT DISTINCT conqueror AS p FROM taken UNION SELECT m.pred FROM up JOIN model m USING (p) WHERE m.pred >= 0)"
ORACLE["ancestor_closure_conquerors"] = f"WITH RECURSIVE {_CLOSED} SELECT p AS position FROM up"
ORACLE["remove_irrelevant_conquerors"] = f"WITH RECURSIVE {_CLOSED} SELECT p AS position, label, round(c, 3) AS pathval FROM model SEMI JOIN up USING (p)"


def _renamed(sql: str, **names: str) -> str:
    for old, new in names.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


# prototypes of the labeled rows s seed a flood over the tree of all rows u
_OVER_ALL = _renamed(f"{_PRIM}, {_FLOOD}, {_MODEL}", s="u", e="e2", prim="prim2", mst="mst2")
ORACLE["semi_train"] = f"""WITH RECURSIVE {_THIRDS}, {_PRIM}, {_PROTO}, u AS MATERIALIZED (SELECT p, y, f FROM s UNION ALL SELECT p, 0, f FROM t), {_OVER_ALL}
SELECT p AS position, CASE WHEN y = 0 THEN label ELSE y END AS truelabel, label, round(c, 3) AS pathval FROM model"""

# clusters for several k at once; every round takes one node of each k from its queue
_GROWN = """wide AS MATERIALIZED (SELECT k, i, j, d FROM arcs UNION SELECT a.k, a.j, a.i, a.d FROM arcs a JOIN dens x ON x.k = a.k AND x.node = a.i JOIN dens y ON y.k = a.k AND y.node = a.j
  WHERE x.dens = y.dens AND (a.k, a.j, a.i) NOT IN (SELECT (k, i, j) FROM arcs)),
grown(k, node, v, dens, root, pred, turn) USING KEY (k, node) AS (
  SELECT k, node, dens - 1, dens, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM dens
  UNION (SELECT q.k, q.node, q.v, q.dens, q.root, q.pred, q.turn FROM (
      SELECT k, node, CASE WHEN pred IS NULL THEN dens ELSE v END AS v, dens, coalesce(root, node) AS root, pred,
        (SELECT count(*) FROM recurring.grown o WHERE o.k = g.k AND o.turn IS NOT NULL) + 1 AS turn
      FROM recurring.grown g WHERE turn IS NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY g.v DESC, node) = 1) t, LATERAL (
    SELECT t.k, t.node, t.v, t.dens, t.root, t.pred, t.turn
    UNION ALL SELECT r.k, r.node, least(t.v, r.dens), r.dens, t.root, t.node, NULL FROM wide f JOIN recurring.grown r ON r.k = f.k AND r.node = f.j
      WHERE f.k = t.k AND f.i = t.node AND r.turn IS NULL AND least(t.v, r.dens) > r.v) q)),
named AS (SELECT k, node AS root, row_number() OVER (PARTITION BY k ORDER BY turn) - 1 AS label FROM grown WHERE pred IS NULL)"""


def _sql_clusters(arcs: str, width: str) -> str:
    return f"""{_EMB}, pairs AS MATERIALIZED (SELECT a.p AS i, b.p AS j, {_LOG} AS d FROM s a, s b WHERE a.p <> b.p),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pairs QUALIFY rank <= 10), arcs AS MATERIALIZED ({arcs}),
width AS ({width}), raw AS (SELECT a.k, i AS node, sum(exp(-d / (2 * w.w / 9))) / (count(*) + 1) AS v FROM arcs a JOIN width w ON w.k = a.k GROUP BY a.k, i),
ends AS (SELECT k, min(v) AS lo, max(v) AS hi FROM raw GROUP BY k), dens AS MATERIALIZED (SELECT r.k, node, 999 * (v - lo) / (hi - lo) + 1 AS dens FROM raw r JOIN ends e ON e.k = r.k),
{_GROWN}"""


_TEN = _sql_clusters("SELECT 10 AS k, i, j, d, rank FROM near", "SELECT k, max(d) AS w FROM arcs GROUP BY k")
ORACLE["cluster"] = f"""WITH RECURSIVE {_TEN} SELECT g.root, node AS position, round(dens, 6) AS dens, round(v, 6) AS pathval, pred, turn AS rank, label FROM grown g JOIN named n ON n.k = g.k AND n.root = g.root"""
ORACLE["cluster_root_labels"] = f"""WITH RECURSIVE {_TEN} SELECT node AS position, label, g.root, CASE WHEN y > 0 THEN y ELSE label + 1 END AS root_label
FROM grown g JOIN named n ON n.k = g.k AND n.root = g.root JOIN s ON s.p = g.root"""
_FIVE = _sql_clusters("SELECT k, i, j, d, rank FROM near, unnest(range(1, 6)) AS t(k) WHERE rank <= k", "SELECT k, max(d) AS w FROM arcs WHERE rank = k GROUP BY k")
ORACLE["best_k"] = f"""WITH RECURSIVE {_FIVE}, lab AS (SELECT g.k, node, g.root AS label FROM grown g), w AS (SELECT f.k, a.label, a.label = b.label AS same, 1 / d AS w
  FROM wide f JOIN lab a ON a.k = f.k AND a.node = f.i JOIN lab b ON b.k = f.k AND b.node = f.j WHERE d > 0),
c AS (SELECT k, label, sum(CASE WHEN same THEN 0 ELSE w END) / sum(w) AS c FROM w GROUP BY k, label), o AS (SELECT k, sum(c) AS cut FROM c GROUP BY k)
SELECT CAST(k AS INT) AS k, round(cut, 6) AS cut FROM o WHERE NOT EXISTS (SELECT 1 FROM o z WHERE z.cut = 0 AND z.k < o.k)"""


def _stage(i: int) -> str:
    """Training, classification and accuracy of the i-th round of a program, on s<i> and t<i>."""
    part = f"""{_TRAINED}, {_TAKEN}, tally AS (SELECT y, count(*) AS n, sum(CASE WHEN l <> y THEN 1 ELSE 0 END) AS miss FROM taken GROUP BY y),
false AS (SELECT l, count(*) AS x FROM taken WHERE l <> y GROUP BY l),
score AS MATERIALIZED (SELECT 1 - sum(coalesce(x, 0) / ((SELECT count(*) FROM taken) - n) + miss / n) / (2 * count(*)) AS acc FROM tally LEFT JOIN false ON false.l = tally.y)"""
    part = part.replace(", false)", ", CAST(0 AS BOOLEAN))").replace(", false FROM", ", CAST(0 AS BOOLEAN) FROM")
    return _renamed(part, **{x: f"{x}{i}" for x in ("s", "t", "e", "prim", "mst", "proto", "flood", "model", "taken", "tally", "false", "score")})


_BEGIN = _renamed(_THIRDS, s="sA", t="tA").replace("sA", "s1").replace("tA", "t1")


def _chosen(rounds: int, which: str) -> str:
    return " UNION ALL ".join(f"SELECT p AS position, label, round(c, 3) AS pathval FROM model{i} WHERE ({which}) = {i}" for i in range(1, rounds + 1))


# each round once more under names of its own
_SWAPS = [f"""err{i} AS MATERIALIZED (SELECT p, y, row_number() OVER (ORDER BY md5(p || ':{2 * i - 1}'), p) AS n FROM taken{i} WHERE l <> y),
spare{i} AS MATERIALIZED (SELECT p, y, row_number() OVER (ORDER BY md5(p || ':{2 * i}'), p) AS n FROM s{i} WHERE p NOT IN (SELECT i FROM proto{i})),
into{i} AS MATERIALIZED (SELECT p FROM err{i} WHERE n <= (SELECT count(*) FROM spare{i})), out{i} AS MATERIALIZED (SELECT p FROM spare{i} WHERE n <= (SELECT count(*) FROM err{i})),
s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} WHERE p NOT IN (FROM out{i}) UNION ALL SELECT * FROM t{i} WHERE p IN (FROM into{i})),
t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE p NOT IN (FROM into{i}) UNION ALL SELECT * FROM s{i} WHERE p IN (FROM out{i}))""" for i in range(1, 4)]
_SCORES = " UNION ALL ".join(f"SELECT {i} AS r, acc FROM score{i}" for i in range(1, 5))
ORACLE["learn"] = f"""WITH RECURSIVE {_BEGIN}, {", ".join(x for i in range(1, 5) for x in [_stage(i), *_SWAPS[i - 1 : i]])},
scores AS ({_SCORES}), last AS (SELECT coalesce(min(r), 4) AS r FROM (SELECT r, abs(acc - lag(acc, 1, 0) OVER (ORDER BY r)) AS gap FROM scores) WHERE gap <= 1e-4),
best AS (SELECT r FROM scores WHERE r <= (SELECT r FROM last) ORDER BY acc DESC, r LIMIT 1) {_chosen(4, "SELECT r FROM best")}"""
_MOVES = [f"s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT * FROM t{i} WHERE p IN (SELECT p FROM taken{i} WHERE l <> y)), t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE p IN (SELECT p FROM taken{i} WHERE l = y))" for i in range(1, 6)]
_ERRORS = " UNION ALL ".join(f"SELECT {i} AS r, count(*) AS n FROM taken{i} WHERE l <> y" for i in range(1, 6))
ORACLE["agglomerative_learn"] = f"""WITH RECURSIVE {_BEGIN}, {", ".join(x for i in range(1, 6) for x in [_stage(i), *_MOVES[i - 1 : min(i, 4)]])},
best AS (SELECT min(r) AS r FROM ({_ERRORS}) WHERE n = 0) {_chosen(5, "SELECT r FROM best")}"""
# a round that removes nothing, or whose model misses the target, repeats the last model
_KEEPS = [f"""up{i} AS (SELECT DISTINCT conqueror AS p FROM taken{i} WHERE l = y UNION SELECT m.pred FROM up{i} u JOIN model{i} m ON m.p = u.p WHERE m.pred >= 0),
s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} WHERE p IN (FROM up{i})), t{i + 1} AS MATERIALIZED (SELECT * FROM t{i})""" for i in range(1, 4)]
_SIZES = " UNION ALL ".join(f"SELECT {i} AS r, acc, (SELECT count(*) FROM s{i}) AS n FROM score{i}" for i in range(1, 5))
_PRUNED = f"""WITH RECURSIVE {_BEGIN}, {", ".join(x for i in range(1, 5) for x in [_stage(i), *_KEEPS[i - 1 : i]])},
sizes AS ({_SIZES}), best AS (SELECT greatest(1, coalesce(min(r), 5) - 1) AS r FROM (SELECT r, acc, n, lag(n) OVER (ORDER BY r) AS before FROM sizes) WHERE acc < 0.4 OR n = before)"""
ORACLE["prune"] = f"{_PRUNED} {_chosen(4, 'SELECT r FROM best')}"
ORACLE["pruning_rate"] = f"{_PRUNED} SELECT round(100 * (1 - CAST(n AS DOUBLE) / (SELECT count(*) FROM s1)), 6) AS rate FROM sizes JOIN best USING (r)"


@query
def experiment(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of two hold-out runs."""
    rows = cut(data.embeddings(spark, d))

    def once(seed: int) -> float:
        train, test = prepare.split(rows, 0.3, seed)
        return evaluate.accuracy_value(supervised.classify(supervised.fit(train), test))

    return evaluate.experiment(spark, 2, once).select("run", F.round("value", 6).alias("value"))


def _run(i: int, seed: int) -> str:
    return f"{_sql_split('s0', f'h{i}', '0.3', seed)}, s{i} AS MATERIALIZED (SELECT p, y, f FROM h{i} WHERE one), t{i} AS (SELECT p, y, f FROM h{i} WHERE NOT one), {_stage(i)}"


ORACLE["experiment"] = f"WITH RECURSIVE {_ALL}, {_run(1, 0)}, {_run(2, 1)} SELECT 0 AS run, round(acc, 6) AS value FROM score1 UNION ALL SELECT 1, round(acc, 6) FROM score2"


@query
def semi_retrained(spark: SparkSession, d: str) -> DataFrame:
    train, other, _ = _three(spark, d)
    return _brief(supervised.semi_retrained(train, other))


_AGAIN = _renamed(_TRAINED, **{x: f"{x}9" for x in ("s", "e", "prim", "mst", "proto", "flood", "model")})
ORACLE["semi_retrained"] = f"""WITH RECURSIVE {_THIRDS}, {_PRIM}, {_PROTO}, u AS MATERIALIZED (SELECT p, y, f FROM s UNION ALL SELECT p, 0, f FROM t), {_OVER_ALL},
s9 AS MATERIALIZED (SELECT p, CASE WHEN y = 0 THEN label ELSE y END AS y, f FROM model), {_AGAIN} SELECT p AS position, label, round(c, 3) AS pathval FROM model9"""


@query
def swap_errors(spark: SparkSession, d: str) -> DataFrame:
    a, b = prepare.split(data.embeddings(spark, d), 0.5)
    a, b = prepare.swap_errors(a.withColumn("is_prototype", F.col("position") % 3 == 0), b.withColumn("label", (1 + F.col("position") % 4).cast("int")))
    return a.select("position", F.lit("train").alias("side")).unionByName(b.select("position", F.lit("evaluation").alias("side")))


ORACLE["swap_errors"] = f"""WITH {_HALVES}, err AS (SELECT p, row_number() OVER (ORDER BY md5(p || ':1'), p) AS n FROM t WHERE 1 + p % 4 <> y),
spare AS (SELECT p, row_number() OVER (ORDER BY md5(p || ':2'), p) AS n FROM s WHERE p % 3 <> 0),
moved AS (SELECT err.p AS a, spare.p AS b FROM err JOIN spare USING (n))
SELECT p AS position, CASE WHEN p IN (SELECT b FROM moved) THEN 'evaluation' ELSE 'train' END AS side FROM s
UNION ALL SELECT p, CASE WHEN p IN (SELECT a FROM moved) THEN 'train' ELSE 'evaluation' END FROM t"""


@query
def move_irrelevant(spark: SparkSession, d: str) -> DataFrame:
    rows = data.lines(spark, d).withColumn("relevant", F.col("feat")[0] > 25)
    kept, moved = prepare.move_irrelevant(rows, data.lines(spark, d).filter("truelabel = 1"))
    return kept.select("position", F.lit("source").alias("side")).unionByName(moved.select("position", F.lit("target").alias("side")))


ORACLE["move_irrelevant"] = f"WITH {_LINE} SELECT p AS position, 'source' AS side FROM s WHERE f[1] > 25 UNION ALL SELECT p, 'target' FROM s WHERE y = 1 UNION ALL SELECT p, 'target' FROM s WHERE f[1] <= 25"


@query
def filter_parameters(spark: SparkSession, d: str) -> DataFrame:
    dens = cut(clustering.density(cut(_arcs(spark, d))))
    return spark.createDataFrame([(k, round(float(clustering.filter_parameter(dens, k, v)), 6)) for k, v in (("height", 0.2), ("area", 0.1), ("volume", 0.05))], "kind string, value double")


ORACLE["filter_parameters"] = f"""WITH {_DENS} SELECT 'height' AS kind, round(0.2 * max(dens), 6) AS value FROM dens UNION ALL SELECT 'area', floor(0.1 * count(*)) FROM dens
UNION ALL SELECT 'volume', floor(0.05 * sum(dens) / count(*)) FROM dens"""


#: A distance of the user's own: dimensions weigh less the later they come.
FADING = Distance(
    "fading",
    lambda x, y: F.aggregate(F.zip_with(F.arrays_zip(x.alias("x"), F.sequence(F.lit(1), F.size(x)).alias("j")), y, lambda a, b: F.abs(a["x"] - b) / a["j"]), F.lit(0.0), lambda s, t: s + t),
    lambda x, y: sum(abs(x[:, j, None] - y[None, :, j]) / (j + 1) for j in range(x.shape[1])),
)


@query
def classify_custom(spark: SparkSession, d: str) -> DataFrame:
    model = _given_model(spark, d).withColumn("rank", ((F.col("position") % 7) * 1_000_000 + F.col("position")).cast("int")).withColumn("pathval", F.col("pathval") / 1000)
    return supervised.classify(model, data.embeddings(spark, d), FADING).select("position", "label", "conqueror", F.round("cost", 6).alias("cost"))


_FADE = "list_sum(list_transform(list_zip(a.f, b.f, range(1, len(a.f) + 1)), lambda z: abs(z[1] - z[2]) / z[3]))"
ORACLE["classify_custom"] = f"""WITH {_HALF}, o AS (SELECT a.p AS position, b.y AS label, b.p AS conqueror, b.c / 1000 AS c, greatest(b.c / 1000, CASE WHEN a.p = b.p THEN 0 ELSE {_FADE} END) AS cost FROM s a, m b)
SELECT position, label, conqueror, round(cost, 6) AS cost FROM o QUALIFY row_number() OVER (PARTITION BY position ORDER BY cost, c, conqueror) = 1"""


# Files: written by tasks into the shared folder and read back.
@query
def binary_samples(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "samples")
    binary.register(spark)
    binary.write_samples(data.embeddings(spark, d), path)
    return spark.read.format("forest_samples").load(path)


@query
def binary_training(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "training")
    binary.register(spark)
    binary.write_training(data.embeddings(spark, d).withColumn("pathval", (F.col("position") % 8) / 4), path)
    return spark.read.format("forest_training").load(path)


@query
def binary_model(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "model")
    binary.register(spark)
    binary.write_model(supervised.fit(data.embeddings(spark, d)), path)
    return spark.read.format("forest_model").load(path).select("position", "truelabel", "pred", "label", "rank")


@query
def binary_distances(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch(spark, "distances"), data.embeddings(spark, d)
    binary.register(spark)
    binary.write_distances(pairwise.distance_matrix(rows), rows.count(), path)
    return spark.read.format("forest_distances").load(path).select("i", "j", F.round(F.col("d").cast("double"), 3).alias("d"))


@query
def binary_header(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "samples")
    binary.write_samples(data.embeddings(spark, d), path)
    return spark.createDataFrame([tuple(binary.header(path).values())], "nnodes int, nlabels int, nfeats int")


@query
def ascii_to_binary(spark: SparkSession, d: str) -> DataFrame:
    text, path = scratch(spark, "text"), scratch(spark, "samples")
    text_form.write(data.embeddings(spark, d), text)
    text_form.to_binary(spark, text, path)
    binary.register(spark)
    return spark.read.format("forest_samples").load(path)


@query
def ascii_check_file(spark: SparkSession, d: str) -> DataFrame:
    """The first bad line of a whole file; the label of the seventh row is spoilt."""
    text = scratch(spark, "text")
    text_form.write(data.embeddings(spark, d).withColumn("truelabel", F.when(F.col("position") == 6, -1).otherwise(F.col("truelabel"))), text)
    return spark.createDataFrame([(text_form.check_file(spark, text),)], "line_no long")


_WHOLE_FLOATS = "SELECT CAST(vec_id AS BIGINT) AS position, CAST(label + 1 AS INT) AS truelabel, {}CAST({} AS FLOAT[]) AS feat FROM embeddings"
ORACLE["binary_samples"] = _WHOLE_FLOATS.format("", "embedding")
ORACLE["binary_training"] = _WHOLE_FLOATS.format("(vec_id % 8) / 4 AS pathval, ", "embedding")
ORACLE["binary_model"] = f"""WITH RECURSIVE {_EMB.replace("s AS (", "s AS MATERIALIZED (", 1)}, {_TRAINED}
SELECT p AS position, CAST(y AS INT) AS truelabel, CASE WHEN pred >= 0 THEN pred END AS pred, CAST(label AS INT) AS label, row_number() OVER (ORDER BY c, p) AS rank FROM model"""
ORACLE["binary_distances"] = f"WITH {_EMB} SELECT a.p AS i, b.p AS j, round(CAST(CAST(sqrt({_SQ}) AS FLOAT) AS DOUBLE), 3) AS d FROM s a, s b"
ORACLE["binary_header"] = "SELECT count(*) AS nnodes, max(label) + 1 AS nlabels, max(len(embedding)) AS nfeats FROM embeddings"
ORACLE["ascii_to_binary"] = _WHOLE_FLOATS.format("", "CAST(list_transform(CAST(embedding AS DOUBLE[]), lambda v: format('{:.6f}', v)) AS DOUBLE[])")
ORACLE["ascii_check_file"] = "SELECT count(*) + 2 AS line_no FROM embeddings WHERE vec_id < 6"
