"""Sampling, set operations and normalisation of sample sets.

Random choices order rows by md5 of position and seed, so they are reproducible in any
engine and independent of partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.plans.runtime import numbered


def shuffle_key(seed: int, position: str = "position") -> Column:
    return F.md5(F.concat(F.col(position).cast("string"), F.lit(f":{seed}")))


def normalize(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """z-scores of every dimension with the population deviation; constant dimensions give 0.

    ``by`` names columns (such as a fold) whose groups are normalised apart.
    """
    wide = samples.select(*by, F.posexplode("feat").alias("_j", "_v"))
    v = F.col("_v").cast("double")
    stats = wide.groupBy(*by, "_j").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    table = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_j", "m", "s"))).alias("_stats"))  # one entry a dimension
    joined = samples.join(table, list(by)) if by else samples.join(F.broadcast(table))  # one row
    z = F.zip_with("feat", "_stats", lambda x, t: (x.cast("double") - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(1.0))
    return joined.withColumn("feat", z).drop("_stats")


def split(samples: DataFrame, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Stratified split: of each label max(int(share * n), 1) rows go to the first part."""
    if not 0 <= share <= 1:
        raise ValueError("the share must lie in [0, 1]")
    marked = _marked(samples, share, seed)
    return marked.filter("_first").drop("_first"), marked.filter("not _first").drop("_first")


def _marked(samples: DataFrame, share: float, seed: int) -> DataFrame:
    quota = F.greatest(F.floor(F.count("*").over(Window.partitionBy("truelabel")) * F.lit(share)), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("truelabel").orderBy(shuffle_key(seed), "position"))
    return samples.withColumns({"_quota": quota, "_rank": rank}).withColumn("_first", F.col("_rank") <= F.col("_quota")).drop("_quota", "_rank")


def split3(samples: DataFrame, train: float, evaluate: float, test: float, seed: int = 1, scale: bool = False) -> DataFrame:
    """Adds ``part`` (train, eval, test): test is split off first, then eval by its ratio."""
    if abs(train + evaluate + test - 1) > 1e-9 or train == 0 or test == 0:
        raise ValueError("shares must sum to 1, and train and test must not be 0")
    data = normalize(samples) if scale else samples
    rest, held = split(data, train + evaluate, seed)
    held = held.withColumn("part", F.lit("test"))
    if evaluate == 0:
        return rest.withColumn("part", F.lit("train")).unionByName(held)
    a, b = split(rest, train / (train + evaluate), seed + 1)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("eval"))).unionByName(held)


def kfold(samples: DataFrame, k: int) -> DataFrame:
    """Adds ``fold``: round robin within each label, in order of position."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy("truelabel").orderBy("position")
    return samples.withColumn("fold", (F.row_number().over(order) - 1) % k)


def random_kfold(samples: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Adds ``fold``: stratified and random, what does not divide goes to the last fold."""
    if k <= 0:
        raise ValueError("k must be positive")
    sizes = samples.groupBy(F.col("truelabel").alias("_l")).agg(F.greatest(F.floor(F.count("*") / k), F.lit(1)).alias("_each"))
    order = Window.partitionBy("truelabel").orderBy(shuffle_key(seed), "position")
    ranked = samples.withColumn("_rank", F.row_number().over(order) - 1).join(sizes, F.col("truelabel").eqNullSafe(F.col("_l")))
    return ranked.withColumn("fold", F.least(F.floor(F.col("_rank") / F.col("_each")), F.lit(k - 1)).cast("int")).drop("_l", "_each", "_rank")


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; positions are kept. The widths must agree."""
    widths = {r[0] for p in parts for r in p.select(F.size("feat")).distinct().limit(2).collect()}
    if len(widths) > 1:
        raise ValueError("feature widths differ")
    return reduce(DataFrame.unionByName, parts)


def move_misclassified(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Moves rows whose label is wrong from source to target."""
    wrong = source.filter("label != truelabel")
    cols = [c for c in target.columns if c in source.columns]
    return source.filter("label is null or label = truelabel"), target.select(cols).unionByName(wrong.select(cols)), wrong.count()


def move_irrelevant(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves rows not marked relevant from source to target."""
    cols = [c for c in target.columns if c in source.columns]
    gone = source.filter(~F.coalesce("relevant", F.lit(False)))
    return source.filter("relevant"), target.select(cols).unionByName(gone.select(cols))


def swap_errors(train: DataFrame, evaluated: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Misclassified evaluation rows change places with random non-prototypes.

    ``train`` has ``is_prototype``; ``evaluated`` has ``label``. Both keep their sizes.
    """
    base = ["position", "truelabel", "feat"]
    errors = numbered(evaluated.filter("label != truelabel"), "_n", shuffle_key(seed), F.col("position"))
    spare = numbered(train.filter("not is_prototype"), "_n", shuffle_key(seed + 1), F.col("position"))
    into = errors.join(spare.select("_n"), "_n", "left_semi").select(base)
    out = spare.join(errors.select("_n"), "_n", "left_semi").select(base)
    new_train = train.select(base).join(out.select("position"), "position", "left_anti").unionByName(into)
    new_eval = evaluated.select(base).join(into.select("position"), "position", "left_anti").unionByName(out)
    return new_train, new_eval


def info(samples: DataFrame) -> DataFrame:
    """``nnodes, nlabels, nfeats`` of a set."""
    return samples.agg(F.count("*").alias("nnodes"), F.coalesce(F.max("truelabel"), F.lit(0)).alias("nlabels"), F.coalesce(F.max(F.size("feat")), F.lit(0)).alias("nfeats"))
