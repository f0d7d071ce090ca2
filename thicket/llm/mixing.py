"""Mixing sources to target shares of size.

Method: documents fall into hash blocks of their source, ``BLOCKS`` or four for every shard. A mix needs, of each
source, a number of whole passes over its blocks plus a part of one more pass, taken as
whole blocks in a random order, then whole sub-blocks of the block that is cut, then
documents of the sub-block that is cut. Those block draws are exact quotas; a splitting
tree halves the output shards again and again and draws, by a multivariate hypergeometric
law, how many block draws of each source go left. At the leaves every shard takes its
disjoint run of the permuted draws and orders its documents by a random key.

Whether a source falls short is read off the draw: every permitted repetition of the source was
dealt to the shards and still less came out than its share asks for.

Only block tables (a bounded number of rows for each mix and source) meet windows; texts
are read once, to be sized. There is a shard for every ``SHARD_SIZE`` of the largest mix, so
shards do not grow with the corpus. Defined cases: null text has size 0; documents of null or
unlisted sources count towards the total only; targets without a mix id form a mix of their own; a source without documents, a null share or
a null ``max_repeat`` draws nothing; repeated (mix, source) rows are drawn
from the one with the largest share, the others are judged by what there is; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.plans.runtime import cut

#: Hash blocks of a source at least, and sub-blocks of a block; least number of shards; size of a shard.
BLOCKS, SHARDS, SHARD_SIZE = 512, 16, 50_000_000
#: Stands for a null mix while mixes are told apart.
_NO_MIX = -(2**62)
#: Fixed value: the unit of size, with white space spelled out as Unicode has it (Java's \s is ASCII).
SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNIT = rf"\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+"


def unit_sizes(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, source, size`` with sizes in runs of letters, digits or marks."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(UNIT)), F.lit(0)).cast("long").alias("size"))


def token_sizes(documents: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id, source, size`` with sizes in tokens of a public byte-level vocabulary file.

    ``ranks`` is the path of a rank file present on every executor.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        lines = Path(ranks).read_bytes().splitlines()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "size": [len(enc.encode_ordinary(t)) if t else 0 for t in b.text]})

    return documents.select("doc_id", "source", F.col(text).alias("text")).mapInPandas(count, "doc_id long, source string, size long")


def _blocked(sized: DataFrame, count: int) -> DataFrame:
    h, again = F.xxhash64(F.lit("mix"), F.col("doc_id")), F.xxhash64(F.lit("within"), F.col("doc_id"))
    return sized.select("doc_id", "source", "size", F.pmod(h, F.lit(count)).cast("int").alias("b"), F.pmod(again, F.lit(BLOCKS)).cast("int").alias("b2"))


def _targets(mix: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per mix and source: what is wanted, what there is, and how many passes that makes."""
    have = blocks.groupBy("source").agg(F.sum("size").alias("have"))
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    joined = mix.select("mix_id", "source", "share", "max_repeat", "budget_ratio").join(have, "source", "left").crossJoin(F.broadcast(total))  # one row
    cap = F.coalesce(F.col("max_repeat"), F.lit(0)) * F.coalesce("have", F.lit(0))
    want = F.coalesce(F.col("share") * F.col("budget_ratio"), F.lit(0.0)) * F.col("total")
    goal = F.least("want", "cap")
    return (
        joined.withColumn("have", F.coalesce("have", F.lit(0)))
        .withColumn("cap", cap)
        .withColumn("want", want)
        .withColumn("goal", goal)
        .withColumn("passes", F.when(F.col("have") > 0, F.floor(F.col("goal") / F.col("have"))).otherwise(0).cast("int"))
        .withColumn("part", F.col("goal") - F.col("passes") * F.col("have"))
    )


def _shards(sizes: DataFrame, mix: DataFrame) -> int:
    """Shards for the largest mix that may be asked for."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    ratio = mix.groupBy("mix_id").agg(F.sum(F.col("share") * F.col("budget_ratio")).alias("r")).agg(F.max("r")).first()[0] or 0.0
    return max(SHARDS, math.ceil(total * ratio / SHARD_SIZE))


def _prefix(parts: DataFrame, key: str, seed: int) -> DataFrame:
    """Cumulated size of ``parts`` within a mix and source, in a random order of ``key``."""
    order = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64(F.lit(seed), "mix_id", key), key)
    return parts.withColumn("upto", F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))


def _split(shards: int, seed: int):
    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        """How many of the block draws of each source every shard takes."""
        pdf = pdf.sort_values("source").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf.mix_id.iloc[0]) & 0x7FFFFFFF])
        out: list[tuple[int, np.ndarray]] = []

        def halve(lo: int, hi: int, quota: np.ndarray) -> None:
            if hi - lo == 1:
                out.append((lo, quota))
                return
            mid = (lo + hi) // 2
            left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * (mid - lo) // (hi - lo), method="marginals")
            halve(lo, mid, left)
            halve(mid, hi, quota - left)

        halve(0, shards, pdf.draws.to_numpy(np.int64))
        took = np.array([q for _, q in out])
        ends = took.cumsum(0)
        return pd.concat(
            [pd.DataFrame({"mix_id": pdf.mix_id, "source": pdf.source, "shard": s, "first": ends[i] - took[i], "last": ends[i]}) for i, (s, _) in enumerate(out)]
        )

    return tree


def compose(sized: DataFrame, mix: DataFrame, shards: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``mix_id, shard, source, doc_id, copy, size, order_key``. Report, one row per row of
    ``mix``: ``mix_id, source, share, want_size, max_size, drawn_size, drawn_share, passes,
    short``; ``short`` says that the source, dealt ``max_repeat`` times in full, did not fill its share.
    """
    mix = mix.withColumn("mix_id", F.coalesce(F.col("mix_id").cast("long"), F.lit(_NO_MIX)))
    docs = cut(sized.select("doc_id", "source", "size"))
    shards = shards or _shards(docs, mix)
    docs = _blocked(docs, max(BLOCKS, 4 * shards))
    blocks = cut(docs.groupBy("source", "b").agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    targets = cut(_targets(mix, blocks))
    best = Window.partitionBy("mix_id", "source").orderBy(F.desc_nulls_last("share"), "passes", "part")
    targets = targets.withColumn("_drawn", F.row_number().over(best) == 1)
    wanted = targets.filter("_drawn").select("mix_id", "source", "passes", "part", "have")
    # whole passes, and the whole blocks of the part of a pass
    full = wanted.filter("passes > 0").select("mix_id", "source", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy")).join(blocks, "source").select("mix_id", "source", "copy", "b")
    extra = _prefix(wanted.filter("part > 0").join(blocks, "source"), "b", seed)
    part = cut(extra.filter("before < part").select("mix_id", "source", (F.col("passes") + 1).alias("copy"), "b", (F.col("upto") <= F.col("part")).alias("whole"), (F.col("part") - F.col("before")).alias("left")))
    # the block that is cut: its sub-blocks, then the documents of the one that is cut
    open_block = part.filter("not whole")
    inner = docs.join(open_block, ["source", "b"])
    sub = _prefix(inner.groupBy("mix_id", "source", "copy", "b", "b2", "left").agg(F.sum("size").alias("size")), "b2", seed + 1).filter("before < left")
    sub = sub.select("mix_id", "source", "b2", (F.col("upto") <= F.col("left")).alias("all_in"), (F.col("left") - F.col("before")).alias("rest"))
    near = inner.join(sub, ["mix_id", "source", "b2"])
    last = _prefix(near.filter("not all_in"), "doc_id", seed + 2).filter("upto <= rest")
    cols = ["mix_id", "source", "copy", "b", "doc_id", "size"]
    loose = cut(near.filter("all_in").select(cols).unionByName(last.select(cols)))
    # block draws in a random order, dealt to shards by the splitting tree
    units = full.withColumn("open", F.lit(False)).unionByName(part.select("mix_id", "source", "copy", "b", (~F.col("whole")).alias("open")))
    deal = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64(F.lit(seed + 3), "mix_id", "copy", "b"), "copy", "b")
    units = cut(units.withColumn("draw", F.row_number().over(deal) - 1))
    quotas = units.groupBy("mix_id", "source").agg(F.count("*").alias("draws"))
    ranges = quotas.groupBy("mix_id").applyInPandas(_split(shards, seed), "mix_id long, source string, shard int, first long, last long").filter("first < last")
    placed = cut(units.join(ranges, ["mix_id", "source"]).filter("draw >= first and draw < last").select("mix_id", "source", "copy", "b", "shard", "open"))
    whole = placed.filter("not open").join(docs, ["source", "b"]).select("mix_id", "shard", "source", "doc_id", "copy", "size")
    cutoff = placed.filter("open").join(loose, ["mix_id", "source", "copy", "b"]).select("mix_id", "shard", "source", "doc_id", "copy", "size")
    mixed = whole.unionByName(cutoff).withColumn("order_key", F.xxhash64(F.lit(seed + 4), "mix_id", "shard", "doc_id", "copy"))
    in_blocks = placed.filter("not open").join(blocks, ["source", "b"]).select("mix_id", "source", "size")
    drawn = in_blocks.unionByName(loose.select("mix_id", "source", "size")).groupBy("mix_id", "source").agg(F.sum("size").alias("drawn_size"))
    sums = drawn.groupBy("mix_id").agg(F.sum("drawn_size").alias("mix_size"))
    report = (
        targets.join(drawn, ["mix_id", "source"], "left")
        .join(sums, "mix_id", "left")
        .select(
            "mix_id",
            "source",
            "share",
            F.col("want").alias("want_size"),
            F.col("cap").alias("max_size"),
            F.coalesce("drawn_size", F.lit(0)).alias("drawn_size"),
            (F.coalesce("drawn_size", F.lit(0)) / F.nullif(F.col("mix_size"), F.lit(0))).alias("drawn_share"),
            "passes",
            F.when(F.col("_drawn"), (F.coalesce("drawn_size", F.lit(0)) < F.col("want")) & (F.coalesce("drawn_size", F.lit(0)) >= F.col("cap"))).otherwise(F.col("want") > F.col("cap")).alias("short"),
        )
    )
    kind = F.nullif(F.col("mix_id"), F.lit(_NO_MIX)).cast("int").alias("mix_id")
    return mixed.select(kind, *mixed.columns[1:]), report.select(kind, *report.columns[1:])


def in_shard_order(mixed: DataFrame) -> DataFrame:
    """The mix with the rows of each shard together, in their random order."""
    return mixed.repartition("mix_id", "shard").sortWithinPartitions("mix_id", "shard", "order_key")
