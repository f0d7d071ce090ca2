import regex

import __spark_entry__ as entry
from thicket.llm import mixing

DOC, MIX = "doc_id long, source string, text string", "mix_id int, source string, share double, max_repeat int, budget_ratio double"


def test_unit_sizes(spark):
    texts = ["a1_b, c d　e", None, "", "héllo wörld… 12½", "x﻿y", "के तो", " \u0085\x1c a"]
    got = {r.doc_id: r["size"] for r in mixing.unit_sizes(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], DOC)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(regex.findall(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", t or "")), t


def mixed(spark, docs, mix, **kw):
    sized = mixing.unit_sizes(spark.createDataFrame(docs, DOC))
    m, r = mixing.compose(sized, spark.createDataFrame(mix, MIX), **kw)
    return m, {(x.mix_id, x.source): x for x in r.collect()}


def test_shares_repeats_and_shards(spark):
    docs = [(i, "big", "w " * (1 + i % 7)) for i in range(4000)] + [(10_000 + i, "small", "w " * 3) for i in range(300)]
    mix = [(1, "big", 0.5, 1, 0.6), (1, "small", 0.25, 8, 0.6), (1, "none", 0.25, 4, 0.6), (2, "small", 1.0, 2, 1.0)]
    m, r = mixed(spark, docs, mix, shards=5)
    got = m.toPandas()
    assert not r[1, "big"].short and not r[1, "small"].short and r[1, "none"].short and r[2, "small"].short
    for k in ((1, "big"), (1, "small")):
        assert 0 <= r[k].want_size - r[k].drawn_size < 10
    assert r[2, "small"].drawn_size == 2 * 900 and r[1, "none"].drawn_size == 0
    assert abs(sum(r[1, s].drawn_share or 0 for s in ("big", "small")) - 1) < 1e-9
    one = got[got.mix_id == 1]
    assert not one.duplicated(["source", "doc_id", "copy"]).any()
    assert one.groupby(["source"])["size"].sum().to_dict() == {s: r[1, s].drawn_size for s in ("big", "small")}
    copies = got[got.mix_id == 2].groupby("doc_id").size()
    assert (copies == 2).all() and len(copies) == 300
    sizes = one.groupby("shard").size()
    assert len(sizes) == 5 and sizes.max() < 1.6 * sizes.min()
    ordered = mixing.in_shard_order(m).filter("mix_id = 1 and shard = 2").toPandas()
    assert ordered.order_key.is_monotonic_increasing


def test_nulls_empty_and_clashing_columns(spark):
    docs = [(1, None, "a b"), (2, "s", None), (3, "s", "a b c")]
    mix = [(1, "s", None, None, None), (1, None, 0.5, 1, 1.0), (2, "s", 0.1, 1, 1.0), (None, "s", 5.0, 1, 1.0)]
    d = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as size", "2 as b", "3 as have")
    t = spark.createDataFrame(mix, MIX).selectExpr("*", "1 as total", "2 as want", "3 as doc_id")
    m, r = mixing.compose(mixing.unit_sizes(d), t)
    assert r.count() == 4 and m.filter("mix_id = 1").count() == 0
    assert {(x.mix_id, x.doc_id) for x in m.filter("size > 0").collect()} == {(None, 3)}
    assert {(x.mix_id, x.source) for x in r.filter("short").collect()} == {(1, None), (None, "s")}
    m, r = mixing.compose(mixing.unit_sizes(d.limit(0)), t)
    assert m.count() == 0 and r.count() == 4
    assert mixing.compose(mixing.unit_sizes(d), t.limit(0))[1].count() == 0


def test_report_describes_the_mix_that_is_drawn(spark, small):
    queries = entry.queries()
    mix = queries["p8_mix"](spark, small).groupBy("mix_id", "source").sum("size").collect()
    want = {(r.mix_id, r.source): r[2] for r in mix if r[2]}
    got = {(r.mix_id, r.source): r.drawn_size for r in queries["p8_report"](spark, small).collect() if r.drawn_size}
    assert want and got == want


def test_short_is_read_off_the_draw(spark, monkeypatch):
    docs, mix = [(i, "a", "w w w") for i in range(600)] + [(1000 + i, "b", "w") for i in range(50)], [(1, "a", 0.5, 1, 1.0), (1, "b", 0.5, 2, 1.0), (1, "none", 0.1, 2, 1.0)]
    _, r = mixed(spark, docs, mix)
    assert {s for (_, s), x in r.items() if x.short} == {"b", "none"}
    # deal a shard less: nothing is exhausted any more, so the report changes
    whole = mixing._split
    monkeypatch.setattr(mixing, "_split", lambda shards, seed: lambda pdf: whole(shards, seed)(pdf).query("shard > 0"))
    _, r = mixed(spark, docs, mix)
    assert r[1, "b"].drawn_size < 100 and not r[1, "b"].short


def test_shards_follow_the_size_of_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SIZE", 100)
    docs, mix = [(i, "a", "w w w") for i in range(2000)], [(1, "a", 1.0, 1, 1.0)]
    m, r = mixed(spark, docs, mix)
    got = m.toPandas().groupby("shard")["size"].sum()
    assert len(got) == 60 and got.max() < 400 and r[1, "a"].drawn_size == 6000
