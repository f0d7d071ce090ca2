import math

import pytest

import __spark_entry__ as entry
from thicket import catalog
from thicket.operators import supervised
from thicket.sources import samples
from thicket.plans.components import components


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components_by_stars_and_by_one_task(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7), (300, 300), (None, 4), (101, 100)] + [(200, 200 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in components(df).collect()}
    assert one == {tuple(r) for r in components(df, local_edges=0).collect()}
    assert (60, 1) in one and (102, 100) in one and (229, 200) in one and (300, 300) in one and len(one) == 60 + 3 + 30 + 1
    assert components(df.limit(0)).count() == 0


def test_learning_queries_run_on_whole_vectors_and_stored_labels(spark, small, monkeypatch):
    def cut_short(*_):
        raise AssertionError("embeddings3")

    monkeypatch.setattr(samples, "embeddings3", cut_short)
    label = {r.position: r.truelabel for r in samples.embeddings(spark, small).collect()}
    for name in ("best_k", "elim_area", "elim_volume", "cluster"):
        assert entry.queries()[name](spark, small).count() > 0
    rows = entry.queries()["semi_train"](spark, small).collect()
    assert {r.label for r in rows} == set(label.values()) and len(rows) > 300


def same(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-3) if isinstance(a, float) else a == b


@pytest.mark.parametrize("name", ["distance_matrix_whole", "distance_matrix_normalized_whole", "distance_matrix_symmetric_whole", "ascii_export_whole", "ascii_parse_whole", "normalize_per_fold_whole", "mst_edges_whole", "prototypes_whole", "train_pathval_whole", "train_labels_whole"])
def test_whole_vector_queries_equal_their_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = entry.queries()[name](spark, small)
    want = sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    got = sorted(tuple(r) for r in got.collect())
    assert len(got) >= 300 and same(got, want)


def test_lines_are_checked_by_the_header_of_their_file(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("raw_line", "subgraph"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    got = {tuple(r) for r in entry.queries()["ascii_check_files"](spark, small).collect()}
    assert got == set(con.execute(entry.oracle_sql()["ascii_check_files"]).fetchall())
    assert got != {tuple(r) for r in entry.queries()["ascii_check"](spark, small).collect()}


def test_closure_marks_the_conquerors_of_evaluation_rows(spark, small):
    train, evaluation, _ = catalog._three(spark, small)
    model = supervised.fit(train).cache()
    pred = {r.position: r.pred for r in model.collect()}
    want = set()
    for r in supervised.classify(model, evaluation).collect():
        v = r.conqueror
        while v is not None:
            want.add(v)
            v = pred[v]
    assert want and {r.position for r in entry.queries()["ancestor_closure_conquerors"](spark, small).collect()} == want
    assert {r.position for r in entry.queries()["remove_irrelevant_conquerors"](spark, small).collect()} == want


def test_numbers_by_ranges_equal_numbers_by_one_window(spark):
    from pyspark.sql import functions as F

    from thicket.plans.runtime import numbered

    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"), (F.col("id") % 3).alias("g"))
    one, two = ({tuple(r) for r in numbered(df, "n", F.desc("g"), F.col("v"), small=s).collect()} for s in (1000, 10))
    assert one == two and {r[2] for r in one} == set(range(1, 501))
    assert numbered(df.limit(0), "n", F.col("v"), small=0).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from thicket.plans import runtime

    class Frame:
        class sparkSession:
            class sparkContext:
                master = "yarn"
                getCheckpointDir = staticmethod(lambda: None)

            class conf:
                get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        runtime.cut(Frame)


PROGRAMS = ["learn", "agglomerative_learn", "prune", "semi_retrained", "cluster", "best_k", "train_labels", "experiment", "swap_errors", "classify_custom", "binary_model"]


@pytest.mark.parametrize("name", PROGRAMS)
def test_programs_equal_their_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = entry.queries()[name](spark, small)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want)) or same(sorted(tuple(r) for r in got.collect()), sorted(want))
