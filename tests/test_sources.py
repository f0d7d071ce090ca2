import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import pairwise, supervised
from thicket.sources import ascii as text_form
from thicket.sources import binary
from thicket.streaming.scoring import score_stream

SAMPLE = "position long, truelabel int, feat array<double>"


@pytest.fixture()
def samples(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, 1 + i % 2, np.round(rng.normal(size=3) + 3 * (i % 2), 3).astype(np.float32).astype(float).tolist()) for i in range(40)], SAMPLE)


def same(a, b, cols):
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_binary_round_trips(spark, samples, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "a.dat")
    binary.write_samples(samples, path)
    assert binary.header(path) == {"nnodes": 40, "nlabels": 2, "nfeats": 3}
    back = spark.read.format("forest_samples").option("partition_rows", 7).load(path)
    assert back.rdd.getNumPartitions() == 6
    assert same(back.withColumn("feat", F.col("feat").cast("array<double>")), samples, ["position", "truelabel", "feat"])
    model = supervised.fit(samples).withColumn("radius", F.lit(0.5))
    binary.write_model(model, path, width=1.5)
    got = spark.read.format("forest_model").load(path)
    assert same(got, model, ["position", "truelabel", "pred", "label", "rank"])
    assert binary.model_header(path)["df"] == 1.5
    binary.write_training(samples.withColumn("pathval", F.lit(0.25)), path)
    assert same(spark.read.format("forest_training").load(path), samples.withColumn("pathval", F.lit(0.25)), ["position", "truelabel", "pathval"])
    d = pairwise.distance_matrix(samples)
    binary.write_distances(d, 40, path)
    m = spark.read.format("forest_distances").load(path)
    assert m.count() == 1600 and abs(m.agg(F.sum("d")).first()[0] - d.agg(F.sum("d")).first()[0]) < 1e-2
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception):
        spark.read.format("forest_distances").load(path).count()


def test_text_round_trip_and_checks(spark, samples, tmp_path):
    path = str(tmp_path / "t")
    text_form.write(samples, path)
    rounded = samples.withColumn("feat", F.transform("feat", lambda v: F.round(v, 6)))
    assert same(text_form.read(spark, path), rounded, ["position", "truelabel", "feat"])
    rows = ["1 1 0.5 -2", "a 1 0.5 2", "1 0 1 2", "1 3 1 2", "1 1 1e3 2", "1 1 1", "", "1 1 +1.5 2", None, "1 1 1-2 2"]
    lines = spark.createDataFrame(list(enumerate(rows, 1)), "line_no int, line string")
    strict = [r.ok for r in text_form.check(lines, 2, 2).orderBy("line_no").collect()]
    assert strict == [True, False, False, False, True, False, False, True, False, False]
    classic = [r.ok for r in text_form.check(lines, 2, 2, classic=True).orderBy("line_no").collect()]
    assert classic == [True, False, False, True, False, False, False, False, False, True]
    assert text_form.first_bad(text_form.check(lines, 2, 2)).first()[0] == 2
    assert text_form.check_header("5 2 3") and not text_form.check_header("5 2") and not text_form.check_header("5 0 3")
    labels = tmp_path / "p.out"
    labels.write_text("1\n2\n2\n")
    assert [r.label for r in text_form.read_labels(spark, str(labels)).orderBy("line_no").collect()] == [1, 2, 2]


def test_stream_scores_like_a_batch(spark, samples, tmp_path):
    model = supervised.fit(samples.filter("position < 20")).cache()
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    samples.filter("position >= 20").repartition(3).write.parquet(src)
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(src)
    score_stream(stream, model, str(tmp_path / "cp"), out).awaitTermination(120)
    want = supervised.classify(model, samples.filter("position >= 20"))
    assert same(spark.read.parquet(out), want, ["position", "label"])


def test_lines_are_numbered_over_files_and_pieces(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 101)))
        (tmp_path / "b.txt").write_text("".join(f"{i}\n" for i in range(101, 141)))
        got = text_form.read_labels(spark, str(tmp_path)).orderBy("line_no").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.label) for r in got] == [(i, i) for i in range(1, 141)]


def test_one_feature_short_lines_and_file_check(spark, tmp_path):
    f = tmp_path / "one.txt"
    f.write_text("3 2 1\n0 1 0.5\n1 2 1.5\n2 1 2.5\n")
    assert [(r.position, r.truelabel, r.feat) for r in text_form.read(spark, str(f)).orderBy("position").collect()] == [(0, 1, [0.5]), (1, 2, [1.5]), (2, 1, [2.5])]
    assert text_form.check_file(spark, str(f)) is None
    for text, bad in (("3 2 1\n0 1 0.5\n1 2\n2 1 2.5\n", 3), ("3 2 1\n0 1 0.5\n1 2 1.5\n", 4), ("3 0 1\n0 1 0.5\n", 1), ("1 1 1\n0 1 0.5\nrubbish\n", None), ("", 1)):
        f.write_text(text)
        assert text_form.check_file(spark, str(f)) == bad, text
    f.write_text("2 2 1\n4 1 0.5\n7 2 1.5\n")
    text_form.to_binary(spark, str(f), str(tmp_path / "b.dat"))
    text_form.from_binary(spark, str(tmp_path / "b.dat"), str(tmp_path / "back"))
    assert [(r.position, r.feat) for r in text_form.read(spark, str(tmp_path / "back")).orderBy("position").collect()] == [(4, [0.5]), (7, [1.5])]


def test_many_tasks_write_one_file(spark, tmp_path, monkeypatch):
    from thicket.plans import runtime

    whole = runtime.numbered
    monkeypatch.setattr(binary, "numbered", lambda df, name, *order, **kw: whole(df, name, *order, **(kw | {"small": 10})))
    rows = spark.createDataFrame([(i, 1 + i % 2, [float(i), -float(i)]) for i in range(200, 0, -1)], SAMPLE).repartition(4)
    binary.register(spark)
    path = str(tmp_path / "m.dat")
    binary.write_samples(rows, path)
    got = spark.read.format("forest_samples").option("partition_rows", 33).load(path)
    assert [(r.position, r.truelabel, r.feat) for r in got.collect()] == [(i, 1 + i % 2, [float(i), -float(i)]) for i in range(1, 201)]
