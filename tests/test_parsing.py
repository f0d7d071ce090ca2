from thicket.operators import parsing

RAW = "raw_id long, subgraph_id long, fmt string, line string"


def judge(spark, lines, fmt="csv", nfeats=2, nlabels=5):
    raw = spark.createDataFrame([(i, 1, fmt, x) for i, x in enumerate(lines)], RAW)
    meta = spark.createDataFrame([(1, nfeats, nlabels)], "subgraph_id long, nfeats int, nlabels int")
    bad = {r.raw_id: r.reason for r in parsing.rejected(raw, meta).collect()}
    good = {r.raw_id for r in parsing.strict_load(raw, meta).collect()}
    assert good | set(bad) == set(range(len(lines))) and not good & set(bad)
    return [bad.get(i) for i in range(len(lines))]


def test_csv_reasons(spark):
    lines = ["1,2,ok,1,2", '"1","2","a ""b"", c",.5,"-1e3"', ' 1 ,\t0,,+1.,2\r', '1,2,a"b,1,2', '1,2,"a",1', "x,2,a,1,2", ",2,a,1,2", "1,6,a,1,2", "1,-1,a,1,2", "1,2,a,1,1e39", "1,2,a,1,NaN", "", '"1,2,a,1,2', '1,2,"a" b,1,2', '" 1",2,a,1,2', "1,2,a,1,2\r\r", "١,2,a,1,2", "1,00000000000000000000000000000000000000000000000003,a,1,2"]
    want = [None, None, None, "quoting", "columns", "ident", "ident", "label", "label", "feature", "feature", "columns", "quoting", "quoting", "ident", "feature", "ident", None]
    assert judge(spark, lines) == want


def test_txt_reasons(spark):
    lines = ["1 2 1 2", "  1\t\t2 1.5  -2e-3 ", "1 2 1", '1 2 "1" 2', "a 2 1 2", "1 9 1 2", "1 2 . 2", "1 2 1e 2", "", None, "1 2 3.4028235e38 0", "1 2 3.4028234e38 0", "1 2 1,0 2"]
    want = [None, None, "columns", "feature", "ident", "label", "feature", "feature", "columns", "columns", "feature", None, "feature"]
    assert judge(spark, lines, "txt") == want


def test_long_lines_nulls_and_unknown_subgraph(spark):
    long = '1,2,"' + "x" * 300_000 + '""' * 20_000 + '",1,2'
    assert judge(spark, [long, "1,2," + ",".join(["7"] * 50_000)]) == [None, "columns"]
    assert judge(spark, ["1 2 1 2", "bad"], None) == [None, "columns"]
    raw = spark.createDataFrame([(1, None, "txt", "1 2 3"), (2, 99, "txt", "1 2 3")], RAW)
    meta = spark.createDataFrame([(1, 2, 5)], "subgraph_id long, nfeats int, nlabels int")
    assert {r.reason for r in parsing.rejected(raw, meta).collect()} == {"columns"}
    assert parsing.rejected(raw.limit(0), meta).count() == 0 and parsing.strict_load(raw.limit(0), meta).count() == 0


def test_clashing_columns_and_repeats(spark):
    raw = spark.createDataFrame([(1, 1, "txt", "1 2 1 2"), (1, 1, "txt", "1 2 1 2"), (2, 1, "txt", "x"), (2, 1, "txt", "x")], RAW).selectExpr("*", "1 as nfeats", "2 as body", "3 as fields", "4 as _sid")
    meta = spark.createDataFrame([(1, 2, 5, 7)], "subgraph_id long, nfeats int, nlabels int, line int")
    assert [tuple(r) for r in parsing.rejected(raw, meta).collect()] == [(2, "columns")]
    assert parsing.strict_load(raw, meta).count() == 2


def test_lines_of_very_many_fields(spark):
    n = 30_000
    sub = spark.createDataFrame([(1, n, 3)], "subgraph_id long, nfeats int, nlabels int")
    rows = [(1, 1, "txt", "7 2 " + "1.5 " * n), (2, 1, "csv", '7, "2" ,note' + ',"-.5e1"' * n), (3, 1, "csv", "7,2,note" + ",1e39" * n), (4, 1, "txt", "7 2 " + "1.5 " * (n - 1) + "x")]
    raw = spark.createDataFrame(rows, "raw_id long, subgraph_id long, fmt string, line string")
    got = {r.raw_id: (r.truelabel, len(r.feat), r.feat[-1]) for r in parsing.strict_load(raw, sub).collect()}
    assert got == {1: (2, n, 1.5), 2: (2, n, -5.0)}
    assert {tuple(r) for r in parsing.rejected(raw, sub).collect()} == {(3, "feature"), (4, "feature")}
