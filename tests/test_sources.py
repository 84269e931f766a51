import pytest
import os
import tempfile

from softgrove.sources.tables import read_table, read_tables, zip_by_position


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_headerless_truncation_blank_lines_and_null_token(spark):
    d = tempfile.mkdtemp(prefix="sg-src-")
    p = _write(d, "a.data", "1,x,3.5,extra1,extra2\n2,?,4.5,e,e\n\n3,y,?,e,e\n")
    df = read_table(spark, p, ["id", "c", "v"], null_token="?", types={"id": "int", "v": "double"})
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3]
    assert rows[1]["c"] is None and rows[2]["v"] is None and rows[0]["v"] == 3.5


def test_header_replaced_space_sep_and_stacking(spark):
    d = tempfile.mkdtemp(prefix="sg-src-")
    p1 = _write(d, "a.txt", "A B\n1 2\n3 4\n")
    p2 = _write(d, "b.txt", "A B\n5 6\n")
    df = read_tables(spark, [p1, p2], columns=["left", "right"], sep=" ", header=True, types={"left": "int"})
    assert sorted(r["left"] for r in df.collect()) == [1, 3, 5]


def test_zip_by_position(spark):
    x = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "f double").coalesce(1)
    y = spark.createDataFrame([(0,), (1,), (0,)], "class int").coalesce(1)
    z = sorted((r["row_id"], r["f"], r["class"]) for r in zip_by_position(x, y).collect())
    assert z == [(0, 10.0, 0), (1, 20.0, 1), (2, 30.0, 0)]


def test_catalog_recipe_on_handmade_files(spark):
    import pytest
    from fixtures import iris_like
    from softgrove.sources.catalog import prepare_table

    root = tempfile.mkdtemp(prefix="sg-cat-")
    os.makedirs(os.path.join(root, "Iris"))
    pdf = iris_like()
    text = "\n".join(",".join(str(v) for v in r) for r in pdf.itertuples(index=False)) + "\n\n"
    _write(os.path.join(root, "Iris"), "iris.data", text)
    df, feats, cats = prepare_table(spark, "Iris", root)
    assert feats == ["sepal_length", "sepal_width", "petal_length", "petal_width"] and cats == []
    assert df.count() == 150
    assert sorted(r["label"] for r in df.select("label").distinct().collect()) == [0, 1, 2]
    os.makedirs(os.path.join(root, "Heart Disease"))
    _write(os.path.join(root, "Heart Disease"), "processed.cleveland.data",
           "63.0,1.0,1.0,145.0,233.0,1.0,2.0,150.0,0.0,2.3,3.0,0.0,6.0,0\n"
           "67.0,1.0,4.0,160.0,286.0,0.0,2.0,108.0,1.0,1.5,2.0,3.0,?,2\n"
           "67.0,1.0,4.0,120.0,229.0,0.0,2.0,129.0,1.0,2.6,2.0,?,7.0,1\n"
           "37.0,1.0,3.0,130.0,250.0,0.0,0.0,187.0,0.0,3.5,3.0,0.0,3.0,0\n")
    df, feats, cats = prepare_table(spark, "BIN:Heart Disease", root)
    rows = df.orderBy("row_id").collect()
    assert [r["label"] for r in rows] == [1, 0, 0, 1]
    assert rows[2]["ca"] == 0.0 and rows[1]["thal"] in ("3.0", "6.0", "7.0")
    with pytest.raises(ValueError):
        prepare_table(spark, "no such table", root)


def test_catalog_preamble_two_files_and_tokens(spark):
    from softgrove.sources.catalog import SEGMENT, COLIC, DERMATOLOGY, prepare_table

    root = tempfile.mkdtemp(prefix="sg-cat2-")
    os.makedirs(os.path.join(root, "Segment"))
    row = lambda cls, v: ",".join([cls] + [str(v + i) for i in range(19)])
    pre = ";;; preamble line\n;;; another\n\nCOL-A,COL-B\n\n"
    _write(os.path.join(root, "Segment"), "segmentation.data", pre + "\n".join([row("SKY", 1.0), row("CEMENT", 2.0)]) + "\n")
    _write(os.path.join(root, "Segment"), "segmentation.test", pre + row("SKY", 3.0) + "\n")
    df, feats, _ = prepare_table(spark, "Segment", root)
    rows = df.orderBy("row_id").collect()
    assert len(rows) == 3 and feats == SEGMENT[1:]
    assert sorted(r["region-centroid-col"] for r in rows) == [1.0, 2.0, 3.0]
    assert sorted(r["label"] for r in rows) == [0, 1, 1]  # CEMENT < SKY

    os.makedirs(os.path.join(root, "Colic"))
    line = lambda les, v: " ".join(["1", "?" if v else "2", "530101"] + [str(v)] * 20 + [str(les)] + ["0"] * 4) + " "
    _write(os.path.join(root, "Colic"), "horse-colic.data", "\n".join([line(1, 0), line(2, 1), line(2, 1)]) + "\n")
    _write(os.path.join(root, "Colic"), "horse-colic.test", line(1, 0) + "\n")
    df, feats, cats = prepare_table(spark, "BIN:Horse Colic", root)
    assert len(feats) == 26 and len(cats) == 15 and "Hospital Number" not in feats
    ages = [r["Age"] for r in df.collect()]
    assert sorted(ages) == [2.0, 2.0, 2.0, 2.0]  # '?' filled with the column mode

    os.makedirs(os.path.join(root, "Dermatology"))
    vals = lambda age, d: ",".join(["1"] * 33 + [age, str(d)])
    _write(os.path.join(root, "Dermatology"), "dermatology.data",
           "\n".join([vals("20", 1), vals("?", 2), vals("40", 1)]) + "\n")
    df, feats, _ = prepare_table(spark, "MULT:Dermatology", root)
    assert feats[-1] == DERMATOLOGY[-2]
    assert sorted(r["Age (linear)"] for r in df.collect()) == [20.0, 30.0, 40.0]
    assert COLIC[23] == "surgical lesion?"


def test_catalog_xy_pair_and_fills(spark):
    from softgrove.sources.catalog import prepare_table

    root = tempfile.mkdtemp(prefix="sg-cat3-")
    os.makedirs(os.path.join(root, "pen_digits"))
    _write(os.path.join(root, "pen_digits"), "X_pen_digits.csv", "a,b\n1,2\n3,4\n5,6\n")
    _write(os.path.join(root, "pen_digits"), "y_pen_digits.csv", "class\n7\n3\n7\n")
    df, feats, _ = prepare_table(spark, "pen_digits", root)
    got = sorted((r["a"], r["b"], r["label"]) for r in df.collect())
    assert feats == ["a", "b"] and got == [(1.0, 2.0, 1), (3.0, 4.0, 0), (5.0, 6.0, 1)]

    os.makedirs(os.path.join(root, "Titanic"))
    _write(os.path.join(root, "Titanic"), "train.csv",
           "PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked\n"
           "1,0,3,x,male,22,1,0,t,7.25,,S\n2,1,1,y,female,,1,0,t,71.3,C85,C\n3,1,3,z,female,26,0,0,t,,,\n")
    df, feats, cats = prepare_table(spark, "BIN:Titanic", root)
    rows = df.orderBy("row_id").collect()
    assert feats == ["Sex", "Embarked", "Pclass", "Age", "SibSp", "Parch", "Fare"]
    assert cats == ["Embarked", "Sex", "Pclass"]
    assert rows[1]["Age"] == 24.0 and rows[2]["Embarked"] == "S" and abs(rows[2]["Fare"] - 39.275) < 1e-9
    assert [r["label"] for r in rows] == [0, 1, 1]


def test_parquet_scan_with_column_selection(spark):
    from conftest import SF
    df = read_table(spark, f"{SF}/orders.parquet", ["o_orderkey", "o_orderstatus"], fmt="parquet")
    assert df.columns == ["o_orderkey", "o_orderstatus"] and df.count() > 0


def _write_files(folder, sizes, column, make):
    import os
    os.makedirs(folder)
    at = 0
    for k, n in enumerate(sizes):
        with open(f"{folder}/part-{k}.csv", "w") as f:
            f.write(column + "\n" + "".join(make(at + i) + "\n" for i in range(n)))
        at += n


def test_zip_by_position_of_folders_with_unequal_files(spark, tmp_path):
    """Files of swapped sizes and several splits each: pairs follow the
    order of paths and rows, however Spark packs the splits."""
    _write_files(f"{tmp_path}/x", [30, 2000, 500], "f", lambda i: f"{i}{'0' * 30}")
    _write_files(f"{tmp_path}/y", [1500, 30, 1000], "class", lambda i: f"c{i}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            x = read_table(spark, f"{tmp_path}/x", header=True)
            y = read_table(spark, f"{tmp_path}/y", header=True)
            got = zip_by_position(x, y).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(got) == 2530
        assert all(r["f"] == f"{r['class'][1:]}{'0' * 30}" and r["row_id"] == int(r["class"][1:]) for r in got)


def test_numbers_are_cast_before_modes_and_codes(spark, tmp_path):
    from softgrove.sources.catalog import TableSpec, prepare_table
    lines = [(0.2, 10), ("0.20", 2), (0.15, 1), ("0.150", 11), ("", 12)] + [(9 + k, k) for k in range(3, 10)]
    with open(f"{tmp_path}/t.csv", "w") as f:
        f.write("".join(f"{a},{b}\n" for a, b in lines))
    spec = TableSpec("t", ["t.csv"], ["v", "cls"], "cls", impute=[("fill_mode_all", {})])
    df, feats, _ = prepare_table(spark, spec, str(tmp_path))
    rows = df.orderBy("row_id").collect()
    assert feats == ["v"] and rows[4]["v"] == 0.15  # 0.15 and 0.2 tie; the lower number wins
    assert [r["label"] for r in rows] == [b - 1 for _, b in lines]


@pytest.mark.parametrize("name", ["WisconsinBreastCancer", "user knowledge", "iranian"])
def test_catalog_tables_landed_as_features_and_target(spark, tmp_path, name):
    from softgrove.sources.catalog import LANDED_XY_TABLES, prepare_table
    assert name in LANDED_XY_TABLES
    folder = tmp_path / name
    folder.mkdir()
    (folder / f"X_{name}.csv").write_text("a.1,class size\n0.5,2\n,4\n1e-3,6\n")
    (folder / f"y_{name}.csv").write_text("target\nvery_low\nHigh\nvery_low\n")
    df, feats, cats = prepare_table(spark, name, str(tmp_path))
    rows = df.orderBy("row_id").collect()
    assert feats == ["a.1", "class size"] and cats == []
    assert [(r["a.1"], r["class size"], r["label"]) for r in rows] == [(0.5, 2.0, 1), (None, 4.0, 0), (0.001, 6.0, 1)]


def test_catalog_sheets_landed_as_csv(spark, tmp_path):
    from softgrove.sources.catalog import CATALOG, SHEET_TABLES, prepare_table
    assert len(CATALOG) == 53
    for name, path in SHEET_TABLES.items():
        file = tmp_path / path
        file.parent.mkdir()
        file.write_text("Area,Major Axis,Class\n100,1.5,Kecimen\n90,2.5,Besni\n")
        df, feats, cats = prepare_table(spark, name, str(tmp_path))
        assert feats == ["Area", "Major Axis"] and cats == []
        assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, 100.0, 1.5, 1), (1, 90.0, 2.5, 0)]
