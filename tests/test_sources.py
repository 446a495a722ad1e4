"""Files in and out."""

import datetime
import glob

import pytest

from paneloom import PanelSpec
from paneloom.functions import nan_to_null
from paneloom.operators import selection as sel
from paneloom.operators.labels import attach_target, join_labels, require_unique_labels, unlabelled
from paneloom.operators.profile import describe, rows_per_file
from paneloom.sources import files, reports

SPEC = PanelSpec(key="k", order="t", categoricals=())


def lines(path):
    out = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        out += open(name).read().splitlines()
    return out


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("k,t,x,n\na,2024-01-01,1.5,1\nb,2024-02-01,,2\nc,2024-03-01,2.25,3\n")
    return str(path)


def test_csv_types_are_inferred(spark, csv):
    df = files.read_csv(spark, csv)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "date", "double", "int"]
    assert df.collect()[0] == ("a", datetime.date(2024, 1, 1), 1.5, 1)


def test_csv_to_parquet(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    df = files.csv_to_parquet(spark, csv, out, "k string, t date, x double, n bigint", rows_per_file=2)
    assert df.count() == 3 and dict(df.dtypes)["n"] == "bigint"
    assert len(glob.glob(f"{out}/*.snappy.parquet")) == 2
    assert files.csv_to_parquet(spark, csv, out).count() == 3
    counts = {r["file_name"]: r["n_rows"] for r in rows_per_file(df.sparkSession.read.parquet(out)).collect()}
    assert sum(counts.values()) == 3


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("k,n,x\na,1,0.5\nb,two,0.5\nc,3,0.5,9,9\nd,4,1.0\n")
    schema = "k string, n int, x double"
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(path), schema).collect()
    tolerant = files.read_csv_tolerant(spark, str(path), schema)
    assert [r["k"] for r in tolerant.collect()] == ["a", "d"]
    # also when the broken column is not read
    assert tolerant.select("k").count() == 2 and tolerant.count() == 2
    assert files.csv_to_parquet(spark, str(path), str(tmp_path / "o"), schema, tolerant=True).count() == 2


def test_rejected_lines_have_place_and_cause(spark, tmp_path):
    long = "".join(f"r{i},{i},0.5\n" if i % 100 else f"r{i},x{i},0.5\n" for i in range(3000))
    (tmp_path / "a.csv").write_text("k,n,x\n" + long)
    (tmp_path / "b.csv").write_text(
        "\n \nk,n,x\na,1,0.5\nb,two,0.5\n\nc,3,0.5,9,9\nd,4,1.0\ne,5,0.5,\nf\ng,,\nh,6\n,,no\n"
        '"i,7",7,0.5\nj,1.5,no\n'
    )
    (tmp_path / "c.csv").write_text("k,n,x\n")
    (tmp_path / "d.csv").write_text("")
    path, schema = str(tmp_path / "*.csv"), "k string, n int, x double"
    with_small_parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        audit = files.audit_csv(spark, path, schema)
        rejected, counts = audit.rejected.collect(), audit.counts.collect()
        accepted = files.read_csv_tolerant(spark, path, schema).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_small_parts)
    of = lambda name: sorted(
        (r["line"], r["cause"], r["text"]) for r in rejected if r["file_path"].endswith(name)
    )
    assert of("a.csv") == [(i + 2, "n is no int", f"r{i},x{i},0.5") for i in range(0, 3000, 100)]
    assert of("b.csv") == [
        (5, "n is no int", "b,two,0.5"), (7, "too many fields", "c,3,0.5,9,9"),
        (9, "too many fields", "e,5,0.5,"), (10, "too few fields", "f"),
        (12, "too few fields", "h,6"), (13, "x is no double", ",,no"), (15, "n is no int", "j,1.5,no"),
    ]
    assert len(rejected) == len(of("a.csv")) + len(of("b.csv"))
    total = {c: sum(r[c] for r in counts) for c in counts[0].asDict() if c != "file_path"}
    assert total == {"lines": 3001 + 15 + 1, "headers": 3, "blank": 3, "accepted": accepted, "rejected": 37}
    for r in counts:
        assert r["lines"] == r["headers"] + r["blank"] + r["accepted"] + r["rejected"]


def test_audit_infers_types(spark, csv):
    audit = files.audit_csv(spark, csv)
    assert audit.rejected.count() == 0
    assert [tuple(r)[1:] for r in audit.counts.collect()] == [(4, 1, 0, 3, 0)]


def test_missing_input(spark, tmp_path):
    for read in (files.read_parquet, files.read_csv, files.read_csv_tolerant, files.audit_csv):
        with pytest.raises(files.MissingInput, match="nothing_"):
            read(spark, str(tmp_path / "nothing_*.x"))


def test_many_files_are_one_table(spark, tmp_path):
    for i in range(3):
        spark.range(4).coalesce(1).write.parquet(str(tmp_path / f"data_{i}.parquet"))
    df = files.read_parquet(spark, str(tmp_path / "data_*.parquet"))
    assert df.count() == 12 and files.file_count(df) == 3
    placed = files.with_file_position(spark, str(tmp_path / "data_*.parquet"))
    assert placed.select("file_path", "row_index").distinct().count() == 12


def test_describe(spark):
    df = spark.createDataFrame([], "a string, b double, c bigint, d date")
    got = [(r["column_name"], r["column_type"], r["null"]) for r in describe(df).collect()]
    assert got == [
        ("a", "VARCHAR", "YES"), ("b", "DOUBLE", "YES"), ("c", "BIGINT", "YES"), ("d", "DATE", "YES")
    ]
    assert describe(df).columns == ["column_name", "column_type", "null", "key", "default", "extra"]


def test_lists_and_reports(spark, tmp_path):
    reports.write_lines(spark, ["k", "target", "x_last"], str(tmp_path / "a"))
    assert lines(tmp_path / "a") == ["k", "target", "x_last"]
    reports.write_numbered_list(spark, ["x", "y"], str(tmp_path / "b"))
    assert lines(tmp_path / "b") == ["SELECTED FEATURES (2 total)", "=" * 60, "", "1. x", "2. y"]
    removals = spark.createDataFrame(
        [(4, 0, "m", "Missing 95%"), (1, 5, "i", sel.REASON_ID), (1, 2, "j", sel.REASON_ID)],
        "rule int, position int, feature string, reason string",
    )
    reports.write_csv_report(sel.report_rows(removals), str(tmp_path / "c"))
    assert lines(tmp_path / "c") == [
        "Feature,Motivo", f"j,{sel.REASON_ID}", f"i,{sel.REASON_ID}", "m,Missing 95%"
    ]
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, score double")
    assert [tuple(r) for r in reports.importance_report(sel.normalised(scores)).collect()] == [
        ("b", 3.0, 0.75), ("a", 1.0, 0.25)
    ]


def test_labels(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 1)], "k string, t int")
    labels = spark.createDataFrame([("a", 1.0), ("c", None), (None, 1.0)], "k string, target double")
    assert sorted(tuple(r) for r in join_labels(rows, labels, SPEC).dropna().collect()) == [
        ("a", 1, 1.0), ("a", 2, 1.0)
    ]
    got = attach_target(rows, labels, SPEC)
    assert sorted(r["t"] for r in got.collect()) == [1, 2]
    assert dict(got.dtypes)["target"] == "int"
    assert unlabelled(rows, labels, SPEC).count() == 3
    require_unique_labels(labels, SPEC)
    with pytest.raises(ValueError, match="several labels"):
        require_unique_labels(labels.union(labels.where("k = 'a'")), SPEC)
    with pytest.raises(ValueError, match="target"):
        join_labels(rows, labels.drop("target"), SPEC)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, x double")
    assert [r["x"] for r in nan_to_null(df).orderBy("i").collect()] == [None, 1.0]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from paneloom.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(
        sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default)
    )
    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(session)
