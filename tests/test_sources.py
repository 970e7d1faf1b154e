"""Readers and sinks."""

import datetime

import pytest
from pyspark.sql import functions as F

from skuflow.operators.documents import clean_pages
from skuflow.operators.suppliers import sku_bridge, sku_lead_time
from skuflow.plans import queries
from skuflow.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_demand_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", "period,sku_id,abc_class,net_units\n2024-03,A-1,—,7\n2024-04,A-1,A,\n")
    rows = readers.read_demand(spark, path).orderBy("period").collect()
    assert [(r.period, r.sku_id, r.abc_class, r.net_units) for r in rows] == [
        (datetime.date(2024, 3, 1), "A-1", "—", 7.0), (datetime.date(2024, 4, 1), "A-1", "A", None)
    ]


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", "sku_id,net_units,period\nA,1,2024-01\n")
    write(tmp_path / "b.csv", "net_units,sku_id,period\n1,A,2024-01\n")
    with pytest.raises(Exception, match="header"):
        readers.read_demand(spark, str(tmp_path)).collect()


def test_quoted_cells_and_bad_cells(spark, tmp_path):
    text = 'supplier_id,penalty_clause,price_valid_until,notes\nS1,"5% ""late"" fee, weekly",31-12-2025,"two\nlines"\n'
    path = write(tmp_path / "q.csv", text)
    row = readers._csv(spark, path, readers.schemas.SUPPLIER_TERMS).first()
    assert (row.penalty_clause, row.price_valid_until, row.notes) == ('5% "late" fee, weekly', "31-12-2025", "two\nlines")
    back = str(tmp_path / "back")
    sinks.save_csv(readers._csv(spark, path, readers.schemas.SUPPLIER_TERMS), back)
    assert readers._csv(spark, back, readers.schemas.SUPPLIER_TERMS).first() == row
    bad = write(tmp_path / "bad.csv", "sku_id,net_units,period\nA,12x,2024-01\n")
    with pytest.raises(Exception, match="12x|MALFORMED"):
        readers.read_demand(spark, bad).collect()


def test_supplier_terms_csv_and_bridge(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        "supplier_id,skus_supplied,lead_time_days,price_valid_until\nS2,a-1; B-2,20,31-12-2025\nS1,A-1;C-3,30,01-02-2024\nS3,,5,\n",
    )
    terms = readers.read_supplier_terms(spark, path)
    assert terms.where("supplier_id = 'S1'").first().price_valid_until == datetime.date(2024, 2, 1)
    bridge = sku_bridge(terms)
    assert {(r.supplier_id, r.sku_id) for r in bridge.collect()} == {
        ("S2", "A-1"), ("S2", "B-2"), ("S1", "A-1"), ("S1", "C-3")
    }
    lead = sku_lead_time(bridge, terms.withColumns({"supplier_name": F.lit("n"), "on_time_rate_pct": F.lit(1.0)}))
    assert {r.sku_id: r.lead_time_days for r in lead.collect()} == {"A-1": 30, "B-2": 20, "C-3": 30}


def test_inventory_csv(spark, tmp_path):
    path = write(tmp_path / "i.csv", "sku_id,total_available,reorder_point,snapshot_date\nA,5,9,18-05-2025\n")
    row = readers.read_inventory(spark, path).first()
    assert (row.total_available, row.snapshot_date) == (5, datetime.date(2025, 5, 18))


def test_documents_pages_and_rejects(spark, tmp_path):
    write(tmp_path / "b.txt", "page one\fpage two")
    write(tmp_path / "a.txt", "only")
    write(tmp_path / "skip.md", "no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff broken")
    pages, rejects = readers.read_documents(spark, str(tmp_path))
    assert sorted((r.source, r.page, r.text) for r in pages.collect()) == [
        ("a.txt", 0, "only"), ("b.txt", 0, "page one"), ("b.txt", 1, "page two")
    ]
    assert [r.source for r in rejects.collect()] == ["bad.txt"]


def test_documents_need_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path))


def test_many_documents_lie_in_few_folders(spark, tmp_path):
    n = 3 * sinks.SOURCE_GROUPS
    pages = spark.range(2 * n).selectExpr(f"concat('s', id % {n}, '.txt') source", f"id div {n} page", "concat('text ', id) text")
    path = tmp_path / "documents"
    sinks.save_documents(pages, str(path))
    assert len([x for x in path.iterdir() if x.is_dir()]) <= sinks.SOURCE_GROUPS
    assert len([x for x in path.rglob("*") if x.is_file()]) == n  # no checksums, no drafts
    read, rejects = readers.read_documents(spark, str(path), nested=True)
    kept = sorted((r.source, r.page, r.text) for r in read.where("text != ''").collect())
    assert kept == sorted((f"s{i % n}.txt", i // n, f"text {i}") for i in range(2 * n))
    assert rejects.isEmpty()


def test_documents_written_by_tasks_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    names = ["a.txt", "B 1", "50%", "x/y", "k=v:w", "q?#*'\"", "[b]{c}^\\", "tab\there", "Ünï", "", None]
    rows = [(name, page, f"{name} {page}" if page != 2 else None) for page in (3, 1, 2) for name in names]
    pages = spark.createDataFrame(rows, "source string, page int, text string")
    spoiled = pages.limit(1).selectExpr("'bad' source", "0 page", "cast(X'41FFFE' as string) text")
    written = {}
    for kind in ("tasks", "spark"):
        path = tmp_path / kind
        sinks.save_documents(pages.unionByName(spoiled), str(path))
        files = [x for x in path.rglob("*.txt") if x.is_file() and not x.name.startswith(".")]
        written[kind] = sorted((str(x.parent.relative_to(path)), x.read_bytes()) for x in files)
        flat, nested = ([x.select("source").collect() for x in readers.read_documents(spark, str(path), nested=n)] for n in (False, True))
        assert [sorted(map(str, x)) for x in flat] == [sorted(map(str, x)) for x in nested]
        assert [r.source for r in nested[1]] == ["bad"]
        monkeypatch.setattr(sinks, "local_path", lambda spark, path: None)
    assert written["tasks"] == written["spark"]
    assert len(written["tasks"]) == len(names) + 1


def test_documents_are_opened_once_by_bounded_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_bytes(b"\xff" if i % 10 == 0 else f"text {i}\f ".encode())
    monkeypatch.setattr(readers, "READ_TASKS", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = readers.read_pages(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() <= 8
        found = sorted((int(r.source[:-4]), r.page, r.text, r.reason) for r in clean_pages(read, also=F.col("reason").isNotNull()).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(i, None, None, "not UTF-8 text") if i % 10 == 0 else (i, 0, f"text {i}", None) for i in range(40)]


def test_scan_documents_reads_its_files_in_one_scan(spark):
    plan = queries.QUERIES["scan_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1


def test_documents_are_never_written_over(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "x")], "source string, page int, text string")
    sinks.save_documents(pages, str(tmp_path / "d"))
    with pytest.raises(FileExistsError):
        sinks.save_documents(pages, str(tmp_path / "d"))


def test_no_documents_are_an_empty_folder(spark, tmp_path):
    sinks.save_documents(spark.createDataFrame([], "source string, page int, text string"), str(tmp_path / "d"))
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "d"), nested=True)


def test_explode_catalog(spark):
    catalogs = spark.createDataFrame(
        [("S1", [("A", 3.0), ("B", 4.0)]), ("S2", [])], "supplier_id string, products array<struct<sku:string,price:double>>"
    )
    assert sorted(map(tuple, readers.explode_catalog(catalogs).collect())) == [("S1", "A", 3.0), ("S1", "B", 4.0)]


def test_features_are_partitioned_by_year(spark, tmp_path):
    rows = spark.createDataFrame([("A", datetime.date(2020 + i % 3, 1, 1), float(i)) for i in range(9)],
                                 "sku_id string, period date, lag_1 double")
    path = str(tmp_path / "f")
    sinks.save_features(rows, path)
    sinks.save_features(rows, path)
    stored = sinks.load_features(spark, path)
    assert stored.count() == 9
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"year=2020", "year=2021", "year=2022"}


def test_runs_are_appended(spark, tmp_path):
    path = str(tmp_path / "runs")
    for rmse in (1.5, 2.5):
        sinks.log_run(spark, path, "r", {"trees": 300}, {"rmse": rmse})
    rows = spark.read.parquet(path).collect()
    assert sorted(r.metrics["rmse"] for r in rows) == [1.5, 2.5]
    assert rows[0].params == {"trees": "300"}


def test_supplier_profile_shows_the_columns_there_are(spark):
    from skuflow.operators.suppliers import supplier_profile

    directory = spark.createDataFrame(
        [("S1", "One", "Pune", "MH", "Pipes", 92.0, "30 days net")],
        "supplier_id string, supplier_name string, city string, state string, category string, on_time_rate_pct double, "
        "payment_terms string",
    )
    terms = spark.createDataFrame(
        [("S1", 36, 116, 30, 20.0, "2% per week", None), ("S2", 5, 10, 0, 0.0, "none", "new")],
        "supplier_id string, lead_time_days int, min_order_qty int, credit_days int, advance_pct double, "
        "penalty_clause string, notes string",
    )
    rows = {r.supplier_id: r for r in supplier_profile(terms, directory).collect()}
    assert rows["S1"].profile_text == (
        "Supplier: One (S1)\n  City: Pune, MH\n  Category: Pipes\n  On-time rate: 92%\n  Payment terms: 30 days net\n"
        "  Lead time: 36 days\n  MOQ: 116 units\n  Credit: 30 days\n  Advance: 20%\n  Penalty: 2% per week"
    )
    assert (rows["S2"].in_directory, rows["S2"].in_terms) == (False, True)
    assert rows["S2"].profile_text.startswith("  Lead time: 5 days")
