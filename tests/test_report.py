import os

from conftest import as_map

from nodeloom.plans import report as R


def test_combined_table_has_the_29_columns_and_fixed_values(sample):
    table = R.combined_table(sample, R.ReportOptions(bins=4)).orderBy("nodeid")
    v = [f"v_{c}" for c in range(1, 11)]
    head = "nodeid degree count pagerank pagerank_t pagerank_t_count clusCoeff clusCoeff_t cc_t_count".split()
    assert table.columns == head + v + [f"{c}_t" for c in v]
    rows = table.collect()
    assert [r["count"] for r in rows] == [4, 2, 2, 4, 4, 4]
    assert [r.pagerank_t_count for r in rows] == [2, 2, 2, 2, 2, 2]
    assert [round(r.clusCoeff_t, 6) for r in rows] == [0.925, 0.475, 0.475, 0.925, 0.925, 0.925]
    assert [r.cc_t_count for r in rows] == [4, 2, 2, 4, 4, 4]
    assert rows[0].v_5 is None and rows[0].v_5_t is None


def test_plots_count_every_node(sample):
    table = R.combined_table(sample, R.ReportOptions(svd=False, bins=4)).cache()
    assert {tuple(r) for r in R.plot_degree_vs_count(table).collect()} == {(2, 4), (5, 2)}
    assert sum(r["count"] for r in R.plot_degree_vs_pagerank(table).collect()) == 6
    assert R.plot_pagerank_vs_count(table).count() == 3
    assert R.plot_all(table).columns == "degree count pagerank_t pagerank_t_count clusCoeff_t cc_t_count".split()


def test_report_writes_the_chosen_tables(spark, sample, tmp_path):
    chosen = R.ReportOptions(
        out_degree=True, in_degree=True, total_degree=True, degree_vs_count=True, pagerank=True,
        pagerank_vs_count=True, degree_vs_pagerank=True, svd=False, bins=4,
    )
    R.write_report(sample.select("src", "dst"), str(tmp_path / "a"), chosen, single_file=True)
    names = {"out_degree", "in_degree", "total_degree", "degree_vs_count", "pagerank", "pagerank_vs_count", "degree_vs_pagerank", "edges", "combined", "plots"}
    assert set(os.listdir(tmp_path / "a")) == names
    assert len(os.listdir(tmp_path / "a" / "plots")) == 4
    back = spark.read.option("sep", "\t").schema("nodeid bigint, degree bigint").csv(str(tmp_path / "a" / "total_degree"))
    assert as_map(back)[2] == 5
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "a" / "edges")).count() == 9


def test_weighted_report_uses_weighted_statistics(sample):
    chosen = R.ReportOptions(weighted=True, total_degree=True, degree_vs_count=True, degree_vs_pagerank=True, bins=4)
    tables = R.run_report(sample, chosen)
    assert set(tables) == {"total_degree", "degree_vs_count", "degree_vs_pagerank"}
    assert as_map(tables["total_degree"])[3] == 29.0
    assert sorted(r.degree for r in tables["degree_vs_pagerank"].collect()) == [6.0, 11.0, 12.0, 14.0, 18.0, 29.0]
    assert sum(r["count"] for r in tables["degree_vs_count"].collect()) == 6
