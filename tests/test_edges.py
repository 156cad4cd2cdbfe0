import pytest
from conftest import SAMPLE, as_map

from nodeloom.operators import edges as E
from nodeloom.operators.degrees import degree_distribution, degrees
from nodeloom.sources import edge_lists, sinks


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_reads_text_file_with_comments_and_carriage_returns(spark, tmp_path):
    path = tmp_path / "edges.txt"
    body = "".join(f"{s}\t{d}\r\n" for s, d in SAMPLE)
    path.write_bytes(("# a graph\r\n# src dst\r\n" + body).encode())
    assert pairs(edge_lists.read_edges(spark, str(path))) == sorted(SAMPLE)
    assert edge_lists.read_rejected_lines(spark, str(path)).count() == 0


def test_separators_extra_fields_and_bad_lines(spark):
    t = lines(spark, "#1\t2", "1 2", "3\t4\tx", "", "5  6", "7", "a\tb", "1.5\t2", "8\t9\r", " 1 2", "+3\t-4")
    assert pairs(edge_lists.parse_edges(t)) == [(1, 2), (3, -4), (3, 4), (8, 9)]
    assert edge_lists.rejected_lines(t).count() == 6
    with pytest.raises(Exception, match="not an edge line"):
        edge_lists.parse_edges(t, mode="fail").collect()


def test_weights(spark):
    t = lines(spark, "1\t2\t0.5", "1 3 2e1", "1\t4", "1\t5\tx", "1\t6\t1d")
    assert pairs(edge_lists.parse_edges(t, weighted=True)) == [(1, 2, 0.5), (1, 3, 20.0)]
    assert edge_lists.rejected_lines(t, weighted=True).count() == 3


def test_comment_only_list_is_empty(spark):
    assert edge_lists.parse_edges(lines(spark, "# nothing", "#")).count() == 0


def test_clean_keeps_nonpositive_destinations_and_copies(graph):
    kept = graph([(0, 1), (-1, 2), (1, 0), (2, 2), (1, 2), (1, 2)])
    assert pairs(kept) == [(1, 0), (1, 2), (1, 2)]


def test_reverse_simple_symmetric(graph):
    g = graph([(1, 2), (2, 1), (1, 2), (3, 1)])
    assert pairs(E.reverse_edges(g)) == [(1, 2), (1, 3), (2, 1), (2, 1)]
    assert pairs(E.simple_edges(g)) == [(1, 2), (1, 3)]
    assert pairs(E.symmetric_edges(g)) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_orientation_flips_only_when_sources_reach_further(graph):
    assert pairs(E.widest_side_as_columns(graph([(9, 1)]))) == [(1, 9)]
    assert pairs(E.widest_side_as_columns(graph([(1, 9)]))) == [(1, 9)]


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("out", {2: 4, 3: 3, 4: 1, 5: 1}),
        ("in", {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2}),
        ("total", {1: 2, 2: 5, 3: 5, 4: 2, 5: 2, 6: 2}),
        ("weighted_out", {2: 10, 3: 18, 4: 8, 5: 9}),
        ("weighted_in", {1: 6, 2: 8, 3: 11, 4: 6, 5: 3, 6: 11}),
        ("weighted_total", {1: 6, 2: 18, 3: 29, 4: 14, 5: 12, 6: 11}),
    ],
)
def test_degrees(sample, mode, expected):
    assert as_map(degrees(sample, mode)) == expected


def test_degree_distribution_and_mode_check(sample):
    assert as_map(degree_distribution(degrees(sample, "total")), "degree") == {2: 4, 5: 2}
    with pytest.raises(ValueError):
        degrees(sample, "sideways")


def test_total_degree_sums_to_twice_the_rows(graph):
    g = graph([(1, 2), (2, 1), (1, 2), (3, 7)])
    assert sum(as_map(degrees(g, "total")).values()) == 2 * g.count()


def test_sinks(spark, sample, tmp_path):
    table = degrees(sample, "total")
    path = str(tmp_path / "t")
    sinks.write_tsv(table, path, single_file=True)
    back = spark.read.schema("nodeid bigint, degree bigint").option("sep", "\t").csv(path)
    assert as_map(back) == as_map(table)
    with pytest.raises(Exception):
        sinks.write_tsv(table, path)
    sinks.write_csv(table, path)
    sinks.write_csv(table, path)
    assert as_map(spark.read.schema("nodeid bigint, degree bigint").csv(path)) == as_map(table)
    assert {r.line for r in table.select(sinks.tsv_line("nodeid", "degree").alias("line")).collect()} >= {"1\t2", "2\t5"}
