"""Text edge lists and row caps."""

import pytest

from lattica.sources import edge_list, labelled_edges, parse_cap, weighted_edges


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_edge_list(spark, tmp_path):
    path = write(tmp_path, "e.txt", "# head\n1 2\n\n  3\t4 extra\n5 6\n")
    assert [tuple(r) for r in edge_list(spark, path).collect()] == [(1, 2), (3, 4), (5, 6)]
    assert [tuple(r) for r in edge_list(spark, path, "2").collect()] == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="not a vertex id"):
        edge_list(spark, write(tmp_path, "bad.txt", "1 x\n")).collect()


def test_other_formats(spark, tmp_path):
    path = write(tmp_path, "w.txt", "1 2 {'weight': 0.5}\n2 3 {'weight': 1}\n")
    assert [tuple(r) for r in weighted_edges(spark, path, 1).collect()] == [(1, 2)]
    parts = labelled_edges(spark, write(tmp_path, "l.txt", "1 2 n\n2 3 e\n3 4 e\n9 9 z\n"))
    assert [tuple(r) for r in parts["n"].collect()] == [(1, 2)]
    assert [tuple(r) for r in parts["e"].collect()] == [(2, 3), (3, 4)]


def test_caps():
    assert [parse_cap(x) for x in ("all", "12", "3k", "2M", "1m", None, 5)] == [None, 12, 3000, 2_000_000, 1_000_000, None, 5]
