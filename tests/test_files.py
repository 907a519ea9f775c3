import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkann.sources import binary, indexes, logs
from tests.test_knn import table


@pytest.mark.parametrize("kind", sorted(binary.LAYOUTS))
def test_round_trip_of_bytes(kind):
    layout = binary.LAYOUTS[kind]
    m = np.array([[1, 2, 100], [3, 0, 127]], layout.element)
    assert (binary.decode(binary.encode(m, layout), layout, 3) == m).all()


@given(st.integers(0, 5), st.integers(1, 9))
@settings(max_examples=30, deadline=None)
def test_bytes_above_127_stay_positive(n, d):
    m = (np.arange(n * d) % 256).reshape(n, d).astype("u1")
    if n:
        assert (binary.decode(binary.encode(m, binary.LAYOUTS["bvecs"]), binary.LAYOUTS["bvecs"]) == m).all()


def test_wrong_lengths_are_refused():
    with pytest.raises(ValueError):
        binary.decode(b"\x02\0\0\0\0\0\0\0", binary.LAYOUTS["fvecs"])
    with pytest.raises(ValueError):
        binary.decode(struct.pack("<ii", 2, 2) + b"\0", binary.LAYOUTS["fbin"])
    with pytest.raises(ValueError):
        binary.decode(b"\0" * 8, binary.LAYOUTS["raw"])


@pytest.mark.parametrize("kind", ["fvecs", "fbin", "i8bin", "bvecs"])
def test_files_through_spark(spark, tmp_path, kind):
    m = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    at = str(tmp_path / f"x.{kind}")
    binary.export_file(table(spark, m), at, kind)
    rows = binary.read_vectors(spark, at, kind, limit=2).orderBy("node_id").collect()
    assert [(r.node_id, list(r.embedding)) for r in rows] == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    binary.write_vectors(table(spark, m), str(tmp_path / "parts"), kind, part_rows=2)
    back = binary.read_parts(spark, str(tmp_path / "parts"), kind).orderBy("part", "node_id").collect()
    assert [list(r.embedding) for r in back] == m.tolist()


def test_ground_truth(spark, tmp_path):
    at = tmp_path / "gt.ivecs"
    at.write_bytes(binary.encode(np.array([[5, 6, 7], [8, 9, 1]]), binary.LAYOUTS["ivecs"]))
    gt = binary.ground_truth(binary.read_vectors(spark, str(at), "ivecs"), cut=2).orderBy("qid", "rank").collect()
    assert [(r.qid, r["rank"], r.node_id) for r in gt] == [(0, 1, 5), (0, 2, 6), (1, 1, 8), (1, 2, 9)]


def test_catalogue():
    assert binary.dataset("SIFT10M")[1] == 10_000_000 and binary.dataset("GLOVE")[0].dim == 300
    with pytest.raises(ValueError):
        binary.dataset("other")


def test_nsg_and_knn_graph_files(spark, tmp_path):
    adjacency = [[1, 2], [0], [], [2, 1, 0]]
    at = tmp_path / "g.nsg"
    at.write_bytes(indexes.nsg_bytes(adjacency, 3, 4))
    edges, entry, width = indexes.read_nsg(spark, str(at))
    assert (entry, width) == (3, 4)
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 1, 0), (0, 2, 1), (1, 0, 0), (3, 0, 2), (3, 1, 1), (3, 2, 0)]
    full = edges.where("src <> 2").unionByName(spark.createDataFrame([(2, 0, 0)], edges.schema))
    indexes.write_knn_graph(full, str(tmp_path / "k.graph"))
    assert indexes.read_knn_graph(spark, str(tmp_path / "k.graph")).count() == 7


def test_hnsw_file(spark, tmp_path):
    dim, m, m0, n = 3, 2, 4, 3
    size = 4 + 4 * m0 + 4 * dim + 8
    head = struct.pack(indexes.HEADER, 0, n, n, size, 4 + 4 * m0 + 4 * dim, 4 + 4 * m0, 1, 2, m, m0, m, 0.5, 100)
    links = [[1, 2], [0], [1]]
    body = b"".join(struct.pack("<I", len(a)) + np.array(a + [0] * (m0 - len(a)), "<u4").tobytes() + np.full(dim, i, "<f4").tobytes() + struct.pack("<q", i + 70) for i, a in enumerate(links))
    upper = struct.pack("<I", 0) * 2 + struct.pack("<I", 4 + 4 * m) + struct.pack("<III", 1, 0, 0)
    (tmp_path / "h.bin").write_bytes(head + body + upper)
    got = indexes.read_hnsw(spark, str(tmp_path / "h.bin"), dim)
    assert len(head) == 96 and got["meta"]["entry"] == 2
    assert sorted(tuple(r) for r in got["edges"].collect()) == [(0, 1, 0), (0, 2, 1), (1, 0, 0), (2, 1, 0)]
    assert [tuple(r) for r in got["edges_upper"].select("level", "src", "dst").collect()] == [(1, 2, 0)]
    assert [r.label for r in got["labels"].orderBy("node_id").collect()] == [70, 71, 72]


def test_sharded_layout(spark, tmp_path):
    v = table(spark, np.eye(5))
    e = spark.createDataFrame([(i, (i + 1) % 5, 0) for i in range(5)], "src long, dst long, pos int")
    indexes.write_sharded(v, e, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s/edges")).where("shard = 1").count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\nkernel time: 12.5 ms\nother 3\nmodel: small batch size: 4 latency: 0.5\nmodel: small batch size: 8 latency: 0.75\n")
    lines = logs.read_lines(spark, str(tmp_path / "a.log"))
    assert [(r.line_no, r.x) for r in logs.scrape(lines, "kernel time").collect()] == [(1, 12.5)]
    assert '"8' in logs.latency_json(lines).first().json
    assert logs.config({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    new = spark.createDataFrame([(1, 2)], "k int, v int")
    assert logs.upsert(None, new, ["k"]).count() == 1
