from parlance.sources import sinks

from test_operators import make_triples  # noqa: I001
from parlance.operators import graph, tagger


def test_graph_round_trip(spark, tmp_path):
    t = make_triples(spark, [(0, "Ann", "PERSON", "heads", "CSE", "DEPARTMENT", "2026-02-01", "m1", "2026-01-05", 1.0, 0.9)])
    nodes, edges = graph.build_nodes(t), graph.build_edges(t)
    path = str(tmp_path / "g")
    assert [df.count() for df in sinks.read_graph(spark, path)] == [0, 0]
    sinks.write_graph(nodes, edges, path)
    n, e = sinks.read_graph(spark, path)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and list(map(tuple, e.collect())) == list(map(tuple, edges.collect()))
    sinks.clear_graph(spark, path)
    assert [df.count() for df in sinks.read_graph(spark, path)] == [0, 0]
    sinks.write_triples(t, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).first().source_meeting == "m1"


def test_cache(spark, tmp_path):
    sinks.append_cache(spark.createDataFrame([("aa1", "x"), ("bb2", None)], "key string, answer string"), str(tmp_path / "c"))
    cache = spark.read.parquet(str(tmp_path / "c"))
    hit, miss = sinks.split_by_cache(spark.createDataFrame([("aa1",), ("bb2",), ("cc3",)], "key string"), cache)
    assert [r.answer for r in hit.collect()] == ["x"] and sorted(r.key for r in miss.collect()) == ["bb2", "cc3"]


def test_tagger(spark):
    d = spark.createDataFrame([("Ann", "PERSON"), ("cse", "ORG")], "word string, type string")
    got = tagger.tag_words(spark.createDataFrame([(1, "ann, of the (CSE)")], "k int, t string"), "k", "t", d).withColumn("type", tagger.map_type("type"))
    assert sorted((r.pos, r.text, r.type) for r in got.collect()) == [(0, "ann", "PERSON"), (3, "CSE", "DEPARTMENT")]
