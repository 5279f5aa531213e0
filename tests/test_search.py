"""Index upkeep, graph search, records, text functions, embedding and prompts on small hard cases."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import answers, context, embed, graph, graph_search, lexical, records, vector


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, c, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"])
    return df.select(c).first()[0]


CHUNK = "chunk_id string, name string, content string, rank string, token string"


def index(spark, data, scope="v1"):
    df = spark.createDataFrame([(i, n, c, "clash", "clash") for i, n, c in data], CHUNK)
    return lexical.index_rows(df, "chunk_id", {"name": F.col("name"), "content": F.col("content")}, (), F.lit(scope))


def test_index_upkeep(spark):
    old = index(spark, [("a", "loadTable", "reads rows"), ("b", None, "rows rows"), ("c", "", "")])
    new = index(spark, [("b", "writeTable", "writes"), ("d", "x", "reads")])
    both = lexical.upsert(old, new)
    assert {r.chunk_id: r.length for r in both.collect()} == {"a": 30 + 2, "b": 30 + 1, "c": 0, "d": 11}
    assert rows(lexical.upsert(both, new).select("chunk_id", "length")) == rows(both.select("chunk_id", "length"))
    gone = spark.createDataFrame([("a",)], "chunk_id string")
    assert rows(lexical.remove(both, gone).select("chunk_id")) == [("b",), ("c",), ("d",)]
    two = lexical.clone(both, "v1", "v2")
    assert two.count() == 8 and lexical.clone(two, "v1", "v2").count() == 8
    assert lexical.remove(two, gone, "v2").count() == 7 and lexical.clear(two, "v2").count() == 4 and lexical.clear(two).count() == 0
    asked = spark.createDataFrame([("q", "v2", "table"), ("p", "v1", "table"), ("n", "v1", None), ("z", "v9", "table")], "query_id string, scope string, text string")
    got = rows(lexical.search(lexical.LexicalIndex(lexical.remove(two, gone, "v2")), asked))
    assert [r[:2] for r in got] == [("p", "a"), ("p", "b"), ("q", "b")]
    for most in (200_000, 0):
        assert [r[:2] for r in rows(lexical.search(lexical.LexicalIndex(two), asked, broadcast_terms=most))] == [("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")]
    assert lexical.search(lexical.LexicalIndex(index(spark, [])), asked).count() == 0
    with pytest.raises(ValueError):
        lexical.search(lexical.LexicalIndex(old), asked, 0)


def test_neighbours_in_blocks(spark):
    v = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(12)] + [("none", None)], "chunk_id string, vector array<double>")
    q = v.where("chunk_id < 'v3' or chunk_id = 'none'").withColumnRenamed("chunk_id", "query_id")
    want = rows(vector.knn(v, q, 3))
    assert len(want) == 15 and rows(vector.knn(v, q, 3, 2)) == want and {r[0]: r[1] for r in want if r[3] == 1}["v1"] == "v1"


NODE = "node_id string, kind string, name string, qualified_name string, file_id string, repository_id string"
EDGE = "edge_id string, source_id string, target_id string, kind string"


def small_graph(spark):
    n = [("s", "class", "Service", "app.Service", "f1"), ("r", "class", "Repo", "app.db.Repo", "f2"), ("c", "class", "Controller", "app.Controller", "f1"), ("m", "method", "save", "app.db.Repo.save", "f2"), ("x", None, None, None, None)]
    e = [("e1", "c", "s", "calls"), ("e2", "s", "r", "calls"), ("e3", "s", "r", "uses"), ("e4", "r", "m", "declares"), ("e5", "s", "s", "calls"), ("e6", "m", "c", "calls")]
    return spark.createDataFrame([(*r, "p") for r in n], NODE), spark.createDataFrame(e, EDGE)


def test_graph_search(spark):
    nodes, edges = small_graph(spark)
    asked = spark.createDataFrame(
        [("q1", "Service", "calls", "inbound"), ("q2", "app.db.Repo", "IMPACT", "inbound"), ("q3", "Repo", "IDENTIFIER", "both"), ("q4", "Service", "DEPENDENCY", "outbound"), ("q5", "db.Repo.save", "calls", "outbound"),
         ("q6", "nobody", "calls", "inbound"), ("q7", None, "calls", "inbound"), ("q8", "Service", None, "none")], "query_id string, target string, relation string, direction string",
    )
    got = {}
    for r in graph_search.graph_search(asked, nodes, edges).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.node_id, r.score, r.depth, r.relation))
    assert {k: sorted(v) for k, v in got.items()} == {
        "q1": [(1, "c", 0.9, 1, "CALLS"), (2, "s", 0.9, 1, "CALLS")],
        "q2": [(1, "s", 0.9, 1, "IMPACT"), (2, "c", 0.8, 2, "IMPACT"), (3, "m", 0.7, 3, "IMPACT")],
        "q3": [(1, "r", 1.0, 0, "EXACT_TARGET"), (2, "s", 0.8, 1, "NEIGHBOR"), (3, "m", 0.8, 1, "NEIGHBOR")],
        "q4": [(1, "r", 0.9, 1, "DEPENDENCY"), (2, "s", 0.9, 1, "DEPENDENCY")],
        "q5": [(1, "c", 0.9, 1, "CALLS")],
    }
    assert graph_search.graph_search(asked, nodes, edges, where=F.col("kind") == "method").select("node_id").distinct().collect()[0][0] == "m"
    assert graph_search.graph_search(asked.where("false"), nodes, edges).count() == 0


def test_anchors_and_expansion(spark):
    nodes, edges = small_graph(spark)
    results = spark.createDataFrame([("q", "k1", "s", None, None), ("q", "R", None, None, "zz"), ("q", "k3", None, " APP.controller ", None), ("q", "k4", None, None, "controller"), ("q", "k5", "none", None, None)], "query_id string, chunk_id string, symbol_id string, qualified_name string, symbol_name string")
    a = graph_search.anchors(results, nodes)
    assert rows(a) == [("q", "c", "k3"), ("q", "r", "R"), ("q", "s", "k1")]
    starts = spark.createDataFrame([("q", "c", "k3", "CALLEES", "SYMBOL"), ("n", "c", "k3", "NONE", "SYMBOL"), ("f", "c", None, "callees", "FILE"), ("i", "m", None, "IMPACT", None)], "query_id string, node_id string, chunk_id string, strategy string, scope string")
    found, summary = graph_search.expand(starts, nodes, edges)
    assert [(r.query_id, r.node_id, r.depth, r.relation, r.path, r.source) for r in found.orderBy("query_id", "place").collect()] == [
        ("f", "s", 1, "CALLS", ["c", "s"], "GRAPH_EXPANSION"), ("f", "r", 2, "CALLS", ["c", "s", "r"], "GRAPH_EXPANSION"),
        ("q", "s", 1, "CALLS", ["c", "s"], "GRAPH_EXPANSION"), ("q", "r", 2, "CALLS", ["c", "s", "r"], "GRAPH_EXPANSION"),
    ]
    assert rows(summary) == [("f", 1, 2, 2, False), ("i", 1, 0, 0, False), ("n", 1, 0, 0, False), ("q", 1, 2, 2, False)]
    found, summary = graph_search.expand(starts, nodes, edges, 2, 1, 1, same_file=False)
    assert {(r.query_id, r.node_id) for r in found.collect()} == {("f", "s"), ("q", "s")} and {r.query_id: r.truncated for r in summary.collect()}["q"]
    found, summary = graph_search.expand(starts, nodes, edges, 0)
    assert found.count() == 0 and summary.count() == 4
    with pytest.raises(ValueError):
        graph_search.expand(starts, nodes, edges, 2, 0)


def test_graph_parts(spark):
    nodes, edges = small_graph(spark)
    assert {r.edge_id: r.kind for r in graph.classified(edges, nodes).collect()} == {"e1": "uses", "e2": "uses", "e3": "uses", "e4": "declares", "e5": "uses", "e6": "uses"}
    typed = spark.createDataFrame([("m", "p", "Map<string, app.db.Repo[]> | Service"), ("r", "p", "Repo"), ("c", "q", "Repo"), ("s", "p", None)], "source_id string, repository_id string, type_text string")
    assert [(r.source_id, r.target_id, r.confidence) for r in graph.type_edges(typed, nodes).orderBy("target_id").collect()] == [("m", "r", 0.9), ("m", "s", 0.9)]
    assert graph.require_nodes(nodes, nodes.where("node_id = 's'")).count() == 1
    with pytest.raises(KeyError, match="lost"):
        graph.require_nodes(nodes, spark.createDataFrame([("lost",)], "node_id string"))
    asked = spark.createDataFrame([("1", "REPO"), ("2", "p."), ("3", " "), ("4", None), ("5", "zz")], "query_id string, text string")
    assert rows(graph.symbol_search(nodes, asked).select("query_id", "node_id")) == [("1", "m"), ("1", "r"), ("2", "c"), ("2", "m"), ("2", "r"), ("2", "s")]
    p = graph.ordered_paths(graph.simple_paths(edges, nodes.where("node_id = 'r'"), "in", None, 2))
    assert [(r.place, r.node_id) for r in p.orderBy("place").collect()] == [(1, "s"), (2, "c")]


def test_records(spark):
    nodes, edges = small_graph(spark)
    assert rows(records.file_symbols(nodes))[0] == ("f1", ["app.Controller", "app.Service"])
    assert [r.node_id for r in records.in_order(nodes, ["repository_id"]).orderBy("place").collect()] == ["x", "c", "s", "r", "m"]
    df = spark.createDataFrame([("a", 2, {"x": "1", "y": "2"}), ("a", 1, {"x": "0"}), ("b", 1, None)], "k string, n int, m map<string,string>")
    assert {r.k: r.m for r in records.merged_maps(df, ["k"], F.col("n"), "m").collect()} == {"a": {"x": "0", "y": "2"}, "b": {}}
    assert rows(records.first_rows(df, ["k"], ["n"]).select("k", "n")) == [("a", 1), ("b", 1)]
    assert rows(records.counters(df, F.col("n") > 1)) == [(3, 1, 2)]
    assert records.require_one(df.where("k = 'a'"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="k"):
        records.require_one(df, ["k", "n"])
    with pytest.raises(ValueError, match="a"):
        records.require_unique(df, "k")
    n, e = records.graph_from_json(records.graph_to_json(nodes, edges), NODE, EDGE)
    assert rows(n) == rows(nodes) and rows(e) == rows(edges)
    assert records.index_record(df, {"k": "key", "gone": "none"}).columns == ["key", "none"]
    chunks = spark.createDataFrame([("k2", "s", "a.py", "S", None), ("k1", "s", "b.py", None, "q")], "chunk_id string, entity_id string, file_path string, symbol_name string, qualified_name string")
    got = {r.node_id: tuple(r)[1:] for r in records.chunk_of(nodes, chunks).collect()}
    assert got["s"] == ("k1", "b.py", "Service", "q", True) and got["r"] == ("r", "f2", "Repo", "app.db.Repo", False) and got["x"][1] == "unknown/file"


def test_text_functions(spark):
    assert one(spark, t.type_names(F.lit("Map<String, List<a.B[]>> | null"))) == ["Map", "String", "List", "a.B"]
    assert one(spark, t.split_type_args(F.lit("a, Map<b, c>,(d, e) => f ,, g"))) == ["a", "Map<b, c>", "(d, e) => f", "g"]
    assert [one(spark, t.relative_module(F.lit(a), F.lit(b))) for a, b in (("a/x.ts", "./b"), ("a/x.ts", "../c.ts"), ("x.ts", "./d/./e"), ("a/x.ts", "react"), ("a/x.ts", "../../../z"))] == ["a/b", "c", "d/e", None, "z"]
    assert [one(spark, t.is_external(F.lit(m), F.lit(x))) for m, x in (("os.path", "python"), ("app.os", "python"), ("java.util.List", "Java"), ("javafx.a", "java"), ("react", "typescript"), ("./a", "typescript"), ("x", "cobol"))] == [True, False, True, False, True, False, False]
    text = F.lit("ab\r\ncdef\nghi")
    assert one(spark, t.body_slice(text, F.lit(1), F.lit(1), F.lit(3), F.lit(2))) == "b\ncdef\ngh" and one(spark, t.body_slice(text, F.lit(2), F.lit(1), F.lit(2), F.lit(3))) == "de"
    assert one(spark, t.body_slice(text, F.lit(9), F.lit(0), F.lit(9), F.lit(3))) == "" and one(spark, t.body_slice(text, F.lit(None).cast("int"), F.lit(0), F.lit(9), F.lit(3))) == ""
    assert [one(spark, t.fused_relevance(F.lit(x))) for x in (0.01, 0.5, -1.0, float("nan"))] == [0.3, 1.0, 0.0, 0.0]
    assert one(spark, t.text_tokens(t.code_tokens(F.lit("where is the loadTable of rows")), t.identifiers(F.lit("where is the loadTable of rows")))) == ["where", "rows"]
    assert one(spark, t.nfc(F.lit("é"))) == "é"
    assert one(spark, t.embedding_text({"language": F.lit("python"), "doc": F.lit(" a 0\r\n\n  b 1 ")}, F.lit("  x = 1 "))) == "[Language: python]\n[Doc: a 0 b 1]\n\nx = 1"
    assert one(spark, t.claims(F.lit("0 One 0. Two 1\nThree"))) == ["0 One 0.", "Two 1", "Three"]
    v = one(spark, t.hash_embedding(F.lit("x")))
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_embedding(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", "bad" if i == 25 else "slow" if i == 5 else None if i == 1 else f"t{i}") for i in range(40)], "chunk_id string, text string").coalesce(1).orderBy("chunk_id")

    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        if "slow" in texts:
            raise embed.Retryable("busy")
        return [[float(len(x)), 1.0] for x in texts]

    got = embed.embed(chunks.repartition(1).sortWithinPartitions("chunk_id"), provider, 2, 10, 2, 0.0).collect()
    by = {r.chunk_id: r for r in got}
    assert len(by) == 40 and sum(r.error is None for r in got) in range(10, 31)
    assert by["c05"].error == "busy" and by["c05"].attempts == 3 and by["c25"].error == "RuntimeError: no" and by["c25"].attempts == 1
    assert all(r.vector is None for r in got if r.error) and all(len(r.vector) == 2 for r in got if not r.error)
    assert {r.error for r in embed.embed(chunks, lambda x: [[1.0]] * len(x), 2).collect()} == {"vectors of another dimension"}
    with pytest.raises(ValueError):
        embed.embed(chunks, provider, 2, 0)


def test_http_provider():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            self.send_response(429 if body["input"] == ["busy"] else 400 if body["input"] == ["bad"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = embed.http_provider(f"http://127.0.0.1:{server.server_port}/v1", "m", "k", 5)
    assert p(["a", "b"]) == [[1.0], [2.0]] and calls[0] == {"model": "m", "input": ["a", "b"]}
    with pytest.raises(embed.Retryable):
        p(["busy"])
    with pytest.raises(Exception) as e:
        p(["bad"])
    assert not isinstance(e.value, embed.Retryable)
    server.shutdown()


def test_prompts(spark):
    q = spark.createDataFrame([("1", " Who calls x? ", "DEPENDENCY"), ("2", "What?", None), ("3", " ", None)], "query_id string, text string, intent string")
    c = spark.createDataFrame([("1", 2, "b", "[CTX:b]\nB"), ("1", 1, "a", "[CTX:a]\nA")], "query_id string, rank int, candidate_id string, text string")
    got = {r.query_id: r for r in answers.prompts(q, c).withColumn("answer", answers.quoted_answer(F.col("message"))).collect()}
    assert set(got) == {"1", "2"} and got["1"].n_items == 2 and got["1"].message.index("[CTX:a]") < got["1"].message.index("[CTX:b]") and "dependency" in got["1"].system
    assert got["1"].answer == "See the evidence [CTX:a].\nSee the evidence [CTX:b]." and "no evidence" in got["2"].message and "[CTX" not in got["2"].answer
    assert answers.violations(3, 0, 1, 1) == ["temperature", "max_tokens"] and answers.violations(0, 1, 1, 1) == []


def test_context_packer(spark):
    c = [("q", "a", 1, 5, [10, 10], 60, "TRUNCATE"), ("q", "b", 2, 5, [8, 100, 1], 60, "TRUNCATE"), ("q", "c", 3, 5, [3], 60, "TRUNCATE"), ("q", "d", 4, None, None, 60, "TRUNCATE"), ("p", "a", 1, 5, [100], 60, "SKIP"), ("p", "b", 2, 5, [55], 60, "SKIP"),
         ("p", "c", 3, 1, [1], 60, "SKIP"), ("p", "d", 4, 1, [1, 40], 60, "SKIP"), ("n", "a", 1, 1, [5], None, None), ("t", "a", 1, 5, [90], 50, "TRUNCATE")]
    df = spark.createDataFrame(c, "query_id string, candidate_id string, rank int, header_tokens int, line_tokens array<int>, budget int, policy string")
    got = {(r.query_id, r.candidate_id): (r.decision, r.tokens, r.kept_lines, r.used) for r in context.pack_context(df).collect()}
    assert got == {
        ("q", "a"): ("INCLUDED", 25, 2, 25), ("q", "b"): ("TRUNCATED", 13, 1, 38), ("q", "c"): ("INCLUDED", 8, 1, 46), ("q", "d"): ("INCLUDED", 0, 0, 46), ("p", "a"): ("CANDIDATE_TOO_LARGE", 0, 0, 0), ("p", "b"): ("INCLUDED", 60, 1, 60),
        ("p", "c"): ("BUDGET_EXHAUSTED", 0, 0, 60), ("p", "d"): ("BUDGET_EXHAUSTED", 0, 0, 60), ("n", "a"): ("BUDGET_EXHAUSTED", 0, 0, 0), ("t", "a"): ("TRUNCATED", 5, 0, 5),
    }
    least = {(r.query_id, r.candidate_id): r.decision for r in context.pack_context(df, 10, 50).collect()}
    assert least["q", "c"] == "BELOW_MINIMUM" and least["p", "b"] == "CANDIDATE_TOO_LARGE"
    stats = {r.query_id: tuple(r)[1:] for r in context.packing_stats(context.pack_context(df), df.groupBy("query_id").agg(F.max("budget").alias("budget"))).collect()}
    assert stats["q"] == (4, 4, 1, 0, 46, 14, round(46 / 60, 6)) and stats["n"] == (1, 0, 0, 1, 0, 0, 0.0)
