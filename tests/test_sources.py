from __future__ import annotations

import json

from graphloom.operators import clean, risk, search
from graphloom.sources import parse, store
from graphloom.streaming import changes as ch
from pyspark.sql import functions as F

PY = '"""Doc."""\nimport os\nfrom a.b import c\nclass Base:\n    pass\nclass X(Base):\n    @staticmethod\n    def _f(a, *, b=1) -> int:\n        """Adds."""\n        if a and b:\n            return g(a)\n        return 0\ndef g(x):\n    return x\n'
JAVA = "package p;\nimport java.util.List;\npublic class A extends B implements C, D {\n  private static int f(int x, List<String> y) { if (x > 1) { g(); } return 1; }\n  void g() { /* } */ String s = \"{\"; }\n}\n"


def test_parse(spark):
    files = [("r/x.py", PY), ("r/A.java", JAVA), ("r/bad.py", "def f(:"), ("r/n.py", None), ("r/t.txt", "x"), ("r/e.py", "")]
    rows = parse.parse_texts(spark.createDataFrame(files, "file_path string, content string")).collect()
    e = {(r.file_path, r.name): r for r in rows}
    assert not e["r/bad.py", None].success and e["r/bad.py", None].error_message.startswith("SyntaxError")
    f = e["r/x.py", "_f"]
    assert (f.type, f.line_number, f.complexity, f.visibility, f.is_static, f.parameters, f.return_type, f.docstring, f.parent, f.calls) == ("function", 8, 3, "private", True, ["a", "b"], "int", "Adds.", "X", ["g"])
    assert e["r/x.py", None].imports == ["os", "a.b"] and e["r/x.py", "X"].bases == ["Base"]
    f = e["r/A.java", "f"]
    assert (f.type, f.visibility, f.is_static, f.parameters, f.parent, f.complexity) == ("method", "private", True, ["x", "y"], "A", 2)
    assert e["r/A.java", "A"].bases == ["B", "C", "D"]
    parsed = parse.element_rows(parse.parse_texts(spark.createDataFrame(files, "file_path string, content string")))
    assert parse.inheritance(parsed).count() == 1 and parse.call_edges(parsed).count() == 2 and parse.defines(parsed).count() == 3


def test_project_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "g.py").write_bytes("x = '中文'".encode("gbk"))
    (tmp_path / "node_modules" / "b.js").write_text("x")
    got = {r.file_path.rsplit("/", 1)[1]: r.content for r in parse.project_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1", "g.py": "x = '中文'"}


def test_store(spark, tmp_path):
    doc = {"nodes": [{"id": "1", "label": "a", "type": "class", "properties": {"k": "v"}}, {"id": "1", "label": "b", "type": "class", "properties": {}}], "edges": [{"id": "e", "source_id": "1", "target_id": "1", "type": "calls", "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    n, e = store.read_graph_json(spark, str(tmp_path / "g.json"), "g1")
    assert [(r.id, r.label) for r in n.collect()] == [("1", "b")] and e.count() == 1
    out = str(tmp_path / "s")
    store.write_graph(n, e, out)
    store.write_graph(n.withColumn("graph_id", F.lit("g2")), e.withColumn("graph_id", F.lit("g2")), out)
    assert store.list_graphs(*store.read_graph(spark, out)).count() == 2
    store.delete_graph(spark, out, "g1")
    assert store.read_graph(spark, out)[0].select("graph_id").distinct().collect() == [("g2",)]


def test_stream(spark, tmp_path):
    rows = [("a.py", "CREATED", "2025-01-01 00:00:00"), ("a.py", "created", "2025-01-01 00:00:00"), ("b.exe", "created", "2025-01-01 00:00:00"), (None, "created", None)]
    df = spark.createDataFrame(rows, "path string, change_type string, t string").select("path", "change_type", F.to_timestamp("t").alias("ts"), F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("timestamp").alias("received_at"))
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = ch.run_updates(ch.stream(spark, str(tmp_path / "in"), df.schema), lambda b, i: seen.extend(r.path for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["a.py"]


def test_windows_on_a_stream(spark, tmp_path):
    ev = spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS ts, 'click' AS event_type, 1.5D AS value UNION ALL SELECT timestamp'2025-01-01 00:50:00', 'click', 2D")
    ev.write.parquet(str(tmp_path / "e"))
    w = ch.windowed_counts(ch.stream(spark, str(tmp_path / "e"), ev.schema), "1 hour", late="10 minutes")
    q = w.writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n, r.total) for r in spark.table("w1").collect()] == [(2, 3.5)]


def test_nulls_and_copies(spark):
    from datetime import datetime

    schema = "graph_id string, id string, label string, type string, element_id string, name string, file_path string, line_number int, complexity int, visibility string, docstring string, created_at timestamp"
    t = datetime(2025, 1, 1)
    rows = [("g", " N1", "a", "class", None, None, None, None, None, None, None, None), ("g", "n1\t", "b", "class", None, None, None, None, None, None, None, t), (None, "x", *[None] * 10), ("g", " ", *[None] * 10)]
    assert [(r.id, r.label) for r in clean.latest_nodes(spark.createDataFrame(rows, schema)).collect()] == [("n1", "b")]


def test_security_rules(spark):
    rows = [("e1", 10, None, 'x = 1\npassword = "abcd"\n'), ("e2", 1, "eval(x + 1)", "MD5("), ("e3", None, "", "md5(a) ../b"), ("e4", 1, None, None)]
    got = {(r.id, r.rule, r.line_number) for r in risk.security_scan(spark.createDataFrame(rows, "id string, line_number int, docstring string, code string")).collect()}
    assert got == {("e1", "hardcoded_password", 11), ("e2", "command_injection", 1), ("e3", "weak_crypto", 0), ("e3", "path_traversal", 0)}


def test_question_types(spark):
    df = spark.createDataFrame([("Who calls foo?",), ("Where is it?",), ("Hello",), (None,), ("类A继承什么",)], "t string")
    assert [r[0] for r in df.select(search.question_type(df.t)).collect()] == ["function_call", "location", "general", None, "inheritance"]
    assert df.limit(1).select(search.keywords(df.t)).first()[0] == ["calls", "foo"]
