"""Scans, sinks and execution on small files and tables; each rejection rule once."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexaria.operators import evaluation, statistics
from lexaria.plans import execution
from lexaria.sources import lines, sinks


def of(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line long, value string")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * 50 for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("one\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = lines.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in got] == text and [r.line for r in got] == list(range(2000))
    assert [r.value for r in lines.read_lines(spark, str(tmp_path / "b.gz")).orderBy("line").collect()] == ["one", "two"]


def test_complex_words(spark):
    ok = "\t".join(["7", 'a "q', "0", "1", "a", "5", "5", "1", "0", "1.0", "0.25"])
    rows = lines.complex_words(of(spark, ok, "too\tfew", "", ok + "\textra")).collect()
    assert len(rows) == 2 and (
        rows[0].id, rows[0].sentence, rows[0].start, rows[0].end, rows[0].target, rows[0].binary, rows[0].probability
    ) == ("7", 'a "q', 0, 1, "a", 1, 0.25)


def test_ranked_substitutes(spark):
    t = of(spark, " s \t cat \tdog\t dog\tpet\t \tcat\tape", "a\tb")
    assert [tuple(x) for x in lines.ranked_substitutes(t).first().ranked] == [("dog", 2), ("ape", 1), ("pet", 1)]
    assert [
        tuple(x) for x in lines.ranked_substitutes(t, True).first().ranked
    ] == [("dog", 2), ("ape", 1), ("cat", 1), ("pet", 1)] and lines.ranked_substitutes(t).count() == 1


def test_word_scans(spark):
    assert lines.word_complexities(of(spark, "1\ten\ts\tw\t0.5", "1\ten\ts")).collect()[0].complexity == 0.5
    head, row = "id\tcorpus\tsentence\ttoken\tcomplexity", "1\tc\ts\tw\t0.5"
    assert lines.single_words(of(spark, head, row), 1).first().token == "w"
    with pytest.raises(ValueError):
        lines.single_words(of(spark, head, row), 2)
    with pytest.raises(Exception, match="not five fields"):
        lines.single_words(of(spark, head, "a\tb")).collect()


def test_aligned_and_parallel(spark):
    a = lines.aligned(of(spark, "a ", "b"), [of(spark, "x", "y"), of(spark, "z")]).orderBy("line").collect()
    assert [(r.original, r.references) for r in a] == [("a", ["x", "z"]), ("b", ["y"])]
    assert lines.parallel(of(spark, "a"), of(spark, "b")).first().right == "b"
    with pytest.raises(ValueError):
        lines.parallel(of(spark, "a"), of(spark, "b", "c"))


def test_lexicon(spark):
    t = of(spark, "word\ttype\tvalue", "Cat\tt\t50", "cat\tt\t75", "dog\tt\tbad", "x\ty")
    assert [tuple(r) for r in lines.lexicon(t, "concreteness").collect()] == [("cat", 4.0)]
    assert [tuple(r) for r in lines.lexicon(of(spark, "cat\t3.5", "a\tb\tc"), "age").collect()] == [("cat", 8.5)]
    with pytest.raises(ValueError):
        lines.lexicon(t, "other")


def test_rules_and_splits(spark):
    rows = lines.paraphrase_rules(of(spark, "A B\tC\t1.5\t4", "x\ty\t-2", "x\ty\tz", "x\ty", "x\ty\t1\tq")).collect()
    assert [tuple(r) for r in rows] == [("a b", "c", 1.5, 4.0), ("y", "x", 2.0, None)]
    rows = lines.sentence_splits(of(spark, "s\ta <::::> b", "skip\tx<::::>y", "s\tno", "q\tr<::::>t<::::>u", "z\tc <::::> d"), 2).orderBy("line").collect()
    assert [(r.source, r.first, r.second) for r in rows] == [("s", "a", "b"), ("z", "c", "d")] and lines.sentence_splits(
        of(spark, "s\ta<::::>b", "t\ta<::::>b"), 1, 1
    ).count() == 1


def test_labels_and_difficulty(spark):
    assert lines.labelled_pairs(spark.createDataFrame([(1,)], "label int")).count() == 1
    with pytest.raises(Exception, match="label 2"):
        lines.labelled_pairs(spark.createDataFrame([(2,)], "label int")).collect()
    d = lines.sentence_difficulty(of(spark, "a\tb\t1\t2", "bad\tx\t2", "Same  Text\t1\t1"))
    assert sorted((r.text, r.difficulty) for r in d.collect()) == [("Same  Text", 1.0), ("a\tb", 1.5)]
    other = spark.createDataFrame([("same text", 0.0)], "text string, difficulty double")
    assert [r.text for r in lines.sentence_difficulty(of(spark, "x\t1\t1", "Same  Text\t1\t1"), other).collect()] == ["x"]


def test_ranked_words(spark):
    rows = lines.ranked_words(of(spark, "s\tt\t3\t1:a\t2:b c\tbad")).collect()
    assert [(r["rank"], r.word) for r in rows] == [(1, "a"), (2, "b c")] and len({r.half for r in rows}) == 1


def test_nested_items(spark):
    j = {
        "contexts": {"c": {"context": "a big cat"}},
        "targets": {"t": {"context_id": "c", "offset": 2, "target": "big"}, "u": {"context_id": "c", "offset": 0, "target": "cat"}},
        "substitutes": {
            "1": {"target_id": "t", "substitute": "large"}, "2": {"target_id": "t", "substitute": "very big"},
            "3": {"target_id": "u", "substitute": "pet"}
        },
        "substitute_labels": {"1": ["TRUE", "FALSE"], "2": ["TRUE"], "3": ["TRUE"]}
    }
    rows = lines.substitution_items(spark.createDataFrame([(json.dumps(j),)], "value string")).collect()
    assert [(r.target, r.substitute, r.share) for r in rows] == [("big", "large", 0.5)]


def test_text_formats(spark):
    t = "k1\nv1\n*******\nk2\nv2\n*******\nk1\nv3\n*******\none line\n"
    df = spark.createDataFrame([(t, "A b => x | Y ; c => d ; none; a B => z", "p one\nmore\n\n \np two")], "b string, g string, p string")
    r = df.select(lines.blocks(F.col("b")).alias("b"), lines.expected_phrases(F.col("g")).alias("g"), lines.paragraphs(F.col("p"), "text").alias("p")).first()
    assert [tuple(x) for x in r.b] == [("k1", "v1"), ("k2", "v2")] and r.g == {"a b": ["x", "y", "z"], "c": ["d"]} and r.p == ["p one more", "p two"]
    rfc = "RFC 9999   Title   May 2020\n\nfront\n\n1. Introduction\n\nBody text.\nAuthor  [Page 2]\n\nMore."
    assert spark.createDataFrame([(rfc,)], "t string").select(
        lines.paragraphs(F.col("t"), "rfc").alias("p")
    ).first().p == ["1. Introduction", "Body text.", "More."]
    assert [r.sentence for r in lines.sentences_of(spark.createDataFrame([("One. Two.",)], "s string"), "s").collect()] == ["One.", "Two."]


def test_folders_and_panels(spark, tmp_path):
    for config in "ab":
        (tmp_path / config).mkdir()
        (tmp_path / config / "7.json").write_text(json.dumps({"output": config * 2}))
    assert sorted(tuple(r) for r in lines.cells(spark, str(tmp_path), "output string").collect()) == [("a", "7", "aa"), ("b", "7", "bb")]
    rows = spark.createDataFrame([("1", "x"), ("ose-2", "y"), ("3", "z")], "id string, text string")
    none = spark.createDataFrame([], "id string, sha256 string")
    assert lines.panel(rows, none).count() == 3
    lock = spark.createDataFrame([("1", None), ("2", None)], "id string, sha256 string").unionByName(
        spark.range(1).select(F.lit(None).cast("string").alias("id"), F.sha2(F.lit("z"), 256).alias("sha256"))
    )
    assert sorted(r.id for r in lines.locked_rows(rows, lock).collect()) == ["1", "3", "ose-2"]
    with pytest.raises(ValueError, match="locked"):
        lines.panel(rows, lock)
    with pytest.raises(ValueError, match="repeat"):
        lines.panel(rows.unionByName(rows), none)
    forms = lines.inflections(of(spark, "Ran\trun\tVBD", "x\ty"), spark.createDataFrame([("ran", "go", "X")], "form string, lemma string, tag string"))
    assert [tuple(r) for r in forms.collect()] == [("ran", "go", "X")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "o" / "x.json")
    sinks.write_json(path, {"b": 1, "a": "é"})
    sinks.write_json(path, {"c": 2})
    assert json.loads(open(path).read()) == {"c": 2} and len(list((tmp_path / "o").iterdir())) == 1
    df = spark.createDataFrame([(1, "a|b", 0.5), (None, None, None)], "n int, s string, x double")
    sinks.append_jsonl(df, str(tmp_path / "j"))
    sinks.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"))
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "c"))
    assert sinks.markdown(df) == "| n | s | x |\n|---:|---|---:|\n| 1 | a\\|b | 0.5000 |\n| – | – | – |\n"
    with pytest.raises(ValueError):
        sinks.markdown(df, 1)
    assert sinks.blob_sha1(b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    (tmp_path / "f").write_bytes(b"abc")
    assert sinks.verified(
        str(tmp_path / "f"), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    ) and sinks.verified(str(tmp_path / "f"), sinks.blob_sha1(b"abc"))
    for wrong in (dict(expected="0" * 64), dict(expected="0" * 40), dict(expected="0" * 64, most=1)):
        with pytest.raises(ValueError):
            sinks.verified(str(tmp_path / "f"), **wrong)


def test_experiment(spark, tmp_path):
    folder, identity = f"file://{tmp_path}/state", {"code": execution.signature([1, "a"])}
    plan = spark.createDataFrame([(c, i) for c in ("a", "b") for i in range(5)], "config string, id long")
    execution.freeze(plan, folder, identity)
    with pytest.raises(FileExistsError):
        execution.freeze(plan, folder, identity)
    with pytest.raises(ValueError):
        execution.freeze(plan.unionByName(plan), f"{folder}2", identity)
    schema = "config string, id long, value long"
    work = lambda todo: todo.withColumn("value", F.col("id") * 2)
    assert execution.run_cells(spark, folder, work, schema, identity, 3, deadline=0) == 10
    assert execution.run_cells(spark, folder, work, schema, identity, 3) == 0
    done = execution.done(spark, folder, schema)
    assert done.count() == 10 and execution.todo(plan, done).count() == 0
    with pytest.raises(execution.Stale, match="code"):
        execution.preflight(spark, folder, {"code": "other"})
    stores = [spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")]
    held, missing = execution.reuse(spark.createDataFrame([(1,), (2,), (3,)], "k int"), stores, "k", "v")
    assert sorted(map(tuple, held.collect())) == [(1, "x"), (2, "z")] and [r.k for r in missing.collect()] == [3]
    assert execution.compatible({"a": "1", "b": "2"}, {"a": "1", "b": "3"}, ["a", "b", "c"]) == ["b", "c"]
    assert execution.stale_cells(spark.createDataFrame([("x",), (None,)], "identity string"), F.lit("x")).count() == 1
    assert execution.staged(
        spark.createDataFrame([(1, 0.5)], "id int, s double"), "s", {"lo": 0.4, "hi": 0.6}, ["id"]
    ).filter("accepted").first().config == "lo"
    items = spark.createDataFrame([(1, "x", "t1"), (1, "y", "t2")], "id int, system string, text string")
    sheet, key = execution.blind_sheet(items, "seed")
    assert sheet.columns == ["text", "item"] and key.count() == 2
    ratings = sheet.select("item", F.lit(3).alias("score"))
    assert execution.import_ratings(ratings, key).count() == 2
    with pytest.raises(Exception, match="no item"):
        execution.import_ratings(spark.createDataFrame([("zz", 1)], "item string, score int"), key).collect()


def test_statistics(spark):
    pairs = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    assert evaluation.auc(pairs, "s", "y").first().auc == pytest.approx(3.5 / 4)
    got = {r.s: r["rank"] for r in evaluation.average_ranks(pairs, "s").collect()}
    assert got == {0.1: 1.0, 0.8: 2.5, 0.9: 4.0}
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    for row in evaluation.exact_quantiles(many, ["g"], "v", [0.25, 0.5]).collect():
        values = sorted(r.v for r in many.filter(F.col("g") == row.g).collect())
        at = (len(values) - 1) * 0.25
        assert row.q0 == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at - int(at)))
    sums = evaluation.before(many.select("v"), "v", F.lit(1), "b").collect()
    assert all(r.b == int(r.v) for r in sums)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a int, b int")
    assert statistics.closure(edges, 8).filter("a = 0").count() == 6
    spans = lambda *x: spark.createDataFrame(list(x), "k int, a long, b long")
    r = {x.kind: (x.precision, x.recall) for x in statistics.span_scores(spans((1, 0, 2), (1, 5, 7)), spans((1, 0, 2), (1, 6, 9), (2, 0, 1)), "k").collect()}
    assert r == {"exact": (round(1 / 3, 6), 0.5), "overlap": (round(2 / 3, 6), 1.0)}
    perfect = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 3.0), (2, 3.0)], "u int, v double")
    assert statistics.ordinal_alpha(perfect, "u", "v").first().alpha == 1.0


def test_nearest(spark):
    import numpy as np

    x = np.random.default_rng(3).standard_normal((300, 8)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (4096, 7):
        got = evaluation.nearest(df, df.filter("id % 20 = 0"), "id", "v", 4, block).collect()
        for q in range(0, 300, 20):
            cosine = np.round(u @ u[q], 9)
            cosine[q] = -2
            want = sorted(range(300), key=lambda i: (-cosine[i], i))[:4]
            assert [r.id for r in sorted((r for r in got if r.q_id == q), key=lambda r: r.place)] == want


def test_page_layout(spark):
    from lexaria.sources import layout

    names = "doc string, page long, col long, top double, left double, right double, size double, kind string, text string"
    e = [("d", 1, 0, 10.0, 0.0, 40.0, 20.0, "plain", "Title"), ("d", 1, 0, 30.0, 0.0, 40.0, 10.0, "bold", "Abstract"), ("d", 1, 0, 40.0, 0.0, 20.0, 10.0, "plain", "It is a sim-"), ("d", 1, 0, 42.0, 30.0, 50.0, 10.0, "plain", "x"),
         ("d", 1, 0, 50.0, 0.0, 20.0, 10.0, "plain", "ple thing."), ("d", 1, 0, 60.0, 9.0, 20.0, 10.0, "plain", "New one."), (
             "d", 1, 0, 70.0, 0.0, 30.0, 10.0, "bold", "1 Introduction"
         ), ("d", 1, 0, 80.0, 0.0, 30.0, 10.0, "plain", "Body here."),
         ("d", 1, 0, 90.0, 0.0, 30.0, 10.0, "bold", "References"), ("d", 1, 0, 99.0, 0.0, 30.0, 10.0, "plain", "[1] none")]
    found = layout.line_kinds(layout.page_lines(spark.createDataFrame(e, names)), 10.0, 18.0)
    assert [(r.text, r.kind) for r in found.orderBy("top").collect()][:3] == [("Title", "title"), ("Abstract", "heading"), ("It is a sim- x", "abstract")]
    assert [r.text for r in layout.paragraphs(found).orderBy("place").collect()] == ["It is a sim- x ple thing.", "New one.", "Body here."]
    with pytest.raises(Exception, match="case 7"):
        layout.attributed_cases(
            spark.createDataFrame([(7, "a cat", "dog", 2, 5, "s")], "id int, text string, target string, start int, end int, source string")
        ).collect()


def test_service_answers():
    from lexaria.sources import services

    good = {"matches": [{"offset": 2, "length": 3, "rule": "r", "replacements": ["dog"]}]}
    assert services.warnings_of("a cat", good) == [(2, 5, "r", ["dog"])]
    for bad in (
        [], {"matches": 1}, {"matches": [{"offset": 2, "length": 9, "rule": "r"}]},
        {"matches": [{"offset": 0, "length": 2, "rule": "r"}, {"offset": 1, "length": 1, "rule": "r"}]}
    ):
        with pytest.raises(ValueError):
            services.warnings_of("a cat", bad)
    with pytest.raises(ValueError, match="loopback"):
        services.post("http://example.org/x", {})


def test_loopback_service():
    import http.server
    import threading

    from lexaria.sources import services

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "http://example.org/")
                self.end_headers()
                return
            data = json.dumps({"output": body["text"].upper(), "matches": []}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert services.simplifier(f"{base}/s")("abc") == "ABC" and services.grammar_checker(f"{base}/g")("abc") == []
        with pytest.raises(ValueError, match="points to"):
            services.post(f"{base}/away", {"text": "x"})
        with pytest.raises(ValueError, match="more than"):
            services.post(f"{base}/s", {"text": "x" * 100}, most=10)
    finally:
        server.shutdown()
