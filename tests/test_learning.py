"""Feedback in batch and as a stream, upserts, files."""

from pyspark.sql import functions as F

from tessera.operators import answering as A
from tessera.operators import learning as L
from tessera.sources import files as S
from tessera.streaming.feedback import streamed_weights

LOG = [("a", 1, "correct"), ("a", 2, "wrong"), ("a", 3, "odd"), ("b", 1, "odd")] + [("c", k, "correct") for k in range(20)] + [("c", 30, "wrong")] + [("d", k, "wrong") for k in range(20)]


def test_feedback_batch_equals_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, t, t, v) for k, t, v in LOG], "key string, ts int, seq int, verdict string")
    batch = {r.key: (r.weight, r.correct, r.wrong) for r in L.feedback_weights(rows, "key", ["ts", "seq"], "verdict").collect()}
    assert batch == {"a": (0.95, 1, 1), "b": (1.0, 0, 0), "c": (1.85, 20, 1), "d": (0.1, 0, 20)}
    for run in (1, 3, 7):
        assert {r.key: (r.weight, r.correct, r.wrong) for r in L.feedback_weights(rows, "key", ["ts", "seq"], "verdict", run).collect()} == batch
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streamed_weights(stream).writeStream.outputMode("update").format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: (r.weight, r.correct, r.wrong) for r in spark.table("weights").collect()} == batch


def test_uploads_are_indexed(spark, tmp_path):
    """A stream of uploads writes filings, chunks, postings and facts; uploading a page again replaces it, with nothing too."""
    from tessera.operators.ingestion import index_filings
    from tessera.operators.retrieval import bm25, from_postings
    from tessera.streaming.feedback import each_batch

    table = "<p>Some words on sales.</p><table><tr><td></td><td>2020</td></tr><tr><td>Sales</td><td>{}</td></tr></table>".format
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def run():
        q = each_batch(S.uploads(spark, str(tmp_path / "in")), lambda df: index_filings(df, out), str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    (tmp_path / "in" / "A_2020_10K.HTM").write_text(table(5))
    (tmp_path / "in" / "B.txt").write_text(table("(7)"))
    (tmp_path / "in" / "c.pdf").write_text(table(1))
    run()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert {(r.doc, r.value_text) for r in read("facts").collect()} == {("A_2020_10K", "5"), ("B", "-7")}
    assert {r.doc for r in read("filings").collect()} == {"A_2020_10K", "B"} == {r.doc for r in read("chunks").collect()}
    chunks = read("chunks").select(F.col("doc"), F.col("chunk_id").alias("id"), "text")
    score = lambda df: sorted((r.doc, r.id, r.score) for r in df.collect())
    assert score(from_postings(read("postings"), read("sizes"), ["sales", "words"])) == score(bm25(chunks, ["sales", "words"], ["doc"]))
    (tmp_path / "in" / "B.html").write_text("<p> </p>")
    run()
    for name in ("facts", "chunks", "postings", "sizes"):
        assert {r.doc for r in read(name).select("doc").distinct().collect()} == {"A_2020_10K"}, name


def test_postings_are_rebuilt(spark, tmp_path):
    """Postings of documents that are gone go, and searches are the same."""
    from tessera.operators import maintenance as M
    from tessera.operators.retrieval import bm25, from_postings

    rows = spark.createDataFrame([("a", 1, "one two two"), ("a", 2, "two three"), ("b", 3, "one"), ("b", 4, "")], "doc string, id int, text string")
    path = str(tmp_path / "p")
    M.store_postings(rows, path)
    M.rebuild_postings(rows.filter("doc = 'a'"), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    assert {r.doc for r in read("postings").collect()} == {"a"} == {r.doc for r in read("sizes").collect()}
    got = {(r.doc, r.id): r.score for r in from_postings(read("postings"), read("sizes"), ["one", "two"]).collect()}
    assert got == {(r.doc, r.id): r.score for r in bm25(rows.filter("doc = 'a'"), ["one", "two"], ["doc"]).collect()}


def test_facts_are_ingested(spark, tmp_path):
    """All, one, a missing one, and a dry run that writes nothing (M7)."""
    from tessera.operators import filings as P
    from tessera.operators.dom import dom
    from tessera.operators.maintenance import ingest_facts

    html = "<table><tr><td></td><td>2020</td></tr><tr><td>x</td><td>1</td></tr></table>"
    pages = spark.createDataFrame([("a", html), ("b", "<p>nothing</p>")], "doc string, html string")
    path = str(tmp_path / "facts")
    extract = lambda df: P.facts(dom(df)).select("doc", "row_label", "value_text")
    assert sorted(map(tuple, ingest_facts(pages, path, extract, dry_run=True).collect())) == [("a", 1, "dry run"), ("b", 0, "empty")]
    only = spark.createDataFrame([("a",), ("z",)], "doc string")
    assert sorted(map(tuple, ingest_facts(pages, path, extract, only).collect())) == [("a", 1, "stored"), ("z", 0, "missing")]
    assert sorted(map(tuple, ingest_facts(pages, path, extract).collect())) == [("a", 1, "stored"), ("b", 0, "empty")]


def test_stores(spark, tmp_path):
    """Logs, tables of chunks, question documents, diagnoses."""
    import pytest

    from tessera.operators import maintenance as M

    rows = spark.createDataFrame([("1", 1)], "id string, score int")
    S.write_log(rows, str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "log")).select("id", "score").collect()] == [("1", 1)]
    S.create_chunks(spark, "stored_chunks")
    S.create_chunks(spark, "stored_chunks")
    assert spark.table("stored_chunks").count() == 0 and S.stored(spark, "a int", str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        S.valid_name("x; drop")
    asked = spark.createDataFrame([("a.htm",), ("a",), ("b.html",), (None,)], "doc_name string")
    assert {r.doc_name: r.n for r in S.question_documents(asked).collect()} == {"a": 2, "b": 1}
    assert M.diagnose({"sparse": rows, "dense": rows.limit(0)}) == {"sparse": 1, "dense": 0}
    assert "index it again" in M.diagnosis({"sparse": 1, "dense": 0}) and "isn't indexed" in M.diagnosis({}) and "unsure" in M.diagnosis({"sparse": 1, "dense": 2})
    L.remember(spark.createDataFrame([("q", "d", True, 1)], "question string, doc_name string, abstained boolean, ts int"), str(tmp_path / "q"))
    L.remember(spark.createDataFrame([("r", "d", False, 2)], "question string, doc_name string, abstained boolean, ts int"), str(tmp_path / "q"))
    assert {(r.question, r.outcome) for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {("q", "abstained"), ("r", "answered")}


def test_two_passes(spark):
    """Drafts and checks by the defaults, a failing model, a fallback, no context."""
    text = "[Excerpt 1 | page 4 | prose]\nnothing of it\n\n[Excerpt 2 | page 9 | prose]\nsales grew to 12"
    rows = spark.createDataFrame([("how did sales grow", text, 4), ("unasked", "", None), ("zebra", text, 4)], "question string, context string, first_page int")
    got = {r.question: (r.answer, r.page_num, r.abstained, r.confidence) for r in A.ask(rows, theta=0.3).collect()}
    assert got == {"how did sales grow": ("sales grew to 12", 9, False, 0.25), "unasked": (A.NOT_FOUND, None, True, 0.0), "zebra": (A.NOT_FOUND, None, True, 0.0)}

    def broken(prompts):
        raise OSError

    assert {r.answer for r in A.ask(rows.filter("context <> ''"), draft=broken).collect()} == {A.UNAVAILABLE}
    assert A.first_that_works(broken, A.extractive)(["Question: a\n\nExcerpts:\n"]) == A.extractive(["Question: a\n\nExcerpts:\n"])
    assert A.guarded(broken)(["a", "b"]) == ["", ""] and A.token_gap(40_000, 100_000, 0.7) == 40_000 / 70_000 * 60


def test_filings_and_questions(spark, tmp_path):
    (tmp_path / "b.htm").write_bytes(b"<p>ok\xff</p>")
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "c.txt").write_text("no")
    assert {r.doc: r.html for r in S.filings(spark, str(tmp_path)).collect()} == {"a": "<p>x</p>", "b": "<p>ok</p>"}
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "q", "doc_name": "d"}\n\n{bad\n')
    assert S.questions(spark, str(tmp_path / "q.jsonl"), strict=False).count() == 1
    (tmp_path / "r.jsonl").write_text("".join('{"id": "%d", "question": "q", "doc_name": "d"}\n\n' % k for k in range(5)))
    assert S.questions(spark, str(tmp_path / "r.jsonl"), first=3).count() == 3


def test_replies_are_paced_and_retried():
    import pandas as pd

    calls, naps = [], []

    def model(prompts):
        calls.append(prompts)
        if len(calls) == 1:
            raise OSError
        return [p.upper() for p in prompts]

    out = list(A.paced(iter([pd.DataFrame({"prompt": ["a"]})] * 2), model, 60, wait=7, sleep=naps.append, gap=5))
    assert out[0]["reply"].tolist() == ["A"] and 7 in naps and naps[0] == 0 and 4 < naps[-1] <= 5


def test_json_reply(spark):
    rows = spark.createDataFrame([('```json\n{"k": 1}\n```',), ('so {"k": 2} it is',), ("none",)], "t string")
    assert [r.k for r in rows.select(A.json_reply(F.col("t"), "k long")["k"].alias("k")).collect()] == [1, 2, None]
