import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corvane.operators import prompts, results, vector
from corvane.plans.engine import Engine, legal, remote
from corvane.streaming.ingest import ingest, read_index

CASES = {
    "civil": "北京市朝阳区人民法院\n（2024）京0105民初12345号\n原告：张某某。被告：李某某，住所地北京市。\n民间借贷纠纷，被告应承担还款义务。本院判决如下。\n2024年3月20日",
    "criminal": "北京市海淀区人民法院\n（2024）京0108刑初55555号\n公诉机关：检察院。被告人以非法占有为目的，犯诈骗罪，判决如下。\n2023年3月12日",
    "admin": "上海市高级人民法院\n（2023）沪行终9号\n行政处罚程序违法，撤销处罚决定。\n2023年5月1日",
}


def engine(spark, **options):
    docs = spark.createDataFrame(list(CASES.items()), "doc_id string, text string")
    return legal(spark, **options).add(docs)


def test_words_find_documents(spark):
    e = engine(spark)
    for query, doc in (("民间借贷 还款义务", "civil"), ("诈骗罪 非法占有", "criminal"), ("行政处罚 程序违法", "admin")):
        first = e.search(query).first()
        assert first.doc_id == doc and first.vector_score == 0 and first.final_score == first.bm25_score > 0


def test_place_questions_find_addresses(spark):
    first = engine(spark).search("这个案子发生在哪里").first()
    assert first.doc_id == "civil" and first.bm25_score > 0


def test_hybrid_and_failing_provider(spark):
    e = engine(spark, embedding=vector.HashingProvider())
    got = e.search(CASES["admin"], 3).collect()
    assert got[0].doc_id == "admin" and got[0].vector_score > 0.99

    class Broken:
        ready = True

        def embed(self, texts):
            raise OSError("no network")

    assert engine(spark, embedding=Broken()).search("诈骗罪").first().vector_score == 0


def test_answers(spark):
    e = engine(spark, chat=prompts.EchoProvider())
    assert e.answer("  ") is None and legal(spark).answer("判决").text == "没有已导入的文档"
    one = e.answer("诈骗罪 判决", year="2023")
    assert one.text == "## 四、参考来源" and "criminal" in one.prompt and {r.doc_id for r in one.results.collect()} <= {"criminal", "admin"}
    every = e.answer("所有案件 判决 汇总", case_type="民事")
    assert "全部 3 个" in every.prompt and len({r.doc_id for r in every.results.collect()}) > 1
    assert {r.doc_id for r in e.answer("所有案件 判决 汇总", case_type="民事", respect_filters=True).results.collect()} == {"civil"}


def test_documents_are_replaced_and_kept(spark, tmp_path):
    e = engine(spark).add(spark.createDataFrame([("civil", "知识产权 侵权。"), (None, "x"), ("empty", "")], "doc_id string, text string"))
    assert e.search("民间借贷").where("doc_id = 'civil'").count() == 0 and e.search("侵权").first().doc_id == "civil"
    assert sorted(r.doc_id for r in e.all_documents().collect()) == ["admin", "civil", "criminal"]
    assert sorted(r.doc_id for r in e.doc_ids().collect()) == ["admin", "criminal"]
    e.save(str(tmp_path / "e"))
    assert legal(spark).load(str(tmp_path / "e")).search("侵权").first().doc_id == "civil"
    assert e.clear().index is None


def test_import(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" ", encoding="utf-8")
    e = Engine(spark)
    log = {r.doc_id: r.imported for r in e.import_files([str(tmp_path), str(tmp_path / "no" / "gone.txt")]).collect()}
    assert log == {"civil.txt": True, "criminal.txt": True, "admin.txt": True, "blank.txt": False, "gone.txt": False}
    assert [r.diagnostic for r in Engine(spark).import_files(["/no/such/file.txt"]).collect()] == ["the file cannot be read"]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    for i, rows in enumerate(([("a", "alpha beta"), ("b", "beta gamma")], [("a", "delta epsilon")])):
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("doc_id string, text string").parquet(str(src))
        ingest(stream, out, str(tmp_path / "check")).awaitTermination(60)
    idx = read_index(spark, out)
    assert sorted((r.term, r.doc_id) for r in idx.postings.collect()) == [("beta", "b"), ("delta", "a"), ("epsilon", "a"), ("gamma", "b")]
    assert sorted((r.doc_id, r.dl) for r in idx.chunk_stats.collect()) == [("a", 2), ("b", 2)]


QUERY = "诈骗罪 判决"


class Provider:
    """Counts what it is asked for; `late` makes it fail for chunks, in the tasks."""

    ready = True

    def __init__(self, late=False, vectors=True):
        self.late, self.vectors = late, vectors

    def embed(self, texts):
        if not self.vectors:
            return []
        if self.late and texts != [QUERY]:
            raise RuntimeError("lost")
        return vector.HashingProvider().embed(texts)


def test_words_alone_with_raw_scores(spark):
    """No provider, one without a key, one that has no vectors, one that fails at once, late, or with vectors for some texts."""
    want = [tuple(r) for r in engine(spark).search(QUERY).collect()]
    assert want and all(r[-1] == r[-3] > 0 and r[-2] == 0 for r in want)

    class Broken(Provider):
        def embed(self, texts):
            raise KeyError("anything")

    class Short(Provider):
        def embed(self, texts):
            return super().embed(texts)[:1] if len(texts) > 1 else super().embed(texts)

    for provider in (vector.HttpProvider("http://localhost:9", ""), vector.HttpProvider("http://localhost:9", "key", timeout=1), Provider(vectors=False), Broken(), Provider(late=True), Short()):
        assert [tuple(r) for r in engine(spark, embedding=provider).search(QUERY).collect()] == want


def test_queries_without_vectors_among_others(spark):
    class Some(Provider):
        def embed(self, texts):
            return [[] if t == QUERY else v for t, v in zip(texts, super().embed(texts), strict=True)]

    e = engine(spark, embedding=Some())
    got = e.search_many([QUERY, CASES["admin"]]).collect()
    assert [tuple(r)[2:] for r in got if r.query_id == 0] == [tuple(r)[1:] for r in engine(spark).search(QUERY).collect()]
    assert any(r.vector_score > 0.99 for r in got if r.query_id == 1)


def test_vectors_are_asked_for_once_and_survive(spark, tmp_path):
    e = engine(spark, embedding=Provider())
    before = {tuple(r) for r in e.sync_vectors().select("doc_id", "chunk_index").collect()}
    e.embedding = Provider(late=True)  # nothing is left to ask for but the query
    first = e.search(QUERY).collect()
    assert first[0].vector_score > 0 and len(before) == e.chunks.count()
    e.save(str(tmp_path / "e"))
    again = legal(spark, embedding=Provider(late=True)).load(str(tmp_path / "e"))
    assert [tuple(r) for r in again.search(QUERY).collect()] == [tuple(r) for r in first]
    # a document that comes again has another vector; the others stay
    again.embedding = Provider()
    old = {r.doc_id: r.vec for r in again.vectors.collect()}
    again.add(spark.createDataFrame([("civil", "民间借贷 纠纷 另一份")], "doc_id string, text string"))
    assert "civil" not in {r.doc_id for r in again.vectors.collect()}
    new = {r.doc_id: r.vec for r in again.sync_vectors().collect()}
    assert new["admin"] == old["admin"] and new["civil"] != old["civil"] and again.vectors.count() == again.chunks.count()
    with pytest.raises(ValueError, match="already"):
        again.save(again.path)


def test_repeated_ids_and_words_of_the_user(spark, tmp_path):
    docs = spark.createDataFrame([("a", "乙 text"), ("a", "甲 text"), ("b", "检索增强生成")], "doc_id string, text string").repartition(3)
    assert {r.doc_id: r.text for r in legal(spark).add(docs).documents.collect()} == {"a": "乙 text", "b": "检索增强生成"}
    words = tmp_path / "words.txt"
    words.write_text("# mine\n检索增强 30\n生成\n", encoding="utf-8")
    e = legal(spark)
    assert e.use_words(str(words)) == 2 and e.use_words(str(tmp_path / "none.txt")) == 0
    e.add(docs)
    assert {r.term for r in e.index.postings.where("doc_id = 'b'").collect()} == {"检索增强", "生成"}
    assert "检索增强" not in legal(spark).settings.lexicon


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, self.headers["Authorization"], body))
        if self.path == "/fails":
            self.send_error(500)
            return
        self.send_response(200)
        self.end_headers()
        if self.path == "/embeddings":
            vecs = vector.HashingProvider().embed(body["input"])
            data = [{"index": i, "embedding": v} for i, v in enumerate(vecs)][::-1]
            self.wfile.write(json.dumps({"data": data}).encode())
        elif self.path == "/junk":
            self.wfile.write(b"no json")
        else:
            for c in ("见", "来源 1"):
                self.wfile.write(b"data: " + json.dumps({"choices": [{"delta": {"content": c}}]}).encode() + b"\n\n")
            self.wfile.write(b"data: [DONE]\n")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_services(spark, service, monkeypatch):
    monkeypatch.setenv("CORVANE_API_KEY", "sk-0123456789abcdefgh")
    e = remote(spark, f"{service}/embeddings", f"{service}/chat")
    e.add(spark.createDataFrame(list(CASES.items()), "doc_id string, text string"))
    Service.asked.clear()
    assert e.search(CASES["admin"], 3).first().vector_score > 0.99
    assert all(key == "Bearer sk-0123456789abcdefgh" and len(body["input"]) <= vector.PER_CALL for _, key, body in Service.asked)
    assert e.answer("诈骗罪 判决").text == "见来源 1"
    path, _, body = Service.asked[-1]
    assert path == "/chat" and body["stream"] is True and (body["temperature"], body["max_tokens"]) == (0.3, 2048) and [m["role"] for m in body["messages"]] == ["system", "user"]
    provider = vector.HttpProvider(f"{service}/embeddings", "key")
    assert vector.embed_one(provider, "一") == vector.HashingProvider().embed(["一"])[0] and provider.embed([]) == []
    for bad in ("fails", "junk"):
        with pytest.raises((OSError, ValueError)):
            vector.HttpProvider(f"{service}/{bad}", "key").embed(["x"])
    with pytest.raises(OSError):
        prompts.generate(prompts.HttpChat(f"{service}/fails", "key"), "s", "u")


def test_keys_of_the_environment(spark, monkeypatch):
    monkeypatch.delenv("CORVANE_API_KEY", raising=False)
    monkeypatch.setenv("OTHER_KEY", " k ")
    assert results.key_from_environment() == "" and results.key_from_environment("NONE", "OTHER_KEY") == "k"
    e = remote(spark, "http://localhost:9", "http://localhost:9")
    assert not e.embedding.ready and not e.chat.ready and prompts.generate(e.chat, "s", "u").startswith("错误")


class Counting:
    """Notes each text that it is asked for, in a file."""

    ready = True
    model = "counting"

    def __init__(self, path):
        self.path = str(path)

    def embed(self, texts):
        with open(self.path, "a", encoding="utf-8") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return vector.HashingProvider().embed(texts)


def test_a_content_is_asked_for_once(spark, tmp_path):
    asked = tmp_path / "asked"
    lines = lambda: asked.read_text(encoding="utf-8").split("\n")[:-1] if asked.exists() else []
    put = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    e = Engine(spark, embedding=Counting(asked)).add(put(("a", "one text"), ("b", "one text"), ("c", "another")))
    assert e.sync_vectors().count() == 3 and sorted(lines()) == ["another", "one text"]
    # replaced by what was there before, and by something new
    e.add(put(("a", "another"), ("d", "one text"), ("e", "third")))
    got = {r.doc_id: r.vec for r in e.sync_vectors().collect()}
    assert sorted(lines()) == ["another", "one text", "third"] and got["a"] == got["c"] and got["b"] == got["d"] and len(got) == 5
    e.add(put(("c", "fourth")))
    e.add(put(("c", "another")))
    assert e.sync_vectors().count() == 5 and len(lines()) == 3
    # kept when saved, with what is there only; another model asks anew
    e.add(put(("e", "one text")))
    e.save(str(tmp_path / "saved"))
    again = Engine(spark, embedding=Counting(asked)).load(str(tmp_path / "saved"))
    assert again.sync_vectors().count() == 5 and len(lines()) == 3
    assert spark.read.parquet(str(tmp_path / "saved" / "vectors")).count() == 2
    other = Counting(asked)
    other.model = "other"
    assert Engine(spark, embedding=other).load(str(tmp_path / "saved")).sync_vectors().count() == 5 and len(lines()) == 5


def test_what_two_writers_stored_is_read_once(spark, tmp_path):
    e = Engine(spark, embedding=vector.HashingProvider()).add(spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string"))
    e.sync_vectors()
    spark.read.parquet(f"{e.path}/vectors").write.mode("append").parquet(f"{e.path}/vectors")
    assert e.vectors.count() == 1 and e.sync_vectors().count() == 1


def test_writers_that_share_a_folder_lose_nothing(spark, tmp_path):
    """Two engines that were loaded from one path add a document each; a batch number is taken once."""
    put = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    first = Engine(spark, path=str(tmp_path / "e")).add(put(("a", "alpha")))
    second = Engine(spark).load(first.path)
    second.add(put(("b", "beta")))
    first.add(put(("c", "gamma"), ("a", "delta")))
    assert {r.doc_id: r.text for r in second.documents.collect()} == {"a": "delta", "b": "beta", "c": "gamma"}
    assert second.search("delta").first().doc_id == "a" and second.search("alpha").count() == 0 and first.search("beta").first().doc_id == "b"
    # what a writer has begun and not ended is not read, and its number not taken again
    put(("x", "lost")).write.parquet(f"{first.path}/documents/batch=4")
    first.add(put(("d", "kappa")))
    assert {r.doc_id for r in second.documents.collect()} == {"a", "b", "c", "d"} and second.stored.batches() == [1, 2, 3, 5]


def test_fallback_indexes_the_documents_once(spark, monkeypatch):
    from corvane.operators.stored import StoredIndex
    from corvane.plans.queries import engine_fallback

    added = []
    monkeypatch.setattr(StoredIndex, "add", lambda self, *a, add=StoredIndex.add: added.append(a[1]) or add(self, *a))
    found = engine_fallback(spark, "/root/testdata/sf0.001")
    assert added == [1] and {r.provider for r in found.select("provider").distinct().collect()} == {"Silent", "Failing", "LateFailing"}


def test_stored_contents_do_not_move(spark):
    put = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "x")], "doc_id string, chunk_index int, content string")
    p = vector.HashingProvider()
    stored = vector.embed_contents(vector.misses(put, None, "m"), p, "m").localCheckpoint()
    assert vector.misses(put, stored.where("digest <> sha2('x', 256)"), "m").collect() == vector.misses(put.where("content = 'x'"), None, "m").collect()
    none = vector.misses(put, stored, "m")
    assert none.count() == 0 and "sha2" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_are_made_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return None if i == 3 else "" if i == 4 else f"text {i}"

    docs = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long")
    e = Engine(spark).add(docs.select("doc_id", F.udf(text, "string")("doc_id").alias("text")))
    assert made.value == 10
    assert {tuple(r) for r in e.documents.select("doc_id", "text").collect()} == {(i, f"text {i}") for i in range(10) if i not in (3, 4)}


def test_texts_without_repeated_ids_are_not_shuffled(spark, monkeypatch):
    """Large batches; those with repeated ids are put together as small ones are."""
    from corvane.plans import engine as plans

    monkeypatch.setattr(plans, "DIRECT", 1)
    rows = [(i, None if i == 3 else "" if i == 4 else f"text {i}") for i in range(10)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, f"text {i}") for i in range(10) if i not in (3, 4)}
    given = plans._given(docs)
    assert "Exchange" not in given._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in given.collect()} == want
    twice = docs.unionByName(docs.where("doc_id in (3, 5)").withColumn("text", F.lit("other")))
    assert {tuple(r) for r in plans._given(twice).collect()} == want - {(5, "text 5")} | {(3, "other"), (5, "other")}
    assert {tuple(r) for r in Engine(spark).add(docs).documents.select("doc_id", "text").collect()} == want


def test_an_engine_keeps_what_its_searches_read(spark, monkeypatch):
    """Large batches: no counted rows beside the postings, no bounds; what replaced texts had of a term is told by the search."""
    from corvane.operators import stored

    monkeypatch.setattr(stored, "SMALL", 0)
    put = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    e = Engine(spark).add(put(("a", "alpha beta"), ("b", "beta"))).add(put(("a", "beta gamma")))
    assert "terms" not in spark.read.parquet(f"{e.path}/index/forward").columns and e.stored._rows("blocks") is None
    assert {(r.term, r.df) for r in e.stored.doc_freq.collect()} == {("beta", 2), ("gamma", 1)}
    assert e.search("alpha").count() == 0
    assert [tuple(r) for r in e.search("beta gamma").collect()] == [tuple(r) for r in Engine(spark).add(put(("a", "beta gamma"), ("b", "beta"))).search("beta gamma").collect()]
