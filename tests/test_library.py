"""Accounting, log, projects, locality, stores, configuration and providers."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions import text as T
from tidemark.operators import accounting, conversations, locality, projects
from tidemark.operators.positions import with_position
from tidemark.plans.offline import OfflineTransport
from tidemark.sources import configuration as conf
from tidemark.sources import providers, vectors_csv
from tidemark.sources.collections import VectorStore, positional_points
from tidemark.streaming.upserts import stream_into


def one(df):
    return df.first()[0]


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), accounting.LEDGER)


def test_usage_costs_and_gaps(spark):
    rows = ledger(spark, ("openai", "gpt-4o", 1000, 500, True, True), ("openai", "gpt-99-unreleased", 10, 0, True, True), ("ollama", "llama3", 7, 7, False, False), ("openai", "text-embedding-3-small", 5, 1, True, True))
    t = accounting.usage_totals(rows).first()
    assert (t["calls"], t["input_tokens"], t["output_tokens"], t["total_tokens"]) == (4, 1022, 508, 1530)
    assert (t["unpriced_calls"], t["uncounted_calls"]) == (2, 1) and t["estimated_cost"] == pytest.approx(0.0075)
    assert one(accounting.usage_summary(rows)) == "4 calls, 1,530 tokens, ~$0.0075 (2 unpriced), 1 not counted"
    assert one(accounting.usage_summary(rows.limit(0))) == "no provider calls"
    assert one(accounting.usage_summary(ledger(spark, ("o", "gpt-4o", 1, 0, True, True)))).startswith("1 call, 1 tokens, ~$0.0000")


def test_batches_of_a_hundred(spark):
    texts = with_position(spark.range(250).select(F.col("id").alias("k"), F.lit(5).cast("bigint").alias("tokens")), "k")
    got = accounting.embedding_batches(texts).orderBy("batch").collect()
    assert [(r["n_texts"], r["tokens"]) for r in got] == [(100, 500), (100, 500), (50, 250)]


def test_positions_of_a_million_wide_rows(spark, tmp_path):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.repeat(F.lit("payload "), 12).alias("wide"), F.col("id"))
    with_position(rows, "k", start=5).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 5, 1_000_004)
    assert with_position(rows, "k").orderBy("position").limit(3).select("k").collect() == rows.orderBy("k").limit(3).select("k").collect()
    assert with_position(rows.limit(0), "k").count() == 0
    tied = with_position(spark.range(1000).select(F.lit(1).alias("k"), "id"), "k").collect()
    assert sorted(r["position"] for r in tied) == list(range(1000))


def test_tables_go_with_their_scope(spark):
    def there(df):
        return os.path.isdir(df._tidemark_path)

    kept = tables.materialise(spark.range(3), "kept")
    with tables.scratch(spark):
        inner, outer = tables.materialise(spark.range(3), "inner"), tables.materialise(spark.range(4), "outer", outer=True)
        assert there(inner) and there(outer)
    assert there(kept) and not there(inner) and outer.count() == 4
    tables.release(kept, outer, spark.range(1))
    assert not there(kept) and not there(outer)
    with pytest.raises(RuntimeError), tables.scratch(spark):
        inner = tables.materialise(spark.range(3), "inner")
        raise RuntimeError
    assert not there(inner)


@pytest.mark.parametrize("name, slug", [("  Case   #42  ", "case-42"), ("!!!", "project"), ("Ünïcode Name", "n-code-name"), ("a--b", "a-b"), ("", "project")])
def test_slugs(spark, name, slug):
    assert one(spark.createDataFrame([(name,)], "n string").select(T.slugify(F.col("n")))) == slug == conf.slug_of(name)


@pytest.mark.parametrize("url, near", [("http://localhost:11434", True), ("127.0.0.1:11434", True), ("http://[::1]:8080", True), ("", True), ("http://0.0.0.0:1/x", True), ("http://box:11434", False), ("https://api.example.com", False), ("192.168.1.5:80", False)])
def test_loopback(spark, url, near):
    assert one(spark.createDataFrame([(url,)], "u string").select(T.is_loopback(F.col("u")))) is near


def test_locality(spark):
    rows = [("x", "embedding", "ollama", None, "http://box:1"), ("x", "generation", "anthropic", "m", ""), ("y", "embedding", "sentence-transformers", None, ""), ("y", "generation", "ollama", "llama3", "")]
    got = {r["config"]: r for r in locality.audit(spark.createDataFrame(rows, "config string, role string, provider string, model string, base_url string")).collect()}
    assert got["x"]["summary"] == "content leaves: embedding (ollama) answered by another host: http://box:1; generation (anthropic) goes to a hosted service"
    assert got["y"]["is_local"] and got["y"]["summary"] == locality.LOCAL
    assert got["y"]["setup"] == "while online, store a copy of all-MiniLM-L6-v2; while online, have the local server load llama3"


PROJECTS = "position bigint, id string, slug string, embedding_model string"


def test_majority_ties_and_exclusions(spark):
    rows = [(0, "1", "a", "small"), (1, "2", "b", "large"), (2, "3", "c", "large"), (3, "1", "again", "large"), (4, "5", "d", "small")]
    p = spark.createDataFrame(rows, PROJECTS)
    assert one(projects.majority_model(p)) == "small"
    chosen = projects.select_projects(p)
    assert sorted(r["slug"] for r in chosen.where("included").collect()) == ["a", "d"]
    assert one(projects.selection_notice(chosen)) == "2 of 4 projects skipped — different embedding model: b (large), c (large)"
    assert one(projects.selection_notice(projects.select_projects(p.where("embedding_model = 'small'")))) == ""
    assert projects.select_projects(p, "large").where("included").count() == 2


def test_registry_tables(spark):
    r = spark.createDataFrame([(0, "1", "x", "m"), (1, "2", "1", "m")], PROJECTS)
    assert projects.find(r, "1").first()["slug"] == "x"
    assert projects.unregister(r, "1").count() == 0
    fresh = projects.register(r, spark.createDataFrame([(2, "1", "x", "new")], PROJECTS))
    assert {(x["id"], x["embedding_model"]) for x in fresh.collect()} == {("1", "new"), ("2", "m")}


def test_log(spark):
    log = spark.createDataFrame([], conversations.MESSAGES)
    new = spark.createDataFrame([("r", "c1", "user", "hi", 1), ("r", "c1", "assistant", "hello", 2)], "ref_id string, chat_id string, role string, message string, at int")
    log = conversations.append_messages(conversations.append_messages(log, new, "at"), new, "at")
    assert sorted(r["id"] for r in log.collect()) == [1, 2, 3, 4]
    loaded = conversations.load_messages(log, "r").first()
    assert [m["content"] for m in loaded["messages"]] == ["hi", "hello", "hi", "hello"]
    index = conversations.append_index(spark.createDataFrame([("r", "then")], conversations.INDEX), spark.createDataFrame([("r", 0), ("s", 0), ("s", 60)], "id string, epoch bigint"))
    assert {tuple(r) for r in index.collect()} == {("r", "then"), ("s", "1970-01-01 00:00:00")}
    assert conversations.orphans(log, index.where("id = 's'")).count() == 4


def test_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    assert store.collections() == []
    store.create("c", 2)
    store.add("c", [[1, 0], [0, 1]], [{"text": "a"}, {"text": "b"}])
    store.append("c", [[1, 1], [-1, 0]])
    assert sorted(r["id"] for r in store.points("c").collect()) == [0, 1, 2, 3] and store.count("c") == 4
    store.add("c", [[0, -1]])
    assert store.count("c") == 4 and store.points("c").where("id = 0").first()["embedding"] == [0.0, -1.0]
    assert [r["id"] for r in store.search([0, 1], 2, "c").collect()] == [1, 2]
    assert store.info("c") == {"collection": "c", "vector_name": "main", "size": 2, "distance": "Cosine"}
    for wrong in (lambda: store.add("c", [[1, 0]], [{}, {}]), lambda: store.add("c", [[1]]), lambda: store.search([1, 0]), lambda: store.count("none")):
        with pytest.raises(ValueError):
            wrong()
    store.add("c", [[1, 0]], [])
    store.create("c", 2)
    assert store.count("c") == 0 and store.collections() == ["c"]
    store.delete("c")
    assert store.collections() == []


def test_store_keeps_what_readers_opened_and_one_row_an_id(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    store.create("c", 2)
    store.add("c", [[1, 0], [0, 1]])
    opened = store.points("c")
    for i in range(3):
        store.add("c", [[i, 1]])
    assert opened.count() == 2
    store.upsert("c", spark.createDataFrame([(1, [5.0, 5.0], None), (1, [5.0, 5.0], None), (7, [1.0, 1.0], None)], "id bigint, embedding array<double>, payload map<string,string>"))
    assert sorted(r["id"] for r in store.points("c").collect()) == [0, 1, 7]
    with pytest.raises(ValueError):
        store.upsert("c", spark.createDataFrame([(1, [5.0], None)], "id bigint, embedding array<double>, payload map<string,string>"))


def test_payloads_meet_vectors_by_position(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "position bigint, embedding array<double>")
    payload = spark.createDataFrame([(1, "b", None), (0, "a", 3)], "position bigint, text string, n int")
    got = {r["id"]: (r["embedding"], r["payload"]) for r in positional_points(vectors, payload).collect()}
    assert got == {0: ([1.0], {"text": "a", "n": "3"}), 1: ([2.0], {"text": "b", "n": None})}
    assert [r["payload"] for r in positional_points(vectors, payload.limit(0)).collect()] == [None, None]
    with pytest.raises(ValueError):
        positional_points(vectors, payload.limit(1))


def test_stream_into_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.create("c", 2)
    schema = "id bigint, embedding array<double>, payload map<string,string>, at bigint"
    source = lambda: stream_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, "c", str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(1, [1.0, 0.0], None, 1), (1, [0.0, 1.0], None, 2), (2, [1.0, 1.0], None, 1)], schema).write.parquet(str(tmp_path / "in"))
    source()
    assert {r["id"]: r["embedding"] for r in store.points("c").collect()} == {1: [0.0, 1.0], 2: [1.0, 1.0]}
    spark.createDataFrame([(1, [9.0, 9.0], None, 1), (2, [2.0, 2.0], None, 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    source()
    assert {r["id"]: r["embedding"] for r in store.points("c").collect()} == {1: [0.0, 1.0], 2: [2.0, 2.0]}


def test_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('text,embeddings\n"two\nlines, and ""quotes""","[0.1, -2e-3, 3]"\nplain,broken\n')
    df = vectors_csv.read_embeddings_csv(spark, str(path), ["embeddings"])
    got = {r["text"]: r["embeddings"] for r in df.collect()}
    assert got == {'two\nlines, and "quotes"': [0.1, -0.002, 3.0], "plain": None}
    with pytest.raises(AttributeError):
        vectors_csv.embedding_frame(df, ["nope"])
    with pytest.raises(TypeError):
        vectors_csv.load_text(spark, "text")


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "")
    monkeypatch.setenv("QDRANT_PORT", "6333")
    (tmp_path / ".env").write_text("OPENAI_API_KEY='from-file'\n# note\nexport OPENAI_GPT_MODEL=gpt-4o\n")
    s = conf.Settings.from_env(tmp_path / ".env", qdrant_host="h")
    assert (s.openai_api_key, s.openai_gpt_model, s.qdrant_port, s.qdrant_host) == ("from-file", "gpt-4o", 6333, "h")
    with pytest.raises(conf.MissingSettingError):
        s.require("gemini_api_key")
    assert conf.Settings.resolve(s) is s
    with pytest.warns(DeprecationWarning):
        assert conf.Settings.resolve(str(tmp_path / ".env")).openai_api_key == "from-file"
    with pytest.raises(TypeError):
        conf.Settings.resolve(None)
    monkeypatch.setenv("QDRANT_PORT", "x")
    with pytest.raises(ValueError):
        conf.Settings.from_env()


def test_projects_and_registry(spark, tmp_path):
    store = conf.ProjectStore(spark, tmp_path / "home")
    store.create("Case A", embedding_model="large")
    store.create('B "quoted" \\ name')
    with pytest.raises(FileExistsError):
        store.create("case a")
    with pytest.raises(FileNotFoundError):
        store.load("none")
    assert store.paths("case-a")["canon"].is_dir() and store.paths("case-a")["config"].name == "project.toml"
    store.register("case-a", "b-quoted-name")
    store.save(store.load("case-a") | {"settings": {"embedding_model": "huge"}})
    assert store.load("b-quoted-name")["name"] == 'B "quoted" \\ name'
    assert [r["embedding_model"] for r in store.registry.orderBy("position").collect()] == ["large", ""] and store.open("case-a")["settings"] == {"embedding_model": "huge"}
    store.register("case-a")
    assert [r["slug"] for r in store.registry.orderBy("position").collect()] == ["b-quoted-name", "case-a"]
    assert [r["slug"] for r in store.rebuild().orderBy("position").collect()] == ["b-quoted-name", "case-a"]
    store.defaults = {"generation_model": "gpt-4o", "embedding_model": "small", "unknown": 1}
    made = store.settings_for("case-a", conf.Settings())
    assert (made.openai_gpt_model, made.openai_embedding_model) == ("gpt-4o", "huge") and made.sql_db_file_path.startswith(str(store.paths("case-a")["root"]))
    assert store.settings_for("b-quoted-name", conf.Settings(openai_gpt_model="mine")).openai_gpt_model == "mine"
    assert store.choices("b-quoted-name").first()["storage_backend"] == "sqlite"
    assert store.unregister("case-a", files=True) and not store.unregister("case-a") and not store.paths("case-a")["root"].exists()
    with pytest.raises(KeyError):
        store.open("case-a")
    (elsewhere := tmp_path / "elsewhere").mkdir()
    conf.write_toml(store.home / conf.REGISTRY_FILE, {"projects": [{"id": "x", "slug": "x", "name": "x", "path": str(elsewhere)}]})
    assert store.unregister("x", files=True) and elsewhere.is_dir()  # a registry file can't have other folders deleted


class Stub:
    """Answers like a server and keeps what it was asked."""

    def __init__(self, usage=True):
        self.asked, self.usage = [], usage

    def post(self, path, body):
        self.asked.append((path, body))
        if path == "embeddings":
            data = [{"index": i, "embedding": [float(i), 0.2, 0.3]} for i in range(len(body["input"]))]
            return {"data": data[::-1], **({"usage": {"prompt_tokens": 5 * len(data)}} if self.usage else {})}
        if path == "messages":
            return {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "STUB "}, {"type": "text", "text": "REPLY"}], "usage": {"input_tokens": 3, "output_tokens": 2}}
        return {"id": "chatcmpl-stub", "choices": [{"message": {"role": "assistant", "content": "STUB REPLY"}}], "usage": {"prompt_tokens": 11, "completion_tokens": 7, "total_tokens": 18, "extra": None}}

    def get(self, path):
        return {"data": [{"id": "b"}, {"id": "a"}]}


def test_compatible_providers_and_their_use(spark):
    log, stub, keys = providers.UsageLog(), Stub(), conf.Settings(openai_api_key="k", anthropic_api_key="k", ollama_base_url="http://b:1/")
    embed = providers.make_provider("embedding", "openai", keys, log=log, transport=stub)
    vectors = embed.embed(["x"] * 250)
    assert [v[0] for v in vectors[:101]] == [*map(float, range(100)), 0.0] and len(stub.asked) == 3 and embed.embed([]) == []
    assert [u.input_tokens for u in log] == [500, 500, 250] and embed.list_models() == ["a", "b"]
    assert stub.asked[0][1]["model"] == "text-embedding-3-small"
    chat = providers.make_provider("generation", "openai", keys, "gpt-4o", log, stub)
    assert chat.generate("s", "u") == "STUB REPLY" and stub.asked[-1][1]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    claude = providers.make_provider("generation", "anthropic", keys, "some-model", log, stub)
    assert claude.generate("s", "u") == "STUB REPLY" and stub.asked[-1][1]["max_tokens"] == 16000 and stub.asked[-1][1]["system"] == "s"
    assert len(log) == 5 and log.uses[-1][2:] == (3, 2, True, True)
    assert log.summary(spark) == "5 calls, 1,273 tokens, ~$0.0001 (1 unpriced)"
    silent = providers.UsageLog()
    providers.make_provider("embedding", "ollama", keys, "m", silent, Stub(usage=False)).embed(["a"])
    assert silent.uses == [providers.Use("ollama", "m", 0, 0, False, False)]
    with pytest.raises(NotImplementedError):
        providers.make_provider("embedding", "gemini", conf.Settings(gemini_api_key="k"), "m", transport=stub).list_models()
    with pytest.raises(ValueError):
        providers.make_provider("generation", "openai", keys)


def test_local_encoder_is_neither_billed_nor_counted():
    class Encoder:
        calls = 0

        def encode(self, texts):
            self.calls += 1
            return [[i, i, i] for i in range(len(texts))]

    log, encoder = providers.UsageLog(), Encoder()
    local = providers.make_provider("embedding", "sentence-transformers", conf.Settings(), log=log, encoder=encoder)
    assert local.embed(["a", "b"]) == [[0.0] * 3, [1.0] * 3] and local.embed([]) == [] and encoder.calls == 1
    assert log.uses == [providers.Use("sentence-transformers", "all-MiniLM-L6-v2", 0, 0, False, False)]


def test_requests_on_executors_write_a_ledger(spark):
    texts = with_position(spark.range(250).select("id", F.repeat(F.lit("a"), F.col("id").cast("int")).alias("text")), "id").repartition(7)
    vectors, ledger = providers.embedded(texts, lambda log: providers.CompatibleEmbedder("text-embedding-3-small", OfflineTransport(), log=log))
    assert {r["id"]: r["embedding"] for r in vectors.collect()} == {i: [float(i), 0.0] for i in range(250)}
    assert sorted(r["input_tokens"] for r in ledger.collect()) == [250, 500, 500]
    said, ledger = providers.generated(spark.createDataFrame([(1, "a"), (2, None)], "k int, prompt string"), lambda log: providers.CompatibleGenerator("gpt-4o", OfflineTransport(), log=log), "s")
    assert {r["k"]: r["reply"] for r in said.collect()} == {1: "1 characters", 2: "0 characters"} and ledger.count() == 2


def test_reply_parts(spark):
    reply = Stub().post("chat/completions", {})
    assert providers.reply_message(reply) == ("assistant", "STUB REPLY")
    assert providers.reply_usage(reply) == {"prompt_tokens": 11, "completion_tokens": 7, "total_tokens": 18} and providers.reply_usage({"usage": None}) == {}
    row = providers.replies(spark.createDataFrame([(1, json.dumps(reply)), (2, "broken"), (3, '{"choices": []}')], "k int, reply string")).collect()
    assert [(r["id"], r["role"], r["message"], r["output_tokens"]) for r in row] == [("chatcmpl-stub", "assistant", "STUB REPLY", 7), (None, None, "", 0), (None, None, "", 0)]


def test_providers(spark):
    class Counting(providers.EmbeddingProvider):
        calls = 0

        def embed(self, texts):
            self.calls += 1
            return [[float(len(t))] for t in texts]

    p = Counting()
    assert len(providers.in_requests(p.embed, ["x"] * 250)) == 250 and p.calls == 3
    assert providers.in_requests(p.embed, []) == [] and p.calls == 3
    with pytest.raises(ValueError):
        providers.in_requests(lambda texts: [], ["a"])
    assert providers.in_order([(2, [2.0]), (0, [0.0]), (1, [1.0])]) == [[0.0], [1.0], [2.0]]
    df = providers.with_embeddings(spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string"), Counting)
    assert {r["id"]: r["embedding"] for r in df.collect()} == {1: [3.0], 2: [0.0]}
    assert providers.connection("embedding", "ollama", conf.Settings(ollama_base_url="http://b:1/")) == ("http://b:1/v1", providers.KEYLESS)
    with pytest.raises(ValueError):
        providers.connection("generation", "voyage", conf.Settings())
    with pytest.raises(conf.MissingSettingError):
        providers.connection("embedding", "openai", conf.Settings())
    with pytest.raises(ValueError):
        providers.model_for("generation", "gemini")
    assert providers.model_for("embedding", "openai") == "text-embedding-3-small"
    assert providers.reply_text([{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]) == "ab"


def test_tokens_and_encodings(spark):
    df = spark.createDataFrame([("Hello, wörld 12345", "gpt-4o-mini"), (None, "gpt-4"), ("日本 語!", "new-model")], "t string, m string")
    got = df.select(T.approximate_tokens(F.col("t")).alias("n"), T.encoding_for_model(F.col("m")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(5, "o200k_base"), (0, "cl100k_base"), (3, "o200k_base")]
