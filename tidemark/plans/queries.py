"""Queries over the test tables: `embeddings` with `documents` stand for an embedded corpus, `conversations` for a log,
`documents.source` for projects. Every key has its SQL in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.vectors import as_doubles, norm, rounded_cosine_to
from tidemark.operators import accounting as A
from tidemark.operators import conversations as C
from tidemark.operators import locality as L
from tidemark.operators import projects as P
from tidemark.operators import search as S
from tidemark.operators import tokens as K
from tidemark.operators.positions import with_position
from tidemark.operators.sampling import weighted_sample as weighted
from tidemark.plans.offline import OfflineTransport
from tidemark.sources import providers as V
from tidemark.sources.collections import VectorStore, append_points, positional_points, upsert_points
from tidemark.sources.configuration import Settings
from tidemark.sources.conversation_store import ConversationStore
from tidemark.sources.embedding_cache import EmbeddingCache
from tidemark.sources.vectors_csv import checked_embeddings, embedding_frame, numbered_texts, read_embeddings_csv
from tidemark.streaming.usage import read_usage, stream_usage
from tidemark.tables import materialise, new_path
from tidemark.tables import table as read_table

Query = Callable[[SparkSession, str], DataFrame]
CHAT_MODELS = ("gpt-4o", "gpt-4o-mini", "gpt-4.1", "gpt-99-unreleased")
EMBEDDING_MODELS = ("text-embedding-3-large", "text-embedding-3-small", "nomic-embed-text")
#: Texts in one part of a context.
CONTEXT_TEXTS = 20
INSTRUCTION = "Summarise the following passages"
DEFAULTS = {"embedding_model": "text-embedding-3-large", "generation_model": "", "storage_backend": "parquet"}
LIBRARY = {"embedding_model": "text-embedding-3-small", "generation_model": "", "storage_backend": "sqlite"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """id, text, source, embedding for vectors that have a document."""
    e, docs = read(spark, d, "embeddings"), read(spark, d, "documents")
    return e.join(docs, e.vec_id == docs.doc_id).select(F.col("vec_id").alias("id"), "text", "source", as_doubles(F.col("embedding")).alias("embedding"))


def seed_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector all single searches start from; empty, so that it scores nothing, where the table has no vec_id 0."""
    row = read(spark, d, "embeddings").where("vec_id = 0").select(as_doubles(F.col("embedding")).alias("v")).first()
    return list(row["v"] or []) if row else []


def picked(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def ledger(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """A usage ledger from the log: a call a message, its provider and model by the conversation, and `more` columns of the log."""
    c = read(spark, d, "conversations")
    n = T.approximate_tokens(F.col("text"))
    return c.select(
        picked(("openai", "ollama", "openai", "gemini"), F.col("conv_id") % 4).alias("provider"),
        picked(CHAT_MODELS, F.col("conv_id") % 4).alias("model"),
        F.when(F.col("role") == "assistant", F.lit(0)).otherwise(n).cast("bigint").alias("input_tokens"),
        F.when(F.col("role") == "assistant", n).otherwise(F.lit(0)).cast("bigint").alias("output_tokens"),
        (F.col("conv_id") % 4 != 1).alias("billable"),
        (F.col("conv_id") % 7 != 0).alias("counted"),
        *more,
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    chat = F.when(F.col("role") == "system", C.SYSTEM_ROW).otherwise(F.concat(F.lit("chat-"), F.col("turn").cast("string")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("ref_id"), chat.alias("chat_id"), "role", F.col("text").alias("message"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    """A project a source, in code-point order, with an embedding model by its position."""
    sources = with_position(read(spark, d, "documents").select("source").where("source is not null").distinct(), "source")
    return sources.select("position", F.md5("source").alias("id"), T.slugify(F.col("source")).alias("slug"), F.col("source").alias("name"), picked(EMBEDDING_MODELS, F.when(F.col("position") % 5 < 3, F.lit(0)).otherwise(F.col("position") % 3)).alias("embedding_model"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_top_k(corpus(spark, d), seed_vector(spark, d), 10).select("id", "text", "score")


def relatedness_scores(spark: SparkSession, d: str) -> DataFrame:
    seed, e = seed_vector(spark, d), read(spark, d, "embeddings")
    return (e if seed else e.limit(0)).select("vec_id", rounded_cosine_to(as_doubles(F.col("embedding")), seed).alias("relatedness"))


def topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return S.above(corpus(spark, d), seed_vector(spark, d), 0.2).select("id", "score")


def embedding_frame_query(spark: SparkSession, d: str) -> DataFrame:
    v = embedding_frame(read(spark, d, "embeddings"), ["embedding"])
    return v.select(F.size("embedding").cast("bigint").alias("width"), F.round(norm(as_doubles(F.col("embedding"))), 6).alias("norm"))


def csv_embedding_parse(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, written to CSV as list literals and scanned again."""
    path = new_path(spark, "csv")
    read(spark, d, "embeddings").select("vec_id", F.to_json(as_doubles(F.col("embedding"))).alias("embedding")).write.csv(path, header=True, escape='"')
    e = read_embeddings_csv(spark, path, ["embedding"])
    return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").cast("bigint").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("embedding"), F.col("label"))


def collection_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All points as a collection, into which those of one label go again, numbered from 0."""
    p = _points(spark, d)
    new = with_position(p.where("label = 3").select(F.col("id").alias("origin"), "embedding"), "origin", name="id")
    old = p.select("id", F.col("id").alias("origin"), "embedding")
    return upsert_points(old, new.select("id", "origin", "embedding")).select("id", "origin", F.round(norm(F.col("embedding")), 6).alias("norm"))


def collection_append(spark: SparkSession, d: str) -> DataFrame:
    """All points as a collection, after which all of them go again."""
    p = _points(spark, d)
    old = p.select("id", F.col("id").alias("origin"))
    new = with_position(p.select(F.col("id").alias("origin")), "origin", name="id").select("id", "origin")
    return append_points(old, new, old.count())


def payload_join(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and their labels, each numbered on its own, as points with a payload."""
    e = read(spark, d, "embeddings")
    vectors = with_position(e.select("vec_id", as_doubles(F.col("embedding")).alias("embedding")), "vec_id")
    labels = with_position(e.select("vec_id", "label"), "vec_id")
    points = positional_points(vectors, labels.select("position", "label"))
    return points.select("id", F.col("payload")["label"].alias("label"), F.size("embedding").cast("bigint").alias("width"))


def collection_count(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).agg(F.count("*").alias("points"))


def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).groupBy(F.col("label").cast("string").alias("collection")).agg(F.lit("main").alias("vector_name"), F.max(F.size("embedding")).cast("bigint").alias("size"), F.lit("Cosine").alias("distance"), F.count("*").alias("points"))


def collection_search(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_top_k(_points(spark, d).where("label = 3"), seed_vector(spark, d), 10).select("id", "score")


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return S.nearest_neighbours(c, c, 5)


def walk(threshold: float, initial: bool, depth: int = 50) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return S.similarity_walk(corpus(spark, d), seed_vector(spark, d), depth=depth, score_threshold=threshold, score_based_on_initial_query=initial)

    return query


def similarity_walks(spark: SparkSession, d: str) -> DataFrame:
    """A walk from every twentieth document that has a vector, all at once."""
    c = corpus(spark, d)
    return S.similarity_walks(c, c.where("id % 20 = 0").select(F.col("id").alias("walk"), "embedding"), score_threshold=0.25)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.approximate_tokens(F.col("text")).alias("tokens"))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(spark, d).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def embedding_cost(spark: SparkSession, d: str) -> DataFrame:
    models = A.prices(spark).where("output_price is null").select("model", "input_price", F.lit(1).alias("k"))
    total = token_counts(spark, d).agg(F.sum("tokens").alias("tokens")).withColumn("k", F.lit(1))
    return total.join(models, "k").select("model", "tokens", F.round(A.cost(F.col("tokens"), F.col("input_price")), 10).alias("cost"))


def prompt_cost(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", picked(CHAT_MODELS, F.col("conv_id") % 4).alias("model"), T.approximate_tokens(F.col("text")).alias("tokens"))
    return A.with_prices(c).select("conv_id", "turn", "model", "tokens", F.round(A.cost(F.col("tokens"), F.col("input_price")), 10).alias("cost"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """The models that the log's calls and the projects use."""
    return ledger(spark, d).select("model").union(projects(spark, d).select("embedding_model")).distinct()


def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.with_prices(_models(spark, d)).select("model", "input_price", "output_price", T.encoding_for_model(F.col("model")).alias("encoding"))


def priced_models(spark: SparkSession, d: str) -> DataFrame:
    """The priced ones of the models in use, by name."""
    return A.priced_models(spark).join(_models(spark, d), "model", "left_semi").orderBy("model")


def vocabulary_path() -> str:
    """The rank file of a public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def exact_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.exact_token_counts(read(spark, d, "documents").select("doc_id", "text"), K.read_ranks(vocabulary_path())).select("doc_id", "tokens")


def exact_corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return K.exact_corpus_tokens(read(spark, d, "documents").select("text"), K.read_ranks(vocabulary_path()))


def exact_embedding_cost(spark: SparkSession, d: str) -> DataFrame:
    """What embedding all documents costs with each model, by exact counts."""
    models = A.prices(spark).where("output_price is null").select("model", "input_price")
    return models.crossJoin(exact_corpus_tokens(spark, d).select("tokens")).select("model", "tokens", F.round(A.cost(F.col("tokens"), F.col("input_price")), 10).alias("cost"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    return A.embedding_batches(with_position(token_counts(spark, d), "doc_id"))


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_totals(ledger(spark, d))


def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_by_model(ledger(spark, d))


def usage_record_costs(spark: SparkSession, d: str) -> DataFrame:
    costs = A.with_record_cost(ledger(spark, d))
    return costs.groupBy("model", "billable", F.col("cost").isNull().alias("unpriced")).agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost"), 8).alias("cost"))


def usage_unpriced(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_totals(ledger(spark, d)).select("unpriced_calls")


def usage_uncounted(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_totals(ledger(spark, d)).select("uncounted_calls")


def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_summary(ledger(spark, d))


def conversation_messages(spark: SparkSession, d: str) -> DataFrame:
    return C.transcript(C.load_messages(messages(spark, d)))


def conversation_index(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), (F.col("conv_id") * 60 + 1_700_000_000).alias("epoch"))
    return C.append_index(spark.createDataFrame([("0", "2023-11-14 00:00:00")], C.INDEX), new)


def conversation_resume(spark: SparkSession, d: str) -> DataFrame:
    return C.transcript(C.load_messages(messages(spark, d), "1"))


def conversation_append(spark: SparkSession, d: str) -> DataFrame:
    log = messages(spark, d)
    new = log.where("role = 'user'").select("ref_id", F.concat(F.lit("again-"), F.col("id").cast("string")).alias("chat_id"), "role", "message", F.col("id").alias("at"))
    return C.append_messages(log, new, "at").select("id", "ref_id", "chat_id", "role")


def conversation_orphans(spark: SparkSession, d: str) -> DataFrame:
    index = messages(spark, d).where("cast(ref_id as int) % 3 <> 0").select(F.col("ref_id").alias("id")).distinct()
    return C.orphans(messages(spark, d), index).select("id", "ref_id", "role")


def distinct_refs(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("ref_id").distinct()


def context_concat(spark: SparkSession, d: str) -> DataFrame:
    """The first fifth of the texts of each source, whole and in order, joined by spaces in parts of CONTEXT_TEXTS texts.

    Ids are numbered first, without texts, to find the last of each fifth; then only texts up to it are moved. Places
    within a source come from places in a whole table, so a source with a third of all rows is never one task's.
    """
    docs = read(spark, d, "documents").where("text is not null and source is not null")
    ids = with_position(docs.select("source", "doc_id"), "source", "doc_id")
    sources = ids.groupBy("source").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    fifth = F.floor(F.col("n") / 5)
    last = materialise(ids.join(sources, "source").where(F.col("position") - F.col("first") == fifth - 1).select("source", F.col("doc_id").alias("last"), fifth.alias("fifth")), "context_ends")
    head = with_position(docs.join(last, "source").where("doc_id <= last").select("source", "doc_id", "text", "fifth"), "source", "doc_id")
    firsts = materialise(head.groupBy("source").agg(F.min("position").alias("first")), "context_starts")
    place = F.col("position") - F.col("first")
    parts = head.join(firsts, "source").where(place < F.col("fifth")).withColumn("part", F.floor(place / CONTEXT_TEXTS))
    rows = parts.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("rows"))
    return rows.select("source", "part", F.array_join(F.transform("rows", lambda x: x["text"]), " ").alias("context"))


def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    hits = S.cosine_top_k(corpus(spark, d), seed_vector(spark, d), 5)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "text")))
    return hits.agg(F.concat(F.array_join(F.transform(rows, lambda x: x["text"]), "\n"), F.lit("\n")).alias("context"))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    made = retrieved_context(spark, d).select(T.prompt(F.lit(INSTRUCTION), F.col("context")).alias("prompt"))
    return made.select("prompt", T.approximate_tokens(F.col("prompt")).alias("tokens"))


def nonnull_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "source")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


def settings_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d).select(
        "slug",
        F.when(F.col("position") % 2 == 0, F.col("embedding_model")).otherwise("").alias("embedding_model"),
        F.when(F.col("position") % 3 == 0, "gpt-4o").alias("generation_model"),
        F.when(F.col("position") % 4 == 0, "sqlite").otherwise("").alias("storage_backend"),
    )
    return P.resolved_settings(p, DEFAULTS, LIBRARY)


def model_majority(spark: SparkSession, d: str) -> DataFrame:
    return P.majority_model(projects(spark, d))


def project_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return P.exclusions(P.select_projects(projects(spark, d)))


def selection_notice(spark: SparkSession, d: str) -> DataFrame:
    return P.selection_notice(P.select_projects(projects(spark, d)))


def _scored(rows: DataFrame, seed: list[float]) -> DataFrame:
    """project, id, score of the rows (source, id, embedding) that have a score."""
    return rows.withColumn("score", rounded_cosine_to(F.col("embedding"), seed)).where("score is not null").select("project", "id", "score")


def cross_project(limit: int | None) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        selected = P.select_projects(projects(spark, d)).where("included")
        rows = S.of_projects(corpus(spark, d).withColumn("project", T.slugify(F.col("source"))), selected)
        return S.merge_project_hits(_scored(rows, seed_vector(spark, d)), selected, limit)

    return query


def cross_project_query(spark: SparkSession, d: str) -> DataFrame:
    """A callable searches each included project for its best; excluded ones are never asked."""
    seed = seed_vector(spark, d)
    rows = corpus(spark, d).withColumn("project", T.slugify(F.col("source")))

    def best(slug: str) -> DataFrame:
        return S.cosine_top_k(rows.where(F.col("project") == slug), seed, 10).select("id", "score")

    return S.search_projects(projects(spark, d), best, limit=25)[0].select("project", "id", "score")


def cross_project_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The same for all projects in one pass."""
    rows = corpus(spark, d).withColumn("project", T.slugify(F.col("source")))
    return S.top_k_by_project(rows, P.select_projects(projects(spark, d)).where("included"), seed_vector(spark, d), 10, 25)


def registry_register(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    return P.register(p, p.where("position % 4 = 0").withColumn("embedding_model", F.lit("changed"))).select("id", "slug", "embedding_model")


def registry_find(spark: SparkSession, d: str) -> DataFrame:
    return P.find(projects(spark, d), "src3").select("id", "slug", "embedding_model")


def registry_unregister(spark: SparkSession, d: str) -> DataFrame:
    return P.unregister(projects(spark, d), "src3").select("id", "slug")


def urls(spark: SparkSession, d: str) -> DataFrame:
    """page_id and url: the addresses of the pages, some of them moved to this host or bare of a scheme."""
    path = F.regexp_replace("url", "^[a-z]*://[^/]*", "")
    return read(spark, d, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("http://localhost:11434"), path))
        .when(F.col("page_id") % 6 == 1, F.concat(F.lit("127.0.0.1:"), F.col("page_id").cast("string")))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit("http://[::1]/"), F.col("page_id").cast("string"), F.lit("//")))
        .when(F.col("page_id") % 6 == 3, F.upper("url"))
        .when(F.col("page_id") % 30 == 4, F.lit(""))
        .otherwise(F.col("url"))
        .alias("url"),
    )


def locality_audit(spark: SparkSession, d: str) -> DataFrame:
    """A configuration a page: its providers by the page's number, its server at the page's address."""
    u, i = urls(spark, d), F.col("page_id")
    roles = (
        ("embedding", picked(("openai", "gemini", "voyage", "ollama", "sentence-transformers"), i % 5), F.when(i % 7 == 1, "models/bge")),
        ("generation", picked(("openai", "gemini", "ollama", "anthropic"), i % 4), F.when(i % 7 == 2, "llama3")),
    )
    rows = [u.select(i.cast("string").alias("config"), F.lit(role).alias("role"), provider.alias("provider"), model.alias("model"), F.col("url").alias("base_url")) for role, provider, model in roles]
    return L.audit(rows[0].unionByName(rows[1]))


def loopback_hosts(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("page_id", T.is_loopback(F.col("url")).alias("is_loopback"))


def base_url(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("page_id", T.compatible_base_url(F.col("url")).alias("base_url"))


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = with_position(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return V.embedded(texts, lambda log: V.make_provider("embedding", "openai", Settings(openai_api_key="offline"), log=log, transport=OfflineTransport()))


def provider_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """All documents embedded in requests of a hundred."""
    return _embedded(spark, d)[0].select(F.col("id").alias("doc_id"), F.col("embedding")[0].alias("characters"), F.col("embedding")[1].alias("blanks"))


def provider_usage(spark: SparkSession, d: str) -> DataFrame:
    """What those requests cost, from the ledger that the provider wrote."""
    return A.usage_totals(_embedded(spark, d)[1])


def _generated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    make = lambda log: V.make_provider("generation", "ollama", Settings(), "llama3", log, OfflineTransport())
    return V.generated(asked, make, INSTRUCTION)


def provider_replies(spark: SparkSession, d: str) -> DataFrame:
    """A reply to each message of a user."""
    return _generated(spark, d)[0].select("conv_id", "turn", "reply")


def provider_replies_usage(spark: SparkSession, d: str) -> DataFrame:
    """What the replies cost: a local backend isn't billed, but counted."""
    return A.usage_totals(_generated(spark, d)[1])


def completion_fields(spark: SparkSession, d: str) -> DataFrame:
    """Completions, kept as JSON, taken apart into id, role, message and counts."""
    c = read(spark, d, "conversations")
    message = F.struct("role", F.col("text").alias("content"))
    usage = F.when(F.col("turn") % 2 == 0, F.struct(F.lit(11).alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))
    raw = F.to_json(F.struct(F.concat(F.lit("chatcmpl-"), F.col("conv_id").cast("string")).alias("id"), F.array(F.struct(message.alias("message"))).alias("choices"), usage.alias("usage")))
    return V.replies(c.select("conv_id", "turn", raw.alias("reply"))).drop("reply")


def reply_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The text of replies in blocks of several types, one a conversation's message."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    c = read(spark, d, "conversations")
    blocks = F.array(block("thinking", F.col("role")), block("text", F.col("text")), block("text", F.lit(".")))
    return c.select("conv_id", "turn", T.block_text(blocks).alias("reply"))


def model_list(spark: SparkSession, d: str) -> DataFrame:
    """The models that each provider of the log has answered with, in the order of their names."""
    return A.models_by_provider(ledger(spark, d))


def connections(spark: SparkSession, d: str) -> DataFrame:
    """Where each backend is reached, its model where none is asked for, and how many calls of the log went there."""
    every = Settings(openai_api_key="k", gemini_api_key="k", voyage_api_key="k", anthropic_api_key="k", ollama_base_url="http://box:1/")
    rows = [(role, b[0], V.connection(role, b[0], every)[0], V.connection(role, b[0], every)[1] == V.KEYLESS, b[5]) for role, known in L.BACKENDS.items() for b in known]
    calls = ledger(spark, d).groupBy("provider").agg(F.count("*").alias("calls"))
    known = spark.createDataFrame(rows, "role string, provider string, base_url string, keyless boolean, model string")
    return known.join(calls, "provider", "left").withColumn("calls", F.when(F.col("role") == "generation", F.coalesce("calls", F.lit(0))))


def text_load(spark: SparkSession, d: str) -> DataFrame:
    """All texts, numbered as an embedding run would number them."""
    return numbered_texts(read(spark, d, "documents"), "text", "doc_id")


def _named_points(spark: SparkSession, d: str) -> DataFrame:
    """Every vector twice over: as it is, and with its components in reverse order."""
    p = _points(spark, d)
    return p.select("id", F.col("embedding").alias("main"), F.reverse("embedding").alias("turned"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"))


def _width(spark: SparkSession, d: str) -> int:
    row = read(spark, d, "embeddings").select(F.size("embedding")).first()
    return row[0] if row else 1


def collection_store(spark: SparkSession, d: str) -> DataFrame:
    """A collection of all vectors, into which those of one label go again from 0 and those of another after the last; one beside it made and deleted."""
    p, store = _points(spark, d), VectorStore(spark, new_path(spark, "store"))
    store.create("kept", _width(spark, d))
    store.create("gone", 3)
    store.upsert("kept", p)
    for label, put in ((3, store.upsert), (4, store.append)):
        put("kept", with_position(p.where(F.col("label") == label).select(F.col("id").alias("origin"), "embedding"), "origin", name="id").select("id", "embedding"))
    store.delete("gone")
    info, names = store.info("kept"), ",".join(store.collections())
    return store.points("kept").select("id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.lit(info["size"]).cast("bigint").alias("size"), F.lit(store.count("kept")).cast("bigint").alias("points"), F.lit(names).alias("collections"))


def collection_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest points by an index of cells, with their payload."""
    store = VectorStore(spark, new_path(spark, "store"))
    store.create("c", _width(spark, d))
    store.upsert("c", _named_points(spark, d).select("id", F.col("main").alias("embedding"), "payload"))
    store.build_index("c")
    return store.search(seed_vector(spark, d), 10, "c").select("id", "score", F.col("payload")["label"].alias("label"))


def collection_named_search(spark: SparkSession, d: str) -> DataFrame:
    """The best points by a weighted sum over two named vectors."""
    store, seed = VectorStore(spark, new_path(spark, "store")), seed_vector(spark, d)
    store.create("c", {"main": _width(spark, d), "turned": _width(spark, d)})
    store.upsert("c", _named_points(spark, d))
    store.build_index("c")
    return store.indexed_search("c", {"main": seed, "turned": seed}, 10, {"main": 0.75, "turned": 0.25})[0].select("id", "score")


def conversation_store(spark: SparkSession, d: str) -> DataFrame:
    """The log written to a store in two goes, its index too, one conversation told twice, and read."""
    store, c = ConversationStore(spark, new_path(spark, "log")), messages(spark, d).withColumn("conv", F.col("ref_id").cast("bigint"))
    for odd in (0, 1):
        part = c.where(F.col("conv") % 2 == odd).select("ref_id", "chat_id", "role", "message", F.col("id").alias("at"))
        store.append_messages(part, "at")
        store.append_index(c.where((F.col("conv") % 2 == odd) | (F.col("conv") == 0)).select(F.col("ref_id").alias("id"), (F.col("conv") * 60).alias("epoch")))
    of_chat = store.messages.join(store.index.select(F.col("id").alias("ref_id"), "created_at"), "ref_id")
    return of_chat.select("id", "ref_id", "role", "message", "created_at", (F.col("chat_id") == C.SYSTEM_ROW).alias("is_setup"))


def conversation_parts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts in parts of three messages."""
    return C.transcript_parts(messages(spark, d), 3)


def literal_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as list literals, some of them spoilt: what parses, and what is set aside as it came."""
    i, said = F.col("vec_id"), F.to_json(as_doubles(F.col("embedding")))
    spoilt = F.when(i % 7 == 0, F.expr("substring(said, 1, char_length(said) - 1)")).when(i % 11 == 0, F.concat(F.lit("x"), F.col("said"))).when(i % 13 == 0, F.lit("[1.0, null]")).when(i % 17 == 0, F.lit(None)).otherwise(F.col("said"))
    rows = read(spark, d, "embeddings").select("vec_id", said.alias("said")).select("vec_id", spoilt.alias("literal"))
    good, bad, seen = checked_embeddings(rows, ["literal"])
    told = good.select("vec_id", F.lit(True).alias("good"), F.size("literal").cast("bigint").alias("width"), F.lit(None).cast("string").alias("begins"))
    told = told.unionByName(bad.select("vec_id", F.lit(False).alias("good"), F.lit(None).cast("bigint").alias("width"), F.substring("literal", 1, 1).alias("begins")))
    return told.withColumn("malformed", F.lit(seen["malformed"]).cast("bigint"))


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty texts a source, drawn by their length."""
    docs = read(spark, d, "documents").where("text is not null")
    return weighted(docs, "source", "doc_id", F.char_length("text"), 20, seed=7).select("source", "doc_id")


def _cached(spark: SparkSession, d: str, goes: int) -> tuple[DataFrame, list[DataFrame]]:
    cache = EmbeddingCache(spark, new_path(spark, "cache"), "small")
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    make = lambda log: V.make_provider("embedding", "openai", Settings(openai_api_key="offline"), log=log, transport=OfflineTransport())
    runs = [cache.embedded(texts, make) for _ in range(goes)]
    return runs[-1][0], [uses for _, uses in runs]


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """All documents embedded through a cache: their vectors as a second run finds them."""
    return _cached(spark, d, 2)[0].select(F.col("id").alias("doc_id"), F.col("embedding")[0].alias("characters"), F.col("embedding")[1].alias("blanks"))


def embedding_cache_usage(spark: SparkSession, d: str) -> DataFrame:
    """What the first run and the second cost: a text is asked for once."""
    first, second = (A.usage_totals(uses).withColumn("run", F.lit(i)) for i, uses in enumerate(_cached(spark, d, 2)[1], 1))
    return first.unionByName(second).select("run", "calls", "input_tokens")


def usage_stream(spark: SparkSession, d: str) -> DataFrame:
    """The ledger replayed as a stream, every call told twice over, summed by hour and model."""
    calls = new_path(spark, "calls")
    when = F.col("conv_id") * 60 + F.col("turn") + 1_700_000_000
    said = ledger(spark, d, (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.timestamp_seconds(when).alias("at"))
    for at in range(3):  # three files of a stream, each with a third of the calls and half of those before
        said.where((F.col("call_id") % 3 == at) | ((F.col("call_id") % 3 < at) & (F.col("call_id") % 2 == 0))).coalesce(1).write.mode("append").parquet(calls)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(calls)
    path = new_path(spark, "usage")
    stream_usage(stream, path, new_path(spark, "usage_checkpoint"), "3650 days").awaitTermination()
    totals = read_usage(spark, path)
    return totals.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "model", "calls", "input_tokens", "output_tokens", F.round("estimated_cost", 8).alias("estimated_cost"), "unpriced_calls", "uncounted_calls")


def conversation_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of an index made from the log."""
    new = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.lit(0).cast("bigint").alias("epoch"))
    return C.append_index(spark.createDataFrame([], C.INDEX), new).select("id")


def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    """A fresh id for each document: its digits, and whether it is none of the ids of the log."""
    made = read(spark, d, "documents").select("doc_id", T.unique_id().alias("unique_id"))
    taken = conversation_ids(spark, d).select(F.col("id").alias("unique_id"))
    return made.join(taken, "unique_id", "left_anti").select("doc_id", F.length("unique_id").alias("digits"), F.col("unique_id").rlike("^[0-9a-f]+$").alias("hex"))


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """What is sure of a sample of fifty documents with a text: how many, how many different, how many of the table."""
    texts = read(spark, d, "documents").where("text is not null")
    sample = texts.orderBy(F.rand(7)).limit(50).select("doc_id")
    known = sample.join(texts.select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left")
    return known.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("different"), F.count("known").alias("known"))


def queries() -> dict[str, Query]:
    plain = (
        cosine_topk, relatedness_scores, topk_threshold, csv_embedding_parse, collection_upsert, collection_append, collection_count, collection_info, collection_search, collection_indexed_search, collection_named_search, batch_knn, similarity_walks,
        token_counts, corpus_tokens, embedding_cost, exact_token_counts, exact_corpus_tokens, exact_embedding_cost, prompt_cost, price_lookup, priced_models, embed_batches, usage_totals, usage_by_model, usage_record_costs, usage_unpriced, usage_uncounted, usage_summary,
        conversation_messages, conversation_index, conversation_resume, conversation_append, conversation_orphans, distinct_refs, context_concat, retrieved_context, prompt_assembly, nonnull_text,
        settings_resolution, model_majority, project_exclusions, selection_notice, registry_register, registry_find, registry_unregister, locality_audit, loopback_hosts, base_url, unique_ids, random_sample, cross_project_query, cross_project_top_k,
        payload_join, reply_blocks, model_list, connections, text_load, collection_store, conversation_store, conversation_ids, conversation_parts, literal_quarantine, weighted_sample, embedding_cache, embedding_cache_usage, usage_stream,
        provider_embeddings, provider_usage, provider_replies, provider_replies_usage, completion_fields,
    )
    named = {"embedding_frame": embedding_frame_query, "slugify": slugs, "cross_project_merge": cross_project(None), "cross_project_limit": cross_project(25)}
    walks = {"similarity_walk": walk(0.25, False), "similarity_walk_initial": walk(0.0, True), "similarity_walk_threshold": walk(0.33, False)}
    return {f.__name__: f for f in plain} | named | walks
