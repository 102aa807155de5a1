"""Providers of embeddings and generated text, called in Arrow batches on the executors, and the record of their use.

Hosted and local servers are reached through a Transport, which posts JSON and gives the reply; any object with its two
methods can stand in, so tests and offline runs inject their own.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import DEFAULT_OLLAMA_URL
from tidemark.operators import accounting
from tidemark.operators.accounting import BATCH
from tidemark.operators.locality import BACKENDS
from tidemark.sources.configuration import ENVIRONMENT, MissingSettingError, Settings
from tidemark.tables import materialise

# End points that speak the common protocol, the key of backends that need none, and a reply's ceiling.
BASE_URLS = {"gemini": "https://generativelanguage.googleapis.com/v1beta/openai/", "voyage": "https://api.voyageai.com/v1"}
OPENAI_URL, ANTHROPIC_URL, ANTHROPIC_VERSION = "https://api.openai.com/v1", "https://api.anthropic.com/v1", "2023-06-01"
KEYLESS, MOST_REPLY_TOKENS = "not-needed", 16000


class Use(NamedTuple):
    """What one request consumed: a row of accounting.LEDGER. Uncounted: the backend reports no tokens."""

    provider: str
    model: str
    input_tokens: int = 0
    output_tokens: int = 0
    billable: bool = True
    counted: bool = True


class UsageLog:
    """The uses of a run in the order of the requests; its sums are those of the ledger operators."""

    def __init__(self, uses: list[Use] | None = None) -> None:
        self.uses = list(uses or [])

    def append(self, use: Use) -> None:
        self.uses.append(use)

    def __iter__(self) -> Iterator[Use]:
        return iter(self.uses)

    def __len__(self) -> int:
        return len(self.uses)

    def ledger(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.uses, accounting.LEDGER)

    def summary(self, spark: SparkSession) -> str:
        return accounting.usage_summary(self.ledger(spark)).first()["summary"]


class Transport:
    """JSON over HTTP below a base URL."""

    def __init__(self, base_url: str, headers: dict[str, str], timeout: float = 120.0) -> None:
        self.base_url, self.headers, self.timeout = base_url.rstrip("/"), headers, timeout

    def _ask(self, path: str, body: bytes | None) -> dict:
        request = urllib.request.Request(f"{self.base_url}/{path}", body, {"content-type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def post(self, path: str, body: dict) -> dict:
        return self._ask(path, json.dumps(body).encode())

    def get(self, path: str) -> dict:
        return self._ask(path, None)


class Provider:
    """What all providers share: a name, a model, perhaps a transport, and where uses are noted."""

    name = ""
    billable = True
    lists_models = False

    def __init__(self, model: str = "", transport: Transport | None = None, log: UsageLog | None = None) -> None:
        self.model, self.transport, self.log = model, transport, log

    def note(self, tokens_in: int | None, tokens_out: int = 0) -> None:
        """Notes a request; None: the reply had no counts."""
        if self.log is not None:
            self.log.append(Use(self.name, self.model, tokens_in or 0, tokens_out, self.billable, tokens_in is not None))

    def list_models(self) -> list[str]:
        """Names of the models that the backend offers, sorted."""
        if not self.lists_models or self.transport is None:
            raise NotImplementedError(f"{self.name or type(self).__name__} can't list its models")
        return sorted(m["id"] for m in self.transport.get("models")["data"])


class EmbeddingProvider(Provider, ABC):
    """One vector for each text, in order."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GenerationProvider(Provider, ABC):
    @abstractmethod
    def generate(self, system: str, user: str) -> str: ...


class HashEmbedder(EmbeddingProvider):
    """Deterministic vectors from hashed words, for tests and offline use."""

    name, billable = "hash", False

    def __init__(self, width: int = 64, model: str = "hash", log: UsageLog | None = None) -> None:
        super().__init__(model, log=log)
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.width)
        for w in text.lower().split():
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % self.width] += 1 if d[4] & 1 else -1
        return v.tolist()


def _counts(reply: dict, into: str, out: str) -> tuple[int | None, int]:
    usage = reply.get("usage")
    return (None, 0) if usage is None else (usage.get(into) or 0, usage.get(out) or 0)


class CompatibleEmbedder(EmbeddingProvider):
    """The common protocol's embeddings: requests of at most `size` texts, replies put in order by their index."""

    def __init__(self, model: str, transport: Transport, name: str = "openai", billable: bool = True, lists_models: bool = True, size: int = BATCH, log: UsageLog | None = None) -> None:
        super().__init__(model, transport, log)
        self.name, self.billable, self.lists_models, self.size = name, billable, lists_models, size

    def _request(self, texts: list[str]) -> list[list[float]]:
        reply = self.transport.post("embeddings", {"model": self.model, "input": texts})
        self.note(_counts(reply, "prompt_tokens", "")[0])
        return in_order([(d["index"], d["embedding"]) for d in reply["data"]])

    def embed(self, texts: list[str]) -> list[list[float]]:
        return in_requests(self._request, texts, self.size)


class CompatibleGenerator(GenerationProvider):
    """The common protocol's chat completions."""

    def __init__(self, model: str, transport: Transport, name: str = "openai", billable: bool = True, lists_models: bool = True, log: UsageLog | None = None) -> None:
        super().__init__(model, transport, log)
        self.name, self.billable, self.lists_models = name, billable, lists_models

    def generate(self, system: str, user: str) -> str:
        reply = self.transport.post("chat/completions", {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]})
        self.note(*_counts(reply, "prompt_tokens", "completion_tokens"))
        return reply_message(reply)[1]


class AnthropicGenerator(GenerationProvider):
    """The messages protocol: the system text apart, and a reply in blocks."""

    name, lists_models = "anthropic", True

    def __init__(self, model: str, transport: Transport, most_tokens: int = MOST_REPLY_TOKENS, log: UsageLog | None = None) -> None:
        super().__init__(model, transport, log)
        self.most_tokens = most_tokens

    def generate(self, system: str, user: str) -> str:
        reply = self.transport.post("messages", {"model": self.model, "max_tokens": self.most_tokens, "system": system, "messages": [{"role": "user", "content": user}]})
        self.note(*_counts(reply, "input_tokens", "output_tokens"))
        return reply_text(reply["content"])


class LocalEmbedder(EmbeddingProvider):
    """An encoder in this process: all texts in one call, neither billed nor counted.

    `encoder` has encode(texts); where none is given, the model is loaded with an optional package.
    """

    name, billable = "sentence-transformers", False

    def __init__(self, model: str, encoder: object | None = None, log: UsageLog | None = None) -> None:
        super().__init__(model, log=log)
        if encoder is None:
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model)
        self.encoder = encoder

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        vectors = self.encoder.encode(texts)
        self.note(None)
        return [[float(x) for x in v] for v in vectors]


def in_requests(request: Callable[[list[str]], list[list[float]]], texts: list[str], size: int = BATCH) -> list[list[float]]:
    """Vectors from requests of at most `size` texts, in order; no texts, no request."""
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        part = request(texts[at : at + size])
        if len(part) != len(texts[at : at + size]):
            raise ValueError("the provider returned another number of vectors than it was given texts")
        out += part
    return out


def in_order(indexed: list[tuple[int, list[float]]]) -> list[list[float]]:
    """The vectors of a reply that numbers them, by number."""
    return [v for _, v in sorted(indexed, key=lambda x: x[0])]


def reply_text(blocks: list[dict]) -> str:
    """The text of a reply made of blocks: those of type text, joined."""
    return "".join(b.get("text", "") for b in blocks if b.get("type") == "text")


def reply_message(reply: dict) -> tuple[str, str]:
    """Role and text of a completion's first choice; no text is empty."""
    message = reply["choices"][0]["message"]
    return message["role"], message.get("content") or ""


def reply_usage(reply: dict) -> dict[str, int]:
    """The counts that a completion reports, without those it leaves open; empty where it reports none."""
    return {k: v for k, v in (reply.get("usage") or {}).items() if v is not None}


def replies(df: DataFrame, column: str = "reply") -> DataFrame:
    """`df` with a column of completions (JSON) taken apart: id, role, message, input_tokens, output_tokens."""
    parsed = F.from_json(column, "id string, usage struct<prompt_tokens: bigint, completion_tokens: bigint>, choices array<struct<message: struct<role: string, content: string>>>")
    said, usage = F.get(F.col("__r.choices"), 0)["message"], F.col("__r.usage")
    parts = {"id": F.col("__r.id"), "role": said["role"], "message": F.coalesce(said["content"], F.lit("")), "input_tokens": F.coalesce(usage["prompt_tokens"], F.lit(0)), "output_tokens": F.coalesce(usage["completion_tokens"], F.lit(0))}
    return df.withColumn("__r", parsed).select(*(c for c in df.columns if c not in parts), *(v.alias(k) for k, v in parts.items()))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"


def with_embeddings(df: DataFrame, make: Callable[[], EmbeddingProvider], text: str = "text", column: str = "embedding") -> DataFrame:
    """`df` with a vector for each text. `make` runs once a task on an executor, so clients and models are never sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            vectors = in_requests(provider.embed, [t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, column])

    return df.mapInArrow(run, _schema(df, f"`{column}` array<double>"))


USE = "struct<" + accounting.LEDGER.replace(" ", ": ").replace(",: ", ", ") + ">"


def embedded(texts: DataFrame, make: Callable[[UsageLog], EmbeddingProvider], size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, position, embedding) of `texts` (id, position from 0, text), and the ledger of the requests for them.

    A request holds the `size` texts of one stretch of positions, however the table is partitioned, so what was asked
    and what it cost is the same in every run. `make` gets the log of its group. Vectors and uses are written once.
    """
    kind = "position bigint, id bigint, embedding array<double>, uses array<" + USE + ">"
    names = [f.split()[0] for f in accounting.LEDGER.split(", ")]

    def ask(group: pa.Table) -> pa.Table:
        group, log = group.sort_by("position"), UsageLog()
        vectors = make(log).embed([t or "" for t in group.column("text").to_pylist()])
        noted = [dict(zip(names, u, strict=True)) for u in log]
        uses = pa.array([noted, *[[]] * (group.num_rows - 1)], pa.list_(pa.struct([(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)])))
        return pa.table([group.column("position"), group.column("id"), pa.array(vectors, pa.list_(pa.float64())), uses], names=["position", "id", "embedding", "uses"])

    batch = F.floor(F.col("position") / size).alias("__batch")
    rows = materialise(texts.select("position", "id", "text", batch).groupBy("__batch").applyInArrow(ask, kind), "embedded")
    return rows.select("id", "position", "embedding"), rows.select(F.explode("uses").alias("u")).select("u.*")


def generated(prompts: DataFrame, make: Callable[[UsageLog], GenerationProvider], system: str) -> tuple[DataFrame, DataFrame]:
    """Replies (the columns of `prompts` and reply) to a column `prompt`, and the ledger of the requests, written once."""
    names = [f.split()[0] for f in accounting.LEDGER.split(", ")]
    use = pa.struct(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = UsageLog()
        provider = make(log)
        for b in batches:
            said, uses = [], []
            for p in b.column("prompt").to_pylist():
                done = len(log)
                said.append(provider.generate(system, p or ""))
                uses.append([dict(zip(names, u, strict=True)) for u in log.uses[done:]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(uses, pa.list_(use))], names=[*b.schema.names, "reply", "__uses"])

    rows = materialise(prompts.mapInArrow(run, _schema(prompts, f"reply string, `__uses` array<{USE}>")), "generated")
    return rows.drop("__uses"), rows.select(F.explode("__uses").alias("u")).select("u.*")


def connection(role: str, provider: str, settings: Settings) -> tuple[str | None, str]:
    """Base URL (None: the protocol's own) and key for a provider; ValueError for one that isn't known for the role."""
    known = {b[0]: b for b in BACKENDS[role]}
    if provider not in known:
        raise ValueError(f"unknown {role} provider {provider!r}; known: {', '.join(sorted(known))}")
    _, _, key_setting, _, served, *_ = known[provider]
    url = f"{(settings.ollama_base_url or DEFAULT_OLLAMA_URL).rstrip('/')}/v1" if served else BASE_URLS.get(provider)
    if key_setting is None:
        return url, KEYLESS
    if not getattr(settings, key_setting):
        raise MissingSettingError(ENVIRONMENT[key_setting], f"the {provider} provider needs it")
    return url, getattr(settings, key_setting)


def model_for(role: str, provider: str, asked: str | None = None, settings: Settings | None = None) -> str:
    """The model asked for, else the settings', else the backend's own; ValueError where none is chosen."""
    own = getattr(settings, {"embedding": "openai_embedding_model", "generation": "openai_gpt_model"}[role]) if settings else ""
    model = asked or own or next((b[5] for b in BACKENDS[role] if b[0] == provider), None)
    if not model:
        raise ValueError(f"choose a model for {provider}")
    return model


def make_provider(role: str, provider: str, settings: Settings, model: str | None = None, log: UsageLog | None = None, transport: Transport | None = None, encoder: object | None = None) -> Provider:
    """The provider of a role ("embedding", "generation") by its name, ready to ask.

    `transport` (or, for an encoder in this process, `encoder`) takes the place of the real one. Errors are those of
    connection and model_for. Call it on executors, within `make` of the operators above.
    """
    url, key = connection(role, provider, settings)
    kind, local, lists = next((b[1], b[3], b[6]) for b in BACKENDS[role] if b[0] == provider)
    chosen = model_for(role, provider, model, settings)
    if kind == "sentence-transformers":
        return LocalEmbedder(chosen, encoder, log)
    if kind == "anthropic":
        return AnthropicGenerator(chosen, transport or Transport(ANTHROPIC_URL, {"x-api-key": key, "anthropic-version": ANTHROPIC_VERSION}), log=log)
    made = CompatibleEmbedder if role == "embedding" else CompatibleGenerator
    return made(chosen, transport or Transport(url or OPENAI_URL, {"authorization": f"Bearer {key}"}), provider, not local, lists, log=log)
