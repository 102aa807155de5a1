"""Completions with a log, summaries and the analysis of a question, over a provider of generated text."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.conversations import SYSTEM_ROW
from tidemark.operators.positions import with_position
from tidemark.operators.search import SearchEngine, nearest_neighbours, query_vector
from tidemark.sources.conversation_store import ConversationStore
from tidemark.sources.providers import EmbeddingProvider, GenerationProvider, UsageLog, embedded, generated
from tidemark.tables import materialise

SUMMARY_PROMPT = (
    "You summarise the text that the user gives. Recognise its structure, find its topics, events and key phrases, and tell "
    "them in as many paragraphs as that takes. Add nothing from outside the text. Answer in the language of the request."
)
ENTITIES_PROMPT = (
    "You summarise the text that the user gives and then list the people, organisations, places and dates in it, each with what "
    "the text says about it. Add nothing from outside the text. Answer in the language of the request."
)
SENTENCE_PROMPT = 'Answer with a JSON object that has the keys "Language", "Input request" and "Subject or topics" for the sentence the user gives.'

Message = dict[str, str]


def _flat(messages: list[Message]) -> tuple[str, str]:
    """Messages as the system text and the rest, for providers that take two strings."""
    system = "\n".join(m["content"] for m in messages if m["role"] == "system")
    rest = [m for m in messages if m["role"] != "system"]
    return system, rest[0]["content"] if len(rest) == 1 else "\n".join(f"{m['role']}: {m['content']}" for m in rest)


class Chat:
    """Completions of one conversation, logged as they happen.

    A user row goes in before the index row, which is written once; a dict of loaded messages resumes its conversation
    and gets the prompt appended; a list is sent as it is.
    """

    def __init__(self, provider: GenerationProvider, store: ConversationStore, clock: Callable[[], float] = time.time) -> None:
        self.provider, self.store, self.clock = provider, store, clock
        self.ref_id = store.new_id()
        self._indexed = False

    def with_system_role(self, messages: list[Message]) -> str:
        """A completion of messages that begin with a system role; the system row is logged too."""
        self.store.insert_messages(self.ref_id, [(SYSTEM_ROW, m["role"], m["content"]) for m in messages if m["role"] == "system"])
        return self._complete(messages, messages[-1]["content"])

    def complete(self, prompt: str, messages: dict | list[Message] | None = None) -> str:
        if isinstance(messages, dict):
            self.ref_id, self._indexed = messages["ref_id"], True
            messages = [*messages["messages"], {"role": "user", "content": prompt}]
        return self._complete(messages or [{"role": "user", "content": prompt}], prompt)

    def interactive(self, prompt: str | None = None, loaded: dict | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> list[Message]:
        """Asks and answers line by line until `exit` or the end of input, and gives all messages.

        Begins with `prompt` as the system's role, or resumes `loaded` messages; ValueError where there is neither.
        """
        if prompt is None and loaded is None:
            raise ValueError("an interactive chat needs a prompt or loaded messages")
        if loaded is not None:
            self.ref_id, self._indexed, said = loaded["ref_id"], True, list(loaded["messages"])
        else:
            said = [{"role": "system", "content": prompt}]
            self.store.insert_messages(self.ref_id, [(SYSTEM_ROW, "system", prompt)])
        while True:
            try:
                asked = read("> ")
            except EOFError:
                return said
            if asked == "exit":
                return said
            said.append({"role": "user", "content": asked})
            said.append({"role": "assistant", "content": self._complete(said, asked)})
            write(said[-1]["content"])

    def _complete(self, messages: list[Message], prompt: str) -> str:
        reply, chat_id = self.provider.generate(*_flat(messages)), uuid.uuid4().hex
        self.store.insert_messages(self.ref_id, [(chat_id, "user", prompt)])
        if not self._indexed:
            self.store.insert_index(self.ref_id, int(self.clock()))
            self._indexed = True
        self.store.insert_messages(self.ref_id, [(chat_id, "assistant", reply)])
        return reply


def summarise(provider: GenerationProvider, instruction: str, context: str, system: str = SUMMARY_PROMPT) -> str:
    return provider.generate(system, f"{instruction}: {context}")


def details(reply: str, sentence: str) -> dict:
    """What a reply says of a sentence; one that isn't a JSON object leaves the sentence as its topic."""
    try:
        found = json.loads(reply.strip().removeprefix("```json").strip("`\n "))
    except ValueError:
        found = None
    return found if isinstance(found, dict) else {"Subject or topics": sentence}


def topics(reply: str, sentence: str) -> str:
    return str(details(reply, sentence).get("Subject or topics") or sentence)


def sentence_details(provider: GenerationProvider, sentence: str) -> dict:
    """Language, request and topics of a sentence."""
    return details(provider.generate(SENTENCE_PROMPT, sentence), sentence)


def search_phrase(provider: GenerationProvider, sentence: str) -> str:
    """What to embed for a question: its topics."""
    return topics(provider.generate(SENTENCE_PROMPT, sentence), sentence)


def rewritten_search(engine: SearchEngine, generator: GenerationProvider, embed: Callable[[list[str]], list], question: str, top_k: int = 10, **options: object) -> tuple[str, DataFrame]:
    """The phrase that a question comes down to, and the engine's hits for it: one call to each provider, then one search."""
    phrase = search_phrase(generator, question)
    return phrase, engine.search_query(query_vector(phrase, None, embed), top_k, **options)


def rewritten_searches(questions: DataFrame, corpus: DataFrame, make_generator: Callable[[UsageLog], GenerationProvider], make_embedder: Callable[[UsageLog], EmbeddingProvider], top_k: int = 10) -> DataFrame:
    """id, phrase, rnk, dst, score: for each row of `questions` (id, question) its phrase and the `top_k` nearest rows of `corpus`.

    Phrases are asked for and embedded on the executors; all of them meet the corpus in one batch search. A question
    whose answer is no JSON object is its own phrase, a NULL one is empty; ids must be unique. Questions whose phrase has
    no vector have no hits.
    """

    def phrased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [topics(r, q or "") for r, q in zip(b.column("reply").to_pylist(), b.column("question").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(said, pa.string())], names=["id", "phrase"])

    said = generated(questions.select("id", "question", F.col("question").alias("prompt")), make_generator, SENTENCE_PROMPT)[0]
    phrases = materialise(said.select("id", "reply", "question").mapInArrow(phrased, "id bigint, phrase string"), "phrases")
    vectors = embedded(with_position(phrases.select("id", F.col("phrase").alias("text")), "id"), make_embedder)[0]
    hits = nearest_neighbours(vectors.select("id", "embedding"), corpus.select("id", "embedding"), top_k)
    return phrases.join(hits, phrases["id"] == hits["src"]).select("id", "phrase", "rnk", "dst", "score")


def summaries(texts: DataFrame, make: Callable[[UsageLog], GenerationProvider], instruction: str, system: str = SUMMARY_PROMPT) -> tuple[DataFrame, DataFrame]:
    """`texts` (with a column text) and the `summary` of each, and the ledger of the requests; asked for on the executors.

    NULL counts as empty text; repeated rows are asked for each; an empty table asks for nothing.
    """
    prompts = texts.withColumn("prompt", F.concat(F.lit(f"{instruction}: "), F.coalesce("text", F.lit(""))))
    rows, uses = generated(prompts, make, system)
    return rows.drop("prompt").withColumnRenamed("reply", "summary"), uses
