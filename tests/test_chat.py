"""Logged completions, resumed conversations and summaries with a stub provider."""

from __future__ import annotations

import pytest

from tidemark.operators import chat, search
from tidemark.sources.conversation_store import ConversationStore
from tidemark.plans.offline import PER_PROMPT, OfflineTransport
from tidemark.sources import providers
from tidemark.sources.configuration import Settings
from tidemark.sources.providers import GenerationProvider, HashEmbedder


class Echo(GenerationProvider):
    def __init__(self, reply="reply"):
        self.reply, self.seen = reply, []

    def generate(self, system, user):
        self.seen.append((system, user))
        return self.reply


def test_log_of_a_conversation(spark, tmp_path):
    store = ConversationStore(spark, str(tmp_path / "log"))
    talk = chat.Chat(Echo(), store, clock=lambda: 1_700_000_000)
    assert talk.with_system_role([{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi"}]) == "reply"
    talk.complete("more")
    loaded = store.load(talk.ref_id)
    assert [(m["role"], m["content"]) for m in loaded["messages"]] == [("system", "be brief"), ("user", "hi"), ("assistant", "reply"), ("user", "more"), ("assistant", "reply")]
    assert [tuple(r) for r in store.index.collect()] == [(talk.ref_id, "2023-11-14 22:13:20")]
    assert store.messages.where("chat_id = 'system-init'").count() == 1 and store.orphans().count() == 0
    assert sorted(r["id"] for r in store.messages.collect()) == [1, 2, 3, 4, 5]
    assert not store.insert_index(talk.ref_id, 0)
    again = chat.Chat(Echo("later"), store)
    again.complete("go on", loaded)
    assert again.ref_id == talk.ref_id and store.ids().count() == 1
    assert again.provider.seen[0][1].endswith("user: go on") and again.provider.seen[0][0] == "be brief"
    fixed = [{"role": "user", "content": "as it is"}]
    again.complete("ignored", fixed)
    assert again.provider.seen[-1] == ("", "as it is")
    assert store.load("nobody") == {"ref_id": "nobody", "messages": []}


def test_interactive_chat(spark, tmp_path):
    store = ConversationStore(spark, str(tmp_path / "log"))
    lines, shown = iter(["hi", "more", "exit", "never"]), []
    talk = chat.Chat(Echo(), store)
    said = talk.interactive("be brief", read=lambda _: next(lines), write=shown.append)
    assert [m["role"] for m in said] == ["system", "user", "assistant", "user", "assistant"] and shown == ["reply"] * 2
    assert store.load(talk.ref_id)["messages"] == said and store.ids().count() == 1

    def ended(_):
        raise EOFError

    assert chat.Chat(Echo(), store).interactive(loaded=store.load(talk.ref_id), read=ended) == said
    with pytest.raises(ValueError):
        talk.interactive()


def test_prompts():
    echo = Echo()
    assert chat.summarise(echo, "Sum up", "text") == "reply" and echo.seen == [(chat.SUMMARY_PROMPT, "Sum up: text")]
    assert chat.search_phrase(Echo('```json\n{"Subject or topics": "solar"}\n```'), "What about solar?") == "solar"
    assert chat.search_phrase(Echo("no json"), "What about solar?") == "What about solar?"


def test_a_question_is_rewritten_and_searched(spark):
    texts = ["river boats", "mountain paths", "river fish", None]
    rows = [(i, t, HashEmbedder(16).embed([t or ""])[0]) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "id bigint, text string, embedding array<double>")
    phrase, hits = chat.rewritten_search(search.FrameEngine(corpus), Echo('{"Subject or topics": "river boats"}'), HashEmbedder(16).embed, "Which boats go on the river?", 1)
    assert phrase == "river boats" and [r["id"] for r in hits.collect()] == [0]
    questions = spark.createDataFrame([(7, "mountain paths"), (8, "river fish"), (9, None)], "id bigint, question string")
    make = lambda log: providers.make_provider("generation", "ollama", Settings(), "llama3", log, OfflineTransport())
    found = chat.rewritten_searches(questions, corpus, make, lambda log: HashEmbedder(16, log=log), 1).collect()
    assert {(r["id"], r["phrase"], r["dst"]) for r in found} == {(7, "mountain paths", 1), (8, "river fish", 2)}


def test_a_corpus_is_summarised(spark):
    make = lambda log: providers.make_provider("generation", "ollama", Settings(), "llama3", log, OfflineTransport())
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (2, None, "y")], "id bigint, text string, prompt_id string")
    rows, uses = chat.summaries(df, make, "Sum")
    assert sorted((r["id"], r["summary"]) for r in rows.collect()) == [(1, "8 characters"), (2, "5 characters"), (2, "5 characters")] and rows.columns == ["id", "text", "prompt_id", "summary"]
    assert sorted(r["input_tokens"] for r in uses.collect()) == [PER_PROMPT] * 3
    assert chat.summaries(df.limit(0), make, "Sum")[0].count() == 0
