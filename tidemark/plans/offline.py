"""A transport that answers without a network, so that the registered queries can ask providers."""

from __future__ import annotations

#: Tokens that its embeddings report for a text, and its completions for a prompt and a reply.
PER_TEXT, PER_PROMPT, PER_REPLY = 5, 11, 7


class OfflineTransport:
    """Embeds a text as its length and its number of blanks, last one first; completes with the prompt's length."""

    def post(self, path: str, body: dict) -> dict:
        if path == "embeddings":
            data = [{"index": i, "embedding": [float(len(t)), float(t.count(" "))]} for i, t in enumerate(body["input"])]
            return {"data": data[::-1], "usage": {"prompt_tokens": PER_TEXT * len(data)}}
        said = body["messages"][-1]["content"]
        return {"id": "offline", "choices": [{"message": {"role": "assistant", "content": f"{len(said)} characters"}}], "usage": {"prompt_tokens": PER_PROMPT, "completion_tokens": PER_REPLY}}

    def get(self, path: str) -> dict:
        return {"data": [{"id": "offline-b"}, {"id": "offline-a"}]}
