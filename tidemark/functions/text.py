"""Scalar text functions: slugs, token counts, URLs, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces that stand in for tokens where no vocabulary is at hand: an approximation, not a tokenizer.
PIECES = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"

# Encodings by model, the fallback, and hosts that cannot be off this machine.
ENCODINGS = {"gpt-4o": "o200k_base", "gpt-4.1": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "text-embedding-3": "cl100k_base", "text-embedding-ada-002": "cl100k_base"}
DEFAULT_ENCODING = "o200k_base"
LOOPBACK_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0", "")
DEFAULT_OLLAMA_URL = "http://localhost:11434"


def slugify(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at the ends; `project` where nothing is left."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("project"))


def encoding_for_model(model: Column) -> Column:
    """The encoding of a model by its longest known beginning; unknown models get the fallback."""
    out = None
    for prefix in sorted(ENCODINGS, key=len, reverse=True):
        out = F.when(model.startswith(prefix), ENCODINGS[prefix]) if out is None else out.when(model.startswith(prefix), ENCODINGS[prefix])
    return F.coalesce(out, F.lit(DEFAULT_ENCODING))


def approximate_tokens(text: Column) -> Column:
    """Number of PIECES in a text; NULL has none. Approximate by design."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).cast("bigint")


def url_host(url: Column) -> Column:
    """The host of a URL, with or without a scheme, in lower case; an IPv6 host comes without its brackets."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[^/]*//", ""), "[/?#].*$", "")
    bare = F.regexp_replace(rest, "^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", "")))


def is_loopback(url: Column) -> Column:
    return url_host(url).isin(*LOOPBACK_HOSTS)


def compatible_base_url(base_url: Column) -> Column:
    """The URL under which a local server answers the common protocol: no trailing slashes, then /v1."""
    url = F.coalesce(F.nullif(base_url, F.lit("")), F.lit(DEFAULT_OLLAMA_URL))
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/v1"))


def prompt(instruction: Column, context: Column) -> Column:
    return F.concat(instruction, F.lit(": "), context)


def block_text(blocks: Column) -> Column:
    """The text of a reply in blocks, ARRAY<STRUCT<type, text>>: those of type text, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")


def local_time(epoch: Column) -> Column:
    """Seconds since 1970 as text in the session's time zone."""
    return F.from_unixtime(epoch, "yyyy-MM-dd HH:mm:ss")


def unique_id() -> Column:
    """A random 32-digit hex id for each row."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def vector_from_text(literal: Column) -> Column:
    """A list literal such as `[0.1, -2e-3]` as ARRAY<DOUBLE>; NULL where it isn't one."""
    return F.from_json(literal, "array<double>")
