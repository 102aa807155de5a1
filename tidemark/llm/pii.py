"""Personal data by weak supervision.

Fixed patterns give base spans and further candidates. Five labelers (format, gazetteer, context, checksum and
boundary) vote for, against or abstain on each candidate. How often each combination of votes occurs over all documents
is counted; expectation-maximisation on these counts estimates how reliable each labeler is for each kind, and the
resulting probabilities train the final span classifier, a logistic regression on the votes and on traits of the span
that no labeler looks at. Base spans always stay; the classifier adds candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import sliced, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn", "iban")
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELERS, CHECKSUM = 5, 3
#: Traits of a span, each one of three values (see traits).
TRAITS, NO_TRAITS = 3, (1, 1, 1)
ACCEPT = 0.5
#: Characters before a candidate in which the context labeler looks for cues.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7} ?[A-Z0-9]{1,4}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?([A-Za-z0-9+/_-]{8,})")
_SECRET_WORDS = ("password", "passwd", "secret", "token", "key")
_SPOKEN = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\])[ ]?[A-Za-z0-9-]+(?:[ ]?(?:\(dot\)|\[dot\]|\.)[ ]?[A-Za-z0-9-]+)+")

# Gazetteers and cues of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at be us ca au jp cn in br ru pl se no fi dk pt".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 98".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "35", "6011", "65", "22", "23", "24", "25", "26", "27")
CUES = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login from", "adresse"),
    "card": ("card", "visa", "master", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "appel", "llame"),
    "secret": ("password", "passwd", "secret", "token", "key"),
    "ssn": ("ssn", "social security", "security number"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
}
AGAINST = ("version", "release", "isbn", "issn", "page", "figure", "section", "chapter", "volume", "build", "doi")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain in linear time: from each @ the local part reaches back to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers: each longest dotted chain holds one for every four of its parts."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            ends = [m.start() - 1, *(m.start() + i for i, c in enumerate(m.group()) if c == "."), m.end()]
            for i in range(0, len(ends) - 4, 4):
                yield ends[i] + 1, ends[i + 4]


def _quad_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in s.split("."))


def _iban_ok(s: str) -> bool:
    bare = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the IBAN pattern, each up to its last group with which the check holds: what follows may look like a group.

    Where the check holds for none, the whole match is given and the next may begin within it.
    """
    at = 0
    while m := _IBAN.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == " ")]
        end = next((e for e in ends if _iban_ok(text[m.start() : e])), None)
        yield m.start(), end or m.end()
        at = end or m.start() + 2


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, start, end and whether the check holds, of every leftmost non-overlapping match of the four base patterns."""
    found = [("email", a, b, True) for a, b in _emails(text)]
    if "." in text:
        found += [("ip", a, b, _quad_ok(text[a:b])) for a, b in _quads(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits):
                found.append(("card", m.start(), m.end(), len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        found += [("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15) for m in _PHONE.finditer(text)]
    return found


def further_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Matches of the looser patterns, which count only if the classifier accepts them."""
    low = text.lower() if text.isascii() else None
    if any(w in (low or text) for w in _SECRET_WORDS) or low is None:
        yield from (("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text))
    if "-" in text:
        yield from (("ssn", m.start(), m.end()) for m in _SSN.finditer(text))
    yield from (("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text))
    yield from (("iban", a, b) for a, b in _ibans(text))
    if ("(" in text or "[" in text) and ("(at)" in (low := low or text.lower()) or "[at]" in low):
        yield from (("email", m.start(), m.end()) for m in _SPOKEN.finditer(text))


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the five labelers say: 1 for, -1 against, 0 nothing."""
    s, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - CONTEXT) : start].lower()
    if kind == "email":
        domain = re.split(r"\.|\(dot\)|\[dot\]", s.lower())[-1].strip()
        shape = 1 if domain.isalpha() and len(domain) >= 2 else -1
        listed = 1 if domain in TOP_DOMAINS else -1
        sound = 1 if not s.startswith((".", "-")) and ".." not in s and len(s) <= 254 else -1
    elif kind == "ip":
        parts = s.split(".")
        shape = 1 if all(p == "0" or not p.startswith("0") for p in parts) else -1
        listed = -1 if parts[0] in ("0", "127") or len(parts[0]) > 3 else 1
        sound = 1 if _quad_ok(s) else -1
    elif kind == "card":
        shape = 1 if len(digits) in (13, 14, 15, 16, 19) and (s == digits or re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4,6}){2,4}", s)) else -1
        listed = 1 if digits.startswith(CARD_STARTS) else -1
        sound = 1 if len(digits) <= 19 and luhn(digits) else -1
    elif kind == "phone":
        shape = 1 if re.fullmatch(r"\+?[0-9 ]{0,4}\(?[0-9]{2,4}\)?[ .-][0-9 .-]{5,12}", s) else 0
        listed = 0 if not s.startswith("+") else 1 if any(digits[:n] in CALLING_CODES for n in (1, 2)) else -1
        sound = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    elif kind == "secret":
        shape = 1 if len(s) >= 12 else -1
        listed = 1 if any(c.isdigit() for c in s) else -1
        sound = 1 if len(set(s)) >= 7 and not s.isalpha() else -1
    elif kind == "ssn":
        shape = 1
        listed = -1 if s[:3] in ("000", "666") or s[0] == "9" else 1
        sound = -1 if s[4:6] == "00" or s[7:] == "0000" else 1
    else:
        bare = s.replace(" ", "")
        shape = 1 if 15 <= len(bare) <= 34 else -1
        listed = 0
        sound = 1 if _iban_ok(s) else -1
    context = 1 if any(c in before for c in CUES[kind]) else -1 if any(c in before for c in AGAINST) else 0
    beside = text[start - 1 : start] + text[end : end + 1]
    bounded = -1 if any(c.isalnum() or c in "_@/" for c in beside) else 1
    return shape, listed, context, sound, bounded


def traits(text: str, start: int, end: int) -> tuple[int, ...]:
    """How long a span is, how much of it is digits, and what stands before it: three values each."""
    n = end - start
    digits = sum("0" <= c <= "9" for c in text[start:end])
    before = text[max(0, start - 4) : start].rstrip(" \t\"'")
    return (n >= 12) + (n >= 24), (3 * digits >= n) + (3 * digits >= 2 * n), 2 if before.endswith((":", "=")) else 1 if not before or before[-1].isalnum() else 0


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """kind, start, end, whether it is a base span, votes of all base matches and further candidates.

    Further candidates that touch a base span, or an earlier further candidate whose check holds, are left out; what
    fails its check is never accepted, so it keeps nothing out. An IBAN whose check holds stays although some of its
    digits happen to be a base span. Two maps with a byte a character say what is taken, so the time is linear in the
    text and its spans.
    """
    out = [(k, a, b, ok, votes(text, k, a, b)) for k, a, b, ok in base_matches(text)]
    taken = inner = None
    for k, a, b in further_candidates(text):
        if taken is None:
            taken, inner = bytearray(len(text) + 1), bytearray(len(text) + 1)
            for _, x, y, ok, _ in out:
                if ok:
                    taken[x:y], inner[x + 1 : y] = b"\1" * (y - x), b"\1" * (y - x - 1)
        v = votes(text, k, a, b)
        free = taken.find(1, a, b) < 0
        if free or k == "iban" and v[CHECKSUM] > 0 and not inner[a] and not inner[b]:
            out.append((k, a, b, False, v))
            if v[CHECKSUM] >= 0:
                taken[a:b], inner[a + 1 : b] = b"\1" * (b - a), b"\1" * (b - a - 1)
    return out


class SpanClassifier:
    """Reliabilities by expectation-maximisation on counted votes, then a logistic regression on votes and traits.

    `patterns` counts (kind, votes, traits); where traits are left out they count as NO_TRAITS.
    """

    def __init__(self, patterns: dict[tuple, int], rounds: int = 50) -> None:
        self.reliability: dict[str, np.ndarray] = {}
        self.weights: dict[str, np.ndarray] = {}
        for kind in KINDS:
            seen = [(k[1], k[2] if len(k) > 2 else NO_TRAITS, n) for k, n in sorted(patterns.items()) if k[0] == kind]
            if seen:
                v, t, n = np.array([x for x, _, _ in seen]), np.array([x for _, x, _ in seen]), np.array([c for *_, c in seen], float)
                self.weights[kind] = self._regression(self.features(v, t), n, self._expectation(kind, v, n, rounds))

    def _expectation(self, kind: str, v: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
        """P(personal) of each vote pattern; table[c, l, x + 1] is how often labeler l says x on class c."""
        p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
        said = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)
        # A few imagined candidates keep each labeler better than chance, so the classes cannot swap.
        imagined = np.repeat(np.array([[[1.0, 1.0, 4.0]], [[4.0, 1.0, 1.0]]]), LABELERS, axis=1)
        imagined[:, CHECKSUM] = [[0.5, 1.0, 8.0], [12.0, 1.0, 0.5]]
        for _ in range(rounds):
            classes = np.stack([p, 1 - p]) * n
            table = np.einsum("cp,plx->clx", classes, said) + imagined
            table /= table.sum(2, keepdims=True)
            prior = (classes.sum(1) + 1) / (n.sum() + 2)
            like = np.log(prior)[:, None] + np.einsum("clx,plx->cp", np.log(table), said)
            p = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        self.reliability[kind] = table
        return p

    @staticmethod
    def features(v: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.concatenate([v == 1, v == -1, np.ones((len(v), 1), bool), t == 0, t == 2], axis=1).astype(float)

    def _regression(self, x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        w, weight = np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1e6)
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w + np.clip(np.linalg.solve(hess, x.T @ (weight * (p - q)) - 0.1 * w), -2, 2)
        return w

    def accepts(self, kind: str, v: tuple[int, ...], t: tuple[int, ...] = NO_TRAITS) -> bool:
        """Whether a candidate with these votes and traits is personal data; never against the checksum's vote."""
        if kind not in self.weights or v[CHECKSUM] < 0:
            return False
        score = float((self.features(np.array([v]), np.array([t])) @ self.weights[kind])[0])
        return 1 / (1 + np.exp(-np.clip(score, -500, 500))) >= ACCEPT


def fit_pii(docs: DataFrame) -> SpanClassifier:
    """Counts the patterns of all candidates in all documents (at most 7 * 3^5 * 3^3 patterns reach the driver) and fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text in texts_of(batch):
                counts.update((k, v, traits(text, a, b)) for k, a, b, _, v in candidates(text))
        rows = list(counts.items())
        names = ["kind", "votes", "traits", "n"]
        columns = [pa.array([k for (k, _, _), _ in rows], pa.string()), *(pa.array([list(k[i]) for k, _ in rows], pa.list_(pa.int32())) for i in (1, 2)), pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    counted = docs.select("text").mapInArrow(run, "kind string, votes array<int>, traits array<int>, n bigint").groupBy("kind", "votes", "traits").agg(F.sum("n").alias("n"))
    return SpanClassifier({(r["kind"], tuple(r["votes"]), tuple(r["traits"])): r["n"] for r in counted.collect()})


def spans_of(text: str, model: SpanClassifier) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text as (start, number of the kind, end), in order."""
    base, every, known = [], [], {}
    for kind, a, b, ok, v in candidates(text):
        if ok:
            base.append((a, ORDER[kind], b))
            every.append((a, ORDER[kind], b))
            continue
        said = kind, v, traits(text, a, b)
        if said not in known:
            known[said] = model.accepts(*said)
        if known[said]:
            every.append((a, ORDER[kind], b))
    return sorted(base), sorted(every)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """doc_id, base and spans (lists of kind, start, end in code points) for every row of `docs` (doc_id, text), as text.

    Null and empty texts have none; repeated rows stay; an empty table gives no rows; a null doc_id stays null; other
    columns are ignored. Time is linear in a text's length, however long its words are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [spans_of(t, model) for t in texts_of(batch)]
            counts = [[sum(k == i for _, k, _ in b) for b, _ in found] for i in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([listed(e) for _, e in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def redacted(text: str, model: SpanClassifier) -> str:
    """The text with each span (spans that overlap count as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in spans_of(text, model)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_pii(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """`docs` with the personal data of `text` replaced by its kind in brackets; all other columns pass through.

    Whole texts of any length; null texts stay null, empty ones empty; repeated rows stay; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pa.array([t if t is None else redacted(t, model) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
