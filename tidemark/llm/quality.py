"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import remainder, sampling_weights, training_rows
from tidemark.llm.shared import sliced, texts_of
from tidemark.llm.trees import BoostedTrees

#: Labelled rows of each class that the trees are fitted on, at most.
TRAIN_PER_CLASS = 6000
FOLDS, HELD = 4, 2
THRESHOLD = 0.7

UPPER, LOWER, DIGITS = range(65, 91), range(97, 123), range(48, 58)
STOPS, SHOUTS, BARS, MARKS = b".,;:?", b"!", b"|", b"#$%&*@^~_=+<>\\/"
BRACKETS = b"()[]{}\"'`-"
STATISTICS = (
    "bytes words lines upper digits stops shouts bars marks brackets beyond_ascii blanks word_length word_spread longest_word "
    "distinct_words top_word repeated_next distinct_pairs capitalised single_letters ends_in_stop ends_in_mark distinct_lines line_words"
).split()


def statistics(text: str) -> list[float]:
    """The STATISTICS of one text; all but the first three are shares, means or ratios.

    A text without words has its bytes (as a logarithm, like any other) and its share of blanks, and zeros for the rest.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        out = [0.0] * len(STATISTICS)
        out[0], out[STATISTICS.index("blanks")] = np.log1p(len(raw)), sum(raw.count(bytes([c])) for c in (9, 10, 13, 32)) / max(len(raw), 1)
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    marks = MARKS.decode()
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        np.log1p(len(lines)),
        seen[UPPER].sum() / max(seen[UPPER].sum() + seen[LOWER].sum(), 1e-9),
        seen[DIGITS].sum(),
        *(seen[list(group)].sum() for group in (STOPS, SHOUTS, BARS, MARKS, BRACKETS)),
        seen[128:].sum(),
        seen[[9, 10, 13, 32]].sum(),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        sum(w[0].isupper() for w in words) / n,
        (lengths == 1).mean(),
        sum(ends[c] for c in ".,;:!?") / n,
        sum(ends[c] for c in marks) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
    ]


def _statistics_in_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> BoostedTrees:
    """Trees fitted on at most `per_class` labelled rows of each class outside the held-out fold.

    Each class is weighed to its share of all labelled ids outside the fold by shifting the base of the scores, so
    that a score stays a probability although the sample takes the rarer class whole. Without labels every score is 0.5.
    """
    rows = training_rows(docs, labels, "quality", FOLDS, HELD, per_class).mapInArrow(_statistics_in_arrow, "x array<double>, label int").collect()
    y = np.array([r["label"] for r in rows], np.float64)
    model = BoostedTrees().fit(np.array([r["x"] for r in rows], np.float64).reshape(-1, len(STATISTICS)), y)
    if len(y):
        weights = sampling_weights(labels, "quality", FOLDS, HELD, per_class)
        model.base += float(np.log((y.sum() * weights[1] + 1.0) / ((len(y) - y.sum()) * weights[0] + 1.0)) - np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)))
    return model


def score_quality(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text); other columns are ignored.

    Scores depend on the text alone, whole however long. Null and empty texts get the score of all-zero statistics; repeated rows stay;
    an empty table gives no rows; a null doc_id stays null and is not held out. Without labels every score is 0.5.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.predict(x))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
