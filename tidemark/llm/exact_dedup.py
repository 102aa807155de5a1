"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations alone.

Each task that reads documents makes a run: one row for each digest it has seen, in the order of digests, with the
identifier that stays and the number of rows. Runs are numbered 0 to P - 1, P a power of two. In a round, the FAN runs
whose numbers differ in one digit exchange their rows, each row going to the run that has the digest's own digit there,
and the up to FAN rows of a digest are merged; after as many rounds as numbers have digits, every digest is in one run.
A digest that a third of all rows have is one row a run from the first merge on, and a merge never has more than FAN
rows of it. What counts as one digest is verified at every level: SHA-256, XXH64 and length in bytes must all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_classes, materialise

#: Bits of one digit of a run's number: 16 runs exchange in a round.
FAN_BITS = 4
#: Runs at most: the digits of a digest that rounds use.
MOST_BITS = 20
KEYS = ["digest", "check", "bytes"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z alone lower-cased; null is empty. Texts of ASCII alone take the quick way."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def digest_rows(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (a number of its own, or the given one), digest, check and bytes of every row of `docs`."""
    number = F.monotonically_increasing_id() if row is None else row
    text = docs.select("doc_id", number.alias("row"), normalised(F.col("text")).alias("t"))
    return text.select("doc_id", "row", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").alias("bytes"))


def merged(rows: DataFrame, bits: int) -> DataFrame:
    """digest, check, bytes, keep (doc_id, row) and size: one row for each digest of `rows`, by rounds of merges.

    The identifier that stays is the largest doc_id, null the smallest of all, and of rows that repeat it the one with
    the greatest number. `bits` is the number of bits of a run's number.
    """
    runs = rows.select(F.shiftright("row", 33).bitwiseAND(F.lit((1 << bits) - 1)).alias("run"), *KEYS, F.struct("doc_id", "row").alias("keep"), F.lit(1).cast("bigint").alias("size"))
    for at in range(0, max(bits, 1), FAN_BITS):
        digit = ((1 << min(FAN_BITS, bits - at)) - 1) << at if bits else 0
        there = F.col("run").bitwiseAND(F.lit(((1 << bits) - 1) & ~digit)).bitwiseOR(F.col("check").bitwiseAND(F.lit(digit)))
        runs = runs.withColumn("run", there).groupBy("run", *KEYS).agg(F.max("keep").alias("keep"), F.sum("size").alias("size"))
    return runs.select(*KEYS, "keep", "size")


def run_bits(docs: DataFrame) -> int:
    """Bits that number as many runs as the session has shuffle partitions."""
    return min((int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), MOST_BITS)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text); other columns are ignored.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and empty texts are a group.
    Whole texts of any length are read, once; what is shuffled is some 60 bytes a row. Of equal texts the largest
    doc_id stays; a null doc_id only where all are null; of rows that repeat doc_id and text, one stays. An empty table
    gives no rows.
    """
    rows = materialise(digest_rows(docs), "digest_rows")
    groups = materialise(merged(rows, run_bits(docs)), "digest_groups")
    found = join_classes(rows, groups.withColumn("group_size", F.col("size")), KEYS)
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_duplicates keeps, with all columns, whatever their names; an empty table stays empty.

    Rows are written once with a number; digests decide on numbers, and the numbers that go are taken out by an
    anti-join, for which Spark sends them to the rows while they are few.
    """
    rows = materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept_row"), F.monotonically_increasing_id().alias("number")), "numbered_docs")
    digests = materialise(digest_rows(rows.select("kept_row.doc_id", "kept_row.text", "number"), F.col("number")), "digest_rows")
    groups = materialise(merged(digests, run_bits(docs)), "digest_groups")
    gone = join_classes(digests, groups, KEYS).where(F.col("row") != F.col("keep.row")).select(F.col("row").alias("number"))
    return rows.join(gone, "number", "left_anti").select("kept_row.*")


#: The same in DuckDB's dialect, where no doc_id is null or repeated.
SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
