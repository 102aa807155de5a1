"""The conversation log as two Parquet tables that grow by appended files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import unique_id
from tidemark.operators import conversations as C
from tidemark.operators.positions import with_position
from tidemark.tables import file_names, write_once


#: Times that a writer tries to claim ids before it gives up.
ATTEMPTS = 20


class ConversationStore:
    """Index and messages below `root`; both exist, empty, from the start. Failed writes raise.

    Writers claim the ids of their messages before they write them, so that none are given twice; the ids of a write that
    failed stay unused.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in (("index", C.INDEX), ("messages", C.MESSAGES)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(C.INDEX).parquet(f"{self.root}/index")

    @property
    def messages(self) -> DataFrame:
        return self.spark.read.schema(C.MESSAGES).parquet(f"{self.root}/messages")

    def ids(self) -> DataFrame:
        return self.index.select("id")

    def new_id(self) -> str:
        """A random id that the index doesn't hold."""
        fresh = self.spark.range(4).select(unique_id().alias("id")).join(self.ids(), "id", "left_anti").first()
        return fresh["id"] if fresh else uuid.uuid4().hex

    def insert_index(self, ref_id: str, epoch: int) -> bool:
        """Adds a conversation; False, and no change, if it is there."""
        if self.ids().where(F.col("id") == ref_id).head(1):
            return False
        new = self.spark.createDataFrame([(ref_id, epoch)], "id string, epoch bigint")
        C.append_index(self.spark.createDataFrame([], C.INDEX), new).coalesce(1).write.mode("append").parquet(f"{self.root}/index")
        return True

    def _claim(self, n: int) -> int:
        """The first of n ids that no other writer has: the next claim after the last, whose file only one writer can make."""
        folder = f"{self.root}/claims"
        for _ in range(ATTEMPTS):
            made = [int(x) for x in file_names(self.spark, folder) if x.isdigit()]
            if made:
                first = int(self.spark.read.text(f"{folder}/{max(made)}").first()["value"]) + 1
            else:
                first = self.messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
            try:
                write_once(self.spark, f"{folder}/{max(made, default=0) + 1}", str(first + n - 1))
            except FileExistsError:
                continue
            return first
        raise RuntimeError(f"no claim in {ATTEMPTS} attempts: too many writers at once")

    def insert_messages(self, ref_id: str, rows: Sequence[tuple[str, str, str]]) -> None:
        """Adds (chat_id, role, message) rows of a conversation, numbered on from the log's last id."""
        first = self._claim(len(rows))
        new = [(first + i, ref_id, *row) for i, row in enumerate(rows)]
        self.spark.createDataFrame(new, C.MESSAGES).coalesce(1).write.mode("append").parquet(f"{self.root}/messages")

    def append_index(self, new: DataFrame) -> None:
        """Adds the conversations of a table (id, epoch) that the index doesn't hold yet."""
        C.append_index(self.index, new).join(self.ids(), "id", "left_anti").write.mode("append").parquet(f"{self.root}/index")

    def append_messages(self, new: DataFrame, *order: str) -> None:
        """Adds a table of messages (ref_id, chat_id, role, message), numbered on from the log's last id in the given order."""
        numbered = with_position(new, *order, name="id", start=self._claim(new.count()))
        numbered.select("id", "ref_id", "chat_id", "role", "message").write.mode("append").parquet(f"{self.root}/messages")

    def load(self, ref_id: str) -> dict:
        """{ref_id, messages: [{role, content}]}, to resume a conversation with."""
        row = C.load_messages(self.messages, ref_id).first()
        return {"ref_id": ref_id, "messages": [m.asDict() for m in row["messages"]] if row else []}

    def orphans(self) -> DataFrame:
        return C.orphans(self.messages, self.index)
