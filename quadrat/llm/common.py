"""Shared plumbing: rows that a second scan finds again, joins without skew."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import rank_within  # noqa: F401
from ..storage import Scratch, file_system, shared_dir  # noqa: F401

#: Words of the text contracts: runs of characters other than these ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Type of place().
AT = "struct<file:long,row:long>"
#: A key is hot if it has more than one in so many rows.
HOT = 1000
#: What a Python worker keeps for the next task, by operator.
_kept: dict[str, dict] = {}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A row number unique in the table, so that repeated doc_ids and nulls stay apart.

    Another scan may number the rows otherwise: store what it gives before it is used twice. Rows that
    a second scan has to find again are told by place().
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _from_files(docs: DataFrame) -> bool:
    """Whether docs is no more than chosen rows and columns of Parquet files."""
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size():
        if node.children().size() > 1 or not node.deterministic() or node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        node = node.children().apply(0)
    if not node.nodeName().startswith(("Relation", "LogicalRelation")):
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:  # files of another format
        return False
    return True


def rooted(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs, if each of its rows can be found again in a second scan, else a stored copy."""
    return docs if _from_files(docs) else scratch.table(docs, "given")


def place(docs: DataFrame) -> Column:
    """Where a row of docs (as rooted() gives it) is stored: its file, as 88 bits of hashes of the path, and its number in the file.

    It is the same in every scan, however files are cut into tasks.
    """
    about = docs.metadataColumn("_metadata")
    low = F.shiftleft(F.hash(about["file_path"]).cast("long"), 40) + about["row_index"]
    return F.struct(F.xxhash64(about["file_path"]).alias("file"), low.alias("row"))


def pick_rows(docs: DataFrame, places: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs (rooted) by place (places: _at); how is left_semi or left_anti."""
    name = fresh(docs, "_at")
    return docs.select("*", place(docs).alias(name)).join(places.select(F.col("_at").alias(name)), name, how).select(*docs.columns)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """many joined with one, a stored table with a row for each value of keys and how many rows of many have it (count).

    Keys with more than a thousandth of all rows are fewer than a thousand, so that their rows of one
    may be broadcast: rows of a hot key are joined where they are, only the others are shuffled.
    """
    total = one.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT > total
    hot = one.filter(is_hot)
    if not hot.limit(1).count():
        return many.join(one.drop(count), keys)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.filter(~is_hot).drop(count), keys)
    return many.join(F.broadcast(hot.drop(count)), keys).unionByName(rest)


def kept(owner: str) -> dict:
    """What tasks of an operator leave for the next one in the same Python worker; a task of another operator clears it."""
    return _kept.setdefault(owner, {})


def hand_back() -> None:
    """Give memory that allocators hold but don't use back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, owner: str = "") -> Callable:
    """run, a function for mapInArrow, for Python workers that outlive its operator.

    A worker serves task after task of all operators of a session, so what each leaves in it adds up. A
    task clears what other operators than owner keep there, and hands free memory back when it ends.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [v for k, v in _kept.items() if k != owner and v]
        for v in others:
            v.clear()
        if others:
            hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in views of fewer, so that what is made of them is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def task_stamp() -> str:
    """Tells this attempt of this task from all others, for names of files in the shared folder."""
    from pyspark import TaskContext

    at = TaskContext.get()
    return f"{at.partitionId():06d}-{at.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
