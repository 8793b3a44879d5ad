"""Operator 3: reversible line dedup.

Exact tables hold which document has which line (references) and how many rows refer to a line
(counts). They are sharded by line; each shard has a cuckoo filter of its lines, which answers
most lines of an insert as new without a look into the tables, and forgets lines whose last
document is deleted. Texts are not changed in place: what a document keeps follows from the
tables, so a deletion gives a line back to the next document that has it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks
from tidegate.llm.cuckoo import CuckooFilter
from tidegate.session import cut_lineage

#: Lines with shorter keys, in code points, are never dropped.
LEAST_KEY = 10
#: Keys of a shard, on average: what one filter and one task hold.
SHARD_KEYS = 16_384
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes | None]:
    """For each line a 128-bit digest of its key, or None where the key is too short.

    The key is the line with ASCII white space stripped and A-Z lowered. Null and empty texts
    have one empty line.
    """
    keys = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(BLANK)
        long = len(key) >= LEAST_KEY and (
            len(key) >= 4 * LEAST_KEY or len(key.decode("utf-8", "surrogatepass")) >= LEAST_KEY
        )
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


def references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h1, h2)``: one row for each row of ``docs`` and distinct long line of it."""

    def make():
        def run(ids, texts):
            each = [list({k for k in line_keys(text) if k}) for text in texts]
            packed = np.frombuffer(b"".join(k for keys in each for k in keys), "<i8").reshape(-1, 2)
            owner = np.repeat(np.array(ids, dtype=np.int64), [len(keys) for keys in each])
            return {"id": pa.array(owner), "h1": pa.array(packed[:, 0].copy()), "h2": pa.array(packed[:, 1].copy())}

        return run

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return map_blocks(named, "id long, h1 long, h2 long", make)


def counted(refs: DataFrame) -> DataFrame:
    """``(h1, h2, n, lo, hi)``: rows that refer to a line, its smallest and largest document."""
    return refs.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")
    )


FILTERS = "shard long, slots binary, stash binary"


def _keys(table: pa.Table) -> np.ndarray:
    return table["h1"].to_numpy() ^ table["h2"].to_numpy()


def _row(shard, filter_: CuckooFilter) -> pa.Table:
    slots, stash = filter_.to_bytes()
    return pa.table({"shard": pa.array([shard], pa.int64()), "slots": pa.array([slots], pa.binary()), "stash": pa.array([stash], pa.binary())})


def _filter(table: pa.Table, keys: int) -> CuckooFilter:
    if not table.num_rows:
        return CuckooFilter.sized(keys)
    return CuckooFilter.from_bytes(table["slots"][0].as_py(), table["stash"][0].as_py())


@dataclass(frozen=True)
class LineIndex:
    """The state: ``refs`` (id, h1, h2), ``counts`` (h1, h2, n, lo, hi) and ``filters`` (shard, ...)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, expected_keys: int = SHARD_KEYS) -> LineIndex:
        """No document yet; filters are laid out for about ``expected_keys`` distinct lines."""
        table = lambda ddl: spark.createDataFrame([], ddl)
        return cls(
            table("id long, h1 long, h2 long"), table("h1 long, h2 long, n long, lo long, hi long"),
            table(FILTERS), max(1, -(-expected_keys // SHARD_KEYS)),
        )

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Insert all of ``docs`` into an empty index of fitting size."""
        refs = cut_lineage(references(docs, id_col, text_col))
        keys = cut_lineage(counted(refs))
        start = cls.empty(docs.sparkSession, keys.count())
        return cls(refs, keys, start._filled(keys), start.shards)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod("h1", F.lit(self.shards)).cast("long").alias("shard"), "h1", "h2")

    def _filled(self, new: DataFrame) -> DataFrame:
        """Filters with ``new`` keys added. What a full filter has no room for is in its stash."""

        def fill(group: tuple, keys: pa.Table, old: pa.Table) -> pa.Table:
            filter_ = _filter(old, keys.num_rows)
            filter_.insert(_keys(keys))
            return _row(group[0].as_py(), filter_)

        both = self._sharded(new).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return cut_lineage(both.applyInArrow(fill, FILTERS))

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2) with ``maybe``: false where the filters exclude the line."""

        def probe(group: tuple, asked: pa.Table, old: pa.Table) -> pa.Table:
            found = _filter(old, 0).contains(_keys(asked))
            return pa.table({"h1": asked["h1"], "h2": asked["h2"], "maybe": pa.array(found)})

        both = self._sharded(keys).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return both.applyInArrow(probe, "h1 long, h2 long, maybe boolean")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with ``docs`` added. Documents that are in it already must be deleted first."""
        refs = cut_lineage(references(docs, id_col, text_col))
        keys = cut_lineage(counted(refs))
        asked = cut_lineage(self.seen(keys))
        # only lines that the filters do not exclude are looked up in the exact table
        known = cut_lineage(
            asked.where("maybe").select("h1", "h2").join(self.counts, ["h1", "h2"])
            .unionByName(keys.join(asked.where("maybe"), ["h1", "h2"]).select("h1", "h2", "n", "lo", "hi"))
            .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("sides"))
        )
        met = known.where("sides = 2").drop("sides")
        new = cut_lineage(
            keys.join(asked.where("not maybe"), ["h1", "h2"]).select("h1", "h2", "n", "lo", "hi")
            .unionByName(known.where("sides = 1").drop("sides"))
        )
        counts = self.counts.join(met.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(met).unionByName(new)
        return LineIndex(
            cut_lineage(self.refs.unionByName(refs)), cut_lineage(counts), self._filled(new), self.shards
        )

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents in the only column of ``ids``."""
        gone = cut_lineage(ids.toDF("gone").where("gone is not null").distinct())
        left = cut_lineage(self.refs.join(gone, F.col("id") == F.col("gone"), "left_anti"))
        touched = cut_lineage(
            self.refs.join(gone, F.col("id") == F.col("gone"), "left_semi").select("h1", "h2").distinct()
        )
        still = cut_lineage(counted(left.join(touched, ["h1", "h2"], "left_semi")))
        counts = self.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(still)
        lost = touched.join(still, ["h1", "h2"], "left_anti")

        def take(group: tuple, keys: pa.Table, old: pa.Table) -> pa.Table:
            filter_ = _filter(old, 0)
            filter_.delete(_keys(keys))
            return _row(group[0].as_py(), filter_)

        both = self._sharded(lost).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return LineIndex(left, cut_lineage(counts), cut_lineage(both.applyInArrow(take, FILTERS)), self.shards)

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id_col, n_lines long, n_dropped long, kept string)`` of indexed documents.

        A long line that several documents have stays only in the smallest of them, all its
        repeats with it. One row for each row of ``docs``; a row without an identifier keeps
        everything, and of rows that share one each loses what their document loses. Other
        columns are not read.
        """
        shared = cut_lineage(self.counts.where("lo <> hi").select("h1", "h2", "lo"))
        # both sides are plain shuffles, so adaptive execution splits the rows of a frequent line
        lost = self.refs.join(shared, ["h1", "h2"]).where("id <> lo").select("id", "h1", "h2").distinct()
        lists = cut_lineage(lost.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))
        key = docs.schema[id_col].dataType.simpleString()

        def make():
            def run(ids, texts, losses):
                out = {"k": ids, "n_lines": [], "n_dropped": [], "kept": []}
                for text, loss in zip(texts, losses):
                    lines = (text or "").split("\n")
                    stay = lines
                    if loss:
                        pairs = np.array([(r["h1"], r["h2"]) for r in loss], dtype="<i8").tobytes()
                        gone = {pairs[i : i + 16] for i in range(0, len(pairs), 16)}
                        stay = [line for line, k in zip(lines, line_keys(text)) if k not in gone]
                    out["n_lines"].append(len(lines))
                    out["n_dropped"].append(len(lines) - len(stay))
                    out["kept"].append("\n".join(stay))
                return out

            return run

        joined = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(
            lists, F.col("k") == F.col("id"), "left"
        )
        out = map_blocks(joined.select("k", "t", "lost"), f"k {key}, n_lines long, n_dropped long, kept string", make)
        return out.withColumnRenamed("k", id_col)
