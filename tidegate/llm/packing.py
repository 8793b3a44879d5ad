"""Operator 7: best-fit packing with certified repacking.

Documents become pieces of at most one sequence; pieces are dealt into groups of bounded size
and packed best-fit decreasing in each. Dual feasible functions certify a group whose bin count
no packing can beat. Groups with a gap give their emptiest bins away, certified ones the one
bin that is not full; what was given is dealt into fewer groups and packed again, for as long
as bins are saved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks
from tidegate.llm.binpack import best_fit_decreasing, bins_needed
from tidegate.llm.pieces import word_encoder
from tidegate.session import cut_lineage

#: Pieces of a group, on average: what one task holds and packs.
GROUP_PIECES = 1_500
#: Texts tokenised together; each distinct word among them is merged once.
BLOCK_TEXTS = 1_024
#: A group with a gap gives away this share of its bins, and so many at least.
GIVEN_SHARE, LEAST_GIVEN = 0.05, 4


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id_col, piece int, start long, length long, ids_crc32 long[, ids binary])``.

    A document is its ids, then ``end_id``; a null or empty text is the end alone. Only longer
    documents are cut, so that all pieces but the first are full. ``ids`` are little-endian
    unsigned 32-bit integers. Repeated rows give their pieces again; other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def make():
        encoder = word_encoder(tokenizer_path)

        def run(keys, texts):
            out = {name: [] for name in ("k", "piece", "start", "length", "ids_crc32", "ids")}
            for k, packed in zip(keys, encoder.packed(texts)):
                packed += end
                n = len(packed) // 4
                first = n if n <= capacity else n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    ids = packed[4 * a : 4 * b]
                    row = (k, piece, a, b - a, zlib.crc32(ids), ids if with_ids else None)
                    for name, value in zip(out, row):
                        out[name].append(value)
            return out

        return run

    ddl = f"k {key}, piece int, start long, length long, ids_crc32 long, ids binary"
    out = map_blocks(docs.select(F.col(id_col), F.col(text_col)), ddl, make, BLOCK_TEXTS)
    return (out if with_ids else out.drop("ids")).withColumnRenamed("k", id_col)


PLACED = "item long, length long, grp long, bin long, offset long, given boolean, bins long"


def pack_groups(items: DataFrame, capacity: int) -> DataFrame:
    """Pack each group ``grp`` of ``(item, length, grp)``; ``given`` marks bins given away."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        fill = np.bincount(bins, lengths, minlength=n_bins)
        gap = n_bins > bins_needed(lengths, capacity)
        n_given = max(LEAST_GIVEN, int(GIVEN_SHARE * n_bins)) if gap else 1
        given = np.zeros(n_bins, dtype=bool)
        given[np.argsort(fill, kind="stable")[:n_given]] = True
        given &= fill < capacity
        return pd.DataFrame({
            "item": pdf["item"].to_numpy(), "length": lengths, "grp": pdf["grp"].to_numpy(),
            "bin": bins, "offset": offsets, "given": given[bins], "bins": n_bins,
        })

    return items.groupBy("grp").applyInPandas(pack, PLACED)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (lengths from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Sequences are gapless from offset 0. An empty table gives an empty result; repeated rows
    are packed each.
    """
    numbered = cut_lineage(pieces.withColumn("item", F.monotonically_increasing_id()))
    count = numbered.count()
    groups = max(1, -(-count // GROUP_PIECES))
    dealt = numbered.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("grp"))
    packed = cut_lineage(pack_groups(dealt, capacity))
    # each round repacks only what the last one gave away, and stands only if it saves bins
    settled, base = packed.where("not given"), groups
    given = packed.where("given")
    while True:
        held = given.agg(F.count(F.lit(1)).alias("items"), F.countDistinct("grp", "bin").alias("bins")).first()
        fewer = max(1, -(-held["items"] // GROUP_PIECES))
        if held["bins"] < 2:
            break
        again = given.select("item", "length", (F.pmod(F.xxhash64("item", F.lit(base)), F.lit(fewer)) + base).alias("grp"))
        repacked = cut_lineage(pack_groups(again, capacity))
        now = repacked.select("grp", "bins").distinct().agg(F.sum("bins")).first()[0]
        if now >= held["bins"]:
            break
        settled, given = settled.unionByName(repacked.where("not given")), repacked.where("given")
        base += fewer
    placed = settled.unionByName(given).select(
        F.col("item").alias("placed_item"),
        (F.shiftleft("grp", 32) + F.col("bin")).alias("sequence_id"), "offset",
    )
    return numbered.join(placed, F.col("item") == F.col("placed_item")).drop("item", "placed_item")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document with their places in as few sequences as the rounds reach."""
    return pack(cut_pieces(docs, tokenizer_path, capacity, 0, id_col, text_col), capacity)


def sequences_needed(pieces: DataFrame, capacity: int = 2048) -> int:
    """The certified bound over all pieces, from the counts of each length (a row a length)."""
    counts = pieces.groupBy("length").count().toPandas()
    return bins_needed(np.repeat(counts["length"].to_numpy(), counts["count"].to_numpy()), capacity)
