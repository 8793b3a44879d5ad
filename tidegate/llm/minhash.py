"""Operator 4: MinHash near-dedup.

Documents with equal shingle sets are one class, and only classes are compared. Bands of the
signatures put alike classes into common buckets. A bucket's best connected member is linked
to the others, so a bucket of n costs n links; each is verified on signatures, then on the full
sets. Linked classes are joined into components. Buckets that still hold several components are
then settled exactly: a class can be linked with another only if enough of its shingles occur
elsewhere, in the centre or beside it, which rules nearly all pairs out by counts, and the rest
are verified as before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import bitmaps
from tidegate.llm.arrow import map_blocks
from tidegate.llm.components import connected_components
from tidegate.llm.shingles import MinHash, shingle_set
from tidegate.session import cut_lineage

#: Hash functions of a signature, and the least similarity in percent if none is given.
FUNCTIONS, LEAST_PERCENT = 160, 85
#: Longs of the mask of a class's shingles beside its centre; a full mask rules nothing out.
MASK_LONGS = 32
#: A pair at the least similarity may share none of the bands with at most this probability.
MOST_MISSED = 1e-8


def band_rows(percent: int) -> int:
    """Rows of a band: the most with which a pair at ``percent`` is met, 5 at 85 and 4 at 80."""
    alike = percent / 100
    fitting = [r for r in range(1, 17) if (1 - alike**r) ** (FUNCTIONS // r) <= MOST_MISSED]
    return max(fitting, default=1)


def most_different(percent: int) -> int:
    """Hash functions on which a pair may differ: seven standard deviations over what is expected at ``percent``.

    55 at 85 percent, where 24 are expected, and 67 at 80, where 32 are.
    """
    unlike = 1 - percent / 100
    return int(FUNCTIONS * unlike + 7 * (FUNCTIONS * unlike * (1 - unlike)) ** 0.5)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, set_key binary, signature binary)``; both null for an empty set."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        hashing = MinHash(FUNCTIONS)

        def run(keys, texts):
            import xxhash

            sets = [shingle_set(text) for text in texts]
            return {
                "id": keys, "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "signature": [hashing.signature(s).tobytes() if len(s) else None for s in sets],
            }

        return run

    return map_blocks(
        docs.select(F.col(id_col), F.col(text_col)),
        f"id {key}, n_shingles long, set_key binary, signature binary", make,
    )


def band_keys(percent: int) -> Column:
    """The bucket of each band of ``signature``."""
    rows = band_rows(percent)
    width = 2 * rows
    return F.array(*[
        F.xxhash64(F.lit(band), F.substring("signature", band * width + 1, width)) for band in range(FUNCTIONS // rows)
    ])


def shared_buckets(classes: DataFrame, percent: int) -> DataFrame:
    """``(bucket, id, n_shingles)`` for buckets of two or more classes."""
    rows = cut_lineage(classes.select("id", "n_shingles", F.explode(band_keys(percent)).alias("bucket")))
    shared = cut_lineage(rows.groupBy("bucket").count().where("count > 1"))
    met = bitmaps.narrowed(rows, "bucket", shared.select("bucket"))
    return cut_lineage(met.join(shared, "bucket").select("bucket", "id", "n_shingles", "count"))


def bucket_centres(members: DataFrame) -> DataFrame:
    """``(bucket, centre, weight)``.

    The centre is the member whose buckets hold most classes in all, which is where the least
    edited text of a family of near copies stands.
    """
    weight = cut_lineage(members.groupBy("id").agg(F.sum("count").alias("weight")))
    return cut_lineage(
        members.join(weight, "id").groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("minus_id"))).alias("best"))
        .select("bucket", (-F.col("best.minus_id")).alias("centre"), "best.weight")
    )


def star_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """``(a, b)``: each member of a bucket with the bucket's centre."""
    pairs = members.select("bucket", "id").join(centres, "bucket").where("id <> centre")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def both_sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of ``table`` (id, column) for both ends.

    A join shuffles the rows of ``table`` that its end names, not all of them.
    """

    def named(end: str, value: str) -> DataFrame:
        held = bitmaps.narrowed(table.select("id", column), "id", pairs.select(end).distinct())
        return held.select(F.col("id").alias(end), F.col(column).alias(value))

    one = cut_lineage(pairs.join(named("a", "x"), "a"))
    return one.join(named("b", "y"), "b").select("a", "b", "x", "y")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree enough and whose full sets are similar enough."""
    ddl, most = "a long, b long", most_different(percent)

    def alike():
        def run(a, b, x, y):
            differ = [np.count_nonzero(np.frombuffer(p, "<u2") != np.frombuffer(q, "<u2")) for p, q in zip(x, y)]
            keep = [d <= most for d in differ]
            return {"a": [v for v, k in zip(a, keep) if k], "b": [v for v, k in zip(b, keep) if k]}

        return run

    def similar():
        def run(a, b, x, y):
            sets: dict = {}
            out = {"a": [], "b": []}
            for p, q, s, t in zip(a, b, x, y):
                for i, text in ((p, s), (q, t)):
                    if i not in sets:
                        sets[i] = shingle_set(text)
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                    out["a"].append(p)
                    out["b"].append(q)
            return out

        return run

    near = cut_lineage(map_blocks(both_sides(pairs, classes, "signature"), ddl, alike, 2048))
    return cut_lineage(map_blocks(both_sides(near, texts, "text"), ddl, similar))


def undecided(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component."""
    shared = [c for c in members.columns if c == "n_shared"]
    placed = cut_lineage(
        members.join(components, members["id"] == components["node"], "left")
        .select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component"), *shared)
    )
    open_buckets = cut_lineage(
        placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("bucket")
    )
    return cut_lineage(placed.join(open_buckets, "bucket"))


def could_link(shared: str, own: str, other: str, percent: int) -> str:
    """SQL: a set of ``own`` shingles, ``shared`` of them with any other set, may reach one of ``other``.

    At most the smaller of ``shared`` and ``other`` can be common.
    """
    common = f"least({shared}, {other})"
    return f"100 * {common} >= {percent} * ({own} + {other} - {common})"


def single_shingles(active: DataFrame, shingles: DataFrame, centres: DataFrame) -> DataFrame:
    """``(id, singles)``: shingles that no other class of ``active`` and no centre of its buckets has.

    Classes that are no longer active are filtered in place, by a bounded filter; one that slips
    through can only make singles fewer, which rules out less and nothing wrongly.
    """
    alive = cut_lineage(
        active.select("id").unionByName(active.join(centres, "bucket").select(F.col("centre").alias("id"))).distinct()
    )
    return cut_lineage(
        bitmaps.narrowed(shingles, "id", alive).groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .where("n = 1").groupBy("id").agg(F.collect_list("shingle").alias("singles"))
    )


def shingle_rows(active: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, shingle)`` of the classes of ``active``."""

    def make():
        def run(keys, bodies):
            sets = [shingle_set(text) for text in bodies]
            return {
                "id": pa.array(np.repeat(np.array(keys, dtype=np.int64), [len(s) for s in sets])),
                "shingle": pa.array(np.concatenate(sets).view(np.int64)),
            }

        return run

    needed = cut_lineage(active.select("id").distinct())
    return cut_lineage(map_blocks(
        texts.select("id", "text").join(needed, "id").select("id", "text"), "id long, shingle long", make, 64
    ))


def able(
    active: DataFrame, components: DataFrame, centres: DataFrame, texts: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """``active`` with ``n_shared``, without the classes that counts show to be linked with no other component.

    ``n_shared`` is the most shingles that another active class can have, too. Returned as well
    are the single shingles of the classes.
    """
    shingles = shingle_rows(active, texts)
    for _ in range(2):  # a class ruled out takes its shingles with it; more rounds find little
        singles = single_shingles(active, shingles, centres)
        numbers = singles.select("id", F.size("singles").alias("n_singles"))
        counted = cut_lineage(active.join(numbers, "id", "left").select(
            "bucket", "id", "n_shingles", "component", (F.col("n_shingles") - F.coalesce("n_singles", F.lit(0))).alias("n_shared")
        ))
        # the easiest partner of the bucket has just as many shingles as the class can share
        sizes = cut_lineage(counted.select("bucket", F.col("n_shingles").alias("other")).distinct())
        fit = cut_lineage(
            counted.select("bucket", "id", "n_shingles", "n_shared").join(sizes, "bucket")
            .where(could_link("n_shared", "n_shingles", "other", percent)).select("id").distinct()
        )
        active = undecided(counted.join(fit, "id").drop("component"), components)
    return active, singles


def beside_centres(active: DataFrame, singles: DataFrame, centres: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, centre, n_common, n_beside, mask)``: shingles of a class in its centre, and shared ones beside it.

    The centre of a class is the one with the greatest weight in its buckets. ``mask`` has a bit
    set for each of the shingles beside it.
    """
    nearest = cut_lineage(
        active.select("bucket", "id").join(centres, "bucket").groupBy("id")
        .agg(F.max(F.struct("weight", (-F.col("centre")).alias("minus_id"))).alias("best"))
        .select(F.col("id").alias("a"), (-F.col("best.minus_id")).alias("b"))
    )
    compared = both_sides(nearest, texts, "text").join(singles.withColumnRenamed("id", "a"), "a", "left")

    def make():
        def run(a, b, x, y, alone):
            held = {c: shingle_set(text) for c, text in dict(zip(b, y)).items()}
            out = {"id": a, "centre": b, "n_common": [], "n_beside": [], "mask": []}
            for c, text, single in zip(b, x, alone):
                own = shingle_set(text)
                beside = np.setdiff1d(own, held[c], assume_unique=True)
                out["n_common"].append(len(own) - len(beside))
                beside = np.setdiff1d(beside, np.array(single or [], dtype=np.int64).view(np.uint64))
                out["n_beside"].append(len(beside))
                bits = np.zeros(64 * MASK_LONGS, dtype=np.uint8)
                bits[(beside % np.uint64(len(bits))).astype(np.int64)] = 1
                out["mask"].append(np.packbits(bits).view(np.int64).tolist())
            return out

        return run

    return cut_lineage(map_blocks(
        compared, "id long, centre long, n_common long, n_beside long, mask array<long>", make, 64
    ))


def remaining_pairs(active: DataFrame, beside: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of different components in one bucket that counts do not rule out.

    Two classes of one centre have in common at most the smaller number of its shingles, and beside
    it the smaller number of shared ones, but none if their masks have no common bit.
    """
    wanted = cut_lineage(active.select("id").distinct())
    buckets = bitmaps.narrowed(classes.select("id", "signature"), "id", wanted).join(wanted, "id")
    keyed = cut_lineage(active.join(buckets.select("id", band_keys(percent).alias("all_buckets")), "id"))
    counted = cut_lineage(keyed.join(beside, "id"))
    main = cut_lineage(
        counted.groupBy("bucket", "component").count().groupBy("bucket")
        .agg(F.max(F.struct("count", "component")).alias("m")).select("bucket", F.col("m.component").alias("main"))
    )
    short = {
        "id": "", "n_shingles": "n", "n_shared": "s", "component": "c", "all_buckets": "k",
        "centre": "m", "n_common": "o", "n_beside": "e", "mask": "h",
    }
    named = lambda rows, end: rows.select("bucket", *[F.col(c).alias(f"{n}{end}") for c, n in short.items()])
    other = cut_lineage(named(counted.join(main, "bucket").where("component <> main"), "a"))
    enough = lambda common: f"100 * ({common}) >= {percent} * (na + nb - ({common}))"
    meet = "exists(zip_with(ha, hb, (p, q) -> (p & q) <> 0), z -> z)"
    likely = f"ma <> mb or {enough('least(oa, ob)')} or ({enough('least(oa, ob) + least(ea, eb)')} and {meet})"
    # a pair is met in its first common bucket only
    first = "element_at(filter(zip_with(ka, kb, (p, q) -> if(p = q, p, null)), z -> z is not null), 1) = bucket"
    pairs = other.join(named(counted, "b"), "bucket").where("ca <> cb").where(
        f"{enough('least(sa, sb)')} and ({likely}) and {first}"
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LEAST_PERCENT
) -> DataFrame:
    """One row for each row of ``docs``: ``(id_col, n_shingles, component_id, kept)``.

    Sets of shingles with a Jaccard similarity of ``percent`` or more are linked.

    A document without words (null or empty texts among them) is linked with nothing. The
    component is the smallest identifier reachable over links, and kept is the row that has it.
    Identifiers are taken to be unique integers; rows that share one are taken to be linked. A
    row without one is linked with nothing and kept. Other columns are not read.
    """
    signed = cut_lineage(signatures(docs, id_col, text_col))
    named = signed.where("id is not null and set_key is not null")
    classes = cut_lineage(named.groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    ))
    members = shared_buckets(classes, percent)
    wanted = cut_lineage(members.select("id").distinct())
    bodies = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = cut_lineage(bitmaps.narrowed(bodies, "id", wanted).join(wanted, "id"))
    centres = bucket_centres(members)
    links = verified(cut_lineage(star_pairs(members, centres)), classes, texts, percent)
    components = connected_components(links.toDF("u", "v"))
    active, singles = able(undecided(members, components), components, centres, texts, percent)
    beside = beside_centres(active, singles, centres, texts)
    more = verified(cut_lineage(remaining_pairs(active, beside, classes, percent)), classes, texts, percent)
    if not more.isEmpty():
        components = connected_components(links.unionByName(more).toDF("u", "v"))
    placed = cut_lineage(
        classes.join(components, classes["id"] == components["node"], "left")
        .select("set_key", F.coalesce("component", "id").alias("component_id"))
    )
    found = named.select("id", "n_shingles", "set_key").join(placed, "set_key").select("id", "n_shingles", "component_id")
    rest = signed.where("id is null or set_key is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.unionByName(rest).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LEAST_PERCENT
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns."""
    dropped = cut_lineage(near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("dropped_id")))
    return docs.join(dropped, docs[id_col] == dropped["dropped_id"], "left_anti")
