"""Context packs: candidate symbols, layers and the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators.ordered import running_sum
from tidegate.session import cut_lineage

# Trimming order of the layers and confidence limits.
LAYERS = ("mandatory", "structural", "evidence", "rationale", "expandable")
MAX_CONFIDENCE = 0.95
CERTAIN_CONFIDENCE = 0.35


def layer_number(layer: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in LAYERS]), layer)


def token_budget(items: DataFrame, budget: Column, run: int = 1024) -> DataFrame:
    """Keep the longest prefix of the layers that fits the budget of each pack.

    ``items`` has pack_id, layer, rank and tokens. Running totals are carried over
    (layer, rank run) buckets, so one huge pack is spread over many tasks. A pack whose
    mandatory layer alone exceeds the budget is a fault.
    """
    placed = items.withColumn("layer_no", layer_number(F.col("layer"))).withColumn(
        "_bucket", F.struct("layer_no", F.expr(f"rank div {run}").alias("run"))
    )
    summed = running_sum(
        placed, ["pack_id"], "_bucket", [F.col("layer_no"), F.col("rank")], F.col("tokens"), "upto"
    )
    return summed.withColumns({
        "kept": F.col("upto") <= budget,
        "fault": F.when(
            (F.col("layer") == "mandatory") & (F.col("upto") > budget),
            "mandatory context exceeds token_budget",
        ),
    }).drop("_bucket", "layer_no")


def truncated_layers(items: DataFrame) -> DataFrame:
    return items.groupBy("pack_id", "layer").agg(
        F.count("*").alias("n_items"), F.count_if("kept").alias("n_kept"),
        F.bool_or(~F.col("kept")).alias("truncated"),
    )


def retained_policy_recall(items: DataFrame) -> DataFrame:
    """Share of a pack's mandatory policies that survive the budget."""
    return items.where("layer = 'mandatory'").groupBy("pack_id").agg(
        F.avg(F.col("kept").cast("double")).alias("mandatory_policy_recall")
    )


def symbol_quality(identifier: Column, label: Column) -> Column:
    """Prefer declarations over calls, main code over tests, qualified labels."""
    return (
        F.when(F.contains(identifier, F.lit("#call")), 0).otherwise(2)
        + F.when(F.contains(identifier, F.lit("/test/")), 0).otherwise(1)
        + F.when(F.contains(label, F.lit(".")), 1).otherwise(0)
    )


def candidate_confidence(hinted: Column, hits: Column, n_terms: Column, semantic: Column) -> Column:
    return F.when(hinted, F.lit(1.0)).otherwise(
        F.least(
            F.lit(MAX_CONFIDENCE),
            hits / F.greatest(F.lit(1), n_terms) + F.lit(0.35) * semantic,
        )
    )


def symbol_text(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id", "label", F.lower(F.concat_ws(" ", "id", "label")).alias("text"),
        symbol_quality(F.col("id"), F.col("label")).alias("quality"),
    )


def task_terms(task: Column) -> Column:
    return F.array_distinct(text.lexical_tokens(task))


# Why a task has no symbol.
NO_NODES = "no indexed symbols in requested repositories"
NO_HINTS = "hint_symbols contain no indexed symbol in the requested repositories"


def held_terms(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(text, n_tokens, held, named)`` of each distinct text: the terms it holds as substrings and as tokens, sorted.

    ``vocabulary`` has lexical tokens (term). They have no character that ends a token, so a text holds
    a term where one of its tokens does, and each distinct token is looked up once.
    """
    from tidegate.operators.joins import term_hits

    read = cut_lineage(texts.select("text").distinct().withColumn("tokens", F.array_distinct(text.lexical_tokens(F.col("text")))))
    each = read.select("text", F.explode("tokens").alias("word"))
    words = cut_lineage(each.select("word").distinct())
    hits = term_hits(vocabulary, words.select(F.col("word").alias("id"), F.col("word").alias("text")))
    holding = cut_lineage(hits.groupBy(F.col("id").alias("word")).agg(F.collect_set("term").alias("terms")))
    met = each.join(holding, "word").groupBy("text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("held"))
    none = F.expr("cast(array() AS ARRAY<STRING>)")
    held = F.coalesce("held", none)
    return read.join(met, "text", "left").select(
        "text", F.size("tokens").alias("n_tokens"), held.alias("held"), F.array_intersect(held, F.col("tokens")).alias("named"))


def symbol_candidates(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best indexed symbols per task: one, or three when confidence is low.

    ``tasks`` has task_id, task, repos and hints. Nodes of the requested repositories come
    from the gram join, so tasks meet only nodes whose id contains one of their repositories.
    Tasks about the same repositories look them up once. Nodes that hold the same asked terms, are as long
    and as good have the same scores in all these tasks, so only the three least identifiers of such a
    class meet them; a node that some task hints at is a class of its own.
    A task without any signal gets an ``unknown://`` symbol. A task whose repositories hold no
    node, or none of its hints, has one row with a ``fault`` and no symbol.
    """
    from tidegate.operators.joins import term_containment
    from tidegate.operators.ordered import top_k

    asked = cut_lineage(tasks.select(
        "task_id", "hints", F.array_sort(F.array_distinct("repos")).alias("repos"), task_terms(F.col("task")).alias("terms")
    ))
    groups = cut_lineage(asked.groupBy("repos").agg(F.min("task_id").alias("group_id")))
    reach = term_containment(
        groups.select(F.col("group_id").alias("request_id"), F.col("repos").alias("terms")),
        nodes.select("id", F.col("id").alias("text")),
    ).select(F.col("request_id").alias("group_id"), "id")
    texts = cut_lineage(symbol_text(nodes))
    held = held_terms(texts, cut_lineage(asked.select(F.explode("terms").alias("term")).distinct()))
    hinted = asked.select(F.explode("hints").alias("id")).distinct().withColumn("hint", F.col("id"))
    alike = ["group_id", "held", "named", "n_tokens", "quality", "hint"]
    known = reach.join(texts.select("id", "text", "quality").join(held, "text"), "id").join(hinted, "id", "left")
    classes = cut_lineage(top_k(known.select(*alike, "id"), alike, [F.asc("id")], 3))
    pairs = classes.drop("position").join(
        asked.join(groups, "repos").select("task_id", "group_id", "hints", "terms"), "group_id")
    scale = F.sqrt(F.size("terms").cast("double") * F.col("n_tokens").cast("double"))
    scored = pairs.withColumns({
        "hits": F.size(F.array_intersect("terms", "held")),
        "semantic": F.when(scale > 0, F.size(F.array_intersect("terms", "named")) / scale).otherwise(F.lit(0.0)),
        "hinted": F.coalesce(F.expr("array_contains(hints, id)"), F.lit(False)),
    }).withColumns({
        "score": F.when(F.col("hinted"), 100.0).otherwise(0.0) + F.col("hits") + F.col("semantic"),
        "confidence": candidate_confidence(
            F.col("hinted"), F.col("hits"), F.size("terms"), F.col("semantic")
        ),
    })
    # a hinted node leads its task, so the first row tells whether any hint was met
    ranked = cut_lineage(top_k(
        scored, ["task_id"], [F.desc("score"), F.desc("quality"), F.asc("id")], 3
    ).select("task_id", "position", "id", "confidence", "hinted"))
    first = ranked.where("position = 1").select(
        "task_id", F.col("confidence").alias("top_confidence"), F.col("hinted").alias("met")
    )
    fault = F.when(F.col("met").isNull(), NO_NODES).when(
        (F.coalesce(F.size("hints"), F.lit(0)) > 0) & ~F.col("met"), NO_HINTS)
    judged = tasks.select("task_id", "task", "hints").join(first, "task_id", "left").withColumn("fault", fault).drop("hints", "met")
    unknown = F.concat(F.lit("unknown://task/"), F.substring(F.sha2("task", 256), 1, 16))
    kept = judged.where("fault IS NULL").join(ranked, "task_id").where(
        (F.col("position") == 1)
        | ((F.col("top_confidence") < CERTAIN_CONFIDENCE) & (F.col("top_confidence") > 0))
    ).select(
        "task_id", "position",
        F.when(F.col("top_confidence") == 0, unknown).otherwise(F.col("id")).alias("symbol"),
        F.col("top_confidence").alias("confidence"), "fault",
    )
    none = lambda kind: F.lit(None).cast(kind)
    return kept.unionByName(judged.where("fault IS NOT NULL").select(
        "task_id", none("int").alias("position"), none("string").alias("symbol"), none("double").alias("confidence"), "fault"))
