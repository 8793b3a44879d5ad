"""Governed hybrid retrieval over many requests at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import filters
from tidegate.operators.ordered import top_k
from tidegate.session import cut_lineage

# BM25 parameters and fusion weights.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LEXICAL_WEIGHT, VECTOR_WEIGHT = 0.65, 0.35

#: Columns that decide who may read a document; the index carries those that a table has.
GOVERNED = ("scope", "revision", "acl", "status", "expires_at")
#: Postings of a request that are read for its first bound, as a multiple of the rows asked for.
SEED_POSTINGS = 64
#: Documents that are counted in full for that bound, as a multiple of the rows asked for.
SEED_FACTOR = 4
#: Room for rounding when bounds are compared.
SLACK = 1e-9


#: Characters of text a part holds on average where words of documents are counted.
PART_CHARACTERS = 1 << 23
#: Postings a part holds on average where they meet candidates.
PART_POSTINGS = 1 << 20


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """``docs`` in parts by id, as many as their text asks for.

    Texts shrink in a shuffle and grow when they become words, so parts of equal bytes, as adaptive
    execution makes them, would hold more words a task the larger the corpus is.
    """
    total = docs.agg(F.sum(F.length(F.concat_ws(" ", "title", "content")))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_CHARACTERS + 1)
    return docs.repartition(parts, "id")


def searchable(docs: DataFrame) -> DataFrame:
    """Document length and index tokens; title and content are indexed together.

    Documents are dealt by id as whole texts, so tokens are built on all cores whatever the
    layout of the files, and what is counted per document needs no further shuffle.
    """
    tokens = text.index_tokens(F.concat_ws(" ", "title", "content"))
    dealt = dealt_by_id(docs.select("id", "title", "content"))
    return dealt.select("id", tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


@dataclass(frozen=True)
class TextIndex:
    """What searches of a set of requests read, written once.

    ``documents``: id, dl (index tokens), n_tokens (distinct lexical tokens) and the governed
    columns, one row each. ``terms``: postings (term, id, dl, tf) of the asked index terms.
    ``tokens``: postings (token, id, n_tokens, governed columns) of the asked lexical tokens.
    """

    documents: DataFrame
    terms: DataFrame
    tokens: DataFrame


def text_index(requests: DataFrame, docs: DataFrame, lexical: bool = True) -> TextIndex:
    """Tokenise every document once and keep the postings of words that some request asks for.

    Without ``lexical`` only index terms are kept, and ``n_tokens`` is 0.
    """
    query = F.col("query")
    kinds = {"term": text.index_tokens, "token": text.lexical_tokens}
    wanted = {
        kind: requests.select(F.explode(tokens(query)).alias("word")).withColumn("kind", F.lit(kind))
        for kind, tokens in kinds.items() if lexical or kind == "term"
    }
    everyone = requests.sparkSession.range(1).select(F.lit("").alias("word"), F.lit("document").alias("kind"))
    # written, so Spark knows that the words of few requests are few and leaves those of the documents where they are
    asked = cut_lineage(reduce(DataFrame.unionByName, wanted.values(), everyone).groupBy("word").agg(
        *[F.bool_or(F.col("kind") == kind).alias(f"as_{kind}") for kind in kinds]))
    held = [c for c in GOVERNED if c in docs.columns]
    body = F.concat_ws(" ", "title", "content")
    dealt = dealt_by_id(docs.select("id", *held, "title", "content")).select("id", *held, body.alias("body"))
    # A lexical token is an index term, or joins several by "_" and "-": texts are read once, and the joined ones again.
    joined = lambda word: F.contains(word, F.lit("_")) | F.contains(word, F.lit("-"))
    tokenised = dealt.select("id", *held, text.lexical_tokens(F.col("body")).alias("tokens")).select(
        "id", *held, "tokens", F.filter("tokens", joined).alias("mixed"),
    ).select("id", *held, "tokens", F.size("mixed").alias("n_mixed"), F.flatten(F.transform("mixed", text.index_tokens)).alias("parts"))
    n_tokens = F.size(F.array_distinct("tokens")) if lexical else F.lit(0)
    # Sizes are taken before the explosion, or every word would carry the arrays of its document; and
    # the empty word of each document keeps the ones without any.
    sized = tokenised.select(
        "id", *held, (F.size("tokens") - F.col("n_mixed") + F.size("parts")).alias("dl"), n_tokens.alias("n_tokens"),
        F.size("tokens").alias("n_whole"), F.concat(F.array(F.lit("")), "tokens", "parts").alias("words"),
    )
    whole = F.col("pos") <= F.col("n_whole")
    # a word is one row whether it is asked as a term, as a token or as both
    rows = (
        sized.select("id", *held, "dl", "n_tokens", "n_whole", F.posexplode_outer("words").alias("pos", "word"))
        .join(asked, "word")
        # dealt by id already, so counting needs no shuffle; what hangs on the id is a key as hash aggregation asks for
        .groupBy("id", *held, "dl", "n_tokens", "word", "as_term", "as_token")
        .agg(F.count_if(~whole | ~joined(F.col("word"))).alias("tf"), F.count_if(whole).alias("n_whole"))
    )
    written = cut_lineage(rows)
    document = F.col("word") == ""
    return TextIndex(
        written.where(document).select("id", "dl", "n_tokens", *held),
        written.where(F.col("as_term") & (F.col("tf") > 0) & ~document).select(F.col("word").alias("term"), "id", "dl", "tf"),
        written.where(F.col("as_token") & (F.col("n_whole") > 0) & ~document).select(F.col("word").alias("token"), "id", "n_tokens", *held),
    )


def inverted_index(docs: DataFrame) -> DataFrame:
    """Postings: term, document, frequency and document length."""
    return (
        searchable(docs)
        .select("id", "dl", F.explode_outer("tokens").alias("term"))
        .where("term IS NOT NULL")
        .groupBy("term", "id", "dl")
        .agg(F.count("*").alias("tf"))
    )


def index_terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences")
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Document count and mean length; tokens are counted, not built."""
    length = F.regexp_count(F.lower(F.concat_ws(" ", "title", "content")), F.lit(text.INDEX_PATTERN))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avgdl"))


def request_terms(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", F.explode(F.array_distinct(text.index_tokens(F.col("query")))).alias("term")
    )


def bm25(requests: DataFrame, docs: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """Scores of the documents that hold every term of a request.

    Statistics cover the whole corpus, before any eligibility rule. Only postings of asked
    terms are kept, and candidates come from the rarest term of each request: a document
    without it cannot match, so frequent terms never pair all documents with all requests.
    """
    index = index or text_index(requests, docs, lexical=False)
    asked, postings = request_terms(requests), index.terms
    corpus = index.documents.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    n_docs, avgdl = F.lit(corpus["n_docs"]), F.lit(corpus["avgdl"])
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    # a row for each asked word, read twice
    graded = cut_lineage(asked.join(frequency, "term", "left").fillna(0, ["df"]))
    rarest = graded.groupBy("request_id").agg(
        F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("n_terms")
    )
    candidates = rarest.join(postings.select("term", "id"), "term").select(
        "request_id", "id", "n_terms"
    )
    idf = F.greatest(
        F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR)
    )
    gain = (
        idf * F.col("tf") * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    )
    # postings shrink in a shuffle as texts do, so parts are counted in rows
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), postings.count() // PART_POSTINGS + 1)
    matched = candidates.join(graded, "request_id").repartition(parts, "term", "id").join(
        postings.repartition(parts, "term", "id"), ["term", "id"])
    return (
        matched.groupBy("request_id", "id")
        .agg(F.sum(gain).alias("bm25"), F.count("*").alias("n_found"), F.max("n_terms").alias("n_terms"))
        .where("n_found = n_terms")
        .select("request_id", "id", "bm25")
    )


def fused(bm25_score: Column, vector_score: Column) -> Column:
    return (
        LEXICAL_WEIGHT * F.coalesce(bm25_score, F.lit(0.0))
        + VECTOR_WEIGHT * F.coalesce(vector_score, F.lit(0.0))
    )


def vector_tokens(title: str = "title", content: str = "content") -> Column:
    return F.array_distinct(text.lexical_tokens(F.concat_ws(" ", title, content)))


def request_keys(requests: DataFrame) -> DataFrame:
    """Requests by the scopes they may read, so eligibility becomes an equi join."""
    return requests.withColumn(
        "scope", F.explode(F.array_distinct(F.array(F.lit("global"), F.col("scope"))))
    )


def open_documents(docs: DataFrame, now: Column) -> DataFrame:
    """Rules that do not depend on the request, applied next to the scan."""
    return docs.where((F.col("status") == "published") & filters.is_fresh(F.col("expires_at"), now))


def eligible_pairs(requests: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Eligible documents per request: equal scope and revision, then a role in common."""
    keys = request_keys(requests)
    return open_documents(docs, now).join(keys, ["scope", "revision"]).where(
        F.arrays_overlap("acl", "roles")
    )


def hybrid_search(
    requests: DataFrame, docs: DataFrame, now: Column, limit: int, scores: DataFrame | None = None,
    score_tokens: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Top documents per request by fused score, ties by id.

    A document outside the lexical matches ranks by its vector score alone, so the result
    lies in (top ``limit`` by vector score) + (lexical matches). The vector score is the set
    cosine of tokens, whose best documents are found over postings with score bounds.
    ``score_tokens`` replaces it by a score of two arrays of distinct tokens, the request's and
    the document's; nothing is known of its bounds, so it is asked for every eligible pair.
    """
    index = text_index(requests, docs)
    lexical = cut_lineage(bm25(requests, docs, index)) if scores is None else scores
    if score_tokens is None:
        pool = vector_pool(requests, index, now, limit, lexical)
    else:
        pool = scored_pool(requests, docs, now, limit, lexical, score_tokens)
    ranked = pool.join(lexical, ["request_id", "id"], "left").select(
        "request_id", "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "vector",
        fused(F.col("bm25"), F.col("vector")).alias("rerank"),
    )
    return top_k(ranked, ["request_id"], [F.desc("rerank"), F.asc("id")], limit)


def scored_pool(
    requests: DataFrame, docs: DataFrame, now: Column, limit: int, lexical: DataFrame,
    score_tokens: Callable[[Column, Column], Column],
) -> DataFrame:
    """The best eligible pairs and the eligible lexical matches by a scorer without bounds."""
    asked = requests.select(
        "request_id", "scope", "revision", "roles",
        F.array_distinct(text.lexical_tokens(F.col("query"))).alias("query_tokens"),
    )
    bodies = docs.withColumn("doc_tokens", vector_tokens())
    similarity = score_tokens(F.col("query_tokens"), F.col("doc_tokens"))
    pairs = eligible_pairs(asked, bodies, now).select("request_id", "id", similarity.alias("vector"))
    leading = top_k(pairs, ["request_id"], [F.desc("vector"), F.asc("id")], limit).drop("position")
    matched_docs = bodies.join(lexical.select("id").distinct(), "id", "left_semi")
    matching = eligible_pairs(asked, matched_docs, now).join(
        lexical.select("request_id", "id"), ["request_id", "id"], "left_semi"
    ).select("request_id", "id", similarity.alias("vector"))
    return leading.unionByName(matching).groupBy("request_id", "id").agg(F.max("vector").alias("vector"))


def vector_pool(requests: DataFrame, index: TextIndex, now: Column, limit: int, lexical: DataFrame) -> DataFrame:
    """Top ``limit`` documents of each request by set cosine, and its eligible lexical matches.

    Documents are met through postings of shared tokens only. Postings stand in cells of equal
    scope, revision and length class (a power of two). From the rarest tokens of a request comes
    a lower bound of its ``limit``-th best score; in every cell the most frequent tokens that
    together cannot lift a document of that length to the bound bring no candidates. Candidates
    whose count plus those tokens stays below the bound go, the others are counted in full. Long
    posting lists are split by adaptive execution, as every join here is an inner one followed by
    a shuffle. Requests with fewer matches are filled with the smallest eligible identifiers.
    """
    cell = ["scope", "revision", "size_class"]
    keys = request_keys(requests.select("request_id", "scope", "revision", "roles"))
    postings = open_documents(index.tokens, now).withColumn("size_class", F.floor(F.log2(F.col("n_tokens"))).cast("int"))
    tokens = requests.select(
        "request_id", F.array_distinct(text.lexical_tokens(F.col("query"))).alias("asked")
    ).select("request_id", F.size("asked").alias("n_asked"), F.explode("asked").alias("token"))
    lists = postings.groupBy(*cell, "token").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("request_id", *cell).orderBy("df", "token")
    # a row for each asked token and cell, whatever the number of documents
    plan = cut_lineage(
        tokens.join(keys, "request_id").join(lists, ["scope", "revision", "token"])
        .withColumns({
            "place": F.row_number().over(rare_first),
            "n_here": F.count("*").over(Window.partitionBy("request_id", *cell)),
            "upto": F.sum("df").over(Window.partitionBy("request_id").orderBy("df", "token", *cell)),
        })
    )

    def counted(asked: DataFrame, *more: str) -> DataFrame:
        """Shared tokens of requests and the documents they may read, by postings of ``asked`` tokens."""
        met = asked.join(postings, [*cell, "token"]).where(F.arrays_overlap("acl", "roles"))
        return met.groupBy("request_id", "id").agg(
            F.count("*").alias("shared"), F.max("n_asked").alias("n_asked"), F.max("n_tokens").alias("n_tokens"),
            *[F.max(c).alias(c) for c in more],
        )

    cosine = lambda shared: shared / F.sqrt(F.col("n_asked").cast("double") * F.col("n_tokens").cast("double"))
    held = index.tokens.select("id", "token", "n_tokens")
    wanted = tokens.select("request_id", "token", "n_asked")

    def in_full(pairs: DataFrame) -> DataFrame:
        """Cosine of pairs that share a token, from all tokens they share."""
        met = pairs.select("request_id", "id").join(held, "id").join(wanted, ["request_id", "token"])
        return met.groupBy("request_id", "id").agg(
            F.count("*").alias("shared"), F.max("n_asked").alias("n_asked"), F.max("n_tokens").alias("n_tokens"),
        ).select("request_id", "id", cosine(F.col("shared")).alias("vector"))

    seeds = plan.where((F.col("upto") <= SEED_POSTINGS * limit) | (F.col("upto") == F.col("df")))
    leading = top_k(
        counted(seeds).select("request_id", "id", cosine(F.col("shared")).alias("least")),
        ["request_id"], [F.desc("least"), F.asc("id")], SEED_FACTOR * limit,
    )
    tested = top_k(in_full(leading), ["request_id"], [F.desc("vector"), F.asc("id")], limit)
    bounds = tested.groupBy("request_id").agg(
        F.when(F.count("*") == limit, F.min("vector")).otherwise(0.0).alias("bound"))
    # how many tokens a document of the cell's least length may share without reaching the bound
    reach = F.col("bound") * F.sqrt(F.col("n_asked") * F.pow(F.lit(2.0), F.col("size_class"))) * (1 - SLACK)
    bounded = plan.join(bounds, "request_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0))).withColumn(
        "silent", F.least(F.greatest(F.ceil(reach) - 1, F.lit(0)), F.col("n_here")))
    candidates = counted(bounded.where(F.col("place") <= F.col("n_here") - F.col("silent")), "bound", "silent")
    survivors = candidates.where(cosine(F.col("shared") + F.col("silent")) >= F.col("bound") * (1 - SLACK))
    readable = open_documents(index.documents, now).join(
        lexical.select("request_id", "id"), "id").join(keys, ["request_id", "scope", "revision"]).where(
        F.arrays_overlap("acl", "roles"))
    chosen = cut_lineage(survivors.select("request_id", "id", F.lit(False).alias("lexical")).unionByName(
        readable.select("request_id", "id", F.lit(True).alias("lexical"))
    ).groupBy("request_id", "id").agg(F.bool_or("lexical").alias("lexical")))
    exact = cut_lineage(
        chosen.join(in_full(chosen), ["request_id", "id"], "left")
        .select("request_id", "id", "lexical", F.coalesce("vector", F.lit(0.0)).alias("vector")))
    best = top_k(exact.where("vector > 0"), ["request_id"], [F.desc("vector"), F.asc("id")], limit).select("request_id", "id", "vector")
    full = best.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    # without a match the smallest identifiers come; fewer than ``limit`` of a profile's can be matches
    profile = ["scope", "revision", "acl"]
    smallest = top_k(open_documents(index.documents, now).select(*profile, "id"), profile, [F.asc("id")], 2 * limit)
    filling = (
        keys.join(full, "request_id", "left_anti").join(smallest, ["scope", "revision"])
        .where(F.arrays_overlap("acl", "roles"))
        .join(exact.select("request_id", "id"), ["request_id", "id"], "left_anti")
        .select("request_id", "id", F.lit(0.0).alias("vector"))
    )
    matches = exact.where("lexical").select("request_id", "id", "vector")
    return best.unionByName(matches).unionByName(filling).groupBy("request_id", "id").agg(F.max("vector").alias("vector"))


def mandatory_policies(
    requests: DataFrame, docs: DataFrame, policies: DataFrame, now: Column
) -> DataFrame:
    """Critical policies of all eligible documents, whatever their rank.

    Documents are reduced to distinct access profiles per policy before they meet requests.
    """
    critical = policies.where("severity = 'critical'").select("policy_id")
    profiles = (
        open_documents(docs, now)
        .select("scope", "revision", "acl", F.explode("policy_ids").alias("policy_id"))
        .join(critical, "policy_id", "left_semi")
        .distinct()
    )
    return (
        profiles.join(request_keys(requests), ["scope", "revision"])
        .where(F.arrays_overlap("acl", "roles"))
        .select("request_id", "policy_id")
        .distinct()
    )


def retrieval_leaks(
    actual: DataFrame, expected: DataFrame, forbidden: DataFrame, mandatory: DataFrame,
    required: DataFrame,
) -> DataFrame:
    """Per request: same documents in the same order, leaks by kind, mandatory policy kept.

    ``actual`` and ``expected`` are (request_id, position, id); ``forbidden`` has a kind.
    """
    want = expected.select("request_id", "position", F.col("id").alias("want"))
    order = actual.select("request_id", "position", "id").join(
        want, ["request_id", "position"], "full_outer"
    ).groupBy("request_id").agg(F.count_if(~F.col("id").eqNullSafe(F.col("want"))).alias("misplaced"))
    leaks = actual.join(forbidden, ["request_id", "id"]).groupBy("request_id").agg(
        F.count_if(F.col("kind") == "stale").alias("stale_leaks"),
        F.count_if(F.col("kind") == "acl_denied").alias("acl_leaks"),
        F.count("*").alias("leaks"),
    )
    kept = required.join(
        mandatory.withColumn("kept", F.lit(True)), ["request_id", "policy_id"], "left"
    ).groupBy("request_id").agg(F.bool_and(F.coalesce("kept", F.lit(False))).alias("policy_ok"))
    joined = order.join(leaks, "request_id", "left").join(kept, "request_id", "left").fillna(
        0, ["stale_leaks", "acl_leaks", "leaks"]
    )
    passed = (
        (F.col("misplaced") == 0) & (F.col("leaks") == 0)
        & F.coalesce("policy_ok", F.lit(True))
    )
    return joined.select(
        "request_id", "misplaced", "stale_leaks", "acl_leaks", "policy_ok", passed.alias("passed")
    )


def leak_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("query_count"),
        F.coalesce(
            F.try_divide(F.count_if("policy_ok").cast("double"), F.count("policy_ok")), F.lit(1.0)
        ).alias("mandatory_policy_recall"),
        (F.sum("stale_leaks") / F.count("*")).alias("stale_knowledge_rate"),
        F.sum("acl_leaks").alias("acl_leak_count"),
    )


def rag_baseline(requests: DataFrame, hits: DataFrame, critical: str, marker: str) -> DataFrame:
    """Outcome from the retrieved documents alone."""
    seen = hits.groupBy("request_id").agg(
        F.bool_or(F.array_contains("policy_ids", critical)).alias("blocked"),
        F.bool_or(F.contains(F.lower("content"), F.lit(marker))).alias("marked"),
    )
    outcome = (
        F.when(F.col("blocked").isNull(), "approval")
        .when(F.col("blocked"), "block")
        .when(F.col("marked"), "tests")
        .otherwise("allow")
    )
    return requests.select("request_id").join(seen, "request_id", "left").select(
        "request_id", outcome.alias("prediction")
    )
