"""Retrieval and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import session
from tidegate.catalog.base import query
from tidegate.catalog.filters import now, with_reason
from tidegate.catalog.metrics import DIGEST_SQL, FILE_HASH_SQL, WORDS_SQL, base_files
from tidegate.catalog.oracle_views import add_view
from tidegate.functions import text
from tidegate.operators import context, joins, metrics, retrieval, vectors
from tidegate.plans.views import TOP_K

LEX = "'[\\p{L}\\p{N}_-]+'"
IDX = "'[\\p{L}\\p{N}]+'"

add_view("toks", "gdocs", f"""SELECT id, regexp_extract_all(lower(title || ' ' || content), {IDX}) AS tokens,
    len(regexp_extract_all(lower(title || ' ' || content), {IDX})) AS dl FROM gdocs""")
add_view("postings", "toks", """SELECT term, id, dl, count(*) AS tf
    FROM (SELECT id, dl, unnest(tokens) AS term FROM toks) GROUP BY ALL""")
add_view("qt", "requests", f"""SELECT request_id, unnest(list_distinct(regexp_extract_all(lower(query), {IDX}))) AS term
    FROM requests""")
add_view("bm", "toks postings qt", """
    SELECT request_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
    FROM qt JOIN postings USING (term) JOIN (SELECT term, count(*) AS df FROM postings GROUP BY 1) USING (term),
      (SELECT count(*) AS n, avg(dl) AS avgdl FROM toks)
    GROUP BY request_id, id
    HAVING count(*) = (SELECT count(*) FROM qt q WHERE q.request_id = qt.request_id)""")
add_view("pairs", "gdocs requests", f"""
    SELECT request_id, id, policy_ids, content,
      CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)) END AS vector
    FROM (SELECT r.request_id, g.id, g.policy_ids, g.content, qa AS a, gb AS b
      FROM (SELECT *, list_distinct(regexp_extract_all(lower(title || ' ' || content), {LEX})) AS gb FROM gdocs) g
      JOIN (SELECT *, list_distinct(regexp_extract_all(lower(query), {LEX})) AS qa FROM requests) r
        ON g.status = 'published' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-02-01')
        AND g.revision = r.revision AND g.scope IN ('global', r.scope) AND list_has_any(acl, roles))""")
add_view("hybrid", "pairs bm", """
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rerank DESC, id) AS position FROM (
      SELECT request_id, id, policy_ids, content, coalesce(bm25, 0.0) AS bm25, vector,
        0.65::DOUBLE * coalesce(bm25, 0.0) + 0.35::DOUBLE * vector AS rerank
      FROM pairs LEFT JOIN bm USING (request_id, id)) QUALIFY position <= 5""")


@query("inverted_index", "SELECT term, id, dl, tf FROM postings", "postings")
def inverted_index(w):
    return retrieval.inverted_index(w.gdocs).withColumn("dl", F.col("dl").cast("long"))


@query("index_terms", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM postings GROUP BY 1", "postings")
def index_terms(w):
    return retrieval.index_terms(retrieval.inverted_index(w.gdocs))


@query("corpus_stats", "SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM toks", "toks")
def corpus_stats(w):
    return retrieval.corpus_stats(w.gdocs).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25", "SELECT request_id, id, round(bm25, 6) AS bm25 FROM bm", "bm")
def bm25(w):
    return retrieval.bm25(w.requests, w.gdocs).withColumn("bm25", F.round("bm25", 6))


@query("score_left_join", """
    SELECT a.id, a.request_id, round(coalesce(bm25, 0.0), 6) AS bm25
    FROM attempts a LEFT JOIN bm ON bm.id = a.id AND bm.request_id = a.request_id""", "attempts bm")
def score_left_join(w):
    scores = retrieval.bm25(w.requests, w.gdocs)
    return w.attempts.select("id", "request_id").join(scores, ["request_id", "id"], "left").select(
        "id", "request_id", F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25"))


@query("governed_candidates", f"""
    SELECT id, request_id, reason, CASE WHEN reason IS NULL THEN
      round(len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)), 6) END AS vector
    FROM (SELECT x.*, list_distinct(regexp_extract_all(lower(title || ' ' || content), {LEX})) AS b,
        list_distinct(regexp_extract_all(lower(query), {LEX})) AS a,
        CASE WHEN status = 'stale' OR expires_at < TIMESTAMP '2024-02-01' THEN 'stale'
          WHEN status <> 'published' THEN 'status_not_published'
          WHEN x.revision <> req_revision THEN 'revision_mismatch'
          WHEN x.scope <> 'global' AND x.scope <> req_scope THEN 'scope_mismatch'
          WHEN NOT list_has_any(acl, x.roles) THEN 'acl_denied' END AS reason
      FROM attempts x JOIN requests r USING (request_id))""", "attempts requests")
def governed_candidates(w):
    rows = with_reason(w.attempts).join(w.requests.select("request_id", "query"), "request_id")
    score = text.set_cosine(text.lexical_tokens(F.col("query")), retrieval.vector_tokens())
    return rows.select("id", "request_id", "reason",
                       F.when(F.col("reason").isNull(), F.round(score, 6)).alias("vector"))


@query("hybrid_search", """SELECT request_id, position, id, round(bm25, 6) AS bm25, round(vector, 6) AS vector,
    round(rerank, 6) AS rerank FROM hybrid""", "hybrid")
def hybrid_search(w):
    found = retrieval.hybrid_search(w.requests, w.gdocs, now(), TOP_K)
    return found.select("request_id", "position", "id", *[F.round(c, 6).alias(c) for c in ("bm25", "vector", "rerank")])


@query("score_fusion", """SELECT request_id, id, round(0.65 * bm25 + 0.35 * coalesce(vector, 0.0), 6)::DOUBLE AS fused
    FROM bm LEFT JOIN pairs USING (request_id, id)""", "bm pairs")
def score_fusion(w):
    asked = w.requests.withColumn("q", F.array_distinct(text.lexical_tokens(F.col("query"))))
    scores = session.cut_lineage(retrieval.bm25(w.requests, w.gdocs))
    matched = w.gdocs.join(scores.select("id").distinct(), "id", "left_semi").withColumn(
        "d", retrieval.vector_tokens())
    pairs = retrieval.eligible_pairs(asked, matched, now()).select(
        "request_id", "id", text.distinct_cosine(F.col("q"), F.col("d")).alias("vector"))
    scores = scores.join(pairs, ["request_id", "id"], "left")
    return scores.select("request_id", "id", F.round(retrieval.fused(F.col("bm25"), F.col("vector")), 6).alias("fused"))


@query("mandatory_policies", """SELECT DISTINCT request_id, policy_id FROM (SELECT request_id, unnest(policy_ids) AS policy_id
    FROM pairs) JOIN policies USING (policy_id) WHERE severity = 'critical'""", "pairs policies")
def mandatory_policies(w):
    return retrieval.mandatory_policies(w.requests, w.gdocs, w.policies, now())


add_view("naive_rank", "bm", """SELECT request_id, id, row_number() OVER (PARTITION BY request_id
    ORDER BY bm25 DESC, id) AS position FROM bm QUALIFY position <= 5""")
add_view("leaks", "naive_rank hybrid gdocs requests pairs policies", """
    SELECT request_id, misplaced, coalesce(stale_leaks, 0) AS stale_leaks, coalesce(acl_leaks, 0) AS acl_leaks,
      policy_ok, misplaced = 0 AND coalesce(leaks, 0) = 0 AND coalesce(policy_ok, true) AS passed
    FROM (SELECT request_id, count(*) FILTER (n.id IS DISTINCT FROM h.id) AS misplaced
      FROM naive_rank n FULL JOIN hybrid h USING (request_id, position) GROUP BY 1)
    LEFT JOIN (SELECT request_id, count(*) FILTER (kind = 'stale') AS stale_leaks,
        count(*) FILTER (kind = 'acl_denied') AS acl_leaks, count(*) AS leaks FROM (
        SELECT n.request_id, CASE WHEN status = 'stale' OR expires_at < TIMESTAMP '2024-02-01' THEN 'stale'
          WHEN NOT list_has_any(acl, roles) THEN 'acl_denied' END AS kind
        FROM naive_rank n JOIN gdocs g USING (id) JOIN requests r ON r.request_id = n.request_id)
        WHERE kind IS NOT NULL GROUP BY 1) USING (request_id)
    LEFT JOIN (SELECT request_id, bool_and(policy_id IN (SELECT policy_id FROM policies WHERE severity = 'critical')) AS policy_ok
      FROM (SELECT DISTINCT request_id, unnest(policy_ids) AS policy_id FROM pairs) GROUP BY 1) USING (request_id)""")


def leak_report(w):
    scores = session.cut_lineage(retrieval.bm25(w.requests, w.gdocs))
    actual = retrieval.top_k(scores, ["request_id"], [F.desc("bm25"), F.asc("id")], TOP_K)
    expected = retrieval.hybrid_search(w.requests, w.gdocs, now(), TOP_K, scores)
    facts = w.gdocs.select("id", "status", "expires_at", "acl")
    kind = F.when((F.col("status") == "stale") | (F.col("expires_at") < now()), "stale").when(
        ~F.arrays_overlap("acl", "roles"), "acl_denied")
    forbidden = actual.select("request_id", "id").join(facts, "id").join(
        w.requests.select("request_id", "roles"), "request_id").select(
        "request_id", "id", kind.alias("kind")).where("kind IS NOT NULL")
    required = retrieval.mandatory_policies(
        w.requests, w.gdocs, w.policies.withColumn("severity", F.lit("critical")), now())
    mandatory = retrieval.mandatory_policies(w.requests, w.gdocs, w.policies, now())
    return retrieval.retrieval_leaks(actual, expected, forbidden, mandatory, required)


@query("retrieval_leaks", "SELECT * FROM leaks", "leaks")
def retrieval_leaks(w):
    return leak_report(w)


@query("leak_summary", """SELECT count(*) AS query_count,
    round(coalesce(count(*) FILTER (policy_ok) / nullif(count(policy_ok), 0), 1.0), 6) AS mandatory_policy_recall,
    round(sum(stale_leaks) / count(*), 6) AS stale_knowledge_rate, sum(acl_leaks)::BIGINT AS acl_leak_count
    FROM leaks""", "leaks")
def leak_summary(w):
    return retrieval.leak_summary(leak_report(w)).withColumns({
        c: F.round(c, 6) for c in ("mandatory_policy_recall", "stale_knowledge_rate")})


@query("rag_baseline", """
    SELECT request_id, CASE WHEN b IS NULL THEN 'approval' WHEN b THEN 'block' WHEN m THEN 'tests' ELSE 'allow' END AS prediction
    FROM requests LEFT JOIN (SELECT request_id, bool_or(list_contains(policy_ids, 'p1')) AS b,
      bool_or(contains(lower(content), 'token')) AS m FROM hybrid GROUP BY 1) USING (request_id)""", "requests hybrid")
def rag_baseline(w):
    found = retrieval.hybrid_search(w.requests, w.gdocs, now(), TOP_K).select("request_id", "id").join(
        w.gdocs.select("id", "policy_ids", "content"), "id")
    return retrieval.rag_baseline(w.requests, found, "p1", "token")


@query("full_text_injection", f"""
    SELECT change_id, contract_id, section, n_files AS n_documents, digest AS knowledge_digest FROM (
      SELECT DISTINCT l_orderkey AS change_id, p_partkey AS contract_id,
        '## Contract: ' || p_partkey || chr(10) || p_name AS section
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'ECONOMY'),
    (SELECT n_files, {DIGEST_SQL} AS digest FROM (SELECT count(*) AS n_files, {WORDS_SQL}
      FROM (SELECT {FILE_HASH_SQL} AS h FROM base_files)))""", "base_files")
def full_text_injection(w):
    contracts = w.table("part").where("p_type <> 'ECONOMY'").selectExpr(
        "p_partkey", "concat('## Contract: ', p_partkey, '\\n', p_name) AS section")
    matched = w.table("lineitem").select("l_orderkey", "l_partkey").distinct().join(
        contracts, F.expr("l_partkey = p_partkey"))
    # The corpus is named by its digest, not copied into every change.
    corpus = metrics.content_digests(base_files(w).withColumn("corpus", F.lit("kb")), ["corpus"], "path", "content")
    return matched.select(
        F.col("l_orderkey").alias("change_id"), F.col("p_partkey").alias("contract_id"), "section",
        corpus.select("n_files").scalar().alias("n_documents"),
        corpus.select("digest").scalar().alias("knowledge_digest"))


# -- vectors -----------------------------------------------------------------------------

add_view("cent", "", """SELECT label::BIGINT AS query_id, list(x ORDER BY dim) AS q FROM (
    SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
      generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
add_view("sims", "cent", """SELECT query_id, vec_id, label::BIGINT AS label,
    list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM embeddings, cent""")
add_view("near", "sims", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)
    AS position FROM sims QUALIFY position <= 10""")


def label_queries(w):
    return vectors.centroids(w.table("embeddings"), "label", "embedding").select(
        F.col("label").cast("long").alias("query_id"), "query")


def nearest(w, k=10):
    return vectors.topk_vector(w.table("embeddings"), label_queries(w), k)


@query("topk_vector", "SELECT query_id, vec_id, position, round(score, 6) AS score FROM near", "near")
def topk_vector(w):
    return nearest(w).withColumn("score", F.round("score", 6))


@query("recall_at_k", """
    SELECT count(*) AS n_queries, round(avg(h1), 6) AS recall_at_1, round(avg(h5), 6) AS recall_at_5 FROM (
      SELECT query_id, bool_or(position <= 1 AND label % 3 = (query_id + 1) % 3)::INT AS h1,
        bool_or(position <= 5 AND label % 3 = (query_id + 1) % 3)::INT AS h5 FROM near GROUP BY 1)""", "near")
def recall_at_k(w):
    labelled = nearest(w).join(w.table("embeddings").select("vec_id", "label"), "vec_id").withColumn(
        "relevant", F.expr("label % 3 = (query_id + 1) % 3"))
    result = metrics.recall_at_k(labelled, [1, 5])
    return result.withColumns({c: F.round(c, 6) for c in ("recall_at_1", "recall_at_5")})


@query("best_chunk_score", "SELECT query_id, label AS doc_id, round(max(score), 6) AS score FROM sims GROUP BY 1, 2", "sims")
def best_chunk_score(w):
    chunks = w.table("embeddings").withColumn("doc", F.col("label").cast("long"))
    return vectors.best_chunk_scores(chunks, label_queries(w), doc="doc").withColumn("score", F.round("score", 6))


@query("cosine", "SELECT vec_id, round(score, 6) AS score FROM sims WHERE query_id = label", "sims")
def cosine(w):
    own = label_queries(w).withColumnRenamed("query_id", "label")
    rows = w.table("embeddings").join(own, "label")
    return rows.select("vec_id", F.round(vectors.cosine(F.col("query"), F.col("embedding")), 6).alias("score"))


@query("vector_quality", """
    SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN 'embedding vectors must not be empty'
      WHEN 2 THEN 'embedding vectors must have matching dimensions' WHEN 3 THEN 'embedding vectors must be finite'
      WHEN 4 THEN 'embedding vectors must not be zero' END AS fault FROM embeddings""")
def vector_quality(w):
    rows = w.table("embeddings").selectExpr("vec_id", """CASE vec_id % 10
        WHEN 1 THEN slice(embedding, 1, 0) WHEN 2 THEN slice(embedding, 1, 63)
        WHEN 3 THEN transform(embedding, (x, i) -> IF(i = 9, float('NaN'), x))
        WHEN 4 THEN transform(embedding, x -> float(0)) ELSE embedding END AS v""")
    return vectors.vector_faults(rows, "v", 64).select("vec_id", "fault")


@query("embed_cache_miss", """
    SELECT DISTINCT sha256(concat_ws(chr(31), 'hashing', 'v1', '32', text)) AS key, 32::BIGINT AS dims, true AS unit
    FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')""")
def embed_cache_miss(w):
    docs = w.table("documents")
    args = ("text", "hashing", "v1", 32)
    none = w.spark.createDataFrame([], "key STRING")
    folder = session.scratch_dir(w.spark, "embeddings")
    first = vectors.cache_misses(docs.where("lang = 'en'"), none, *args)
    vectors.embed_misses(first, 32).write.parquet(folder)
    misses = vectors.cache_misses(docs, w.spark.read.parquet(folder), *args)
    return vectors.embed_misses(misses, 32).select(
        "key", F.size("vector").cast("long").alias("dims"),
        (F.abs(vectors.norm(F.col("vector")) - 1.0) < 1e-4).alias("unit"))


# -- symbol candidates -------------------------------------------------------------------


@query("symbol_candidates", f"""
    WITH tasks AS (SELECT p_brand AS task_id, 'change the ' || max(p_name) || ' of ' || lower(max(p_type)) || ' line' AS task,
        CASE WHEN p_brand LIKE '%3' THEN 'no-such-repo' ELSE lower(replace(p_brand, '#', '-')) END AS repo,
        CASE WHEN p_brand LIKE '%4' THEN 'repo://elsewhere' WHEN length(p_brand) = 7 THEN max(node) END AS hint
      FROM part_ids GROUP BY p_brand),
      c AS (SELECT task_id, task, hint, n.id, n.label, lower(n.id || ' ' || n.label) AS txt,
        list_distinct(regexp_extract_all(lower(task), {LEX})) AS terms FROM tasks JOIN nodes n ON contains(n.id, repo)),
      s AS (SELECT *, len(list_filter(terms, lambda t: contains(txt, t))) AS hits,
        len(list_intersect(terms, b)) / sqrt(len(terms)::DOUBLE * len(b)) AS sem, coalesce(id = hint, false) AS hinted
        FROM (SELECT *, list_distinct(regexp_extract_all(txt, {LEX})) AS b FROM c)),
      r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN hinted THEN 100.0 ELSE 0.0 END + hits + sem DESC,
          CASE WHEN contains(label, '.') THEN 4 ELSE 3 END DESC, id) AS position,
        CASE WHEN hinted THEN 1.0 ELSE least(0.95::DOUBLE, hits / greatest(1, len(terms)) + 0.35::DOUBLE * sem) END AS conf FROM s),
      lost AS (SELECT t.task_id, CASE WHEN count(r.id) = 0 THEN 'no indexed symbols in requested repositories'
          WHEN any_value(t.hint) IS NOT NULL AND NOT bool_or(r.hinted)
            THEN 'hint_symbols contain no indexed symbol in the requested repositories' END AS fault
        FROM tasks t LEFT JOIN r USING (task_id) GROUP BY t.task_id)
    SELECT task_id, position, id, round(first_conf, 6) AS confidence, NULL AS fault FROM (
      SELECT *, max(CASE WHEN position = 1 THEN conf END) OVER (PARTITION BY task_id) AS first_conf FROM r)
    WHERE (position = 1 OR (position <= 3 AND first_conf < 0.35)) AND task_id IN (SELECT task_id FROM lost WHERE fault IS NULL)
    UNION ALL SELECT task_id, NULL, NULL, NULL, fault FROM lost WHERE fault IS NOT NULL""", "part_ids nodes")
def symbol_candidates(w):
    """One task for each brand; some ask for a repository or a hint that is not indexed."""
    tasks = w.table("part").groupBy("p_brand").agg(
        F.max("p_name").alias("name"), F.max("p_type").alias("type"),
        F.expr("max(concat('repo://', lower(replace(p_brand, '#', '-')), '/part/', p_partkey))").alias("top")
    ).selectExpr("p_brand AS task_id", "concat('change the ', name, ' of ', lower(type), ' line') AS task",
                 "array(IF(p_brand LIKE '%3', 'no-such-repo', lower(replace(p_brand, '#', '-')))) AS repos",
                 "CASE WHEN p_brand LIKE '%4' THEN array('repo://elsewhere') WHEN length(p_brand) = 7 THEN array(top) "
                 "ELSE array() END AS hints")
    return context.symbol_candidates(tasks, w.nodes).select(
        "task_id", "position", F.col("symbol").alias("id"), F.round("confidence", 6).alias("confidence"), "fault")
