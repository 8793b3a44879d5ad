"""Governance relations derived from the warehouse tables.

Every view covers its whole source table. Attributes the warehouse lacks (status, ACL,
policy ids, modes) are assigned by rules over the keys, so that each operator meets all
of its branches; nothing is filtered out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values shared by the views and their SQL twins.
NOW = "2024-02-01 00:00:00"
REVISION = "r1"
TOP_K = 5


class Warehouse:
    """Lazy access to the parquet tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def item_of(self, key: str) -> Column:
        """The benchmark item that goes with a key: items are numbered from 0 without gaps."""
        return F.pmod(F.col(key), self.table("benchmark").agg(F.count(F.lit(1))).scalar())

    # -- knowledge ---------------------------------------------------------------
    @cached_property
    def gdocs(self) -> DataFrame:
        """Governed knowledge entries over all documents, whole texts."""
        return self.table("documents").selectExpr(
            "doc_id AS id",
            "concat(source, ' ', lang) AS title",
            "text AS content",
            "CASE WHEN doc_id % 7 = 0 THEN 'global' ELSE source END AS scope",
            "concat('team-', lang) AS owner",
            "concat('repo://kb/', source, '/', doc_id, '.md') AS source_uri",
            "CASE WHEN doc_id % 11 = 4 THEN 'r2' ELSE 'r1' END AS revision",
            "0.5D + (doc_id % 50) / 100D AS confidence",
            "CASE WHEN doc_id % 13 = 6 THEN timestamp_ntz'2020-01-01 00:00:00' END AS expires_at",
            "CASE doc_id % 3 WHEN 0 THEN array('engineering') "
            "WHEN 1 THEN array('engineering', 'merchant') ELSE array('security') END AS acl",
            "CASE WHEN doc_id % 20 = 3 THEN 'draft' WHEN doc_id % 20 = 5 THEN 'stale' "
            "ELSE 'published' END AS status",
            "CASE WHEN doc_id % 4 = 1 THEN array(concat('p', doc_id % 6)) "
            "ELSE array() END AS policy_ids",
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One search request per benchmark item; the query is the whole item text."""
        return self.table("benchmark").selectExpr(
            "item_id AS request_id",
            "text AS query",
            "concat('src', item_id % 20) AS scope",
            "CASE WHEN item_id % 2 = 0 THEN array('engineering') "
            "ELSE array('security', 'merchant') END AS roles",
            "CASE WHEN item_id % 5 = 4 THEN 'r2' ELSE 'r1' END AS revision",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        """Each document opened once by one request, all requests in turn."""
        docs = self.gdocs.withColumn("request_id", self.item_of("id"))
        asks = self.requests.select(
            "request_id",
            F.col("scope").alias("req_scope"),
            "roles",
            F.col("revision").alias("req_revision"),
        )
        return docs.join(asks, "request_id")

    @cached_property
    def policies(self) -> DataFrame:
        """Policy definitions p0..p5, keyed by part family."""
        return self.table("part").selectExpr(
            "concat('p', p_partkey % 6) AS policy_id",
            "CASE WHEN p_partkey % 3 = 1 THEN 'critical' ELSE 'high' END AS severity",
        ).distinct()

    # -- decisions ---------------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        """Findings over all line items; the four keys identify one finding."""
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        rows = self.table("lineitem").groupBy(*keys).agg(
            F.max("l_tax").alias("l_tax"),
            F.max("l_returnflag").alias("l_returnflag"),
            F.max("l_quantity").alias("l_quantity"),
            F.max("l_linestatus").alias("l_linestatus"),
            F.max("l_discount").alias("l_discount"),
        )
        return rows.selectExpr(
            "l_orderkey AS change_id",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id",
            "element_at(array('medium', 'high', 'critical', 'low'), l_linenumber % 4 + 1) "
            "AS severity",
            "1D - l_tax AS confidence",
            "l_returnflag = 'R' AS violated",
            "l_quantity >= 49 AS critical_unknown",
            "l_linestatus = 'O' AND l_discount >= 0.09D AS public_contract",
            "element_at(array('draft', 'shadow', 'warning', 'blocking'), "
            "cast(l_suppkey % 4 AS INT) + 1) AS policy_mode",
            "concat('owner', l_suppkey % 3) AS required_approver",
        )

    @cached_property
    def changes(self) -> DataFrame:
        """One change per order."""
        return self.table("orders").selectExpr(
            "o_orderkey AS change_id",
            "o_orderstatus <> 'P' OR o_custkey % 2 = 0 AS version_known",
            "CASE WHEN o_orderpriority LIKE '1%' THEN true "
            "WHEN o_orderpriority LIKE '2%' THEN false END AS tests_passed",
            "o_custkey % 5 = 0 AS approval_satisfied",
            "concat('r', o_custkey % 2) AS revision",
        )

    @cached_property
    def required(self) -> DataFrame:
        """Required tests per change."""
        return (
            self.table("lineitem")
            .selectExpr("l_orderkey AS change_id", "concat('t', l_partkey % 9) AS test_id")
            .distinct()
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Test evidence per change; the latest revision wins, a failure beats a pass.

        Every other line is evidence of another test than the one it requires.
        """
        return (
            self.table("lineitem")
            .selectExpr(
                "l_orderkey AS change_id",
                "concat('t', (l_partkey + l_linenumber % 2) % 9) AS test_id",
                "concat('r', l_suppkey % 2) AS revision",
                "l_returnflag <> 'R' AS passed",
            )
            .groupBy("change_id", "test_id")
            .agg(
                F.max("revision").alias("revision"),
                F.bool_and("passed").alias("passed"),
            )
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Truth and prediction per order."""
        states = "array('allow', 'tests', 'approval', 'block')"
        return (
            self.table("orders")
            .selectExpr(
                "o_orderkey AS task_id",
                "o_orderkey",
                "o_custkey",
                "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'block' "
                "WHEN '2' THEN 'approval' WHEN '3' THEN 'tests' ELSE 'allow' END AS truth",
                "o_orderkey % 2 = 0 AS impact",
            )
            .selectExpr(
                "task_id",
                "truth",
                "CASE WHEN o_orderkey % 3 <> 0 THEN truth ELSE element_at("
                f"{states}, cast((o_orderkey * 7 + o_custkey) % 4 AS INT) + 1) END AS prediction",
                "impact",
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        """Decision metric records over all events."""
        return self.table("events").selectExpr(
            "event_id",
            "ts",
            "event_type AS decision",
            "value AS duration_ms",
            "event_id % 9 = 0 AS unknown",
            "cast(event_id % 5 AS INT) AS shadow_findings",
        )

    @cached_property
    def approval_events(self) -> DataFrame:
        """Approval actions; a context is one user on one day."""
        return self.table("events").selectExpr(
            "concat(user_id, '@', date_format(ts, 'yyyy-MM-dd')) AS context_id",
            "event_id AS seq",
            "ts",
            "CASE event_type WHEN 'signup' THEN 'delegate' WHEN 'view' THEN 'request_evidence' "
            "WHEN 'click' THEN 'add_evidence' WHEN 'purchase' THEN 'approve' "
            "ELSE 'reject' END AS action",
            "concat('owner', event_id % 4) AS actor",
            "user_id",
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Labelled policy observations: one per document, policy = source."""
        docs = self.table("documents").select("doc_id", "source")
        labels = self.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        return docs.join(labels, "doc_id", "left").selectExpr(
            "source AS policy_id",
            "doc_id AS sample_id",
            "toxic = 1 AS expected_violation",
            "doc_id % 9 = 0 OR coalesce(toxic = 1 AND doc_id % 5 <> 0, false) "
            "AS policy_triggered",
        )

    # -- graph -------------------------------------------------------------------
    @cached_property
    def edges(self) -> DataFrame:
        """Dependency edges over all parts, suppliers, nations and regions."""
        parts = self.table("part")
        part_ids = parts.selectExpr(
            "p_partkey", "p_size",
            "concat('repo://', lower(replace(p_brand, '#', '-')), '/part/', p_partkey) AS node",
            "concat('repo://', lower(replace(p_brand, '#', '-'))) AS repo",
        )
        pairs = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(
            F.count("*").alias("n")
        )
        maps = (
            pairs.join(part_ids.where("p_size < 49"), F.expr("l_partkey = p_partkey"))
            .selectExpr("node AS source_id", "concat('service://s', l_suppkey) AS target_id",
                        "'MAPS_TO' AS kind", "'AST' AS source", "0.9D AS confidence")
        )
        declares = part_ids.selectExpr(
            "repo AS source_id", "node AS target_id", "'DECLARES' AS kind", "'AST' AS source",
            "0.9D AS confidence")
        deployed = self.table("supplier").selectExpr(
            "concat('service://s', s_suppkey) AS source_id",
            "concat('db://nation/', s_nationkey) AS target_id", "'DEPLOYED_WITH' AS kind",
            "'IDL' AS source", "0.9D AS confidence")
        belongs = self.table("nation").selectExpr(
            "concat('db://nation/', n_nationkey) AS source_id",
            "concat('capability://region-', n_regionkey) AS target_id",
            "'BELONGS_TO_CAPABILITY' AS kind", "'manual' AS source", "1D AS confidence")
        owned = self.table("region").selectExpr(
            "concat('capability://region-', r_regionkey) AS source_id",
            "concat('owner://team-', r_regionkey % 2) AS target_id", "'OWNED_BY' AS kind",
            "'manual' AS source", "1D AS confidence")
        union = maps
        for branch in (declares, deployed, belongs, owned):
            union = union.unionByName(branch)
        return union.selectExpr(
            "*", "concat(kind, ':', source_id, '->', target_id) AS edge_id", "'r1' AS revision",
            "concat('repo://graph/', kind, '/', target_id) AS evidence_uri",
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """Nodes for every endpoint of ``edges`` plus isolated parts."""
        parts = self.table("part").selectExpr(
            "concat('repo://', lower(replace(p_brand, '#', '-')), '/part/', p_partkey) AS id",
            "'Code' AS kind", "p_name AS label",
            "p_size >= 49 AND p_type = 'ECONOMY' AS dynamic")
        repos = self.table("part").selectExpr(
            "concat('repo://', lower(replace(p_brand, '#', '-'))) AS id",
            "'Organization' AS kind", "p_brand AS label", "false AS dynamic").distinct()
        suppliers = self.table("supplier").selectExpr(
            "concat('service://s', s_suppkey) AS id", "'Deployment' AS kind",
            "s_name AS label", "false AS dynamic")
        nations = self.table("nation").selectExpr(
            "concat('db://nation/', n_nationkey) AS id", "'Data' AS kind",
            "n_name AS label", "false AS dynamic")
        capabilities = self.table("region").selectExpr(
            "concat('capability://region-', r_regionkey) AS id", "'Business' AS kind",
            "r_name AS label", "false AS dynamic")
        owners = self.table("region").selectExpr(
            "concat('owner://team-', r_regionkey % 2) AS id", "'Organization' AS kind",
            "concat('team-', r_regionkey % 2) AS label", "false AS dynamic").distinct()
        union = parts
        for branch in (repos, suppliers, nations, capabilities, owners):
            union = union.unionByName(branch)
        return union.withColumn("revision", F.lit(REVISION))

    @cached_property
    def starts(self) -> DataFrame:
        """Changed nodes: every part."""
        return self.table("part").selectExpr(
            "concat('repo://', lower(replace(p_brand, '#', '-')), '/part/', p_partkey) AS start")

    # -- diffs -------------------------------------------------------------------
    @cached_property
    def diffs(self) -> DataFrame:
        """One unified diff per document over its whole text.

        Odd shapes on purpose: adds, deletes, renames, and five kinds of damaged input.
        """
        docs = self.table("documents").selectExpr(
            "doc_id", "source", "text",
            "split(text, '\\n') AS ls",
            "element_at(array('sql', 'proto', 'yaml', 'avsc', 'properties', 'java'), "
            "cast(doc_id % 6 AS INT) + 1) AS ext",
            "doc_id % 10 AS shape",
            "doc_id % 50 AS fault",
        ).selectExpr(
            "*",
            "concat('docs/', source, '/', doc_id) AS stem",
            "size(ls) AS n",
        ).selectExpr(
            "*",
            "CASE WHEN shape = 2 THEN concat(stem, '.md') ELSE concat(stem, '.', ext) END AS old_p",
            "concat(stem, '.', ext) AS new_p",
        )
        body = """CASE
            WHEN shape = 0 THEN array_join(transform(ls, x -> concat('+', x)), '\\n')
            WHEN shape = 1 THEN array_join(transform(ls, x -> concat('-', x)), '\\n')
            ELSE array_join(concat(
                array(concat('-', ls[0]), concat('+', ls[0], ' (changed)')),
                transform(slice(ls, 2, n), x -> concat(' ', x))), '\\n') END"""
        ranges = """concat('@@ -',
            CASE WHEN shape = 0 THEN '0,0' ELSE concat('1,', n + IF(fault = 13, 1, 0)) END, ' +',
            CASE WHEN shape = 1 THEN '0,0' ELSE concat('1,', n) END, ' @@')"""
        return docs.selectExpr(
            "doc_id AS change_id",
            f"""concat_ws('\\n',
                CASE WHEN fault <> 23 THEN concat('diff --git a/', old_p, ' b/', new_p) END,
                CASE WHEN shape = 2 AND fault <> 12 THEN concat('rename from ', old_p) END,
                CASE WHEN shape = 2 THEN concat('rename to ', new_p) END,
                CASE WHEN fault = 33 THEN 'GIT binary patch' END,
                CASE WHEN shape = 0 THEN '--- /dev/null' ELSE concat('--- a/', old_p) END,
                CASE WHEN fault = 43 THEN NULL
                     WHEN shape = 1 THEN '+++ /dev/null'
                     WHEN fault = 3 THEN concat('+++ b/../', new_p)
                     ELSE concat('+++ b/', new_p) END,
                {ranges},
                {body}) AS diff_text""",
            # The stored file: the before state, the after state, a shifted before state
            # or an unrelated file.
            """CASE doc_id % 7
                WHEN 1 THEN array_join(concat(array(concat(ls[0], ' (changed)')), slice(ls, 2, n)), '\\n')
                WHEN 2 THEN concat('# header', '\\n', '# moved', '\\n', text)
                WHEN 3 THEN concat('unrelated ', stem)
                ELSE text END AS stored_text""",
        )

    # -- changes of several files ----------------------------------------------------
    @cached_property
    def changeset_files(self) -> DataFrame:
        """The files of changes over three documents each, with their states before and after.

        A file is a statement of its kind and the whole document as comment lines. Files are added,
        deleted, renamed or modified, the longer ones in two hunks; some are damaged.
        """
        docs = self.table("documents").selectExpr(
            "doc_id", "source", "doc_id div 3 AS change_id",
            "element_at(array('sql', 'proto', 'yaml', 'avsc', 'properties', 'java'), cast(doc_id % 6 AS INT) + 1) AS ext",
            "doc_id % 10 AS shape", "doc_id % 50 AS fault", "split(text, '\\n') AS ls",
        ).selectExpr(
            "*", "concat('docs/', source, '/', doc_id) AS stem",
            """CASE ext WHEN 'sql' THEN IF(doc_id % 4 = 0, 'UPDATE t SET a = 1;', 'BEGIN; UPDATE t SET a = 1; COMMIT;')
                WHEN 'proto' THEN 'message M { int64 id = 1; string s = 2; }' WHEN 'yaml' THEN 'key: value'
                WHEN 'avsc' THEN IF(doc_id % 5 = 0, '{"name": "x"}', '{"name": "x", "version": 1}')
                WHEN 'properties' THEN IF(doc_id % 7 = 0, 'password = hunter2', 'password = $SECRET')
                ELSE 'class X {}' END AS head""",
            "CASE ext WHEN 'sql' THEN '-- ' WHEN 'proto' THEN '// ' WHEN 'java' THEN '// ' ELSE '# ' END AS mark",
        ).selectExpr(
            "*",
            """CASE ext WHEN 'sql' THEN IF(doc_id % 12 = 0, 'BEGIN; DELETE FROM t; COMMIT;', 'DELETE FROM t;')
                WHEN 'proto' THEN IF(doc_id % 12 = 1, 'message M { int64 id = 1; }', concat(head, ' // changed'))
                ELSE concat(head, ' # changed') END AS new_head""",
            "transform(ls, x -> concat(mark, x)) AS rest",
            "CASE WHEN shape = 2 THEN concat(stem, '.md') ELSE concat(stem, '.', ext) END AS old_p",
            "concat(stem, '.', ext) AS new_p",
        ).selectExpr(
            "*", "size(rest) + 1 AS n", "concat(array(head), rest) AS base",
            "shape >= 3 AND size(rest) >= 4 AND size(array_distinct(rest)) = size(rest) AS two",
        )
        return docs.selectExpr(
            "*", "n div 2 AS k", "concat(array(new_head), rest, IF(two, array('tail'), array())) AS done",
        )

    @cached_property
    def changesets(self) -> DataFrame:
        """One unified diff per change over all its files, in the order of documents."""
        extra = "IF(fault = 13, 1, 0)"
        body = f"""CASE
            WHEN shape = 0 THEN concat('@@ -0,0 +1,', n + {extra}, ' @@\\n', array_join(transform(base, x -> concat('+', x)), '\\n'))
            WHEN shape = 1 THEN concat('@@ -1,', n + {extra}, ' +0,0 @@\\n', array_join(transform(base, x -> concat('-', x)), '\\n'))
            WHEN two THEN concat('@@ -1,', k + {extra}, ' +1,', k, ' @@\\n-', head, '\\n+', new_head, '\\n',
                array_join(transform(slice(base, 2, k - 1), x -> concat(' ', x)), '\\n'),
                '\\n@@ -', k + 2, ',', n - k - 1, ' +', k + 2, ',', n - k, ' @@\\n',
                array_join(transform(slice(base, k + 2, n), x -> concat(' ', x)), '\\n'), '\\n+tail')
            ELSE concat('@@ -1,', n + {extra}, ' +1,', n, ' @@\\n-', head, '\\n+', new_head, '\\n',
                array_join(transform(rest, x -> concat(' ', x)), '\\n')) END"""
        parts = self.changeset_files.selectExpr("change_id", "doc_id", f"""concat_ws('\\n',
            concat('diff --git a/', old_p, ' b/', new_p),
            CASE WHEN shape = 2 AND fault <> 12 THEN concat('rename from ', old_p) END,
            CASE WHEN shape = 2 THEN concat('rename to ', new_p) END,
            CASE WHEN fault = 33 THEN 'GIT binary patch' END,
            CASE WHEN shape = 0 THEN '--- /dev/null' ELSE concat('--- a/', old_p) END,
            CASE WHEN fault = 43 THEN NULL WHEN shape = 1 THEN '+++ /dev/null'
                 WHEN fault = 3 THEN concat('+++ b/../', new_p) ELSE concat('+++ b/', new_p) END,
            {body}) AS part""")
        # three documents a change
        whole = parts.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "part"))).alias("parts"))
        return whole.select("change_id", F.array_join(F.col("parts.part"), "\n").alias("diff_text")).selectExpr(
            "change_id", "diff_text",
            "CASE change_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS tests_passed",
            "IF(change_id % 7 = 5, map('__index__', 'r2'), map('core', 'c1', '__index__', 'r1')) AS base_revisions",
            "'p1' AS policy_revision",
            "CASE WHEN change_id % 4 <> 3 THEN concat('ctx', change_id) END AS context_id",
            "sha2('repo', 256) AS repository_digest", "sha2('kb', 256) AS knowledge_digest",
        )

    @cached_property
    def changeset_stored(self) -> DataFrame:
        """Stored files: before or after the change, shifted, or unrelated; renamed ones at either path."""
        return self.changeset_files.where("NOT (shape = 0 AND doc_id % 4 <> 0) AND NOT (shape = 1 AND doc_id % 4 = 1)").selectExpr(
            "change_id", "IF(shape = 2 AND doc_id % 4 < 2, old_p, new_p) AS path",
            """CASE WHEN shape = 0 THEN array_join(base, '\\n') WHEN doc_id % 7 = 1 THEN array_join(done, '\\n')
                WHEN doc_id % 7 = 2 THEN concat(mark, 'header\\n', mark, 'moved\\n', array_join(base, '\\n'))
                WHEN doc_id % 7 = 3 THEN concat('unrelated ', stem) ELSE array_join(base, '\\n') END AS stored_text""",
        )
