"""Views of code-review data over the driver's tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: View name -> query over base tables and other views, whose names stand in braces; two, for Spark and DuckDB, where they differ.
VIEWS: dict[str, str | tuple[str, str]] = {
    "repositories": """SELECT c_custkey AS id, 'owner' || (c_custkey % 40) || '/repo' || (c_custkey % 900) AS full_name, 'https://github.com/owner' || (c_custkey % 40) || '/repo' || (c_custkey % 900) AS url, 'python' AS language FROM {customer}""",
    "repo_urls": """SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN 'https://github.com/own-' || page_id || '/re.po_' || page_id || '.git' WHEN 1 THEN 'git@github.com:own' || page_id || '/repo.git'
        WHEN 2 THEN chr(9) || ' own' || page_id || '/repo/ ' || chr(10) WHEN 3 THEN 'http://github.com/own/repo' || page_id WHEN 4 THEN '' WHEN 5 THEN 'https://github.com/own' || page_id WHEN 6 THEN 'not-a-repo' ELSE url END AS url FROM {pages}""",
    "chunks": """SELECT doc_id AS id, CAST(replace(source, 'src', '') AS int) AS repository_id,
        CASE WHEN doc_id % 7 = 0 THEN lang || '/tests/test_' || (doc_id % 50) || '.py' ELSE lang || '/mod_' || (doc_id % 50) || '.py' END AS file_path,
        CASE WHEN doc_id % 5 = 0 THEN 'validate_' || doc_id WHEN doc_id % 11 = 0 THEN NULL ELSE 'fn_' || doc_id END AS symbol_name,
        1 AS start_line, 1 + length(text) - length(replace(text, chr(10), '')) AS end_line, text AS content, doc_id % 7 = 0 AS is_test FROM {documents}""",
    "query_sets": """SELECT CAST(floor(item_id / 4.0) AS bigint) AS review_id, item_id % 4 AS seq, CAST(floor(item_id / 4.0) AS bigint) % 20 AS repository_id, text FROM {benchmark}""",
    "many_queries": """SELECT CAST(floor(item_id / 10.0) AS bigint) AS review_id, item_id % 10 AS seq, CASE WHEN item_id % 7 = 0 THEN chr(9) || ' ' ELSE text END AS text FROM {benchmark}""",
    "excluded": """SELECT DISTINCT review_id, p AS file_path FROM (SELECT review_id, 'en/mod_' || ((repository_id + 20) % 50) || '.py' AS p FROM {query_sets} UNION ALL SELECT review_id, 'fr/mod_' || (repository_id % 50) || '.py' AS p FROM {query_sets}) x""",
    "vector_chunks": """SELECT vec_id AS id, CAST(label AS bigint) AS repository_id, 'mod_' || (vec_id % 50) || '.py' AS file_path, CASE WHEN vec_id % 41 <> 0 THEN embedding END AS vector FROM {embeddings}""",
    "vector_queries": """SELECT CAST(floor(vec_id / 100.0) AS bigint) AS review_id, CAST(floor((vec_id % 100) / 25.0) AS bigint) AS seq, CAST(label AS bigint) AS repository_id, embedding AS vector FROM {embeddings} WHERE vec_id % 25 = 0""",
    "vector_excluded": """SELECT DISTINCT review_id, 'mod_' || (review_id % 50) || '.py' AS file_path FROM {vector_queries}""",
    "hashed": """SELECT doc_id AS id, CAST(replace(source, 'src', '') AS int) AS repository_id, text AS content, doc_id % 3 <> 0 AS is_old, doc_id % 4 <> 0 AS is_new FROM {documents}""",
    "raw_findings": """SELECT l_orderkey AS review_id, l_linenumber AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q, min(l_discount) AS d FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "findings": """SELECT review_id * 10 + n AS finding_id, review_id, 'mod_' || (pk % 5) || '.py' AS file, CAST(floor(q) AS int) AS start_line, CAST(floor(q) AS int) + n - 3 AS end_line,
        CASE pk % 7 WHEN 0 THEN ' High ' WHEN 1 THEN 'critical' WHEN 2 THEN 'LOW' WHEN 3 THEN 'bogus' WHEN 4 THEN NULL WHEN 5 THEN 'info' ELSE 'medium' END AS severity,
        CASE sk % 6 WHEN 0 THEN 'business_logic' WHEN 1 THEN ' Security' WHEN 2 THEN 'cross_file' WHEN 3 THEN 'test_coverage' WHEN 4 THEN NULL ELSE 'maintainability' END AS category,
        d * CAST(12 AS double) - CAST(0.1 AS double) AS confidence FROM {raw_findings}""",
    "changed_lines": """SELECT l_orderkey AS review_id, 'mod_' || (l_partkey % 5) || '.py' AS filename, CAST(floor(l_quantity) AS int) + 4 * CAST(l_suppkey % 3 AS int) - 2 AS first, CAST(least(4, l_linenumber + 1) AS int) AS n FROM {lineitem} WHERE l_linenumber <= 5""",
    "added_lines": (
        "SELECT review_id, filename, first + k AS line FROM {changed_lines} LATERAL VIEW explode(sequence(0, n - 1)) AS k",
        "SELECT review_id, filename, first + CAST(k AS int) AS line FROM {changed_lines}, unnest(range(n)) AS t(k)",
    ),
    "source_facts": """SELECT DISTINCT review_id, filename, CAST(20 + review_id % 40 AS int) AS n_lines, CAST(1 + review_id % 7 AS int) AS s1, CAST(30 + review_id % 11 AS int) AS e1 FROM {changed_lines} WHERE review_id % 4 <> 0""",
    "static_hits": """SELECT l_orderkey AS review_id, l_orderkey * 10 + l_linenumber AS id, 'rule-' || (l_suppkey % 9) AS rule_id, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'src/mod_' || (l_partkey % 5) || '.py' ELSE 'mod_' || (l_partkey % 5) || '.py' END AS file_path,
        CAST(floor(l_quantity) AS int) AS start_line, CAST(floor(l_quantity) AS int) + 2 AS end_line, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'warning' END AS severity, ' see line ' || l_linenumber || ' ' AS message FROM {lineitem} WHERE l_returnflag = 'R'""",
    # hunks with up to 3 context, 2 removed and 4 added lines, some of them written like file headers; a second one for even numbers
    "patch_parts": """SELECT review_id * 10 + n AS file_id, n, CAST(floor(q) AS int) AS o, CAST(pk % 4 AS int) AS a, CAST(sk % 5 AS int) AS b, CAST(pk % 3 AS int) AS c, CAST(CASE WHEN sk % 7 = 0 THEN 1 ELSE 0 END AS int) AS p FROM {raw_findings}""",
    "patches": """SELECT file_id, a, b, c, CASE WHEN file_id % 23 <> 0 THEN '@@ -' || o || ',' || (a + c + p + 1) || ' +' || (o + 2) || ',' || (a + b + p + 1) || ' @@ def f' || chr(10) || repeat(' ctx' || chr(10), a) || repeat('-old' || chr(10), c) || repeat('--- old note' || chr(10), p)
        || repeat('+++ counter;' || chr(10), p) || repeat('+new' || chr(10), b) || chr(10) || CASE WHEN a = 2 THEN '\\ No newline at end of file' || chr(10) ELSE '' END
        || CASE WHEN n % 2 = 0 THEN '@@ -' || (o + 40) || ' +' || (o + 50) || ',2 @@' || chr(10) || '-cut' || chr(10) || '+tail' || chr(10) || '+end ' || file_id || chr(10) ELSE '' END END AS patch FROM {patch_parts}""",
    "stored_pulls": """SELECT o_custkey % 20 AS repository_id, o_orderkey AS number, 'old ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS state, 'sha' || o_orderkey AS head_sha,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS github_updated_at, CASE o_orderkey % 3 WHEN 0 THEN 'sha' || o_orderkey WHEN 1 THEN 'stale' ELSE NULL END AS last_reviewed_sha, 'kept ' || o_custkey AS description FROM {orders}""",
    "live_pulls": """SELECT o_custkey % 20 AS repository_id, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS number, 'new ' || o_orderkey AS title, 'open' AS state, 'head' || o_orderkey AS head_sha, o_orderdate AS github_updated_at
        FROM {orders} WHERE o_orderkey % 4 <> 0 AND o_custkey % 20 < 15""",
    "refreshed": """SELECT DISTINCT o_custkey % 20 AS repository_id FROM {orders} WHERE o_custkey % 20 < 18""",
    "reviews": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS pull_request_id, max(l_shipdate) AS created_at, 'st' || min(l_suppkey % 4) AS status FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "lifecycle": """SELECT user_id AS review_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, event_type AS stage, CASE event_type WHEN 'error' THEN props ELSE '' END AS error FROM {events}""",
    "feedback": """SELECT event_id, value AS score, user_id * 10 + 1 AS finding_id, CASE event_type WHEN 'view' THEN 'helpful' WHEN 'click' THEN 'not_helpful' WHEN 'error' THEN 'false_positive' WHEN 'signup' THEN 'maybe' ELSE NULL END AS verdict FROM {events}""",
}


_NL = "chr(10)"
#: The files of a whole diff made of each patch: place, path, status, header, hunks and condition.
PIECES = [
    (0, "'one.py'", "modified", f"'diff --git a/one.py b/one.py' || {_NL} || 'index 1..2 100644' || {_NL} || '--- a/one.py' || {_NL} || '+++ b/one.py' || {_NL}", "coalesce(patch, '')", "true"),
    (1, "'new' || (file_id % 3) || '.py'", "added", f"'diff --git a/new' || (file_id % 3) || '.py b/new' || (file_id % 3) || '.py' || {_NL} || 'new file mode 100644' || {_NL} || '--- /dev/null' || {_NL} || '+++ b/new' || (file_id % 3) || '.py' || {_NL}", f"'@@ -0,0 +1,' || b || ' @@' || {_NL} || repeat('+a' || {_NL}, b)", "b > 0"),
    (2, "'gone.py'", "removed", f"'diff --git a/gone.py b/gone.py' || {_NL} || '--- a/gone.py' || {_NL} || '+++ /dev/null' || {_NL}", f"'@@ -1,' || (a + 1) || ' +0,0 @@' || {_NL} || repeat('-a' || {_NL}, a + 1)", "true"),
    (3, "'moved.py'", "renamed", f"'diff --git a/old.py b/moved.py' || {_NL} || 'rename from old.py' || {_NL} || 'rename to moved.py' || {_NL} || CASE WHEN c > 0 THEN '--- a/old.py' || {_NL} || '+++ b/moved.py' || {_NL} ELSE '' END", f"CASE WHEN c > 0 THEN '@@ -' || (5 + a) || ' +' || (5 + a) || ' @@' || {_NL} || '-a' || {_NL} || '+b' || {_NL} ELSE '' END", "true"),
]
VIEWS["diff_pieces"] = " UNION ALL ".join(f"SELECT file_id, {pos} AS pos, {path} AS path, '{status}' AS status, {patch} AS patch FROM {{patches}} WHERE {when}" for pos, path, status, _, patch, when in PIECES)
VIEWS["whole_diffs"] = "SELECT file_id, " + " || ".join(f"CASE WHEN {when} THEN {head} || {patch} ELSE '' END" for *_, head, patch, when in PIECES) + " AS diff FROM {patches}"


def _sql(name: str, dialect: int) -> str:
    return VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][dialect]


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Base tables and views of one input folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in VIEWS:
                self._held[name] = self.spark.sql(_sql(name, 0).replace("\\", "\\\\"), **{n: getattr(self, n) for n in _names(_sql(name, 0))})
            elif name in TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._held[name]


def oracle(body: str) -> str:
    """DuckDB SQL with every view that the body names in braces as a common table."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for name in _names(sql):
            if name in VIEWS and name not in needed:
                need(_sql(name, 1))
                needed.append(name)

    need(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS or m[1] in TABLES else m[0], sql)
    ctes = [f"{n} AS ({plain(_sql(n, 1))})" for n in needed]
    text = plain(body).strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, text[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + text
