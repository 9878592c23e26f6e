"""The library's operators as queries over the test tables, with the same queries in DuckDB's SQL.

The test tables hold no code: each operator runs on a table of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import changes, graph, history, lines, rules, scoring, sessions, similarity
from ..operators.rules import Rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


RULES = [
    Rule("assigned-secret", "error", "A secret is assigned", r"(?i)(api_key|secret|token|passw(or)?d)\s*[=:]\s*\S{6,}"),
    Rule("mail-address", "warning", "A mail address", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"),
    Rule("licence", "info", "A licence is named", r"(?i)\b(licensed|released) under\b"),
    Rule("junk", "warning", "A run of symbols", r"[#*$%&]{3}"),
]
_CASES = [
    ("assigned-secret", "error", r"(?i)(api_key|secret|token|passw(or)?d)\s*[=:]\s*\S{6,}"),
    ("mail-address", "warning", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+"),
    ("licence", "info", r"(?i)\b(licensed|released) under\b"),
    ("junk", "warning", r"[#*$%&]{3}"),
]
LINES_SQL = "line AS (SELECT doc_id, source, i AS line_no, s[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i))"
HITS_SQL = LINES_SQL + ", hit AS (" + " UNION ALL ".join(
    f"SELECT doc_id, source, line_no, '{r}' AS rule_id, '{s}' AS severity, {i} AS rule_ord FROM line WHERE regexp_matches(text, '{p}')" for i, (r, s, p) in enumerate(_CASES)
) + ")"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_of(read(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(doc_lines(spark, sf_dir), RULES)


CARD_SQL = f"""
WITH {HITS_SQL}, size AS (SELECT source AS repo, count(*) AS n FROM documents GROUP BY 1),
kind AS (SELECT * FROM (VALUES ('security', 'secrets', 'error', 30.0, 10.0), ('integrity', 'mail', 'warning', 30.0, 0.25), ('debt', 'junk', 'warning', 30.0, 0.05)) AS t(category, name, severity, e, w)),
cnt AS (SELECT source AS repo, count(*) FILTER (severity = 'error') AS n_err, count(*) FILTER (rule_id = 'mail-address') AS n_mail, count(*) FILTER (rule_id = 'junk') AS n_junk FROM hit GROUP BY 1),
chk AS (
  SELECT size.repo, category, name, greatest(0.0, 100 - (CASE WHEN n <= 10 THEN 1.0 ELSE greatest(0.3, 1 - 0.4 * log10(n / 10.0)) END)
    * (CASE name WHEN 'secrets' THEN e * coalesce(n_err, 0) WHEN 'mail' THEN w * coalesce(n_mail, 0) ELSE w * coalesce(n_junk, 0) END)) AS score
  FROM size CROSS JOIN kind LEFT JOIN cnt ON cnt.repo = size.repo),
cat AS (SELECT repo, category, floor(avg(CASE WHEN name = 'secrets' THEN score ELSE greatest(25.0, score) END) + 0.5) AS score FROM chk GROUP BY 1, 2),
card AS (SELECT repo, CAST(floor(sum(score * CASE category WHEN 'debt' THEN 0.15 ELSE 0.20 END) / sum(CASE category WHEN 'debt' THEN 0.15 ELSE 0.20 END) + 0.5) AS BIGINT) AS score FROM cat GROUP BY 1)
"""
_GRADE_SQL = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score cards of document sources: three checks of three categories, scaled by size."""
    size = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("n"))
    hits = doc_hits(spark, sf_dir).groupBy(F.col("source").alias("repo")).agg(
        F.count_if(F.col("severity") == "error").alias("secrets"), F.count_if(F.col("rule_id") == "mail-address").alias("mail"), F.count_if(F.col("rule_id") == "junk").alias("junk")
    )
    scale = X.size_scale(F.col("n"), 10, 0.4, 0.3)
    points = {"secrets": ("security", 30.0), "mail": ("integrity", 0.25), "junk": ("debt", 0.05)}
    checks = F.array(
        *[F.struct(F.lit(c).alias("category"), F.lit(k).alias("name"), X.clamp(100.0 - scale * (w * F.coalesce(k, F.lit(0)))).alias("score")) for k, (c, w) in points.items()]
    )
    each = size.join(hits, "repo", "left").select("repo", F.explode(checks).alias("c")).select("repo", "c.*")
    return scoring.scorecards(scoring.categories(each))


@query(CARD_SQL + f"SELECT repo, score, {_GRADE_SQL} AS grade, score >= 60 AS passed FROM card")
def scorecard_by_source(spark, sf_dir):
    return cards(spark, sf_dir)


@query(CARD_SQL + f"SELECT {_GRADE_SQL} AS grade, count(*) AS n FROM card GROUP BY 1")
def grade_histogram(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n"))


@query(f"WITH {HITS_SQL} SELECT doc_id, line_no, rule_id, severity FROM hit")
def line_rule_scan(spark, sf_dir):
    return doc_hits(spark, sf_dir).select("doc_id", "line_no", "rule_id", "severity")


@query(f"WITH {HITS_SQL} SELECT doc_id, line_no, arg_min(rule_id, rule_ord) AS rule_id FROM hit GROUP BY 1, 2")
def first_rule_per_line(spark, sf_dir):
    return doc_lines(spark, sf_dir).withColumn("rule_id", rules.first_rule(F.col("text"), RULES)).where("rule_id IS NOT NULL").select("doc_id", "line_no", "rule_id")


@query(f"WITH {HITS_SQL} SELECT source, rule_id, severity, count(*) AS n FROM hit GROUP BY GROUPING SETS ((source), (source, rule_id), (severity), ())")
def issue_counts_grouping_sets(spark, sf_dir):
    hits = doc_hits(spark, sf_dir)
    sets = [[F.col("source")], [F.col("source"), F.col("rule_id")], [F.col("severity")], []]
    return hits.groupingSets(sets, "source", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(
    f"WITH {HITS_SQL} SELECT source, doc_id, line_no, rule_id FROM hit WHERE severity <> 'info' "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, doc_id, line_no, rule_id) <= 5"
)
def top_fixes(spark, sf_dir):
    return scoring.top_fixes(doc_hits(spark, sf_dir), ["source"], ["doc_id", "line_no", "rule_id"]).select("source", "doc_id", "line_no", "rule_id")


@query(
    f"WITH {LINES_SQL} SELECT doc_id, line_no FROM (SELECT *, coalesce(sum(CASE WHEN contains(text, '|') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM line) WHERE inside"
)
def toggle_parity(spark, sf_dir):
    return lines.with_parity(doc_lines(spark, sf_dir), ["doc_id"], F.contains("text", F.lit("|"))).where("inside").select("doc_id", "line_no")


@query(
    f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, bool_or(contains(text, '@')) OVER (PARTITION BY doc_id ORDER BY line_no "
    "ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM line) WHERE near GROUP BY 1"
)
def context_pm5(spark, sf_dir):
    near = lines.with_context(doc_lines(spark, sf_dir), ["doc_id"], F.contains("text", F.lit("@")), 5)
    return near.where("near").groupBy("doc_id").agg(F.count("*").alias("n_near"))


@query(
    f"WITH {LINES_SQL}, sec AS (SELECT *, sum(CASE WHEN length(text) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM line) "
    "SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(arg_min(text, line_no) FILTER (length(text) < 20), '(intro)') AS title, count(*) AS n_lines, "
    "CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(ceil(sum(strlen(text) + 1) / 4.0) AS BIGINT) AS est_tokens FROM sec GROUP BY 1, 2"
)
def sections(spark, sf_dir):
    return lines.sections(doc_lines(spark, sf_dir), ["doc_id"], F.length("text") < 20)


_WINDOWS_SQL = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
w AS (SELECT doc_id, i AS start, md5(array_to_string(s[i:i + 2], chr(10))) AS h FROM l, unnest(range(1, len(s) - 1)) AS t(i) WHERE length(array_to_string(s[i:i + 2], chr(10))) >= 40),
f AS (SELECT h, doc_id, min(start) AS start FROM w GROUP BY 1, 2) """


def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.clone_windows(read(spark, sf_dir, "documents"), ["doc_id"], F.split("text", "\n"), 3, least_chars=40)


@query(_WINDOWS_SQL + "SELECT h, count(*) AS n_files, min(doc_id) AS first_file, arg_min(start, doc_id) AS first_start FROM f GROUP BY 1 HAVING count(*) >= 2")
def text_clone_windows(spark, sf_dir):
    return similarity.clone_groups(doc_windows(spark, sf_dir), "doc_id")


@query(
    _WINDOWS_SQL + ", c AS (SELECT h FROM f GROUP BY 1 HAVING count(*) >= 2), cov AS (SELECT DISTINCT doc_id, start + j AS n FROM w JOIN c USING (h), unnest(range(0, 3)) AS t(j)) "
    "SELECT round(CAST((SELECT count(*) FROM cov) AS DOUBLE) / (SELECT sum(len(s)) FROM l), 6) AS rate"
)
def duplication_rate(spark, sf_dir):
    windows = doc_windows(spark, sf_dir)
    shared = similarity.clone_groups(windows, "doc_id").select("h")
    over = windows.join(shared, "h", "left_semi").select("doc_id", F.explode(F.sequence("start", F.col("start") + 2)).alias("n")).distinct()
    total = read(spark, sf_dir, "documents").agg(F.sum(F.size(F.split("text", "\n"))).alias("total"))
    return over.agg(F.count("*").alias("n")).join(total).select(r6(F.col("n") / F.col("total")).alias("rate"))


@query(
    "SELECT sha256(t) AS digest, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents) GROUP BY 1 HAVING count(*) >= 2"
)
def exact_dups(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("t", F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")))
    return similarity.exact_groups(docs, "t", "doc_id")


_PLAIN_SQL = "lower(regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g'))"


@query(
    f"WITH d AS (SELECT {_PLAIN_SQL} AS t, min(1000 * conv_id + turn) AS k, length({_PLAIN_SQL}) AS n FROM conversations GROUP BY 1 HAVING n >= 65) "
    "SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b, levenshtein(a.t, b.t) AS distance FROM d a JOIN d b ON a.k < b.k AND least(a.n, b.n) > 0.9 * greatest(a.n, b.n) "
    "WHERE 1 - levenshtein(a.t, b.t) / greatest(a.n, b.n) > 0.92"
)
def near_dup_pairs(spark, sf_dir):
    plain = F.lower(F.regexp_replace("text", r"[^\x20-\x7E]", "?"))
    turns = read(spark, sf_dir, "conversations").select((1000 * F.col("conv_id") + F.col("turn")).alias("k"), plain.alias("t"))
    return similarity.near_pairs(turns, "k", "t").select("a", "b", "distance")


KNOWN = ["almond", "antique", "azure", "beige", "bisque", "black", "blue", "brown", "cream", "green", "steel", "copper", "widget", "gadget", "rotor", "flange", "bolt", "valve"]


@query(
    "WITH n AS (SELECT DISTINCT unnest(string_split(c_mktsegment || ' ' || lower(c_name), ' ')) AS name FROM customer UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part), "
    "m AS (SELECT DISTINCT substr(name, 2) AS name FROM n UNION SELECT name FROM n), k AS (SELECT unnest(range(0, 18)) AS ord, unnest(["
    + ", ".join(f"'{k}'" for k in KNOWN)
    + "]) AS known) SELECT name, arg_min(known, ord) AS known, arg_min(levenshtein(name, known), ord) AS distance FROM m CROSS JOIN k "
    "WHERE length(name) >= 4 AND strlen(name) = length(name) AND name NOT IN (SELECT known FROM k) AND levenshtein(name, known) BETWEEN 1 AND 2 GROUP BY 1"
)
def typosquat(spark, sf_dir):
    words = lambda c: F.explode(F.split(c, " ")).alias("name")
    names = read(spark, sf_dir, "customer").select(words(F.concat_ws(" ", "c_mktsegment", F.lower("c_name")))).union(read(spark, sf_dir, "part").select(words(F.col("p_name")))).distinct()
    names = names.union(names.select(F.substring("name", 2, 1000))).distinct().where(F.octet_length("name") == F.length("name"))
    return similarity.look_alikes(names, "name", KNOWN)


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_returnflag = 'R')")
def dead_deps(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'")
    return read(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE l_partkey = p_partkey AND p_size < 40)")
def phantom_deps(spark, sf_dir):
    declared = read(spark, sf_dir, "part").where("p_size < 40")
    return read(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(declared, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


def item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changed files: orders are commits, suppliers authors, quantities lines."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("author"), F.col("l_quantity").alias("lines"))


_CHURN_SQL = "SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_suppkey) AS authors, sum(l_quantity) AS lines_changed FROM lineitem GROUP BY 1"


@query(_CHURN_SQL)
def churn(spark, sf_dir):
    return history.churn(item_changes(spark, sf_dir))


@query(f"WITH c AS ({_CHURN_SQL}) SELECT path, commits, p_size AS complexity, round(log2(commits + 1) * p_size, 6) AS risk FROM c JOIN part ON p_partkey = path")
def hotspots(spark, sf_dir):
    complexity = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("complexity"))
    return history.hotspots(history.churn(item_changes(spark, sf_dir)), complexity).select("path", "commits", "complexity", r6(F.col("risk")).alias("risk"))


@query(
    "WITH f AS (SELECT DISTINCT l_orderkey AS sha, l_suppkey AS path FROM lineitem), n AS (SELECT path, count(*) AS n FROM f GROUP BY 1), "
    "s AS (SELECT sha FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), "
    "p AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM f x JOIN f y ON x.sha = y.sha AND x.path < y.path WHERE x.sha IN (SELECT sha FROM s) GROUP BY 1, 2 HAVING count(*) >= 3) "
    "SELECT a, b, together, round(together / least(na.n, nb.n), 6) AS strength FROM p JOIN n na ON na.path = a JOIN n nb ON nb.path = b WHERE together / least(na.n, nb.n) > 0.04"
)
def cochange(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("path"))
    return history.cochange(files, strength=0.04).withColumn("strength", r6(F.col("strength")))


_EDGES_SQL = (
    "edges AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING count(*) > (SELECT 1.3 * count(*) / 625 FROM lineitem))"
)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nations to supplier nations with more trade than usual."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    usual = items.agg((1.3 * F.count("*") / 625).alias("usual"))  # one row
    return counts.join(F.broadcast(usual), F.col("n") > F.col("usual")).select("src", "dst")


_COUPLING_SQL = f"WITH {_EDGES_SQL}, e AS (SELECT src AS node, 1 AS ce, 0 AS ca FROM edges UNION ALL SELECT dst, 0, 1 FROM edges UNION ALL SELECT n_nationkey, 0, 0 FROM nation) "


@query(
    _COUPLING_SQL + "SELECT node, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ce) AS BIGINT) AS ce, round(CASE WHEN sum(ca) + sum(ce) = 0 THEN 0.5 ELSE sum(ce) / (sum(ca) + sum(ce)) END, 6) AS instability FROM e GROUP BY 1"
)
def module_coupling(spark, sf_dir):
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.coupling(nation_edges(spark, sf_dir), nodes).withColumn("instability", r6(F.col("instability")))


@query(f"WITH {_EDGES_SQL} SELECT dst AS node, count(DISTINCT src) AS n_importers FROM edges GROUP BY 1 HAVING count(DISTINCT src) >= 3")
def god_nodes(spark, sf_dir):
    return graph.hubs(nation_edges(spark, sf_dir), 3)


_PARTNER_SQL = (
    "edges AS (SELECT c_nationkey AS src, arg_min(s_nationkey, (-n, s_nationkey)) AS dst FROM (SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) GROUP BY 1)"
)


@query(
    f"WITH RECURSIVE {_PARTNER_SQL}, walk AS (SELECT src, dst, 1 AS hops FROM edges UNION ALL SELECT w.src, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.dst = e.src WHERE w.hops < 8 AND e.dst <> w.src) "
    "SELECT src, dst, min(hops) AS hops FROM walk GROUP BY 1, 2"
)
def reachability(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    partner = counts.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("n"), "dst")).alias("dst"))
    return graph.reachable(partner, "auditlake_partner_edges", 8)


@query(
    f"WITH {_EDGES_SQL}, b AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges), p AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS w FROM b GROUP BY 1, 2), "
    "k AS (SELECT u, sum(w) AS k, any_value(n_regionkey) AS c FROM p JOIN nation ON n_nationkey = u GROUP BY 1), m AS (SELECT sum(k) AS m2 FROM k) "
    "SELECT round(sum((w - a.k * z.k / m2) / m2), 6) AS q_adjacent, round(sum(w) / any_value(m2) - (SELECT sum(s * s) FROM (SELECT sum(k) AS s FROM k GROUP BY c)) / any_value(m2 * m2), 6) AS q "
    "FROM p JOIN k a ON a.u = p.u JOIN k z ON z.u = p.v CROSS JOIN m WHERE a.c = z.c"
)
def modularity(spark, sf_dir):
    community = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graph.modularity(nation_edges(spark, sf_dir), community).select(r6(F.col("q_adjacent")).alias("q_adjacent"), r6(F.col("q")).alias("q"))


@query(
    "SELECT split_part(p_name, ' ', 2) AS suffix, count(DISTINCT split_part(p_name, ' ', 1)) AS n_verbs, array_to_string(list_sort(list_distinct(list(split_part(p_name, ' ', 1)))), ',') AS verbs "
    "FROM part GROUP BY 1 HAVING count(DISTINCT split_part(p_name, ' ', 1)) >= 3"
)
def naming_drift(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("verb"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("suffix"))
    return history.naming_drift(names, "verb", "suffix").withColumn("verbs", F.array_join("verbs", ","))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: users are sessions, purchases write, views read, ``props.k`` is the file."""
    action = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "view", "read").otherwise("other")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", "event_type", "value", action.alias("action"), k.cast("string").alias("file_path"))


_CALLS_SQL = (
    "calls AS (SELECT user_id AS session, event_id AS seq, ts, event_type, value, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'read' ELSE 'other' END AS action, "
    "CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS file_path FROM events)"
)
_ROLL_SQL = (
    "roll AS (SELECT session, arg_min(ts, seq) AS started, arg_max(ts, seq) AS ended, count(DISTINCT file_path) FILTER (action = 'write') AS files_written, "
    "count(DISTINCT file_path) FILTER (action = 'read') AS files_read, count(*) AS calls FROM c GROUP BY 1)"
)


@query(f"WITH {_CALLS_SQL}, c AS (SELECT * FROM calls), {_ROLL_SQL} SELECT *, CASE WHEN calls > 3 AND files_written = 0 THEN 'SILENT_FAIL' ELSE 'OK' END AS status FROM roll")
def session_rollup(spark, sf_dir):
    return sessions.rollup(event_calls(spark, sf_dir))


@query(
    f"WITH {_CALLS_SQL}, c AS (SELECT * REPLACE (CAST(session AS VARCHAR) || strftime(ts, '-%Y-%m-%d') AS session) FROM calls), {_ROLL_SQL}, w AS (SELECT DISTINCT session, file_path FROM c WHERE action = 'write'), "
    "x AS (SELECT file_path FROM w GROUP BY 1 HAVING count(DISTINCT session) >= 2), h AS (SELECT DISTINCT session FROM w JOIN x USING (file_path)) "
    "SELECT session, calls, CASE WHEN calls > 3 AND files_written = 0 THEN 'SILENT_FAIL' WHEN h.session IS NOT NULL THEN 'CONFLICT' ELSE 'OK' END AS status FROM roll LEFT JOIN h USING (session)"
)
def silent_fail(spark, sf_dir):
    # A user's day is a session here.
    calls = event_calls(spark, sf_dir).withColumn("session", F.concat(F.col("session").cast("string"), F.date_format("ts", "-yyyy-MM-dd")))
    return sessions.with_conflicts(sessions.rollup(calls), calls).select("session", "calls", "status")


@query(f"WITH {_CALLS_SQL} SELECT file_path, count(DISTINCT session) AS n_sessions FROM calls WHERE action = 'write' GROUP BY 1 HAVING count(DISTINCT session) >= 2")
def write_conflicts(spark, sf_dir):
    return sessions.conflicts(event_calls(spark, sf_dir))


@query(
    "SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s "
    "FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s"
)
def session_gaps(spark, sf_dir):
    out = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("started"), "n", r6(F.col("total")).alias("total"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_hourly(spark, sf_dir):
    out = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", r6(F.col("mean")).alias("mean"))


@query(
    f"WITH {_CALLS_SQL}, i AS (SELECT *, greatest(1, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS iter_no FROM calls) "
    "SELECT session, CAST(iter_no AS BIGINT) AS iter_no, count(*) FILTER (action = 'write') AS changes, count(DISTINCT file_path) FILTER (action = 'write') AS files, round(sum(value), 6) AS tokens FROM i GROUP BY 1, 2"
)
def loop_iterations(spark, sf_dir):
    out = sessions.with_iteration(event_calls(spark, sf_dir), F.col("event_type") == "error")
    write = F.col("action") == "write"
    return out.groupBy("session", "iter_no").agg(F.count_if(write).alias("changes"), F.count_distinct(F.when(write, F.col("file_path"))).alias("files"), r6(F.sum("value")).alias("tokens"))


PRICES = [("click", 3.0, 15.0), ("pur", 15.0, 75.0), ("view", 0.8, 4.0), ("err", 0.25, 1.25)]


@query(
    "WITH p AS (SELECT * FROM (VALUES (0, 'click', 3.0, 15.0), (1, 'pur', 15.0, 75.0), (2, 'view', 0.8, 4.0), (3, 'err', 0.25, 1.25)) AS t(ord, name, i, o)), "
    "m AS (SELECT event_type, arg_min(i, (CASE WHEN name = event_type THEN 0 ELSE 1 END, ord)) AS i, arg_min(o, (CASE WHEN name = event_type THEN 0 ELSE 1 END, ord)) AS o FROM (SELECT DISTINCT event_type FROM events) JOIN p ON starts_with(event_type, name) GROUP BY 1) "
    "SELECT event_type AS model, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round(sum((in_tokens * coalesce(i, 3.0) + out_tokens * coalesce(o, 15.0)) / 1e6), 6) AS cost FROM "
    "(SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS in_tokens, CAST(floor(value) AS BIGINT) AS out_tokens FROM events) LEFT JOIN m USING (event_type) WHERE in_tokens + out_tokens > 0 GROUP BY GROUPING SETS ((event_type), ())"
)
def cost_by_model(spark, sf_dir):
    usage = read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.floor(F.col("value") * 100).alias("in_tokens"), F.floor("value").alias("out_tokens"))
    money = (F.col("in_tokens") * sessions.price(F.col("model"), 0, PRICES) + F.col("out_tokens") * sessions.price(F.col("model"), 1, PRICES)) / 1e6
    used = usage.where("in_tokens + out_tokens > 0").withColumn("cost", money)
    return used.rollup("model").agg(F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), r6(F.sum("cost")).alias("cost"))


@query(
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, CAST(sum(length(text)) AS BIGINT) AS n_chars, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1"
)
def receipt(spark, sf_dir):
    told = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("t"))))
    out = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("n_chars"), told.alias("told")
    )
    return out.select("conv_id", "turns", "asked", "n_chars", F.sha2(F.array_join(F.transform("told", lambda x: x["t"]), "\n"), 256).alias("sha256"))


_COMPACT_SQL = """c AS (SELECT *, role = 'system' AS explicit, role = 'assistant' AND length(text) > 500 AS candidate, role = 'user' AS exchange FROM conversations),
l AS (SELECT *, coalesce(max(CASE WHEN exchange THEN turn END) OVER b, -1) AS last_exchange, coalesce(max(CASE WHEN explicit OR candidate THEN turn END) OVER b, -1) AS last_candidate FROM c
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, explicit OR (candidate AND last_exchange > last_candidate) AS event FROM l),
s AS (SELECT *, CAST(coalesce(sum(CASE WHEN event THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM e)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations")
    return sessions.compaction_events(
        talk, F.col("role") == "system", (F.col("role") == "assistant") & (F.length("text") > 500), F.col("role") == "user", session="conv_id", order="turn"
    )


@query(f"WITH {_COMPACT_SQL} SELECT conv_id, turn, event, segment FROM s")
def compaction_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("conv_id", "turn", "event", "segment")


@query(
    f"WITH {_COMPACT_SQL}, t AS (SELECT DISTINCT conv_id, segment, term FROM (SELECT conv_id, segment, unnest(string_split(lower(text), ' ')) AS term FROM s WHERE NOT event) WHERE length(term) >= 12) "
    "SELECT t.conv_id, t.segment, term FROM t JOIN (SELECT conv_id, segment, text FROM s WHERE event) x ON x.conv_id = t.conv_id AND x.segment = t.segment WHERE NOT contains(lower(x.text), term)"
)
def dropped_terms(spark, sf_dir):
    cut = segments(spark, sf_dir)
    terms = cut.where("NOT event").select("conv_id", "segment", F.explode(F.split(F.lower("text"), " ")).alias("term")).where(F.length("term") >= 12)
    return sessions.dropped_terms(terms, cut.where("event").select("conv_id", "segment", F.col("text").alias("summary")), "term", keys=["conv_id", "segment"])


@query(
    "WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS handler, bool_or(l_quantity >= 49) AS many FROM lineitem GROUP BY 1), "
    "s AS (SELECT o_orderkey, starts_with(o_orderpriority, '1') AS security, o_orderstatus = 'P' AS schema, coalesce(handler, false) AS handler, coalesce(many, false) AS many FROM orders LEFT JOIN f ON l_orderkey = o_orderkey) "
    "SELECT o_orderkey, CASE WHEN security AND (handler OR schema) THEN 'CRITICAL' WHEN security OR handler OR schema THEN 'HIGH' WHEN many THEN 'MEDIUM' ELSE 'SKIP' END AS rank FROM s"
)
def triage_rank(spark, sf_dir):
    flags = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("handler"), F.bool_or(F.col("l_quantity") >= 49).alias("many"))
    joined = read(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    no = F.lit(False)
    rank = changes.triage_rank(F.col("o_orderpriority").startswith("1"), F.coalesce("handler", no), F.col("o_orderstatus") == "P", F.coalesce("many", no))
    return joined.select("o_orderkey", rank.alias("rank"))


@query(
    "WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS removed, bool_or(l_returnflag = 'A') AS added FROM lineitem GROUP BY 1), "
    "t AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RISKY' WHEN '2' THEN 'REVIEW' ELSE 'SAFE' END AS tier FROM orders) "
    "SELECT o_orderkey, CASE WHEN coalesce(removed, false) THEN 'RISKY' WHEN coalesce(added, false) AND tier = 'SAFE' THEN 'REVIEW' ELSE tier END AS tier FROM t LEFT JOIN f ON l_orderkey = o_orderkey"
)
def tier_bump(spark, sf_dir):
    flags = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("removed"), F.bool_or(F.col("l_returnflag") == "A").alias("added")
    )
    p = F.substring("o_orderpriority", 1, 1)
    tier = F.when(p == "1", "RISKY").when(p == "2", "REVIEW").otherwise("SAFE")
    joined = read(spark, sf_dir, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", changes.bumped(tier, F.col("removed"), F.col("added")).alias("tier"))


@query(
    "WITH a AS (SELECT o_orderkey AS path FROM orders WHERE o_orderpriority LIKE '1%'), c AS (SELECT l_orderkey + 7 AS path FROM lineitem WHERE l_quantity > 49) "
    "SELECT path, path IN (SELECT path FROM c) AS claimed, path IN (SELECT o_orderkey FROM orders) AS found FROM (SELECT path FROM a UNION SELECT path FROM c)"
)
def verify_union(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), "o_orderpriority")
    claimed = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select((F.col("l_orderkey") + 7).alias("path"))
    return changes.verified_claims(orders.where("o_orderpriority LIKE '1%'"), claimed, orders)


_PATH_SQL = "p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"


@query(
    f"WITH {_PATH_SQL}, x AS (SELECT page_id, array_to_string(s[1:i], '/') AS dir FROM (SELECT page_id, string_split(path, '/') AS s FROM p), unnest(range(1, len(s))) AS t(i)), "
    "r AS (SELECT dir FROM x GROUP BY 1 HAVING count(*) >= 3) SELECT page_id, count(*) AS n_dirs FROM x WHERE dir IN (SELECT dir FROM r) GROUP BY 1"
)
def ancestor_refs(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    spread = read(spark, sf_dir, "pages").select("page_id", F.explode(X.ancestors(path)).alias("dir"))
    referred = spread.groupBy("dir").agg(F.count("*").alias("n")).where("n >= 3").select("dir")
    return spread.join(referred, "dir", "left_semi").groupBy("page_id").agg(F.count("*").alias("n_dirs"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2")
def href_extract(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query(
    "WITH p AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings WHERE label < 5 GROUP BY 1), "
    "c AS (SELECT vec_id, p.label AS pattern, list_cosine_similarity(embedding::DOUBLE[], e) AS cosine FROM embeddings CROSS JOIN p) "
    "SELECT vec_id, min(pattern) AS pattern, round(arg_min(cosine, pattern), 6) AS cosine FROM c WHERE cosine > 0.45 GROUP BY 1"
)
def semantic_first_match(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    patterns = vectors.where("label < 5").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))  # five rows
    patterns = patterns.agg(F.array_sort(F.collect_list(F.struct("label", "e"))).alias("patterns"))
    met = vectors.join(F.broadcast(patterns))
    judged = F.transform("patterns", lambda p: F.struct(p["label"].alias("pattern"), X.cosine(F.col("embedding"), p["e"]).alias("cosine")))
    first = met.select("vec_id", F.get(F.filter(judged, lambda j: j["cosine"] > 0.45), F.lit(0)).alias("j"))
    return first.where("j IS NOT NULL").select("vec_id", "j.pattern", r6(F.col("j.cosine")).alias("cosine"))


@query(
    "WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:[A-Za-z_]+) ?[=:] ?\"?([A-Za-z0-9_/+-]{8,})', 1)) AS v FROM documents), "
    "c AS (SELECT v, x, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS x FROM v) GROUP BY 1, 2) SELECT v AS value, round(-sum(n / length(v) * log2(n / length(v))), 6) AS entropy FROM c GROUP BY v"
)
def entropy_tokens(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r'(?:[A-Za-z_]+) ?[=:] ?"?([A-Za-z0-9_/+-]{8,})'), F.lit(1))
    values = read(spark, sf_dir, "documents").select(F.explode(found).alias("value")).distinct()
    return values.select("value", r6(X.entropy(F.col("value"))).alias("entropy"))


@query(
    "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[.,|!]')) AS x FROM documents), c AS (SELECT doc_id, x, regexp_matches(x, '^[A-Za-z]') AS operand, count(*) AS n FROM w GROUP BY 1, 2, 3), "
    "h AS (SELECT doc_id, sum(n) FILTER (operand) AS n2, sum(n) FILTER (NOT operand) AS n1, count(*) FILTER (operand) AS u2, count(*) FILTER (NOT operand) AS u1, CAST(sum(n) AS DOUBLE) AS total, count(*) AS kinds FROM c GROUP BY 1) "
    "SELECT doc_id, CAST(total AS BIGINT) AS length, kinds AS vocabulary, round(total * log2(kinds), 6) AS volume, round(CASE WHEN u2 > 0 THEN u1 / 2.0 * coalesce(n2, 0) / u2 ELSE 0 END, 6) AS difficulty FROM h"
)
def halstead_words(spark, sf_dir):
    from ..operators.code import halstead

    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[.,|!]"), F.lit(0))).alias("token"))
    out = halstead(words.withColumn("operand", F.col("token").rlike("^[A-Za-z]")), ["doc_id"])
    return out.select("doc_id", "length", "vocabulary", r6(F.col("volume")).alias("volume"), r6(F.col("difficulty")).alias("difficulty"))


@query(
    "SELECT round(corr(CAST(quality AS DOUBLE), CAST(n AS DOUBLE)), 6) AS pearson, count(*) AS n, round(avg(n) FILTER (quality = 1), 6) AS mean_good, round(avg(n) FILTER (quality = 0), 6) AS mean_bad "
    "FROM (SELECT quality, len(regexp_extract_all(text, '[#*$%&|]')) AS n FROM labels JOIN documents USING (doc_id))"
)
def calibration(spark, sf_dir):
    marks = F.size(F.regexp_extract_all("text", F.lit("[#*$%&|]"), F.lit(0))).cast("double")
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("quality", marks.alias("n"))
    return joined.agg(
        r6(F.corr(F.col("quality").cast("double"), "n")).alias("pearson"), F.count("*").alias("n"),
        r6(F.avg(F.when(F.col("quality") == 1, F.col("n")))).alias("mean_good"), r6(F.avg(F.when(F.col("quality") == 0, F.col("n")))).alias("mean_bad"),
    )


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations QUALIFY nth > 1")
def repeated_names(spark, sf_dir):
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    talk = read(spark, sf_dir, "conversations")
    return lines.repeats_after_first(talk.withColumn("nth", F.row_number().over(own)), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role", F.col("nth").cast("long").alias("nth"))
