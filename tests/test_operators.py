"""Operators on small cases with known results."""

import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import expressions as X
from auditlake.operators import changes, code, graph, history, lines, scoring, sessions, similarity
from auditlake.operators.rules import Rule, first_rule, ignored, scan
from auditlake.plans.report import badges
from auditlake.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_scalar_expressions(spark):
    assert one(spark, X.half_up(F.col("v")), v=-2.5) == -2
    assert one(spark, X.size_scale(F.col("n"), 10, 0.4, 0.3), n=100) == pytest.approx(0.6)
    assert [one(spark, X.completeness_multiplier(F.col("s")), s=float(s)) for s in (100, 75, 50, 25, 0)] == pytest.approx([1, 0.85, 0.65, 0.45, 0.2])
    assert [one(spark, X.grade(F.col("s")), s=s) for s in (90, 89, 75, 60, 40, 39)] == list("ABBCDF")
    assert one(spark, X.entropy(F.col("t")), t="aabb") == pytest.approx(1.0)
    assert one(spark, X.normal_path(F.col("p")), p="a/./b/../c//d") == "a/c/d"
    assert one(spark, X.ancestors(F.col("p")), p="a/b/c.ts") == ["a", "a/b"]
    assert [one(spark, X.extension(F.col("p")), p=p) for p in ("a/b.test.ts", ".env", "x")] == [".ts", "", ""]
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)


def test_lines_windows(spark):
    text = "intro\n## A\n```\nx\n```\n## B\nlast\n"
    frame = lines.lines_of(spark.createDataFrame([("r", "p", text)], "repo string, path string, content string"), ["repo", "path"])
    fenced = lines.with_parity(frame, ["repo", "path"], F.col("text") == "```").where("inside").select("line_no")
    assert [r[0] for r in fenced.orderBy("line_no").collect()] == [4, 5]
    near = lines.with_context(frame, ["repo", "path"], F.col("text") == "x", 1).where("near").select("line_no")
    assert sorted(r[0] for r in near.collect()) == [3, 4, 5]
    got = lines.sections(frame, ["repo", "path"], F.col("text").startswith("## ")).orderBy("section").collect()
    assert [(r["section"], r["title"], r["n_lines"]) for r in got] == [(0, "(intro)", 1), (1, "## A", 4), (2, "## B", 3)]


def test_rules(spark):
    rules = [Rule("a", "error", "m", "x", paths=r"\.ts\z"), Rule("b", "info", "m", "x", unless="ok")]
    frame = spark.createDataFrame([("p.ts", "x"), ("p.js", "x ok"), ("p.js", None)], "path string, text string")
    assert sorted((r["path"], r["rule_id"]) for r in scan(frame, rules, path="path").collect()) == [("p.ts", "a"), ("p.ts", "b")]
    assert [r[0] for r in frame.select(first_rule(F.col("text"), rules, F.col("path"))).collect()] == ["a", None, None]
    assert one(spark, ignored(F.col("c"), "audit-ignore"), c="a\n// audit-ignore\nb")


def test_score_card(spark):
    checks = spark.createDataFrame(
        [("r", "security", "scan", 0.0, "ok"), ("r", "security", "guard", 0.0, "ok"), ("r", "debt", "debt", 90.0, "ok"), ("r", "debt", "clones", 0.0, "failed")],
        "repo string, category string, name string, score double, status string",
    )
    cats = {r["category"]: r["score"] for r in scoring.categories(checks).collect()}
    assert cats == {"security": 13, "debt": 90}
    card = scoring.scorecards(scoring.categories(checks)).first()
    assert (card["score"], card["grade"], card["passed"]) == (46, "D", False)
    scaled = scoring.with_multiplier(scoring.scorecards(scoring.categories(checks)), spark.createDataFrame([("r", 75.0)], "repo string, completeness double"))
    assert scaled.first()["score"] == 39
    assert badges(spark.createDataFrame([("r", 46)], "repo string, score long")).first()["url"].endswith("/code%20audit-46%2F100-orange")


@given(st.lists(st.text(alphabet="ab", min_size=70, max_size=90), min_size=2, max_size=6, unique=True), st.integers(0, 10**6))
@settings(max_examples=5, deadline=None)
def test_near_pairs_like_brute_force(spark, texts, seed):
    rng = random.Random(seed)
    for t in list(texts):
        s = list(t)
        for _ in range(rng.randrange(1, 7)):
            s[rng.randrange(len(s))] = rng.choice("abc")
        texts.append("".join(s)[rng.randrange(3) :])
    texts = list(dict.fromkeys(texts))

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    slow = {(i, j) for j in range(len(texts)) for i in range(j) if 1 - far(texts[i], texts[j]) / max(len(texts[i]), len(texts[j])) > 0.92 and min(len(texts[i]), len(texts[j])) >= 65}
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert {(r["a"], r["b"]) for r in similarity.near_pairs(frame, "k", "t").collect()} == slow


def test_look_alikes(spark):
    names = spark.createDataFrame([("lodas",), ("reakt",), ("lodash",), ("vue",), ("something",)], "p string")
    got = {r["p"]: (r["known"], r["distance"]) for r in similarity.look_alikes(names, "p", ["lodash", "react", "vuex"]).collect()}
    assert got == {"lodas": ("lodash", 1), "reakt": ("react", 1)}


def test_clones_and_cover(spark):
    block = "\n".join(f"const value{i} = compute(value{i});" for i in range(12))
    files = spark.createDataFrame([("r", "a", block), ("r", "b", "head\n" + block), ("r", "c", "alone")], "repo string, path string, content string")
    windows = similarity.clone_windows(files, ["repo", "path"], F.split("content", "\n"), 10)
    groups = similarity.clone_groups(windows, "path").orderBy("first_start").collect()
    assert [(r["n_files"], r["first_file"], r["first_start"]) for r in groups] == [(2, "a", 1), (2, "a", 2), (2, "a", 3)]
    frame = pd.DataFrame([("r", "h1", 2, "a", 1), ("r", "h2", 2, "a", 2), ("r", "h3", 2, "a", 9)], columns=["repo", "h", "n_files", "first_file", "first_start"])
    assert similarity.greedy_cover(frame, 10)["h"].tolist() == ["h1", "h3"]


def test_graph(spark):
    edges = pd.DataFrame([("r", "a", "b", 0), ("r", "b", "c", 1), ("r", "c", "a", 2), ("r", "c", "d", 3), ("r", "d", "c", 4)], columns=["repo", "src", "dst", "ord"])
    assert graph.cycles(edges)["cycle"].tolist() == ["a -> b -> c -> a", "c -> d -> c"]
    two = pd.DataFrame([("r", a, b, i) for i, (a, b) in enumerate([("a", "b"), ("x", "y")])], columns=["repo", "src", "dst", "ord"])
    found = graph.communities(two).groupby("community")["node"].apply(lambda s: "".join(sorted(s))).tolist()
    assert sorted(found) == ["ab", "xy"]
    deep = pd.DataFrame([("r", f"n{i}", f"n{i + 1}", i) for i in range(5000)], columns=["repo", "src", "dst", "ord"])
    assert len(graph.cycles(deep)) == 0
    frame = spark.createDataFrame(edges)
    got = {r["node"]: (r["ca"], r["ce"]) for r in graph.coupling(frame.select("src", "dst")).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (2, 2), "d": (1, 1)}
    pairs = {(r["src"], r["dst"]): r["hops"] for r in graph.reachable(frame.select("src", "dst"), "test_edges", 3).collect()}
    assert pairs[("a", "d")] == 3
    whole = graph.modularity(spark.createDataFrame(two).select("src", "dst"), spark.createDataFrame(graph.communities(two)).select("node", "community")).first()
    assert whole["q"] == pytest.approx(0.5)


@pytest.mark.parametrize(
    ("name", "expected"), [("@scope/pkg/sub", "@scope/pkg"), ("lodash/fp", "lodash"), ("./a", None), ("node:fs", None), ("@/x", None), ("https://x", None)]
)
def test_package_names(spark, name, expected):
    assert one(spark, graph.package_name(F.col("s")), s=name) == expected


@pytest.mark.parametrize(("path", "expected"), [("src/a/b.ts", "src/a"), ("src/b.ts", "src"), ("packages/x/src/a/b.ts", "packages/x/src/a"), ("tools/x.ts", "tools"), ("x.ts", "(root)")])
def test_modules(spark, path, expected):
    assert one(spark, graph.module_of(F.col("p")), p=path) == expected


def test_history(spark):
    rows = [(c, p, f"author{c % 2}", 5) for c in range(6) for p in ("a", "b", *(["c"] if c < 2 else []))]
    frame = spark.createDataFrame(rows, "sha long, path string, author string, lines long")
    assert {r["path"]: (r["commits"], r["authors"], r["lines_changed"]) for r in history.churn(frame).collect()} == {"a": (6, 2, 30.0), "b": (6, 2, 30.0), "c": (2, 2, 10.0)}
    assert [(r["a"], r["b"], r["together"], r["strength"]) for r in history.cochange(frame).collect()] == [("a", "b", 6, 1.0)]
    pairs = spark.createDataFrame([("x/a", "y/b"), ("x/a", "x/b"), ("x/a", "y/test")], "a string, b string")
    assert [(r["a"], r["b"]) for r in history.surprising(pairs).collect()] == [("x/a", "y/b")]
    commit = [("r", "s", p, "M") for p in ("src/x/1.ts", "src/x/2.ts", "src/y/1.ts", "tests/a.ts", "package.json", "src/y/2.ts")]
    plan = history.commit_concerns(spark.createDataFrame(commit, "repo string, sha string, path string, status string")).first()
    assert (plan["clusters"], plan["files"], plan["deduction"]) == (4, 6, 15)
    assert tuple(one(spark, history.split_verb(F.col("n")), n="getUser")) == ("get", "User")
    assert one(spark, history.split_verb(F.col("n")), n="getter") is None


def session_rows(name, items):
    return [(name, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)]


def use(tool, ts="2024-01-01T00:00:00Z", nested=True, **arguments):
    block = {"type": "tool_use", "name": tool, "input": arguments}
    return {"timestamp": ts, "message": {"role": "assistant", "content": [block]}} if nested else {"timestamp": ts, "role": "assistant", "content": [block]}


def test_sessions(spark):
    rows = session_rows("good", ["{bad", use("Write", file_path="a.ts"), use("Edit", ts="2024-01-01T00:03:00Z", nested=False, file_path="b.ts"), ""])
    rows += session_rows("silent", [use("Read", file_path="x"), use("Read", file_path="y"), use("Read", file_path="z"), use("Bash", command="ls")])
    rows += session_rows("other", [use("Write", file_path="a.ts"), use("bash", command="npm install left -D && rm old.ts"), {"role": "user", "content": "plain text"}])
    parsed = sessions.entries(spark.createDataFrame(rows, "session string, seq long, value string"))
    calls = sessions.tool_calls(parsed)
    rolled = {r["session"]: r for r in sessions.with_conflicts(sessions.rollup(calls), calls).collect()}
    assert {s: r["status"] for s, r in rolled.items()} == {"good": "CONFLICT", "silent": "SILENT_FAIL", "other": "CONFLICT"}
    assert rolled["good"]["files_written"] == 2
    told = {r["session"]: r for r in sessions.receipt(calls).collect()}
    assert (told["good"]["created"], told["good"]["modified"], told["good"]["duration_seconds"]) == (["a.ts"], ["b.ts"], 180)
    assert told["other"]["packages"] == ["left"]
    assert parsed.where("session = 'other' AND role = 'user'").first()["text"] == "plain text"


def test_cost_and_subsidy(spark):
    usage = [("claude-sonnet-4-6", 1_000_000, 1_000_000), ("claude-opus-4-6-long", 1_000_000, 1_000_000), ("made-up", 1_000_000, 1_000_000), ("idle", 0, 0)]
    costs = sessions.cost(spark.createDataFrame(usage, "model string, in_tokens long, out_tokens long"))
    got = {r["model"]: r["cost"] for r in costs.collect()}
    assert got == pytest.approx({"claude-sonnet-4-6": 18, "claude-opus-4-6-long": 90, "made-up": 18, None: 126})
    paid = sessions.subsidy(costs, 20).first()
    assert paid["rate"] == pytest.approx(100 * 106 / 126)


def test_iterations_and_compaction(spark):
    calls = spark.createDataFrame([("s", i, a) for i, a in enumerate(["write", "test", "write", "test", "write"])], "session string, seq long, action string")
    got = [r["iter_no"] for r in sessions.with_iteration(calls, F.col("action") == "test").orderBy("seq").collect()]
    assert got == [1, 1, 1, 2, 2]
    rows = [("s", i, r, n) for i, (r, n) in enumerate([("system", 900), ("user", 9), ("assistant", 9), ("system", 900), ("system", 900), ("user", 9), ("system", 900)])]
    talk = spark.createDataFrame(rows, "session string, seq long, role string, n long")
    out = sessions.compaction_events(talk, F.lit(False), (F.col("role") == "system") & (F.col("n") > 500), F.col("role").isin("user", "assistant"))
    assert [r["seq"] for r in out.where("event").orderBy("seq").collect()] == [3, 6]


def test_changes(spark):
    def diff(path, added=(), removed=()):
        return [("r", path, "+", i, t) for i, t in enumerate(added)] + [("r", path, "-", None, t) for t in removed]

    rows = diff("src/auth/login.ts", ["x"] * 3, ["} catch (e) {"]) + diff("src/auth/style.css", ["a"] * 9) + diff("src/big.ts", [f"l{i}" for i in range(60)])
    rows += diff("src/pay.ts", ["// note", ""]) + diff("src/session/a.ts", [f"v{i}" for i in range(6)])
    frame = spark.createDataFrame(rows, "repo string, path string, kind string, new_line_no long, text string")
    ranks = {r["path"]: r["rank"] for r in changes.triage(frame).collect()}
    assert ranks == {"src/auth/login.ts": "CRITICAL", "src/auth/style.css": "SKIP", "src/big.ts": "MEDIUM", "src/pay.ts": "SKIP", "src/session/a.ts": "HIGH"}
    tiers = {p: one(spark, changes.path_tier(F.col("p")), p=p) for p in ("src/auth.ts", "migrations/1.sql", "api/x.ts", "src/x.ts")}
    assert list(tiers.values()) == ["RISKY", "RISKY", "REVIEW", "SAFE"]
    bad = spark.createDataFrame([("r", "p", "+", 1, "debugger; const token = 'abcdefghij'"), ("r", "p", "-", None, "debugger")], frame.schema)
    assert [r["rule_id"] for r in changes.diff_issues(bad).collect()] == ["hardcoded-secret"]
    named = changes.claims(spark.createDataFrame([("r", "Add src/a.ts and fixed the `b.js`")], "repo string, subject string"))
    assert {r["path"] for r in named.collect()} == {"src/a.ts", "b.js"}


def test_code_metrics(spark):
    files = spark.createDataFrame([("r", "p", "if (a) {\n  b = a + 1; // note\n}\n")], "repo string, path string, content string")
    row = code.file_metrics(files).first()
    assert (row["sloc"], row["cyclomatic"], row["n_operands"], row["u_operands"]) == (3, 2, 4, 3)
    assert 0 < row["maintainability"] <= 100
    assert code.indentation(files).first()["complexity"] == pytest.approx(1 / 3)


def test_streams(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:{m:02d}:00", 1.0, i) for i, (u, m) in enumerate([(1, 0), (1, 5), (1, 50), (2, 10)])]
    frame = spark.createDataFrame(rows, "user_id long, t string, value double, event_id long").select("user_id", F.to_timestamp("t").alias("ts"), "value", "event_id")
    frame.union(frame.limit(1)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    plan = events.user_sessions(events.distinct_events(events.timed(stream), ["event_id"]))
    query = plan.writeStream.format("memory").queryName("live_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    late = spark.createDataFrame([(9, "2024-01-02", 0.0, 99)], "user_id long, t string, value double, event_id long").select("user_id", F.to_timestamp("t").alias("ts"), "value", "event_id")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    query = plan.writeStream.format("memory").queryName("live_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["user_id"], r["n"]) for r in spark.table("live_sessions").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
