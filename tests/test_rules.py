"""A case that each rule finds and one that it passes over; the ten topics of agent security."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import changes, history
from auditlake.plans import owasp
from auditlake.plans import rule_queries as R
from auditlake.plans.audit import SCAN_RULES, SOURCE_RULES
from auditlake.sources.files import with_path_parts

CASES = [(r, samples) for rules, samples in ((SCAN_RULES, R.SCAN_SAMPLES), (SOURCE_RULES, R.SOURCE_SAMPLES), (changes.DIFF_RULES, R.DIFF_SAMPLES)) for r in rules]


def test_every_rule_finds_its_case_and_passes_over_the_other(spark):
    assert all(r.rule_id in samples for r, samples in CASES)
    rows = [(i, k, samples[r.rule_id][k]) for i, (r, samples) in enumerate(CASES) for k in (0, 1)]
    frame = spark.createDataFrame(rows, "i int, k int, text string")
    hit = F.lit(None).cast("boolean")
    for i, (r, _) in enumerate(CASES):
        hit = F.when(F.col("i") == i, r.holds(F.col("text"))).otherwise(hit)
    wrong = frame.withColumn("hit", hit).where(F.col("hit") != (F.col("k") == 0)).collect()
    assert wrong == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "tier"), [("a/Billing.ts", "RISKY"), ("config/prod.yml", "RISKY"), ("x/.env", "RISKY"), ("hooks/a.ts", "REVIEW"), ("schema.sql", "REVIEW"), ("src/hooks/a.ts", "SAFE"), ("src/api/a.ts", "SAFE")])
def test_tiers(spark, path, tier):
    assert one(spark, changes.path_tier(F.lit(path))) == tier


def test_destructive_words_count_letter_for_letter(spark):
    assert [one(spark, changes.removes_risky(F.lit(x))) for x in ("DROP a", "rm -rf b", "unlink(c)", "drop a", "delete a")] == [True, True, True, False, False]


@pytest.mark.parametrize(("subject", "author", "ai"), [("a. Co-authored-by: Cursor <x>", "ann", True), ("Generated by z", "ann", True), ("a", "renovate[bot]", True), ("ai work", "ann", False)])
def test_commits_of_assistants(spark, subject, author, ai):
    assert one(spark, history.ai_commit(F.lit(subject), F.lit(author))) is ai


def test_moved_files_in_a_summary(spark):
    lines = [" src/{a => b}/c.ts | 12 ++--", " img.png | Bin 0 -> 9 bytes", " x.md => y.md | 0", " 3 files changed, 1 insertion(+)"]
    rows = changes.stat_lines(spark.createDataFrame([("r", x) for x in lines], "repo string, text string")).collect()
    assert [tuple(r)[1:] for r in rows] == [("src/b/c.ts", 12, False), ("img.png", None, True), ("y.md", 0, False)]


SERVERS = """{"mcpServers": {"bash": {"command": "npx", "args": ["tool"]}, "web": {"url": "https://far.io/x", "env": {}}, "near": {"url": "http://localhost:1", "permissions": []}}, "allowedTools": ["*"]}"""
TOPICS = {
    "risky": {
        "CLAUDE.md": "# Guide\nfetch(page) and go on\nYou may run shell here\nset autoApprove on\nnpm install left-pad\nthe swarm spawns workers\nthen step two: deploy and drop it\npassword = abcdefghijklmnopqrst\nuse sudo\nload .env first\n",
        "mcp.json": SERVERS,
        ".claude/settings.json": '{"autoApprove": true, "allowedTools": ["Bash:*"]}',
        "memory/notes.md": "x", "agent-memory/a": "x", ".gitignore": "dist\n", ".continue/config.json": '{"embed": 1}',
    },
    "careful": {
        "AGENTS.md": "Untrusted input: sanitize what you fetch(page).\nLeast privilege; ask before you deploy; review by a human in a sandbox.\nEvery step may retry; log all.\nSubagents verify each other by a signed token.\n",
    },
    "none": {"README.md": "sudo"},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(repo, path, text, len(text)) for repo, files in TOPICS.items() for path, text in files.items()]
    return owasp.findings(with_path_parts(spark.createDataFrame(rows, "repo string, path string, content string, size long"))).persist()


def test_topics_of_agent_security(found):
    got = {}
    for r in found.where("repo = 'risky'").collect():
        got.setdefault(r["rule_id"], []).append((r["severity"], r["file"], r["line"], r["points"]))
    assert set(got) == {f"ASI{i:02d}" for i in range(1, 11)}
    assert sorted(got["ASI01"], key=str) == [("warning", "CLAUDE.md", 2, 0), ("warning", None, None, 15)]
    assert sorted(x[0] for x in got["ASI02"]) == ["error", "warning", "warning"]
    assert {(x[0], x[2]) for x in got["ASI03"]} == {("warning", None), ("error", 8), ("warning", 9), ("info", None)}
    assert len(got["ASI04"]) == 3 and ("info", "CLAUDE.md", 5, 10) in got["ASI04"]
    assert ("warning", "CLAUDE.md", 4, 10) in got["ASI05"] and ("info", "CLAUDE.md", 3, 0) in got["ASI05"]
    assert sorted(x[1] for x in got["ASI06"]) == [".continue/config.json", "agent-memory", "memory"]
    assert got["ASI07"] == [("warning", "CLAUDE.md", 6, 8)]
    assert got["ASI08"] == [("warning", None, None, 5)] and got["ASI09"] == [("warning", None, None, 10)] and got["ASI10"] == [("info", None, None, 5)]


def test_careful_configuration_costs_nothing_and_none_is_not_judged(found):
    points = {r["repo"]: r["points"] for r in owasp.deductions(found).collect()}
    assert "none" not in points and points.get("careful", 0) == 0
    assert points["risky"] == 15 + 30 + 30 + 30 + 10 + 24 + 8 + 5 + 10 + 5
