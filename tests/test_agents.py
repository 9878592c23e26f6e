"""Finer signals of agents, sessions and change claims, formulas, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake import cli
from auditlake.operators import sessions
from auditlake.plans import agents as G
from auditlake.plans import audit as A
from auditlake.plans import formulas as S
from auditlake.sources.files import with_path_parts
from auditlake.sources.git import read_blobs

from .test_audit import files, root  # noqa: F401
from .test_operators import one, session_rows, use


def table(spark, rows):
    frame = spark.createDataFrame([("r", p, c) for p, c in rows.items()], "repo string, path string, content string")
    return with_path_parts(frame.withColumn("size", F.octet_length("content").cast("long")))


def result(text):
    return {"role": "user", "content": [{"type": "tool_result", "content": text}]}


def test_loops(spark):
    rows = session_rows("s", [use("Write", file_path="a"), use("Bash", command="npm test"), result("5 failed, 1 passed"), use("Edit", file_path="a"), use("Bash", command="npm test"), result("12 passed, 0 failed")])
    rows += session_rows("untested", [use("Write", file_path="b")])
    parsed = sessions.entries(spark.createDataFrame(rows, "session string, seq long, value string"))
    got = [(r["session"], r["iter_no"], r["changes"], r["outcome"]) for r in G.loops(parsed).orderBy("iter_no").collect()]
    assert got == [("s", 1, 2, "fail"), ("s", 2, 0, "pass")]


def test_terms_and_lost_instructions(spark):
    text = "See src/app/main.ts and getUserName or user_name. Always run the linter before pushing changes."
    got = {k: one(spark, v, t=text) for k, v in G.terms(F.col("t")).items()}
    assert got == {"paths": ["src/app/main.ts"], "identifiers": ["getUserName", "user_name"], "instructions": ["Always run the linter before pushing changes"]}
    lost = G.lost_instruction(F.col("i"), F.col("s"))
    assert one(spark, lost, i=got["instructions"][0], s="we spoke of main.ts")
    assert not one(spark, lost, i=got["instructions"][0], s="always run linter before pushing")


def test_agent_files(spark):
    own = table(spark, {"CLAUDE.md": "## Test\nUse npm and `vitest`.\n## Old\nzebras everywhere\n", "AGENTS.md": "Use yarn here.\n", "src/a.ts": "x"})
    assert [r["message"] for r in G.contradictions(own).collect()] == ["package manager: npm or yarn"]
    packages = spark.createDataFrame([("r", "vitest"), ("r", "react")], "repo string, package string")
    best = G.config_quality(own, packages).first()
    assert (best["path"], best["consistent"]) == ("CLAUDE.md", 5.0)
    log = spark.createDataFrame([("r", "we used vitest")], "repo string, text string")
    stale = {(r["file"], r["line"]) for r in G.stale_sections(own, log).collect()}
    assert stale == {("CLAUDE.md", 3)}


def test_verdict_ladder(spark):
    body = "\n".join(f"line {i}" for i in range(12))
    own = table(spark, {"a.ts": body, "b.ts": "x", "c.ts": " ", "t/x.test.ts": "it('a', () => { go() })\n" * 12, "index.ts": "x"})
    claimed = spark.createDataFrame([("r", p, True) for p in ("a.ts", "b.ts", "c.ts", "t/x.test.ts", "index.ts", "gone.ts")] + [("r", "moved.ts", False)], "repo string, path string, claimed boolean")
    got = {r["path"]: r["verdict"] for r in G.verdicts(own, claimed).collect()}
    assert got == {"a.ts": "verified", "b.ts": "thin", "c.ts": "empty", "t/x.test.ts": "asserts nothing", "index.ts": "verified", "gone.ts": "missing", "moved.ts": "gone"}


def test_manifests_and_workspaces(spark):
    own = table(
        spark,
        {"package.json": '{"workspaces": ["packages/*"]}', "packages/a/package.json": '{"name": "a"}', "packages/a/src/x.ts": "x", "packages/a/src/y.ts": "x", "other/b/package.json": "{}", "pnpm-workspace.yaml": "packages:\n  - 'other/*'\n"},
    )
    assert {r["path"] for r in G.workspaces(own).collect()} == {"packages/a/package.json", "other/b/package.json"}
    assert {r["manifest"] for r in G.nearest_manifest(own).collect()} == {"packages/a/package.json"}


def test_file_signals(spark):
    own = table(spark, {"src/my-file.ts": "let a: any = 1;\nif (a) {}", "src/two-words.ts": "x", "src/snake_case.ts": "x", "src/plain.ts": "const m = 'old-1' + \"old-1x\";"})
    row = G.naming_styles(own).first()
    assert row["styles"] == {"kebab": 2, "snake": 1} and row["share"] == pytest.approx(2 / 3)
    assert {r["path"]: r["any_density"] for r in G.densities(own).collect()}["src/my-file.ts"] == pytest.approx(0.5)
    assert [r["proposed"] for r in G.rewritten_models(own, {"old-1": "new-2"}).collect()] == ["const m = 'new-2' + \"old-1x\";"]
    added = [("r", "p", "+", i, t) for i, t in enumerate(["import { used, idle as other } from 'x';", "used();", "a", "b"])]
    names = G.unused_imports(spark.createDataFrame(added, "repo string, path string, kind string, new_line_no long, text string"))
    assert [r["name"] for r in names.collect()] == ["other"]


@pytest.mark.parametrize(
    ("score", "expected"),
    [
        (lambda: S.scan(F.lit(1), F.lit(2)), 30.0),
        (lambda: S.verify(F.lit(2), F.lit(1)), 67.0),
        (lambda: S.clones(F.lit(0.1)), 60.0),
        (lambda: S.bloat(F.lit(12.0), F.lit(10), F.lit(1), F.lit(0)), 30.0),
        (lambda: S.architecture(F.lit(5), F.lit(1), F.lit(0), F.lit(0), F.lit(7), F.lit(0.2)), 74.0),
        (lambda: S.context(F.lit(1), F.lit(2), F.lit(13000)), 65.0),
        (lambda: S.loop(F.lit(11), F.lit(0.5), F.lit(3), F.lit(2)), 60.0),
        (lambda: S.debt(F.lit(100), F.lit(10), F.lit(1)), 67.0),
        (lambda: S.fleet(F.lit(1), F.lit(2)), 45.0),
        (lambda: S.hotspots(F.lit(2), F.lit(100), F.lit(1)), 85.0),
        (lambda: S.integrity(F.lit(5), F.lit(1), F.lit(1), F.lit(1), F.lit(9)), 67.0),
        (lambda: S.sandbox(F.lit(2.5)), 75.0),
        (lambda: S.too_small(F.lit(2), 3, F.lit(10.0)), 100.0),
    ],
)
def test_formulas(spark, score, expected):
    assert one(spark, score()) == pytest.approx(expected)


def test_blobs_at_a_revision(spark, root):  # noqa: F811
    got = {r["path"]: r["content"] for r in read_blobs(spark, str(root), ref="HEAD~1").collect()}
    assert set(got) == {"package.json", "src/a.ts"} and got["src/a.ts"].startswith("import _")


def test_commands(spark, root, tmp_path, capsys):  # noqa: F811
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [use("Write", file_path="a"), {"role": "system", "type": "summary", "content": "short"}]))
    for command in cli.COMMANDS:
        path = str(tmp_path) if command in ("fleet", "receipt", "subsidy", "loop", "compact") else str(root)
        assert cli.main([command, path]) == 0
    for form in ("text", "json", "badge"):
        assert cli.main(["audit", str(root), "--checks", "scan,guard", "--format", form]) in (0, 1)
    assert "shop" in capsys.readouterr().out


def test_environment(spark):
    assert G.sandbox_points(G.environment(spark)).first()["points"] >= 0
    assert {r["ai_framework"] for r in G.ai_framework(table(spark, {"a": "x"})).collect()} == {False}
    assert A.is_agent_file(F.col("p")) is not None
