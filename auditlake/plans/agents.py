"""Agent configuration, sessions and change claims: the finer signals."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.fixed_values import CONVENTIONS, RETIRED_MODELS
from ..operators import lines, sessions
from .audit import CODE, is_agent_file, is_code, issues_of

#: Commands that run tests, and what their output says, in the order it is asked.
TEST_COMMANDS = r"\b(jest|vitest|pytest|make\s+test|cargo\s+test)\b|npm\s+(run\s+)?test\b|(yarn|pnpm)\s+test\b|node\s+--test\b|\bgo\s+test\b|\bmocha\b"
OUTCOMES = [
    ("fail", r"(?i)\b[1-9]\d*\s+fail(ed|ing|ure)?\b"), ("fail", r"\bFAIL\b"), ("fail", r"(?i)exit code [1-9]"), ("pass", r"(?i)\b0\s+fail(ed|ing|ure)?\b"),
    ("pass", r"(?i)\b(passing|passed)\b|test result:\s*ok\b|all tests passed"), ("fail", r"(?i)\b(failed|failing|failure|error)\b"), ("pass", r"(?i)\bpass\b"),
]

#: Where hosts keep secrets, names of variables that hold them, and the points of each.
SENSITIVE = ["~/.ssh", "~/.aws", "~/.gnupg", "~/.kube", "~/.docker", "~/.netrc", "~/.npmrc", "~/.config/gcloud", "/var/run/docker.sock"]
SECRET_NAMES = r"(?i)(secret|token|passw(or)?d|api_?key|credential|private)"

#: Tools that exclude each other, by topic.
RIVALS = {
    "package manager": ["npm", "yarn", "pnpm", "bun"], "test runner": ["jest", "vitest", "mocha"], "formatter": ["prettier", "biome"], "orm": ["prisma", "drizzle", "typeorm"], "styling": ["tailwind", "styled-components"],
}

#: For each package of a stack: words of which a configuration should hold one.
STACK = {
    "react": ["react", "jsx", "component"], "next": ["next", "app router"], "vue": ["vue"], "typescript": ["typescript", "types"], "vitest": ["vitest", "test"], "jest": ["jest", "test"],
    "express": ["express", "route"], "prisma": ["prisma", "schema"], "tailwindcss": ["tailwind"], "eslint": ["eslint", "lint"],
}


def is_test_command(command: Column) -> Column:
    return F.coalesce(command.rlike(TEST_COMMANDS), F.lit(False))


def outcome(text: Column) -> Column:
    """pass, fail or unknown: the first sign in order decides."""
    out = F.lit("unknown")
    for verdict, form in reversed(OUTCOMES):
        out = F.when(text.rlike(form), F.lit(verdict)).otherwise(out)
    return out


def writes_file(tool: Column, command: Column) -> Column:
    """Whether a call changes files: by its tool's name, or by what its command does."""
    return F.lower(tool).rlike("write|edit|str_replace") | F.coalesce(command.rlike(r"(^|[^0-9&>])>{1,2}\s*[\w./~-]+|\btee\s|\bsed\s+-i"), F.lit(False))


def loops(parsed: DataFrame) -> DataFrame:
    """Iterations of each session between test runs: changes, files, tokens and the outcome of the run that opens each."""
    calls = sessions.tool_calls(parsed).withColumn("is_test", is_test_command(F.col("command")))
    numbered = sessions.with_iteration(calls, F.col("is_test"), order=["seq", "block_no"])
    tested = numbered.where("is_test").select("session").distinct()
    write = writes_file(F.col("tool"), F.col("command"))
    by = numbered.join(tested, "session", "left_semi").groupBy("session", "iter_no").agg(
        F.count_if(write).alias("changes"), F.count_distinct(F.when(write, F.coalesce("file_path", "command"))).alias("files"), F.min(F.when(F.col("is_test"), F.col("seq"))).alias("test_seq")
    )
    results = sessions.blocks(parsed).where("kind = 'tool_result'").select("session", F.col("seq").alias("r_seq"), F.coalesce(F.try_variant_get("block", "$.content", "string"), F.col("block_text")).alias("said"))
    near = by.join(results, (by["session"] == results["session"]) & (results["r_seq"] >= by["test_seq"]), "left").groupBy(by["session"], "iter_no", "changes", "files").agg(F.min_by("said", "r_seq").alias("said"))
    return near.withColumn("outcome", F.when(F.col("said").isNull(), "unknown").otherwise(outcome(F.col("said")))).drop("said")


def terms(text: Column) -> dict[str, Column]:
    """Paths, identifiers and instructions that a text holds, each once."""
    find = lambda form, group=0: F.array_distinct(F.regexp_extract_all(text, F.lit(form), F.lit(group)))
    return {
        "paths": find(r"(?:[\w.-]+/)+[\w.-]*\w"),
        "identifiers": find(r"\b(?:[a-z]+(?:[A-Z][a-z0-9]+)+|[a-z]+(?:_[a-z0-9]+)+)\b"),
        "instructions": F.filter(F.transform(find(r"(?i)\b(?:always|never|must|don't|do not)\b[^.\n]{8,}"), F.trim), lambda x: F.length(x) > 10),
    }


def lost_instruction(instruction: Column, summary: Column) -> Column:
    """Whether under half of an instruction's longer words survive."""
    words = F.filter(F.split(F.lower(instruction), r"\W+"), lambda w: F.length(w) > 3)
    kept = F.size(F.filter(words, lambda w: F.contains(F.lower(summary), w)))
    return (F.size(words) > 0) & (kept * 2 < F.size(words))


def environment(spark: SparkSession) -> DataFrame:
    """What this host exposes to an agent.  Only for an audit of the driver's own machine."""
    paths = [("path", p, 1.0) for p in SENSITIVE if os.path.exists(os.path.expanduser(p))]
    names = [("env", n, 0.5) for n in sorted(os.environ) if re.search(SECRET_NAMES, n)]
    return spark.createDataFrame(paths + names, "kind string, name string, points double")


def sandbox_points(exposed: DataFrame, *, most_env: float = 3.0) -> DataFrame:
    own = F.sum(F.when(F.col("kind") == "path", F.col("points")).otherwise(0.0))
    env = F.least(F.lit(most_env), F.sum(F.when(F.col("kind") == "env", F.col("points")).otherwise(0.0)))
    return exposed.agg((F.coalesce(own, F.lit(0.0)) + F.coalesce(env, F.lit(0.0))).alias("points"))


def contradictions(files: DataFrame) -> DataFrame:
    """Tools of one topic that different agent files first mention."""
    spread = lines.lines_of(files.where(is_agent_file(F.col("path"))), ["repo", "path"])
    table = [(topic, tool) for topic, tools in RIVALS.items() for tool in tools]
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(rf"(?i)(^|[^\w-]){tool}([^\w-]|$)"), F.struct(F.lit(topic).alias("topic"), F.lit(tool).alias("tool"))) for topic, tool in table]))
    first = spread.select("repo", "path", "line_no", F.explode(hit).alias("h")).groupBy("repo", "h.topic", "h.tool").agg(F.min(F.struct("path", "line_no")).alias("at"))
    a = first.select("repo", "topic", F.col("tool").alias("a"), F.col("at.path").alias("path"), F.col("at.line_no").alias("line"))
    b = first.select("repo", "topic", F.col("tool").alias("b"), F.col("at.path").alias("other"))
    pairs = a.join(b, ["repo", "topic"]).where("a < b AND path <> other")
    return issues_of(pairs, "memory", "contradiction", "warning", F.concat(F.col("topic"), F.lit(": "), F.col("a"), F.lit(" or "), F.col("b")))


def config_quality(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Sub-scores from 0 to 10 of each repository's best agent file: completeness, consistency with the stack, specifics."""
    own = files.where(is_agent_file(F.col("path")) & F.col("path").rlike(r"\.mdc?\z|rules\z"))
    topics = [r"(?i)\btest", r"(?i)\bbuild|compile", r"(?i)style|convention|format", r"(?i)architect|structure|director", r"(?i)\bdo not|never|avoid"]
    complete = 2.0 * sum((F.col("content").rlike(t).cast("int") for t in topics), F.lit(0))
    concrete = F.least(F.lit(10.0), F.regexp_count("content", F.lit(r"`[^`\n]+`")).cast("double"))
    stack = packages.where(F.col("package").isin(list(STACK))).groupBy("repo").agg(F.collect_set("package").alias("stack"))
    joined = own.join(stack, "repo", "left").withColumn("stack", F.coalesce("stack", F.array().cast("array<string>")))
    told = F.filter(
        F.array(*[F.when(F.array_contains("stack", p) & sum((F.contains(F.lower("content"), F.lit(w)).cast("int") for w in ws), F.lit(0)).cast("boolean"), F.lit(p)) for p, ws in STACK.items()]), lambda x: x.isNotNull()
    )
    consistent = F.when(F.size("stack") == 0, 10.0).otherwise(10.0 * F.size(told) / F.size("stack"))
    each = joined.select("repo", "path", complete.alias("complete"), consistent.alias("consistent"), concrete.alias("specific"))
    total = F.col("complete") + F.col("consistent") + F.col("specific")
    return each.groupBy("repo").agg(F.max_by(F.struct("path", "complete", "consistent", "specific"), F.struct(total, F.col("path"))).alias("b")).select("repo", "b.*")


def ai_framework(files: DataFrame) -> DataFrame:
    """Repositories that are themselves tools for models."""
    path = F.col("path")
    sign = (path.rlike(r"(^|/)package\.json\z") & F.col("content").rlike(r"(?i)\"(name|keywords)\"[^}]*\b(llm|agents?|langchain|openai|anthropic)\b")) | (
        path.rlike(r"^([^/]+/){0,2}pyproject\.toml\z") & F.col("content").rlike(r"(?i)\b(langchain|llama|openai|transformers|litellm)\b")
    )
    return files.groupBy("repo").agg(F.bool_or(F.coalesce(sign, F.lit(False))).alias("ai_framework"))


def stale_sections(files: DataFrame, log_text: DataFrame) -> DataFrame:
    """Sections of agent files none of whose first twenty longer words comes in recent sessions (``repo``, ``text``)."""
    numbered = lines.with_section(lines.lines_of(files.where(is_agent_file(F.col("path"))), ["repo", "path"]), ["repo", "path"], F.col("text").rlike("^#{2,3} "))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 4)), 1, 20)
    each = numbered.groupBy("repo", "path", "section").agg(words.alias("w"), F.min("line_no").alias("line")).where("size(w) > 0")
    seen = log_text.select("repo", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("word")).distinct()
    live = each.select("repo", "path", "section", F.explode("w").alias("word")).join(seen, ["repo", "word"], "left_semi").select("repo", "path", "section").distinct()
    return issues_of(each.join(live, ["repo", "path", "section"], "left_anti"), "context", "stale-section", "warning", "Nothing recent speaks of this section")


def verdicts(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """What became of each changed or claimed file (``repo``, ``path``, ``claimed``): the first that holds of a ladder."""
    n = F.size(F.filter(F.split(F.col("content"), "\n"), lambda x: F.trim(x) != ""))
    path, base = F.col("path"), F.substring_index("path", "/", -1)
    exempt = base.rlike(r"^\.|\.(json|ya?ml|toml|lock|md|txt|css|svg)\z|^(index|types|constants|config)\.|\.d\.ts\z|^__init__\.py\z")
    test = path.rlike(r"(^|/)(tests?|__tests__)/|\.(test|spec)\.")
    asserted = F.col("content").rlike(r"\b(expect|assert\w*)\s*[.(]|\bassert\b|\.should\b")
    joined = claimed.join(files.select("repo", "path", "content", F.lit(True).alias("found")), ["repo", "path"], "left")
    ladder = (
        F.when(F.col("found").isNull() & F.col("claimed"), "missing")
        .when(F.col("found").isNull(), "gone")
        .when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty")
        .when(exempt, "verified")
        .when(test & ~asserted & F.col("content").rlike(r"\b(it|test|def test_)\b"), "asserts nothing")
        .when(n < 10, "thin")
        .otherwise("verified")
    )
    return joined.select("repo", "path", "claimed", ladder.alias("verdict"))


def unused_imports(diff_lines: DataFrame) -> DataFrame:
    """Names that added lines import and nothing else of the added lines uses, in files with over three added lines."""
    added = diff_lines.where("kind = '+'")
    form = r"import\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)|\{\s*([^}]*)\})"
    name = F.regexp_extract("text", form, 1)
    inner = F.transform(F.split(F.regexp_extract("text", form, 2), ","), lambda x: F.trim(F.regexp_replace(x, r"^.*\bas\s+", "")))
    imports = added.where(F.col("text").rlike(r"^\s*import\b")).select("repo", "path", "new_line_no", F.explode(F.concat(F.array(name), inner)).alias("name")).where("length(name) >= 2")
    used = added.where(~F.col("text").rlike(r"^\s*import\b")).select("repo", "path", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name")).distinct()
    large = added.groupBy("repo", "path").agg(F.count("*").alias("n")).where("n > 3").select("repo", "path")
    return imports.join(large, ["repo", "path"], "left_semi").join(used, ["repo", "path", "name"], "left_anti")


def workspaces(files: DataFrame) -> DataFrame:
    """Manifests below the workspace globs (one ``*`` for a segment) of each repository's manifests."""
    own = files.where("depth = 0")
    listed = own.where("base = 'package.json'").select("repo", F.explode(F.coalesce(F.try_variant_get(F.try_parse_json("content"), "$.workspaces", "array<string>"), F.try_variant_get(F.try_parse_json("content"), "$.workspaces.packages", "array<string>"))).alias("glob"))
    lerna = own.where("base = 'lerna.json'").select("repo", F.explode(F.try_variant_get(F.try_parse_json("content"), "$.packages", "array<string>")).alias("glob"))
    pnpm = own.where("base = 'pnpm-workspace.yaml'").select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"[\"'\s-]([\w./-]*\*[\w./*-]*)"), F.lit(1))).alias("glob"))
    globs = listed.unionByName(lerna).unionByName(pnpm).distinct()
    form = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(F.regexp_replace("glob", r"/\z", ""), r"([.+()])", r"\\$1"), F.lit("**"), F.lit(".+")), F.lit("*"), F.lit("[^/]+")), F.lit("/package\\.json$"))
    found = files.where("base = 'package.json' AND depth > 0").join(globs.withColumn("form", form), "repo").where(F.expr("path rlike form"))
    return found.select("repo", "path", F.try_variant_get(F.try_parse_json("content"), "$.name", "string").alias("name")).distinct()


def nearest_manifest(files: DataFrame) -> DataFrame:
    """For each code file the manifest of its nearest directory that has one, the root left out."""
    near = is_code(files).select("repo", "path", F.posexplode(X.ancestors(F.col("path"))).alias("depth", "dir"))
    own = files.where("base = 'package.json' AND depth > 0").select("repo", "dir", F.col("path").alias("manifest"))
    return near.join(own, ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by("manifest", "depth").alias("manifest"))


def not_conventional(exports: DataFrame) -> DataFrame:
    """Exports that no framework convention uses."""
    where = F.col("path").rlike(r"(^|/)(pages|app|routes|api)/|(^|/)middleware\.[cm]?[jt]s\z|\.config\.[cm]?[jt]s\z|(^|/)\+(page|layout|server)")
    return exports.where(~(F.col("name").isin(CONVENTIONS) & where))


def naming_styles(files: DataFrame) -> DataFrame:
    """Files of each naming style and the share of the commonest; plain lower-case names count in none."""
    stem = F.regexp_replace("base", r"\..*\z", "")
    style = F.when(stem.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+\z"), "kebab").when(stem.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+\z"), "snake").when(stem.rlike(r"^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)*\z"), "Pascal").when(stem.rlike(r"^[a-z]+([A-Z][a-z0-9]*)+\z"), "camel")
    by = is_code(files).withColumn("style", style).where("style IS NOT NULL").groupBy("repo", "style").agg(F.count("*").alias("n"))
    return by.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("style", "n")))).alias("styles"), (F.max("n") / F.sum("n")).alias("share"))


def densities(files: DataFrame) -> DataFrame:
    """For each code file: uses of ``any`` a line, and branches a line (padding is long and hardly branches)."""
    n = F.size(F.split("content", "\n"))
    code_lines = F.array_join(F.filter(F.split("content", "\n"), lambda x: ~x.rlike(r"^\s*(//|\*|/\*)")), "\n")
    return is_code(files).select(
        "repo", "path", n.alias("n_lines"),
        (F.regexp_count(code_lines, F.lit(r":\s*any\b|\bas any\b|<any>")) / n).alias("any_density"),
        (F.regexp_count("content", F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?")) / n).alias("branch_density"),
        ((n > 1000) & (F.regexp_count("content", F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?")) / n < 0.02)).alias("padding"),
    )


def large_other_files(files: DataFrame, least: int = 10 << 20, exts: Sequence[str] = (".json", ".csv", ".sql", ".log")) -> DataFrame:
    return files.where(F.col("ext").isin(list(exts)) & (F.col("size") > least)).select("repo", "path", "size")


def context_load(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Mean relative imports of a code file, and files within two steps of each on average."""
    out = edges.select("repo", F.col("src_path").alias("a"), F.col("dst_path").alias("b")).distinct()
    two = out.join(out.select("repo", F.col("a").alias("b"), F.col("b").alias("c")), ["repo", "b"]).where("a <> c").select("repo", "a", F.col("c").alias("b"))
    reach = out.unionByName(two).distinct().groupBy("repo").agg(F.count("*").alias("reach"))
    n = is_code(files).groupBy("repo").agg(F.count("*").alias("n"))
    direct = edges.groupBy("repo").agg(F.count("*").alias("direct"))
    joined = n.join(direct, "repo", "left").join(reach, "repo", "left").fillna(0)
    return joined.select("repo", (F.col("direct") / F.col("n")).alias("imports_per_file"), (F.col("reach") / F.col("n")).alias("two_step_files"))


def orphan_modules(files: DataFrame, coupled: DataFrame, module: Column) -> DataFrame:
    """Modules of over two files that nothing imports and that import nothing, without an entry file."""
    by = is_code(files).withColumn("node", module).groupBy("repo", "node").agg(F.count("*").alias("n"), F.bool_or(F.col("base").rlike(r"^(index|main|app|cli|server)\.")).alias("entry"))
    return by.where("n > 2 AND NOT entry").join(coupled.where("ca + ce > 0"), ["repo", "node"], "left_anti").select("repo", "node", "n")


def unstable(coupled: DataFrame) -> DataFrame:
    """Modules that many depend on and that depend on much themselves."""
    return coupled.where("instability > 0.8 AND ca >= 3")


def rewritten_models(files: DataFrame, replacements: dict[str, str] = RETIRED_MODELS) -> DataFrame:
    """Proposals (path, content) with quoted model names replaced; nothing is written."""
    content = F.col("content")
    for old, new in replacements.items():
        content = F.regexp_replace(content, rf"([\"'`])\Q{old}\E\1", f"$1{new}$1")
    return files.where(F.col("ext").isin([*CODE, ".py", ".json", ".yaml", ".yml"])).withColumn("proposed", content).where("proposed <> content").select("repo", "path", "proposed")


def proposed_config(files: DataFrame, packages: DataFrame) -> DataFrame:
    """A first agent file for repositories without one, from what they declare."""
    have = files.where(is_agent_file(F.col("path"))).select("repo").distinct()
    own = packages.groupBy("repo").agg(F.array_sort(F.collect_set("package")).alias("stack"))
    text = F.concat(F.lit("# Project guide\n\n## Stack\n\n"), F.array_join(F.transform("stack", lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("\n\n## Commands\n\n- `npm test`\n"))
    return own.join(have, "repo", "left_anti").select("repo", F.lit("AGENTS.md").alias("path"), text.alias("proposed"))


def since(entries: DataFrame, start: Column) -> DataFrame:
    """Entries from ``start`` on; those without a readable time stay."""
    return entries.where(F.col("ts").isNull() | (F.col("ts") >= start))

