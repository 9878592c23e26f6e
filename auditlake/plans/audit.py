"""Checks of source trees: each a plan from shared base tables to issues.

``files(repo, path, content, size)`` with path parts is the one base table; history, change sets and
session logs have their own plans in the operators.  Issues have the columns repo, check_name,
rule_id, severity, message, file, line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.extract import CatchBlocks, Functions, OpenAwaits, TestBlocks, extract
from ..functions.fixed_values import BUILTIN, PACKAGES, RETIRED_MODELS, SCAN_PATTERNS, SOURCE_PATTERNS
from ..operators import code, graph, history, lines, similarity
from ..operators.rules import Rule, file_issues

ISSUE = ["repo", "check_name", "rule_id", "severity", "message", "file", "line"]

#: Files that configure coding agents, and directories of such files.
AGENT_FILES = ["CLAUDE.md", "AGENTS.md", ".cursorrules", ".windsurfrules", ".aider.conf.yml", ".mcp.json", "mcp.json", ".github/copilot-instructions.md", "GEMINI.md"]
AGENT_DIRS = [".claude/", ".cursor/", ".windsurf/", ".continue/", ".roo/", ".cline/", ".codex/"]
CODE = [".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs"]

_FENCE = r"^\s*(```|~~~)"
_MD = r"\.mdc?\z"

SCAN_RULES = [Rule(name, severity, name.replace("-", " "), pattern) for name, severity, pattern in SCAN_PATTERNS]
_WHERE = {"exec-sync": r"^src/", "innerhtml": r"^(?!.*(test|spec))"}
SOURCE_RULES = [Rule(name, severity, name.replace("-", " "), pattern, paths=_WHERE.get(name)) for name, severity, pattern in SOURCE_PATTERNS]
_SQL, _SHELL, _JS = r"\.(sql|ts|js|py|rb|go|php|java|prisma)\z", r"\.(sh|bash)\z", r"\.(ts|js|mjs|cjs)\z"
GUARD_RULES = [
    Rule("drop-table", "error", "A table is dropped", r"(?i)\bdrop\s+table\b", paths=_SQL),
    Rule("drop-database", "error", "A database is dropped", r"(?i)\bdrop\s+(database|schema)\b", paths=_SQL),
    Rule("truncate", "error", "A table is emptied", r"(?i)\btruncate\s+(table\s+)?\w+\s*;?", paths=r"\.sql\z"),
    Rule("delete-filtered", "warning", "Rows are deleted", r"(?i)\bdelete\s+from\s+\w+.*\bwhere\b", paths=_SQL),
    Rule("delete-all", "error", "All rows are deleted", r"(?i)\bdelete\s+from\s+\w+", paths=_SQL, unless=r"(?i)\bwhere\b"),
    Rule("shell-remove", "error", "Files are removed", r"^\s*(sudo\s+)?rm\s+(-\w*[rf]\w*\s+)+|\brmdir\b|\bshred\b|\btruncate\s+-s", paths=_SHELL),
    Rule("exec-remove", "error", "A removing command is run", r"(exec|spawn)(Sync)?\s*\(\s*[\"'`](sudo\s+)?(rm|rmdir|shred|truncate)\b", paths=_JS),
]
STUB_RULES = [
    Rule("always-true", "error", "A test that cannot fail", r"expect\(\s*(true|1)\s*\)\.(toBe|toEqual|toStrictEqual)\(\s*(true|1)\s*\)|assert(\.ok)?\(\s*true\s*\)", paths=r"\.(test|spec)\."),
    Rule("empty-test", "error", "A test without a body", r"\b(it|test)\s*\([^,]+,\s*(async\s*)?\(\)\s*=>\s*\{\s*\}\s*\)", paths=r"\.(test|spec)\."),
    Rule("skipped-test", "warning", "A test is skipped", r"\b(it|test|describe)\.skip\s*\(|\bx(it|describe|test)\s*\(", paths=r"\.(test|spec)\."),
    Rule("todo-test", "warning", "A test is still to be written", r"\b(it|test)\.todo\s*\(", paths=r"\.(test|spec)\."),
]
PHRASES = [
    Rule("skip-permission", "warning", "Approval is waived", r"(?i)dangerously[- ]skip[- ]permissions|\bauto[- ]?approve\b|\byolo mode\b|without (asking|confirmation)|\bbypass permissions\b")
]
SECRET_FORM = r"(?i)\b(api[_-]?key|secret|token|passw(?:or)?d|private[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_=.-]{16,})"


def is_agent_file(path: Column) -> Column:
    out = path.isin(AGENT_FILES)
    for d in AGENT_DIRS:
        out = out | path.startswith(d)
    return out


def is_code(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(CODE) & ~F.col("path").endswith(".d.ts"))


def issues_of(frame: DataFrame, check: str, rule: str, severity: str | Column, message: str | Column, file: str | None = "path", line: str | None = "line") -> DataFrame:
    """Rows as issues."""
    own = lambda x: F.lit(x) if isinstance(x, str) else x
    return frame.select(
        "repo", F.lit(check).alias("check_name"), F.lit(rule).alias("rule_id"), own(severity).alias("severity"), own(message).alias("message"),
        (F.col(file) if file else F.lit(None)).cast("string").alias("file"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"),
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Security


def scan(files: DataFrame) -> DataFrame:
    """Rules over agent configuration; command substitution is allowed in workflows and in fenced text."""
    own = files.where(is_agent_file(F.col("path")) | F.col("path").startswith(".github/workflows/"))
    numbered = lines.with_parity(lines.lines_of(own, ["repo", "path"]), ["repo", "path"], F.col("text").rlike(_FENCE), "fenced")
    from ..operators.rules import scan as apply

    hits = apply(numbered, SCAN_RULES)
    flow = F.col("path").startswith(".github/workflows/")
    quiet = (F.col("rule_id") == "command-substitution") & (flow | (F.col("path").rlike(_MD) & (F.col("fenced") | F.col("text").rlike(r"`[^`]*\$\(")))) | ((F.col("rule_id") == "permission-escalation") & flow)
    named = hits.where(~quiet).select("repo", F.lit("scan").alias("check_name"), "rule_id", "severity", "message", F.col("path").alias("file"), F.col("line_no").cast("int").alias("line"))
    return named.unionByName(decoded_addresses(own))


def decoded_addresses(files: DataFrame) -> DataFrame:
    """Base64 runs of plain text that hold an address; the first of each file."""
    spread = lines.lines_of(files, ["repo", "path"]).select("*", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))).alias("run"))
    plain = F.expr("try_to_binary(run, 'base64')").cast("string")
    hit = spread.where(plain.rlike(r"\A[\x09\x0A\x0D\x20-\x7E]+\z") & plain.rlike("https?://"))
    return issues_of(lines.first_per(hit, ["repo", "path"], ["line_no"]), "scan", "decoded-address", "error", "Encoded text holds an address", line="line_no")


def source_security(files: DataFrame, most_bytes: int = 1 << 19) -> DataFrame:
    plain = is_code(files).where(F.col("size") <= most_bytes)
    return file_issues(plain, "source-security", SOURCE_RULES).join(comment_lines(plain), ["repo", "file", "line"], "left_anti")


def comment_lines(files: DataFrame) -> DataFrame:
    out = lines.lines_of(files, ["repo", "path"]).where(F.col("text").rlike(r"^\s*(//|\*|/\*|#)"))
    return out.select("repo", F.col("path").alias("file"), F.col("line_no").cast("int").alias("line"))


def guard(files: DataFrame) -> DataFrame:
    hits = file_issues(files, "guard", GUARD_RULES)
    destructive = r"(?i)\bdrop\s+(table|column|database)\b|\btruncate\b|\bdelete\s+from\b"
    moves = files.where(F.col("path").rlike(r"(?i)(^|/)(migrations?|db)/") & F.col("content").rlike(destructive) & ~F.col("content").rlike(r"(?i)\b(down|rollback|revert)\b"))
    return hits.unionByName(issues_of(moves, "guard", "no-rollback", "warning", "A destructive migration without a way back", line=None))


def secrets(files: DataFrame, least_entropy: float = 3.5) -> DataFrame:
    """Assigned values of environment and build files that look random.  (Our own rule: form and entropy.)"""
    own = files.where(F.col("base").startswith(".env") | F.col("path").rlike(r"(^|/)(dist|build|out|public)/"))
    spread = lines.lines_of(own, ["repo", "path"]).withColumn("value", F.regexp_extract("text", SECRET_FORM, 2))
    hit = spread.where((F.col("value") != "") & (X.entropy(F.col("value")) >= least_entropy))
    return issues_of(hit, "secrets", "random-value", "error", "A value that looks like a secret", line="line_no")


def models(files: DataFrame, retired: Sequence[str] = tuple(RETIRED_MODELS)) -> DataFrame:
    """Retired model names, quoted or assigned in code and configuration."""
    own = files.where(F.col("ext").isin([*CODE, ".py", ".json", ".yaml", ".yml", ".toml", ".env"]))
    rules = [Rule(name, "error", f"{name} is retired", rf"[\"'`=:\s]\Q{name}\E([\"'`\s,]|$)") for name in retired]
    return file_issues(own, "models", rules)


def permissions(files: DataFrame) -> DataFrame:
    """Agent settings and tool servers, from their JSON."""
    settings = files.where(F.col("path").rlike(r"(^|/)\.claude/settings(\.local)?\.json\z")).withColumn("v", F.try_parse_json("content"))
    allow = F.coalesce(F.try_variant_get("v", "$.permissions.allow", "array<string>"), F.array().cast("array<string>"))
    deny = F.coalesce(F.try_variant_get("v", "$.permissions.deny", "array<string>"), F.array().cast("array<string>"))
    mode = F.try_variant_get("v", "$.permissions.defaultMode", "string")
    good = settings.where("v IS NOT NULL")
    servers = files.where(F.col("base").isin("mcp.json", ".mcp.json")).withColumn("v", F.try_parse_json("content"))
    named = servers.where("v IS NOT NULL").select("repo", "path", F.explode(F.try_variant_get("v", "$.mcpServers", "map<string,struct<command:string,args:array<string>,url:string>>")).alias("name", "server"))
    args = F.coalesce(F.col("server.args"), F.array().cast("array<string>"))
    sensitive = r"^(~|/root|/home/\w+)?/?(\.ssh|\.aws|\.gnupg|\.config|etc)(/|$)|^/$|^~$"
    return union(
        [
            issues_of(settings.where("v IS NULL AND trim(content) <> ''"), "permissions", "invalid-json", "warning", "Settings cannot be read", line=None),
            issues_of(good.where(F.exists(allow, lambda a: a.rlike(r"^Bash(\(\*(:\*)?\))?\z"))), "permissions", "any-shell", "error", "Any shell command is allowed", line=None),
            issues_of(good.where(F.exists(allow, lambda a: a.isin("*", "*(*)"))), "permissions", "wildcard", "error", "Everything is allowed", line=None),
            issues_of(good.where(mode == "bypassPermissions"), "permissions", "bypass", "error", "Approval is bypassed", line=None),
            issues_of(good.where((F.size(allow) > 0) & (F.size(deny) == 0)), "permissions", "no-deny", "warning", "Nothing is denied", line=None),
            issues_of(named.where(F.exists(args, lambda a: a.rlike(sensitive))), "permissions", "sensitive-path", "error", F.concat(F.lit("A tool server reaches a sensitive path: "), F.col("name")), line=None),
            issues_of(named.where((F.size(args) == 0) & F.col("server.url").isNull()), "permissions", "no-roots", "warning", F.concat(F.lit("A tool server has no roots: "), F.col("name")), line=None),
            file_issues(files.where(is_agent_file(F.col("path"))), "permissions", PHRASES),
        ]
    )


# Integrity


def integrity(files: DataFrame) -> DataFrame:
    """Imports of nothing, swallowed errors, tests that cannot fail, awaits that nothing guards."""
    own = is_code(files)
    lost = graph.resolve_imports(graph.imports_of(own.where(~F.col("is_test"))), files).where(F.col("dst_path").isNull() & ~F.col("specifier").rlike(r"\.(css|svg|png|json|scss)\z|(^|/)(dist|build)/"))
    caught = extract(own.where(~F.col("is_test")), CatchBlocks)
    awaits = extract(own.where(~F.col("is_test")), OpenAwaits)
    return union(
        [
            issues_of(lost, "integrity", "unresolved-import", "error", F.concat(F.lit("No such file: "), F.col("specifier")), file="src_path", line=None),
            issues_of(caught.where("is_empty"), "integrity", "empty-catch", "warning", "An error is swallowed"),
            issues_of(caught.where("only_comment"), "integrity", "comment-catch", "info", "An error is only commented on"),
            file_issues(own, "integrity", STUB_RULES[:3]),
            issues_of(awaits, "integrity", "open-await", "warning", F.concat(F.lit("Nothing guards an await in "), F.col("function"))),
        ]
    )


def tests(files: DataFrame) -> DataFrame:
    """Tests that prove nothing."""
    own = is_code(files).where("is_test")
    blocks = extract(own, TestBlocks)
    same = F.regexp_extract("text", r"expect\(\s*([\w.\"']+)\s*\)\.(?:toBe|toEqual)\(\s*([\w.\"']+)\s*\)", 1)
    other = F.regexp_extract("text", r"expect\(\s*([\w.\"']+)\s*\)\.(?:toBe|toEqual)\(\s*([\w.\"']+)\s*\)", 2)
    told = lines.lines_of(own, ["repo", "path"]).where((same != "") & (same == other))
    again = lines.repeats_after_first(blocks, ["repo", "path", "name"], ["line"])
    empty = F.trim(F.regexp_replace("body", r"//[^\n]*", "")) == ""
    return union(
        [
            issues_of(told, "tests", "tautology", "error", "A value is compared with itself", line="line_no"),
            issues_of(blocks.where(empty), "tests", "empty-body", "error", F.concat(F.lit("Empty test: "), F.col("name"))),
            issues_of(blocks.where(~empty & (F.col("n_asserts") == 0)), "tests", "no-assertion", "warning", F.concat(F.lit("Nothing is asserted: "), F.col("name"))),
            issues_of(blocks.where("n_asserts > 0 AND n_asserts = n_mock_asserts"), "tests", "mock-only", "info", F.concat(F.lit("Only mocks are asserted: "), F.col("name"))),
            issues_of(again, "tests", "repeated-name", "info", F.concat(F.lit("A test name comes again: "), F.col("name"))),
            file_issues(own, "tests", STUB_RULES[2:]),
        ]
    )


def memory(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Agent files that name scoped packages nobody declares (``packages``: repo, package), or paths that are not there."""
    own = files.where(is_agent_file(F.col("path")) & F.col("path").rlike(_MD))
    spread = lines.lines_of(own, ["repo", "path"])
    scoped = spread.select("*", F.explode(F.regexp_extract_all("text", F.lit(r"@[a-z0-9-]+/[a-z0-9.-]+"), F.lit(0))).alias("package"))
    stale = scoped.join(packages, ["repo", "package"], "left_anti")
    refs = spread.select("repo", "path", "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[\s`(])\./?([\w-]+(?:/[\w.-]*[\w-])+)"), F.lit(1))).alias("ref"))
    there = files.select("repo", F.explode(F.concat(F.array("path"), X.ancestors(F.col("path")))).alias("ref")).distinct()
    return union(
        [
            issues_of(stale, "memory", "stale-package", "warning", F.concat(F.lit("No such package: "), F.col("package")), line="line_no"),
            issues_of(refs.join(there, ["repo", "ref"], "left_anti"), "memory", "broken-path", "error", F.concat(F.lit("No such path: "), F.col("ref")), line="line_no"),
        ]
    )


# Debt


def debt(files: DataFrame, least_length: int = 65) -> DataFrame:
    """Functions that repeat or nearly repeat, exports that nobody imports, names that drift."""
    own = is_code(files)
    found = extract(own, Functions).withColumn("t", similarity.normal_code(F.col("body"))).where(F.length("t") >= least_length)
    shown = F.col("path").rlike(r"(^|/)(tests?|__tests__|examples?|fixtures?|demos?)/|\.(test|spec)\.")
    groups = found.groupBy("repo", "t").agg(F.count("*").alias("n"), F.min(F.struct("path", "line", "name")).alias("first"), F.bool_or(shown).alias("shown")).where("n >= 2")
    near = similarity.near_pairs(found.withColumn("k", F.concat_ws("#", "path", F.lpad("line", 6, "0"), "name")), "k", "t", block=["repo"])
    exports = lines.lines_of(own.where(~F.col("is_test") & ~F.col("base").rlike(r"^(index|main|cli)\.")), ["repo", "path"]).withColumn(
        "name", F.regexp_extract("text", r"^export\s+(?:async\s+)?(?:function|const|class|let)\s+([\w$]+)", 1)
    ).where("name <> ''")
    used = own.select("repo", F.col("path").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
    orphan = exports.join(used, [exports["repo"] == used["repo"], exports["name"] == used["name"], exports["path"] != used["other"]], "left_anti")
    verbs = extract(own, Functions).withColumn("v", history.split_verb(F.col("name"))).where("v IS NOT NULL").select("repo", "v.verb", "v.suffix")
    drift = history.naming_drift(verbs, "verb", "suffix", keys=["repo"])
    return union(
        [
            issues_of(groups.select("repo", "first.*", "n", "shown"), "debt", "exact-duplicate", F.when(F.col("shown"), "info").otherwise("warning"), F.concat(F.col("n").cast("string"), F.lit(" copies of "), F.col("name"))),
            issues_of(near.withColumn("path", F.substring_index("a", "#", 1)), "debt", "near-duplicate", "warning", F.concat(F.col("a"), F.lit(" ~ "), F.col("b")), line=None),
            issues_of(orphan, "debt", "orphan-export", "warning", F.concat(F.lit("Nobody uses "), F.col("name")), line="line_no"),
            issues_of(drift, "debt", "naming-drift", "info", F.concat(F.array_join("verbs", "/"), F.lit(" for "), F.col("suffix")), file=None, line=None),
        ]
    )


def clones(files: DataFrame, size: int = 10) -> DataFrame:
    """Windows of lines that several files share, greedily chosen."""
    useful = F.size(F.filter("_l", lambda x: F.length(F.trim(x)) > 1)) * 2 >= F.size("_l")
    windows = similarity.clone_windows(is_code(files), ["repo", "path"], F.split(similarity_lines(F.col("content")), "\n"), size, useful=useful, least_chars=40)
    firsts = windows.groupBy("repo", "h", "path").agg(F.min("start").alias("start"))
    groups = firsts.groupBy("repo", "h").agg(F.count("*").alias("n_files"), F.min(F.struct("path", "start")).alias("f")).where("n_files >= 2")
    flat = groups.select("repo", "h", "n_files", F.col("f.path").alias("first_file"), F.col("f.start").alias("first_start"))
    kept = flat.groupBy("repo").applyInPandas(lambda g: similarity.greedy_cover(g, size), flat.schema)
    return issues_of(kept, "clones", "shared-block", "info", F.concat(F.col("n_files").cast("string"), F.lit(" files share a block")), file="first_file", line="first_start")


def similarity_lines(content: Column) -> Column:
    """Content with strings and numbers to one form, lines kept."""
    return F.regexp_replace(F.regexp_replace(content, r"([\"'])(?:\\.|(?!\1)[^\\\n])*\1", "\"S\""), r"\b\d+\b", "0")


# Dependencies, architecture, readiness


def manifests(files: DataFrame) -> DataFrame:
    """Declared packages: repo, path of the manifest, package, whether for development."""
    own = files.where("base = 'package.json'").withColumn("v", F.try_parse_json("content")).where("v IS NOT NULL")
    get = lambda k: F.coalesce(F.map_keys(F.try_variant_get("v", f"$.{k}", "map<string,string>")), F.array().cast("array<string>"))
    spread = own.select("repo", "path", F.explode(F.array(F.struct(F.concat(get("dependencies"), get("peerDependencies"), get("optionalDependencies")).alias("p"), F.lit(False).alias("dev")), F.struct(get("devDependencies").alias("p"), F.lit(True).alias("dev")))).alias("x"))
    return spread.select("repo", "path", F.explode("x.p").alias("package"), F.col("x.dev").alias("dev")).distinct()


def deps(files: DataFrame) -> DataFrame:
    """Packages that are imported and not declared, declared and not imported, or look like well-known ones."""
    declared = manifests(files)
    used = graph.imports_of(is_code(files)).withColumn("package", graph.package_name(F.col("specifier"))).where(F.col("package").isNotNull() & ~F.col("package").isin(BUILTIN))
    names = declared.select("repo", "package").distinct()
    phantom = used.join(names, ["repo", "package"], "left_anti").groupBy("repo", "package").agg(F.min("src_path").alias("path"))
    dead = declared.where("NOT dev").join(used, ["repo", "package"], "left_anti")
    return union(
        [
            issues_of(phantom, "deps", "undeclared", "warning", F.concat(F.lit("Not declared: "), F.col("package")), line=None),
            issues_of(dead, "deps", "unused", "info", F.concat(F.lit("Not imported: "), F.col("package")), line=None),
            issues_of(similarity.look_alikes(declared, "package", PACKAGES), "deps", "look-alike", "error", F.concat_ws(" looks like ", "package", "known"), line=None),
        ]
    )


def architecture(files: DataFrame) -> dict[str, DataFrame]:
    """Edges, module coupling, hubs, boundary violations, cycles and communities of the import graph."""
    own = is_code(files).where("NOT is_test")
    edges = graph.resolve_imports(graph.imports_of(own), own).where("dst_path IS NOT NULL")
    modules = graph.module_edges(edges).withColumn("ord", F.xxhash64("src", "dst"))
    files_ = edges.select("repo", F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    return {
        "edges": edges,
        "modules": graph.coupling(modules, keys=["repo"]),
        "hubs": graph.hubs(files_, 10, ["repo"]),
        "violations": graph.boundary_violations(edges),
        "cycles": graph.module_cycles(modules),
        "communities": graph.module_communities(modules),
    }


def deep(files: DataFrame) -> DataFrame:
    """Complex, nested or oddly named functions, from brackets and key words (not from a syntax tree), and hard files."""
    found = extract(is_code(files).where("NOT is_test"), Functions)
    hard = code.file_metrics(is_code(files).where("NOT is_test")).where("sloc > 0")
    return union(
        [
            issues_of(found.where("cyclomatic > 20"), "deep", "very-complex", "warning", F.concat_ws(" ", "name", "cyclomatic")),
            issues_of(found.where("cyclomatic BETWEEN 11 AND 20"), "deep", "complex", "info", F.concat_ws(" ", "name", "cyclomatic")),
            issues_of(found.where("nesting > 4"), "deep", "nested", "warning", F.concat_ws(" ", "name", "nesting")),
            issues_of(found.where("cognitive > 15"), "deep", "cognitive", "info", F.concat_ws(" ", "name", "cognitive")),
            issues_of(found.where("n_params >= 5"), "deep", "parameters", "info", F.concat_ws(" ", "name", "n_params")),
            issues_of(hard.where("maintainability < 20"), "deep", "hard-to-maintain", "warning", F.format_number("maintainability", 1), line=None),
        ]
    )


def aiready(files: DataFrame) -> DataFrame:
    """Shares that tell how well an assistant can work on a repository: clear, typed functions; depth; window fit."""
    own = is_code(files)
    found = extract(own, Functions)
    size = F.col("end_line") - F.col("line") + 1
    clear = found.groupBy("repo").agg(
        F.avg(((size <= 25) & (F.col("n_params") < 5)).cast("double")).alias("clarity"), F.avg((F.col("params_typed") & F.col("has_return_type")).cast("double")).alias("typed"), F.count("*").alias("n_functions")
    )
    tree = own.groupBy("repo").agg(F.count("*").alias("n_files"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), (F.sum(F.length("content")) / 4).cast("long").alias("est_tokens"))
    return tree.join(clear, "repo", "left").withColumn("window_fit", F.least(F.lit(1.0), 128_000.0 / F.greatest("est_tokens", F.lit(1))))


def context_cost(files: DataFrame) -> DataFrame:
    """Sections of agent files with their estimated tokens."""
    own = files.where(is_agent_file(F.col("path")) & F.col("path").rlike(_MD))
    return lines.sections(lines.lines_of(own, ["repo", "path"]), ["repo", "path"], F.col("text").rlike("^#{2,3} "))


#: For each topic of a review guide: what names it.
REVIEW = {"security": r"(?i)secur|vulnerab|secret", "tests": r"(?i)\btests?\b|coverage", "style": r"(?i)style|naming|format", "performance": r"(?i)perform|speed|memory", "example": r"(?s)```.+```"}


def review(files: DataFrame) -> DataFrame:
    """Score of each review guide, 20 points for each topic."""
    own = files.where("base = 'REVIEW.md' AND depth <= 3")
    return own.select("repo", "path", sum((F.col("content").rlike(p).cast("int") for p in REVIEW.values()), F.lit(0)).alias("topics")).withColumn("score", 20.0 * F.col("topics"))


def ready(files: DataFrame) -> DataFrame:
    """What a repository lacks, and files that are too large."""
    has = lambda cond: F.bool_or(cond)
    path = F.col("path")
    by = files.groupBy("repo").agg(
        has(path.rlike(r"(?i)^readme(\.\w+)?\z")).alias("readme"), has(path.rlike(r"(^|/)(package\.json|pyproject\.toml|go\.mod|Cargo\.toml)\z")).alias("manifest"),
        has(F.col("is_test")).alias("tests"), has(F.col("content").rlike(r"process\.env\.|os\.environ")).alias("env"), has(path.rlike(r"(^|/)\.env\.(example|sample)\z")).alias("env_example"),
        has(F.col("ext").isin(".js", ".jsx")).alias("js"), has(F.col("ext").isin(".ts", ".tsx")).alias("ts"),
    )
    n = F.size(F.split("content", "\n"))
    large = files.where(F.col("ext").isin([*CODE, ".py", ".go", ".rs", ".java"]) & ~F.col("is_example") & (n > F.when(F.col("is_test"), 1000).otherwise(500)))
    large = large.withColumn("n", n)
    lack = lambda cond, rule, sev, msg: issues_of(by.where(cond), "ready", rule, sev, msg, file=None, line=None)
    return union(
        [
            lack(~F.col("readme"), "no-readme", "error", "There is no readme"),
            lack(~F.col("manifest"), "no-manifest", "error", "There is no manifest"),
            lack(~F.col("tests"), "no-tests", "error", "There are no tests"),
            lack(F.col("env") & ~F.col("env_example"), "no-env-example", "warning", "Environment variables without an example"),
            lack(F.col("js") & ~F.col("ts"), "untyped", "info", "No typed sources"),
            issues_of(large, "ready", "large-file", "warning", F.concat(F.col("n").cast("string"), F.lit(" lines")), line=None),
        ]
    )


def completeness(files: DataFrame, last_commit: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Points for sources, tests, a manifest, types, documents, continuous integration, linting and freshness, up to 100."""
    path, source = F.col("path"), F.col("ext").isin([*CODE]) & ~F.col("is_test")
    by = files.groupBy("repo").agg(
        F.count_if(source).alias("src"), F.count_if(F.col("is_test")).alias("tests"), F.bool_or(F.col("base") == "package.json").alias("manifest"), F.bool_or(F.col("base") == "tsconfig.json").alias("types"),
        F.bool_or(path.rlike(r"(?i)^readme")).alias("docs"), F.bool_or(path.startswith(".github/workflows/")).alias("ci"), F.bool_or(F.col("base").rlike(r"^(\.eslintrc|eslint\.config|\.prettierrc|biome\.json)")).alias("lint"),
    )
    points = (
        F.when(F.col("src") >= 5, 25).when(F.col("src") > 0, 15).otherwise(0) + F.when(F.col("tests") >= 3, 20).when(F.col("tests") > 0, 10).otherwise(0)
        + F.when(F.col("manifest"), 15).otherwise(0) + F.when(F.col("types"), 10).otherwise(0) + F.when(F.col("docs"), 10).otherwise(0) + F.when(F.col("ci"), 10).otherwise(0) + F.when(F.col("lint"), 10).otherwise(0)
    )
    if last_commit is not None:
        months = (now - F.col("epoch")) / (30.44 * 86400)
        by = by.join(last_commit, "repo", "left")
        points = points + F.when(F.col("epoch").isNull(), 0).when(months < 6, 10).when(months < 12, 5).when(months < 24, 0).otherwise(-15)
    return by.select("repo", F.when(F.col("src") == 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), points))).cast("double").alias("completeness"))


def visibility(files: DataFrame) -> DataFrame:
    """Each file's tier: agent configuration, referred to by it (or below a directory that is), or invisible."""
    own = files.where(is_agent_file(F.col("path")))
    refs = own.select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"[`\s(]\.?/?([\w.-]+(?:/[\w.-]+)*)/?[`\s),:]"), F.lit(1))).alias("ref")).distinct()
    reach = files.select("repo", "path", F.explode(F.concat(F.array("path"), X.ancestors(F.col("path")))).alias("ref")).join(refs, ["repo", "ref"], "left_semi").select("repo", "path").distinct()
    seen = files.select("repo", "path").join(reach.withColumn("hit", F.lit(True)), ["repo", "path"], "left")
    return seen.select("repo", "path", F.when(is_agent_file(F.col("path")), "config").when(F.col("hit"), "visible").otherwise("invisible").alias("tier"))


def language(files: DataFrame) -> DataFrame:
    """typescript, javascript, python or unknown, by marker files."""
    has = lambda p: F.bool_or(F.col("path").rlike(p))
    by = files.groupBy("repo").agg(has(r"^tsconfig.*\.json\z").alias("ts"), has(r"^package\.json\z").alias("js"), has(r"^(pyproject\.toml|setup\.py|requirements\.txt)\z").alias("py"))
    return by.select("repo", F.when(F.col("ts"), "typescript").when(F.col("js"), "javascript").when(F.col("py"), "python").otherwise("unknown").alias("language"))
