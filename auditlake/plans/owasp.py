"""Ten topics of agent security over agent configuration.

Every finding has the points it costs; a topic's points are capped where :data:`CAPS` says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..operators import lines

#: The most points that a topic costs.
CAPS = {"ASI01": 15, "ASI02": 30, "ASI03": 30, "ASI05": 10}
_KEYS = ["repo", "path"]


def under(path: Column, targets: Sequence[str]) -> Column:
    """Whether a path is one of the targets or lies below one."""
    out = path.isin(list(targets))
    for t in targets:
        out = out | path.startswith(t + "/")
    return out


def _says(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("(?i)" + "|".join(words))


def _found(frame: DataFrame, topic: str, severity: str, message: str | Column, points: int, file: str | None = "path", line: str | None = None) -> DataFrame:
    return frame.select(
        "repo", F.lit(topic).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.col(file) if file else F.lit(None)).cast("string").alias("file"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.lit(points).alias("points"),
    )


def _servers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed tool server files, and their servers: ``name`` and ``server``."""
    parsed = files.where(under(F.col("path"), FV.TOPIC_SERVERS)).withColumn("v", F.try_parse_json("content")).where("v IS NOT NULL")
    named = F.coalesce(F.try_variant_get("v", "$.mcpServers", "map<string,variant>"), F.try_variant_get("v", "$.servers", "map<string,variant>"))
    return parsed, parsed.select(*_KEYS, F.explode(named).alias("name", "server"))


def _has(server: str, field: str) -> Column:
    value = F.try_variant_get(server, f"$.{field}", "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def _wildcard(v: str, endings: bool) -> Column:
    """Whether ``allowedTools`` allows everything."""
    listed = F.try_variant_get(v, "$.allowedTools", "array<string>")
    hit = F.exists(listed, lambda t: t.isin("*", "**") | (t.endswith(":*") if endings else F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def findings(files: DataFrame) -> DataFrame:
    """``repo``, ``rule_id`` (the topic), ``severity``, ``message``, ``file``, ``line`` and ``points``; none for repositories without agent configuration."""
    text, path = F.col("text"), F.col("path")
    own = files.where(under(path, FV.TOPIC_CONFIGS))
    numbered = lines.lines_of(own, _KEYS)
    numbered = lines.with_context(numbered, _KEYS, _says(text, FV.SANITIZE_WORDS), 5, "sanitized")
    numbered = lines.with_context(numbered, _KEYS, _says(text, FV.AGENT_AUTH) | _says(text, FV.AGENT_ENCRYPTION), 3, "guarded")
    content = F.col("content")
    multi = _says(content, FV.MULTI_AGENT)
    says = {
        "aware": _says(content, FV.INJECTION_WORDS), "least": _says(content, FV.LEAST_PRIVILEGE), "sandboxed": _says(content, FV.SANDBOX_WORDS), "reviewed": _says(content, FV.CODE_APPROVAL),
        "runs": content.rlike(FV.RUN_WORDS), "agents": multi, "signed": multi & _says(content, FV.AGENT_AUTH), "flow": _says(content, FV.WORKFLOW_WORDS), "recovers": _says(content, FV.RECOVERY_WORDS),
        "destroys": content.rlike(r"(?i)\b(?:" + "|".join(FV.DESTRUCTIVE_WORDS) + r")\b"), "asks": _says(content, FV.APPROVAL_WORDS), "watched": _says(content, FV.MONITOR_WORDS),
    }
    settings = files.where("path = '.claude/settings.json'").withColumn("v", F.try_parse_json("content")).where("v IS NOT NULL")
    waved = F.coalesce(F.try_variant_get("v", "$.autoApprove", "boolean"), F.size(F.try_variant_get("v", "$.autoApprove", "array<variant>")) > 0, F.lit(False))
    waives = settings.where(waved).select("repo").distinct()
    by = own.groupBy("repo").agg(*[F.bool_or(F.coalesce(x, F.lit(False))).alias(k) for k, x in says.items()])
    parsed, servers = _servers(files)

    approve = numbered.where(text.rlike(FV.AUTO_APPROVE) & ~text.rlike(FV.AUTO_APPROVE_OFF))
    limited = _has("server", "permissions") | _has("server", "allowedPaths") | _has("server", "restrictions")
    args = F.coalesce(F.try_variant_get("server", "$.args", "array<string>"), F.array().cast("array<string>"))
    words = "|".join(FV.SHELL_WORDS)
    shell = F.lower("name").rlike(words) | F.exists(args, lambda a: a.rlike(words))
    url, command, first = F.try_variant_get("server", "$.url", "string"), F.try_variant_get("server", "$.command", "string"), F.get(args, F.lit(0))
    unpinned = (command.rlike(FV.NPX_COMMAND) | (command == "npx")) & F.try_variant_get("server", "$.version", "string").isNull() & ~first.contains("@") & ~first.startswith("-")
    star = F.coalesce(F.contains(F.try_variant_get("v", "$.allowedTools", "string"), F.lit("*")), F.lit(False)) & F.try_variant_get("v", "$.allowedTools", "array<string>").isNull()
    env_file = F.contains(F.lower("content"), F.lit(".env")) & content.rlike(FV.ENV_READ) & ~path.endswith(".env") & ~path.contains(".env.")
    in_ci = F.lit(False)
    for lead in FV.CI_PATHS:
        in_ci = in_ci | path.startswith(lead)
    credential = F.explode(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in FV.CREDENTIALS])))
    ignored = files.where("path = '.gitignore'").select("repo", F.col("content").alias("ignores"))
    where = F.lit(None).cast("string")
    for p in FV.MEMORY_PATHS:
        where = F.when((path == p) | path.startswith(p + "/"), F.lit(p)).otherwise(where)
    kept = files.select("repo", where.alias("path")).where("path IS NOT NULL").distinct().join(ignored, "repo", "left")
    exposed = kept.where(~F.coalesce(F.contains("ignores", "path") | F.contains("ignores", F.substring_index("path", "/", 1)), F.lit(False)))
    spoken = lines.first_per(numbered.where(_says(text, FV.MULTI_AGENT) & ~F.col("guarded")), _KEYS, ["line_no"])
    npm = lines.first_per(numbered.where(text.rlike(FV.NPM_INSTALL) & ~text.rlike(FV.NPM_TRUSTED)), _KEYS, ["line_no"])
    whole = lambda cond, topic, severity, message, points: _found(by.where(cond), topic, severity, message, points, None)
    parts = [
        _found(numbered.where(text.rlike(FV.FETCH) & ~F.col("sanitized")), "ASI01", "warning", "Fetched content without guidance to sanitize it", 0, line="line_no"),
        whole("NOT aware", "ASI01", "warning", "Nothing is said about untrusted input or prompt injection", 15),
        _found(servers.where(shell & ~limited), "ASI02", "error", F.concat(F.lit("A shell tool without restrictions: "), F.col("name")), 10),
        _found(servers.where(~shell & ~limited & ~_has("server", "env")), "ASI02", "warning", F.concat(F.lit("A tool without restrictions: "), F.col("name")), 10),
        _found(parsed.where(star | _wildcard("v", False)), "ASI02", "warning", "allowedTools allows everything", 10),
        _found(settings.where(_wildcard("v", True)).join(own.select("repo").distinct(), "repo", "left_semi"), "ASI02", "warning", "allowedTools of the settings allows everything", 10),
        _found(lines.first_per(own.where(env_file), ["repo"], ["path"]), "ASI03", "warning", "An environment file is read", 15),
        _found(numbered.select("*", credential.alias("label")), "ASI03", "error", F.concat(F.lit("Perhaps a credential: "), F.col("label")), 15, line="line_no"),
        _found(numbered.where(~in_ci & text.rlike(FV.ROOT_RIGHTS)), "ASI03", "warning", "Root rights are granted", 15, line="line_no"),
        whole("NOT least", "ASI03", "info", "Nothing is said about least privilege", 0),
        _found(servers.where(url.isNotNull() & ~url.rlike(FV.LOCAL_ADDRESS)), "ASI04", "warning", F.concat(F.lit("An external tool server: "), F.col("name")), 10),
        _found(servers.where(F.coalesce(unpinned, F.lit(False))), "ASI04", "warning", F.concat(F.lit("An unpinned package: "), F.col("name")), 10),
        _found(npm, "ASI04", "info", "An npm package without a version", 10, line="line_no"),
        _found(approve, "ASI05", "warning", "Code may run without review", 10, line="line_no"),
        _found(numbered.where(text.rlike(FV.FREE_RUN) & ~_says(text, FV.SANDBOX_WORDS)), "ASI05", "info", "Code may be run", 0, line="line_no"),
        whole("runs AND NOT sandboxed AND NOT reviewed", "ASI05", "warning", "Code runs without a sandbox or an approval", 10),
        _found(exposed, "ASI06", "warning", F.concat(F.lit("Agent memory is not ignored by version control: "), path), 8),
        _found(files.where(path.isin(FV.RAG_CONFIGS) & content.rlike(FV.RAG_WORDS) & ~content.rlike(FV.RAG_FILTER)), "ASI06", "warning", "Retrieval without a filter of what comes in", 8),
        _found(spoken, "ASI07", "warning", "Agents talk to each other without authentication", 8, line="line_no"),
        _found(by.where("agents AND NOT signed").join(spoken.select("repo").distinct(), "repo", "left_anti"), "ASI07", "warning", "Several agents and no authentication", 8, None),
        whole("flow AND NOT recovers", "ASI08", "warning", "Steps without a way back", 5),
        _found(waives.join(own.select("repo").distinct(), "repo", "left_semi"), "ASI09", "warning", "Approval is waived in the settings", 10, None),
        _found(by.where("destroys AND NOT asks").join(waives, "repo", "left_anti"), "ASI09", "warning", "Destructive steps without an approval", 10, None),
        _found(by.where("NOT destroys AND NOT asks").join(waives, "repo", "left_anti"), "ASI09", "info", "No approvals are mentioned", 0, None),
        whole("NOT watched", "ASI10", "info", "Nothing watches the agent", 5),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(own.select("repo").distinct(), "repo", "left_semi")


def deductions(found: DataFrame) -> DataFrame:
    """Points of each repository, after the caps."""
    cap = F.lit(None).cast("long")
    for topic, most in CAPS.items():
        cap = F.when(F.col("rule_id") == topic, F.lit(most)).otherwise(cap)
    each = found.groupBy("repo", "rule_id").agg(F.sum("points").alias("p")).withColumn("p", F.least("p", cap))
    return each.groupBy("repo").agg(F.sum("p").alias("points"))


def issues(found: DataFrame) -> DataFrame:
    return found.select("repo", F.lit("owasp").alias("check_name"), "rule_id", "severity", "message", "file", "line")
