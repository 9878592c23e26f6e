"""Coding-agent session logs: entries, tool calls, roll-ups, conflicts, iterations, cost, receipts, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import LOOP_PRICES, OTHER_PRICE, SUBSCRIPTION_PRICES

#: What a tool does, by lower-case name.
TOOL_ACTIONS = {
    "write": "write", "write_to_file": "write", "edit": "write", "edit_file": "write", "multiedit": "write", "notebookedit": "write", "str_replace": "write", "create": "write",
    "read": "read", "read_file": "read", "view": "read", "glob": "search", "grep": "search", "bash": "shell", "shell": "shell", "execute_command": "shell", "webfetch": "fetch", "websearch": "fetch",
}


def entries(raw: DataFrame) -> DataFrame:
    """``raw(session, seq, value)`` parsed: malformed and blank lines go, ``seq`` keeps the order of lines."""
    v = raw.withColumn("v", F.try_parse_json(F.trim("value"))).where("v IS NOT NULL")
    text = lambda p: F.try_variant_get("v", p, "string")
    number = lambda p: F.coalesce(F.try_variant_get("v", f"$.usage.{p}", "long"), F.try_variant_get("v", f"$.message.usage.{p}", "long"), F.lit(0))
    return v.select(
        "session", "seq", "v",
        F.coalesce(text("$.timestamp"), text("$.ts")).alias("ts_text"),
        F.try_to_timestamp(F.coalesce(text("$.timestamp"), text("$.ts"))).alias("ts"),
        F.coalesce(text("$.role"), text("$.message.role")).alias("role"),
        F.coalesce(text("$.type"), text("$.meta.type")).alias("type"),
        F.coalesce(text("$.model"), text("$.message.model")).alias("model"),
        number("input_tokens").alias("in_tokens"), number("output_tokens").alias("out_tokens"),
        number("cache_read_input_tokens").alias("cache_read"), number("cache_creation_input_tokens").alias("cache_new"),
        F.coalesce(text("$.content"), text("$.message.content")).alias("text"),
    )


def blocks(parsed: DataFrame) -> DataFrame:
    """Content blocks of both envelope styles, numbered in order: ``kind``, ``name``, ``block`` (variant)."""
    def array(path: str) -> Column:
        return F.coalesce(F.try_variant_get("v", path, "array<variant>"), F.array().cast("array<variant>"))

    spread = parsed.select("session", "seq", "ts", "ts_text", F.posexplode(F.concat(array("$.content"), array("$.message.content"))).alias("block_no", "block"))
    get = lambda p: F.try_variant_get("block", p, "string")
    return spread.select("*", get("$.type").alias("kind"), get("$.name").alias("name"), get("$.text").alias("block_text"))


def tool_calls(parsed: DataFrame) -> DataFrame:
    """Tool uses with what they act on."""
    get = lambda p: F.try_variant_get("block", p, "string")
    action = F.lit("other")
    for tool, what in TOOL_ACTIONS.items():
        action = F.when(F.lower("name") == tool, F.lit(what)).otherwise(action)
    return blocks(parsed).where("kind = 'tool_use'").select(
        "session", "seq", "block_no", "ts", "ts_text", F.col("name").alias("tool"), action.alias("action"),
        F.coalesce(get("$.input.file_path"), get("$.input.path"), get("$.input.notebook_path")).alias("file_path"),
        get("$.input.command").alias("command"), get("$.input.url").alias("url"),
    )


def rollup(calls: DataFrame, *, session: str = "session", order: str = "seq", when: str = "ts") -> DataFrame:
    """Each session's first and last time in the order of entries, files written and read, calls, and status.

    SILENT_FAIL: over three calls and nothing written.
    """
    files = lambda a: F.count_distinct(F.when(F.col("action") == a, F.col("file_path")))
    out = calls.groupBy(session).agg(
        F.min_by(when, order).alias("started"), F.max_by(when, order).alias("ended"), files("write").alias("files_written"), files("read").alias("files_read"), F.count("*").alias("calls")
    )
    return out.withColumn("status", F.when((F.col("calls") > 3) & (F.col("files_written") == 0), "SILENT_FAIL").otherwise("OK"))


def conflicts(calls: DataFrame, *, session: str = "session") -> DataFrame:
    """Files that several sessions write, with the number of sessions."""
    return calls.where("action = 'write'").groupBy("file_path").agg(F.count_distinct(session).alias("n_sessions")).where("n_sessions >= 2")


def with_conflicts(rolled: DataFrame, calls: DataFrame, *, session: str = "session") -> DataFrame:
    """The roll-up with status CONFLICT where a session wrote a contested file and did not fail."""
    hit = calls.where("action = 'write'").join(conflicts(calls, session=session), "file_path", "left_semi").select(session).distinct().withColumn("_hit", F.lit(True))
    status = F.when((F.col("_hit")) & (F.col("status") != "SILENT_FAIL"), "CONFLICT").otherwise(F.col("status"))
    return rolled.join(hit, session, "left").withColumn("status", status).drop("_hit")


def with_iteration(events: DataFrame, test: Column, *, session: str = "session", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The iteration each event is in: as many as there are test runs; what comes before the first is in it."""
    upto = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("iter_no", F.greatest(F.lit(1), F.sum(test.cast("int")).over(upto)).cast("long"))


def price(model: Column, part: int, prices: Sequence[tuple] = SUBSCRIPTION_PRICES, other: tuple = OTHER_PRICE) -> Column:
    """Price of a model's input (0) or output (1) tokens: exact name, else the first prefix, else ``other``."""
    out = F.lit(other[part])
    for row in reversed(prices):
        out = F.when(model.startswith(row[0]), F.lit(row[part + 1])).otherwise(out)
    for row in prices:
        out = F.when(model == row[0], F.lit(row[part + 1])).otherwise(out)
    return out


def loop_cost(model: Column, in_tokens: Column, out_tokens: Column) -> Column:
    """Cost of an iteration: the first name in order that the model's holds."""
    parts = []
    for part in (0, 1):
        out = F.lit(OTHER_PRICE[part])
        for row in reversed(LOOP_PRICES):
            out = F.when(F.contains(model, F.lit(row[0])), F.lit(row[part + 1])).otherwise(out)
        parts.append(out)
    return (in_tokens * parts[0] + out_tokens * parts[1]) / 1e6


def cost(usage: DataFrame, *, model: str = "model") -> DataFrame:
    """Tokens and cost by model, with a row of totals (model null)."""
    money = (F.col("in_tokens") * price(F.col(model), 0) + F.col("out_tokens") * price(F.col(model), 1)) / 1e6
    used = usage.where("in_tokens + out_tokens > 0").withColumn("cost", money)
    return used.rollup(model).agg(F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.sum("cost").alias("cost"))


def subsidy(costs: DataFrame, plan: float) -> DataFrame:
    """What a plan price leaves unpaid of the total, and its share in percent."""
    left = F.greatest(F.lit(0.0), F.col("cost") - plan)
    return costs.where("model IS NULL").select("cost", left.alias("subsidised"), F.when(F.col("cost") > 0, 100 * left / F.col("cost")).otherwise(0.0).alias("rate"))


def receipt(calls: DataFrame) -> DataFrame:
    """One row for each session: sorted distinct files, commands, addresses, packages, and a digest."""
    pack = F.regexp_extract("command", r"^\s*(?:npm (?:install|i)|yarn add|pnpm add|pip install)\s+([^;&|]+)", 1)
    named = F.filter(F.split(pack, r"\s+"), lambda x: (x != "") & ~x.startswith("-"))
    gone = F.regexp_extract("command", r"^\s*(?:rm|trash)\s+(?:-\S+\s+)*(\S+)", 1)
    made = F.regexp_extract("command", r"^\s*(?:touch|mkdir)\s+(?:-\S+\s+)*(\S+)", 1)
    use = calls.withColumns({"pack": named, "gone": gone, "made": made, "tool": F.lower("tool")})
    some = lambda c: F.array_sort(F.collect_set(c))
    out = use.groupBy("session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set(F.when(F.col("tool").isin("write", "create"), F.col("file_path"))), F.filter(F.collect_set("made"), lambda x: x != "")))).alias("created"),
        some(F.when(F.col("tool").isin("edit", "multiedit", "str_replace"), F.col("file_path"))).alias("_edited"),
        F.filter(some("gone"), lambda x: x != "").alias("deleted"), some("command").alias("commands"), some("url").alias("urls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pack")))).alias("packages"),
    )
    out = out.withColumn("modified", F.array_except("_edited", "created")).drop("_edited")
    lists = ["created", "modified", "deleted", "commands", "urls", "packages"]
    body = F.concat_ws("\n", "session", *[F.array_join(c, ",") for c in lists])
    seconds = F.coalesce(F.unix_timestamp("ended") - F.unix_timestamp("started"), F.lit(0))
    return out.withColumns({"duration_seconds": seconds, "sha256": F.sha2(body, 256)})


def compaction_events(messages: DataFrame, explicit: Column, long_system: Column, exchange: Column, *, session: str = "session", order: str = "seq") -> DataFrame:
    """Which messages compact the context (``event``), and the segment each message is in.

    A long system text counts if an exchange stands between it and the candidate before it.
    """
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col(order))).over(before), F.lit(-1))
    event = explicit | (long_system & (last(exchange) > last(explicit | long_system)))
    out = messages.withColumn("event", F.coalesce(event, F.lit(False)))
    return out.withColumn("segment", F.coalesce(F.sum(F.col("event").cast("int")).over(before), F.lit(0)).cast("long"))


def dropped_terms(segments: DataFrame, summaries: DataFrame, term: str, *, keys: Sequence[str]) -> DataFrame:
    """Terms of a segment that the summary after it does not contain (``summary`` by keys)."""
    terms = segments.select(*keys, term).distinct()
    return terms.join(summaries, list(keys)).where(~F.contains(F.lower("summary"), F.lower(term))).select(*keys, term)
