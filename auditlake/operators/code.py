"""Code metrics: Halstead measures, maintainability, indentation, and functions found by a table function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def halstead(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Halstead measures from a row for each token: ``token`` and whether it is an ``operand``."""
    kinds = tokens.groupBy(*keys, "token", "operand").agg(F.count("*").alias("n"))
    out = kinds.groupBy(*keys).agg(
        F.sum("n").alias("length"), F.count("*").alias("vocabulary"),
        F.coalesce(F.sum(F.when(F.col("operand"), F.col("n"))), F.lit(0)).alias("n_operands"),
        F.count_if(F.col("operand")).alias("u_operands"), F.count_if(~F.col("operand")).alias("u_operators"),
    )
    volume = F.col("length") * F.log2("vocabulary")
    difficulty = F.when(F.col("u_operands") > 0, F.col("u_operators") / 2.0 * F.col("n_operands") / F.col("u_operands")).otherwise(0.0)
    return out.withColumns({"volume": volume, "difficulty": difficulty, "effort": volume * difficulty})


def maintainability(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln SLOC, within 0 to 100; 100 for an empty file."""
    index = 171 - 5.2 * F.ln(volume) - 0.23 * cyclomatic - 16.2 * F.ln(sloc)
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))


def code_tokens(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens of source text: names, numbers and strings are operands, key words and signs operators."""
    words = "if|else|for|while|do|switch|case|default|break|continue|return|function|class|new|delete|typeof|instanceof|in|of|try|catch|finally|throw|var|let|const|import|export|from|await|async|yield"
    plain = F.regexp_replace(F.regexp_replace("content", r"/\*[\s\S]*?\*/", " "), r"//[^\n]*", " ")
    form = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|=>|[=!]==?|&&|\|\||\?\?|\+\+|--|[-+*/%<>=!&|^~?:.;,(){}\[\]]"
    spread = files.select(*keys, F.explode(F.regexp_extract_all(plain, F.lit(form), F.lit(0))).alias("token"))
    return spread.withColumn("operand", F.col("token").rlike(r"^[\w$\"'`]") & ~F.col("token").rlike(rf"^({words})\z"))


def file_metrics(files: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Halstead measures, lines of code, branches and maintainability of each file."""
    lines = F.split("content", "\n")
    branches = F.regexp_count("content", F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?[^.:?]"))
    base = files.select(*keys, F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("sloc"), (branches + 1).cast("long").alias("cyclomatic"))
    out = base.join(halstead(code_tokens(files, keys), keys), list(keys), "left")
    return out.withColumn("maintainability", maintainability(F.coalesce("volume", F.lit(0.0)), F.col("cyclomatic"), F.col("sloc")))


def indentation(files: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Mean depth of lines with text: tabs, else half the leading blanks."""
    depth = lambda x: F.when(x.startswith("\t"), F.length(F.regexp_extract(x, r"^\t+", 0))).otherwise(F.floor(F.length(F.regexp_extract(x, "^ *", 0)) / 2))
    return files.select(*keys, F.explode(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")).alias("x")).groupBy(*keys).agg(F.avg(depth(F.col("x"))).alias("complexity"))
