"""Table functions for what needs to follow brackets: functions, test bodies, catch blocks, unguarded awaits."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_HEAD = re.compile(
    r"(?:^|\n)[ \t]*(?:export\s+)?(?:default\s+)?(?:(?P<async>async)\s+)?(?:function\s*\*?\s*(?P<f>[\w$]+)\s*(?:<[^>{}]*>)?\s*\((?P<fp>[^)]*)\)|"
    r"(?:const|let|var)\s+(?P<a>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<aasync>async\s+)?\((?P<ap>[^)]*)\)\s*(?::\s*(?P<ar>[^={\n]+))?=>)(?:\s*:\s*(?P<fr>[^{\n]+))?\s*\{"
)
_TEST = re.compile(r"\b(?:it|test)(?:\.only)?\s*\(\s*([\"'`])(?P<name>(?:\\.|(?!\1).)*)\1\s*,\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?:=>)?\s*\{")
_CATCH = re.compile(r"\bcatch\s*(?:\(\s*(?P<v>\w*)[^)]*\))?\s*\{")


def matching(text: str, at: int) -> int:
    """Place after the bracket that closes the ``{`` at ``at``; strings and comments are passed over.  -1 if none does."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\n" and c != "`":
                    break
                j += 2 if text[j] == "\\" else 1
            i = j
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                return -1
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 1
            if i <= 0:
                return -1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def find_functions(text: str) -> Iterator[tuple]:
    """Name, first and last line, parameters, whether all are typed and a result type is given, body, cyclomatic, nesting, cognitive."""
    for m in _HEAD.finditer(text or ""):
        end = matching(text, m.end() - 1)
        if end < 0:
            continue
        body = text[m.end() - 1 : end]
        params = [p for p in re.split(r",(?![^<({]*[>)}])", m["fp"] if m["f"] else m["ap"]) if p.strip()]
        typed = all(":" in p for p in params)
        line = text.count("\n", 0, m.start() + 1 if text[m.start()] == "\n" else m.start()) + 1
        cyclomatic = 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", body))
        depth = deepest = cognitive = 0
        opened: list[bool] = []
        for t in re.finditer(r"\b(if|for|while|switch|catch|else)\b[^{};]*(?=\{)|[{}]", body[1:-1]):
            if t[0] == "{":
                opened.append(False)
            elif t[0] == "}":
                if opened and opened.pop():
                    depth -= 1
            else:
                cognitive += 1 + depth
                depth += 1
                deepest = max(deepest, depth)
                opened.append(True)
        yield (m["f"] or m["a"], line, line + text.count("\n", m.start() + 1, end), len(params), typed, bool(m["fr"] or m["ar"]), bool(m["async"] or m["aasync"]), body, cyclomatic, deepest, cognitive)


@udtf(returnType="name string, line int, end_line int, n_params int, params_typed boolean, has_return_type boolean, is_async boolean, body string, cyclomatic int, nesting int, cognitive int")
class Functions:
    def eval(self, content: str) -> Iterator[tuple]:
        yield from find_functions(content)


@udtf(returnType="name string, line int, body string, n_asserts int, n_mock_asserts int")
class TestBlocks:
    def eval(self, content: str) -> Iterator[tuple]:
        for m in _TEST.finditer(content or ""):
            end = matching(content, m.end() - 1)
            if end > 0:
                body = content[m.end() : end - 1]
                mocks = len(re.findall(r"expect\(\s*\w*[mM]ock\w*|\.toHaveBeenCalled", body))
                yield m["name"], content.count("\n", 0, m.start()) + 1, body, len(re.findall(r"\b(?:expect|assert\w*)\s*[.(]|\.should\b", body)), mocks


@udtf(returnType="line int, is_empty boolean, only_comment boolean, only_log boolean, rethrows boolean")
class CatchBlocks:
    def eval(self, content: str) -> Iterator[tuple]:
        for m in _CATCH.finditer(content or ""):
            end = matching(content, m.end() - 1)
            if end > 0:
                body = content[m.end() : end - 1]
                bare = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", body).strip()
                yield (
                    content.count("\n", 0, m.start()) + 1, not body.strip(), bool(body.strip()) and not bare,
                    bool(re.fullmatch(r"(?:console\.\w+\([^;]*\);?\s*)+", bare)), "throw" in bare,
                )


@udtf(returnType="line int, function string")
class OpenAwaits:
    """Awaits in async functions that no ``try`` of the function encloses."""

    def eval(self, content: str) -> Iterator[tuple]:
        for name, line, _, _, _, _, is_async, body, *_ in find_functions(content):
            if not is_async or ".catch(" in body:
                continue
            guarded = [(m.start(), matching(body, m.end() - 1)) for m in re.finditer(r"\btry\s*\{", body)]
            for m in re.finditer(r"\bawait\b", body):
                if not any(a <= m.start() < e for a, e in guarded):
                    yield line + body.count("\n", 0, m.start()), name


def register(spark: SparkSession) -> None:
    """For use in SQL: functions, test_blocks, catch_blocks, open_awaits."""
    for name, f in (("code_functions", Functions), ("test_blocks", TestBlocks), ("catch_blocks", CatchBlocks), ("open_awaits", OpenAwaits)):
        spark.udtf.register(name, f)


def extract(files: DataFrame, function: type, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """What a table function finds in each file's content, beside the keys."""
    return files.alias("f").lateralJoin(function(F.col("f.content").outer()).alias("x")).select(*[f"f.{k}" for k in keys], "x.*")
