"""Tables of what source files say. Each content is parsed once by a worker; all detectors are queries on these tables.

``python_facts``: kind is import, from, call, self_call or observe; ``ord`` numbers statements and calls breadth first.
``yaml_docs``: a document as JSON, with its keys at any depth, own keys before those of children, and how many documents,
empty ones too, its file holds.
``settings``: sections of test configuration. Files that don't parse, and null texts, give no rows.

Results belong to a content, not to a place: its number is a hash of the parser, that parser's version, what of the path matters to it,
and the text. Files with the same content, of one repository or many, share one row, and with a ``known`` table (of
``sources.committed``) a later scan parses only contents that no scan before has met.
"""

from __future__ import annotations

import ast
import configparser
import json
import tomllib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import glob_pattern
from fleetlens.plans.staging import shared_folder, staged
from fleetlens.sources import committed

PYTHON = "ord int, kind string, line int, module string, names array<string>, chain array<string>, cls int, method string, is_async boolean, event string, handler string, snippet string"
YAML = "doc int, json string, keys array<string>, docs int"
SETTINGS = "section string, key string, value string"
#: Sections of test configuration by file name; fixed values.
SECTIONS = {"pytest.ini": "pytest", "setup.cfg": "tool:pytest", "tox.ini": "pytest"}


class Parser(NamedTuple):
    """``of``: what of the path it gets; ``version`` changes with what it gives for the same text."""

    name: str
    version: int
    wanted: Callable[[], Column]
    of: Callable[[], Column]
    rows: Callable[[str, str], Iterator[tuple]]
    ddl: str


#: Bytes of text, and files, for a task of its own.
TASK_BYTES, TASK_FILES = 1 << 20, 200


def content(parser: Parser) -> Column:
    """The number of a file's content; null for files that the parser doesn't read."""
    return F.when(parser.wanted() & F.col("text").isNotNull(), F.sha2(F.concat_ws("\0", F.lit(f"{parser.name}:{parser.version}"), parser.of(), F.col("text")), 256))


def _parsed(rows: DataFrame, parser: Parser) -> DataFrame:
    """``id, found`` of contents (id, at, text): a row for each, also if nothing is found."""
    names = [f.split()[0] for f in parser.ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[dict(zip(names, row, strict=True)) for row in parser.rows(at, text)] for at, text in zip(batch["at"], batch["text"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "found": found})

    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    tasks = max(1, (size["bytes"] or 0) // TASK_BYTES, min(rows.sparkSession.sparkContext.defaultParallelism, size["n"] // TASK_FILES))
    return rows.repartition(tasks, "id").mapInPandas(run, f"id string, found array<struct<{', '.join(f'{n}: {k}' for n, k in (f.split() for f in parser.ddl.split(', ')))}>>")


def facts_of(files: DataFrame, parser: Parser, known: str | None = None) -> tuple[DataFrame, int]:
    """The parser's rows for these files (slug, path, text), and how many contents were parsed for that.

    ``known``: a folder of committed tables, one for each parser; without it all contents are new.
    """
    spark = files.sparkSession
    own = files.withColumn("id", content(parser)).where("id is not null")
    schema = f"id string, found array<struct<{', '.join(f'{n}: {k}' for n, k in (f.split() for f in parser.ddl.split(', ')))}>>"
    path = f"{known}/{parser.name}" if known else shared_folder(spark, parser.name)
    before = committed.read(spark, path, schema) if known else None
    fresh = own
    if before is not None and not before.isEmpty():
        # ids alone are compared; where few are new, no text is shuffled
        ids = staged(own.select("id").distinct().join(before.select("id"), "id", "left_anti"))
        n = ids.count()
        fresh = own.join(ids, "id", "left_semi") if n else None
    if fresh is not None:
        new = staged(fresh.select("id", parser.of().alias("at"), "text").dropDuplicates(["id"]))
        n = new.count()
        if n:
            committed.append(_parsed(new, parser), path)
    found = committed.read(spark, path, schema)
    if known:  # of other scans too, and two at once may both have parsed a content
        found = found.join(own.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    out = own.select("slug", "path", "id").join(found.where(F.size("found") > 0), "id").select("slug", "path", F.inline("found"))
    return out, n


def _chain(node: ast.AST) -> list[str] | None:
    """Dotted names from a plain name on, without leading underscores."""
    out: list[str] = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr.lstrip("_"))
        node = node.value
    return [node.id.lstrip("_"), *reversed(out)] if isinstance(node, ast.Name) else None


def _of_python(_path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = text.split("\n")
    row = lambda at, kind, node, module=None, names=None, chain=None, cls=None, method=None, is_async=None, event=None, handler=None: (at, kind, node.lineno, module, names, chain, cls, method, is_async, event, handler, lines[node.lineno - 1].strip()[:120])
    classes = 0
    for at, node in enumerate(ast.walk(tree)):
        match node:
            case ast.Import():
                for alias in node.names:
                    yield row(at, "import", node, alias.name)
            case ast.ImportFrom() if node.module:
                yield row(at, "from", node, node.module, [a.name for a in node.names])
            case ast.Call():
                if chain := _chain(node.func):
                    yield row(at, "call", node, chain=chain)
                if isinstance(node.func, ast.Attribute) and node.func.attr == "observe" and len(node.args) >= 2 and all(isinstance(a, ast.Attribute) for a in node.args[:2]):
                    yield row(at, "observe", node, event=node.args[0].attr, handler=node.args[1].attr)
            case ast.ClassDef():
                for method in node.body:
                    if isinstance(method, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        for k, call in enumerate(ast.walk(method)):
                            if isinstance(call, ast.Call) and isinstance(f := call.func, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self":
                                yield row(k, "self_call", call, chain=[f.attr], cls=classes, method=method.name, is_async=isinstance(method, ast.AsyncFunctionDef))
                classes += 1


PYTHON_PARSER = Parser("python", 1, lambda: F.lit(True), lambda: F.lit(""), _of_python, PYTHON)


def python_facts(files: DataFrame) -> DataFrame:
    """Of files that are all taken for Python."""
    return facts_of(files, PYTHON_PARSER)[0]


def _keys(doc: Any) -> Iterator[str]:
    if isinstance(doc, dict):
        yield from map(str, doc)
        for v in doc.values():
            yield from _keys(v)
    elif isinstance(doc, list):
        for v in doc:
            yield from _keys(v)


def _of_yaml(_path: str, text: str) -> Iterator[tuple]:
    import yaml

    try:
        every = list(yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))
        made = [(i, json.dumps(d, default=str), list(_keys(d)), len(every)) for i, d in enumerate(d for d in every if d)]
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return  # an error anywhere discards the whole file
    yield from made


def yaml_parser(globs: Iterable[str] = ()) -> Parser:
    """Of files with the two usual endings, and of those that a glob names."""
    named = "|".join([r"\.ya?ml$", *map(glob_pattern, sorted(set(globs)))])
    return Parser("yaml", 1, lambda: F.col("path").rlike(named), lambda: F.lit(""), _of_yaml, YAML)


def yaml_docs(files: DataFrame) -> DataFrame:
    return facts_of(files, yaml_parser())[0]


def _of_settings(path: str, text: str) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "pyproject.toml":
            section, found = "tool.pytest.ini_options", tomllib.loads(text).get("tool", {}).get("pytest", {}).get("ini_options", {})
        else:
            parser = configparser.ConfigParser(interpolation=None)
            parser.read_string(text)
            section = SECTIONS[name]
            found = dict(parser[section]) if parser.has_section(section) else {}
    except (tomllib.TOMLDecodeError, configparser.Error, AttributeError):
        return
    for k, v in found.items():
        yield section, k, str(v)


SETTINGS_PARSER = Parser("settings", 1, lambda: F.col("path").isin("pyproject.toml", *SECTIONS), lambda: F.col("path"), _of_settings, SETTINGS)


def settings(files: DataFrame) -> DataFrame:
    """Of the files at the top of a unit; values aren't interpolated."""
    return facts_of(files, SETTINGS_PARSER)[0]
