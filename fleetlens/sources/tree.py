"""Source trees as a table of files, and the units in them.

Spark's own file sources hide names that begin with a dot or an underscore and empty files, so trees are walked by the
workers, a task for some trees; the roots must lie in a folder that all workers see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders in which no unit begins, and those whose YAML isn't the unit's.
FAN_OUT_SKIP = ("lib", "libs", "tests", "test", "node_modules", ".git", ".tox", ".venv", "venv", "build", "dist", "vendor")
YAML_SKIP = (".git", ".tox", ".venv", "venv", "node_modules", "build", "dist", "vendor")
METADATA = ("charmcraft.yaml", "metadata.yaml")
FILES = "slug string, path string, text string"
#: Files beyond what detectors read are listed without their text.
READ = (".py", ".yaml", ".yml", ".toml", ".ini", ".cfg")


def files(roots: DataFrame, per_batch: int = 200, read_too: tuple[str, ...] = ()) -> DataFrame:
    """``slug, path, text`` of all files below ``root`` of each row (slug, root); path is relative, line ends are \\n.

    ``read_too``: endings of more files whose text is wanted.

    Bytes that aren't UTF-8 are replaced. A null or missing root gives no rows; a file that can't be read has a null text.
    """

    def read(path: str) -> str | None:
        if not path.endswith((*READ, *read_too)):
            return None
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str, str | None]] = []
        for batch in batches:
            for slug, root in zip(batch["slug"], batch["root"], strict=True):
                for folder, below, names in os.walk(root or ""):
                    below[:] = sorted(d for d in below if d != ".git")
                    for name in sorted(names):
                        full = os.path.join(folder, name)
                        held.append((slug, os.path.relpath(full, root), read(full)))
                        if len(held) >= per_batch:
                            yield pd.DataFrame(held, columns=["slug", "path", "text"])
                            held = []
        if held:
            yield pd.DataFrame(held, columns=["slug", "path", "text"])

    return roots.select("slug", "root").mapInPandas(run, FILES)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def folders(path: Column) -> Column:
    """The parts of a path before the file's name."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def vendored(path: Column) -> Column:
    """Whether ``lib`` and ``charms`` are neighbours in the path."""
    return F.concat(F.lit("/"), path, F.lit("/")).contains("/lib/charms/")


def in_scope(path: Column, scope: str) -> Column:
    """Python files of a scope: src, tests or any; membership is over all parts, the name included."""
    p = parts(path)
    has = lambda *names: F.arrays_overlap(p, F.array(*map(F.lit, names)))
    of = {"any": F.lit(True), "src": has("src", "lib") & ~has("tests", "test"), "tests": has("tests", "test")}[scope]
    return path.endswith(".py") & ~vendored(path) & of


def own_path(path: Column) -> Column:
    """A file that is the unit's own: not in build trees, hidden folders or vendored libraries."""
    return ~F.exists(folders(path), lambda d: d.isin(*YAML_SKIP) | d.startswith(".")) & ~vendored(path)


def yaml_in_scope(path: Column) -> Column:
    return path.rlike(r"\.ya?ml$") & own_path(path)


def is_metadata(path: Column) -> Column:
    p = parts(path)
    has = lambda name: F.array_contains(p, name)
    return F.element_at(p, -1).isin(*METADATA) & ~(has("lib") & has("charms")) & ~has("tests") & ~has("test")


def unit_roots(found: DataFrame) -> DataFrame:
    """``slug, subpath``: folders with a metadata file that isn't a bundle's; below such a folder no other begins.

    The shallowest wins, so a unit at the top ('' as subpath) is the only one. ``found``: slug, path, text.
    """
    name, folder = F.element_at(parts(F.col("path")), -1), F.array_join(folders(F.col("path")), "/")
    bundle = (name == METADATA[0]) & F.coalesce(F.col("text").rlike(r"(?m)^type:\s*[\"']?bundle[\"']?\s*(#.*)?$"), F.lit(False))
    skipped = F.exists(folders(F.col("path")), lambda d: d.isin(*FAN_OUT_SKIP) | d.startswith("."))
    roots = found.where(name.isin(*METADATA) & ~bundle & ~skipped).select("slug", folder.alias("subpath")).distinct()
    # a folder's proper ancestors are few; an equi-join on them replaces a comparison of all folders
    up = F.when(F.col("subpath") == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts(F.col("subpath")))), lambda i: F.array_join(F.slice(parts(F.col("subpath")), F.lit(1), i), "/"))))
    below = roots.select("slug", "subpath", F.explode(F.array_remove(up, F.col("subpath"))).alias("above")).join(roots.toDF("slug", "above"), ["slug", "above"], "left_semi")
    return roots.join(below.select("slug", "subpath").distinct(), ["slug", "subpath"], "left_anti")


def unit_files(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The files of each unit, with paths relative to it; the slug of a unit below the top is ``slug/subpath``."""
    p = parts(F.col("path"))
    above = found.withColumn("subpath", F.explode(F.concat(F.array(F.lit("")), F.filter(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i - 1), "/")), lambda x: x != ""))))
    out = above.join(roots, ["slug", "subpath"])
    own = F.when(F.col("subpath") == "", F.col("path")).otherwise(F.expr("substring(path, length(subpath) + 2)"))
    return out.select(F.when(F.col("subpath") == "", F.col("slug")).otherwise(F.concat_ws("/", "slug", "subpath")).alias("slug"), own.alias("path"), "text")
