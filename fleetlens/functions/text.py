"""Scalar expressions: slugs, suffixes, versions, permalinks, rounding and the lines of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K8S_SUFFIXES, MACHINE_SUFFIXES = ("-k8s-operator", "-k8s"), ("-operator",)  # fixed values
ARCH_ORDER = ("reactive", "legacy-classic", "component-graph", "reconcile-all", "reconcile", "unconditional-init", "part-reconcile", "delta")  # fixed values


def strip_all(c: Column) -> Column:
    """All white space at both ends, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slug(url: Column) -> Column:
    """Last segment of a repository URL without trailing slashes and then without .git."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"\.git$", "")


def name_from_url(url: Column) -> Column:
    """The fallback for a missing name: .git goes before the segment is taken."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "/"), -1)


def strip_suffix(c: Column, *suffixes: str) -> Column:
    """Without the first suffix that matches, if anything remains."""
    out = c
    for s in reversed(suffixes):
        out = F.when(c.endswith(s) & (F.length(c) > len(s)), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(out)
    return out


def k8s_root(name: Column) -> Column:
    return strip_suffix(strip_suffix(name, *K8S_SUFFIXES), *MACHINE_SUFFIXES)


def machine_root(name: Column) -> Column:
    return strip_suffix(name, *MACHINE_SUFFIXES)


def library_root(name: Column) -> Column:
    return k8s_root(F.replace(name, F.lit("_"), F.lit("-")))


def event_attribute(name: Column) -> Column:
    """Class name of an event to its attribute: without Event, an underscore before each inner capital, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "Event$", ""), "(?<!^)(?=[A-Z])", "_"))


def version_key(v: Column) -> Column:
    """Dotted numbers compare as arrays of integers: 3.10 comes after 3.9."""
    return F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))


def round1(x: Column) -> Column:
    """One decimal, half to even on the exact binary value."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit("")).cast("double")


def floor_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(F.lit(100) * part / whole))


def primary_architecture(arch: Column, reactive: Column, legacy: Column) -> Column:
    """The first label that holds, by the fixed order."""
    tests = [F.when(reactive, "reactive"), F.when(legacy, "legacy-classic")]
    tests += [F.when(F.array_contains(arch, a), a) for a in ARCH_ORDER[2:-1]]
    return F.coalesce(*tests, F.lit(ARCH_ORDER[-1]))


def permalink(url: Column, ref: Column, subpath: Column, file: Column, line: Column) -> Column:
    """The place of a piece of evidence in a hosted repository; without a file, the repository itself."""
    base = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    path = F.when(F.coalesce(subpath, F.lit("")) != "", F.concat(subpath, F.lit("/"), file)).otherwise(file)
    at = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise(F.lit(""))
    return F.when(F.coalesce(file, F.lit("")) == "", url).otherwise(F.concat(base, F.lit("/blob/"), F.coalesce(ref, F.lit("HEAD")), F.lit("/"), path, at))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-")


def glob_pattern(glob: str) -> str:
    """A Java pattern of whole paths: ``*``, ``?`` and ``[...]`` stay within a part of the path, ``**`` is any number of parts."""
    parts = glob.split("/")
    out = []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        at = 0
        while at < len(part):
            c, end = part[at], part.find("]", at + 2)
            if c == "[" and end > 0:
                inner = part[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append(f"[^/{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
                at = end
            else:
                out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() else f"\\{c}" if c.isascii() else c))
            at += 1
        out.append("" if last else "/")
    return f"^(?s:{''.join(out)})$"


MARK, OTHER_MARK = "\ue000", "\ue001"


def match_lines(text: str, pattern: str | Column) -> Column:
    """``array<struct<match, line>>`` of all matches of a Java pattern that matches no empty text, lines from 1.

    One mark goes before each match and the text is split into lines: a line's marks are its matches, so the work is linear
    in text and matches. The mark is a private character; where the text holds it already, another stands for it.
    """
    t, p = F.col(text), F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(F.translate(t, MARK, OTHER_MARK), p, F.lit(f"{MARK}$0"))
    marks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))
    lines = F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(i + 1, marks(line))))
    found = F.regexp_extract_all(t, p, F.lit(0))
    return F.coalesce(F.arrays_zip(found.alias("match"), lines.alias("line")).cast("array<struct<match:string,line:int>>"), F.array().cast("array<struct<match:string,line:int>>"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")
