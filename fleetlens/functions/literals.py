"""What a regular expression can't match without: strings of which one occurs in every match.

Read off the pattern's own text, by caution: where a part may be left out, repeated or chosen, it breaks a run of characters;
a pattern of which nothing is certain has no such strings and has to be tried on every text.
"""

from __future__ import annotations

_LEAST = 2


def _group_end(p: str, at: int) -> int:
    """The place behind the bracket that closes the group or class that begins at ``at``."""
    depth, inside = 0, False
    while at < len(p):
        c = p[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            at += p[at + 1 : at + 2] == "^"
            at += p[at + 1 : at + 2] == "]"  # a bracket that comes first is a member
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if depth == 0 and not inside:
            return at + 1
        at += 1
    return len(p)


def _repeat(p: str, at: int) -> tuple[int, int]:
    """The place behind a quantifier at ``at``, and the fewest times that it asks for."""
    if at < len(p) and p[at] in "?*+":
        end, least = at + 1, int(p[at] == "+")
    elif at < len(p) and p[at] == "{" and (close := p.find("}", at)) > 0:
        first = p[at + 1 : close].split(",")[0]
        end, least = close + 1, int(first) if first.isdigit() else 0
    else:
        return at, 1
    return end + (end < len(p) and p[end] in "?+"), least


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The one whose shortest string is longer."""
    if a is None or b is None:
        return b if a is None else a
    return a if (min(map(len, a)), -len(a)) >= (min(map(len, b)), -len(b)) else b


def _branch(p: str) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run, at = "", 0

    def close() -> None:
        nonlocal run, best
        if len(run) >= _LEAST:
            best = _better(best, frozenset([run]))
        run = ""

    while at < len(p):
        c, char, group = p[at], None, None
        if c == "\\":
            n = p[at + 1 : at + 2]
            end = at + 2
            char = n if n and not n.isalnum() else None
            if n == "b":  # takes no character
                at = end
                continue
            if n.isalnum() and n not in "wWdDsSbBAzZnrt":
                return best  # something that isn't read here
        elif c in "([":
            end = _group_end(p, at)
            if c == "(":
                head = p[at + 1 : at + 3]
                if p[at + 1 : at + 2] != "?":
                    group = required(p[at + 1 : end - 1])
                elif head == "?:":
                    group = required(p[at + 3 : end - 1])
                elif head not in ("?=", "?!") and p[at + 1 : at + 4] not in ("?<=", "?<!"):
                    return None  # flags and the like
        else:
            end, char = at + 1, None if c in ".^$" else c
        end, least = _repeat(p, end)
        once = p[at:end] == c or (c == "\\" and end == at + 2)
        if char is not None and least:
            run += char
            if not once:
                close()
        else:
            close()
            if group and least:
                best = _better(best, group)
        at = end
    close()
    return best


def required(pattern: str) -> frozenset[str] | None:
    """Strings of which at least one is part of every match; None if that isn't known."""
    branches, at, start = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c in "([":
            at = _group_end(pattern, at)
        elif c == "\\":
            at += 2
        else:
            if c == "|":
                branches.append(pattern[start:at])
                start = at + 1
            at += 1
    found = [_branch(b) for b in [*branches, pattern[start:]]]
    return frozenset().union(*found) if all(found) else None
