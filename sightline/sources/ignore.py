"""Ignore files, as a trie of path segments that a walk descends level by level."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: segments of a path, from the root."""

    segments: tuple[str, ...]
    negated: bool
    only_dir: bool


def parse(line: str) -> Rule | None:
    """The rule of a line; None for blanks and comments.

    Blanks at the end go unless escaped, ``\\#`` and ``\\!`` are plain at the start, a
    slash but at the end ties the rule to the root, one at the end keeps it to folders.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_dir, anchored = line.endswith("/"), "/" in line.rstrip("/")
    segments = [s for s in line.split("/") if s]
    if not segments:
        return None
    if not anchored and segments != ["**"]:
        segments.insert(0, "**")
    if segments[-1] == "**":  # everything below, not the folder itself
        segments.append("*")
    return Rule(tuple(segments), negated, only_dir)


def segment_pattern(segment: str) -> str:
    """A segment as a regular expression: * and ? stay within it, [...] and [!...] are classes, a backslash takes the next character as it is."""
    out, i = "", 0
    while i < len(segment):
        c = segment[i]
        if c == "\\" and i + 1 < len(segment):
            out, i = out + re.escape(segment[i + 1]), i + 2
            continue
        if c == "[" and (end := segment.find("]", i + 2 + (segment[i + 1 : i + 2] in ("!", "^")))) > 0:
            body = segment[i + 1 : end]
            inverse, body = body[:1] in ("!", "^"), body.lstrip("!^") if body[:1] in ("!", "^") else body
            # A slash never fits; Java and Python both read these characters as they are once escaped.
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body)
            out, i = out + ("[^/" + body + "]" if inverse else "(?!/)[" + body + "]"), end + 1
            continue
        out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return out


def path_pattern(rule: Rule) -> str:
    """The rule as a regular expression on relative paths of files: what it names, or what lies below."""
    body = ""
    for k, s in enumerate(rule.segments):
        last = k == len(rule.segments) - 1
        body += "(?:[^/]+/)*" if s == "**" else segment_pattern(s) + ("" if last else "/")
    return f"^{body}{'/.+' if rule.only_dir else '(?:/.+)?'}$"


def pruned(files: DataFrame, ignore: list[str] = (), path: str = "path") -> DataFrame:
    """The rows of a table of paths that no ignore line drops; the last line that fits decides."""
    return files.filter(~ignored(F.col(path), ignore))


def ignored(path: Column, ignore: list[str]) -> Column:
    rules = [r for r in map(parse, ignore) if r]
    return reduce(lambda before, r: F.when(path.rlike(path_pattern(r)), F.lit(not r.negated)).otherwise(before), rules, F.lit(False))


@dataclass
class _Node:
    literal: dict[str, _Node] = field(default_factory=dict)
    pattern: dict[str, tuple[re.Pattern, _Node]] = field(default_factory=dict)
    #: What follows a ``**``: reached by any number of segments.
    deep: _Node | None = None
    repeats: bool = False
    #: Numbers of the rules that end here, of any path and of folders alone.
    ends: list[int] = field(default_factory=list)
    dir_ends: list[int] = field(default_factory=list)


class Walk:
    """The rules while a tree is walked from its root: each step costs the rules still open, not all of them."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(parse, lines) if r]
        self.root = _Node()
        for number, rule in enumerate(self.rules):
            at = self.root
            for s in rule.segments:
                if s == "**":
                    at.deep = at = at.deep or _Node(repeats=True)
                elif re.search(r"[*?\[\\]", s):
                    at = at.pattern.setdefault(s, (re.compile(segment_pattern(s) + r"\Z"), _Node()))[1]
                else:
                    at = at.literal.setdefault(s, _Node())
            (at.dir_ends if rule.only_dir else at.ends).append(number)

    def start(self) -> tuple[tuple[_Node, ...], int]:
        """Where a walk begins: the open nodes, and the number of the last rule that fits a folder above."""
        return self._closed([self.root]), -1

    @staticmethod
    def _closed(nodes: list[_Node]) -> tuple[_Node, ...]:
        out, seen = list(nodes), {id(n) for n in nodes}
        for n in out:
            if n.deep is not None and id(n.deep) not in seen:
                seen.add(id(n.deep))
                out.append(n.deep)
        return tuple(out)

    def step(self, state: tuple[tuple[_Node, ...], int], name: str, folder: bool) -> tuple[tuple[_Node, ...], int]:
        """The state below ``name``."""
        nodes, last = state
        found = [n for n in nodes if n.repeats]
        for n in nodes:
            if name in n.literal:
                found.append(n.literal[name])
            found += [to for p, to in n.pattern.values() if p.match(name)]
        for n in found:
            last = max([last, *n.ends, *(n.dir_ends if folder else ())])
        return self._closed(found), last

    def drops(self, state: tuple[tuple[_Node, ...], int]) -> bool:
        return state[1] >= 0 and not self.rules[state[1]].negated
