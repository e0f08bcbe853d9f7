"""CSS selectors over a page's nodes: a selector becomes column expressions, step by step from its first part to its last.

Known are lists, the combinators (blank, ``>``, ``+``, ``~``), tags, ``#id``, ``.class``, attributes with every operator, ``:first-child``,
``:last-child``, ``:only-child``, ``:nth-child``, ``:nth-of-type``, ``:first-of-type``, ``:empty`` and ``:not``. Anything else raises a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketgrain.functions.text import let

_NAME = r"-?(?:[A-Za-z_\u0080-￿]|\\.)(?:[\w\u0080-￿-]|\\.)*"
_SIMPLE = re.compile(
    rf"(?P<any>\*)|(?P<tag>{_NAME})|\#(?P<id>(?:[\w\u0080-￿-]|\\.)+)|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]\"']+))\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|:(?P<pseudo>[a-z-]+)(?P<open>\()?"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*$", re.I)


@dataclass
class Compound:
    """Simple selectors that hold of one element together: (kind, arguments)."""

    parts: list[tuple] = field(default_factory=list)


#: A selector: (combinator before it, compound) from left to right; the first combinator is a blank.
Steps = list[tuple[str, Compound]]


def nth(text: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    found = _NTH.match(text)
    if found is None:
        raise ValueError(f"no place of this kind is known: {text!r}")
    if found["word"]:
        return (2, 1) if found["word"].lower() == "odd" else (2, 0)
    if found["only"]:
        return 0, int(found["only"])
    a = {"": 1, "+": 1, "-": -1}.get(found["a"]) if found["a"] in ("", "+", "-") else int(found["a"])
    return a, int((found["sign"] or "+") + (found["b"] or "0"))


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self) -> ValueError:
        return ValueError(f"no selector of this kind is known: {self.text!r} at {self.at}")

    def blank(self) -> bool:
        found = re.compile(r"\s*").match(self.text, self.at)
        self.at = found.end()
        return bool(found[0])

    def compound(self) -> Compound:
        own = Compound()
        while (m := _SIMPLE.match(self.text, self.at)) and (not own.parts or not (m["tag"] or m["any"])):
            self.at = m.end()
            plain = lambda name: re.sub(r"\\(.)", r"\1", name)
            if m["any"]:
                own.parts.append(("any",))
            elif m["tag"]:
                own.parts.append(("tag", plain(m["tag"]).lower()))
            elif m["id"]:
                own.parts.append(("attr", "id", "=", plain(m["id"]), False))
            elif m["cls"]:
                own.parts.append(("class", plain(m["cls"])))
            elif m["attr"]:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
                own.parts.append(("attr", m["attr"].lower(), m["op"], value, (m["flag"] or "").lower() == "i"))
            else:
                own.parts.append(self.pseudo(m["pseudo"], bool(m["open"])))
        if not own.parts:
            raise self.fail()
        return own

    def pseudo(self, name: str, opened: bool) -> tuple:
        if not opened:
            if name not in ("first-child", "last-child", "only-child", "first-of-type", "empty"):
                raise self.fail()
            return ("nth-of-type", 0, 1) if name == "first-of-type" else ("nth-child", 0, 1) if name == "first-child" else (name,)
        if name in ("nth-child", "nth-of-type"):
            end = self.text.find(")", self.at)
            if end < 0:
                raise self.fail()
            a, b = nth(self.text[self.at : end])
            self.at = end + 1
            return name, a, b
        if name != "not":
            raise self.fail()
        inside = []
        while True:
            self.blank()
            inside.append(self.compound())
            self.blank()
            mark, self.at = self.text[self.at : self.at + 1], self.at + 1
            if mark == ")":
                return "not", inside
            if mark != ",":
                raise self.fail()

    def steps(self) -> Steps:
        self.blank()
        found = [(" ", self.compound())]
        while True:
            apart = self.blank()
            mark = self.text[self.at : self.at + 1]
            if mark in ("", ","):
                return found
            if mark in (">", "+", "~"):
                self.at += 1
                self.blank()
            elif apart:
                mark = " "
            else:
                raise self.fail()
            found.append((mark, self.compound()))

    def list(self) -> list[Steps]:
        found = [self.steps()]
        while self.at < len(self.text):
            self.at += 1  # a comma
            found.append(self.steps())
        return found


def parse(selector: str) -> list[Steps]:
    return _Reader(selector).list()


def _placed(place: Column, a: int, b: int) -> Column:
    return place == b if a == 0 else ((place - b) % a == 0) & ((place - b) / a >= 0)


def _attribute(value: Column, op: str | None, want: str | None, fold: bool) -> Column:
    if op is None:
        return value.isNotNull()
    value, want = (F.lower(value), want.lower()) if fold else (value, want)
    if op == "=":
        return value == want
    if op == "|=":
        return (value == want) | value.startswith(want + "-")
    if not want or op == "~=" and re.search(r"\s", want):
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(value, r"\s+"), want)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[op](want)


def _holds(part: tuple, n: Column, nodes: Column) -> Column:
    kind, *given = part
    sibling = lambda x: x["parent"] == n["parent"]
    if kind == "any":
        return F.lit(True)
    if kind == "tag":
        return n["tag"] == given[0]
    if kind == "class":
        return F.array_contains(F.split(n["classes"], " "), given[0])
    if kind == "attr":
        return _attribute(n["attrs"][given[0]], *given[1:])
    if kind == "nth-child":
        return _placed(n["nth"], *given)
    if kind == "nth-of-type":
        return _placed(F.size(F.filter(nodes, lambda x: sibling(x) & (x["tag"] == n["tag"]) & (x["id"] <= n["id"]))), *given)
    if kind == "last-child":
        return ~F.exists(nodes, lambda x: sibling(x) & (x["id"] > n["id"]))
    if kind == "only-child":
        return ~F.exists(nodes, lambda x: sibling(x) & (x["id"] != n["id"]))
    if kind == "empty":
        return (n["end"] == n["id"] + 1) & (n["first"] == n["last"])
    return ~_any([_test(c, n, nodes) for c in given[0]])


def _any(tests: list[Column]) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def _test(compound: Compound, n: Column, nodes: Column) -> Column:
    found = F.lit(True)
    for part in compound.parts:
        found = found & F.coalesce(_holds(part, n, nodes), F.lit(False))
    return found


_RELATED: dict[str, Callable[[Column, Column], Column]] = {
    " ": lambda a, n: (a["id"] < n["id"]) & (n["id"] < a["end"]),
    ">": lambda a, n: n["parent"] == a["id"],
    "+": lambda a, n: (n["parent"] == a["parent"]) & (n["nth"] == a["nth"] + 1),
    "~": lambda a, n: (n["parent"] == a["parent"]) & (n["nth"] > a["nth"]),
}


def _next(picked: Column, combinator: str, compound: Compound, nodes: Column) -> Column:
    """The elements that stand so to one of ``picked``, which is found once."""
    near = _RELATED[combinator]
    return let(picked, lambda before: F.filter(nodes, lambda n: _test(compound, n, nodes) & F.exists(before, lambda a: near(a, n))))


def _picked(steps: Steps, nodes: Column) -> Column:
    first = steps[0][1]
    picked = F.filter(nodes, lambda n: _test(first, n, nodes))
    for combinator, compound in steps[1:]:
        picked = _next(picked, combinator, compound, nodes)
    return picked


def matching(nodes: Column, selector: str) -> Column:
    """All elements that a selector picks, those of each selector of a list after those of the one before."""
    return F.concat(*[_picked(steps, nodes) for steps in parse(selector)])


def selected(nodes: Column, selector: str) -> Column:
    """The first element of the page that a selector picks."""
    ids = F.transform(matching(nodes, selector), lambda n: n["id"])
    return F.get(nodes, F.array_min(ids))
