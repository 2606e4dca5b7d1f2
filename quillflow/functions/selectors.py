"""CSS selectors over a page's nodes as Column expressions, and the shortest selector that names a node alone.

A page parsed with its nodes has them as one array, each with the places of its ancestors in it. A selector becomes a predicate over a node of that array:
tags, #id, .class, [attribute] with = ^= $= *= ~= |=, :nth-child, :nth-of-type, :first-, :last- and :only-child or -of-type, :not(...), the
combinators descendant, >, + and ~, and lists. Pages are matched where they lie, in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "struct<at: int, parent: int, prev: int, ancestors: array<int>, tag: string, id: string, classes: array<string>, attrs: map<string,string>, child: int, children_after: int, of_type: int, of_type_after: int, link: int, first_link: int, n_links: int, start: int, size: int, selector: string>"
_NAME = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w-]|[^\x00-\x7f])+"
_PART = re.compile(
    rf"(?P<tag>{_NAME}|\*)|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))\s*)?\]"
    rf"|:not\((?P<inner>[^()]*(?:\([^()]*\)[^()]*)*)\)|:(?P<pseudo>[\w-]+)(?:\(\s*(?P<arg>[^()]*?)\s*\))?"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")

Test = Callable[[Column], Column]


def _plain(name: str) -> str:
    """A name without its escapes: a backslash and a character's number in hexadecimal, or the character."""
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


def _nth(arg: str, place: Column) -> Column:
    """Whether a place (1 first) is one of an + b."""
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.lower(), arg.lower().replace(" ", ""))
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not found:
        raise ValueError(f"no such place: {arg}")
    if found[3]:
        return place == int(found[3])
    a, b = int(found[1] + "1" if found[1] in ("", "+", "-") else found[1]), int(found[2] or 0)
    return place == b if a == 0 else ((place - b) % a == 0) & ((place - b) * (1 if a > 0 else -1) >= 0)


_PLACES: dict[str, Test] = {
    "first-child": lambda e: e["child"] == 1, "last-child": lambda e: e["children_after"] == 0, "only-child": lambda e: (e["child"] == 1) & (e["children_after"] == 0), "first-of-type": lambda e: e["of_type"] == 1,
    "last-of-type": lambda e: e["of_type_after"] == 0, "only-of-type": lambda e: (e["of_type"] == 1) & (e["of_type_after"] == 0), "root": lambda e: e["parent"] < 0,
}
_NTH: dict[str, Callable[[Column], Column]] = {"nth-child": lambda e: e["child"], "nth-of-type": lambda e: e["of_type"], "nth-last-child": lambda e: e["children_after"] + 1, "nth-last-of-type": lambda e: e["of_type_after"] + 1}


def _test(part: re.Match) -> Test:
    """What one part of a compound selector asks of a node."""
    g = part.groupdict()
    if g["tag"]:
        tag = _plain(g["tag"]).lower()
        return (lambda e: F.lit(True)) if tag == "*" else lambda e: e["tag"] == tag
    if g["id"]:
        return lambda e: e["id"] == _plain(g["id"])
    if g["cls"]:
        return lambda e: F.array_contains(e["classes"], _plain(g["cls"]))
    if g["attr"]:
        name, want = _plain(g["attr"]).lower(), next((g[k] for k in ("dq", "sq") if g[k] is not None), _plain(g["bare"] or ""))
        value = lambda e: e["attrs"][name]
        if not g["op"]:
            return lambda e: value(e).isNotNull()
        never = lambda e: F.lit(False)
        return {
            "=": lambda e: value(e) == want, "^=": (lambda e: value(e).startswith(want)) if want else never, "$=": (lambda e: value(e).endswith(want)) if want else never, "*=": (lambda e: value(e).contains(want)) if want else never,
            "~=": lambda e: F.array_contains(F.split(value(e), r"\s+"), want), "|=": lambda e: (value(e) == want) | value(e).startswith(f"{want}-"),
        }[g["op"]]
    if g["inner"] is not None:
        inner = _compound(g["inner"].strip())
        return lambda e: ~F.coalesce(inner(e), F.lit(False))
    if g["pseudo"] in _PLACES:
        return _PLACES[g["pseudo"]]
    if g["pseudo"] in _NTH:
        return lambda e: _nth(g["arg"] or "", _NTH[g["pseudo"]](e))
    raise ValueError(f"no such selector: {part[0]}")


def _compound(text: str) -> Test:
    tests, at = [], 0
    while at < len(text):
        part = _PART.match(text, at)
        if not part:
            raise ValueError(f"no such selector: {text}")
        tests.append(_test(part))
        at = part.end()

    def all_(e: Column) -> Column:
        out = tests[0](e)
        for t in tests[1:]:
            out = out & t(e)
        return out

    if not tests:
        raise ValueError("a selector is missing")
    return all_


def _steps(text: str) -> list[tuple[str, Test]]:
    """(combinator with what stands before, test) from left to right."""
    out, at, combinator = [], 0, ""
    while at < len(text):
        start = at
        while part := _PART.match(text, at):
            at = part.end()
        out.append((combinator, _compound(text[start:at])))
        joint = _COMBINATOR.match(text, at)
        if at < len(text) and not joint:
            raise ValueError(f"no such selector: {text}")
        if joint:
            combinator, at = joint[1] or " ", joint.end()
            if at == len(text):
                raise ValueError(f"no such selector: {text}")
    return out


def _split(text: str) -> list[str]:
    """The selectors of a list; commas in brackets and quotes do not divide."""
    return [x.strip() for x in re.findall(r"""((?:\\.|"[^"]*"|'[^']*'|\([^)]*\)|\[[^\]]*\]|[^,])+)""", text)]


def matches(nodes: Column, e: Column, selector: str) -> Column:
    """Whether the node e of nodes fits the selector."""
    lists = [_steps(s) for s in _split(selector) if s]
    if not lists:
        raise ValueError("a selector is missing")

    def fits(steps: list[tuple[str, Test]], i: int, e: Column) -> Column:
        combinator, test = steps[i]
        if i == 0:
            return test(e)
        before = lambda x: F.coalesce(fits(steps, i - 1, x), F.lit(False))
        around = {
            ">": lambda: before(F.get(nodes, e["parent"])), "+": lambda: before(F.get(nodes, e["prev"])), " ": lambda: F.exists(e["ancestors"], lambda a: before(F.get(nodes, a))),
            "~": lambda: F.exists(nodes, lambda s: (s["parent"] == e["parent"]) & (s["at"] < e["at"]) & before(s)),
        }[combinator]
        return test(e) & around()

    found = [F.coalesce(fits(steps, len(steps) - 1, e), F.lit(False)) for steps in lists]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def selected(nodes: str, selector: str) -> Column:
    """The nodes of a page (a column of NODEs) that fit, in order."""
    return F.filter(nodes, lambda e: matches(F.col(nodes), e, selector))


def first(nodes: str, selector: str) -> Column:
    return F.try_element_at(selected(nodes, selector), F.lit(1))


# The other way round ---------------------------------------------------------------------------------------------------------------------------


def escaped(name: str) -> str:
    safe = re.sub(r"([^\w-])", r"\\\1", name, flags=re.ASCII)
    return f"\\{ord(safe[0]):x} {safe[1:]}" if safe[:1].isdigit() else safe


def shortest(nodes: list[dict]) -> list[str]:
    """For each node of a page (parent, tag, id, classes, of_type, of_type_after) a selector that it alone fits: its id, its tag and classes, its tag, or the path from the
    nearest ancestor that has an id to itself."""
    ids, tags = Counter(n["id"] for n in nodes if n["id"]), Counter(n["tag"] for n in nodes)
    holders: dict[tuple[str, str], set[int]] = {}
    for i, n in enumerate(nodes):
        for c in n["classes"]:
            holders.setdefault((n["tag"], c), set()).add(i)
    out, paths = [], []
    for n in nodes:
        named = bool(n["id"]) and ids[n["id"]] == 1
        step = n["tag"] + (f":nth-of-type({n['of_type']})" if n["of_type"] > 1 or n["of_type_after"] else "")
        root = step if n["parent"] < 0 else f"{paths[n['parent']]} > {step}"
        paths.append(f"#{escaped(n['id'])}" if named else root)
        classes = list(dict.fromkeys(n["classes"]))[:2]
        if named:
            out.append(paths[-1])
        elif classes and len(set.intersection(*(holders[n["tag"], c] for c in classes))) == 1:
            out.append(".".join([n["tag"], *map(escaped, classes)]))
        else:
            out.append(n["tag"] if tags[n["tag"]] == 1 else paths[-1])
    return out
