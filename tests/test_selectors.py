"""CSS selectors against a plain matcher on random trees."""

import random

import pytest
from pyspark.sql import functions as F

from marketgrain.functions import html, selectors

TAGS, CLASSES, VALUES = ["div", "p", "b"], ["x", "y", "z-1"], ["", "ab", "ab cd", "ab-cd", "AB", "xaby"]


def tree(rng, size):
    """A page, and its elements as (parent, tag, attributes, whether it holds text) in document order."""
    elements, parts = [], []

    def grow(parent, depth):
        while len(elements) < size and rng.random() < (0.9 if depth < 4 else 0.3):
            n, tag, attrs = len(elements), rng.choice(TAGS), {}
            if rng.random() < 0.6:
                attrs["class"] = " ".join(rng.sample(CLASSES, rng.randrange(1, 3)))
            if rng.random() < 0.4:
                attrs["data-a"] = rng.choice(VALUES)
            if rng.random() < 0.1:
                attrs["id"] = f"i{rng.randrange(5)}"
            elements.append([parent, tag, attrs, False])
            parts.append(f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">")
            if rng.random() < 0.3:
                elements[n][3] = True
                parts.append("text")
            grow(n, depth + 1)
            parts.append(f"</{tag}>")

    while len(elements) < size:
        grow(-1, 0)
    return "".join(parts), elements


def simple(rng):
    """A simple selector as text, and a test of (elements, n)."""
    siblings = lambda es, n: [m for m, e in enumerate(es) if e[0] == es[n][0]]
    kind = rng.randrange(9)
    if kind == 0:
        t = rng.choice(TAGS)
        return t if rng.random() < 0.7 else t.upper(), lambda es, n: es[n][1] == t
    if kind == 1:
        c = rng.choice(CLASSES)
        return f".{c}", lambda es, n: c in es[n][2].get("class", "").split()
    if kind == 2:
        i = rng.randrange(5)
        return f"#i{i}", lambda es, n: es[n][2].get("id") == f"i{i}"
    if kind == 3:
        op, v, quote, flag = rng.choice(["=", "^=", "$=", "*=", "~=", "|="]), rng.choice(["ab", "cd", "ab cd", "AB", "", "b"]), rng.choice("\"'"), rng.choice(["", " i"])

        def test(es, n):
            own = es[n][2].get("data-a")
            if own is None:
                return False
            a, w = (own.lower(), v.lower()) if flag else (own, v)
            return {"=": a == w, "^=": bool(w) and a.startswith(w), "$=": bool(w) and a.endswith(w), "*=": bool(w) and w in a, "~=": w in a.split() and bool(w), "|=": a == w or a.startswith(w + "-")}[op]

        return f"[ data-a {op} {quote}{v}{quote}{flag}]", test
    if kind == 4:
        return "[data-a]", lambda es, n: "data-a" in es[n][2]
    if kind == 5:
        a, b = rng.randrange(-2, 4), rng.randrange(-2, 4)
        text = rng.choice([f"{a}n{b:+d}", f"{a}n {'+-'[b < 0]} {abs(b)}", f"{a}n{b:+d}"])
        placed = lambda k: any(a * j + b == k for j in range(200))
        if rng.random() < 0.5:
            return f":nth-child({text})", lambda es, n: placed(siblings(es, n).index(n) + 1)
        return f":nth-of-type({text})", lambda es, n: placed([m for m in siblings(es, n) if es[m][1] == es[n][1]].index(n) + 1)
    if kind == 6:
        name = rng.choice([":first-child", ":last-child", ":only-child", ":first-of-type", ":nth-child(odd)", ":nth-child(even)", ":nth-child(2)"])
        return name, {
            ":first-child": lambda es, n: siblings(es, n)[0] == n,
            ":last-child": lambda es, n: siblings(es, n)[-1] == n,
            ":only-child": lambda es, n: siblings(es, n) == [n],
            ":first-of-type": lambda es, n: [m for m in siblings(es, n) if es[m][1] == es[n][1]][0] == n,
            ":nth-child(odd)": lambda es, n: siblings(es, n).index(n) % 2 == 0,
            ":nth-child(even)": lambda es, n: siblings(es, n).index(n) % 2 == 1,
            ":nth-child(2)": lambda es, n: siblings(es, n).index(n) == 1,
        }[name]
    if kind == 7:
        return ":empty", lambda es, n: not es[n][3] and all(e[0] != n for e in es)
    (s, t), (u, w) = compound(rng, 1), compound(rng, 1)
    return f":not({s} , {u})", lambda es, n: not t(es, n) and not w(es, n)


def compound(rng, most=3):
    parts = [simple(rng) for _ in range(rng.randrange(1, most + 1))]
    parts.sort(key=lambda p: not p[0][0].isalpha())  # a tag comes first, and only one does
    parts = [p for k, p in enumerate(parts) if k == 0 or not p[0][0].isalpha()]
    return "".join(s for s, _ in parts), lambda es, n: all(t(es, n) for _, t in parts)


def steps(rng):
    text, test = compound(rng)
    tests = [(" ", test)]
    for _ in range(rng.randrange(3)):
        mark, (s, t) = rng.choice(" >+~"), compound(rng)
        text += (rng.choice([mark, f" {mark} "]) if mark != " " else rng.choice([" ", "  "])) + s
        tests.append((mark, t))

    def picks(es, n, k):
        mark, t = tests[k]
        if not t(es, n):
            return False
        if k == 0:
            return True
        own = [m for m, e in enumerate(es) if e[0] == es[n][0]]
        place = own.index(n)
        above = []
        up = es[n][0]
        while up >= 0:
            above.append(up)
            up = es[up][0]
        near = {" ": above, ">": above[:1], "+": own[place - 1 : place] if place else [], "~": own[:place]}[mark]
        return any(picks(es, m, k - 1) for m in near)

    return text, lambda es, n: picks(es, n, len(tests) - 1)


def test_random_selectors_on_random_trees(spark):
    rng = random.Random(21)
    pages = [tree(rng, rng.randrange(1, 40)) for _ in range(40)]
    parsed = html.with_nodes(spark.createDataFrame([(k, page) for k, (page, _) in enumerate(pages)], "k int, html string")).cache()
    assert [len(r.nodes) for r in parsed.orderBy("k").collect()] == [len(es) for _, es in pages]
    hits = 0
    for _ in range(12):
        batch = []
        for _ in range(6):
            one = [steps(rng) for _ in range(rng.choice([1, 1, 2]))]
            batch.append((" , ".join(s for s, _ in one), [t for _, t in one]))
        columns = [selectors.selected(F.col("nodes"), text)["id"].alias(f"c{j}") for j, (text, _) in enumerate(batch)]
        for r in parsed.select("k", *columns).collect():
            es = pages[r.k][1]
            for j, (text, tests) in enumerate(batch):
                want = next((n for n in range(len(es)) if any(t(es, n) for t in tests)), None)
                assert r[f"c{j}"] == want, (text, pages[r.k][0])
                hits += want is not None
    assert hits > 300


@pytest.mark.parametrize("text", ["", " ", "a,", ",a", "a >", "> a", "a:hover", ":nth-child(x)", ":nth-child(2", "a[", "a[b=]", ":not(a", ":not(a b)", "a..b", "a}b", "::before", "a | b"])
def test_unknown_selectors_raise(text):
    with pytest.raises(ValueError):
        selectors.parse(text)


@pytest.mark.parametrize("text, want", [("odd", (2, 1)), ("EVEN", (2, 0)), ("n", (1, 0)), ("-n+3", (-1, 3)), ("+3n - 2", (3, -2)), ("4", (0, 4)), (" -1 ", (0, -1))])
def test_places(text, want):
    assert selectors.nth(text) == want


def test_values_with_marks_of_their_own(spark):
    page = '<a href="/p?x=1,2>3">one</a><a title="a] b" class="b:c">two</a>'
    parsed = html.with_nodes(spark.createDataFrame([(page,)], "html string"))
    pick = lambda s: html.node_text(selectors.selected(F.col("nodes"), s))
    row = parsed.select(pick('a[href*="1,2>3"]').alias("a"), pick("a[title='a] b']").alias("b"), pick(r"a.b\:c").alias("c"), pick("a[href$='4'], a + a").alias("d")).first()
    assert tuple(row) == ("one", "two", "two", "two")
