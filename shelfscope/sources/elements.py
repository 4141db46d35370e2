"""Elements of archived HTML as intervals, found and selected by built-in expressions.

A page is cut into pieces: a tag (or comment, or declaration) and the text up to the next one. A fold over
the pieces with a stack of open elements gives every element the piece that opens it and the one that
ends it, its depth, and the element before it among its siblings. An end tag closes the nearest open
element of its name with all that are open inside; one without such an element is ignored; what is still
open ends with the page. Void elements, scripts and styles hold no text.

Ancestors are then elements whose interval contains another's opening, the text of an element is the
text of the pieces of its interval, and a selector (tag, .class, [attr], [attr*='v'], descendants, next
siblings, alternatives) is a filter over the page's array of elements. The fold keeps what it has found
in blocks, so its cost grows with the number of tags to the power 1.5 at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = "area base br col embed hr img input link meta source track wbr".split()
# One step through an opening tag: a gap, a name with or without a value, or a stray sign.
STEP = r"""(?>[\s/]++|[^\s=>/"'][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|["'=])"""
TOKEN = rf"(?is)(<!--.*?(?:-->|\z)|<(?:script(?=[\s/>]){STEP}*+>.*?(?:</script\s*>|\z)|style(?=[\s/>]){STEP}*+>.*?(?:</style\s*>|\z))|</?[a-z][^\s/>]*+{STEP}*+>|<[!?][^>]*+>)"
#: Between pieces, and between the tag and the text of one.
CUT, APART = "\x01", "\x02"
BLOCK = 256

OPEN = "struct<at:int,name:string,prev:int,last:int>"
ELEMENT = "struct<at:int,end:int,depth:int,prev:int,name:string>"


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def field(attribute: str) -> str:
    """The field of a piece that holds an attribute."""
    return "attr_" + re.sub(r"\W", "_", attribute.lower())


def pieces(html: Column, unescape, attribute, names: Iterable[str]) -> Column:
    """array<struct<name, kind, text, attr_...>>; kind is open, close, void or none. `unescape` decodes texts, and
    `attribute(tag, name)` reads the attributes `names`, each once per tag."""
    clean = F.translate(F.coalesce(html, F.lit("")), CUT + APART, "")
    parts = F.split(F.regexp_replace(clean, TOKEN, f"{CUT}$1{APART}"), CUT)

    def piece(part: Column) -> Column:
        tag = F.when(F.contains(part, F.lit(APART)), F.substring_index(part, APART, 1)).otherwise("")
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))
        kind = (
            F.when(name == "", "none").when(F.startswith(tag, F.lit("</")), "close")
            .when(name.isin("script", "style", *VOID) | tag.endswith("/>"), "void").otherwise("open")
        )
        read = [F.when(F.contains(tag, F.lit("=")), attribute(tag, n)).alias(field(n)) for n in names]
        return F.struct(name.alias("name"), kind.alias("kind"), unescape(F.substring_index(part, APART, -1)).alias("text"), *read)

    return F.transform(parts, piece)


def _element(open_: Column, end: Column, depth: Column) -> Column:
    return F.struct(open_["at"].alias("at"), end.alias("end"), depth.cast("int").alias("depth"), open_["prev"].alias("prev"), open_["name"].alias("name"))


def _closed(stack: Column, keep: Column, end: Column) -> Column:
    """Elements of the open ones above the first `keep`."""
    return F.transform(F.slice(stack, keep + 1, F.size(stack)), lambda o, k: _element(o, end, keep + k))


def _step(state: Column, piece: Column) -> Column:
    stack, at = state["stack"], piece["at"]
    top = F.element_at(stack, -1)
    opened = F.struct(at.alias("at"), piece["name"].alias("name"), top["last"].alias("prev"), F.lit(-1).alias("last"))
    below = F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(top.withField("last", at)))

    def close(keep: Column) -> Column:
        return F.struct(F.slice(stack, 1, keep).alias("stack"), F.concat(state["out"], _closed(stack, keep, at)).alias("out"))

    # How many stay open: all below the last one of the name.
    kept = F.aggregate(stack, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("found")), lambda a, o: F.struct(
        (a["n"] + 1).alias("n"), F.when(o["name"] == piece["name"], a["n"]).otherwise(a["found"]).alias("found"),
    ), lambda a: a["found"])
    return (
        F.when(piece["kind"] == "open", F.struct(F.concat(below, F.array(opened)).alias("stack"), state["out"].alias("out")))
        .when(piece["kind"] == "void", F.struct(below.alias("stack"), F.concat(state["out"], F.array(_element(opened, at, F.size(stack)))).alias("out")))
        .when(piece["kind"] == "close", let(kept, lambda k: F.when(k > 0, close(k)).otherwise(state)))
        .otherwise(state)
    )


def elements(parts: Column) -> Column:
    """array<struct<at, end, depth, prev, name>> of a page's pieces, in page order. The pieces from `at` up to,
    not with, `end` are an element's; of a void element both are the same."""
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["name"].alias("name"), p["kind"].alias("kind")))
    tags = F.filter(numbered, lambda p: p["kind"] != "none")
    root = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("name"), F.lit(-1).alias("prev"), F.lit(-1).alias("last")))
    none = F.array().cast(f"array<{ELEMENT}>")

    def block(state: Column, first: Column) -> Column:
        begin = F.struct(state["stack"].alias("stack"), none.alias("out"))
        done = F.aggregate(F.slice(state["tags"], first, BLOCK), begin, _step)
        return let(done, lambda d: F.struct(
            d["stack"].alias("stack"), F.concat(state["blocks"], F.array(d["out"])).alias("blocks"), state["tags"].alias("tags"),
        ))

    def folded(tags: Column) -> Column:
        start = F.struct(root.cast(f"array<{OPEN}>").alias("stack"), F.array().cast(f"array<array<{ELEMENT}>>").alias("blocks"), tags.alias("tags"))
        starts = F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, start, block, lambda s: F.concat(F.flatten(s["blocks"]), _closed(s["stack"], F.lit(1), F.size(parts))))

    return F.array_sort(let(tags, folded))


# Selectors

SIMPLE = re.compile(
    r"(?P<tag>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*$^]?=)(?P<quote>['\"])(?P<value>.*?)(?P=quote))?\]"
)


def steps_of(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Per alternative: (combinator before, simple tests) from left to right."""
    out = []
    for group in re.split(r",(?![^\[]*\])", selector):
        spaced = re.sub(r"\s*\+\s*(?![^\[]*\])", " + ", group.strip())
        steps, combinator = [], " "
        for token in re.split(r"\s+(?![^\[]*\])", spaced):
            if token == "+":
                combinator = "+"
            else:
                steps.append((combinator, [m.groupdict() for m in SIMPLE.finditer(token)]))
                combinator = " "
        out.append(steps)
    return out


def attributes_of(selector: str) -> set[str]:
    """The attributes that a selector looks at."""
    tests = [t for steps in steps_of(selector) for _, tests in steps for t in tests]
    return {"class" if t["cls"] else t["attr"] for t in tests if not t["tag"]}


def _passes(element: Column, piece: Column, tests: list[dict]) -> Column:
    result = F.lit(True)
    for test in tests:
        if test["tag"]:
            holds = element["name"] == test["tag"].lower()
        elif test["cls"]:
            holds = F.array_contains(F.split(F.coalesce(piece[field("class")], F.lit("")), r"\s+"), test["cls"])
        else:
            value = piece[field(test["attr"])]
            wanted = F.lit(test["value"])
            holds = {
                None: lambda: value.isNotNull(), "=": lambda: value == wanted, "*=": lambda: F.contains(value, wanted),
                "$=": lambda: value.endswith(test["value"]), "^=": lambda: value.startswith(test["value"]),
            }[test["op"]]()
            holds = F.coalesce(holds, F.lit(False))
        result = result & holds
    return result


def select(found: Column, parts: Column, selector: str) -> Column:
    """The elements of a page that match a selector, in page order; its attributes are fields of the pieces."""

    def passing(tests: list[dict]) -> Column:
        return F.filter(found, lambda e: _passes(e, F.get(parts, e["at"]), tests))

    def after(matched: Column, own: Column) -> Column:
        return let(matched, lambda before: F.filter(own, lambda e: F.exists(before, lambda b: b["at"] == e["prev"])))

    def below(matched: Column, own: Column) -> Column:
        return let(matched, lambda above: F.filter(own, lambda e: F.exists(above, lambda a: (a["at"] < e["at"]) & (e["at"] < a["end"]))))

    chosen = []
    for steps in steps_of(selector):
        matched = passing(steps[0][1])
        for combinator, tests in steps[1:]:
            matched = (after if combinator == "+" else below)(matched, passing(tests))
        chosen.append(matched)
    if len(chosen) == 1:
        return chosen[0]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*chosen))))


def inside(chosen: Column, element: Column) -> Column:
    """Those of the chosen elements that are descendants of an element."""
    return F.filter(chosen, lambda e: (element["at"] < e["at"]) & (e["at"] < element["end"]))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_of(parts: Column, element: Column, separator: str = "", strip: bool = True) -> Column:
    """Text of an element; pieces are stripped one by one unless `strip` is off. NULL without an element."""
    held = F.slice(parts, element["at"] + 1, element["end"] - element["at"])["text"]
    if strip:
        held = F.filter(F.transform(held, stripped), lambda t: t != "")
    return F.when(element.isNotNull(), F.array_join(held, separator))
