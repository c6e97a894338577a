"""Merging of utility class names: of names that set the same property the last one counts.

Which names set one property follows the documented behaviour of the public tailwind-merge project (MIT licence), which the callers of
such a function know; groups have names of this library's own.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIDES = ("x", "y", "s", "e", "t", "r", "b", "l")

# Which names set one property (first pattern that fits the whole name), and which others a property overrides.
GROUPS = [
    ("display", "block|inline-block|inline|flex|inline-flex|grid|inline-grid|table|inline-table|table-(caption|cell|column|row|column-group|row-group|header-group|footer-group)|contents|list-item|flow-root|hidden"),
    ("position", "static|fixed|absolute|relative|sticky"),
    ("visibility", "visible|invisible|collapse"),
    ("isolation", "isolate|isolation-auto"),
    ("container", "container"),
    ("columns", "columns-.+"),
    ("break-after", "break-after-.+"),
    ("break-before", "break-before-.+"),
    ("break-inside", "break-inside-.+"),
    ("box-decoration", "box-decoration-(slice|clone)"),
    ("float", "float-.+"),
    ("clear", "clear-.+"),
    ("box", "box-(border|content)"),
    ("z", "z-.+"),
    ("order", "order-.+"),
    ("overflow-x", "overflow-x-.+"),
    ("overflow-y", "overflow-y-.+"),
    ("overflow", "overflow-.+"),
    ("overscroll-x", "overscroll-x-.+"),
    ("overscroll-y", "overscroll-y-.+"),
    ("overscroll", "overscroll-.+"),
    *((f"inset-{s}", f"inset-{s}-.+") for s in ("x", "y")),
    ("start", "start-.+"),
    ("end", "end-.+"),
    ("top", "top-.+"),
    ("right", "right-.+"),
    ("bottom", "bottom-.+"),
    ("left", "left-.+"),
    ("inset", "inset-.+"),
    ("flex-direction", "flex-(row|col)(-reverse)?"),
    ("flex-wrap", "flex-(wrap|wrap-reverse|nowrap)"),
    ("flex", "flex-.+"),
    ("grow", "grow(-.+)?"),
    ("shrink", "shrink(-.+)?"),
    ("basis", "basis-.+"),
    ("grid-cols", "grid-cols-.+"),
    ("grid-rows", "grid-rows-.+"),
    ("grid-flow", "grid-flow-.+"),
    ("auto-cols", "auto-cols-.+"),
    ("auto-rows", "auto-rows-.+"),
    ("col-start", "col-start-.+"),
    ("col-end", "col-end-.+"),
    ("col", "col-.+"),
    ("row-start", "row-start-.+"),
    ("row-end", "row-end-.+"),
    ("row", "row-.+"),
    ("gap-x", "gap-x-.+"),
    ("gap-y", "gap-y-.+"),
    ("gap", "gap-.+"),
    ("justify-items", "justify-items-.+"),
    ("justify-self", "justify-self-.+"),
    ("justify", "justify-.+"),
    ("items", "items-.+"),
    ("self", "self-.+"),
    ("place-content", "place-content-.+"),
    ("place-items", "place-items-.+"),
    ("place-self", "place-self-.+"),
    ("align-content", "content-(normal|center|start|end|between|around|evenly|baseline|stretch)"),
    ("content", "content-.+"),
    *((f"p{s}", f"p{s}-.+") for s in _SIDES),
    ("p", "p-.+"),
    *((f"m{s}", f"m{s}-.+") for s in _SIDES),
    ("m", "m-.+"),
    ("space-x-reverse", "space-x-reverse"),
    ("space-y-reverse", "space-y-reverse"),
    ("space-x", "space-x-.+"),
    ("space-y", "space-y-.+"),
    ("min-w", "min-w-.+"),
    ("max-w", "max-w-.+"),
    ("w", "w-.+"),
    ("min-h", "min-h-.+"),
    ("max-h", "max-h-.+"),
    ("h", "h-.+"),
    ("size", "size-.+"),
    ("aspect", "aspect-.+"),
    ("object-fit", "object-(contain|cover|fill|none|scale-down)"),
    ("object-position", "object-.+"),
    ("font-size", "text-(xs|sm|base|lg|xl|[0-9]+xl|\\[[0-9.]+(px|rem|em|%)\\])(/.+)?"),
    ("text-align", "text-(left|center|right|justify|start|end)"),
    ("text-overflow", "truncate|text-ellipsis|text-clip"),
    ("text-wrap", "text-(wrap|nowrap|balance|pretty)"),
    ("text-opacity", "text-opacity-.+"),
    ("text-colour", "text-.+"),
    ("font-family", "font-(sans|serif|mono|body|heading|display)"),
    ("font-weight", "font-(thin|extralight|light|normal|medium|semibold|bold|extrabold|black|\\[[0-9]+\\])"),
    ("font-smoothing", "antialiased|subpixel-antialiased"),
    ("font-style", "italic|not-italic"),
    ("numbers-normal", "normal-nums"),
    ("numbers-ordinal", "ordinal"),
    ("numbers-zero", "slashed-zero"),
    ("numbers-figure", "lining-nums|oldstyle-nums"),
    ("numbers-spacing", "proportional-nums|tabular-nums"),
    ("numbers-fraction", "diagonal-fractions|stacked-fractions"),
    ("tracking", "tracking-.+"),
    ("leading", "leading-.+"),
    ("case", "uppercase|lowercase|capitalize|normal-case"),
    ("decoration-line", "underline|overline|line-through|no-underline"),
    ("decoration-style", "decoration-(solid|double|dotted|dashed|wavy)"),
    ("decoration-thickness", "decoration-(auto|from-font|[0-9]+|\\[[0-9.]+(px|rem|em|%)\\])"),
    ("decoration-colour", "decoration-.+"),
    ("indent", "indent-.+"),
    ("hyphens", "hyphens-.+"),
    ("underline-offset", "underline-offset-.+"),
    ("whitespace", "whitespace-.+"),
    ("break", "break-(normal|words|all|keep)"),
    ("line-clamp", "line-clamp-.+"),
    ("align", "align-.+"),
    ("list-position", "list-(inside|outside)"),
    ("list-image", "list-image-.+"),
    ("list-style", "list-.+"),
    ("bg-attachment", "bg-(fixed|local|scroll)"),
    ("bg-repeat", "bg-(repeat|no-repeat|repeat-x|repeat-y|repeat-round|repeat-space)"),
    ("bg-size", "bg-(auto|cover|contain)"),
    ("bg-position", "bg-(bottom|center|left|left-bottom|left-top|right|right-bottom|right-top|top)"),
    ("bg-image", "bg-(none|gradient-to-(t|tr|r|br|b|bl|l|tl))"),
    ("bg-blend", "bg-blend-.+"),
    ("bg-clip", "bg-clip-.+"),
    ("bg-origin", "bg-origin-.+"),
    ("bg-opacity", "bg-opacity-.+"),
    ("bg-colour", "bg-.+"),
    *((f"{k}-place", f"{k}-([0-9]+%|\\[[0-9.]+%\\])") for k in ("from", "via", "to")),
    *((k, f"{k}-.+") for k in ("from", "via", "to")),
    ("divide-x-reverse", "divide-x-reverse"),
    ("divide-y-reverse", "divide-y-reverse"),
    ("divide-x", "divide-x(-.+)?"),
    ("divide-y", "divide-y(-.+)?"),
    ("divide-style", "divide-(solid|dashed|dotted|double|none)"),
    ("divide-opacity", "divide-opacity-.+"),
    ("divide-colour", "divide-.+"),
    *((f"rounded-{s}", f"rounded-{s}(-.+)?") for s in ("ss", "se", "ee", "es", "tl", "tr", "br", "bl", "s", "e", "t", "r", "b", "l")),
    ("rounded", "rounded(-.+)?"),
    ("border-style", "border-(solid|dashed|dotted|double|hidden|none)"),
    ("border-collapse", "border-(collapse|separate)"),
    ("border-spacing-x", "border-spacing-x-.+"),
    ("border-spacing-y", "border-spacing-y-.+"),
    ("border-spacing", "border-spacing-.+"),
    ("border-opacity", "border-opacity-.+"),
    *((f"border-{s}", f"border-{s}(-([0-9]+|\\[[0-9.]+(px|rem|em)\\]))?") for s in _SIDES),
    ("border", "border(-([0-9]+|\\[[0-9.]+(px|rem|em)\\]))?"),
    *((f"border-colour-{s}", f"border-{s}-.+") for s in _SIDES),
    ("border-colour", "border-.+"),
    ("outline-style", "outline(-(none|dashed|dotted|double))?"),
    ("outline-offset", "outline-offset-.+"),
    ("outline-width", "outline-[0-9]+"),
    ("outline-colour", "outline-.+"),
    ("ring-inset", "ring-inset"),
    ("ring-offset-width", "ring-offset-[0-9]+"),
    ("ring-offset-colour", "ring-offset-.+"),
    ("ring", "ring(-([0-9]+|\\[[0-9.]+(px|rem|em)\\]))?"),
    ("ring-colour", "ring-.+"),
    ("shadow", "shadow(-(sm|md|lg|xl|2xl|inner|none|\\[[0-9].+\\]))?"),
    ("shadow-colour", "shadow-.+"),
    ("opacity", "opacity-.+"),
    ("mix-blend", "mix-blend-.+"),
    *((f"backdrop-{k}", f"backdrop-{k}(-.+)?") for k in ("blur", "brightness", "contrast", "grayscale", "hue-rotate", "invert", "opacity", "saturate", "sepia", "filter")),
    *((k, f"{k}(-.+)?") for k in ("blur", "brightness", "contrast", "grayscale", "hue-rotate", "invert", "saturate", "sepia", "drop-shadow", "filter")),
    ("table-layout", "table-(auto|fixed)"),
    ("caption", "caption-.+"),
    ("transition", "transition(-.+)?"),
    ("duration", "duration-.+"),
    ("ease", "ease-.+"),
    ("delay", "delay-.+"),
    ("animate", "animate-.+"),
    ("scale-x", "scale-x-.+"),
    ("scale-y", "scale-y-.+"),
    ("scale", "scale-.+"),
    ("rotate", "rotate-.+"),
    ("translate-x", "translate-x-.+"),
    ("translate-y", "translate-y-.+"),
    ("translate", "translate-.+"),
    ("skew-x", "skew-x-.+"),
    ("skew-y", "skew-y-.+"),
    ("transform", "transform(-.+)?"),
    ("origin", "origin-.+"),
    ("cursor", "cursor-.+"),
    ("accent", "accent-.+"),
    ("caret", "caret-.+"),
    ("will-change", "will-change-.+"),
    ("scroll-behaviour", "scroll-(auto|smooth)"),
    *((f"scroll-{k}{x}", f"scroll-{k}{x}-.+") for k in ("m", "p") for x in (*_SIDES, "")),
    ("snap-align", "snap-(start|end|center|align-none)"),
    ("snap-stop", "snap-(normal|always)"),
    ("snap-type", "snap-(none|x|y|both)"),
    ("snap-strictness", "snap-(mandatory|proximity)"),
    ("forced-colours", "forced-color-adjust-.+"),
    ("pointer-events", "pointer-events-.+"),
    ("select", "select-.+"),
    ("resize", "resize(-.+)?"),
    ("appearance", "appearance-.+"),
    ("touch-x", "touch-(pan-x|pan-left|pan-right)"),
    ("touch-y", "touch-(pan-y|pan-up|pan-down)"),
    ("touch-pinch", "touch-pinch-zoom"),
    ("touch", "touch-.+"),
    ("fill", "fill-.+"),
    ("stroke-width", "stroke-[0-9]+"),
    ("stroke", "stroke-.+"),
    ("screen-reader", "sr-only|not-sr-only"),
]
OVERRIDES = {
    "overflow": ["overflow-x", "overflow-y"],
    "overscroll": ["overscroll-x", "overscroll-y"],
    "inset": ["inset-x", "inset-y", "start", "end", "top", "right", "bottom", "left"],
    "inset-x": ["right", "left"],
    "inset-y": ["top", "bottom"],
    "flex": ["basis", "grow", "shrink"],
    "gap": ["gap-x", "gap-y"],
    **{f"{k}": [f"{k}{s}" for s in _SIDES] for k in ("p", "m")},
    **{f"{k}x": [f"{k}r", f"{k}l"] for k in ("p", "m")},
    **{f"{k}y": [f"{k}t", f"{k}b"] for k in ("p", "m")},
    **{f"scroll-{k}": [f"scroll-{k}{s}" for s in _SIDES] for k in ("m", "p")},
    **{f"scroll-{k}x": [f"scroll-{k}r", f"scroll-{k}l"] for k in ("m", "p")},
    **{f"scroll-{k}y": [f"scroll-{k}t", f"scroll-{k}b"] for k in ("m", "p")},
    "touch": ["touch-x", "touch-y", "touch-pinch"],
    **{f"touch-{k}": ["touch"] for k in ("x", "y", "pinch")},
    "numbers-normal": [f"numbers-{k}" for k in ("ordinal", "zero", "figure", "spacing", "fraction")],
    **{f"numbers-{k}": ["numbers-normal"] for k in ("ordinal", "zero", "figure", "spacing", "fraction")},
    "border-spacing": ["border-spacing-x", "border-spacing-y"],
    "translate": ["translate-x", "translate-y"],
    "size": ["w", "h"],
    "font-size": ["leading"],
    "line-clamp": ["display", "overflow"],
    "rounded": [f"rounded-{s}" for s in ("s", "e", "t", "r", "b", "l", "ss", "se", "ee", "es", "tl", "tr", "br", "bl")],
    "rounded-s": ["rounded-ss", "rounded-es"],
    "rounded-e": ["rounded-se", "rounded-ee"],
    "rounded-t": ["rounded-tl", "rounded-tr"],
    "rounded-r": ["rounded-tr", "rounded-br"],
    "rounded-b": ["rounded-br", "rounded-bl"],
    "rounded-l": ["rounded-tl", "rounded-bl"],
    "border": [f"border-{s}" for s in _SIDES],
    "border-x": ["border-r", "border-l"],
    "border-y": ["border-t", "border-b"],
    "border-colour": [f"border-colour-{s}" for s in _SIDES],
    "border-colour-x": ["border-colour-r", "border-colour-l"],
    "border-colour-y": ["border-colour-t", "border-colour-b"],
}


def _heads(pattern: str) -> set[str]:
    """The first words of what a pattern fits: letters and digits before anything else, of each of its alternatives."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return {re.match("[a-z0-9]+", p)[0] for p in parts}


#: Groups that a name can be of by its first word, in order.
BY_HEAD: dict[str, list[tuple[str, str]]] = {}
for _group, _pattern in GROUPS:
    for _head in sorted(_heads(_pattern)):
        BY_HEAD.setdefault(_head, []).append((_group, _pattern))


def group_of(base: Column, head: Column) -> Column:
    """The property that a name without prefixes sets; null for names that set none of GROUPS. ``head``, its first word, is looked up first: only
    the patterns of that word are tried."""
    table = {h: [{"group": g, "pattern": f"^(?:{p})$"} for g, p in groups] for h, groups in BY_HEAD.items()}
    # as one text that Spark reads once, when it plans: hundreds of literals of their own would take seconds to plan
    known = F.from_json(F.lit(json.dumps(table)), "map<string,array<struct<group:string,pattern:string>>>")
    return F.get(F.filter(F.try_element_at(known, head), lambda g: F.rlike(base, g["pattern"])), 0)["group"]


def sorted_variants(prefix: Column) -> Column:
    """A name's variants (``md:hover:``) in one order, whatever order they are written in; those in brackets of their own stay where
    they are, and others don't cross them."""
    variants = F.regexp_extract_all(prefix, F.lit(r"((?:[^:\[\]]|\[[^\]]*\])+):"), F.lit(1))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("done"), none.alias("run"))
    closed = lambda s: F.concat(s["done"], F.array_sort(s["run"]))
    step = lambda s, v: F.when(v.startswith("["), F.struct(F.concat(closed(s), F.array(v)).alias("done"), none.alias("run"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["run"], F.array(v)).alias("run")))
    return F.array_join(F.aggregate(variants, zero, step, closed), ":")


def class_names(parts: Column) -> Column:
    """Falsy parts dropped, the rest split at white space and joined; of names that set one property, with the same prefixes
    (``hover:``, ``md:``, ``!``, in whatever order), the last counts, and it hides those it overrides (``p-4`` after ``px-2``). Other names stay.
    """
    text = F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), " ")
    names = F.filter(F.split(text, r"\s+"), lambda n: n != "")

    # in steps, so that what a step works out is not worked out again wherever the next one uses it
    def cut(name: Column) -> Column:
        return F.struct(name.alias("name"), F.regexp_extract(name, r"((?:[^:\[\]]|\[[^\]]*\])+)$", 1).alias("base"))

    def read(x: Column) -> Column:
        name, base = x["name"], x["base"]
        plain = F.regexp_replace(base, "^!?-?", "")
        variants = sorted_variants(F.substring(name, F.lit(1), F.length(name) - F.length(base)))
        prefix = F.concat(variants, F.when(base.startswith("!"), F.lit("!")).otherwise(F.lit("")))
        return F.struct(name.alias("name"), prefix.alias("prefix"), plain.alias("plain"), F.regexp_extract(plain, "^[a-z0-9]+", 0).alias("head"))

    def grouped(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), x["prefix"].alias("prefix"), group_of(x["plain"], x["head"]).alias("group"))

    described = F.transform(F.transform(F.transform(names, cut), read), grouped)
    overridden = F.from_json(F.lit(json.dumps(OVERRIDES)), "map<string,array<string>>")
    mark = lambda d, group: F.concat(d["prefix"], F.lit("|"), group)
    hides = lambda d: F.when(d["group"].isNotNull(), F.transform(F.concat(F.array(d["group"]), F.coalesce(F.try_element_at(overridden, d["group"]), F.array().cast("array<string>"))), lambda g: mark(d, g))).otherwise(F.array().cast("array<string>"))

    # from the last name on: what is kept so far, and what the names after hide
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("hidden"))

    def step(state: Column, d: Column) -> Column:
        hidden = F.coalesce(F.array_contains(state["hidden"], mark(d, d["group"])), F.lit(False))
        return F.struct(
            F.when(hidden, state["kept"]).otherwise(F.concat(F.array(d["name"]), state["kept"])).alias("kept"),
            F.when(hidden, state["hidden"]).otherwise(F.array_union(state["hidden"], hides(d))).alias("hidden"),
        )

    return F.array_join(F.aggregate(F.reverse(described), zero, step, lambda s: s["kept"]), " ")
