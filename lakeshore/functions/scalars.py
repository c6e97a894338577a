"""Scalar and collection functions: columns in, columns out, all built of Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Themes and their prefixes, breakpoints, variants of a menu button.
THEMES = {"light": "", "dark": ".dark"}
MOBILE, DESKTOP = 768, 1024
MENU_VARIANTS = {"variant": ["default", "outline"], "size": ["default", "sm", "lg"]}


def truthy(x: Column, kind: str = "string") -> Column:
    """Null for what counts as false: null, '', 0, NaN, false."""
    if kind == "string":
        return F.nullif(x, F.lit(""))
    if kind == "boolean":
        return F.when(x, x)
    return F.when((x != 0) & ~F.isnan(x.cast("double")), x)


def first_truthy(*xs: Column, kind: str = "string") -> Column:
    """The first that counts as true, else the last as it is."""
    return F.coalesce(*[truthy(x, kind) for x in xs[:-1]], xs[-1])


def first_known(*xs: Column) -> Column:
    """The first that is not null; '' and 0 are known."""
    return F.coalesce(*xs)


def when_equal(x: Column, y: Column | str, yes: str, no: str) -> Column:
    """``yes`` where both are equal, else ``no``; unknown is not equal."""
    return F.when(F.coalesce(x == y, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def at_least(width: Column, yes: Column, no: Column, limit: float = DESKTOP) -> Column:
    """``yes`` from the limit on, else ``no``; an unknown width is below."""
    return F.when(width >= limit, yes).otherwise(no)


def is_mobile(width: Column, limit: float = MOBILE) -> Column:
    """Below the limit; unknown is false."""
    return F.coalesce(width < limit, F.lit(False))


def routed(path: Column, routes: Mapping[str, str], otherwise: str) -> Column:
    """The route of a path, or the catch-all."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for known, name in routes.items():
        out = out.when(path == known, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def themed_colour(theme: Column, name: str, colour: Column) -> Column:
    """A theme's colour or the common one; null if neither is set."""
    return F.coalesce(truthy(F.try_element_at(theme, F.lit(name))), truthy(colour))


def colour_block(config: Column, chart: Column, name: str) -> Column:
    """A theme's style block: a line for each entry with a colour or a theme, in the map's order; '' where one has no
    colour for this theme. Null if no entry has any."""
    used = F.filter(F.map_entries(config), lambda e: truthy(e["value"]["color"]).isNotNull() | e["value"]["theme"].isNotNull())

    def line(e: Column) -> Column:
        colour = themed_colour(e["value"]["theme"], name, e["value"]["color"])
        return F.coalesce(F.concat(F.lit("  --color-"), e["key"], F.lit(": "), colour, F.lit(";")), F.lit(""))

    text = F.concat(F.lit(f"\n{THEMES[name]} [data-chart="), chart, F.lit("] {\n"), F.array_join(F.transform(used, line), "\n"), F.lit("\n}\n"))
    return F.when(F.size(used) > 0, text)


def style_text(config: Column, chart: Column) -> Column:
    """The blocks of all themes, joined by line ends."""
    return F.when(colour_block(config, chart, "light").isNotNull(), F.concat_ws("\n", *[colour_block(config, chart, n) for n in THEMES]))


def payload_config(config: Column, own: Column, nested: Column, key: Column) -> Column:
    """The entry of a payload: looked up by the payload's own text at ``key``, else its nested payload's, else by ``key``.

    Presence counts: an entry that is there but null is taken. ``own`` and ``nested`` are maps of text.
    """
    name = F.coalesce(F.try_element_at(own, key), F.try_element_at(nested, key), key)
    return F.when(F.map_contains_key(config, name), F.try_element_at(config, name)).otherwise(F.try_element_at(config, key))


def item_key(first: Column, second: Column, third: Column) -> Column:
    """The first that counts as true, else ``value``."""
    return first_truthy(first, second, third, F.lit("value"))


def first_item(items: Column) -> Column:
    """The first item, null if there is none."""
    return F.get(items, F.lit(0))


def is_empty(items: Column) -> Column:
    return F.coalesce(F.size(items) <= 0, F.lit(True))


def is_single(items: Column) -> Column:
    return F.coalesce(F.size(items) == 1, F.lit(False))


def grouped_number(x: Column) -> Column:
    """A number with grouped thousands and at most three decimals; null for what counts as false.

    Halves round away from zero, as the US English form does.
    """
    whole = F.format_number(F.round(truthy(x, "double").cast("decimal(38,6)"), 3), 3)
    return F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", "")


def projected(items: Column, label: str, name: str) -> Column:
    """Each item's label, or its name, in order."""
    return F.transform(items, lambda i: F.coalesce(truthy(i[label]), i[name]))


def without(text: Column, part: str = ":") -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def remaining(value: Column, whole: float = 100) -> Column:
    """What is left of ``whole``; nothing known takes nothing."""
    return F.lit(whole) - F.coalesce(truthy(value, "double"), F.lit(0))


def random_width(instance: Column, seed: int = 0, low: int = 50, span: int = 40) -> Column:
    """A whole number from ``low`` below ``low + span``, by chance but fixed for an instance: by a hash of what tells it from others, so that
    neither partitions nor a second run change it. A null instance is an empty text."""
    digest = F.md5(F.concat(F.coalesce(instance.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(drawn * F.lit(span) / F.lit(4294967296)).cast("int") + F.lit(low)


def toggled(flag: Column) -> Column:
    return ~flag


def open_state(flag: Column) -> Column:
    """expanded or collapsed; unknown is collapsed."""
    return F.when(flag, F.lit("expanded")).otherwise(F.lit("collapsed"))


def is_shortcut(key: Column, meta: Column, ctrl: Column, wanted: str = "b") -> Column:
    return F.coalesce((key == wanted) & (F.coalesce(meta, F.lit(False)) | F.coalesce(ctrl, F.lit(False))), F.lit(False))


def arrow_step(key: Column) -> Column:
    """-1 for the left arrow key, 1 for the right one, else null."""
    return F.when(key == "ArrowLeft", F.lit(-1)).when(key == "ArrowRight", F.lit(1))


def variant(table: Column, asked: Column, default: str = "default") -> Column:
    """A variant's entry; the default's where none is asked for; null for an unknown one."""
    return F.try_element_at(table, F.coalesce(asked, F.lit(default)))


def derived_id(base: Column, suffix: str) -> Column:
    return F.concat(base, F.lit(suffix))


def message(error: Column, children: Column) -> Column:
    """The error's message as text where there is an error, else the children; null if that is ''.

    ``error`` is a struct with ``message``; an error without one reads 'undefined'.
    """
    body = F.when(error.isNotNull(), F.coalesce(error["message"].cast("string"), F.lit("undefined"))).otherwise(children)
    return truthy(body)


def own_label(config: Column, label: Column) -> Column:
    """The configured label of a text, else the text."""
    return F.coalesce(truthy(F.try_element_at(config, label)["label"]), label)


def overridden(defaults: Column, overrides: Column) -> Column:
    """Both maps; where both have a key, the override counts, even a null one."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.when(overrides.isNull(), defaults).otherwise(F.map_concat(kept, overrides))


def as_record(text: Column) -> Column:
    """A record whose children are the text; null stays null."""
    return F.when(text.isNotNull(), F.struct(text.alias("children")))


def without_falsy(items: Column) -> Column:
    return F.filter(items, lambda i: F.coalesce(i != "", F.lit(False)))


def element(key: Column, title: Column, description: Column, action: Column) -> Column:
    """What is shown of a record: its key, the parts that it has in their order (a part that counts as false is left out, an action is shown
    whatever it is unless it is null), and the close button."""
    part = lambda name, text: F.struct(F.lit(name).alias("part"), text.alias("text"))
    parts = F.array(part("title", truthy(title)), part("description", truthy(description)), part("action", action), part("close", F.lit("")))
    return F.struct(key.alias("key"), F.filter(parts, lambda p: p["text"].isNotNull()).alias("parts"))
