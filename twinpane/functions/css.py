"""CSS values: colours, equality with tolerance, canonical forms, gradients."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .arrays import let
from .text import ascii_lower, collapse_whitespace

EPSILON = 0.1
COLOR_PROPERTIES = ["color", "background-color", "border-color"]
#: The named colours of the CSS standard (fixed values).
NAMED_HEX = """
aliceblue f0f8ff
antiquewhite faebd7
aqua 00ffff
aquamarine 7fffd4
azure f0ffff
beige f5f5dc
bisque ffe4c4
black 000000
blanchedalmond ffebcd
blue 0000ff
blueviolet 8a2be2
brown a52a2a
burlywood deb887
cadetblue 5f9ea0
chartreuse 7fff00
chocolate d2691e
coral ff7f50
cornflowerblue 6495ed
cornsilk fff8dc
crimson dc143c
cyan 00ffff
darkblue 00008b
darkcyan 008b8b
darkgoldenrod b8860b
darkgray a9a9a9
darkgreen 006400
darkgrey a9a9a9
darkkhaki bdb76b
darkmagenta 8b008b
darkolivegreen 556b2f
darkorange ff8c00
darkorchid 9932cc
darkred 8b0000
darksalmon e9967a
darkseagreen 8fbc8f
darkslateblue 483d8b
darkslategray 2f4f4f
darkslategrey 2f4f4f
darkturquoise 00ced1
darkviolet 9400d3
deeppink ff1493
deepskyblue 00bfff
dimgray 696969
dimgrey 696969
dodgerblue 1e90ff
firebrick b22222
floralwhite fffaf0
forestgreen 228b22
fuchsia ff00ff
gainsboro dcdcdc
ghostwhite f8f8ff
gold ffd700
goldenrod daa520
gray 808080
green 008000
greenyellow adff2f
grey 808080
honeydew f0fff0
hotpink ff69b4
indianred cd5c5c
indigo 4b0082
ivory fffff0
khaki f0e68c
lavender e6e6fa
lavenderblush fff0f5
lawngreen 7cfc00
lemonchiffon fffacd
lightblue add8e6
lightcoral f08080
lightcyan e0ffff
lightgoldenrodyellow fafad2
lightgray d3d3d3
lightgreen 90ee90
lightgrey d3d3d3
lightpink ffb6c1
lightsalmon ffa07a
lightseagreen 20b2aa
lightskyblue 87cefa
lightslategray 778899
lightslategrey 778899
lightsteelblue b0c4de
lightyellow ffffe0
lime 00ff00
limegreen 32cd32
linen faf0e6
magenta ff00ff
maroon 800000
mediumaquamarine 66cdaa
mediumblue 0000cd
mediumorchid ba55d3
mediumpurple 9370db
mediumseagreen 3cb371
mediumslateblue 7b68ee
mediumspringgreen 00fa9a
mediumturquoise 48d1cc
mediumvioletred c71585
midnightblue 191970
mintcream f5fffa
mistyrose ffe4e1
moccasin ffe4b5
navajowhite ffdead
navy 000080
oldlace fdf5e6
olive 808000
olivedrab 6b8e23
orange ffa500
orangered ff4500
orchid da70d6
palegoldenrod eee8aa
palegreen 98fb98
paleturquoise afeeee
palevioletred db7093
papayawhip ffefd5
peachpuff ffdab9
peru cd853f
pink ffc0cb
plum dda0dd
powderblue b0e0e6
purple 800080
rebeccapurple 663399
red ff0000
rosybrown bc8f8f
royalblue 4169e1
saddlebrown 8b4513
salmon fa8072
sandybrown f4a460
seagreen 2e8b57
seashell fff5ee
sienna a0522d
silver c0c0c0
skyblue 87ceeb
slateblue 6a5acd
slategray 708090
slategrey 708090
snow fffafa
springgreen 00ff7f
steelblue 4682b4
tan d2b48c
teal 008080
thistle d8bfd8
tomato ff6347
turquoise 40e0d0
violet ee82ee
wheat f5deb3
white ffffff
whitesmoke f5f5f5
yellow ffff00
yellowgreen 9acd32
"""
NAMED = {name: tuple(bytes.fromhex(code)) for name, code in (line.split() for line in NAMED_HEX.split("\n") if line)}
_NAMES = json.dumps({k: f"rgb({r}, {g}, {b})" for k, (r, g, b) in NAMED.items()})
_NUMBER = "([+-]?[0-9]*\\.?[0-9]+)"


def _rgb(r: Column, g: Column, b: Column, a: Column) -> Column:
    whole = F.concat_ws(", ", r.cast("int").cast("string"), g.cast("int").cast("string"), b.cast("int").cast("string"))
    alpha = F.regexp_replace(F.round(a, 3).cast("decimal(4,3)").cast("string"), "\\.?0+$", "")
    return F.when(a == 1, F.concat(F.lit("rgb("), whole, F.lit(")"))).otherwise(F.concat(F.lit("rgba("), whole, F.lit(", "), F.when(alpha == "", "0").otherwise(alpha), F.lit(")")))


def normalize_color(c: Column) -> Column:
    """rgb(), rgba(), #rgb, #rrggbb, #rrggbbaa and names become rgb() or rgba(); anything else stays."""

    def of(v):
        numbers = F.regexp_extract_all(v, F.lit("([0-9]*\\.?[0-9]+)"), F.lit(1))
        n = lambda i: F.get(numbers, F.lit(i)).cast("double")
        long = F.when(F.length(v) == 4, F.regexp_replace(v, "([0-9a-f])", "$1$1")).otherwise(v)
        x = lambda i: F.conv(F.substring(long, 2 + 2 * i, 2), 16, 10).cast("double")
        return (
            F.when(v.rlike("^rgba?\\([^a-z%]*\\)$") & F.size(numbers).isin(3, 4), _rgb(n(0), n(1), n(2), F.coalesce(n(3), F.lit(1.0))))
            .when(v.rlike("^#([0-9a-f]{3}|[0-9a-f]{6})$"), _rgb(x(0), x(1), x(2), F.lit(1.0)))
            .when(v.rlike("^#[0-9a-f]{8}$"), _rgb(x(0), x(1), x(2), x(3) / 255))
            .when(v == "transparent", "rgba(0, 0, 0, 0)")
            .otherwise(F.coalesce(F.try_element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), v), c))
        )

    return let(ascii_lower(F.trim(c)), of)


def quoted(c: Column) -> Column:
    """A regular expression that finds the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def normalize_url_origins(c: Column, page: Column) -> Column:
    """url(...) on the page's own host without its origin, then without the page's directory."""
    place = urls.page_dir(page)
    own = F.concat(F.lit("(?i)(url\\(\\s*[\"']?)https?://"), quoted(urls.authority(page)), F.lit("(?=/)"))
    bare = F.regexp_replace(c, own, F.lit("$1"))
    below = F.concat(F.lit("(?i)(url\\(\\s*[\"']?)"), quoted(place), F.lit("(?!/)"))
    return F.when(c.rlike("(?i)url\\("), F.regexp_replace(bare, below, F.lit("$1"))).otherwise(c)


def normalize_value(prop: Column, c: Column, page: Column | None = None) -> Column:
    """Whitespace, colours and, if the page is given, the origins in url()."""
    v = let(collapse_whitespace(c), lambda x: F.when(prop.isin(*COLOR_PROPERTIES), normalize_color(x)).otherwise(x))
    return v if page is None else let(v, lambda x: normalize_url_origins(x, page))


_URL = "(?i)url\\(\\s*[\"']?[^\"')?#]*?([^\"')?#/]*)(?:[?#][^\"')]*)?[\"']?\\s*\\)"


def same_file(a: Column, b: Column) -> Column:
    """The same but for the folders of url(): file names alike, on different hosts, one of which is named."""
    form = lambda c: F.regexp_replace(c, _URL, "url($1)")
    first = lambda c: ascii_lower(F.regexp_extract(c, "(?i)url\\(\\s*[\"']?[a-z][a-z0-9+.-]*://(?:[^/?#@\"')]*@)?([^/?#:\"')]+)", 1))
    return ((first(a) != "") | (first(b) != "")) & (first(a) != first(b)) & (form(a) == form(b))


def differs(prop: Column, old: Column, new: Column, old_page: Column, new_page: Column, old_size: Column, new_size: Column) -> Column:
    """Do two values of a property differ after all tolerances?"""
    same = lambda v: values_equal(v["a"], v["b"])
    canon = lambda v: F.struct(canonical(prop, v["a"], old_size).alias("a"), canonical(prop, v["b"], new_size).alias("b"))
    far = lambda v: ~same(v) & ~same_file(v["a"], v["b"]) & ~let(canon(v), same)
    return F.when(old == new, False).otherwise(let(F.struct(normalize_value(prop, old, old_page).alias("a"), normalize_value(prop, new, new_page).alias("b")), far))


def values_equal(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """The same but for numbers that differ by less than epsilon; units and all else must be the same."""
    skeleton = lambda c: F.regexp_replace(c, "[0-9]*\\.?[0-9]+", "#")
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("([0-9]*\\.?[0-9]+)"), F.lit(1)), lambda x: x.cast("double"))
    near = F.forall(F.zip_with(numbers(a), numbers(b), lambda x, y: F.abs(x - y) < epsilon), lambda x: x)
    return (a == b) | ((skeleton(a) == skeleton(b)) & near)


def canonical(prop: Column, c: Column, font_size: Column) -> Column:
    """Forms that mean the same: no border or outline, text-align by side, normal line height, content without its quotes."""
    size = F.regexp_extract(font_size, f"^{_NUMBER}px$", 1)
    height = F.concat(F.regexp_replace(F.round(F.try_to_number(size, F.lit("99999.9999")).cast("double") * 1.2, 4).cast("string"), "\\.0$", ""), F.lit("px"))
    return (
        F.when(prop.rlike("^(border|outline)") & c.rlike("(^|\\s)none(\\s|$)"), "none")
        .when(prop == "content", F.regexp_replace(F.trim(c), "(?s)^(['\"])(.*)\\1$", "$2"))
        .when((prop == "text-align") & (c == "start"), "left")
        .when((prop == "text-align") & (c == "end"), "right")
        .when((prop == "line-height") & (c == "normal") & (size != ""), height)
        .otherwise(c)
    )


def style_change_type(prop: Column, old: Column, new: Column) -> Column:
    """What a difference of a property is called."""
    gradient = lambda c: c.rlike("gradient\\(")
    background = (prop == "background-image") & gradient(old)
    return F.when(background & (new == "none"), "background_gradient_lost").when(background & gradient(new), "background_gradient_changed").otherwise("style_changed")


_KINDS = re.compile(r"^((?:repeating-)?(?:linear|radial|conic)-gradient)\((.*)\)$", re.S)
GRADIENTS = "array<struct<kind:string,angle:string,stops:array<string>,raw:string>>"


def split_top(value: str) -> list[str]:
    """Parts between commas that stand in no parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(value):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(value[start:i].strip())
            start = i + 1
    return [*parts, value[start:].strip()]


def parse_gradients(value: str | None) -> list[dict] | None:
    """Every layer: kind, angle or direction, stops; a layer that isn't a gradient has only its raw text."""
    if value is None:
        return None
    out = []
    for layer in split_top(value):
        m = _KINDS.match(layer)
        balanced = layer.count("(") == layer.count(")")
        if not (m and balanced):
            out.append({"kind": None, "angle": None, "stops": [], "raw": layer})
            continue
        parts = split_top(m[2])
        led = bool(re.match(r"(to |from |at |circle|ellipse|closest|farthest|[+-]?[\d.]+(deg|rad|turn|grad)\b)", parts[0]))
        out.append({"kind": m[1], "angle": parts[0] if led else None, "stops": parts[led:], "raw": layer})
    return out


def _parse_all(values: pd.Series) -> pd.Series:
    return values.map(lambda v: parse_gradients(v if isinstance(v, str) else None))


def gradients(c: Column | str) -> Column:
    """Parsed layers; parentheses need a scanner, so this one runs in Python, over Arrow batches."""
    return F.pandas_udf(_parse_all, GRADIENTS)(c)
