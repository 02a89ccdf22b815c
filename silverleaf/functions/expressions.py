"""Column expressions: geometry of quads and lines, colour, boxes, dates and lenient JSON, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_white(r: Column, g: Column, b: Column, floor: int = 170, spread: float = 25.0) -> Column:
    """White reference: all channels above ``floor`` and a population deviation between channels under ``spread``."""
    m = (r + g + b) / 3.0
    var = ((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3.0
    return (r > floor) & (g > floor) & (b > floor) & (F.sqrt(var) < spread)


def rounded(c: Column | str, n: int) -> Column:
    """Rounded to ``n`` places as SQL engines on binary doubles do: the scaled number, halves away from zero; zero has no sign."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    a = F.abs(c) * 10.0**n
    whole = F.floor(a).cast("double")
    up = whole + F.when(a - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(a < 2.0**52, F.when(c < 0, -up).otherwise(up) / 10.0**n + 0.0).otherwise(c)


def inside_quad(x: Column, y: Column, v: Column) -> Column:
    """Point in a convex quad of either orientation, edges included."""
    cross = [(v[(i + 1) % 4]["x"] - v[i]["x"]) * (y - v[i]["y"]) - (v[(i + 1) % 4]["y"] - v[i]["y"]) * (x - v[i]["x"]) for i in range(4)]
    return (F.least(*cross) >= 0) | (F.greatest(*cross) <= 0)


def shrink_quad(v: Column, f: float) -> Column:
    """Every corner moved toward the centroid by the share ``f``."""
    cx, cy = sum(v[i]["x"] for i in range(4)) / 4.0, sum(v[i]["y"] for i in range(4)) / 4.0
    return F.transform(v, lambda p: F.struct((p["x"] + (cx - p["x"]) * f).alias("x"), (p["y"] + (cy - p["y"]) * f).alias("y")))


def grow_quad(v: Column, margin: float = 5.0) -> Column:
    """Every corner (TL, TR, BR, BL) moved outward by ``margin`` on both axes, truncated to whole numbers."""
    cut = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    sides = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[F.struct(cut(v[i]["x"] + sx * margin).alias("x"), cut(v[i]["y"] + sy * margin).alias("y")) for i, (sx, sy) in enumerate(sides)])


def blend(c: Column, mask: Column, value: Column, alpha: float = 0.45) -> Column:
    """Channel mixed with ``value`` where the mask is set, truncated."""
    return F.when(mask, F.floor(c * (1.0 - alpha) + value * alpha).cast("int")).otherwise(c)


#: Colours of items, by index.
PALETTE = ((0, 255, 0), (255, 0, 0), (0, 170, 255), (255, 0, 255), (255, 220, 0))


def palette(index: Column) -> Column:
    """array(r, g, b) of a 1-based index, cyclic."""
    return F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in PALETTE]), (F.pmod(index - 1, F.lit(len(PALETTE))) + 1).cast("int"))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L scaled to 0..255, a and b moved by 128, as doubles (sRGB primaries, D65 white)."""

    def linear(c):
        c = c / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def bend(t):
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    r, g, b = linear(r), linear(g), linear(b)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return light * 255.0 / 100.0, 500.0 * (bend(x) - bend(y)) + 128.0, 200.0 * (bend(y) - bend(z)) + 128.0


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The reverse of ``rgb_to_lab``, as doubles in 0..255."""
    light = light * 100.0 / 255.0
    fy = F.when(light > 7.9996, (light + 16.0) / 116.0).otherwise(7.787 * (light / 903.3) + 16.0 / 116.0)
    y = F.when(light > 7.9996, fy * fy * fy).otherwise(light / 903.3)
    back = lambda f: F.when(f > 0.206893, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    x, z = back(fy + (a - 128.0) / 500.0) * 0.950456, back(fy - (b - 128.0) / 200.0) * 1.088754

    def curve(c):
        c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
        return 255.0 * F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1.0 / 2.4)) - 0.055).otherwise(12.92 * c)

    return (curve(3.240479 * x - 1.537150 * y - 0.498535 * z), curve(-0.969256 * x + 1.875991 * y + 0.041556 * z), curve(0.055648 * x - 0.204043 * y + 1.057311 * z))


def build_request(url: Column, model: str, prompt: str, max_tokens: int = 1024, thinking_budget: int = 0) -> Column:
    """JSON body of a chat request with one image; the thinking budget is sent only if it is positive."""
    image = F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url"), F.lit(65536).alias("min_pixels"), F.lit(2621440).alias("max_pixels"))
    system = F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.array(image).alias("content"))
    extra = [F.lit(thinking_budget > 0).alias("enable_thinking")] + ([F.lit(thinking_budget).alias("thinking_budget")] if thinking_budget > 0 else [])
    messages = F.concat(F.lit("["), F.to_json(system), F.lit(","), F.to_json(user), F.lit("]"))
    tail = F.to_json(F.struct(F.lit(max_tokens).alias("max_tokens"), *extra))
    head = F.to_json(F.struct(F.lit(model).alias("model")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":'), messages, F.lit(","), F.substring(tail, F.lit(2), F.length(tail)))


def rectify_quality(v: Column, aspect: float = 1.35) -> Column:
    """Product of opposite side ratios and of the closeness of the mean aspect to ``aspect``."""
    side = lambda a, b: F.sqrt(F.pow(v[a]["x"] - v[b]["x"], 2) + F.pow(v[a]["y"] - v[b]["y"], 2))
    top, right, bottom, left = side(0, 1), side(1, 2), side(2, 3), side(3, 0)
    ratio = lambda a, b: F.try_divide(F.least(a, b), F.greatest(a, b))
    shape = F.try_divide((left + right) / 2.0, (top + bottom) / 2.0)
    return ratio(top, bottom) * ratio(left, right) * ratio(shape, F.lit(aspect))


def corner_deviation(v: Column, template: list[tuple[float, float]]) -> tuple[Column, Column]:
    """(largest, mean) distance of corners from the template's."""
    d = [F.sqrt(F.pow(v[i]["x"] - x, 2) + F.pow(v[i]["y"] - y, 2)) for i, (x, y) in enumerate(template)]
    return F.greatest(*d), sum(d) / 4.0


def line_from_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(orient, m, b): y = m x + b for 'h', x = m y + b for 'v'; by the larger difference."""
    dx, dy = x2 - x1, y2 - y1
    flat = F.abs(dx) > F.abs(dy)
    m = F.when(flat, F.try_divide(dy, dx)).otherwise(F.coalesce(F.try_divide(dx, dy), F.lit(0.0)))
    return F.struct(F.when(flat, "h").otherwise("v").alias("orient"), m.alias("m"), F.when(flat, y1 - m * x1).otherwise(x1 - m * y1).alias("b"))


def intersect_lines(mh: Column, bh: Column, mv: Column, bv: Column) -> Column:
    """Point where y = mh x + bh meets x = mv y + bv; null if they are near parallel."""
    det = 1.0 - mv * mh
    x = F.try_divide(mv * bh + bv, det)
    return F.when(F.abs(det) >= 1e-9, F.struct(x.alias("x"), (mh * x + bh).alias("y")))


def scale_box(box: Column, width: Column, height: Column, norm: float = 1000.0) -> Column:
    """Box in [0, norm] to pixels: low corners floored, high corners raised and clamped."""
    low = lambda c, n: F.floor(c / norm * n).cast("int")
    high = lambda c, n: F.least(n, F.ceil(c / norm * n)).cast("int")
    return F.array(low(box[0], width), low(box[1], height), high(box[2], width), high(box[3], height))


def apply_gain(c: Column, gain: Column) -> Column:
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c * gain))).cast("int")


def data_url(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def canonical_query(url: Column) -> Column:
    """Query string with RFC 3986 escapes and sorted parameters."""
    escape = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(url, "?", -1)).otherwise("")
    part = lambda p: F.concat(escape(F.substring_index(p, "=", 1)), F.lit("="), escape(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")))
    return F.array_join(F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), part)), "&")


#: White space at either end, as Unicode has it, and the separators U+001C to U+001F. A run inside a text is passed over once: nothing in it is a start.
EDGE_BLANKS = "(?U)^[\\s\\x1c-\\x1f]++|(?<![\\s\\x1c-\\x1f])[\\s\\x1c-\\x1f]++\\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_BLANKS, "")


def clean_json(text: Column) -> Column:
    """Text without outer white space, control characters as blanks, so that strings that hold them can be parsed."""
    return F.regexp_replace(strip(text), "[\\x00-\\x1f]", " ")


def between_braces(text: Column) -> Column:
    """From the first '{' to the last '}'; null if one is missing."""
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.substring(text, F.instr(text, "{"), F.greatest(last - F.instr(text, "{") + 1, F.lit(0)))
    return F.when((F.instr(text, "{") > 0) & (F.instr(text, "}") > 0), inner)


def parse_object(clean: Column) -> Column:
    """The JSON object in a clean text: the text itself or, if it is no JSON, from its first '{' to its last '}'; null if there is none."""
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(between_braces(clean)))


def normalize_date(t: Column) -> Column:
    """YYYY.MM.DD or MM.DD (leap day allowed) that is a date, else null; ``t`` without outer white space."""
    full = t.rlike("^[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}$") & ~t.startswith("0000") & F.try_to_date(t, "yyyy.MM.dd").isNotNull()
    short = t.rlike("^[0-9]{2}\\.[0-9]{2}$") & F.try_to_date(F.concat(F.lit("2000."), t), "yyyy.MM.dd").isNotNull()
    return F.when(full | short, t)


def round_half_even(c: Column, digits: int) -> Column:
    """Rounded to ``digits``, halves to the even neighbour, as report fields are."""
    return F.bround(c, digits)
