"""Numeric, array and JSON functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def l2_distance(a: Column, b: Column) -> Column:
    """Of two arrays, in doubles."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two boxes (x, y, width, height)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees of a colour; 0 without saturation."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    raw = (
        F.when(high == r, F.pmod((g - b) / span, F.lit(6.0)))
        .when(high == g, (b - r) / span + 2)
        .otherwise((r - g) / span + 4)
    )
    return F.when(span == 0, 0.0).otherwise(raw * 60)


def circular_difference(a: Column, b: Column, turn: float = 360.0) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(turn) - d)


def replace_values(items: Column, mapping: Column) -> Column:
    """Each element replaced by a map's value if it has one; a null array is empty."""
    known = F.coalesce(items, F.array().cast("array<string>"))
    return F.transform(known, lambda x: F.coalesce(F.try_element_at(mapping, x), x))


def name_index(names: Column, part: str) -> Column:
    """0-based index of the first name that contains `part`, else of the last name."""
    hit = F.array_position(F.transform(names, lambda n: F.contains(F.lower(n), F.lit(part))), F.lit(True))
    return F.when(hit > 0, hit - 1).otherwise(F.size(names) - 1).cast("int")


def chunk_path(episode: Column, size: int) -> Column:
    """The file of an episode when each has its own: chunks of `size` episodes, padded numbers."""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / size).cast("long"), episode.cast("long"))


def rounded(x: Column, places: int) -> Column:
    """A double to decimal places as loops and other engines round it: scaled, rounded half away from zero, scaled back.
    F.round goes by the shortest decimal of the double, which differs next to ties."""
    return F.round(x * 10.0**places) / 10.0**places


def human(n: Column) -> Column:
    """A count with K, M or B. Two places as C and Python print them: by the double's own value, an exact tie to the
    even digit (79125: 79.12K); format_string would round the shortest decimal half up."""
    places = lambda x, unit: F.concat(F.call_function("format_number", x, F.lit("0.00")), F.lit(unit))
    return (
        F.when(n >= 10**9, places(n / 1e9, "B"))
        .when(n >= 10**6, places(n / 1e6, "M"))
        .when(n >= 10**3, places(n / 1e3, "K"))
        .otherwise(n.cast("string"))
    )


def text_list(value: Column, kind: str, ordered: bool = False) -> Column:
    """A list of texts from null, one text or an array of them (`kind` is the column's type); sorted if asked for."""
    empty = F.array().cast("array<string>")
    own = value.cast("array<string>") if kind.startswith("array") else F.when(value.isNotNull(), F.array(value.cast("string")))
    out = F.coalesce(own, empty)
    return F.array_sort(out) if ordered else out


def span_text(count: Column) -> Column:
    """The split of all episodes, as in 0:12."""
    return F.concat(F.lit("0:"), count.cast("string"))


def parse_span(text: Column) -> Column:
    """struct<low, high> of a split such as 0:12; null if it is none."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+)\s*:\s*(\d+)\s*$", i).try_cast("long")
    return F.when(part(2).isNotNull(), F.struct(part(1).alias("low"), part(2).alias("high")))


def suffixed_keys(values: Column, suffix: str) -> Column:
    """A map whose keys all end in `suffix`."""
    return F.transform_keys(values, lambda k, v: F.when(F.endswith(k, F.lit(suffix)), k).otherwise(F.concat(k, F.lit(suffix))))


def data_uri_bytes(text: Column) -> Column:
    """The bytes of base64, with or without a data: head."""
    return F.unbase64(F.when(F.startswith(text, F.lit("data:")), F.substring_index(text, ",", -1)).otherwise(text))


def zipped(names: Column, values: Column) -> Column:
    """A map of two arrays that must be of one length."""
    text = F.concat(F.lit("lengths differ: "), F.size(names).cast("string"), F.lit(" and "), F.size(values).cast("string"))
    return F.when(F.size(names) == F.size(values), F.map_from_arrays(names, values)).otherwise(F.raise_error(text).cast("map<string,double>"))


def only_row(nested: Column) -> Column:
    """The row of an array of one array; others raise."""
    return F.when(F.size(nested) == 1, nested[0]).otherwise(F.raise_error(F.lit("not one row")).cast("array<double>"))


def transposed(nested: Column) -> Column:
    """Rows of equal length turned into columns."""
    places = F.sequence(F.lit(0), F.size(nested[0]) - 1)
    return F.when(F.size(nested) > 0, F.transform(places, lambda i: F.transform(nested, lambda row: F.get(row, i)))).otherwise(nested)


def camera_key(names: Column, prefix: str, wanted: str | None = None) -> Column:
    """The wanted name, which must be there, or the first in order that has the prefix."""
    own = F.array_sort(F.filter(names, lambda n: F.startswith(n, F.lit(prefix))))
    if wanted is None:
        return F.get(own, F.lit(0))
    return F.when(F.array_contains(names, wanted), F.lit(wanted)).otherwise(F.raise_error(F.lit(f"no such key: {wanted}")).cast("string"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct<l, a, b> of an sRGB colour with components to 255, under daylight (D65): lightness to 100, a and b about 0."""
    linear = lambda c: F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92)
    red, green, blue = linear(r), linear(g), linear(b)
    #: Rows of the sRGB matrix divided by the white point.
    x = (0.412453 * red + 0.357580 * green + 0.180423 * blue) / 0.950456
    y = 0.212671 * red + 0.715160 * green + 0.072169 * blue
    z = (0.019334 * red + 0.119193 * green + 0.950227 * blue) / 1.088754
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    lightness = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.struct(lightness.alias("l"), (500 * (root(x) - root(y))).alias("a"), (200 * (root(y) - root(z))).alias("b"))


def chroma_distance(one: Column, other: Column) -> Column:
    """How far the hues of two `lab` colours are apart, whatever their lightness."""
    return F.hypot(one["a"] - other["a"], one["b"] - other["b"])


def luminance_ratio(one: Column, other: Column) -> Column:
    """Of two `lab` lightnesses on a scale to 255, with one added to both."""
    return (one["l"] * 2.55 + 1) / (other["l"] * 2.55 + 1)


def colour_change(one: Column, other: Column, limit: float = 12.0) -> Column:
    """struct<covered, shade>: whether something else is in front (chroma beyond the limit); where not, the factor of
    light between 0.3 and 1.2, else 1."""
    covered = chroma_distance(one, other) > limit
    return F.struct(covered.alias("covered"), F.when(covered, 1.0).otherwise(clamp(luminance_ratio(one, other), 0.3, 1.2)).alias("shade"))
