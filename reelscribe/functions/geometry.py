"""Column functions on boxes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BAND_HEIGHT, GREEN_LEAD, WHITE_FLOOR


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def band(y: Column) -> Column:
    return half_up(y / BAND_HEIGHT)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def valid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return finite(x) & finite(y) & finite(w) & finite(h) & (w > 0) & (h > 0)


def containment(a: str, b: str) -> Column:
    """Overlap of two boxes (struct columns x, gy, w, h) as a share of the smaller; 0 for an empty one."""
    def at(name: str, field: str) -> Column:
        return F.col(f"{name}.{field}")

    wide = F.least(at(a, "x") + at(a, "w"), at(b, "x") + at(b, "w")) - F.greatest(at(a, "x"), at(b, "x"))
    high = F.least(at(a, "gy") + at(a, "h"), at(b, "gy") + at(b, "h")) - F.greatest(at(a, "gy"), at(b, "gy"))
    area = F.least(at(a, "w") * at(a, "h"), at(b, "w") * at(b, "h"))
    return F.when(area == 0, F.lit(0.0)).otherwise(F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0)) / area)


def rgb_channels(colour: Column, kind: T.DataType) -> list[Column]:
    """The channels r, g, b as doubles of a colour column of type ``kind``: an array, a map or struct with the fields r, g, b, or
    JSON text of either form. A channel that is missing, null or no number is null, as are all of a null colour or malformed text."""
    if isinstance(kind, T.ArrayType):
        found = [F.get(colour, F.lit(i)) for i in range(3)]
    elif isinstance(kind, T.MapType):
        found = [F.try_element_at(colour, F.lit(c)) for c in "rgb"]
    elif isinstance(kind, T.StructType):
        found = [colour[c] if c in kind.names else F.lit(None) for c in "rgb"]
    elif isinstance(kind, T.StringType):
        found = [F.coalesce(F.get_json_object(colour, f"$[{i}]"), F.get_json_object(colour, f"$.{c}")) for i, c in enumerate("rgb")]
    else:
        raise TypeError(f"no colour: {kind.simpleString()}")
    return [c.try_cast("double") for c in found]


def bubble_colour(r: Column, g: Column, b: Column, white: float = WHITE_FLOOR) -> Column:
    """self for green, other for near white, system for the rest and for what is no number."""
    known = finite(r) & finite(g) & finite(b)
    return (
        F.when(known & (g - b > GREEN_LEAD), "self")
        .when(known & (r > white) & (g > white) & (b > white), "other")
        .otherwise("system")
    )
