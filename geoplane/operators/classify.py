"""Classification and styling (CLS-1..8).

Class tables are tiny (<= 20 classes, <= 50 categories), so they are built
from one aggregate on the driver and applied to the features either as a
``CASE`` chain (step) or a broadcast left join (match) -- both bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_numeric
from . import profile as PF

# Default (unmatched) colour, category cap, class count bounds and default,
# single-style fill colour.
DEFAULT_COLOR = "#cccccc"
MAX_CATEGORIES = 50
MIN_CLASSES, MAX_CLASSES, DEFAULT_CLASSES = 2, 20, 5
DEFAULT_FILL_COLOR = "#1B4F72"

# The seven named colour palettes (ColorBrewer-inspired).
PALETTES = {
    "blues": ["#eff3ff", "#bdd7e7", "#6baed6", "#3182bd", "#08519c"],
    "greens": ["#edf8e9", "#bae4b3", "#74c476", "#31a354", "#006d2c"],
    "reds": ["#fee5d9", "#fcae91", "#fb6a4a", "#de2d26", "#a50f15"],
    "oranges": ["#feedde", "#fdbe85", "#fd8d3c", "#e6550d", "#a63603"],
    "purples": ["#f2f0f7", "#cbc9e2", "#9e9ac8", "#756bb1", "#54278f"],
    "spectral": ["#d53e4f", "#fc8d59", "#fee08b", "#e6f598", "#99d594", "#3288bd"],
    "qualitative": ["#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00",
                    "#ffff33", "#a65628", "#f781bf", "#999999", "#66c2a5"],
}


def _field(df: DataFrame, field: str):
    for f in df.schema.fields:
        if f.name == field:
            return f
    raise ValueError(f"Column '{field}' not found")


def clamp_classes(classes) -> int:
    """2..20, default 5 (junk or 0 -> 5)."""
    try:
        n = int(classes)
    except (TypeError, ValueError):
        n = 0
    n = n or DEFAULT_CLASSES
    return min(max(n, MIN_CLASSES), MAX_CLASSES)


# ---------------------------------------------------------------- CLS-1
def categorized(df: DataFrame, field: str) -> DataFrame:
    """CLS-1: up to 50 distinct non-null values, ascending."""
    _field(df, field)
    return PF.distinct_values(df, field, MAX_CATEGORIES)


# ---------------------------------------------------------------- CLS-2, CLS-3
def graduated(df: DataFrame, field: str, classes=DEFAULT_CLASSES, method: str = "quantile",
              exact: bool = True) -> list[dict]:
    """CLS-2 (quantile) / CLS-3 (equal interval): [{class_index, min, max}, ...].

    Class i spans [previous break, break i]; the first min is the column
    minimum and the last max the column maximum.
    """
    f = _field(df, field)
    if not is_numeric(f.dataType):
        raise ValueError(f"Column '{field}' is not numeric (type: {f.dataType.simpleString()})")
    n = clamp_classes(classes)
    v = F.col(f"`{field}`").cast("double")
    rng = df.agg(F.min(v).alias("min"), F.max(v).alias("max"),
                 F.count_if(v.isNotNull() & ~F.isnan(v)).alias("n")).first()        # one aggregate row
    lo, hi = rng["min"], rng["max"]
    if lo is None:
        return []
    if method == "equal_interval":
        breaks = [lo + (i + 1) * (hi - lo) / n for i in range(n - 1)]
    else:
        breaks = PF.quantile_breaks(df, field, n, exact=exact, n=int(rng["n"]))
    out, prev = [], lo
    for i in range(n):
        nxt = breaks[i] if i < n - 1 else hi
        out.append({"class_index": i, "min": prev, "max": nxt})
        prev = nxt
    return out


# ---------------------------------------------------------------- CLS-6
def interpolate_palette(palette, count: int) -> list[str]:
    """CLS-6: ``count`` colours at even steps over the palette.

    A palette that is long enough gives its nearest stops (its middle stop for
    a single colour); a shorter one is interpolated per RGB channel.
    """
    stops = PALETTES[palette] if isinstance(palette, str) else palette
    if count <= 0:
        return []
    at = np.linspace(0, len(stops) - 1, count) if count > 1 else np.array([len(stops) // 2])
    if count <= len(stops):
        return [stops[i] for i in np.floor(at + 0.5).astype(int)]
    rgb = np.array([list(bytes.fromhex(s.lstrip("#"))) for s in stops], dtype=float)
    channels = [np.interp(at, np.arange(len(stops)), rgb[:, c]) for c in range(3)]
    return ["#" + bytes(row).hex() for row in np.floor(np.stack(channels, axis=1) + 0.5).astype(np.uint8)]


def with_colors(classes: list[dict], palette: str = "blues") -> list[dict]:
    cols = interpolate_palette(palette, len(classes))
    return [{**c, "color": col} for c, col in zip(classes, cols)]


# ---------------------------------------------------------------- CLS-4, CLS-5, CLS-8
def style_categorized(df: DataFrame, field: str, categories: DataFrame, default: str = DEFAULT_COLOR) -> DataFrame:
    """CLS-4 ``match``: compare the *text* of the value to each category value; no match / null -> default.

    ``categories`` (value, color) is broadcast when it is counted to hold at most
    ``MAX_CATEGORIES`` rows; a longer table is joined as Catalyst chooses.
    """
    cats = categories.select(F.col("value").cast("string").alias("__cv"), F.col("color").alias("__cc"))
    few = cats.limit(MAX_CATEGORIES + 1).count() <= MAX_CATEGORIES
    out = df.join(F.broadcast(cats) if few else cats, F.col(f"`{field}`").cast("string") == F.col("__cv"), "left")
    return out.withColumn("color", F.coalesce(F.col("__cc"), F.lit(default))).drop("__cv", "__cc")


def step_class(value: Column, classes: list[dict]) -> Column:
    """CLS-5 ``step``: index of the last class whose min <= value; below the first min -> null."""
    expr = None
    for c in sorted(classes, key=lambda c: c["class_index"], reverse=True):
        cond = value >= F.lit(float(c["min"]))
        expr = F.when(cond, F.lit(c["class_index"])) if expr is None else expr.when(cond, F.lit(c["class_index"]))
    return expr if expr is not None else F.lit(None).cast("int")


def style_graduated(df: DataFrame, field: str, classes: list[dict], default: str = DEFAULT_COLOR) -> DataFrame:
    """CLS-8: features + class index + colour (``classes`` carry colours, see :func:`with_colors`)."""
    v = F.col(f"`{field}`").cast("double")
    idx = step_class(v, classes)
    colors = F.array(*[F.lit(c["color"]) for c in sorted(classes, key=lambda c: c["class_index"])])
    return df.withColumn("class_index", idx).withColumn(
        "color", F.coalesce(F.get(colors, F.col("class_index")), F.lit(default)))


# ---------------------------------------------------------------- CLS-7
def legend(classes: list[dict]) -> list[dict]:
    """CLS-7: one row per class with label ``min – max`` (2 decimals) and colour."""
    return [{"class_index": c["class_index"], "label": f"{c['min']:.2f} – {c['max']:.2f}",
             "color": c.get("color")} for c in classes]


def legend_frame(spark, classes: list[dict]) -> DataFrame:
    """CLS-7: the legend of graduated classes as rows (kind, position, label, color)."""
    rows = [("class", int(r["class_index"]), r["label"], r["color"]) for r in legend(classes)]       # at most 20
    return spark.createDataFrame(rows, "kind string, position int, label string, color string")


def category_legend(categories: DataFrame) -> DataFrame:
    """CLS-7: the legend of categories (value, color; at most 50): one row each in value order, labelled by its text."""
    from pyspark.sql import Window
    position = F.row_number().over(Window.orderBy("value")) - 1
    return categories.select(F.lit("category").alias("kind"), position.alias("position"),
                             F.col("value").cast("string").alias("label"), "color")
