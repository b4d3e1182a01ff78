"""Label algebra of long rows: choosing, assigning, ordering, joining and comparing along labelled axes.

An axis is a column of labels; the place of a label is its rank among the axis's distinct labels. Labels are few
against rows, so what is joined back is one row per label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwave.operators import frames
from loomwave.operators.sorted_scan import global_rank


def places(df: DataFrame, axis: str, out: str = "place") -> DataFrame:
    """Each label of an axis with its place from 0, in sorted order."""
    return global_rank(df.select(axis).where(F.col(axis).isNotNull()).distinct(), [axis], out)


def select(df: DataFrame, delimiter: str = "-", **chosen: object) -> DataFrame:
    """Rows chosen along axes: a label (whole, else a part between delimiters), a list of labels, a slice of places, or a condition.

    An empty choice gives no rows; axes that are not named stay whole.
    """
    for axis, choice in chosen.items():
        if isinstance(choice, Column):
            df = df.where(choice)
        elif isinstance(choice, (list, tuple)):
            df = df.where(F.col(axis).isin(list(choice)))
        elif isinstance(choice, slice):
            at = places(df, axis, "_place")
            size = at.agg(F.count("*").alias("_size"))
            start, stop, step = choice.start, choice.stop, choice.step or 1
            if step < 1:
                raise ValueError("a slice goes forwards; use take for another order")
            bound = lambda b, default: default if b is None else F.greatest(F.col("_size") + b, F.lit(0)) if b < 0 else F.lit(b)
            low, high = bound(start, F.lit(0)), bound(stop, F.col("_size"))
            kept = at.join(F.broadcast(size)).where((F.col("_place") >= low) & (F.col("_place") < high) & ((F.col("_place") - low) % step == 0))
            df = df.join(kept.select(axis), axis, "left_semi")
        else:
            df = frames.select_label(df, axis, choice, delimiter)
    return df


def assign(df: DataFrame, where: Column, value: str, new: Column) -> DataFrame:
    """df with `value` replaced in the chosen region; a null condition leaves it."""
    return df.withColumn(value, F.when(F.coalesce(where, F.lit(False)), new).otherwise(F.col(value)))


def take(df: DataFrame, axis: str, wanted: list, by: str = "place", out: str = "at") -> DataFrame:
    """Rows of labels in the wanted order, by place (negative from the end) or by label; `out` numbers the wanted ones.

    A label wanted twice comes twice; places beyond the axis are an error, unknown labels give nothing.
    """
    spark = df.sparkSession
    if by == "label":
        kind = dict(df.dtypes)[axis]
        order = spark.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"{out} long, {axis} {kind}")
        return df.join(F.broadcast(order), axis)
    at = places(df, axis, "_place")
    n = at.count()
    if any(not -n <= w < n for w in wanted):
        raise IndexError(f"the axis has {n} labels")
    order = spark.createDataFrame([(i, w % n) for i, w in enumerate(wanted)], f"{out} long, _place long")
    return df.join(at.join(F.broadcast(order), "_place").drop("_place"), axis)


def find(df: DataFrame, axis: str, label: str, delimiter: str = "-") -> DataFrame:
    """place and label of the labels that are `label`, else of those of which one part is; empty where none is."""
    return frames.select_label(places(df, axis), axis, label, delimiter)


def reorder_like(df: DataFrame, axis: str, wanted: DataFrame, out: str = "at") -> DataFrame:
    """Rows whose label stands in `wanted` (columns axis and out), with their place there."""
    return df.join(wanted.select(axis, out), axis)


def concatenate_positional(sources: list[DataFrame], axis: str, others: list[str], value: str) -> DataFrame:
    """Arrays one after another along an axis of places, the other axes' places aligned from 0; missing cells are null.

    Sources are long rows whose axes are places; empty ones add nothing. Axes' sizes are one row per source.
    """
    axes = [axis, *others]
    shapes = [s.agg(*((F.max(a) + 1).alias(a) for a in axes)).first() for s in sources]  # one row per source
    kept = [(s, shape) for s, shape in zip(sources, shapes) if shape[axis] is not None]
    if not kept:
        return sources[0].select(*axes, value)
    size = {o: max(shape[o] for _, shape in kept) for o in others}
    offset, moved = 0, []
    for s, shape in kept:
        moved.append(s.select((F.col(axis) + offset).alias(axis), *others, value))
        offset += shape[axis]
    grid = sources[0].sparkSession.range(offset).select(F.col("id").alias(axis))
    for o in others:
        grid = grid.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size[o] - 1).cast("long"))))
    return grid.join(reduce(DataFrame.unionByName, moved), axes, "left")


def stack(sources: dict[str, DataFrame], new_axis: str) -> DataFrame:
    """Sources under a new axis of their names; where an axis is longer in one, the others have no rows there."""
    return reduce(DataFrame.unionByName, (s.withColumn(new_axis, F.lit(name)) for name, s in sources.items()))


def equal(a: DataFrame, b: DataFrame, axes: list[str], value: str) -> DataFrame:
    """One row: whether two arrays have the same labels and the same values, missing ones counting as alike."""
    sides = [df.select(*axes, F.col(value).alias(f"_{n}"), F.lit(True).alias(f"_has_{n}")) for n, df in (("a", a), ("b", b))]
    both = sides[0].join(sides[1], axes, "full")
    same = F.col("_has_a").isNotNull() & F.col("_has_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(F.coalesce(F.min(same), F.lit(True)).alias("equal"))


def outer_labels(a: DataFrame, b: DataFrame, first: str, second: str, out: str, delimiter: str = "-") -> DataFrame:
    """Every label of one axis joined with every label of another. Both are axes of one array, whose cells they number."""
    return a.select(first).distinct().crossJoin(b.select(second).distinct()).withColumn(out, F.concat_ws(delimiter, first, second))


def joined_labels(parts: list[str], delimiter: str = "") -> Column:
    """A row's labels as one text; nulls are left out."""
    return F.concat_ws(delimiter, *parts)


def transpose(values: str) -> Column:
    """A matrix (array of rows of one length) with rows and columns exchanged."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(values, F.lit(0))) - 1, F.lit(0))), lambda j: F.transform(values, lambda row: F.get(row, j)))


def flatten_once(values: str) -> Column:
    """One level of nesting less."""
    return F.flatten(values)


def broadcastable(first: str, second: str) -> Column:
    """Whether two shapes (arrays of sizes) fit: the shorter is continued by ones, and sizes are equal or one is one."""
    pairs = F.zip_with(first, second, lambda a, b: F.struct(F.coalesce(a, F.lit(1)).alias("a"), F.coalesce(b, F.lit(1)).alias("b")))
    return F.forall(pairs, lambda p: (p["a"] == 1) | (p["b"] == 1) | (p["a"] == p["b"]))


def ordered_union(first: str, second: str) -> Column:
    """The first list, then what the second has beside it, in the order in which it is first seen."""
    return F.array_union(first, second)


def shank_numbers(contact: str, shank: str) -> Column:
    """The number of a contact's shank: it grows where a contact is numbered one. Needs `shank`, a running sum of first contacts."""
    return F.when(F.col(contact).isNotNull(), F.col(shank))


def round_up(c: Column, step: float = 1.0) -> Column:
    """The least multiple of step that is not smaller."""
    return F.ceil(F.round(c / step, 9)) * step


def fractional(c: Column) -> Column:
    """What follows the point, with the sign of the number."""
    return c - c.cast("long")


def decompose(labels: str, delimiter: str = "-") -> Column:
    """The parts that all labels of a list share, in the order of the first."""
    split = F.transform(labels, lambda x: F.split(x, F.lit(f"\\Q{delimiter}\\E")))
    return F.aggregate(F.slice(split, 2, F.greatest(F.size(split), F.lit(1))), F.get(split, F.lit(0)), lambda a, b: F.array_intersect(a, b))


def common_over(df: DataFrame, channel: str, trial: str, value: str) -> DataFrame:
    """Rows of the trials that every channel has with a value."""
    channels = df.select(channel).distinct().agg(F.count("*").alias("_n"))
    having = df.where(F.col(value).isNotNull()).groupBy(trial).agg(F.count_distinct(channel).alias("_k"))
    return df.join(having.join(F.broadcast(channels)).where("_k = _n").select(trial), trial, "left_semi")


def grey_matter(df: DataFrame, label: str, words: tuple[str, ...]) -> DataFrame:
    """Rows whose anatomical label holds none of the words of places without grey matter; a null label is none."""
    out = df.where(F.col(label).isNotNull())
    for w in words:
        out = out.where(~F.col(label).contains(w))
    return out


def in_region(df: DataFrame, label: str, regions: list[str]) -> DataFrame:
    """Rows whose label contains one of the regions, whatever its case."""
    found = F.lit(False)
    for r in regions:
        found = found | F.lower(label).contains(r.lower())
    return df.where(found)


def padded_pool(df: DataFrame, token: str, source: str, rank: str, value: str) -> DataFrame:
    """Ranked repeats of every source brought to the most that any source of the token has; what is missing is zero."""
    most = df.groupBy(token).agg(F.max(rank).alias("_most"))
    grid = df.select(token, source).distinct().join(most, token).withColumn(rank, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most")))).drop("_most")
    return grid.join(df.select(token, source, rank, value), [token, source, rank], "left").fillna(0, [value])
