"""Column expressions over boxes. Coordinates start at 0 in the top left corner and are inclusive."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX_COLUMNS = ("box_left", "box_top", "box_right", "box_bottom")
BOX_TYPE = "struct<box_left:int,box_top:int,box_right:int,box_bottom:int>"

# Pixels of slack per edge, and the least text similarity, for two boxes to be "similar".
SIMILAR_EDGE = 4
SIMILAR_TEXT = 0.9


class Box(NamedTuple):
    """Four coordinate columns."""

    left: Column
    top: Column
    right: Column
    bottom: Column


def box(prefix: str = "box_", alias: str | None = None) -> Box:
    """The box held in columns ``<prefix>left`` .. ``<prefix>bottom``."""
    path = f"{alias}.{prefix}" if alias else prefix
    return Box(*(F.col(path + side) for side in ("left", "top", "right", "bottom")))


def box_of(struct: Column) -> Box:
    return Box(*(struct.getField(name) for name in BOX_COLUMNS))


def box_struct(b: Box) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in zip(b, BOX_COLUMNS)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rect_is_valid(b: Box) -> Column:
    return (b.top >= 0) & (b.bottom > b.top) & (b.left >= 0) & (b.right > b.left)


def rect_ltrb(b: Box) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(b, ("l", "t", "r", "b"))))


def rect_ltwh(b: Box) -> Column:
    """Left, top, width, height; edges are inclusive, so the width is one more than the difference."""
    return F.struct(b.left.alias("l"), b.top.alias("t"),
                    (b.right - b.left + 1).alias("w"), (b.bottom - b.top + 1).alias("h"))


def rect_area(b: Box) -> Column:
    return (b.right - b.left).cast("bigint") * (b.bottom - b.top)


def rect_equal(a: Box, b: Box, *same: tuple[Column, Column]) -> Column:
    """Equal edges; extra column pairs (frame, overlay, text) must be equal too."""
    cond = F.lit(True)
    for x, y in [*zip(a, b), *same]:
        cond = cond & (x == y)
    return cond


def rect_contains_point(b: Box, x: Column, y: Column) -> Column:
    return x.between(b.left, b.right) & y.between(b.top, b.bottom)


def rect_contains_rect(outer: Box, inner: Box) -> Column:
    return ((outer.left <= inner.left) & (outer.top <= inner.top)
            & (outer.right >= inner.right) & (outer.bottom >= inner.bottom))


def rect_overlap(a: Box, b: Box, touching: bool = False) -> Box:
    """The common part; it is a null box when the two lie apart or, unless ``touching``, only share an edge."""
    left, top = F.greatest(a.left, b.left), F.greatest(a.top, b.top)
    right, bottom = F.least(a.right, b.right), F.least(a.bottom, b.bottom)
    apart = ((left > right) | (top > bottom)) if touching else ((left >= right) | (top >= bottom))
    return Box(*(F.when(apart, F.lit(-1)).otherwise(c) for c in (left, top, right, bottom)))


def rect_mbr(a: Box, b: Box) -> Box:
    return Box(F.least(a.left, b.left), F.least(a.top, b.top),
               F.greatest(a.right, b.right), F.greatest(a.bottom, b.bottom))


def rect_similar(a: Box, b: Box, limit: int = SIMILAR_EDGE) -> Column:
    """Every edge within ``limit`` pixels."""
    cond = F.lit(True)
    for x, y in zip(a, b):
        cond = cond & (F.abs(x - y) <= limit)
    return cond


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn ``a`` into ``b``."""
    before_last: list[int] = []
    last = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, before_last[j - 2] + 1)
            row.append(best)
        before_last, last = last, row
    return last[-1]


def texts_similar(a: str, b: str, least: float = SIMILAR_TEXT) -> bool:
    longest = max(len(a), len(b))
    return longest == 0 or 1 - edit_distance(a, b) / longest >= least


@F.pandas_udf(T.IntegerType())
def _swap_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def text_similar(a: Column, b: Column, least: float = SIMILAR_TEXT) -> Column:
    """Similarity of two texts under edit distance with neighbour swaps.

    The built-in ``levenshtein`` lies between that distance and twice that distance, so it
    decides all but a narrow band. Texts outside the band reach the Python function as two
    empty strings, for which it has nothing to do.
    """
    longest = F.greatest(F.length(a), F.length(b))
    plain = F.levenshtein(a, b)
    allowed = F.lit(1.0 - least) * longest + F.lit(1e-9)
    undecided = (plain > allowed) & (plain <= 2 * allowed)
    exact = _swap_distance(F.when(undecided, a).otherwise(""), F.when(undecided, b).otherwise(""))
    return F.when(plain <= allowed, True).when(undecided, exact <= allowed).otherwise(False)


def parse_rect_list(text: Column) -> Column:
    """``x0,y0,x1,y1[,frame[,overlay]]`` items separated by ``;`` to an array of boxes.

    A leading ``+`` on the third or fourth number makes it an offset from the first corner.
    Brackets and blanks are ignored; an item with fewer than four numbers is an error.
    """
    items = F.split(F.translate(text, "() ", ""), ";")

    def parse(item: Column) -> Column:
        parts = F.split(item, ",")

        def number(i: int) -> Column:
            return F.get(parts, F.lit(i)).cast("int")

        def corner(i: int) -> Column:
            relative = F.get(parts, F.lit(i)).contains("+")
            return number(i) + F.when(relative, number(i - 2)).otherwise(0)

        row = F.struct(number(0).alias("box_left"), number(1).alias("box_top"),
                       corner(2).alias("box_right"), corner(3).alias("box_bottom"),
                       F.coalesce(number(4), F.lit(-1)).alias("frame"),
                       F.coalesce(number(5), F.lit(-1)).alias("overlay"))
        short = F.raise_error(F.lit("a rectangle needs at least four comma-separated numbers"))
        return F.when(F.size(parts) < 4, short).otherwise(row)

    return F.transform(items, parse)


def parse_rule_coords(text: Column, width: Column, height: Column) -> Column:
    """``l,t,r,b`` or ``(l,t,r,b)`` to a box; ``all`` is the whole frame and needs its size."""
    parts = F.split(F.translate(text, "() ", ""), ",")
    whole = text.contains("all")
    sized = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i)).cast("int")

    full = box_struct(Box(F.lit(0), F.lit(0), width - 1, height - 1))
    return (F.when(whole & ~sized, F.raise_error(F.lit("the frame size is needed to resolve all")))
            .when(whole, full)
            .otherwise(F.struct(*(number(i).alias(n) for i, n in enumerate(BOX_COLUMNS)))))


def fold_box_array(boxes: Column, start: Column | None = None, coalesce: bool = True) -> Column:
    """Ordered fold of one row's array of boxes into a list without hidden boxes.

    A new box removes those it covers, is skipped when covered, grows the first similar box
    when ``coalesce`` is set, and is appended otherwise. For arrays bounded by one document
    or one rule file; tables of boxes use ``operators.fold``.
    """
    first = start if start is not None else F.array().cast(f"array<{BOX_TYPE}>")

    def add_to(left_over: Column, new: Column) -> Column:
        nb = box_of(new)
        hidden = F.exists(left_over, lambda k: rect_contains_rect(box_of(k), nb))
        appended = F.array_append(left_over, new)
        if coalesce:
            at = F.array_position(F.transform(left_over, lambda k: rect_similar(box_of(k), nb)), True)
            appended = let(at, lambda p: F.when(p > 0, F.transform(left_over, lambda k, i: F.when(
                i + 1 == p, box_struct(rect_mbr(box_of(k), nb))).otherwise(k))).otherwise(F.array_append(left_over, new)))
        return F.when(hidden, left_over).otherwise(appended).cast(f"array<{BOX_TYPE}>")

    def add(kept: Column, new: Column) -> Column:
        uncovered = F.filter(kept, lambda k: ~rect_contains_rect(box_of(new), box_of(k)))
        return F.when(~rect_is_valid(box_of(new)), kept).otherwise(let(uncovered, lambda u: add_to(u, new)))

    return F.aggregate(boxes, first, add)


def fold_text_boxes(rows: Column, row_type: str, match_text: bool = True) -> Column:
    """Ordered fold of a frame's text boxes: ``kept``, and ``undecided`` if two texts that met need the swap distance.

    ``rows`` is an array of ``row_type``, a struct with the box columns and ``ocrtext``, in order. A new box removes those it
    covers, is skipped when covered, grows the first similar box with a similar text, and is appended otherwise. Null texts
    count as empty. When ``undecided`` is set, ``kept`` says nothing.
    """
    state_type = f"struct<kept:array<{row_type}>,undecided:boolean>"
    no, maybe, yes = 0, 1, 2

    def alike(k: Column, new: Column) -> Column:
        near = rect_similar(box_of(k), box_of(new))
        if not match_text:
            return F.when(near, yes).otherwise(no)
        a, b = (F.coalesce(x["ocrtext"], F.lit("")) for x in (k, new))
        allowed = F.lit(1.0 - SIMILAR_TEXT) * F.greatest(F.length(a), F.length(b)) + F.lit(1e-9)
        level = F.when(F.levenshtein(a, b) <= allowed, yes).when(F.levenshtein(a, b) <= 2 * allowed, maybe).otherwise(no)
        return F.when(near, level).otherwise(no)

    def grown(k: Column, new: Column) -> Column:
        edges = box_struct(rect_mbr(box_of(k), box_of(new)))
        for n in BOX_COLUMNS:
            k = k.withField(n, edges[n])
        return k

    def joined(left: Column, new: Column, undecided: Column) -> Column:
        hidden = F.exists(left, lambda k: rect_contains_rect(box_of(k), box_of(new)))

        def decide(levels: Column) -> Column:
            at = F.array_position(levels, F.lit(yes))
            kept = (F.when(at > 0, F.transform(left, lambda k, i: F.when(i + 1 == at, grown(k, new)).otherwise(k)))
                    .otherwise(F.array_append(left, new)))
            return F.struct(kept.alias("kept"), (undecided | F.array_contains(levels, maybe)).alias("undecided")).cast(state_type)

        levels = F.transform(left, lambda k: alike(k, new))
        return (F.when(hidden, F.struct(left.alias("kept"), undecided.alias("undecided")).cast(state_type))
                .otherwise(let(levels, decide)))

    def add(state: Column, new: Column) -> Column:
        uncovered = F.filter(state["kept"], lambda k: ~rect_contains_rect(box_of(new), box_of(k)))
        return F.when(state["undecided"], state).otherwise(let(uncovered, lambda u: joined(u, new, state["undecided"])))

    first = F.struct(F.array().cast(f"array<{row_type}>").alias("kept"), F.lit(False).alias("undecided")).cast(state_type)
    return F.aggregate(rows, first, add)


def complement_boxes(keep: Column, width: Column, height: Column, exact: bool = False) -> Column:
    """Boxes covering the part of the frame outside every ``keep`` box; empty for an empty list.

    By default the pieces share their edge pixels with the kept boxes, as the existing
    redaction rules expect; ``exact`` leaves those pixels alone.
    """
    step = 1 if exact else 0

    def usable(b: Box) -> Column:
        if exact:
            return (b.right >= b.left) & (b.bottom >= b.top) & (b.left >= 0) & (b.top >= 0)
        return rect_is_valid(b)

    def cut(piece: Column, hole: Column) -> Column:
        p = box_of(piece)

        def around(overlap: Column) -> Column:
            inner = box_of(overlap)
            pieces = F.array(
                box_struct(Box(p.left, p.top, p.right, inner.top - step)),
                box_struct(Box(p.left, inner.top, inner.left - step, inner.bottom)),
                box_struct(Box(inner.right + step, inner.top, p.right, inner.bottom)),
                box_struct(Box(p.left, inner.bottom + step, p.right, p.bottom)))
            return F.when(usable(inner), pieces).otherwise(F.array(piece))

        return let(box_struct(rect_overlap(p, box_of(hole), touching=exact)), around)

    def subtract(pieces: Column, hole: Column) -> Column:
        cuts = F.array_distinct(F.filter(F.flatten(F.transform(pieces, lambda p: cut(p, hole))),
                                         lambda p: usable(box_of(p))))
        return let(cuts, lambda c: F.filter(c, lambda p: ~F.exists(
            c, lambda q: (q != p) & rect_contains_rect(box_of(q), box_of(p))))).cast(f"array<{BOX_TYPE}>")

    whole = F.array(box_struct(Box(F.lit(0), F.lit(0), width - 1, height - 1)))
    return F.when(F.size(keep) == 0, F.array().cast(f"array<{BOX_TYPE}>")).otherwise(
        F.aggregate(keep, whole.cast(f"array<{BOX_TYPE}>"), subtract))
