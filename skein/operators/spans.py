"""Spans of one text as sorted arrays in its row, met by binary search in Arrow batches.

A row holds both cuts of a text, so nothing is exploded, shuffled or windowed: a
batch's documents are laid one after another on one line of offsets, and all
their spans are searched at once. Only documents whose sources are not in order
(nested ones, or any order) are searched one by one, still in
O((targets + sources) log sources) each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import in_parts

CUTS = T.StructType([T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("e", T.ArrayType(T.IntegerType()))])


def split_spans(sep: str) -> Callable[[Column], Column]:
    """A function of a text that gives starts and ends (in code points) of its pieces between ``sep``, one character; a null text has null spans."""

    @F.arrow_udf(CUTS)
    def spans(texts: pa.Array) -> pa.Array:
        starts, ends, sizes = [], [], []
        for t in texts:
            if not t.is_valid:
                sizes.append(0)
                continue
            chars = np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.flatnonzero(chars == ord(sep)).astype(np.int32)
            starts.append(np.concatenate([[0], at + 1]))
            ends.append(np.append(at, len(chars)))
            sizes.append(len(at) + 1)
        lists = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        s, e = (pa.ListArray.from_arrays(lists, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (starts, ends))
        return pa.StructArray.from_arrays([s, e], names=["s", "e"], mask=texts.is_null())

    return spans


def _flat(lists: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists (a null value is NaN) and how many each has; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    if kind is float:
        values = values.cast(pa.float64())
    return values.to_numpy(zero_copy_only=False).astype(kind), sizes


def _in_order(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Documents (by number) in which a key falls."""
    same = doc[1:] == doc[:-1]
    fall = np.zeros(len(same), bool)
    for k in keys:
        fall |= k[1:] < k[:-1]
    return np.unique(doc[1:][same & fall])


def _range_means(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Means of ``values[lo:hi]`` of each range (none is empty), each summed by itself."""
    ends = np.column_stack([lo, hi]).ravel()
    return np.add.reduceat(np.append(values, 0.0), ends)[::2] / (hi - lo)


def overlap_in_order(ts, te, ss, se, values, how: str) -> np.ndarray:
    """Of sources whose starts and ends never fall, those that meet a target follow each other."""
    lo, hi = np.searchsorted(se, ts, "right"), np.searchsorted(ss, te, "left")
    met = (lo < hi) & (te > ts)
    out = np.zeros(len(ts))
    if met.any():
        out[met] = values[hi[met] - 1] if how == "last" else _range_means(values, lo[met], hi[met])
    return out


def overlap_any(ts, te, ss, se, values, how: str) -> np.ndarray:
    """Sources in any order: a mean from running sums of those begun and those ended, NaN and infinities counted apart; ``last`` by a sweep over the targets' ends."""
    out = np.zeros(len(ts))
    real = np.flatnonzero(te > ts)
    if how == "last":
        out[real] = _last_any(ts[real], te[real], ss, se, values)
        return out
    parts = []
    for key, at, side in ((ss, te[real], "left"), (se, ts[real], "right")):
        by = np.argsort(key, kind="stable")
        n = np.searchsorted(key[by], at, side)
        v = values[by]
        counts = [np.ones(len(v)), np.where(np.isfinite(v), v, 0).astype(np.longdouble), np.isnan(v), np.isposinf(v), np.isneginf(v)]
        parts.append([np.concatenate([[0], np.cumsum(c, dtype=np.longdouble)])[n] for c in counts])
    n, total, nans, up, down = (a - b for a, b in zip(*parts, strict=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, total / n, 0).astype(float)
    mean[up > 0] = np.inf
    mean[down > 0] = -np.inf
    mean[(nans > 0) | ((up > 0) & (down > 0))] = np.nan
    out[real] = mean
    return out


def _last_any(ts, te, ss, se, values) -> np.ndarray:
    """For each target the value of the source of the highest place that has begun before its end and ends after its start.

    Targets are taken by their ends. A binary indexed tree over the falling
    ends of the sources begun so far holds the highest place of those that end late enough.
    """
    out = np.zeros(len(ts))
    begin = np.argsort(ss, kind="stable").tolist()
    ends, starts = se.tolist(), ss.tolist()
    tree = [-1] * (len(ends) + 1)  # by falling rank of the end: the highest place among sources that end no earlier
    ranks = sorted(set(ends))
    k = 0
    for t in np.argsort(te, kind="stable").tolist():
        while k < len(begin) and starts[begin[k]] < te[t]:
            place = begin[k]
            i = len(ranks) - bisect_right(ranks, ends[place]) + 1
            while i < len(tree):
                tree[i] = max(tree[i], place)
                i += i & -i
            k += 1
        i, best = len(ranks) - bisect_right(ranks, ts[t]), -1
        while i > 0:
            best = max(best, tree[i])
            i -= i & -i
        if best >= 0:
            out[t] = values[best]
    return out


def overlaps(how: str = "mean") -> Callable[..., Column]:
    """A function of target starts and ends, source starts, ends and values (lists of one row) that gives an array: for
    each target the ``mean`` or the ``last`` of the values of the sources with ``s < te`` and ``e > ts``; 0 where none is.

    The last is the one of the highest place in its list, whatever the spans: of sources with one span the later one. Empty
    spans meet nothing. Null values are NaN, and NaN and infinities reach the targets that they overlap and no
    other. A null list is an empty one, and a row without target lists has a null result. Sums in order are taken by themselves
    for each target, others from running sums of 80 bits.
    """
    if how not in ("mean", "last"):
        raise ValueError(f"how is mean or last, not {how!r}")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(ts: pa.Array, te: pa.Array, ss: pa.Array, se: pa.Array, values: pa.Array) -> pa.Array:
        (a, n), (b, nb) = _flat(ts, np.int64), _flat(te, np.int64)
        (c, m), (d, md), (v, mv) = _flat(ss, np.int64), _flat(se, np.int64), _flat(values, float)
        if (n != nb).any() or (m != md).any() or (m != mv).any():
            raise ValueError("starts, ends and values of a row differ in number")
        out = np.zeros(len(a))
        docs = np.arange(len(n))
        of_target, of_source = np.repeat(docs, n), np.repeat(docs, m)
        real = d > c
        of_source, c, d, v = of_source[real], c[real], d[real], v[real]
        odd = _in_order(of_source, c, d)
        line = [x for x in (a, b, c, d) if len(x)]
        low = min((int(x.min()) for x in line), default=0)
        width = max((int(x.max()) for x in line), default=0) - low + 1
        plain_t, plain_s = ~np.isin(of_target, odd), ~np.isin(of_source, odd)
        shift_t, shift_s = of_target * width - low, of_source * width - low
        at = [x[p] + s[p] for x, p, s in ((a, plain_t, shift_t), (b, plain_t, shift_t), (c, plain_s, shift_s), (d, plain_s, shift_s))]
        out[plain_t] = overlap_in_order(*at, v[plain_s], how)
        for i in odd.tolist():
            t, s = of_target == i, of_source == i
            out[t] = overlap_any(a[t], b[t], c[s], d[s], v[s], how)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out), mask=ts.is_null())

    return run


def as_of_places() -> Callable[[Column, Column], Column]:
    """A function of offsets and of ends (lists of one row) that gives for each offset the highest place among the ends that come last up to it, else -1.

    Ends may come in any order; of equal ends the later place counts. Null offsets have -1 and null ends are met by none.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(at: pa.Array, ends: pa.Array) -> pa.Array:
        (x, n), (y, m) = _flat(at, float), _flat(ends, float)
        docs = np.arange(len(n))
        of_at, of_end = np.repeat(docs, n), np.repeat(docs, m)
        place = np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m)
        if (unknown := np.isnan(y)).any():
            y, of_end, place = y[~unknown], of_end[~unknown], place[~unknown]
        if len(_in_order(of_end, y)):
            by = np.lexsort((place, y, of_end))
            y, of_end, place = y[by], of_end[by], place[by]
        known = np.concatenate([x[~np.isnan(x)], y])
        low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
        width = high - low + 1.0
        first = np.searchsorted(of_end, docs, "left")[of_at] if len(n) else np.zeros(0, int)
        k = np.searchsorted(of_end * width + (y - low), of_at * width + (x - low), "right") - 1
        met = (k >= first) & ~np.isnan(x)
        out = np.full(len(x), -1, np.int64)
        out[met] = place[k[met]]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(out), mask=at.is_null())

    return run


def _places(lists: pa.Array) -> pa.Array:
    """Each list's places 0, 1, 2 and so on as numbers."""
    _, n = _flat(lists, np.int64)
    ends = np.cumsum(n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n), pa.int64()).cast(pa.float64()))


def overlapped_places(targets, sources, how: str = "mean") -> Callable[[Column], Column]:
    """A function of a text: for each span of its cut ``targets`` the ``mean`` or ``last`` place of the spans of its cut ``sources`` that meet it.

    Cuts are functions of this kind: ``split_spans(" ")``. Both are made and searched in one part of a batch, so that spans never leave it.
    """
    meet = overlaps(how)

    def part(texts: pa.Array) -> pa.Array:
        a, b = targets.func(texts), sources.func(texts)
        return meet.func(a.field("s"), a.field("e"), b.field("s"), b.field("e"), _places(b.field("s")))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return in_parts(part, texts)

    return run


def last_places(targets, sources) -> Callable[[Column], Column]:
    """A function of a text: for each span of its cut ``targets`` the place of the last span of its cut ``sources`` that ends no later, else -1."""
    search = as_of_places()

    def part(texts: pa.Array) -> pa.Array:
        a, b = targets.func(texts), sources.func(texts)
        return search.func(a.field("e"), b.field("e"))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return in_parts(part, texts)

    return run
