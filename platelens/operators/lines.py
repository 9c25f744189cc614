"""Work along the lines of images: each row or column of pixels is one array, many of them to a batch.

An axis costs one shuffle of a row a pixel. In a batch the lines lie behind each other in one array with gaps of k
places, so that a window of k to both sides never sees another line, and whole-array steps serve all lines at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "plate_id"
#: Pixels that are worked on together (a longer line is taken alone).
_CELLS = 1 << 20


class Lines:
    """Lines side by side: get(column, fill) has the column's values at their places and `fill` elsewhere."""

    def __init__(self, line: np.ndarray, position: np.ndarray, columns: Callable[[str], np.ndarray], gap: int):
        n = int(line[-1]) + 1 if len(line) else 0
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, line, position)
        np.maximum.at(high, line, position)
        span = np.where(high >= low, high - low + 1 + gap, 0)
        self._base = gap + np.cumsum(span) - span - low
        self.at = self._base[line] + position
        self.size, self._columns, self._first = gap + int(span.sum()), columns, self._base + low

    def get(self, column: str, fill: float) -> np.ndarray:
        out = np.full(self.size, fill)
        out[self.at] = self._columns(column)
        return out

    def around(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, line, position) of the places without a pixel that have one of their line at most k away, where
        lines lie 2k apart."""
        own = np.zeros(self.size)
        own[self.at] = 1
        place = np.flatnonzero((running(own, k, np.maximum) > 0) & (own == 0))
        line = np.searchsorted(self._first - k, place, side="right") - 1
        return place, line, place - self._base[line]


def along(px: DataFrame, axis: str, k: int, outputs: dict[str, T.DataType], change: Callable[[Lines], dict[str, np.ndarray]], beyond: bool = False) -> DataFrame:
    """px with the columns `outputs` more (or instead), which change(lines) gives in the lines' places. beyond: a
    column `__there` more, and rows in which it is false for places up to k away from a line's pixels at which there
    is none. A window over the other axis needs them where lines differ in length or have gaps."""
    other = "y" if axis == "x" else "x"
    passed = [c for c in px.columns if c not in (KEY, other)]
    lines = px.groupBy(KEY, other).agg(F.collect_list(F.struct(*passed)).alias("cells"))
    kept = [c for c in passed if c not in outputs]
    schema = T.StructType([T.StructField(c, px.schema[c].dataType) for c in (KEY, other, *kept)] + [T.StructField(c, t) for c, t in outputs.items()] + [T.StructField("__there", T.BooleanType())] * beyond)

    def slices(batch: pa.RecordBatch):
        cells = batch.column(2)
        done = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(done, done[at] + _CELLS, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto

    def work(batches):
        for batch in batches:
            for b in slices(batch):
                flat = b.column(2).flatten()
                line = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
                # a null, of which Arrow's floats make NaN, is like a pixel that isn't there
                values = lambda c, flat=flat: np.nan_to_num(flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64))
                lines_ = Lines(line, flat.field(axis).to_numpy(zero_copy_only=False).astype(np.int64), values, 2 * k if beyond else k)
                made = change(lines_)
                places = [(lines_.at, line, None), *([lines_.around(k)] if beyond else [])]
                kinds = {c: pa.int32() if isinstance(t, T.IntegerType) else pa.int64() if isinstance(t, T.LongType) else pa.float64() for c, t in outputs.items()}
                for place, of, position in places:
                    row = pa.array(of)
                    if position is None:
                        passed_on = [flat.field(c) for c in kept]
                    else:
                        passed_on = [pa.array(position).cast(flat.field(c).type) if c == axis else pa.nulls(len(place), flat.field(c).type) for c in kept]
                    arrays = [b.column(0).take(row), b.column(1).take(row), *passed_on, *(pa.array(made[c][place]).cast(kinds[c], safe=False) for c in outputs)]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(np.full(len(place), position is None))] * beyond, schema.names)

    return lines.mapInArrow(work, schema)


def smoothed(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The values' sum weighted by a symmetric kernel about each place, by Fourier transform: the cost doesn't hang
    on the kernel's width, and errors are about 1e-13 of the largest value."""
    n = len(values) + len(kernel) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(kernel, size), size)[:n]
    return full[len(kernel) // 2 : len(kernel) // 2 + len(values)]


def running(values: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """np.maximum or np.minimum over k places to both sides, in three steps a place whatever k: blocks' extrema from
    the left and from the right, and the two that make up each window."""
    width, n = 2 * k + 1, len(values)
    fill = -np.inf if pick is np.maximum else np.inf
    padded = np.full(-(-(n + 2 * k) // width) * width, fill)
    padded[k : k + n] = values
    blocks = padded.reshape(-1, width)
    left, right = pick.accumulate(blocks, axis=1).ravel(), pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n], left[2 * k : 2 * k + n])


def summed(values: np.ndarray, k: int) -> np.ndarray:
    """Sums over k places to both sides, made up of blocks' sums from the left and from the right as in `running`, so
    that no sum is longer than a window."""
    width, n = 2 * k + 1, len(values)
    padded = np.zeros(-(-(n + 2 * k) // width) * width)
    padded[k : k + n] = values
    blocks = padded.reshape(-1, width)
    left, right = np.cumsum(blocks, axis=1).ravel(), np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = right[:n] + left[2 * k : 2 * k + n]
    out[::width] = right[:n:width]  # a window that is a whole block
    return out


def running_ellipse(lines: Lines, columns: dict[int, str], halves: list[int], pick: np.ufunc) -> np.ndarray:
    """The extremum over lines up to len(halves) - 1 away, of which each has its own column by its half width."""
    fill, k = (-np.inf if pick is np.maximum else np.inf), len(halves) - 1
    found = {h: np.concatenate([np.full(k, fill), lines.get(c, fill), np.full(k, fill)]) for h, c in columns.items()}
    out = np.full(lines.size, fill)
    for d in range(-k, k + 1):
        out = pick(out, found[halves[abs(d)]][k + d : k + d + lines.size])
    return out


def mirrored(px: DataFrame, plates: DataFrame, k: int) -> DataFrame:
    """px and a frame of k pixels around each image, in which it is mirrored at its edges, edge pixels included (as
    often as k needs); `__inside` tells the image's own pixels."""

    def places(axis: str, side: str):
        n = F.col(side)
        turns = F.sequence(-F.ceil((F.lit(k) + n) / (2 * n)).cast("int"), F.ceil((F.lit(k) + n) / (2 * n)).cast("int"))
        both = F.flatten(F.transform(turns, lambda m: F.array((2 * m * n + F.col(axis)).cast("int"), (2 * m * n - 1 - F.col(axis)).cast("int"))))
        return F.explode(F.filter(both, lambda p: (p >= -k) & (p < n + k)))

    sized = px.join(plates.select(KEY, F.col("width").alias("__w"), F.col("height").alias("__h")).hint("merge"), KEY)
    framed = sized.withColumn("__x", places("x", "__w")).withColumn("__y", places("y", "__h"))
    inside = (F.col("__x") == F.col("x")) & (F.col("__y") == F.col("y"))
    kinds = {c: px.schema[c].dataType for c in ("x", "y")}
    return framed.select(*(F.col(f"__{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in px.columns), inside.alias("__inside"))


def within(px: DataFrame, plates: DataFrame | None, border: str, k: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(px) under a rule for the border: 'shrink' takes windows of what is there, 'reflect' of the mirrored
    image, whose sizes `plates` has."""
    if border == "shrink":
        return work(px)
    if border != "reflect" or plates is None:
        raise ValueError(f"no such rule for borders: {border}" if plates is not None else "mirroring needs the images' sizes")
    return work(mirrored(px, plates, k)).filter("__inside").drop("__inside")


def first_of_component(block: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """The number of the first run, by y and x0, of each run's component; runs are sorted by block, y and x0, and meet
    in adjacent lines of one block if at most `reach` places lie between them."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64)
    line = np.cumsum(np.concatenate([[0], (block[1:] != block[:-1]) | (y[1:] != y[:-1])]))  # lines that have runs
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    follows = np.concatenate([[False], (block[start[1:]] == block[start[:-1]]) & (y[start[1:]] == y[start[:-1]] + 1)])
    low = int(x0.min()) - reach
    span = int(x1.max()) - low + 2 * reach + 2
    first, last = line * span + (x0 - low), line * span + (x1 - low)
    # in the line above: from the first run that ends far enough right to the last that begins far enough left
    frm = np.searchsorted(last, first - span - reach, side="left")
    to = np.searchsorted(first, last - span + reach, side="right")
    above = np.maximum(line - 1, 0)
    ends = np.append(start, n)
    frm, to = np.maximum(frm, ends[above]), np.minimum(to, ends[above + 1])
    count = np.where(follows[line], np.maximum(to - frm, 0), 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(frm, count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:  # the larger root goes under the smaller one, then paths are cut short
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            onward = root[root]
            if (onward == root).all():
                break
            root = onward


def block_components(runs: DataFrame, block: tuple[str, ...], y: str, x0: str, x1: str, reach: int) -> DataFrame:
    """runs with __ly and __la, the line and start of the first run of each run's component in its block. A block is
    bounded by whoever dealt it out."""
    kept = [c for c in runs.columns if c not in block]
    grouped = runs.groupBy(*block).agg(F.collect_list(F.struct(*kept)).alias("runs"))
    schema = T.StructType([T.StructField(c, runs.schema[c].dataType) for c in (*block, *kept)] + [T.StructField(c, T.LongType()) for c in ("__ly", "__la")])

    def find(batches):
        for b in batches:
            column = b.column(len(block))
            flat, of = column.flatten(), np.repeat(np.arange(b.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            line, start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (y, x0, x1))
            order = np.lexsort((start, line, of))
            root = order[first_of_component(of[order], line[order], start[order], end[order], reach)]
            first = np.empty(len(of), np.int64)
            first[order] = root
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(len(block))), *(flat.field(c) for c in kept), pa.array(line[first]), pa.array(start[first])], schema.names)

    return grouped.mapInArrow(find, schema)
