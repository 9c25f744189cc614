"""Work on squares of images: a block of pixels, with as many around it as a window reaches, is one small array.

A pass shuffles a row a pixel once, however many windows follow on each other in it; along lines each axis of each
window would take a shuffle. A block is bounded by its side and the reach, whatever an image's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .lines import summed

KEY = "plate_id"
Change = Callable[[tuple[np.ndarray, np.ndarray], np.ndarray, tuple[int, int]], np.ndarray]


def in_blocks(px: DataFrame, column: str, reach: int, change: Change, side: int = 256) -> DataFrame:
    """px with `column` made anew by change(places, values, shape), which gets the rows of a block and of `reach`
    pixels around it, their places being (line, column) in an array of that shape, and gives each row's new value."""
    return made_in_blocks(px, (column,), {column: px.schema[column].dataType}, reach, lambda at, values, shape: {column: change(at, values[column], shape)}, side)


def made_in_blocks(px: DataFrame, columns: tuple[str, ...], outputs: dict[str, T.DataType], reach: int, change: Callable[..., dict[str, np.ndarray]], side: int = 256) -> DataFrame:
    """px with the columns `outputs` more (or instead), which change(places, values, shape) gives for the rows of a
    block and of `reach` pixels around it from the values of `columns`, of which nulls are 0; where it gives NaN they
    are null."""
    across = lambda c: F.explode(F.sequence(F.floor(F.col(c) / side).cast("long"), F.floor((F.col(c) + 2 * reach) / side).cast("long")))
    dealt = px.select("*", across("x").alias("__bx")).select("*", across("y").alias("__by"))
    block = [KEY, "__bx", "__by"]
    ordered = dealt.repartition(*block).sortWithinPartitions(*block)
    names = [*px.columns, *(c for c in outputs if c not in px.columns)]
    schema = T.StructType([T.StructField(c, outputs[c]) if c in outputs else px.schema[c] for c in names])
    kinds = {c: to_arrow_type(t) for c, t in outputs.items()}

    def edges(table: pa.Table) -> np.ndarray:
        """Where blocks begin, and the end."""
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            own = [table.column(c).to_numpy() for c in ("__bx", "__by")] + [table.column(KEY).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)]
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in own])
        return np.append(np.flatnonzero(new), table.num_rows)

    def made(table: pa.Table, stops: np.ndarray) -> pa.Table:
        x, y, bx, by = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "__bx", "__by"))
        given = {c: np.nan_to_num(table.column(c).to_numpy().astype(np.float64)) for c in columns}
        found = {c: np.empty(table.num_rows) for c in outputs}
        for a, z in zip(stops.tolist(), stops[1:].tolist()):
            u, v = x[a:z] - x[a:z].min(), y[a:z] - y[a:z].min()
            for c, values in change((v, u), {c: g[a:z] for c, g in given.items()}, (int(v.max()) + 1, int(u.max()) + 1)).items():
                found[c][a:z] = values
        own = pa.array(((x + reach) // side == bx) & ((y + reach) // side == by))
        arrays = [pa.array(found[c], from_pandas=True).cast(kinds[c], safe=False) if c in outputs else table.column(c) for c in names]
        return pa.table(arrays, names).filter(own).combine_chunks()

    def work(batches):
        rest = None  # rows of a block that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            stops = edges(table)
            if len(stops) > 2:
                yield from made(table.slice(0, stops[-2]), stops[:-1]).to_batches()
                table = table.slice(stops[-2])
            rest = table
        if rest is not None and rest.num_rows:
            yield from made(rest, edges(rest)).to_batches()

    return ordered.mapInArrow(work, schema)


def _line_extremum(a: np.ndarray, k: int, pick: np.ufunc, fill: float) -> np.ndarray:
    """Over k places to both sides in each line, by doubling."""
    a = np.pad(a, ((0, 0), (k, k)), constant_values=fill)
    span = 1
    while span < 2 * k + 1:
        step = min(span, 2 * k + 1 - span)
        a = pick(a[:, :-step], a[:, step:])
        span += step
    return a


def _fill(pick: np.ufunc) -> float:
    return -np.inf if pick is np.maximum else np.inf


def square_extrema(k: int, picks: tuple[np.ufunc, ...]) -> Change:
    """Extrema over squares of 2k+1 places, one after the other, of the places that there are."""

    def change(at, values, shape):
        for pick in picks:
            a = np.full(shape, _fill(pick))
            a[at] = values
            lines = _line_extremum(a, k, pick, _fill(pick))
            values = _line_extremum(lines.T, k, pick, _fill(pick)).T[at]
        return values

    return change


def disc_extremum(a: np.ndarray, halves: list[int], pick: np.ufunc) -> np.ndarray:
    """Over a disc, of which halves[d] is the half width d lines away."""
    fill, k, out = _fill(pick), len(halves) - 1, None
    wide = {h: np.pad(_line_extremum(a, h, pick, fill), ((k, k), (0, 0)), constant_values=fill) for h in set(halves)}
    for d in range(-k, k + 1):
        line = wide[halves[abs(d)]][k + d : k + d + len(a)]
        out = line if out is None else pick(out, line)
    return out


def closing(halves: list[int], times: int) -> Change:
    """Of rows with 0, the image's places, and with 1, those of a mask: 1 for the places of the image that the mask
    closed by a disc has, else 0."""

    def change(at, values, shape):
        there, mask = np.zeros(shape, bool), np.zeros(shape)
        image = values == 0
        there[at[0][image], at[1][image]] = True
        mask[at[0][~image], at[1][~image]] = 1
        for pick in [np.maximum] * times + [np.minimum] * times:
            mask = disc_extremum(np.where(there, mask, _fill(pick)), halves, pick)
        return np.where(image, np.where(there, mask, 0)[at], 0)

    return change


def thin_edges(low: float, weights: np.ndarray) -> Callable[..., dict[str, np.ndarray]]:
    """m: the Sobel gradient of v smoothed by the kernel (half of which `weights` has, from its middle on), where it is
    over `low` and no less than at the two neighbours across the edge, else null. w is 1 where v has a value. Lines are
    smoothed first, columns then, each over the pixels that there are; a gradient needs all eight neighbours."""

    def smooth(a: np.ndarray) -> np.ndarray:
        k = len(weights) - 1
        wide = np.pad(a, ((0, 0), (k, k)))
        out = weights[0] * a
        for i in range(1, k + 1):  # both sides at once, so that mirrored places have the same sum
            out = out + weights[i] * (wide[:, k - i : wide.shape[1] - k - i] + wide[:, k + i : wide.shape[1] - k + i])
        return out

    def change(at, values, shape):
        sums = []
        for c in "vw":
            a = np.zeros(shape)
            a[at] = values[c]
            lines = np.zeros(shape)
            lines[at] = smooth(a)[at]
            sums.append(smooth(lines.T).T[at])
        soft = np.full((shape[0] + 2, shape[1] + 2), np.nan)
        inner = at[0] + 1, at[1] + 1
        with np.errstate(invalid="ignore", divide="ignore"):
            soft[inner] = np.where(sums[1] > 0, sums[0] / sums[1], np.nan)
        around = lambda a, dy, dx: a[inner[0] + dy, inner[1] + dx]
        s = {(dy, dx): around(soft, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
        gx = (s[-1, 1] - s[-1, -1]) + 2 * (s[0, 1] - s[0, -1]) + (s[1, 1] - s[1, -1])
        gy = (s[1, 1] + 2 * s[1, 0] + s[1, -1]) - (s[-1, 1] + 2 * s[-1, 0] + s[-1, -1])
        strength = np.hypot(gx, gy)
        m = np.zeros_like(soft)
        m[inner] = np.nan_to_num(strength)
        turn = np.nan_to_num(np.floor(np.degrees(np.arctan2(gy, gx)) / 45 + 0.5)).astype(np.int64) % 4
        dy, dx = np.array([0, 1, 1, -1])[turn], np.array([1, 1, 0, 1])[turn]
        best = np.maximum(around(m, dy, dx), around(m, -dy, -dx))
        return {"m": np.where((strength > low) & (strength >= best), strength, np.nan)}

    return change


def edges_and_variances(variance: int, deviation: int) -> Callable[..., dict[str, np.ndarray]]:
    """Of rows with mark 0, an image's pixels, and 1, edges: whether a pixel is next to an edge or on one, and the
    variance and standard deviation of v over squares of 2k+1 places, of those where v has a value (w = 1)."""

    def squares(a: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):  # lines lie behind each other with gaps of k places
            wide = np.pad(a, ((0, 0), (k, k)))
            a = summed(wide.ravel(), k).reshape(wide.shape)[:, k : k + a.shape[1]].T
        return a

    def change(at, values, shape):
        image = values["mark"] == 0
        own = at[0][image], at[1][image]
        v, w, edge = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        v[own], w[own] = values["v"][image], values["w"][image]
        edge[at[0][~image], at[1][~image]] = 1
        out = {"e": disc_extremum(edge, [1, 1], np.maximum)[at]}
        for name, k in (("local_variance", variance), ("local_std", deviation)):
            n, s, q = (squares(a, k)[at] for a in (w, v, v * v))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = s / n
                out[name] = q / n - mean * mean  # not a number without pixels
        out["local_std"] = np.sqrt(np.fmax(0.0, out["local_std"]))
        return out

    return change


def tile_tables(hist: DataFrame, tile: list[str], clip: float) -> DataFrame:
    """(tile, table): lookup tables of 256 entries from histograms (tile, pixels, h: (v, n)) clipped at `clip` times
    the mean, what is cut off being dealt out evenly."""
    schema = T.StructType([hist.schema[c] for c in tile] + [T.StructField("table", T.ArrayType(T.IntegerType()))])

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                b = batch.slice(first, 2048)
                column, pixels = b.column(len(tile) + 1), b.column(len(tile)).to_numpy()
                of = np.repeat(np.arange(b.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
                flat = column.flatten()
                v, n = flat.field("v").to_numpy(zero_copy_only=False).astype(np.float64), flat.field("n").to_numpy(zero_copy_only=False)
                limit = np.maximum(1, (clip * pixels / 256).astype(np.int64))
                excess = np.bincount(of, np.maximum(0, n - limit[of]), b.num_rows).astype(np.int64)[:, None]
                gray = (v >= 0) & (v <= 255) & (v == np.floor(v))
                counts = np.zeros((b.num_rows, 256), np.int64)
                counts[of[gray], v[gray].astype(np.int64)] = n[gray]
                counts = np.minimum(counts, limit[:, None]) + excess // 256 + (np.arange(256) < excess % 256)
                table = np.floor(np.cumsum(counts, axis=1) * 255 / pixels[:, None] + 0.5).astype(np.int32)
                tables = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 256), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(tile))), tables], schema.names)

    return hist.select(*tile, "pixels", "h").mapInArrow(work, schema)


def _envelope(of: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points (sorted by y in each region) that no chord between two others of their region lies below or on.
    Those above the chord of their neighbours go all at once, until there are none."""
    while True:
        bend = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (x[2:] - x[:-2]) * (y[1:-1] - y[:-2])
        gone = np.flatnonzero((of[:-2] == of[2:]) & (bend >= 0)) + 1
        if not len(gone):
            return of, y, x
        of, y, x = (np.delete(a, gone) for a in (of, y, x))


def _under(of: np.ndarray, y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Twice the area between x = 0 and the chain of each region's points."""
    same = of[1:] == of[:-1]
    return np.bincount(of[1:][same], ((x[1:] + x[:-1]) * (y[1:] - y[:-1]))[same], n)


def hull_areas(regions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, area, hull_area) of regions (keys, area, l: (y, x0, x1), a line of which ends before x1), over the
    corners of their pixels."""
    schema = T.StructType([regions.schema[c] for c in (*keys, "area")] + [T.StructField("hull_area", T.DoubleType())])

    def work(batches):
        for batch in batches:
            column = batch.column(len(keys) + 1)
            of = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            flat = column.flatten()
            y, x0, x1 = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x0", "x1"))
            of, y, x0, x1 = np.tile(of, 2), np.concatenate([y, y + 1]), np.tile(x0, 2), np.tile(x1, 2)
            order = np.lexsort((y, of))
            of, y, x0, x1 = of[order], y[order], x0[order], x1[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (y[1:] != y[:-1])])) if len(of) else np.zeros(0, np.int64)
            if len(first):
                of, y, x0, x1 = of[first], y[first], np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first)
            twice = -_under(*_envelope(of, y, -x1), batch.num_rows) - _under(*_envelope(of, y, x0), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys) + 1)), pa.array(twice / 2, pa.float64())], schema.names)

    return regions.select(*keys, "area", "l").mapInArrow(work, schema)
