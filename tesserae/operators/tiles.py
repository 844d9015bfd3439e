"""Image problems solved tile by tile, exactly: each tile sees a halo, and answers only what nothing outside can change.

Pixels that a tile leaves open are solved again in larger tiles with a wider halo; a tile
that sees the whole image leaves nothing open. Memory is that of a tile, unless an
answer really depends on pixels far away.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import keep
from .grid import AXES3, Blocking, axes_of, coordinate_to_node, node_to_coordinate

SIZE, HALO = 1 << 16, 32


def tile_of(shape: Sequence[int], size: int = SIZE, flat: Sequence[int] = ()) -> list[int]:
    """Sides of a tile of about `size` pixels, as even as the shape allows; 1 along the axes in `flat`."""
    block, left = [1] * len(shape), size
    open_ = [k for k in range(len(shape)) if k not in flat]
    for i, k in enumerate(sorted(open_, key=lambda k: shape[k])):
        block[k] = max(1, min(shape[k], round(left ** (1 / (len(open_) - i)))))
        left = max(1, left // block[k])
    return block


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into a fixed number of partitions, which are not merged for being small: tiles cost time, not bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bounds(vox: DataFrame) -> tuple[list[int], list[int]]:
    """(begin, end) of the coordinates; of an empty table, one pixel."""
    own = axes_of(vox)
    b = vox.agg(*[f(a) for f in (F.min, F.max) for a in own]).first()
    return [x or 0 for x in b[: len(own)]], [(x or 0) + 1 for x in b[len(own) :]]


class Box:
    """The pixels of a tile and its halo, as arrays over their bounding region; `open` marks those with unseen neighbours."""

    def __init__(self, key: int, b: Blocking, halo: Sequence[int]):
        pos = np.unravel_index(key, b.per_axis)
        raw = [int(p) * k + o for p, k, o in zip(pos, b.block, b.begin, strict=True)]
        self.core = [(r, min(r + k, e)) for r, k, e in zip(raw, b.block, b.end, strict=True)]
        self.low = [max(r - h, o) for (r, _), h, o in zip(self.core, halo, b.begin, strict=True)]
        self.high = [min(r + h, e) for (_, r), h, e in zip(self.core, halo, b.end, strict=True)]
        self.begin, self.end = b.begin, b.end

    @staticmethod
    def rows(coords: Sequence[np.ndarray]) -> np.ndarray:
        """Row numbers by position, -1 where there is no row; the box is cut to the rows it holds."""
        low = [int(c.min()) for c in coords]
        full = np.full([int(c.max()) + 1 - lo for c, lo in zip(coords, low, strict=True)], -1)
        full[tuple(c - lo for c, lo in zip(coords, low, strict=True))] = np.arange(len(coords[0]))
        return full

    def inside(self, own: Sequence[np.ndarray]) -> np.ndarray:
        """Which coordinates lie in the core."""
        ok = np.ones(len(own[0]), bool)
        for c, (b, e) in zip(own, self.core, strict=True):
            ok &= (c >= b) & (c < e)
        return ok

    def unseen(self, own: Sequence[np.ndarray]) -> np.ndarray:
        """Which coordinates may have a face neighbour beyond the halo."""
        out = np.zeros(len(own[0]), bool)
        for c, lo, hi, b, e in zip(own, self.low, self.high, self.begin, self.end, strict=True):
            out |= (c == lo) & (lo > b) | (c == hi - 1) & (hi < e)
        return out


def faces(full: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per axis, the pairs of adjacent filled cells of an array of row numbers (-1: empty)."""
    out = []
    for k in range(full.ndim):
        a, b = np.moveaxis(full, k, 0)[:-1].ravel(), np.moveaxis(full, k, 0)[1:].ravel()
        both = (a >= 0) & (b >= 0)
        out.append((a[both], b[both]))
    return out


def _tile(run: Callable, b: Blocking, reach: Sequence[int]) -> Callable:
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(Box(int(key[0]), b, reach), pdf)

    return solve


def until_certain(rows: DataFrame, begin: Sequence[int], end: Sequence[int], run: Callable, value: str, flat: Sequence[int] = (), size: int = SIZE, halo: int = HALO) -> DataFrame:
    """(coordinates, value) of run(box, rows of a tile and its halo), null where the tile cannot tell; those go to larger tiles."""
    own = axes_of(rows)
    shape = [e - b for b, e in zip(begin, end, strict=True)]
    name, schema = value.split()[0], f"{', '.join(f'{a} long' for a in own)}, {value}"
    done, todo = None, None
    while True:
        b = Blocking(begin, end, tile_of(shape, size, flat))
        reach = [0 if k in flat else min(halo, s) for k, s in enumerate(shape)]
        placed = b.with_halo(rows, reach)
        if todo is not None:
            placed = placed.join(F.broadcast(todo.select(b.block_id([F.col(a) for a in own]).alias("block_id")).distinct()), "block_id", "left_semi")

        out = deal(placed, "block_id").groupBy("block_id").applyInPandas(_tile(run, b, reach), schema)
        out = keep(out if todo is None else out.join(todo, list(own), "left_semi"))
        sure = out.where(F.col(name).isNotNull())
        done = sure if done is None else done.union(sure)
        left = out.where(F.col(name).isNull()).select(*own)
        if left.isEmpty():
            return done
        todo, size, halo = left, size * 8, halo * 8


MODES = {
    "min": np.fmin,
    "max": np.fmax,
    "sum": np.add,
    "prod": np.multiply,
    "l1": lambda a, b: np.abs(a - b),
    "l2": lambda a, b: (a - b) ** 2,
}


def watershed(vox: DataFrame, seeds: DataFrame, shape: Sequence[int], kernel: Callable, mode: str, tall: bool, **sizes: int) -> DataFrame:
    """(node, label) by kernel(edges, seeds[, heights]) as over the whole image.

    Pixels at the rim of a halo may be reached from outside. They are taken as reached at
    once and first, by a flood of unknown label, which is the earliest that can happen: a
    pixel that a known seed reaches nevertheless keeps that label whatever lies outside.
    Only the order of ticks and heights counts, so ties come out as in one run, too.
    """
    own = axes_of(vox)
    px = vox.select(*own, F.col("value").cast("double").alias("value"), F.lit(None).cast("long").alias("seed"))
    at = node_to_coordinate(F.col("node"), shape)
    mark = seeds.select(*[c.alias(a) for a, c in zip(own, at, strict=True)], F.lit(None).cast("double").alias("value"), F.col("label").cast("long").alias("seed"))

    def run(box: Box, pdf: pd.DataFrame) -> pd.DataFrame:
        isseed = pdf["seed"].notna()
        told = pdf[isseed]
        pdf = pdf[~isseed].sort_values(list(own)).reset_index(drop=True)
        if not len(pdf):
            return pd.DataFrame({**{a: [] for a in own}, "label": pd.array([], "Int64")})
        coords = [pdf[a].to_numpy(np.int64) for a in own]
        node = np.ravel_multi_index(coords, shape)
        full = box.rows(coords)
        value, edges = pdf["value"].to_numpy(), []
        for a, b in faces(full):
            edges += zip(node[a].tolist(), node[b].tolist(), MODES[mode](value[a], value[b]).tolist(), strict=True)
        seed = dict(zip(np.ravel_multi_index([told[a].to_numpy(np.int64) for a in own], shape).tolist(), told["seed"].astype("int64").tolist(), strict=True))
        linked = {x for u, v, _ in edges for x in (u, v)}
        unknown = max([0, *seed.values()]) + 1
        rim = node[box.unseen(coords)].tolist()
        # virtual seeds of negative id come before all others
        edges += [(-1 - k, x, -math.inf) for k, x in enumerate(rim)]
        seed |= {-1 - k: unknown for k in range(len(rim))}
        seed = {x: s for x, s in seed.items() if x < 0 or x in linked}
        labels = kernel(edges, seed, *([dict(zip(node.tolist(), value.tolist(), strict=True))] if tall else []))
        inner = box.inside(coords)
        inner[inner] = [x in linked for x in node[inner].tolist()]
        found = [labels[x] for x in node[inner].tolist()]
        return pd.DataFrame({**{a: c[inner] for a, c in zip(own, coords, strict=True)}, "label": pd.array([None if x == unknown else x for x in found], "Int64")})

    out = until_certain(px.union(mark), [0] * len(shape), list(shape), run, "label long", **sizes)
    return out.select(coordinate_to_node([F.col(a) for a in own], shape).alias("node"), "label")


def distances(vox: DataFrame, threshold: float, **sizes: int) -> DataFrame:
    """(z, y, x, value): Euclidean distance in each slice to the nearest pixel with value above the threshold; by columns, then rows."""
    begin, end = bounds(vox)

    def run(box: Box, pdf: pd.DataFrame) -> pd.DataFrame:
        (y0, x0), (y1, x1) = box.low[1:], box.high[1:]
        h, w = y1 - y0, x1 - x0
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        wall = np.zeros((h, w), bool)
        wall[y - y0, x - x0] = pdf["value"].to_numpy() > threshold
        g = np.where(wall, 0.0, np.inf)
        for i in range(1, h):
            g[i] = np.minimum(g[i], g[i - 1] + 1)
        for i in range(h - 2, -1, -1):
            g[i] = np.minimum(g[i], g[i + 1] + 1)
        step = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
        inner = box.inside([pdf["z"].to_numpy(np.int64), y, x])
        iy, ix = y[inner] - y0, x[inner] - x0
        d = np.full((h, w), np.inf)
        for i in np.unique(iy):
            d[i] = (g[i][None, :] ** 2 + step).min(axis=1)
        found = np.sqrt(d[iy, ix])
        # a pixel beyond the halo is at least this far
        far = np.full(len(iy), np.inf)
        for c, lo, hi, o, e in ((iy + y0, y0, y1, begin[1], end[1]), (ix + x0, x0, x1, begin[2], end[2])):
            far = np.minimum(far, np.minimum(c - lo + 1 if lo > o else np.inf, hi - c if hi < e else np.inf))
        sure = found <= far
        return pdf.loc[inner, list(AXES3)].assign(value=pd.arrays.FloatingArray(np.where(sure, found, 0.0), ~sure))

    return until_certain(vox.select(*AXES3, "value"), begin, end, run, "value double", flat=(0,), **sizes)


def same_label_mean(vox: DataFrame, sigma: float, r: int, **sizes: int) -> DataFrame:
    """(coordinates, value): Gaussian-weighted mean over pixels of the same label and positive value within r along each axis; 0 without any."""
    own = axes_of(vox)
    rows = vox.select(*own, F.col("value").cast("double").alias("value"), F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNotNull().alias("known"), F.coalesce(F.col("value") > 0, F.lit(False)).alias("ok"))

    def run(box: Box, pdf: pd.DataFrame) -> pd.DataFrame:
        coords = [pdf[a].to_numpy(np.int64) for a in own]
        full = box.rows(coords)
        at = [c - int(c.min()) for c in coords]
        full = np.pad(full, r, constant_values=-1)
        label, value = pdf["label"].to_numpy(), pdf["value"].to_numpy()
        known, ok = pdf["known"].to_numpy(bool), pdf["ok"].to_numpy(bool)
        num, den = np.zeros(len(pdf)), np.zeros(len(pdf))
        for s in itertools.product(range(-r, r + 1), repeat=len(own)):
            w = math.exp(-sum(d * d for d in s) / (2 * sigma * sigma))
            q = full[tuple(c + r + d for c, d in zip(at, s, strict=True))]
            use = np.flatnonzero((q >= 0) & ok[q] & known & known[q] & (label[q] == label))
            num[use] += w * value[q[use]]
            den[use] += w
        inner = box.inside(coords)
        out = np.divide(num, den, out=np.zeros(len(pdf)), where=den > 0)
        return pd.DataFrame({**{a: c[inner] for a, c in zip(own, coords, strict=True)}, "value": out[inner]})

    begin, end = bounds(vox)
    return until_certain(rows, begin, end, run, "value double", halo=r, **sizes)


def components(vox: DataFrame, shape: Sequence[int], background: bool, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """((node, part), (u, v)): the parts of equal label in each tile by their smallest node, and pairs of parts that touch across tiles.

    With background, pixels of label 0 are left out. Pixels without a label stand alone.
    """
    own = axes_of(vox)
    b = Blocking([0] * len(shape), list(shape), tile_of(shape, size))
    rows = vox.select(*own, F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNotNull().alias("known"))
    rows = rows.where("label <> 0 and known") if background else rows

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(own))
        coords = [pdf[a].to_numpy(np.int64) for a in own]
        box = Box(int(key[0]), b, [0] * len(shape))
        full = box.rows(coords)
        label, known = pdf["label"].to_numpy(), pdf["known"].to_numpy(bool)
        pairs = [(p[ok], q[ok]) for p, q in faces(full) for ok in [(label[p] == label[q]) & known[p] & known[q]]]
        node = np.ravel_multi_index(coords, shape)
        part = node[least(len(pdf), np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))]
        rim = np.zeros(len(pdf), bool)
        for c, (lo, hi) in zip(coords, box.core, strict=True):
            rim |= (c == lo) | (c == hi - 1)
        return pd.DataFrame({"node": node, "part": part, "label": label, "rim": rim & known})

    placed = rows.withColumn("block_id", b.block_id([F.col(a) for a in own]))
    out = keep(deal(placed, "block_id").groupBy("block_id").applyInPandas(run, "node long, part long, label long, rim boolean"))
    rim = out.where("rim").select("node", "part", "label")
    up = rim.select(F.col("node").alias("to"), F.col("part").alias("v"), F.col("label").alias("l"))
    pos = node_to_coordinate(F.col("node"), shape)
    steps, pairs = [math.prod(shape[k + 1 :]) for k in range(len(shape))], None
    for k, step in enumerate(steps):
        last = (pos[k] % b.block[k] == b.block[k] - 1) & (pos[k] < shape[k] - 1)
        part = rim.where(last).withColumn("to", F.col("node") + step).join(up, "to").where("label = l").select(F.col("part").alias("u"), "v")
        pairs = part if pairs is None else pairs.union(part)
    return out.select("node", "part"), pairs.distinct()


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the set of each of 0..n-1 after joining the pairs (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while ((up := root[root]) != root).any():
            root = up



#: Pairs of points that are compared at once.
PAIRS = 1 << 21


def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct ids of the points of largest dist, smallest id of ties, within the dist of each point that asks."""
    # best first, so that the winner is the least row number
    pdf = pdf.sort_values(["dist", "id"], ascending=[False, True], na_position="last")
    y, x, reach = (pdf[c].to_numpy(float) for c in ("y", "x", "dist"))
    ask = np.flatnonzero(pdf["ask"].to_numpy(bool))
    power = np.ceil(np.log2(np.fmax(reach, 1.0))).astype(int)
    power += np.exp2(power) < reach
    won = []
    for k in np.unique(power[ask]):
        who = ask[power[ask] == k]
        cy, cx = (np.floor((c - c.min()) / 2.0**k).astype(np.int64) + 1 for c in (y, x))
        wide = int(cx.max()) + 2
        cell = cy * wide + cx
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        best = np.full(len(who), len(y))
        for dy in (-1, 0, 1):
            at = (cy[who] + dy) * wide + cx[who]
            first, last = np.searchsorted(cell, at - 1, "left"), np.searchsorted(cell, at + 1, "right")
            ends = np.cumsum(last - first)
            cuts = [0, *np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) + 1, PAIRS), "left").tolist(), len(who)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                n = last[lo:hi] - first[lo:hi]
                some = np.flatnonzero(n) + lo
                n = n[n > 0]
                if not len(n):
                    continue
                start = np.cumsum(n) - n
                q = order[np.repeat(first[some] - start, n) + np.arange(int(n.sum()))]
                p = np.repeat(who[some], n)
                near = (y[q] - y[p]) ** 2 + (x[q] - x[p]) ** 2 <= reach[p] * reach[p]
                best[some] = np.minimum(best[some], np.minimum.reduceat(np.where(near, q, len(y)), start))
        won.append(best[best < len(y)])
    ids = np.unique(np.concatenate(won)) if won else np.zeros(0, int)
    return pdf.iloc[ids][["id"]]
