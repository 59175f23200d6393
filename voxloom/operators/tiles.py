"""Images as tiles, and steps over neighbours that need one shuffle for several hops.

A tile is a row: its place, its shape and each column's cells as bytes. What happens to a cell within k hops depends on the cells
within k of it, so tiles send their borders of k cells to their neighbours, and each then does k hops on its own. Only tiles that
changed, or whose neighbours did, take part in the next round; the others are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY, dealt

#: Cells on each side of a tile: a column of a tile has at most 128 KB.
TILE = 32
PLACE = ["img_id", "tz", "ty", "tx"]
SHAPE = ["nz", "ny", "nx"]
_TILES = "img_id int, tz int, ty int, tx int, nz int, ny int, nx int"


def tiled(cells: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """A dense table as tiles: place, shape, and each column as bytes of 32-bit integers in raster order. All of a tile's cells must be there."""
    corner = [F.expr(f"cast({a} div {tile} as int)").alias(f"t{a}") for a in AXES]
    rows = cells.select(*KEY, *[F.col(c).cast("int").alias(c) for c in columns], *corner)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        at = [part[a].to_numpy() - part[f"t{a}"].iloc[0] * tile for a in AXES]
        shape = [int(a.max()) + 1 for a in at]
        place = np.ravel_multi_index(at, shape)
        out = {c: int(part[c].iloc[0]) for c in PLACE} | dict(zip(SHAPE, shape))
        for c in columns:
            dense = np.zeros(int(np.prod(shape)), np.int32)
            dense[place] = part[c].to_numpy()
            out[c] = dense.tobytes()
        return pd.DataFrame([out])

    found = dealt(rows, PLACE).groupBy(*PLACE).applyInPandas(pack, f"{_TILES}, {', '.join(f'{c} binary' for c in columns)}")
    return found.withColumn("counts", F.lit(None).cast("array<bigint>"))


def untiled(tiles: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """The dense table of tiles' columns."""

    def unpack(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                at = np.indices((row.nz, row.ny, row.nx), dtype=np.int32).reshape(3, -1)
                out = {"img_id": row.img_id} | {a: at[i] + getattr(row, f"t{a}") * tile for i, a in enumerate(AXES)}
                yield pd.DataFrame(out | {c: np.frombuffer(getattr(row, c), np.int32) for c in columns}).astype("int32")

    return tiles.select(*PLACE, *SHAPE, *columns).mapInPandas(unpack, ", ".join(f"{c} int" for c in [*KEY, *columns]))


def _side(d: int, n: int, k: int) -> slice:
    """Of n cells along an axis those within k of the neighbour on side d (0: all)."""
    return slice(0, min(k, n)) if d < 0 else slice(max(0, n - k), n) if d > 0 else slice(0, n)


def _borders(columns: list[str], k: int, tile: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each tile for itself, and its borders for its neighbours: place of the receiver, side from which it comes, shape, bytes. A tile that isn't full is the last along that axis."""

    def send(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                shape = (row.nz, row.ny, row.nx)
                dense = [np.frombuffer(getattr(row, c), np.int32).reshape(shape) for c in columns]
                out = []
                sides = [[0, *([-1] if t > 0 else []), *([1] if n == tile else [])] for t, n in zip((row.tz, row.ty, row.tx), shape)]
                for d in product(*sides):
                    cut = tuple(_side(s, n, k) for s, n in zip(d, shape))
                    own = [np.ascontiguousarray(x[cut]) for x in dense]
                    out.append((row.img_id, row.tz + d[0], row.ty + d[1], row.tx + d[2], *own[0].shape, *(-s for s in d), *(x.tobytes() for x in own)))
                yield pd.DataFrame(out, columns=[*PLACE, *SHAPE, "dz", "dy", "dx", *columns])

    return send


Kernel = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, list[int]]]


def round_of(tiles: DataFrame, active: DataFrame | None, columns: list[str], changing: str, k: int, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """tiles after k hops, with `changed` and `counts`, which the kernel makes for each hop.

    kernel: (columns as arrays with a border of k cells, where cells exist) -> the changing column and counts of the tile's own
    cells after each hop. active: places of the tiles that take part (None: all); of the others changed is false and counts stay.
    """
    sent = tiles.select(*PLACE, *SHAPE, *columns).mapInPandas(_borders(columns, k, tile), f"{_TILES}, dz int, dy int, dx int, {', '.join(f'{c} binary' for c in columns)}")
    around = dealt(sent, PLACE).join(tiles.select(*PLACE) if active is None else active, PLACE, "left_semi")  # borders beyond an image's end have no receiver

    def step(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part.itertuples(index=False))
        own = next((r for r in rows if (r.dz, r.dy, r.dx) == (0, 0, 0)), None)
        if own is None:  # active places may lie beyond an image's end
            return pd.DataFrame(columns=names)
        shape = (own.nz, own.ny, own.nx)
        there = np.zeros([n + 2 * k for n in shape], bool)
        dense = {c: np.zeros(there.shape, np.int32) for c in columns}
        for r in rows:
            place = []
            for d, n, m in zip((r.dz, r.dy, r.dx), shape, (r.nz, r.ny, r.nx)):
                place.append(slice(k - m, k) if d < 0 else slice(k + n, k + n + m) if d > 0 else slice(k, k + n))
            there[tuple(place)] = True
            for c in columns:
                dense[c][tuple(place)] = np.frombuffer(getattr(r, c), np.int32).reshape((r.nz, r.ny, r.nx))
        core = tuple(slice(k, k + n) for n in shape)
        before = dense[changing][core].copy()
        after, counts = kernel(dense, there)
        mine = np.ascontiguousarray(after[core])
        out = {c: getattr(own, c) for c in [*PLACE, *SHAPE, *columns]} | {changing: mine.tobytes(), "changed": bool((mine != before).any()), "counts": counts}
        return pd.DataFrame([out], columns=names)

    names = [*PLACE, *SHAPE, *columns, "changed", "counts"]
    kinds = f"{_TILES}, {', '.join(f'{c} binary' for c in columns)}, changed boolean, counts array<bigint>"
    done = around.groupBy(*PLACE).applyInPandas(step, kinds)
    if active is None:
        return done
    idle = tiles.join(active, PLACE, "left_anti").select(*PLACE, *SHAPE, *columns, F.lit(False).alias("changed"), "counts")
    return done.unionByName(idle)


def near(changed: DataFrame, tile: int = TILE) -> DataFrame:
    """Places of the given tiles (with their shapes) and of all around them within the images, but for a full tile at an image's end; some of them several times."""
    for a in AXES:
        around = F.array(F.col(f"t{a}"), F.when(F.col(f"t{a}") > 0, F.col(f"t{a}") - 1), F.when(F.col(f"n{a}") == tile, F.col(f"t{a}") + 1))
        changed = changed.withColumn(f"t{a}", F.explode(F.array_compact(around)))
    return changed.select(*PLACE)


def hop_array(label: np.ndarray, passes: np.ndarray, grows: np.ndarray | None, rule: str) -> np.ndarray:
    """One hop: empty cells that pass take the highest (max) or lowest (min) growing label of their face neighbours."""
    own = label if grows is None else np.where(np.isin(label, grows), label, 0)
    far = np.iinfo(np.int32).max
    spread = own if rule == "max" else np.where(own > 0, own, far)
    best = spread.copy()
    how = np.maximum if rule == "max" else np.minimum
    for axis in range(3):
        front, back = [slice(None)] * 3, [slice(None)] * 3
        front[axis], back[axis] = slice(1, None), slice(None, -1)
        for a, b in ((tuple(front), tuple(back)), (tuple(back), tuple(front))):
            best[a] = how(best[a], spread[b])
    best = np.where(best == far, 0, best)
    return np.where(label > 0, label, np.where(passes, best, 0)).astype(np.int32)
