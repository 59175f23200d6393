"""Growth of labels into cells that pass a threshold.

Growth goes by tiles: a shuffle of tiles' borders for several hops, and only of tiles near a change. Where labels overwrite
each other a hop is windows along the axes, one label after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY, line
from . import tiles
from .components import written

#: Hops between two rows of the log, and between two written tables where windows do the hops.
HOPS = 4
#: Hops of a round by tiles, and the most hops of a threshold that grows to its end.
ROUND = 8
MOST = 200


def hop(cells: DataFrame, passes: Column, rule: str = "max", ids: Iterable[int] | None = None) -> DataFrame:
    """Empty cells that pass take the label of a neighbour: the highest (max), the lowest (min), or the first along +z, -z, +y, -y, +x, -x (first)."""
    own = F.when(F.col("label").isin(*ids), F.col("label")) if ids is not None else F.when(F.col("label") > 0, F.col("label"))
    cells = cells.withColumn("_g", own)
    if rule == "first":
        near = [f("_g").over(line(a)) for a in AXES for f in (F.lag, F.lead)]
        take = F.coalesce(*near)
    else:
        how = F.max if rule == "max" else F.min
        near = [how("_g").over(line(a).rowsBetween(-1, 1)) for a in AXES]
        take = (F.greatest if rule == "max" else F.least)(*near)
    return cells.withColumn("label", F.when(F.col("label") > 0, F.col("label")).when(passes, F.coalesce(take, F.lit(0))).otherwise(0).cast("int")).drop("_g")


def overwrite(cells: DataFrame, labels: Iterable[int]) -> DataFrame:
    """Labels in ascending order each dilate by the ball over everything; no threshold holds."""
    for k in sorted(labels):
        cells = cells.withColumn("_on", (F.col("label") == k).cast("int"))
        hits = [F.max("_on").over(line(a).rowsBetween(-1, 1)) for a in AXES]
        cells = cells.withColumn("label", F.when(F.greatest(*hits) == 1, k).otherwise(F.col("label"))).drop("_on")
    return cells


Save = Callable[[int, int, DataFrame], None]


def grow(
    cells: DataFrame,
    thresholds: list[int],
    steps: list[int] | None = None,
    rule: str = "max",
    uppers: list[int] | None = None,
    still: int | None = None,
    least: int = 1,
    ids: Iterable[int] | None = None,
    boundary: Column | None = None,
    every: list[int] | None = None,
    save: Save | None = None,
    hops: int = ROUND,
    tile: int = tiles.TILE,
) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Growth through falling thresholds, steps[i] hops each; a threshold ends early after `still` hops in a row that add fewer than `least` cells each.

    Returns img_id, z, y, x, v, label and a log of (threshold, hop, cells with a label, cells that pass or have one). Without steps
    a threshold grows to its end, in at most MOST hops. ids: the labels that grow, the others stay as they are; boundary: cells that
    no label enters. every[i]: hops after which the log has a row and save(threshold, hop, table) is called, as it is after a
    threshold's last hop; by default the log has one for every hop if `still` is set, else for each HOPS. rule: max or min of
    several labels that reach a cell, or `overwrite`, as overwrite() does. hops: of one round, at most `tile`.
    """
    ids = None if ids is None else list(ids)
    if rule == "overwrite":
        return _grow_over(cells, thresholds, steps or [MOST] * len(thresholds), uppers, still, least, ids, boundary)
    own = cells.withColumn("wall", F.lit(0) if boundary is None else boundary.cast("int"))
    at, log = written(tiles.tiled(own, ["v", "label", "wall"], tile), "tiles"), []
    n = None
    for i, low in enumerate(thresholds):
        high, count = None if uppers is None else uppers[i], MOST if steps is None else steps[i]
        seen_every = every[i] if every else 1 if still is not None else HOPS
        active, k, quiet, ended = None, 0, 0, False
        while k < count and not ended:
            size = min(hops, count - k, seen_every - k % seen_every if save else hops)
            after, sums, moved = _round(at, active, low, high, size, rule, ids, tile)
            for j, (now, full) in enumerate(sums, 1):
                quiet = quiet + 1 if n is not None and now - n < least else 0
                n = now
                ended = (still is not None and quiet >= still) or now == full or (steps is None and not moved and j == len(sums)) or k + j == count
                if ended or (k + j) % seen_every == 0:
                    log.append((low, k + j, now, full))
                if ended:
                    break
            if j < size and sums[j - 1] != sums[-1]:  # it ended within the round, and something grew after that
                after, _, _ = _round(at, active, low, high, j, rule, ids, tile)
            at, k = after, k + j
            active = tiles.near(at.where("changed").select(*tiles.PLACE, *tiles.SHAPE), tile)
            if save and (ended or k % seen_every == 0):
                save(low, k, tiles.untiled(at, ["v", "label"], tile))
            if not moved and not ended and not save:  # nothing will change: what is left of the log is known
                while k < count:
                    k += 1
                    quiet += 1
                    ended = (still is not None and quiet >= still and least > 0) or k == count
                    if ended or k % seen_every == 0:
                        log.append((low, k, *sums[-1]))
                    if ended:
                        break
    return tiles.untiled(at, ["v", "label"], tile), log


def _round(at: DataFrame, active: DataFrame | None, low: int, high: int | None, k: int, rule: str, ids: list[int] | None, tile: int) -> tuple[DataFrame, list[tuple[int, int]], bool]:
    """k hops by tiles: the tiles, after each hop (cells with a label, cells that pass or have one), and whether any changed."""
    grows = None if ids is None else np.array(ids, np.int32)

    def kernel(dense: dict[str, np.ndarray], there: np.ndarray) -> tuple[np.ndarray, list[int]]:
        v, label = dense["v"], dense["label"]
        passes = there & (v >= low) & (dense["wall"] == 0)
        passes = passes if high is None else passes & (v <= high)
        core, counts = tuple(slice(k, n - k) for n in label.shape), []
        for _ in range(k):
            label = tiles.hop_array(label, passes, grows, rule)
            counts += [int((label[core] > 0).sum()), int((passes | (label > 0))[core].sum())]
        return label, counts

    after = written(tiles.round_of(at, active, ["v", "label", "wall"], "label", k, kernel, tile), "grown")
    count = lambda i: F.sum(F.get("counts", F.least(F.lit(i), F.size("counts") - 2 + i % 2)))  # noqa: E731  a tile at rest keeps its last counts
    row = after.agg(F.max("changed"), *[count(i) for i in range(2 * k)]).first()
    return after, [(row[1 + 2 * j] or 0, row[2 + 2 * j] or 0) for j in range(k)], bool(row[0])


def _grow_over(cells: DataFrame, thresholds: list[int], steps: list[int], uppers: list[int] | None, still: int | None, least: int, ids: list[int] | None, boundary: Column | None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    log, n = [], None
    if ids is None:
        ids = [r["label"] for r in cells.where("label > 0").select("label").distinct().collect()]  # one plan step a label
    for i, (low, count) in enumerate(zip(thresholds, steps)):
        passes = (F.col("v") >= low) if uppers is None else F.col("v").between(low, uppers[i])
        passes = passes if boundary is None else passes & ~boundary
        quiet = 0
        for k in range(1, count + 1):
            cells = overwrite(cells, ids)
            if boundary is not None:
                cells = cells.withColumn("label", F.when(boundary, 0).otherwise(F.col("label")))
            if still is None and k % HOPS and k < count:
                continue
            cells = written(cells, "grown")
            row = cells.agg(F.count(F.when(F.col("label") > 0, 1)).alias("n"), F.count(F.when(passes | (F.col("label") > 0), 1)).alias("full")).first()
            log.append((low, k, row["n"], row["full"]))
            quiet = quiet + 1 if n is not None and row["n"] - n < least else 0
            n = row["n"]
            if still is not None and quiet >= still or row["n"] == row["full"]:
                break
    return cells, log


def flood(cells: DataFrame, start: int, target: int, rounds: int, hops: int = 5) -> DataFrame:
    """Thresholds falling evenly from start to target; up to `hops` hops a round, each cell taking its first labelled neighbour."""
    for i in range(1, rounds + 1):
        low = start - (start - target) * i // rounds
        for _ in range(hops):
            cells = hop(cells, F.col("v") > low, "first")
        cells = written(cells, "flood")
    return cells.select(*KEY, "v", "label")
