"""Problem 2: samples that match target category proportions.

Rates for the cells (category by band) are raked to the margins of the requested shares by
iterative proportional fitting; rows get weighted exponential keys and the least keys make
the sample; then minimums are repaired and what could not be met is reported.

Rows are only counted and filtered. Cells, which are as many as the targets have rows, are
fitted per request; the order of keys within a cell is found from a histogram of them, so no
cell's rows are ever sorted together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import outer_trim
from lexigrid.session import scratch

BINS = 4096
_CELL = ["request_id", "source", "band"]


def rake(available: np.ndarray, source: np.ndarray, band: np.ndarray, wanted: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Expected rows of each cell: margins of ``wanted`` over sources and bands, at most ``available``."""
    fitted = np.where(wanted > 0, available, 0).astype(float)
    margins = [(key, np.bincount(key, wanted)) for key in (source, band)]
    for _ in range(rounds):
        before = fitted.copy()
        for key, goal in margins:
            now = np.bincount(key, fitted, len(goal))
            fitted *= np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[key]
            fitted = np.minimum(fitted, available)
        if np.abs(fitted - before).max(initial=0) < 1e-9:
            break
    return fitted


def repair(drawn: np.ndarray, available: np.ndarray, least: np.ndarray, wanted: np.ndarray, source: np.ndarray, total: int) -> np.ndarray:
    """Rows to take of each cell: the minimums first, then as drawn, ``total`` in all where possible.

    Surplus leaves the cells that are furthest above what is wanted of them; what is missing
    comes from wanted cells with rows left, of the same source if it is short, else of any.
    """
    floor = np.minimum(least, available)
    take = np.clip(drawn, floor, available)
    while (over := int(take.sum()) - total) > 0 and (take > floor).any():
        at = int(np.argmax(np.where(take > floor, take - wanted, -np.inf)))
        rest = np.where((take > floor) & (np.arange(len(take)) != at), take - wanted, -np.inf).max(initial=-np.inf)
        step = min(over, take[at] - floor[at], max(1, int(np.ceil((take[at] - wanted[at]) - rest))) if np.isfinite(rest) else over)
        take[at] -= step
    while (under := total - int(take.sum())) > 0:
        room = np.where(wanted > 0, available - take, 0)
        if room.sum() == 0:
            break
        short = np.bincount(source, wanted - take)[source]
        open_cells = room > 0
        best = short[open_cells].max()
        chosen = open_cells & (short >= best - 1e-9)
        at = int(np.argmax(np.where(chosen, wanted - take, -np.inf)))
        step = min(under, room[at], max(1, int(np.ceil(max(wanted[at] - take[at], best / max(chosen.sum(), 1))))))
        take[at] += step
    return take


def passages(report: DataFrame, wikipedia: DataFrame) -> DataFrame:
    """Eligible passages ``(id, source, words)``: positive word count, and an article with a source."""
    rows = report.where("word_count > 0 and id is not null").groupBy("id", "article_id").agg(F.max("word_count").alias("words"))
    articles = wikipedia.where("source is not null").select("article_id", F.lower(outer_trim(F.col("source"))).alias("source"))
    return rows.join(articles, "article_id").groupBy("id").agg(F.min(F.struct("source", "words")).alias("x")).select("id", "x.*")


class QuotaSample:
    """A sample of ``rows`` ``(id, source, words)`` for every request in ``targets``.

    ``targets`` has ``request_id, source, band, min_words, max_words`` (inclusive),
    ``share_pct, min_rows, sample_pct``; ranges of one source and request should not overlap.
    A request's total is ``floor(rows * sample_pct / 100)``; a cell needs the larger of its
    minimum and ``floor(total * share_pct / 100)``. Rows with a null or unlisted source, or
    words outside every range, count in the total only. Null shares and minimums are 0.

    ``report()``: a row per target cell. ``sample()``: the rows drawn, ``(request_id, id,
    source, band, words)``. Without targets both are empty; without rows every need is its
    minimum. Ids must be unique: a repeated id is drawn with all its rows. The draw depends on
    ids and ``seed`` only.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, seed: int = 7):
        self.rows = scratch(rows.select("id", "source", "words"), "rows")
        self.targets = targets.select(
            "request_id", F.lower(outer_trim(F.col("source"))).alias("source"), "band", "min_words", "max_words",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("share_pct", "min_rows", "sample_pct")],
        )
        self.seed = seed
        self.cells = self._cells()
        self.plan = scratch(self._plan(), "plan")

    def _cells(self) -> DataFrame:
        """Targets with the rows that each finds, its total and its need."""
        sizes = self.rows.groupBy("source", "words").agg(F.count("*").alias("n"))
        eligible = self.rows.count()
        found = (
            self.targets.join(sizes, "source").where("words between min_words and max_words")
            .groupBy(_CELL).agg(F.sum("n").alias("available"))
        )
        return (
            self.targets.join(found, _CELL, "left").fillna(0, ["available"])
            .withColumn("eligible", F.lit(eligible).cast("long"))
            .withColumn("total", F.expr("eligible * sample_pct div 100"))
            .withColumn("need", F.expr("greatest(cast(min_rows as long), total * share_pct div 100)"))
        )

    def _keyed(self, cells: DataFrame) -> DataFrame:
        """Rows of every request with their bin: the place of their draw among ``BINS`` equal ones."""
        return (
            self.rows.join(cells, "source").where("words between min_words and max_words")
            .withColumn("draw", F.xxhash64(F.lit(self.seed), "request_id", "id"))
            .withColumn("bin", F.expr(f"cast(shiftrightunsigned(draw, {64 - BINS.bit_length() + 1}) as int)"))
        )

    def _plan(self) -> DataFrame:
        added = ", rate double, source_residual double, band_residual double"
        rated = self.cells.groupBy("request_id").applyInPandas(self._rates, self.cells.schema.simpleString()[7:-1] + added)
        bins = self._keyed(self.targets.select(*_CELL, "min_words", "max_words")).groupBy(*_CELL, "bin").agg(F.count("*").alias("n"))
        heights = bins.groupBy(_CELL).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("heights"))
        joined = rated.join(heights, _CELL, "left")
        out = rated.schema.simpleString()[7:-1] + ", drawn long, sampled long, last_bin int, of_last long"
        return joined.groupBy("request_id").applyInPandas(self._quotas, out)

    @staticmethod
    def _rates(cells: pd.DataFrame) -> pd.DataFrame:
        wanted = (cells["total"] * cells["share_pct"] / 100).to_numpy(float)
        codes = [pd.factorize(cells[c], use_na_sentinel=False)[0] for c in ("source", "band")]
        available = cells["available"].to_numpy(float)
        fitted = rake(available, *codes, wanted)
        # with keys -ln(u) / rate below 1, a row of the cell is drawn with the fitted probability
        share = np.divide(fitted, available, out=np.zeros_like(fitted), where=available > 0)
        # what raking leaves between the margins of a cell's source and band and those wanted
        left = [(np.bincount(c, fitted) - np.bincount(c, wanted))[c] for c in codes]
        return cells.assign(rate=-np.log1p(-np.minimum(share, 1 - 1e-12)), source_residual=left[0], band_residual=left[1])

    @staticmethod
    def _quotas(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.reset_index(drop=True)
        heights = np.zeros((len(cells), BINS), np.int64)
        for k, h in enumerate(cells["heights"]):
            if h:
                heights[k, np.fromiter(h.keys(), int, len(h))] = np.fromiter(h.values(), np.int64, len(h))
        # a row's key is -ln(1 - u) / rate, so the least keys of a cell are its least u
        edge = (np.arange(BINS) + 1) / BINS
        with np.errstate(divide="ignore", invalid="ignore"):
            keys = -np.log1p(-edge)[None, :] / cells["rate"].to_numpy()[:, None]
        keys = np.where(np.isfinite(keys), keys, np.inf)
        total = int(cells["total"].iloc[0]) if len(cells) else 0
        order = np.argsort(keys, axis=None, kind="stable")
        finite = order[np.isfinite(keys.ravel()[order])]
        within = finite[np.cumsum(heights.ravel()[finite]) <= total]
        drawn = np.zeros_like(heights)
        drawn.ravel()[within] = heights.ravel()[within]
        drawn = drawn.sum(axis=1)
        wanted = (cells["total"] * cells["share_pct"] / 100).to_numpy(float)
        source = pd.factorize(cells["source"], use_na_sentinel=False)[0]
        take = repair(drawn, cells["available"].to_numpy(np.int64), cells["need"].to_numpy(np.int64), wanted, source, total)
        reach = heights.cumsum(axis=1)
        last = (reach < take[:, None]).sum(axis=1)
        below = np.where(last > 0, reach[np.arange(len(cells)), np.maximum(last - 1, 0)], 0)
        return cells.drop(columns="heights").assign(drawn=drawn, sampled=take, last_bin=np.where(take > 0, last, -1), of_last=np.where(take > 0, take - below, 0))

    def report(self) -> DataFrame:
        """Target cells with what was asked, found and sampled.

        ``gap`` is what a cell's sample lacks of its need, ``short`` whether it lacks any, ``surplus`` what it
        has above its need, which fills up totals that other cells could not. ``source_residual``
        and ``band_residual`` are the rows by which the raked margins miss the wanted ones.
        """
        return self.plan.select(
            *_CELL, "min_words", "max_words", "share_pct", "min_rows", "available", "total", "need", F.expr("sampled < need").alias("short"), "rate",
            "drawn", "sampled", F.expr("greatest(need - sampled, 0)").alias("gap"), F.expr("greatest(sampled - need, 0)").alias("surplus"), "source_residual", "band_residual",
        )

    def sample(self) -> DataFrame:
        keyed = self._keyed(self.plan.where("sampled > 0").select(*_CELL, "min_words", "max_words", "last_bin", "of_last"))
        columns = [*_CELL, "id", "words"]
        sure = keyed.where("bin < last_bin").select(columns)
        # only the rows of one bin of a cell are ranked, about a 4096th of it
        rest = keyed.where("bin = last_bin").withColumn("place", F.expr("row_number() over (partition by request_id, source, band order by draw, id)"))
        return sure.union(rest.where("place <= of_last").select(columns))
