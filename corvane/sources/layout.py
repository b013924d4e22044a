"""Reading order of positioned boxes on pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A box that is wider than this share of what it stands among spans columns.
SPANS = 0.6


def widest_gap(low: np.ndarray, high: np.ndarray, least: float) -> tuple[float, float] | None:
    """The widest stretch between intervals that none covers, if it is ``least`` wide."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])
    gaps = low[order][1:] - reach[:-1]
    if not len(gaps) or gaps.max() < least:
        return None
    i = int(gaps.argmax())
    return float(reach[i]), float(low[order][i + 1])


def page_order(boxes: np.ndarray, gutter: float, leading: float) -> list[int]:
    """Rows of ``boxes`` (x0, y0, x1, y1, downwards) as they are read.

    Where boxes that don't span leave a gutter, what spans it parts the page into bands, and each band is read column after column.
    Where there is none, the page is cut at its widest horizontal gap; what can't be cut is read line by line.
    """

    def lines(rows: list[int]) -> list[int]:
        """By lines: boxes whose middles lie within half a height of each other are one, from left to right."""
        out, line, base = [], [], None
        for i in sorted(rows, key=lambda i: (boxes[i, 1] + boxes[i, 3], i)):
            middle, half = (boxes[i, 1] + boxes[i, 3]) / 2, (boxes[i, 3] - boxes[i, 1]) / 2
            if base is not None and middle - base > half:
                out, line, base = out + sorted(line, key=lambda j: (boxes[j, 0], j)), [], None
            base = middle if base is None else base
            line.append(i)
        return out + sorted(line, key=lambda j: (boxes[j, 0], j))

    done: list[int] = []
    waiting = [list(range(len(boxes)))]
    while waiting:  # parts that are still to be read, the next one last
        rows = waiting.pop()
        if len(rows) < 2:
            done += rows
            continue
        own = boxes[rows]
        width = own[:, 2].max() - own[:, 0].min()
        narrow = own[:, 2] - own[:, 0] <= SPANS * width
        gap = widest_gap(own[narrow, 0], own[narrow, 2], gutter) if narrow.sum() > 1 else None
        if gap:
            middle = sum(gap) / 2
            across = sorted((i for i in rows if boxes[i, 0] < middle < boxes[i, 2]), key=lambda i: (boxes[i, 1], i))
            rest = [i for i in rows if i not in set(across)]
            parts, from_ = [], -np.inf
            for i in [*across, None]:
                to = np.inf if i is None else boxes[i, 1]
                band = [j for j in rest if from_ <= (boxes[j, 1] + boxes[j, 3]) / 2 < to]
                parts += [[j for j in band if boxes[j, 2] <= middle], [j for j in band if boxes[j, 0] >= middle], [] if i is None else [i]]
                from_ = to
            waiting += reversed([p for p in parts if p])
            continue
        gap = widest_gap(own[:, 1], own[:, 3], leading)
        if gap:
            waiting += [[i for i in rows if boxes[i, 1] >= gap[1]], [i for i in rows if boxes[i, 3] <= gap[0]]]
        else:
            done += lines(rows)
    return done


def reading_order(boxes: DataFrame, gutter: float = 15.0, leading: float = 25.0) -> DataFrame:
    """document_id, page, box_id, position (from 0, within the page) of ``boxes``: document_id, page, box_id, x0, y0, x1, y1.

    A page is a group; its boxes are as many as a page holds. Boxes with a null or non-finite edge come last, by id.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id").reset_index(drop=True)
        edges = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        known = np.isfinite(edges).all(1)
        read = [int(i) for i in np.flatnonzero(known)[page_order(edges[known], gutter, leading)]] if known.any() else []
        rows = read + [int(i) for i in np.flatnonzero(~known)]
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[rows].to_numpy(), "page": pdf["page"].iloc[rows].to_numpy(), "box_id": pdf["box_id"].iloc[rows].to_numpy(), "position": np.arange(len(rows))})

    own = boxes.select("document_id", "page", "box_id", *[boxes[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return own.groupBy("document_id", "page").applyInPandas(order, "document_id long, page long, box_id long, position int")
