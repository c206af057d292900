"""Map buffers: ordered events of many buffers replayed, each buffer on its own.

Events (buffer_id, seq, kind, ...) in the order of seq: INIT and CAPACITY set the number of stored frames (a smaller one shrinks
nothing), FRAME appends a frame of labels, JOINT settles the last frame's partial objects, READ asks for an area, CLEAR drops the frames (and, with `reset`, the index
base and what was learnt of objects), REMOVE forgets the buffer.
An append re-indexes the labels, is linked with all stored frames, the one about to leave among them, then drops at most one and
joins the store. The state is what the stored frames hold, the representatives of linked labels and the set of partial objects.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.components import Union
from tessera.operators.labels import NO_LABEL, linked_labels

EVENTS = "buffer_id long, seq long, kind string, capacity int, reset boolean, min_x long, min_y long, w int, h int, labels array<long>"
RESULTS = "buffer_id long, seq long, base long, n_stored int, evicted long, object1 long, object2 long"
LIMIT = 2147483647


@dataclass
class Frame:
    seq: int
    min_x: int
    min_y: int
    labels: np.ndarray  # (h, w), re-indexed

    @property
    def max_x(self) -> int:
        return self.min_x + self.labels.shape[1] - 1

    @property
    def max_y(self) -> int:
        return self.min_y + self.labels.shape[0] - 1


@dataclass
class Buffer:
    """One buffer's state and its rules."""

    capacity: int = 1
    base: int = 0
    frames: deque = field(default_factory=deque)
    union: Union = field(default_factory=Union)
    partial: set = field(default_factory=set)

    def facing(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Labels of the stored frames at some pixels, the latest first; NO_LABEL where there is none."""
        out = np.full(len(xs), NO_LABEL, np.int64)
        for f in self.frames:
            inside = (xs >= f.min_x) & (xs <= f.max_x) & (ys >= f.min_y) & (ys <= f.max_y)
            out[inside] = f.labels[ys[inside] - f.min_y, xs[inside] - f.min_x]
        return out

    def sides(self, frame: Frame) -> list[tuple[np.ndarray, np.ndarray]]:
        """The labels along each of a frame's sides and those that face them."""
        h, w = frame.labels.shape
        across, down = np.arange(frame.min_x, frame.max_x + 1), np.arange(frame.min_y, frame.max_y + 1)
        around = (frame.labels[:, 0], np.full(h, frame.min_x - 1), down), (frame.labels[0], across, np.full(w, frame.min_y - 1)), (frame.labels[:, -1], np.full(h, frame.max_x + 1), down), (frame.labels[-1], across, np.full(w, frame.max_y + 1))
        return [(own, self.facing(xs, ys)) for own, xs, ys in around]

    def read(self, min_x: int, min_y: int, w: int, h: int, outside: int = 0) -> np.ndarray:
        """The labels of an area (h, w): the last frame's at each pixel, `outside` where there is none."""
        ys, xs = (v.ravel() for v in np.mgrid[min_y : min_y + h, min_x : min_x + w])
        found = self.facing(xs, ys)
        return np.where(found == NO_LABEL, outside, found).reshape(h, w)

    def change(self, rect: tuple[int, int, int, int] | None, kind: str, x: int, y: int, covered: bool = False, within: tuple[int, int, int, int] | None = None) -> tuple[int, int, int, int]:
        """A rectangle (min_x, max_x, min_y, max_y), the last frame's without one, expanded or shifted in a diagonal direction, and clipped to another.

        What was there before must be covered by the stored frames if asked for, and the last frame always is. Not to meet the other rectangle is an error.
        """
        if rect is None:
            if not self.frames:
                raise ValueError("there is no frame")
            last = self.frames[-1]
            rect = last.min_x, last.max_x, last.min_y, last.max_y
        a, b, c, d = rect
        if covered and (self.read(a, c, b - a + 1, d - c + 1, NO_LABEL) == NO_LABEL).any():
            raise ValueError("the rectangle isn't covered by the stored frames")
        if kind == "EXPAND":
            a, b, c, d = a - x, b + x, c - y, d + y
        else:
            dx, dy = x if kind.startswith("RIGHT") else -x, y if kind.endswith("DOWN") else -y
            a, b, c, d = a + dx, b + dx, c + dy, d + dy
        if within is not None:
            a, b, c, d = max(a, within[0]), min(b, within[1]), max(c, within[2]), min(d, within[3])
            if a > b or c > d:
                raise ValueError("the rectangles don't meet")
        return a, b, c, d

    def based(self, labels: np.ndarray) -> np.ndarray:
        """The labels' representatives."""
        names, at = np.unique(labels, return_inverse=True)
        return np.array([self.union.base(int(x)) if x > 0 else int(x) for x in names], np.int64)[at].reshape(labels.shape)

    def joint(self) -> set[int]:
        """Settles partial objects along the last frame's sides and gives the representatives that are completed there.

        An object is on the boundary if its representative has a pixel next to one that no stored frame covers. Of the labels facing the frame, those not on the
        boundary are complete and no longer partial; the frame's own labels at its sides whose representatives are on the boundary are partial.
        """
        if not self.frames:
            raise ValueError("there is no frame")
        x0, y0 = min(f.min_x for f in self.frames) - 1, min(f.min_y for f in self.frames) - 1
        x1, y1 = max(f.max_x for f in self.frames) + 1, max(f.max_y for f in self.frames) + 1
        labels = self.read(x0, y0, x1 - x0 + 1, y1 - y0 + 1, NO_LABEL)
        open_ = labels == NO_LABEL
        edge = np.zeros(labels.shape, bool)
        edge[1:] |= open_[:-1]
        edge[:-1] |= open_[1:]
        edge[:, 1:] |= open_[:, :-1]
        edge[:, :-1] |= open_[:, 1:]
        boundary = set(self.based(labels[edge & ~open_]).tolist())
        completed = set()
        for own, adjacent in self.sides(self.frames[-1]):
            for mine, other in zip(own.tolist(), adjacent.tolist(), strict=True):
                if other != NO_LABEL and (base := self.union.base(other) if other else 0) not in boundary:
                    completed.add(base)
                    self.partial.discard(other)
                if mine and self.union.base(mine) in boundary:
                    self.partial.add(mine)
        return completed

    def correlations(self, start: int = 1) -> list[tuple[int, int, bool, bool]]:
        """(label, base, raw_partial, partial) of all labels in use: partial if it and its base are, and so are all members of its component below the last raw partial label."""
        last = max(self.partial, default=-1)
        rows = [(k, self.union.base(k) if k else 0, k in self.partial) for k in range(start, self.base + 1)]
        every: dict[int, bool] = {}
        for k, base, raw in rows:
            if k <= last or k == base:
                every[base] = every.get(base, True) and raw
        return [(k, base, raw, raw and every.get(base, False)) for k, base, raw in rows]

    def append(self, seq: int, min_x: int, min_y: int, labels: np.ndarray) -> tuple[list[tuple[int, int]], int | None]:
        """The links of the new frame, and the frame that left. Errors: other sizes than the stored frames', labels below 0 or too large."""
        if self.frames and self.frames[0].labels.shape != labels.shape:
            raise ValueError("all frames of a buffer have one size")
        top = int(labels.max(initial=0))
        if labels.min(initial=0) < 0 or top + self.base >= LIMIT:
            raise ValueError("label out of range")
        frame = Frame(seq, min_x, min_y, np.where(labels == 0, 0, labels + self.base))
        self.base += top
        links = []
        for own, adjacent in self.sides(frame):
            if (adjacent != NO_LABEL).any():
                links += linked_labels(own, adjacent)
        for a, b in links:
            self.union.join(a, b)
        gone = self.frames.popleft().seq if len(self.frames) >= self.capacity else None
        self.frames.append(frame)
        return links, gone

    def apply(self, e) -> list[tuple]:
        """Rows (seq, base, n_stored, evicted, object1, object2) of an event: one for each link of a frame, or one without."""
        if e.kind in ("INIT", "CAPACITY"):
            self.capacity = int(e.capacity)
            return []
        if e.kind in ("CLEAR", "REMOVE"):
            self.frames.clear()
            if e.kind == "REMOVE" or e.reset:
                self.base, self.union, self.partial = 0, Union(), set()
            return []
        if e.kind == "READ":
            return []
        if e.kind == "JOINT":
            self.joint()
            return []
        before = self.base
        links, gone = self.append(int(e.seq), int(e.min_x), int(e.min_y), np.asarray(e.labels, np.int64).reshape(int(e.h), int(e.w)))
        return [(int(e.seq), before, len(self.frames), gone, a, b) for a, b in links or [(None, None)]]


def frame_rows(buffer_id: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["seq", "base", "n_stored", "evicted", "object1", "object2"])
    out.insert(0, "buffer_id", buffer_id)
    return out.astype({"evicted": "Int64", "object1": "Int64", "object2": "Int64"})


def replay(events: DataFrame) -> DataFrame:
    """RESULTS of each buffer's events in their order. Buffers run in parallel; one buffer is sequential by nature and holds `capacity` frames."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer, rows = Buffer(), []
        for e in pdf.sort_values("seq").itertuples(index=False):
            rows += buffer.apply(e)
        return frame_rows(int(pdf["buffer_id"].iloc[0]), rows)

    return events.groupBy("buffer_id").applyInPandas(run, RESULTS)


def reads(events: DataFrame) -> DataFrame:
    """buffer_id, seq, x, y, v: what each READ event's area (min_x, min_y, w, h) holds when its turn comes, zero where no frame is; with `reset` labels are replaced by their representatives."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer, parts = Buffer(), []
        for e in pdf.sort_values("seq").itertuples(index=False):
            buffer.apply(e)
            if e.kind == "READ":
                v = buffer.read(int(e.min_x), int(e.min_y), int(e.w), int(e.h))
                v = buffer.based(v) if e.reset else v
                y, x = np.indices(v.shape)
                parts.append(pd.DataFrame({"buffer_id": int(pdf["buffer_id"].iloc[0]), "seq": int(e.seq), "x": x.ravel() + int(e.min_x), "y": y.ravel() + int(e.min_y), "v": v.ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("buffer_id", "seq", "x", "y", "v")})

    return events.groupBy("buffer_id").applyInPandas(run, "buffer_id long, seq long, x long, y long, v long")


def correlation_tables(events: DataFrame, start: int = 1) -> DataFrame:
    """buffer_id, label, base, raw_partial, partial of every label of each buffer after its last event; start is 0 or 1."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = Buffer()
        for e in pdf.sort_values("seq").itertuples(index=False):
            buffer.apply(e)
        out = pd.DataFrame(buffer.correlations(start), columns=["label", "base", "raw_partial", "partial"])
        out.insert(0, "buffer_id", int(pdf["buffer_id"].iloc[0]))
        return out.astype({"label": "int64", "base": "int64", "raw_partial": bool, "partial": bool})

    return events.groupBy("buffer_id").applyInPandas(run, "buffer_id long, label long, base long, raw_partial boolean, partial boolean")
