"""Tracking boxes over time: a Kalman filter a track, corrected by what was observed (the published OC-SORT method).

Boxes of enough confidence are matched to the tracks' predicted boxes by overlap plus agreement of direction; tracks
left over are tried again from their last observed box; what is left starts new tracks. A track that is found again
after a gap is filtered anew along the straight line over the gap. Pairs are chosen so that their scores' total is as
large as it can be. A box has track_id -1 until its track was seen in `min_frames` frames in a row, and if its
confidence is low.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from groundflow.sources.kept import forget, kept

BOX = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class Params:
    min_frames: int = 3
    high_conf: float = 0.6
    min_iou: float = 0.3
    lost_frames: int = 30
    direction_weight: float = 0.2
    look_back: int = 3


#: The noise of the motion model on (centre x, centre y, area, ratio, and the first three's speeds).
DRIFT = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
ERROR = np.diag([1.0, 1, 10, 10])
START = np.diag([10.0, 10, 10, 10, 10_000, 10_000, 10_000])


def _measured(boxes: np.ndarray) -> np.ndarray:
    w, h = np.maximum(boxes[:, 2] - boxes[:, 0], 1e-6), np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, w / h], axis=1)


def _boxes(mean: np.ndarray) -> np.ndarray:
    w = np.sqrt(np.maximum(mean[:, 2] * mean[:, 3], 1e-6))
    h = np.maximum(mean[:, 2], 1e-6) / w
    return np.stack([mean[:, 0] - w / 2, mean[:, 1] - h / 2, mean[:, 0] + w / 2, mean[:, 1] + h / 2], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each box of a with each of b. Worked out in place: there are many pairs."""
    w = np.minimum(a[:, None, 2], b[None, :, 2])
    w -= np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3])
    h -= np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.multiply(np.maximum(w, 0, out=w), np.maximum(h, 0, out=h), out=w)
    size = lambda r: (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
    of_any = np.add(size(a)[:, None], size(b)[None], out=h)
    of_any -= both
    return np.divide(both, np.maximum(of_any, 1e-9, out=of_any), out=both)


#: Boxes of the left side that are compared at once with those that lie beside them.
STRIP = 64


def near_pairs(a: np.ndarray, b: np.ndarray, least: float, score: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a box of a and one of b that overlap by `least` (more than 0) or more, with the overlap; with `score`, those for which
    score(rows, columns, overlaps) is positive, with that. Boxes are taken from left to right in strips, so a crowd is never compared as a
    whole and memory holds the pairs alone, 16 bytes each."""
    found = ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)])
    order, across = (np.argsort(boxes[:, 0], kind="stable").astype(np.int32) for boxes in (a, b))
    b = b[across]
    reach = np.maximum.accumulate(np.nan_to_num(b[:, 2], nan=-np.inf, posinf=np.inf, neginf=-np.inf))
    for k in range(0, len(order), STRIP):
        rows = order[k : k + STRIP]
        inset = (a[rows, 2] - a[rows, 0]) * least * (1 - 1e-9)  # a pair has more than `least` of either box's width in common
        left, right = np.fmin.reduce(a[rows, 0] + inset), np.fmax.reduce(a[rows, 2] - inset)  # past boxes without numbers
        low, high = np.searchsorted(reach, left, "right"), np.searchsorted(b[:, 0], right, "left")
        if low < high:
            near = overlaps(a[rows], b[low:high]).ravel()
            at = np.flatnonzero(near >= least)
            r, c = np.divmod(at, high - low)
            pairs = (rows[r], across[low + c], near[at])
            if score:
                value = score(*pairs)
                some = value > 0
                pairs = (pairs[0][some], pairs[1][some], value[some])
            for parts, part in zip(found, pairs, strict=True):
                parts.append(part)
    return tuple(map(_joined, found))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One array of these, which are let go one by one, so memory holds them once."""
    end = sum(map(len, parts))
    found = np.empty(end, parts[0].dtype)
    while parts:
        part = parts.pop()
        found[end - len(part) : end] = part
        end -= len(part)
    return found


def _in_order(keys: np.ndarray) -> np.ndarray:
    """What sorts these numbers (0 to 2^32 - 1), by 16 bits at a time, for which numpy's sort is linear."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = keys >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


#: Rounds of bidding at most, best offers that a bidder remembers (2 at least), and by how little a bid may raise a price. They decide on time alone.
ROUNDS, OFFERS, LEAST_BID = 300, 24, 1e-12
#: With more offers a bidder than this, prices are found roughly first: by bids that exceed the second best by so much, in so many rounds at
#: most, among a bidder's best offers and some of its others.
CROWDED, RISES, ROUGH_ROUNDS, LAST, BEST, OTHERS = 24, (0.1, 0.02, 0.004, 0.0008), 3000, 8, 32, 64


class _Offers:
    """The offers (bidder, item, value) sorted by bidder, prices of the items (at least 0) and who holds them.

    All along a bidder holds what is worth most to it at the prices, and an item that nobody holds costs nothing: so nothing is lost by
    bidding, and what augment() ends with is the best choice (the theorem of complementary slackness)."""

    def __init__(self, bidder: np.ndarray, item: np.ndarray, value: np.ndarray, n: int, m: int):
        if (bidder[1:] < bidder[:-1]).any():
            order = _in_order(bidder)
            bidder, item, value = bidder[order], item[order], value[order]
        self.bidder, self.item, self.value = bidder, item, value
        self.at = np.searchsorted(bidder, np.arange(n + 1, dtype=bidder.dtype))
        self.price, self.holder = np.zeros(m), np.full(m, -1)

    def remember(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best OFFERS offers of each, at the prices of now, and the worth of the next best (0 without)."""
        first, size = self.at[who], self.at[who + 1] - self.at[who]
        place = first[:, None] + np.arange(max(size.max(), OFFERS + 1))
        real = place < self.at[who + 1][:, None]
        place = np.minimum(place, len(self.item) - 1)
        worth = np.where(real, self.value[place] - self.price[self.item[place]], -np.inf)
        best = np.argpartition(-worth, OFFERS, axis=1)
        line = np.arange(len(who))[:, None]
        top = best[:, :OFFERS]
        return self.item[place[line, top]], np.where(real[line, top], self.value[place[line, top]], -np.inf), np.maximum(worth[line[:, 0], best[:, OFFERS]], 0.0)

    def choose(self) -> None:
        """The best choice. In a dense crowd the last bidders would raise their neighbours' prices by little steps or long paths. So rough
        auctions find prices that are nearly right; from there bids and paths are short."""
        if len(self.value) > CROWDED * (len(self.at) - 1):
            some = self.some()
            for k, rise in enumerate(RISES):
                self.bid(rise, some if k < 2 else None)
                self.price = np.where(self.holder < 0, 0.0, np.maximum(self.price - 2 * rise, 0.0))
        self.augment(self.bid())
        self.lower()

    def lower(self) -> None:
        """Where items that nobody holds have a price, as it was too high from the start: they take part along shortest paths among their
        bidders, with the sides exchanged, or cost nothing."""
        left = np.flatnonzero((self.holder < 0) & (self.price > 0))
        if len(left):
            turned = _Offers(self.item, self.bidder, self.value, len(self.price), len(self.at) - 1)
            turned.price, held = self.worth(), np.flatnonzero(self.holder >= 0)
            turned.holder[self.holder[held]] = held
            turned.augment(left)
            held = np.flatnonzero(turned.holder >= 0)
            self.holder[:] = -1
            self.holder[turned.holder[held]] = held
            self.price = turned.worth()

    def worth(self) -> np.ndarray:
        """Of what is worth most to each bidder at the prices: how much, at least 0."""
        found, some = np.zeros(len(self.at) - 1), np.flatnonzero(np.diff(self.at))
        for k in range(0, len(some), 1024):
            who = some[k : k + 1024]
            offers = slice(self.at[who[0]], self.at[who[-1] + 1])
            found[who] = np.maximum.reduceat(self.value[offers] - self.price[self.item[offers]], self.at[who] - self.at[who[0]])
        return np.maximum(found, 0.0)

    def some(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each bidder's BEST offers and OTHERS spread over the rest, as bid() remembers them, with nothing beyond."""
        n, size = len(self.at) - 1, np.diff(self.at)
        items, values = np.zeros((n, BEST + OTHERS), np.int64), np.full((n, BEST + OTHERS), -np.inf)
        for k in range(0, n, 256):
            width = max(size[k : k + 256].max(), BEST + OTHERS)
            place = self.at[k : k + 257][:-1, None] + np.arange(width)
            real = place < self.at[k + 1 : k + 257][:, None]
            place = np.minimum(place, len(self.item) - 1)
            value = np.where(real, self.value[place], -np.inf)
            order = np.argpartition(value, width - BEST, axis=1)
            rest = (width - BEST - 1 - np.arange(OTHERS) * np.maximum(size[k : k + 256, None] - BEST, OTHERS) // OTHERS)
            chosen = np.concatenate([order[:, width - BEST :], np.take_along_axis(order, rest, axis=1)], axis=1)
            items[k : k + 256] = np.take_along_axis(self.item[place], chosen, axis=1)
            values[k : k + 256] = np.take_along_axis(value, chosen, axis=1)
        return items, values, np.full(n, -np.inf)

    def bid(self, rise: float = 0.0, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """All who hold nothing bid at once for what is worth most to them, up to where the second best is worth as much. Gives those who
        neither hold an item nor have nothing to win. With a rise bids are higher by so much, and with some offers only those count: then the
        prices alone are of use."""
        n = len(self.at) - 1
        self.holder[:] = -1
        items, values, beyond = known or (np.zeros((n, OFFERS), np.int64), np.full((n, OFFERS), -np.inf), np.full(n, np.inf))
        active, stuck, highest = np.flatnonzero(np.diff(self.at)), [], np.zeros(len(self.price), np.int64)
        for _ in range(ROUGH_ROUNDS if rise else ROUNDS):
            for again in (False, True):
                worth = values[active] - self.price[items[active]]
                line, place = np.arange(len(active)), worth.argmax(axis=1)
                best = worth[line, place]
                worth[line, place] = 0.0  # to stay without an item
                second = np.maximum(worth.max(axis=1), 0.0)
                unsure = active[second < beyond[active] - rise]
                if again or not len(unsure):
                    break
                for k in range(0, len(unsure), 256):
                    who = unsure[k : k + 256]
                    items[who], values[who], beyond[who] = self.remember(who)
            item, raised = items[active, place], best - second + rise
            idle = (raised <= LEAST_BID) & (self.holder[item] >= 0)
            stuck.append(active[(best > 0) & idle])
            going = np.flatnonzero((best > 0) & ~idle)
            if not len(going):
                return np.concatenate(stuck)
            going = going[np.argsort(self.price[item[going]] + raised[going], kind="stable")]
            highest[item[going]] = going  # the last one stays
            first = highest[item[going]] == going
            wins, lost = going[first], active[going[~first]]
            out = self.holder[item[wins]]
            self.holder[item[wins]] = active[wins]
            self.price[item[wins]] += raised[wins]
            active = np.concatenate([lost, out[out >= 0]])
            if len(active) <= (LAST if rise else 0):
                break
        return np.concatenate([*stuck, active])

    def augment(self, free: np.ndarray) -> None:
        """Each of free takes part along the shortest path of exchanges: to an item that nobody holds, or to whoever has least to lose by
        giving up."""
        gain = self.worth()
        at, price, holder = self.at.tolist(), self.price, self.holder
        for start in free.tolist():
            offers = slice(at[start], at[start + 1])
            cost = price[self.item[offers]] - self.value[offers]
            gain[start] = least = -cost.min(initial=0.0)
            far, came = np.full(len(price), np.inf), {}
            quits, item, k, so_far, since = start, -1, start, 0.0, gain[start]
            path, dist, rows, old = [], [], [], []
            origin = np.full(len(price), -1)
            while True:
                offers = slice(at[k], at[k + 1])
                items = self.item[offers]
                new = price[items] - self.value[offers] + since
                closer = new < np.minimum(far[items], least)
                hit = items[closer]
                far[hit], origin[hit] = new[closer], k
                item = int(far.argmin())
                so_far = far[item]
                if so_far >= least:
                    item, so_far = -1, least
                    break
                k = int(holder[item])
                if k < 0:
                    break
                came[k] = item
                path.append(item)
                dist.append(so_far)
                rows.append(k)
                old.append(price[item])
                price[item] = far[item] = np.inf  # done: nothing comes closer over it
                since = so_far + gain[k]
                if since < least:
                    least, quits = since, k
            if path:
                up = so_far - np.array(dist)
                price[path] = np.array(old) + np.maximum(up, 0.0)
                gain[rows] -= np.maximum(up, 0.0)
            gain[start] -= so_far
            if item < 0:
                if quits == start:
                    continue
                item = came[quits]
            while True:  # turn the path over
                k = int(origin[item])
                holder[item] = k
                if k == start:
                    break
                item = came[k]


def best_pairs(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of these pairs, each with a positive score, those with the largest total in which no row (of n) and no column (of m) comes twice.

    If no pairs compete, all stand. Else the side with fewer boxes bids for the other."""
    if len(rows) <= min(n, m) and max(np.bincount(x).max(initial=0) for x in (rows, cols)) <= 1:
        r, c = rows, cols
    else:
        turned = n > m
        offers = _Offers(cols, rows, score, m, n) if turned else _Offers(rows, cols, score, n, m)
        offers.choose()
        item = np.flatnonzero(offers.holder >= 0)
        r, c = (item, offers.holder[item]) if turned else (offers.holder[item], item)
    order = np.argsort(r)
    return r[order], c[order]


def _predict(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = mean.copy()
    mean[mean[:, 2] + mean[:, 6] <= 0, 6] = 0.0
    mean[:, :3] += mean[:, 4:]
    cov = cov + 0.0
    cov[:, :3] += cov[:, 4:]
    cov[:, :, :3] += cov[:, :, 4:]
    return mean, cov + DRIFT


def _correct(mean: np.ndarray, cov: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = cov[:, :, :4] @ np.linalg.inv(cov[:, :4, :4] + ERROR)
    mean = mean + (gain @ (seen - mean[:, :4])[:, :, None])[:, :, 0]
    return mean, cov - gain @ cov[:, :4, :]


class Tracker:
    """The tracks of one stream; `update` takes its frames in order. All state is a few arrays a live track."""

    def __init__(self, params: Params):
        self.params, self.frame, self.next_id = params, None, 0
        self.tracks = {
            "mean": np.zeros((0, 7)), "cov": np.zeros((0, 7, 7)), "mean_seen": np.zeros((0, 7)), "cov_seen": np.zeros((0, 7, 7)),
            "seen": np.zeros((0, params.look_back + 1, 4)), "at": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "id": np.zeros(0, np.int64),
        }

    def _score(self, boxes: np.ndarray, conf: np.ndarray) -> Callable:
        """What gives pairs' scores (of a track, a box and their overlap): overlap plus agreement (-1/2 to 1/2) of the track's direction
        with the one towards the box."""
        middle = lambda b: (b[:, :2] + b[:, 2:]) / 2
        old, last = middle(self.tracks["seen"][:, 0]), middle(self.tracks["seen"][:, -1])
        length = np.linalg.norm(last - old, axis=1)
        (from_x, from_y), (own_x, own_y), (at_x, at_y) = (np.ascontiguousarray(p.T) for p in (old, last - old, middle(boxes)))

        def score(rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> np.ndarray:
            to_x, to_y = at_x[cols] - from_x[rows], at_y[cols] - from_y[rows]
            far = length[rows] * np.sqrt(to_x * to_x + to_y * to_y)
            cos = (own_x[rows] * to_x + own_y[rows] * to_y) / np.maximum(far, 1e-9)
            turn = np.arccos(np.minimum(np.maximum(cos, -1, out=cos), 1, out=cos), out=cos)
            return near + self.params.direction_weight * (np.where(far > 1e-9, 0.5 - turn / np.pi, 0.0) * conf[cols])

        return score

    def _matched(self, own: np.ndarray, boxes: np.ndarray, score: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best pairs of tracks, which are at `own`, and boxes. Fewer bid for more, and from left to right, so their pairs need no sorting."""
        turned = len(own) > len(boxes)
        a, b = (boxes, own) if turned else (own, boxes)
        order = np.argsort(a[:, 0], kind="stable")
        value = score and (lambda r, c, near: score(c, order[r], near) if turned else score(order[r], c, near))
        r, c = best_pairs(*near_pairs(a[order], b, self.params.min_iou, value), len(a), len(b))
        rows, cols = (c, order[r]) if turned else (order[r], c)
        order = np.argsort(rows)
        return rows[order], cols[order]

    def _observe(self, rows: np.ndarray, boxes: np.ndarray) -> None:
        t, frame = self.tracks, self.frame
        gap = frame - t["at"][rows]
        for step in range(1, gap.max()):  # along the line over the gap, from the state at the last observation
            k = np.flatnonzero(gap > step)
            r = rows[k]
            if step == 1:
                t["mean"][r], t["cov"][r] = t["mean_seen"][r], t["cov_seen"][r]
            on_line = t["seen"][r, -1] + (boxes[k] - t["seen"][r, -1]) * step / gap[k, None]
            t["mean"][r], t["cov"][r] = _correct(*_predict(t["mean"][r], t["cov"][r]), _measured(on_line))
        late = rows[gap > 1]
        t["mean"][late], t["cov"][late] = _predict(t["mean"][late], t["cov"][late])
        t["mean"][rows], t["cov"][rows] = _correct(t["mean"][rows], t["cov"][rows], _measured(boxes))
        t["mean_seen"][rows], t["cov_seen"][rows] = t["mean"][rows], t["cov"][rows]
        t["seen"][rows] = np.concatenate([t["seen"][rows, 1:], boxes[:, None]], axis=1)
        t["row"][rows] = np.where(gap == 1, t["row"][rows] + 1, 1)
        t["at"][rows] = frame

    def update(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Track ids of the boxes of a later frame than those before."""
        t, p = self.tracks, self.params
        steps = 0 if self.frame is None else frame - self.frame
        self.frame = frame
        alive = frame - t["at"] <= p.lost_frames + 1
        t = self.tracks = {k: v[alive] for k, v in t.items()}
        if len(t["at"]):
            for _ in range(steps):
                t["mean"], t["cov"] = _predict(t["mean"], t["cov"])
        # all scores are positive while min_iou exceeds half of direction_weight
        rows, cols = self._matched(_boxes(t["mean"]), boxes, self._score(boxes, conf))
        free_r, free_c = np.setdiff1d(np.arange(len(t["at"])), rows), np.setdiff1d(np.arange(len(boxes)), cols)
        if len(free_r) and len(free_c):
            r, c = self._matched(t["seen"][free_r, -1], boxes[free_c])
            rows, cols = np.append(rows, free_r[r]), np.append(cols, free_c[c])
        if len(rows):
            self._observe(rows, boxes[cols])
        fresh = np.setdiff1d(np.arange(len(boxes)), cols)
        n, first = len(fresh), len(t["at"])
        mean = np.concatenate([_measured(boxes[fresh]), np.zeros((n, 3))], axis=1)
        cov = np.repeat(START[None], n, axis=0)
        new = {"mean": mean, "cov": cov, "mean_seen": mean, "cov_seen": cov, "seen": np.repeat(boxes[fresh][:, None], p.look_back + 1, axis=1), "at": np.full(n, frame), "row": np.ones(n, np.int64), "id": np.full(n, -1)}
        t = self.tracks = {k: np.concatenate([t[k], new[k]]) for k in t}
        rows, cols = np.append(rows, np.arange(first, first + n)), np.append(cols, fresh)
        order = np.argsort(cols)
        rows = rows[order].astype(np.int64)
        ready = rows[(t["id"][rows] < 0) & (t["row"][rows] >= p.min_frames)]
        t["id"][ready] = self.next_id + np.arange(len(ready))
        self.next_id += len(ready)
        return t["id"][rows]


    # A stream's blocks of time are followed side by side, so a tracker can be put down and taken up again.

    def saved(self) -> bytes:
        return pickle.dumps((self.frame, self.tracks))

    @classmethod
    def taken_up(cls, params: Params, state: bytes, first_id: int) -> Tracker:
        """From a saved state; its confirmed tracks are numbered anew from first_id on."""
        found = cls(params)
        found.frame, found.tracks = pickle.loads(state)
        confirmed = np.flatnonzero(found.tracks["id"] >= 0)
        found.tracks["id"][confirmed] = first_id + np.arange(len(confirmed))
        found.next_id = first_id + len(confirmed)
        return found


#: Two filters of one track agree if they differ by no more than this, relatively or absolutely.
NEARLY = 1e-6
FILTERS = ["mean", "cov", "mean_seen", "cov_seen"]


def agree(begun: bytes | None, ended: bytes | None, first_frame: int, params: Params) -> list[tuple[int, int]] | None:
    """Whether a block began with the tracks that the one before it ended with: pairs of their numbers (new, old), else None.

    Compared are tracks that can be found again at first_frame or later: what they saw last, exactly; whether they are confirmed, and
    if not, for how many frames they were seen; and the filters' states."""
    sides = []
    for state in (begun, ended):
        t = pickle.loads(state)[1] if state is not None else Tracker(params).tracks
        t = {k: v[first_frame - t["at"] <= params.lost_frames + 1] for k, v in t.items()}
        order = sorted(range(len(t["at"])), key=lambda k: (t["at"][k], t["seen"][k].ravel().tolist(), t["mean"][k].round(3).tolist()))
        sides.append({k: v[order] for k, v in t.items()})
    a, b = sides
    if len(a["at"]) != len(b["at"]) or not (np.array_equal(a["at"], b["at"]) and np.array_equal(a["seen"], b["seen"]) and np.array_equal(a["id"] >= 0, b["id"] >= 0)):
        return None
    new = a["id"] < 0
    if not np.array_equal(a["row"][new], b["row"][new]) or not all(np.allclose(a[k], b[k], rtol=NEARLY, atol=NEARLY) for k in FILTERS):
        return None
    return list(zip(a["id"][~new].tolist(), b["id"][~new].tolist(), strict=True))


#: Working columns: block of time, what a row is, whether its box is sure, whether it only warms a block up, a tracker's state.
ROW, BEGUN, ENDED = 0, 1, 2
WORKING = ["_block", "_kind", "_sure", "_halo", "_state"]


def _follow(placed: DataFrame, by: list[str], params: Params) -> DataFrame:
    """Rows of blocks in order of time, with track_id, and each block's states where it begins and ends. A block starts from the
    state in its first row (BEGUN), if it has one, else with its warming-up rows."""
    group, schema = [*by, "_block"], StructType([StructField(f.name, f.dataType) for f in placed.schema])  # a state's row has nothing else
    rest = [c for c in placed.columns if c not in (*group, "_kind", "_state", "track_id")]

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tracker, begun, rest_rows = None, None, False, None

        def state(kind: int) -> pd.DataFrame:
            row = dict(zip(group, at, strict=True)) | {"_kind": kind, "_state": tracker.saved(), "track_id": -1}
            return pd.DataFrame([row | dict.fromkeys(rest)])[schema.names]

        for last, batch in _with_end(found):
            rows = batch if rest_rows is None else pd.concat([rest_rows, batch], ignore_index=True)
            if not len(rows):
                continue
            kinds, sure, halo = rows["_kind"].to_numpy(), rows["_sure"].fillna(False).to_numpy(bool), rows["_halo"].fillna(False).to_numpy(bool)
            keys = rows[[*group, "frame_idx"]]
            starts = np.flatnonzero(np.append(True, (keys.values[1:] != keys.values[:-1]).any(axis=1)))
            done = len(rows) if last else int(starts[-1])  # a batch may end within a frame
            starts = starts[starts < done]
            boxes, conf, ids = rows[BOX].to_numpy(float), rows["conf"].to_numpy(float), np.full(len(rows), -1, np.int64)
            blocks, frames = rows[group], rows["frame_idx"]
            for a, b in zip(starts, np.append(starts[1:], done), strict=True):
                key = tuple(blocks.iloc[a])
                if key != at:
                    if at is not None:
                        if not begun:
                            yield state(BEGUN)
                        yield state(ENDED)
                    at, begun = key, False
                    first_id = (int(key[-1]) & 0x3FFFFFFF) << 32
                    tracker = Tracker(params)
                    tracker.next_id = first_id
                    if kinds[a] == BEGUN:
                        tracker = Tracker.taken_up(params, rows["_state"].iat[a], first_id)
                        continue
                if not begun and not halo[a]:
                    begun = True
                    yield state(BEGUN)
                n = int(sure[a:b].sum())  # they come first
                if n:
                    ids[a : a + n] = tracker.update(int(frames.iat[a]), boxes[a : a + n], conf[a : a + n])
            rest_rows = rows.iloc[done:]
            own = np.flatnonzero(~halo[:done] & (kinds[:done] == ROW))
            if len(own):
                yield rows.iloc[own].assign(track_id=ids[own])[schema.names]
        if at is not None:
            if not begun:
                yield state(BEGUN)
            yield state(ENDED)

    order = placed.repartition(*group).sortWithinPartitions(*group, F.desc("_kind"), "frame_idx", F.desc("_sure"), F.desc("conf"), *BOX)
    return kept(order.mapInPandas(run, schema), "tracked", ["_kind"])


def _edges(tables: list[DataFrame], by: list[str], length: int, params: Params) -> DataFrame:
    """For every block whether it agrees with the one before: pairs of numbers, else that one's state at its end."""
    state = lambda kind: F.max_by(F.when(F.col("_kind") == kind, F.col("_state")), F.when(F.col("_kind") == kind, F.col("_round")))
    states = [t.where(F.col("_kind") != ROW).select(*by, "_block", "_kind", "_state", F.lit(k).alias("_round")) for k, t in enumerate(tables)]
    now = reduce(DataFrame.unionByName, states).groupBy(*by, "_block").agg(state(BEGUN).alias("begun"), state(ENDED).alias("ended"), F.max("_round").alias("_round"))
    before = now.select(*by, (F.col("_block") + 1).alias("_block"), F.col("ended").alias("before"))
    met = now.select(*by, "_block", "_round", "begun").join(before, [*by, "_block"], "left")
    schema = now.select(*by, "_block", "_round", F.lit(True).alias("ok"), F.col("ended").alias("before"), F.lit(None).cast("array<struct<new: bigint, old: bigint>>").alias("pairs")).schema

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in found:
            pairs = [agree(a, b, int(block) * length, params) for block, a, b in zip(rows["_block"], rows["begun"], rows["before"], strict=True)]
            ok = [p is not None for p in pairs]
            out = rows[[*by, "_block", "_round"]].assign(ok=ok)
            out["before"] = [None if good else b for good, b in zip(ok, rows["before"], strict=True)]
            out["pairs"] = [[{"new": x, "old": y} for x, y in p or []] for p in pairs]
            yield out

    return kept(met.mapInPandas(run, schema), "track-edges")


def _whole(edges: DataFrame, by: list[str]) -> DataFrame:
    """Each number that goes on a track of an earlier block, with the track's first number: steps back are doubled until none is left."""
    steps = kept(edges.select(*by, F.explode("pairs").alias("p")).select(*by, "p.new", "p.old"), "track-steps")
    while True:
        further = steps.select(*by, F.col("new").alias("old"), F.col("old").alias("older"))
        longer = kept(steps.join(further, [*by, "old"], "left").select(*by, "new", F.coalesce("older", "old").alias("old"), F.col("older").isNotNull().alias("went")), "track-steps")
        forget(steps)
        steps = longer.drop("went")
        if longer.where("went").isEmpty():
            return steps


def track(detections: DataFrame, streams: list[str] | None = None, params: Params = Params(), block_frames: int = 15_000, overlap: int = 1_500) -> DataFrame:
    """detections (streams, frame_idx, conf, x1, y1, x2, y2, ...) with track_id, as one pass over each stream gives them up to the
    numbers.

    A stream is cut into blocks of time that are followed side by side; a task holds the live tracks alone. A block warms up on the
    `overlap` frames before it. Where it then begins with the tracks that the block before ends with (see agree), its rows are those of
    one pass, and the tracks' numbers are told apart or joined over the edge. Where it does not, it is followed
    again from the state that the block before ended with, until all blocks agree: a track that the overlap is too short
    for costs its block a second run, and never a wrong number. Numbers are those of the block in which a track was confirmed.

    The result reads tables under spark.checkpoint.dir; kept.forget(result) deletes them."""
    by = streams or ["stream_id"]
    if not params.lost_frames + 1 < min(overlap, block_frames):
        raise ValueError("blocks and their overlap are longer than a track can be lost")
    detections = detections.select([c for c in detections.columns if c not in ("track_id", *WORKING)])
    sure = F.coalesce(F.col("conf") >= params.high_conf, F.lit(False))
    own, later = (F.floor((F.col("frame_idx") + F.lit(d)) / F.lit(block_frames)) for d in (0, overlap))
    # only sure boxes warm a block up; the block before may lie further back than the one that a frame is in
    placed = detections.withColumn("_sure", sure).withColumn("_block", F.explode(F.when(F.col("_sure"), F.sequence(own, later)).otherwise(F.array(own))))
    placed = placed.withColumns({"_halo": F.col("_block") > own, "_kind": F.lit(ROW), "_state": F.lit(None).cast("binary"), "track_id": F.lit(-1).cast("long")})
    tables = [_follow(placed, by, params)]
    while True:
        edges = _edges(tables, by, block_frames, params)
        wrong = edges.where("not ok").select(*by, "_block", "before")
        if wrong.isEmpty():
            break
        known = wrong.select(*by, "_block", F.lit(BEGUN).alias("_kind"), F.col("before").alias("_state")).where("_state is not null")
        again = tables[0].where(F.col("_kind") == ROW).join(wrong.select(*by, "_block"), [*by, "_block"]).select(tables[0].columns)
        tables.append(_follow(again.unionByName(known, allowMissingColumns=True), by, params))
        forget(edges)
    rows = [t.where(F.col("_kind") == ROW).select(*detections.columns, "_block", "track_id") for t in tables]
    if len(rows) > 1:
        last = edges.select(*by, "_block", "_round")
        rows = [r.join(last.where(F.col("_round") == k), [*by, "_block"]).select(r.columns) for k, r in enumerate(rows)]
    found = reduce(DataFrame.unionByName, rows).drop("_block")
    first = _whole(edges, by).select(*by, F.col("new").alias("track_id"), F.col("old").alias("_first"))
    joined = found.where("track_id >= 0").join(first, [*by, "track_id"], "left").withColumn("track_id", F.coalesce("_first", "track_id")).select(found.columns)
    return joined.unionByName(found.where("track_id < 0"))


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    held = None
    for batch in batches:
        if held is not None:
            yield False, held
        held = batch
    if held is not None:
        yield True, held
