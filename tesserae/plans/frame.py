"""One frame at a time in numpy: the sequential kernels of the region algorithms, vectorised over pixels and regions.

A frame is an array (height, width, 3) and labels are an int array (height, width), -1 for none.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from ..operators.regions import hex_geometry
from ..operators.stencil import simple_table

_SIMPLE = np.array(simple_table())
_STEPS = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}
_CODE = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


@dataclass(frozen=True)
class Options:
    """Parameters of the region algorithms, with their usual values."""

    sp_size: int = 25
    niters: int = 0
    niters_seg: int = 4
    #: Rounds of later frames; by their share of new pixels if 0.
    vid_niters: int = 0
    potts: float = 10.0
    sigma_app: float = 0.009
    alpha: float = math.log(0.5)
    split_alpha: float = 0.0
    merge_alpha: float = 0.0
    gamma: float = 4.0
    epsilon_new: float = 5e-2
    epsilon_reid: float = 1e-6
    smaller_wins: bool = True
    #: In a later frame the prior weighs as much as the region did before it, else as much as its prior did.
    prop_nc: bool = True
    #: The prior of a region that was there before has the shape it had then, smoothed; else the inverse kept for it.
    prop_icov: bool = True
    target_nspix: int = 0
    use_sm: bool = True
    sm_start: int = -1
    most_rounds: int = 5000

    @property
    def rounds(self) -> int:
        return self.niters if self.niters > 0 else self.sp_size

    @property
    def sigma2(self) -> float:
        return self.sigma_app**2


@dataclass
class Params:
    """Parameters by region id (arrays indexed by id); n is 0 where an id has no pixels.

    Matrices are rows xx, xy, yy. sample: the covariance of places in the frame before. prior: the shape to which the
    covariance is drawn, if it isn't conditioned on the sample.
    """

    n: np.ndarray
    mu: np.ndarray
    centre: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior_count: np.ndarray
    propagated: np.ndarray
    sample: np.ndarray
    prior: np.ndarray
    conditioned: bool = True


@dataclass
class State:
    """What a video carries from frame to frame: labels, and of every id ever seen what it was when last seen.

    inverse: the inverse covariance that was fitted; sample: the covariance of places; prior_count: the prior's weight.
    """

    labels: np.ndarray
    n: np.ndarray
    mu: np.ndarray
    centre: np.ndarray
    inverse: np.ndarray | None = None
    sample: np.ndarray | None = None
    prior_count: np.ndarray | None = None
    #: Finds the dead among the ids; made where it is missing.
    dead: Dead | None = None


def around(a: np.ndarray, d: str, fill: int = -2) -> np.ndarray:
    dy, dx = _STEPS[d]
    h, w = a.shape
    out = np.full_like(a, fill)
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def hex_labels(height: int, width: int, side: int) -> np.ndarray:
    tall, wide, nx, ny = hex_geometry(side, width, height)
    y, x = np.mgrid[:height, :width]
    best, label = np.full((height, width), np.inf), np.zeros((height, width), np.int64)
    for row in range(ny):
        rows = np.flatnonzero(np.abs(np.arange(height) - row * tall) <= 2 * tall)
        if not len(rows):
            continue
        part = slice(rows[0], rows[-1] + 1)
        for column in range(nx):
            d = (x[part] - column * wide - (0.5 * wide if row % 2 == 0 else 0)) ** 2 + (y[part] - row * tall) ** 2
            better = np.round(d, 6) <= best[part]
            best[part] = np.where(better, np.round(d, 6), best[part])
            label[part] = np.where(better, row * nx + column, label[part])
    return np.unique(label, return_inverse=True)[1].reshape(height, width)


def sums(labels: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    ok = labels >= 0
    if ok.all():
        return np.bincount(labels.ravel(), values.ravel(), size)
    return np.bincount(labels[ok], values[ok], size)


def round_shapes(size: int) -> np.ndarray:
    return np.tile([1.0, 0.0, 1.0], (size, 1))


@lru_cache(maxsize=4)
def places(height: int, width: int) -> tuple[np.ndarray, ...]:
    """x, y, xx, xy and yy of a frame's pixels; not to be written to."""
    y, x = np.mgrid[:height, :width].astype(float)
    return x, y, x * x, x * y, y * y


def scatter(labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels, mean places and centred sums of squares of places of each region."""
    x, y, xx, xy, yy = places(*labels.shape)
    n = sums(labels, np.ones(labels.shape), size)
    safe = np.maximum(n, 1)
    mx, my = sums(labels, x, size) / safe, sums(labels, y, size) / safe
    spread = sums(labels, xx, size) - n * mx * mx, sums(labels, xy, size) - n * mx * my, sums(labels, yy, size) - n * my * my
    return n, np.stack([mx, my], 1), np.stack(spread, 1)


def smoothed(sample: np.ndarray, prior_count: np.ndarray, side: int) -> np.ndarray:
    """Covariances drawn to round cells of that side, with a quarter of the prior's weight."""
    q = prior_count / 4
    out = prior_count[:, None] * sample / (prior_count + q + 3)[:, None]
    out[:, [0, 2]] += (q * side / (prior_count + q + 3))[:, None]
    return out


def parameters(image: np.ndarray, labels: np.ndarray, prior_count: np.ndarray, propagated: np.ndarray, side: int, sample: np.ndarray | None = None, prior: np.ndarray | None = None, conditioned: bool = True) -> Params:
    """Fits each region; its covariance is drawn to a prior matrix scaled to unit determinant and the prior's weight.

    That matrix is the smoothed sample of a propagated region if conditioned, else prior (without one, the identity).
    """
    size = len(prior_count)
    n, centre, spread = scatter(labels, size)
    mu = np.stack([sums(labels, image[..., i], size) / np.maximum(n, 1) for i in range(3)], 1)
    sample = spread / np.maximum(n, 1)[:, None] if sample is None else sample
    prior = round_shapes(size) if prior is None else prior
    pc = prior_count
    k = np.where((propagated & conditioned)[:, None], smoothed(sample, pc, side), prior)
    root = np.sqrt(np.maximum(k[:, 0] * k[:, 2] - k[:, 1] ** 2, 1e-12))
    total = n + 50 * pc + 3
    sxx, sxy, syy = ((pc[:, None] * (pc / root)[:, None] * k + spread) / total[:, None]).T
    bad = sxx * syy - sxy * sxy <= 0
    sxx, syy = sxx + 1e-5 * bad, syy + 1e-5 * bad
    det = np.maximum(sxx * syy - sxy * sxy, 1e-5)
    return Params(n, mu, centre, np.stack([syy / det, -sxy / det, sxx / det], 1), np.log(det), pc, propagated, sample, prior, conditioned)


def refit(image: np.ndarray, labels: np.ndarray, p: Params, side: int) -> Params:
    """Parameters of new labels under the same priors."""
    return parameters(image, labels, p.prior_count, p.propagated, side, p.sample, p.prior, p.conditioned)


PHASES = ((0, 0), (0, 1), (1, 0), (1, 1))


#: Of a code of like neighbours: how many of the eight are unlike.
_UNLIKE = 8 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
_SIDES = [_CODE.index(d) for d in "nswe"]


def update_labels(image: np.ndarray, labels: np.ndarray, p: Params, sigma2: float, potts: float, passes: int, phases: tuple = PHASES) -> np.ndarray:
    """Moves region borders: in each checkerboard phase a simple border pixel takes the best of its neighbours' labels.

    Once every phase in a row has changed nothing the rest would change nothing either, and is left out.
    """
    h, w = labels.shape
    rim = np.full((h + 2, w + 2), -2, np.int64)
    rim[1:-1, 1:-1] = labels
    flat, colours = rim.ravel(), image.reshape(h * w, -1)
    steps = np.array([dy * (w + 2) + dx for dy, dx in (_STEPS[d] for d in _CODE)])[:, None]
    places = [(np.arange(b, h, 2)[:, None] * (w + 2) + np.arange(a, w, 2) + w + 3).ravel() for a, b in phases]
    calm = 0
    for k in range(passes * len(phases)):
        at = places[k % len(phases)]
        calm += 1
        at = at[(flat[at + steps[_SIDES]] != flat[at]).any(0)]
        if len(at):
            ring = flat[at + steps]
            near = ring[_SIDES]
            code = np.packbits((ring == -2) | (ring == near[:, None]), axis=1, bitorder="little")[:, 0]
            free = ((near == -2) | _SIMPLE[code]).all(0)
            at, near, code = at[free], near[:, free], code[:, free]
            y, x = at // (w + 2) - 1, at % (w + 2) - 1
            i = np.maximum(near, 0)
            c = colours[y * w + x] - p.mu[i]
            c *= c
            d0, d1 = np.trunc(x - p.centre[i, 0]), np.trunc(y - p.centre[i, 1])
            r = -1000 - (c[..., 0] + c[..., 1] + c[..., 2]) / sigma2 - (d0 * d0 * p.inverse[i, 0] + d1 * d1 * p.inverse[i, 2] + 2 * d0 * d1 * p.inverse[i, 1]) - p.logdet[i] - potts * _UNLIKE[code]
            r = np.where((near >= 0) & (r > -9999), r, -np.inf)
            top, own, each = r.argmax(0), flat[at], np.arange(len(at))
            best = np.where(r[top, each] > -np.inf, near[top, each], own)
            if (best != own).any():
                flat[at], calm = best, 0
        if calm == len(phases):
            break
    return rim[1:-1, 1:-1].copy()


def distances(labels: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Steps from the seed pixels (y, x) inside their regions, -1 where none leads; all regions at once."""
    h, w = labels.shape
    rim, out = np.full((h + 2, w + 2), -2, np.int64), np.full((h + 2, w + 2), -1)
    rim[1:-1, 1:-1] = labels
    flat, far, first = rim.ravel(), out.ravel(), np.zeros((h + 2) * (w + 2), np.int64)
    steps, level = np.array([-w - 2, w + 2, -1, 1])[:, None], 0
    front = (seeds[:, 0] + 1) * (w + 2) + seeds[:, 1] + 1
    far[front] = 0
    while len(front):
        level += 1
        near = front + steps
        near = near[(flat[near] == flat[front]) & (far[near] < 0)]
        first[near] = np.arange(len(near))  # of a pixel reached twice one stays
        front = near[first[near] == np.arange(len(near))]
        far[front] = level
    return out[1:-1, 1:-1].copy()


def marginal(n: np.ndarray, s: np.ndarray, q: np.ndarray, sigma: float, a0: float = 1e4) -> np.ndarray:
    b0, safe = 2 * sigma * a0, np.maximum(n, 1)
    b = b0 + (q - s * s / safe[:, None]) / 2
    return ((a0 + n[:, None] / 2) * (math.log(b0) - np.log(np.maximum(b, 1e-12))) - np.log(safe)[:, None] / 2 - n[:, None] * (math.log(math.pi) / 2 + math.log(2))).sum(1)


def colour_sums(image: np.ndarray, labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = sums(labels, np.ones(labels.shape), size)
    s = np.stack([sums(labels, image[..., i], size) for i in range(3)], 1)
    return n, s, np.stack([sums(labels, image[..., i] ** 2, size) for i in range(3)], 1)


def split_gain(kept: tuple, moved: tuple, o: Options, lost: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By region: what its cut gains, and whether the moved part takes after the old region (it has fewer invalid pixels).

    kept and moved: pixels, colour sums and sums of squares of the two parts; lost: invalid pixels of each, in a
    propagated frame. There every cut pays gamma times the valid share of the part that takes after the old region.
    """
    both = tuple(a + b for a, b in zip(kept, moved, strict=True))
    gain = marginal(*kept, o.sigma_app) + marginal(*moved, o.sigma_app) - marginal(*both, o.sigma_app) + o.split_alpha
    if lost is None:
        return gain, np.zeros(len(gain), bool)
    other = lost[1] < lost[0]
    share = np.where(other, lost[1] / np.maximum(moved[0], 1), lost[0] / np.maximum(kept[0], 1))
    return gain - o.gamma * (1 - share), other


def split(image: np.ndarray, labels: np.ndarray, p: Params, o: Options, count: int, invalid: np.ndarray | None = None) -> tuple[np.ndarray, Params]:
    """Cuts regions along one axis where two parts explain the colours better than one."""
    h, w = labels.shape
    step = count % 2 + 1
    dx, dy = (1, 0) if step == 1 else (0, 2)
    live = np.flatnonzero(p.n > 0)
    x, y = p.centre[live, 0].astype(int), p.centre[live, 1].astype(int)
    ends = []
    for sign in (-1, 1):
        sy, sx = np.clip(y + sign * dy, 0, h - 1), np.clip(x + sign * dx, 0, w - 1)
        ends.append((sy, sx, labels[sy, sx] == live))
    ok = ends[0][2] & ends[1][2]
    if not ok.any():
        return labels, p
    seeds = [np.stack([sy[ok], sx[ok]], 1) for sy, sx, _ in ends]  # from both ends at once, one copy of the frame below the other
    far = distances(np.vstack([labels, np.full((1, w), -2), labels]), np.vstack([seeds[0], seeds[1] + [h + 1, 0]]))
    first, second = far[:h], far[h + 1 :]
    size = len(p.n)
    wanted = np.zeros(size, bool)
    wanted[live[ok]] = True
    away = (labels >= 0) & wanted[np.maximum(labels, 0)] & (first > second) & (second >= 0)
    kept, moved = colour_sums(image, np.where(away, -1, labels), size), colour_sums(image, np.where(away, labels, -1), size)
    lost = None if invalid is None else [sums(np.where(m, labels, -1), invalid.astype(float), size) for m in (~away, away)]
    gain, other = split_gain(kept, moved, o, lost)
    swap = p.propagated & other
    accept = wanted & (gain > -2) & (kept[0] > 0) & (moved[0] > 0) & ((invalid is None) | (kept[0] + moved[0] >= 64))
    ids = np.flatnonzero(accept)
    if not len(ids):
        return labels, p
    new = np.full(size, -1)
    new[ids] = size + np.arange(len(ids))
    flips = (labels >= 0) & accept[np.maximum(labels, 0)] & (away ^ swap[np.maximum(labels, 0)])
    labels = np.where(flips, new[np.maximum(labels, 0)], labels)
    floor = 8 if invalid is None else 36
    half = np.maximum(p.prior_count[ids] / 2, floor)
    count = np.append(p.prior_count, half)
    changed = ids[(invalid is None) | other[ids]]
    count[changed] = half[(invalid is None) | other[ids]]
    prior = np.vstack([p.prior, round_shapes(len(ids))])
    prior[changed] = round_shapes(len(changed))
    sample = np.vstack([p.sample, round_shapes(len(ids))])
    return labels, parameters(image, labels, count, np.append(p.propagated, np.zeros(len(ids), bool)), o.sp_size, sample, prior, p.conditioned)


#: What is told of each step: its name, the labels after it, and of a merge all proposals (region, target, gain, accepted).
Log = Callable[..., None]


def silent(step: str, labels: np.ndarray, merges: tuple | None = None) -> None:
    pass


def merge(image: np.ndarray, labels: np.ndarray, p: Params, o: Options, count: int, edge: int = 0, told: list | None = None) -> tuple[np.ndarray, Params]:
    """Joins regions to a neighbour where one explains the colours as well; one region for each target.

    Pixels nearer than edge to the frame's two sides in that direction propose nothing. told: a list that gets the
    proposals.
    """
    out, q, proposals = _merged(image, labels, p, o, count, edge)
    if told is not None:
        told.append(proposals)
    return out, q


def _merged(image: np.ndarray, labels: np.ndarray, p: Params, o: Options, count: int, edge: int) -> tuple[np.ndarray, Params, tuple]:
    size = len(p.n)
    near = around(labels, "s" if count % 2 else "w")
    if edge:
        near = near if count % 2 else near.T
        near[:edge] = near[-edge:] = -2
        near = near if count % 2 else near.T
    pair = (near >= 0) & (labels >= 0) & (near != labels)
    pair &= ~(p.propagated[np.maximum(labels, 0)] & p.propagated[np.maximum(near, 0)])
    target = np.full(size, -1)
    np.maximum.at(target, labels[pair], near[pair])
    ids = np.flatnonzero(target >= 0)
    if not len(ids):
        return labels, p, (ids, ids, np.zeros(0), np.zeros(0, bool))
    n, s, q = colour_sums(image, labels, size)
    f = target[ids]
    own = marginal(n, s, q, o.sigma_app)
    h = marginal(n[ids] + n[f], s[ids] + s[f], q[ids] + q[f], o.sigma_app) - o.alpha - own[ids] - own[f] + o.merge_alpha
    good, asked = h > -2, (ids, f, h)
    ids, f, h = ids[good], f[good], h[good]
    order = np.lexsort((ids, -h, f))
    ids, f = ids[order], f[order]
    first = np.append(True, f[1:] != f[:-1]) if len(f) else np.zeros(0, bool)
    ids, f = ids[first], f[first]
    goes = np.full(size, -1)
    goes[ids] = f
    keep = (goes[f] < 0) | ((goes[f] == ids) & (p.propagated[ids] | (ids < f)))
    ids, f = ids[keep], f[keep]
    proposals = (*asked, np.isin(asked[0], ids))
    if not len(ids):
        return labels, p, proposals
    flip = p.propagated[ids]
    source, into = np.where(flip, f, ids), np.where(flip, ids, f)
    to = np.arange(size)
    to[source] = into
    total = p.prior_count.copy()
    np.add.at(total, into, p.prior_count[source])
    labels = np.where(labels >= 0, to[np.maximum(labels, 0)], labels)
    return labels, refit(image, labels, replace(p, prior_count=total), o.sp_size), proposals


def compact(labels: np.ndarray, p: Params, previous: int = 0) -> tuple[np.ndarray, Params]:
    """Renumbers ids from previous on without gaps, with their parameters."""
    live = np.flatnonzero(np.bincount(labels[labels >= 0], minlength=len(p.n)))
    ids = np.append(np.arange(min(previous, len(p.n))), live[live >= previous])
    to = np.full(len(p.n), -1)
    to[ids] = np.arange(len(ids))
    kept = {k: getattr(p, k)[ids] for k in ("n", "mu", "centre", "inverse", "logdet", "prior_count", "propagated", "sample", "prior")}
    return np.where(labels >= 0, to[np.maximum(labels, 0)], -1), replace(p, **kept)


def controlled(o: Options, live: int, step: int, last: int) -> tuple[Options, int]:
    """Draws the number of regions to the target by easing splits or merges; steps begin anew when the sign changes."""
    sign = (live > 1.05 * o.target_nspix) - (live < 0.95 * o.target_nspix)
    if step % 2 or not sign:
        return o, sign
    base = replace(o, split_alpha=0.0, merge_alpha=0.0) if sign != last else o
    return replace(base, split_alpha=base.split_alpha - sign, merge_alpha=base.merge_alpha + sign), sign


def segment_image(image: np.ndarray, o: Options, log: Log = silent) -> tuple[np.ndarray, Params]:
    """Regions of a single image: parameters, splits and merges by turns, border moves. log gets the labels after each step."""
    h, w = image.shape[:2]
    side = max(5, round(math.sqrt(h * w / o.target_nspix))) if o.target_nspix else o.sp_size
    labels = hex_labels(h, w, side)
    size = int(labels.max()) + 1
    p = parameters(image, labels, np.full(size, float(h * w // size)), np.zeros(size, bool), side)
    step, count, last = 0, 0, 0
    still = False  # the last border moves changed nothing: under the same labels the parameters and borders stay
    while step < (o.most_rounds if o.target_nspix else o.rounds):
        if o.target_nspix:
            live = int(np.count_nonzero(np.bincount(labels[labels >= 0])))
            if step >= o.rounds and abs(live - o.target_nspix) <= 0.05 * o.target_nspix:
                break
            o, last = controlled(o, live, step, last)
        before = labels
        if not still:
            p = refit(image, labels, p, side)
        if o.use_sm and step > o.sm_start:
            if step % 4 == 0:
                labels, p = split(image, labels, p, o, count)
                count += 1
                log("split", labels)
            elif step % 4 == 2:
                told: list = []
                labels, p = merge(image, labels, p, o, count, told=told)
                log("merge", labels, told[0])
        if not still or labels is not before:
            before, labels = labels, update_labels(image, labels, p, o.sigma2, o.potts, o.niters_seg)
            still = bool((labels == before).all())
        log("bndy", labels)
        step += 1
        if step % 8 == 0:
            labels, p = compact(labels, p)
    return compact(labels, refit(image, labels, p, side))


def merge_only(image: np.ndarray, labels: np.ndarray, o: Options, rounds: int) -> np.ndarray:
    size = int(labels.max()) + 1
    p = parameters(image, labels, np.full(size, float(o.sp_size**2)), np.zeros(size, bool), o.sp_size)
    for k in range(rounds):
        labels, p = merge(image, labels, p, o, k)
        labels = update_labels(image, labels, p, o.sigma2, o.potts, 1)
        p = refit(image, labels, p, o.sp_size)
    return compact(labels, p)[0]


def merge_loop(image: np.ndarray, labels: np.ndarray, o: Options, rounds: int, told: list | None = None) -> np.ndarray:
    """Rounds of downward merges as in a later frame, which leave out the frame's edge; no border moves, ids are kept."""
    size = int(labels.max()) + 1
    live = max(1, len(np.unique(labels[labels >= 0])))
    p = parameters(image, labels, np.full(size, float(labels.size // live)), np.zeros(size, bool), o.sp_size)
    for _ in range(rounds):
        labels, p = merge(image, labels, refit(image, labels, p, o.sp_size), o, 1, 2, told)
    return labels


def pieces(labels: np.ndarray) -> np.ndarray:
    """8-connected pieces of equal labels: each pixel gets the least index of its piece, -1 where there is no label."""
    h, w = labels.shape
    begins = labels >= 0
    begins[:, 1:] &= labels[:, 1:] != labels[:, :-1]
    run = np.maximum.accumulate(np.where(begins.ravel(), np.arange(h * w), 0)).reshape(h, w)  # runs of a row by their first pixel
    up, down = [], []
    for dx in (-1, 0, 1):
        a, b = slice(max(0, -dx), w - max(0, dx)), slice(max(0, dx), w + min(0, dx))
        same = (labels[:-1, a] == labels[1:, b]) & (labels[:-1, a] >= 0)
        up.append(run[:-1, a][same])
        down.append(run[1:, b][same])
    u, v, root = np.concatenate(up), np.concatenate(down), np.arange(h * w)
    while (root[u] != root[v]).any():
        u, v = root[u], root[v]
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        np.minimum.at(root, v, u)
        while (root[root] != root).any():
            root = root[root]
    return np.where(labels >= 0, root[run], -1)


def largest_pieces(labels: np.ndarray) -> np.ndarray:
    """Only the largest piece of each label stays, the first one of equals."""
    index = pieces(labels)
    ids, inverse, n = np.unique(index, return_inverse=True, return_counts=True)
    own = labels.ravel()[np.maximum(ids, 0)]
    order = np.lexsort((ids, -n, own))
    order = order[ids[order] >= 0]
    first = np.append(True, own[order][1:] != own[order][:-1]) if len(order) else np.zeros(0, bool)
    good = np.zeros(len(ids), bool)
    good[order[first]] = True
    return np.where(good[inverse].reshape(labels.shape), labels, -1)


def shift(labels: np.ndarray, flow: np.ndarray, smaller_wins: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Moves regions by their mean motion (dx, dy); returns the labels and each region's motion."""
    h, w = labels.shape
    size = int(labels.max()) + 1
    n = sums(labels, np.ones(labels.shape), size)
    move = np.stack([sums(labels, flow[..., k], size) / np.maximum(n, 1) for k in (0, 1)], 1)
    whole = np.trunc(move + np.copysign(0.5, move)).astype(int)
    y, x = np.nonzero(labels >= 0)
    k = labels[y, x]
    ny, nx = y + whole[k, 1], x + whole[k, 0]
    ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
    ny, nx, k = ny[ok], nx[ok], k[ok]
    order = np.lexsort((-k, -n[k] if smaller_wins else n[k]))  # the winner is written last
    out = np.full((h, w), -1)
    out[ny[order], nx[order]] = k[order]
    return out, move


def fill(labels: np.ndarray, centre: np.ndarray, passes: int = 0, size: tuple[int, int] | None = None) -> np.ndarray:
    """Missing pixels take the neighbouring label with the nearest centre, from the edges of holes inwards.

    passes: how many passes of four phases at most, 0 for all. size: height and width of the frame, if labels are a part.
    """
    labels, done = labels.copy(), 0
    h, w = labels.shape
    tall, wide = size or (h, w)
    while (before := (labels < 0).sum()) and (not passes or done < passes):
        done += 1
        for a, b in PHASES:
            hole = np.zeros((h, w), bool)
            hole[b::2, a::2] = labels[b::2, a::2] < 0
            y, x = np.nonzero(hole)
            near = np.stack([around(labels, d)[y, x] for d in "nswe"], 1)
            k = np.maximum(near, 0)
            d = np.where(near >= 0, ((x[:, None] - centre[k, 0]) / wide) ** 2 + ((y[:, None] - centre[k, 1]) / tall) ** 2, np.inf)
            best = near[np.arange(len(y)), np.lexsort((near, np.round(d, 9)), axis=1)[:, 0]] if len(y) else np.zeros(0, int)
            found = np.isfinite(d).any(1) if len(y) else np.zeros(0, bool)
            labels[y[found], x[found]] = best[found]
        if (labels < 0).sum() == before:
            break
    return labels


def near_pairs(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a and b that lie in the same or neighbouring cells, as wide as the radius, of the first three
    components: all pairs within the radius and few others, found by sorted cells."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ca, cb = (np.floor(m[:, :3] / radius).astype(np.int64) for m in (a, b))
    low = np.minimum(ca.min(0), cb.min(0)) - 1
    ca, cb = ca - low, cb - low
    wide = np.maximum(ca.max(0), cb.max(0)) + 2
    if float(wide[0]) * float(wide[1]) * float(wide[2]) >= 2.0**62:  # cells that can't be numbered: those of one component
        wide, ca, cb = np.array([1, 1, 1]), ca * [0, 0, 1], cb * [0, 0, 1]
    factor = np.array([wide[1] * wide[2], wide[2], 1])
    key = cb @ factor
    order = np.argsort(key, kind="stable")
    key = key[order]
    left, right = [], []
    steps = sorted({int(np.dot(step, factor)) for step in np.ndindex(3, 3, 3)})
    middle = int(np.dot((1, 1, 1), factor))
    for step in steps:
        at = ca @ factor + step - middle
        first, last = np.searchsorted(key, at), np.searchsorted(key, at, "right")
        size = last - first
        left.append(np.repeat(np.arange(len(a)), size))
        right.append(order[np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())])
    return np.concatenate(left), np.concatenate(right)


_NEAR = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3), -1).reshape(27, 3)
_FACTORS = np.array([73856093, 19349663, 83492791], np.int64)


class Cells:
    """Rows of three components sorted by their cells, as wide as the radius; near() gives the rows in the cells around
    others, and few more whose cells share a number."""

    def __init__(self, at: np.ndarray, radius: float):
        self.radius = radius
        key = self._cells(at) @ _FACTORS
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _cells(self, at: np.ndarray) -> np.ndarray:
        return np.floor(at / self.radius).astype(np.int64)

    def near(self, at: np.ndarray) -> np.ndarray:
        key = ((self._cells(at)[:, None] + _NEAR) @ _FACTORS).ravel()
        first, last = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        return np.concatenate([self.order[a:b] for a, b in zip(first[first < last], last[first < last], strict=True)] or [self.order[:0]])


def features(mu: np.ndarray, centre: np.ndarray, shape: tuple) -> np.ndarray:
    """One colour and the place, so scaled that near regions are near in them."""
    return np.column_stack([mu[:, 0], math.sqrt(10) * centre / (shape[1], shape[0])])


class Dead:
    """The ids that were dead in some frame, by their cells: a step into the next frame looks at those near its regions
    only, however many there are. Ids that died lately are kept apart and sorted in with the rest from time to time."""

    def __init__(self, state: State, radius: float, rest: tuple[np.ndarray, Cells] | None = None, late: np.ndarray | None = None):
        self.radius, shape = radius, state.labels.shape
        if rest is None or len(late) > 512:
            alive = np.zeros(len(state.n), bool)
            alive[state.labels[state.labels >= 0]] = True
            ids, late = np.flatnonzero((state.n > 0) & ~alive), np.zeros(0, np.int64)
            rest = ids, Cells(features(state.mu[ids], state.centre[ids], shape), radius)
        self.rest, self.late = rest, late
        self.cells = Cells(features(state.mu[late], state.centre[late], shape), radius)

    def near(self, at: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.rest[0][self.rest[1].near(at)], self.late[self.cells.near(at)]]))

    def after(self, state: State, died: np.ndarray) -> Dead:
        return Dead(state, self.radius, self.rest, np.append(self.late, died)) if len(died) else self


def revive(labels: np.ndarray, p: Params, state: State, o: Options, led: np.ndarray | None = None) -> tuple[np.ndarray, Params]:
    """Living regions close to a dead id take it over; those far from what they were get a new one.

    Where they are many, only living and dead regions whose colours and places share a cell are compared. led: the places to which the motion
    led the regions, NaN where it led none. A region that is as close to its own there stays what it is: else one that
    moves would give way to whatever once ended at the place it passes.
    """
    h, w = labels.shape
    known, size = len(state.n), len(p.n)
    live = np.flatnonzero(p.n > 0)
    gone = state.n > 0
    gone[live[live < known]] = False
    dead = np.flatnonzero(gone)
    to, own = np.arange(size), np.full(size, -1.0)
    kept = live[live < known]
    kept = kept[state.n[kept] > 0]

    def delta(a: np.ndarray, b: np.ndarray, centre: np.ndarray = state.centre) -> np.ndarray:
        place = ((p.centre[a] - centre[b]) / (w, h)) ** 2
        return ((p.mu[a] - state.mu[b]) ** 2).sum(-1) + 10 * place.sum(-1)

    own[kept] = delta(kept, kept)
    wants = np.zeros(size, bool)
    if len(live) * len(dead) <= 4096:  # all of them
        i, j = np.divmod(np.arange(len(live) * len(dead)), max(1, len(dead)))
    else:
        i, j = near_pairs(features(p.mu[live], p.centre[live], (h, w)), features(state.mu[dead], state.centre[dead], (h, w)), math.sqrt(o.epsilon_reid))
    k, j = live[i], dead[j]
    d = delta(k, j)
    close = (d < o.epsilon_reid) & ~((own[k] >= 0) & (own[k] <= d))
    if led is not None:
        along = np.full(size, np.inf)
        there = kept[np.isfinite(led[kept]).all(1)]
        along[there] = delta(there, there, led)
        close &= along[k] > d + 1e-9
    k, j, d = k[close], j[close], d[close]
    for nearest in (np.lexsort((j, d, k)), None):  # each region's nearest dead id, then each dead id's nearest region
        order = nearest if nearest is not None else np.lexsort((k, d, j))
        k, j, d = k[order], j[order], d[order]
        by = k if nearest is not None else j
        first = np.append(True, by[1:] != by[:-1]) if len(by) else np.zeros(0, bool)
        k, j, d = k[first], j[first], d[first]
        if nearest is not None:
            wants[k] = True
    to[k] = j
    changed = live[~wants[live] & (own[live] > o.epsilon_new)]
    if not len(k) and not len(changed):
        return labels, p
    top = size + len(changed)
    to[changed] = np.arange(size, top)
    out = {c: np.concatenate([getattr(p, c), getattr(p, c)[changed]]) for c in ("prior_count", "propagated", "sample", "prior")}
    out["propagated"][size:] = False
    empty = {c: np.zeros((top, *getattr(p, c).shape[1:])) for c in ("n", "mu", "centre", "inverse", "logdet")}
    return np.where(labels >= 0, to[np.maximum(labels, 0)], -1), replace(p, **out, **empty)


def first_frame(image: np.ndarray, o: Options, log: Log = silent) -> State:
    labels, p = segment_image(image, o, log)
    return state_of(labels, p)


def state_of(labels: np.ndarray, p: Params) -> State:
    return State(labels, p.n, p.mu, p.centre, p.inverse, scatter(labels, len(p.n))[2] / np.maximum(p.n, 1)[:, None], p.prior_count)


def carried_priors(state: State, filled: np.ndarray, size: int, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, samples and prior matrices of the ids in the next frame, before it is fitted.

    With prop_nc the weight is the size before, or for ids that had no pixels then the size after filling; without, the
    weight that was kept. A prior matrix is the adjugate-free inverse of the kept one: its off-diagonal keeps its sign.
    """
    known = len(state.n)
    before, now = np.zeros(size), np.bincount(filled[filled >= 0], minlength=size).astype(float)
    before[:known] = np.bincount(state.labels[state.labels >= 0], minlength=known)
    weight = np.where(before > 0, before, now)
    if not o.prop_nc and state.prior_count is not None:
        weight[:known] = state.prior_count
    sample, prior = round_shapes(size), round_shapes(size)
    if state.inverse is not None:
        kept = state.inverse[:, 0] * state.inverse[:, 2] - state.inverse[:, 1] ** 2
        good = kept > 0
        prior[:known][good] = state.inverse[good][:, [2, 1, 0]] / kept[good, None]
        sample[:known] = state.sample
    return weight, sample, prior


_KEPT = ("n", "mu", "centre", "inverse", "sample", "prior_count")


def rows_of(state: State, labels: np.ndarray, ids: np.ndarray) -> State:
    """The state of those ids alone."""
    return State(labels, *(None if getattr(state, name) is None else getattr(state, name)[ids] for name in _KEPT))


class Named:
    """A step's regions numbered from 0: first the ids of the state that it deals with, in their order, then new ones."""

    def __init__(self, state: State, ids: np.ndarray):
        self.state, self.ids = state, ids

    def outer(self, a: np.ndarray) -> np.ndarray:
        """Numbers as ids; the new ones follow all ids of the state."""
        m = len(self.ids)
        known = np.append(self.ids, -1)
        return np.where(a < 0, a, np.where(a < m, known[np.clip(a, 0, m)], a - m + len(self.state.n)))

    def nearest(self, dead: Dead, p: Params, o: Options, shape: tuple) -> np.ndarray:
        """Of the dead ids that the step doesn't deal with, those that are nearest to a living region: no other could be revived."""
        live = np.flatnonzero(p.n > 0)
        at = features(p.mu[live], p.centre[live], shape)
        more = np.setdiff1d(dead.near(at), self.ids, assume_unique=True)
        mu, centre = self.state.mu[more], self.state.centre[more]
        if len(live) * len(more) <= 4096:
            i, j = np.divmod(np.arange(len(live) * len(more)), max(1, len(more)))
        else:
            i, j = near_pairs(at, features(mu, centre, shape), dead.radius)
        place = ((p.centre[live[i]] - centre[j]) / (shape[1], shape[0])) ** 2
        d = ((p.mu[live[i]] - mu[j]) ** 2).sum(-1) + 10 * place.sum(-1)
        i, j, d = i[d < o.epsilon_reid], j[d < o.epsilon_reid], d[d < o.epsilon_reid]
        order = np.lexsort((j, d, i))
        return more[np.unique(j[order[np.unique(i[order], return_index=True)[1]]])]

    def admit(self, more: np.ndarray, inner: State, labels: np.ndarray, p: Params, led: np.ndarray, o: Options) -> tuple[State, np.ndarray, Params, np.ndarray]:
        """Takes in dead ids; numbers keep the order of ids."""
        m, none = len(self.ids), np.full((1, 1), -1)
        at = np.searchsorted(self.ids, more)
        weight, sample, prior = carried_priors(rows_of(self.state, none, more), none, len(more), o)
        new = {"prior_count": weight, "propagated": np.ones(len(more), bool), "sample": sample, "prior": prior}
        grown = {c: np.insert(getattr(p, c), at, new.get(c, 0), 0) for c in ("n", "mu", "centre", "inverse", "logdet", "prior_count", "propagated", "sample", "prior")}
        to = np.arange(len(p.n))
        to += np.where(to < m, np.searchsorted(at, np.minimum(to, m), "right"), len(more))
        self.ids = np.insert(self.ids, at, more)
        labels = np.where(labels >= 0, to[np.maximum(labels, 0)], labels)
        return rows_of(self.state, inner.labels, self.ids), labels, replace(p, **grown), np.insert(led, at, np.nan, 0)


def next_frame(image: np.ndarray, flow: np.ndarray, state: State, o: Options, log: Log = silent) -> State:
    """Propagates the regions along the motion into the next frame and fits them there; ids stay stable.

    log gets the labels after each step: shifted, filled (once whole, once with the largest pieces only), then split,
    relabel, merge and bndy. Only living ids and dead ones near them take part, however many were seen.
    """
    h, w = state.labels.shape
    outer, seen = state, len(state.n)
    dead = state.dead if state.dead is not None and state.dead.radius == math.sqrt(o.epsilon_reid) else Dead(state, math.sqrt(o.epsilon_reid))
    held = np.flatnonzero(np.bincount(state.labels[state.labels >= 0], minlength=seen))
    names, to = Named(outer, held), np.full(seen + 1, -1)
    to[held] = np.arange(len(held))
    state = rows_of(outer, to[state.labels], held)

    def tell(step: str, labels: np.ndarray, merges: tuple | None = None) -> None:
        if log is not silent:
            log(step, names.outer(labels), merges if merges is None else (names.outer(merges[0]), names.outer(merges[1]), *merges[2:]))

    size = len(state.n)
    moved, motion = shift(state.labels, flow, o.smaller_wins)
    tell("shifted", moved)
    centre = state.centre + motion
    if (moved >= 0).any():
        whole = fill(moved, centre)
        tell("filled", whole)
        filled = fill(largest_pieces(whole), centre)
    else:  # its labels are new ones and ids of the state
        names, state = Named(outer, np.arange(seen)), outer
        filled = hex_labels(h, w, o.sp_size)
    tell("filled", filled)
    known = len(names.ids)
    size = max(known, int(filled.max()) + 1)
    invalid = moved < 0
    share = invalid.mean()
    rounds = o.vid_niters or (12 if share > 0.2 else 4 if share < 0.01 else 8)
    weight, sample, prior = carried_priors(state, filled, size, o)
    p = parameters(image, filled, weight, np.arange(size) < known, o.sp_size, sample, prior, o.prop_icov)
    led = np.where((p.n > 0)[:, None], p.centre, np.nan)
    labels, count, last = filled, 0, 0
    step, still, fitted = 0, False, True  # fitted: p is that of the labels
    while step < (o.most_rounds if o.target_nspix else rounds):
        before = labels
        if not fitted:
            p, fitted = refit(image, labels, p, o.sp_size), True
        if o.target_nspix:
            live = int(np.count_nonzero(np.bincount(labels[labels >= 0])))
            if step >= rounds and abs(live - o.target_nspix) <= 0.05 * o.target_nspix:
                break
            o, last = controlled(o, live, step, last)
            if step > 2000 and step % 200 == 0:
                o = replace(o, epsilon_new=2 * o.epsilon_new)
        if step % 4 == 1:
            labels, p = split(image, labels, p, o, count, invalid)
            count += 1
            tell("split", labels)
        elif step % 4 == 3:
            more = names.nearest(dead, p, o, (h, w))
            if len(more):
                state, labels, p, led = names.admit(more, state, labels, p, led, o)
                before = labels
            labels, q = revive(labels, p, state, o, led)
            tell("relabel", labels)
            told: list = []
            labels, p = merge(image, labels, p if q is p else refit(image, labels, q, o.sp_size), o, count, 2, told)
            tell("merge", labels, told[0])
        if not still or (labels is not before and (labels != before).any()):
            before, labels = labels, update_labels(image, labels, p, o.sigma2, o.potts, o.niters_seg)
            still = bool((labels == before).all())
            fitted = still
        tell("bndy", labels)
        step += 1
    known = len(names.ids)
    labels, p = compact(labels, p if fitted else refit(image, labels, p, o.sp_size), known)
    found = State(labels, p.n, p.mu, p.centre, p.inverse, scatter(labels, len(p.n))[2] / np.maximum(p.n, 1)[:, None], p.prior_count)
    alive, out = p.n[:known] > 0, {}
    for name in _KEPT:  # dead ids are remembered
        old, new = getattr(outer, name), getattr(found, name)
        out[name] = np.concatenate([np.zeros((seen, *new.shape[1:])) if old is None else old, new[known:]])
        stays = alive if name != "prior_count" else slice(None)
        out[name][names.ids[stays]] = new[:known][stays]
    now = State(names.outer(labels), **out)
    here = np.zeros(len(now.n), bool)
    here[names.ids[alive]] = True
    return replace(now, dead=dead.after(now, held[~here[held]]))
