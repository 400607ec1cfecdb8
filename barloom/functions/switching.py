"""Two-state Gaussian switching model, fitted for many return histories at once.

Maximum likelihood by expectation-maximisation over the Hamilton (1989) filter and its backward
pass, sped up by squared extrapolation (Varadhan & Roland 2008). Histories are the columns of
one matrix; a column never sees another column or anything after its own length. Filter and backward
pass run on the odds of state 1.

Few histories run as blocked scans: a row is a 2x2 matrix, products of rows are associative, so the steps in
time are twice the root of a history and not its length. Many run side by side in lanes, row by row, the filter
from the first row and the backward pass from the last in the same calls; a lane whose history is done takes
the next one, and what is no recursion is computed for as many rows at once as a core's cache holds.
"""

from collections.abc import Iterator, Sequence

import numpy as np

#: A guard only: a history that has not met the tolerance by then has no fit.
MAX_CYCLES = 5000
TOLERANCE = 1e-8
LOG_ODDS_LIMIT = 150.0

#: Histories that run side by side, how many are too few to go row by row, and by how much their lengths may differ.
LANES, FEW_LANES, LENGTHS_ALIKE = 512, 80, 1.5
#: Cells that are computed at once, in arrays that fit a core's cache together.
SLAB_CELLS = 16_384


def latest_regimes(histories: list[np.ndarray]) -> list[int | None]:
    """State at the end of each history: 1 the higher-mean one, 0 the other, None if no fit."""
    labels: list[int | None] = [None] * len(histories)
    for some in _alike([len(h) for h in histories]):
        for place, label in zip(some, _fit_lanes([histories[place] for place in some]), strict=True):
            labels[place] = label
    return labels


def _alike(lengths: Sequence[int]) -> Iterator[list[int]]:
    """Places of histories of about one length, the longest first."""
    held: list[int] = []
    for place in sorted(range(len(lengths)), key=lambda place: -lengths[place]):
        if held and lengths[held[0]] > LENGTHS_ALIKE * lengths[place]:
            yield held
            held = []
        held.append(place)
    if held:
        yield held


class _Lanes:
    """Histories side by side, each ending in the last row; rows before a history have a ratio of 1.

    Under such a ratio the stationary odds stay as they are, so the filter needs no other start.
    """

    def __init__(self, rows: int, lanes: int):
        self.rows = rows
        self.y, self.inside, self.lengths = np.zeros((rows, lanes)), np.zeros((rows, lanes)), np.zeros(lanes)
        self.near_0, self.near_1 = np.empty((rows, lanes)), np.empty((rows, lanes))
        # by row: the filter's row and, from the end, the backward pass's
        self.ratios, self.coming = np.ones((rows, 2, lanes)), np.ones((rows, 2, lanes))
        slab = 4 * max(1, SLAB_CELLS // lanes // 4)
        self.slabs = [slice(first, min(first + slab, rows)) for first in range(0, rows, slab)]
        self.spare = np.empty((6, slab, lanes))

    def put(self, lane: int, history: np.ndarray) -> None:
        first = self.rows - len(history)
        self.y[:first, lane], self.inside[:first, lane] = 0.0, 0.0
        self.y[first:, lane], self.inside[first:, lane] = history, 1.0
        self.lengths[lane] = len(history)

    def keep(self, lanes: np.ndarray) -> None:
        """Go on with some lanes only."""
        fewer = _Lanes(self.rows, len(lanes))
        fewer.y[:], fewer.inside[:], fewer.lengths[:] = self.y[:, lanes], self.inside[:, lanes], self.lengths[lanes]
        self.__dict__ = fewer.__dict__

    def step(self, theta):
        """As ``_step``."""
        mean, variance = theta[:2], np.exp(theta[2:4])
        p00, p11 = np.clip(1 / (1 + np.exp(-theta[4:])), 1e-10, 1 - 1e-10)
        p01, p10 = 1 - p00, 1 - p11
        squares = self._set_ratios(mean, variance)
        if self.y.shape[1] < FEW_LANES:
            self._scan(p00, p01, p10, p11)
        else:
            self._pass(p00, p01, p10, p11)
        likelihood = -0.5 * (self.lengths * np.log(2 * np.pi * variance[0]) + squares / variance[0])
        latest = self.coming[-1, 0].copy()
        # (1 + filtered) / (1 + prior) over all rows, most of which cancels
        likelihood += np.log((1 + latest) / (1 + p01 / p10))
        sums = np.zeros((8, len(p00)))
        for rows in self.slabs:
            likelihood += self._add_rows(rows, sums, p00, p01, p10, p11)
        share, later, before, both = sums[:4]
        moves = np.array([p00 * share, p01 * later, p11 * both, p10 * before])
        # weights of the states: those of the moves, and the last row's, which nothing follows
        last = np.array([1 / (1 + latest), latest / (1 + latest)])
        amounts = np.array([moves[0] + moves[1], moves[2] + moves[3]]) + last
        centers = sums[4:6] / amounts
        spreads = sums[6:8] / amounts
        variances = spreads - (centers - mean) ** 2
        updated = np.concatenate([centers, np.log(variances), np.clip(np.log(moves[::2] / moves[1::2]), -23.0, 23.0)])
        # the difference has lost its digits where a state has shrunk to a few equal returns
        poor = np.flatnonzero(~(variances > 1e-6 * spreads).all(axis=0) & np.isfinite(theta).all(axis=0))
        if len(poor):
            lengths = self.lengths[poor].astype(int)
            y = np.zeros((self.rows, len(poor)))
            for column, (lane, n) in enumerate(zip(poor, lengths)):
                y[:n, column] = self.y[self.rows - n :, lane]
            updated[:, poor], likelihood[poor], latest[poor] = _step(theta[:, poor], y, lengths)
        return updated, likelihood, latest

    def _set_ratios(self, mean, variance):
        half = 0.5 / variance
        shift = 0.5 * np.log(variance[0] / variance[1])
        squares = -(self.rows - self.lengths) * mean[0] ** 2  # rows before a history hold zeros
        for rows in self.slabs:
            near_0, near_1, y = self.near_0[rows], self.near_1[rows], self.y[rows]
            a, b = self.spare[:2, : len(y)]
            np.subtract(y, mean[0], out=near_0)
            np.multiply(near_0, near_0, out=near_0)
            squares += near_0.sum(axis=0)
            np.multiply(near_0, half[0], out=a)
            np.subtract(y, mean[1], out=near_1)
            np.multiply(near_1, near_1, out=near_1)
            np.multiply(near_1, half[1], out=b)
            np.subtract(a, b, out=a)
            np.add(a, shift, out=a)
            np.clip(a, -LOG_ODDS_LIMIT, LOG_ODDS_LIMIT, out=a)
            np.multiply(a, self.inside[rows], out=a)
            np.exp(a, out=a)
            self.ratios[rows, 0] = a
            self.ratios[self.rows - rows.stop : self.rows - rows.start, 1] = a[::-1]
        return squares

    def _pass(self, p00, p01, p10, p11):
        """``coming``: odds after each row, and relative likelihoods of the rows from each row on."""
        slope, level = np.array([[p11, p11], [p10, p01]]), np.array([[p01, p10], [p00, p00]])
        odds = np.stack([p01 / p10, np.ones_like(p00)])
        both = np.empty_like(slope)
        upper, lower = both
        for ratio, coming in zip(self.ratios, self.coming):
            np.multiply(odds, ratio, coming)
            np.multiply(slope, coming, both)
            np.add(both, level, both)
            np.divide(upper, lower, odds)

    def _scan(self, p00, p01, p10, p11):
        """As ``_pass``, in blocks."""
        ratio = self.ratios[:, 0]
        np.multiply(forward_odds(ratio, p00, p01, p10, p11), ratio, self.coming[:, 0])
        np.multiply(backward_odds(ratio, p00, p01, p10, p11), ratio, self.coming[::-1, 1])

    def _add_rows(self, rows, sums, p00, p01, p10, p11):
        """Add up what the update needs of some rows; also the logarithm of their odds' denominators."""
        first, stop = rows.start, rows.stop
        filtered = self.coming[rows, 0]
        up, down, share, coming, product = self.spare[:5, : stop - first]
        moving = min(stop, self.rows - 1) - first  # nothing follows the last row
        coming[:moving] = self.coming[self.rows - 1 - first - moving : self.rows - 1 - first, 1][::-1]
        coming[moving:] = 0.0
        np.multiply(coming, p11, up)
        np.add(up, p10, up)
        np.multiply(coming, p01, down)
        np.add(down, p00, down)
        if moving < stop - first:
            up[moving:] = down[moving:] = 1.0
        np.multiply(up, filtered, up)
        np.add(up, down, share)
        np.divide(self.inside[rows], share, share)
        np.multiply(up, share, up)
        np.multiply(down, share, down)
        for state, weight in ((0, down), (1, up)):
            sums[4 + state] += _sum(weight, self.y[rows])
            sums[6 + state] += _sum(weight, (self.near_0, self.near_1)[state][rows])
        share[moving:] = 0.0
        sums[0] += share.sum(axis=0)
        sums[2] += _sum(share, filtered)
        np.multiply(coming, share, coming)
        sums[1] += coming.sum(axis=0)
        sums[3] += _sum(coming, filtered)
        # before a history this is 1; four together stay in range
        np.multiply(filtered, p10, product)
        np.add(product, p00, product)
        product[moving:] = 1.0
        if len(product) % 4:
            return np.log(product).sum(axis=0)
        np.multiply(product[0::2], product[1::2], up[: len(up) // 2])
        joint = np.multiply(up[0 : len(up) // 2 : 2], up[1 : len(up) // 2 : 2], down[: len(up) // 4])
        return np.log(joint, joint).sum(axis=0)


def _fit_lanes(histories: list[np.ndarray]) -> list[int | None]:
    """The labels of histories, the longest first."""
    labels: list[int | None] = [None] * len(histories)
    count = min(LANES, len(histories))
    lanes = _Lanes(len(histories[0]), count)
    owner, turn = np.arange(count), count
    for lane in range(count):
        lanes.put(lane, histories[lane])
    theta = _start_of(histories[:count])
    # a cycle's points, likelihoods and how far it is: two steps, a leap, and the two steps instead of a bad one
    now, once, twice = theta.copy(), theta.copy(), theta.copy()
    before, middle = np.zeros(count), np.zeros(count)
    phase, cycles = np.zeros(count, np.int8), np.zeros(count, np.int64)
    with np.errstate(all="ignore"):
        while True:
            after, reached, latest = lanes.step(theta)
            first, second, leapt, again = (phase == p for p in range(4))
            before = np.where(first, reached, before)
            middle = np.where(second, reached, middle)
            once, twice = np.where(first, after, once), np.where(second, after, twice)
            change, bend = once - now, twice - 2 * once + now
            length = np.sqrt((change**2).sum(axis=0) / (bend**2).sum(axis=0))
            stride = np.where(np.isfinite(length), np.maximum(length, 1.0), 1.0)
            leap = now + 2 * stride * change + stride**2 * bend
            # A leap that loses likelihood is replaced by the two plain steps.
            good = leapt & np.isfinite(reached) & np.isfinite(after).all(axis=0) & (reached >= middle)
            bad = leapt & ~good
            now = np.where(good, after, np.where(bad, twice, now))
            ends = good | again
            broken = ends & (~np.isfinite(reached) | ~np.isfinite(now).all(axis=0) | np.isnan(latest))
            done = broken | (ends & (np.abs(reached - before) <= TOLERANCE * np.abs(reached)))
            cycles += ends
            theta = np.where(second, leap, np.where(ends, now, np.where(bad, twice, after)))
            phase = np.where(first, 1, np.where(second, 2, np.where(bad, 3, 0)))
            over = (done | (cycles >= MAX_CYCLES)) & (owner >= 0)
            if not over.any():
                continue
            for lane in np.flatnonzero(over):
                if done[lane] and not broken[lane]:
                    labels[owner[lane]] = int((latest[lane] > 1.0) == (now[1, lane] > now[0, lane]))
            places = np.flatnonzero(over)
            free = places[: len(histories) - turn]
            if len(free):
                own = np.arange(turn, turn + len(free))
                turn += len(free)
                owner[free], cycles[free] = own, 0
                theta[:, free] = now[:, free] = _start_of([histories[h] for h in own])
                for lane, h in zip(free, own):
                    lanes.put(lane, histories[h])
            owner[places[len(free) :]] = -1
            going = owner >= 0
            if not going.any():
                break
            # lanes without a history are dropped once they are many
            if going.sum() <= 0.75 * len(going):
                left = np.flatnonzero(going)
                lanes.keep(left)
                theta, now, once, twice = theta[:, left], now[:, left], once[:, left], twice[:, left]
                owner, before, middle, phase, cycles = (a[left] for a in (owner, before, middle, phase, cycles))
    return labels


def _start_of(histories: Sequence[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(h) for h in histories])
    y = np.zeros((lengths.max(), len(histories)))
    for column, history in enumerate(histories):
        y[: len(history), column] = history
    return _start(y, lengths)


def _start(y, lengths):
    """Rows: two means, two log variances, two logits of staying."""
    inside = np.arange(len(y))[:, None] < lengths
    center = y.sum(axis=0) / lengths
    spread = np.where(inside, (y - center) ** 2, 0.0).sum(axis=0) / lengths
    zero = np.zeros_like(center)
    return np.array([zero, center / 2, np.log(spread / 10), np.log(spread), zero, zero])


def _fit(y, lengths):
    theta = _start(y, lengths)
    odds = np.ones(len(lengths))
    fitted = np.ones(len(lengths), dtype=bool)
    active = np.arange(len(lengths))
    for _ in range(MAX_CYCLES):
        size = lengths[active]
        data = y[: size.max(), active]
        now = theta[:, active]
        once, before, _ = _step(now, data, size)
        twice, middle, _ = _step(once, data, size)
        first, second = once - now, twice - 2 * once + now
        length = np.sqrt((first**2).sum(axis=0) / (second**2).sum(axis=0))
        stride = np.where(np.isfinite(length), np.maximum(length, 1.0), 1.0)
        leap = now + 2 * stride * first + stride**2 * second
        after, reached, latest = _step(leap, data, size)
        # A leap that loses likelihood is replaced by the two plain steps.
        good = np.isfinite(reached) & np.isfinite(after).all(axis=0) & (reached >= middle)
        theta[:, active] = np.where(good, after, twice)
        plain = ~good
        if plain.any():
            _, reached_plain, latest_plain = _step(twice[:, plain], data[:, plain], size[plain])
            reached[plain], latest[plain] = reached_plain, latest_plain
        odds[active] = latest
        broken = ~np.isfinite(reached) | ~np.isfinite(theta[:, active]).all(axis=0)
        broken |= np.isnan(latest)
        fitted[active[broken]] = False
        gain = np.abs(reached - before)
        done = broken | (gain <= TOLERANCE * np.abs(reached))
        active = active[~done]
        if not len(active):
            break
    fitted[active] = False
    return theta, odds, fitted


def _step(theta, y, lengths):
    """One update; also the log likelihood and the latest filtered odds before it."""
    mean, variance = theta[:2], np.exp(theta[2:4])
    stay = np.clip(1 / (1 + np.exp(-theta[4:])), 1e-10, 1 - 1e-10)
    p00, p11 = stay
    p01, p10 = 1 - p00, 1 - p11
    inside = np.arange(len(y))[:, None] < lengths
    near_0, near_1 = ((y - mean[k]) ** 2 for k in (0, 1))
    ratio = 0.5 * (near_0 / variance[0] - near_1 / variance[1] + np.log(variance[0] / variance[1]))
    ratio = np.exp(np.clip(ratio, -LOG_ODDS_LIMIT, LOG_ODDS_LIMIT))
    ratio[~inside] = 1.0

    prior = forward_odds(ratio, p00, p01, p10, p11)
    filtered = prior * ratio
    ahead = backward_odds(ratio, p00, p01, p10, p11)

    # state 0 alone, and what state 1 adds to it (nothing outside, where the ratio is 1)
    alone = -0.5 * (lengths * np.log(2 * np.pi * variance[0]) + _sum(near_0, inside) / variance[0])
    likelihood = alone + np.log((1 + filtered) / (1 + prior)).sum(axis=0)
    ends = (lengths - 1, np.arange(len(lengths)))

    # Expected transitions out of every row but the last of each history.
    moving = inside[1:]
    before = filtered[:-1]
    coming = ratio[1:] * ahead[1:]
    share = moving / (p00 + p01 * coming + before * (p10 + p11 * coming))
    coming *= share
    kept_0, left_0 = p00 * share.sum(axis=0), p01 * coming.sum(axis=0)
    kept_1, left_1 = p11 * _sum(before, coming), p10 * _sum(before, share)

    smoothed = filtered * ahead
    weight_0 = inside / (1 + smoothed)
    weight_1 = smoothed * weight_0
    means, variances = [], []
    for weight in (weight_0, weight_1):
        amount = weight.sum(axis=0)
        center = _sum(weight, y) / amount
        means.append(center)
        variances.append(_sum(weight, (y - center) ** 2) / amount)
    updated = np.array(
        [*means, *np.log(variances), np.log(kept_0 / left_0), np.log(kept_1 / left_1)]
    )
    updated[4:] = np.clip(updated[4:], -23.0, 23.0)
    return updated, likelihood, filtered[ends]


def _sum(a, b):
    return np.einsum("tc,tc->c", a, b)


def forward_odds(ratio, p00, p01, p10, p11):
    """[row, history] odds of state 1 before each observation, from the stationary odds.

    A row turns odds ``o`` into ``(p11 r o + p01) / (p10 r o + p00)``, a 2x2 matrix on ``(o, 1)``.
    """
    return _scan(ratio, p01 / p10, p11, p01, p10, p00)


def backward_odds(ratio, p00, p01, p10, p11):
    """[row, history] relative likelihood of the rows after each row: state 1 against state 0."""
    turned = ratio[:0:-1]
    out = np.ones_like(ratio)
    if len(turned):
        # from the end, and one row further than the scan, which stops before its last row
        odds = _scan(turned, np.ones(ratio.shape[1]), p11, p10, p01, p00)
        last = turned[-1] * odds[-1]
        out[0] = (p11 * last + p10) / (p01 * last + p00)
        out[1:] = odds[::-1]
    return out


def _scan(ratio, odds, a, b, c, d):
    """Odds before each row under ``o -> (a r o + b) / (c r o + d)``, from ``odds`` on.

    A prefix product of 2x2 matrices in blocks of about the root of the length: all blocks are
    multiplied up side by side, the odds pass from block to block, and all blocks run through
    side by side again.
    """
    rows, histories = ratio.shape
    size = max(1, int(np.ceil(np.sqrt(rows))))
    blocks = -(-rows // size)
    steps = np.ones((blocks * size, histories))
    steps[:rows] = ratio
    # [step, block, history]: a step is one slice
    steps = np.ascontiguousarray(steps.reshape(blocks, size, histories).transpose(1, 0, 2))
    # the two columns of each block's matrix, scaled together often enough to stay in range
    upper = np.stack([np.ones((blocks, histories)), np.zeros((blocks, histories))])
    lower = 1 - upper
    for t in range(size):
        upper *= steps[t]
        upper, lower = a * upper + b * lower, c * upper + d * lower
        if t % 3 == 2:
            scale = 1 / (upper[0] + upper[1] + lower[0] + lower[1])
            upper *= scale
            lower *= scale
    starts = np.empty((blocks, histories))
    for k in range(blocks):
        starts[k] = odds
        odds = (upper[0, k] * odds + upper[1, k]) / (lower[0, k] * odds + lower[1, k])
    out = np.empty_like(steps)
    for t in range(size):
        out[t] = starts
        starts = starts * steps[t]
        starts = (a * starts + b) / (c * starts + d)
    return out.transpose(1, 0, 2).reshape(blocks * size, histories)[:rows]
