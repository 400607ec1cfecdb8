"""Trees of many fits grown together: candidates of one training set, and training sets of many tickers.

A fit is a training set with parameters. All fits of a pack add their next trees in one round. A round keeps
its rows in blocks, one for each node that may still be cut: a block holds the node's rows once for every
feature its fit drew, each time in the order of that feature's bins. One running sum over all blocks then
scores every cut of every node of every fit, and a stable partition makes the blocks of the next level, so
the cost of a level is its rows and not nodes times bins, and the number of numpy calls does not depend on
the fits of a pack.

Results equal those of :mod:`barloom.functions.histogram_trees` for each fit alone. Targets are shifted by
their mean and scaled by a power of two, so that no set's running sums cost those of its neighbours digits.
"""

from collections.abc import Iterator, Sequence

import numpy as np

from barloom.functions.histogram_trees import BOOSTED_BINS, LEAST_GAIN, MAX_BINS, TIE, Bins

#: Parameters of a candidate and their values where it names none.
DEFAULTS = {"subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0}

#: Cells (rows times features) that grow together: enough to hide the cost of calls, few enough for a core's cache.
PACK_CELLS = 120_000

#: A training set: features and target of its training rows, features of the rows to forecast.
Set = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Binned:
    """A training set as bin numbers, sorted once by each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tested: np.ndarray, max_bins: int):
        bins = Bins(x, max_bins)
        codes = bins.codes(x)
        order = np.argsort(codes, axis=1, kind="stable")
        self.size, self.tested, self.width = len(y), len(tested), x.shape[1]
        self.order = order.ravel()
        self.sorted_codes = np.take_along_axis(codes, order, axis=1).ravel().astype(np.int32)
        self.codes, self.test_codes = codes.T.astype(np.int32), bins.codes(tested).T.astype(np.int32)
        self.mean = y.mean()
        centred = y - self.mean
        self.scale = 2.0 ** -np.frexp(np.abs(centred).max())[1]
        self.target = centred * self.scale


class _Trees:
    """The growing trees of one round: [fit, node of a complete binary tree]."""

    def __init__(self, fits: int, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full((fits, size), -1, np.int32)
        self.cut = np.zeros((fits, size), np.int32)
        self.value = np.zeros((fits, size))
        self.depth = depth

    def predict(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Values of the leaves that the rows of ``codes`` [row, feature] reach in their owner's tree."""
        root = owner * self.feature.shape[1]
        cells = np.arange(len(codes)) * codes.shape[1]
        features, cuts, codes = self.feature.ravel(), self.cut.ravel(), codes.ravel()
        at = np.zeros(len(owner), np.int64)
        for _ in range(self.depth):
            node = root + at
            feature = features[node]
            inner = feature >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + 1 + (codes[cells + feature] > cuts[node]), at)
        return self.value.ravel()[root + at]


class _Layout:
    """The rows of some fits one after the other: by fit, and by (fit, feature, bin)."""

    def __init__(self, sets: Sequence[_Binned]):
        self.sizes = np.array([s.size for s in sets])
        self.width = sets[0].width
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([s.order + start for s, start in zip(sets, self.starts, strict=True)])
        self.code = np.concatenate([s.sorted_codes for s in sets])
        self.lane = np.repeat(np.arange(len(sets) * self.width), np.repeat(self.sizes, self.width))


def _squared(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    out = np.abs(g)
    out -= l1
    np.maximum(out, 0, out=out)
    out *= out
    return out


def _shrunk(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _grow(layout: _Layout, residual: np.ndarray, weight: np.ndarray, columns: np.ndarray, depths, least, l1, l2, gain) -> _Trees:
    """One tree for each fit.

    ``residual`` and whole-numbered ``weight`` are given for the rows of all fits, ``columns`` are the
    features [fit, feature] a tree may cut, and a cut gains more than ``gain``.
    """
    trees = _Trees(len(columns), int(depths.max()))
    lanes, lane_features = columns.sum(axis=1), np.argsort(~columns, axis=1, kind="stable")
    # blocks of the roots: fit, then feature, then bin
    times = weight[layout.flat] * columns.ravel()[layout.lane]
    place = np.flatnonzero(times)
    code, flat = layout.code[place], layout.flat[place]
    weighted = times.max(initial=0) > 1
    w = times[place].astype(np.int32) if weighted else None
    summed = weight * residual
    g = summed[flat]
    fit, number = np.arange(len(columns)), np.zeros(len(columns), np.int64)
    count = np.add.reduceat(weight > 0, layout.starts, dtype=np.int64)  # rows of a node
    size = np.add.reduceat(weight, layout.starts, dtype=np.int64)  # and their weight
    total = np.add.reduceat(summed, layout.starts)
    trees.value[:, 0] = _shrunk(total, l1) / (size + l2)
    side = np.zeros(len(residual), bool)
    penalised = bool(l1.any())
    for level in range(trees.depth):
        going = (depths[fit] > level) & (size >= 2 * least[fit]) & (count > 1)
        if not going.all():
            stays = np.repeat(going, count * lanes[fit])
            code, g, flat, w = code[stays], g[stays], flat[stays], w[stays] if weighted else None
            fit, number, count, size, total = fit[going], number[going], count[going], size[going], total[going]
        if not len(fit):
            break
        # a lane is a node's rows in the order of one feature
        lane_node = np.repeat(np.arange(len(count)), lanes[fit])
        lane_count = count[lane_node]
        lane_end = np.cumsum(lane_count)
        lane_start = lane_end - lane_count
        lane_of = np.repeat(np.arange(len(lane_count), dtype=np.int32), lane_count)
        # a cut lies between two bins of a lane, with enough rows on both sides
        cuts = np.empty(len(code), bool)
        np.not_equal(code[:-1], code[1:], out=cuts[:-1])
        cuts[lane_end - 1] = False
        at = np.flatnonzero(cuts)
        lane = lane_of[at]
        if weighted:
            running = np.cumsum(w)
            left_n = running[at] - (running[lane_start] - w[lane_start])[lane]
        else:
            left_n = at - (lane_start - 1)[lane]
        small = least[fit]
        if small.max() > 1:
            fits = np.flatnonzero((left_n >= small[lane_node][lane]) & (left_n <= (size - small)[lane_node][lane]))
            at, lane, left_n = at[fits], lane[fits], left_n[fits]
        if not len(at):
            break
        running = np.cumsum(g)
        left = running[at] - (running[lane_start] - g[lane_start])[lane]
        right = total[lane_node][lane] - left
        beta = l2[fit][lane_node]
        if penalised:
            alpha = l1[fit][lane_node][lane]
            score = _squared(left, alpha) / (left_n + beta[lane])
            score += _squared(right, alpha) / ((size[lane_node] + beta)[lane] - left_n)
        else:
            score = left * left / (left_n + beta[lane])
            score += right * right / ((size[lane_node] + beta)[lane] - left_n)
        heads = np.flatnonzero(np.diff(lane, prepend=-1))
        lane_top = np.maximum.reduceat(score, heads)
        inner = lane_node[lane[heads]]
        top = np.full(len(count), -np.inf)
        np.maximum.at(top, inner, lane_top)
        parent = _squared(total, l1[fit]) / (size + l2[fit])
        bar = np.where(top - parent > gain[fit], top * (1 - TIE), np.inf)
        # the first of the best cuts in feature and bin order; sums differ by their rounding only
        near = np.flatnonzero(score >= bar[lane_node][lane])
        if not len(near):
            break
        near = near[np.flatnonzero(np.diff(lane_node[lane[near]], prepend=-1))]
        at, lane, left_size, left_total = at[near], lane[near], left_n[near].astype(np.int64), left[near]
        split = lane_node[lane]
        of_node = lane - (np.cumsum(lanes[fit]) - lanes[fit])[split]
        trees.feature[fit[split], number[split]] = lane_features[fit[split], of_node]
        trees.cut[fit[split], number[split]] = code[at]
        children = np.stack([2 * number[split] + 1, 2 * number[split] + 2], axis=1).ravel()
        owners = np.repeat(fit[split], 2)
        sizes = np.stack([left_size, size[split] - left_size], axis=1).ravel()
        totals = np.stack([left_total, total[split] - left_total], axis=1).ravel()
        trees.value[owners, children] = _shrunk(totals, l1[owners]) / (sizes + l2[owners])
        if level + 1 == trees.depth:
            break
        # rows of the chosen lanes behind the cut go right
        left_count = at - lane_start[lane] + 1
        offsets = np.arange(int(count[split].sum())) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
        chosen = np.repeat(lane_start[lane], count[split]) + offsets
        side[flat[chosen]] = offsets >= np.repeat(left_count, count[split])
        # blocks of the children, each lane still in the order of its bins
        index = np.full(len(count), -1, np.int16 if 2 * len(split) < 1 << 15 else np.int64)
        index[split] = 2 * np.arange(len(split))
        child = np.repeat(index[lane_node], lane_count)
        if len(split) < len(count):
            kept = np.flatnonzero(child >= 0)
            kept = kept[np.argsort(child[kept] + side[flat[kept]], kind="stable")]
        else:
            kept = np.argsort(child + side[flat], kind="stable")
        code, g, flat, w = code[kept], g[kept], flat[kept], w[kept] if weighted else None
        counts = np.stack([left_count, count[split] - left_count], axis=1).ravel()
        fit, number, count, size, total = owners, children, counts, sizes, totals
    return trees


def _packs(cells: Sequence[int]) -> Iterator[range]:
    """Neighbouring fits whose cells reach ``PACK_CELLS`` together."""
    first, held = 0, 0
    for place, own in enumerate(cells):
        held += own
        if held >= PACK_CELLS:
            yield range(first, place + 1)
            first, held = place + 1, 0
    if first < len(cells):
        yield range(first, len(cells))


def boosted_fits(sets: Sequence[Set], fits: Sequence[tuple[int, dict]], seed: int) -> list[np.ndarray]:
    """Forecasts of each fit, a set's number and parameters as in ``histogram_trees.boosted``."""
    binned = [_Binned(*s, BOOSTED_BINS) for s in sets]
    own = [DEFAULTS | dict(params) for _, params in fits]
    # fits of about as many rounds and levels grow together, so that none waits long for others
    turn = sorted(range(len(fits)), key=lambda f: (int(own[f]["n_estimators"]), int(own[f]["max_depth"]), fits[f][0]))
    found: list = [None] * len(fits)
    for pack in _packs([binned[fits[f][0]].size * binned[fits[f][0]].width for f in turn]):
        members = [turn[place] for place in pack]
        grow = lambda some: _boosted_pack([binned[fits[f][0]] for f in some], [own[f] for f in some], seed)
        forecasts = grow(members)
        if len(members) > 1 and not all(np.isfinite(f).all() for f in forecasts):
            # numbers that are not finite spoil the sums of their neighbours
            forecasts = [grow([f])[0] for f in members]
        for f, forecast in zip(members, forecasts, strict=True):
            found[f] = forecast
    return found


def _boosted_pack(sets: list[_Binned], own: list[dict], seed: int) -> list[np.ndarray]:
    # fits end in the order of their rounds, so that those still growing come first
    turn = sorted(range(len(own)), key=lambda f: -int(own[f]["n_estimators"]))
    sets, own = [sets[f] for f in turn], [own[f] for f in turn]
    of = lambda name, kind=float: np.array([c[name] for c in own], kind)
    rounds, depths, scale = of("n_estimators", int), of("max_depth", int), np.array([s.scale for s in sets])
    rate, l1, l2, gain = of("learning_rate"), of("reg_alpha") * scale, of("reg_lambda"), LEAST_GAIN * scale**2
    least = np.maximum(of("min_child_weight"), 1e-9)
    width = sets[0].width
    # fits with as many rows and the same parameters draw the same rows and features
    kinds = [(s.size, max(1, int(round(c["subsample"] * s.size))), max(1, int(c["colsample_bytree"] * width))) for s, c in zip(sets, own, strict=True)]
    target = np.concatenate([s.target for s in sets])
    codes, test_codes = np.concatenate([s.codes for s in sets]), np.concatenate([s.test_codes for s in sets])
    owner, test_owner = (np.repeat(np.arange(len(sets)), [getattr(s, n) for s in sets]) for n in ("size", "tested"))
    fitted, out = np.zeros(len(target)), np.zeros(len(test_owner))
    draws = {kind: np.random.RandomState(seed) for kind in kinds}
    active = 0
    for step in range(int(rounds.max(initial=0))):
        growing = int((rounds > step).sum())
        if growing != active:
            active = growing
            layout = _Layout(sets[:active])
            rows, tests = int(layout.sizes.sum()), int(sum(s.tested for s in sets[:active]))
            chosen = dict.fromkeys(kinds[:active])
        for n, n_rows, n_columns in chosen:
            draw = draws[n, n_rows, n_columns]
            used, columns = np.ones(n, np.int8), np.ones(width, bool)
            if n_rows < n:
                used[draw.permutation(n)[n_rows:]] = 0
            if n_columns < width:
                columns[draw.permutation(width)[n_columns:]] = False
            chosen[n, n_rows, n_columns] = used, columns
        weight = np.concatenate([chosen[kind][0] for kind in kinds[:active]])
        columns = np.array([chosen[kind][1] for kind in kinds[:active]])
        trees = _grow(
            layout, target[:rows] - fitted[:rows], weight, columns, depths[:active], least[:active], l1[:active], l2[:active], gain[:active]
        )
        trees.value *= rate[:active, None]
        fitted[:rows] += trees.predict(codes[:rows], owner[:rows])
        out[:tests] += trees.predict(test_codes[:tests], test_owner[:tests])
    ends = np.cumsum([s.tested for s in sets])[:-1]
    forecasts = [part / s.scale + s.mean for part, s in zip(np.split(out, ends), sets, strict=True)]
    return [forecast for _, forecast in sorted(zip(turn, forecasts, strict=True), key=lambda pair: pair[0])]


def boosted_together(x: np.ndarray, y: np.ndarray, tested: np.ndarray, seed: int, candidates: Sequence[dict]) -> np.ndarray:
    """[candidate, row] forecasts for ``tested``; parameters as in ``histogram_trees.boosted``."""
    return np.array(boosted_fits([(x, y, tested)], [(0, c) for c in candidates], seed)).reshape(len(candidates), len(tested))


def forest_fits(sets: Sequence[Set], seed: int, n_estimators: int, max_depth: int, min_samples_leaf=1) -> list[np.ndarray]:
    """Forecasts for each set of a forest as in ``histogram_trees.forest``; its trees grow together."""
    trees = int(n_estimators)
    return [_forest(_Binned(*s, MAX_BINS), seed, trees, int(max_depth), min_samples_leaf) for s in sets]


def _forest(own: _Binned, seed: int, n_estimators: int, max_depth: int, min_samples_leaf) -> np.ndarray:
    draw = np.random.RandomState(seed)
    out = np.zeros(own.tested)
    for pack in _packs([own.size * own.width] * n_estimators):
        count = len(pack)
        weight = np.concatenate([np.bincount(draw.randint(0, own.size, own.size), minlength=own.size) for _ in pack])
        same = lambda value, kind=float: np.full(count, value, kind)
        grown = _grow(
            _Layout([own] * count), np.tile(own.target, count), weight, np.ones((count, own.width), bool), same(max_depth, int),
            same(max(min_samples_leaf, 1e-9)), same(0.0), same(0.0), same(LEAST_GAIN * own.scale**2),
        )
        owner = np.repeat(np.arange(count), own.tested)
        out += grown.predict(np.tile(own.test_codes, (count, 1)), owner).reshape(count, -1).sum(axis=0)
    return out / n_estimators / own.scale + own.mean


def _forests(sets: Sequence[Set], params: dict, seed: int) -> list[np.ndarray]:
    return forest_fits(sets, seed, **params)


def _boosted(sets: Sequence[Set], params: dict, seed: int) -> list[np.ndarray]:
    return boosted_fits(sets, [(s, params) for s in range(len(sets))], seed)


#: Learners by name: forecasts of many training sets from one set of parameters.
LEARNERS = {"boosted": _boosted, "forest": _forests}
