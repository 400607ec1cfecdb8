"""Regression trees on binned features, for one fit of a few thousand rows inside a task.

A tree grows level by level. At every level one pass counts rows and sums gradients per
(feature, node, bin); prefix sums over the bins give the gain of every cut at once.
"""

import numpy as np

#: Bins of a feature in forests, whose cuts are otherwise exact, and in boosted trees.
MAX_BINS, BOOSTED_BINS = 255, 64
#: A cut must gain more than this; cuts whose scores differ by less than this share of them are equally good,
#: and the first feature and bin is taken.
LEAST_GAIN, TIE = 1e-15, 1e-11


class Bins:
    """Cut points of each feature: between all distinct values, or at quantiles where there are more."""

    def __init__(self, x: np.ndarray, max_bins: int = MAX_BINS):
        self.edges = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > max_bins:
                values = np.unique(np.quantile(column, np.linspace(0, 1, max_bins), method="nearest"))
            self.edges.append((values[:-1] + values[1:]) / 2)
        self.width = max((len(e) for e in self.edges), default=0) + 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        """[feature, row] bin numbers; values at or below a cut are in the lower bin."""
        return np.array([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], np.int64)


class Tree:
    """Arrays over the nodes of a complete binary tree; ``feature`` is -1 at a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1)
        self.cut = np.zeros(size, np.int64)
        self.value = np.zeros(size)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        for _ in range(self.depth):
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            right = codes[feature, rows] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def grow(codes, width, target, weight, depth, features, min_weight, l1=0.0, l2=0.0) -> Tree:
    """Tree whose leaves hold the penalised mean of ``target`` under integer row weights.

    ``features`` are the columns it may cut; a cut leaves at least ``min_weight`` on both sides.
    """
    tree = Tree(depth)
    used = np.flatnonzero(weight)
    own = codes[np.ix_(features, used)]
    w, wt = weight[used].astype(float), weight[used] * target[used]
    least = max(min_weight, 1e-9)
    # only nodes that may still be cut are kept: their number in the whole tree, sums and rows
    number, at = np.array([0]), np.zeros(len(used), np.int64)
    sums, sizes = np.array([wt.sum()]), np.array([w.sum()])
    tree.value[0] = _shrunk(sums[0], l1) / (sizes[0] + l2)
    for _ in range(depth):
        nodes = len(number)
        place = ((np.arange(len(features))[:, None] * nodes + at) * width + own).ravel()
        shape, cells = (len(features), nodes, width), len(features) * nodes * width
        left_w = np.bincount(place, np.tile(w, len(features)), cells).reshape(shape).cumsum(axis=2)
        left_s = np.bincount(place, np.tile(wt, len(features)), cells).reshape(shape).cumsum(axis=2)
        right_w, right_s = sizes[:, None] - left_w, sums[:, None] - left_s
        fits = (left_w >= least) & (right_w >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = _shrunk(left_s, l1) ** 2 / (left_w + l2) + _shrunk(right_s, l1) ** 2 / (right_w + l2)
        flat = np.where(fits, score, -np.inf).transpose(1, 0, 2).reshape(nodes, -1)
        top = flat.max(axis=1)
        parent = _shrunk(sums, l1) ** 2 / (sizes + l2)
        best = (flat >= np.where(np.isfinite(top), top * (1 - TIE), np.inf)[:, None]).argmax(axis=1)
        cuts = np.flatnonzero(top - parent > LEAST_GAIN)
        if not len(cuts):
            break
        feature, cut = best // width, best % width
        tree.feature[number[cuts]] = features[feature[cuts]]
        tree.cut[number[cuts]] = cut[cuts]
        ls, lw = left_s[feature[cuts], cuts, cut[cuts]], left_w[feature[cuts], cuts, cut[cuts]]
        child = np.concatenate([2 * number[cuts] + 1, 2 * number[cuts] + 2])
        sums = np.concatenate([ls, sums[cuts] - ls])
        sizes = np.concatenate([lw, sizes[cuts] - lw])
        tree.value[child] = _shrunk(sums, l1) / (sizes + l2)
        # rows move to the children that are large enough to be cut again
        large = sizes >= 2 * least
        renumbered = np.where(large, np.cumsum(large) - 1, -1)
        index = np.full(nodes, -1)
        index[cuts] = np.arange(len(cuts))
        right = own[feature[at], np.arange(len(at))] > cut[at]
        at = np.where(index[at] >= 0, renumbered[index[at] + len(cuts) * right], -1)
        going = at >= 0
        if not going.any():
            break
        own, w, wt, at = own[:, going], w[going], wt[going], at[going]
        number, sums, sizes = child[large], sums[large], sizes[large]
    return tree


def boosted(x, y, tested, seed, n_estimators, max_depth, learning_rate, subsample=1.0, colsample_bytree=1.0,
            min_child_weight=1.0, reg_alpha=0.0, reg_lambda=1.0) -> np.ndarray:
    """Forecasts for ``tested`` of boosted trees for squared error: every tree is shrunk by the
    learning rate, from the training mean on; rows and columns are drawn anew for each tree."""
    draw = np.random.RandomState(seed)
    bins = Bins(x, BOOSTED_BINS)
    codes, test_codes = bins.codes(x), bins.codes(tested)
    n, width = x.shape
    base = y.mean()
    fitted, out = np.full(n, base), np.full(len(tested), base)
    n_rows, n_columns = max(1, int(round(subsample * n))), max(1, int(colsample_bytree * width))
    for _ in range(int(n_estimators)):
        weight = np.ones(n, np.int64)
        if n_rows < n:
            weight[:] = 0
            weight[draw.choice(n, n_rows, replace=False)] = 1
        columns = np.arange(width) if n_columns == width else np.sort(draw.choice(width, n_columns, replace=False))
        tree = grow(codes, bins.width, y - fitted, weight, int(max_depth), columns, min_child_weight, reg_alpha, reg_lambda)
        fitted += learning_rate * tree.predict(codes)
        out += learning_rate * tree.predict(test_codes)
    return out


def forest(x, y, tested, seed, n_estimators, max_depth, min_samples_leaf=1) -> np.ndarray:
    """Mean forecast of trees grown on bootstrap samples; every cut may use every feature."""
    draw = np.random.RandomState(seed)
    bins = Bins(x)
    codes, test_codes = bins.codes(x), bins.codes(tested)
    columns = np.arange(x.shape[1])
    out = np.zeros(len(tested))
    for _ in range(int(n_estimators)):
        weight = np.bincount(draw.randint(0, len(x), len(x)), minlength=len(x))
        tree = grow(codes, bins.width, y, weight, int(max_depth), columns, min_samples_leaf)
        out += tree.predict(test_codes)
    return out / n_estimators
