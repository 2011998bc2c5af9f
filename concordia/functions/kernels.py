"""Batched NumPy kernels: every function works on many users of one shape at once.

Arrays have a leading user axis.  ``cost[u, i, j]`` is what bundle j costs at the prices
of observation i; ``own[u, i]`` is its diagonal.
"""

from __future__ import annotations

import numpy as np

TOL = 1e-10
#: Rows of relations below which calls cost more than their work.
FEW_ROWS = 4096


def costs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of all bundles at all prices, and own spending; p and q are users x times x goods."""
    cost = np.matmul(p, q.transpose(0, 2, 1))
    return cost, np.einsum("uii->ui", cost).copy()


def relations(cost: np.ndarray, own: np.ndarray, level: np.ndarray | float = 1.0, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
    """Weak and strict direct revealed preference at an efficiency level (a number, or one for each user)."""
    budget = (np.asarray(level, dtype=float).reshape(-1, 1) * own)[:, :, None]
    weak, strict = budget >= cost - tol, budget > cost + tol
    n = np.arange(cost.shape[1])
    strict[:, n, n] = False
    weak[:, n, n] = True
    return weak, strict


def closure(relation: np.ndarray) -> np.ndarray:
    """Reflexive transitive closure: by pivots on rows packed to words of 64 bits, or by squaring for few users of many nodes."""
    users, n = relation.shape[:2]
    out = relation.copy()
    diagonal = np.arange(n)
    out[:, diagonal, diagonal] = True
    if 24 < n <= 512 and users * n < FEW_ROWS:
        reached = int(out.sum())
        while True:
            step = out.astype(np.float32)
            out = np.matmul(step, step) > 0
            if (now := int(out.sum())) == reached:
                return out
            reached = now
    packed = np.zeros((users, n, -(-n // 64) * 8), dtype=np.uint8)
    packed[:, :, : -(-n // 8)] = np.packbits(out, axis=2, bitorder="little")
    rows = packed.view("<u8")
    for k in range(n):
        # all ones for the rows that reach k
        mask = np.uint64(0) - ((rows[:, :, k >> 6] >> np.uint64(k & 63)) & np.uint64(1))
        rows |= mask[:, :, None] & rows[:, None, k, :]
    return np.unpackbits(packed, axis=2, count=n, bitorder="little").view(bool)


def components(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (least member) of strongly connected components, their number and the largest size."""
    mutual = reach & reach.transpose(0, 2, 1)
    labels = mutual.argmax(axis=2)
    number = (labels == np.arange(reach.shape[1])).sum(axis=1)
    return labels, number, mutual.sum(axis=2).max(axis=1)


def violations(reach: np.ndarray, strict: np.ndarray) -> np.ndarray:
    """Pairs that are weakly preferred through others one way and strictly the other way."""
    return (reach & strict.transpose(0, 2, 1)).sum(axis=(1, 2))


def ccei(cost: np.ndarray, own: np.ndarray, consistent: np.ndarray, tol: float = TOL) -> np.ndarray:
    """The largest ratio of a cost to own spending at which the user is consistent; 1 if consistent, 0 if none is.

    Each user has its own candidates; all users take a step of the bisection together.
    """
    users = np.flatnonzero(~consistent)
    out = np.ones(len(cost))
    if not len(users):
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (cost[users] / own[users][:, :, None]).reshape(len(users), -1)
    ratio = np.where((ratio > 0) & (ratio < 1), ratio, 0.0)
    ratio.sort(axis=1)
    # the candidates stand at the end, ascending; position first-1 stands for none
    low = (ratio <= 0).sum(axis=1) - 1
    high = np.full(len(users), ratio.shape[1] - 1)
    row = np.arange(len(users))
    while (open_ := low < high).any():
        at = (low + high + 1) // 2
        level = ratio[row, np.minimum(at, ratio.shape[1] - 1)]
        todo = np.flatnonzero(open_)
        weak, strict = relations(cost[users[todo]], own[users[todo]], level[todo], tol)
        fine = violations(closure(weak), strict) == 0
        low[todo] = np.where(fine, at[todo], low[todo])
        high[todo] = np.where(fine, high[todo], at[todo] - 1)
    valid = low >= (ratio <= 0).sum(axis=1)
    out[users] = np.where(valid, ratio[row, np.maximum(low, 0)], 0.0)
    return out


def mpi(cost: np.ndarray, own: np.ndarray, weak: np.ndarray, consistent: np.ndarray) -> np.ndarray:
    """The largest mean of savings ratios over cycles of weak preference, by Karp's theorem; 0 if consistent."""
    users = np.flatnonzero(~consistent)
    out = np.zeros(len(cost))
    if not len(users):
        return out
    cost, own, weak = cost[users], own[users], weak[users].copy()
    n = cost.shape[1]
    weak[:, np.arange(n), np.arange(n)] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(weak & (own[:, :, None] > 0), (own[:, :, None] - cost) / own[:, :, None], -np.inf)
    # best[k][v]: the largest weight of a walk of k steps that ends at v, from anywhere
    best = [np.zeros((len(users), n))]
    for _ in range(n):
        best.append((best[-1][:, :, None] + weight).max(axis=1))
    last = best[-1]
    with np.errstate(invalid="ignore"):
        means = np.stack([(last - best[k]) / (n - k) for k in range(n)])
    means = np.where(np.isnan(means), np.inf, means)
    found = np.where(np.isfinite(last), means.min(axis=0), -np.inf).max(axis=1)
    out[users] = np.maximum(0.0, found)
    return out


def harp(cost: np.ndarray, own: np.ndarray, weak: np.ndarray, tol: float = TOL) -> np.ndarray:
    """Whether no cycle of weak preference multiplies spending ratios above one."""
    n = cost.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(weak & (own[:, :, None] > tol) & (cost > tol), np.log(own)[:, :, None] - np.log(cost), -np.inf)
    diagonal = np.arange(n)
    gain[:, diagonal, diagonal] = 0.0
    for k in range(n):
        np.maximum(gain, gain[:, :, k, None] + gain[:, None, k, :], out=gain)
    return (gain[:, diagonal, diagonal] <= tol).all(axis=1)


def varian_levels(cost: np.ndarray, own: np.ndarray, consistent: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """For each observation the largest share of its budget that a revealed worse bundle costs; 1 if consistent."""
    n = cost.shape[1]
    weak, _ = relations(cost, own, tol=tol)
    weak[:, np.arange(n), np.arange(n)] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(weak, cost / own[:, :, None], 0.0)
    return np.where(consistent[:, None], 1.0, np.clip(np.nan_to_num(share).max(axis=2), 0.0, 1.0))


def spread(levels: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, minimum, population deviation and linear quartiles of each row."""
    low, high = np.percentile(levels, [25, 75], axis=1)
    return {"mean": levels.mean(axis=1), "min": levels.min(axis=1), "std": levels.std(axis=1), "q25": low, "q75": high}


def gini(degree: np.ndarray) -> np.ndarray:
    """Gini coefficient of each row, 0 if it sums to nothing."""
    n = degree.shape[1]
    ordered = np.sort(degree, axis=1).astype(float)
    total = ordered.sum(axis=1)
    weighted = (ordered * np.arange(1, n + 1)).sum(axis=1)
    return np.where(total > 0, (2 * weighted - (n + 1) * total) / (n * np.maximum(total, 1e-300)), 0.0)


def degrees(weak: np.ndarray) -> dict[str, np.ndarray]:
    """Density, deviation of out-degrees and Gini of degrees of the direct relation without its diagonal."""
    n = weak.shape[1]
    edges = weak.copy()
    edges[:, np.arange(n), np.arange(n)] = False
    out, into = edges.sum(axis=2), edges.sum(axis=1)
    return {"r_density": out.sum(axis=1) / max(1, n * (n - 1)), "r_out_degree_std": out.std(axis=1), "degree_gini": gini(out + into)}


def weights(cost: np.ndarray, own: np.ndarray, weak: np.ndarray, tol: float = TOL) -> dict[str, np.ndarray]:
    """Mean, population deviation and skewness of log spending ratios over the direct relation."""
    n = cost.shape[1]
    use = weak & (own[:, :, None] > tol) & (cost > tol)
    use[:, np.arange(n), np.arange(n)] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(use, np.log(own)[:, :, None] - np.log(cost), 0.0)
    count = np.maximum(1, use.sum(axis=(1, 2)))
    mean = value.sum(axis=(1, 2)) / count
    off = np.where(use, value - mean[:, None, None], 0.0)
    std = np.sqrt((off**2).sum(axis=(1, 2)) / count)
    skew = np.where(std > 1e-12, (off**3).sum(axis=(1, 2)) / count / np.where(std > 1e-12, std, 1.0) ** 3, 0.0)
    return {"ew_mean": mean, "ew_std": std, "ew_skew": skew}


def menu_relation(rows: list[tuple[list[list[int]], list[int]]], n_items: int) -> np.ndarray:
    """Which items were chosen while others were there; rows are (menus, choices) of users with items below n_items."""
    out = np.zeros((len(rows), n_items, n_items), dtype=bool)
    for user, (menus, choices) in enumerate(rows):
        for menu, choice in zip(menus, choices, strict=True):
            out[user, choice, menu] = True
    out[:, np.arange(n_items), np.arange(n_items)] = False
    return out


def limited_attention(direct: np.ndarray) -> np.ndarray:
    """Whether every direct reversal of a pair has a third item above both."""
    reversed_ = direct & direct.transpose(0, 2, 1)
    above = np.matmul(direct.transpose(0, 2, 1).astype(np.float32), direct.astype(np.float32)) > 0
    return ~(reversed_ & ~above).any(axis=(1, 2))
