"""Kernels of demand systems and spatial choice for one user."""

from __future__ import annotations

import numpy as np

from concordia.functions import kernels
from concordia.functions.single import ideal_point, regress, slutsky, slutsky_tests


def condensed(relation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels 0, 1, … and which components reach which directly."""
    labels = kernels.components(kernels.closure(relation[None]))[0][0]
    names, labels = np.unique(labels, return_inverse=True)
    dag = np.zeros((len(names), len(names)), dtype=bool)
    a, b = np.nonzero(relation)
    dag[labels[a], labels[b]] = True
    np.fill_diagonal(dag, False)
    return labels, dag


def quasilinear(p: np.ndarray, q: np.ndarray, tol: float = 1e-10) -> bool:
    """Whether no cycle of any length saves money by swapping bundles: no negative cycle of cost differences."""
    cost, own = kernels.costs(p[None], q[None])
    gap = cost[0] - own[0][:, None]
    for k in range(len(gap)):
        gap = np.minimum(gap, gap[:, k, None] + gap[None, k, :])
    return bool((np.diag(gap) >= -tol * max(1.0, own.max())).all())


def stone_geary(p: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
    """Linear expenditure system: subsistence bundle (nine tenths of the least), shares of the rest, substitution effects at means."""
    least = 0.9 * q.min(axis=0)
    rest = np.maximum(((q - least) * p).sum(axis=1), 1e-12)
    share = (((q - least) * p) / rest[:, None]).mean(axis=0)
    share /= share.sum()
    mean_p, above = p.mean(axis=0), float(np.maximum(((q - least) * p).sum(axis=1).mean(), 1e-12))
    s = above * (np.outer(share, share) - np.diag(share)) / np.outer(mean_p, mean_p)
    return {"subsistence": least, "share": share, "slutsky": s}


def two_stage(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Elasticities by good and price with the prices of the observation before as instruments; none for under four observations."""
    goods = p.shape[1]
    if len(p) < 4:
        return np.full((goods, goods), np.nan)
    lag, now = np.log(p[:-1]), np.log(p[1:])
    design = np.column_stack([np.ones(len(lag)), lag])
    fitted = design @ np.linalg.lstsq(design, now, rcond=None)[0]
    beta, _ = regress(np.log(np.maximum(q[1:], 1e-10)), fitted)
    return beta.T


def slutsky_bootstrap(p: np.ndarray, q: np.ndarray, n: int, chance: np.random.Generator) -> dict[str, float]:
    """The largest eigenvalue of the symmetric substitution matrix, with its bootstrap deviation and centred p-value against at most zero."""
    own = slutsky_tests(slutsky(p, q))["max_eigenvalue"]
    drawn = []
    for _ in range(n):
        at = chance.integers(0, len(p), len(p))
        drawn.append(slutsky_tests(slutsky(p[at], q[at]))["max_eigenvalue"])
    drawn = np.array(drawn)
    return {"max_eigenvalue": own, "std": float(drawn.std()), "p_value": float((drawn - drawn.mean() >= own).mean())}


def additive_groups(elasticities: np.ndarray, threshold: float = 0.1) -> list[list[int]]:
    """Goods that cross effects above the threshold connect."""
    like = (np.abs(elasticities) > threshold) | (np.abs(elasticities.T) > threshold)
    labels = kernels.components(kernels.closure(like[None]))[0][0]
    return [np.flatnonzero(labels == k).tolist() for k in np.unique(labels)]


def distances(items: np.ndarray, point: np.ndarray, norm: float) -> np.ndarray:
    return np.linalg.norm(items - point, ord=norm, axis=1)


def metric_violations(items: np.ndarray, menus: list[list[int]], choices: list[int], norm: float) -> tuple[np.ndarray, int]:
    """An ideal point under a norm (1, 2, inf or any p above 1) by coordinate steps from the Euclidean one, and the choices it fails."""
    point, _ = ideal_point(items, menus, choices)

    def fails(x: np.ndarray) -> tuple[int, float]:
        d = distances(items, x, norm)
        over = [d[c] - min(d[i] for i in m if i != c) for m, c in zip(menus, choices, strict=True) if len(set(m)) > 1]
        return sum(o > 1e-9 for o in over), float(sum(max(0.0, o) for o in over))

    best = fails(point)
    step = float(items.std() + 1e-9)
    while step > 1e-3 * float(items.std() + 1e-9) and best[0]:
        moved = False
        for k in range(items.shape[1]):
            for sign in (step, -step):
                other = point.copy()
                other[k] += sign
                if (now := fails(other)) < best:
                    point, best, moved = other, now, True
        if not moved:
            step /= 2
    return point, best[0]


def strengths(items: np.ndarray, menus: list[list[int]], choices: list[int], point: np.ndarray) -> list[float]:
    """For each choice how much nearer it is than the nearest other item, over its own distance."""
    d = distances(items, point, 2)
    return [float((min((d[i] for i in m if i != c), default=d[c]) - d[c]) / max(d[c], 1e-12)) for m, c in zip(menus, choices, strict=True)]


def several_points(items: np.ndarray, menus: list[list[int]], choices: list[int], n: int = 2) -> tuple[list[np.ndarray], int]:
    """Ideal points one after the other for the choices that those before fail; the choices that all fail."""
    points, left = [], list(range(len(choices)))
    while left and len(points) < n:
        point, _ = ideal_point(items, [menus[k] for k in left], [choices[k] for k in left])
        points.append(point)
        d = distances(items, point, 2)
        left = [k for k in left if any(d[i] < d[choices[k]] - 1e-9 for i in menus[k] if i != choices[k])]
    return points, len(left)


def independence_violations(choices: list[tuple[np.ndarray, np.ndarray, int]], tol: float = 1e-8) -> int:
    """Pairs of choices between two lotteries that mix a common part in, one of which is turned around by the mixing."""
    n = 0
    pairs = [(o[c], o[1 - c], p) for o, p, c in choices if len(o) == 2]
    for a in range(len(pairs)):
        for b in range(len(pairs)):
            if a == b or len(pairs[a][2]) != len(pairs[b][2]):
                continue
            # b chose the other way round between w a + (1 - w) z and w a' + (1 - w) z
            d, e = pairs[a][0] - pairs[a][1], pairs[b][1] - pairs[b][0]
            size = float(d @ d)
            w = float(d @ e) / size if size > tol else 0.0
            n += 0 < w <= 1 + tol and np.abs(e - w * d).max() <= tol * max(1.0, np.abs(d).max())
    return n


def rank_dependent(choices: list[tuple[np.ndarray, np.ndarray, int]], tol: float = 1e-8) -> dict[str, object]:
    """Whether no choice is dominated state by state, and how probability weights seem to bend from the spread of what is chosen."""
    bad = sum(any((x >= o[c] - tol).all() and (x > o[c] + tol).any() for k, x in enumerate(o) if k != c) for o, _, c in choices)
    spread = lambda x, p: float(p @ (x - p @ x) ** 2)
    own = [spread(o[c], p) for o, p, c in choices]
    other = [np.mean([spread(x, p) for k, x in enumerate(o) if k != c]) for o, p, c in choices if len(o) > 1]
    ratio = (np.mean(own) / max(np.mean(other), 1e-12)) if other else 1.0
    return {"is_consistent": bad == 0, "n_dominated": int(bad), "weighting": "optimistic" if ratio > 1.2 else "pessimistic" if ratio < 0.8 else "linear"}
