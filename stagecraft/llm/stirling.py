"""Tables of dishes with any number of customers, drawn from their exact conditional.

The ways to seat c customers at t tables, S(c, t), are c! / (t! d^t) times the coefficient of x^c in
(1 - (1 - x)^d)^t. It is read off by Cauchy's integral over x = e^-p: along a parabola through the
saddle point that opens to the cut, or around the circle where nearly every customer has a table
alone. Its cost does not depend on c; its error is near that of rounding.

Between a few tables the logarithm is smooth, so a dish is computed at Chebyshev points of its
likely range and read from their polynomial at each number of tables. The range grows until what
lies outside weighs less than e^-``TAIL``.
"""

from __future__ import annotations

import numpy as np

NODES, POINTS, CELLS, ROWS, TAIL = 32, 24, 1 << 16, 2048, 36.0
#: Beyond it e^-p is too small to tell a dish from one whose customers all sit alone.
_FAR = 30.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x, by Stirling's series eight higher."""
    z = x + 8.0
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / z**2) / z**2) / z**2) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - steps


def _log1p(z: np.ndarray) -> np.ndarray:
    """numpy's own loses small complex numbers."""
    w = 1 + z
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 1, z, np.log(w) * z / (w - 1))


def _log_f(p: np.ndarray, discount: float, near: bool) -> np.ndarray:
    """log(1 - (1 - e^-p)^d); ``near`` for p around 0, where the power is small."""
    if near:
        return _log1p(-np.exp(discount * np.log(-np.expm1(-p))))
    return np.log(-np.expm1(discount * _log1p(-np.exp(-p))))


def _tilted(p: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log f, the mean customers of a table at this p, and the slope of its logarithm."""
    small, large = np.minimum(p, 1.0), np.maximum(p, 1.0)
    log_f = np.where(p < 1, _log_f(small, discount, True), _log_f(large, discount, False))
    rest = np.where(p < 1, np.log(-np.expm1(-small)), np.log1p(-np.exp(-large)))
    mean = np.exp(np.log(discount) - p + (discount - 1) * rest - log_f)
    return log_f, mean, mean - 1 - (1 - discount) / np.expm1(p)


def _saddle(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Where tables of that mean hold all customers, but not so near 0 that the cut is touched."""
    least, most, want = np.log(5 / count), np.full(len(count), np.log(_FAR)), np.log(count / tables)
    low, high = least, most
    for _ in range(12):
        u = (low + high) / 2
        above = np.log(_tilted(np.exp(u), discount)[1]) > want
        low, high = np.where(above, u, low), np.where(above, high, u)
    for _ in range(3):
        p = np.exp(u)
        _, mean, slope = _tilted(p, discount)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = (np.log(mean) - want) / (p * slope)
        u = np.clip(u - np.where(np.isfinite(step), step, 0), least, most)
    return np.exp(u)


def log_coefficient(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Logs of the coefficients of x^count in (1 - (1 - x)^d)^tables, of lists as long; tables
    need not be whole numbers unless fewer than 32 below count."""
    out = np.empty(len(count))
    for at in range(0, len(out), ROWS):
        some = slice(at, at + ROWS)
        out[some] = _coefficient(count[some].astype(float), tables[some].astype(float), discount)
    return out


def _coefficient(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    p = _saddle(count, tables, discount)
    log_f, mean, slope = _tilted(p, discount)
    spread = np.maximum(-tables * mean * slope, 0)
    circle = (spread < 10) & (p > 1)
    # The constant 1 adds nothing to the integral, but would drown the rest.
    light = -tables * log_f < 0.5
    drop = np.where(light, count * p, np.where(
        count * p < 5.001, 2 * (1 - discount) * count * p, 2 * spread * p * p))
    reach = np.sqrt(40 / np.maximum(drop, 1e-300))
    steps = np.arange(NODES + 1)
    y = 1 + 1j * reach[:, None] * steps / NODES
    z = np.where(circle[:, None], p[:, None] + 1j * np.pi * steps / NODES, p[:, None] * y * y)
    weight = np.where(circle[:, None], 1 / NODES, (2 * reach * p / np.pi / NODES)[:, None] * y)
    weight[:, 0] /= 2
    weight[circle, -1] /= 2
    grown, near = np.empty(z.shape, complex), p < 1
    grown[near], grown[~near] = _log_f(z[near], discount, True), _log_f(z[~near], discount, False)
    grown *= tables[:, None]
    shift = count[:, None] * (z - p[:, None])
    heavy, total = ~light, np.empty(len(p))
    total[light] = (weight[light] * np.exp(shift[light]) * np.expm1(grown[light])).real.sum(axis=1)
    total[heavy] = (weight[heavy] * np.exp(shift[heavy] + grown[heavy] - (tables * log_f)[heavy, None])
                    ).real.sum(axis=1)
    return np.log(total) + count * p + np.where(light, 0, tables * log_f)


def log_stirling_at(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers of lists as long, however large."""
    return (log_coefficient(count, tables, discount) + log_gamma(count + 1.0)
            - log_gamma(tables + 1.0) - tables * np.log(discount))


def _likely(count, fee, parent, discount) -> tuple[np.ndarray, np.ndarray]:
    """About the most likely number of tables, and half the width of their range."""
    # From where half a table would hold them all.
    low, high = np.log(discount / 2 / count) / (1 - discount), np.full(len(count), np.log(_FAR))
    for _ in range(60):
        u = (low + high) / 2
        log_f, mean, _ = _tilted(np.exp(u), discount)
        more = log_f + np.log(parent * (fee + count / mean) / (count / mean + 1)) > 0
        low, high = np.where(more, u, low), np.where(more, high, u)
    _, mean, slope = _tilted(np.exp(u), discount)
    tables = np.clip(count / mean, 1, count)
    bend = mean * mean / np.maximum(-slope * count, 1e-300) - 1 / (fee + tables) + 1 / (tables + 1)
    return tables, np.minimum(9 / np.sqrt(np.maximum(bend, 1 / count / count)) + POINTS, count)


def _smooth(count: int, low: int, high: int) -> np.ndarray:
    """Tables at which a dish is computed: Chebyshev points of their logarithm, each number of
    tables if few or if nearly all customers sit alone."""
    points = POINTS + 12 * int(np.log(high / low))
    if high - low < points or (high > count - 32 and high - low < ROWS):
        return np.arange(low, high + 1.0)
    high = min(high, count - 32)
    angle = np.cos(np.pi * (np.arange(points) + 0.5) / points)
    return np.exp((np.log(high / low) * angle + np.log(high * low)) / 2)


def _between(points: np.ndarray, values: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The polynomial in the logarithm through Chebyshev points, divided by what is not smooth at 0."""
    n, ends = len(points), np.log(points[[0, -1]])
    edge = np.cos(np.pi * 0.5 / n)
    middle, half = ends.mean(), (ends[0] - ends[1]) / 2 / edge
    order = np.arange(n)
    waves = np.cos(np.pi * np.outer(order, order + 0.5) / n) @ (values - np.log(points)) * 2 / n
    waves[0] /= 2
    return np.polynomial.chebyshev.chebval((np.log(tables) - middle) / half, waves) + np.log(tables)


def draw_many_tables(rng, count, others, parent, strength, discount) -> np.ndarray:
    """Tables of dishes with any number of customers above 100, given the other tables of their
    restaurants and the parent's probabilities: p(t) ~ S(c, t) parent^t prod (strength + discount T).
    A range of more than ``CELLS`` numbers is drawn by as many cells, even inside."""
    out, u, inside = np.ones(len(count), np.int64), rng.random(len(count)), rng.random(len(count))
    fee = (strength + discount * others) / discount
    middle, half = _likely(count, fee, parent, discount)
    left = np.arange(len(count))
    while len(left):
        low = np.maximum(np.floor(middle - half), 1)[left].astype(np.int64)
        high = np.minimum(np.ceil(middle + half), count)[left].astype(np.int64)
        points = [_smooth(*x) for x in zip(count[left].tolist(), low.tolist(), high.tolist())]
        values = log_coefficient(np.repeat(count[left], [len(x) for x in points]), np.concatenate(points), discount)
        wider = []
        for i, a, b, at, known in zip(left, low, high, points, np.split(
                values, np.cumsum([len(x) for x in points])[:-1])):
            cells = min(b - a + 1, CELLS)
            starts = a + np.arange(cells + 1) * (b + 1 - a) // cells
            tables = (starts[:-1] + starts[1:] - 1) / 2
            ways = known if len(at) == cells else _between(at, known, tables)
            score = (ways + tables * np.log(parent[i]) + log_gamma(fee[i] + tables)
                     - log_gamma(tables + 1) + np.log(np.diff(starts)))
            least = score.max() - TAIL
            if (a > 1 and score[0] > least) or (b < count[i] and score[-1] > least):
                wider.append(i)
                continue
            weight = np.cumsum(np.exp(score - score.max()))
            cell = min(int(np.searchsorted(weight, u[i] * weight[-1], "right")), cells - 1)
            out[i] = starts[cell] + int(inside[i] * (starts[cell + 1] - starts[cell]))
        left = np.array(wider, np.int64)
        half[left] *= 2
    return out
