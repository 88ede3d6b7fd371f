"""Numbers of one model: basis pieces, a K x K solve, and distribution tails.

Everything here works on statistics that Spark has already aggregated: at most a few dozen
numbers per model.
"""

from __future__ import annotations

import math

import numpy as np

WIDTH = 4  # polynomial coefficients kept per interval


def degree_of(size: int) -> int:
    return min(3, size - 1)


def intervals_of(size: int) -> int:
    return size - degree_of(size)


def basis_pieces(breaks: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis as polynomials: [interval, local basis, power of u], u from 0 to 1."""
    knots = np.concatenate([[breaks[0]] * degree, breaks, [breaks[-1]] * degree])
    u = np.linspace(0.0, 1.0, degree + 1)
    to_powers = np.linalg.inv(np.vander(u, increasing=True))
    pieces = np.zeros((len(breaks) - 1, degree + 1, degree + 1))
    for m in range(len(breaks) - 1):
        x = breaks[m] + u * (breaks[m + 1] - breaks[m])
        span = m + degree
        values = [np.ones_like(x)]
        for d in range(1, degree + 1):
            nxt = [np.zeros_like(x) for _ in range(d + 1)]
            for j in range(d):
                left, right = knots[span - d + 1 + j], knots[span + 1 + j]
                part = values[j] / (right - left)
                nxt[j] = nxt[j] + (right - x) * part
                nxt[j + 1] = nxt[j + 1] + (x - left) * part
            values = nxt
        pieces[m] = np.array(values) @ to_powers.T
    return pieces


def gram(pieces: np.ndarray, moments: dict[int, np.ndarray], cross: dict[int, np.ndarray]):
    """Gram matrix and right-hand side from the moments of u in every interval."""
    n_int, width = pieces.shape[0], pieces.shape[1]
    size = n_int + width - 1
    g, b = np.zeros((size, size)), np.zeros(size)
    powers = np.add.outer(np.arange(width), np.arange(width))
    for m, s in moments.items():
        c = pieces[m]
        g[m:m + width, m:m + width] += c @ s[powers] @ c.T
        b[m:m + width] += c @ cross[m][:width]
    return g, b


def rebased(cuts: np.ndarray, breaks: np.ndarray, sums: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of powers of u between ``breaks``, from those between the finer ``cuts``.

    In the interval u is shift + scale * (u of the stretch), both from 0 to 1, so no digits are lost.
    """
    out: dict[int, np.ndarray] = {}
    for m, s in sums.items():
        j = min(max(int(np.searchsorted(breaks, cuts[m], "right")) - 1, 0), len(breaks) - 2)
        width = breaks[j + 1] - breaks[j]
        shift, scale = (cuts[m] - breaks[j]) / width, (cuts[m + 1] - cuts[m]) / width
        move = np.array([[math.comb(p, k) * shift ** (p - k) * scale ** k if k <= p else 0.0 for k in range(len(s))] for p in range(len(s))])
        out[j] = out.get(j, 0.0) + move @ s
    return out


def roughness(pieces: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Integral of products of second derivatives, on x scaled to unit range."""
    n_int, width = pieces.shape[0], pieces.shape[1]
    size = n_int + width - 1
    s = np.zeros((size, size))
    h = np.diff(breaks) / (breaks[-1] - breaks[0])
    p = np.arange(2, width)
    weight = np.outer(p * (p - 1), p * (p - 1)) / (np.add.outer(p, p) - 3.0)
    for m in range(n_int):
        c = pieces[m][:, 2:]
        s[m:m + width, m:m + width] += c @ weight @ c.T / h[m] ** 3
    return s


def penalised_fit(g, b, s, zz: float, n: float, target_edf: float | None):
    """Coefficients, edf, residual sum and lambda; lambda by GCV or to meet a target edf.

    After one decomposition every lambda costs a few sums.
    """
    g = g + np.eye(len(g)) * 1e-10 * max(np.trace(g) / len(g), 1e-300)
    root = np.linalg.cholesky(g)
    inner = np.linalg.solve(root, np.linalg.solve(root, s).T)
    d, vectors = np.linalg.eigh((inner + inner.T) / 2)
    d = np.clip(d, 0.0, None)
    c = vectors.T @ np.linalg.solve(root, b)
    shrink = lambda lam: 1.0 / (1.0 + lam * d)
    residual = lambda f: max(zz - float(np.sum(c * c * (2 * f - f * f))), 0.0)
    bent = d[d > 1e-9 * max(d.max(), 1e-300)]
    if len(bent) == 0:
        lam = 0.0
    else:
        grid = np.geomspace(1e-4 / bent.max(), 1e6 / bent.min(), 200)
        if target_edf is None:
            def gcv(lam):
                f = shrink(lam)
                return n * residual(f) / max(n - f.sum(), 1e-9) ** 2 if n > f.sum() else math.inf
            best = int(np.argmin([gcv(v) for v in grid]))
            fine = np.geomspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 21)
            lam = float(fine[int(np.argmin([gcv(v) for v in fine]))])
        else:
            low, high = math.log(grid[0]), math.log(grid[-1])
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if shrink(math.exp(mid)).sum() > target_edf else (low, mid)
            lam = math.exp((low + high) / 2)
    f = shrink(lam)
    beta = np.linalg.solve(root.T, vectors @ (f * c))
    return beta, float(f.sum()), residual(f), lam


def levelled(beta: np.ndarray, g, b, breaks: np.ndarray, degree: int) -> np.ndarray:
    """The fit moved by a straight line so that its residuals sum to zero, plain and times x.

    A penalty on curvature leaves straight lines free, so this only takes back rounding, which borders of very unequal
    distance make visible.
    """
    knots = (np.concatenate([[breaks[0]] * degree, breaks, [breaks[-1]] * degree]) - breaks[0]) / (breaks[-1] - breaks[0])
    line = np.array([knots[i + 1:i + 1 + degree].mean() for i in range(len(beta))])
    free = np.column_stack([np.ones(len(beta)), line])
    for _ in range(2):
        beta = beta + free @ np.linalg.lstsq(free.T @ g @ free, free.T @ (b - g @ beta), rcond=None)[0]
    return beta


def to_pieces(beta: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Polynomial coefficients of the fitted curve, four per interval."""
    width = pieces.shape[1]
    out = np.zeros((pieces.shape[0], WIDTH))
    for m in range(pieces.shape[0]):
        out[m, :width] = beta[m:m + width] @ pieces[m]
    return out.ravel()


def design(pieces: np.ndarray, interval: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Values of the basis at each place: rows, basis functions."""
    width = pieces.shape[1]
    values = np.einsum("iwp,ip->iw", pieces[interval], u[:, None] ** np.arange(width))
    out = np.zeros((len(u), pieces.shape[0] + width - 1))
    out[np.arange(len(u))[:, None], interval[:, None] + np.arange(width)] = values
    return out


def quantile_fit(b, y, weight, tau: float, penalty, pull, start, steps: int = 80):
    """Coefficients that minimise the weighted check loss of y - b beta, plus beta' penalty beta / 2, less pull' beta.

    Primal-dual interior points with predictor and corrector (Mehrotra): each residual is a positive part less a negative
    one, each row has a dual value between its two slopes. ``pull`` is the slope of rows whose side is known. Returns the
    coefficients, and whether the gap between primal and dual has closed.
    """
    m, size = b.shape
    scale = max(float(np.mean(np.abs(y - b @ start))), 1e-12 * max(float(np.abs(y).max()), 1e-300))
    unit = float(weight.mean())
    w, target = weight / unit, (y - b @ start) / scale
    penalty, pull = penalty * (scale / unit), (pull - penalty @ start) / unit
    beta, low = np.zeros(size), (1 - tau) * w
    z, s = low.copy(), tau * w
    u, v = np.maximum(target, 0) + 1.0, np.maximum(-target, 0) + 1.0

    def longest(*pairs) -> float:
        return min([1.0, *(float((-0.9995 * x[d < 0] / d[d < 0]).min()) for x, d in pairs if (d < 0).any())])

    settled = None
    for _ in range(steps):
        residual = target - b @ beta
        slope = b.T @ (z - low) + pull - penalty @ beta
        gap = float(v @ z + u @ s)
        loss = float(np.sum(w * residual * (tau - (residual < 0))))
        # What rounding leaves of the slope, which a stiff penalty makes large.
        noise = 1e-12 * float((np.abs(penalty) @ (np.abs(beta) + np.abs(start) / scale)).max())
        if gap <= 1e-11 * (1e-3 * m + loss) and np.abs(slope).max() <= 1e-8 * m + noise:
            return start + scale * beta, True
        if gap <= 1e-7 * loss and np.abs(slope).max() <= 1e-6 * m + noise:
            settled = beta  # near enough if rounding stops it here
        d = 1.0 / (u / s + v / z)
        h = b.T @ (b * d[:, None]) + penalty
        h += np.eye(size) * 1e-13 * max(np.trace(h) / size, 1e-300)

        def towards(up, down):
            xi = residual + down / z - up / s
            step = np.linalg.solve(h, b.T @ (d * xi) + slope)
            dz = d * (xi - b @ step)
            return step, dz, down / z - v - v / z * dz, up / s - u + u / s * dz

        try:
            step, dz, dv, du = towards(0.0, 0.0)
            reach = longest((z, dz), (s, -dz), (v, dv), (u, du))
            left = float((v + reach * dv) @ (z + reach * dz) + (u + reach * du) @ (s - reach * dz))
            center = gap / (2 * m) * (left / gap) ** 3
            step, dz, dv, du = towards(center + dz * du, center - dz * dv)
        except np.linalg.LinAlgError:
            break
        reach = longest((z, dz), (s, -dz), (v, dv), (u, du))
        beta, z, s, v, u = beta + reach * step, z + reach * dz, s - reach * dz, v + reach * dv, u + reach * du
        if not np.isfinite(beta).all():
            break
    return (start, False) if settled is None else (start + scale * settled, True)


def rank_score(g, ones, scores, total: float, n: float, tau: float) -> tuple[float, int]:
    """Rank-score statistic of a constant against a curve, and its degrees of freedom.

    ``g``: Gram matrix of the basis, ``ones`` its sums, ``scores`` its sums times tau less one below the constant.
    """
    inner = g - np.outer(ones, ones) / n
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    held = values > 1e-9 * max(float(values.max()), 1e-300)
    along = vectors[:, held].T @ (scores - ones * total / n)
    return float(np.sum(along**2 / values[held]) / (tau * (1 - tau))), int(held.sum())


def chi_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with a whole number of degrees of freedom."""
    if not (x >= 0 and df > 0):
        return math.nan
    half = x / 2
    at, tail = (0.5, math.erfc(math.sqrt(half))) if df % 2 else (1.0, math.exp(-half))
    while at < df / 2 - 0.25:
        if half > 0:
            tail += math.exp(at * math.log(half) - half - math.lgamma(at + 1))
        at += 1
    return min(tail, 1.0)


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-12:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if not (f > 0 and df1 > 0 and df2 > 0):
        return math.nan
    return beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))
