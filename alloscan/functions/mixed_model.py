"""Variance-component helpers for one bounded panel (n x n NumPy; the fan-out is Spark's)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from alloscan.functions import special as sp


@dataclass
class Fit:
    sigma2: dict
    pve: dict
    component_var: dict
    beta: np.ndarray
    loglik: float
    boundary: list
    converged: bool = True
    drop_reason: str = "kept"
    extra: dict = field(default_factory=dict)


def pull_psd(k: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    k = (k + k.T) / 2
    w, q = np.linalg.eigh(k)
    if w[0] < -tol * max(1.0, abs(w[-1])):
        raise ValueError("kernel is not positive semi-definite")
    return k if w[0] >= 0 else (q * np.clip(w, 0, None)) @ q.T


def _reml_state(theta, mats, y, x):
    """log-likelihood, P and Py of V = sum theta_k M_k (last M is the identity)."""
    v = sum(t * m for t, m in zip(theta, mats))
    n, p = x.shape
    chol = np.linalg.cholesky(v)
    li = np.linalg.solve(chol, np.eye(n))
    vi = li.T @ li
    vx = vi @ x
    c = x.T @ vx
    proj = vi - vx @ np.linalg.solve(c, vx.T)
    py = proj @ y
    ll = -0.5 * ((n - p) * np.log(2 * np.pi) + 2 * np.log(np.diag(chol)).sum()
                 + np.linalg.slogdet(c)[1] + y @ py)
    return ll, proj, py, np.linalg.solve(c, vx.T @ y)


FLAT = 1e-4  # slope of the log-likelihood in log theta below which a fit has converged


def fit_reml(y, x, kernels: dict, n_starts: int = 1, seed: int | None = None, max_iter: int = 200) -> Fit:
    """Multi-kernel REML by projected average-information steps from several starts.

    Components are bounded at 0, the residual at 1e-8 of the trait variance; the best
    log-likelihood over the starts wins. PVE weighs a component by its mean diagonal.
    """
    y, x = np.asarray(y, float), np.asarray(x, float)
    n = len(y)
    names = list(kernels)
    mats = [pull_psd(np.asarray(kernels[k], float)) for k in names] + [np.eye(n)]
    var = float(np.var(y, ddof=1)) or 1.0
    floor = np.array([0.0] * len(names) + [1e-8 * var])
    rng = np.random.default_rng(seed)
    starts = [np.array([0.3 * var / max(len(names), 1)] * len(names) + [0.7 * var])]
    starts += [np.exp(rng.uniform(np.log(1e-3), np.log(10), len(mats))) * var for _ in range(n_starts - 1)]

    def slope(th, st):
        """Gradient, the components that may move, and the largest change of the likelihood per unit of log theta."""
        _, proj, py, _ = st
        grad = np.array([-0.5 * (np.sum(proj * m) - py @ m @ py) for m in mats])
        free = (th > floor) | (grad > 0)
        return grad, free, float(np.max(np.abs(np.where(free, grad, 0)) * np.maximum(th, 1e-6 * var)))

    best = None
    for th in starts:
        th = np.maximum(th, floor)
        st = _reml_state(th, mats, y, x)
        for _ in range(max_iter):
            ll, proj, py, _ = st
            grad, free, steep = slope(th, st)
            mp = np.stack([m @ py for m in mats], 1)
            ai = 0.5 * mp.T @ proj @ mp
            if steep < 1e-7:
                break
            step = np.zeros_like(th)
            a = ai[np.ix_(free, free)]
            step[free] = np.linalg.lstsq(a + 1e-10 * np.trace(a) / len(a) * np.eye(len(a)), grad[free], rcond=None)[0]
            em = np.where(free, 2 * th * th * grad / n, 0.0)
            for direction in (step, em):
                t, moved = 1.0, False
                while t > 1e-8:
                    new = np.maximum(th + t * direction, floor)
                    try:
                        cand = _reml_state(new, mats, y, x)
                    except np.linalg.LinAlgError:
                        cand = None
                    if cand is not None and cand[0] > ll + 1e-12:
                        moved = True
                        break
                    t /= 2
                if moved:
                    break
            if not moved:
                break
            th, st = new, cand
        if best is None or st[0] > best[1][0]:
            best = (th, st)
    th, st = best
    # a line search that finds nothing better is no proof; a flat likelihood is
    done = slope(th, st)[2] < FLAT
    diag = np.array([np.trace(m) / n for m in mats])
    cv = th * diag
    tags = [*names, "e"]
    pve = cv / cv.sum()
    return Fit(dict(zip(tags, th)), dict(zip(tags, pve)), dict(zip(tags, cv)), st[3], float(st[0]),
               [k for k, f in zip(names, pve) if f < 1e-3], done)


def fit_single(y, x, k, bounds=(-10.0, 10.0)) -> dict:
    """One-kernel REML profiled in log delta = log(sigma2_e / sigma2_g), golden section."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    n, p = x.shape
    w, q = np.linalg.eigh((k + k.T) / 2)
    if w[0] < -1e-8:
        raise ValueError("kernel is not positive semi-definite")
    w, yt, xt = np.clip(w, 0, None), q.T @ y, q.T @ x

    def ll(logd):
        h = w + np.exp(logd)
        xh = xt / h[:, None]
        c = xt.T @ xh
        b = np.linalg.solve(c, xh.T @ yt)
        s = float(((yt - xt @ b) ** 2 / h).sum()) / (n - p)
        return -0.5 * ((n - p) * (np.log(2 * np.pi * s) + 1) + np.log(h).sum() + np.linalg.slogdet(c)[1]), s, b

    grid = np.linspace(*bounds, 41)
    i = int(np.argmax([ll(g)[0] for g in grid]))
    lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
    r = (5 ** 0.5 - 1) / 2
    while hi - lo > 1e-6:
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if ll(a)[0] > ll(b)[0] else (a, hi)
    d = (lo + hi) / 2
    val, s, beta = ll(d)
    return {"sigma2_g": s, "sigma2_e": s * np.exp(d), "h2": 1 / (1 + np.exp(d)), "loglik": float(val),
            "log_delta": d, "at_boundary": bool(min(d - bounds[0], bounds[1] - d) < 1e-3), "beta": beta}


def null_context(y, x, kernels: dict, sigma2: dict):
    """P and Py of the fixed null model; a jitter ladder guards the factorisation."""
    n = len(y)
    v = sigma2["e"] * np.eye(n) + sum(sigma2[k] * np.asarray(m) for k, m in kernels.items())
    for jit in (0.0, 1e-10, 1e-8, 1e-6):
        try:
            np.linalg.cholesky(v + jit * np.mean(np.diag(v)) * np.eye(n))
            v = v + jit * np.mean(np.diag(v)) * np.eye(n)
            break
        except np.linalg.LinAlgError:
            continue
    else:
        raise np.linalg.LinAlgError("covariance cannot be factorised")
    vi = np.linalg.inv(v)
    vx = vi @ x
    proj = vi - vx @ np.linalg.solve(x.T @ vx, vx.T)
    proj = (proj + proj.T) / 2
    if np.abs(proj @ x).max() > 1e-6 * max(1.0, np.abs(proj).max()):
        raise ValueError("projection does not remove the fixed effects")
    return proj, proj @ y


def whitener(y, x, kernels: dict, seed: int = 42):
    """A root W of V^(-1) (W V W' = I) under the REML variances, and the fit.

    Least squares after W do not depend on which root is taken: here the inverse of the
    Cholesky factor, with a residual of at least 1e-6 of the scale of the trait.
    """
    fit = fit_reml(y, x, kernels, n_starts=3, seed=seed % 100000)
    v = np.einsum("k,kij->ij", [fit.component_var[k] for k in kernels], np.stack([np.asarray(m, float) for m in kernels.values()]))
    v[np.diag_indices_from(v)] += max(fit.component_var["e"], 1e-6)
    return root_of_inverse(v), fit


def root_of_inverse(v: np.ndarray) -> np.ndarray:
    return np.linalg.solve(np.linalg.cholesky((v + v.T) / 2), np.eye(len(v)))


def normal_scores(y) -> np.ndarray:
    y = np.asarray(y, float)
    _, inv, cnt = np.unique(y, return_inverse=True, return_counts=True)
    last = np.cumsum(cnt)
    return sp.norm_ppf(((last - (cnt - 1) / 2)[inv] - 0.5) / len(y))


def kernel_components(kernels: dict, count: int) -> np.ndarray:
    """Leading unit-variance eigenvectors of the kernels' mean, at most ``count`` and n - 4, from positive eigenvalues only."""
    mean = sum(np.asarray(m, float) for m in kernels.values()) / len(kernels)
    values, vectors = np.linalg.eigh(0.5 * (mean + mean.T))
    positive = values > 1e-8 * max(1.0, float(np.abs(values).max()))
    take = np.flatnonzero(positive)[::-1][:max(0, min(count, len(mean) - 4))]
    chosen = vectors[:, take]
    spread = chosen.std(axis=0, keepdims=True)
    return np.divide(chosen, spread, out=chosen.copy(), where=spread > 1e-12)


def covariates(kernels: dict, n: int, n_pcs: int = 0, extra=None):
    """Intercept, kernel components and standardised extra columns; None if there is the intercept only.

    A QR decomposition of the block tells dependent columns by their small diagonal.
    """
    given = np.zeros((n, 0)) if extra is None else np.asarray(extra, float).reshape(n, -1)
    varies = given.std(axis=0) > 1e-12
    given = (given[:, varies] - given[:, varies].mean(axis=0)) / given[:, varies].std(axis=0)
    parts = kernel_components(kernels, n_pcs) if n_pcs > 0 else np.zeros((n, 0))
    if parts.shape[1] + given.shape[1] == 0:
        return None
    block = np.hstack((np.ones((n, 1)), parts, given))
    diagonal = np.abs(np.diag(np.linalg.qr(block, mode="r")))
    if len(diagonal) < block.shape[1] or diagonal.min() < 1e-10 * np.linalg.norm(block):
        raise ValueError("covariates are linearly dependent")
    return block


def interaction_tests(wh, y, bx, by, c=None, dominance: bool = False):
    """GLS t test of the burden product for a block of pairs (rows of bx, by: pairs x n).

    Covariates are projected out once; each pair then solves a small system. Rank-deficient
    designs give p = 1. Returns beta, t, p arrays.
    """
    n = len(y)
    c0 = wh @ (np.ones((n, 1)) if c is None else c)
    q = np.linalg.qr(c0)[0]

    def clean(m):
        m = m @ wh.T
        return m - (m @ q) @ q.T

    terms = [bx, by] + ([bx * bx, by * by] if dominance else []) + [bx * by]
    d = np.stack([clean(m) for m in terms], 2)              # pairs x n x terms
    yw = clean(np.asarray(y, float)[None])[0]
    k = d.shape[2]
    df = n - c0.shape[1] - k
    g = np.einsum("pni,pnj->pij", d, d)
    rhs = np.einsum("pni,n->pi", d, yw)
    scale = np.sqrt(np.maximum(np.einsum("pii->pi", g), 0))
    ok = (scale > 1e-10).all(1)
    s = np.where(scale > 0, scale, 1)
    gs = g / s[:, :, None] / s[:, None, :]
    ok &= np.linalg.eigvalsh(gs)[:, 0] > 1e-10
    gs[~ok] = np.eye(k)
    inv = np.linalg.inv(gs)
    b = np.einsum("pij,pj->pi", inv, rhs / s)
    rss = np.maximum(yw @ yw - np.einsum("pi,pi->p", b, rhs / s), 1e-300)
    t = b[:, -1] / np.sqrt(rss / df * inv[:, -1, -1])
    beta = b[:, -1] / s[:, -1]
    p = np.where(ok, sp.t_sf2(np.where(ok, t, 0.0), df), 1.0)
    return np.where(ok, beta, np.nan), np.where(ok, t, 0.0), p


#: Determinant of the scaled design from which a closed form is as good as a factorisation.
CLOSED_FROM = 1e-4


def interaction_p(wh, y, bx, by, c=None):
    """p of :func:`interaction_tests`, without dominance, for many pairs: the 3 x 3 systems in closed form.

    Pairs whose design is near collinear go through :func:`interaction_tests`.
    """
    n = len(y)
    c0 = wh @ (np.ones((n, 1)) if c is None else c)
    q = np.linalg.qr(c0)[0]
    clean = (wh - q @ (q.T @ wh)).T
    yw = np.asarray(y, float) @ clean
    d = [m @ clean for m in (bx, by, bx * by)]
    dot = lambda a, b: np.einsum("pn,pn->p", a, b)
    scale = [np.sqrt(dot(m, m)) for m in d]
    seen = (scale[0] > 1e-10) & (scale[1] > 1e-10) & (scale[2] > 1e-10)
    u, v, w = (np.where(seen, s, 1.0) for s in scale)
    r, s, t = dot(d[0], d[1]) / (u * v), dot(d[0], d[2]) / (u * w), dot(d[1], d[2]) / (v * w)
    det = 1 + 2 * r * s * t - r * r - s * s - t * t
    easy = seen & (det > CLOSED_FROM)
    safe = np.where(easy, det, 1.0)
    x, y1, z = d[0] @ yw / u, d[1] @ yw / v, d[2] @ yw / w
    rr = r * t - s, r * s - t, 1 - r * r  # last row of the adjugate
    b0 = ((1 - t * t) * x + (s * t - r) * y1 + rr[0] * z) / safe
    b1 = ((s * t - r) * x + (1 - s * s) * y1 + rr[1] * z) / safe
    b2 = (rr[0] * x + rr[1] * y1 + rr[2] * z) / safe
    df = n - c0.shape[1] - 3
    rss = np.maximum(yw @ yw - (b0 * x + b1 * y1 + b2 * z), 1e-300)
    stat = np.where(easy, b2, 0.0) / np.sqrt(rss / df * np.where(easy, rr[2], 1.0) / safe)
    p = sp.t_sf2_whole(stat, df)
    hard = np.flatnonzero(~easy)
    if len(hard):
        p[hard] = interaction_tests(wh, y, bx[hard], by[hard], c)[2]
    return p


def marginal_tests(wh, y, b, c=None):
    """GLS t p-value of each burden alone (rows of b: genes x n)."""
    n = len(y)
    c0 = wh @ (np.ones((n, 1)) if c is None else c)
    q = np.linalg.qr(c0)[0]
    m = b @ wh.T
    m = m - (m @ q) @ q.T
    yw = wh @ np.asarray(y, float)
    yw = yw - q @ (q.T @ yw)
    ss, xy = (m * m).sum(1), m @ yw
    df = n - c0.shape[1] - 1
    ok = ss > 1e-10
    safe = np.where(ok, ss, 1)
    t = xy / safe / np.sqrt(np.maximum(yw @ yw - xy * xy / safe, 1e-300) / df / safe)
    return np.where(ok, sp.t_sf2(np.where(ok, t, 0.0), df), 1.0)


def blup(y, x, x_new, kernels: dict, train, test, sigma2: dict, beta, jitter=1e-6):
    """Predictions for ``test`` rows from a model fitted on ``train`` rows."""
    n = len(train)
    v = sigma2["e"] * np.eye(n) + sum(sigma2[k] * m[np.ix_(train, train)] for k, m in kernels.items())
    a = np.linalg.solve(v + jitter * np.eye(n), y - x @ beta)
    return x_new @ beta + sum(sigma2[k] * (m[np.ix_(test, train)] @ a) for k, m in kernels.items())


def homolog_kernel(grms: dict, mode: str = "auto", threshold: int = 3):
    """Product kernel for 2..threshold subgenomes, mean of pair products beyond; None for one."""
    mats = list(grms.values())
    if mode == "none" or len(mats) < 2:
        return None
    if mode == "hadamard" or (mode == "auto" and len(mats) <= threshold):
        out = mats[0]
        for m in mats[1:]:
            out = out * m
        return out
    s = sum(mats)
    return (s * s - sum(m * m for m in mats)) / (len(mats) * (len(mats) - 1))


def trace_scaled(k):
    t = np.trace(k)
    if abs(t) < 1e-12:
        raise ValueError("kernel has no scale")
    return k * len(k) / t


def kernel_condition(kernels: dict) -> float:
    n = len(next(iter(kernels.values())))
    return float(np.linalg.cond(np.stack([*(k.ravel() for k in kernels.values()), np.eye(n).ravel()], 1)))


def fit_with_fallback(y, x, grms: dict, mode="auto", cond_limit=1e4, pve_floor=1e-3, **kw):
    """Full model with the homolog kernel, or the additive one when that kernel is not
    supported: boundary first, then conditioning, then a PVE under the floor."""
    add = fit_reml(y, x, grms, **kw)
    kh = homolog_kernel(grms, mode)
    if kh is None:
        add.drop_reason = "no_homolog_kernel"
        return add, add, None
    kernels = {**grms, "K_hom": kh}
    full = fit_reml(y, x, kernels, **kw)
    if "K_hom" in full.boundary:
        reason = "boundary"
    elif kernel_condition(kernels) > cond_limit:
        reason = "ill_conditioned"
    elif full.pve["K_hom"] < pve_floor:
        reason = "low_pve"
    else:
        reason = "kept"
    chosen = full if reason == "kept" else add
    chosen.drop_reason = reason
    return chosen, add, full


def residual_loglik(y, x) -> float:
    """Closed-form REML log-likelihood without kernels."""
    n, p = x.shape
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s = float(((y - x @ b) ** 2).sum()) / (n - p)
    return -0.5 * ((n - p) * (np.log(2 * np.pi * s) + 1) + np.linalg.slogdet(x.T @ x)[1])
