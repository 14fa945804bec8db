"""Surfaces from points: kriging, tensioned splines, minimum curvature and triangulation.

The neighbours of cells are found, and their linear systems solved as stacks, in grouped NumPy kernels on blocks with a halo;
a block is bounded by its size, not by the raster's. Cells whose neighbours lie farther than the halo get theirs from joins.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import fixed
from .cells import plane_sums, solved_plane
from .neighbors import haloed, knn, nearest_k, nearest_places, radius_pairs

EULER = 0.5772156649015329


def variogram_value(model: str, h: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Semivariance at distance h; 0 at no distance, where the nugget does not apply."""
    if model == "spherical":
        r = np.minimum(h / reach, 1.0)
        v = nugget + sill * (r * (1.5 - 0.5 * r * r))
    elif model == "exponential":
        v = nugget + sill * (1 - np.exp(-3 * h / reach))
    elif model == "linear":
        v = nugget + sill * h
    else:
        raise ValueError(f"unknown variogram model {model}")
    return np.where(h > 0, v, 0.0)


def drift(dx: np.ndarray, dy: np.ndarray, order: int) -> np.ndarray:
    """Polynomial terms about the cell."""
    terms = [np.ones_like(dx)]
    if order >= 1:
        terms += [dx, dy]
    if order >= 2:
        terms += [dx * dx, dx * dy, dy * dy]
    return np.stack(terms, -1)


#: By how much of the neighbours' range an estimate may leave it before inverse distance steps in.
GUARDS = {"range": 0.0, "widened": 1.0, "none": np.inf}


def krige_stack(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, variogram: tuple, order: int = 0, ridge: float = 1e-6, guard: str = "range") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate, variance and whether inverse distance had to step in, for a stack of cells with equally many
    neighbours at (dx, dy) from the cell. ``variogram``: (model, nugget, sill, range). What is kriged is the misfit of the
    drift's least-squares fit, which rounding harms least; neighbours that do not span the drift have no estimate of it."""
    model, nugget, sill, reach = variogram
    m, k = z.shape
    f = drift(dx, dy, order)
    t = f.shape[-1]
    apart = np.hypot(dx[:, :, None] - dx[:, None, :], dy[:, :, None] - dy[:, None, :])
    dist = np.hypot(dx, dy)
    total = nugget + sill
    a = np.zeros((m, k + t, k + t))
    np.subtract(total if model != "linear" else 0.0, variogram_value(model, apart, nugget, sill, reach), out=a[:, :k, :k])
    a[:, range(k), range(k)] += ridge * total
    a[:, :k, k:] = f
    a[:, k:, :k] = f.transpose(0, 2, 1)
    right = np.zeros((m, k + t, 1))
    right[:, :k, 0] = (total if model != "linear" else 0.0) - variogram_value(model, dist, nugget, sill, reach)
    right[:, k, 0] = 1.0
    w = solve_stack(a, right)[:, :, 0]
    fit, spans = drift_fit(dx, dy, z, order)
    est = np.where(spans, fit[:, 0] + (w[:, :k] * (z - (f @ fit[:, :, None])[:, :, 0])).sum(1), np.nan)
    with np.errstate(invalid="ignore"):
        room = GUARDS[guard] * (z.max(1) - z.min(1)) if guard != "none" else np.inf
        bad = ~np.isfinite(est) | (est < z.min(1) - room) | (est > z.max(1) + room)
    var = total - (w * right[:, :, 0]).sum(1)
    if bad.any():
        v = 1 / np.maximum(dist[bad], 1e-9) ** 2
        est[bad], var[bad] = (v * z[bad]).sum(1) / v.sum(1), np.nan
    return est, var, bad


def drift_fit(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The drift's least-squares coefficients for each row of a stack, and whether its neighbours span the drift; where they
    do not, their mean."""
    size = np.maximum(np.abs(dx).max(1), np.abs(dy).max(1))
    size = np.where(size > 0, size, 1.0)[:, None]
    f = drift(dx / size, dy / size, order)
    t = f.shape[-1]
    mean = z.mean(1)
    fit = np.zeros((len(z), t))
    fit[:, 0] = mean
    if f.shape[1] < t:
        return fit, np.zeros(len(z), bool)
    q, r = np.linalg.qr(f)
    spans = (np.abs(np.diagonal(r, axis1=1, axis2=2)) > 1e-7).all(1)
    if order:
        off = np.linalg.solve(r[spans], q[spans].transpose(0, 2, 1) @ (z - mean[:, None])[spans, :, None])[:, :, 0]
        fit[spans] += off / size[spans] ** np.array([0, 1, 1, 2, 2, 2])[:t]
    return fit, spans


def solve_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; NaN for singular ones."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                continue
        return out


def by_count(frame: pd.DataFrame, key: list[str], solve, names: list[str], batch: int = 4000) -> pd.DataFrame:
    """Run ``solve(dx, dy, z)`` on the cells of a frame of (key, dx, dy, z) rows, stacked by how many rows a cell has."""
    frame = frame.sort_values([*key, "k"], kind="stable")
    edge = np.flatnonzero(np.r_[True, (frame[key].to_numpy()[1:] != frame[key].to_numpy()[:-1]).any(1)]) if len(frame) else np.zeros(0, int)
    count = np.diff(np.r_[edge, len(frame)])
    cols = {c: frame[c].to_numpy(float) for c in ("dx", "dy", "z")}
    parts = []
    for n in np.unique(count):
        at = edge[count == n]
        for lo in range(0, len(at), batch):
            i = at[lo : lo + batch, None] + np.arange(n)
            got = solve(*(cols[c][i] for c in ("dx", "dy", "z")))
            part = frame[key].iloc[i[:, 0]].reset_index(drop=True)
            for name, v in zip(names, got, strict=True):
                part[name] = v
            parts.append(part)
    return pd.concat(parts) if parts else pd.DataFrame(columns=[*key, *names])


def krige_guards(points: DataFrame, cells: DataFrame, variogram: tuple, guards: list[str], k: int = 16, radius: float = 50.0, least: int = 4) -> DataFrame:
    """``row, col, guard, z, fallback``: ordinary kriging under each of several guards. The systems are solved once: a guard
    only says which estimates inverse distance replaces."""

    def each(dx: np.ndarray, dy: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        est, _, bad = krige_stack(dx, dy, z, variogram, guard="none")
        out = []
        for guard in guards:
            with np.errstate(invalid="ignore"):
                room = GUARDS[guard] * (z.max(1) - z.min(1)) if guard != "none" else np.inf
                over = bad | (est < z.min(1) - room) | (est > z.max(1) + room)
            v = 1 / np.maximum(np.hypot(dx[over], dy[over]), 1e-9) ** 2
            got = est.copy()
            got[over] = (v * z[over]).sum(1) / v.sum(1)
            out += [got, over]
        return out

    names = {f"{v}{i}": kind for i in range(len(guards)) for v, kind in (("z", "double"), ("fallback", "boolean"))}
    got = estimated(points, cells, ["row", "col"], k, radius, least, each, names)
    each_guard = F.explode(F.array(*[F.struct(F.lit(guard).alias("guard"), F.col(f"z{i}").alias("z"), F.col(f"fallback{i}").alias("fallback")) for i, guard in enumerate(guards)]))
    return got.select("row", "col", each_guard.alias("_g")).select("row", "col", "_g.guard", "_g.z", "_g.fallback")


def estimated(points: DataFrame, asked: DataFrame, key: list[str], k: int, radius: float, need: int, solve, names: dict[str, str], order: int = 0, buffer: float = -1, closed: bool = False, far: bool = False, batch: int = 500) -> DataFrame:
    """``key`` and the columns ``names`` that ``solve(dx, dy, z)`` gives for stacks of the rows of ``asked`` (key, xi, yi) from
    their ``k`` nearest points (xi, yi, z) beyond the buffer and within the radius (``closed``: its edge too), ties by place. Rows
    for which these are fewer than ``need``, or do not span the drift, have no estimate of fewer than ``need`` or, with ``far``,
    one from their ``k`` nearest however far, of more where these do not span it either. Places are whole. Neighbours are
    found in blocks with a halo; only those of rows whose halo doesn't hold enough are joined."""
    p = points.select("xi", "yi", F.col("z").cast("double").alias("z"))
    halo = int(np.ceil(radius))
    occupied, n = p.groupBy(F.expr("yi div 100"), F.expr("xi div 100")).agg(F.count(F.lit(1)).alias("n")).agg(F.count("n"), F.sum("n")).first()  # two numbers
    room = (occupied or 1) * 1e4 / (n or 1)
    if far:
        halo = max(halo, int(np.ceil(3 * np.sqrt(k * room / np.pi) + max(buffer, 0))))
    core = max(8 * halo, int(np.sqrt(4000 * room)))  # some 4,000 points, so that thin clouds have few blocks
    kinds = {c: asked.schema[c].dataType.simpleString() for c in key}
    inputs = [f"_{c}" for c in key]
    rows = haloed(p.withColumns({i: F.lit(None).cast(kinds[c]) for c, i in zip(key, inputs, strict=True)}).withColumn("ask", F.lit(False)), core, halo).drop("inner")
    own = asked.select("xi", "yi", F.lit(None).cast("double").alias("z"), *[F.col(c).alias(i) for c, i in zip(key, inputs, strict=True)], F.lit(True).alias("ask"))
    own = own.withColumns({"bi": F.floor(F.col("yi") / core), "bj": F.floor(F.col("xi") / core)})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        ask = frame["ask"].to_numpy(bool)
        at = frame[~ask].sort_values(["xi", "yi", "z"], kind="stable")
        mine = frame[ask]
        x, y, u, v = (f[c].to_numpy(np.int64) for f in (at, mine) for c in ("xi", "yi"))
        z = at["z"].to_numpy(float)
        near, d2 = nearest_places(x, y, u, v, k, buffer, float(halo) if far else float(radius))
        within = ((near >= 0) & ((d2 <= radius * radius) if closed else (d2 < radius * radius))).sum(1)
        out = {name: np.zeros(len(u), bool) if kind == "boolean" else np.full(len(u), np.nan) for name, kind in names.items()}
        told = np.zeros(len(u), bool)
        left = np.arange(len(u))
        for count in (within, np.where(near[:, -1] >= 0, k, 0)) if far else (within,):
            left = left[~told[left]]
            for m in np.unique(count[left]):
                if m < need:
                    continue
                same = left[count[left] == m]
                for lo in range(0, len(same), batch):
                    i = same[lo : lo + batch]
                    other = near[i, :m]
                    dx, dy, h = (x[other] - u[i, None]).astype(float), (y[other] - v[i, None]).astype(float), z[other]
                    if far and order:
                        ok = drift_fit(dx, dy, h, order)[1]
                        i, dx, dy, h = i[ok], dx[ok], dy[ok], h[ok]
                    if len(i):
                        told[i] = True
                        for name, got in zip(names, solve(dx, dy, h), strict=True):
                            out[name][i] = got
        back = pd.DataFrame({**{c: mine[i].to_numpy() for c, i in zip(key, inputs, strict=True)}, **out, "told": told})
        return back if far else back[told]

    fields = ", ".join(f"{c} {kind}" for c, kind in {**kinds, **names}.items())
    got = rows.unionByName(own).groupBy("bi", "bj").applyInPandas(block, f"{fields}, told boolean")
    if not far:
        return got.drop("told")
    got = fixed(got, "estimated")
    done, bare = got.filter("told").drop("told"), asked.select(*key, "xi", "yi").join(got.filter("not told").select(*key), key, "left_semi")
    bare = fixed(bare, "bare")
    while not bare.isEmpty():
        near = nearest_k(bare, p, k, key, ["xi2", "yi2"], 2 * halo, beyond=buffer)
        near = near.select(*key, "k", (F.col("xi2") - F.col("xi")).cast("double").alias("dx"), (F.col("yi2") - F.col("yi")).cast("double").alias("dy"), F.col("z2").alias("z"), F.floor(F.col("xi") / core).alias("_a"), F.floor(F.col("yi") / core).alias("_b"))

        def solve_far(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame[frame.groupby(key)["k"].transform("size") >= need]
            back = by_count(frame, key, lambda dx, dy, z: [*solve(dx, dy, z), drift_fit(dx, dy, z, order)[1]], [*names, "told"], batch)
            return back.astype({name: "bool" if kind == "boolean" else "float64" for name, kind in {**names, "told": "boolean"}.items()})

        more = fixed(near.groupBy("_a", "_b").applyInPandas(solve_far, f"{fields}, told boolean"), "afar")
        crooked = more.filter("not told")
        if not order or crooked.isEmpty() or k >= n or not _spread(p):
            return done.unionByName(more.drop("told"))
        done = done.unionByName(more.filter("told").drop("told"))
        bare, k = fixed(bare.join(crooked.select(*key), key, "left_semi"), "bare"), 2 * k
    return done


def _spread(p: DataFrame) -> bool:
    """Whether the points don't all lie on one line."""
    a, b, c = p.agg(F.var_pop("xi"), F.var_pop("yi"), F.covar_pop("xi", "yi")).first()  # three numbers
    return a * b - c * c > 1e-9 * (a + b) ** 2


def krige(points: DataFrame, cells: DataFrame, variogram: tuple, k: int = 16, radius: float = 50.0, least: int = 4, order: int = 0, guard: str = "range", far: bool = False) -> DataFrame:
    """``row, col, z, variance, fallback``: ordinary (order 0) or universal kriging at the cells (row, col, xi, yi), from the
    ``k`` nearest points within the radius; cells with fewer than ``least`` points have no estimate or, with ``far``, one
    from their ``k`` nearest however far. An estimate outside its neighbours' range is replaced by inverse squared distance."""
    need = max(least, {0: 1, 1: 3, 2: 6}[order] + 1)
    solve = lambda dx, dy, z: krige_stack(dx, dy, z, variogram, order, guard=guard)
    names = {"z": "double", "variance": "double", "fallback": "boolean"}
    return estimated(points, cells, ["row", "col"], k, radius, need, solve, names, order, far=far)


def exp1(x: np.ndarray) -> np.ndarray:
    """The exponential integral E1 for positive x: a power series below 1, a continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    low = x <= 1
    if low.any():
        v = x[low]
        total, term = -EULER - np.log(v), np.ones_like(v)
        for n in range(1, 30):
            term = term * -v / n
            total = total - term / n
        out[low] = total
    high = (~low) & (x < 700)
    if high.any():
        v = x[high]
        f = np.zeros_like(v)
        for n in range(60, 0, -1):
            f = n / (1 + n / (v + f))
        out[high] = np.exp(-v) / (v + f)
    return out


def tension_kernel(r2: np.ndarray, tension: float) -> np.ndarray:
    rho = np.maximum(tension * tension / 4 * r2, 1e-12)
    return -(exp1(rho) + np.log(rho) + EULER)


def spline_stack(dx: np.ndarray, dy: np.ndarray, z: np.ndarray, tension: float, smoothing: float) -> tuple[np.ndarray]:
    m, k = z.shape
    a = np.zeros((m, k + 1, k + 1))
    a[:, :k, :k] = tension_kernel((dx[:, :, None] - dx[:, None, :]) ** 2 + (dy[:, :, None] - dy[:, None, :]) ** 2, tension)
    if smoothing:
        a[:, range(k), range(k)] += smoothing * np.abs(a[:, :k, :k]).mean((1, 2))[:, None]
    a[:, :k, k] = a[:, k, :k] = 1
    right = np.zeros((m, k + 1, 1))
    right[:, :k, 0] = z
    s = solve_stack(a, right)[:, :, 0]
    return (s[:, k] + (s[:, :k] * tension_kernel(dx * dx + dy * dy, tension)).sum(1),)


def spline(points: DataFrame, cells: DataFrame, k: int = 48, radius: float = 100.0, tension: float = 0.04, smoothing: float = 0.0, far: bool = False) -> DataFrame:
    """``row, col, z``: a spline with tension through the ``k`` nearest points (within a radius that holds so many); cells with
    fewer than three have no value or, with ``far``, one from their ``k`` nearest however far."""
    return estimated(points, cells, ["row", "col"], k, radius, 3, lambda dx, dy, z: spline_stack(dx, dy, z, tension, smoothing), {"z": "double"}, far=far)


# Minimum curvature


def _second(u: np.ndarray) -> np.ndarray:
    """Second differences along the last axis."""
    return u[..., 2:] - 2 * u[..., 1:-1] + u[..., :-2]


def _bend(u: np.ndarray) -> np.ndarray:
    """The gradient of the bending energy: the transposed second differences of the second differences, which is the
    thirteen-point stencil inside and keeps planes free at the edges."""
    out = np.zeros_like(u)
    for axis in (0, 1):
        w = np.moveaxis(u, axis, -1)
        o = np.moveaxis(out, axis, -1)
        if w.shape[-1] > 2:
            d = _second(w)
            o[..., 2:] += d
            o[..., 1:-1] -= 2 * d
            o[..., :-2] += d
    if u.shape[0] > 1 and u.shape[1] > 1:
        d = 2 * (u[1:, 1:] - u[1:, :-1] - u[:-1, 1:] + u[:-1, :-1])
        out[1:, 1:] += d
        out[1:, :-1] -= d
        out[:-1, 1:] -= d
        out[:-1, :-1] += d
    return out


def minimum_curvature(data: np.ndarray, weight: np.ndarray, tolerance: float = 1e-8, most: int = 4000, guess: np.ndarray | None = None) -> np.ndarray:
    """The surface of least bending energy plus weighted squared misfit, by conjugate gradients. ``data``: NaN where there
    is none; ``weight``: for each cell with data, infinite where the surface must pass exactly. ``guess``: a surface near the
    one sought. Where ``most`` rounds don't suffice, a warning gives the residual that is left."""
    has = np.isfinite(data)
    if not has.any():
        return np.full(data.shape, np.nan)
    pinned = has & ~np.isfinite(weight)
    soft = np.where(has & ~pinned, weight, 0.0)
    # Planes have no bending energy: the surface about the data's own plane is the same, and nearer to nothing.
    trend = _plane(data, has)
    target = np.where(has, data - trend, 0.0)
    free = ~pinned
    x = _start(target, has) if guess is None else guess - trend
    x[pinned] = target[pinned]

    def apply(v: np.ndarray) -> np.ndarray:
        return np.where(free, _bend(v) + soft * v, 0.0)

    scale = np.where(free, 20 + soft, 1.0)
    r = np.where(free, soft * target - _bend(x) - soft * x, 0.0)
    q = r / scale
    p, rq = q.copy(), (r * q).sum()
    # As measured from the data alone, whatever the guess; and no finer than rounding allows.
    plain = np.where(free, soft * target - _bend(np.where(pinned, target, 0.0)), 0.0)
    goal = max(tolerance**2 * (plain * plain / scale).sum(), (1e-13 * np.abs(data[has]).max()) ** 2 * data.size, 1e-300)
    for _ in range(most):
        if rq <= goal:
            break
        ap = apply(p)
        step = rq / max((p * ap).sum(), 1e-300)
        x += step * p
        r -= step * ap
        q = r / scale
        new = (r * q).sum()
        p = q + new / rq * p
        rq = new
    if rq > goal:
        warnings.warn(f"minimum curvature stopped after {most} rounds with {np.sqrt(rq / goal):.3g} times the residual asked for", stacklevel=2)
    return x + trend


def _plane(data: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The least-squares plane through the data, over the whole grid; level where they don't span one."""
    r, c = np.nonzero(has)
    a = np.stack([np.ones(len(r)), r - r.mean(), c - c.mean()], 1)
    p, _, rank, _ = np.linalg.lstsq(a, data[has], rcond=1e-9)
    if rank < 3:
        return np.full(data.shape, data[has].mean())
    rr, cc = np.mgrid[: data.shape[0], : data.shape[1]]
    return p[0] + p[1] * (rr - r.mean()) + p[2] * (cc - c.mean())


def _start(z: np.ndarray, has: np.ndarray, smallest: int = 12) -> np.ndarray:
    """A first guess: the surface on a grid twice as coarse, found the same way, between whose cells lines are drawn. What
    it gets wrong is rough, and that goes in a few rounds."""
    if has.all() or min(z.shape) < smallest:
        return np.where(has, z, z[has].mean() if has.any() else 0.0)
    h, w = (z.shape[0] + 1) // 2, (z.shape[1] + 1) // 2
    pad = lambda a: np.pad(a, ((0, 2 * h - a.shape[0]), (0, 2 * w - a.shape[1])))
    total = pad(np.where(has, z, 0.0)).reshape(h, 2, w, 2).sum((1, 3))
    count = pad(has.astype(float)).reshape(h, 2, w, 2).sum((1, 3))
    data = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a guess need not be solved to the end
        coarse = minimum_curvature(data, np.where(count > 0, np.inf, 0.0), 1e-3, 300)
    for axis, n in enumerate(z.shape):
        at = np.clip((np.arange(n) - 0.5) / 2, 0, coarse.shape[axis] - 1)
        lo = np.minimum(at.astype(int), max(coarse.shape[axis] - 2, 0))
        f = (at - lo).reshape([-1 if k == axis else 1 for k in (0, 1)])
        coarse = np.take(coarse, lo, axis) * (1 - f) + np.take(coarse, np.minimum(lo + 1, coarse.shape[axis] - 1), axis) * f
    return np.where(has, z, coarse)


def slope_adaptive(data: np.ndarray, cell: float, knee: float = 20.0, beta: float = 0.2, gamma: float = 1.0, tightness: float | None = 50.0) -> tuple[np.ndarray, int]:
    """The surface through all data, then again with the data on slopes beyond the knee (degrees) held less tightly the
    steeper they are. Returns it and how many cells were relaxed; without ``tightness`` the first is the result."""
    has = np.isfinite(data)
    exact = np.where(has, np.inf, 0.0)
    first = minimum_curvature(data, exact)
    if tightness is None or not has.any() or min(data.shape) < 2:
        return first, 0
    gy, gx = np.gradient(first, cell)
    over = np.maximum(np.hypot(gx, gy) - np.tan(np.radians(knee)), 0.0)
    slack = beta * over**gamma
    soft = has & (slack > 0)
    if not soft.any():
        return first, 0
    return minimum_curvature(data, np.where(soft, tightness * cell / np.where(soft, slack, 1.0), exact), guess=first), int(soft.sum())


#: The slope (degrees) and steepness of the slope's logistic; the window (metres), the relief across it that
#: makes a break and the steepness of the curvature's; the window (metres) that slopes are read over; least and most weight.
GATE = {"slope": 5.5, "slope_gain": 1.2, "window": 1.5, "relief": 0.1, "bend_gain": 6.0, "slope_window": 5.0, "low": 4.0, "high": 1e4}


def held(first: np.ndarray, cell: float, gate: dict = GATE) -> np.ndarray:
    """How firmly a surface's data hold it, from 0 to 1: firmly where it is flat, or where it bends, be it ever so
    steep; a broad smooth hillside is let go. Both are logistic gates, read over windows that a single cell doesn't
    sway, and joined as a smooth union."""
    from .ground import blur

    gentle, fine = (blur(first, gate[w] / cell / 2) for w in ("slope_window", "window"))
    steep = np.degrees(np.arctan(np.hypot(*np.gradient(gentle, cell))))
    p = np.pad(fine, 1, mode="symmetric")
    bend = np.abs(p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * fine) / cell**2
    logistic = lambda t: 1 / (1 + np.exp(np.clip(t, -60, 60)))
    flat = logistic(gate["slope_gain"] * (steep - gate["slope"]))
    broken = logistic(gate["bend_gain"] * (1 - bend * gate["window"] ** 2 / (2 * gate["relief"])))
    return 1 - (1 - flat) * (1 - broken)


def gated(data: np.ndarray, cell: float, gate: dict = GATE) -> tuple[np.ndarray, int]:
    """The surface through all data, then again with weights that fall geometrically from ``high`` to ``low`` as the data
    are held less firmly. Returns it and how many cells were relaxed."""
    has = np.isfinite(data)
    first = minimum_curvature(data, np.where(has, np.inf, 0.0))
    if not has.any() or min(data.shape) < 3:
        return first, 0
    firm = held(first, cell, gate)
    weight = gate["low"] * (gate["high"] / gate["low"]) ** firm
    return minimum_curvature(data, np.where(has, weight, 0.0), guess=first), int((has & (firm <= 0.5)).sum())


def pooled(total: np.ndarray, count: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian-weighted means of the returns about each cell with data: sums and counts blurred apart."""
    from .ground import blur

    num, den = blur(total, sigma), blur(count.astype(float), sigma)
    return np.where((count > 0) & (den > 1e-9), num / np.maximum(den, 1e-9), np.nan)


def curvature_blocks(points: DataFrame, cell: int, core: int, halo: int, least: int = 20, tightness: float | None = 50.0, scale: float = 1.0, pool: float = 0.0, variant: str = "slope") -> DataFrame:
    """``row, col, z, constrained, relaxed``: minimum curvature in blocks of ``core`` with a halo, in whole units of the points. Blocks
    with fewer than ``least`` points have no surface. ``cell`` must divide core and halo. ``pool``: a Gaussian, in cells, over
    which returns are averaged; ``variant``: slope or gated."""

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        empty = pd.DataFrame({"row": [], "col": [], "z": [], "constrained": [], "relaxed": []}).astype({"row": "int64", "col": "int64", "z": "float64", "constrained": "bool", "relaxed": "int64"})
        if len(frame) < least or not frame["inner"].any():
            return empty
        top, left = (bi * core - halo) // cell, (bj * core - halo) // cell
        size = (core + 2 * halo) // cell
        r, c = (frame["yi"].to_numpy() // cell - top), (frame["xi"].to_numpy() // cell - left)
        ok = (r >= 0) & (r < size) & (c >= 0) & (c < size)
        flat = r[ok] * size + c[ok]
        total, n = np.bincount(flat, frame["z"].to_numpy(float)[ok], size * size), np.bincount(flat, minlength=size * size)
        total, n = total.reshape(size, size), n.reshape(size, size)
        data = pooled(total, n, pool) if pool else np.where(n > 0, total / np.maximum(n, 1), np.nan)
        surface, relaxed = gated(data, cell * scale) if variant == "gated" else slope_adaptive(data, cell * scale, tightness=tightness)
        inner = slice(halo // cell, (halo + core) // cell)
        rr, cc = np.mgrid[inner, inner]
        return pd.DataFrame({"row": (rr + top).ravel(), "col": (cc + left).ravel(), "z": surface[inner, inner].ravel(), "constrained": np.isfinite(data[inner, inner]).ravel(), "relaxed": np.full(rr.size, relaxed)})

    blocks = haloed(points.select("xi", "yi", "z"), core, halo)
    return blocks.groupBy("bi", "bj").applyInPandas(solve, "row long, col long, z double, constrained boolean, relaxed long")


# Triangulation


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points, by insertion into a growing triangulation (Bowyer and Watson), points in
    order along a curve so that the walk to the next one is short."""
    n = len(x)
    if n < 3:
        return np.zeros((0, 3), int)
    span = max(x.max() - x.min(), y.max() - y.min(), 1e-9)
    mx, my = (x.max() + x.min()) / 2, (y.max() + y.min()) / 2
    px, py = np.r_[x, mx - 1e3 * span, mx + 1e3 * span, mx], np.r_[y, my - 1e3 * span, my - 1e3 * span, my + 1e3 * span]
    g = max(1, int(np.sqrt(n / 2)))
    gx, gy = np.minimum(((x - x.min()) / span * g).astype(int), g), np.minimum(((y - y.min()) / span * g).astype(int), g)
    order = np.lexsort((np.where(gy % 2 == 0, gx, -gx), gy))
    tri = {0: (n, n + 1, n + 2)}
    side = {}  # directed edge -> the triangle to its left

    def add(t, a, b, c):
        tri[t] = (a, b, c)
        side[a, b] = side[b, c] = side[c, a] = t

    add(0, n, n + 1, n + 2)
    X, Y = px.tolist(), py.tolist()  # noqa: N806

    def left_of(a, b, p):
        return (X[b] - X[a]) * (Y[p] - Y[a]) - (Y[b] - Y[a]) * (X[p] - X[a])

    def inside(t, p):
        a, b, c = tri[t]
        ax, ay, bx, by, cx, cy = X[a] - X[p], Y[a] - Y[p], X[b] - X[p], Y[b] - Y[p], X[c] - X[p], Y[c] - Y[p]
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    last, serial = 0, 1
    for p in order.tolist():
        t, steps = last, 0
        while True:
            a, b, c = tri[t]
            out = next(((u, v) for u, v in ((a, b), (b, c), (c, a)) if left_of(u, v, p) < 0), None)
            steps += 1
            if out is None or steps > 4 * n + 50:
                break
            nxt = side.get((out[1], out[0]))
            if nxt is None:
                break
            t = nxt
        hole, todo, rim = {t}, [t], []
        while todo:
            cur = todo.pop()
            a, b, c = tri[cur]
            for u, v in ((a, b), (b, c), (c, a)):
                o = side.get((v, u))
                if o is not None and o not in hole and inside(o, p):
                    hole.add(o)
                    todo.append(o)
        for cur in hole:
            a, b, c = tri[cur]
            for u, v in ((a, b), (b, c), (c, a)):
                if side.get((v, u)) not in hole:
                    rim.append((u, v))
        for cur in hole:
            a, b, c = tri.pop(cur)
            for e in ((a, b), (b, c), (c, a)):
                side.pop(e, None)
        for u, v in rim:
            add(serial, u, v, p)
            last = serial
            serial += 1
    got = np.array([v for v in tri.values() if max(v) < n], int).reshape(-1, 3)
    area = (px[got[:, 1]] - px[got[:, 0]]) * (py[got[:, 2]] - py[got[:, 0]]) - (py[got[:, 1]] - py[got[:, 0]]) * (px[got[:, 2]] - px[got[:, 0]])
    return got[area > 1e-9 * span]


def linear_on(tri: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, qx: np.ndarray, qy: np.ndarray, cell: float) -> np.ndarray:
    """The value of the triangulated surface at query points on a lattice of the given cell; NaN outside the hull."""
    out = np.full(len(qx), np.nan)
    order = np.lexsort((qx, qy))
    qy_sorted = qy[order]
    for a, b, c in tri:
        lo, hi = np.searchsorted(qy_sorted, min(y[a], y[b], y[c]), "left"), np.searchsorted(qy_sorted, max(y[a], y[b], y[c]), "right")
        at = order[lo:hi]
        det = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
        if det == 0 or not len(at):
            continue
        u = ((y[b] - y[c]) * (qx[at] - x[c]) + (x[c] - x[b]) * (qy[at] - y[c])) / det
        v = ((y[c] - y[a]) * (qx[at] - x[c]) + (x[a] - x[c]) * (qy[at] - y[c])) / det
        hit = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
        out[at[hit]] = (u * z[a] + v * z[b] + (1 - u - v) * z[c])[hit]
    return out


def on_delaunay(x: np.ndarray, y: np.ndarray, z: np.ndarray, qx: np.ndarray, qy: np.ndarray, room: int = 250_000, most: int = 200) -> np.ndarray:
    """The value of the triangulated surface at query points; NaN outside the hull. The triangle about a point is the lowest of
    those that the points, raised by their squared distance from the middle, make above it: a linear program of three weights,
    solved for all queries at once, over a few of the points first, then over four times as many, and at last over all."""
    out = np.full(len(qx), np.nan)
    order = np.lexsort((x, y))
    x, y, z = x[order], y[order], z[order]
    n = len(x)
    if n < 3 or not len(qx) or np.linalg.matrix_rank(np.stack([x - x.mean(), y - y.mean()])) < 2:
        return out
    span, mx, my = max(np.ptp(x), np.ptp(y)), (x.max() + x.min()) / 2, (y.max() + y.min()) / 2
    # A query at a point has its value.
    place, asked = y + 1j * x, qy + 1j * qx
    at = np.minimum(np.searchsorted(place, asked), n - 1)
    same = place[at] == asked
    out[same] = z[at[same]]
    ask = np.flatnonzero(~same & (qx >= x.min()) & (qx <= x.max()) & (qy >= y.min()) & (qy <= y.max()))
    if not len(ask):
        return out
    # Three corners far out, so dear that only a query outside the hull keeps one.
    px, py = np.r_[x - mx, -4 * span, 4 * span, 0.0], np.r_[y - my, -4 * span, -4 * span, 4 * span]
    cost = np.r_[px[:n] ** 2 + py[:n] ** 2, np.full(3, 1e5 * span * span)]
    u, v, base = qx[ask] - mx, qy[ask] - my, np.tile(np.arange(n, n + 3), (len(ask), 1))
    mixed, step, every = np.random.default_rng(0).permutation(n), 4 ** max(0, int(np.log(n / 16) / np.log(4))), np.arange(len(ask))
    while step > 1:
        _pivoted(px, py, cost, base, u, v, every, mixed[::step], 1e-9 * span * span, room, most)
        step //= 4
    stuck = _pivoted(px, py, cost, base, u, v, every, np.arange(n), 1e-9 * span * span, room, most)
    weight = _weights(px[base], py[base], u, v)
    inside = (np.where(base >= n, np.abs(weight), 0.0).max(1) <= 1e-9) & (weight.min(1) >= -1e-9)
    out[ask[inside]] = (weight * np.r_[z, 0.0, 0.0, 0.0][base]).sum(1)[inside]
    if len(stuck):
        out[ask[stuck]] = linear_on(triangulate(x, y), x, y, z, qx[ask[stuck]], qy[ask[stuck]], 1.0)
    return out


def _weights(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What the corners of triangles (rows of three) weigh at points."""
    ax, ay, bx, by, qx, qy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0], u - x[:, 0], v - y[:, 0]
    det = ax * by - ay * bx
    s, t = (qx * by - qy * bx) / det, (ax * qy - ay * qx) / det
    return np.stack([1 - s - t, s, t], 1)


def _pivoted(px, py, cost, base, u, v, todo: np.ndarray, near: np.ndarray, slack: float, room: int, most: int) -> np.ndarray:
    """Changes the triangles ``base`` of queries ``todo`` until none of the points ``near`` lies below a triangle's plane; returns
    the queries that don't come to an end."""
    terms, own, left = np.stack([np.ones(len(near)), px[near], py[near]]), cost[near], []
    size = max(1, room // len(near))
    for lo in range(0, len(todo), size):
        go = todo[lo : lo + size]
        for _ in range(most):
            x, y, w = px[base[go]], py[base[go]], cost[base[go]]
            ax, ay, aw, bx, by, bw = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], w[:, 1] - w[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0], w[:, 2] - w[:, 0]
            det = ax * by - ay * bx
            sx, sy = (aw * by - bw * ay) / det, (ax * bw - bx * aw) / det
            below = own - np.stack([w[:, 0] - sx * x[:, 0] - sy * y[:, 0], sx, sy], 1) @ terms
            j = below.argmin(1)
            more = below[np.arange(len(go)), j] < -slack
            go, j, x, y = go[more], near[j[more]], x[more], y[more]
            if not len(go):
                break
            share, have = _weights(x, y, px[j], py[j]), np.maximum(_weights(x, y, u[go], v[go]), 0.0)
            leaves = np.where(share > 1e-12, have / np.where(share > 1e-12, share, 1.0), np.inf).argmin(1)
            base[go, leaves] = j
        left.append(go)
    return np.concatenate(left) if left else todo


def block_planes(points: DataFrame, core: int, halo: int) -> DataFrame:
    """``bi, bj, pz, px, py``: the least-squares plane ``pz + px * x + py * y`` of the points of each block with its halo, x and y
    taken from the block's middle; for every block of the points' bounding box. A block whose points span no plane goes on with
    that of the nearest one in its row of blocks that has one, the one before in a tie, and a row without any with that of the nearest row."""
    middle = lambda b: F.col(b) * core + core // 2
    near = haloed(points.select("xi", "yi", F.col("z").cast("double").alias("z")), core, halo).withColumns({"_dx": F.col("xi") - middle("bj"), "_dy": F.col("yi") - middle("bi")})
    own = fixed(solved_plane(plane_sums(near, ["bi", "bj"], "z")).select("bi", "bj", (F.col("bi") * core).alias("y0"), (F.col("bj") * core).alias("x0"), F.col("a").alias("pz"), F.col("b").alias("px"), F.col("c").alias("py")), "planes")
    ends = [F.floor(f(c) / core) for c in ("yi", "xi") for f in (F.min, F.max)]
    top, bottom, left, right = points.agg(*ends).first()  # four numbers
    spark = points.sparkSession
    if top is None or own.isEmpty():
        return own.drop("y0", "x0")
    width = right - left + 1
    every = spark.range((bottom - top + 1) * width).select((F.expr(f"id div {width}") + top).alias("bi"), (F.col("id") % width + left).alias("bj"))
    held = F.struct("y0", "x0", "pz", "px", "py")
    along = _nearest_along(every.join(own, ["bi", "bj"], "left").select("bi", "bj", F.when(F.col("pz").isNotNull(), held).alias("p")), "bj", Window.partitionBy("bi").orderBy("bj"))
    # Rows of blocks without any plane; a single row of the window for each row of blocks.
    rows = _nearest_along(spark.range(top, bottom + 1).withColumnRenamed("id", "bi").join(own.groupBy("bi").agg(F.min_by(held, "bj").alias("p")), "bi", "left"), "bi", Window.orderBy("bi"))
    got = along.join(rows.withColumnRenamed("p", "q"), "bi").withColumn("p", F.coalesce("p", "q")).select("bi", "bj", "p.*")
    shift = F.col("px") * (F.col("bj") * core - F.col("x0")) + F.col("py") * (F.col("bi") * core - F.col("y0"))
    return got.select("bi", "bj", (F.col("pz") + shift).alias("pz"), "px", "py")


def _nearest_along(df: DataFrame, at: str, w) -> DataFrame:
    """``p``, where it is missing, from the nearest row of the window that has one, the one before in a tie."""
    has = F.when(F.col("p").isNotNull(), F.struct(F.col(at).alias("k"), "p"))
    before = F.last(has, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(has, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = df.withColumns({"_b": before, "_a": after})
    farther = F.col("_b").isNull() | ((F.col("_a.k") - F.col(at)) < (F.col(at) - F.col("_b.k")))
    return got.withColumn("p", F.when(farther, F.col("_a.p")).otherwise(F.col("_b.p"))).drop("_a", "_b")


def tin(points: DataFrame, cell: int, core: int, halo: int, queries: DataFrame | None = None, far: bool = False) -> DataFrame:
    """``row, col, z``: the linear surface over the Delaunay triangles of the points, block by block with a halo; or, for a
    frame ``queries`` (xi, yi, id), ``id, z`` at its points. Outside the hull there is no value or, with ``far`` and cells, in
    every block of the points' bounding box that of the plane of ``block_planes``."""
    at_points = queries is not None

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[~frame["ask"]].drop_duplicates(["xi", "yi"])
        if at_points:
            ask = frame[frame["ask"] & frame["inner"]]
            qx, qy, key = ask["xi"].to_numpy(float), ask["yi"].to_numpy(float), {"id": ask["id"].to_numpy("int64")}
        else:
            bi, bj = int(frame["bi"].iloc[0]), int(frame["bj"].iloc[0])
            n = core // cell
            r, c = np.mgrid[bi * n : (bi + 1) * n, bj * n : (bj + 1) * n]
            qx, qy, key = (c.ravel() + 0.5) * cell, (r.ravel() + 0.5) * cell, {"row": r.ravel(), "col": c.ravel()}
        x, y, z = (own[k].to_numpy(float) for k in ("xi", "yi", "z"))
        got = on_delaunay(x, y, z, qx, qy)
        if far:
            out = np.isnan(got)
            pz, px, py = frame[["pz", "px", "py"]].iloc[0]
            got[out] = pz + px * (qx[out] - (bj * core + core // 2)) + py * (qy[out] - (bi * core + core // 2))
        out = pd.DataFrame({**key, "z": got})
        return out[np.isfinite(got)]

    rows = points.select("xi", "yi", F.col("z").cast("double").alias("z"), F.lit(False).alias("ask"), F.lit(-1).cast("bigint").alias("id"))
    if at_points:
        rows = rows.unionByName(queries.select("xi", "yi", F.lit(0.0).alias("z"), F.lit(True).alias("ask"), "id"))
    kinds = "id long, z double" if at_points else "row long, col long, z double"
    if not far:
        return haloed(rows, core, halo).groupBy("bi", "bj").applyInPandas(solve, kinds)
    if at_points:
        raise ValueError("far is for cells")
    planes = fixed(block_planes(points, core, halo), "planes")
    around = haloed(rows, core, halo)
    held = around.select("bi", "bj").distinct()
    near = around.join(planes, ["bi", "bj"]).groupBy("bi", "bj").applyInPandas(solve, kinds)
    n = core // cell
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n * n - 1).cast("bigint")))
    bare = planes.join(held, ["bi", "bj"], "left_anti").withColumn("_i", each)
    bare = bare.withColumns({"row": F.col("bi") * n + F.expr(f"_i div {n}"), "col": F.col("bj") * n + F.col("_i") % n})
    off = lambda c, b: (F.col(c) + 0.5) * cell - (F.col(b) * core + core // 2)
    return near.unionByName(bare.select("row", "col", (F.col("pz") + F.col("px") * off("col", "bj") + F.col("py") * off("row", "bi")).alias("z")))


def idw(points: DataFrame, cells: DataFrame, k: int = 16, radius: float = 50.0, least: int = 1) -> DataFrame:
    """``row, col, z``: inverse squared distance, in expressions alone."""
    near = knn(cells, points.select("xi", "yi", "z"), k, radius, ["row", "col"], ["xi2", "yi2"], strict=True)
    w = 1 / F.greatest(F.col("d2").cast("double"), F.lit(1e-18))
    return near.groupBy("row", "col").agg((F.sum(F.col("z2") * w) / F.sum(w)).alias("z"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")


ENGINES = {"kriging": krige, "spline": spline, "minimum curvature": curvature_blocks, "tin": tin, "idw": idw}


def engine(name: str):
    """A surface engine by name; an unknown one is an error."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name}; there are {', '.join(ENGINES)}")
    return ENGINES[name]


def density_within(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """``row, col, n``: points within a radius of each cell."""
    return radius_pairs(cells, points.select("xi", "yi"), radius).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
