"""Small-graph and matrix algorithms that SQL can't express; one group, such as a sample or a repeat, is one call.

Groups are bounded by their number of nodes or variables, which the caller declares and each function checks.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distributions import t_two_sided_p

MAX_NODES = 2000
MAX_ROWS = 100_000


def _check(n: int) -> None:
    if n > MAX_NODES:
        raise ValueError(f"a group of {n} nodes; at most {MAX_NODES} are taken")


def betweenness(edges: list[tuple], nodes: list) -> dict:
    """GRA8: shares of shortest directed paths through each node, as in Brandes (2001)."""
    _check(len(nodes))
    after: dict = {v: [] for v in nodes}
    for a, b in edges:
        after[a].append(b)
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, before, paths, depth = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0), {s: 0}
        paths[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def without_cycles(edges: list[tuple]) -> list[tuple]:
    """GRA8: (src, dst, w) without the weakest edge of each cycle found, until there is none."""
    kept = sorted(edges)
    while cycle := _cycle([(a, b) for a, b, _ in kept]):
        weakest = min((e for e in kept if (e[0], e[1]) in cycle), key=lambda e: (e[2], e[0], e[1]))
        kept.remove(weakest)
    return kept


def _cycle(pairs: list[tuple]) -> set | None:
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    state: dict = {}
    for root in sorted(after):
        if root in state:
            continue
        path, stack = [root], [iter(sorted(after[root]))]
        state[root] = 1
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                state[path.pop()] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                ring = path[path.index(nxt) :] + [nxt]
                return set(zip(ring[:-1], ring[1:], strict=True))
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                stack.append(iter(sorted(after.get(nxt, []))))
    return None


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """GRA17: the pairs of rows and columns of least total cost, by successive shortest paths with potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    _check(m)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        match[m], j = row, m
        least, way, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while match[j] != -1:
            done[j] = True
            i = match[j]
            free = ~done[:m]
            slack = c[i] - u[i] - v[:m]
            better = free & (slack < least)
            least[better], way[better] = slack[better], j
            nxt = int(np.where(free, least, np.inf).argmin())
            step = least[nxt]
            for k in np.flatnonzero(done):
                u[match[k]] += step
                v[k] -= step
            least[free] -= step
            j = nxt
        while j != m:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(int(match[j]), j) for j in range(m) if match[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def topology_filter(adjacency: np.ndarray, strength: float, components: int, threshold: float) -> np.ndarray:
    """GRA3: singular values s become s^3 / (s^2 + 1 / strength) in a rebuilt graph; small weights are cut."""
    _check(len(adjacency))
    left, s, right = np.linalg.svd(adjacency)
    k = min(components, len(s))
    out = (left[:, :k] * (s[:k] ** 3 / (s[:k] ** 2 + 1 / strength))) @ right[:k]
    out = np.maximum((out + out.T) / 2, 0)
    np.fill_diagonal(out, 0)
    return np.where(out >= threshold, out, 0.0)


def spectral_gap(adjacency: np.ndarray) -> float:
    """GRA3: the second smallest eigenvalue of the normalised Laplacian less the smallest."""
    _check(len(adjacency))
    d = adjacency.sum(axis=1)
    h = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0)
    values = np.linalg.eigvalsh(np.eye(len(d)) - h[:, None] * adjacency * h)
    return float(values[1] - values[0]) if len(values) > 1 else 0.0


def partial_correlation_p(data: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """STA10: p of the partial correlation of two columns given others; without others, of Pearson's r by its t.

    With others, the covariance has 1e-6 added to its diagonal, r is held to 0.9999, and Fisher's z has n - |given| - 2
    degrees of freedom, at least 1.
    """
    n = len(data)
    if not given:
        r = float(np.corrcoef(data[:, i], data[:, j])[0, 1])
        return 0.0 if abs(r) >= 1 else t_two_sided_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
    idx = [i, j, *given]
    precision = np.linalg.pinv(np.cov(data[:, idx], rowvar=False) + 1e-6 * np.eye(len(idx)))
    r = float(np.clip(-precision[0, 1] / math.sqrt(abs(precision[0, 0] * precision[1, 1]) + 1e-10), -0.9999, 0.9999))
    z = 0.5 * math.log((1 + r) / (1 - r + 1e-10))
    return math.erfc(abs(z) * math.sqrt(max(n - len(given) - 2, 1)) / math.sqrt(2))


def pc(data: np.ndarray, alpha: float, most: int) -> np.ndarray:
    """STA11: a directed graph by constraint-based search; columns are taken in order, and each removal counts at once.

    An edge of a smaller and a larger column goes where a test given up to `most` other neighbours of the smaller one
    doesn't reject independence. Both edges of a collider turn to it; then an undirected edge points away from a column
    that some column not linked to its other end points to; what is left points from the smaller to the larger column.
    """
    p = data.shape[1]
    _check(p)
    linked = ~np.eye(p, dtype=bool)
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    pairs = list(itertools.combinations(range(p), 2))
    for size in range(most + 1):
        for i, j in pairs:
            if linked[i, j]:
                others = [k for k in np.flatnonzero(linked[i]).tolist() if k != j]
                given = next((g for g in itertools.combinations(others, size) if partial_correlation_p(data, i, j, g) > alpha), None)
                if given is not None:
                    linked[i, j] = linked[j, i] = False
                    apart[i, j] = given
    out = linked.copy()
    for i, j in pairs:
        if not linked[i, j]:
            for k in np.flatnonzero(linked[i] & linked[j]).tolist():
                if k not in apart.get((i, j), ()):
                    out[k, i] = out[k, j] = False
    changed = True
    while changed:
        changed = False
        for i, j in itertools.permutations(range(p), 2):
            if out[i, j] and out[j, i]:
                into, apart_of_j = out[:, i] & ~out[i], ~out[:, j] & ~out[j]
                into[[i, j]] = False
                if (into & apart_of_j).any():
                    out[j, i] = False
                    changed = True
    for i, j in pairs:
        if out[i, j] and out[j, i]:
            out[j, i] = False
    return out


def bootstrap_edges(matrix: DataFrame, repeats: int, alpha: float = 0.05, most: int = 3, seed: int = 1, by: str | None = None) -> DataFrame:
    """STA12: (by, src, dst, frequency) of edges over resampled fits; a fit is a task, however many groups there are.

    matrix: (by, row, values array), the observations of few variables. A group's observations meet in the tasks of its
    own fits, MAX_ROWS at most (an error beyond), and nowhere else.
    """
    g = F.lit(0) if by is None else F.col(by)
    rows = matrix.select(g.alias("g"), "row", "values", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    kind = rows.schema["g"].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_ROWS:
            raise ValueError(f"a group of {len(pdf)} observations; at most {MAX_ROWS} are taken")
        data = np.array(pdf.sort_values("row")["values"].tolist(), float)
        rng = np.random.default_rng([seed, int(key[1])])
        src, dst = np.nonzero(pc(data[rng.integers(0, len(data), len(data))], alpha, most))
        return pd.DataFrame({"g": [key[0]] * len(src), "src": src, "dst": dst})

    found = rows.groupBy("g", "repeat").applyInPandas(run, f"g {kind}, src int, dst int")
    out = found.groupBy("g", "src", "dst").agg((F.count(F.lit(1)) / repeats).alias("frequency"))
    return out.drop("g") if by is None else out.withColumnRenamed("g", by)


def linear_sem(data: np.ndarray, mask: np.ndarray, l1: float = 0.01, acyclic: float = 1.0, steps: int = 300, rate: float = 0.02) -> np.ndarray:
    """MOD3: weights A of x = x A without diagonal, by Adam on masked squares, an L1 term and tr(exp(A * A)) - d.

    mask: 1 where an entry of the observation counts (an intervened variable's own entry doesn't).
    """
    d = data.shape[1]
    _check(d)
    a, m, v = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
    for t in range(1, steps + 1):
        gradient = data.T @ (mask * (data @ a - data)) / max(mask.sum(), 1) * 2
        square, term, total = a * a, np.eye(d), np.eye(d)
        for k in range(1, 13):
            term = term @ square / k
            total = total + term
        gradient += l1 * np.sign(a) + acyclic * total.T * 2 * a
        np.fill_diagonal(gradient, 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    np.fill_diagonal(a, 0)
    return a


def sem_by_context(values: DataFrame, names: list[str], context: str, unit: str, name: str, value: str, floor: float = 0.02, steps: int = 300) -> DataFrame:
    """MOD3: (context, src, dst, w) of weights above the floor in size, a fit for each context.

    values: one row for each unit and name, missing ones being 0; columns are scaled by context. The fit needs products of
    columns alone, so a context's task gets the names' squares and products, summed before, not its units.
    """
    _check(len(names))
    rows = values.filter(F.col(name).isin(names))
    n = rows.select(context, unit).distinct().groupBy(context).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = (rows.select(context, unit, F.col(name).alias(s), F.col(value).cast("double").alias(f"v{s}")) for s in "ab")
    cross = a.join(b, [context, unit]).groupBy(context, "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("p"), F.sum("va").alias("s"))
    held = cross.join(n, context)
    place, d = {x: i for i, x in enumerate(names)}, len(names)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = float(pdf.n.iloc[0])
        i, j = pdf.a.map(place).to_numpy(), pdf.b.map(place).to_numpy()
        product, mean = np.zeros((d, d)), np.zeros(d)
        product[i, j] = pdf.p.to_numpy() / total
        mean[i[i == j]] = pdf.s.to_numpy()[i == j] / total
        cov = product - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(scale > 1e-6, scale, 1.0)
        w = sem_of_products(cov / np.outer(scale, scale), steps=steps)
        src, dst = np.nonzero(np.abs(w) > floor)
        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({context: text([key[0]] * len(src)), "src": text([names[k] for k in src]), "dst": text([names[k] for k in dst]), "w": w[src, dst]})

    return held.groupBy(context).applyInPandas(run, f"{context} {dict(values.dtypes)[context]}, src string, dst string, w double")


def sem_of_products(products: np.ndarray, l1: float = 0.01, acyclic: float = 1.0, steps: int = 300, rate: float = 0.02) -> np.ndarray:
    """MOD3 without interventions: linear_sem() from the mean products of the columns, which is all its gradient uses."""
    d = len(products)
    a, m, v = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
    for t in range(1, steps + 1):
        gradient = (products @ a - products) * 2 / d
        square, term, total = a * a, np.eye(d), np.eye(d)
        for k in range(1, 13):
            term = term @ square / k
            total = total + term
        gradient += l1 * np.sign(a) + acyclic * total.T * 2 * a
        np.fill_diagonal(gradient, 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    np.fill_diagonal(a, 0)
    return a


#: Points of a triangulation; their edges take about 1 kB a point.
MAX_CORNERS = 1_000_000


def delaunay(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """GRA2: the triangles of a Delaunay triangulation, by halving the points and merging (Guibas and Stolfi).

    Equal points after the first take no part, nor points with a coordinate that is no finite number; points on a line have
    no triangle. Where four points lie on a circle, either diagonal may be taken. Signs that doubles leave open are worked
    out in whole fractions.
    """
    if len(xy) > MAX_CORNERS:
        raise ValueError(f"a group of {len(xy)} points; at most {MAX_CORNERS} are taken")
    p = np.asarray(xy, float).reshape(-1, 2)
    ok = np.flatnonzero(np.isfinite(p).all(axis=1))
    order = ok[np.lexsort((ok, p[ok, 1], p[ok, 0]))]
    q = p[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)])] if len(q) else order
    if len(order) < 3:
        return []
    xs, ys = p[order, 0].tolist(), p[order, 1].tolist()
    org: list[int] = []  # edge e runs from org[e] to org[e ^ 1]
    after: list[int] = []  # the next edge around its origin, and the one before
    before: list[int] = []

    def side(a: int, b: int, c: int) -> float:
        """Above 0 where a, b, c turn left, below where they turn right."""
        left, right = (xs[a] - xs[c]) * (ys[b] - ys[c]), (ys[a] - ys[c]) * (xs[b] - xs[c])
        det, most = left - right, abs(left) + abs(right)
        if abs(det) > 4e-16 * most or most == 0:
            return det
        ax, ay, bx, by, cx, cy = map(Fraction, (xs[a], ys[a], xs[b], ys[b], xs[c], ys[c]))
        exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        return (exact > 0) - (exact < 0)

    def inside(a: int, b: int, c: int, d: int) -> bool:
        """Whether d is within the circle through a, b, c, which turn right."""
        dx, dy = xs[d], ys[d]
        ax, ay, bx, by, cx, cy = xs[a] - dx, ys[a] - dy, xs[b] - dx, ys[b] - dy, xs[c] - dx, ys[c] - dy
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        det = a2 * (bc - cb) + b2 * (ca - ac) + c2 * (ab - ba)
        if abs(det) > 1.2e-15 * (a2 * (abs(bc) + abs(cb)) + b2 * (abs(ca) + abs(ac)) + c2 * (abs(ab) + abs(ba))):
            return det < 0
        fx, fy = Fraction(dx), Fraction(dy)
        u, v, w = ((Fraction(xs[i]) - fx, Fraction(ys[i]) - fy) for i in (a, b, c))
        m = lambda r, s: r[0] * s[1] - s[0] * r[1]
        n = lambda r: r[0] * r[0] + r[1] * r[1]
        return n(u) * m(v, w) + n(v) * m(w, u) + n(w) * m(u, v) < 0

    def edge(a: int, b: int) -> int:
        e = len(org)
        org.extend((a, b))
        after.extend((e, e + 1))
        before.extend((e, e + 1))
        return e

    def splice(a: int, b: int) -> None:
        if a != b:
            before[after[a]], before[after[b]] = b, a
            after[a], after[b] = after[b], after[a]

    def connect(a: int, b: int) -> int:
        e = edge(org[a ^ 1], org[b])
        splice(e, before[a ^ 1])
        splice(e ^ 1, b)
        return e

    def drop(e: int) -> None:
        splice(e, before[e])
        splice(e ^ 1, before[e ^ 1])
        org[e] = org[e ^ 1] = -1

    def halves(s: int, t: int) -> tuple[int, int]:
        """Triangulates the points from s up to t; the outer edges at the first and at the last point."""
        if t - s == 2:
            a = edge(s, s + 1)
            return a, a ^ 1
        if t - s == 3:
            a, b = edge(s, s + 1), edge(s + 1, s + 2)
            splice(a ^ 1, b)
            turn = side(s, s + 1, s + 2)
            if turn < 0:
                c = connect(b, a)
                return c ^ 1, c
            if turn > 0:
                connect(b, a)
            return a, b ^ 1
        m = (s + t + 1) // 2
        (ldo, ldi), (rdi, rdo) = halves(s, m), halves(m, t)
        while True:  # the lower common tangent
            if side(org[ldi], org[ldi ^ 1], org[rdi]) > 0:
                ldi = after[ldi ^ 1]
            elif side(org[rdi], org[rdi ^ 1], org[ldi]) < 0:
                rdi = before[rdi ^ 1]
            else:
                break
        base = connect(ldi ^ 1, rdi)
        if org[ldi] == org[ldo]:
            ldo = base
        if org[rdi] == org[rdo]:
            rdo = base ^ 1
        while True:
            r, n = after[base ^ 1], before[base]
            b, c = org[base], org[base ^ 1]
            on_r, on_n = side(b, c, org[r ^ 1]) > 0, side(b, c, org[n ^ 1]) > 0
            if not (on_r or on_n):
                return ldo, rdo
            if on_r:
                while side(b, c, org[after[r] ^ 1]) > 0 and inside(c, b, org[r ^ 1], org[after[r] ^ 1]):
                    e = after[r]
                    drop(r)
                    r = e
            if on_n:
                while side(b, c, org[before[n] ^ 1]) > 0 and inside(c, b, org[n ^ 1], org[before[n] ^ 1]):
                    e = before[n]
                    drop(n)
                    n = e
            if not on_r or (on_n and inside(org[r ^ 1], org[r], org[n], org[n ^ 1])):
                base = connect(n, base ^ 1)
            else:
                base = connect(base ^ 1, r ^ 1)

    halves(0, len(order))
    names, found = order.tolist(), set()
    for e, a in enumerate(org):
        if a >= 0:
            b, c = org[e ^ 1], org[after[e] ^ 1]
            if a < b and a < c and b != c and side(a, b, c) < 0:  # each triangle at its first corner
                found.add(tuple(sorted((names[a], names[b], names[c]))))
    return sorted(found)


def ward(points: np.ndarray, weights: np.ndarray, n_groups: list[int]) -> dict[int, np.ndarray]:
    """GRA15: labels from 0 for each number of groups, by merging the two groups whose union adds least to the squares."""
    _check(len(points))
    groups = {i: [i] for i in range(len(points))}
    centre, mass = {i: np.asarray(x, float) for i, x in enumerate(points)}, {i: float(w) for i, w in enumerate(weights)}
    out: dict[int, np.ndarray] = {}

    def note() -> None:
        if len(groups) in n_groups:
            labels = np.zeros(len(points), int)
            for k, members in enumerate(sorted(groups.values())):
                labels[members] = k
            out[len(groups)] = labels

    note()
    while len(groups) > 1:
        cost = lambda a, b: mass[a] * mass[b] / max(mass[a] + mass[b], 1e-300) * float(((centre[a] - centre[b]) ** 2).sum())
        a, b = min(itertools.combinations(sorted(groups), 2), key=lambda x: (round(cost(*x), 12), x))
        total = mass[a] + mass[b]
        centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / max(total, 1e-300)
        mass[a] = total
        groups[a] = sorted(groups[a] + groups.pop(b))
        note()
    return out
