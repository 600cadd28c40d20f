"""Nearest neighbours within the arrays of one task: leaves of a k-d tree against the leaves that can matter."""

from __future__ import annotations

import numpy as np

#: Points of a leaf; queries times candidates of one piece of work.
LEAF = 128
PIECE = 2_000_000


def _best(qx, qy, q_id, cx, cy, c_id, k: int, reach2):
    """For each query its k nearest candidates by (distance, id) within ``reach2``, without its own id: query, candidate, squared distance."""
    out = []
    step = max(1, PIECE // max(1, len(cx)))
    order = np.argsort(c_id, kind="stable")
    cx, cy, c_id = cx[order], cy[order], c_id[order]
    for a in range(0, len(qx), step):
        at = slice(a, a + step)
        dx, dy = qx[at, None] - cx[None, :], qy[at, None] - cy[None, :]
        d2 = dx * dx + dy * dy
        d2[q_id[at, None] == c_id[None, :]] = np.inf
        limit = np.full(len(d2), np.inf) if d2.shape[1] <= k else np.partition(d2, k - 1, axis=1)[:, k - 1]
        if reach2 is not None:
            limit = np.minimum(limit, reach2[at])
        row, col = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
        d = d2[row, col]
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        take = place < k
        out.append((row[take] + a, order[col[take]], d[take]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def leaves(x: np.ndarray, y: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Indices of the points of each leaf: halves along the wider side until none has over ``most``."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            if len(at):
                out.append(at)
            continue
        side = x[at] if np.ptp(x[at]) >= np.ptp(y[at]) else y[at]
        order = at[np.argpartition(side, len(at) // 2)]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def nearest(qx, qy, q_id, cx, cy, c_id, k: int, reach2=None):
    """The k nearest of the candidates for each query, ties by id, its own id left out, at most ``reach2`` away: query, candidate, squared distance.

    Exact: a leaf of queries meets every leaf of candidates that lies no farther than the worst k-th distance found nearby.
    """
    if not len(qx) or not len(cx):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if len(cx) <= 4 * LEAF:
        return _best(qx, qy, q_id, cx, cy, c_id, k, reach2)
    parts = leaves(cx, cy, max(LEAF, 4 * k))
    box = np.array([(cx[i].min(), cx[i].max(), cy[i].min(), cy[i].max()) for i in parts])
    out = []
    for q in leaves(qx, qy, LEAF):
        x0, x1, y0, y1 = qx[q].min(), qx[q].max(), qy[q].min(), qy[q].max()
        gx = np.maximum(0, np.maximum(box[:, 0] - x1, x0 - box[:, 1]))
        gy = np.maximum(0, np.maximum(box[:, 2] - y1, y0 - box[:, 3]))
        gap = gx * gx + gy * gy
        order = np.argsort(gap, kind="stable")
        # a bound from the nearest leaves, which have over k candidates besides a query's own
        size, near = 0, 0
        while near < len(order) and size < k + 1:
            size += len(parts[order[near]])
            near += 1
        at = np.concatenate([parts[i] for i in order[:near]])
        row, _, d = _best(qx[q], qy[q], q_id[q], cx[at], cy[at], c_id[at], k, None)
        found = np.bincount(row, minlength=len(q))
        bound = np.full(len(q), np.inf)
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.empty(0, np.int64)
        bound[row[last]] = np.where(found[row[last]] >= k, d[last], np.inf)
        if reach2 is not None:
            bound = np.minimum(bound, reach2[q])
        at = np.concatenate([parts[i] for i in np.flatnonzero(gap <= bound.max())] or [np.empty(0, np.int64)])
        row, col, d = _best(qx[q], qy[q], q_id[q], cx[at], cy[at], c_id[at], k, bound)
        out.append((q[row], at[col], d))
    return tuple(np.concatenate(x) for x in zip(*out))


#: Types that are counted at once.
TYPES = 32


def counted(qx, qy, cx, cy, code, weight, types: int, reach: float, square: bool = False) -> np.ndarray:
    """For each query and type the weight of candidates within ``reach`` (or in the square of that half width), coincident ones too.

    Candidates lie in rows, each sorted by x with running sums of its types. A query takes the sums of the run in each row that lies
    within whatever its y, and tests the candidates between that run and the widest one, so it doesn't meet all it counts.
    """
    out = np.zeros((len(qx), types), dtype=np.int64)
    if not len(qx) or not len(cx):
        return out
    by = np.argsort(qy, kind="stable")
    qx, qy = qx[by], qy[by]
    low, span = float(cy.min()), float(np.ptp(cy))
    # a row's height balances searches against tests
    high = max(np.sqrt(10 * max(span, 1e-9) * max(float(np.ptp(cx)), 1e-9) / len(cx)), span / 4096, reach / 512, 1e-300)
    row = np.floor((cy - low) / high).astype(np.int64)
    order = np.lexsort((cx, row))
    cx, cy, code, weight, row = cx[order], cy[order], code[order], weight[order], row[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    slack = 1e-12 * (reach + max(np.abs(qx).max(), np.abs(cx).max()))
    r2 = reach * reach
    for a, b in zip(starts, np.append(starts[1:], len(cx))):
        x, y0, y1 = cx[a:b], cy[a:b].min(), cy[a:b].max()
        lo, hi = np.searchsorted(qy, y0 - reach - slack - 1e-12 * abs(y0)), np.searchsorted(qy, y1 + reach + slack + 1e-12 * abs(y1), "right")
        if lo >= hi:
            continue
        sums = np.zeros((b - a + 1, types), dtype=np.int64)
        sums[np.arange(1, b - a + 1), code[a:b]] = weight[a:b]
        np.cumsum(sums, axis=0, out=sums)
        step = max(1, PIECE // (b - a))
        for c in range(lo, hi, step):
            at = np.arange(c, min(hi, c + step))
            x_, y_ = qx[at], qy[at]
            near = np.maximum(0, np.maximum(y0 - y_, y_ - y1))
            far = np.maximum(np.abs(y_ - y0), np.abs(y_ - y1)) * (1 + 1e-15)
            if square:
                wide = np.full(len(at), reach) + slack
                sure = np.where(far <= reach * (1 - 1e-15), reach, -1.0) - slack
            else:
                wide = np.sqrt(np.maximum(0, r2 * (1 + 1e-12) - near * near)) + slack
                sure = np.sqrt(np.maximum(0, r2 * (1 - 1e-12) - far * far)) - slack
            l0, h0 = np.searchsorted(x, x_ - wide), np.searchsorted(x, x_ + wide, "right")
            inside = sure > 0
            l1 = np.where(inside, np.searchsorted(x, x_ - sure), h0)
            h1 = np.where(inside, np.searchsorted(x, x_ + sure, "right"), h0)
            found = sums[np.maximum(l1, h1)] - sums[l1]
            first, size = np.concatenate((l0, h1)), np.concatenate((l1 - l0, h0 - h1))
            q = np.repeat(np.tile(np.arange(len(at)), 2), size)
            if len(q):
                i = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                dx, dy = x_[q] - x[i], y_[q] - cy[a:b][i]
                ok = (np.abs(dx) <= reach) & (np.abs(dy) <= reach) if square else dx * dx + dy * dy <= r2
                q, i = q[ok], i[ok]
                np.add.at(found.reshape(-1), q * types + code[a:b][i], weight[a:b][i])
            out[by[at]] += found
    return out


def boxes(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of the rows of each leaf: halves along the widest side until none has over ``most``."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            if len(at):
                out.append(at)
            continue
        side = v[at, int(np.argmax(np.ptp(v[at], axis=0)))]
        order = at[np.argpartition(side, len(at) // 2)]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def _first(row, col, d, ids, k: int):
    """The k least of each row by (distance, id)."""
    by = np.lexsort((ids[col], d, row))
    row, col, d = row[by], col[by], d[by]
    take = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[take], col[take], d[take]


def nearest_vectors(q, q_id, c, c_id, k: int, reach2=None):
    """The k nearest candidates of each query by (distance, id), its own id left out, at most ``reach2`` away: query, candidate, squared distance.

    Exact: a leaf of queries meets the leaves of candidates in order of their gap until none can be nearer than its worst k-th distance.
    Products of matrices with a slack choose which distances are computed, in single precision where its slack is small beside the bounds.
    """
    if not len(q) or not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    parts = boxes(c, 1024)
    low, high = (np.array([f(c[at], axis=0) for at in parts]) for f in (np.min, np.max))
    middle = c.mean(0)
    wide = [np.column_stack((-2 * (c[at] - middle), ((c[at] - middle) ** 2).sum(1))).T for at in parts]
    most = ((c - middle) ** 2).sum(1).max() + ((q - middle) ** 2).sum(1).max()
    # rounding of a product of d + 1 terms in 32 bits is under (d + 4) * 2**-24 times the sum of their sizes, which is under twice ``most``
    fine, coarse = 1e-11 * most, (c.shape[1] + 4) * 2.0**-22 * most
    narrow: list = []
    out = []
    for at in boxes(q, 512):
        x, own = q[at], q_id[at]
        gap = (np.maximum(0, np.maximum(low - x.max(0), x.min(0) - high)) ** 2).sum(1)
        one = np.column_stack((x - middle, np.ones(len(at))))
        norm = ((x - middle) ** 2).sum(1)
        bound = np.full(len(at), np.inf) if reach2 is None else reach2[at]
        row, col, about = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        new, size = [], 0
        slack, single = fine, False

        def known(row, col):
            """The k least of what is left, by their distances."""
            other = own[row] != c_id[col]
            row, col = row[other], col[other]
            d = ((c[col] - x[row]) ** 2).sum(1)
            ok = d <= bound[row]
            return _first(row[ok], col[ok], d[ok], c_id, k)

        order = np.argsort(gap, kind="stable")
        for n, p in enumerate(order):
            if gap[p] > bound.max() + slack:
                break
            near = thin @ narrow[p] if single else one @ wide[p]
            if not n and len(parts[p]) > k + 1:  # its own and k more
                bound = np.minimum(bound, np.partition(near, k, axis=1)[:, k] + norm + 2 * slack)
                if 1e-30 < most < 1e30 and coarse < 0.005 * np.median(bound):
                    narrow = narrow or [w.astype(np.float32) for w in wide]
                    slack, single, thin = coarse, True, one.astype(np.float32)
            limit = bound - norm + slack
            if single:
                limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
            hit = np.flatnonzero((near <= limit[:, None]).ravel())
            r = hit // len(parts[p])
            new.append((r, parts[p][hit - r * len(parts[p])], near.ravel()[hit] + norm[r]))
            size += len(hit)
            if size >= 2 * (k + 1) * len(at) or np.isinf(bound).any():
                row, col, about = (np.concatenate([old, *(v[i] for v in new)]) for i, old in enumerate((row, col, about)))
                new, size = [], 0
                # a row's least k + 1, its own among them, by sorting (row, distance in 32 bits); what is added covers the rounding
                key = (row.astype(np.uint64) << np.uint64(32)) | np.clip(about, 0, 3e38).astype(np.float32).view(np.uint32)
                key.sort()
                count = np.bincount(row, minlength=len(at))
                full = count > k
                last = (key[(np.cumsum(count) - count)[full] + k] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32).astype(np.float64)
                bound[full] = np.minimum(bound[full], np.where(last < 2.9e38, last * (1 + 1e-6) + 1e-30 + 2 * slack, np.inf))
                ok = about <= bound[row] + slack
                row, col, about = row[ok], col[ok], about[ok]
                if len(row) > 4 * (k + 1) * len(at):  # many at one distance
                    row, col, about = known(row, col)
                    count = np.bincount(row, minlength=len(at))
                    full = count >= k
                    bound[full] = np.minimum(bound[full], about[(np.cumsum(count) - 1)[full]])
        row, col, d = known(*(np.concatenate([old, *(v[i] for v in new)]) for i, old in enumerate((row, col))))
        out.append((at[row], col, d))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_outside(q, q_core, q_of, c, c_core, c_of, limit):
    """For each component of the queries its edge of least mutual reachability to a candidate of another: component, weight, query, candidate.

    Only edges below the component's ``limit`` (an array by component) count; their weight is the largest of both core distances and the distance.
    """
    best = limit.copy()
    of, to = np.full(len(limit), -1), np.full(len(limit), -1)
    parts = boxes(c, 1024)
    low, high = (np.array([f(c[at], axis=0) for at in parts]) for f in (np.min, np.max))
    middle = c.mean(0)
    slack = 1e-11 * (((c - middle) ** 2).sum(1).max() + ((q - middle) ** 2).sum(1).max())
    for at in boxes(q, 512):
        x, own = q[at], q_of[at]
        one = np.column_stack((x - middle, np.ones(len(at))))
        norm = ((x - middle) ** 2).sum(1)
        gap = (np.maximum(0, np.maximum(low - x.max(0), x.min(0) - high)) ** 2).sum(1)
        for p in np.argsort(gap, kind="stable"):
            bound = best[own]
            if gap[p] > bound.max() ** 2 + slack:
                break
            part = parts[p]
            about = one @ np.column_stack((-2 * (c[part] - middle), ((c[part] - middle) ** 2).sum(1))).T
            r, j = np.nonzero((about <= (bound**2 - norm + slack)[:, None]) & (own[:, None] != c_of[part][None, :]))
            j = part[j]
            w = np.maximum(np.maximum(np.sqrt(((c[j] - x[r]) ** 2).sum(1)), c_core[j]), q_core[at][r])
            ok = w < bound[r]
            r, j, w = r[ok], j[ok], w[ok]
            by = np.lexsort((j, r, w, own[r]))
            first = by[np.append(True, np.diff(own[r][by]) != 0)] if len(by) else by
            best[own[r[first]]], of[own[r[first]]], to[own[r[first]]] = w[first], at[r[first]], j[first]
    found = np.flatnonzero(of >= 0)
    return found, best[found], of[found], to[found]
