"""How many of a cell's points are in each of many circles, without a row for each pair.

The points are cut into strips of latitude. In a strip the circle's half-width in longitude has a
least and a greatest value: points up to the least are counted by two binary searches in the
sorted longitudes, only those between the two are measured, by the formula of geo.haversine_km.
So the work for a circle grows with the root of the points in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..constants import EARTH_RADIUS_KM

#: Cosines are widened by SLACK, far more than they are rounded by; strips so near a pole, and circles so wide, are measured point by point.
SLACK, POLE, WIDEST, AT_ONCE = 1e-12, 89.9, 1.5, 1 << 17
RADIANS = np.pi / 180.0


def _span(start: np.ndarray, end: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of many ranges one after the other, and whose each is."""
    n = np.maximum(end - start, 0)
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - first, n), np.repeat(who, n)


def within(lat: np.ndarray, lng: np.ndarray, c_lat: np.ndarray, c_lng: np.ndarray, r: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    """For each circle, how many points are in it and in its limits (south, north, west, east)."""
    out = np.zeros(len(c_lat), np.int64)
    if not len(lat) or not len(c_lat):
        return out
    order = np.argsort(lat, kind="stable")
    lat, lng = lat[order], lng[order]
    cuts = np.unique(np.linspace(0, len(lat), max(1, int((0.4 * len(lat)) ** 0.5)) + 1).astype(np.int64))
    south, north, west, east = limits
    p, theta = c_lat * RADIANS, r / EARTH_RADIUS_KM
    sin_c, cos_c, odd = np.sin(p), np.cos(p), ~((theta >= 0) & (theta <= WIDEST)) | (np.abs(c_lat) > 90) | (np.abs(c_lng) > 180)
    with np.errstate(all="ignore"):
        cos_t = np.cos(theta)
        top = np.arcsin(np.clip(sin_c / cos_t, -1, 1))  # where a circle is widest
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            y0, y1 = lat[s], lat[e - 1]
            k = np.flatnonzero((south <= y1) & (north >= y0))
            if not len(k):
                continue
            x = lng[s:e]
            place = np.argsort(x, kind="stable")
            x, y = x[place], lat[s:e][place]
            q, slack = [], []  # the cosine of the half-width at the strip's ends and where it is greatest
            for v in (y0 * RADIANS, y1 * RADIANS, np.clip(top[k], y0 * RADIANS, y1 * RADIANS)):
                slack.append(SLACK / (np.cos(v) * cos_c[k]))
                q.append((cos_t[k] - np.sin(v) * sin_c[k]) * (slack[-1] / SLACK))
            far = np.maximum(q[0] + slack[0], q[1] + slack[1])
            near = np.minimum(np.minimum(q[0] - slack[0], q[1] - slack[1]), q[2] - slack[2])
            least = np.where(far > 1, -1.0, np.arccos(np.clip(far, -1, 1)) / RADIANS)
            most = np.where(near > 1, -1.0, np.arccos(np.clip(near, -1, 1)) / RADIANS)
            whole = far <= -1  # every longitude
            plain = ~(odd[k] | np.isnan(far) | np.isnan(near) | (max(abs(y0), abs(y1)) > POLE))
            inner = plain & (south[k] <= y0) & (north[k] >= y1)
            least = np.where(inner, least, -1.0)
            every = ~plain | (near <= -1)  # the widest part may have every longitude
            lo, hi = np.searchsorted(x, west[k], "left"), np.searchsorted(x, east[k], "right")
            if (full := inner & whole).any():
                out[k[full]] += (hi - lo)[full]
            ranges = []
            if (u := np.flatnonzero(every & ~full)).size:
                ranges.append((lo[u], hi[u], k[u]))
            u = np.flatnonzero(~every & ~full & (most >= 0) & (hi > lo))
            for turn in (0.0, 360.0, -360.0):
                at, w, n = c_lng[k[u]] + turn, most[u], least[u]
                some = (at + w >= west[k[u]]) & (at - w <= east[k[u]])
                v, at, w, n = u[some], at[some], w[some], n[some]
                if not len(v):
                    continue
                a = np.maximum(np.searchsorted(x, at - w, "left"), lo[v])
                z = np.maximum(np.minimum(np.searchsorted(x, at + w, "right"), hi[v]), a)
                b = np.where(n >= 0, np.clip(np.searchsorted(x, at - n, "left"), a, z), z)
                c = np.where(n >= 0, np.clip(np.searchsorted(x, at + n, "right"), b, z), z)
                out[k[v]] += c - b  # each circle is in v once
                ranges += [(a, b, k[v]), (c, z, k[v])]
            for start, end, who in ranges:
                cut = np.searchsorted(np.cumsum(np.maximum(end - start, 0)), np.arange(AT_ONCE, int(np.maximum(end - start, 0).sum()), AT_ONCE))
                for some in np.split(np.arange(len(who)), np.unique(cut)):
                    i, w = _span(start[some], end[some], who[some])
                    if not len(i):
                        continue
                    a, f, g = y[i], p[w], y[i] * RADIANS
                    h = np.sin((g - f) / 2) ** 2 + cos_c[w] * np.cos(g) * np.sin((x[i] * RADIANS - c_lng[w] * RADIANS) / 2) ** 2
                    ok = (2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= r[w]) & (a >= south[w]) & (a <= north[w])
                    out += np.bincount(w[ok], minlength=len(out))
    return out


def counts(points: pa.Table, circles: pa.Table) -> pa.Table:
    """qid, n of one cell's circles that hold some of its points; of rows with equal id and z_ord one counts."""
    of = lambda t, name: t.column(name).to_numpy()
    id = points.column("id")
    known, id, z = id.is_valid().to_numpy(), id.fill_null(0).to_numpy(), of(points, "z_ord")
    order = np.lexsort((z, id, known))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(z[order]) != 0) | (np.diff(id[order]) != 0) | (known[order][1:] != known[order][:-1])
    order = order[new]
    n = within(of(points, "lat_q")[order], of(points, "lng_q")[order], of(circles, "c_lat"), of(circles, "c_lng"), of(circles, "r"), [of(circles, c) for c in ("min_lat", "max_lat", "min_lng", "max_lng")])
    some = np.flatnonzero(n)
    return pa.table({"qid": circles.column("qid").take(pa.array(some)), "n": pa.array(n[some], pa.int64())})
