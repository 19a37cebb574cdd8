"""Plain sequential versions of the non-trivial operators, for small fixtures."""

import math
import random


def walk(n, seed, start=100.0, step=1.0, drift=0.0):
    """(open, high, low, close, volume) bars of a random walk on a coarse price grid."""
    r = random.Random(seed)
    out, price = [], start
    for _ in range(n):
        o = price
        c = max(5.0, round(o + r.gauss(drift, step), 1))
        h = round(max(o, c) + abs(r.gauss(0, step / 2)), 1)
        low = max(1.0, round(min(o, c) - abs(r.gauss(0, step / 2)), 1))
        out.append((o, h, min(low, o, c), c, float(r.randint(50, 499))))
        price = c
    return out


def smoothed(xs, alpha):
    out = []
    for x in xs:
        out.append(x if not out else out[-1] + alpha * (x - out[-1]))
    return out


def true_ranges(bars):
    out = []
    for i, (_, h, low, c, _) in enumerate(bars):
        p = bars[i - 1][3] if i else c
        out.append(max(h - low, abs(h - p), abs(low - p)))
    return out


def median(xs):
    xs = sorted(xs)
    m = len(xs) // 2
    return xs[m] if len(xs) % 2 else (xs[m - 1] + xs[m]) / 2


def effective_atr(bars):
    base = median([b[1] - b[2] for b in bars]) or 1.0
    raw = smoothed(true_ranges(bars), 1 / 14)
    return [a if i >= 13 and a > 0 else base for i, a in enumerate(raw)]


def pivots(bars, k=5):
    """[(idx, kind, price)] by index, high before low."""
    found = []
    for kind, col, best in (("high", 1, max), ("low", 2, min)):
        xs = [b[col] for b in bars]
        cands = [i for i in range(k, len(xs) - k) if xs[i] == best(xs[i - k : i + k + 1])]
        for j, i in enumerate(cands):
            if j and xs[cands[j - 1]] == xs[i] and i - cands[j - 1] <= 2:
                continue
            found.append((i, kind, xs[i]))
    return sorted(found, key=lambda t: (t[0], t[1] == "low"))


def level_breaks(bars, k=5):
    """[(idx, direction, swing idx)]: the first close beyond each level while it is the newest."""
    out = []
    for kind, direction in (("high", "bullish"), ("low", "bearish")):
        sw = [p for p in pivots(bars, k) if p[1] == kind]
        for j, (i, _, price) in enumerate(sw):
            end = sw[j + 1][0] + k if j + 1 < len(sw) else len(bars)
            for t in range(i + k, min(end, len(bars))):
                c = bars[t][3]
                if (c > price) if kind == "high" else (c < price):
                    out.append((t, direction, i))
                    break
    return sorted(out, key=lambda t: (t[0], t[1] == "bearish"))


def price_clusters(points, tol):
    """Groups of (price, idx) whose neighbours in price order are within ``tol``."""
    groups = []
    for p in sorted(points):
        if groups and p[0] - groups[-1][-1][0] <= tol:
            groups[-1].append(p)
        else:
            groups.append([p])
    return groups


def pool_hits(bars, k=5):
    """{(side, first idx, last idx): first piercing bar or None}."""
    atr = smoothed(true_ranges(bars), 1 / 14)[-1]
    out = {}
    for kind, side in (("high", "buy_side"), ("low", "sell_side")):
        pts = [(p, i) for i, s, p in pivots(bars, k) if s == kind]
        for g in price_clusters(pts, atr * 0.15):
            if len(g) < 2:
                continue
            # centres have twelve digits: a bar at the mean of its level touches it and no more
            level = float(f"{math.fsum(p for p, _ in g) / len(g):.12g}")
            first, last = min(i for _, i in g), max(i for _, i in g)
            hit = next(
                (
                    t
                    for t in range(last + 1, len(bars))
                    if (bars[t][1] > level if kind == "high" else bars[t][2] < level)
                ),
                None,
            )
            out[(side, first, last)] = hit
    return out
