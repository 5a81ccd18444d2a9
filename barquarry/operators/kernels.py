"""Numpy kernels over trailing windows of bars: profile, quiet phase, patterns, confluence, trade plan, structure, mixture.

A kernel sees one block of a symbol's bars and no Spark.  Indicators are computed for all
windows of the block at once, as a matrix (window, bar in window); only what differs in
size from window to window (the histogram and its nodes) is done window by window.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

TINY = 1e-12
CHUNK = 2048  # bars that are spread over the bins at once


class Profile(NamedTuple):
    low: float
    high: float
    size: float
    centers: np.ndarray
    hist: np.ndarray
    poc_bin: int
    val_bin: int
    vah_bin: int
    hvn: list[tuple[float, float]]  # (price, volume), strongest first
    lvn: list[tuple[float, float]]  # emptiest first
    n_bars: int

    @property
    def poc(self) -> float:
        return float(self.centers[self.poc_bin])

    @property
    def val(self) -> float:
        return float(self.centers[self.val_bin])

    @property
    def vah(self) -> float:
        return float(self.centers[self.vah_bin])


def true_range(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Along the last axis; the first bar has no close before it."""
    out = h - lo
    before = c[..., :-1]
    out[..., 1:] = np.maximum(out[..., 1:], np.maximum(np.abs(h[..., 1:] - before), np.abs(lo[..., 1:] - before)))
    return out


def spread(h: np.ndarray, lo: np.ndarray, amount: np.ndarray, edges: np.ndarray, flat: float = 0.0) -> np.ndarray:
    """Each bar's amount over the bins that it overlaps; a bar of no height into its bin."""
    n = len(edges) - 1
    out = np.zeros(n)
    thin = h - lo <= flat
    if thin.any():
        at = np.clip((lo[thin] - edges[0]) / (edges[1] - edges[0]), 0, n - 1).astype(np.int64)
        np.add.at(out, at, amount[thin])
    h, lo, amount = h[~thin], lo[~thin], amount[~thin]
    for a in range(0, len(h), CHUNK):
        own = slice(a, a + CHUNK)
        share = np.minimum(h[own, None], edges[1:]) - np.maximum(lo[own, None], edges[:-1])
        out += (amount[own] / (h[own] - lo[own])) @ np.clip(share, 0, None)
    return out


def value_area(hist: np.ndarray, poc: int, share: float = 0.70) -> tuple[int, int]:
    """From the point of control outwards by pairs of bins, the heavier side first (ties up)."""
    need, inside, low, high, last = share * float(hist.sum()), float(hist[poc]), poc, poc, len(hist) - 1
    while inside < need and (low > 0 or high < last):
        up = float(hist[high + 1 : high + 3].sum()) if high < last else -1.0
        down = float(hist[max(low - 2, 0) : low].sum()) if low > 0 else -1.0
        if up >= down:
            inside, high = inside + up, min(high + 2, last)
        else:
            inside, low = inside + down, max(low - 2, 0)
    return low, high


def smoothed(hist: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian filter cut at four sigmas, the ends mirrored."""
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(hist, radius, mode="symmetric"), w / w.sum(), "valid")


def peaks(signal: np.ndarray, prominence: float) -> list[int]:
    """Local maxima (a flat top counts at its middle, the ends never) of at least that prominence."""
    first = np.flatnonzero(np.diff(signal, prepend=np.nan) != 0)
    level = signal[first]
    end = np.append(first[1:], len(signal)) - 1
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    out = []
    for k in top.tolist():
        at = int(first[k] + end[k]) // 2
        left, right = np.flatnonzero(signal[:at] > signal[at]), np.flatnonzero(signal[at + 1 :] > signal[at])
        a = int(left[-1]) + 1 if len(left) else 0
        z = at + 1 + int(right[0]) if len(right) else len(signal)
        if signal[at] - max(signal[a : at + 1].min(), signal[at:z].min()) >= prominence:
            out.append(at)
    return out


def profile(h, lo, c, v, mode: str = "auto", n_bins: int = 100, bin_size: float | None = None, share: float = 0.70, most_nodes: int = 5) -> Profile | None:
    """The volume profile of some bars; None if no bar is valid. mode: auto (a quarter of the last 14 bars' mean true range a bin) or fixed."""
    keep = np.isfinite(h) & np.isfinite(lo) & np.isfinite(c) & np.isfinite(v) & (v > 0) & (h >= lo)
    if not keep.all():
        h, lo, c, v = h[keep], lo[keep], c[keep], v[keep]
    if not len(h):
        return None
    low, high = float(lo.min()), float(h.max())
    if high <= low:
        pad = abs(low) * 1e-6 + 1e-9
        low, high = low - pad, high + pad
    if mode == "auto":
        width = 0.25 * float(true_range(h, lo, c)[-14:].mean())
        n = max(20, min(500, round((high - low) / width))) if width > 0 else max(20, min(500, n_bins))
        edges = np.linspace(low, high, n + 1)
    elif bin_size:
        n = max(math.ceil((high - low) / bin_size), 1)
        n += low + bin_size * n < high
        edges = low + bin_size * np.arange(n + 1)
    else:
        edges = np.linspace(low, high, n_bins + 1)
    centers = (edges[:-1] + edges[1:]) / 2
    hist = spread(h, lo, v, edges)
    poc = int(hist.argmax())
    val, vah = value_area(hist, poc, share)
    hvn, lvn = nodes(hist, centers, poc, most_nodes)
    return Profile(low, high, bin_size if bin_size and mode != "auto" else float(edges[1] - edges[0]), centers, hist, poc, val, vah, hvn, lvn, len(h))


def nodes(hist: np.ndarray, centers: np.ndarray, poc: int, most: int = 5, prominence: float = 0.10) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """High and low volume nodes as (price, volume)."""
    if len(hist) < 3 or not most:
        return [(float(centers[poc]), float(hist[poc]))][:most], []
    s = smoothed(hist)
    top = float(s.max())
    if top <= 0:
        return [], []
    tall = sorted({poc, *peaks(s, prominence * top)}, key=lambda i: (-hist[i], i))
    deep = sorted(peaks(top - s, prominence * top), key=lambda i: (hist[i], i)) if len(hist) >= 5 else []
    return [(float(centers[i]), float(hist[i])) for i in tall[:most]], [(float(centers[i]), float(hist[i])) for i in deep[:most]]


# ---- indicators of all windows: matrices (window, bar) ----


def rolling(m: np.ndarray, n: int, least: int, what) -> np.ndarray:
    """what(frames, axis=-1) of the last n bars of each bar; of fewer, from `least` on, where the window begins."""
    out = np.full(m.shape, np.nan)
    for t in range(least - 1, min(n - 1, m.shape[1])):
        out[:, t] = what(m[:, : t + 1], axis=-1)
    if m.shape[1] >= n:
        out[:, n - 1 :] = what(sliding_window_view(m, n, axis=1), axis=-1)
    return out


def wilder(tr: np.ndarray, n: int = 14) -> np.ndarray:
    """a(0) = tr(0), a(t) = a(t-1) + (tr(t) - a(t-1)) / n; nan before n bars."""
    out, now = np.full(tr.shape, np.nan), tr[:, 0]
    for t in range(tr.shape[1]):
        now = now + (tr[:, t] - now) / n
        if t >= n - 1:
            out[:, t] = now
    return out


def slopes(m: np.ndarray, n: int, least: int) -> np.ndarray:
    """Least-squares slope of the last n bars; nan where any of them is nan."""

    def slope(frames, axis=-1):
        k = np.arange(frames.shape[-1]) - (frames.shape[-1] - 1) / 2
        return (frames @ k) / (k @ k)

    return rolling(m, n, least, slope)


def rank_of_last(m: np.ndarray, n: int, least: int) -> np.ndarray:
    """Share of the last n bars that are not above the last one; nan if that or too many are nan."""
    frame = m[:, -n:]
    good = ~np.isnan(m[:, -1]) & ((~np.isnan(frame)).sum(1) >= least)
    return np.where(good, (frame <= m[:, -1:]).sum(1) / frame.shape[1], np.nan)


def bandwidth(frames: np.ndarray, axis: int = -1) -> np.ndarray:
    mean = frames.mean(axis)
    return 4 * frames.std(axis) / np.where(mean == 0, np.nan, mean)


class Windows:
    """The windows that end at some bars of a block, and what quiet phases and patterns need of them."""

    def __init__(self, open_, h, lo, c, v, ends: np.ndarray, lookback: int):
        def cut(x):
            return sliding_window_view(x, lookback)[ends - lookback + 1]

        self.open, self.high, self.low, self.close, self.volume = (cut(x) for x in (open_, h, lo, c, v))
        self.n = lookback
        self.atr = wilder(true_range(self.high, self.low, self.close))
        self.volume_mean = rolling(self.volume, 20, 10, np.mean)

    def quiet(self, baseline: int = 100, threshold: float = 60.0) -> dict[str, np.ndarray]:
        """The last bar's ranks of volatility, volume and range, their mean complement as a score, and whether that is quiet."""
        ranks = [rank_of_last(m, baseline, max(3, baseline // 4)) for m in (self.atr, self.volume_mean, rolling(self.close, 20, 10, bandwidth))]
        score = 100 * (3 - sum(ranks)) / 3
        falling = slopes(self.volume_mean, 20, 10)[:, -1] < 0
        return {"ranks": np.stack(ranks, 1), "score": np.where(np.isnan(score), 0.0, score), "quiet": score >= threshold, "falling": falling}

    def events(self, recency: int | None = 10) -> list[list[dict]]:
        """Per window the dry-ups, climaxes, divergences and accumulations whose anchor is at most `recency` bars old (None: all), by anchor."""
        v, c = self.volume, self.close
        nan = np.nan
        base = rolling(v, 60, 30, np.mean)
        dry = self.volume_mean / np.where(base == 0, nan, base)
        ratio = v / np.where(self.volume_mean == 0, nan, self.volume_mean)
        wide = (self.high - self.low) / np.where(self.atr == 0, nan, self.atr)
        mean_v = rolling(v, 20, 20, np.mean)
        rise, flow = slopes(c, 20, 10) / rolling(c, 20, 20, np.mean), slopes(v, 20, 10) / np.where(mean_v == 0, nan, mean_v)
        moved = np.full(c.shape, nan)
        moved[:, 20:] = np.abs(c[:, 20:] - c[:, :-20])
        span = (rolling(self.high, 20, 20, np.max) - rolling(self.low, 20, 20, np.min)) / c
        whole = rolling(v, 60, 60, np.mean)
        coil = (moved < 2 * self.atr) & (span < rolling(span, 60, 60, np.median)) & (self.volume_mean < whole)
        depth = np.clip(1 - self.volume_mean / np.where(whole == 0, nan, whole), 0, 1)
        oldest = 0 if recency is None else self.n - 1 - recency
        out: list[list[dict]] = [[] for _ in range(len(c))]

        def add(w, kind, direction, at, strength, start, end):
            if at >= oldest:
                out[w].append({"kind": kind, "direction": direction, "anchor": at, "price": float(c[w, at]), "volume": float(v[w, at]), "strength": float(strength), "start": start, "end": end, "atr": float(self.atr[w, at])})

        for w, a, z in runs(dry <= 0.5, 3, oldest):
            at = a + int(dry[w, a : z + 1].argmin())
            add(w, "dry_up", "neutral", at, 1 - dry[w, at], a, z)
        for w, a, z in runs((ratio >= 2.5) & (wide >= 1.5), 1, oldest):
            at = a + int(ratio[w, a : z + 1].argmax())
            add(w, "climax", "bearish" if c[w, at] >= self.open[w, at] else "bullish", at, ratio[w, at], a, z)
        for direction, flag in (("bearish", (rise > 5e-4) & (flow < -5e-4)), ("bullish", (rise < -5e-4) & (flow < -5e-4))):
            for w, a, z in runs(flag, 3, oldest):
                add(w, "divergence", direction, z, abs(flow[w, z]) / 5e-4, a, z)
        for w, a, z in runs(coil, 5, oldest):
            add(w, "accumulation", "bullish", z, depth[w, z] if np.isfinite(depth[w, z]) else 0.5, a, z)
        for own in out:
            own.sort(key=lambda e: e["anchor"])
        return out


def runs(flag: np.ndarray, least: int, oldest: int):
    """(window, first, last) of unbroken runs of at least `least` bars that reach to bar `oldest` or beyond."""
    edge = np.diff(flag.astype(np.int8), axis=1, prepend=0, append=0)
    w, a = np.nonzero(edge == 1)
    z = np.nonzero(edge == -1)[1] - 1
    keep = (z - a + 1 >= least) & (z >= oldest)
    return zip(w[keep].tolist(), a[keep].tolist(), z[keep].tolist())


# ---- texts ----

# The wording of readings, events, reasons and plans
KIND = {"dry_up": "Volume dry-up", "climax": "Volume climax", "divergence": "divergence", "accumulation": "Possible accumulation"}
FADES = {"bearish": "price rising while volume fades — rally lacks participation", "bullish": "price falling on shrinking volume — selling pressure waning"}
LEADS = {"bullish": "Bullish setup", "bearish": "Bearish setup", "neutral": "Neutral / balanced setup"}


def nearest_level(price: float, p: Profile | None, tolerance: float) -> str | None:
    """The profile's level that is strictly nearer than the tolerance, as text; ties go to the more important kind."""
    if p is None or not math.isfinite(tolerance) or tolerance <= 0:
        return None
    levels = [("POC", p.poc), ("VAH", p.vah), ("VAL", p.val), *(("HVN", x) for x, _ in p.hvn), *(("LVN", x) for x, _ in p.lvn)]
    name, level = min(levels, key=lambda x: abs(price - x[1]))
    return f"{name} {level:.2f}" if abs(price - level) < tolerance else None


def explain_event(e: dict, level: str | None) -> str:
    n, near = e["end"] - e["start"] + 1, f" near {level}" if level else ""
    if e["kind"] == "dry_up":
        return f"{KIND['dry_up']}: {n} bars with volume ≤50% of its longer-term baseline (low {1 - e['strength']:.0%}) — supply thinning, watch for expansion{near}."
    if e["kind"] == "climax":
        at = f" at {level}" if level else ""
        return f"{KIND['climax']}: {e['strength']:.1f}× average volume on a wide bar ({'buying' if e['direction'] == 'bearish' else 'selling'} climax){at} — potential exhaustion / reversal."
    if e["kind"] == "divergence":
        return f"{e['direction'].title()} volume divergence over {n} bars: {FADES[e['direction']]}."
    return f"{KIND['accumulation']}: {n} bars coiling in a tight, flat range on below-average volume{near}."


def explain_quiet(ranks, score: float, quiet: bool, falling: bool) -> str:
    volatility, volume, span = (float(x) for x in ranks)
    found = []
    if 1 - volatility >= 0.6:
        found.append(f"volatility in the bottom {volatility * 100:.0f}% of its range")
    if 1 - volume >= 0.6:
        found.append(f"volume in the bottom {volume * 100:.0f}% {'and falling' if falling else 'and flat'}")
    if 1 - span >= 0.6:
        found.append(f"price range compressed (bottom {span * 100:.0f}%)")
    if quiet:
        return f"Quiet phase (score {score:.0f}/100): {'; '.join(found) or 'all energy gauges subdued'}."
    if not found:
        return f"Active / normal (score {score:.0f}/100): volatility, volume and range near typical levels."
    return f"Mixed (score {score:.0f}/100): {'; '.join(found)} — but not yet below the quiet threshold."


def shortened(text: str, most: int = 70) -> str:
    head = text.split(" — ")[0].split(":")[0]
    return head if len(head) <= most else head[:most] + "…"


# ---- confluence ----

WEIGHTS = {"value_area": 1.0, "key_level": 1.0, "quiet": 1.5, "patterns": 1.5}
BAND, RECENCY = 10.0, 10


class Part(NamedTuple):
    name: str
    strength: float
    direction: int
    reason: str

    @property
    def worth(self) -> float:
        return WEIGHTS[self.name] * self.strength


def value_part(price: float, p: Profile) -> Part:
    at = (price - p.val) / max(p.vah - p.val, 1e-9)
    if at < 0:
        return Part("value_area", min(0.98, 0.9 - at * 0.25), 1, f"below value (under VAL {p.val:.2f}) — stretched, reversion pull up")
    if at > 1:
        return Part("value_area", min(0.98, 0.9 + (at - 1) * 0.25), -1, f"above value (over VAH {p.vah:.2f}) — stretched, reversion pull down")
    strength = 0.2 + 0.7 * abs(2 * at - 1)
    if at <= 0.45:
        return Part("value_area", strength, 1, f"near value-area low (VAL {p.val:.2f}) — bounce zone")
    if at >= 0.55:
        return Part("value_area", strength, -1, f"near value-area high (VAH {p.vah:.2f}) — rejection zone")
    return Part("value_area", strength, 0, f"balanced inside the value area (POC {p.poc:.2f})")


def level_part(price: float, p: Profile, atr: float) -> Part:
    reach, far = 0.5 * atr, (float("inf"), 0.0)
    tall = min(((abs(price - x), x) for x, _ in p.hvn), key=lambda d: d[0], default=far)
    deep = min(((abs(price - x), x) for x, _ in p.lvn), key=lambda d: d[0], default=far)
    if min(tall[0], deep[0]) > reach:
        return Part("key_level", 0.1, 0, "no major volume node nearby")
    if tall[0] <= deep[0]:
        strength = 0.3 + 0.6 * (1 - tall[0] / reach)
        if price >= tall[1]:
            return Part("key_level", strength, 1, f"holding above HVN {tall[1]:.2f} (support)")
        return Part("key_level", strength, -1, f"capped below HVN {tall[1]:.2f} (resistance)")
    return Part("key_level", 0.3 + 0.5 * (1 - deep[0] / reach), 0, f"inside LVN {deep[1]:.2f} (air pocket — fast moves)")


def quiet_part(score: float, quiet: bool) -> Part:
    said = f"quiet coil (score {score:.0f}/100) — primed for a move" if quiet else f"active market (quiet score {score:.0f}/100)"
    return Part("quiet", max(0.0, min(1.0, score / 100)), 0, said)


def event_force(e: dict) -> tuple[int, float]:
    """(direction, strength) of an event."""
    s = e["strength"] if math.isfinite(e["strength"]) else 0.0
    side = 1 if e["direction"] == "bullish" else -1
    return {"accumulation": (1, min(1.0, max(0.4, s))), "dry_up": (0, min(1.0, max(0.3, s))), "divergence": (side, 0.6), "climax": (side, min(1.0, max(0.3, (s - 1) / 3)))}[e["kind"]]


def pattern_part(events: list[dict], n: int) -> Part:
    """events: those of the last RECENCY bars, in order, each with its text."""
    if not events:
        return Part("patterns", 0.0, 0, "no recent volume patterns")
    signed = total = most = 0.0
    for e in events:
        side, strength = event_force(e)
        w = strength * max(0.0, min(1.0, 1 - (n - 1 - e["anchor"]) / RECENCY))
        signed, total, most = signed + side * w, total + w, max(most, w)
    lean = signed / total if total > 0 else 0.0
    newest = max(events, key=lambda e: e["anchor"])
    said = shortened(newest["text"])
    return Part("patterns", min(1.0, most), (lean > 0.15) - (lean < -0.15), f"{len(events)} active; latest: {said}" if len(events) > 1 else said)


def confluence(parts: list[Part]) -> tuple[float, float, str, str]:
    """(quality, bias score, both to 2 places; bias; rationale)."""
    whole = sum(WEIGHTS.values())
    quality = 100 * sum(x.worth for x in parts) / whole
    lean = 100 * sum(x.worth * x.direction for x in parts) / whole
    bias = "bullish" if lean > BAND else "bearish" if lean < -BAND else "neutral"
    ranked = sorted(parts, key=lambda x: -x.worth)
    leads = [x.reason for x in ranked if x.strength >= 0.25][:2]
    said = f"{LEADS[bias]} (quality {quality:.0f}/100): {'; '.join(leads) or 'little decisive evidence yet'}."
    against = {"bullish": -1, "bearish": 1}.get(bias)
    caution = [x.reason for x in ranked if against and x.direction == against and x.strength >= 0.4]
    return round(quality, 2), round(lean, 2), bias, said + (f" Caution: {caution[0]}." if caution else "")


def plan(side: int, price: float, p: Profile, atr: float, style: str = "reversion", stop_atr: float = 1.5, buffer: float = 0.25, trigger: float = 0.10, target_rr: float = 2.0) -> tuple[float, float, list[float]]:
    """(entry, stop, at most two targets, the nearer first) from the profile's levels."""
    levels = sorted({p.poc, p.vah, p.val, *(x for x, _ in p.hvn)}, reverse=side < 0)  # in the trade's direction
    eps = 0.05 * atr
    ahead, behind = [x for x in levels if side * (x - price) > eps], [x for x in levels if side * (x - price) < -eps]
    if style == "reversion":
        entry = price
        stop = behind[-1] - side * buffer * atr if behind else entry - side * stop_atr * atr
        targets = [x for x in (p.poc, p.vah if side > 0 else p.val) if side * (x - price) > eps]
    else:
        entry = (ahead[0] if ahead else price) + side * trigger * atr
        stop = entry - side * stop_atr * atr
        targets = [x for x in levels if side * (x - entry) > eps][:1]
    if side * (entry - stop) <= 0:
        stop = entry - side * stop_atr * atr
    targets = sorted({x for x in targets if side * (x - entry) > eps}, reverse=side < 0)[:2]
    return entry, stop, targets or [entry + side * abs(entry - stop) * target_rr]


def signal(price, atr, p: Profile, quality, lean, bias, rationale, quiet_score, style="reversion", least_quality=55.0, least_bias=15.0, least_quiet: float | None = None, least_rr=1.5, budget=100.0) -> dict:
    """The trade that a confluence score allows, or the first reason against it. budget: money at risk."""
    side = {"bullish": 1, "bearish": -1}.get(bias, 0)
    reason = None
    if not side:
        reason = "no directional bias"
    elif quality < least_quality:
        reason = f"setup quality {quality:.0f} below minimum {least_quality:.0f}"
    elif abs(lean) < least_bias:
        reason = f"directional conviction {abs(lean):.0f} below minimum {least_bias:.0f}"
    elif least_quiet is not None and quiet_score < least_quiet:
        reason = f"not a quiet phase (quiet score {quiet_score:.0f})"
    if reason:
        return {"action": "NO_TRADE", "reason": reason}
    entry, stop, targets = plan(side, price, p, atr, style)
    risk = abs(entry - stop)
    if risk <= 0:
        return {"action": "NO_TRADE", "reason": "degenerate stop (zero risk)"}
    rr = abs(targets[0] - entry) / risk
    if rr < least_rr:
        return {"action": "NO_TRADE", "reason": f"risk:reward {rr:.2f} below minimum {least_rr:.2f}"}
    out = {"side": side, "entry": round(entry, 6), "stop": round(stop, 6), "targets": [round(x, 6) for x in targets], "risk": risk, "rr": round(rr, 3), "size": float(math.floor(budget / risk))}
    if out["size"] <= 0:
        return out | {"action": "NO_TRADE", "reason": f"risk budget ({budget:.2f}) too small to size one unit at {risk:.2f}/unit risk"}
    verb, how = ("Long" if side > 0 else "Short"), ("fade toward value" if style == "reversion" else "trade the breakout")
    said = f"{verb} ({style}, {how}): {rationale} Plan: enter {entry:.2f}, stop {stop:.2f}, first target {targets[0]:.2f} (R:R {rr:.2f})."
    return out | {"action": verb.upper(), "reason": said}


# ---- structure of a profile ----


def structure(h, lo, c, v, p: Profile, half_life: float = 21.0) -> dict[str, float]:
    """The structural features that one window gives by itself."""
    edges = p.low + (p.high - p.low) / len(p.hist) * np.arange(len(p.hist) + 1)
    span = h - lo
    place = np.clip(np.where(span > TINY, (2 * c - h - lo) / np.where(span > TINY, span, 1), 0), -1, 1)
    volume, delta = spread(h, lo, v, edges, TINY), spread(h, lo, v * place, edges, TINY)
    at = int(np.abs(p.centers - p.poc).argmin())

    def share(d, of):
        return float(np.clip(d / of, -1, 1)) if of > TINY else 0.0

    total = p.hist.sum()
    mean = float((p.centers * p.hist).sum() / total)
    d = p.centers - mean
    m2, m3, m4 = (float((p.hist * d**k).sum() / total) for k in (2, 3, 4))
    skew, kurtosis = (m3 / m2**1.5, m4 / m2**2) if m2 > TINY else (0.0, 3.0)
    where = float(np.clip((p.poc - p.low) / (p.high - p.low), 0, 1)) if p.high - p.low > TINY else 0.5
    jumps = np.abs(np.diff(p.hist))
    ledges = int((jumps > 3 * np.diff(p.hist).std()).sum()) if len(p.hist) >= 4 else 0
    outer = max(1, round(0.02 * len(p.hist)))
    aged = spread(h, lo, v * 0.5 ** ((len(v) - 1 - np.arange(len(v))) / half_life), edges, TINY)
    return {
        "delta_net": share(delta.sum(), volume.sum()), "delta_poc": share(delta[at], volume[at]), "skew": skew, "kurtosis": kurtosis, "poc_loc": where, "n_ledges": float(ledges),
        "poor_high": float(len(p.hist) >= 5 and p.hist[-outer:].mean() > 0.5 * p.hist.mean()), "shape": shape(p.hist, skew, where), "aged_poc": float(p.centers[aged.argmax()]),
    }


def shape(hist: np.ndarray, skew: float, where: float) -> int:
    """0 unknown, 1 P, 2 b, 3 D, 4 B (two distributions)."""
    s = smoothed(hist) if len(hist) >= 3 else hist
    top = peaks(s, 0.15 * float(s.max())) if len(hist) >= 3 else []
    if len(top) == 2 and hist[top[0] : top[1] + 1].min() < 0.20 * hist.mean():
        return 4
    if skew < -0.5 and where > 0.7:
        return 1
    if skew > 0.5 and where < 0.3:
        return 2
    return 3 if abs(skew) < 0.5 else 0


# ---- mixtures ----


class Mixture(NamedTuple):
    mean: np.ndarray
    sd: np.ndarray
    share: np.ndarray
    bic: float


def _bic(fit: float, k: int, n: float) -> float:
    return -2 * fit * n + (3 * k - 1) * math.log(max(n, 2.0))


def mixture(x: np.ndarray, w: np.ndarray, k: int, least_var: float = 1e-5, n: float | None = None, rounds: int = 100, close: float = 1e-7) -> Mixture:
    """Weighted normal mixture of k components in ascending x, by expectation and maximisation from weighted quantiles."""
    n = float(max(len(x), 1)) if n is None else n
    total = float(w.sum())
    if total <= TINY or (w > TINY).sum() < k:
        mean = float(w @ x / total) if total > TINY else float(x.mean()) if len(x) else 0.5
        return Mixture(np.array([mean]), np.array([math.sqrt(max(least_var, TINY))]), np.ones(1), _bic(0.0, 1, n))
    w = w / total
    mean = np.interp((np.arange(k) + 0.5) / k, w.cumsum() - w / 2, x)
    if k > 1 and np.ptp(mean) < 1e-3:
        mean = np.linspace(x[0] + 0.2 * (x[-1] - x[0]), x[-1] - 0.2 * (x[-1] - x[0]), k)
    var = np.full(k, max(least_var, float(w @ (x - w @ x) ** 2) / k))
    share, before, fit = np.full(k, 1 / k), -math.inf, 0.0
    for _ in range(rounds):
        each = share * np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
        all_of = each.sum(1) + TINY
        fit = float(w @ np.log(all_of))
        owned = w[:, None] * each / all_of[:, None]
        mass = owned.sum(0) + TINY
        mean = x @ owned / mass
        var = np.maximum((owned * (x[:, None] - mean) ** 2).sum(0) / mass, least_var)
        share = mass / mass.sum()
        if fit - before < close:
            break
        before = fit
    by = mean.argsort()
    return Mixture(mean[by], np.sqrt(var[by]), share[by], _bic(fit, k, n))


def mixtures(profiles: list[Profile], k: int, rounds: int = 100, close: float = 1e-7) -> list[Mixture]:
    """mixture() of each profile's bins in a range scaled to 0..1, all profiles at once; each stops for itself."""
    width, each = max(len(p.hist) for p in profiles), len(profiles)
    x, w, least, n = np.zeros((each, width)), np.zeros((each, width)), np.empty(each), np.empty(each)
    for i, p in enumerate(profiles):
        x[i, : len(p.hist)], w[i, : len(p.hist)] = (p.centers - p.low) / (p.high - p.low), p.hist
        least[i], n[i] = max((1 / (2 * len(p.hist))) ** 2, 1e-6), float(max(p.n_bars, 2))
    out: list[Mixture | None] = [None] * each
    good = (w.sum(1) > TINY) & ((w > TINY).sum(1) >= k)
    for i in np.flatnonzero(~good):
        out[i] = mixture(x[i, : len(profiles[i].hist)], profiles[i].hist, k, least[i], n[i])
    live = np.flatnonzero(good)
    x, w, floor = x[live], w[live] / w[live].sum(1, keepdims=True), least[live][:, None]
    mean = np.empty((len(live), k))
    for j, i in enumerate(live):
        own = slice(0, len(profiles[i].hist))
        a, b = x[j, own], w[j, own]
        mean[j] = np.interp((np.arange(k) + 0.5) / k, b.cumsum() - b / 2, a)
        if k > 1 and np.ptp(mean[j]) < 1e-3:
            mean[j] = np.linspace(a[0] + 0.2 * (a[-1] - a[0]), a[-1] - 0.2 * (a[-1] - a[0]), k)
    middle = (w * x).sum(1, keepdims=True)
    var = np.repeat(np.maximum(floor, (w * (x - middle) ** 2).sum(1, keepdims=True) / k), k, 1)
    share, before = np.full(mean.shape, 1 / k), np.full(len(live), -math.inf)
    for r in range(rounds):
        if not len(live):
            break
        dens = share[:, None] * np.exp(-0.5 * (x[:, :, None] - mean[:, None]) ** 2 / var[:, None]) / np.sqrt(2 * np.pi * var)[:, None]
        total = dens.sum(2) + TINY
        fit = (w * np.log(total)).sum(1)
        owned = dens * (w / total)[:, :, None]
        mass = owned.sum(1) + TINY
        mean = (owned * x[:, :, None]).sum(1) / mass
        var = np.maximum((owned * (x[:, :, None] - mean[:, None]) ** 2).sum(1) / mass, floor)
        share = mass / mass.sum(1, keepdims=True)
        done = (fit - before < close) | (r == rounds - 1)
        for j in np.flatnonzero(done):
            by = mean[j].argsort()
            out[live[j]] = Mixture(mean[j][by], np.sqrt(var[j][by]), share[j][by], _bic(float(fit[j]), k, n[live[j]]))
        live, x, w, floor, mean, var, share, before = (z[~done] for z in (live, x, w, floor, mean, var, share, fit))
    return out  # type: ignore[return-value]


MIXTURE = ["n_modes", "separation", "imbalance", "antimode_depth", "nearest", "zone", "gravity"]


def mixture_rows(profiles: list[Profile], closes: list[float], most: int = 3) -> list[list[float]]:
    """mixture_features of many profiles."""
    if not profiles:
        return []
    by_k = [mixtures(profiles, k) for k in range(1, most + 1)]
    return [mixture_features(p, c, list(fits)) for p, c, fits in zip(profiles, closes, zip(*by_k))]


def mixture_features(p: Profile, close: float, fits: list[Mixture]) -> list[float]:
    """Modes by BIC, and the geometry of the mixture of two in a range scaled to 0..1; see MIXTURE. fits: those of 1, 2, ... components."""
    span = p.high - p.low
    if len(p.hist) < 4 or span <= TINY or p.hist.sum() <= TINY or (p.hist > TINY).sum() < 2:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    at = float(np.clip((close - p.low) / span, -0.5, 1.5))
    best = min(fits, key=lambda f: f.bic)
    two = next((f for f in fits if len(f.mean) == 2), None)
    if two is None:
        return [float(len(best.mean)), 0.0, 0.0, 0.0, abs(at - fits[0].mean[0]), 0.0, at - float(fits[0].mean[0])]
    (a, b), (wa, wb), var = two.mean, two.share, two.sd**2
    depth = zone = 0.0

    def density(x):
        return (two.share * np.exp(-0.5 * (x[:, None] - two.mean) ** 2 / var) / np.sqrt(2 * np.pi * var)).sum(1)

    if b - a > 1e-4:
        grid = np.linspace(a, b, 64)
        d = density(grid)
        modal = two.share / np.sqrt(2 * np.pi * var)
        depth = float(np.clip(1 - d.min() / (modal.min() + TINY), 0, 1))
        zone = float(np.sign(at - grid[d.argmin()])) if depth > 0.02 else 0.0
    pooled = math.sqrt(float(two.share @ var) + TINY)
    return [float(len(best.mean)), float(b - a) / pooled, float(wb - wa), depth, float(min(abs(at - a), abs(at - b))), zone, float(at - (b if wb >= wa else a))]
