"""The ten detectors and the profile that runs them, as states of the keyed fold.

A detector is told of each event once and answers None (silent) or (score, expected, confidence). States are plain
objects, so the batch fold keeps them in a task and the stream keeps them, pickled, in Spark's state store.
"""

from __future__ import annotations

import math
from collections import OrderedDict, deque
from dataclasses import dataclass

import numpy as np

from .forest import Forest
from .sketches import CountMin, Distinct

#: Names of the detectors in the order of their ids.
NAMES = ("Volume", "Distribution", "Cardinality", "Burst", "Spectral", "ChangePoint", "RRCF", "MultiScale", "Behavioral", "Drift")
Answer = tuple[float, float, float] | None


@dataclass(frozen=True)
class Config:
    """What a profile can be told: smoothing and period of the volume forecast, histogram, warm-up and least scores."""

    alpha: float = 0.3
    beta: float = 0.1
    gamma: float = 0.1
    period: int = 24
    bins: int = 50
    low: float = 0.1
    high: float = 10_000.0
    decay: float = 0.999
    warmup: int = 100
    least_confidence: float = 0.5
    least_detector_score: float = 0.1
    least_score: float = 0.1
    adaptive: bool = True


class Ewma:
    """Mean and variance that forget by half every ``half_life`` values; the first value sets them."""

    __slots__ = ("alpha", "mean", "var")

    def __init__(self, half_life: float | None = None, alpha: float | None = None):
        self.alpha = 1 - math.exp(-math.log(2) / half_life) if alpha is None else alpha
        self.mean = self.var = None

    def update(self, x: float) -> float:
        if self.mean is None:
            self.mean, self.var = x, 0.0
        else:
            d = x - self.mean
            self.mean += self.alpha * d
            self.var = (1 - self.alpha) * (self.var + self.alpha * d * d)
        return self.mean


class Limit:
    """An adaptive threshold; ``score`` takes a value in and says how far it is above, 0 to 1.

    Kinds: ``sigma`` (mean and k deviations), ``percentile``, ``mad`` (median and k scaled median deviations, each deviation
    from the median at its own time) and ``median`` of those three. Percentile and mad are twice the mean below ten values.
    """

    def __init__(self, kind: str, size: int, k: float = 3.0, p: float = 0.95, low: float = 0.001, high: float = math.inf):
        self.kind, self.k, self.p, self.low, self.high = kind, k, p, low, high
        self.ewma = Ewma(alpha=2 / (size + 1) if kind == "sigma" else 0.1)
        self.values, self.far, self.limit, self.n = deque(maxlen=size), deque(maxlen=size), 0.0, 0

    def _sigma(self, k: float) -> float:
        return self.ewma.mean + k * max(math.sqrt(self.ewma.var), self.low)

    def _percentile(self) -> float:
        s = sorted(self.values)
        return s[int(self.p * (len(s) - 1))] if len(s) >= 10 else 2 * self.ewma.mean

    def _mad(self) -> float:
        return _median(self.values) + self.k * 1.4826 * _median(self.far) if len(self.far) >= 10 else 2 * self.ewma.mean

    def update(self, x: float) -> float:
        self.n += 1
        self.ewma.update(x)
        if self.kind == "sigma":
            limit = self._sigma(self.k)
        else:
            self.values.append(x)
            if self.kind == "percentile":
                limit = self._percentile()
            else:
                self.far.append(abs(x - _median(self.values)))
                limit = self._mad() if self.kind == "mad" else sorted((self._sigma(3.0), self._percentile(), self._mad()))[1]
        self.limit = min(max(limit, self.low), self.high)
        return self.limit

    def score(self, x: float) -> float:
        return max(0.0, min(x / self.update(x) - 1, 2.0)) / 2


def _median(values) -> float:
    s, n = sorted(values), len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


#: The named thresholds, as kind, size and factor or part.
PRESETS = {
    "volume": ("sigma", 50, {"k": 2.0}), "distribution": ("sigma", 100, {"k": 3.0}), "cardinality": ("percentile", 100, {"p": 0.95}),
    "burst": ("mad", 50, {"k": 3.0}), "conservative": ("median", 100, {"p": 0.95, "k": 3.0}),
}


def preset(name: str) -> Limit:
    kind, size, more = PRESETS[name]
    return Limit(kind, size, **more)


class HoltWinters:
    """Additive level, trend and season; the first period + 1 values only set level and trend and predict themselves."""

    def __init__(self, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, period: int = 24):
        self.rates, self.season, self.n, self.level, self.trend = (alpha, beta, gamma), [0.0] * period, 0, 0.0, 0.0

    def update(self, x: float) -> tuple[float, float]:
        (alpha, beta, gamma), n, i = self.rates, self.n, self.n % len(self.season)
        self.n += 1
        if n <= len(self.season):
            self.trend = 0.5 * self.trend + 0.5 * (x - self.level) if n else 0.0
            self.level = x
            return x, 0.0
        level, trend, season = self.level, self.trend, self.season[i]
        expected = level + trend + season
        self.level = alpha * (x - season) + (1 - alpha) * (level + trend)
        self.trend = beta * (self.level - level) + (1 - beta) * trend
        self.season[i] = gamma * (x - self.level) + (1 - gamma) * season
        return expected, x - expected


class Volume:
    def __init__(self, c: Config):
        self.forecast, self.rate, self.limit, self.last, self.n = HoltWinters(c.alpha, c.beta, c.gamma, c.period), Ewma(50), preset("volume"), None, 0

    def update(self, t: int, _uid, _x: float, warm: bool) -> Answer:
        if self.last is None:
            self.last = t
            return None
        gap = max(t - self.last, 1)
        self.last, self.n = t, self.n + 1
        expected, off = self.forecast.update(self.rate.update(1e9 / gap))
        if warm or self.n < 100:
            return None
        score = self.limit.score(abs(off))
        error = abs(off) / max(expected, 1.0)
        return (score, expected, 0.9 if error < 0.1 else 0.7 if error < 0.3 else 0.5) if score > 0 else None


class FadingHistogram:
    """Decayed counts in logarithmic bins. Instead of fading all bins, new values weigh ever more (rescaled at times)."""

    def __init__(self, bins: int, low: float, high: float, decay: float):
        self.low, self.high, self.decay, self.bins, self.total, self.unit = low, high, decay, [0.0] * bins, 0.0, 1.0
        self.scale = bins / math.log(high / low)

    def place(self, x: float) -> int:
        if x <= self.low:
            return 0
        return len(self.bins) - 1 if x >= self.high else min(int(math.log(x / self.low) * self.scale), len(self.bins) - 1)

    def share(self, x: float) -> float | None:
        return self.bins[self.place(x)] / self.total if self.total else None

    def rarity(self, x: float) -> float:
        """0 for more than half the weight in the value's bin, 1 below a thousandth, 0.5 of share at first."""
        p = self.share(x)
        p = 0.5 if p is None else p
        return 0.0 if p > 0.5 else 1.0 if p < 0.001 else 1 - 2 * p

    def mean(self) -> float:
        """Mean of the bins' geometric centres."""
        n, ratio = len(self.bins), self.high / self.low
        return sum(w * self.low * ratio ** ((i + 0.5) / n) for i, w in enumerate(self.bins)) / self.total if self.total else 0.0

    def add(self, x: float) -> None:
        self.unit /= self.decay
        if self.unit > 1e100:
            self.bins, self.total, self.unit = [w / self.unit for w in self.bins], self.total / self.unit, 1.0
        self.bins[self.place(x)] += self.unit
        self.total += self.unit

    def update(self, x: float) -> float:
        """1 / share of the value's bin before it (100 below a thousandth, 1 at first)."""
        p = self.share(x)
        self.add(x)
        return 1.0 if p is None else 100.0 if p < 0.001 else 1 / p


class Distribution:
    def __init__(self, c: Config):
        self.seen, self.limit = FadingHistogram(c.bins, c.low, c.high, c.decay), preset("distribution")

    def update(self, _t: int, _uid, x: float, _warm: bool) -> Answer:
        rarity = self.seen.update(x)
        score = self.limit.score(rarity)
        return (score, 0.0, 0.95 if rarity > 50 else 0.8 if rarity > 20 else 0.6 if rarity > 10 else 0.4) if score > 0 else None


class Cardinality:
    """Increase of the number of distinct ids an event, by a sketch whose size does not grow with the ids."""

    def __init__(self, p: int = 12):
        self.seen, self.known, self.velocity, self.limit = Distinct(p), 0.0, Ewma(100), preset("cardinality")

    def update(self, _t: int, uid, _x: float, _warm: bool) -> Answer:
        self.seen.add(uid)
        now = self.seen.count()
        new, self.known = max(now - self.known, 0.0), now
        usual = self.velocity.update(new)
        score = self.limit.score(new)
        return (score, usual, 0.95 if new > 10 * usual else 0.85) if score > 0 else None


class Cusum:
    """Two-sided cumulative sums with a head start, a V-mask over the last sums and a limit that adapts to them."""

    KEPT, SETTLED, HEAD_EVENTS, RESET = 20, 40, 10, 1000

    def __init__(self, target: float = 0.0, slack: float = 0.5, limit: float = 4.0, lead: int = 10, head: float = 0.5):
        self.target, self.slack, self.limit, self.lead, self.head = target, max(slack, 0.1), max(limit, 1.0), max(lead, 5), head
        self.up = self.down = 0.0
        self.n, self.age, self.sums, self.adapted = 0, 0, [], self.limit
        self.slope = math.tan(math.atan(slack / 2))

    def update(self, x: float) -> tuple[int, float]:
        """Side of an alarm (0 for none) and its severity."""
        floor = self.limit * self.head if self.n < self.HEAD_EVENTS else 0.0
        off = x - self.target
        self.up, self.down = max(self.up + off - self.slack, floor), max(self.down - off - self.slack, floor)
        sums = self.sums
        sums.append(max(self.up, self.down))
        if len(sums) > self.KEPT:
            del sums[0]
        if (m := len(sums)) >= 10:
            mean = sum(sums) / m
            self.adapted = max(mean + 3 * math.sqrt(sum((s - mean) ** 2 for s in sums) / m), self.limit)
        cut = self.adapted if self.n > self.KEPT * 2 else self.limit
        now, turned = sums[-1], False
        if m >= self.lead:
            for i in range(1, min(self.lead, m - 1) + 1):
                if abs(now - sums[-1 - i]) > i * self.slope:
                    turned = True
                    break
        side, severity = 0, 0.0
        if self.up > cut or (turned and self.up >= self.down and self.up > 0):
            side, severity, self.up = 1, min(self.up / cut, 2.0) / 2, 0.0
        elif self.down > cut or (turned and self.up < self.down):
            side, severity, self.down = -1, min(self.down / cut, 2.0) / 2, 0.0
        self.n, self.age = self.n + 1, self.age + 1
        if self.age > self.RESET:
            self.up, self.down, self.age, self.n = 0.0, 0.0, 0, 0 if self.head else self.n
        return side, severity


class Burst:
    def __init__(self):
        self.sums, self.gap, self.last, self.wait = Cusum(lead=5), Ewma(100), None, 50

    def update(self, t: int, _uid, _x: float, _warm: bool) -> Answer:
        if self.last is None:
            self.last = t
            return None
        gap, self.last = max(t - self.last, 0) / 1e6, t
        usual = self.gap.update(gap)
        if self.wait:
            self.wait -= 1
            return None
        side, severity = self.sums.update(max(usual - gap, 0.0))
        return (severity, usual, 0.75) if side else None


class Spectral:
    """Residual of the log spectrum of the last values, when they first fill the window and at every fifth event after."""

    def __init__(self, size: int = 24, sensitivity: float = 0.6, every: int = 5):
        self.values, self.size, self.sensitivity, self.every, self.n = deque(maxlen=size), size, sensitivity, every, 0
        self.mean, self.var, self.alpha, self.k = 0.0, 1.0, 2 / (size + 1), 2 + 2 * (1 - sensitivity)
        self.least, self.most = math.inf, -math.inf

    def raw(self) -> float:
        x = np.array(self.values)
        x = (x - x.mean()) / max(math.sqrt(((x - x.mean()) ** 2).mean()), 1e-10)
        size = np.abs(np.fft.rfft(x)) / len(x)
        size[0] = 0.0  # the mean of what is normalised; its rounding errors are no spectrum
        logs = np.log(size + 1e-10)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        a, b = np.maximum(np.arange(len(logs)) - 1, 0), np.minimum(np.arange(len(logs)) + 2, len(logs))
        rest = np.abs(logs - (sums[b] - sums[a]) / (b - a))
        return float((rest[-1] + rest[:3].mean()) / 2 * (1 + self.sensitivity))

    def step(self, x: float) -> tuple[float, bool]:
        self.values.append(x)
        self.n += 1
        if self.n < self.size or (self.n > self.size and self.n % self.every):
            return 0.0, False
        raw = self.raw()
        if self.n <= self.size:
            self.mean, self.var = raw, raw * raw + 0.1
        else:
            self.least, self.most = min(self.least, raw), max(self.most, raw)
            d = raw - self.mean
            self.mean += self.alpha * d
            self.var = max((1 - self.alpha) * (self.var + self.alpha * d * d), 0.01)
        limit = self.mean + self.k * math.sqrt(self.var)
        return min(raw / max(limit, 0.01), 2.0) / 2 if limit > 0 and raw > 0 else 0.0, raw > limit and raw > 0.1

    def update(self, _t: int, _uid, x: float, _warm: bool) -> Answer:
        score, odd = self.step(x)
        return (score, 0.0, 0.85) if odd and score > 0.15 else None


class ChangePoint:
    def __init__(self):
        self.sums, self.trend, self.last = Cusum(lead=8), Ewma(100), None

    def update(self, _t: int, _uid, x: float, _warm: bool) -> Answer:
        if self.last is None:
            self.last = x
            return None
        step, self.last = x - self.last, x
        side, severity = self.sums.update(self.trend.update(step))
        return (severity, 0.0, 0.8) if side else None


class Rrcf:
    def __init__(self, shingle: int = 10, seed: int = 0):
        self.forest, self.last, self.n = Forest(seed=seed), deque(maxlen=shingle), 0

    def update(self, _t: int, _uid, x: float, _warm: bool) -> Answer:
        self.last.append(x)
        self.n += 1
        if len(self.last) < self.last.maxlen:
            return None
        return self._answer(*self.forest.update(self.last))

    def judge(self, raw: float | None) -> Answer:
        """The answer to a value whose shingle's displacement is known (none: no shingle yet)."""
        self.n += 1
        return None if raw is None else self._answer(*self.forest.judge(raw))

    def _answer(self, score: float, odd: bool) -> Answer:
        return (score, 0.0, min(0.9 * score, 0.95)) if self.n > 20 and odd and score > 0.4 else None


class Scale:
    """Means of windows that start at the event that ended the one before, held against a forecast."""

    def __init__(self, seconds: int, half_life: float, tolerance: float, kept: int, period: int | None):
        self.length, self.tolerance, self.kept = seconds * 10**9, tolerance, kept
        self.usual, self.forecast = Ewma(half_life), HoltWinters(period=period) if period else None
        self.begun, self.sum, self.n, self.values, self.seasonal = None, 0.0, 0, [], None

    def update(self, t: int, x: float) -> tuple[float, float, float, bool] | None:
        """Mean, score, expected and season flag of the window that this event ends, if it does."""
        if self.begun is not None and self.n and max(t - self.begun, 0) >= self.length:
            mean = self.sum / self.n
            self.sum, self.n, self.begun = x, 1, t
            return self._window(mean)
        self.sum, self.n = self.sum + x, self.n + 1
        self.begun = t if self.begun is None else self.begun
        return None

    def _window(self, mean: float) -> tuple[float, float, float, bool]:
        usual = self.usual.update(mean)
        expected, off = self.forecast.update(mean) if self.forecast else (usual, abs(mean - usual))
        self.values = [*self.values, mean][-self.kept :]
        if self.seasonal is None and len(self.values) >= self.kept:
            size = np.abs(np.fft.rfft(self.values))[: min(self.kept // 2, 8)]
            self.seasonal = bool(size.max() > 0.4 * size.sum())
        over = max(off - max(self.tolerance * expected, 1.0), 0.0)
        return mean, min(over / max(expected, 1.0), 2.0) / 2, expected, bool(self.forecast and self.seasonal)


class MultiScale:
    #: Seconds, half-life, tolerance, windows kept, period and weight of each scale.
    SCALES = ((1, 5.0, 0.3, 10, None, 1.0), (60, 10.0, 0.2, 60, None, 0.8), (3600, 50.0, 0.15, 24, 24, 0.6), (86400, 100.0, 0.1, 7, 7, 0.4))

    def __init__(self):
        self.scales = [(Scale(*s[:-1]), s[-1]) for s in self.SCALES]

    def step(self, t: int, x: float) -> tuple[float, int, bool]:
        """Combined score, how many scales are above 0.5, and whether any has a season."""
        found = [(r, w) for r, w in ((s.update(t, x), w) for s, w in self.scales) if r]
        if not found:
            return 0.0, 0, False
        score, high = sum(r[1] * w for r, w in found) / sum(w for _, w in found), sum(r[1] > 0.5 for r, _ in found)
        return min(1.2 * score, 1.0) if high >= 2 else score, high, any(r[3] for r, _ in found)

    def update(self, t: int, _uid, x: float, _warm: bool) -> Answer:
        score, high, _ = self.step(t, x)
        return (score, 0.0, 0.75 + min(0.05 * high, 0.2)) if score > 0.6 else None


class Behaviour:
    """One id's habits: hours, speed, gaps, sizes, services and places; ``deviation`` is taken before the event counts.

    Services are counted in a sketch and services and places by number, so that the state does not grow with them.
    """

    MATURE = 50

    def __init__(self, low: float = 0.1):
        self.hours, self.n, self.speed, self.score, self.odd = [0] * 24, 0, 0.0, 0.0, 0
        self.gaps, self.sizes = FadingHistogram(20, low, 10_000.0, 0.999), FadingHistogram(20, low, 100_000.0, 0.999)
        self.services, self.variety, self.places = CountMin(), Distinct(10), Distinct(10)

    def deviation(self, t: int, gap: float, size: float, service) -> float:
        if self.n < self.MATURE:
            return 0.0
        parts = [0.3] if self.hours[t // (3600 * 10**9) % 24] < self.n // 24 // 2 else []
        ratio = 1 / max(gap, 1.0) / max(self.speed, 0.001)
        parts += [0.4 * min(ratio, 10.0) / 10] if ratio > 5 else []
        parts += [w * r for w, r in ((0.3, self.gaps.rarity(gap)), (0.2, self.sizes.rarity(size))) if r > 0.8]
        parts += [] if service in self.services else [0.3]
        worst = max(parts, default=0.0)
        self.score = 0.1 * worst + 0.9 * self.score
        self.odd += worst > 0.5
        return worst

    def add(self, t: int, gap: float, size: float, service, place=None) -> None:
        self.n += 1
        self.hours[t // (3600 * 10**9) % 24] += 1
        now = 1 / max(gap, 1.0)
        self.speed = now if self.speed == 0 else 0.1 * now + 0.9 * self.speed
        self.gaps.add(gap)
        self.sizes.add(size)
        self.services.add(service)
        self.variety.add(service)
        self.places.add(place)


class Behavioral:
    """A store of at most ``most`` behaviours by id; the one longest unused makes room and starts anew if met again."""

    def __init__(self, most: int = 10_000):
        self.store, self.last, self.most, self.evicted = OrderedDict(), (None, 0), max(most, 10), 0

    def step(self, t: int, uid, size: float, service, place=None) -> tuple[float, bool]:
        gap = max(t - self.last[1], 0) / 1e6 if self.last[0] == uid and self.last[1] else 1000.0
        self.last = (uid, t)
        own = self.store.get(uid)
        if own is None:
            if len(self.store) >= self.most:
                self.store.popitem(last=False)
                self.evicted += 1
            own = self.store[uid] = Behaviour()
        self.store.move_to_end(uid)
        score = own.deviation(t, gap, size, service)
        own.add(t, gap, size, service, place)
        return score, own.score > 0.6 and own.n >= Behaviour.MATURE

    def update(self, t: int, uid, x: float, _warm: bool) -> Answer:
        score, odd = self.step(t, uid, abs(x), uid)
        return (score, 0.0, min(0.85 * score, 0.95)) if odd and score > 0.6 else None


class Adwin:
    """Two adjacent windows of half the size, with running sums; a difference of means above its bound clears both."""

    def __init__(self, size: int = 1000, least: int = 30, delta: float = 0.002):
        self.half, self.least, self.log = size // 2, least, math.log(2 / delta)
        self._clear()

    def _clear(self) -> None:
        self.new, self.old, self.sums = deque(), deque(), [0.0, 0.0, 0.0, 0.0]

    def update(self, x: float) -> tuple[bool, float]:
        s = self.sums
        self.new.append(x)
        s[0] += x
        s[1] += x * x
        if len(self.new) > self.half:
            y = self.new.popleft()
            self.old.append(y)
            s[0], s[1], s[2], s[3] = s[0] - y, s[1] - y * y, s[2] + y, s[3] + y * y
            if len(self.old) > self.half:
                y = self.old.popleft()
                s[2], s[3] = s[2] - y, s[3] - y * y
        a, b = len(self.old), len(self.new)
        if a < self.least or b < self.least:
            return False, 0.0
        before, now = s[2] / a, s[0] / b
        variance = max((a * (s[3] / a - before * before) + b * (s[1] / b - now * now)) / (a + b), 0.0001)
        m = math.sqrt(1 / a + 1 / b)
        bound = math.sqrt(2 * variance * m * self.log) + 2 / 3 * m * self.log
        apart = abs(before - now)
        if apart > bound:
            self._clear()
            return True, apart
        return False, apart / bound


class PageHinkley:
    def __init__(self, limit: float = 50.0, slack: float = 0.1, alpha: float = 0.01):
        self.limit, self.slack, self.alpha, self.mean, self.sum, self.least = limit, slack, alpha, None, 0.0, 0.0

    def update(self, x: float) -> tuple[bool, float]:
        self.mean = x if self.mean is None else self.alpha * x + (1 - self.alpha) * self.mean
        self.sum += x - self.mean - self.slack
        self.least = min(self.least, self.sum)
        rise = self.sum - self.least
        if rise > self.limit:
            self.sum, self.least, self.mean = 0.0, 0.0, x
            return True, rise / self.limit
        return False, rise / self.limit


class Divergence:
    """Kullback-Leibler divergence of the current histogram from a reference one, tested from ``target`` values on."""

    def __init__(self, bins: int = 50, low: float = 0.0, high: float = 1000.0, limit: float = 0.5, target: int = 1000):
        self.low, self.width, self.limit, self.target = low, (high - low) / bins, limit, target
        self.before, self.now, self.n = None, [0] * bins, 0

    def value(self) -> float:
        a, b = sum(self.before), sum(self.now)
        return sum(p / a * math.log((p / a) / (q / b)) for p, q in zip(self.before, self.now, strict=True) if p and q) if a and b else 0.0

    def update(self, x: float) -> tuple[bool, float]:
        self.now[min(max(int((x - self.low) / self.width), 0), len(self.now) - 1)] += 1
        self.n += 1
        if self.n < self.target:
            return False, 0.0
        if self.before is None:
            self.before, self.now, self.n = self.now, [0] * len(self.now), 0
            return False, 0.0
        d = self.value()
        if d > self.limit:
            self.before, self.now, self.n = self.now, [0] * len(self.now), 0
            return True, d
        if self.n >= 2 * self.target:
            self.before, self.now, self.n = [p // 2 + q // 2 for p, q in zip(self.before, self.now, strict=True)], [0] * len(self.now), 0
        return False, d / self.limit


class DriftVote:
    """Any of three tests; sudden goes before gradual before incremental; the score is their mean."""

    def __init__(self):
        self.tests = (Adwin(), PageHinkley(), Divergence())

    def update(self, x: float) -> tuple[str | None, float]:
        found = [t.update(x) for t in self.tests]
        kind = next((k for k, (hit, _) in zip(("sudden", "gradual", "incremental"), found, strict=True) if hit), None)
        return kind, (found[0][1] + found[1][1] + found[2][1]) / 3


class Drift:
    def __init__(self):
        self.vote, self.n = DriftVote(), 0

    def update(self, _t: int, _uid, x: float, _warm: bool) -> Answer:
        self.n += 1
        if self.n < 100:
            return None
        kind, score = self.vote.update(x)
        return (score, 0.0, 0.7 + 0.25 * score) if kind else None


class Quantile:
    """Five markers that follow a quantile without keeping values. ``parity`` moves them by the rules that the survey lists."""

    def __init__(self, q: float = 0.95, parity: bool = True):
        self.q, self.parity, self.n, self.h, self.p = q, parity, 0, [], []

    def update(self, x: float) -> None:
        self.n += 1
        if not self.p:
            self.h.append(x)
            if len(self.h) == 5:
                self.h.sort()
                self.p = [0.0, 1.0, 2.0, 3.0, 4.0]
            return
        h, p, q, n = self.h, self.p, self.q, float(self.n)
        if x < h[0]:
            h[0], first = x, None if self.parity else 1
        elif x >= h[4]:
            h[4], first = x, None if self.parity else 4
        else:
            first = next(i for i in range(1, 5) if x < h[i])
        if first is not None:
            for i in range(first, 5):
                p[i] += 1
        want = (0.0, 2 * n * q, n * q, n * (1 + q), n) if self.parity else (0.0, (n - 1) * q / 2, (n - 1) * q, (n - 1) * (1 + q) / 2, n - 1)
        for i in (1, 2, 3):
            d = want[i] - p[i]
            if (d >= 1 and p[i + 1] - p[i] > 1) or (d <= -1 and p[i - 1] - p[i] < -1):
                s = 1.0 if d > 0 else -1.0
                up = (p[i] - p[i - 1] + s) * (h[i + 1] - h[i]) / (p[i + 1] - p[i]) + (p[i + 1] - p[i] - s) * (h[i] - h[i - 1]) / (p[i] - p[i - 1])
                new = h[i] + s / (p[i + 1] - p[i - 1]) * up if abs(p[i + 1] - p[i - 1]) >= 1e-10 else h[i]
                if not h[i - 1] < new < h[i + 1]:
                    j = i + int(s)
                    new = h[i] + (h[j] - h[i]) / (p[j] - p[i])
                h[i] = new
                p[i] += s

    def value(self) -> float:
        if self.p:
            return self.h[2]
        s = sorted(self.h)
        return s[int((len(s) - 1) * self.q)] if s else 0.5


class Profile:
    """All ten detectors of a key, its running baseline and the adaptive limit of its ensemble score."""

    def __init__(self, config: Config | None = None, weights: tuple[float, ...] = (0.1,) * 10, seed: int = 0):
        c = self.config = config or Config()
        self.detectors = (
            Volume(c), Distribution(c), Cardinality(), Burst(), Spectral(), ChangePoint(), Rrcf(seed=seed), MultiScale(), Behavioral(), Drift(),
        )
        self.weights, self.quantile, self.limit = weights, Quantile(), 0.5
        self.n, self.sum, self.squares, self.last, self.rate = 0, 0.0, 0.0, None, Ewma(100)

    @property
    def rrcf(self) -> Rrcf:
        return self.detectors[6]

    def reset(self) -> None:
        """Zero counts and ensemble; the detectors keep what they know."""
        self.n, self.sum, self.squares, self.last, self.rate = 0, 0.0, 0.0, None, Ewma(100)
        self.weights, self.quantile, self.limit = (0.1,) * 10, Quantile(), 0.5

    def step(self, t: int, uid, x: float) -> tuple:
        self.n += 1
        self.sum, self.squares = self.sum + x, self.squares + x * x
        if self.last is not None and t > self.last:
            self.rate.update(1e9 / (t - self.last))
        self.last = t
        warm = self.n < self.config.warmup
        answers = [d.update(t, uid, x, warm) for d in self.detectors]
        top = total = 0.0
        for a, w in zip(answers, self.weights, strict=True):
            c = 1.0 if a is None else a[2]
            total += w * c
            top += 0.0 if a is None else a[0] * w * c
        self.quantile.update(top / total if total > 0 else 0.0)
        if self.quantile.n >= 100:
            self.limit = max(self.quantile.value(), 0.5)
        mean = self.sum / self.n
        parts = [[None if a is None else a[i] for a in answers] for i in range(3)]
        return self.n, mean, math.sqrt(max(self.squares / self.n - mean * mean, 0.0)), self.rate.mean or 0.0, warm, self.limit, *parts


FIELDS = (
    "sequence long, mean double, std double, rate double, warmup boolean, score_limit double, "
    "scores array<double>, expected array<double>, confidences array<double>"
)
