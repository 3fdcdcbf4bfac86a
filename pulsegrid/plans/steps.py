"""Steps of the keyed fold: each factory gives (step, fields); a state is a dict of the objects in ``detectors``."""

from __future__ import annotations

from collections.abc import Callable

from . import detectors as d

Step = tuple[Callable[[dict, int, float], tuple], str]


def _of(make: Callable[[], object], update: Callable[[object, int, float], tuple], fields: str) -> Step:
    def step(s: dict, t: int, value: float) -> tuple:
        if "of" not in s:
            s["of"] = make()
        return update(s["of"], t, value)

    return step, fields


def holt_winters(period: int = 24, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> Step:
    """Forecast of level, trend and season, and the deviation from it."""
    return _of(lambda: d.HoltWinters(alpha, beta, gamma, period), lambda o, _t, x: o.update(x), "expected double, deviation double")


def cusum(target: float = 0.0, slack: float = 0.5, limit: float = 4.0, lead: int = 10) -> Step:
    """Side and severity of an alarm of the two-sided cumulative sums."""
    return _of(lambda: d.Cusum(target, slack, limit, lead), lambda o, _t, x: o.update(x), "side int, severity double")


def adwin(size: int = 1000, least: int = 30, delta: float = 0.002) -> Step:
    """Whether two adjacent windows differ, and by how much of the bound (or by how much, at a drift)."""
    return _of(lambda: d.Adwin(size, least, delta), lambda o, _t, x: o.update(x), "drift boolean, strength double")


def spectral_residual(size: int = 24, sensitivity: float = 0.6, every: int = 5) -> Step:
    """Score of the log spectrum's residual and whether it is an anomaly."""
    return _of(lambda: d.Spectral(size, sensitivity, every), lambda o, _t, x: o.step(x), "score double, anomaly boolean")


def divergence(bins: int = 50, low: float = 0.0, high: float = 1000.0, limit: float = 0.5, target: int = 1000) -> Step:
    """Whether the histogram drifted from its reference, and its divergence (or its part of the limit)."""
    return _of(lambda: d.Divergence(bins, low, high, limit, target), lambda o, _t, x: o.update(x), "drift boolean, strength double")


def drift_vote() -> Step:
    """Kind of drift that any of three tests found (null for none) and their mean score."""
    return _of(d.DriftVote, lambda o, _t, x: o.update(x), "kind string, score double")


def quantile(q: float = 0.95, parity: bool = True) -> Step:
    """A running quantile by five markers."""

    def update(o: d.Quantile, _t: int, x: float) -> tuple:
        o.update(x)
        return (o.value(),)

    return _of(lambda: d.Quantile(q, parity), update, "quantile double")


def limit(name: str) -> Step:
    """A named adaptive threshold after the event, and how far the event is above it."""

    def update(o: d.Limit, _t: int, x: float) -> tuple:
        score = o.score(x)
        return o.limit, score

    return _of(lambda: d.preset(name), update, "threshold double, score double")


def scale(seconds: int) -> Step:
    """The window of one scale that the event ends: its mean, score, forecast and season flag (null for events that end none)."""
    which = next(s for s in d.MultiScale.SCALES if s[0] == seconds)
    return _of(
        lambda: d.Scale(*which[:-1]), lambda o, t, x: o.update(t, x) or (None,) * 4, "mean double, score double, expected double, seasonal boolean"
    )


def multi_scale() -> Step:
    """Combined score of the scales whose windows the event ends, and how many of them are high."""
    return _of(d.MultiScale, lambda o, t, x: o.step(t, x)[:2], "score double, high int")


def rarity(bins: int = 20, low: float = 0.1, high: float = 1000.0, decay: float = 0.999) -> Step:
    """Rarity of the value's bin in the faded histogram before it, 0 to 1, and the histogram's mean after it."""

    def update(o: d.FadingHistogram, _t: int, x: float) -> tuple:
        rare = o.rarity(x)
        o.add(x)
        return rare, o.mean()

    return _of(lambda: d.FadingHistogram(bins, low, high, decay), update, "rarity double, mean double")


def forest(shingle: int = 1, seed: int = 0) -> Step:
    """Score of the last ``shingle`` values (or of a point, where events carry arrays) in a random cut forest."""

    def update(o: dict, _t: int, x) -> tuple:
        if isinstance(x, list):
            return o["forest"].update(x)
        o["last"] = [*o["last"], x][-shingle:]
        return o["forest"].update(o["last"]) if len(o["last"]) == shingle else (0.0, False)

    return _of(lambda: {"forest": d.Forest(seed=seed), "last": []}, update, "score double, anomaly boolean")


def both(one: Step, other: Step) -> Step:
    """Two steps over the same events, each with its own state."""

    def step(s: dict, t: int, value: float) -> tuple:
        return *one[0](s.setdefault("a", {}), t, value), *other[0](s.setdefault("b", {}), t, value)

    return step, f"{one[1]}, {other[1]}"
