"""What an entity learns from feedback, and the scoring state of an entity: its profile and what it has learned."""

from __future__ import annotations

from .detectors import NAMES, Config, Profile

#: Fade of the betas at each feedback, and the score above which a detector has spoken.
DECAY, SPOKEN = 0.98, 0.5


class Learner:
    """Betas and hits of each detector, and the ensemble's weights: half of the betas' means, half of F1, as shares.

    Weights are renewed after every ``every`` feedback rows. A batch of feedback that holds true negatives only says nothing
    and is left out.
    """

    def __init__(self, every: int = 100):
        n = len(NAMES)
        self.every, self.n = every, 0
        self.alpha, self.beta, self.weights = [1.0] * n, [1.0] * n, [1 / n] * n
        self.hits = [[0, 0, 0] for _ in range(n)]  # true and false positives, false negatives

    def batch(self, rows: list[tuple[list[float], bool, bool]]) -> bool:
        """Take in rows of detector scores, decision and truth; whether they were significant."""
        if not any(decision or truth for _, decision, truth in rows):
            return False
        for scores, _, truth in rows:
            for i, score in enumerate(scores[: len(NAMES)]):
                spoke = (score or 0.0) > SPOKEN
                right = spoke == truth
                self.alpha[i] = max(self.alpha[i] * DECAY, 1.0) + right
                self.beta[i] = max(self.beta[i] * DECAY, 1.0) + (not right)
                if spoke or truth:
                    self.hits[i][0 if spoke and truth else 1 if spoke else 2] += 1
            self.n += 1
            if self.n % self.every == 0:
                self._renew()
        return True

    def f1(self, i: int) -> float:
        """0.5 stands for precision or recall without any row."""
        tp, fp, fn = self.hits[i]
        p = tp / (tp + fp) if tp + fp else 0.5
        r = tp / (tp + fn) if tp + fn else 0.5
        return 2 * p * r / (p + r) if p + r else 0.0

    def _renew(self) -> None:
        means = [a / (a + b) for a, b in zip(self.alpha, self.beta, strict=True)]
        f1 = [self.f1(i) for i in range(len(NAMES))]
        whole, best = sum(means), sum(f1)
        half = [0.5 * m / whole + 0.5 * (f / best if best else 1 / len(f1)) for m, f in zip(means, f1, strict=True)]
        self.weights = [h / sum(half) for h in half]


class Scoring:
    """An entity's profile and learner. Events are scored with the weights learned so far."""

    def __init__(self, config: Config | None = None, every: int = 100):
        self.profile, self.learner, self.last = Profile(config), Learner(every), 0

    def feedback(self, rows: list[tuple[list[float], bool, bool]]) -> bool:
        if not self.learner.batch(rows):
            return False
        self.profile.weights = tuple(self.learner.weights)
        return True

    def event(self, t: int, uid, x: float) -> tuple:
        self.last = max(self.last, t)
        return *self.profile.step(t, uid, x), list(self.learner.weights)
