"""Steps as data: a graph of named functions with needs, run in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Step:
    """``run`` gets the results of the steps it needs, by name."""

    name: str
    run: Callable[..., Any]
    needs: tuple[str, ...] = ()
    minutes: float = 0.0
    outputs: tuple[str, ...] = field(default_factory=tuple)


#: What any step takes at least.
FLOOR_MINUTES = 0.3


class Graph:
    """Steps in order of declaration; needs must be declared before."""

    def __init__(self, steps: list[Step]):
        self.steps: dict[str, Step] = {}
        for s in steps:
            if s.name in self.steps:
                raise ValueError(f"{s.name} is declared twice")
            if missing := [n for n in s.needs if n not in self.steps]:
                raise ValueError(f"{s.name} needs {missing}, which come later or not at all")
            self.steps[s.name] = s

    def resolve(self, targets: list[str] | None = None, only: bool = False, start: str | None = None) -> list[str]:
        """The steps to run: targets with all they need (``only``: without), from ``start`` on."""
        names = list(self.steps)
        for t in [*(targets or []), *([start] if start else [])]:
            if t not in self.steps:
                raise KeyError(f"no such step: {t}")
        wanted = set(targets or names)
        if not only:
            for name in reversed(names):
                if name in wanted:
                    wanted.update(self.steps[name].needs)
        order = [n for n in names if n in wanted]
        return [n for n in order if not start or names.index(n) >= names.index(start)]

    def estimate(self, names: list[str], scale: float = 1.0) -> float:
        return sum(max(FLOOR_MINUTES, self.steps[n].minutes * scale) for n in names)

    def run(self, targets: list[str] | None = None, have: dict[str, Any] | None = None, **options) -> dict[str, Any]:
        """The results by name; ``have`` gives those of steps that aren't run."""
        done = dict(have or {})
        for name in self.resolve(targets, **options):
            step = self.steps[name]
            if missing := [n for n in step.needs if n not in done]:
                raise KeyError(f"{name} needs {missing}")
            done[name] = step.run(*[done[n] for n in step.needs])
        return done


def retail_graph(raw: Any = None, tables: Any = None, at: str = "2000-06-01") -> Graph:
    """The retail chain over the roles; every result is a DataFrame, a table of them, or a fitted model."""
    from ..operators import affinity, cleaning, features, nba, questions, ranking, segments, splits, trust
    from .nba_queries import Snapshot
    from .reco_queries import Window, clusters

    def ranker(w):
        full = features.with_relevance(w.matrix(), w.target, w.t["products"])
        return ranking.fit_ranker(full.join(splits.validation_tail(w.q).select("query_id", "is_validation"), "query_id"), features.FEATURES)

    def systems(w, model):
        served = ranking.rank_with(model, features.with_relevance(w.matrix(), w.target, w.t["products"]), features.FEATURES)
        both = {"fixed score": w.metrics(), "ranker": ranking.per_query_metrics(ranking.top_k(served), w.q)}
        return ranking.compare_systems(both, clusters(w), resamples=100)

    return Graph([
        Step("raw", lambda: raw),
        Step("trust_raw", trust.retail_checks, ("raw",), 1),
        Step("clean", cleaning.clean_all, ("raw",), 2),
        Step("report", cleaning.cleaning_report, ("raw", "clean"), 1),
        Step("tables", lambda: tables),
        Step("rfm", lambda t: segments.rfm(t["customers"], t["baskets"]), ("tables",), 1),
        Step("cycles", lambda t: segments.repurchase(t["customers"], t["baskets"], t["items"], t["products"]), ("tables",), 1),
        Step("affinity", lambda t: affinity.cooccurrence(affinity.basket_items(t["items"], t["products"])), ("tables",), 1),
        Step("value", lambda t: questions.add_shares(questions.value_by(t, "tier")), ("tables",)),
        Step("lines", lambda t: nba.category_lines(t["baskets"], t["items"], t["products"]), ("tables",)),
        Step("labels", lambda lines: nba.category_label(nba.candidate_pairs(lines, at), lines, at), ("lines",), 1),
        Step("features", lambda t, lines: nba.category_features(lines, t["baskets"], t["items"], t["customers"], t["products"], at), ("tables", "lines"), 1),
        Step("window", lambda t: Window(t), ("tables",)),
        Step("matrix", lambda w: w.matrix(), ("window",), 3),
        Step("ranking_metrics", lambda w: ranking.summarise(w.metrics(), w.q), ("window",), 2),
        Step("ranker", ranker, ("window",), 10),
        Step("systems", systems, ("window", "ranker"), 4),
        Step("decisions", lambda t: nba.decide(nba.action_values(Snapshot(t, at).candidates())), ("tables",), 2),
        Step("policies", lambda t: Snapshot(t, at).comparison(), ("tables",), 2),
    ])
