"""Weighted rules as data: a registry of named features, combinations of them, and packs that label by rounds.

A rule gives a feature, or a tree of features under OR and AND, a weight where it is true and one where it isn't, and a stage:
0 for all rounds, s > 0 from round s on, s < 0 up to round -s. For a round the rules of a label become one closed-form score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lectio.functions.score import estimate_array

#: A feature by name, or ("OR" or "AND", part, ...).
Tree = str | tuple


def f_or(*truths: str) -> str:
    """The greatest of some truths; null if one of them is, where greatest itself would skip it."""
    return f"CASE WHEN {' OR '.join(f'({t}) IS NULL' for t in truths)} THEN NULL ELSE greatest({', '.join(truths)}) END" if len(truths) > 1 else truths[0]


def f_and(*truths: str) -> str:
    """The least of some truths; null if one of them is."""
    return f"CASE WHEN {' OR '.join(f'({t}) IS NULL' for t in truths)} THEN NULL ELSE least({', '.join(truths)}) END" if len(truths) > 1 else truths[0]


class Registry:
    """Named features: SQL for a truth from 0 to 1."""

    def __init__(self) -> None:
        self.features: dict[str, str] = {}

    def add(self, **features: str) -> Registry:
        self.features |= features
        return self

    def register(self, make: Callable[[], str]) -> Callable[[], str]:
        """A feature whose SQL is made by a function of its name."""
        self.features[make.__name__] = make()
        return make

    def compile(self, tree: Tree) -> str:
        """SQL of a feature or a tree of them. An unknown name is an error when the plan is made, not when it runs."""
        if isinstance(tree, str):
            return f"({self.features[tree]})"
        kind, *parts = tree
        return f"({ {'OR': f_or, 'AND': f_and}[kind](*map(self.compile, parts)) })"


@dataclass(frozen=True)
class Rule:
    tree: Tree
    true: float
    false: float
    stage: int = 0

    def counts(self, stage: int | None) -> bool:
        """Whether it takes part in a round; without one (where blocks are scored) only rules of all rounds do."""
        if self.stage == 0:
            return True
        return stage is not None and (0 < self.stage <= stage or self.stage < 0 and -self.stage >= stage)


Pack = dict[str, Sequence[Rule]]


def label_sql(registry: Registry, rules: Sequence[Rule], stage: int | None = None) -> str:
    """The score of one label in a round. Rules with the same feature replace one another, the last counts; one whose truth is null is passed over."""
    last = {r.tree: r for r in rules if r.counts(stage)}
    return estimate_array([(registry.compile(r.tree), r.true, r.false) for r in last.values()])


def label(rows: DataFrame, registry: Registry, pack: Pack, rounds: int = 1, prefix: str = "p_") -> DataFrame:
    """rows with a score for each label of a pack after so many rounds; features of a later round may read those of the one before."""
    keep = rows.columns
    for stage in range(1, rounds + 1):
        rows = rows.selectExpr(*keep, *(f"{label_sql(registry, rules, stage)} AS {prefix}{name}" for name, rules in pack.items()))
    return rows


def relevant(pack: Pack, prefix: str = "p_", least: float = 0.5) -> str:
    """SQL that is true for rows worth another round: those that reach half of what counts for some label."""
    return " OR ".join(f"{prefix}{name} >= {least / 2}" for name in pack)


def best(pack: Pack, prefix: str = "p_", least: float = 0.5, other: str = "NONE") -> str:
    """SQL for the label with the highest score over `least`, the first of equals."""
    high = "greatest(" + ", ".join(f"{prefix}{n}" for n in pack) + ", 0e0)" if len(pack) > 1 else f"{prefix}{next(iter(pack))}"
    return f"CASE WHEN {high} <= {least} THEN '{other}' {' '.join(f'WHEN {prefix}{n} = {high} THEN {chr(39)}{n}{chr(39)}' for n in pack)} END"
