"""The cell catalogue: which columns hold a numerator and denominator, read from column names alone.

Wide rows carry ``<team>.Sets[<index>].<base>.Dividend`` and ``.Divisor`` columns. The catalogue is built
on the driver from the names, once; operators ask it instead of the data whether a cell exists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

TEAMS = ("PlayerTeam1", "PlayerTeam2")
SET_INDICES = tuple(range(6))
DEFAULT_BASE = "Stats.PointStats.TotalPointsWon"


@dataclass(frozen=True)
class Cell:
    """One position of a wide row: a team's numerator and denominator of a base in a set."""

    team: str
    set_index: int
    base: str

    @property
    def dividend(self) -> str:
        return f"{self.team}.Sets[{self.set_index}].{self.base}.Dividend"

    @property
    def divisor(self) -> str:
        return f"{self.team}.Sets[{self.set_index}].{self.base}.Divisor"


@dataclass(frozen=True)
class Catalogue:
    """All positions that the teams, set indices and discovered bases span, and the names that exist."""

    names: frozenset[str]
    bases: tuple[str, ...]
    teams: tuple[str, ...] = TEAMS
    set_indices: tuple[int, ...] = SET_INDICES

    @classmethod
    def of(cls, df: DataFrame, teams: tuple[str, ...] = TEAMS, set_indices: tuple[int, ...] = SET_INDICES) -> Catalogue:
        """Bases are taken from any set index; only ``set_indices`` are read later."""
        any_team = "|".join(map(re.escape, teams))
        shape = re.compile(rf"(?:{any_team})\.Sets\[\d+\]\.(.+)\.(?:Dividend|Divisor)")
        found = {m[1] for m in map(shape.fullmatch, df.columns) if m}
        return cls(frozenset(df.columns), tuple(sorted(found)), tuple(teams), tuple(set_indices))

    def positions(self, base: str, teams: tuple[str, ...] | None = None) -> list[Cell]:
        return [Cell(t, i, base) for t in (teams or self.teams) for i in self.set_indices]

    def ratio_cells(self) -> list[Cell]:
        """Positions that have both columns."""
        return [c for b in self.bases for c in self.positions(b) if {c.dividend, c.divisor} <= self.names]

    def total_cells(self, base: str, teams: tuple[str, ...]) -> list[Cell]:
        """Positions that have the denominator."""
        return [c for c in self.positions(base, teams) if c.divisor in self.names]
