"""Positional roles of survey tables, resolved from column names when a plan is built."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: The accepted names of each role, in lower case.
ALIASES: dict[str, set[str]] = {
    "nr": {"nr", "bro_id", "nitg_nr", "nitg", "boorp"},
    "surface": {"surface", "maaiveld", "mv", "height_nap", "surface_nap", "height_nap_corr"},
    "end": {"end", "einddiepte", "einddiepte_nap", "end_depth", "end_depth_nap", "end_ah_depth"},
    "x": {"x", "x-coord", "longitude", "lon", "easting", "x_bottom_rd", "x_rd_crd", "x_calc_crd"},
    "y": {"y", "y-coord", "latitude", "lat", "northing", "y_bottom_rd", "y_rd_crd", "y_calc_crd"},
    "top": {"top", "tv_top_nap", "top_diepte", "top_depth", "upperboundary"},
    "depth": {"depth", "bottom", "tv_bottom_nap", "basis_diepte", "bottom_depth", "lowerboundary"},
}
_extra: dict[str, set[str]] = {role: set() for role in ALIASES}


def add_aliases(save_to: str | None = None, **names: str | list[str]) -> None:
    """Accept further column names for roles, for this session or, with save_to, in a JSON file for later ones."""
    for role, value in names.items():
        if role not in ALIASES:
            raise KeyError(f"{role} is no role; roles are {', '.join(ALIASES)}")
        _extra[role] |= {v.lower() for v in ([value] if isinstance(value, str) else value)}
    if save_to:
        Path(save_to).write_text(json.dumps({k: sorted(v) for k, v in _extra.items()}))


def load_aliases(file: str) -> None:
    for role, names in json.loads(Path(file).read_text()).items():
        _extra[role] |= set(names)


def reset_aliases(file: str | None = None) -> None:
    for names in _extra.values():
        names.clear()
    if file:
        Path(file).unlink(missing_ok=True)


@dataclass(frozen=True)
class Roles:
    """The columns that play each role in a table; None where a role is missing."""

    nr: str
    surface: str | None
    end: str | None
    x: str | None
    y: str | None
    top: str | None
    depth: str | None

    @classmethod
    def of(cls, df: DataFrame) -> Roles:
        found = {f.name: next((c for c in df.columns if c.lower() in ALIASES[f.name] | _extra[f.name]), None) for f in fields(cls)}
        if found["nr"] is None:
            raise KeyError("the table has no survey id column")
        return cls(**found)

    @property
    def layered(self) -> bool:
        return self.top is not None and self.depth is not None

    @property
    def has_depths(self) -> bool:
        return self.surface is not None and self.depth is not None

    @property
    def has_xy(self) -> bool:
        return self.x is not None and self.y is not None

    def need(self, *roles: str, error: type[Exception] = KeyError) -> None:
        """Raise where one of these roles is missing."""
        missing = [r for r in roles if getattr(self, r) is None]
        if missing:
            raise error(f"the table has no column for: {', '.join(missing)}")

    def window(self) -> WindowSpec:
        """The rows of a survey from its surface down. Built here alone, so that operators share one exchange."""
        self.need("depth")
        order = [F.col(f"`{self.top}`")] if self.top else []
        return Window.partitionBy(F.col(f"`{self.nr}`")).orderBy(*order, F.col(f"`{self.depth}`"))


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def check_roles(df: DataFrame) -> Roles:
    """Roles of a table; warns where coordinates or depths are missing."""
    roles = Roles.of(df)
    missing = [r for r in ("x", "y", "surface", "depth") if getattr(roles, r) is None]
    if missing:
        warnings.warn(f"the table has no column for: {', '.join(missing)}; some operators won't work", UserWarning, stacklevel=2)
    return roles
