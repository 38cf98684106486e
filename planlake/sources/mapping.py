"""How elements become families, types and parameters of a building model: a document edited once per template."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from .profiles import _made, _mapping


@dataclass(frozen=True)
class TypeRule:
    """Types of one kind of element. type_name has fields {w}, {d}, {dia} and {thk}; a parameter that is null is not set.

    With a family, a missing type is made of fallback_type and takes the parameters; without one (floors,
    walls, slabs on ground) it is copied from base_type.
    """

    type_name: str
    family: str | None = None
    width_param: str | None = None
    depth_param: str | None = None
    diameter_param: str | None = None
    thickness_param: str | None = None
    base_type: str | None = None
    fallback_type: str | None = None
    create_missing_types: bool = True


# -- fixed values: the usual families, names of their types and parameters, and what is built -------------------------
RULES = {
    "column": TypeRule("{w:.0f} x {d:.0f}mm", "M_Concrete-Rectangular-Column", "b", "h"),
    "column_round": TypeRule("{dia:.0f}mm", "M_Concrete-Round-Column", diameter_param="b"),
    "beam": TypeRule("{w:.0f} x {d:.0f}mm", "M_Concrete-Rectangular Beam", "b", "h"),
    "footing": TypeRule("{w:.0f} x {d:.0f} x {thk:.0f}mm", "M_Footing-Rectangular", "Width", "Length", thickness_param="Thickness"),
    "pile": TypeRule("{dia:.0f}mm", "M_Concrete-Round-Column", diameter_param="b"),
    "floor": TypeRule("RCC {thk:.0f}mm", base_type="Generic 150mm"),
    "ramp_floor": TypeRule("RCC RAMP {thk:.0f}mm", base_type="Generic 150mm"),
    "raft": TypeRule("RAFT {thk:.0f}mm", base_type="Generic 300mm"),
    "pcc": TypeRule("PCC {thk:.0f}mm", base_type="Generic 100mm"),
    "wall": TypeRule("RCC {thk:.0f}mm", base_type="Generic - 200mm"),
}
BUILD = {"levels": True, "grids": True, "columns": True, "beams": True, "floors": True, "foundations": True, "pcc": True, "piles": True, "walls": True, "shafts": True, "stairs": False}
# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    name: str = "structural template"
    level_prefix: str = ""
    grid_prefix: str = ""
    create_grids: bool = True
    structural_only: bool = True
    shaft_from: tuple[str, ...] = ("LIFT", "SHAFT", "STAIR")
    round_sizes_to_mm: float = 5.0
    build: dict[str, bool] = field(default_factory=lambda: dict(BUILD))
    rules: dict[str, TypeRule] = field(default_factory=lambda: dict(RULES))

    def __post_init__(self):
        if not self.round_sizes_to_mm > 0:
            raise ValueError("sizes are rounded to a step above zero")
        if odd := (set(self.build) - set(BUILD)) | (set(self.rules) - set(RULES)):
            raise ValueError(f"unknown kinds {sorted(odd)} in the mapping")


def load_mapping(text: str) -> Mapping:
    """A mapping of a YAML or JSON document; rules stand in it by their kind. What it leaves out keeps its usual value."""
    raw = dict(_mapping(text) or {})
    given = {k: raw.pop(k) or {} for k in list(raw) if k in RULES}
    for k, v in given.items():
        if unknown := set(v) - set(asdict(RULES[k])):
            raise ValueError(f"unknown settings {sorted(unknown)} in {k}")
    raw["rules"] = {k: replace(r, **given.get(k, {})) for k, r in RULES.items()}
    raw["build"] = BUILD | (raw.get("build") or {})
    if "shaft_from" in raw:
        raw["shaft_from"] = tuple(raw["shaft_from"])
    return _made(Mapping, raw)


def save_mapping(mapping: Mapping) -> str:
    raw = asdict(mapping)
    return json.dumps(raw | raw.pop("rules"), indent=1, ensure_ascii=False)
