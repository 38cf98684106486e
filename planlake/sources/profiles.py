"""Rule profiles, template specs and mappings: small configuration documents, and their rules as tables.

A profile names a role for each layer, tolerances, and which witness of a size wins. A document is a mapping
as YAML or JSON text; unknown keys are refused, so a typing error never passes for a setting.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "layer string, role string, text_role string, confidence string, modifiers array<string>"


def _made(kind, values: dict):
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings {sorted(unknown)} in {kind.__name__}")
    return kind(**values)


@dataclass(frozen=True)
class Tolerances:
    """Lengths in mm, areas in square mm. The usual settings."""

    ring_close: float = 50.0
    column_min_side: float = 100.0
    beam_min_overlap: float = 300.0
    beam_merge_gap: float = 800.0
    grid_ref: float = 600.0
    size_mismatch: float = 26.0
    dimension_text_height: float = 125.0
    text_box_area_ratio: float = 3.0


@dataclass(frozen=True)
class SizeSources:
    """tag or outline, for each kind of element."""

    column: str = "tag"
    beam: str = "tag"
    slab: str = "tag"
    footing: str = "tag"

    def __post_init__(self):
        if odd := {v for v in asdict(self).values()} - {"tag", "outline"}:
            raise ValueError(f"a size comes from a tag or an outline, not {sorted(odd)}")


@dataclass(frozen=True)
class Profile:
    name: str = "auto"
    units_override: str | None = None
    layers: dict[str, dict] = field(default_factory=dict)
    tolerances: Tolerances = Tolerances()
    size_sources: SizeSources = SizeSources()

    def rules(self, spark: SparkSession) -> DataFrame:
        """The layers' rules as a table; missing entries are null."""
        return spark.createDataFrame([{"layer": k, **v} for k, v in self.layers.items()], RULE)


@dataclass(frozen=True)
class Spec:
    """Layers of kinds in template drawings, and text heights that a mark may have, largest first."""

    layers: dict[str, str] = field(default_factory=lambda: {"column": "T-COLUMN", "beam": "T-BEAM", "slab": "T-SLAB"})
    text_heights: tuple[float, ...] = (250.0, 200.0, 150.0, 125.0, 100.0)
    size_step: float = 25.0


def _mapping(text: str) -> dict:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text) or {}


def load_profile(text: str) -> Profile:
    """A profile of a YAML or JSON document."""
    raw = _mapping(text)
    raw["tolerances"], raw["size_sources"] = _made(Tolerances, raw.get("tolerances") or {}), _made(SizeSources, raw.get("size_sources") or {})
    return _made(Profile, raw)


def save_profile(profile: Profile) -> str:
    return json.dumps(asdict(profile), indent=1, ensure_ascii=False)


def load_spec(text: str) -> Spec:
    raw = _mapping(text)
    if "text_heights" in raw:
        raw["text_heights"] = tuple(sorted(map(float, raw["text_heights"]), reverse=True))
    return _made(Spec, raw)


def profile_documents(rules: DataFrame, name: str) -> DataFrame:
    """One JSON document for each profile (a column of rules): its layers and their rules, for a corpus of profiles."""
    entry = F.struct("layer", F.struct("role", "text_role", "confidence", "modifiers").alias("rule"))
    layers = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return rules.groupBy(name).agg(F.to_json(F.struct(F.first(name).alias("name"), layers.alias("layers"))).alias("document"))


def read_profile_documents(documents: DataFrame) -> DataFrame:
    """name and the rules of the layers of profile documents."""
    kind = "name string, layers map<string,struct<role:string,text_role:string,confidence:string,modifiers:array<string>>>"
    d = documents.select(F.from_json("document", kind).alias("d"))
    return d.select("d.name", F.explode("d.layers").alias("layer", "rule")).select("name", "layer", "rule.*")
