"""Run parameters, read once on the driver and passed to the operators."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

# Feature lists, codes and thresholds that results depend on.
FEATURES = {
    "model_1": [
        "bag_construction_year", "bag_function", "bag_net_internal_area", "bag_no_units",
        "esri_building_type", "cbs_pop_per_km2", "cbs_percent_multihousehold", "cbs_cafe_avg_1km",
        "footprint_area", "footprint_perim", "footprint_no_vertices", "footprint_no_adjacent",
        "footprint_no_neighbours_100m", "h_50p", "h_70p", "h_max", "h_min", "lod22_href_diff",
        "bag3d_roof_type", "lod12_area_walls", "lod12_area_roof", "lod12_volume",
        "lod22_area_walls", "lod22_area_roof", "lod22_volume",
    ],
    "model_2": ["bag_construction_year", "bag_function", "bag_net_internal_area", "bag_no_units"],
    "model_3": [
        "footprint_area", "footprint_perim", "footprint_no_vertices", "footprint_no_adjacent",
        "footprint_no_neighbours_100m",
    ],
    "model_4": [
        "h_70p", "h_50p", "h_max", "h_min", "lod12_area_walls", "lod12_area_roof", "lod12_volume",
    ],
    "model_5": [
        "h_70p", "h_50p", "h_max", "h_min", "lod22_area_walls", "lod22_area_roof", "lod22_volume",
        "lod22_href_diff", "bag3d_roof_type",
    ],
    "model_6": ["cbs_pop_per_km2", "cbs_percent_multihousehold", "cbs_cafe_avg_1km"],
}


@dataclass(frozen=True)
class Params:
    features: dict = field(default_factory=lambda: dict(FEATURES))
    algorithms: tuple = ("rfr", "gbr", "svr")
    training_tables: tuple = ("c1_ams", "c2_rot", "c3_dhg", "c4_rho")
    case_study_tables: tuple = ("c5_dft", "c6_dwt", "c7_rhn")
    id_column: str = "bag_id"
    label_column: str = "clean_floors"
    text_columns: tuple = ("bag_function", "bag3d_roof_type", "esri_building_type")
    distance_adjacent: float = 0.1
    neighbour_radii: tuple = (25, 50, 75, 100)
    ceiling_height: float = 2.65
    voxel_scales: dict = field(default_factory=lambda: {"lod12": 75, "lod22": 90})
    class_threshold: int = 5
    test_ratio: float = 0.2
    split_seed: int = 42
    cluster_cut: float = 0.4
    top_k: int = 10

    @classmethod
    def from_json(cls, path: str) -> "Params":
        """Override defaults with the keys of a JSON document; unknown keys are an error."""
        with open(path) as fh:
            raw = json.load(fh)
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = set(raw) - known
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def feature_columns(self, model: str) -> list[str]:
        """Feature list of a model; a derived subset such as ``model_1.kbest`` must be registered."""
        return list(self.features[model])


DEFAULTS = Params()
