"""Run settings: command line over a TOML file over defaults, secrets from the environment or a .env file."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .operators.pairing import TIME_FILTERS

_IMAGE_TYPES = ("all", "panorama", "flat")


@dataclass(frozen=True)
class Settings:
    # mode
    input_csv: str | None = None
    area_wkt: str | None = None
    # area
    max_distance: float = 2.5
    max_angle_diff: float | None = None
    image_type: str = "all"
    image_size: str = "2048"
    request_delay: float = 0.1
    max_retries: int = 5
    retry_delay: float = 60.0
    time_filter: tuple[str, ...] = ("any",)
    year_group_left: tuple[int, ...] = ()
    year_group_right: tuple[int, ...] = ()
    pair_random_seed: int = 42
    # common
    images_dir: str | None = None
    output: str = "results"
    dry_run: bool = False
    access_token: str | None = None
    indices: tuple[str, ...] = ()
    max_pairs_per_index: int | None = None
    # filtering
    filtered_output: str | None = None
    filter_match_ratio_min: float | None = None
    filter_avg_distance_max: float | None = None
    filter_keypoint_coverage_min: float | None = None
    filter_keypoint_hull_iou_min: float | None = None
    filter_road_iou_min: float | None = None
    filter_mean_iou_min: float | None = None
    # panorama and field of view
    panorama: bool = False
    yaw_step: int = 10
    crop_keep: float = 0.55
    crop_top_bias: float = 0.0
    panorama_fast_yaw: bool = False
    panorama_semantic_rerank: bool = False
    semantic_rerank_radius: int = 8
    semantic_rerank_step: int = 2
    scale_search: bool = False
    scale_reproject: bool = False
    # metrics and masks
    image_metrics: bool = True
    profile_timing: bool = False
    segmentation: bool = False
    segmentation_max_width: int | None = None
    ignore_temporary: bool = False
    ignore_sky_keypoints: bool = False
    sky_keypoint_boundary_px: int = 10
    seg_crop_top_frac: float = 0.0
    seg_crop_bottom_frac: float = 0.0
    # sampling
    samples_per_group: int = 100
    year_group_old: tuple[int, ...] = ()
    year_group_new: tuple[int, ...] = ()
    old_label: str = "old"
    new_label: str = "new"
    seed: int = 42
    allow_short: bool = False
    samples_per_decile: int = 3

    def thresholds(self) -> dict[str, float]:
        """Active result thresholds, by the names that results.active() takes."""
        found = {f.name.removeprefix("filter_"): getattr(self, f.name) for f in fields(self) if f.name.startswith("filter_")}
        return {k: v for k, v in found.items() if v is not None}

    def checked(self) -> Settings:
        """These settings with what follows from them, or an error that says what does not fit."""
        if (self.input_csv is None) == (self.area_wkt is None):
            raise ValueError("give either input_csv or area_wkt")
        if self.image_type not in _IMAGE_TYPES:
            raise ValueError(f"image_type must be one of {', '.join(_IMAGE_TYPES)}")
        unknown = set(self.time_filter) - set(TIME_FILTERS)
        if unknown:
            raise ValueError(f"unknown time filters {sorted(unknown)}")
        if bool(self.year_group_left) != bool(self.year_group_right):
            raise ValueError("year groups need both sides")
        if self.max_distance <= 0 or (self.max_angle_diff is not None and not 0 <= self.max_angle_diff <= 180):
            raise ValueError("max_distance must be positive and max_angle_diff between 0 and 180")
        if self.panorama and self.scale_search:
            raise ValueError("panorama and scale_search exclude each other")
        if self.scale_reproject and not self.scale_search:
            raise ValueError("scale_reproject needs scale_search")
        if self.panorama_semantic_rerank and not (self.panorama and self.segmentation):
            raise ValueError("panorama_semantic_rerank needs panorama and segmentation")
        if not 0 < self.crop_keep <= 1 or not -1 <= self.crop_top_bias <= 1:
            raise ValueError("crop_keep must be in (0, 1] and crop_top_bias in [-1, 1]")
        if self.seg_crop_top_frac + self.seg_crop_bottom_frac >= 1:
            raise ValueError("the two mask crops leave nothing")
        if self.yaw_step < 1 or self.semantic_rerank_step < 1 or self.semantic_rerank_radius < 0:
            raise ValueError("yaw_step and semantic_rerank_step must be 1 or more")
        rules = self.time_filter
        if self.year_group_left and "year" not in rules:
            rules = (*rules, "year")  # both groups imply different years
        return replace(self, time_filter=tuple(dict.fromkeys(rules)))


def flattened(config: Mapping, sections: Sequence[str] = ()) -> dict:
    """Names of all tables on one level; tables named after another script are left out if sections are given."""
    out: dict = {}
    for key, value in config.items():
        if not isinstance(value, Mapping):
            out[key] = value
        elif not sections or key in sections or not key.startswith("script_"):
            out.update(flattened(value, sections))
    return out


def dotenv(path: str | Path) -> dict[str, str]:
    """NAME=value lines; quotes round a value go, comments and blanks do not count."""
    found = {}
    file = Path(path)
    for line in file.read_text().splitlines() if file.exists() else []:
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        value = value.strip()
        if equals and not name.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            found[name.strip()] = value[1:-1] if quoted else value
    return found


def load(
    overrides: Mapping | None = None,
    config: str | Path | None = None,
    env_file: str | Path = ".env",
    token_name: str = "IMAGE_ACCESS_TOKEN",
) -> Settings:
    """Overrides beat the TOML file, that beats defaults; unknown names in the file are ignored. The real environment beats .env."""
    known = {f.name: f for f in fields(Settings)}
    values = {}
    if config:
        with open(config, "rb") as f:
            values = {k.replace("-", "_"): v for k, v in flattened(tomllib.load(f)).items()}
    values = {k: v for k, v in values.items() if k in known}
    values.update({k: v for k, v in (overrides or {}).items() if v is not None})
    wrong = set(values) - set(known)
    if wrong:
        raise ValueError(f"unknown settings {sorted(wrong)}")
    if not values.get("access_token"):
        values["access_token"] = os.environ.get(token_name) or dotenv(env_file).get(token_name)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
