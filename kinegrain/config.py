"""Configurations from YAML: sections to the operators' settings; unknown keys are ignored."""

from __future__ import annotations

from dataclasses import fields
from pathlib import Path
from typing import Any

from kinegrain.functions.changepoints import ChangeConfig
from kinegrain.functions.primitives import PrimitiveConfig
from kinegrain.operators.boundaries import PhaseConfig
from kinegrain.operators.features import FeatureConfig


def read_yaml(path: str | None) -> dict:
    """The file's mapping; empty without a file or without a YAML library."""
    if not path or not Path(path).exists():
        return {}
    try:
        import yaml
    except ImportError:
        return {}
    return yaml.safe_load(Path(path).read_text()) or {}


def _pick(kind: type, section: dict[str, Any], names: dict[str, str]) -> Any:
    known = {f.name for f in fields(kind)}
    own = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in section.items()}
    return kind(**{k: v for k, v in own.items() if k in known})


def feature_config(cfg: dict) -> FeatureConfig:
    return _pick(FeatureConfig, cfg.get("features", {}), {"smoothing_window": "window", "modality_weights": "block_weights", "lowpass_cutoff_hz": "cutoff"})


def change_config(cfg: dict) -> ChangeConfig:
    return _pick(ChangeConfig, cfg.get("ruptures", {}), {"cost_model": "model", "max_n_breakpoints": "max_n_bkps"})


def primitive_config(cfg: dict) -> PrimitiveConfig:
    return _pick(PrimitiveConfig, cfg.get("ticc", {}), {"window_size": "window", "n_clusters": "k", "lambda_parameter": "lam", "switch_penalty": "beta", "max_iterations": "max_iter", "random_state": "seed"})


def phase_config(cfg: dict) -> PhaseConfig:
    g, v = cfg.get("gripper", {}), cfg.get("velocity", {})
    own = {"closed": g.get("closed"), "opened": g.get("open"), "grip_dwell": g.get("dwell"), "moving": v.get("moving"), "still": v.get("stationary"), "speed_dwell": v.get("dwell")}
    return PhaseConfig(**{k: x for k, x in own.items() if x is not None})


def enabled(cfg: dict, section: str) -> bool:
    return bool(cfg.get(section, {}).get("enabled", True))


def modalities(asked: list[str]) -> tuple[list[str], list[str]]:
    """Distinct modalities in order, and notes on the aliases among them."""
    from kinegrain.operators.features import normalize_modality

    out: list[str] = []
    notes = []
    for m in asked:
        n = normalize_modality(m)
        if n != m.strip().lower():
            notes.append(f"{m} is {n}")
        if n not in out:
            out.append(n)
    return out, notes
