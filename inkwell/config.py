"""Settings: defaults, inheritance, overrides, validation, identity."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

import yaml

PREFIX = "INKWELL_"
MAX_DEPTH = 8


class ConfigError(ValueError):
    """A setting that can't be used."""


# Every key there is, with its default. None stands for "not set".
DEFAULTS: dict[str, dict[str, Any]] = {
    "corpus": {"author_label": "", "dir": "data/corpus", "sources": "data/corpus_sources.yaml", "manifest": "data/manifest.json", "expected_count": 49, "include_ids": None, "exclude_ids": []},
    "chunking": {"P": 400, "merge_short_tail": False, "min_chunk_words": 1},
    "profile": {"structured_output": True, "context_budget_tokens": None, "tokens_per_word": 1.35, "merge_when_multiple": True, "max_output_tokens": 4096},
    "rewrite": {
        "max_output_tokens": 2048, "max_retries": 2, "max_failed_fraction": 0.02,
        "validation": {"min_length_ratio": 0.60, "max_length_ratio": 1.60, "min_content_retention": 0.50, "strip_preamble": True, "strip_code_fences": True},
    },
    "distance": {"metric": "fwed", "function_words": "", "store_edit_detail_sample": 200},
    "aggregate": {"chunk_reduce": "mean", "run_reduce": "mean", "std_ddof": 1, "report_length_weighted": True},
    "classify": {"method": "otsu_exact", "cross_check_skimage": True, "otsu_agreement_tol": 0.005, "borderline_band": 0.01, "manual_tau": None, "bimodality_min_separability": 0.5, "bimodality_min_gap_ratio": 0.5},
    "noise": {"enabled": True, "pool_dir": "data/noise_pool", "first_run_plain": True, "cumulative": False, "score_injected_text": True},
    "llm": {"provider": "fake", "model_id": None, "temperature": 0.0, "mode": "live", "cache_dir": "cache", "concurrency": 8, "requests_per_minute": 240, "tokens_per_minute": 1_000_000, "max_transient_retries": 5, "timeout_seconds": 120},
    "run": {"M": 3, "seed": 20260731, "out_dir": "runs", "tag": ""},
    "report": {"figures": True, "compare_to_prior": None, "consensus_cases": None, "formats": ["csv", "md"]},
    "purification": {"enabled": False, "T_max": 5, "stop_when_unchanged_for": 1, "report_set_differences": True},
    "experiment": {
        "control": {"sample_chunks": 300, "alpha": 0.05, "stratify": True, "report_power": True}, "sensitivity": {"P_values": [200, 300, 400, 500, 600], "M_values": [3, 5]},
        "mixture": {"n_splices": 3, "splice_words": 800}, "calibration": {"sample_chunks": 100, "repeats": 5, "max_cv": 0.15},
    },
}

CHOICES = {
    ("distance", "metric"): ("fwed", "fw_freq_cosine", "fw_freq_manhattan"),
    ("classify", "method"): ("otsu_exact", "otsu_skimage", "otsu_binned", "gmm_2", "manual"),
    ("llm", "mode"): ("live", "replay", "refresh"),
}

# Presets that lie over the defaults.
PRESETS: dict[str, dict[str, Any]] = {
    "mini": {"corpus": {"expected_count": 3}, "chunking": {"P": 120}, "llm": {"concurrency": 4}, "run": {"M": 2, "tag": "mini"}},
    "poc": {"run": {"M": 3, "tag": "poc"}},
    "full": {"run": {"M": 3, "tag": "full"}},
    "sensitivity": {"run": {"tag": "sensitivity"}},
    "control": {"run": {"tag": "control"}},
    "purification": {"purification": {"enabled": True}, "run": {"tag": "purification"}},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``: mappings merge, anything else (lists, null) replaces."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def load_chain(path: str | Path, _seen: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A YAML file over the files that its ``extends`` names, one after another."""
    p = Path(path).resolve()
    if p in _seen:
        raise ConfigError(f"'extends' goes in a circle: {' -> '.join(q.name for q in (*_seen, p))}")
    if len(_seen) >= MAX_DEPTH:
        raise ConfigError(f"'extends' goes deeper than {MAX_DEPTH}")
    if not p.is_file():
        raise ConfigError(f"no settings at {p}")
    found = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict):
        raise ConfigError(f"{p.name} holds no mapping")
    parent = found.pop("extends", None)
    return merged(load_chain(p.parent / parent, (*_seen, p)), found) if parent else found


def _exact_path(path: Iterable[str]) -> list[str]:
    """The path in the spelling of DEFAULTS, whatever its case."""
    here: Any = DEFAULTS
    out = []
    for part in path:
        names = {k.lower(): k for k in here} if isinstance(here, dict) else {}
        if part.lower() not in names:
            raise ConfigError(f"unknown setting {'.'.join([*out, part])!r}; there are {', '.join(sorted(names.values())) or 'none'}")
        out.append(names[part.lower()])
        here = here[out[-1]]
    return out


def _nested(path: list[str], raw: str) -> dict[str, Any]:
    try:
        value: Any = yaml.safe_load(raw)
    except yaml.YAMLError as e:
        raise ConfigError(f"{'.'.join(path)}: {raw!r} is no value") from e
    for k in reversed(path):
        value = {k: value}
    return value


def environment_overrides(environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings from variables such as INKWELL_LLM__CONCURRENCY."""
    out: dict[str, Any] = {}
    for name, raw in sorted((os.environ if environ is None else environ).items()):
        if name.startswith(PREFIX) and "__" in name:
            out = merged(out, _nested(_exact_path(name[len(PREFIX) :].split("__")), raw))
    return out


def assignments(items: Iterable[str]) -> dict[str, Any]:
    """Settings from ``key.path=value`` strings."""
    out: dict[str, Any] = {}
    for item in items:
        key, sep, raw = item.partition("=")
        if not sep or not key.strip():
            raise ConfigError(f"expected key=value, got {item!r}")
        out = merged(out, _nested(_exact_path(key.strip().split(".")), raw))
    return out


def validated(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Defaults under ``settings``, every key known, every value of its kind and in its range."""

    def check(over: Mapping[str, Any], known: Mapping[str, Any], path: tuple[str, ...]) -> None:
        for k, v in over.items():
            where = ".".join((*path, k))
            if k not in known:
                raise ConfigError(f"unknown setting {where!r}")
            d = known[k]
            if isinstance(d, dict):
                if not isinstance(v, Mapping):
                    raise ConfigError(f"{where} is a group")
                check(v, d, (*path, k))
            elif d is not None and v is not None:
                kind = (int, float) if isinstance(d, float) else type(d)
                if not isinstance(v, kind) or isinstance(v, bool) != isinstance(d, bool):
                    raise ConfigError(f"{where} must be of kind {type(d).__name__}, not {v!r}")

    check(settings, DEFAULTS, ())
    c = merged(DEFAULTS, settings)
    for (g, k), allowed in CHOICES.items():
        if c[g][k] not in allowed:
            raise ConfigError(f"{g}.{k} must be one of {', '.join(allowed)}")
    v = c["rewrite"]["validation"]
    if not 0 <= v["min_length_ratio"] <= v["max_length_ratio"]:
        raise ConfigError("min_length_ratio must not exceed max_length_ratio")
    if c["classify"]["method"] == "manual" and c["classify"]["manual_tau"] is None:
        raise ConfigError("the manual method needs manual_tau")
    if c["chunking"]["P"] < 1 or c["run"]["M"] < 1 or c["llm"]["concurrency"] < 1:
        raise ConfigError("chunking.P, run.M and llm.concurrency must be at least 1")
    return c


def build(path: str | Path | None = None, preset: str | None = None, sets: Iterable[str] = (), environ: Mapping[str, str] | None = None, **flags: Any) -> dict[str, Any]:
    """Settings by precedence: key=value pairs and flags, environment, file, preset, defaults."""
    out = PRESETS[preset] if preset else {}
    if path:
        out = merged(out, load_chain(path))
    out = merged(out, environment_overrides(environ))
    named = {"provider": ("llm", "provider"), "mode": ("llm", "mode"), "seed": ("run", "seed")}
    for k, v in flags.items():
        if v is not None:
            g, n = named[k]
            out = merged(out, {g: {n: v}})
    return validated(merged(out, assignments(sets)))


def identity(settings: Mapping[str, Any]) -> str:
    """The hash of settings, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()
