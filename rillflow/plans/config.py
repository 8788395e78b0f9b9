"""Deployment configuration: YAML, environment variables, checks, segments."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

from ..errors import ConfigEnvError

_ENV = re.compile(r"^\$\{envvar:([^}]+)\}$")


def substitute(value: Any) -> Any:
    """Whole strings ``${envvar:NAME}`` become the variable's value; an unset one is an error."""
    if isinstance(value, dict):
        return {k: substitute(v) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v) for v in value]
    if isinstance(value, str) and (m := _ENV.match(value)):
        if m[1] not in os.environ:
            raise ConfigEnvError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]
    return value


def _require(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise ValueError(f"configuration, {where}: {what}")


def check(config: Any) -> None:
    """Shapes of the known parts; unknown settings pass."""
    _require(isinstance(config, dict), "top level", "must be a mapping")
    pipeline = config.get("pipeline")
    if pipeline is not None:
        _require(isinstance(pipeline, dict), "pipeline", "must be a mapping")
        _require(isinstance(pipeline.get("segments"), list), "pipeline.segments", "must be a list")
        for i, segment in enumerate(pipeline["segments"]):
            where = f"pipeline.segments[{i}]"
            _require(isinstance(segment, dict), where, "must be a mapping")
            steps = segment.get("steps_config", {})
            _require(isinstance(steps, dict), f"{where}.steps_config", "must be a mapping")
            for name, step in steps.items():
                _require(isinstance(step, dict), f"{where}.steps_config.{name}", "must be a mapping")
                if "dlq" in step:
                    check_dlq(step["dlq"], f"{where}.steps_config.{name}.dlq")
    _require(isinstance(config.get("env", {}), dict), "env", "must be a mapping")
    metrics = config.get("metrics")
    if metrics is not None:
        _require(isinstance(metrics, dict), "metrics", "must be a mapping")
        needed = {"datadog": ("host", "port"), "log": ("period_sec", "tags"), "dummy": ()}
        _require(metrics.get("type") in needed, "metrics.type", f"must be one of {', '.join(needed)}")
        for key in needed[metrics["type"]]:
            _require(key in metrics, f"metrics.{key}", "is required")
        if metrics["type"] == "log":
            _require(isinstance(metrics["period_sec"], (int, float)) and metrics["period_sec"] >= 0.1, "metrics.period_sec", "must be 0.1 or more")
        if "flush_interval_ms" in metrics:
            _require(isinstance(metrics["flush_interval_ms"], int) and metrics["flush_interval_ms"] >= 1, "metrics.flush_interval_ms", "must be a positive integer")


def check_dlq(dlq: Any, where: str = "dlq") -> None:
    _require(isinstance(dlq, dict), where, "must be a mapping")
    servers = dlq.get("bootstrap_servers")
    _require(isinstance(servers, list) and servers and all(isinstance(s, str) for s in servers), f"{where}.bootstrap_servers", "must be a list of at least one server")
    if "topic" in dlq:
        _require(isinstance(dlq["topic"], str) and dlq["topic"] != "", f"{where}.topic", "must not be empty")
    params = dlq.get("override_params", {})
    _require(isinstance(params, dict) and all(isinstance(v, str) for v in params.values()), f"{where}.override_params", "must map to strings")


def load(path: str | Path) -> dict[str, Any]:
    """Reads, substitutes and checks a configuration file."""
    config = yaml.safe_load(Path(path).read_text())
    config = substitute({} if config is None else config)
    check(config)
    return config


def segment(config: Mapping[str, Any], segment_id: int | None = None) -> dict[str, Any]:
    """One segment's settings: env, adapter_config and steps_config, each empty where absent."""
    pipeline = config.get("pipeline", {})
    segments = pipeline.get("segments") or [{}]
    chosen = segments[segment_id or 0]
    return {"steps_config": {}} | chosen | {"env": config.get("env", {}), "adapter_config": pipeline.get("adapter_config", {})}
