"""Configuration: YAML files with anchors and merge keys, defaults, overrides."""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml


@dataclass(frozen=True)
class ModelConfig:
    path: str
    backend: str = "onnxruntime"
    shape: tuple[int, int] = (640, 640)
    batch: int = 1
    buffer_size: int = 4
    warm_up: int = 0
    classes: tuple[str, ...] = ()
    session_options: dict[str, Any] = field(default_factory=dict)
    conf: float = 0.25
    nms: float = 0.45
    max_detections: int = 300
    auto_aspect_ratio: bool = True
    pad_color: tuple[int, int, int] = (114, 114, 114)
    bgr_to_rgb: bool = True


@dataclass(frozen=True)
class Override:
    """Values that are set win over the model's: above 0, at least 0, or not empty."""

    batch: int = 0
    buffer_size: int = 0
    warm_up: int = -1
    execution_providers: str = ""


@dataclass(frozen=True)
class BenchmarkConfig:
    config_path: str = ""
    image_path: str = "assets/bus.png"
    warmup_count: int = 5
    test_duration_sec: float = 10.0
    min_iterations: int = 50
    concurrent_clients: int = 1
    output_dir: str = "./benchmark_output"
    export_json: bool = True
    export_csv: bool = True
    sync_override: Override = Override()
    async_override: Override = Override()
    batch_override: Override = Override()
    mode: str = "all"
    model_type: str = "yolo"
    show_gpu_stats: bool = True


def parse_yaml(text: str) -> dict:
    """A YAML tree; anchors and merge keys are resolved, and a local key wins over a merged one.  Read by libyaml where PyYAML has it: the pure Python parser takes several times as long."""
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}


def load_yaml(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read())


def model_config(tree: dict) -> ModelConfig:
    model, pre, post = tree["model"], tree.get("preprocess") or {}, tree.get("postprocess") or {}
    own = {k: model[k] for k in ("backend", "batch", "buffer_size", "warm_up") if k in model}
    own |= {k: tuple(model[k]) for k in ("shape", "classes") if k in model}
    own |= {k: pre[k] for k in ("auto_aspect_ratio", "bgr_to_rgb") if k in pre}
    own |= {"pad_color": tuple(pre["pad_color"])} if "pad_color" in pre else {}
    own |= {k: post[k] for k in ("conf", "nms", "max_detections") if k in post}
    parse_backend(own.get("backend", "onnxruntime"))
    return ModelConfig(path=model["path"], session_options=dict(model.get("session_options") or {}), **own)


def benchmark_config(tree: dict, path: str = "") -> BenchmarkConfig:
    names = {f.name for f in dataclasses.fields(BenchmarkConfig)}
    own = {k: v for k, v in tree.items() if k in names}
    for k in ("sync_override", "async_override", "batch_override"):
        own[k] = Override(**(tree.get(k) or {}))
    own["test_duration_sec"] = float(own.get("test_duration_sec", 10.0))
    own.setdefault("config_path", path)
    return BenchmarkConfig(**own)


def merged(model: ModelConfig, over: Override) -> ModelConfig:
    """A new configuration with the override on top; the model's own is left as it is."""
    new = {}
    if over.batch > 0:
        new["batch"] = over.batch
    if over.buffer_size > 0:
        new["buffer_size"] = over.buffer_size
    if over.warm_up >= 0:
        new["warm_up"] = over.warm_up
    if over.execution_providers:
        new["session_options"] = model.session_options | {"execution_providers": [over.execution_providers]}
    return dataclasses.replace(model, **new)


def from_arguments(arguments: list[str], load: Callable[[str], dict] = load_yaml) -> BenchmarkConfig:
    """Command line over file over default; ``load`` gives the tree of the file named by ``--config``."""
    p = argparse.ArgumentParser(description="Latency and throughput of the execution modes")
    p.add_argument("--config")
    p.add_argument("--mode", choices=["sync", "async", "batch", "all"])
    p.add_argument("--model", "--model-type", dest="model_type")
    p.add_argument("--image", dest="image_path")
    p.add_argument("--clients", dest="concurrent_clients", type=int)
    p.add_argument("--duration", dest="test_duration_sec", type=float)
    p.add_argument("--warmup", dest="warmup_count", type=int)
    p.add_argument("--min-iterations", dest="min_iterations", type=int)
    p.add_argument("--output-dir", dest="output_dir")
    for flag, name in (("--no-json", "export_json"), ("--no-csv", "export_csv"), ("--no-gpu-stats", "show_gpu_stats")):
        p.add_argument(flag, dest=name, action="store_const", const=False)
    given = {k: v for k, v in vars(p.parse_args(arguments)).items() if v is not None}
    path = given.pop("config", None)
    return dataclasses.replace(benchmark_config(load(path), path) if path else BenchmarkConfig(), **given)


# The names that a configuration may use.
BACKENDS = ("onnxruntime",)
GRAPH_LEVELS = ("ORT_DISABLE_ALL", "ORT_ENABLE_BASIC", "ORT_ENABLE_EXTENDED", "ORT_ENABLE_ALL")
EXECUTION_MODES = ("ORT_SEQUENTIAL", "ORT_PARALLEL")
LOG_LEVELS = ("VERBOSE", "INFO", "WARNING", "ERROR", "FATAL")


def _one_of(kind: str, names: tuple[str, ...], value: str) -> str:
    if value not in names:
        raise ValueError(f"unknown {kind}: {value!r}; one of {', '.join(names)}")
    return value


def parse_backend(value: str) -> str:
    return _one_of("backend", BACKENDS, value)


def parse_graph_level(value: str) -> str:
    return _one_of("graph optimization level", GRAPH_LEVELS, value)


def parse_execution_mode(value: str) -> str:
    return _one_of("execution mode", EXECUTION_MODES, value)


def parse_log_level(value: str) -> int:
    """The level's number, from 0."""
    return LOG_LEVELS.index(_one_of("log severity", LOG_LEVELS, value))
