"""Parameters of the runs: rules, defaults and checks. All errors of a configuration are raised together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Rule:
    kinds: tuple[type, ...]
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple | None = None
    items: tuple[type, ...] = (int, float)
    #: At least one parameter of a group must be given.
    group: str | None = None


def _int(**k) -> Rule:
    return Rule((int,), **k)


def _numbers(**k) -> Rule:
    return Rule((int, list), **k)


def _text(**k) -> Rule:
    return Rule((str,), **k)


#: The parameters of the runs, with their defaults and bounds.
_IMAGE = {"img_path": _text(required=True), "output_folder": _text(required=True), "workspace": _text(default=""), "base_name": _text(), "boundary_path": _text()}
_MESH = {"is_make_meshes": Rule((bool,), default=False), "downsample_scale": _int(default=10, low=1, high=100), "step_size": _int(default=1, low=1, high=10)}
_THRESHOLDS = {"thresholds": _numbers(required=True, low=0), "upper_thresholds": _numbers(low=0), "num_threads": _int(low=1, default=1)}

RULES: dict[str, dict[str, Rule]] = {
    "seeds": {**_IMAGE, **_MESH, **_THRESHOLDS, "erosion_steps": _int(required=True, low=0, high=1000), "segments": _int(required=True, low=1), "footprints": Rule((str, list), items=(str,))},
    "grow": {
        **_IMAGE, **_MESH, **_THRESHOLDS, "seg_path": _text(required=True), "dilation_steps": _numbers(required=True, low=0), "touch_rule": _text(required=True, choices=("stop", "overwrite")),
        "save_every_n_iters": _int(low=1), "grow_to_end": Rule((bool,), default=False), "final_grow_output_folder": _text(), "use_simple_naming": Rule((bool,), default=True), "to_grow_ids": Rule((list,), low=0),
        "is_sort": Rule((bool,), default=False), "no_growth_max_iter": _int(default=3, low=1), "min_growth_size": _int(default=50, low=0),
    },
    "adaptive": {
        **_IMAGE, **_THRESHOLDS, "erosion_steps": _int(required=True, low=0, high=1000), "segments": _numbers(required=True, low=1), "background": _int(default=0, low=0), "sort": Rule((bool,), default=True),
        "no_split_max_iter": _int(default=3, low=0), "min_size": _int(default=1, low=1), "min_split_ratio": Rule((int, float), default=0, low=0, high=1), "min_split_total_ratio": Rule((int, float), default=0, low=0, high=1),
        "save_every_iter": Rule((bool,), default=True), "init_segments": _int(low=1), "last_segments": _int(low=1), "footprints": Rule((str, list), items=(str,)),
        "split_size_limit": Rule((list,), default=(None, None), items=(int, type(None))), "split_convex_hull_limit": Rule((list,), default=(None, None), items=(int, type(None))),
    },
    "mesh": {"num_threads": _int(required=True, low=1), "output_folder": _text(required=True), "input_folder": _text(group="input"), "img_path": _text(group="input"), "downsample_scale": _MESH["downsample_scale"], "step_size": _MESH["step_size"]},
}


def checked(kind: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """given with defaults; raises ValueError with every fault found."""
    rules, faults = RULES[kind], []
    faults += [f"{k}: unknown" for k in given if k not in rules]
    for name, rule in rules.items():
        value = given.get(name)
        if value is None:
            if rule.required:
                faults.append(f"{name}: missing")
            continue
        if not isinstance(value, rule.kinds) or isinstance(value, bool) and bool not in rule.kinds:
            faults.append(f"{name}: {type(value).__name__} isn't one of {', '.join(t.__name__ for t in rule.kinds)}")
            continue
        items = value if isinstance(value, list) else [value]
        if isinstance(value, list) and not all(isinstance(x, rule.items) for x in items):
            faults.append(f"{name}: an item has the wrong type")
            continue
        numbers = [x for x in items if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if rule.low is not None and any(x < rule.low for x in numbers) or rule.high is not None and any(x > rule.high for x in numbers):
            faults.append(f"{name}: out of [{rule.low}, {rule.high}]")
        if rule.choices and value not in rule.choices:
            faults.append(f"{name}: not one of {', '.join(rule.choices)}")
    for group in {r.group for r in rules.values() if r.group}:
        if not any(given.get(k) is not None for k, r in rules.items() if r.group == group):
            faults.append(f"one of {', '.join(k for k, r in rules.items() if r.group == group)} is needed")
    if faults:
        raise ValueError("; ".join(faults))
    return {name: given.get(name) if given.get(name) is not None else rule.default for name, rule in rules.items()}


def load(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, Any]:
    """Parameters from a YAML or JSON file anywhere that Spark reads; with kind, checked with defaults."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    given = yaml.safe_load(text["value"]) if text else None  # JSON is YAML
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no parameters")
    return checked(kind, given) if kind else given


def save(spark: SparkSession, path: str, parameters: Mapping[str, Any]) -> None:
    """The parameters of a run as a YAML file in the folder `path`. Arrays and tables aren't parameters and are left out."""
    import yaml

    plain = lambda x: isinstance(x, (str, int, float, bool, type(None))) or isinstance(x, (list, tuple)) and all(map(plain, x)) or isinstance(x, dict) and all(map(plain, x.values()))
    text = yaml.safe_dump({k: list(v) if isinstance(v, tuple) else v for k, v in parameters.items() if plain(v)}, sort_keys=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def thresholds(lower: int | Sequence[float], upper: int | Sequence[float] | None, rising: bool) -> list[tuple[int, int | None]]:
    """Pairs of whole thresholds. Seeds go inwards (lower ends rise, upper ends fall), growth outwards."""
    lower = [int(x) for x in (lower if isinstance(lower, Sequence) else [lower])]
    upper = [None] * len(lower) if upper is None else [int(x) for x in (upper if isinstance(upper, Sequence) else [upper])]
    if len(lower) != len(upper):
        raise ValueError("as many lower as upper thresholds are needed")
    if any(u is not None and u < x for x, u in zip(lower, upper)):
        raise ValueError("an upper threshold is below its lower one")
    sign = 1 if rising else -1
    ends = [u for u in upper if u is not None]
    if any(sign * a > sign * b for a, b in zip(lower, lower[1:])) or any(sign * a < sign * b for a, b in zip(ends, ends[1:])):
        raise ValueError("thresholds are out of order")
    return list(zip(lower, upper))


def footprints(names: str | Sequence[str], steps: int, known: Sequence[str]) -> list[str]:
    """A footprint for each erosion step."""
    names = [names] * steps if isinstance(names, str) else list(names)
    if len(names) != steps:
        raise ValueError(f"{steps} footprints are needed")
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown footprints: {', '.join(bad)}")
    return names


def segment_list(segments: int | Sequence[int], erosion_steps: int | None, n_thresholds: int, first: int | None = None, last: int | None = None) -> list[int]:
    """How many components to keep at each step of adaptive seeds: erosion_steps + 2 or n_thresholds + 1 numbers."""
    n = n_thresholds + 1 if erosion_steps is None else erosion_steps + 2
    out = [segments] * n if isinstance(segments, int) else list(segments)
    if len(out) != n:
        raise ValueError(f"{n} segments are needed")
    if first is not None:
        out[0] = first
    if last is not None:
        out[-1] = last
    return out


def adaptive_mode(thresholds: int | Sequence[int]) -> str:
    """One threshold: erosion mode; several: threshold mode."""
    return "erosion" if isinstance(thresholds, int) or len(thresholds) == 1 else "threshold"
