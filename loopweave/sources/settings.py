"""Settings of a run: sections with defaults, read from a JSON or YAML file."""

from __future__ import annotations

import json
import os
from typing import Any

VARIABLE = "CYCLE_REFACTOR_CONFIG"
DEFAULTS: dict[str, dict[str, Any]] = {
    "retriever": {"search_type": "similarity", "k": 4}, "refactor": {"context_window": 4096, "prefer_full_files": True, "compact_prompts": False, "sequential": False, "simple_format_threshold_b": 14},
    "pipeline": {"agents_order": ["describer", "refactor", "validator", "explainer"], "max_iterations": 1, "dry_run": False, "enable": {}}, "report": {"max_log_chars": 8000, "max_llm_excerpt": 2000}, "prompts": {}, "auth": {},
}


def _scalar(s: str) -> Any:
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    low = s.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            continue
    return s


def read_mapping(text: str) -> dict:
    """A mapping out of JSON, or of YAML as far as settings go: nested keys, lists of scalars, comments."""
    try:
        v = json.loads(text)
        return v if isinstance(v, dict) else {}
    except ValueError:
        pass
    root: dict = {}
    stack: list[tuple[int, Any]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for raw in text.splitlines():
        line = raw.split(" #", 1)[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip() or line.strip() == "---":
            continue
        depth = len(line) - len(line.lstrip())
        body = line.strip()
        if body.startswith("- "):
            if last is not None:
                if not isinstance(last[0].get(last[1]), list):
                    last[0][last[1]] = []
                last[0][last[1]].append(_scalar(body[2:]))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, value = body.partition(":")
        at = stack[-1][1]
        if value.strip():
            at[key.strip()] = _scalar(value)
        else:
            at[key.strip()] = {}
            stack.append((depth, at[key.strip()]))
        last = (at, key.strip())
    return root


def load_settings(path: str | None = None) -> dict[str, dict]:
    """The settings of ``path``, else of the file that the environment names, over :data:`DEFAULTS`; a missing file changes
    nothing. A value of ``auth`` that ends in ``_ENV`` names a variable of the environment."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    path = path or os.environ.get(VARIABLE, "config.yml")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for k, v in read_mapping(f.read()).items():
                out[k] = {**out.get(k, {}), **v} if isinstance(v, dict) else v
    out["auth"] = {k: os.environ.get(v) if isinstance(v, str) and v.endswith("_ENV") else v for k, v in (out.get("auth") or {}).items()}
    return out


def enabled(settings: dict, stage: str) -> bool:
    """Whether a stage is on; it is unless switched off."""
    return bool(settings.get("pipeline", {}).get("enable", {}).get(stage, True))


def prompt(settings: dict, stage: str, compact: bool = False) -> str:
    """The template of a stage, the compact one where asked for and there is one; empty without any."""
    from .templates import load_template

    p = settings.get("prompts", {})
    return load_template((p.get(f"{stage}_compact") if compact else None) or p.get(stage) or "")
