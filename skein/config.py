"""Settings: an option given in code, else the environment, else a file, else the default."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {"max_retries": 3, "handler_timeout_s": 60, "max_concurrency": 200, "min_concurrency": 1, "batch_size": 1000, "page_size": 10_000, "persist_interval_s": 60}


def setting(name: str, option: Any = None, path: str | None = None, prefix: str = "SKEIN_") -> Any:
    if option is not None:
        return option
    if (found := os.environ.get(prefix + name.upper())) is not None:
        try:
            return json.loads(found)
        except ValueError:
            return found
    if path and Path(path).exists() and name in (given := json.loads(Path(path).read_text())):
        return given[name]
    return DEFAULTS[name]
