"""An optional log of runs: one JSON line each. A log that can't be written never ends a run."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


def sanitize(name: str, most: int = 120) -> str:
    """A name of letters, digits and ``_-./`` only."""
    return re.sub(r"[^\w./-]+", "_", name.strip(), flags=re.A).strip("_")[:most] or "unnamed"


class Run:
    """Parameters and metrics of one run."""

    def __init__(self, name: str):
        self.name, self.params, self.metrics = sanitize(name), {}, {}

    def param(self, **values) -> None:
        self.params |= {sanitize(k): str(v) for k, v in values.items()}

    def metric(self, **values: float | None) -> None:
        """Numbers only; null and not-a-number are left out."""
        self.metrics |= {sanitize(k): float(v) for k, v in values.items() if v is not None and v == v}


@contextmanager
def track(name: str, path: str | None = None, **params) -> Iterator[Run]:
    """Log a run to ``path`` when it ends, also if it fails; without a path nothing is written."""
    run, began, state = Run(name), time.time(), "ok"
    run.param(**params)
    try:
        yield run
    except BaseException as e:
        state = type(e).__name__
        raise
    finally:
        if path:
            line = {"name": run.name, "state": state, "seconds": round(time.time() - began, 3), "params": run.params, "metrics": run.metrics}
            try:
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                with open(path, "a") as f:
                    f.write(json.dumps(line) + "\n")
            except OSError:
                pass
