"""The process and its workers: usable cores, timed stages, and lost workers said plainly."""

from __future__ import annotations

import logging
import math
import os
import time
from contextlib import contextmanager
from pathlib import Path

from ..errors import ConversionError, LoomError

log = logging.getLogger("matrixloom")

# Fixed texts: how Spark words the loss of a worker.
LOST = ("ExecutorLostFailure", "Python worker exited unexpectedly", "OutOfMemoryError", "Container killed", "exit code 137")


def usable_cpus(root: str = "/") -> int:
    """Cores for this process: its affinity, no more than any control group's quota, part cores rounded up. root is where /proc and /sys lie."""
    return max(1, min([os.process_cpu_count() or 1, *(math.ceil(quota / period) for quota, period in _quotas(Path(root)))]))


def _quotas(root: Path) -> list[tuple[int, int]]:
    """(quota, period) of the control groups that limit this process: its own and those above it, or the files of the first version."""
    groups = root / "sys/fs/cgroup"
    own = next((line[3:] for line in _text(root / "proc/self/cgroup").splitlines() if line.startswith("0::")), "/")
    parts = [p for p in own.split("/") if p not in ("", "..")]
    found = [_text(groups.joinpath(*parts[:i], "cpu.max")).split() for i in range(len(parts) + 1)]
    found.append([_text(groups / "cpu" / name).strip() for name in ("cpu.cfs_quota_us", "cpu.cfs_period_us")])
    return [(int(pair[0]), int(pair[1])) for pair in found if len(pair) == 2 and all(x.isdigit() and int(x) for x in pair)]


def _text(path: Path) -> str:
    try:
        return path.read_text()
    except OSError:
        return ""


@contextmanager
def stage(name: str):
    """Logs a stage and its seconds; also a decorator. A lost worker becomes a ConversionError that says what helps."""
    start = time.monotonic()
    log.info("%s", name)
    try:
        yield
    except LoomError:
        raise
    except Exception as e:
        if any(text in str(e) for text in LOST):
            raise ConversionError(f"{name}: a worker was lost, most often for want of memory; give executors more memory, or run fewer tasks at once (--cpus)") from e
        raise
    log.info("%s: %.1f s", name, time.monotonic() - start)
