"""Small helpers for local files of the driver (logs, reports)."""

from __future__ import annotations

import logging
import os
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path


def ensure_dir(path: str | Path) -> Path:
    path = Path(path)
    if str(path):
        path.mkdir(parents=True, exist_ok=True)
    return path


def backup(path: str | Path, suffix: str = ".bak") -> Path | None:
    """A copy beside the file; nothing if there is no file."""
    path = Path(path)
    return Path(shutil.copy2(path, f"{path}{suffix}")) if path.exists() else None


def readable_size(n_bytes: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n_bytes < 1024:
            return f"{n_bytes:.1f} {unit}"
        n_bytes /= 1024
    return f"{n_bytes:.1f} TB"


def with_extension(folder: str | Path, extension: str, recursive: bool = False) -> list[Path]:
    end = extension if extension.startswith(".") else f".{extension}"
    return sorted(Path(folder).glob(f"{'**/' if recursive else ''}*{end}"))


def remove_older(folder: str | Path, hours: float, pattern: str = "*.tmp") -> int:
    limit = time.time() - 3600 * hours
    old = [p for p in Path(folder).glob(pattern) if p.is_file() and p.stat().st_mtime < limit]
    for p in old:
        p.unlink()
    return len(old)


def setup_logging(level: str = "INFO", path: str | None = None) -> logging.Logger:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        if folder := os.path.dirname(path):
            os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=level.upper(), format="%(asctime)s %(name)s %(levelname)s %(message)s", handlers=handlers, force=True)
    return logging.getLogger("termloom")


@contextmanager
def timed(name: str, spark=None) -> Iterator[None]:
    """Logs how long a step took and names its Spark jobs."""
    log, start = logging.getLogger("termloom"), time.time()
    if spark is not None:
        spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        if spark is not None:
            spark.sparkContext.setJobDescription(None)
        log.info("%s took %.2f s", name, time.time() - start)
