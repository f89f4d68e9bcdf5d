"""Messages of the engine: on the console, and in a file for each day."""

from __future__ import annotations

import logging
from datetime import date
from pathlib import Path

FORMAT = "%(asctime)s | %(levelname)s | %(name)s | %(message)s"


def logger(name: str = "ledgerlark", folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger; asking again adds no second handler. folder: where the day's file is."""
    out = logging.getLogger(name)
    out.setLevel(level)
    wanted = {"console": None} | ({"file": Path(folder, f"{date.today():%Y-%m-%d}.log")} if folder else {})
    have = {h.get_name() for h in out.handlers}
    for kind, path in wanted.items():
        if (label := f"{name}:{kind}:{path}") in have:
            continue
        if path is not None:
            path.parent.mkdir(parents=True, exist_ok=True)
        handler = logging.StreamHandler() if path is None else logging.FileHandler(path, encoding="utf-8")
        handler.set_name(label)
        handler.setFormatter(logging.Formatter(FORMAT))
        out.addHandler(handler)
    return out
