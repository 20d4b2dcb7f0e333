"""Settings of the service: the command line comes before the environment (LEDGERLIGHT_...), which comes before the defaults."""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

PREFIX = "LEDGERLIGHT_"


@dataclass(frozen=True)
class Settings:
    #: Folder of the data sets, shared by all executors; folder of uploads, the same.
    root: str = ""
    uploads: str = ""
    host: str = "127.0.0.1"
    port: int = 8000
    #: `replay` (recorded answers only, no credentials) or the callable `module:name` that answers requests.
    provider: str = "replay"
    #: Folder of recorded answers, and whether new ones of the provider are recorded there.
    answers: str = "answers"
    record: bool = False
    #: Largest upload, and bytes that must stay free on the disk of the uploads; at 0 an upload only has to fit.
    max_upload: int = 500 * 1024 * 1024
    min_free: int = 0


def _read(name: str, kind: str, text: str) -> Any:
    if kind == "bool":
        if text.lower() not in ("1", "true", "yes", "0", "false", "no", ""):
            raise ValueError(f"{PREFIX}{name.upper()} must be true or false")
        return text.lower() in ("1", "true", "yes")
    return int(text) if kind == "int" else text


def settings(arguments: list[str] | None = None, environment: Mapping[str, str] = os.environ) -> Settings:
    p = argparse.ArgumentParser(prog="ledgerlight", description="Serve data sets and queries over HTTP")
    p.add_argument("command", nargs="?", choices=["serve"], default="serve")
    for f in fields(Settings):
        if f.type == "bool":
            p.add_argument(f"--{f.name}", action="store_true", default=None)
        else:
            p.add_argument(f"--{f.name.replace('_', '-')}", type=int if f.type == "int" else str)
    p.add_argument("--replay", action="store_const", const="replay", dest="provider", help="the same as --provider replay")
    given = vars(p.parse_args(arguments))
    out = {f.name: _read(f.name, f.type, environment[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in environment}
    out |= {k: v for k, v in given.items() if v is not None and k != "command"}
    if not out.get("root"):
        p.error("--root or LEDGERLIGHT_ROOT must name the folder of the data sets")
    return Settings(**out)


def provider_of(s: Settings) -> Callable[[dict], Any]:
    """Recorded answers, and behind them, if one is named, a provider; its answers are kept with `record` only."""
    from ledgerlight.plans.propose import Replay

    if s.provider == "replay":
        return Replay(s.answers)
    module, _, name = s.provider.partition(":")
    live = getattr(importlib.import_module(module), name)
    return Replay(s.answers, live, keep=s.record)
