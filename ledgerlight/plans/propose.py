"""Proposing roles: from the profile alone, or by a pluggable provider whose answers are recorded and replayed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from ledgerlight.operators.profile import ColumnProfile, Profile
from ledgerlight.plans.model import ENTITIES, NUMERIC, ROLES, Claim

#: Fixed values of the rules.
KEY_UNIQUE, WHOLE, ID_LIKE, MANY, UNIQUE_TEXT, SURE = 0.999, 0.9, 1000, 20, 0.9, 0.99


def _id_like(c: ColumnProfile) -> bool:
    """Whole numbers of so many values that they name things rather than count them."""
    return c.type == "integer" and (c.distinct >= ID_LIKE or c.uniqueness >= 0.5)


def heuristic(profile: Profile) -> list[Claim]:
    """Claims by what the columns hold, never by what they are called; where two readings are as good, none."""
    cols, claims, taken = profile.columns, [], set()

    def claim(column: str, role: str, confidence: float, reason: str, entity: str | None = None) -> None:
        claims.append(Claim(column, role, entity, confidence, [reason], "heuristic"))
        taken.add(column)

    def determined(a: str, b: str) -> bool:
        return bool((e := profile.strength(a, b)) and e.strength >= SURE)

    times = [c.name for c in cols.values() if c.type in ("date", "timestamp")]
    for t in times:
        claim(t, "event_time", 0.9 if t == times[0] else 0.5, "its type is a time")
    for c in cols.values():
        if c.name not in taken and c.distinct >= 2 and c.uniqueness < 0.5 and times and determined(times[0], c.name) and c.type in ("text", "integer"):
            claim(c.name, "dimension", 0.7, "the time determines it")
    for c in cols.values():
        if c.name not in taken and (c.type == "boolean" or c.distinct == 2):
            claim(c.name, "flag", 0.7, "it has two values")
    keys = [c for c in cols.values() if c.name not in taken and c.type in ("text", "integer") and c.uniqueness < KEY_UNIQUE and any(determined(c.name, t) for t in times)]
    if keys:
        claim(max(keys, key=lambda c: c.uniqueness).name, "transaction_key", 0.7, "it determines the time")
    whole = [c for c in cols.values() if c.name not in taken and c.type in NUMERIC and (c.integer_ratio or 0) >= WHOLE and c.distinct > 2 and not _id_like(c)]
    quantity = whole[0].name if whole else None
    if quantity:
        claim(quantity, "additive_quantity", 0.5, "mostly whole numbers that don't name anything")
    money = [c for c in cols.values() if c.name not in taken and c.type == "decimal" and (c.integer_ratio or 0) < WHOLE]
    if len(money) == 1:
        claim(money[0].name, "monetary_rate", 0.5, "the only decimal column")
    elif len(money) == 2 and quantity:
        low, high = sorted(money, key=lambda c: float(c.max or 0))
        claim(low.name, "monetary_rate", 0.45, "the lesser of two decimal columns")
        claim(high.name, "monetary_amount", 0.4, "the greater of two decimal columns")
    for c in cols.values():
        if c.name in taken or c.type not in ("text", "integer"):
            continue
        if c.type == "text" and c.uniqueness >= UNIQUE_TEXT:
            claim(c.name, "description" if any(" " in s for s in c.samples) else "ignore", 0.4, "nearly every value is its own")
        elif c.distinct >= MANY:
            claim(c.name, "entity_key", 0.4, "many repeated values", "other")
        elif c.type == "text":
            claim(c.name, "dimension", 0.5, "few values")
    return claims


def evidence(profile: Profile) -> dict[str, Any]:
    """What a provider gets to see of a profile."""
    return {c.name: {"type": c.type, "null_rate": round(c.null_rate, 6), "distinct": c.distinct, "uniqueness": round(c.uniqueness, 6), "top": c.top[:5], "samples": c.samples, "determines": sorted(d.dependent for d in profile.dependencies if d.determinant == c.name)} for c in profile.columns.values()}


class Missing(Exception):
    """No recorded answer to a request."""


class Replay:
    """Answers of a provider by the hash of the request; with a live provider, new ones are recorded unless told not to."""

    def __init__(self, folder: str, live: Callable[[dict], Any] | None = None, keep: bool = True):
        self.folder, self.live, self.keep = Path(folder), live, keep

    def key(self, request: dict[str, Any]) -> str:
        return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def __call__(self, request: dict[str, Any]) -> Any:
        at = self.folder / f"{self.key(request)}.json"
        if at.exists():
            return json.loads(at.read_text())["response"]
        if self.live is None:
            raise Missing(at.stem)
        response = self.live(request)
        if not self.keep:
            return response
        self.folder.mkdir(parents=True, exist_ok=True)
        part = at.with_suffix(".part")
        part.write_text(json.dumps({"request": request, "response": response}, ensure_ascii=False))
        part.replace(at)
        return response


def proposed(profile: Profile, provider: Callable[[dict], Any] | None = None) -> list[Claim]:
    """Claims of a provider, unknown columns and roles dropped; the heuristic's where it has no answer."""
    if provider is None:
        return heuristic(profile)
    try:
        raw = provider({"task": "roles", "roles": list(ROLES), "entities": list(ENTITIES), "columns": evidence(profile)})
    except Missing:
        return heuristic(profile)
    return [Claim(c["column"], c["role"], c.get("entity"), float(c.get("confidence", 0.5)), list(c.get("reasons", [])), "provider") for c in raw if c.get("column") in profile.columns and c.get("role") in ROLES and c.get("entity") in (None, *ENTITIES)]
