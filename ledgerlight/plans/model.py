"""What is known about a data set: the roles of its columns, how far they are proven, and its conventions."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, ClassVar

#: The roles a column can have, and the entities of a key.
ROLES = ("event_time", "transaction_key", "entity_key", "additive_quantity", "monetary_rate", "monetary_amount", "discount", "dimension", "flag", "description", "ignore")
ENTITIES = ("customer", "product", "location", "other")
#: Roles whose values may be added up over any rows.
ADDITIVE = ("additive_quantity", "monetary_amount", "discount")
NUMERIC = ("integer", "decimal")
VERSION = 4


@dataclass
class Claim:
    column: str
    role: str
    entity: str | None = None
    confidence: float = 1.0
    reasons: list[str] = field(default_factory=list)
    source: str = "declared"  # or heuristic, provider


@dataclass
class Check:
    """Outcome of one test of a claim. A failed confirming test leaves the claim unproven, others refute it."""

    name: str
    passed: bool
    share: float | None = None
    support: int = 0
    detail: str = ""
    confirming: bool = False


@dataclass
class Binding:
    column: str
    role: str
    entity: str | None = None
    confidence: float = 1.0
    source: str = "declared"
    checks: list[Check] = field(default_factory=list)

    @property
    def status(self) -> str:
        if any(not c.passed and not c.confirming for c in self.checks):
            return "refuted"
        return "verified" if self.checks and all(c.passed for c in self.checks) else "unverified"


@dataclass
class Returns:
    """How returned lines show. kind: none, explicit_flag, explicit_category, derived_key_prefix, derived_negative_quantity."""

    kind: str = "none"
    column: str | None = None
    values: list[str] = field(default_factory=list)
    confidence: float = 0.0


@dataclass
class Partition:
    """A dimension whose values a flag splits into facts and others (charges, fees)."""

    column: str
    fact_value: str | None
    flag: str


@dataclass
class Label:
    label: str
    entity: str
    strength: float
    support: int


@dataclass
class Completeness:
    flag: str
    period: str


@dataclass
class Values:
    values: list[str]
    exhaustive: bool


@dataclass
class Dependency:
    determinant: str
    dependent: str
    strength: float
    support: int


@dataclass
class Measure:
    name: str
    formula: str
    columns: list[str]
    available: bool = True
    additive: bool = True
    missing: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


@dataclass
class Model:
    """The frozen model of a data set. Everything a query needs besides the rows."""

    dataset_id: str
    row_count: int
    types: dict[str, str]
    bindings: list[Binding]
    coverage: dict[str, float] = field(default_factory=dict)
    returns: Returns = field(default_factory=Returns)
    partition: Partition | None = None
    labels: list[Label] = field(default_factory=list)
    period_columns: list[str] = field(default_factory=list)
    completeness: Completeness | None = None
    values: dict[str, Values] = field(default_factory=dict)
    measures: list[Measure] = field(default_factory=list)
    date_notes: dict[str, str] = field(default_factory=dict)
    parsers: dict[str, str] = field(default_factory=dict)  # text column -> order of its dates
    scales: dict[str, int] = field(default_factory=dict)  # decimals of a column, where few
    latest: str | None = None  # the latest event time, from which rolling windows count back
    claims: list[Claim] = field(default_factory=list)  # what the model was built from
    version: int = VERSION
    #: fields that an earlier format doesn't have; they must be derived again
    lacking: ClassVar[set[str]] = frozenset()

    def in_role(self, role: str) -> list[str]:
        """Columns in a role, the surest first; refuted ones are left out."""
        found = [b for b in self.bindings if b.role == role and b.status != "refuted"]
        return [b.column for b in sorted(found, key=lambda b: -b.confidence)]

    def first(self, role: str) -> str | None:
        return next(iter(self.in_role(role)), None)

    def binding(self, column: str) -> Binding | None:
        return next((b for b in self.bindings if b.column == column and b.role != "ignore"), None)

    def bound(self) -> list[str]:
        return [b.column for b in self.bindings if b.role != "ignore"]

    def entity(self, kind: str) -> str | None:
        return next((c for c in self.in_role("entity_key") if (b := self.binding(c)) and b.entity == kind), None)

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    def numeric(self) -> list[str]:
        return [c for c, t in self.types.items() if t in NUMERIC]

    def product_columns(self) -> set[str]:
        """Columns that tell products apart: product keys, their labels, and descriptions."""
        keys = {c for c in self.in_role("entity_key") if (b := self.binding(c)) and b.entity == "product"}
        return keys | {x.label for x in self.labels if x.entity in keys} | ({d for d in self.in_role("description")} if keys else set())

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Model:
        raw: dict[str, Any] = json.loads(text)
        if raw.get("version", 1) > VERSION:
            raise ValueError(f"the model is of version {raw['version']}, later than {VERSION}")
        lacking = {f.name for f in dataclasses.fields(cls)} - raw.keys()
        raw = {k: v for k, v in raw.items() if k in {f.name for f in dataclasses.fields(cls)}} | {"version": VERSION}
        raw["bindings"] = [Binding(**{**b, "checks": [Check(**c) for c in b.get("checks", [])]}) for b in raw["bindings"]]
        for name, kind in (("returns", Returns), ("partition", Partition), ("completeness", Completeness)):
            if raw.get(name):
                raw[name] = kind(**raw[name])
            else:
                raw.pop(name, None)
        raw["labels"] = [Label(**x) for x in raw.get("labels", [])]
        raw["measures"] = [Measure(**x) for x in raw.get("measures", [])]
        raw["values"] = {k: Values(**v) for k, v in raw.get("values", {}).items()}
        # an earlier format kept no claims of its own: its bindings hold them
        raw["claims"] = [Claim(**c) for c in raw["claims"]] if "claims" in raw else [Claim(b.column, b.role, b.entity, b.confidence, [], b.source) for b in raw["bindings"]]
        model = cls(**raw)
        model.lacking = lacking
        return model
