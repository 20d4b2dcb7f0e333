"""Small bundled data sets, made by rule: an id gives the same file every time; other ids are errors."""

from __future__ import annotations

import csv
import io
import random
from collections.abc import Callable
from datetime import date, timedelta


def _catering(rng: random.Random) -> tuple[list[str], list[list]]:
    head = ["order_ref", "event_date", "client", "city", "event_type", "menu", "guests", "price_per_guest", "order_total", "status"]
    rows = []
    for k in range(202):
        guests, price = rng.randrange(8, 240), rng.randrange(900, 6400) / 100
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(366))
        rows.append([f"CT-{1000 + k}", day.strftime("%d/%m/%Y"), f"Client {rng.randrange(40)}", rng.choice(["Arden", "Bexley", "Corby"]), rng.choice(["wedding", "lunch", "launch"]), rng.choice(["garden", "grill", "buffet"]), guests, f"{price:.2f}", f"{guests * price:.2f}", rng.choice(["completed"] * 8 + ["provisional", "cancelled"])])
    return head, rows


def _storefront(rng: random.Random) -> tuple[list[str], list[list]]:
    goods = {"kitchen": ["bowl", "ladle", "whisk"], "garden": ["trowel", "pot"], "office": ["stapler", "tray", "clip"]}
    rows = []
    for k in range(198):
        kind = rng.choice(list(goods))
        day = date(2024, 1, 1) + timedelta(days=k)
        rows.append([f"L{k:05}", day.isoformat(), kind, rng.choice(goods[kind]), rng.randrange(1, 12), f"{rng.randrange(150, 4000) / 100:.2f}"])
    return ["line_id", "sale_date", "category", "product", "units", "price_each"], rows


def _sensors(rng: random.Random) -> tuple[list[str], list[list]]:
    rows = [[f"ST-{s}", (date(2024, 1, 1) + timedelta(days=d)).isoformat(), round(rng.gauss(11, 6), 2), rng.randrange(30, 101), round(abs(rng.gauss(14, 8)), 2), round(rng.gauss(1012, 8), 2)] for s in ("MOOR", "QUAY", "HILL", "DALE") for d in range(60)]
    return ["station", "reading_date", "temperature_c", "humidity_pct", "wind_kph", "pressure_hpa"], rows


_SAMPLES: dict[str, Callable[[random.Random], tuple[list[str], list[list]]]] = {"catering": _catering, "storefront": _storefront, "sensors": _sensors}


def names() -> list[str]:
    return sorted(_SAMPLES)


def content(name: str) -> bytes:
    """The file of a sample; KeyError for any other name."""
    head, rows = _SAMPLES[name](random.Random(name))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([head, *rows])
    return out.getvalue().encode()
