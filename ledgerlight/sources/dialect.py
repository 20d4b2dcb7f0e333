"""How a delimited file is written: encoding, delimiter, quotes, header. Found from its first bytes; encoding and width are checked on all rows when it is loaded."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

#: Bytes that are looked at, and the delimiters there are.
HEAD, DELIMITERS = 128 * 1024, ",;\t|"


class DialectError(ValueError):
    """The file isn't a table, or it can't be told how it is written."""


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    quotechar: str
    has_header: bool
    names: tuple[str, ...] = ()


def encoding_of(head: bytes) -> str:
    """By the byte order mark, else utf-8 where the bytes are that, else cp1252."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    for cut in range(4):  # the last character may be cut
        try:
            head[: len(head) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return "utf-8"
    return "cp1252"


def _rows(text: str, delimiter: str, quote: str, whole: bool) -> list[list[str]]:
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote))
    return [r for r in (rows if whole else rows[:-1] or rows) if r]


def _typed(value: str) -> bool:
    """Whether a value reads as a number, a date or a time."""
    return re.fullmatch(r"[+-]?[\d.,]*\d[\d.,]*(?:[eE][+-]?\d+)?%?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T][\d:.]+)?", value.strip()) is not None


def _header(rows: list[list[str]]) -> bool:
    """Whether the first row names the columns: no value of it is typed. Where that can't be told, it does."""
    return not any(_typed(x) for x in rows[0])


def sniff(head: bytes, whole: bool) -> Dialect:
    """The dialect of a file from its head; `whole` if that is all of it. Rows of the head must be of one width."""
    encoding = encoding_of(head)
    text = head.decode(encoding, "ignore")
    if not text.strip():
        raise DialectError("the file is empty")
    quote, wanted = '"', None
    try:
        found = csv.Sniffer().sniff(text, DELIMITERS)
        wanted, quote = found.delimiter, found.quotechar or '"'
    except csv.Error:
        pass
    # the sniffer can be misled (decimal commas) or find nothing: delimiters that split all rows evenly come first
    widths = {d: [len(r) for r in _rows(text, d, quote, whole)] for d in DELIMITERS}
    even = {d: n[0] for d, n in widths.items() if n and min(n) == max(n) and n[0] > 1}
    if even:
        delimiter = wanted if wanted in even else max(even, key=lambda d: even[d])
    elif wanted:
        delimiter = wanted
    elif all(max(n, default=1) == 1 for n in widths.values()):
        delimiter = ","  # one column
    else:
        raise DialectError("no delimiter splits the rows evenly")
    rows = _rows(text, delimiter, quote, whole)
    width = len(rows[0])
    for k, r in enumerate(rows):
        if len(r) != width:
            raise DialectError(f"row {k + 1} has {len(r)} fields, the first {width}")
    header = _header(rows)
    names = [x.strip() or f"column{k}" for k, x in enumerate(rows[0])] if header else [f"column{k}" for k in range(width)]
    seen: dict[str, int] = {}
    for k, n in enumerate(names):
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        if seen[n.lower()] > 1:
            names[k] = f"{n}_{seen[n.lower()]}"
    return Dialect(encoding, delimiter, quote, header, tuple(names))
