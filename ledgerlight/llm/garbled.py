"""Text that was decoded by a wrong encoding: finding it, and restoring the original.

A hidden Markov model labels the text. One state is clean; every other stands for one encoding pair:
bytes of one encoding that were read as another (or a chain of such errors). A state's emission is the
chance of the text that its inverse transform gives, by a character-bigram model of the whole corpus;
only runs that hold a character outside ASCII can tell the states apart, so those are the steps of the
Viterbi path and the ASCII between them costs nothing. Each span in a pair's state gets that state's
inverse transform. Two further states stand for characters that are lost: U+FFFD, and question marks
where a word's letters stand, of which the model says that letters outside ASCII are likelier there.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings whose bytes may have been read by another. `western` takes cp1252, and
#: Latin-1 for the bytes that cp1252 leaves open.
SINGLE = ("western", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850")
DOUBLE = ("cp932", "euc_jp", "gbk")
LOST = "�"
#: Costs, in nats, of entering a state from clean: pairs with UTF-8, whose bytes have a form of their
#: own; the same where the reader is Cyrillic, whose text can have that form by chance; other pairs; and
#: for each further link of a chain. Leaving a state costs LEAVE.
ENTER_UTF8, ENTER_CYRILLIC, ENTER_PLAIN, ENTER_LINK, LEAVE = 2.5, 4.0, 4.8, 2.0, 0.4
#: The model's size: so many pairs of characters, the most frequent of the corpus, have a chance of
#: their own (about 100 bytes each on the driver and in each worker); others get their characters' chances.
PAIRS = 200_000
#: Weight of the single-character model within the bigram model.
BACK = 8.0
#: What a symbol between blanks can speak for a pair of single-byte encodings, at most.
ALONE = 1.0
#: Words after which a lost character is only spoken of.
SPOKEN = ("sign", "character", "symbol", "glyph")
QUOTES = {"“": "”", "„": "“”", "«": "»", "‘": "’", "‚": "‘’", "»": "«"}

#: Cyrillic letters that pass for Latin ones. Words disguised with them are sound text.
LOOKALIKES = str.maketrans("аеорсухіѕјАВЕКМНОРСТХІЅЈ", "aeopcyxisjABEKMHOPCTXISJ")
DISGUISE, ENTER_DISGUISE = ("disguise", "disguise"), 2.5
#: Pairs that one meets often, of a system's own encoding and one read for it.
COMMON = {
    *(("western", r) for r in ("mac_roman", "cp850", "cp437", "cp1251", "koi8-r")),
    *((s, "western") for s in ("mac_roman", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", *DOUBLE)),
    *((s, r) for s in ("cp1251", "koi8-r", "cp866") for r in ("cp1251", "koi8-r", "cp866") if s != r),
    ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"),
}
ENTER_RARE = 13.0
#: Question marks in place of letters: within a word, at its head, or three and more that are a word of their
#: own. A query string behind a path isn't meant.
ASKED = ("?", "?")
_BEFORE, _BEHIND = r"(?<![^\s,;|\"'(\[])", r"(?![^\s,;|\"')\]])"
_LETTERS = re.compile(rf"(?:(?<=[^\W\d_])|{_BEFORE})\?+(?=[^\W\d_])(?!\w+=)|{_BEFORE}\?{{3,}}{_BEHIND}")

_RUN = re.compile(rf"{_LETTERS.pattern}|[^\x00-\x7f]+")


@lru_cache(None)
def _bytes_of(encoding: str) -> tuple[dict[str, int], list[str | None]]:
    """(byte of each character, character of each byte) of a single-byte encoding."""
    codec = "cp1252" if encoding == "western" else encoding
    back: dict[str, int] = {}
    there: list[str | None] = []
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b) if codec.startswith(("cp125", "iso")) else None
        there.append(c)
        if c is not None:
            back[c] = b
    if encoding == "western":
        for b in range(0x80, 0xA0):
            back.setdefault(chr(b), b)
    return back, there


@lru_cache(None)
def _utf8_units(reader: str) -> re.Pattern:
    """Characters, as the reader shows them, of one or more whole UTF-8 sequences."""
    back, _ = _bytes_of(reader)

    def chars(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in back.items() if lo <= b <= hi) + "]"

    tail = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{tail}|{chars(0xF0, 0xF4)}{tail}{tail}{tail})+")


def _undo(run: str, source: str, reader: str) -> str | None:
    """`run` with the error of reading `source` as `reader` taken back, as far as it can be; null if it can't."""
    if reader in DOUBLE:
        try:
            raw = run.encode(reader, "strict")
        except UnicodeEncodeError:
            raw = b"".join(c.encode(reader, "ignore") or c.encode() for c in run.replace(LOST, "?"))
        text = raw.decode(source, "replace")
        # some characters were lost on the way; most must have come back
        return text if text != run and text.count(LOST) * 3 <= len(text) else None
    back, _ = _bytes_of(reader)
    if source == "utf-8":
        changed = False

        def whole(m: re.Match) -> str:
            nonlocal changed
            try:
                text = bytes(back[c] for c in m[0]).decode()
            except UnicodeDecodeError:
                return m[0]
            changed = True
            return text

        text = _utf8_units(reader).sub(whole, run)
        return text if changed else None
    if source in DOUBLE:
        try:
            text = bytes(back[c] for c in run).decode(source)
        except (KeyError, UnicodeDecodeError):
            return None
        return text
    _, there = _bytes_of(source)
    out = []
    for c in run:
        b = back.get(c)
        if b is None or b < 0x80 or (d := there[b]) is None:
            return None
        out.append(d)
    text = "".join(out)
    return text if text != run else None


def _pairs() -> list[tuple[str, str]]:
    utf8 = [("utf-8", r) for r in (*SINGLE, "cp932", "gbk")]
    plain = [(s, r) for s in SINGLE for r in SINGLE if s != r and s != "iso8859-15"]
    wide = [(s, r) for s in ("cp932", "euc_jp", "gbk") for r in ("western", "mac_roman", "cp1251", "iso8859-2", "cp1250", "cp437", "koi8-r")] + [("euc_jp", "cp932"), ("cp932", "euc_jp"), ("cp932", "gbk"), ("euc_jp", "gbk")]
    return utf8 + plain + wide


def _cost(chain: tuple[tuple[str, str], ...]) -> float:
    source, reader = chain[0]
    if chain == ((LOST, LOST),):
        return 0.0
    if chain[0] == ASKED:
        return ENTER_PLAIN
    if chain[0] == DISGUISE:
        return ENTER_DISGUISE
    first = (ENTER_PLAIN if chain[0] in COMMON else ENTER_RARE) if source != "utf-8" else ENTER_CYRILLIC if reader in ("cp1251", "koi8-r", "cp866") else ENTER_UTF8
    return first + sum(ENTER_LINK if further == "utf-8" else ENTER_PLAIN for further, _ in chain[1:])


def _wide(c: str) -> bool:
    return c > "\x7f" and c.isalpha()


class Model:
    """The bigram model and the pairs' emissions; remembers the runs it has seen."""

    def __init__(self, pairs: dict[tuple[str, str], int], single: dict[str, int] | None = None):
        """From the counts of pairs and, where not all pairs are given, of single characters."""
        if single is None:
            single = {}
            for (a, _), n in pairs.items():
                single[a] = single.get(a, 0) + n
        total = sum(single.values()) + len(single) + 1
        self.single = {c: math.log((n + 0.5) / total) for c, n in single.items()}
        self.floor = math.log(0.5 / total)
        self.count, self.pairs = single, pairs
        self.seen: dict[tuple[str, str, str], dict] = {}
        self.all = _pairs()
        # text that was written as UTF-8 once more may have been read wrongly by any common pair before
        self.further = [p for p in self.all if p[0] == "utf-8" and p[1] in SINGLE or p in COMMON and p[0] in SINGLE]
        # letters outside ASCII, taken together: how often they come, and before and after which characters
        self.wide = sum(n for c, n in single.items() if _wide(c))
        self.rate = (self.wide + 0.5) / total
        self.after: dict[str, int] = {}
        self.before: dict[str, int] = {}
        for (a, b), n in pairs.items():
            if _wide(b):
                self.after[a] = self.after.get(a, 0) + n
            if _wide(a):
                self.before[b] = self.before.get(b, 0) + n

    def asked(self, before: str, run: str, after: str) -> float:
        """How much likelier letters outside ASCII are than the question marks of `run`."""

        def share(hits: int, of: int, rate: float) -> float:
            return math.log((hits + BACK * rate) / (of + BACK))

        within = sum(self.after.get(c, 0) for c in self.count if _wide(c)) if len(run) > 1 else 0
        letters = share(self.after.get(before, 0), self.count.get(before, 0), self.rate) + (len(run) - 1) * share(within, self.wide, self.rate)
        return letters + share(self.before.get(after, 0), self.wide, math.exp(self.single.get(after, self.floor))) - self.chance(before, run, after)

    def chance(self, before: str, text: str, after: str) -> float:
        """Log chance of `text` and the character after it, given the one before."""
        out = 0.0
        for b in text + after:
            alone = self.single.get(b, self.floor)
            out += math.log((self.pairs.get((before, b), 0) + BACK * math.exp(alone)) / (self.count.get(before, 0) + BACK))
            before = b
        return out

    def states(self, before: str, run: str, after: str) -> dict[tuple, tuple[float, str]]:
        """For each chain of pairs that can be undone in `run`: how much likelier the text gets, and the text."""
        key = (before, run, after)
        if (known := self.seen.get(key)) is not None:
            return known
        if run[0] == "?":
            self.seen[key] = out = {(ASKED,): (self.asked(before, run, after), run)}
            return out
        now = self.chance(before, run, after)
        out: dict[tuple, tuple[float, str]] = {}

        def deepen(chain: tuple, text: str) -> None:
            for pair in self.all if not chain else self.further:
                restored = _undo(text, *pair)
                if restored is None or restored == text:
                    continue
                gain = self.chance(before, restored, after) - now
                longer = (*chain, pair)
                if gain > 0 or pair[0] == "utf-8":
                    out[longer] = (gain, restored)
                if len(longer) < 3 and pair[0] == "utf-8":
                    deepen(longer, restored)

        deepen((), run)
        plain = run.translate(LOOKALIKES)
        if plain.isascii() and (before.isascii() and before.isalpha() or after.isascii() and after.isalpha()):
            out[(DISGUISE,)] = (self.chance(before, plain, after) - now, plain)
        if LOST in run:
            out[((LOST, LOST),)] = (20.0, run)
        if before.isspace() and after.isspace() and all(c == "…" or unicodedata.category(c) in ("No", "So", "Zs") for c in run):
            # a symbol that stands alone says little of how a text was read: ornaments do
            out = {c: (min(x[0], ALONE) if c[0][0] in SINGLE else x[0], x[1]) for c, x in out.items()}
        out = {c: x for c, x in out.items() if x[0] > -6}
        if len(run) <= 100:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = out
        return out

    def label(self, text: str) -> list[tuple[int, int, tuple, str, float]]:
        """Spans outside the clean state: (start, end, chain, restored text, gain), by the Viterbi path."""
        steps = []
        hope = 0.0
        for m in _RUN.finditer(text):
            a = m.start()
            states = self.states(text[a - 1] if a else "\n", m[0], text[m.end()] if m.end() < len(text) else "\n")
            steps.append((m.start(), m.end(), states))
            if states:
                hope += max(0.0, max(x[0] for x in states.values()))
        # no path through other states can beat the clean one if all gains together don't pay for entering
        if hope <= ENTER_UTF8 and not any(((LOST, LOST),) in s[2] for s in steps):
            return []
        best: dict[tuple | None, tuple[float, tuple | None]] = {None: (0.0, None)}
        for k, (_, _, states) in enumerate(steps):
            leave, at = max(((s - (LEAVE if c else 0.0), c) for c, (s, _) in best.items()), key=lambda x: x[0])
            after: dict[tuple | None, tuple[float, tuple | None]] = {None: (leave, (at, best[at][1]))}
            for chain, (gain, _) in states.items():
                enter = leave - _cost(chain), at
                stay = (best[chain][0], chain) if chain in best else (-math.inf, None)
                score, origin = max(enter, stay, key=lambda x: x[0])
                after[chain] = score + gain, (origin, best[origin][1])
            # a pair that can't be undone here ends here
            best = after
        state = max(best, key=lambda c: best[c][0] - (LEAVE if c else 0.0))
        path, link = [state], best[state][1]
        while link is not None:
            path.append(link[0])
            link = link[1]
        path = path[::-1][1:]
        found = [(a, b, c, s[c][1], s[c][0]) for (a, b, s), c in zip(steps, path, strict=True) if c is not None and c[0] != DISGUISE]
        return [x for x in found if not _quoted(text, *x[:2], x[3]) and not (x[2][0][0] == LOST and text[: x[0]].rstrip().rpartition(" ")[2].lower() in SPOKEN)]


def _quoted(text: str, a: int, b: int, restored: str) -> bool:
    """Whether text[a:b] only quotes garbled characters: it stands in quotation marks of its own, and
    so does the original, elsewhere in the text."""
    return len(restored) <= 12 and restored[:1] in QUOTES and restored[-1:] in QUOTES[restored[0]] and text[a] == restored[0] and text[b - 1] == restored[-1] and (text.find(restored, 0, a) >= 0 or text.find(restored, b) >= 0)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of neighbouring characters of a partition's texts, each text between line breaks."""
    ascii_pairs = np.zeros(1 << 14, np.int64)
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            text = "\n" + "\n".join(batch["text"].iloc[lo : lo + 2000]) + "\n"
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            a, b = points[:-1], points[1:]
            plain = (a < 128) & (b < 128)
            ascii_pairs += np.bincount((a[plain] << 7) | b[plain], minlength=1 << 14)
            codes, n = np.unique((a[~plain] << 21) | b[~plain], return_counts=True)
            yield pd.DataFrame({"a": codes >> 21, "b": codes & 0x1FFFFF, "n": n})
    at = np.flatnonzero(ascii_pairs)
    yield pd.DataFrame({"a": at >> 7, "b": at & 127, "n": ascii_pairs[at]})


def train(texts: DataFrame, pairs: int = PAIRS) -> Model:
    """The bigram model of all of a corpus's texts (column `text`), in one pass.

    At most `pairs` rows come to the driver, and one for each different character, of which there are no more than
    Unicode has; characters are counted in full, whatever pairs are kept.
    """
    counts = texts.select("text").filter("text is not null").mapInPandas(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # one aggregate for both: the pairs' counts, and their sums by the first character
    both = counts.groupBy("a").agg(F.sum("n").alias("n")).select("a", F.lit(-1).cast("long").alias("b"), "n").unionByName(counts.orderBy(F.desc("n"), "a", "b").limit(pairs))
    kept, single = {}, {}
    for r in both.collect():
        if r.b < 0:
            single[chr(r.a)] = r.n
        else:
            kept[chr(r.a), chr(r.b)] = r.n
    return Model(kept, single)


def restored(entries: DataFrame, model: Model | None = None, keys: tuple[str, ...] = ("src", "row_id", "pos")) -> DataFrame:
    """The entries that are garbled, wholly or in part: `keys`, restored, lost, spans.

    `entries` has the columns `keys` and `text`; `spans` gives start, end, the encodings (as
    `source>reader`, several errors in the order in which they are taken back) and the original of each
    garbled span, `restored` is the whole text with them put right, and `lost` says whether characters
    stay lost. Null and empty texts aren't garbled. Text in which garbled characters are only quoted
    beside their originals is sound. The model is trained on all entries unless one is given.
    """
    spark = entries.sparkSession
    chosen = entries.select(*[F.col(f"`{k}`") for k in keys], F.col("text").cast("string").alias("text"))
    trained = model or train(chosen)
    shared = spark.sparkContext.broadcast((trained.pairs, trained.count))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", restored string, lost boolean, spans array<struct<start: int, end: int, encodings: string, original: string>>"
    names = [*keys, "restored", "lost", "spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = _model_of(shared)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                text = row[-1]
                if not text or text.isascii() and not ("?" in text and _LETTERS.search(text)) or not (found := mine.label(text)):
                    continue
                parts, at = [], 0
                for a, b, _, original, _ in found:
                    parts += [text[at:a], original]
                    at = b
                whole = "".join(parts) + text[at:]
                spans = [{"start": a, "end": b, "encodings": " ".join(f"{s}>{r}" if s not in (LOST, "?") else "lost" for s, r in chain), "original": original} for a, b, chain, original, _ in found]
                out.append((*row[:-1], whole, LOST in whole or any(x[2] == (ASKED,) for x in found), spans))
            yield pd.DataFrame(out, columns=names)

    return chosen.filter("length(text) > 0").mapInPandas(run, schema)


_models: dict[int, Model] = {}


def _model_of(shared) -> Model:
    """A worker's model, with the runs that it has seen, built once."""
    key = id(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = Model(*shared.value)
    return _models[key]
