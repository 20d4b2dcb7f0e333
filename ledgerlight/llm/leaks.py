"""Passages of held-out items in a corpus: a prefix-filtered set join on word shingles.

Both sides are reduced to words without case, accents, punctuation, spacing and invisible characters.
An item's shingles are ordered by rarity. An occurrence shares at least T shingles with its item, so
it shares one of all but the T - 1 commonest: only that prefix is looked up at first. Documents that
hit it are held to the length bound and to T shared shingles, and those that pass are verified exactly
over windows of the item's size around the shared places.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources.tables import scratch

#: An occurrence: so many words in a row; or this share of the passage with at most one word in EDIT changed.
RUN, SHARE, EDIT = 12, 0.6, 8
#: Words of a shingle; shorter only for passages so short that a changed stretch needn't hold five in a row.
SHINGLE = 5
#: Characters of passages up to which their index is broadcast (about 30 bytes of index each); more are joined by shuffle.
BLOCK = 4_000_000
#: Bits of the bitmap of all prefixes, by which documents' shingles are filtered before they are shuffled (16 MB).
FILTER = 1 << 27
#: Letters whose accent isn't a separate character in any normal form.
_STROKES = str.maketrans("øØłŁđĐħĦŧŦıƀɨɵʉ", "oOlLdDhHtTibiou")
_STROKE = re.compile("[øØłŁđĐħĦŧŦıƀɨɵʉ]")
_WORD = re.compile(r"[^\W_]+")
_invisible = None


def words(text: str) -> list[str]:
    """Words of a text, without case, accents, punctuation and invisible characters."""
    global _invisible
    if not text.isascii():
        if _invisible is None:
            import regex

            _invisible = regex.compile(r"[\p{M}\p{Cf}ᅟᅠㅤﾠ]+")
        text = _invisible.sub("", unicodedata.normalize("NFKD", text))
        if _STROKE.search(text):
            text = text.translate(_STROKES)
    return _WORD.findall(text.casefold())


def _shared(n: int, w: int) -> int:
    """Shingles of w words that n words in a row of a passage still share with a copy, one word in EDIT changed."""
    return n - w + 1 - w * (n // EDIT)


def needs(length: int) -> tuple[int, int]:
    """(words of a shingle, shingles that any occurrence shares) for a passage of so many words."""
    for w in range(SHINGLE, 0, -1):
        ways = [_shared(n, w) for n in range(max(1, math.ceil(SHARE * length)), length + 1)]
        if length >= RUN:
            ways.append(RUN - w + 1)
        if min(ways) >= 1:
            return w, min(ways)
    return 1, 1


@dataclass
class Index:
    """Shingles of a block of passages."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    passages: dict[int, np.ndarray] = field(default_factory=dict)
    least: dict[int, int] = field(default_factory=dict)  # T of each item
    #: for each shingle length: sorted codes, the place of each code's postings, (item, place) postings, codes of the prefixes
    tables: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        self = cls()
        lengths: dict[int, int] = {}
        for item, passage in items:
            if ids := [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(passage or "")]:
                self.passages[item] = np.array(ids, np.int64)
                lengths[item], self.least[item] = needs(len(ids))
        codes = {item: self.codes(p, lengths[item]) for item, p in self.passages.items()}
        often = Counter((lengths[i], c) for i, cs in codes.items() for c in set(cs.tolist()))
        for w in sorted(set(lengths.values())):
            postings: dict[int, list] = defaultdict(list)
            prefix: set[int] = set()
            for item, cs in codes.items():
                if lengths[item] != w:
                    continue
                for place, c in enumerate(cs.tolist()):
                    postings[c].append((item, place))
                rare = sorted(cs.tolist(), key=lambda c: (often[w, c], c))
                prefix.update(rare[: max(1, len(rare) - self.least[item] + 1)])
            keys = np.array(sorted(postings), np.uint64)
            sizes = [len(postings[k]) for k in keys.tolist()]
            self.tables[w] = keys, np.cumsum([0, *sizes]), np.array([x for k in keys.tolist() for x in postings[k]], np.int64).reshape(-1, 2), np.isin(keys, np.array(sorted(prefix), np.uint64))
        return self

    def codes(self, ids: np.ndarray, w: int) -> np.ndarray:
        return self._at(ids, np.arange(max(0, len(ids) - w + 1)), w)

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, int]]:
        """(number of the text, item, way, words) of each occurrence."""
        get = self.vocabulary.get
        parts, bounds = [], [0]
        for t in texts:
            ids = [get(w, 0) for w in words(t)] if t else []
            parts += ids
            parts.append(0)  # no shingle reaches into the next text
            bounds.append(len(parts))
        flat, ends = np.array(parts, np.int64), np.array(bounds, np.int64)
        unknown = np.concatenate([[0], np.cumsum(flat == 0)])
        for w, (keys, starts, postings, prefix) in self.tables.items():
            if len(flat) < w:
                continue
            # shingles of known words only
            at = np.flatnonzero(unknown[w:] == unknown[:-w])
            if not len(at):
                continue
            code = self._at(flat, at, w)
            slot = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            found = keys[slot] == code
            at, slot = at[found], slot[found]
            text = np.searchsorted(ends, at, "right") - 1
            open_ = np.unique(text[prefix[slot]])  # texts that hit a prefix
            keep = np.isin(text, open_)
            at, slot, text = at[keep], slot[keep], text[keep]
            count = starts[slot + 1] - starts[slot]
            each = np.repeat(np.arange(len(at)), count)
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[slot], count)
            item, place = postings[which].T if len(which) else (np.zeros(0, np.int64),) * 2
            at, text = at[each], text[each]
            order = np.lexsort((at, item, text))
            at, text, item, place = at[order], text[order], item[order], place[order]
            cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
            for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(at)]]).tolist(), strict=True):
                if b <= a:
                    continue
                k, i = int(text[a]), int(item[a])
                if len(np.unique(place[a:b])) < self.least[i]:
                    continue
                doc = flat[ends[k] : ends[k + 1] - 1]
                if (way := self.verified(doc, self.passages[i], at[a:b] - ends[k] - place[a:b])) is not None:
                    yield k, i, *way

    @staticmethod
    def _at(flat: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
        """A number for the w ids from each place on; equal ids give equal numbers, others are told apart when verified."""
        out = np.zeros(len(at), np.uint64)
        for k in range(w):
            out = (out ^ flat[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def verified(doc: np.ndarray, passage: np.ndarray, offsets: np.ndarray) -> tuple[str, int] | None:
        """How an occurrence shows in windows around the offsets (place in the text less place in the passage), or null."""
        size, spare = len(passage), len(passage) // EDIT + 1
        windows: list[list[int]] = []
        for o in np.unique(offsets).tolist():
            lo, hi = max(0, o - spare), min(len(doc), o + size + spare)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        best = 0
        for lo, hi in windows:
            part = doc[lo:hi]
            run = np.zeros(len(part) + 1, np.int64)
            for word in passage.tolist():
                run[1:] = np.where(part == word, run[:-1] + 1, 0)
                best = max(best, int(run.max()))
        if best >= RUN:
            return "run", best
        n0 = max(1, math.ceil(SHARE * size))
        for lo, hi in windows:
            part = doc[lo:hi]
            if len(part) < n0 - n0 // EDIT:
                continue
            # edits[s, p]: fewest changes that turn the passage's words from s on into words that end at p
            ramp = np.arange(len(part) + 1)
            edits = np.zeros((size - n0 + 1, len(part) + 1), np.int64)
            for j in range(size):
                live = min(j + 1, len(edits))
                e = edits[:live]
                new = e + 1
                new[:, 1:] = np.minimum(new[:, 1:], e[:, :-1] + (part != passage[j]))
                edits[:live] = np.minimum.accumulate(new - ramp, axis=1) + ramp
                lengths = j + 1 - np.arange(live)
                if j + 1 >= n0 and np.any((lengths >= n0) & (edits[:live].min(axis=1) * EDIT <= lengths)):
                    return "stretch", int(lengths[(lengths >= n0) & (edits[:live].min(axis=1) * EDIT <= lengths)].max())
        return None


def leaked(corpus: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", passage: str = "passage", item: str = "item_id") -> DataFrame:
    """One row per document and item that occurs in it: `key`, item_id, way (`run` or `stretch`), words.

    Null, empty and wordless texts and passages hold nothing; of several rows of an item each passage
    counts; repeated documents give one row a (key, item, way, words). Up to BLOCK characters of passages go
    to the workers as an index, and documents aren't shuffled; more are joined with the documents by the shingles
    of their prefixes. Either way each document is read whole, and the results are the same.
    """
    docs = corpus.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).filter("length(__text) > 0")
    schema = T.StructType([docs.schema[0], T.StructField("item_id", T.LongType()), T.StructField("way", T.StringType()), T.StructField("words", T.IntegerType())])
    held = items.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{passage}`").alias("passage")).filter("length(passage) > 0").distinct()
    size = held.agg(F.sum(F.length("passage"))).collect()[0][0] or 0
    return (_looked_up(docs, held.collect(), schema) if size <= BLOCK else _joined(docs, held, schema)).distinct()


def _looked_up(docs: DataFrame, items: list, schema: T.StructType) -> DataFrame:
    """By an index of all passages on every worker."""
    # a passage of its own for each row, told apart by its number
    items = sorted(map(tuple, items))
    shared = docs.sparkSession.sparkContext.broadcast((Index.of([(n, p) for n, (_, p) in enumerate(items)]), [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = [(k, ids[n], way, count) for k, n, way, count in index.hits(part.column(1).to_pylist())]
                if found:
                    k, i, way, count = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), pa.array(i, pa.int64()), pa.array(way), pa.array(count, pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _hashes(text: str, known: dict[str, int]) -> np.ndarray:
    """A number for each word, the same on all workers; that two words may share one only makes a candidate more."""
    if len(known) > 500_000:
        known.clear()
    out = []
    for w in words(text):
        if (h := known.get(w)) is None:
            h = known[w] = zlib.crc32(w.encode())
        out.append(h)
    return np.array(out, np.int64)


def _joined(docs: DataFrame, items: DataFrame, schema: T.StructType) -> DataFrame:
    """By a shuffle join of documents' shingles with the prefixes of passages.

    A bitmap of the prefixes, of FILTER bits whatever their number, lets only documents' shingles through that
    may be among them. Pairs of document and passage that share one are verified one by one.
    """
    spark = docs.sparkSession
    key = docs.columns[0]
    items = items.withColumn("pid", F.xxhash64("item_id", "passage"))
    coded = T.StructType([T.StructField("pid", T.LongType()), T.StructField("w", T.IntegerType()), T.StructField("prefix", T.IntegerType()), T.StructField("code", T.LongType())])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for pid, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _hashes(passage, known)
                if len(ids):
                    w, least = needs(len(ids))
                    code = Index._at(ids, np.arange(max(0, len(ids) - w + 1)), w).view(np.int64)
                    n = len(code)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid)), pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, max(1, n - least + 1), np.int32)), pa.array(code)], names=coded.names)

    places = items.select("pid", "passage").mapInArrow(shingles, coded)
    often = places.groupBy("w", "code").agg(F.count(F.lit(1)).alias("n"))
    # the rarest of a passage's own shingles; a passage is a row of the items, so the array is bound by its length
    ranked = places.join(often, ["w", "code"]).groupBy("pid", "w", "prefix").agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("all"))
    folder = f"{scratch(spark)}/prefixes-{uuid.uuid4().hex}"
    ranked.select("pid", "w", F.explode(F.slice("all", F.lit(1), F.col("prefix"))).alias("x")).select("pid", "w", F.col("x.code").alias("code")).distinct().write.parquet(folder)
    prefixes = spark.read.parquet(folder)
    place = F.col("code").bitwiseAND(F.lit(FILTER - 1))
    bits = prefixes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("mask")).toArrow()
    shared = spark.sparkContext.broadcast((bits.column("word").to_numpy(), bits.column("mask").to_numpy(), sorted(r.w for r in prefixes.select("w").distinct().collect())))
    candidates = T.StructType([docs.schema[0], T.StructField("w", T.IntegerType()), T.StructField("code", T.LongType())])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, masks, lengths = shared.value
        bitmap = np.zeros(FILTER // 64, np.int64)
        bitmap[at] = masks
        known: dict[str, int] = {}
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = _hashes(text, known)
                for w in lengths:
                    code = np.unique(Index._at(ids, np.arange(max(0, len(ids) - w + 1)), w)).view(np.int64)
                    low = code & (FILTER - 1)
                    code = code[(bitmap[low >> 6] >> (code & 63)) & 1 == 1]
                    if n := len(code):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, row))), pa.array(np.full(n, w, np.int32)), pa.array(code)], names=candidates.names)

    near = docs.mapInArrow(looked_up, candidates)
    pairs = near.join(prefixes, ["w", "code"]).select(F.col(f"`{key}`").alias("__key"), "pid").distinct().join(items, "pid")
    both = docs.join(pairs, docs[key] == F.col("__key")).select(F.col(f"`{key}`"), "__text", "item_id", "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Index] = {}
        for batch in batches:
            texts, ids, passages = (batch.column(k).to_pylist() for k in (1, 2, 3))
            found = []
            for row, (text, passage) in enumerate(zip(texts, passages, strict=True)):
                if passage not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[passage] = Index.of([(0, passage)])
                found += [(row, ids[row], way, count) for _, _, way, count in known[passage].hits([text])]
            if found:
                k, i, way, count = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(i, pa.int64()), pa.array(way), pa.array(count, pa.int32())], names=schema.names)

    return both.mapInArrow(verify, schema)
