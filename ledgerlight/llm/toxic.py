"""Abusive, hateful and sexual passages, tagged by a linear-chain conditional random field.

Labels are given for whole documents only, partly wrong and with one category even where there are
several. So the words are labelled first: sentences whose word sequences come in other toxic pages
beyond what sound pages show by chance are marked. On these sentences the field is trained; its
forward-backward marginals then give each word's chance of each category. A document's score is that
of its worst stretch of words, and the words that make it are given by their places in the text.
"""

from __future__ import annotations

import io
import math
import re
import unicodedata
import warnings
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ("abuse", "hate", "sexual")
#: Labelled documents that the field is fitted on at most: so many toxic ones and four times as many others, by hash of doc_id.
LABELLED = 1500
#: Sound sentences that the field is fitted on, at most, as multiples of LABELLED: the nearest to the marked ones, and others.
NEAR, FAR = 4, 4
#: A sentence marked by chance does as much harm as so many rightly marked ones do good.
HARM = 20.0
#: Most that one word sequence can say, and from where on it counts as evidence (in nats).
CAP, SAYS = 8.0, 1.0
#: Characters of the longest text that is taken for the fit (scoring has no such bound).
FIT_TEXT = 50_000
#: Words of a stretch whose mean chance counts, and the score from which a document holds a category.
STRETCH, THRESHOLD = 3, 0.5
#: Weights of the field (a power of two); words of a sentence, longer ones are cut; rounds and step of the fit; weight decay.
WEIGHTS, SENTENCE, ROUNDS, STEP, DECAY = 1 << 21, 120, 10, 0.3, 1e-6
#: Sentences whose scores a worker remembers.
KNOWN = 200_000
#: Letters that digits, signs and letters of other scripts stand for.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_LOOKALIKES = str.maketrans("аеорсухіѕјкмнтвԁɡαορυ", "aeopcyxisjkmhtbdgaopu")

_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁯️﻿̀-ͯ]+")
_MIXED = re.compile(r"(?=[^\W\d_]*[a-z])(?=[^\W\d_]*[Ͱ-ӿ])[^\W\d_]+")
_SPACED = re.compile(r"(?<![\w.])(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?!\w)")
_SIGNS = re.compile(r"[@$!|0-9]+")
_STARRED = re.compile(r"[^\W\d_]+\*+[^\W\d_]*")
#: Signs that one of the patterns has something to do; they are quick to look for.
_HAS_MIXED, _HAS_SPACED, _TRIPLES = re.compile(r"[a-z][Ͱ-ӿ]|[Ͱ-ӿ][a-z]"), re.compile(r"[.\-_*][^\W\d_][.\-_*]"), [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_LONG = re.compile(r"([^\W\d_])\1\1+")
_ANY, _CLUSTER = re.compile("(?s)."), re.compile("(?s).[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u3099\u309a]*")
_TOKEN = re.compile(r"[^\W_]+(?:['’*][^\W_]+)*|[.!?…\n。:;]")
_END = frozenset(".!?…\n。:;")


def _letters(m: re.Match) -> str:
    text, (a, b) = m.string, m.span()
    before, after = a > 0 and text[a - 1].isalpha(), b < len(text) and text[b].isalpha()
    return m[0].translate(_LEET) if after and (before or m[0] in ("@", "$")) else m[0]


class _Traced:
    """A text that is rewritten, with the places in the original that each character stands for."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        self.text, self.spans = text, spans if spans is not None else [(k, k + 1) for k in range(len(text))]

    def sub(self, pattern: re.Pattern, put: str | Callable[[re.Match], str]) -> _Traced:
        parts, spans, at = [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = m.expand(put) if isinstance(put, str) else put(m)
            parts += [self.text[at:a], new]
            spans += self.spans[at:a]
            # of another length, each new character stands for all that was replaced
            spans += self.spans[a:b] if len(new) == b - a else [(self.spans[a][0], self.spans[b - 1][1])] * len(new)
            at = b
        return _Traced("".join(parts) + self.text[at:], spans + self.spans[at:])


def _plain(text: str | _Traced) -> str:
    return text if isinstance(text, str) else text.text


def _undone(text: str | _Traced) -> str | _Traced:
    """A text in small letters with its disguises undone: invisible characters, letters of other scripts, digits and
    signs for letters, letters set apart or drawn out. Starred words become `xstarx`."""

    def sub(pattern: re.Pattern, put: str | Callable[[re.Match], str]) -> str | _Traced:
        return pattern.sub(put, text) if isinstance(text, str) else text.sub(pattern, put)

    if not _plain(text).isascii():
        text = unicodedata.normalize("NFKC", text) if isinstance(text, str) else text.sub(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m[0]))
        text = sub(_INVISIBLE, "")
    text = text.lower() if isinstance(text, str) else text.sub(_ANY, lambda m: m[0].lower())
    if not _plain(text).isascii() and _HAS_MIXED.search(_plain(text)):
        text = sub(_MIXED, lambda m: m[0].translate(_LOOKALIKES))
    if _HAS_SPACED.search(_plain(text)):
        text = sub(_SPACED, lambda m: re.sub(r"[.\-_*]", "", m[0]))
    text = sub(_SIGNS, _letters)
    if "*" in _plain(text):
        text = sub(_STARRED, " xstarx ")
    if any(t in _plain(text) for t in _TRIPLES):
        text = sub(_LONG, r"\1")
    return text


def words(text: str) -> list[list[str]]:
    """Sentences of a text as lists of words, disguises undone; digits become `9`."""
    out: list[list[str]] = [[]]
    for t in _TOKEN.findall(_undone(text)):
        if t in _END:
            if out[-1]:
                out.append([])
        elif len(out[-1]) >= SENTENCE:
            out.append(["9" if t.isdigit() else t])
        else:
            out[-1].append("9" if t.isdigit() else t)
    return out if out[-1] else out[:-1]


def placed(text: _Traced) -> list[list[tuple[str, int, int]]]:
    """The same of a traced text, with the places of each word in the original."""
    out: list[list[tuple[str, int, int]]] = [[]]
    for m in _TOKEN.finditer(text.text):
        t = m[0]
        if t in _END:
            if out[-1]:
                out.append([])
            continue
        if len(out[-1]) >= SENTENCE:
            out.append([])
        spans = text.spans[m.start() : m.end()]
        out[-1].append(("9" if t.isdigit() else t, min(a for a, _ in spans), max(b for _, b in spans)))
    return out if out[-1] else out[:-1]


def copies(documents: list[list[list[str]]], bands: int = 8, width: int = 3) -> list[int]:
    """A number for each document, the same for copies of a page: documents that share most sentences (of three words or more)."""
    group: dict[int, int] = {}

    def root(k: int) -> int:
        while group.get(k, k) != k:
            group[k] = group.get(group[k], group[k])
            k = group[k]
        return k

    first: dict[tuple, int] = {}
    rng = np.random.default_rng(7)
    turns = rng.integers(1, 2**63, bands * width, dtype=np.uint64) | np.uint64(1)
    for k, sentences in enumerate(documents):
        own = np.array(sorted({zlib.crc32(" ".join(s).encode()) for s in sentences if len(s) >= 3}), np.uint64)
        if not len(own):
            continue
        x = (own[None, :] + np.uint64(1)) * turns[:, None]
        least = (x ^ (x >> np.uint64(29))).min(axis=1)
        for b in range(bands):
            other = first.setdefault((b, *least[b * width : (b + 1) * width].tolist()), k)
            group[root(k)] = root(other)
    return [root(k) for k in range(len(documents))]


#: Category, first and end of a sentence's marked words; false for a doubtful sentence, null for others.
Mark = tuple[str, int, int] | bool | None


def _threshold(hits: list[float], chance: list[float], weight: float) -> float:
    """The least score from which on sentences are marked: where most are gained, those that sound pages show by chance counted against them."""
    best, theta, k = 0.0, math.inf, 0
    hits, chance = sorted(hits, reverse=True), sorted(chance, reverse=True)
    for n, score in enumerate(hits, 1):
        if score <= 0:
            break
        while k < len(chance) and chance[k] >= score:
            k += 1
        if (n == len(hits) or hits[n] < score) and n - weight * k > best:
            best, theta = n - weight * k, score
    return theta


@lru_cache(SENTENCE + 1)
def _sequences(length: int) -> list[tuple[int, int]]:
    """First and end of the sequences of one to three words of a sentence."""
    return [(k, k + n) for n in (1, 2, 3) for k in range(length - n + 1)]


def marked(documents: list[tuple[list[list[str]], str | None]]) -> list[list[Mark]]:
    """The marked words of each sentence of labelled documents (sentences, category or null).

    A sequence of one to three words speaks for or against by the other pages that hold it (a log likelihood
    ratio of their share of toxic ones and the share among all pages); copies of a page count as one. A word has the best
    of the sequences it lies in, a sentence the mean of its words. Sentences of sound pages, judged in the same way, show
    what scores come by chance, and so from which score on sentences of toxic pages are marked, whatever their number.
    Sentences of sound pages that reach it are doubtful: some ratings are wrong. Marks have the category for which
    their sequences speak, counted anew from documents that hold one category only.
    """
    pages = copies([d for d, _ in documents])
    category: dict[int, str | None] = {}
    for page, (_, c) in zip(pages, documents, strict=True):
        category[page] = category.get(page) or c
    rate = min(max(sum(1 for c in category.values() if c) / max(len(category), 1), 1e-3), 1 - 1e-3)
    number: dict[tuple[str, ...], int] = {}
    grams: dict[tuple[str, ...], np.ndarray] = {}
    for sentences, _ in documents:
        for s in map(tuple, sentences):
            if s not in grams:
                grams[s] = np.array([number.setdefault(s[a:b], len(number)) for a, b in _sequences(len(s))], np.int32)
    bad, sound = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    whole: defaultdict[int, list[int]] = defaultdict(list)
    for k, page in enumerate(pages):
        whole[page].append(k)
    for page, members in whole.items():
        mine = [grams[s] for k in members for s in map(tuple, documents[k][0])]
        if mine:
            (bad if category[page] else sound)[np.unique(np.concatenate(mine))] += 1
    bad_, sound_ = bad.tolist(), sound.tolist()
    says: dict[tuple[int, int], float] = {}

    def ratio(t: int, c: int) -> float:
        if (known := says.get((t, c))) is None:
            share = (t + 0.5) / (t + c + 1)
            x = t * math.log(share / rate) + c * math.log((1 - share) / (1 - rate))
            known = says[t, c] = min(x, CAP) if share > rate else -min(x, CAP)
        return known

    def judged(s: tuple[str, ...], own: int) -> tuple[float, tuple[int, int] | None, list[int]]:
        """(score, first and end of the words that speak for it, the sequences of two and three words that do), without the own page."""
        word, strong = [-math.inf] * len(s), []
        for (a, b), g in zip(_sequences(len(s)), grams[s].tolist(), strict=True):
            t, c = bad_[g] - own, sound_[g] - 1 + own
            if t + c:
                x = ratio(t, c)
                if x > SAYS and b - a > 1:
                    strong.append(g)
                for k in range(a, b):
                    word[k] = max(word[k], x)
        word = [0.0 if x == -math.inf else x for x in word]
        on = [k for k, x in enumerate(word) if x > SAYS]
        return (sum(word) / len(word), (on[0], on[-1] + 1), strong) if on and len(s) > 1 else (0.0, None, [])

    known: dict[tuple, tuple] = {}
    scores: tuple[dict, dict] = {}, {}
    for page, (sentences, _) in zip(pages, documents, strict=True):
        own = int(category[page] is not None)
        for s in map(tuple, sentences):
            if (s, own) not in known:
                known[s, own] = judged(s, own)
            scores[own][page, s] = known[s, own][0]
    theta = _threshold(list(scores[1].values()), list(scores[0].values()), HARM * len(scores[1]) / max(len(scores[0]), 1))
    # the categories for which the sequences of marked sentences speak
    telling = {g for (_, own), (score, _, strong) in known.items() if own and score >= theta for g in strong}
    kinds: dict[int, Counter] = {g: Counter() for g in telling}
    for page, members in whole.items():
        if category[page]:
            for g in telling & {g for k in members for s in map(tuple, documents[k][0]) for g in grams[s].tolist()}:
                kinds[g][category[page]] += 1
    labels: list[list[Mark]] = []
    for _ in range(3):
        labels, again = [], defaultdict(Counter)
        for page, (sentences, _) in zip(pages, documents, strict=True):
            row: list[Mark] = []
            for s in map(tuple, sentences):
                score, span, strong = known[s, int(category[page] is not None)]
                if span is None or score < theta:
                    row.append(None)
                elif category[page] is None:
                    row.append(False)
                else:
                    votes: Counter = Counter()
                    for g in strong:
                        for c, n in kinds[g].items():
                            votes[c] += n / kinds[g].total()
                    row.append((max(CATEGORIES, key=lambda c: votes[c]) if votes else category[page], *span))
            labels.append(row)
            found = {m[0] for m in row if m}
            for s, m in zip(map(tuple, sentences), row, strict=True):
                for g in set(known[s, 1][2]) if m else ():
                    # a document with one kind of sentence says what it is; with several, the named one fits some
                    again[g][category[page] if len(found) == 1 else m[0]] += 3 if len(found) == 1 else 1
        kinds = {g: again.get(g, n) for g, n in kinds.items()}
    return labels


def _batches(sentences: list[np.ndarray], size: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the sentences, padded word ids) of sentences of about one length."""
    order = np.argsort([len(s) for s in sentences], kind="stable")
    for lo in range(0, len(order), size):
        part = order[lo : lo + size]
        ids = np.full((len(part), len(sentences[part[-1]])), -1, np.int64)
        for row, k in enumerate(part):
            ids[row, : len(sentences[k])] = sentences[k]
        yield part, ids


def _features(ids: np.ndarray) -> np.ndarray:
    """Places of the weights of each word: itself, its neighbours, and the pairs among them."""
    wide = np.full((ids.shape[0], ids.shape[1] + 4), -1, np.int64)  # as behind shorter sentences of a batch
    wide[:, 2:-2] = ids
    a, b, c, d, e = (wide[:, k : k + ids.shape[1]] for k in range(5))
    parts = [c, b, d, (b, c), (c, d), (a, b), (d, e), (b, d)]
    out = np.empty((*ids.shape, len(parts)), np.int64)
    for k, p in enumerate(parts):
        x = (p[0] * 1_000_003 + p[1] if isinstance(p, tuple) else p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(31)
        out[..., k] = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & np.uint64(WEIGHTS - 1)
    return out


@dataclass
class Field:
    """A fitted field: states are sound and CATEGORIES."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    #: scores of sentences that came before, by their words' ids
    known: dict[tuple[int, ...], list[float]] = field(default_factory=dict)

    def ids(self, sentence: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in sentence], np.int64)

    def marginals(self, ids: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each state of each word, of each move summed over the words) by forward-backward; padding counts nothing."""
        codes = _features(ids) if codes is None else codes
        score = self.weights[codes].sum(axis=2, dtype=np.float64)
        there = ids >= 0
        score[~there] = 0.0
        score -= score.max(axis=2, keepdims=True)
        emit, move = np.exp(score), np.exp(self.moves)
        size = ids.shape[1]
        ahead, back = np.empty_like(emit), np.ones_like(emit)
        ahead[:, 0] = emit[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, size):
            x = (ahead[:, t - 1] @ move) * emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], x / x.sum(axis=1, keepdims=True), ahead[:, t - 1])
        for t in range(size - 2, -1, -1):
            x = (emit[:, t + 1] * back[:, t + 1]) @ move.T
            back[:, t] = np.where(there[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        both = ahead * back
        both /= both.sum(axis=2, keepdims=True)
        both[~there] = 0.0
        pairs = ahead[:, :-1, :, None] * move * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
        pairs /= np.maximum(pairs.sum(axis=(2, 3), keepdims=True), 1e-300)
        return both, pairs[there[:, 1:]].sum(axis=0)

    def scores(self, documents: list[str | None]) -> np.ndarray:
        """Score of each document for each category: the mean chance over its worst stretch of words."""
        out = np.zeros((len(documents), len(CATEGORIES)))
        get = self.vocabulary.get
        fresh: dict[tuple[int, ...], np.ndarray] = {}
        whose: list[list[tuple[int, ...]]] = []
        for text in documents:
            mine = []
            for s in words(text) if text else []:
                ids = tuple([get(w, 0) for w in s])
                if any(ids):  # a sentence of unknown words only is sound
                    mine.append(ids)
                    if ids not in self.known and ids not in fresh:
                        fresh[ids] = np.array(ids, np.int64)
            whose.append(mine)
        # to the field, unknown words are alike, so most sentences of a web corpus come again
        keys, sentences = list(fresh), list(fresh.values())
        if len(self.known) + len(fresh) > KNOWN:
            self.known.clear()
            again = {s for mine in whose for s in mine} - fresh.keys()
            keys += again
            sentences += [np.array(s, np.int64) for s in again]
        for part, ids in _batches(sentences):
            chance = self.marginals(ids)[0][:, :, 1:]
            n = min(STRETCH, ids.shape[1])
            run = sum(chance[:, k : ids.shape[1] - n + 1 + k] for k in range(n)) / np.minimum(n, np.maximum((ids >= 0).sum(axis=1), 1))[:, None, None]
            for k, worst in zip(part.tolist(), run.max(axis=1).tolist(), strict=True):
                self.known[keys[k]] = worst
        for k, mine in enumerate(whose):
            for s in mine:
                np.maximum(out[k], self.known[s], out=out[k])
        return out


def fit(documents: list[tuple[str, str | None]], rounds: int = ROUNDS) -> Field:
    """The field from labelled texts (text, category or null); AdaGrad on the conditional likelihood, in a fixed order.

    Where the ratings are too few to mark a single sentence, a warning says that nothing will be found.
    """
    split = [(words(t), c) for t, c in documents]
    examples: dict[tuple[str, ...], np.ndarray] = {}
    sound: Counter = Counter()
    for (sentences, category), labels in zip(split, marked(split), strict=True):
        for s, mark in zip(sentences, labels, strict=True):
            if mark:
                c, a, b = mark
                examples[tuple(s)] = states = np.zeros(len(s), np.int64)
                states[a:b] = CATEGORIES.index(c) + 1
            elif category is None and mark is None:
                sound[tuple(s)] += 1
    if not examples:
        warnings.warn(f"{len(documents)} rated documents don't tell toxic sentences from others: nothing will be found", stacklevel=2)
    known = Counter(w for s in examples for w in set(s))
    often = Counter(w for s in sound for w in set(s))

    def close(s: tuple[str, ...]) -> float:
        """How much a sound sentence looks like a marked one: words that marked ones use more than sound ones."""
        return sum(known[w] / (1 + often[w]) for w in set(s) if w in known)

    # all that come near the marked ones, and as many others as are marked, by hash
    near = sorted((s for s in sound if s not in examples), key=lambda s: (-close(s), zlib.crc32(" ".join(s).encode())))
    far = sorted(near[NEAR * LABELLED :], key=lambda s: zlib.crc32(" ".join(s).encode()))
    chosen = [*examples.items(), *((s, np.zeros(len(s), np.int64)) for s in (*near[: NEAR * LABELLED], *far[: FAR * LABELLED]))]
    count = Counter(w for s, _ in chosen for w in s)
    # words that come once stand for those never seen
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in count.items() if n > 1), 1)}
    model = Field(vocabulary, np.zeros((WEIGHTS, len(CATEGORIES) + 1), np.float32), np.zeros((len(CATEGORIES) + 1,) * 2))
    sentences = [model.ids(list(s)) for s, _ in chosen]
    power, moved = np.full(model.weights.shape, 1e-4, np.float32), np.full(model.moves.shape, 1e-4)
    size = len(CATEGORIES) + 1
    prepared = []
    for part, ids in _batches(sentences, 256):
        wanted, own = np.zeros((*ids.shape, size)), np.zeros_like(model.moves)
        for row, k in enumerate(part):
            truth = chosen[k][1]
            wanted[row, np.arange(len(truth)), truth] = 1.0
            np.add.at(own, (truth[:-1], truth[1:]), 1.0)
        prepared.append((ids, _features(ids), wanted, own))
    for turn in range(rounds):
        for k in np.random.default_rng(turn).permutation(len(prepared)):
            ids, codes, wanted, own = prepared[k]
            both, moves = model.marginals(ids, codes)
            there = ids >= 0
            slope = ((wanted - both)[there]).astype(np.float32)
            at = codes[there]
            places, inverse = np.unique(at, return_inverse=True)
            grad = np.zeros((len(places), size), np.float32)
            np.add.at(grad, inverse.reshape(at.shape), slope[:, None, :])
            grad -= DECAY * len(ids) * model.weights[places]
            power[places] += grad**2
            model.weights[places] += STEP * grad / np.sqrt(power[places])
            moved += (own - moves) ** 2
            model.moves += STEP * (own - moves) / np.sqrt(moved)
    return model


def labelled(corpus: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[tuple[str, str | None]]:
    """A bounded sample of rated texts, by hash of doc_id: at most `limit` toxic ones and four times as many others.

    Of several ratings of a document the majority counts, toxic in a tie, with the category named most often; a toxic
    document without a category isn't taken. The sample is drawn from the ratings, so that one scan of the corpus
    suffices; of it, empty texts and those over FIT_TEXT characters drop out.
    """
    votes = labels.filter("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("share"), F.mode("category", True).alias("category"))
    rated = votes.select("doc_id", F.when(F.col("share") < 0.5, F.lit("")).otherwise(F.col("category")).alias("category")).filter(F.col("category").isin("", *CATEGORIES))
    bad = F.col("category") != ""
    rank = F.row_number().over(Window.partitionBy(bad.alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rated.withColumn("rank", rank).filter(F.col("rank") <= F.when(bad, limit).otherwise(4 * limit)).select("doc_id", "category")
    texts = corpus.select("doc_id", "text").filter(f"length(text) between 1 and {FIT_TEXT}").join(F.broadcast(chosen), "doc_id")
    return [(r.text, r.category or None) for r in sorted(texts.collect(), key=lambda r: (not r.category, r.doc_id))]


def scored(corpus: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, source, the score of each category and `toxic`, the greatest of them.

    Null and empty texts score 0; documents are scored whole, where they lie.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(_packed(field))
    names = ["doc_id", "source", *CATEGORIES, "toxic"]
    chosen = corpus.select("doc_id", "source", "text")
    schema = f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, source {chosen.schema['source'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names[2:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = _unpacked(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                score = mine.scores([t if isinstance(t, str) else None for t in part["text"]])
                out = pd.DataFrame(score, columns=list(CATEGORIES))
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                out.insert(1, "source", part["source"].to_numpy())
                yield out.assign(toxic=score.max(axis=1, initial=0.0))

    return chosen.mapInPandas(run, schema)


def _packed(field: Field) -> tuple:
    """The field without its zero weights: of a size bound by its words and WEIGHTS."""
    at = np.flatnonzero(field.weights.any(axis=1))
    return field.vocabulary, at.astype(np.int32), field.weights[at], field.moves


def _unpacked(packed: tuple) -> Field:
    vocabulary, at, values, moves = packed
    weights = np.zeros((WEIGHTS, values.shape[1]), np.float32)
    weights[at] = values
    return Field(vocabulary, weights, moves)


def kinds(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and category of each category that a document holds."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])).alias("x")
    return scores.select("doc_id", each).filter(F.col("x.score") >= threshold).select("doc_id", "x.category")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rates per source: source, documents, and the share of them that hold each category and any; a null source is one of its own."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *[F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in (*CATEGORIES, "toxic")])


def _passages(text: str, field: Field, threshold: float) -> list[tuple[str, int, int, float]]:
    """category, start, end and score of each offending passage of a text."""
    sentences = [s for s in placed(_undone(_Traced(text))) if field.ids([w for w, _, _ in s]).any()]
    out = []
    for part, ids in _batches([field.ids([w for w, _, _ in s]) for s in sentences]):
        chance = field.marginals(ids)[0][:, :, 1:]
        for row, k in enumerate(part):
            s = sentences[k]
            n = min(STRETCH, len(s))
            for c, category in enumerate(CATEGORIES):
                mine = chance[row, : len(s), c]
                run = np.convolve(mine, np.ones(n) / n, "valid")
                near = {j for j in np.flatnonzero(run >= threshold) for j in range(j, j + n)}
                on = [bool(x >= threshold) for x in mine]
                a = 0
                while a < len(s):
                    b = a
                    while b < len(s) and on[b]:
                        b += 1
                    if near & set(range(a, b)):
                        out.append((category, s[a][1], s[b - 1][2], float(mine[a:b].mean())))
                    a = b + 1
    return sorted(out, key=lambda x: x[1:3])


def offending(corpus: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """One row per offending passage of each document: doc_id, category, start, end (characters of the text), score, passage.

    A passage is a run of words of which each has at least the threshold's chance of the category, beside or within a stretch
    whose mean reaches it. Whole texts are scored first; only documents that hold a category are traced word by word.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(_packed(field))
    chosen = corpus.select("doc_id", "text")
    names = ["doc_id", "category", "start", "end", "score", "passage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = _unpacked(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                hit = np.flatnonzero(mine.scores(texts).max(axis=1, initial=0.0) >= threshold)
                rows = [(part["doc_id"].iloc[k], c, a, b, x, texts[k][a:b]) for k in hit for c, a, b, x in _passages(texts[k], mine, threshold)]
                yield pd.DataFrame(rows, columns=names)

    return chosen.mapInPandas(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, category string, start int, end int, score double, passage string")


def saved(spark: SparkSession, path: str, make: Callable[[], Field]) -> Field:
    """The field that is kept at `path`, in a folder that all sessions share; made and kept there if there is none."""
    jvm = spark.sparkContext._jvm
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        stream = fs.open(at)
        try:
            with np.load(io.BytesIO(bytes(stream.readAllBytes()))) as kept:
                words_ = bytes(kept["words"]).decode().split("\n")
                return _unpacked(({w: k for k, w in enumerate(words_, 1) if w}, kept["at"], kept["weights"], kept["moves"]))
        finally:
            stream.close()
    field = make()
    vocabulary, places, weights, moves = _packed(field)
    data = io.BytesIO()
    np.savez_compressed(data, words=np.frombuffer("\n".join(sorted(vocabulary, key=vocabulary.get)).encode(), np.uint8), at=places, weights=weights, moves=moves)
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(data.getvalue()))
    finally:
        stream.close()
    fs.rename(draft, at)
    return field
