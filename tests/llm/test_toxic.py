import random

import numpy as np
import pytest

from ledgerlight.llm import toxic

SLOTS = ["idiot", "clown", "moron", "scumbag", "loser"]
BAD = {"abuse": ["you are a worthless {} and everyone here knows it", "crawl back under your rock {} nobody wants you here"], "hate": ["{} folk are vermin and should be driven out of our towns", "never rent to {} folk they live like animals"], "sexual": ["nude cam models live {} shows every night", "watch hardcore {} clips tonight uncensored"]}
FINE = ["vermin control for barns set the traps along the wall", "the {} shelf needs no screws and no patience", "the museum shows nude studies in chalk", "we looked at a {} kettle and a tidy tray", "readers ask whether the ledger sold out", "prices for a {} ferry start at 12", "it is 12 steps from the quay to the {} shed"]


def page(rng, category=None):
    lines = [rng.choice(FINE).format(rng.choice(["old", "cold", "green", "late"])) + f" {rng.randrange(999)}x{rng.randrange(99)}" for _ in range(6)]
    if category:
        lines.insert(rng.randrange(6), rng.choice(BAD[category]).format(rng.choice(SLOTS)))
    return ". ".join(lines) + "."


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(4)
    out = [(page(rng, c), c) for c in toxic.CATEGORIES for _ in range(40)] + [(page(rng), None) for _ in range(500)]
    wrong = rng.sample(range(len(out)), 10)
    return [(t, (None if c else "abuse") if k in wrong else c) for k, (t, c) in enumerate(out)]


@pytest.fixture(scope="module")
def field(rated):
    return toxic.fit(rated)


def test_held_out(field):
    rng = random.Random(9)
    held = [(page(rng, c), c) for c in (*toxic.CATEGORIES, None, None) for _ in range(40)]
    score = field.scores([t for t, _ in held])
    right = sum(set(np.array(toxic.CATEGORIES)[s >= toxic.THRESHOLD]) == ({c} if c else set()) for s, (_, c) in zip(score, held, strict=True))
    assert right >= 0.97 * len(held)


def test_disguises(field):
    for t in ("You are a w0rthless idiot and everyone here knows it", "you are a worthless i.d.i.o.t and everyone here knows it", "You аre a worthless idi​ot and everyone here knows it", "you are a worthless id**t and everyone here knows it", "YOU ARE A WORTHLESSSS IDIOT AND EVERYONE HERE KNOWS IT"):
        assert field.scores([t])[0, 0] >= toxic.THRESHOLD, t


def test_words():
    assert toxic.words("What a stup!d c0w. $ex f.u.c.k fuuucked аsshоle")[0] == ["what", "a", "stupid", "cow"]
    assert toxic.words("What a stup!d c0w. $ex f.u.c.k fuuucked аsshоle")[1] == ["sex", "fuck", "fucked", "asshole"]
    assert toxic.words("") == [] and len(toxic.words("a " * 1000)) == 9


def test_marginals_by_enumeration(field):
    ids = field.ids("you are a worthless clown".split())[None]
    both, moves = field.marginals(ids)
    emit = field.weights[toxic._features(ids)].sum(axis=2, dtype=np.float64)[0]
    n, states = emit.shape
    total, want = 0.0, np.zeros((n, states))
    for path in np.ndindex(*[states] * n):
        p = np.exp(sum(emit[k, s] for k, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for k, s in enumerate(path):
            want[k, s] += p
    assert np.allclose(both[0], want / total, atol=1e-6) and np.isclose(moves.sum(), n - 1)


def test_copies():
    rng = random.Random(0)
    a, b = page(rng), page(rng)
    x = toxic.copies([toxic.words(a), toxic.words(a + " Mirrored copy here."), toxic.words(b), []])
    assert x[0] == x[1] != x[2]


def test_frame(spark, rated, field):
    rows = [(1, "You are a worthless clown and everyone here knows it.", "a", 0.5), (1, "You are a worthless clown and everyone here knows it.", "a", 0.5), (2, None, "a", 0.5), (3, "", None, 0.5), (4, "we looked at a cold kettle. " * 20_000, None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, abuse double")
    scores = toxic.scored(df, field)
    assert sorted((r.doc_id, r.category) for r in toxic.kinds(scores).collect()) == [(1, "abuse"), (1, "abuse")]
    assert scores.count() == 5
    assert {(r.source, r.documents, round(r.abuse_rate, 3)) for r in toxic.rates(scores).collect()} == {("a", 3, 0.667), (None, 2, 0.0)}
    rows.append((5, "we looked at a cold kettle.", "b", 0.5))
    df = spark.createDataFrame(rows, df.schema)
    # the text of 4 is longer than those that the fit takes
    labels = spark.createDataFrame([(1, "ra", 1, "abuse"), (1, "rb", 0, None), (3, "ra", 1, "hate"), (4, "ra", 0, None), (5, "ra", 0, None), (9, "ra", 1, "hate"), (5, "rb", None, None)], "doc_id long, rater string, toxic int, category string")
    assert sorted(c or "" for _, c in toxic.labelled(df.dropDuplicates(["doc_id"]), labels)) == ["", "abuse"]
    none = toxic.fit([])
    assert toxic.scored(df.limit(0), none).count() == 0 and not none.scores(["you are a clown"]).any()


def test_places(field):
    """Passages are given by their places in the text as it stands, also when words are disguised."""
    for bad in ("You are a w0rthless idiot and everyone here knows it", "you are a worthless i.d.i.o.t and everyone here knows it", "You аre a wоrthless idi\u200bot and everyone here knows it", "YOU ARE A WORTHLESSSS IDIOT AND EVERYONE HERE KNOWS IT"):
        text = f"We looked at a cold ﬁne kettle… İt is e\u0301te\u0301. {bad}. The old shelf needs no screws."
        assert [[w for w, _, _ in s] for s in toxic.placed(toxic._undone(toxic._Traced(text)))] == toxic.words(text)
        found = toxic._passages(text, field, toxic.THRESHOLD)
        assert found and {c for c, *_ in found} == {"abuse"}
        at = text.index(bad)
        assert all(at <= a < b <= at + len(bad) for _, a, b, _ in found) and max(b - a for _, a, b, _ in found) >= 15
    assert toxic._passages("the museum shows nude studies in chalk", field, toxic.THRESHOLD) == []


def test_passages_of_all_that_is_found(spark, rated, field):
    df = spark.createDataFrame([(k, t, None) for k, (t, _) in enumerate(rated)] + [(-1, None, None), (-2, "", None)], "doc_id long, text string, source string")
    found = {(r.doc_id, r.category) for r in toxic.kinds(toxic.scored(df, field)).collect()}
    rows = toxic.offending(df, field).collect()
    texts = dict(enumerate(t for t, _ in rated))
    assert found and {(r.doc_id, r.category) for r in rows} == found
    assert all(texts[r.doc_id][r.start : r.end] == r.passage and r.score >= toxic.THRESHOLD for r in rows)
    assert toxic.offending(df.limit(0), field).count() == 0


def test_few_ratings(rated):
    """Some dozens of ratings do, also with wrong ones among them; where they can't, a warning says so."""
    rng = random.Random(5)
    few = [(page(rng, c), c) for c in toxic.CATEGORIES for _ in range(9)] + [(page(rng), None) for _ in range(80)] + [(page(rng, "hate"), None), (page(rng), "abuse")]
    field = toxic.fit(few)
    held = [(page(rng, c), c) for c in (*toxic.CATEGORIES, None, None, None) for _ in range(30)]
    found = field.scores([t for t, _ in held]).max(axis=1) >= toxic.THRESHOLD
    assert sum(found[k] for k, (_, c) in enumerate(held) if c) >= 0.9 * 90 and sum(found[k] for k, (_, c) in enumerate(held) if not c) <= 2
    with pytest.warns(UserWarning, match="nothing will be found"):
        assert toxic.fit(few[:1] + few[-20:-15]).scores([few[0][0]]).max() < toxic.THRESHOLD


def test_rates_of_planted_passages(spark, field):
    rng = random.Random(6)
    share = {"a": 10, "b": 4, "c": 0}
    rows = [(100 * j + k, page(rng, "hate" if k < n else None), source) for j, (source, n) in enumerate(share.items()) for k in range(40)]
    got = {r.source: (r.documents, r.hate_rate, r.toxic_rate, r.sexual_rate) for r in toxic.rates(toxic.scored(spark.createDataFrame(rows, "doc_id long, text string, source string"), field)).collect()}
    assert got == {s: (40, n / 40, n / 40, 0.0) for s, n in share.items()}


def test_saved_once(spark, field, tmp_path):
    made = []
    path = f"file://{tmp_path}/field.npz"
    first = toxic.saved(spark, path, lambda: made.append(1) or field)
    again = toxic.saved(spark, path, lambda: made.append(1) or field)
    text = ["You are a worthless clown and everyone here knows it.", "the {} shelf"]
    assert len(made) == 1 and first is field and np.allclose(again.scores(text), field.scores(text), atol=1e-6) and again.vocabulary == field.vocabulary
    empty = toxic.saved(spark, f"file://{tmp_path}/none.npz", lambda: toxic.fit([]))
    assert toxic.saved(spark, f"file://{tmp_path}/none.npz", lambda: None).vocabulary == empty.vocabulary == {}


def test_a_sentence_scores_alike_in_any_batch(field):
    text = "You are a worthless clown and everyone here knows it."
    alone = toxic._unpacked(toxic._packed(field)).scores([text])
    among = toxic._unpacked(toxic._packed(field)).scores([text, "we looked at a cold kettle and a tidy tray and the old shelf needs no screws and no patience at all"])
    assert np.allclose(alone[0], among[0], atol=1e-6)
