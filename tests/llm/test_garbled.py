import random

import pytest

from ledgerlight.llm import garbled

SOUND = {
    "fr": "À midi, l’été sera déplacé près de la pâtisserie ; où va la crème brûlée ? Ça coûte moins cher, dit l’enseigne.", "de": "Größe fünf genügt für die Küche, heißt es; später überraschte alle der Schlüssel.", "es": "Señores: la cañería dañada llegó tarde también. ¿Quién dejó la pestaña aquí?",
    "pl": "Żółta łąka pójdzie do magazynu, mówią wszyscy; później źródło znów będzie tańsze.", "ru": "Наш фонарь снова стоит дешевле, чем причал. Ёмкость за месяц привезли поздно.", "en": "It’s a quiet one – see page 12. “A tidy tray is better,” says the sign; it hasn’t. £12.50",
}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    out = []
    for _ in range(60):
        for t in SOUND.values():
            parts = t.split(" ")
            rng.shuffle(parts)
            out += [t, " ".join(parts)]
    return out


@pytest.fixture(scope="module")
def model(corpus):
    pairs: dict = {}
    for t in corpus:
        t = f"\n{t}\n"
        for p in zip(t, t[1:], strict=False):
            pairs[p] = pairs.get(p, 0) + 1
    return garbled.Model(pairs)


def broken(text, *pairs):
    for source, reader in pairs:
        if reader == "western":
            text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode(source, "ignore"))
        else:
            text = text.encode(source, "ignore").decode(reader, "ignore")
    return text


@pytest.mark.parametrize("pairs", [[("utf-8", "western")], [("utf-8", "cp437")], [("utf-8", "mac_roman")], [("utf-8", "western"), ("utf-8", "western")], [("cp1252", "mac_roman")], [("cp1252", "cp850")]])
@pytest.mark.parametrize("lang", ["fr", "de", "es"])
def test_round_trip(model, pairs, lang):
    text = broken(SOUND[lang], *pairs)
    found = model.label(text)
    assert found
    whole, at = "", 0
    for a, b, _, original, _ in found:
        whole += text[at:a] + original
        at = b
    same = sum(x == y for x, y in zip(whole + text[at:], SOUND[lang], strict=False))
    assert same >= 0.97 * len(SOUND[lang])


@pytest.mark.parametrize(("lang", "pair"), [("ru", ("cp1251", "western")), ("ru", ("koi8-r", "cp1251")), ("ru", ("utf-8", "cp1251")), ("pl", ("cp1250", "western"))])
def test_other_scripts(model, lang, pair):
    assert model.label(broken(SOUND[lang], pair))


def test_sound_text(model, corpus):
    assert not [t for t in corpus if model.label(t)]
    assert not model.label("When “é” shows up as “Ã©”, the file was opened with the wrong setting.")
    assert not model.label("The replacement sign � means a byte could not be shown.")
    assert not model.label("naïve café ½ ² ™\nmore ½ ² ™")
    assert not model.label("") and not model.label("plain ascii")


def test_part_of_a_text(model):
    text = SOUND["fr"] + " " + broken(SOUND["es"], ("utf-8", "western"))
    found = model.label(text)
    assert found and all(a > len(SOUND["fr"]) for a, *_ in found)


def test_lost(model):
    assert model.label("A caf� here")[0][2] == (("�", "�"),)


def test_question_marks_for_letters(model):
    """Letters that were lost when a text was written: within a word, at its head, or a whole word."""
    assert [x[:2] for x in model.label("Gr?ne K?che")] == [(2, 3), (7, 8)]
    assert model.label("l?été, ?té sera") and model.label("der Sch?ssel") and model.label("a;????????;b")
    for sound in ("Who knows? Nobody.", "really?? yes", "see /page?id=3 and /x?y=1", "?", "what ?", "(?)"):
        assert not model.label(sound)


def test_chain_ends_in_any_common_pair(model):
    """Read wrongly, written as UTF-8, and read wrongly again."""
    text = broken(SOUND["ru"], ("cp1251", "western"), ("utf-8", "western"))
    found = model.label(text)
    whole, at = "", 0
    for a, b, _, original, _ in found:
        whole += text[at:a] + original
        at = b
    whole += text[at:]
    same = sum(x == y for x, y in zip(whole, SOUND["ru"], strict=False))
    assert same >= 0.97 * len(SOUND["ru"])
    assert (("utf-8", "western"), ("cp1251", "western")) in {x[2] for x in found}


def test_characters_are_counted_in_full(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    full, few = garbled.train(df), garbled.train(df, 10)
    assert len(few.pairs) == 10 and few.count == full.count and few.floor == full.floor


def test_frame(spark, corpus):
    bad = broken(SOUND["de"], ("utf-8", "western"))
    rows = [("a", k, 0, t, "x") for k, t in enumerate(corpus)] + [("b", 1, 0, bad, "x"), ("b", 1, 0, bad, "x"), ("b", 2, 0, None, "x"), ("b", 3, 0, "", "x"), ("b", 4, None, SOUND["fr"] * 300, "x"), ("b", 5, 0, "lost �", "x")]
    df = spark.createDataFrame(rows, "src string, row_id long, pos long, text string, spans string")
    got = garbled.restored(df).collect()
    assert sorted((r.src, r.row_id, r.lost) for r in got) == [("b", 1, False), ("b", 1, False), ("b", 5, True)]
    assert got[0].restored == SOUND["de"] and got[0].spans[0].encodings == "utf-8>western"
    assert garbled.restored(df.limit(0)).count() == 0
