import random

import numpy as np

from ledgerlight.llm import leaks

WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]


def brute(text, passage):
    """Straight from the definition: a run of RUN words, or a stretch within its number of changes."""
    doc, p = leaks.words(text), leaks.words(passage)
    for a in range(len(p)):
        for b in range(len(doc)):
            n = 0
            while a + n < len(p) and b + n < len(doc) and p[a + n] == doc[b + n]:
                n += 1
            if n >= leaks.RUN:
                return True
    least = max(1, int(np.ceil(leaks.SHARE * len(p))))
    for a in range(len(p) - least + 1):
        row = [0] * (len(doc) + 1)
        for j in range(a, len(p)):
            new = [row[0] + 1]
            for k in range(1, len(doc) + 1):
                new.append(min(row[k - 1] + (p[j] != doc[k - 1]), row[k] + 1, new[-1] + 1))
            row = new
            n = j - a + 1
            if n >= least and min(row) * leaks.EDIT <= n:
                return True
    return False


def test_against_the_definition():
    rng = random.Random(11)
    items = [(k, " ".join(rng.choices(WORDS[: 60 + 5 * k], k=rng.choice([3, 8, 13, 20, 30, 45])))) for k in range(30)]
    index = leaks.Index.of(items)
    for trial in range(150):
        _, p = rng.choice(items)
        part = p.split()
        lo = rng.randrange(len(part))
        part = part[lo : lo + rng.choice([5, 11, 12, 13, 20, 40])] if rng.random() < 0.6 else part
        for _ in range(rng.choice([0, 1, 2, 4])):
            k = rng.randrange(len(part))
            part = {0: part[:k] + part[k + 1 :], 1: part[:k] + ["zz"] + part[k:], 2: [*part[:k], "zz", *part[k + 1 :]]}[rng.randrange(3)] or ["zz"]
        text = " ".join(rng.choices(WORDS, k=5) + part + rng.choices(WORDS, k=5))
        got = {items[i][0] for _, i, _, _ in index.hits([None, text, ""])}
        assert got == {k for k, q in items if brute(text, q)}, trial


def test_what_doesn_t_matter(spark):
    passage = "The tarred loom of Naïve Bel was lifted in 1857 by 24 chandlers, who charged 45 arar for brine."
    changed = "the  TARRED loom of naïve Bel—was l​if­ted in 1857 by 24 chandlérs who charged 45 arar for brine"
    corpus = spark.createDataFrame([(1, changed, 0), (1, changed, 0), (2, None, 0), (3, "", 0), (4, "the tarred loom of naive bel was lifted in", 0), (5, ("pad " * 50_000) + changed, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "!!"), (7, "other words")], "item_id long, passage string")
    assert sorted((r.doc_id, r.item_id, r.way) for r in leaks.leaked(corpus, items).collect()) == [(1, 7, "run"), (5, 7, "run")]
    assert leaks.leaked(corpus.limit(0), items).count() == 0 and leaks.leaked(corpus, items.limit(0)).count() == 0


def test_the_join_gives_the_same(spark, data, monkeypatch):
    """Beyond one block of passages, documents and passages are joined by shuffle."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.choice([2, 7, 13, 30])))) for k in range(30)] + [(3, "another passage of an item there is already, long enough to be found again"), (50, None), (51, "!!")]
    items = spark.createDataFrame(rows, "item_id long, passage string")
    corpus = items.selectExpr("item_id + 100 doc_id", "concat('x ', passage, ' y') text").union(items.selectExpr("item_id + 200", "substr(passage, 12)")).union(items.selectExpr("7L", "concat(passage, ' tail')"))
    held = spark.read.parquet(f"{data}/eval_items.parquet").filter("split_name <> 'train'")
    for c, i in ((corpus, items), (spark.read.parquet(f"{data}/documents.parquet"), held)):
        monkeypatch.setattr(leaks, "BLOCK", 4_000_000)
        whole = sorted(map(str, leaks.leaked(c, i).collect()))
        monkeypatch.setattr(leaks, "BLOCK", 200)
        assert sorted(map(str, leaks.leaked(c, i).collect())) == whole and whole
    monkeypatch.setattr(leaks, "FILTER", 1 << 10)  # a full bitmap lets more through, no less
    assert sorted(map(str, leaks.leaked(corpus, items).collect())) == sorted(map(str, leaks._looked_up(corpus.withColumnRenamed("text", "__text").filter("length(__text) > 0"), [r for r in items.collect() if r.passage], leaks.leaked(corpus, items).schema).distinct().collect()))
