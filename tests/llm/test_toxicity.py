"""Class-conditional Kneser-Ney scores against the formula written out over dictionaries, and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from tongueprint.llm import toxicity
from tongueprint.llm.quality import held_out

DOCS = "doc_id long, text string, per_char string, top int, part int, id string, word string"


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    plain = ["the", "house", "under", "river", "of", "stone", "and", "walking", "garden", "öfter"]
    bad = ["zgrok", "zgroks", "zgroker", "vlixu", "vlixum"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), "x", 1, 2, "y", "z"))
        labels.append((i, int(toxic)))
    return docs, labels


def textbook(counts, order):
    """P(class, run) by recursion, counts as {run: (n0, n1)}."""
    below = [Counter() for _ in range(order)]
    kinds = set(counts)
    for k in range(order - 1, 0, -1):
        for run in kinds:
            below[k][run[1:]] += 1
        kinds = set(below[k])

    def d(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return one / (one + 2 * two) if one else 0.5

    ds = {k: d(list(below[k].values())) for k in range(1, order)}
    sums = {k: defaultdict(lambda: [0, 0]) for k in range(1, order)}
    for k in range(1, order):
        for run, n in below[k].items():
            sums[k][run[:-1]][0] += n
            sums[k][run[:-1]][1] += 1

    def low(run):
        k = len(run)
        if k == 1:
            return below[1][run] / sum(below[1].values())
        total, many = sums[k][run[:-1]]
        return (below[k][run] - ds[k]) / total + ds[k] * many / total * low(run[1:])

    top = [d([v[c] for v in counts.values()]) for c in (0, 1)]
    contexts = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for run, ns in counts.items():
        for c in (0, 1):
            contexts[c][run[:-1]][0] += ns[c]
            contexts[c][run[:-1]][1] += ns[c] > 0

    def ratio(run):
        if run in counts:
            ps = []
            for c in (0, 1):
                total, many = contexts[c][run[:-1]]
                ps.append(low(run[1:]) if not total else max(counts[run][c] - top[c], 0) / total + top[c] * many / total * low(run[1:]))
            return math.log(ps[1]) - math.log(ps[0])
        if run[:-1] not in contexts[0] and run[:-1] not in contexts[1]:
            return 0.0
        rest = [top[c] * contexts[c][run[:-1]][1] / contexts[c][run[:-1]][0] if contexts[c][run[:-1]][0] else 1.0 for c in (0, 1)]
        return math.log(rest[1]) - math.log(rest[0])

    return ratio


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, frames, toxicity.train(*frames)


def test_scores_equal_the_formula(spark, trained):
    docs, labels, (texts, _), model = trained
    rows = toxicity.labelled(*trained[2], "doc_id", "text", "toxic")
    aside = {r["id"] for r in rows.where(toxicity.F.pmod("part", toxicity.F.lit(4)) == 0).select("id").collect()}
    known = {r["id"] for r in rows.select("id").collect()}
    words = [Counter(), Counter()]
    for (i, text, *_), (_, y) in zip(docs, labels):
        if i in known - aside:
            words[y].update(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))
    counts = defaultdict(lambda: [0, 0])
    for y in (0, 1):
        for w, n in words[y].items():
            padded = "    " + w + " "
            for i in range(len(w) + 1):
                counts[padded[i:i + 5]][y] += n
    ratio = textbook(dict(counts), 5)

    def expected(text):
        found = [sum(ratio(("    " + w + " ")[i:i + 5]) for i in range(len(w) + 1)) for w in text.lower().split()]
        return sum(found) / sum(len(w) + 1 for w in text.split()), max(found)

    got = {r["doc_id"]: r for r in toxicity.measure(texts, model).collect()}
    for i, text, *_ in docs:
        per_char, top = expected(text)
        assert got[i]["per_char"] == pytest.approx(per_char, abs=1e-9) and got[i]["top"] == pytest.approx(top, abs=1e-9)


def test_joins_give_the_same_scores(spark, trained):
    texts, model = trained[2][0], trained[3]
    odd = spark.createDataFrame([(1, None, "", 1, 2, "", ""), (1, "", "", 1, 2, "", ""), (None, " \t\n", "", 1, 2, "", ""), (2, "Zgrok " * 9000, "", 1, 2, "", "")], DOCS)
    both = texts.unionByName(odd).unionByName(odd)

    def rows(settings):
        scored = toxicity.score(both, replace(model, settings=settings))
        return sorted((str(r["doc_id"]), r["text"] or "", round(r["score"], 9)) for r in scored.collect())

    sent = rows(model.settings)
    assert sent == rows(replace(model.settings, ship_rows=0))
    assert len(sent) == 248 and all(0 <= s <= 1 for *_, s in sent)
    assert [s for _, text, s in sent if text.startswith("Zgrok")] > [0.9, 0.9]


def test_held_out_rows_are_told_apart(spark, trained):
    docs, labels, (texts, known), model = trained
    scored = toxicity.score(texts, model).join(known, "doc_id").where(held_out()).collect()
    assert len(scored) > 20
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in scored) >= 0.95 * len(scored)


def test_without_labels_or_texts(spark):
    docs = spark.createDataFrame(corpus(12)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == 12
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, odd)).count() == 0
