"""Pages of one template, each with a few words changed: exact components without comparing all pairs."""

import random

import pytest

from dossier.llm import neardup


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_of_a_template_are_not_compared_pair_by_pair(spark, monkeypatch, seed):
    rng = random.Random(seed)
    template = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(300):
        words = list(template)
        for at in rng.sample(range(150), rng.randint(1, 7)):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    low = list(range(len(sets)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    compared = []
    confirmed = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, sets: compared.append(pairs.count()) or confirmed(pairs, sets))
    monkeypatch.setattr(neardup, "COMPARED", 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {k: find(k) for k in range(len(sets))} and len(set(got.values())) > 50
    assert len(compared) > 1 and sum(compared[1:]) < 3 * len(sets)  # the first are the links within buckets
