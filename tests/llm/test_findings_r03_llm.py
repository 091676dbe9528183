"""Small cases of the third round's findings on the training-data operators."""

import random

from scholarmesh.llm import near_dedup as N


def test_outliers_of_a_near_copy_group_are_not_paired_with_all_of_it(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{n}" for n in range(200)]

    def changed(n):
        text = list(base)
        for at in rng.sample(range(200), n):
            text[at] = f"x{rng.randrange(60)}"
        return " ".join(text)

    texts = [changed(7) for _ in range(40)] + [changed(24) for _ in range(40)]
    pairs, verified = [], N.verified

    def counted(rows, *more):
        pairs.append(rows.count())
        return verified(rows, *more)

    monkeypatch.setattr(N, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    word = [t.split() for t in texts]
    code = {w: n for n, w in enumerate(sorted({w for t in word for w in t}))}
    rows = [N.np.array([code[w] for w in t], N.np.uint64) for t in word]
    linked = [(a, b) for a in range(80) for b in range(a) if N.aligned(rows[a], rows[b]) >= N.LEAST]
    root = list(range(80))
    for _ in range(80):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert [found[n] for n in range(80)] == root
    assert sum(pairs[1:]) < 100
