"""The pipeline's near-dedup stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline


def kept(texts):
    """Ids of the first of each component of pairs with a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    while True:
        before = list(root)
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b))
        if root == before:
            return sorted(set(root))


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    texts, common = [], say(40)
    for _ in range(25):
        base = say(rng.randint(20, 150))
        texts.append(base)
        for edits in (1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
    chain = say(100)
    for k in range(12):  # neighbours are alike, the ends are not
        texts.append(chain[4 * k :] + [f"c{i}" for i in range(4 * k)])
    texts += [common + say(8) for _ in range(15)] + [common + say(40) for _ in range(15)]
    crowd = say(120)
    for k in range(60):
        texts.append([*crowd[: k + 1], f"x{k}", *crowd[k + 1 :]])
    texts = [" ".join(t) for t in texts] + [None, "", " \n", "one two", "One\ttwo", "one two three", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(texts)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
