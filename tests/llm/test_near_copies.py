"""The near-dedup stage against brute-force Jaccard pairs."""

import random

import corpus_pipeline
from graftline.llm import shingles


def grams(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def smallest_ids(texts):
    """The smallest id of each component, over all pairs."""
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {root(i) for i in range(len(texts))}


def test_stage_drops_edited_copies(spark):
    draw = random.Random(8)
    made = lambda n: [f"w{draw.randrange(900)}" for _ in range(n)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for _ in range(40):
        base = made(draw.randrange(60, 400))
        texts.append(" ".join(base))
        for edits in (1, 2, len(base) // 60, len(base) // 45, len(base) // 35, len(base) // 20):  # about 0.8 and on both sides of it
            copy = list(base)
            for k in draw.sample(range(len(copy)), edits):
                copy[k] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    hub = made(300)  # each copy is near the hub, few are near each other
    for _ in range(60):
        copy = list(hub)
        for k in draw.sample(range(300), 6):
            copy[k] = f"y{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    order = list(range(len(texts)))
    draw.shuffle(order)
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest_ids(texts))
    assert shingles.first_of_each(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, "alone in the whole wide table")]
    kept = shingles.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)
