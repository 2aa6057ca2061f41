"""Each pipeline stage on odd rows, against brute force: null, empty and very long
texts, null ids and sources, ties, repeated rows, extra columns, empty tables."""

import base64
import collections
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
from test_near_copies import grams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, sid long, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(12)
    made = lambda n: " ".join(f"w{draw.randrange(3000)}x" for _ in range(n))
    banner = "Please accept all cookies of this site before you go on {}"
    texts = [None, "", " \n\t", "too short", "same again " * 30, "   only a few wide blanks here and then some more words to pass"]
    texts += [f"{made(14)}\n{banner.format(k)}\n\n{made(3)}" for k in range(25)]
    texts += [banner.format(99) + "\ntwo words", made(60_000), made(40)]
    base = made(80).split()
    texts += [" ".join(base), " ".join([*base[:-1], "other"]), "  ".join(base).upper()]
    rows = [(i, t, "en", "s0" if i % 3 else "s1" if i % 2 else None, 7, "d", "r", i, "h") for i, t in enumerate(texts)]
    rows = [(*r[:3], "s0", *r[4:]) if r[1] and "cookies" in r[1] else r for r in rows]
    rows += [rows[-1]] * 3 + [(5, made(30), "en", "s0", 7, None, None, None, None), (None, made(30), None, None, None, None, None, None, None), (None, " ".join(base[:60]), "en", "s1", 7, "d", "r", 0, "h")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_quality_stage(spark, odd):
    rows = [tuple(r) for r in odd.collect()]
    held, size = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        size[r[3]].add(r[1] or "")
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):
                held[r[3], normal(line)].add(r[1])
    often = {k for k, texts in held.items() if len(texts) > 20 and len(texts) > 0.005 * len(size[k[0]])}
    assert often
    expected = []
    for r in rows:
        ws = WORD.findall(r[1] or "")
        count = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        twice = {k + j for k in range(len(ws) - 4) if count[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        if len(ws) < 10 or 100 * len(twice) > 20 * len(ws):
            continue
        text = "\n".join(x for x in r[1].split("\n") if (r[3], normal(x)) not in often)
        left = len(WORD.findall(text))
        if left == len(ws) or (left >= 3 and left >= 0.1 * len(ws)):
            expected.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    found = corpus_pipeline.quality_rules(spark, odd, "")
    assert found.columns == odd.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_near_dedup_stage(spark, odd):
    rows = [tuple(r) for r in odd.collect()]
    sets, group = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or 10 * both >= 8 * (len(a) + len(b) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        ids[g].append(r[0])
    expected = [min((i for i in found if i is not None), default=None) for found in ids.values()]
    kept = corpus_pipeline.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns
    kept = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] for r in kept), key=repr) == sorted(expected, key=repr) and set(kept) <= set(rows)


def test_mix_stage(spark, odd):
    rows, count = odd.collect(), lambda t: len(WORD.findall(t or ""))
    mixed = corpus_pipeline.mix(spark, odd, "")
    assert mixed.columns == odd.columns
    found = [tuple(r) for r in mixed.collect()]
    again = [tuple(r) for r in corpus_pipeline.mix(spark, odd.repartition(3), "").collect()]
    assert sorted(found, key=repr) == sorted(again, key=repr)
    size, taken, per_row, epochs = (collections.Counter() for _ in range(4))
    texts = collections.defaultdict(list)
    for r in rows:
        size[r.source] += count(r.text)
        per_row[r.doc_id] += count(r.text)
        texts[r.doc_id].append(r.text or "")
    for r in found:
        assert count(r[1]) and r[4] == len(r[1]) and any(set(WORD.findall(r[1])) <= set(WORD.findall(t)) for t in texts[r[0]])
        taken[r[3]] += count(r[1])
        epochs[r[0]] += count(r[1])
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size)
    assert all(taken[s] <= 3 * size[s] for s in size) and all(epochs[i] <= 3 * per_row[i] for i in epochs)


def test_encode_stage(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in odd.collect():
        ids = encoding.encode_ordinary(r.text or "")
        expected.append((r.doc_id, r.source, ids, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), r.text or ""))))
    found = corpus_pipeline.encode(spark, odd, "")
    assert found.columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_run(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in found} < {r.doc_id for r in odd.collect()} and all(r.n_tokens == len(r.ids) > 0 for r in found)
