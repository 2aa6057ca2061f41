"""Periodic runs, prefix dynamic programming and the prefix trie against brute force."""

import hashlib
import os
import random
import re
import zlib

import pyarrow as pa
import pytest
from graftline.llm import periodic, prefix_bpe, prefix_trie
from graftline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def true_runs(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q) and not any(ws[s + r : e] == ws[s : e - r] for r in range(1, q)):
                out.append((s, e - s, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def true_collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted(doc, ws):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_against_brute_force(spark):
    r = random.Random(5)
    texts = ["", None, "a", "a a a a a a", " a\ta\n a\x0ba a a  ", "a b a b a b a b", "a b a b a b a", "a a a a a", "é é é é é é", "a a " * 6, "x " * 5000, "a b " * 2000 + "a a a a a a a b"]
    for _ in range(300):
        ws = [r.choice("abcdefghij"[: r.choice([1, 2, 3, 10])]) for _ in range(r.randint(0, 60))]
        part = [r.choice("abc") for _ in range(r.randint(1, 12))]
        texts.append(r.choice([" ", "\n", "  "]).join(ws[:20] + part * r.randint(0, 7) + part[: r.randint(0, len(part))] + ws[20:]))
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    found = sorted((x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in periodic.runs(df).collect())
    true = []
    for _, t, *_ in rows:
        ws = WORD.findall(t or "")
        true.append((len(ws), true_runs(ws), true_collapsed(ws, true_runs(ws))))
    assert found == sorted(true)
    assert periodic.runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_occurrences_are_exact(size):
    """Sums that are a multiple of one prime aren't taken for nought."""
    import numpy as np

    r = np.random.default_rng(size)
    words = r.choice([1, 2, 3, 2013265921 // 2], 40 * size).astype(np.int64)
    words[size * 5 : size * 9] = words[size * 3 : size * 7]
    padded = np.append(words, np.zeros(3 * size, dtype=np.int64))
    starts = np.arange(40, dtype=np.int64) * size
    found = {*zip(*(x.tolist() for x in periodic.occurrences(padded, starts, size)))}
    assert found == {(int(j), d) for j in starts for d in range(size, 2 * size) if (padded[j : j + size] == padded[j + d : j + d + size]).all()}


def test_long_runs_take_no_longer_than_they_are(spark):
    texts = ["a " * 400_000, " ".join(f"w{i % 30_000}" for i in range(150_000))]
    found = periodic.runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc").collect()
    assert [[tuple(y) for y in x["runs"]] for x in found] == [[(0, 400_000, 1)], [(0, 150_000, 30_000)]]


@data
def test_op11(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert len(found) == len(docs) and any(r["n_runs"] for r in found.values())
    for d in docs:
        ws = planted(d["doc_id"], WORD.findall(d["text"] or ""))
        # Periods of planted documents may be long; of the others up to 40 words are enough to try.
        runs = true_runs(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = found[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(true_collapsed(ws, runs) if runs else " ".join(ws))


# Prefix dynamic programming


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(tokenizer_path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path)


def test_encodes_as_the_library(spark, tokenizer, tokenizer_path):
    r = random.Random(3)
    texts = ["", None, "a" * 3000, " " * 60, "<|endoftext|>a <|endoftext|><|endoftext|>", "x\t y\n\nz", "don't 's 'S we'll", "ünï " * 40, "　x y ", "a ", " a", "\n"]
    texts += ["".join(r.choice("ab ehtsn'\n.,1 éü中😀<|>") for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["".join(r.choice("ab") for _ in range(r.randint(0, 500))) for _ in range(60)]
    texts += [" ".join(form.replace("%", chr(c)) for form in ("x%.", "xx%s's", "1%", "% a")) for c in range(1, 0x33000, 37) if not 0xD800 <= c < 0xE000]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted((tuple(tokenizer.encode(t or "", add_special_tokens=False).ids), t or "") for _, t, _ in rows)
    assert sorted((tuple(x["ids"]), x["decoded"]) for x in prefix_bpe.round_trip(df, tokenizer_path).collect()) == want
    assert sorted(tuple(x["ids"]) for x in prefix_bpe.encode(df, tokenizer_path).collect()) == [w[0] for w in want]
    assert prefix_bpe.encode(df.limit(0), tokenizer_path).collect() == []


def test_decodes_any_ids(spark, tokenizer, tokenizer_path):
    r = random.Random(4)
    lists = [[r.randint(0, 50_256) for _ in range(30)] for _ in range(50)]
    df = spark.createDataFrame([*enumerate(lists), (50, None), (51, []), (52, [-1, 64, 999_999, None])], "doc long, ids array<int>")
    found = {x["doc"]: x["decoded"] for x in prefix_bpe.decode(df, tokenizer_path).collect()}
    assert [found[i] for i in range(50)] == [tokenizer.decode(x, skip_special_tokens=False) for x in lists]
    assert [found[i] for i in (50, 51, 52)] == ["", "", tokenizer.decode([64])]


def test_merges_by_hand():
    # a b c; ab, bc, abc by way of ab: abc is one token, bcc stays bc c.
    m = prefix_bpe.Merges([1, 1, 1, 2, 2, 3], [(0, 1, 3), (1, 2, 4), (3, 2, 5)])
    assert m.sound == [True] * 6
    assert not m.compatible(0, 4) and m.compatible(4, 2) and not m.compatible(3, 2) and m.compatible(5, 5)
    # bc first: abc can't come out of ab and c.
    assert prefix_bpe.Merges([1, 1, 1, 2, 2, 3], [(1, 2, 3), (0, 1, 4), (4, 2, 5)]).sound[5] is False
    # Of equal pairs the left one merges: aaa is aa a.
    m = prefix_bpe.Merges([1, 2], [(0, 0, 1)])
    assert m.compatible(1, 0) and not m.compatible(0, 1) and not m.compatible(0, 0) and m.compatible(1, 1)
    with pytest.raises(ValueError):
        prefix_bpe.Merges([1, 1, 2, 3], [(2, 0, 3), (0, 1, 2)])


@data
def test_op12(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in QUERIES["op12_prefix_bpe"](spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


# Prefix trie


def true_trie(turns):
    """Nodes as rows, from (conv, turn, role, text)."""
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(t, key=lambda x: (x[0] is not None, x[0] or 0))] for c, t in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = set()
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        children = [x for x in below if len(x) == len(node) + 1]
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(node))))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, sha(ends)))
    return out


def found_trie(df, **options):
    rows = prefix_trie.trie(prefix_trie.with_shared_starts(prefix_trie.conversations(df)), **options).collect()
    assert len({(r["conv"], r["depth"]) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


TURNS = "conv_id long, turn long, role string, text string, depth string, key string"


@pytest.mark.parametrize("options", [{}, {"depth": 1}, {"depth": 1, "most": 6}, {"depth": 2, "most": 10**6}])
def test_trie_against_brute_force(spark, options):
    r = random.Random(6)
    turns = []
    for c in r.sample(range(120), 60):
        n = r.choice([1, 2, 3, 5, 30])
        turns += [(c, None if k == 0 and c % 3 else k, r.choice(["u", None, "a"]) if k > 1 else "u", r.choice(["x y", "", None, "z"]) if k != 4 else "w w w", "x", "y") for k in range(n)]
    turns += [(None, 1, "u", "x", "x", "y"), (200, None, None, None, "x", "y")]
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    assert found_trie(df, **options) == true_trie([t[:4] for t in turns])


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    assert found_trie(spark.createDataFrame([], TURNS)) == set()
    turns = [(c, k, "u", f"{k // 2} a", "", "") for c in (0, 20) for k in range(300)]
    assert found_trie(spark.createDataFrame(turns, TURNS)) == true_trie([t[:4] for t in turns])


def test_ends_in_pieces(spark):
    """Ids over many ranges, negative ones too, come in numeric order."""
    ids = [*range(-5, 5), *range(65_530, 65_545), 10**12, 10**12 + 70_000]
    convs = spark.createDataFrame([(c, []) for c in ids], "conv long, turns array<struct<digest:string,words:bigint>>").repartition(4)
    ((_, digest),) = prefix_trie.ends(convs).collect()
    assert digest == sha(",".join(map(str, ids)))


@data
def test_op13(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = QUERIES["op13_prefix_trie"](spark, FOLDER).collect()
    assert {tuple(r) for r in rows} == true_trie(turns) and len(rows) == len(true_trie(turns))


def test_arrow_splits_at_the_same_blanks():
    import pyarrow.compute as pc

    text = "".join(f"{chr(c)}w" for c in range(1, 0x3100))
    parts = [x for x in pc.ascii_split_whitespace(pa.array([text]))[0].as_py() if x]
    assert parts == WORD.findall(text)
