"""Each operator against a brute-force version, with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns whose names clash."""

import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.llm import ann, bpe, katz, lengths, mixing, quality, simhash, token_files, urls, warc
from graftline.llm.common import connected_components, shared_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, fp string, row string, line string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefgéßñ文") for _ in range(draw.randrange(1, 7))) for _ in range(150)]
    line = "shared line of many documents here"

    def made(n):
        return " ".join(draw.choice(vocabulary) + draw.choice(["", "", ",", "."]) for _ in range(n))

    out = [f"{made(draw.randrange(1, 40))}\n{line if k % 2 else made(9)}\n{made(20)}" for k in range(80)]
    base = made(150)
    out += [base, base, base + " more", base.upper(), "x " + base]
    out += [None, "", " ", "\n\t", "a", "A b", "one  two\x0bthree", "it's  3 o'clock!!\r\n ok <|endoftext|>", made(4000), "same words " * 30, "\u00a0\u2003 x", "the end."]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 5 else f"s{i % 3}", 0, "x", "y", "z", "l") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "en", "s0", 0, "x", "y", "z", "l")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(None, 1), (5, 5)] + [(200, k) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in edges if None not in (a, b) and a != b for n in (a, b)}
    assert got == {n: label[n] for n in linked}


def test_quality(spark, docs, nothing):
    rows = {r.doc: r for r in quality.judge(docs, quality.LineRules(min_docs=5)).collect()}
    for r in docs.collect():
        ws, lines = words(r.text), [x for x in (r.text or "").split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        twice = {k + j for k in range(len(ws) - 4) if count[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        got = rows[r.doc_id]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(twice))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (len(ws) < 10 or 100 * len(twice) > 20 * len(ws))
    cleaned = quality.clean(docs, quality.LineRules(min_docs=5))
    assert cleaned.columns == docs.columns
    kept = {r.doc_id: r for r in cleaned.collect()}
    assert kept.keys() == {k for k, r in rows.items() if r.kept}
    assert all("shared line" not in r.text for r in kept.values() if r.source is not None)
    assert quality.judge(nothing).count() == 0 and quality.clean(nothing).count() == 0


def test_copies_are_not_boilerplate(spark):
    text = "first line of a text that is copied\nand a second line that follows it\nand a third"
    own = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(100)]  # digits don't tell lines apart
    rows = [(i, text, "s") for i in range(100)] + [(100 + i, f"own words of {w} {w}{w} stand here in a line\nfooter that is everywhere on this host\nlast {w}", "s") for i, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc: r for r in quality.judge(docs, quality.LineRules(copies_once=True)).collect()}
    assert all(got[i].kept and got[i].removed_words == 0 for i in range(100))
    assert all(got[100 + i].removed_words == 7 for i in range(100))
    by_id = {r.doc: r for r in quality.judge(docs).collect()}
    assert not any(by_id[i].kept for i in range(100)) and all(by_id[100 + i].removed_words == 7 for i in range(100))


def test_mixing(spark, docs, nothing):
    got = mixing.taken_words(mixing.mix_documents(docs, mixing.Mix(block_words=16, shard_slots=32))).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert len(got) == docs.count() and all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.taken_words(mixing.mix_documents(docs.repartition(2), mixing.Mix(block_words=16, shard_slots=32))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    pieces = mixing.mixed_texts(docs, mixing.Mix(block_words=16, shard_slots=32))
    assert pieces.columns == docs.columns
    held = collections.Counter()
    for r in pieces.collect():
        held[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in held.items() if v} == {k: v for k, v in (collections.Counter({}) + sum((collections.Counter({r.doc_id: r.taken}) for r in got), collections.Counter())).items() if v}
    assert mixing.taken_words(mixing.mix_documents(nothing)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 16, F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in out) == list(range(n))


def test_simhash(spark, docs, nothing):
    import xxhash

    def brute(text):
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.components(docs).collect()
    prints = {r.doc_id: brute(r.text) for r in docs.collect()}
    label = {i: i for i in prints if i is not None}
    for _ in range(10):
        for i in label:
            for j in label:
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    for r in got:
        assert r.fp % (1 << 64) == prints[r.doc]
        assert r.doc is None or r.component == label[r.doc]
    assert len(got) == docs.count()
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label.values()))
    assert simhash.components(nothing).count() == 0


def test_covering_masks_miss_nothing(spark):
    masks, draw = [m % (1 << 64) for m in simhash.masks(3)], random.Random(2)
    assert len(masks) == 15
    for _ in range(3000):
        differ = sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 4)))
        assert any(not differ & m for m in masks)
    # One bucket of many near fingerprints, in blocks.
    base = draw.getrandbits(63)
    prints = sorted({base} | {base ^ sum(1 << b for b in draw.sample(range(63), 2)) for _ in range(300)})
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = connected_components(simhash.links(rows, most=40)).collect()
    assert {r.node for r in found} == set(prints) and {r.component for r in found} == {prints[0]}


def test_bpe(spark, docs, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = decoded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids) == encoding.encode_ordinary(text[r.doc]) and bytes(r.bytes).decode() == text[r.doc]
    for r in bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN)).collect():
        ids = encoding.encode_ordinary(text[r.doc])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc].encode()).hexdigest())
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [1, None, 2**30, 5]), (2, None), (3, [])], "doc long, ids array<int>")
    by_rank = {v: k for k, v in ranks.items()}
    assert {r.doc: bytes(r.bytes) for r in bpe.decode(odd, path, public_tokenizers.PATTERN).collect()} == {1: by_rank[1] + by_rank[5], 2: b"", 3: b""}


@pytest.mark.parametrize("kind", ["base64", "dna", "one letter", "period", "scripts", "syllables", "marks"])
def test_bpe_of_long_words(kind):
    """Words of 100 kB, which no pattern splits, and shorter ones of every length."""
    import time

    import pyarrow as pa

    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(kind)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n = 100_000
    made = {
        "base64": lambda n: "".join(draw.choices(letters, k=n)),
        "dna": lambda n: "".join(draw.choices("ACGT", k=n)),
        "one letter": lambda n: " " + "a" * n,
        "period": lambda n: ("xab" * n)[:n],
        "scripts": lambda n: "".join(draw.choices("abcé中文の한", k=n // 2)),
        "syllables": lambda n: "".join(draw.choices(["tion", "ing", "er", "aa", "th", "z"], k=n // 3)),
        "marks": lambda n: "=" * n + "-" * 300,
    }[kind]
    coder = bpe.Coder.of(path, public_tokenizers.PATTERN)
    began = time.time()
    texts = [made(n), *[made(k) for k in range(100, 700, 7)]]
    ids = coder.encode(pa.array(texts))
    assert ids.to_pylist() == [encoding.encode_ordinary(t) for t in texts]
    assert coder.decode(ids).to_pylist() == [t.encode() for t in texts]
    assert time.time() - began < 60


def test_token_files(spark, docs, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    assert any("<|endoftext|>" in (r.text or "") for r in docs.collect())
    files = token_files.write(docs, shared_folder(spark, "ids"), path, end_id=2)
    rows = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text or ""))
    at = 0
    assert len(rows) == len(want)
    for r, d in zip(rows, want, strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc, r.start, r.n_tokens) == (d.doc_id, at, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)
    assert token_files.read(token_files.write(nothing, shared_folder(spark, "ids"), path, end_id=2)).count() == 0


def test_token_files_of_many_ids(spark, docs, monkeypatch):
    """Files that are rolled within a task are in order as well."""
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 700)
    write_raw, path = token_files._write_raw, public_tokenizers.path("byte_bpe_50k.json")

    def small(*args):
        run = write_raw(*args)

        def rolled(batches):
            token_files.FILE_IDS, token_files.SLICE_BYTES = 500, 700
            yield from run(batches)

        return rolled

    monkeypatch.setattr(token_files, "_write_raw", small)
    files = token_files.write(docs, shared_folder(spark, "ids"), path, end_id=2)
    assert files.count() > 8
    rows = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text is not None, r.text or ""))
    assert [r.doc for r in rows] == [d.doc_id for d in want]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_code_limit(spark, docs):
    with pytest.raises(ValueError, match="symbols"):
        token_files.write(docs, shared_folder(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_bits=4)


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (16, 4), (300, 9), (300, 16)):
        counts = (rng.pareto(0.6, n) * 10 + 1).astype(np.int64)
        size = token_files.code_lengths(counts, limit).astype(int)
        assert size.max() <= limit and sum(2.0**-s for s in size) <= 1
        ids = rng.integers(0, n, 5000).astype("<u4")
        code = token_files.Code(size.astype(np.uint8))
        data, at = code.pack(ids)
        assert (code.unpack(np.frombuffer(data, np.uint8), at, len(ids)) == ids).all()
        assert (code.unpack(np.frombuffer(data, np.uint8), at[2:3], 1024) == ids[2048:3072]).all()  # a block by itself
    with pytest.raises(ValueError, match="symbols"):
        token_files.code_lengths(np.ones(17, dtype=np.int64), 4)


def test_warc(spark, nothing):
    rows = [(1, "http://a b/ü", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "x", None), (4, "y", ""), (5, "z\r\nEvil: 1", "long " * 90_000), (1, "http://a b/ü", "<p>é</p>"), (None, "n", "<p>é</p>"), (9, "q", "own")]
    pages = spark.createDataFrame([(*r, "page", "digest") for r in rows], "page_id long, url string, html string, page string, digest string").repartition(3)
    files = warc.write(pages, shared_folder(spark, "warc"), file_bytes=200)
    got = warc.read(files, payloads=True).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r.refers_to == (None if r.page_id == first[html] else first[html]) and r.record_type == ("response" if r.refers_to is None else "revisit")
        assert (bytes(r.payload) if r.payload is not None else None) == (html.encode() if r.refers_to is None else None)
    assert all(len({r.record_id for r in got if r.record_id.startswith(f"<urn:page:{i}:")}) == sum(r.page_id == i and r.refers_to is not None for r in got) for i in (2, 4))
    key = lambda r: (r.page_id is None, r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
    spread = warc.read(warc.write(pages, shared_folder(spark, "warc"), hot_bytes=600)).collect()
    assert sorted(map(key, spread), key=str) == sorted(map(key, got), key=str)
    large = warc.read(warc.write(pages, shared_folder(spark, "warc"), min_bytes=100)).collect()
    assert all(r.record_type == "response" for r in large)
    empty = spark.createDataFrame([], pages.schema)
    assert warc.read(warc.write(empty, shared_folder(spark, "warc"))).count() == 0


def test_warc_reader_finds_damage():
    data = warc.record_bytes(1, "u", b"payload", warc.digest(b"payload"), None) * 3
    assert len(list(warc.read_records(io.BytesIO(data)))) == 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError, match="payload"):
        list(warc.read_records(io.BytesIO(warc.record_bytes(1, "u", b"payload", warc.digest(b"other"), None))))


def test_warc_of_others(spark, tmp_path):
    """Records as other tools write them, without optional fields and of other types."""

    def record(kind, block, *fields):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", f"Content-Length: {len(block)}", *fields])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = "Content-Type: application/http; msgtype=response"
    sha = lambda x: "WARC-Payload-Digest: sha256:" + hashlib.sha256(x).hexdigest()
    b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=y\r\npedia\r\n0\r\n\r\n"
    made = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        record("response", b"HTTP/1.1 200 OK\r\nX-Long: one\r\n two\r\n\r\nbody", http, "WARC-Target-URI: http://a/"),
        record("response", chunked, http, "WARC-Payload-Digest: sha1:" + b32(b"Wikipedia")),
        record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\ncut", http, "WARC-Truncated: length", sha(b"cut")),
        record("resource", b"a file", "Content-Type: text/plain", "WARC-Block-Digest: md5:" + hashlib.md5(b"a file").hexdigest()),
        record("metadata", b"", "WARC-Block-Digest: blake9:AAAA"),
        record("response", b"20200101 a.example", "Content-Type: text/dns"),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:x>"),
        record("response", b"HTTP/1.1 200 OK", http),
    ]
    path = tmp_path / "others.warc.gz"
    path.write_bytes(b"".join(made))
    got = warc.read(spark.createDataFrame([(str(path),)], "path string"), payloads=True).collect()
    bodies = [b"software: x\r\n", b"", b"body", chunked.partition(b"\r\n\r\n")[2], b"cut", b"a file", b"", b"20200101 a.example", None, b""]
    assert [r.payload if r.payload is None else bytes(r.payload) for r in got] == bodies
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "resource", "metadata", "response", "revisit", "response"]
    assert all(r.page_id is None and r.refers_to is None for r in got) and got[8].refers_to_id == "<urn:uuid:x>" and got[8].payload_bytes is None
    assert got[2].payload_digest == b32(b"body") and got[3].payload_digest == b32(b"Wikipedia") and got[4].payload_digest == "sha256:" + hashlib.sha256(b"cut").hexdigest()
    folded = list(warc.read_records(io.BytesIO(made[2])))[0]
    assert folded.http == {"x-long": "one two"}
    for bad in (record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, sha(b"other")), record("resource", b"x", "WARC-Block-Digest: sha1:" + b32(b"y")), record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody", http)):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_urls(spark):
    made = ["https://WWW.Example.ORG/es/1?q=/x#y", "http://a.example.org/en/19", "http://a.example.org/en/2", "http://b.com/fr/x", "http://b.com/de/", "http://xcom/de/", "org/", None, "", "http://org", "http://org/", "//x.org/", "ftp://h?q", "http://h#f/de/", "a://b://c/d"]
    got = urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string"), urls.train(spark.createDataFrame([], "url string, label int"))).collect()
    want = [("www.example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/19", "example.org/en/1", "block"), ("a.example.org", "/en/2", "org/", "allow"), ("b.com", "/fr/x", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"), ("xcom", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("x.org", "/", "org/", "allow") if False else ("", "", None, "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow")]
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.page_id)] == want


def test_url_model_on_held_out_pages(spark):
    labelled = urls.labelled_by_rules(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    counts = {(r.label, r.blocked): r.n for r in urls.held_out(labelled).collect()}
    assert counts.get((0, False), 0) + counts.get((1, True), 0) >= 0.95 * sum(counts.values()) and counts[1, True]


def test_url_model_on_held_out_rows(spark):
    draw = random.Random(4)
    rows = [(f"http://{'casino' if bad else 'school'}{draw.randrange(999)}.example.net/{draw.choice('abc')}/{draw.randrange(9999)}", bad) for bad in (draw.random() < 0.5 for _ in range(400))]
    model = urls.train(spark.createDataFrame(rows[:300], "url string, label boolean").withColumn("label", F.col("label").cast("int")))
    held = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.judge(held, model).collect()}
    assert sum(got[i] == bad for i, (_, bad) in enumerate(rows[300:])) >= 95


def test_lengths(spark, docs, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = lengths._encoding(path, public_tokenizers.PATTERN)
    true = [len(encoding.encode_ordinary(r.text or "")) for r in docs.collect()]
    assert tiktoken
    hist = lengths.histogram(lengths.encoded_lengths(docs, path, public_tokenizers.PATTERN))
    sums = lengths.suffix_sums(hist, span=7)
    rows = sums.collect()
    assert sorted(r.length for r in rows) == sorted(set(true))
    for r in rows:
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) == (true.count(r.length), sum(x >= r.length for x in true), sum(x for x in true if x >= r.length), sum(min(x, r.length) for x in true))
    assert tuple(lengths.totals(sums).first()) == (len(true), sum(true))
    limits = [0, 1, 5, 33, 10**6]
    assert list(lengths.at_limits(sums, limits).first()) == [sum(min(x, n) for x in true) for n in limits]
    ordered = sorted(true)
    assert list(lengths.quantiles(sums, [0.1, 0.5, 1.0]).first()) == [ordered[math.ceil(q * len(true)) - 1] for q in (0.1, 0.5, 1.0)]
    by = lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(docs, path, public_tokenizers.PATTERN, by=("source",)), ("source",)), ("source",))
    assert sum(r.n_docs for r in by.collect()) == len(true)
    assert tuple(lengths.totals(lengths.suffix_sums(lengths.histogram(lengths.encoded_lengths(nothing, path, public_tokenizers.PATTERN)))).first()) == (0, 0)


@pytest.mark.parametrize("block_rows", [1500, 25])
def test_embeddings(spark, block_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(220, 16))
    x[100:130] = x[0] + rng.normal(size=(30, 16)) * 0.08
    x[130:140] = x[1]
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)] + [(300, None, "n"), (301, [0.0] * 16, "n"), (302, [float("nan")] * 16, "n"), (303, [None] * 16, "n"), (304, [], "n"), (305, [1.0, 2.0], "n"), (306, [2.0, 4.0], "n"), (None, x[0].tolist(), "n"), (0, x[0].tolist(), "n")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    found = ann.near_duplicates(vectors, graph=ann.Graph(shard_rows=40, block_rows=block_rows))
    valid = [(i, np.array(v) / np.linalg.norm(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [sum(k != j and len(a) == len(b) and a @ b >= 0.9 for j, (_, b) in enumerate(valid)) for k, (_, a) in enumerate(valid)]
    label = {i: i for i, _ in valid}
    for _ in range(4):
        for i, a in valid:
            for j, b in valid:
                if len(a) == len(b) and a @ b >= 0.9:
                    label[i] = label[j] = min(label[i], label[j])
    got = collections.defaultdict(list)
    for r in found.rows.collect():
        got[r.id].append(r)
    assert sum(map(len, got.values())) == len(rows) and found.recall >= 0.99
    for (i, _), n in zip(valid, links, strict=True):
        assert all(r.n_links == n and r.component == label[i] for r in got[i])
    assert all(r.n_links == 0 and r.component == i for i in range(300, 305) for r in got[i])
    assert ann.near_duplicates(spark.createDataFrame([], vectors.schema)).rows.count() == 0


def test_embeddings_in_cells(spark):
    """Cells that are too large get centroids of their own; every link is planted."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(500, 32))
    away -= (away * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.86, 0.99, size=(500, 1))
    x = np.concatenate([x, cosine * x[:500] + np.sqrt(1 - cosine**2) * away])
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    graph = ann.Graph(max_centroids=2, shard_rows=40)
    found = ann.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), graph=graph)
    got = {r.id: r.n_links for r in found.rows.collect()}
    assert sum(true) > 500 and all(got[i] <= n for i, n in enumerate(true))
    assert sum(got.values()) >= 0.95 * sum(true) and found.recall >= 0.9


def test_recall_is_not_vacuous(spark):
    """Vectors without links: the probes have some; a search that finds nothing fails."""
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 32)))], "vec_id long, embedding array<double>")
    found = ann.near_duplicates(vectors)
    assert found.recall >= 0.99 and all(r.n_links == 0 and r.component == r.id for r in found.rows.collect())
    nodes = vectors.select(F.xxhash64("embedding").alias("node"), F.lit(1).cast("long").alias("weight"), "embedding", F.size("embedding").alias("dim"))
    asked = ann.probes(nodes, 0.9, ann.Graph())
    assert asked.count() == 256
    assert ann.audit(nodes, asked, spark.createDataFrame([], "node long, links long"), 0.9, ann.Graph()) == 0


@pytest.mark.parametrize(("order", "hot", "cut"), [(2, 2000, 1), (3, 2000, 2), (3, 40, 1), (4, 2000, 1), (4, 40, 2)])
def test_katz(spark, docs, nothing, monkeypatch, order, hot, cut):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(katz, "HOT", hot)
    model = katz.train(docs, order, least=cut)
    rows = model.scores().collect()
    assert len(rows) == docs.count() and model.stats.buckets > 3
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    grams = {k: collections.Counter() for k in range(1, order + 1)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def context(ws, i, k):
        """The k - 1 words before ws[i]; before a text stands an end."""
        ahead = [b"", *ws[:i]]
        return tuple(ahead[len(ahead) - (k - 1) :]) if len(ahead) >= k - 1 else None

    for r in docs.collect():
        if not held(r.doc_id):
            ws = tokens(r.text)
            for i, w in enumerate(ws):
                for k in grams:
                    if context(ws, i, k) is not None:
                        grams[k][*context(ws, i, k), w] += 1
    least = {k: 1 if k < 3 else cut for k in grams}

    def factors(counts):
        n = collections.Counter(min(c, 7) for c in counts)
        common = 6 * n[6] / n[1] if n[1] else 1
        raw = {c: ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and common < 1 else 0 for c in range(1, 6)}
        return {c: d if 0 < d <= 1 else (c - 0.5) / c for c, d in raw.items()}

    d = {k: factors(g.values()) for k, g in grams.items()}
    one, total = {w: c for (w,), c in grams[1].items()}, sum(grams[1].values())
    unknown = sum(c * (1 - d[1][c]) for c in one.values() if c <= 5) / total
    after = {k: collections.defaultdict(dict) for k in grams}
    size = {k: collections.Counter() for k in grams}
    for k, g in grams.items():
        for (*h, w), c in g.items():
            size[k][tuple(h)] += c
            if c >= least[k]:
                after[k][tuple(h)][w] = c
    known = {}

    def given(h, w):
        k = len(h) + 1
        if k == 1:
            return one[w] * d[1].get(one[w], 1) / total if w in one else unknown
        if size[k][h] < least[k]:
            return given(h[1:], w)
        if h not in known:
            free = size[k][h] - sum(c * d[k].get(c, 1) for c in after[k][h].values())
            known[h] = free, size[k][h] + (free <= 1e-9), 1 - sum(given(h[1:], x) for x in after[k][h])
        free, n, left = known[h]
        c = after[k][h].get(w, 0)
        return c * d[k].get(c, 1) / n if c else (free if free > 1e-9 else 1) / n / left * given(h[1:], w)

    for k in range(2, order + 1):
        some = [h for h in after[k] if after[k][h]][:15]
        assert some and all(abs(sum(given(h, w) for w in one) + given(h, b"\0") - 1) < 1e-9 for h in some)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        ws = tokens(text[r.doc])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc), len(ws), sum(w in one for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((one.get(w, 0) + 1) / (total + len(one) + 1)) for w in ws))
        assert r.score == pytest.approx(sum(math.log10(given(next(h for k in range(order, 0, -1) if (h := context(ws, i, k)) is not None), w)) for i, w in enumerate(ws)))
    for k in grams:
        assert sorted(r["count"] for r in model.table(k).collect()) == sorted(c for c in grams[k].values() if c >= least[k])
    assert katz.train(nothing, order).scores().count() == 0


@pytest.mark.parametrize(("order", "hot", "cut"), [(2, 2000, 1), (3, 4000, 1), (4, 4000, 2)])
def test_katz_spread(spark, docs, nothing, monkeypatch, order, hot, cut):
    """Contexts of several words are spread over buckets as well."""
    monkeypatch.setattr(katz, "HOT_TOKENS", 0)
    levels = []
    monkeypatch.setattr(katz, "Model", lambda *a, make=katz.Model: levels.append(len(a[4].hot)) or make(*a))
    test_katz(spark, docs, nothing, monkeypatch, order, hot, cut)
    assert levels[0] == order - 1
