"""Lines that many documents share, in blocks of several lines."""

import collections
import random
import re

import pytest

from graftline.llm import quality

LETTERS = "abcdefghij"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def name(k):
    """Digits don't tell lines apart."""
    return "".join(LETTERS[int(c)] for c in f"{k:05}")


@pytest.mark.parametrize(("shared", "own"), [(1, 1), (2, 1), (5, 1), (5, 2), (10, 2), (10, 10)])
def test_blocks_of_shared_lines(spark, shared, own):
    block = [f"shared words of line {name(70_000 + k)}" for k in range(shared)]
    mine = lambda i: [f"own words {name(i)} of line {name(80_000 + k)} and twenty more words that fill it up so that it is long enough to stay" for k in range(own)]
    rows = [(i, "\n".join([*block, *mine(i)]), "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality.removed_lines(docs).collect()
    assert len(found) == 60 and all(len(r.removed) == shared and r.removed_words == 5 * shared for r in found)


def test_copies_count_once(spark):
    """Documents with nothing but shared lines, and copies, hide no boilerplate."""
    foot, head = "the foot of all the pages", "the head of all the pages"
    texts = [f"own words {name(i)}\n{foot}" for i in range(40)]  # 40 documents differ
    texts += [foot] * 200 + [f"{head}\n{foot}"] * 30  # with copies counted once, two more
    texts += ["a text that is copied\nin all of its lines"] * 50
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.doc: r.removed_words for r in quality.judge(docs, quality.LineRules(copies_once=True)).collect() if r.removed_words}
    assert collections.Counter(found.values()) == {6: 270} and set(found) == set(range(270))


def test_copies_count_by_their_ids(spark):
    """Of 300 equal pages among 400 the line is boilerplate; rows that repeat aren't more documents."""
    rows = [(i, "an equal line on many pages that all have nothing else on them" if i < 300 else f"own words {name(i)} and ten more of them that fill up the line", "s") for i in range(400)]
    rows += [(1000, "a row of some words that is there many times over, always the same", "s")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc: r for r in quality.judge(docs).collect()}
    assert [i for i, r in found.items() if r.removed_words] == [i for i, r in found.items() if not r.kept] and {i for i, r in found.items() if not r.kept} == set(range(300))


def normal(line):
    line = re.sub(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ", re.sub("[0-9]+", "0", line.lower()))
    return line.strip(" ")


def brute(rows, rules):
    """``(removed words, depleted, text that is left)`` of each row."""
    holds, pages = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, host in rows:
        text = text or ""
        key = text if rules.copies_once else (i, text)
        pages[host].add(key)
        for x in text.split("\n"):
            if WORD.search(x):
                holds[host, normal(x)].add(key)
    often = {k for k, texts in holds.items() if len(texts) > rules.min_docs and len(texts) > rules.max_share * len(pages[k[0]])}
    out = []
    for _, text, host in rows:
        lines = (text or "").split("\n")
        gone = [x for x in lines if WORD.search(x) and (host, normal(x)) in often]
        n, removed = len(WORD.findall(text or "")), sum(len(WORD.findall(x)) for x in gone)
        out.append((removed, removed > 0 and (n - removed < rules.min_words or n - removed < rules.min_kept * n), "\n".join(x for x in lines if x not in gone)))
    return out


@pytest.mark.parametrize("rules", [quality.LineRules(), quality.LineRules(copies_once=True), quality.LineRules(min_docs=5, max_share=0.05, min_kept=0.4)])
def test_against_brute_force(spark, rules):
    """Pages that are mostly template, pages of one line, copies, other hosts, nulls."""
    draw = random.Random(9)
    template = [f"template line {name(k)} with some words of its own" for k in range(20)]
    own = lambda i, k: [f"page {name(i)} says {name(60_000 + 10 * i + j)} in a line of its own" for j in range(k)]
    texts = [("\n".join([*template[:10], *own(i, 3)]), "mostly") for i in range(300)]
    texts += [("\n".join([*template, *own(1000 + i, 3)]), "mostly") for i in range(100)]
    texts += [("\n".join(template[: 1 + i % 20]), "only") for i in range(100)]
    texts += [("one equal line on a page of its own", "single")] * 100 + [(f"one line {name(i)}", "single") for i in range(200)]
    texts += [("one equal line on a page of its own\n" + own(3000 + i, 1)[0], "single") for i in range(25)]
    texts += [("\n".join(draw.sample(template, 3) + own(5000 + i, 2)), None) for i in range(120)]
    texts += [("Head  LINE 12\t of\r all\n" + own(6000 + i, 1)[0] * (1 + 400 * (i == 3)), "other") for i in range(40)]
    texts += [(None, "other"), ("", "other"), (" \n\t", None), ("\n".join(template * 300), "mostly")]
    rows = [(i, t, h) for i, (t, h) in enumerate(texts)]
    rows += rows[:5] + [(None, texts[7][0], "mostly"), (8, texts[9][0], "only")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, host long, line long").repartition(5)
    want = brute(rows, rules)
    got = collections.Counter((r.doc, r.n_words, r.removed_words, r.kept) for r in quality.judge(docs, rules).collect())
    failed = {r.doc: r.base_failed for r in quality.judge(docs, rules).collect() if r.doc is not None}
    failed[None] = failed[7]
    assert got == collections.Counter((i, len(WORD.findall(t or "")), removed, not failed[i] and not gone) for (i, t, _), (removed, gone, _) in zip(rows, want, strict=True))
    cleaned = quality.clean(docs, rules)
    assert cleaned.columns == docs.columns
    left = collections.Counter((r.doc_id, r.text, r.source) for r in cleaned.collect())
    assert left == collections.Counter((i, new if removed else t, h) for (i, t, h), (removed, gone, new) in zip(rows, want, strict=True) if not failed[i] and not gone)
    assert sum(removed > 0 for removed, _, _ in want) > 400


def test_hosts_are_counted_exactly(spark):
    rows = [(i % 5000, "no line" if i % 2 else " ", "a") for i in range(10_000)] + [(None, f"text {name(i)}", "b") for i in range(300)] + [(i, f"text {name(i)}", None) for i in range(7001)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string")
    assert {r.host: r.docs for r in quality.host_sizes(docs).collect()} == {"a": 5000, "b": 300, None: 7001}
    assert {r.host: r.docs for r in quality.host_sizes(docs, copies_once=True).collect()} == {"a": 2, "b": 300, None: 7001}


def test_share_of_a_host_is_exact(spark):
    """30 of 6,000 documents are 0.5 %, 30 of 5,999 are more; documents without words count."""
    for n, removed in ((6000, 0), (5999, 30)):
        rows = [(i, f"own words {name(i)}\nthe foot of the page" if i < 30 else f"text {name(i)}" if i < n - 1 else "", "s") for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert quality.removed_lines(docs).count() == removed
