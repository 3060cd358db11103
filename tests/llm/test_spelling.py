"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from calltide.llm import spelling

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, key bigint, low int, id string"


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, noise=31, min_chars=7, times=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= min_chars and c >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = set()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["analysis", "analyses", "analysés", "aaaaaaa", "aaaaaaaa", "aaaaaab", "aabaaaa", "ÉCOLEÀÿ×÷", "bcdefgh", "cbdefgh", "bcdefghi", "abcdefgh", "short", "Running", "runnning", "runing", "mississippi", "misissippi", "mississipi", "mississippis"]
    made = ["".join(rng.choice("abc") for _ in range(rng.randrange(6, 10))) for _ in range(300)]
    long = "".join(rng.choice("abcdefghij") for _ in range(64))
    base += [long, long + "x", long[:-1], "y" + long, long[:30] + "q" + long[31:] + "z", long * 60, (long * 60)[:2000] + (long * 60)[2001:]]
    weights = [rng.choice([1, 2, 3, 30, 400]) for _ in base + made]
    out = [(i, " ".join(rng.choices(base + made, weights, k=400)), "en", "clash", None, 1, 2, "x") for i in range(60)]
    odd = [None, "", "   ", "123 456 --", "Über-schön naïve É", " ".join(base), "chainedway " * 2, "chainedwayy " * 40 + "chainedwayyy " * 500]
    return out + [(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(odd)] + [(3, out[3][1], *out[3][2:]), (None, out[5][1], *out[5][2:])]


def test_variants_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([r[:2] for r in rows])
    assert result(spelling.spelling_variants(docs, noise=31)) == want
    assert len(want) > 200 and sum(w[1] is not None for w in want) > 30 and any(w[2] != w[1] and w[1] for w in want) and any(len(w[0]) > 2000 for w in want)
    assert result(spelling.spelling_variants(docs, min_chars=3, times=2)) == brute([r[:2] for r in rows], None, 3, 2)


def test_small_flushes_and_batches_change_nothing(spark, rows, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(9)], "text": [r[1] or "" for r in rows[:9]]})
    whole = Counter()
    for limit in (200_000, 5):
        monkeypatch.setattr(spelling, "COUNTED", limit)
        got = Counter()
        for out in spelling._counts(iter([batch]), 7, 31):
            for w, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[w] += n
        assert not whole or got == whole
        whole = got
    words = pa.RecordBatch.from_pydict({"id": list(range(len(whole))), "word": list(whole), "n": list(whole.values())})
    keys = set()
    for made in (500_000, 7):
        monkeypatch.setattr(spelling, "MADE", made)
        got = {tuple(r.values()) for out in spelling._keys(iter([words])) for r in out.to_pylist()}
        assert not keys or got == keys
        keys = got


def test_keys_are_those_of_the_deletions():
    words = ["aab", "abc", "a", "banana", "ÿ×÷"]
    of, keys, low, high = spelling.word_keys(words)
    own = {w: k for w, k in zip(words, keys[: len(words)], strict=True)}
    for i, word in enumerate(words):
        rows = [(int(k), int(a), int(b)) for o, k, a, b in zip(of, keys, low, high, strict=True) if o == i and a >= 0]
        strings = {word[:p] + word[p + 1 :] for p in range(len(word))}
        assert len(rows) == len(strings) and own[word] not in {k for k, *_ in rows}
        want = {int(spelling.word_keys([s])[1][0]) for s in strings if s}
        assert want <= {k for k, *_ in rows}
        for _, a, b in rows:
            assert len({word[:p] + word[p + 1 :] for p in range(a, b + 1)}) == 1


def test_no_words_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.spelling_variants(empty).count() == 0
    lone = spark.createDataFrame([(1, "solitary solitary"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in spelling.spelling_variants(lone).collect()] == [("solitary", None, "solitary", 2, 0, None)]
