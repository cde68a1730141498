"""Phrase collocations against a plain version."""

import collections
import random
import re

import pytest

from creditlens.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, collections.Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return {lang: c for lang, c in counts.items() if c}


def plain(rows, least=10, first=2000):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in f.items() if len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS phrase", "1 AS n", "2 AS word", "3 AS `group`", "4 AS size", "5 AS score")


def mined(spark, rows, **options):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in phrases.collocations(frame(spark, rows), **options).collect())


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "ÉTÉ", "été", "a\x1cb", "x\x85y", "\x00", "東京", "don't", "--", " "] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[30, 20, 8, 8, *[3] * (len(vocabulary) - 4)], k=rng.randrange(0, 60))
        rows.append(("".join(w + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\x0b", "! "]) for w in words), rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("new york city " * 40, "fr"), ("new york city " * 40, "fr"), (" \t ", "fr"), ("A A A A A A A A A A A A", "aa")]


def test_small_corpus(spark):
    rows = corpus()
    want = plain(rows)
    assert mined(spark, rows) == want and len({w[0] for w in want}) == 5


@pytest.mark.parametrize("batch_bytes", [40, 700])
def test_many_groups_and_stretches(spark, monkeypatch, batch_bytes):
    """Tiny groups, so that prefixes of one and two words are extended; stretches that cut texts; few bits, so that others are extended by chance."""
    monkeypatch.setattr(phrases, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(phrases.stretches, "__defaults__", (batch_bytes,))
    monkeypatch.setattr(phrases, "BITS", 64)
    rows = corpus(6)
    assert mined(spark, rows, group_bytes=300) == plain(rows)


def test_first_phrases_only(spark):
    rows = corpus(7)
    assert mined(spark, rows, first=9, least=3) == plain(rows, 3, 9)


def test_hot_phrase_and_long_text(spark):
    """One pair is a third of all words; one text is a single piece of many stretches."""
    rng = random.Random(2)
    words = [f"k{rng.randrange(300)}" for _ in range(4000)]
    for i in range(0, len(words) - 1, 6):
        words[i : i + 2] = ["hot", "pair"]
    rows = [(" ".join(words), "en"), ("hot pair " * 30, "en"), ("longword" * 40_000 + " hot pair", "en")]
    assert mined(spark, rows) == plain(rows)


def test_counts_are_exact_past_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "x", 1, big + 1), ("en", "y", 1, big + 7), ("en", "x y", 2, big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()
    assert [tuple(r) for r in got] == [("en", "x y", big, big + 1, big + 7, 1000000 * big * big // ((big + 1) * (big + 7)))]


def test_stretches_cover_each_word_once():
    rng = random.Random(4)
    for limit in (1, 7, 30, 1000):
        texts = ["".join(rng.choice(["ab", "c", "déf", " ", " ", "\t", "\n", ".", "  "]) for _ in range(rng.randrange(200))).encode() for _ in range(20)]
        want = collections.Counter(p for t in texts for p in triples(t.translate(phrases._FOLD), None))
        got = collections.Counter(p for data, own in phrases.stretches(texts, limit) for p in triples(data, own))
        assert got == want


def triples(data, own):
    """The truncated suffixes of the words that begin before ``own``."""
    for piece in re.finditer(rb"[^\n]+", data):
        w = list(re.finditer(rb"[^\t ]+", piece[0]))
        for i, m in enumerate(w):
            if own is None or piece.start() + m.start() < own:
                yield tuple(x[0] for x in w[i : i + 3])


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en")]) == []
