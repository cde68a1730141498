"""Each operator against a plain version, on edge cases and on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditlens.llm import bpe, chat, exact, jaccard, mixing, pii, quality, substring, text, toxicity, warc

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def bag(rows):
    return collections.Counter(rows)


def read(df, *columns):
    return bag(tuple(r) for r in df.select(*columns).collect())


def small_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]


# --- words and hashes


def test_words_are_cut_at_six_characters_only():
    sample = "a\x1cb c\x85d\te f\n\x0bg  h"
    w = text.Words([sample.encode(), b"", b" x "])
    found = [w.data[a:b].decode() for a, b in zip(w.start, w.stop)]
    assert found == words(sample) + ["x"]
    assert list(w.count) == [len(words(sample)), 0, 1]


def test_word_hashes_do_not_depend_on_the_place():
    w = text.Words([b"one two three one two", b"zz one two three"])
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[4] and len({*h[:3]}) == 3
    k = text.window_hashes(h, 2)
    assert k[0] == k[3] == k[6] and k[1] != k[0]


# --- 1 substring dedup


def repeats(rows, window=35):
    split = [(i, words(t)) for i, t in rows]
    seen = bag(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                keep[s : s + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), sha(kept)))
    return bag(out)


@pytest.mark.parametrize("limit", [4000, 2])
def test_substring_edges(documents, edge_rows, limit):
    got = read(substring.remove_repeats(documents(edge_rows), group_limit=limit, bin_rows=50), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats([r[:2] for r in edge_rows])


def test_substring_random_repeats(documents):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = [f"v{x}" for x in rng.integers(0, 40, rng.integers(0, 150))]
        a, n = rng.integers(0, 30), rng.integers(20, 60)
        rows.append((i, " ".join(w[:30] + passage[a : a + n] + w[30:] + passage[: rng.integers(0, 60)]), "s"))
    for limit in (4000, 5):
        got = read(substring.remove_repeats(documents(rows), group_limit=limit, bin_rows=200), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == repeats([r[:2] for r in rows])


def test_substring_copies_are_listed_by_anchor(documents):
    rng = np.random.default_rng(6)
    w = [f"v{x}" for x in rng.integers(0, 90, 200)]
    rows = [(i, " ".join(w), "s") for i in range(40)] + [(40 + i, " ".join([*w[:90], f"own{i}", *w[91:]]), "s") for i in range(5)]
    made, listed = [], substring.write_stage

    def counted(df, name):
        out = listed(df, name)
        made.append((name, out))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring, "write_stage", counted)
        got = read(substring.remove_repeats(documents(rows), group_limit=2), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats([r[:2] for r in rows])
    sizes = {name: df.count() for name, df in made}
    # One row per anchor and document; the windows of the 40 copies are listed once, those of each of the 5 near copies where they differ.
    assert sizes["runs"] < 45 * 166 / 5
    assert sizes["distinct-runs"] < sizes["runs"] / 4
    made.clear()
    rows = [(i, " ".join(w[:40] * 30), "s") for i in range(4)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring, "write_stage", counted)
        got = read(substring.remove_repeats(documents(rows), group_limit=2), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats([r[:2] for r in rows])
    # A line that a document repeats has its runs once, but for those at the end.
    assert dict(made)["runs"].count() < 4 * 12


def test_substring_small_tables(spark, documents):
    rows = small_rows(spark)
    got = read(substring.remove_repeats(documents(rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats([r[:2] for r in rows])


# --- 2 Jaccard join


def linked_components(rows):
    sets = []
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest.setdefault(root(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in smallest[root(k)] if x is not None]
        out.append((i, len(sets[k]), i if not sets[k] else min(ids, default=None)))
    return bag(out)


def near_copies(n, size, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{x}" for x in rng.integers(0, 10_000, size)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, size, rng.integers(0, edits)):
            w[k] = f"e{rng.integers(0, 10_000)}"
        out.append((i, " ".join(w[: size - int(rng.integers(0, 3))]), "s"))
    return out


@pytest.mark.parametrize("rarity", [2000, 2])
def test_jaccard_edges(documents, edge_rows, rarity):
    got = read(jaccard.join(documents(edge_rows), rarity=rarity), "doc_id", "n_shingles", "component_id")
    assert got == linked_components([r[:2] for r in edge_rows])


@pytest.mark.parametrize("block", [2000, 7])
def test_jaccard_group_of_near_copies(documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(60, 120, 9, 1) + [(1000 + i, t, s) for i, t, s in near_copies(40, 14, 2, 2)]
    got = read(jaccard.join(documents(rows), rarity=3), "doc_id", "n_shingles", "component_id")
    assert got == linked_components([r[:2] for r in rows])


@pytest.mark.parametrize("size", [1, 64])
def test_signatures_are_written_only_if_shared(documents, monkeypatch, size):
    stages, write = {}, jaccard.write_stage

    def kept(df, name):
        stages.setdefault(name, []).append(write(df, name))
        return stages[name][-1]

    monkeypatch.setattr(jaccard, "write_stage", kept)
    monkeypatch.setattr(jaccard, "BIN", size)
    rows = near_copies(40, 120, 9, 5) + [(1000 + i, " ".join(f"o{i}w{j}" for j in range(90)), "s") for i in range(30)]
    got = read(jaccard.join(documents(rows), dense=1), "doc_id", "n_shingles", "component_id")
    assert got == linked_components([r[:2] for r in rows])
    assert "index" not in stages and stages["members"]
    for shared in stages["shared"]:
        assert min(r["n"] for r in shared.groupBy("sign").agg(F.count_distinct("short").alias("n")).collect()) > 1


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        lost = int(rng.integers(0, jaccard.allowed_losses(len(a)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 60, rng.integers(0, 3)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        frequent = np.uint64(rng.integers(1, 4))
        one, two = (jaccard.signatures(x, x % np.uint64(3) < frequent) for x in (a, b))
        assert (len(a) == len(b) == common) or len(np.intersect1d(one, two))


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (900, 1500))
    x, y = jaccard.parity_bits(a), jaccard.parity_bits(b)
    size = min(len(x), len(y))
    assert np.bitwise_count(np.frombuffer(jaccard.folded(x, size), np.uint8) ^ np.frombuffer(jaccard.folded(y, size), np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_one_per_component(documents, edge_rows):
    docs = documents(edge_rows)
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    comps = linked_components([r[:2] for r in edge_rows])
    groups = {c for (i, n, c) in comps if n}
    empties = sum(k for (i, n, c), k in comps.items() if not n)
    assert kept.count() == len(groups) + empties


# --- 3 toxicity


def test_toxicity_learns_only_allowed_labels(spark, parquet):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    texts = [b"", b"some ordinary words", b"you idiot"]
    assert list(one.scores(texts)) == list(two.scores(texts))
    assert zlib.crc32(b"17") % 4 == spark.range(1).select(F.crc32(F.lit("17").cast("binary")) % 4).first()[0]


def test_toxicity_held_out_quality(spark):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta", "ro", "vi") for b in ("ren", "dos", "mal", "tik", "per", "gan")]
    texts, toxic = [], []
    for i in range(900):
        w = list(rng.choice(plain, rng.integers(20, 200)))
        y = i % 6 == 0
        for _ in range(rng.integers(2, 6) if y else 0):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["grumpfool", "sludgebrain", "wretchling"])))
        texts.append(" ".join(w).encode())
        toxic.append(y)
    toxic = np.array(toxic)
    model = toxicity.fit(texts[:600], toxic[:600], (500, 100))
    scores = model.scores(texts[600:])
    assert ((scores >= toxicity.THRESHOLD) == toxic[600:]).mean() > 0.97
    assert ((scores >= 0) & (scores <= 1)).all()


def test_toxicity_edges(spark, documents, edge_rows):
    docs = documents(edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    assert read(scored, "score", "predicted") == {(0.0, 0): len(edge_rows)}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- 4 mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while len(fixed) < len(names):
        rest = total - sum(3 * sizes[s] for s in fixed)
        open_ = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            target.update(share)
            break
        fixed |= over
    return {s: target.get(s, 3.0 * sizes[s]) for s in names}


def test_mixing_targets(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i:02d}": int(rng.integers(0, 10 ** rng.integers(1, 5))) for i in range(n)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mixing_edges(documents, edge_rows):
    docs = documents(edge_rows)
    mixed = mixing.with_copies(docs)
    sizes = collections.Counter()
    for i, t, s in edge_rows:
        sizes[s] += len(words(t))
    want = plain_targets(dict(sizes))
    for r in mixed.select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect():
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs).count() == out.count()
    assert mixing.mix(docs.limit(0)).count() == 0


# --- 5 exact dedup


def test_exact_edges(documents, edge_rows):
    docs = documents(edge_rows)
    normal = [(i, "".join(c.lower() if c.isascii() else c for c in t or "")) for i, t, _ in edge_rows]
    groups = collections.defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact.verdicts(docs)
    assert read(got, "id", "keep_id", "group_size", "text_sha256") == bag((i, best[t], len(groups[t]), sha(t)) for i, t in normal)
    kept = read(got.filter("kept"), "id", "text_sha256")
    assert kept == bag((best[t], sha(t)) for t in groups)
    out = exact.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(groups)


def test_exact_in_several_steps(documents):
    rows = [(i, f"text {i % 7}", "a") for i in range(200)]
    docs = documents(rows).repartition(6)
    got = exact.deduplicate(docs, bytes_per_batch="1000")
    assert read(got, "doc_id") == bag((max(i for i in range(200) if i % 7 == k),) for k in range(7))


def test_exact_empty_table(documents, edge_rows):
    assert exact.verdicts(documents([])).count() == 0


# --- 6 BPE


def test_bpe_edges(spark, documents, edge_rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = edge_rows + [
        (20, "<|endoftext|>a <|endoftext|><|endoftext|>", "a"), (21, "aaaaaaa" * 500, "a"), (22, "it's we'll 'tis I'VE 中文 \U0001f600\U0010ffff x", "a"),
        (23, "\n\n  two\t tabs  \n", "a"), (24, "\U0010ffff", "a"),
    ]
    got = read(bpe.encode_frame(documents(rows), VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = collections.Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_frame(documents([]), VOCABULARY).count() == 0


def test_bpe_random_texts():
    v, tokenizer = bpe.Vocabulary.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(8)
    letters = list("ab'sdlrevtm  \n\t1²é中😀!?- \x85\x1c") + ["the", " and", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    assert [x.tolist() for x in bpe.encode(texts, v)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(x, v) for x in bpe.encode(texts, v)] == texts


def test_bpe_decodes_broken_bytes():
    v, tokenizer = bpe.Vocabulary.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    ids = tokenizer.encode("中é", add_special_tokens=False).ids[:-1] + [0, 50256]
    assert bpe.decode(np.array(ids), v) == tokenizer.decode(ids, skip_special_tokens=False)


# --- 7 quality


def plain_quality(t):
    t = t or ""
    w = words(t)
    seen = bag(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(documents, edge_rows):
    rows = edge_rows + [(30, "a b c d e\na b c d e\n\n \nx # $ | é", "a"), (31, "### " * 30, "a"), (32, " ".join(f"word{i}" for i in range(60)), "a")]
    judged = quality.judge(documents(rows))
    got = read(judged, "doc_id", *quality.BASE, "base_failed")
    want = collections.Counter()
    for i, t, _ in rows:
        m = plain_quality(t)
        want[(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert kept[32] and not kept[31] and not kept[4]


def test_quality_verdict_does_not_depend_on_the_order(documents, spark):
    docs = documents(small_rows(spark))
    names = [r.name for r in quality.RULES]
    assert sorted(quality.cascade_order(docs)) == sorted(names)
    one, two = (read(quality.judge(docs, order=o), "doc_id", "kept", "base_failed") for o in (names, names[::-1]))
    assert one == two
    assert quality.judge(documents([])).count() == 0 and sorted(quality.cascade_order(documents([]))) == sorted(names)


# --- 8 WARC


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 150
    rows = [
        (5, "http://a/1", big), (3, "http://a/2\r\nX: y", big), (9, None, big), (1, "http://b", "short"), (2, "http://c", "short"),
        (7, "http://d", None), (8, "http://d", ""), (3, "http://a/2", big), (None, "http://e", big), (11, "é", "ü" * 200_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    folder, index = warc.write_archives(pages, file_bytes=500)
    got = {}
    for r in warc.read_records(folder, index, block_bytes=700, gap_bytes=10).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert [r.record_type for r in got[3]] == ["response", "response"] and bytes(got[3][0].payload) == big.encode()
    for i in (5, 9, None):
        assert got[i][0].record_type == "revisit" and got[i][0].refers_to == 3 and got[i][0].payload is None
        assert got[i][0].payload_bytes == len(big) and got[i][0].payload_digest == sha(big)
    assert all(got[i][0].record_type == "response" for i in (1, 2, 7, 8, 11))
    assert bytes(got[11][0].payload).decode() == "ü" * 200_000 and bytes(got[7][0].payload) == b""
    assert got[9][0].url is None and got[3][0].url.startswith("http://a/2")
    some = index.filter(F.col("page_id").isin(1, 11))
    assert {r.page_id for r in warc.read_records(folder, some).collect()} == {1, 11}
    assert warc.read_records(folder, index.limit(0)).count() == 0


def test_warc_empty(spark):
    folder, index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read_records(folder, index).count() == 0


# --- 9 PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def plain_spans(t):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }
            if fits[name]:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_pii_base_spans(documents, edge_rows):
    rng = np.random.default_rng(3)
    pieces = ["a", "B", "9", "1", "23", "+", "-", " ", ".", "@", "_", "%", "(", ")", "4539578763621486", "é", "😀", "255", "300", "x@y.z", "+49 170 1234567", "1.2.3.4", "\n"]
    rows = edge_rows + [(100 + i, "".join(rng.choice(pieces, rng.integers(0, 40))), "a") for i in range(1500)]
    rows += [(5000, "a" * 3000, "a"), (5001, "1" * 9000, "a"), (5002, "a." * 3000 + "@", "a"), (5003, "1 " * 9000, "a"), (5004, "x@" + "a." * 3000 + "b", "a"), (5005, "1." * 5000, "a")]
    docs = documents(rows)
    got = read(pii.find(docs.select("doc_id", "text"), None).select("doc_id", pii.listed(F.col("base")).alias("b")), "doc_id", "b")
    assert got == bag((i, plain_spans(t)) for i, t, _ in rows)


def test_pii_adds_spans_and_keeps_base(documents):
    rng = np.random.default_rng(1)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'plain words here token = "{key()}" and 1.2.3.4 there', "a") for i in range(40)]
    rows += [(100 + i, f"item number-{i:06d} on page 12345678 of it", "a") for i in range(40)]
    docs = documents(rows)
    found = {r.doc_id: r.s for r in pii.find(docs, pii.train(docs)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    for i, t, _ in rows:
        base = set(filter(None, plain_spans(t).split(",")))
        spans = set(filter(None, found[i].split(",")))
        assert base <= spans and (len(spans) > len(base)) == (i < 100)
    assert pii.train(documents([])) is None


def test_pii_finds_secrets_of_any_length(documents):
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n - 8)) + "abcdef0f"
    lengths = (40, 128, 129, 500, 5000, 200_000)
    prefix = 'plain words here token = "'
    # Digits never stand side by side often enough for a card.
    secrets = {i: re.sub("[0-9]{9}", "fabcdef0a", key(lengths[i % 6])) for i in range(48)}
    rows = [(i, f'{prefix}{s}" there', "a") for i, s in secrets.items()]
    rows += [(100 + i, f"item number-{i:06d} on page 12345678 of it", "a") for i in range(40)]
    rows += [(200, "a" * 200_000, "a"), (201, "-" * 300 + "1", "a"), (202, "/srv/data" * 30 + "/" + "0a1b2c3d" * 5, "a")]
    docs = documents(rows)
    candidates = {r.doc_id: [c.found for c in r.candidates] for r in pii.with_spans(docs.select("doc_id", "text")).select("doc_id", "candidates").collect()}
    assert all(candidates[i] == [s] for i, s in secrets.items())
    assert candidates[200] == [] and [len(c) for c in candidates[201]] == [301] and candidates[202] == [rows[-1][1]]
    found = {r.doc_id: r.s for r in pii.find(docs, pii.train(docs)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert all(found[i] == f"secret:{len(prefix)}:{len(prefix) + len(s)}" for i, s in secrets.items())


def test_pii_plan_holds_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    plan = pii.find(docs, pii.train(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 10 chat


def test_escape_is_reversible():
    rng = np.random.default_rng(9)
    pieces = [*chat.CONTROL, "\\", "|", "<", ">", "[", "a", "</", "INST"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces, rng.integers(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


@pytest.mark.parametrize("per_block,piece", [(64, 500_000), (2, 30)])
def test_chat_edges(spark, per_block, piece):
    rows = [
        (1, 0, "system", "be <|end|> kind"), (1, 1, "user", None), (1, 2, "assistant", "yes\n\\o/ </s>"), (1, 3, "assistant", "twice é😀"), (1, 3, "assistant", "twice é😀"),
        (2, None, None, "x"), (2, 5, "assistant", ""), (None, 1, "assistant", " lead and trail "), (3, 70, "assistant", "late"), (3, 2, "user", "early"), (4, 0, "user", "a" * 5000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(0)).repartition(3)
    pieces = chat.format_conversations(df, VOCABULARY, per_block, piece)
    got = read(chat.conversation_digests(pieces), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    want = collections.Counter()
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        formatted, _ = chat.render([(r, x) for _, r, x in turns])
        want[conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned), len(formatted)] += 1
    assert got == want
    assert chat.conversation_digests(chat.format_conversations(df.limit(0), VOCABULARY)).count() == 0


def test_mask_by_binary_search():
    offsets = np.array([[0, 2], [2, 5], [5, 5], [5, 9], [9, 12]])
    spans = np.array([[3, 4], [9, 10]])
    assert chat.token_mask(offsets, spans).tolist() == [False, True, False, False, True]
