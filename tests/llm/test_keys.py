"""Row keys of frames that are not plain files, word hashes that cannot be steered, match places of long texts."""

import itertools

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from creditlens.llm import bpe, credentials, exact, jaccard, pii, quality, substring
from creditlens.llm.text import Words, let, match_spans, running_sums, window_hashes, with_row_key
from tests.llm.test_operators import linked_components, sha, words

TEXTS = [" ".join(f"t{i}w{j}" for j in range(40)) for i in range(6)]


def made(spark, parquet, kind):
    """The same eight rows (doc_id, text, source) as a frame of another kind; two pairs of equal texts."""
    rows = [(i, TEXTS[i % 6], "s") for i in range(8)]
    files = parquet(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    if kind == "files":
        return files
    if kind == "union":
        return files.filter("doc_id < 3").unionByName(files.filter("doc_id >= 3"))
    if kind == "join":
        return files.join(parquet(spark.createDataFrame([("s", 1)], "source string, row_locator int")), "source").select("doc_id", "text", "source", "row_locator")
    if kind == "aggregate":
        return files.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("source").alias("source"))
    if kind == "explode":
        return files.filter("doc_id < 2 OR doc_id > 5").select("text", "source", F.explode(F.array("doc_id")).alias("doc_id")).unionByName(
            files.filter("doc_id BETWEEN 2 AND 5").select("text", "source", "doc_id"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


KINDS = ("files", "union", "join", "aggregate", "explode", "memory")


@pytest.mark.parametrize("kind", KINDS)
def test_operators_on_any_frame(spark, parquet, kind):
    df = made(spark, parquet, kind)
    stay = jaccard.one_per_component(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == [0, 1, 2, 3, 4, 5]
    stay = exact.deduplicate(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted((r.id, r.keep_id) for r in exact.verdicts(df).collect()) == [(i, i if i in range(2, 6) else i % 6 + 6) for i in range(8)]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [(i, i % 6) for i in range(8)]
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(i, 0 if i in range(2, 6) else 40) for i in range(8)]


@pytest.mark.parametrize("kind", KINDS)
def test_keys_are_distinct_and_stay(spark, parquet, kind):
    keyed = with_row_key(made(spark, parquet, kind))
    first, second = ({r.doc_id: (r.row_file, r.row_no) for r in keyed.collect()} for _ in range(2))
    assert first == second and len(set(first.values())) == 8


def test_rows_multiplied_by_a_join_have_keys_of_their_own(spark, parquet):
    df = made(spark, parquet, "files")
    twice = df.join(spark.createDataFrame([("s",), ("s",)], "source string"), "source")
    assert with_row_key(twice).select("row_file", "row_no").distinct().count() == 16


def test_columns_named_like_keys(spark, parquet):
    df = made(spark, parquet, "files").withColumn("row_locator", F.lit(1)).withColumn("row_file", F.lit("x")).withColumn("component_file", F.lit(2))
    df = df.withColumn("row_no", F.lit(None).cast("int"))
    for stay in (exact.deduplicate(df), jaccard.one_per_component(df)):
        assert stay.columns == df.columns and stay.count() == 6


def bit_parities():
    """Two different words of 1,024 letters whose difference any sum of letters times powers modulo 2**64 takes for nothing."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_defeat_power_sums(spark, documents):
    one, two = bit_parities()
    own = [[f"x{i}y{j}" for j in range(40)] for i in range(2)]
    rows = [
        (1, " ".join([*own[0][:20], one, *own[0][20:]]), "a"), (2, " ".join([*own[0][:20], two, *own[0][20:]]), "a"), (3, one, "a"), (4, two, "a"), (5, one, "a"),
        (6, f"{one} b c d e {two} b c d e " * 2, "a"), (7, f"{one} p q r s {two} p q r s " + " ".join(own[1]), "a"),
    ]
    df = documents(rows)
    removed = {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()}
    assert removed == {i: 0 for i in removed} and len(removed) == 7
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == sorted(linked_components([(i, t) for i, t, _ in rows]))
    for r in bpe.encode_frame(df, public_tokenizers.path("byte_bpe_50k.json")).collect():
        assert r.decoded_sha256 == sha(r.text)
    for r in quality.judge(df).collect():
        w = words(r.text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {p for i, k in enumerate(windows) if windows.count(k) > 1 for p in range(i, i + 5)}
        assert r.n_repeat_words == len(again)


def test_sequences_of_words_that_defeat_power_sums():
    """Windows of two words in the order of bit parities."""
    order = [i.bit_count() % 2 for i in range(4096)]
    hashes = [Words([" ".join("ab"[x ^ flip] for x in order).encode()]).hashes() for flip in (0, 1)]
    assert window_hashes(hashes[0], 4096)[0] != window_hashes(hashes[1], 4096)[0]


def test_window_hashes_follow_the_words():
    h = Words([b"a b c a b c d a b c a b c d x"]).hashes()
    for k in range(1, 9):
        got = window_hashes(h, k)
        assert len(got) == 15 - k + 1
        for i, j in itertools.combinations(range(len(got)), 2):
            assert (got[i] == got[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())
    assert len(window_hashes(h, 16)) == 0


def test_running_sums_and_let(spark):
    for n in (0, 1, 5, 512, 513, 2000):
        values = list(range(n))
        df = spark.createDataFrame([(values,), ([],)], "v array<bigint>").select(running_sums(F.col("v")).alias("s"), let(F.size("v"), lambda x: x + x).alias("d"))
        got = df.collect()
        assert got[0].s == list(itertools.accumulate(values)) and got[0].d == 2 * n and got[1].s == []


def test_places_of_many_matches(spark):
    text = "é1 22😀 333 " * 3000
    df = spark.createDataFrame([(text,), ("",)], "t string").withColumn("m", F.regexp_extract_all("t", F.lit("[0-9]+"), 0))
    got = df.select(match_spans(F.col("t"), F.col("m"), "[0-9]+", 4).alias("s")).collect()
    assert all(text[x.start : x.stop] == x.found and x.kind == 4 for x in got[0].s) and len(got[0].s) == 9000 and got[1].s == []


def test_long_texts_are_encoded_in_pieces():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, v = Tokenizer.from_file(path), bpe.Vocabulary.load(path)
    library.no_truncation()
    library.no_padding()
    text = "It's  a   long text,\n\n\tisn't it?  12'34 don't　 'S 's  été 東京  " * 40 + "nospace" * 50 + " end  "
    want = library.encode(text, add_special_tokens=False).ids
    for limit in (1, 2, 7, 50, 1000, 10**6):
        assert bpe.encode([text, "", "short"], v, limit)[0].tolist() == want


def test_many_addresses_in_one_text(documents):
    """A long log file: the places of matches cost no more than their number."""
    text = "10.0.0.1 a@b.cc " * 8_000
    df = documents([(1, text, "a")])
    found = pii.find(df, None).collect()[0]
    assert len(found.base) == 16_000 and found.base[-1].stop == len(text) - 1
    assert credentials.find(df).collect()[0].spans == []


def similar(n, group, share, size=120):
    """Texts of one group: a common text with each of its words replaced by an own one with chance ``share``."""
    import random

    rng = random.Random(group * 1000 + n)
    return [" ".join(f"o{group}x{i}y{j}" if rng.random() < share else f"c{group}w{j}" for j in range(size)) for i in range(n)]


@pytest.mark.parametrize("dense", [1, 5, 1000])
def test_groups_of_candidates_of_any_size(spark, documents, dense):
    """Near copies, near misses and chains give the same links whether a task settles them or not."""
    texts = [t for g, share in enumerate((0.0, 0.01, 0.02, 0.03, 0.04, 0.06)) for t in similar(25, g, share)]
    base = [f"z{j}" for j in range(200)]
    texts += [" ".join([*base[4 * i :], *(f"q{j}" for j in range(4 * i))]) for i in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(documents(rows), dense=dense).collect())
    want = sorted(linked_components([(i, t) for i, t, _ in rows]))
    assert got == want and 20 < len({c for _, _, c in want}) < len(rows)
