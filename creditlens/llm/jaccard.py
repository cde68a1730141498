"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the distinct shingles of five words, as 64-bit hashes. Documents link when the intersection
of their sets has at least 80 % of the size of the union.

1. Classes. Documents with equal sets (by 128 bits over the sorted set) are one class; all further work is on classes.
2. Frequent tokens. Each batch of documents reports the shingles it holds often; those with 1/``RARITY`` of all documents or
   about that are frequent. There are at most mean set size x 2 ``RARITY`` of them, however many documents there are, so the list is sent to all tasks.
3. Prefixes. Tokens are ordered rare ones first. A set of size n may lack up to t = n - ceil(0.8 n) tokens in a partner. Each rare token in the prefix
   is a signature of its own and can be lost once; frequent tokens are cut into hash classes, and within a class all pairs are
   signatures: a class with m tokens loses its last pair with its (m-1)th token. The prefix is extended until more than t
   losses are needed to lose every signature, so linked sets share one. The number of classes follows the set size
   (in bands of a factor 4; a set is indexed in each band that a partner can have), so pairs stay in proportion to the set.
4. Candidates. The classes of a signature are compared in blocks of bounded size by bitmaps, in which two sets that link differ in
   few bits. A signature only gives the pairs that connect what is near (a forest, so a group of near copies does not list all its pairs).
5. Verification compares the whole sets, made again from the whole texts. All that may link is connected by the pairs, so a group of connected classes
   that fits a task (``DENSE`` classes) is sent there, each text once, and settled exactly; only the label of each class leaves it. In larger groups the pairs are
   tried by longer bitmaps and then verified, first one per class; then the classes are compared by signature once more, now between the groups that links leave apart.
   Components over pairs and links are found by alternating stars.

Edge cases: a null text has no words; a text with less than five words is one shingle; a set without shingles links with nothing,
not even its equal; repeated rows are one class; a null id is ignored in the smallest id of a component, and a component of nulls only is null;
an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from creditlens.llm.components import components
from creditlens.llm.text import Words, chunks, mixed, unused, window_hashes, with_row_key
from creditlens.session import write_stage

SHINGLE = 5
PERCENT = 80
RARITY = 2_000
REPORT_BYTES = 16_000_000
LEAST_BITS = 2_048
BLOCK = 2_000
# Members of a signature for each bin that its unit may be dealt to.
BIN = 64
# Classes and bytes of text of a group of candidates that one task settles.
DENSE = 2_000
DENSE_BYTES = 8_000_000
SPOTS = 1 << 20
# Bits a token of the bitmaps that pairs in large groups are tried by before texts are sent.
FINE_BITS = 8
KEY = ["row_file", "row_no"]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z)."""
    words = Words([t.lower() for t in texts])
    hashes = words.hashes()
    windows = window_hashes(hashes, SHINGLE)
    out = []
    for first, count in zip(words.first[:-1].tolist(), words.count.tolist()):
        if count >= SHINGLE:
            out.append(np.unique(windows[first : first + count - SHINGLE + 1]))
        elif count:
            out.append(window_hashes(hashes[first : first + count], count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> bytes:
    """128 bits over a sorted set."""
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    sums = [mixed(tokens + mixed(place * np.uint64(k))).sum(dtype=np.uint64, keepdims=True) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return mixed(np.concatenate(sums) + np.uint64(len(tokens))).astype(">u8").tobytes()


def parity_bits(tokens: np.ndarray, bits: int = 2) -> bytes:
    """A bitmap of at least ``bits`` bits a token, each of which flips one. Two of them differ in no more bits than their sets differ in tokens."""
    size = max(LEAST_BITS, 1 << max(0, bits * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of ``size`` bytes of the same set; ``size`` divides the length by a power of two."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "big") ^ int.from_bytes(bits[half:], "big")).to_bytes(half, "big")
    return bits


def _short(ids: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(x[:8], "big", signed=True) for x in ids], np.int64)


def allowed_losses(n: int) -> int:
    return n - (PERCENT * n + 99) // 100


def _band(n: int) -> int:
    """The j with 4**j <= n < 4**(j+1)."""
    return (n.bit_length() - 1) // 2


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set; ``frequent`` flags its tokens."""
    need = allowed_losses(len(tokens)) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need]
    common = tokens[frequent]
    out = [rare]
    least, most = (PERCENT * len(tokens) + 99) // 100, 100 * len(tokens) // PERCENT
    for band in range(_band(max(least, 1)), _band(max(most, 1)) + 1):
        group = common % np.uint64(max(1, 4**band // 10))
        first = np.zeros(len(common), bool)
        first[np.unique(group, return_index=True)[1]] = True
        enough = np.flatnonzero(len(rare) + np.cumsum(~first) >= need)
        size = enough[0] + 1 if len(enough) else len(common)
        order = np.argsort(group[:size], kind="stable")
        ranked, own = group[:size][order], common[:size][order]
        bounds = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])) if size else []
        pairs = [p for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1 for p in combinations(own[a:b].tolist(), 2)]
        if pairs:
            pairs = np.array(pairs, np.uint64)
            out.append(mixed(mixed(pairs[:, 0] + np.uint64(band + 1)) ^ pairs[:, 1]))
    return np.concatenate(out)


def _batches(part: pa.RecordBatch, limit: int):
    values = part.column("text")
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
    for start, stop in chunks(sizes, limit):
        yield start, values.slice(start, stop - start).to_pylist()


def _sets_of(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for start, stop in chunks(np.array([len(t) for t in texts])):
        out += shingle_sets(texts[start:stop])
    return out


def _describe(rarity: int):
    """Class and size of each document; with the first document of a batch the shingles that the batch holds often."""

    def run(parts):
        for part in parts:
            for at, texts in _batches(part, REPORT_BYTES):
                sets = _sets_of(texts)
                tokens, count = np.unique(np.concatenate(sets), return_counts=True)
                often = count >= max(2, -(-len(texts) // rarity))
                report = [None] * len(texts)
                report[0] = [{"token": t, "n": n} for t, n in zip(tokens[often].view(np.int64).tolist(), count[often].tolist())]
                ids = [set_id(s) for s in sets]
                bits = [parity_bits(s) for s in sets]
                rows = part.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in (*KEY, "doc_id")), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.binary()), pa.array(report, pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))),
                    ],
                    [*KEY, "doc_id", "bytes", "n_shingles", "set_id", "bits", "often"],
                )

    return run


def _index(frequent):
    def run(parts):
        known = frequent.value
        for part in parts:
            for _, texts in _batches(part, 2_000_000):
                # Equal sets of a batch are one row per signature.
                sets = list({set_id(s): s for s in shingle_sets(texts) if len(s)}.values())
                signs, owner = [], []
                for s in sets:
                    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    own = signatures(s, known[at] == s if len(known) else np.zeros(len(s), bool))
                    signs.append(own)
                    owner.append(len(own))
                if signs:
                    ids = _short([set_id(s) for s in sets])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(signs).view(np.int64)), pa.array(np.repeat(ids, owner))], ["sign", "short"],
                    )

    return run


def _verify(parts):
    """Pairs of texts that link."""
    left_text, left_set = None, None
    for part in parts:
        found = []
        a_texts, b_texts = part.column("a_text"), part.column("b_text")
        for start in range(0, part.num_rows, 200):
            rows = range(start, min(start + 200, part.num_rows))
            b_sets = shingle_sets([b_texts[i].as_py() for i in rows])
            for i, b_set in zip(rows, b_sets):
                text = a_texts[i].as_py()
                if text != left_text:
                    left_text, left_set = text, shingle_sets([text])[0]
                shared = len(np.intersect1d(left_set, b_set, assume_unique=True))
                found.append(100 * shared >= PERCENT * (len(left_set) + len(b_set) - shared))
        keep = pa.array(found, pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """Label of each set: the lowest place that links between these sets reach."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(n)])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    maps = [parity_bits(s) for s in sets]
    size = min(map(len, maps))
    bits = np.frombuffer(b"".join(folded(x, size) for x in maps), np.uint64).reshape(m, -1)
    label, mine = np.arange(m), np.zeros(len(distinct), bool)
    for i in range(m):
        near = np.flatnonzero(_near(bits, n, label, i, slice(i + 1, None))) + i + 1
        if not len(near):
            continue
        own = flat[start[i] : start[i + 1]]
        mine[own] = True
        if len(near) > 16:
            hits = np.add.reduceat(mine[flat[start[i + 1] :]], start[i + 1 : m] - start[i + 1], dtype=np.int64)
            shared = hits[near - i - 1]
        else:
            shared = np.array([mine[flat[start[j] : start[j + 1]]].sum() for j in near])
        mine[own] = False
        joined = label[near[100 * shared >= PERCENT * (n[i] + n[near] - shared)]]
        if len(joined):
            both = np.append(joined, label[i])
            label[np.isin(label, both)] = both.min()
    return label


def _label_groups(parts):
    """(node, component): set ids of the classes of each group of candidates, whose rows follow each other, with the one that stands for their links."""

    def labelled(rows):
        ids, texts = zip(*sorted(rows))
        label = _classes(_sets_of(list(texts)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([ids[k] for k in label], pa.binary())], ["node", "component"])

    key, rows = None, []
    for part in parts:
        for at in range(0, part.num_rows, 500):
            for row in zip(*(part.column(c).slice(at, 500).to_pylist() for c in ("component", "set_id", "text"))):
                if row[0] != key:
                    if rows:
                        yield labelled(rows)
                    key, rows = row[0], []
                rows.append(row[1:])
    if rows:
        yield labelled(rows)


def _near(bits: np.ndarray, n: np.ndarray, group: np.ndarray, i: int, to: slice) -> np.ndarray:
    """Flags of the members that may link with member i: other component, fitting sizes, bitmaps that are near enough."""
    differ = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
    # At 80 % two sets differ in no more than (200 - 160) / 180 of their sizes together.
    near = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[i] + n[to])
    return near & (group[to] != group[i]) & (100 * np.minimum(n[i], n[to]) >= PERCENT * np.maximum(n[i], n[to]))


def _unit_pairs(one_block: bool, rows: list[tuple], forest: bool) -> list[tuple[int, int]]:
    """Pairs of one unit of work that may link; with ``forest`` only as many as connect all that such pairs connect."""
    rows.sort()
    side, short, group, n, maps = zip(*rows)
    size = min(map(len, maps))
    if len(rows) == 2:
        if group[0] == group[1] or (not one_block and side[0] == side[1]):
            return []
        x, y = (int.from_bytes(folded(m, size), "big") for m in maps)
        near = (100 + PERCENT) * (x ^ y).bit_count() <= (100 - PERCENT) * (n[0] + n[1])
        return [(short[0], short[1])] if near and 100 * min(n) >= PERCENT * max(n) else []
    bits = np.frombuffer(b"".join(folded(m, size) for m in maps), np.uint64).reshape(len(rows), -1)
    n, group, label = np.array(n), np.array(group), np.arange(len(rows))
    second = side.index(1) if 1 in side else len(rows)
    found = []
    for i in range(len(rows) if one_block else second):
        start = i + 1 if one_block else second
        near = np.flatnonzero(_near(bits, n, group, i, slice(start, None))) + start
        if forest and len(near):
            new, first = np.unique(label[near], return_index=True)
            near = near[first[new != label[i]]]
            label[np.isin(label, new)] = label[i]
        found += [(short[i], short[j]) for j in near.tolist()]
    return found


def _compare_units(forest: bool):
    """Candidate pairs of all units; a unit's rows follow each other."""

    def batch(found):
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    def run(parts):
        key, rows, found = None, [], []
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("sign", "low", "high", "side", "short", "group", "n", "bits")]
            for sign, low, high, *row in zip(*columns):
                if (sign, low, high) != key:
                    if len(rows) > 1:
                        found += _unit_pairs(key[1] == key[2], rows, forest)
                    key, rows = (sign, low, high), []
                rows.append(tuple(row))
            if len(found) > 1_000:
                yield batch(found)
                found = []
        if len(rows) > 1:
            found += _unit_pairs(key[1] == key[2], rows, forest)
        if found:
            yield batch(found)

    return run


def _candidates(members: DataFrame, maps: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of the classes of each signature that may link, from ``members`` (sign, short, group) and ``maps`` (short, n, bits).

    Only signatures between different groups matter. A large one is cut into blocks by hash and a unit of work compares two blocks, so each
    member is sent once per block. The bitmaps join in last, so they are shuffled once. Near copies meet in many units: those with the same
    smallest class go to the same few bins, more of them the more members they have. There the rows of a class follow each other as they are
    sent, in the order of the join, so that its bitmap is compressed to one copy a bin and not sent anew for each unit.
    """
    mixed_signs = (
        members.groupBy("sign").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("short").alias("first"), F.count("*").alias("members"))
        .filter("low != high").select(
            "sign", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
            F.xxhash64("first", F.pmod(F.xxhash64("sign"), F.ceil(F.col("members") / BIN))).alias("bin"),
        )
    )
    units = (
        members.join(write_stage(mixed_signs, "open"), "sign")
        .withColumn("own", F.pmod(F.xxhash64("short", "sign"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bin", "sign", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "short", "group",
        )
        .join(maps, "short")
        .repartition("bin", "low", "high").sortWithinPartitions("sign", "low", "high")
    )
    return write_stage(units.mapInArrow(_compare_units(forest), "a long, b long").distinct(), "pairs")


def _texts_of(places: DataFrame, rows: DataFrame) -> DataFrame:
    """``places`` (row key, short, set id, component) of one document of each class, with the text."""
    spot = F.pmod(F.xxhash64(*KEY), F.lit(SPOTS)).cast("int")
    # Most texts are in no group: a bitmap of fixed size keeps them from the shuffle, and what it lets through by chance ends in the join.
    wanted = np.zeros(SPOTS, bool)
    wanted[[r.spot for r in places.select(spot.alias("spot")).distinct().collect()]] = True
    flags = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(parts):
        known = np.unpackbits(flags.value).view(bool)
        for part in parts:
            yield part.filter(pa.array(known[part.column("spot").to_numpy()]))

    asked = rows.select(*KEY, "text", spot.alias("spot")).mapInArrow(run, "row_file long, row_no long, text binary, spot int")
    return places.join(asked.drop("spot"), KEY).select("short", "set_id", "component", "text")


def _fine_maps(parts):
    """(short, n, bits, fine) of each text: size, bitmap and long bitmap of its set."""
    for part in parts:
        for at, texts in _batches(part, 2_000_000):
            sets = _sets_of(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("short").slice(at, len(texts)), pa.array([len(x) for x in sets], pa.int64()),
                    *(pa.array(maps, pa.binary()) for maps in ([parity_bits(x) for x in sets], [parity_bits(x, FINE_BITS) for x in sets])),
                ],
                ["short", "n", "bits", "fine"],
            )


def _near_by_fine_maps(parts):
    """The pairs whose long bitmaps allow a link."""
    for part in parts:
        keep = []
        for a_n, b_n, a_fine, b_fine in zip(*(part.column(c).to_pylist() for c in ("a_n", "b_n", "a_fine", "b_fine"))):
            size = min(len(a_fine), len(b_fine))
            x, y = (int.from_bytes(folded(m, size), "big") for m in (a_fine, b_fine))
            keep.append((100 + PERCENT) * (x ^ y).bit_count() <= (100 - PERCENT) * (a_n + b_n))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs (a, b of short ids) that link, as pairs of set ids."""
    # The texts of pairs that only nearly link would be most of what is sent; the long bitmaps of ``fine`` (short, n, fine) rule them out first.
    for side in ("a", "b"):
        pairs = pairs.join(fine.select(F.col("short").alias(side), F.col("n").alias(f"{side}_n"), F.col("fine").alias(f"{side}_fine")), side)
    pairs = write_stage(pairs.mapInArrow(_near_by_fine_maps, "a long, b long"), "pairs")
    # Only texts that are in a pair are sent.
    of = lambda side: texts.join(pairs.select(F.col(side).alias("short")).distinct(), "short", "left_semi")
    b_side = pairs.join(of("b").select(F.col("short").alias("b"), F.col("set_id").alias("b_id"), F.col("text").alias("b_text")), "b")
    both = b_side.join(of("a").select(F.col("short").alias("a"), F.col("set_id").alias("a_id"), F.col("text").alias("a_text")), "a")
    ready = both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_text", "b_text")
    return write_stage(ready.mapInArrow(_verify, "a binary, b binary"), "links")


def _settle(pairs: DataFrame, texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, component) of the classes of ``texts``, whose groups of candidates are too large for a task."""

    def placed(links):
        """(short, group) after these links."""
        groups = write_stage(components(links), "groups")
        near = texts.select("short", "set_id").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
        return near.select("short", F.xxhash64(F.coalesce("component", "set_id")).alias("group"))

    fine = write_stage(texts.select("short", "text").mapInArrow(_fine_maps, "short long, n long, bits binary, fine binary"), "fine")
    pairs = pairs.join(texts.select(F.col("short").alias("a")), "a", "left_semi")
    # One pair per class connects most of what links; of the others only those between groups that are still apart matter.
    one = write_stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    first = _linked(one, texts, fine)
    group = placed(first)
    apart = pairs.join(one, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        apart = apart.join(group.select(F.col("short").alias(side), F.col("group").alias(f"{side}_group")), side)
    links = first.unionByName(_linked(write_stage(apart.filter("a_group != b_group").select("a", "b"), "pairs"), texts, fine))

    # Then the classes of each signature are compared once more, across the groups found.
    members = write_stage(shared.join(placed(links), "short"), "members")
    links = links.unionByName(_linked(_candidates(members, fine.select("short", "n", "bits"), forest=False), texts, fine))
    return components(links)


def _bytes(text: str):
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def join(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """(row_file, row_no, doc_id, n_shingles, component_id) of each row of ``docs``."""
    return _join(with_row_key(docs.select(F.col(row_id).alias("doc_id"), _bytes(text))), **options)


def _join(rows: DataFrame, rarity: int = RARITY, dense: int = DENSE) -> DataFrame:
    spark = rows.sparkSession
    sets = write_stage(
        rows.mapInArrow(_describe(rarity), "row_file long, row_no long, doc_id long, bytes long, n_shingles long, set_id binary, bits binary, often array<struct<token:bigint,n:bigint>>"),
        "sets",
    )
    least = sets.count() / (2 * rarity)
    often = sets.select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.n").alias("n")).filter((F.col("n") >= least) & (F.col("n") > 8))
    frequent = np.sort(np.array([r.token for r in often.select("token").collect()], np.int64).view(np.uint64))

    members = sets.filter("n_shingles > 0").withColumn("short", F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("long"))
    classes = write_stage(
        members.groupBy("set_id", "short", "n_shingles")
        .agg(F.min(F.struct(*KEY, "bytes")).alias("place"), F.min("doc_id").alias("smallest"), F.min("bits").alias("bits"))
        .select("set_id", "short", "n_shingles", "place.*", "smallest", "bits"), "classes",
    )
    # A signature of one class finds nothing; only shared ones are kept. All are sent once, as they are made, and never written.
    index = rows.select("text").mapInArrow(_index(spark.sparkContext.broadcast(frequent)), "sign long, short long")
    ends = [F.min("short").over(W.partitionBy("sign")).alias("least"), F.max("short").over(W.partitionBy("sign")).alias("most")]
    shared = write_stage(index.select("*", *ends).filter("least != most").select("sign", "short").distinct(), "shared")
    # Signatures of the very same classes say the same, and near copies share many; one of them is enough (by the number of classes and 128 bits over them).
    marks = [F.bit_xor(F.xxhash64("short", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    alike = shared.groupBy("sign").agg(F.count("*").alias("members"), *marks)
    alike = alike.filter("members > 1")
    shared = write_stage(shared.join(alike.groupBy("members", "mark_1", "mark_2").agg(F.min("sign").alias("sign")).select("sign"), "sign", "left_semi"), "shared")

    # First every class is a group of its own.
    maps = classes.select("short", F.col("n_shingles").alias("n"), "bits")
    pairs = _candidates(shared.withColumn("group", F.col("short")), maps, forest=True)

    # What may link at all is connected by these pairs. A group of candidates that fits a task is settled there, each text sent once.
    grouped = components(pairs).withColumnRenamed("node", "short")
    places = write_stage(classes.join(grouped, "short").select(*KEY, "short", "set_id", "component", "bytes"), "places")
    size = places.groupBy("component").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    crowded = write_stage(size.filter((F.col("members") > dense) | (F.col("bytes") > DENSE_BYTES)).select("component"), "crowded")
    fitting = _texts_of(places.join(crowded, "component", "left_anti"), rows).select("component", "set_id", "text")
    fitting = fitting.repartition("component").sortWithinPartitions("component")
    groups = write_stage(fitting.mapInArrow(_label_groups, "node binary, component binary"), "groups")
    if not crowded.isEmpty():
        held = _texts_of(places.join(crowded, "component", "left_semi"), rows)
        groups = groups.unionByName(_settle(pairs, write_stage(held.select("short", "set_id", "text"), "crowded-texts"), shared))

    labels = classes.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = labels.groupBy("component").agg(F.min("smallest").alias("component_id"))
    # Written, so that a frequent set meets a plain table and adaptive execution can split its documents.
    labels = write_stage(labels.select("set_id", "component").join(smallest, "component").select("set_id", "component_id"), "labels")
    return sets.join(labels, "set_id", "left").select(
        *KEY, "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with its smallest id; of rows with equal ids the first one."""
    own = [unused("component_file", docs.columns), unused("component_row", docs.columns)]
    keyed = with_row_key(docs, *own)
    found = _join(keyed.select(*[F.col(o).alias(k) for o, k in zip(own, KEY)], F.col(row_id).alias("doc_id"), _bytes(text)), **options)
    grouped = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min_by(F.struct(*KEY), F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("place"))
    kept = grouped.select("place.*").unionByName(found.filter("n_shingles = 0").select(*KEY))
    return keyed.join(kept.withColumnsRenamed(dict(zip(KEY, own))), own, "left_semi").select(*docs.columns)
