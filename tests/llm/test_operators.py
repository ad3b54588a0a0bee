"""Each operator against a brute-force version, on fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablescope.llm import census, chat_threads, common, decontaminate, exact_dedup, html_extract, mixing, simhash_dedup, substring_dedup, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, white space of all kinds, non-ASCII, a null, an empty and a long text."""
    rng, words = random.Random(7), vocabulary()
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        out.append("  ".join(own) if i % 7 == 0 else " ".join(own))
    out += [out[1], out[1], out[2], out[2] + " tail", out[3].upper(), None, "", "   ", "é ñ x\tß\n" * 40, out[8] * 3]
    out.append(" ".join(rng.choice(words) for _ in range(20_000)))
    edited = out[4].split()
    edited[len(edited) // 2] = "changed"
    out.append(" ".join(edited))
    return [(7 * i % 101 + 1000 * (i >= 101), t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pack_keeps_keys():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (census.unpack(census.pack(keys)) == keys).all()


def test_buckets_grow_with_the_keys():
    """What a bucket holds is bounded at every size, and rows grow in proportion to the keys."""
    for tb in (1e-3, 0.03, 1, 100):
        total = int(tb * 1e12)
        pieces = max(1, -(-total // census.PIECE_BYTES))
        b = census.Buckets.of(total // 6, pieces)
        assert total // 6 / (b.coarse * b.fine) <= census.BUCKET_KEYS
        assert total // 6 / (b.coarse * -(-pieces // b.run)) <= 1.01 * census.BUCKET_KEYS
        assert pieces * b.coarse <= total / 6 / census.LEAST_KEYS + pieces


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_repeats_through_coarse_and_fine_buckets(docs, rows, operator, monkeypatch):
    monkeypatch.setattr(census, "BUCKET_KEYS", 300)
    monkeypatch.setattr(census, "LEAST_KEYS", 200)
    seen = []
    of = census.Buckets.of
    monkeypatch.setattr(census.Buckets, "of", lambda keys, pieces: seen.append(of(keys, pieces)) or seen[-1])
    got = {r.doc_id: r.n_removed for r in operator.remove_repeats(docs, piece_bytes=9000).collect()}
    assert got == {d: v[1] for d, v in operator.brute_force(rows).items()}
    assert seen[0].fine > 1


def test_second_hashes_tell_equal_keys_apart():
    of, of_extra = np.array([5, 5, 5, 9], np.uint64), np.array([1, 3, 7, 2], np.uint32)
    got = census.member(np.array([5, 5, 5, 9, 9, 4], np.uint64), of, np.array([7, 2, 1, 2, 3, 1], np.uint32), of_extra)
    assert got.tolist() == [True, False, True, True, False, False]


def test_rolling_hash_is_a_function_of_the_window():
    x = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64)
    x[70_000:70_050] = x[10:60]
    r = census.Roller(35)
    h = np.concatenate([r.hashes(x[a : b + 34]) for a, b in r.segments(len(x))])
    assert h[10] == h[70_000] and h[24] == h[70_014] and len(np.unique(h)) == len(h) - 16


@pytest.mark.parametrize("piece_bytes", [census.PIECE_BYTES, 3000])
def test_substring_dedup(docs, rows, piece_bytes):
    found = substring_dedup.remove_repeats(docs, piece_bytes=piece_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found}
    assert got == substring_dedup.brute_force(rows)
    assert sum(n for _, n, _ in got.values()) > 500
    for r in found:
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_removed


def test_substring_dedup_of_repeated_ids(spark):
    text = " ".join(vocabulary(50))
    d = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(d).collect()) == [(0, 50), (1, 50), (1, 50), (2, 0)]
    clash = d.withColumns({"row": F.lit(1), "piece": F.lit("x"), "keys": F.lit(None)})
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(clash, piece_bytes=200).collect()) == [(0, 50), (1, 50), (1, 50), (2, 0)]


@pytest.mark.parametrize("piece_bytes", [census.PIECE_BYTES, 3000])
def test_suffix_dedup(docs, rows, piece_bytes):
    found = suffix_dedup.remove_repeats(docs, piece_bytes=piece_bytes).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found}
    assert got == suffix_dedup.brute_force(rows)
    assert sum(x[1] for x in got.values()) > 1000


def test_suffix_dedup_inside_one_document_and_of_repeated_ids(spark):
    text = "".join(vocabulary(40))
    d = spark.createDataFrame([(1, text + text), (5, text), (5, text), (None, text), (6, text)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(d).collect())
    n = len(text.encode())
    # The null comes first and keeps its text; what follows is covered but for the seam of the doubled text.
    assert found[0] == (0, 0) and found[2:] == [(5, n), (5, n), (6, n)] and found[1] == (1, 2 * n)
    clash = d.withColumns({"row": F.lit(1), "piece": F.lit("x"), "phase": F.lit(None)})
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(clash, piece_bytes=300).collect()) == found


def test_difference_cover_has_every_shift():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("hot_rows", [exact_dedup.HOT_ROWS, 1])
@pytest.mark.parametrize("batches", [None, ["doc_id < 30", "doc_id between 30 and 60", "doc_id > 60"]])
def test_exact_dedup(spark, docs, rows, batches, hot_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.judged(docs, batches, exact_dedup.DigestIndex(spark, buckets=4)).collect()}
    assert got == {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


def test_digest_index_takes_only_new_texts(spark):
    first = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, None, 0)], "doc_id long, text string, keep_id int")
    index = exact_dedup.DigestIndex(spark, buckets=2)
    assert {r.doc_id for r in exact_dedup.deduplicated(first, index).collect()} == {2, 3}
    second = spark.createDataFrame([(4, "a", 0), (5, "b", 0), (6, "", 0), (5, "b", 0)], "doc_id long, text string, keep_id int")
    assert [r.doc_id for r in exact_dedup.deduplicated(second, index).collect()] == [5]
    assert index.groups().count() == 3 and {r.group_size for r in index.groups().collect()} == {2, 3}


def test_exact_dedup_keeps_columns_whatever_their_names(spark, none):
    d = spark.createDataFrame([(1, "a", 5, "x", 1), (2, "a", 6, "y", 2), (2, "a", 6, "y", 2), (2, "a", 7, "z", 3), (None, "b", 8, "w", 4)], "doc_id long, text string, sha int, keep string, _digest int")
    out = exact_dedup.deduplicated(d)
    assert out.columns == d.columns
    first, second = (sorted(map(tuple, exact_dedup.deduplicated(x).collect()), key=repr) for x in (d, d.repartition(3)))
    assert first == second and len(first) == 2 and first[1] == (None, "b", 8, "w", 4) and first[0][:2] == (2, "a")
    assert exact_dedup.judged(none).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows_and_tells_texts_of_one_id_apart(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.deduplicated(d).collect()) == [(0, "c"), (1, "a"), (2, "b")]


def brute_benchmark(rows, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def test_decontamination(spark, docs, rows):
    items = [(1, rows[0][1][:200]), (2, "changed"), (3, None), (10, rows[5][1]), (11, "É ñ-x? ß"), (12, "never seen anywhere"), (1, rows[0][1][:200]), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.judged(docs, bench).collect()}
    want = brute_benchmark(rows, items)
    assert got == want and sum(x[3] for x in want.values()) >= 3


def test_decontamination_of_repeated_and_null_ids(spark):
    """Rows are told apart by themselves: of two rows of one doc_id, or of none, only the one with the passage is hit."""
    item = "one two three four five six seven eight nine ten eleven"
    data = [(1, item), (1, "hello there"), (None, "x " + item + " y"), (None, None), (2, item), (2, item), (3, ""), (4, "solo"), (5, "nine ten")]
    d = spark.createDataFrame([(i, t, "k", 7) for i, t in data], "doc_id long, text string, key string, hit int")
    bench = spark.createDataFrame([(8, item), (9, "solo"), (None, "ten nine")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.judged(d, bench).collect())
    assert got == sorted([(1, 11, 11, ["8"]), (1, 2, 0, []), (0, 13, 11, ["8"]), (0, 0, 0, []), (2, 11, 11, ["8"]), (2, 11, 11, ["8"]), (3, 0, 0, []), (4, 1, 1, ["9"]), (5, 2, 0, [])])
    left = decontaminate.without_matches(d, bench)
    assert left.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "hello there"), (3, ""), (5, "nine ten")]
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.length) for r in decontaminate.matches(d, bench).collect())[0] == (0, "8", 1, 10)
    assert decontaminate.without_matches(d.limit(0), bench).count() == 0 and decontaminate.without_matches(d, bench.limit(0)).count() == len(data)


def test_decontamination_proximity_and_empty_tables(spark, docs, none):
    d = spark.createDataFrame([(1, "a b c x d e f y g h i j"), (2, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "a b c d e f g h i j")], "item_id string, text string")
    assert decontaminate.matches(d, bench).count() == 0
    assert {(r.doc_id, r.item_id, r.found) for r in decontaminate.proximity(d, bench).collect()} == {(1, "q", 1.0)}
    assert decontaminate.judged(docs, none.select(F.col("doc_id").alias("item_id"), "text")).where("contaminated").count() == 0
    assert decontaminate.judged(none, bench).count() == 0


def test_decontamination_proximity_finds_windows_without_their_rarest_terms(spark):
    texts = ["a b c d e f g h i z", "a b c d e f g h y z", "a b c d e f g x y z", "q a b c", "j", "i h"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # The last term of the second item occurs nowhere, and of the first only far from the rest.
    bench = spark.createDataFrame([("p", "a b c d e f g h i j"), ("q", "a b c d e f g h i nowhere")], "item_id string, text string")
    got = {(r.doc_id, r.item_id, round(r.found, 3)) for r in decontaminate.proximity(d, bench).collect()}
    assert got == {(doc, item, found) for item in "pq" for doc, found in ((0, 0.9), (1, 0.8))}


def simhash(text, k=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(docs, rows):
    fp = {d: simhash(t) for d, t in rows}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    label = components(fp, near)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {d: (fp[d], label[d]) for d in fp} and len(near) > 5


@pytest.mark.parametrize("split_at", [simhash_dedup.SPLIT_AT, 20])
def test_gray_index_links_what_brute_force_links(spark, split_at):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)], *[np.repeat(base[:1], 60) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)]]))
    near = [(int(a), int(b)) for a in fp for b in fp[fp > a] if (int(a) ^ int(b)).bit_count() <= 2]
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash_dedup.links(table, 2, split_at).collect()]
    assert set(got) <= {p for a, b in near for p in ((a, b), (b, a))} or split_at < 1000
    ids = [int(x) for x in fp]
    assert components(ids, near) == components(ids, got)


def test_gray_rank_orders_the_reflected_code():
    code = np.arange(1024, dtype=np.uint64) ^ (np.arange(1024, dtype=np.uint64) >> np.uint64(1))
    assert (simhash_dedup.gray_rank(code) == np.arange(1024)).all()


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_similar_groups_find_edits_and_leave_others(spark):
    rng, words = random.Random(5), vocabulary(3000, 2)
    base = [[rng.choice(words) for _ in range(300)] for _ in range(40)]
    data = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(10):
        edited = list(base[i])
        for at in rng.sample(range(300), 2):
            edited[at] = "edited"
        data.append((100 + i, " ".join(edited)))
    data += [(500, None), (501, ""), (502, "short text")]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("component_id", F.lit(3))
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(d).where("doc_id <> component_id").collect()}
    assert {k: v for k, v in got.items() if k < 500} == {100 + i: i for i in range(10)}


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_groups_confirm_each_link(spark):
    """Copies on both sides of 0.8, and copies whose smallest id is a stranger: only true links count."""
    rng, words = random.Random(9), vocabulary(3000, 2)
    data = {}
    for i in range(40):
        base = [rng.choice(words) for _ in range(300)]
        data[10 * i + 1] = " ".join(base)
        # Single edits each change five shingles of 296: of 6 or fewer J is above 0.8, of 8 it is about 0.76.
        for j, edits in ((2, 6), (3, 8)):
            edited = list(base)
            for at in range(20, 20 + 30 * edits, 30):
                edited[at] = f"edit{j}"
            data[10 * i + j] = " ".join(edited)
    d = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    near = lambda a, b: jaccard(data[a], data[b]) >= 0.8
    want = {10 * i + 2: 10 * i + 1 for i in range(40)}
    assert all(near(a, b) and not near(a + 1, a) and not near(a + 1, b) for a, b in want.items())
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(d).where("doc_id <> component_id").collect()}
    assert not got.keys() - want.keys() and all(got[i] == want[i] for i in got) and len(got) >= 36
    # The same with the odd copy as the smallest id, which every candidate link of a key's leader then meets first.
    swapped = d.withColumn("doc_id", F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") - 3).otherwise(F.col("doc_id")))
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(swapped).where("doc_id <> component_id").collect()}
    assert not got.keys() - want.keys() and all(got[i] == want[i] for i in got) and len(got) >= 36


def test_similar_groups_find_every_shape_of_edit(spark):
    """Appended, replaced and scattered edits just above 0.8, by true five-word Jaccard, as if in any corpus."""
    rng, words = random.Random(3), vocabulary(3000, 2)
    some = lambda n: [rng.choice(words) for _ in range(n)]
    data = {}
    for i in range(120):
        base = some(400)
        data[i] = " ".join(base)
        edited = base + some(95) if i % 3 == 0 else base[:150] + some(38) + base[188:] if i % 3 == 1 else [w if j % 47 else "edit" for j, w in enumerate(base)]
        data[1000 + i] = " ".join(edited)
    assert all(0.8 <= jaccard(data[i], data[1000 + i]) < 0.83 for i in range(120))
    d = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(d).where("doc_id <> component_id").collect()}
    assert got == {1000 + i: i for i in range(120)}


def test_similar_groups_do_not_count_repeats(spark):
    """One line repeated in texts that are otherwise all different does not make them alike."""
    rng, words = random.Random(4), vocabulary(3000, 2)
    line = [rng.choice(words) for _ in range(10)]
    data = [(i, " ".join(line * 40 + [rng.choice(words) for _ in range(400)])) for i in range(20)]
    assert max(jaccard(a, b) for i, (_, a) in enumerate(data) for _, b in data[:i]) < 0.1
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert simhash_dedup.similar_groups(d).count() == 0


def test_near_copies_of_repeated_and_null_ids(spark, none):
    """No unlike row goes with a copy that shares its doc_id, and a row without doc_id is compared like others."""
    rng, words = random.Random(8), vocabulary(2000, 3)
    long = [rng.choice(words) for _ in range(200)]
    near = " ".join(long[:100] + ["edit"] + long[101:])
    data = [(1, " ".join(long)), (None, near), (3, near + " end"), (3, "something quite different here"), (None, "alone without number"), (5, ""), (4, None), (7, "Two Words"), (7, "two words"), (None, "word " * 20_000)]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in data], "doc_id long, text string, row string, root int")
    out = simhash_dedup.without_near_copies(d)
    assert out.columns == d.columns
    got = sorted((r.doc_id or 0, len(r.text or "")) for r in out.collect())
    assert got == sorted([(1, len(" ".join(long))), (3, 30), (0, 20), (4, 0), (7, 9), (0, 100_000)])
    assert simhash_dedup.without_near_copies(none).count() == 0


@pytest.mark.parametrize("words_", [1, 8])
def test_gray_tree_finds_all_pairs(words_):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (60, words_), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (600, words_)).astype(np.uint64)
    fp = np.concatenate([base, base[rng.integers(0, 60, 600)] ^ flips])
    fp = fp[simhash_dedup.gray_order(fp)]
    size = words_ * rng.integers(1, 3, len(fp))
    tree = simhash_dedup.GrayTree(fp)
    most = tree.largest(size)
    got = {(int(a), int(b)) for i, j in tree.near(lambda level, a, b: most[level][a] + most[level][b]) for a, b in zip(i, j, strict=True)}
    apart = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=np.int64)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= size[:, None] + size[None]), strict=True) if a < b}
    assert got == want and len(want) > 500
    if words_ == 1:
        assert (np.diff(simhash_dedup.gray_rank(fp[:, 0]).astype(object)) >= 0).all()


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (40, 40), (70, 60), (1000, 900), (3000, 1)):
        a, b = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((b, a[: n // 2])))
        apart = simhash_dedup.differing([simhash_dedup.parity_map(a)], [simhash_dedup.parity_map(b)])[0]
        assert apart <= len(np.setxor1d(a, b))
        assert (simhash_dedup.folded([simhash_dedup.parity_map(a)], 8) == simhash_dedup.folded([simhash_dedup.folded([simhash_dedup.parity_map(a)], 8).tobytes()], 8)).all()


def test_similar_groups_of_one_hot_shingle(spark):
    """Texts of all lengths that share their rarest shingle, a few of them near copies: the tree finds what brute force finds."""
    rng, words = random.Random(12), vocabulary(60, 5)
    data = {}
    for i in range(120):
        own = [rng.choice(words) for _ in range(rng.choice([6, 20, 70, 200, 1500]))]
        data[i] = " ".join(["rare", "beginning", "of", "all", "texts", *own])
        if i % 3 == 0:
            edited = [w if rng.random() > 0.025 else "edit" for w in own]
            data[1000 + i] = " ".join(["rare", "beginning", "of", "all", "texts", *edited])
    near = [(a, b) for a in data for b in data if a < b and jaccard(data[a], data[b]) >= 0.8]
    want = {i: r for i, r in components(data, near).items() if i != r}
    d = spark.createDataFrame(list(data.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(d).where("doc_id <> component_id").collect()}
    assert got == want and 10 < len(want) < 40


def test_mixing(spark, docs, rows):
    out = mixing.mixed(docs, shard_rows=5).collect()
    size = {}
    for i, (_, t) in enumerate(rows):
        s = None if i % 9 == 0 else f"s{i % 4}"
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(size.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] >= 3 * size[s]}
        for s in capped or free:
            target[s] = 3 * size[s] if capped else level * weight[s]
        left -= sum(target[s] for s in capped)
        free = free - capped if capped else set()
    taken = {}
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 16 * 8
    again = mixing.mixed(docs.repartition(2), shard_rows=5).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def seats_by_hand(votes, seats):
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda p: (votes[p] / (2 * out[p] + 1), [-ord(c) for c in p]))
        out[best] += 1
    return out


def test_mixing_matches_sql_with_null_and_repeated_ids(spark, rows, tmp_path):
    import duckdb

    from tablescope.llm.oracles import ORACLE_SQL

    data = [(None if i % 11 == 0 else d % 40, t, None if i % 9 == 0 else f"s{i % 7}") for i, (d, t) in enumerate(rows)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("place", F.lit("x")).withColumn("size", F.lit(1)).repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op8_source_mixing"]).fetchall(), key=repr)
    got = mixing.mixed(d).select("doc_id", "size", "source_size", "target", "taken").collect()
    rounded = lambda rs: sorted(((*r[:3], round(r[3], 6), r[4]) for r in rs), key=repr)
    assert rounded(got) == rounded(want)


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.randint(0, 1000), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v long, i long").repartition(5)
    got = {r.i: (r.place, r.before_v) for r in common.running(df, {"v": F.col("v").desc(), "i": F.col("i").asc()}, ("v",), ("g",)).collect()}
    want = {}
    for g in ("a", "b", None):
        total = 0
        for k, (_, v, i) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))):
            want[i], total = (k, total), total + v
    assert got == want


def test_sainte_lague_of_many_parties_off_by_many(spark):
    """Nearly equal parties, whose shares all round the same way, and one that holds a third of the votes."""
    for n, seats in ((60, 89), (60, 91), (41, 20), (41, 21)):
        votes = {f"p{i:02}": 1000.0 + i for i in range(n)} | {"hot": 500.0 * n}
        p = spark.createDataFrame([(1, k, v) for k, v in votes.items()], "g int, p string, v double")
        got = {r.p: r.quota for r in mixing.apportioned(p, "v", F.lit(seats), ["g"], ["p"]).collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            want[min(votes, key=lambda x: (-votes[x] / (2 * want[x] + 1), x))] += 1
        assert got == want


@pytest.mark.parametrize("seats", [0, 1, 7, 100])
def test_sainte_lague(spark, seats):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.5, "e": 24.5}
    p = spark.createDataFrame([(1, k, v) for k, v in votes.items()], "g int, p string, v double")
    got = {r.p: r.quota for r in mixing.apportioned(p, "v", F.lit(seats), ["g"], ["p"]).collect()}
    assert got == seats_by_hand(votes, seats)


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://Example.ORG/es/1", "http://example.org/en/12?x", "https://a.example.org", "https://a.example.org/x", "ftp://b.com/fr/", "https://b.com/de/#a", "https://m.ads-track.example.net/en/5", "http://news.example.net/en/5", "http://notorg/", "http://x.org?/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[0][:3] == ("", "", None) and got[1][:3] == ("", "", None)
    assert got[2] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][:3] == ("a.example.org", "", None)
    assert got[5] == ("a.example.org", "/x", "org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10][2] is None and got[11][2] is None
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_model_needs_a_bounded_table():
    with pytest.raises(ValueError):
        url_filter.fitted([("a", "/", 0)] * (url_filter.MAX_LABELLED + 1))


def test_url_model_on_addresses_it_has_not_seen():
    """Half of the addresses of each word train; the others, on other hosts and paths, are judged."""
    rows = list(url_filter.LABELLED)
    weights = url_filter.fitted(rows[::2])
    p = url_filter.probabilities(weights, [h for h, _, _ in rows[1::2]], [q for _, q, _ in rows[1::2]])
    y = np.array([label for _, _, label in rows[1::2]])
    said = p >= url_filter.THRESHOLD
    hit = said & (y == 1)
    assert hit.sum() / max(1, said.sum()) >= 0.9 and hit.sum() / y.sum() >= 0.8


def test_url_rules_match_sql(spark):
    import duckdb

    urls = [f"{scheme}{host}{path}" for scheme in ("http://", "HTTPS://", "") for host in ("example.org", "A.Example.org", "x.com", "com", "notcom", "a.b.org", "de") for path in ("", "/", "/es/1?x", "/en/12", "/en/2", "/fr/", "/FR/", "/de/3#t", "?/de/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("probability", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judged(pages).collect()}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    con.execute("create table rules (rule varchar, verdict varchar)")
    con.executemany("insert into rules values (?, ?)", [list(r) for r in url_filter.RULES])
    sql = """WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    h AS (SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(regexp_replace(r, '^[^/?#]*', ''), '^[^?#]*') AS path FROM p),
    m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM h JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))))
    SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND k = 1"""
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}


BODY = "<p>First sentence, of some length, with marks. And another one, also long enough to read.</p><p>Short.</p><p>Third &amp; last paragraph, which has\n  enough text. It ends here.</p>"
TEXT = "First sentence, of some length, with marks. And another one, also long enough to read. Short. Third & last paragraph, which has enough text. It ends here."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><article>{BODY}</article><footer>&copy; 2024. All rights reserved.</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div id='sidebar'><p>Related, story. Read on.</p></div><div class='content'>{BODY}</div><div class='comments'><p>Great post, thanks. I liked it, a lot.</p></div></body>",
        f"<div class=ad>Buy now, cheap. Really.</div><main>{BODY}<aside>A box, with words.</aside><form><p>Your mail, please.</p></form></main><script>var x = '<p>no</p>';</script>",
        f"<div class='cookie-notice'>We use cookies. Accept, please.</div><style>p {{ a: b }}</style><!-- <p>hidden, text.</p> --><div>{BODY}</div>",
    ],
)
def test_html_extraction(page):
    assert html_extract.article(page) == TEXT


def test_html_extraction_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "a"), (2, "u", "", "b"), (3, None, "plain &lt;text&gt; here", "c"), (4, "u", "<p>open <b>bold<br>next<p>second", "d"), (4, "u", "<script>only", "e"), (5, "u", "<div>" * 300 + "deep" + "</div>" * 300, "f")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extracted(pages).collect()), key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "plain <text> here", 17), (4, "open bold next second", 21), (4, "", 0), (5, "deep", 4)], key=str)


def plain_page(rng, words):
    """A page whose elements have no telling names: menu, box, article and footer are divs; and the article's text."""
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    title, parts = some(5), [f"{some(rng.randint(20, 60))}, {some(8)}. {some(rng.randint(4, 30))}." for _ in range(rng.randint(3, 6))] + [some(2) + "."]
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words[:6])
    page = f"<html><body><div><ul>{menu}</ul></div><div>{some(10)}. {some(4)}.</div><div><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in parts)}</div><div>&copy; {some(3)}, {some(9)}.</div></body></html>"
    return page, " ".join([title, *parts])


def test_html_extraction_goes_by_tag_path_ratios(monkeypatch):
    """Without article elements and class names; with every path scored alike the method finds less."""
    rng, words = random.Random(21), vocabulary(300, 6)
    pages = [plain_page(rng, words) for _ in range(100)]
    right = sum(html_extract.article(p) == t for p, t in pages)
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: {n.path: 1.0 for n, _, _ in blocks})
    blind = sum(html_extract.article(p) == t for p, t in pages)
    assert right >= 95 and blind <= right - 30


def test_tag_path_ratios_match_a_plain_aggregation():
    rng = random.Random(3)
    for _ in range(20):
        page, _ = plain_page(rng, vocabulary(300, 6))
        blocks = html_extract.Page(page).blocks

        def path(node):
            return (path(node.parent) if node.parent else ()) + (node.tag,)

        groups = {}
        for node, text, links in blocks:
            groups.setdefault(path(node), []).append((len(text) - links, sum(c in ".,;:!?" for c in text)))
        order = list(groups)
        means = [[sum(x[i] for x in g) / len(g) for g in groups.values()] for i in (0, 1)]
        weigh = lambda i, j: np.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 2 else 0.0
        smooth = [[sum(weigh(i, j) * m[j] for j in range(len(order))) / sum(weigh(i, j) for j in range(len(order))) for i in range(len(order))] for m in means]
        want = {p: smooth[0][i] * (1 + smooth[1][i]) for i, p in enumerate(order)}
        scores = html_extract.path_scores(blocks)
        got = {path(node): scores[node.path] for node, _, _ in blocks}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 * max(1, want[p]) for p in want)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 40_000 + "x", "<div>x" * 20_000, '<a "' * 20_000, '<a "' * 20_001 + ">", "<ul>" + "<div>" * 10_000 + "<li>x</li>" * 10_000, "<div>" * 10_000 + "</p></section>" * 10_000, "<!" * 40_000, "<a" * 40_000, "<script>" * 20_000, "<!--" * 20_000, "<p>" * 40_000 + "x", "&amp;" * 100_000],
)
def test_html_extraction_of_long_and_broken_pages_is_linear(page):
    import time

    began = time.process_time()
    html_extract.article(page)
    assert time.process_time() - began < 4


def marginals_by_hand(e, chain):
    """All label sequences of a short chain."""
    import itertools

    total, one = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        # The first token's transition comes from either label alike.
        w = sum(np.exp(chain[i, y[0]]) for i in (0, 1)) * np.exp(sum(e[t] * y[t] for t in range(len(e))) + sum(chain[y[t - 1], y[t]] for t in range(1, len(e))))
        total += w
        one += w * np.array(y)
    return one / total


def test_marginals_are_those_of_the_whole_sequence(monkeypatch):
    rng = np.random.default_rng(0)
    chain = np.array([[0.4, -0.8], [-0.3, 0.9]])
    lengths = np.array([1, 0, 7, 10, 3])
    e = rng.normal(0, 2, lengths.sum())
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    p, moves = toxicity.chain_marginals(lengths, e, chain, count=True)
    at = 0
    for n in lengths:
        if n:
            assert np.allclose(p[at : at + n], marginals_by_hand(e[at : at + n], chain), atol=1e-6)
        at += n
    assert abs(moves.sum() - sum(sum(1 for t in range(n) if t % 4) for n in lengths)) < 1e-6


def test_toxicity_learns_words_and_beginnings(spark):
    rng, words = random.Random(3), vocabulary(500, 4)
    data, labels = [], []
    for i in range(240):
        own = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                own[rng.randrange(len(own))] = rng.choice(["horrid", "Horrid!", "vilexa", "vilexo", "vilexu"])
        data.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    data += [(900, None), (901, ""), (902, "x " * 30_000), (903, "a vilexzz thing")]
    labels += [(901, None), (5000, 1)]
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.fitted(d, marks)
    got = {r.doc_id: r for r in toxicity.scored(d, field).collect()}
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got.values())
    wrong = sum((got[i].score >= 0.3) != bool(t) for i, t in labels if t is not None and i < 900)
    assert wrong <= 2
    assert got[900].score == got[901].score == 0 and got[902].score < 0.1 < got[903].score
    spans = {r.doc_id: r.spans for r in toxicity.scored(d, field, 0.1).collect()}
    assert [(s.first, s.last) for s in spans[903]] == [(1, 1)]
    kept = toxicity.without_toxic(d, field)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_toxicity_of_conflicting_labels_and_of_labels_without_documents(spark, none):
    """A document with both labels is toxic, in any order of rows; labels that no document has don't take the places of others."""
    rng, words = random.Random(5), vocabulary(300, 8)
    data = [(i, " ".join([*(rng.choice(words) for _ in range(20)), "horrid" if i % 2 else "kind"])) for i in range(80)]
    labels = [(i, i % 2) for i in range(80)] + [(i, 0) for i in range(1, 80, 2)] + [(10_000 + i, i % 2) for i in range(400)]
    d, m = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fields = [toxicity.fitted(d.repartition(n), x, max_toxic=30, max_clean=30) for n, x in ((1, m), (3, m.orderBy("toxic")))]
    assert (fields[0].weights == fields[1].weights).all()
    got = {r.doc_id: r.score for r in toxicity.scored(d, fields[0]).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 2 == 1) for i, _ in data)
    assert toxicity.scored(none, fields[0]).count() == 0 and toxicity.without_toxic(none, fields[0]).count() == 0


def test_toxicity_without_labels(spark, docs):
    field = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert field is None and toxicity.scored(docs, field).where("score > 0").count() == 0


def test_chat_threads(spark):
    data = [
        (1, 0, "user", "How are you?\nI am well."),
        (1, 1, "assistant", "> how ARE  you?\nFine."),
        (1, 2, "user", ">> How are you?\n> Fine.\nGood."),
        (1, 3, "user", "> not said before\nHm."),
        (1, 4, "user", ">I am well.\n> How are you?\nBack to the start."),
        (2, 0, "user", "Fine."),
        (2, 1, "user", "> How are you?\nOther conversation."),
        (None, 0, "user", "a"),
        (None, 1, None, "> a\nb"),
        (3, None, "user", "> x"),
        (3, 0, "user", None),
        (3, 0, "user", None),
    ]
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("reply_to", F.lit(9))
    got = {(r.conv_id, r.turn): (r.body, r.n_quoted, r.quote_depth, r.n_found, r.reply_to, r.thread, r.position) for r in chat_threads.threaded(c).collect()}
    assert got[1, 1] == ("Fine.", 1, 1, 1, 0, 0, 1)
    assert got[1, 2] == ("Good.", 2, 2, 2, 1, 0, 2)
    assert got[1, 3] == ("Hm.", 1, 1, 0, None, 3, 0)
    assert got[1, 4] == ("Back to the start.", 2, 1, 2, 0, 0, 3)
    assert got[2, 1][3:5] == (0, None)
    assert got[None, 1][3:] == (1, 0, 0, 1)
    assert got[3, None][4:] == (None, None, None)
    assert chat_threads.threaded(c).count() == len(data)
    assert chat_threads.threaded(c.limit(0)).count() == 0
    ordered = [r.formatted for r in chat_threads.conversation_text(c).where("conv_id = 1").orderBy("thread", "position").collect()]
    assert [x.split("\n")[1] for x in ordered] == ["How are you?", "Fine.", "Good.", "Back to the start.", "Hm."]


def test_quotes_that_are_wrapped_anew_or_taken_out_of_a_line(spark):
    data = [
        (1, -5, "user", "A first sentence that is long. A second one follows here! And a third"),
        (1, 10**13, "user", "> A first sentence\n>  that is long.\nYes."),
        (1, 10**13 + 1, "user", "> A second one\n> follows here! And a third\n>> A first sentence that\n>> is long.\nNo."),
        (1, 10**13 + 2, "user", "> A second one\n\n> follows here!\nA run ends at a blank own line."),
    ]
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = [(r.n_found, r.reply_to, r.thread, r.position) for r in chat_threads.threaded(c).orderBy("turn").collect()]
    assert got == [(0, None, -5, 0), (1, -5, -5, 1), (3, -5, -5, 2), (0, None, 10**13 + 2, 0)]


def brute_threads(data):
    """{(conv_id, turn): (n_found, reply_to, thread, position)} in plain Python."""
    out, talks = {}, {}
    for conv, turn, _, text in data:
        talks.setdefault(conv, {})[turn] = text
    for conv, talk in talks.items():
        own, children, parent = {}, {}, {}
        for turn in sorted(talk):
            runs, units = [], {}
            for line in talk[turn].split("\n"):
                marks = re.match(r"(?:[ \t]*>)*", line)[0]
                level, norm = marks.count(">"), " ".join(line[len(marks) :].lower().split())
                units.setdefault(level, set()).add(norm)
                if runs and runs[-1][0] == level:
                    runs[-1][1] += " " + norm
                else:
                    runs.append([level, norm])
            for level, text in runs:
                units.setdefault(level, set()).update(re.split(r"(?<=[.!?]) +", " ".join(text.split())))
            votes, found = {}, 0
            for level, group in units.items():
                for u in group - {""}:
                    if level and u in own:
                        found += 1
                        if level == 1:
                            votes[own[u]] = votes.get(own[u], 0) + 1
            for u in units.get(0, set()) - {""}:
                own.setdefault(u, turn)
            out[conv, turn] = [found, None, turn, 0]
            if votes:
                out[conv, turn][1] = parent[turn] = max(votes, key=lambda o: (votes[o], o))
                children.setdefault(parent[turn], []).append(turn)
        for root in set(talk) - set(parent):
            stack, at = [root], 0
            while stack:
                turn = stack.pop()
                out[conv, turn][2:] = [root, at]
                at += 1
                stack += sorted(children.get(turn, []), reverse=True)
    return {k: tuple(v) for k, v in out.items()}


def generated_talks():
    """Thousands of messages that quote each other: trees, a long chain, and one turn that hundreds answer."""
    rng, words, data = random.Random(31), vocabulary(800, 7), []

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))).capitalize() + rng.choice(".!?")

    for conv in range(120):
        said = []
        for turn in range(400 if conv < 2 else rng.randint(1, 30)):
            own = [" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            quotes = []
            if said and rng.random() < 0.8:
                to = said[-1] if conv == 0 else said[0] if conv == 1 else rng.choice(said)
                picked = rng.choice(to["own"])
                cut = picked.split()
                at = rng.randint(1, len(cut))
                quotes = rng.choice([[f"> {picked}"], [f"> {' '.join(cut[:at])}", f">{' '.join(cut[at:])}"], [f"> {re.split(r'(?<=[.!?]) ', picked)[-1]}"]])
                quotes += [f">{q}" for q in to["quotes"][:2]]
                quotes += [f"> {sentence()}"] * rng.randint(0, 1)
            said.append({"own": own, "quotes": quotes})
            data.append((conv, 3 * turn, "user", "\n".join(quotes + own)))
    return data


def test_threads_match_brute_force_and_sql(spark, tmp_path):
    import duckdb

    from tablescope.llm.oracles import ORACLE_SQL

    data = generated_talks()
    c = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    rows = chat_threads.threaded(c).collect()
    got = {(r.conv_id, r.turn): (r.n_found, r.reply_to, r.thread, r.position) for r in rows}
    want = brute_threads(data)
    assert got == want and sum(v[1] is not None for v in want.values()) > 1000
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["op3_chat_threads"])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(found.fetchall())


def test_empty_tables(none):
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.similar_groups(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert exact_dedup.deduplicated(none).count() == 0
