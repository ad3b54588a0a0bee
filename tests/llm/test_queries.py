"""The registered queries with their columns and digests, on small tables, against brute force or SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
import xxhash

from tablescope.llm import html_extract, queries, simhash_dedup, substring_dedup, suffix_dedup, toxicity, url_filter


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = some(70), []
    for i in range(120):
        t = some(rng.randint(3, 150))
        if i % 5 == 0:
            t = f"{t} {passage} {some(4)}"
        if i % 7 == 0:
            t = t.replace(" ", " horrid ", 2)
        texts.append(t)
    texts += [texts[1], texts[2], texts[2] + " end", None, "", "É ñ\tß", texts[0] * 2]
    rows = [(i, t, "en", None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i % 7 == 0)) for i in range(120)]
    items = [(1, passage), (2, texts[3]), (3, None), (4, some(4))]
    pages = [(i, u, f"<html><body><nav><a href=/>{some(2)}</a></nav><article><h1>{some(3)}</h1><p>{some(30)}, {some(5)}.</p></article><footer>{some(3)}</footer></body></html>") for i, u in enumerate([None, "x", "http://A.org/x", "https://b.example.org/es/1", "http://casino.example.net/en/4", "http://news.example.net/fr/3?a#b", "http://b.com/de/"])]
    talk = [(1, 0, "user", "How is it? Fine."), (1, 1, "assistant", "> How is it?\nGood."), (1, 2, "user", ">> How is it?\n> Good.\nOk."), (2, 0, "user", None)]
    d = tmp_path_factory.mktemp("tables")
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"), ("pages", pages, "page_id long, url string, html string"), ("conversations", talk, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{d}/{name}.parquet")
    return str(d), rows, labels, pages


def found(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    got = queries.QUERIES[name](spark, tables[0])
    assert sorted(got.columns) == names
    assert sorted((tuple(rounded(r[n]) for n in names) for r in got.collect()), key=repr) == sorted((tuple(rounded(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_op1_and_op9_match_brute_force(spark, tables):
    plain = [(r[0], r[1]) for r in tables[1]]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found(spark, tables, "op1_substring_dedup")} == substring_dedup.brute_force(plain)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found(spark, tables, "op9_suffix_array_dedup")} == suffix_dedup.brute_force(plain)


def test_op5_query(spark, tables):
    weights = url_filter.fitted()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found(spark, tables, "op5_url_filter")}
    model = lambda h, p: "block" if url_filter.probabilities(weights, [h], [p])[0] >= url_filter.THRESHOLD else "allow"
    assert got == {
        0: ("", "", None, model("", "")),
        1: ("", "", None, model("", "")),
        2: ("a.org", "/x", "org/", "allow"),
        3: ("b.example.org", "/es/1", "example.org/es/", "block"),
        4: ("casino.example.net", "/en/4", None, "block"),
        5: ("news.example.net", "/fr/3", None, "allow"),
        6: ("b.com", "/de/", "com/de/", "block"),
    }


def test_op6_query(spark, tables):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in found(spark, tables, "op6_html_extraction")}
    assert got == {i: (u, html_extract.article(h), len(html_extract.article(h))) for i, u, h in tables[3]}
    assert all(t and "<" not in t for _, t, _ in got.values())


def test_op7_query(spark, tables):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {r[0]: fingerprint(r[1]) for r in tables[1]}
    label = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2):
            break
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found(spark, tables, "op7_simhash_dedup")}
    assert got == {i: (f"{fp[i]:016x}", label[i]) for i in fp}
    assert simhash_dedup.fingerprints(spark.read.parquet(f"{tables[0]}/documents.parquet")).count() == len(fp)


def test_op10_query(spark, tables):
    _, rows, labels, _ = tables
    got = {r.doc_id: r for r in found(spark, tables, "op10_toxicity")}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(i, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 10 and sum(got[i].predicted == t for i, t in held) / len(held) >= 0.9


def test_op2_digests_are_of_the_text(spark, tables):
    text = {r[0]: r[1] or "" for r in tables[1]}
    assert {r.doc_id: r.text_sha256 for r in found(spark, tables, "op2_exact_dedup")} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text.items()}
