"""Operators on documents: brute force, nulls, blanks, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, normal
from pyspark.sql import functions as F

from histoplane.llm import fingerprints, licenses, mixing, ngram_join, quality, queries, sentencepiece_bpe
from histoplane.llm.shingles import shingles

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3).split()
LONG = " ".join(f"w{i % 4000}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, score string, ids string, decoded string, key long, n int, u double, src string, id string, label string, `text_grams` string"


def base(i, text, source="a"):
    return (i, text, "en", source, 1, 9, "x", "y", "z", "w", 5, 6, 0.5, "q", "r", "l", "t")


@pytest.fixture(scope="module")
def docs(spark):
    near = WORDS[:]
    near[40] = "changed"
    rows = [
        base(1, " ".join(WORDS)),
        base(2, " ".join(WORDS).upper()),
        base(3, " ".join(near)),
        base(4, None, None),
        base(5, ""),
        base(6, " \t\n"),
        base(7, "one two"),
        base(8, "One\ttwo", "b"),
        base(9, LONG, "b"),
        base(9, LONG, "b"),
        base(None, "no id here at all", "b"),
        base(None, " ".join(WORDS), None),
        base(10, "Ünïcode ÉCOLE ﬁn 漢字 😀 é", "c"),
        base(11, "ünïcode ÉCOLE ﬁn 漢字 😀 é", "c"),
        base(12, "Released under the MIT License.\n" + "filler " * 50, "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word_set(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [word_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[root(i)] = min(d, groups.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(groups.get(root(i)))) for i, (d, _) in enumerate(rows))


def test_join_edge_cases(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "9", "10", "11", "12", "None", "None"])


@pytest.mark.parametrize("hot", [200_000, 3])
def test_join_random_groups(spark, hot):
    rnd = np.random.default_rng(3)
    rows = []
    for g in range(12):
        text = [f"g{rnd.integers(60)}" for _ in range(int(rnd.integers(5, 90)))]
        for _ in range(int(rnd.integers(1, 9))):
            t = text[:]
            for _ in range(int(rnd.integers(0, 4))):
                t[int(rnd.integers(len(t)))] = f"e{rnd.integers(1000)}"
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(3 * i))) for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(df, hot=hot).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_join_links(spark, docs, none, hot):
    rnd = np.random.default_rng(5)
    rows = []
    for g in range(8):
        text = [f"g{g}_{rnd.integers(60)}" for _ in range(int(rnd.integers(40, 120)))]
        for _ in range(int(rnd.integers(4, 9))):
            t = text[:]
            for _ in range(int(rnd.integers(0, 3))):
                t[int(rnd.integers(len(t)))] = f"e{rnd.integers(1000)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000))
    sets = {r.doc_id: word_set(r.text) for r in df.collect()}
    want = {frozenset((frozenset(a), frozenset(b))) for a in sets.values() for b in sets.values() if a != b and 100 * len(a & b) >= 75 * len(a | b) and a & b}
    key = {r.class_key: frozenset(sets[r.doc_id]) for r in ngram_join.near_duplicates(df).where("class_key is not null").collect()}
    got = ngram_join.linked_pairs(df, hot=hot).collect()
    assert len(got) == len(want) > 20 and {frozenset((key[r.u], key[r.v])) for r in got} == want
    assert ngram_join.linked_pairs(none).count() == 0


def test_keep_one_with_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    near = lambda c: text(c) + " end"
    rows = [(1, text("a")), (2, near("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e")), (5, text("f")), (5, near("f"))]
    rows += [(6, ""), (6, " "), (6, ""), (7, None), (7, text("g")), (8, text("h")), (9, near("h")), (9, near("a")), (None, text("a"))]
    kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), str(r.text)) for r in kept if r.doc_id != 5)
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (6, ""), (6, " "), (7, None), (7, text("g")), (8, text("h")), (None, text("a"))]
    assert got == sorted((str(i), str(t)) for i, t in want)
    assert [r.text in (text("f"), near("f")) for r in kept if r.doc_id == 5] == [True]


def test_join_filters_never_lose_a_pair():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 400, int(rnd.integers(1, 200)), dtype=np.uint64))
        b = np.unique(np.concatenate((rnd.permutation(a)[: int(rnd.integers(0, len(a) + 1))], rnd.integers(0, 400, int(rnd.integers(1, 40)), dtype=np.uint64))))
        inter = len(np.intersect1d(a, b))
        need = ngram_join.required_overlap(len(a), len(b), 75)
        differ = ngram_join.difference_bound(ngram_join.parities(a), ngram_join.parities(b))
        assert differ <= len(a) + len(b) - 2 * inter
        assert ngram_join.overlap_at_least(a, b, need) == (inter if inter >= need else None)
        assert (inter >= need) == (100 * inter >= 75 * (len(a) + len(b) - inter))


def test_shingles():
    assert len(shingles(None)) == len(shingles(b"")) == len(shingles(b" \x0b ")) == 0
    assert len(shingles(b"a b")) == 1 and len(shingles(b"a b c d e f")) == 2
    assert (shingles(b"A b") == shingles(b"a  B")).all() and (shingles("É".encode()) != shingles("é".encode())).all()
    assert len(shingles(b"a " * 100)) == 1


def test_mixing(docs, none):
    out = mixing.mixed_copies(docs).collect()
    assert len(out) == docs.count()
    total = sum(r["size"] for r in out)
    assert total == sum(len(words(r.text)) for r in docs.collect())
    by = {}
    for r in out:
        assert 0 <= r.copies <= 2 and r.source_size == sum(x["size"] for x in out if x.src == r.src)
        by.setdefault(r.src, [r.target, r.source_size, 0])[2] += r.copies * r["size"]
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    left, open_, want = 1.5 * total, dict(weights), {}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 2 * by[s][1]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * by[s][1]
            left -= want[s]
            del open_[s]
    assert all(abs(want[s] - by[s][0]) < 1e-6 for s in by)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed_copies(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mixed_copies(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("one", [lambda i: (None, "w " * 100, "a"), lambda i: (7 if i < 600 else i, "w " * 100, "a"), lambda i: (None, f"v{i} " + "w " * 99, "a")])
def test_mixing_repeated_rows(spark, one):
    rows = [one(i) for i in range(800)] + [(5000 + i, "x " * 50, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mixed_copies(docs).toPandas()
    assert len(out) == len(rows) and out["copies"].between(0, 2).all()
    for _, g in out.groupby("src"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= 100
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.groupBy("source").count().toPandas().set_index("source")["count"].to_dict() == out.groupby("src")["copies"].sum().to_dict()


def test_mixing_is_balanced(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rnd.lognormal(4, 1))), f"s{i % 4}") for i in range(800)]
    out = mixing.mixed_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in out.groupby("src"):
        taken = (g["copies"] * g["size"]).sum()
        assert abs(taken - g["target"].iloc[0]) < 0.01 * g["target"].iloc[0]
        rate = (g["rate"] * g["size"]).sum()
        assert abs(rate - g["target"].iloc[0]) < 1e-4 * g["target"].iloc[0]


def test_sentencepiece(docs, none):
    import sentencepiece

    path = sentencepiece_bpe.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_bpe.encode(docs, path)
    assert [c for c in out.columns if c not in ("ids", "decoded")] == [c for c in docs.columns if c not in ("ids", "decoded", "text")]
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out.collect())
    assert got == sorted((str(r.doc_id), sp.encode(r.text or ""), sp.decode(sp.encode(r.text or ""))) for r in docs.collect())
    assert sentencepiece_bpe.encode(none, path).count() == 0


def test_sentencepiece_random_texts():
    import random

    import sentencepiece

    path = sentencepiece_bpe.model_path()
    sp, model, rnd = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.load(path), random.Random(2)
    texts = ["".join(rnd.choice(" abcdeé▁\n\t\x00!<>s漢😀ｆ　01the ") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["x" * 2000, "ab" * 900, "漢字" * 700, "</s><s>", " ", "▁", "a" + " " * 700 + "b"]
    ids = [np.frombuffer(x, dtype=np.int32).tolist() for x in model.encode(texts)]
    assert ids == sp.encode(texts)
    assert [model.decode(i) for i in ids] == [sp.decode(i) for i in ids]
    loose = [[rnd.randrange(32_000) for _ in range(12)] for _ in range(300)]
    assert [model.decode(i) for i in loose] == [sp.decode(i) for i in loose]


def test_fingerprints(docs, none):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprints.sketch(x.encode()) for x in (t, edited, following))
        want.append((str(d), len(t), edited, fingerprints.to_text(a), fingerprints.to_text(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted(map(repr, want)) == sorted(repr((str(r.doc_id), *r[1:])) for r in fingerprints.edited_fingerprints(docs).collect())
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprint_estimates():
    rnd = np.random.default_rng(5)
    text = "".join(chr(97 + i) for i in rnd.integers(0, 26, 40_000))
    whole, part, other = (fingerprints.sketch(t.encode()) for t in (text, text[10_000:14_000], text[::-1]))
    assert fingerprints.likeness(whole, part) > 0.98 and fingerprints.likeness(whole, other) < 0.02
    a, b = fingerprints.sketch(text[:20_000].encode()), fingerprints.sketch(text[20_000:].encode())
    assert len(np.setxor1d(fingerprints.merge(a, b), whole)) <= 16
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    short = [fingerprints.sketch(f"a line of words {i}".encode()) for i in range(200)]  # some have no hash below the fraction
    fraction = (1 << 32) // fingerprints.SCALE
    assert any(s[0] >= fraction for s in short) and any(s[0] < fraction for s in short)
    for x, y in zip(short, short[1:]):
        both = np.union1d(x, y)
        assert fingerprints.merge(x, y).tolist() == ([h for h in both.tolist() if h < fraction] or [int(both[0])])
        assert fingerprints.merge(x, y).tolist() == fingerprints.merge(y, x).tolist()
    assert fingerprints.merge(short[0], fingerprints.sketch(b"")).tolist() == short[0].tolist()
    assert fingerprints.likeness(fingerprints.sketch(b""), fingerprints.sketch(b"")) == 1.0 and len(fingerprints.sketch(b"x")) == 1


def test_quality(spark, docs, none):
    rnd = np.random.default_rng(7)
    good = [" ".join(f"w{rnd.integers(500)}" for _ in range(60)) for _ in range(150)]
    bad = [" ".join(f"W{rnd.integers(500)}!!".upper() for _ in range(60)) for _ in range(150)]
    texts = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(1, None, 0), (None, 1, 0), (9999, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(texts, labels, ~quality.held_out())
    out = quality.score(texts, model).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert len(held) > 30 and ((held.score >= 0.3) == (held.doc_id < 150)).mean() > 0.98
    again = quality.train(texts, labels, ~quality.held_out())
    assert again[0] == model[0] and (again[1] == model[1]).all()
    edge = quality.score(docs, model)
    assert edge.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in edge.collect()) and edge.count() == docs.count()
    assert quality.score(none, model).count() == 0
    empty = quality.train(none, labels, ~quality.held_out())
    assert [r.score for r in quality.score(docs.limit(2), empty).collect()] == [0.5, 0.5]


def test_license_scan(spark, docs, none):
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license, r.containment, r.first_word) for r in got] == [(12, "MIT-line", 1.0, 0)]
    assert licenses.scan(none).count() == 0
    changed = licenses.TEMPLATES["MIT"].replace("sublicense", "resell")
    half = licenses.TEMPLATES["MIT"][:200]
    rows = [(1, "x " * 333 + licenses.TEMPLATES["GPL-3.0-or-later"] + " y" * 50), (2, changed.upper()), (3, half), (4, None)]
    found = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {(1, "GPL-3.0-or-later"), (2, "MIT")}
    assert found[1, "GPL-3.0-or-later"].containment == 1.0 and 0.75 <= found[2, "MIT"].containment < 1


def test_license_rows_without_or_with_repeated_ids(spark):
    text = "Released under the MIT License"
    rows = [(None, text), (None, text + " and more"), (3, text), (3, "other " + text), (3, text), (4, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("3", "MIT-line")] * 3 + [("None", "MIT-line")] * 2


def test_license_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = {"Released under the MIT License": "MIT-line", "Licensed under the Apache License, Version 2.0": "Apache-2.0-line", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0-short", "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-line"}
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text]
    want = {(i, name) for i, text in texts for line, name in names.items() if line in text}
    assert {i for i, _ in want} == {i for i, text in texts if re.search("(?i)(licensed|released) under", text)}
    assert "CC-BY-NC-4.0-short" in {name for _, name in want}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == want


def test_license_notices(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = licenses.TEMPLATES["BSD-clauses-1-2"]
    rows = {
        "Licensed under CC BY 4.0.": {"CC-BY-4.0-short"},
        "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0-short"},
        "Licensed under CC0 1.0.": {"CC0-1.0-short"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0-line"},
        "To the extent possible under law, A. Name has waived all copyright and related or neighboring rights to This Work.": {"CC0-1.0"},
        "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-line"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-line"},
        gnu.format("Affero"): {"AGPL", "GPL-3.0-or-later"},  # all but four of the GPL's 39 shingles
        gnu.format("Lesser"): {"LGPL", "GPL-3.0-or-later"},
        bsd: {"BSD-clauses-1-2"},
        bsd + " 3. Neither the name of A. Name nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": {"BSD-clauses-1-2", "BSD-clause-3"},
    }
    docs = spark.createDataFrame([(i, f"some words before it {text} and some after it") for i, text in enumerate(rows)], "doc_id long, text string")
    found = {i: set() for i in range(len(rows))}
    for r in licenses.scan(docs).collect():
        found[r.doc_id].add(r.license)
    assert list(found.values()) == list(rows.values())


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op5_license_scan"])
def test_sql(spark, duck, name):
    assert normal(queries.QUERIES[name](spark, DATA).toPandas()) == normal(duck.sql(queries.ORACLE_SQL[name]).df())


def test_digest_queries(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.model_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in queries.QUERIES["op3_sentencepiece"](spark, DATA).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert queries.QUERIES["op7_fingerprints"](spark, DATA).where(F.col("n_chars") > 200).agg(F.avg("near_edited") - F.avg("near_next")).first()[0] > 0.4
    scored = queries.QUERIES["op9_quality"](spark, DATA)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and scored.count() == len(texts)
