"""The prefix-tree join, whitening and the manifest against brute force."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from statloom.llm import jaccard, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(digests):
    """(root, per leaf: segments from the leaf upwards)."""
    paths, level, spans = [[] for _ in digests], digests, [[i] for i in range(len(digests))]
    while len(level) > 1:
        runs = [range(i, min(i + 8, len(level))) for i in range(0, len(level), 8)]
        for run in runs:
            for i in run:
                for one in spans[i]:
                    paths[one].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        spans = [[x for i in run for x in spans[i]] for run in runs]
        level = [h(*[level[i] for i in run]) for run in runs]
    return level[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for g in names:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs.append((held, *tree([leaf(r, r[1]) for r in held])))
    root, tops = tree([s[1] for s in subs])
    for (held, sub, paths), top in zip(subs, tops, strict=True):
        for r, path in zip(held, paths, strict=True):
            text, whole = r[1], path + top
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for before, after in whole:
                folded = h(before, folded, after)
            out.append((r[0], leaf(r, r[1]), sub, root, h(*[b + a for b, a in whole]), folded, folded == root))
    return out


def key(t):
    return tuple((v is not None, v) for v in t)


def manifest_rows():
    rows = [(i, f"Text {i} Ä" * (i % 4), "en", "a", i) for i in range(600)] + [(i, f"Mot {i}", "fr", None, None) for i in range(9)] + [(7000, "X", "lone", "b", 1)]
    rows += [(1, None, None, None, None), (1, "", None, None, 0), (None, "NO id", "en", "s", 3), (None, "NO id", "en", "s", 3), (5, "Same", "de", "s", 1), (5, "Same", "de", "s", 1),
             (5, "other", "de", "s", 1), (8, "LONG " * 50_000, "Über", "s", 250_000)]
    return rows + [(10_000 + i, "T", f"g{i}", "s", 1) for i in range(70)]


def test_manifest_against_brute_force(spark):
    rows = manifest_rows()
    got = [tuple(r) for r in merkle.proofs(clashing(spark.createDataFrame(rows, DOCS))).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(3, "A", None, "s", 1)], [(i, "A", "en", "s", 1) for i in range(9)]):
        got = [tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, DOCS)).collect()]
        assert sorted(got, key=key) == sorted(brute_manifest(rows) if rows else [], key=key)


def test_proofs_of_some_leaves(spark):
    docs = spark.createDataFrame(manifest_rows(), DOCS)
    asked = spark.createDataFrame([("en", 0), ("en", 64), ("en", 601), ("lone", 0), (None, 1), ("en", 10_000)], "lang string, rank long")
    some = {(r["lang"], r["rank"]): r for r in merkle.manifest(docs, asked).collect()}
    assert set(some) == {("en", 0), ("en", 64), ("en", 601), ("lone", 0), (None, 1)}
    whole = {(r["lang"], r["rank"]): r for r in merkle.manifest(docs).collect()}
    assert all(whole[k] == v for k, v in some.items())


# ---- prefix-tree join

def word_set(text):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    found = [w for x in found for w in x.replace("\t", "\n").split("\n") if w]
    return frozenset(tuple(found[i:i + 3]) for i in range(max(len(found) - 2, 1))) if found else frozenset()


def brute_components(rows, percent=90):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=key)


def near_copies(seed, groups=12):
    rng, out = random.Random(seed), []
    for g in range(groups):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 11, 12, 20, 40, 90, 200]))]
        for _ in range(rng.randrange(2, 12)):
            copy = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = f"n{rng.randrange(10 ** 6)}"
                else:
                    copy.insert(at, f"n{rng.randrange(10 ** 6)}")
            if rng.random() < 0.5:
                copy = [*copy, f"end{rng.randrange(10 ** 6)}"]
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                own = copy  # chains of copies of copies
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, percent, size", [(1, 90, 2048), (2, 90, 3), (3, 70, 4), (4, 80, 2048)])
def test_components_against_brute_force(spark, monkeypatch, seed, percent, size):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", size)
    rows = near_copies(seed)
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_components(rows, percent)


def test_components_odd(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, shared), (7, shared), (7, "other words here now"), (9, shared + " x"), (None, shared), (None, None),
            (11, "a b c d e f g h i j k"), (12, "a b c d e f g h i j k l"), (13, "a b c d e f g h i j"), (14, "w " * 60_000), (15, "  no-break"), (16, "long " + " ".join(f"q{i}" for i in range(20_000)))]
    got = jaccard.components(clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)))
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_components(rows)
    assert jaccard.components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("percent", [60, 90, 97])
def test_linked_sets_share_a_key(percent):
    rng, cuts = np.random.default_rng(percent), jaccard.Cuts(percent)
    met = 0
    for _ in range(3000):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        b = a[rng.random(len(a)) > rng.random() * (100 - percent) / 100]
        b = np.unique(np.concatenate([b, rng.integers(0, 2 ** 64, int(rng.integers(0, 3)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and len(b) != common != len(a) and 100 * common >= percent * (len(a) + len(b) - common):
            met += 1
            x, y = ({int(k) for _, keys in cuts.keys(s) for k in keys} for s in (a, b))
            assert x & y
    assert met > 50


def test_walks_find_all_links():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, size=rng.integers(1, 30)).astype(np.uint64)) for _ in range(150)]
    sets = list({s.tobytes(): s for s in sets}.values())
    tree = jaccard.Tree(sets, [len(sets)] * len(sets))
    for percent in (50, 80):
        for i, s in enumerate(sets):
            want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
            assert set(tree.walk(s, 0, percent, lambda label: False)) == want, i


# ---- whitening

def brute_whitening(vectors):
    x = np.floor(vectors * 1024).astype(np.int64) + 100_000
    n = len(x)
    c = (n * x - x.sum(axis=0)) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return x, c, values[::-1], vectors[:, ::-1]


def held(df):
    rows = df.toPandas()
    return rows, rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()


def test_whitening_against_eigenvectors(spark):
    data = np.random.default_rng(2).standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>").repartition(5)
    rows, got = held(whitening.whiten(df))
    x, c, values, vectors = brute_whitening(data)
    want = c @ vectors[:, :8] / np.sqrt(values[:8])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9
    first = rows[rows["component"] == 1].sort_values("vec_id")
    assert first["deviation"].tolist() == np.square(300 * x - x.sum(axis=0)).sum(axis=1).tolist()
    assert np.allclose(rows.groupby("component")["explained"].first(), values[:8] / values.sum(), rtol=1e-9)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9 and set(rows["n"]) == {300}


def test_whitening_with_equal_deviations(spark):
    unit = np.concatenate([np.eye(10), -np.eye(10)])  # every direction has the same variance
    rows, got = held(whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, vector array<double>")))
    assert got.shape == (20, 8) and np.abs(got.T @ got / 20 - np.eye(8)).max() < 1e-9
    assert np.allclose(rows["explained"], 0.1)


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0, 2.0]), (3, [inf, 1.0, 2.0]), (4, [None, 1.0, 2.0]), (5, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (None, [2.0, 0.5, 1.0]), (7, [4.0]), (8, []), (9, [1e30, -1e30, 0.0])]
    df = clashing(spark.createDataFrame(odd, "id long, vector array<double>"))
    got = whitening.whiten(df.filter("id IS NULL OR id < 9")).collect()
    assert {r["vec_id"] for r in got} == {5, None, 7, 8} and {r["n"] for r in got} == {5}
    assert len(got) == 5 * 3 and max(r["identity_error"] for r in got) < 1e-9
    big = whitening.whiten(df).collect()
    assert {r["deviation"] for r in big if r["vec_id"] == 9} == {2 ** 63 - 1}
    for few in (df.limit(0), df.filter("id = 5"), df.filter("id = 7"), df.filter("id = 8")):
        assert whitening.whiten(few).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], "id long, vector array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_deviations_beyond_floats():
    m = whitening.Moments(10 ** 9, 2, np.array([0, 0]), np.array([1, 2]))
    got = whitening.deviations(np.array([[3, 0], [2, 2], [4, 4]]), m).tolist()
    want = [min(2 ** 63 - 1, (3 * 10 ** 9 - 1) ** 2 + 4), (2 * 10 ** 9 - 1) ** 2 + (2 * 10 ** 9 - 2) ** 2, 2 ** 63 - 1]
    assert got == want


def test_rows_are_ranked_across_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("tree"), (5000 - F.col("id")).alias("at")).repartition(7)
    got = merkle.ranked(rows, "tree", ["at"], "ranked").collect()
    for t in range(3):
        own = sorted((r["at"], r["rank"], r["n"]) for r in got if r["tree"] == t)
        assert [r[1] for r in own] == list(range(len(own))) and {r[2] for r in own} == {len(own)}


# ---- stages on rows

def test_stages_judge_rows_not_ids(spark):
    import corpus_pipeline as p

    def words_of(letter):
        return " ".join(f"{letter}{i}" for i in range(60))

    rows = [(1, "t"), (2, "t"), (2, "u"), (3, "v"), (3, "v"), (None, "t"), (None, "w"), (None, "w")]
    docs = spark.createDataFrame([(i, words_of(x), "en", "s", 1) for i, x in rows] + [(9, None, None, None, None), (9, "", None, None, 0)], DOCS)
    got = [(r["doc_id"], (r["text"] or "-")[:1]) for r in p.one_of_each(spark, docs, "").collect()]
    assert sorted(got, key=key) == sorted([(1, "t"), (2, "u"), (3, "v"), (None, "w"), (9, "-"), (9, "-")], key=key)


def test_sample_is_a_bound(spark):
    from statloom.llm.quality import bounded_sample

    one_id = spark.range(3000).select(F.lit(7).alias("doc_id"), (F.col("id") % 2000).alias("v"))
    got = [tuple(r) for r in bounded_sample(one_id, 500).collect()]
    assert len(got) == 500 and sorted(got) == sorted(map(tuple, bounded_sample(one_id.repartition(9), 500).collect()))
    assert bounded_sample(one_id.limit(20), 500).count() == 20


# ---- markup without end

@pytest.mark.parametrize("page, texts", [
    ("<p>hi there</p><a title='" + "x" * 5000, ["hi there"]), ("<p>hi</p>" + "<a " * 300_000, ["hi"]), ("<p>a</p><!-- x > y", ["a"]), ("<p>t</p>" + "<!-- " * 200_000, ["t"]),
    ("<p>a < b</p> c", ["a < b", " c"]), ("<" * 300_000, ["<" * 300_000]),
])
def test_markup_without_end(page, texts):
    import time

    from statloom.llm import html

    start = time.time()
    assert [text for kind, _, text in html.pieces(page) if kind == "w"] == texts
    assert time.time() - start < 5


def test_misspelled_words_under_a_stem():
    from statloom.llm.toxicity import Matcher

    m = Matcher({"vequabc": 1.0, "badword": 1.0}, {"vequ": 1.0})
    assert m.look("vequabc") == ("vequabc", 1.0, False) and m.look("vequxyz") == ("vequ", 1.0, False)
    assert all(m.look(w) == ("vequabc", 0.7, True) for w in ("vepuabc", "vwquabc", "veqabc"))
    assert m.look("vepuxyz") is None and m.look("other") is None


# ---- licence expressions

def test_licence_expressions(spark):
    from itertools import chain, combinations

    from statloom.llm import licenses

    order = licenses.postfix(licenses.tokens("(mit or gpl-2.0 with classpath-exception) and (cc0-1.0 or isc)"))
    assert licenses.licences(order) == {"mit", "gpl-2.0", "cc0-1.0", "isc"}
    names = ["mit", "gpl-2.0", "cc0-1.0", "isc", "classpath-exception"]
    for held in map(set, chain.from_iterable(combinations(names, n) for n in range(6))):
        assert licenses.satisfied(order, held) == bool(held & {"mit", "gpl-2.0"} and held & {"cc0-1.0", "isc"})
    wide = " and ".join(f"(mit or licenseref-{i})" for i in range(20_000))  # 2 ** 20,000 choices
    texts = [(1, "license-expression: see the file below"), (2, "SPDX-License-Identifier: " + wide), (3, "spdx-license-identifier: MIT OR mitten"), (4, "// SPDX-License-Identifier: LicenseRef-Own")]
    got = {r["doc_id"]: r for r in licenses.scan(clashing(spark.createDataFrame(texts, "doc_id long, text string")), ["doc_id"]).collect()}
    assert (got[1]["labels"], got[1]["unknown"], got[1]["score"]) == ([], ["see"], 0.0)
    assert len(got[2]["labels"]) == 20_001 and len(got[2]["expressions"][0]) == 79_999
    assert (got[3]["labels"], got[3]["unknown"]) == (["mit"], ["mitten"]) and got[4]["labels"] == ["licenseref-own"]
