"""The operators and queries on tables: SQL, brute force, held-out accuracy, and odd rows."""

import hashlib
import os
import random
import time
from zlib import crc32

import numpy as np
import pytest
from helpers import clashing, words
from pyspark.sql import functions as F

from statloom.llm import bpe, decontaminate, html, langid, licenses, neardup, quality, queries, topk, toxicity
from statloom.llm.common import table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in table(spark, FOLDER, "documents").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in table(spark, FOLDER, "labels").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_language(spark, docs):
    got = queries.op1_language_id(spark, FOLDER).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def brute_classes(docs, least=0.8):
    known = neardup.Hashes()
    grams = {i: neardup.labelled_kmers(w, known) for i, r in docs.items() if (w := words(r["text"]))}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(grams, key=lambda i: (len(grams[i]), i))
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(grams[a]) < least * len(grams[b]):
                break
            if neardup.aligned(grams[a], grams[b], least):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in docs}


def test_near_duplicates(spark, docs):
    some = {i: r for i, r in docs.items() if i < 400}
    got = neardup.classes(spark.createDataFrame([(i, r["text"]) for i, r in some.items()], "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute_classes(some)


def test_encoding(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary_path())
    for r in queries.op4_bpe_transducer(spark, FOLDER).collect():
        ids = tok.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("name, label, least", [("op6_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, docs, labels, name, label, least):
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, FOLDER).collect()}
    assert set(got) == set(docs)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    assert all(crc32(str(i).encode()) % 5 == 0 for i in held)
    assert sum(got[i]["predicted"] == labels[i][label] for i in held) >= least * len(held)


def test_chat(spark):
    talks = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in table(spark, FOLDER, "conversations").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, FOLDER).collect()}
    assert set(got) == set(talks)
    for i, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["loss_sha256"]) == (
            len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))


def test_licenses(spark, docs):
    for r in queries.op8_license_scan(spark, FOLDER).collect():
        found = words(docs[r["doc_id"]]["text"])
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (
            len(found), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_pages(spark):
    import html as entities
    import re

    for r in queries.op10_html_extraction(spark, FOLDER).join(table(spark, FOLDER, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == " ".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


# Rows without values, empty and very long texts, repeated rows and ids.
LONG = "word " * 60_000
SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TEXTS = [(1, None), (2, ""), (3, LONG), (4, "Alpha " + SHARED), (4, "Alpha " + SHARED), (4, "other text"), (None, "no id " + SHARED), (None, None), (5, "... !!!"), (6, "alpha, " + SHARED + "!"),
         (7, "a mit license b")]
ROWS = [(i, t, None, None, None) for i, t in TEXTS]


def odd(spark):
    return clashing(spark.createDataFrame(ROWS, DOCS))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language_odd(spark):
    train = [(100, "the word of the others", "en"), (101, "les mots des autres", "fr"), (102, "x", None), (103, None, "en")]
    rows = ROWS + [(i, t, lang, None, None) for i, t, lang in train]
    both = clashing(spark.createDataFrame(rows, DOCS))
    got = langid.identify(both, F.col("doc_id") >= 100, ["doc_id", "text", "lang"]).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"] or "") for r in got) == sorted((r[0] or 0, r[1] or "", r[2] or "") for r in rows)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 5)] == ["und"] * 3
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4)} == {"en"}
    assert {r["lang_pred"] for r in langid.identify(both, F.lit(False), ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty(spark), F.lit(True), ["doc_id"]).count() == 0


def test_classifiers_odd(spark):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (4, 1, 1), (None, 1, 1), (6, None, None), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (quality.classify, toxicity.classify):
        for given in (labels, labels.limit(0)):
            got = run(odd(spark), given, ["doc_id"]).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert run(empty(spark), labels, ["doc_id"]).count() == 0


def test_near_duplicates_odd(spark):
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in neardup.classes(odd(spark)).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (4, 4), (5, 5), (6, 4), (7, 7)]
    assert neardup.classes(empty(spark)).count() == 0


def test_encoding_odd(spark):
    path = queries.vocabulary_path()
    image = bpe.build_lexicon(odd(spark), path)
    got = bpe.encode(odd(spark), image, path, ["doc_id"]).collect()
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t in TEXTS)
    assert bpe.encode(empty(spark), bpe.build_lexicon(empty(spark), path), path, ["doc_id"]).count() == 0


def test_decontamination_odd(spark):
    items = clashing(spark.createDataFrame([(1, SHARED), (1, SHARED), (2, None), (3, ""), (None, SHARED), (4, "Other TEXT"), (5, "unseen words"), (6, "word " * 12)], "item_id long, text string"))
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.decontaminate(odd(spark), items, ["doc_id"]).collect()}
    assert got == {(1, 0, 0, ()), (2, 0, 0, ()), (3, 60_000, 60_000, ("6",)), (4, 17, 16, ("1",)), (4, 2, 2, ("4",)), (None, 18, 16, ("1",)), (None, 0, 0, ()), (5, 0, 0, ()),
                   (6, 17, 16, ("1",)), (7, 4, 0, ())}
    assert decontaminate.decontaminate(odd(spark), items.limit(0), ["doc_id"]).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(spark), items, ["doc_id"]).count() == 0


def test_decontamination_against_brute_force(spark):
    import random

    random.seed(3)
    letters = "abcd"
    texts = [" ".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(60)]
    items = [" ".join(random.choice(letters) for _ in range(random.randint(1, 14))) for _ in range(25)]
    items += [" ".join(texts[i].split()[3:3 + random.randint(2, 20)]) for i in range(0, 60, 3)]
    got = decontaminate.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                                      spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), ["doc_id"]).collect()
    for r in got:
        w, hit, named = texts[r["doc_id"]].split(), set(), set()
        for n, item in enumerate(items):
            own = item.split()
            size = min(10, len(own))
            for j in range(len(own) - size + 1 if own else 0):
                for i in range(len(w) - size + 1):
                    if w[i:i + size] == own[j:j + size]:
                        hit |= set(range(i, i + size))
                        named.add(str(n))
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(named))


def test_licenses_odd(spark):
    got = licenses.scan(odd(spark), ["doc_id"]).collect()
    assert len(got) == len(ROWS)
    assert [(r["starts"], r["labels"]) for r in got if r["doc_id"] == 7] == [([1], ["mit"])]
    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND cc0-1.0\n")], "doc_id long, text string")
    assert licenses.scan(tagged, ["doc_id"]).first()["labels"] == ["cc0", "gpl", "mit"]
    assert licenses.scan(empty(spark), ["doc_id"]).count() == 0


def test_pages_odd(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>" * 20_000 + "x"), (4, "u", "<article>a<br>b</article>"), (4, "u", "<article>a<br>b</article>")],
                                  "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract_pages(clashing(pages), ["page_id", "url"]).collect())[:2] == ["", ""]
    assert html.extract_pages(pages.limit(0), ["page_id"]).count() == 0


def test_chat_odd(spark):
    from statloom.llm import chat

    rows = spark.createDataFrame([(1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(chat.format_conversations(clashing(rows), queries.vocabulary_path()).collect(), key=lambda r: (r["part"], r["piece"])):
        turns, loss = got.get(r["conv_id"], ([], ""))
        got[r["conv_id"]] = turns + chat.read_back(r["formatted"]), loss + chat.masked_text(r["formatted"], *map(np.array, (r["starts"], r["ends"], r["mask"])))
    assert got == {1: ([("", "x"), ("user", ""), ("user", "")], ""), None: ([("assistant", "y")], "y")}
    assert chat.format_conversations(rows.limit(0), queries.vocabulary_path()).count() == 0
    assert chat.digests(chat.format_conversations(rows.limit(0), queries.vocabulary_path(), finish=chat.read_pieces, schema=chat.PIECE)).count() == 0


@pytest.mark.parametrize("limit", [1, 300, 10**6])
def test_chat_of_one_hot_conversation(spark, limit):
    """A third of all rows, very long texts, repeated rows and null ids; pieces of one turn, of some and of all."""
    from statloom.llm import chat

    talk = [(7, i, ("user", "assistant")[i % 2], f"say {i} </s> it's <|end|> naïve 🙂") for i in range(600)] + [(7, 600, "assistant", "long " * 40_000)]
    other = [(i, j, ("assistant", "user")[j % 2], f"{i} {j}") for i in range(100, 300) for j in range(6)] + [(None, 1, "assistant", "same")] * 50
    rows = talk + other
    spread = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "conv_id long, turn long, role string, text string").repartition(7)
    pieces = chat.format_conversations(spread, queries.vocabulary_path(), finish=chat.read_pieces, schema=chat.PIECE, limit=limit)
    got = {r["conv_id"]: r for r in chat.digests(pieces).collect()}
    want = {}
    for conv, _, role, text in rows:
        want.setdefault(conv, []).append((role, text))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = chat.render(turns)[0]
        assert tuple(got[conv])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole))


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (100, [0.0, 0.0]), (7, [])]
    df = clashing(spark.createDataFrame(rows, "id long, vector array<double>"))
    got = topk.top_k(df.select("id", "vector"), df.select("id", "vector").filter("id % 100 = 0"), 3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 1), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 1, 0)]
    none = df.select("id", "vector").limit(0)
    assert topk.top_k(none, none).count() == 0
    exact = spark.createDataFrame([(0, [0.5, -0.0001, inf])], "id long, v array<float>").select(topk.integer_vector(F.col("v")).alias("v")).first()["v"]
    assert exact == [512.0, -1.0, inf]


def test_top_k_copies_no_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "SUPER", 8)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "HELD", 2, raising=False)
    vectors = {i: [float((i * 37) % 101 - 50), float((i * i) % 89 - 44), float(i % 7)] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    out = topk.top_k(df, df.filter("id % 5 = 0"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    want = set()
    for q in range(0, 300, 5):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:3]
        want |= {(q, n + 1, i, int(-score)) for n, (score, i) in enumerate(scored)}
    assert set(map(tuple, out.collect())) == want and out.count() == len(want)
    assert topk.ranges_of(0, 4096) == 1 and topk.ranges_of(30_000_000, 4096) == 458  # the driver samples per range


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline as p

    docs = table(spark, FOLDER, "documents")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns, name
        before, after = {r[0] for r in kept.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "near_duplicates":
            classes = brute_classes({r["doc_id"]: r for r in kept.collect()})
            assert after == set(classes.values())
        kept = spark.createDataFrame(out.collect(), docs.schema)
    final = p.STAGES[-1][1](spark, kept, FOLDER)
    assert {r["doc_id"] for r in final.collect()} == {r[0] for r in kept.select("doc_id").collect()}
    empty_docs = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty_docs, FOLDER).count() == 0


def test_near_duplicates_behind_a_leader(spark):
    """a is near its leader, b is near a only: the leaders do not bring them together."""
    texts = []
    for x in "adfghjk":
        own = [f"{x}{i}" for i in range(400)]
        a = own[:-1] + [f"{x}last"]
        b = a[:200] + [f"{x}v{i}" for i in range(40)] + a[240:]
        hub = [own] + [[f"{x}first{i}", *own[1:]] for i in range(30)]
        texts += [" ".join(w) for w in [*hub, a, b]]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: i // 33 * 33 for i in range(len(texts))}


def test_near_duplicates_of_few_words(spark):
    texts = []
    for n in (8, 9, 10, 13, 20, 40):
        own = [f"t{n}x{i}" for i in range(n)]
        texts += [" ".join(own), " ".join([*own, f"t{n}more"])]
    texts += ["a b c", "a b c d", "a b c d e", "a b c d e f"]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: i // 2 * 2 if i < 12 else i for i in range(len(texts))}


def test_pipeline_stages_give_their_space_back(spark, monkeypatch):
    import corpus_pipeline as p
    from statloom import session

    paths = []
    fresh = session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda *a: paths.append(fresh(*a)) or paths[-1])
    docs = odd(spark).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) AS n_chars")
    kept = p.kept_by(spark, "near_duplicates", p.one_of_each, docs, "")
    assert kept.count() == p.one_of_each(spark, docs, "").count()
    own = paths[:next(i for i, x in enumerate(paths) if "numbered" in x and i)]
    assert own and all(spark.read.parquet(x).columns == ["nothing"] for x in own)


def test_one_of_each_keeps_two_tables_and_one_plan(spark, monkeypatch):
    """The choice of rows gives its tables and shuffles back before the rows are read again, and what stays is not broadcast, however few rows there are."""
    import corpus_pipeline as p
    from statloom import session

    paths, freeing = [], []
    fresh = session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda *a: freeing.append(spark.conf.get(session.FREE_SHUFFLES, "false")) or paths.append(fresh(*a)) or paths[-1])
    before = spark.conf.get(session.FREE_SHUFFLES, "false")
    docs = odd(spark).selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "length(text) AS n_chars")
    made = p.one_of_each(spark, docs, "")
    left = [x for x in paths if spark.read.parquet(x).columns != ["nothing"]]
    assert len(left) == 2 and "numbered" in left[0] and "kept" in left[1]
    assert set(freeing[2:]) == {"true"} and spark.conf.get(session.FREE_SHUFFLES, "false") == before
    assert made.count() == spark.read.parquet(left[1]).count()
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_shuffles_inside_scratch_leave_no_files(spark, tmp_path):
    """The blocks of a shuffle are gone after the write that needed it; outside they stay until the garbage is collected."""
    from statloom.session import cut, scratch

    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum(1 for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles()) if f.getName().startswith("shuffle_"))

    with scratch(spark):
        began = files()
        assert cut(spark.range(1000).repartition(7, "id").groupBy("id").count(), "dealt").count() == 1000
        deadline = time.time() + 20
        while files() > began and time.time() < deadline:
            time.sleep(0.1)
        assert files() <= began
