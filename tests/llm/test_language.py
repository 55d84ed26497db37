import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from statloom.llm import langid

ORDER = 5
rng = random.Random(3)
LETTERS = "abcdé𐐨"


def some_words(n, weights):
    return ["".join(rng.choices(LETTERS, weights, k=rng.randint(1, 6))) for _ in range(n)]


TEXTS = {"x": some_words(300, [5, 3, 1, 1, 1, 1]), "y": some_words(200, [1, 1, 4, 4, 2, 1])}


def plain(words):
    """The interpolated Kneser-Ney probability of a window, by the formula."""
    tables = {ORDER: Counter(p[i:i + ORDER] for w in words for p in ["\x02" * 4 + w + "\x03"] for i in range(len(p) - ORDER + 1))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, t in tables.items():
        n1, n2 = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d[k] = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        for g, c in t.items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]] += 1

    def p(window, base):
        value = base
        for k in range(1, ORDER + 1):
            g = window[-k:]
            if total[k, g[:-1]]:
                value = max(tables[k][g] - d[k], 0) / total[k, g[:-1]] + d[k] * kinds[k, g[:-1]] / total[k, g[:-1]] * value
        return value

    return p, d


@pytest.fixture(scope="module")
def model(spark):
    rows = [(lang, w) for lang, words in TEXTS.items() for w in words] + [(None, "zzz")]
    counted = langid.gram_counts(spark.createDataFrame(rows, "lang string, text string"))
    return counted, langid.fit(counted)


def test_discounts_come_from_all_counts(spark, model):
    got = {(r["lang"], r["k"]): r["d"] for r in langid.discounts(langid.levels(model[0])).collect()}
    want = {(lang, k): d for lang, words in TEXTS.items() for k, d in plain(words)[1].items()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)


def test_every_counted_gram_is_kept(spark, model):
    held = model[1].blocks.select("lang", F.explode("keys").alias("key"))
    grams = langid.levels(model[0]).select("lang", F.xxhash64("gram").alias("key")).distinct()
    assert grams.join(held, ["lang", "key"], "left_anti").count() == 0
    for r in model[1].blocks.collect():
        assert r["keys"] == sorted(set(r["keys"]))


def test_probabilities_equal_the_formula_and_sum_to_one(spark, model):
    characters = sorted(set(LETTERS) | {"\x03"})
    assert model[1].base == 1 / (len(characters) + 1)
    contexts = ["\x02" * 4, "\x02\x02\x02a", "abcd", "𐐨éaa", "qqqq", "aaqa"]
    asked = [c + x for c in contexts for x in [*characters, "?"]]
    got = {r["gram"]: r["p"] for r in model[1].probabilities(spark.createDataFrame([(g,) for g in asked], "gram string")).collect()}
    for i, lang in enumerate(model[1].langs):
        p, _ = plain(TEXTS[lang])
        for g in asked:
            assert math.isclose(got[g][i], p(g, model[1].base), rel_tol=1e-9), (lang, g)
        for c in contexts:  # `?` stands for all that was never seen
            assert math.isclose(sum(got[c + x][i] for x in [*characters, "?"]), 1, rel_tol=1e-9)


def test_words_and_texts_equal_the_formula(spark):
    rows = [(i, " ".join(words[j:j + 10]), lang) for i, (lang, words) in enumerate(TEXTS.items()) for j in range(0, len(words), 10)]
    rows += [(9, "abc " + "dé" * 1200 + " zz1a", "x"), (9, "abc", None)]
    docs = spark.createDataFrame(rows, "id int, text string, lang string")
    learned = F.col("id") < 9
    for common in (1e-6, 0.002, 2.0):  # all, some and no n-grams are sent to the tasks
        got = langid.identify(docs, learned, ["text"], common=common).collect()
        assert len(got) == len(rows)
        models = [plain(TEXTS[lang])[0] for lang in ("x", "y")]
        for r in got:
            found = langid.letter_words(r["text"])
            windows = [p[i:i + ORDER] for w in found for p in ["\x02" * 4 + w + "\x03"] for i in range(len(w) + 1)]
            nats = [-sum(math.log(p(g, 1 / 8)) for g in windows) / len(windows) for p in models]
            assert math.isclose(r["entropy"], min(nats), rel_tol=1e-9) and r["lang_pred"] == "xy"[nats.index(min(nats))]


def test_hashes_of_windows():
    text = "".join(rng.choices(LETTERS, k=3000))
    hashes = langid.window_hashes(text, ORDER)
    assert len(hashes) == len(text) - ORDER + 1
    by_gram = {text[i:i + ORDER]: h for i, h in enumerate(hashes.tolist())}
    assert all(by_gram[text[i:i + ORDER]] == h for i, h in enumerate(hashes.tolist())) and len(set(by_gram.values())) == len(by_gram)
    assert len(langid.window_hashes("abc", ORDER)) == 0


@pytest.mark.parametrize("share", [0.02, 0.3, 0.6])
def test_foreign_texts_are_rejected_whatever_their_share(spark, share):
    known = ["".join(rng.choices("abcde", k=3)) + "en" for _ in range(60)]
    own = [(i, " ".join(rng.choices(known, k=30)), "en") for i in range(200)]
    foreign = [(1000 + i, " ".join("".join(rng.choices("vwxyzq", k=5)) for _ in range(30)), None) for i in range(int(200 * share / (1 - share)))]
    docs = spark.createDataFrame(own + foreign, "id int, text string, lang string")
    got = langid.identify(docs, F.col("id") < 150, ["id"]).collect()
    assert all(r["rejected"] for r in got if r["id"] >= 1000)
    assert sum(r["rejected"] for r in got if r["id"] < 1000) <= 4


def test_letter_words_are_letter_runs_without_a_pattern_for_plain_words(monkeypatch):
    """Runs are those of the pattern, for every character; the pattern is only asked for parts that hold something else than letters."""
    pattern = langid.LETTERS
    samples = [t for c in range(0x11000) for t in (chr(c), f"a{chr(c)}B", f"é{chr(c)}Σ {chr(c)}")]
    for text in samples:
        runs = pattern.findall(text.lower())
        assert langid.letter_words(text) == (runs if any(c.isalpha() for w in runs for c in w) else [])
    asked = []

    class Watched:
        def findall(self, text):
            asked.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(langid, "LETTERS", Watched())
    assert langid.letter_words("It's 3_rd\tÉtude,ÉTÉ x y ab—cd") == ["it", "s", "rd", "étude", "été", "x", "y", "ab", "cd"]
    assert asked == ["ab—cd"]


ODD = [("x", "½ ²"), (None, "½a"), ("y", ""), ("y", "İSTANBUL ΟΔΟΣ 3_a 漢字 𐐨b"), ("x", "a" * 700), (None, " a\n\n"), ("x", "\x02\x03 b\x00c"), ("y", "a")]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_windows_are_read_and_counted_without_words(monkeypatch, piece):
    """Pieces cut texts and words anywhere; counts, hashes and owners stay those of the words, none of which becomes a Python value."""
    rows = ODD + [(lang, " ".join(words)) for lang, words in TEXTS.items()]
    want = Counter((lang, p[i:i + ORDER]) for lang, text in rows for w in langid.letter_words(text) for p in ["\x02" * 4 + w + "\x03"] for i in range(len(w) + 1))
    windows = [[p[i:i + ORDER] for w in langid.letter_words(text) for p in ["\x02" * 4 + w + "\x03"] for i in range(len(w) + 1)] for _, text in rows]
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "letter_words", None)
    counts = langid.Counts(ORDER)
    for _ in range(2):  # a drained table starts anew
        for row in rows:
            counts.feed(*row)
        assert {(lang, gram): n for lang, gram, n in counts.drain()} == want and counts.size() == 0
    got = [[] for _ in rows]
    for codes, at, hashes, owners, sizes in langid.read([text.lower() for _, text in rows], ORDER):
        assert len(codes) == sum(len(text.lower()) + 1 for _, text in rows) and sizes.sum() == len(at) == len(hashes)
        for owner, part in zip(range(len(rows))[owners], langid.np.split(hashes, sizes.cumsum()[:-1]), strict=True):
            got[owner] += part.tolist()
    assert got == [langid.window_hashes("".join(w), ORDER)[::ORDER].tolist() for w in windows]
    assert [len(some) for some in langid.read([], ORDER)] == []


def test_characters_of_runs_are_those_of_the_pattern():
    kinds, _ = langid.code_points()
    assert all((kinds[c] > 0) == bool(langid.LETTERS.match(chr(c))) and (kinds[c] == 2) == chr(c).isalpha() for c in range(0x110000))


def test_a_task_emits_an_n_gram_once_however_many_words_hold_it(spark):
    """A task's table holds n-grams, so many different words of few n-grams do not fill it."""
    counts = langid.Counts(ORDER)
    words = ["".join(w) for w in itertools.product("ab", repeat=12)]
    for start in range(0, len(words), 64):
        counts.feed("x", " ".join(words[start:start + 64]))
    emitted = list(counts.drain())
    assert len(emitted) == len({g for _, g, _ in emitted}) == 2 + 4 + 8 + 16 + 32 + 16 and sum(n for _, _, n in emitted) == 13 * len(words)


def test_places_number_every_key_once():
    random_keys = langid.np.random.default_rng(1)
    keys = langid.np.unique(random_keys.integers(-2**63, 2**63 - 1, 30_000))
    crowded = langid.np.arange(5000)  # all of one home slot
    places = langid.Places()
    assert places.find(keys[:3]).tolist() == [-1, -1, -1]
    for part in (keys[:10], crowded, keys[10:]):
        assert places.find(part[part > 5000]).max(initial=-1) == -1
        assert places.add(part).tolist() == list(range(places.size - len(part), places.size))
    assert places.find(langid.np.concatenate([keys[:10], crowded, keys[10:]])).tolist() == list(range(places.size))
    assert (places.find(crowded + 10_000) == -1).all()
