"""The operators' plain parts against brute force."""

import random

import numpy as np
import pytest

from statloom.llm import bpe, chat, html, langid, licenses, neardup, quality, topk, toxicity
from statloom.llm.queries import vocabulary_path

random.seed(5)
ODD = ["", " ", "  a\n\n b ", "It's 12 o'clock, don't!", "ü" * 300, "a" * 3000, "日本語 text 🙂🙂", "x<|endoftext|>y <|endoftext|>", "\0\0<|endoftext|>", "   \x85\x1c z", "ﬁ²½ٱ",
       "<|endoftext|>", "'sS 'll'LL"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    tok.no_padding()
    tok.no_truncation()
    v = bpe.vocabulary_of(vocabulary_path())
    texts = ODD + ["".join(random.choice(" \n\taeé'sD1$<|>") for _ in range(random.randint(0, 60))) for _ in range(300)]
    frequent = {w for t in texts[::2] for w in v.pre_tokens(t) if not w.startswith("\0\0")}
    encoder = bpe.Encoder(v, bpe.compile_words({w.encode(): v.merge(w) for w in frequent}))
    for text, (ids, shown) in zip(texts, encoder.encode_all(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert shown == ",".join(map(str, want))
        assert encoder.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_many_words_merge_as_one_by_one(monkeypatch):
    v = bpe.vocabulary_of(vocabulary_path())
    words = ["".join(random.choice("abehinorst éß漢\ud800") for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["\0\0" + s for s in v.special]
    assert v.merge_all(words) == [v.merge(w) for w in words]
    assert v.merge_all([]) == []
    # an encoder does not merge its new words one by one, forgets when it has many, and takes long texts in parts
    usual = [w for w in words if len(w.encode("utf-8", "surrogatepass")) in range(2, bpe.SHORT) and "\ud800" not in w and "\0" not in w]
    want = [[i for w in v.pre_tokens(t) for i in v.merge(w)] for t in usual]
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "MANY", 7)
    monkeypatch.setattr(v, "merge_few", None)
    encoder = bpe.Encoder(v, bpe.compile_words({}))
    got = [ids for start in range(0, len(usual), 64) for ids, _ in encoder.encode_all(usual[start:start + 64])]
    assert got == want and [encoder.decode(i) for i in got] == usual


def test_bpe_splits_every_character_as_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    v = bpe.vocabulary_of(vocabulary_path())
    wrong = []
    for start in range(1, 0x30000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        pieces = [i for w in v.pre_tokens(text) for i in v.merge(w)]
        if pieces != tok.encode(text, add_special_tokens=False).ids:
            wrong.append(start)
    assert not wrong


def test_transducer_shares_suffixes_and_keeps_outputs():
    table = {w.encode(): (i, i + 1) for i, w in enumerate(["walking", "talking", "walked", "talked", "talk", "ing", ""]) if w}
    t = bpe.Transducer(bpe.compile_words(table))
    assert t.look_up([*table, b"tal", b"walkings", b""]) == [*table.values(), None, None, None]
    assert len(t.final) < sum(map(len, table))
    assert bpe.Transducer(bpe.compile_words({})).look_up([b"a"]) == [None]


def test_chat_escape_is_reversible():
    parts = ["<|", "<\\|", "</s>", "[INST]", "[/INST]", "\\", "<", "|", "x", "<|end|>", "<s>", "<|text|>"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(x in escaped for x in ("<|", "</s>", "[INST]", "[/INST]"))
        formatted, starts, ends = chat.render([("user", text), ("assistant", text), (text, "b")])
        assert chat.read_back(formatted) == [("user", text), ("assistant", text), (text, "b")]
        assert chat.unescape(formatted[starts[0]:ends[0]]) == text


def test_mask_covers_whole_spans_only():
    starts, ends = np.array([0, 3, 5, 5, 9]), np.array([3, 5, 9, 9, 12])
    assert chat.mask_of(starts, ends, [3], [9]).tolist() == [0, 1, 1, 1, 0]
    assert chat.mask_of(starts, ends, [5, 9], [5, 12]).tolist() == [0, 0, 0, 0, 1]
    assert chat.mask_of(starts[:0], ends[:0], [], []).tolist() == []


def test_remembered_pieces_encode_as_the_library():
    path = vocabulary_path()
    encoder = chat.OffsetEncoder(path)
    parts = [chat.TURN, chat.TEXT, chat.END, "<\\|end|>", " it's", "naïve", "日本語", "🙂🙃", "  \n\n", "\t", " 12345", "''s", "<|endoftext|>", "…—", "\x00", "e\u0301", " "]
    for _ in range(500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        whole = encoder.tokenizer.encode(text, add_special_tokens=False)
        ids, starts, ends = encoder.encode(text)
        assert ids.tolist() == whole.ids
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


def test_license_expressions():
    run = lambda s: [sorted(c) for c in licenses.evaluate(licenses.postfix(licenses.tokens(s)))]
    assert run(" mit or apache-2.0 and bsd-3-clause */") == [["mit"], ["apache-2.0", "bsd-3-clause"]]
    assert run("(mit or apache-2.0) and isc") == [["isc", "mit"], ["apache-2.0", "isc"]]
    assert run("gpl-2.0-only with classpath-exception-2.0 or mit") == [["gpl-2.0-only"], ["mit"]]
    assert run("((mit") == [["mit"]]
    assert run("and or") == []
    assert run("mit and (") == [["mit"]]
    assert run("") == []


def test_aligned_against_plain_dynamic_programming():
    known = neardup.Hashes()
    for _ in range(200):
        a = [random.choice("abcdefghijklmnop") + str(random.randint(0, 30)) for _ in range(random.randint(5, 60))]
        b = list(a)
        for _ in range(random.randint(0, 3)):
            b[random.randrange(len(b))] = "zz"
        if random.random() < 0.3:
            b = b[3:] + b[:3]
        x, y = neardup.labelled_kmers(a, known).tolist(), neardup.labelled_kmers(b, known).tolist()
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1, j + 1] = best[i, j] + 1 if p == q else max(best[i, j + 1], best[i + 1, j])
        similarity = best[-1, -1] / (len(x) + len(y) - best[-1, -1])
        got = neardup.aligned(np.array(x, np.uint64), np.array(y, np.uint64))
        assert got == (pytest.approx(similarity) if similarity >= 0.8 else 0.0)


def test_short_texts_are_one_kmer():
    known = neardup.Hashes()
    assert len(neardup.labelled_kmers(["a", "b"], known)) == 1
    assert neardup.labelled_kmers(["a", "b"], known) != neardup.labelled_kmers(["b", "a"], known)


def test_matcher_finds_one_edit():
    m = toxicity.Matcher({"idiot": 9.0, "scum": 8.0}, {"vequ": 7.0})
    for word in ("idiot", "idiots", "idot", "xidiot", "idi0t", "ldiot"):
        assert m.look(word)[0] == "idiot", word
    assert m.look("vequabc") == ("vequ", 7.0, False)
    for word in ("idxxt", "scam", "veq", "diots", "radio"):
        assert m.look(word) is None, word
    assert toxicity.Matcher({"idiot": 9.0}, {}, frozenset({"idot"})).look("idot") is None


def test_matcher_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = {"abcab": 1.0, "abbac": 1.0, "ccabb": 1.0}
    m = toxicity.Matcher(terms, {})
    for _ in range(5000):
        word = "".join(random.choice("abcd") for _ in range(random.randint(4, 7)))
        assert (m.look(word) is not None) == (min(distance(word, t) for t in terms) <= 1), word


def test_quotation_weighs_less():
    m = toxicity.Matcher({"idiot": 9.0}, {})
    strong = toxicity.features(*toxicity.hits("you idiot there", m))
    weak = toxicity.features(*toxicity.hits('he wrote "you idiot" there', m))
    assert weak[0] < strong[0]
    assert toxicity.hits(None, m) == (0, [])


def test_html_cases():
    weights = {}
    page = ('<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a>menu words here</a></nav><div class="sidebar">side <b>bar</b></div>'
            '<article><h1>Head</h1><p>One<b>two</b> three<br>four &amp; &eacute;<script>var t="</p>";</script><aside>skip me</aside><form>no <input> no</form><p>Last'
            '<div class="comments"><p>bad comment</p></div></article><div class="cookie-notice">accept all of it</div><footer>foot &copy;</footer>')
    assert html.extract(page, weights) == "Head Onetwo three four & é Last"
    for odd in (None, "", "<", "<p", "&amp", "<script>", "<article></article>", "<!-- x", "</p></p>", "<p>a<b", "<nav>x</nav>"):
        html.extract(odd, weights)
    assert html.extract("plain text", weights) == "plain text"
    assert html.extract("<article>a &amp", weights) == "a &"
    assert html.extract(None, weights) == ""
    assert html.extract("<nav>only menu</nav>", weights) == ""
    assert html.extract("<body><nav>a b c d</nav><div><p>some words of a page without any article element</p></div><footer>x y z</footer>", weights) == \
        "some words of a page without any article element"


def test_trees_fit_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = trees.score(x[:50])
    for i in range(50):  # node by node
        total = trees.base
        for f, c, leaf in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > c[node])
            total += leaf[node - len(f)]
        assert one[i] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "!" * 5000, "The The The", "\0", "é 🙂"])
def test_statistics_are_finite(text):
    got = quality.statistics(text)
    assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()


def test_search_prunes_exactly():
    rng = np.random.default_rng(2)
    for scale in (50, 10 ** 12):
        matrix = np.floor(rng.normal(size=(700, 6)) * scale)
        matrix[100:200] = matrix[0]
        ids = rng.permutation(700).astype(np.int64)
        queries = np.vstack([matrix[:5], np.zeros((1, 6))])
        for n, got, score in topk.search(ids, matrix, np.array([*ids[:5], -1]), queries, 10, block=32):
            exact = [sum(int(a) * int(b) for a, b in zip(row, queries[n], strict=True)) for row in matrix]
            exact = [min(max(s, topk._LOW), topk._HIGH) for s in exact]
            own = ids[n] if n < 5 else -1
            want = sorted((-s, i) for s, i in zip(exact, ids.tolist(), strict=True) if i != own)[:10]
            assert list(zip((-score).tolist(), got.tolist(), strict=True)) == want


def test_letters_decide():
    assert langid.letter_words("½ ² 12 _") == []
    assert langid.letter_words("Ab1c") == ["ab", "c"]
    assert langid.letter_words(None) == []
