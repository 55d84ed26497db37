"""Byte-pair encoding through a minimal acyclic transducer, and decoding.

The corpus' pre-tokens are counted whole; those whose share reaches `floor` (at most 1/floor of them) are encoded by exact merging and
compiled into an automaton that shares prefixes and suffixes. Arcs carry numbers; their sum along a word is the word's place in
the id table, so the automaton is a transducer from words to ids. It is a flat file image: sorted arc keys, arc numbers, final marks and the id
table. A task maps it into memory and walks many words at once by binary search; words it does not have are merged exactly.

The vocabulary file is a parameter; executors must be able to read it. Special tokens in a text are found first and get their ids, as the file
asks. Decoding joins the tokens' bytes and reads them as UTF-8, with replacement marks where an id list cuts a character.

Defined cases: null and empty texts have no ids and decode to the empty text. Texts of any length, and words of any length (merged with a heap),
are encoded whole. Repeated rows get a row each, an empty table none. Ties between
merges: by rank, then from the left. Columns beyond text and those to keep are not read.
"""

from __future__ import annotations

import heapq
import json
import mmap
import tempfile
from collections import Counter
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import arrow_rows, count_in_tasks

# The pattern that splits text before merging: a fixed value of this kind of vocabulary. Letters come first, being most frequent; no two of the first
# three ways can start at the same place.
PATTERN = r""" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FLOOR = 2e-6
CACHE = 300_000
# Words of up to so many bytes are merged without a heap.
FEW = 64
# Words of up to so many bytes are merged many at a time.
SHORT = 32
# Numbers that are looked up at a time.
MANY = 1 << 16
# No merge: above every rank and id.
NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (n, self.ids[raw(a + b)]) for n, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        # the same as whole numbers: both ids in the key, rank and made id in the value, so the smallest value is the next merge
        self.packed = {a << 32 | b: n << 32 | made for (a, b), (n, made) in self.ranks.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.bytes, np.int64)
        self.pair_keys = np.array(sorted(self.packed), np.int64) if self.packed else np.array([-1], np.int64)
        self.pair_values = np.array([self.packed.get(k, NONE) for k in self.pair_keys.tolist()], np.int64)
        self.byte_pairs = self._next(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pieces = regex.compile(PATTERN).findall

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand among them as they are, with a leading NUL NUL mark."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.split_special(text)):
            if i % 2:
                out.append("\0\0" + part)
            elif part:
                out.extend(self.pieces(part))
        return out

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact merging: the lowest-ranked pair first, leftmost among equals."""
        if word.startswith("\0\0") and word[2:] in self.special:
            return (self.special[word[2:]],)
        ids = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        return tuple(ids) if len(ids) < 2 else self.merge_few(ids) if len(ids) <= FEW else self.merge_many(ids)

    def merge_few(self, ids: list[int]) -> tuple[int, ...]:
        """By looking through all pairs for each merge: the faster way for a word of usual length."""
        packed, none = self.packed, NONE
        pairs = [packed.get(a << 32 | b, none) for a, b in pairwise(ids)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = packed.get(ids[i - 1] << 32 | ids[i], none)
            if i < len(pairs):
                pairs[i] = packed.get(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """As `merge`, for many words at once: each round makes the next merge of every word that has one."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, c in enumerate(coded) if 1 < len(c) <= SHORT and not c.startswith(b"\0\0")]
        short.sort(key=lambda i: len(coded[i]))  # words of one length make narrow tables
        out: list[tuple[int, ...] | None] = [None] * len(words)
        for start in range(0, len(short), 2048):
            part = short[start:start + 2048]
            for i, ids in zip(part, self._merge_short([coded[i] for i in part]), strict=True):
                out[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _next(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and made id of pairs, NONE where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def _merge_short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, size = len(words), int(lengths.max())
        letters = np.zeros((n, size + 1), np.int64)
        real = np.arange(size + 1) < lengths[:, None]
        letters[real] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(real, self.byte_ids[letters], -1)
        pairs = np.full((n, size + 1), NONE)  # of each place with the next one that is left; the last column is never a pair
        pairs[:, :-1] = np.where(real[:, 1:], self.byte_pairs[letters[:, :-1], letters[:, 1:]], NONE)
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = pairs[rows].argmin(1)  # leftmost among equals
            best = pairs[rows, at]
            going = best != NONE
            rows, at, best = rows[going], at[going], best[going]
            gone = after[rows, at]
            follow = after[rows, gone]
            made = best & 0xFFFFFFFF
            ids[rows, at], ids[rows, gone], pairs[rows, gone] = made, -1, NONE
            after[rows, at], before[rows, np.minimum(follow, size)] = follow, at
            pairs[rows, at] = np.where(follow < lengths[rows], self._next(made, ids[rows, np.minimum(follow, size)]), NONE)
            led = before[rows, at] >= 0
            r, a, m = rows[led], at[led], made[led]
            lead = before[r, a]
            pairs[r, lead] = self._next(ids[r, lead], m)
        left = ids >= 0
        flat, ends = ids[left].tolist(), np.cumsum(left.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in pairwise([0, *ends])]

    def merge_many(self, ids: list[int]) -> tuple[int, ...]:
        """With a heap of pairs: for words of any length."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.ranks]
        heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else n
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in self.ranks:
                    rank, new = self.ranks[p]
                    heapq.heappush(heap, (rank, x, new, *p))
        return tuple(x for x in ids if x >= 0)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """Read once per Python process."""
    return Vocabulary(path)


def compile_words(table: dict[bytes, tuple[int, ...]]) -> bytes:
    """The minimal automaton of the words, with numbered arcs, as one flat image."""
    words = sorted(table)
    nodes: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]  # states of the last word
    last = b""

    def settle(down: int) -> None:
        """Replaces the last word's states below a depth by equal ones that exist."""
        for depth in range(len(path) - 1, down, -1):
            state = path.pop()
            form = (final[state], tuple(sorted(nodes[state].items())))
            same = register.setdefault(form, state)
            nodes[path[-1]][last[depth - 1]] = same

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        for byte in word[common:]:
            nodes.append({})
            final.append(False)
            nodes[path[-1]][byte] = len(nodes) - 1
            path.append(len(nodes) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    number: dict[int, int] = {0: 0}
    order = [0]
    for state in order:
        for _, child in sorted(nodes[state].items()):
            if child not in number:
                number[child] = len(order)
                order.append(child)
    ways: dict[int, int] = {}
    pending = [(0, False)]
    while pending:  # words below each state
        state, ready = pending.pop()
        if state in ways:
            continue
        if ready:
            ways[state] = final[state] + sum(ways[c] for c in nodes[state].values())
        else:
            pending.append((state, True))
            pending.extend((c, False) for c in nodes[state].values())
    keys, targets, outputs = [], [], []
    for state in order:
        before = int(final[state])
        for byte, child in sorted(nodes[state].items()):
            keys.append(number[state] * 256 + byte)
            targets.append(number[child])
            outputs.append(before)
            before += ways[child]
    ends = np.cumsum([len(table[w]) for w in words], dtype=np.int64)
    parts = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([final[s] for s in order], np.int64),
             np.concatenate([[0], ends]).astype(np.int64), np.array(list(chain.from_iterable(table[w] for w in words)), np.int64)]
    head = np.array([len(p) for p in parts], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Transducer:
    """A mapped image."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:  # goes with its last user
            f.write(image)
            f.flush()
            self.mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.mapped, np.int64, 6)
        at, parts = 48, []
        for size in sizes:
            parts.append(np.frombuffer(self.mapped, np.int64, int(size), at))
            at += 8 * int(size)
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def look_up(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        if not len(self.keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths > 0)
        step = 0
        while len(alive):
            key = state[alive] * 256 + raw[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            state[alive[~good]] = -1
            alive, at = alive[good], at[good]
            state[alive] = self.targets[at]
            total[alive] += self.outputs[at]
            step += 1
            alive = alive[lengths[alive] > step]
        known = (state >= 0) & (lengths > 0)
        known[known] = self.final[state[known]] == 1
        return [tuple(self.ids[self.starts[n]:self.starts[n + 1]].tolist()) if ok else None for ok, n in zip(known, total, strict=True)]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Pieces:
    """Short arrays laid end to end; `take` gives those of many numbers, joined in order."""

    def __init__(self, kind):
        self.flat, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def take(self, numbers: np.ndarray) -> np.ndarray:
        if len(numbers) > MANY:  # long texts in parts: the places take more room than what they point to
            return np.concatenate([self.take(numbers[i:i + MANY]) for i in range(0, len(numbers), MANY)])
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        done = np.cumsum(sizes)
        return self.flat[np.repeat(begin - (done - sizes), sizes) + np.arange(done[-1] if len(done) else 0)]


class Encoder:
    """Encodes and decodes texts; remembers words it has met."""

    def __init__(self, vocabulary: Vocabulary, image: bytes):
        self.vocabulary, self.transducer = vocabulary, Transducer(image)
        self.forget()
        self.digits = [str(i) for i in range(max(vocabulary.tokens) + 1)]
        token = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        self.token = Pieces(np.uint8)
        self.token.add(np.frombuffer(b"".join(token), np.uint8), np.array(list(map(len, token)), np.int64))

    def forget(self) -> None:
        self.number, self.known, self.shown = Numbers(), Pieces(np.int32), []

    def learn(self) -> None:
        """Encodes the words that have a number only."""
        new = list(islice(self.number, len(self.shown), None))
        if not new:
            return
        found = self.transducer.look_up([w.encode("utf-8", "surrogatepass") for w in new])
        other = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(other, self.vocabulary.merge_all([new[i] for i in other]), strict=True):
            found[i] = ids
        digits = self.digits
        self.shown.extend([",".join([digits[i] for i in ids]) for ids in found])
        self.known.add(np.array(list(chain.from_iterable(found)), np.int32), np.array(list(map(len, found)), np.int64))

    def encode_all(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """(ids, the ids in decimal joined by commas) per text."""
        return [(ids.tolist(), shown) for ids, shown in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        if len(self.number) > CACHE:
            self.forget()
        split = [list(map(self.number.__getitem__, self.vocabulary.pre_tokens(t))) if t else [] for t in texts]
        self.learn()
        return [(self.known.take(np.array(t, np.int64)), ",".join(map(self.shown.__getitem__, t))) for t in split]

    def decode(self, ids) -> str:
        return self.token.take(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(word, n): pre-tokens of all whole texts."""

    def make():
        split = vocabulary_of(vocabulary_path).pre_tokens
        seen: Counter = Counter()

        def feed(text):
            seen.update(split(text))

        def drain():
            rows = list(seen.items())
            seen.clear()
            return rows

        return feed, drain, lambda: len(seen)

    part = count_in_tasks(docs.select("text").filter("text IS NOT NULL"), make, "word string, n long", limit=400_000)
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary_path: str, floor: float = FLOOR) -> bytes:
    """The automaton of the frequent words; at most 1/floor words reach the driver."""
    from statloom.session import cut

    counts = cut(word_counts(docs, vocabulary_path), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    vocabulary = vocabulary_of(vocabulary_path)
    frequent = [r["word"] for r in counts.filter(F.col("n") >= max(1.0, total * floor)).select("word").collect()]
    return compile_words({w.encode(): vocabulary.merge(w) for w in frequent if not w.startswith("\0\0")})


def encode(docs: DataFrame, image: bytes, vocabulary_path: str, keep: list[str], finish=None, schema: str = "ids array<int>, decoded string") -> DataFrame:
    """keep, and ids and decoded text per row; finish(ids, shown, decoded) may put other columns of `schema` in their place."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = dict(docs.dtypes)
    whole = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema])
    out = to_arrow_schema(_parse_datatype_string(whole))
    sent = docs.sparkSession.sparkContext.broadcast(image)
    finish = finish or (lambda ids, shown, decoded: (ids, decoded))

    def run(batches):
        encoder = Encoder(vocabulary_of(vocabulary_path), sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part: pa.RecordBatch = batch.slice(start, 64)
                columns = [c.to_pylist() for c in part.columns]
                done = encoder.encode_arrays(columns[-1])
                rest = zip(*columns[:-1], strict=True) if len(columns) > 1 else [()] * len(done)
                yield arrow_rows([(*row, *finish(ids, shown, encoder.decode(ids))) for row, (ids, shown) in zip(rest, done, strict=True)], out)

    return docs.select(*keep, "text").mapInArrow(run, whole)
