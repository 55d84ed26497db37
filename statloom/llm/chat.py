"""Chat formatting with offset-aligned loss masks.

Conversations are rendered whole: every turn is `<|turn|>role<|text|>text<|end|>`, the three marks being special tokens of the tokenizer,
so no token crosses the border of a text. It is encoded once with offsets; the assistant texts' spans and the tokens' spans are
both sorted, and binary search finds the tokens of each span. Tokens never cross a pre-token either, so the library encodes each pre-token
once, and its ids are remembered; offsets follow from the tokens' lengths in bytes.

Control strings inside roles and texts (the marks, any `<|`, and the usual `<s>`, `</s>`, `[INST]`, `[/INST]`) get a backslash behind their
first character; a backslash that stands there already is doubled up by one more, so unescaping takes exactly one away.

Turns are put in order by ranges of (conversation, turn), and consecutive turns of a conversation are rendered and encoded together as one piece, which ends
with the conversation, with the range or before it exceeds `limit` characters. A conversation may have any number of rows: no task holds
more than a piece. The marks are special tokens, so pieces encode as the whole conversation does; their offsets count from their own start.

Defined cases: null text or role: empty. Turns are ordered by turn, then role, then a hash of the text; a null turn comes first, repeated turns all
stay. Rows with null conv_id form one conversation with a null id. Empty table: no rows. A very long text is encoded whole, in a piece of its
own. Columns beyond the four named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.bpe import PATTERN
from statloom.llm.common import arrow_rows, chunks

CACHE = 200_000
LIMIT = 1_000_000
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = ("assistant",)
# What counts as a control string: its first character, with or without backslashes behind it.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and starts and ends of the texts to learn from."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role in learned:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return made


def mask_of(token_starts: np.ndarray, token_ends: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """1 for tokens inside a span; tokens and spans sorted."""
    mask = np.zeros(len(token_starts) + 1, np.int64)
    first = np.searchsorted(token_ends, np.array(starts, np.int64), side="right")
    last = np.searchsorted(token_starts, np.array(ends, np.int64), side="left")
    some = last > first
    np.add.at(mask, first[some], 1)
    np.add.at(mask, last[some], -1)
    return (np.cumsum(mask)[:-1] > 0).astype(np.int8)


class OffsetEncoder:
    """Ids and offsets (code points) of whole texts, as the library gives them."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = tokenizer_of(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added.values(), key=len, reverse=True))) + ")").split
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)  # by id; a letter of a vocabulary entry stands for one byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(added[i].encode()) if i in added else len(token)

    def learn(self, words: list[str]) -> None:
        if len(self.known) >= CACHE:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        for word, encoded in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[word] = tuple(encoded.ids)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends). Tokens tile the text's bytes; a token that holds part of a character covers the whole of it."""
        words: list[str] = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                words.append(part)
            elif part:
                words.extend(self.pieces(part))
        self.learn(words)
        ids = np.array(list(chain.from_iterable(map(self.known.__getitem__, words))), np.int32)
        if not len(ids):
            return ids, ids, ids
        character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1
        after = np.cumsum(self.n_bytes[ids])
        return ids, character[after - self.n_bytes[ids]], character[after - 1] + np.int32(1)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped, run by run."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return "".join(unescape(formatted[starts[i]:ends[j - 1]]) for i, j in zip(turns[::2], turns[1::2], strict=True))


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, role, text, part): turns in order within parts, and parts in order. rows: conv_id, turn, role, text.

    The key of the ranges is short whatever the texts are, and rows of one key are dealt over several ranges.
    """
    text = F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("tie"),
                        F.monotonically_increasing_id().alias("row"))
    key = ["conv_id", "turn", "role", "tie", "row"]
    return turns.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "role", "text", F.spark_partition_id().alias("part"))


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)


OUTPUT = "formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<byte>"


def format_conversations(rows: DataFrame, tokenizer_path: str, learned: tuple[str, ...] = LEARNED, finish=None, schema: str = OUTPUT,
                         limit: int = LIMIT) -> DataFrame:
    """conv_id, part, piece, formatted, ids, starts, ends (token offsets in code points), mask (1: learn from this token): a conversation's pieces in the order of
    (part, piece). finish(formatted, ids, starts, ends, mask) may put other columns of `schema` in place of the last five."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    finish = finish or (lambda *made: made)
    schema = f"conv_id long, part int, piece long, {schema}"
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder(tokenizer_path)
        made: list[tuple] = []
        held: list[tuple[str, str]] = []
        number = size = waiting = 0
        conv = part = None

        def piece():
            formatted, first, last = render(held, learned)
            ids, starts, ends = encoder.encode(formatted)
            return conv, part, number, *finish(formatted, ids, starts, ends, mask_of(starts, ends, first, last))

        for conv_id, role, text, at in values(batches):
            here = len(role) + len(text)
            if held and (conv_id != conv or size + here > limit):
                made.append(piece())
                waiting += size
                held, number, size = [], number + 1, 0
                if waiting > limit or len(made) == 500:
                    yield arrow_rows(made, out)
                    made, waiting = [], 0
            conv, part, size = conv_id, at, size + here
            held.append((role, text))
        if held:
            made.append(piece())
        if made:
            yield arrow_rows(made, out)

    return in_order(rows).mapInArrow(run, schema)


def read_pieces(formatted: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> tuple[int, str, str, int]:
    """A finish of format_conversations: what is read back from a piece, in the columns PIECE."""
    turns = read_back(formatted)
    return len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), masked_text(formatted, starts, ends, mask), len(formatted)


PIECE = "n_turns long, turns string, loss string, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame) -> DataFrame:
    """A row of DIGESTS per conversation from its pieces of PIECE, which pass through one by one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(DIGESTS))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, sums = None, None

        def row():
            return conv, sums[0], turns_hash.hexdigest(), sums[1], loss_hash.hexdigest(), sums[2]

        for conv_id, n_turns, turns, loss, n_chars in values(batches):
            if sums is None or conv_id != conv:
                if sums is not None:
                    yield row()
                conv, sums, turns_hash, loss_hash = conv_id, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
            turns_hash.update(turns.encode())
            loss_hash.update(loss.encode())
            sums = [sums[0] + n_turns, sums[1] + len(loss), sums[2] + n_chars]
        if sums is not None:
            yield row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from chunks(fold(batches), out)

    together = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return together.select("conv_id", "n_turns", "turns", "loss", "formatted_chars").mapInArrow(run, DIGESTS)
