"""License scan: Aho-Corasick over words for notice phrases and over the text for identifier tags, expressions by shunting-yard.

Phrases are found where their words stand one after the other. A tag (`SPDX-License-Identifier:` and the like) is followed by an
expression of identifiers with AND, OR, WITH and parentheses; it is put into postfix order with two stacks and evaluated over a stack: to the licences it
names, and to whether a set of licences satisfies it. Alternatives are never multiplied out. The expression ends at the line's end, a comment's end or
where it stops being one. Identifiers are those of known families and LicenseRef- ones; other words behind a tag are kept apart and give no label.

Defined cases: null and empty texts have no words, no places and empty labels. Overlapping phrases all count. A tag whose
expression is broken gives the identifiers read before the break. Ties need no rule: labels are sets in order. Very long texts and expressions are read whole,
in one pass. Repeated rows get a row each, an empty table none. Columns beyond text and those to keep are not read, whatever they are named.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from statloom.llm.common import lower_ascii, map_rows, words

# Phrases and the labels they stand for: fixed values of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Identifier prefixes (lower case) and their family's label; the longest prefix counts.
FAMILIES = {
    "agpl": "agpl", "apache": "apache", "artistic": "artistic", "bsd": "bsd", "bsl": "bsl", "cc-by": "cc-by", "cc0": "cc0", "epl": "epl",
    "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl", "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib",
}
OWN = "licenseref-"
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")
_TOKEN = re.compile(r"[ \t]*(?:(\()|(\))|([a-z0-9][a-z0-9.+:-]*))")
_POWER = {"with": 3, "and": 2, "or": 1}


def tokens(text: str) -> list[str]:
    """Tokens of the expression at the start of a text, as far as it can be one."""
    out: list[str] = []
    at, depth = 0, 0
    operand = True  # what must come next
    while m := _TOKEN.match(text, at):
        t = m.group().strip()
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t in _POWER and not operand:
            operand = True
        elif t not in ("(", ")") and t not in _POWER and operand:
            operand = False
        else:
            break
        out.append(t)
        at = m.end()
    while out and (out[-1] in _POWER or out[-1] == "("):  # nothing stands behind these
        out.pop()
    return out


def postfix(infix: list[str]) -> list[str]:
    """Shunting-yard: WITH binds before AND, AND before OR."""
    out: list[str] = []
    waiting: list[str] = []
    for t in infix:
        if t in _POWER:
            while waiting and waiting[-1] != "(" and _POWER[waiting[-1]] >= _POWER[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            out.append(t)
    return out + [t for t in reversed(waiting) if t != "("]


def satisfied(order: list[str], held: set[str]) -> bool:
    """Whether licences satisfy an expression in postfix order; an exception (WITH) asks for no licence."""
    stack: list[bool] = []
    for t in order:
        if t not in _POWER:
            stack.append(t in held)
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            stack.append(left if t == "with" else left and right if t == "and" else left or right)
    return stack[-1] if stack else False


def evaluate(order: list[str]) -> list[frozenset[str]]:
    """The choices an expression leaves, multiplied out: each a set of licences that hold together. For short expressions; a scan does without."""
    stack: list[list[frozenset[str]]] = []
    for t in order:
        if t not in _POWER:
            stack.append([frozenset([t])])
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            both = left if t == "with" else left + right if t == "or" else [a | b for a in left for b in right]
            stack.append(list(dict.fromkeys(both)))
    return stack[-1] if stack else []


def licences(order: list[str]) -> set[str]:
    """The licences that an expression in postfix order names, exceptions left out."""
    stack: list[set[str]] = []
    for t in order:
        if t not in _POWER:
            stack.append({t})
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if t == "with":
                stack.append(left)
            else:  # the smaller into the larger one
                few, many = sorted((left, right), key=len)
                many |= few
                stack.append(many)
    return stack[-1] if stack else set()


def family(identifier: str) -> str | None:
    """Label of an identifier; None for a word that is none."""
    if identifier.startswith(OWN) and len(identifier) > len(OWN):
        return identifier
    found = [f for f in FAMILIES if identifier.startswith(f) and not identifier[len(f):len(f) + 1].isalpha()]
    return FAMILIES[max(found, key=len)] if found else None


class Scanner:
    def __init__(self, phrases: dict[str, str], tags: tuple[str, ...]):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in phrases.items():
            self.phrases.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 2, label))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in tags:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, list[str]]]]:
        """Number of words, phrase places (word number, label), and expressions (character behind the tag, postfix order)."""
        found = words(text)
        places: list[tuple[int, str]] = []
        if found:
            line = " " + " ".join(found) + " "
            seen = number = 0
            for end, (_, size, label) in self.phrases.iter(line):
                start = end - size + 1
                if start >= seen:
                    number += line.count(" ", seen, start)
                    seen = start
                    places.append((number, label))
                else:
                    places.append((number - line.count(" ", start, seen), label))
        expressions = []
        if text and ":" in text:
            low = lower_ascii(text)
            for end, _ in self.tags.iter(low):
                stop = low.find("\n", end + 1)
                behind = low[end + 1:stop if stop >= 0 else len(low)]
                expressions.append((end + 1, postfix(tokens(behind))))
        return len(found), places, expressions


def scan(docs: DataFrame, keep: list[str], phrases: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """keep, and n_words, starts and base (places and labels of phrases), expressions (postfix order, per tag that names a licence), unknown (words behind
    tags that are no identifiers), labels, score.

    score: 1 for an expression that names a licence, 0.9 for a phrase, 0 without either.
    """
    phrases = PHRASES if phrases is None else phrases
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + (
        ", n_words long, starts array<long>, base array<string>, expressions array<array<string>>, unknown array<string>, labels array<string>, score double")

    def make():
        scanner = Scanner(phrases, tags)

        def f(*row):
            n, places, expressions = scanner.scan(row[-1])
            base = sorted({label for _, label in places})
            read, more, unknown = [], set(), set()
            for _, order in expressions:
                named = {x: family(x) for x in licences(order)}
                if any(named.values()):
                    read.append(order)
                more |= {label for label in named.values() if label}
                unknown |= {x for x, label in named.items() if not label}
            score = 1.0 if read else 0.9 if places else 0.0
            return (*row[:-1], n, [p for p, _ in places], base, read, sorted(unknown), sorted({*base, *more}), score)

        return f

    return map_rows(docs.select(*keep, "text"), make, schema)
