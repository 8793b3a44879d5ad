"""Operator 2: secret scans.

An Aho-Corasick automaton finds keywords in each text; regular expressions are tried only at
the places it names, anchored there, so the cost does not depend on their number. Tokens whose
format carries a checksum are reported only when it holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks

#: Kinds in the order in which spans with the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "iban", "card")
BASE_KINDS = KINDS[:3]

# What the base kinds match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Public token formats with an embedded checksum.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
IBAN = re.compile(r"iban\W{0,4}([a-z]{2}[0-9]{2}(?:\x20?[0-9a-z]){11,30})(?![0-9a-z])", re.ASCII | re.IGNORECASE)
IBAN_HEAD = re.compile(r"iban\W{0,4}([a-z]{2})[0-9]{2}", re.ASCII | re.IGNORECASE)
CARDS = [
    re.compile(rf"card\W{{0,4}}((?:[0-9][\x20-]?){{{digits - 1}}}[0-9])(?![0-9])", re.ASCII | re.IGNORECASE)
    for digits in range(19, 12, -1)
]
#: Characters of an account number by country (ISO 13616 registry).
IBAN_LENGTHS = {
    country: int(size) for size, countries in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
        "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    )) for country in countries.split()
}
IBANS = {
    size: re.compile(rf"iban\W{{0,4}}([a-z]{{2}}[0-9]{{2}}(?:\x20?[0-9a-z]){{{size - 4}}})(?![0-9a-z])", re.ASCII | re.IGNORECASE)
    for size in set(IBAN_LENGTHS.values())
}


def crc_holds(found: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    body, check = found.group(1), found.group(2)
    value = 0
    for character in check:
        value = value * 62 + BASE62.index(character)
    return value == zlib.crc32(body.encode())


def iban_holds(found: re.Match) -> bool:
    """ISO 13616: the rotated account number is 1 modulo 97."""
    account = found.group(1).replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def luhn_holds(found: re.Match) -> bool:
    """Every second digit from the right doubled, the digit sum is 0 modulo 10."""
    digits = [int(c) for c in reversed(found.group(1)) if c.isdigit()]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


@lru_cache(maxsize=1)
def automata():
    """One automaton over the text with A-Z lowered, one over the text as it is.

    Of a run of 24 or more hexadecimal digits the first four are a keyword of the second, so
    every run is met at its start.
    """
    import ahocorasick

    folded, exact = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        folded.add_word(word, ("assign", len(word)))
    for word in ("iban", "card"):
        folded.add_word(word, (word, len(word)))
    exact.add_word("AKIA", ("access", 4))
    exact.add_word("npm_", ("npm", 4))
    for letter in "pousr":
        exact.add_word(f"gh{letter}_", ("github", 4))
    for digits in product("0123456789abcdef", repeat=4):
        exact.add_word("".join(digits), ("hex", 4))
    folded.make_automaton()
    exact.make_automaton()
    return folded, exact


def iban_patterns(text: str, start: int) -> list[re.Pattern]:
    """The pattern of the country's length; for a country not in the registry, the longest that is there."""
    head = IBAN_HEAD.match(text, start)
    if not head:
        return []
    size = IBAN_LENGTHS.get(head.group(1).upper())
    return [IBANS[size] if size else IBAN]


#: By kind: the anchored patterns in the order in which they are tried, and what a match must hold.
RULES: dict[str, tuple[Callable[[str, int], list[re.Pattern]], Callable[[re.Match], bool]]] = {
    "assign": (lambda text, start: [ASSIGN], lambda m: len(m.group(2)) >= ASSIGN_LEAST),
    "access": (lambda text, start: [ACCESS], lambda m: len(m.group()) >= ACCESS_LEAST),
    "hex": (lambda text, start: [HEX], lambda m: len(m.group()) >= HEX_LEAST),
    "github": (lambda text, start: [GITHUB], crc_holds),
    "npm": (lambda text, start: [NPM], crc_holds),
    "iban": (iban_patterns, iban_holds),
    "card": (lambda text, start: CARDS, luhn_holds),
}


def hits(text: str) -> Iterator[tuple[int, str]]:
    """``(start, kind)`` of keywords; starts of one kind ascend."""
    folded, exact = automata()
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for automaton, body in ((folded, lowered), (exact, text)):
        for end, (kind, length) in automaton.iter(body):
            yield end - length + 1, kind


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind; code points, end exclusive.

    Matches of a kind are leftmost and do not overlap. Of the base kinds, one that fails its test
    still takes its text; of the others it takes none. A card number is the longest of 13 to 19
    digits that ends where a group does and holds. Spans of different kinds may overlap.
    """
    last, spans = dict.fromkeys(KINDS, 0), []
    for start, kind in hits(text or ""):
        if start < last[kind]:
            continue
        patterns, holds = RULES[kind]
        for pattern in patterns(text, start):
            found = pattern.match(text, start)
            if found and holds(found):
                last[kind] = found.end()
                spans.append((kind, start, found.end()))
                break
            if found and kind in BASE_KINDS:
                last[kind] = found.end()
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str | None, spans: list[tuple[str, int, int]], mask: str) -> str | None:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    start, end = spans[0][1:]
    for _, a, b in [*spans[1:], ("", len(text) + 1, 0)]:
        if a >= end:
            out += [text[at:start], mask]
            at, start, end = end, a, b
        end = max(end, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: ``(id_col, spans)``, spans as ``find_spans`` orders them.

    A null or empty text has none. Rows map one to one, repeated rows and null keys included;
    other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(keys, texts):
            return {"k": keys, "spans": [
                [{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text)] for text in texts
            ]}

        return run

    out = map_blocks(docs.select(F.col(id_col), F.col(text_col)), f"k {key}, spans {SPANS}", make)
    return out.withColumnRenamed("k", id_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked; all rows and other columns stay.

    Null and empty texts stay as they are.
    """

    def make():
        def run(*columns):
            values = dict(zip(names, columns))
            values[inner] = [masked(t, find_spans(t), mask) for t in values[inner]]
            return values

        return run

    # positions instead of names, so that columns of any name pass
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = names[docs.columns.index(text_col)]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    return map_blocks(docs.toDF(*names), ddl, make).toDF(*docs.columns)
