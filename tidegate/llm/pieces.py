"""Byte-level BPE over texts of any length: split at safe boundaries, merge each chunk once.

The split pattern of byte-level BPE never lets a match run from a visible character into white
space, and nothing in it looks back. So every place before white space that follows a visible
character is a match boundary, whatever stands around it: ids of the text are the ids of such
parts, one after another. That bounds what one call of a tokenizer sees, lets a worker merge
each distinct word once, and keeps long white-space runs, on which backtracking patterns
overflow, away from the pattern.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters of \\s in the split pattern (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARACTERS = [chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))]
#: A safe boundary: white space after a visible character.
BOUNDARY = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: What a space that does not follow a visible character looks like; cutting there is not safe.
UNSAFE = [space + " " for space in SPACE_CHARACTERS]
#: Texts longer than this many characters are split first, into segments of about that length.
SEGMENT = 16_384
#: White space from this length on bypasses the pattern.
LONG_RUN = 4_096
#: Words up to this many characters are remembered, at most so many of them in a worker.
SHORT, REMEMBERED = 48, 400_000
#: New words that are merged in one call.
RUN_WORDS = 256


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Cut ``text`` at safe boundaries, each ``size`` characters or more after the last.

    A segment is longer than about ``size`` only where one word or one run of white space is.
    """
    out, at = [], 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def matches_apart(segment: str) -> list[tuple[bool, str]]:
    """``(is one match, text)`` parts of a segment, long runs of white space cut out.

    Such a run is one match, but for its last character if something visible follows.
    """
    parts, at = [], 0
    for found in re.finditer(f"[{SPACE}]{{{LONG_RUN},}}", segment):
        end = found.end() - (found.end() < len(segment))
        parts += [(False, segment[at : found.start()]), (True, segment[found.start() : end])]
        at = end
    return [part for part in [*parts, (False, segment[at:])] if part[1]]


class RankEncoder:
    """Ids by a rank file, as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.encoding = tiktoken_encoding(path, pattern)

    def packed(self, text: str | None) -> bytes:
        """A null text is an empty one; special tokens are ordinary text."""
        text = text or ""
        if len(text) <= SEGMENT:
            return pack(self.whole(text))
        return b"".join(pack(self.whole(segment)) for segment in segments(text))

    def whole(self, segment: str) -> list[int]:
        if len(segment) < LONG_RUN:
            return self.encoding.encode_ordinary(segment)
        ids: list[int] = []
        for one, part in matches_apart(segment):
            ids += (self.encoding._encode_single_piece if one else self.encoding.encode_ordinary)(part)
        return ids


class WordEncoder:
    """Ids by a tokenizer file, each distinct word of a block of texts merged once.

    Texts are cut at spaces, which are safe boundaries after visible characters; Arrow numbers
    the distinct words of a block. The ids of short words are remembered from block to block, and
    with ``word_encoder`` from task to task: words not met since the last time that the younger
    half of the memory was full are forgotten.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = tokenizer(path), {}, {}
        names = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():  # a byte-level name has one character for each byte
            self.n_bytes[i] = len(name)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text is an empty one."""
        cut = [self._cut(text or "") for text in texts]
        split = pc.split_pattern(pa.array([body for _, body, _ in cut], pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        which, ends = numbered.indices.to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        packed = self._words(numbered.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        starts = np.cumsum(lengths) - lengths
        heads = map(pack, self._ids([head for head, _, _ in cut]))
        tails = map(pack, self._ids([tail for _, _, tail in cut]))
        out = []
        for head, tail, at, end in zip(heads, tails, np.r_[0, ends].tolist(), ends.tolist()):
            mine = which[at:end]
            sizes = lengths[mine]
            before = np.cumsum(sizes) - sizes
            places = np.repeat(starts[mine] - before, sizes) + np.arange(int(sizes.sum()))
            out.append(head + ids[places].tobytes() + tail)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each of the distinct ``words``."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unseen = list(filterfalse(known.__contains__, words))
        known.update((word, older[word]) for word in unseen if word in older)
        new = sorted(filterfalse(known.__contains__, unseen), key=len)
        short = bisect_right(new, SHORT, key=len)
        encoded = self._encode(new)
        known.update(zip(new[:short], encoded))
        if short == len(new):
            return list(map(known.__getitem__, words))
        held = dict(zip(new[short:], encoded[short:]))
        return [known.get(word) or held[word] for word in words]

    @staticmethod
    def _cut(text: str) -> tuple[str, str | None, str]:
        """``(head, body, tail)``: the head, the words after a space each, the tail.

        Words end in visible characters. A text with a space that does not follow a visible
        character is all head; without words the body is null.
        """
        at = text.find(" ")
        if at < 1 or any(pair in text for pair in UNSAFE):
            return text, None, ""
        end = len(text)
        if text[-1] in SPACE_CHARACTERS:
            end = text.rfind(" ")
        return text[:at], text[at + 1 : end] if end > at else None, text[end:]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word: runs of words are merged together, and cut by bytes.

        Words hold no space, so the spaces of a run are where its words begin.
        """
        out: list[bytes] = []
        runs = [" " + " ".join(words[at : at + RUN_WORDS]) for at in range(0, len(words), RUN_WORDS)]
        for run, ids in zip(runs, self._ids(runs)):
            ids = np.asarray(ids, dtype="<u4")
            packed, raw = ids.tobytes(), np.frombuffer(run.encode(), dtype=np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            stops = (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) * 4 + 4).tolist()
            out += [packed[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once in each worker, on one thread; special tokens are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return loaded


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The word encoder of a file, once in each worker."""
    return WordEncoder(path)


@lru_cache(maxsize=4)
def tiktoken_encoding(path: str, pattern: str):
    """The encoding of a rank file, once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
