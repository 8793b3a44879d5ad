"""Operator 11: personal data by rules and by a character-level BiLSTM-CRF.

Base spans come from anchored patterns. The network learns from them: base spans of a bounded
sample are set into clean stretches of text, next to each other too, and it is trained on the
driver. It then reads every window of every text that can hold a span, windows overlap, and the
spans of all windows of a text are reconciled by one pass over the whole text. What it adds are
spans that the leftmost greedy patterns swallow with a neighbour and drop.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import bilstm
from tidegate.llm.arrow import map_blocks
from tidegate.session import cut_lineage

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")

# What the base kinds match. Looking back keeps a run from being tried at each of
# its characters and changes no match: matches are greedy, so none begins inside a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP_MOST, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)

#: Windows of a text and how far they are apart.
WINDOW, STRIDE = 128, 96
#: A window without any of these holds no span of any kind and is not read.
TELLING = np.zeros(bilstm.CLASSES, dtype=bool)
TELLING[[*range(ord("0"), ord("9") + 1), ord("@")]] = True
#: Windows that the network reads at once.
BATCH = 512
#: Bounds of the training sample: spans of each kind, clean stretches, characters of each.
SAMPLE_SPANS, SAMPLE_STRETCHES, LONGEST_SPAN, STRETCH = 300, 1200, 60, 160
HIDDEN, STEPS, TRAIN_BATCH, TRAIN_WINDOW = 16, 160, 64, 96

SPANS = "array<struct<kind:string,start:long,stop:long,base:boolean>>"


def digits_of(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    """Every second digit from the right doubled, the digit sum is 0 modulo 10."""
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind: str, text: str) -> bool:
    """The test that a match of its kind's pattern must pass."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in text.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= IP_MOST for p in parts)
    if kind == "card":
        digits = digits_of(text)
        return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    if kind == "phone":
        return PHONE_DIGITS[0] <= len(digits_of(text)) <= PHONE_DIGITS[1]
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from every @: the run of local characters before it and a domain behind."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        last = found.end() if found else at + 1
        if found:
            yield start, last
        at = text.find("@", last)


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """Matches of all kinds ``(kind, start, end, passed its test)`` by start, then kind."""
    found = [("email", a, b, True) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, m.start(), m.end(), holds(kind, m.group())) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind; code points, end exclusive."""
    return [s[:3] for s in matches(text or "") if s[3]]


def whole(kind: str, text: str) -> bool:
    """``text`` as a whole is what the kind's pattern and test ask for."""
    if kind == "email":
        return any((a, b) == (0, len(text)) for a, b in emails(text))
    pattern = {"ip": IP, "card": CARD, "phone": PHONE}[kind]
    return pattern.fullmatch(text) is not None and holds(kind, text)


def windows(length: int) -> list[tuple[int, int]]:
    """Overlapping ``(start, end)`` that cover a text of ``length`` characters."""
    starts = range(0, max(1, length - WINDOW + STRIDE), STRIDE)
    return [(a, min(length, a + WINDOW)) for a in starts]


def tag_runs(path: np.ndarray, gains: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(tag, start, end, summed gain)`` of the runs of equal tags other than 0."""
    edges = np.flatnonzero(np.diff(path, prepend=0, append=0))
    return [
        (int(path[a]), int(a), int(b), float(gains[a:b].sum()))
        for a, b in zip(edges, edges[1:]) if path[a]
    ]


def reconcile(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """One set of spans without overlaps from those of all windows of a text.

    ``found`` has ``(tag, start, end, gain, cut at the start, cut at the end)``. Pieces of one
    span that window borders cut are joined, over any number of windows. Of the spans that then
    overlap, the set with the largest total gain stays; of equal sets the one that ends first.
    """
    joined: list[list] = []
    for tag in {s[0] for s in found}:
        run: list | None = None
        for _, a, b, gain, cut_a, cut_b in sorted(s for s in found if s[0] == tag):
            if run and a <= run[2] and (run[4] or cut_a):
                # the shorter piece's gain lies within the other's as far as they overlap
                run[3] = max(run[3], gain, run[3] + gain * (b - run[2]) / max(1, b - a)) if b > run[2] else max(run[3], gain)
                run[4] = cut_b if b >= run[2] else run[4]
                run[2] = max(run[2], b)
            else:
                run = [tag, a, b, gain, cut_b]
                joined.append(run)
    spans = sorted({(b, a, tag): gain for tag, a, b, gain, _ in joined}.items())
    ends = [b for (b, _, _), _ in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]  # total gain of the first spans, and the last one taken
    before = [bisect_right(ends, a, 0, i) for i, ((_, a, _), _) in enumerate(spans)]
    for i, (_, gain) in enumerate(spans):
        total = best[before[i]][0] + gain
        best.append((total, i) if total > best[i][0] else (best[i][0], -1))
    chosen, i = [], len(spans)
    while i:
        taken = best[i][1]
        if taken >= 0:
            (b, a, tag), _ = spans[taken]
            chosen.append((tag, a, b))
            i = before[taken]
        else:
            i -= 1
    return chosen[::-1]


def read_windows(model: bilstm.Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled ``(tag, start, end)`` of every text, decoded over all its telling windows."""
    found: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int, int, int]] = []
    rows: list[np.ndarray] = []

    def flush() -> None:
        if not queue:
            return
        ids = np.full((len(queue), WINDOW), bilstm.PAD, dtype=np.uint8)
        for row, part in zip(ids, rows):
            row[: len(part)] = part
        paths, gains = model.decode(ids)
        for (t, a, b, length), path, gain in zip(queue, paths, gains):
            for tag, x, y, total in tag_runs(path[: b - a], gain[: b - a]):
                found[t].append((tag, a + x, a + y, total, x == 0 and a > 0, y == b - a and b < length))
        queue.clear()
        rows.clear()

    for t, text in enumerate(texts):
        if not text:
            continue
        ids = bilstm.classes(text)
        telling = np.concatenate([[0], np.cumsum(TELLING[ids])])
        if not telling[-1]:
            continue
        for a, b in windows(len(ids)):
            if telling[b] > telling[a]:
                queue.append((t, a, b, len(ids)))
                rows.append(ids[a:b])
                if len(queue) == BATCH:
                    flush()
    flush()
    return [reconcile(f) for f in found]


def added_spans(text: str, tagged: list[tuple[int, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tagged spans that pass their kind's pattern and test, stand alone and overlap no base span."""
    out, taken = [], sorted((a, b) for _, a, b in base)
    for tag, a, b in tagged:
        kind = KINDS[tag - 1]
        while a < b and not (text[a].isalnum() or text[a] in "+._%-"):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        alone = not (a > 0 and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
        if a < b and alone and whole(kind, text[a:b]) and all(y <= a or x >= b for x, y in taken):
            out.append((kind, a, b))
    return out


def sample(docs: DataFrame, text_col: str = "text") -> list[tuple[str, str]]:
    """``(kind, text)`` of base spans and ``("", text)`` of clean stretches, at most the stated numbers.

    All documents are read; of the distinct texts of a kind those with the smallest hashes are
    taken, so copies count once and the sample does not depend on the order of rows. A stretch
    holds no match of any pattern, passed or not; one begins at a place that follows from the
    text's own checksum, others at digits outside of matches.
    """

    def make():
        def run(texts):
            kinds, values = [], []
            for text in texts:
                found = matches(text or "")
                for kind, a, b, passed in found:
                    if passed and b - a <= LONGEST_SPAN:
                        kinds.append(kind)
                        values.append(text[a:b])
                for a, b in stretches(text or "", found):
                    kinds.append("")
                    values.append(text[a:b])
            return {"kind": kinds, "value": values}

        return run

    rows = cut_lineage(map_blocks(docs.select(text_col), "kind string, value string", make).distinct())
    out: list[tuple[str, str]] = []
    for kind in ("", *KINDS):
        most = SAMPLE_SPANS if kind else SAMPLE_STRETCHES
        top = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most).collect()
        out += [(r["kind"], r["value"]) for r in top]
    return out


def stretches(text: str, found: list[tuple[str, int, int, bool]]) -> list[tuple[int, int]]:
    """Up to two clean stretches of a text: one anywhere, one around digits that belong to no match."""
    from zlib import crc32

    blocked = sorted((a, b) for _, a, b, _ in found)
    gaps, at = [], 0
    for a, b in [*blocked, (len(text), len(text))]:
        if a - at >= STRETCH // 4:
            gaps.append((at, a))
        at = max(at, b)
    if not gaps:
        return []
    a, b = gaps[crc32(text[:64].encode("utf-8", "surrogatepass")) % len(gaps)]
    place = a + crc32(text[-64:].encode("utf-8", "surrogatepass")) % max(1, b - a - STRETCH)
    out = [(place, min(b, place + STRETCH))]
    for a, b in gaps:
        digit = re.compile("[0-9@]").search(text, a, b)
        if digit:
            start = max(a, digit.start() - STRETCH // 2)
            out.append((start, min(b, start + STRETCH)))
            break
    return out


def lessons(rows: list[tuple[str, str]], seed: int = 11) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training batches: clean stretches with labelled spans set in at spaces, alone or side by side."""
    draw = np.random.default_rng(seed)
    by_kind = {k: [v for kind, v in rows if kind == k] for k in KINDS}
    kinds = [k for k in KINDS if by_kind[k]]
    clean = [v for kind, v in rows if kind == ""] or [""]
    for _ in range(STEPS):
        ids = np.full((TRAIN_BATCH, TRAIN_WINDOW), bilstm.PAD, dtype=np.uint8)
        tags = np.zeros((TRAIN_BATCH, TRAIN_WINDOW), dtype=np.int64)
        for row, gold in zip(ids, tags):
            words = clean[draw.integers(len(clean))].split(" ")
            parts = [[bilstm.classes(w + " "), 0] for w in words]
            for _ in range(draw.integers(0, 3)):
                at = int(draw.integers(0, len(parts) + 1))
                for _ in range(draw.integers(1, 4)):
                    kind = kinds[draw.integers(len(kinds))]
                    values = by_kind[kind]
                    span = bilstm.classes(values[draw.integers(len(values))])
                    gap = (" ", " ", ", ", "; ", "\n", " | ")[draw.integers(6)]
                    parts[at:at] = [[span, 1 + KINDS.index(kind)], [bilstm.classes(gap), 0]]
            line = np.concatenate([p for p, _ in parts])
            marks = np.concatenate([np.full(len(p), t) for p, t in parts])
            first = int(draw.integers(0, max(1, len(line) - TRAIN_WINDOW + 1)))
            part = line[first : first + TRAIN_WINDOW]
            row[: len(part)] = part
            gold[: len(part)] = marks[first : first + TRAIN_WINDOW]
        yield ids, tags


def fit(docs: DataFrame, text_col: str = "text") -> bilstm.Tagger | None:
    """A tagger trained on the bounded sample, or None where the corpus holds no base span."""
    rows = sample(docs, text_col)
    if not any(kind for kind, _ in rows):
        return None
    return bilstm.train(lessons(rows), HIDDEN, 1 + len(KINDS))


def scan(docs: DataFrame, model: bilstm.Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: ``(id_col, spans)`` by start, then kind, base ones marked.

    A null or empty text has none. Rows map one to one, repeated rows and null keys included;
    other columns are not read. Without a model only base spans are found.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(keys, texts):
            texts = [t or "" for t in texts]
            tagged = read_windows(model, texts) if model is not None else [[]] * len(texts)
            out = []
            for text, more in zip(texts, tagged):
                base = base_spans(text)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, more, base)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "stop": b, "base": own} for k, a, b, own in spans])
            return {"k": keys, "spans": out}

        return run

    out = map_blocks(docs.select(F.col(id_col), F.col(text_col)), f"k {key}, spans {SPANS}", make)
    return out.withColumnRenamed("k", id_col)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on a bounded sample of ``docs`` and scan all of them."""
    return scan(docs, fit(docs, text_col), id_col, text_col)
