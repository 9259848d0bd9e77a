"""Secrets: base patterns, and the guess cost of values that stand where credentials do."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.spans import Span, joined
from postlytics.llm.words import per_text
from postlytics.sources.staging import cut_lineage

KINDS = ["assign", "access", "hex", "guess"]
#: Words that guessing knows: the most frequent of the whole corpus.
DICTIONARY = 20_000
#: Classes of word frequencies between a number and its double.
CLASSES_PER_OCTAVE = 16
#: A value is a secret from so many guesses on, as a power of ten.
LEAST_COST = 8.0
LONGEST_WORD = 24
_PER_PART = math.log10(2)
#: Powers of ten for a step of a walk, a turn of it, saying a block twice, saying it once more, and a word's spelling.
_PER_STEP, _TURN, _TWICE, _PER_REPEAT, _SPELLING = 0.1, 0.6, 0.3, 0.02, 0.7

# Fixed patterns.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = ("pass", "secret", "token", "key", "pwd", "auth", "bearer", "credential", "login")
#: Where credentials stand: a name, a separator, a value; or a scheme and a value.
_CONTEXT = re.compile(
    r"""(?a:(?i:(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_\x20-]?key)?|token|(?:api|access|private|auth)[_\x20-]?key|auth(?:orization)?|credentials?|login)"""
    r"""["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*(?:(?:bearer|basic)\x20+)?|\b(?:bearer|basic)\x20+)["']?)([!-~\xa1-\xac\xae-\u167f\u1681-\u1fff]{6,})"""
)
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates wherever they begin, and what they cost.
_DATES = (
    (re.compile(rf"(?=({_YEAR}))", re.ASCII), 2.1),
    (re.compile(rf"(?=({_YEAR}([-/._]?){_MONTH}\2{_DAY}))", re.ASCII), 4.6),
    (re.compile(rf"(?=({_DAY}([-/._]?){_MONTH}\2{_YEAR}))", re.ASCII), 4.6),
)
#: Rows of the usual keyboard; a walk goes to a neighbour in its row or to a key above or below.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, at) for r, row in enumerate(_ROWS) for at, c in enumerate(row)}
_LEET = str.maketrans("013457@$!", "oieastasi")


def _brute(c: str) -> float:
    if c.isascii():
        return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def _lower(value: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def _step(a: str, b: str) -> tuple[int, int]:
    return _PLACE[b][0] - _PLACE[a][0], _PLACE[b][1] - _PLACE[a][1]


def _neighbours(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE or a == b:
        return False
    row, at = _step(a, b)
    return abs(row) <= 1 and abs(at) <= 1


def _follows(a: str, b: str) -> bool:
    return a.isalnum() and b.isalnum() and ord(b) - ord(a) == 1


#: Kinds of walks: what two characters in a row have to be, and what choosing the kind and the start costs.
_WALKS = (
    (lambda a, b: a == b, 2.0),
    (_follows, 1.5),
    (lambda a, b: _follows(b, a), 1.5),
    (_neighbours, 2.2),
)


def _turns(near, a: str, b: str, c: str) -> int:
    """Turns of a walk over the keyboard are choices; a straight run has none."""
    return int(near is _neighbours and _step(a, b) != _step(b, c))


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of all years and days, those within others too."""
    for form, cost in _DATES:
        for m in form.finditer(value):
            yield m.start(1), m.end(1), cost


@dataclass
class GuessCost:
    """Least guesses, as a power of ten, over all ways to put a value together; ``rank`` of the known words.

    A value is cut into parts in any way; each part but the first costs a
    factor of two. Parts are known words of 2 to 24 characters, dates, walks of three characters or
    more (equal, in alphabetic order either way, or neighbouring keys), a block of 2 to 8
    characters said at least twice, and single characters tried out, which form
    one part while they stand side by side. The length of a walk and the number of
    repetitions cost a fixed factor a step, so that the least cost is found exactly in time
    linear in the value, however long: a part that can grow is a state, not a list of its pieces.
    """

    rank: dict[str, int]

    def cost(self, value: str) -> float:
        return self._cost(value, {})

    def word(self, value: str, low: str, plain: str) -> float:
        """Cost of a known word, as it is or with digits and signs for letters."""
        least = min(math.log10(self.rank[low] + 1) if low in self.rank else math.inf, math.log10(self.rank[plain] + 1) + _SPELLING if plain in self.rank else math.inf)
        return least + (_PER_PART if any(c.isupper() for c in value) else 0.0)

    def _cost(self, value: str, blocks: dict[str, float] | None) -> float:
        """``blocks`` are the costs of repeated blocks found so far; None looks for no repetitions."""
        n = len(value)
        low = _lower(value)
        plain = low.translate(_LEET)
        ends: dict[int, list[tuple[int, float]]] = {}
        for start, end, cost in _dates(value):
            ends.setdefault(end, []).append((start, cost))
        best = [0.0] + [math.inf] * n
        tried = math.inf  # least cost up to here if the last part is tried out
        walks = [math.inf] * len(_WALKS)  # the same if it is a walk of each kind
        again = {size: [math.inf] * (n + 1) for size in range(2, 9)}
        for end in range(1, n + 1):
            c = value[end - 1]
            tried = min(tried, best[end - 1] + (_PER_PART if end > 1 else 0.0)) + _brute(c)
            least = tried
            for at, (near, base) in enumerate(_WALKS):
                if end < 3 or not near(low[end - 2], low[end - 1]) or not near(low[end - 3], low[end - 2]):
                    walks[at] = math.inf
                    continue
                turn = _TURN * _turns(near, *low[end - 3 : end])
                begun = best[end - 3] + (_PER_PART if end > 3 else 0.0) + base + 3 * _PER_STEP
                walks[at] = min(begun, walks[at] + _PER_STEP) + turn
                least = min(least, walks[at])
            for start in range(max(0, end - LONGEST_WORD), end - 1):
                if low[start:end] in self.rank or plain[start:end] in self.rank:
                    known = self.word(value[start:end], low[start:end], plain[start:end])
                    least = min(least, best[start] + known + (_PER_PART if start else 0.0))
            for start, cost in ends.get(end, ()):
                least = min(least, best[start] + cost + (_PER_PART if start else 0.0))
            if blocks is not None:
                for size in range(2, min(8, end // 2) + 1):
                    block, start = value[end - size : end], end - 2 * size
                    if value[start : end - size] != block:
                        continue
                    if block not in blocks:
                        blocks[block] = self._cost(block, None)
                    begun = best[start] + (_PER_PART if start else 0.0) + blocks[block] + _TWICE
                    again[size][end] = min(begun, again[size][end - size] + _PER_REPEAT)
                    least = min(least, again[size][end])
            best[end] = least
        return best[n]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base spans, and values in credential contexts that are hard to guess."""
        base = base_spans(text)
        if not text or not _hinted(text):
            return base, []
        added = []
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}>\"'")
            if len(value) >= 6 and self.cost(value) >= LEAST_COST:
                added.append(Span("guess", m.start(1), m.start(1) + len(value)))
        return base, added


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    if not text:
        return []
    out = []
    if _hinted(text):
        out += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def fit_guess_cost(docs: DataFrame, dictionary: int = DICTIONARY) -> GuessCost:
    """Rank the most frequent words of all ``docs`` (text), ``dictionary`` of them at most.

    Words are counted in classes of about equal frequency, a number fixed by the
    class width, and whole classes are taken from the top as long as they fit. So the
    driver gets no more than that, however many words and tasks there are.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"[\s\d\p{Punct}]+")).alias("word")).filter(F.length("word").between(2, LONGEST_WORD))
    counted = words.groupBy("word").agg(F.count("*").alias("times"))
    counted = cut_lineage(counted.withColumn("class", F.floor(F.log2("times") * CLASSES_PER_OCTAVE).cast("int")), "words")
    total, least = 0, None
    for row in sorted(counted.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        total += row["n"]
        if total > dictionary:
            break
        least = row["class"]
    rows = [] if least is None else counted.filter(F.col("class") >= least).collect()
    ranked = sorted((-row["times"], row["word"]) for row in rows)
    return GuessCost({word: at + 1 for at, (_, word) in enumerate(ranked)})


def find_secrets(docs: DataFrame, model: GuessCost) -> DataFrame:
    """(doc_id, n_ per base kind, base, spans) for each row of ``docs`` (doc_id, text).

    ``spans`` are the base spans and those of kind ``guess``: values behind a
    credential's name that take 10^8 guesses or more; a value ends at a blank or at a
    script that is written without blanks. Offsets are code
    points, ends exclusive. NULL and empty texts have no spans; texts are read
    whole; repeated rows get equal answers, an empty table none; further columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = KINDS[:3]

    def find(text: str | None) -> tuple:
        base, added = shared.value.spans(text)
        numbers = [sum(s.kind == kind for s in base) for kind in counted]
        return (*numbers, joined(base, KINDS), joined([*base, *added], KINDS))

    columns = {f"n_{kind}": pa.int64() for kind in counted} | {"base": pa.string(), "spans": pa.string()}
    return per_text(docs, columns, find)
