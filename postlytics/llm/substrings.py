"""Removal of repeated word sequences, found by recompression.

Every text is rewritten in rounds. A round names tokens and pairs of neighbouring
symbols by a hash of what they stand for, so equal sequences get equal names all over the corpus
without asking each other. Which neighbours pair up hangs on their names alone,
so of two equal sequences only the symbols near the ends can differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlytics.llm.words import ODD, ODD_2, hash_words, mix, word_bytes
from postlytics.sources.staging import cut_lineage

WINDOW = 20
#: The longest symbols that a round may pair, round by round. With 2 words for a cut run, a window can lose as
#: many words at either end as these sum up to, 9 in all; the two in its middle are always safe.
ROUNDS = (1, 1, 1, 2, 2)
RUN = 3
MIDDLE = 9
_CHUNK = 400_000
_FIRST = -(1 << 63)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, b)))) for b in (ODD, inverse))
    return _powers


def prefix_sums(words: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(len(words) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * power[: len(words)])))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``start`` to before ``end``, wherever they stand."""
    _, inverse = _powers_to(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def recompress(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length in words of the symbols of the last round; ``text`` numbers each word's text."""
    same = np.concatenate(([False], (words[1:] == words[:-1]) & (text[1:] == text[:-1]), [False]))
    # Runs of equal tokens stay in single words and never pair: a word is in a run if so many about it are equal.
    starts_run = np.flatnonzero(~same[:-1])
    long_run = np.diff(np.append(starts_run, len(words))) >= RUN
    in_run = np.repeat(long_run, np.diff(np.append(starts_run, len(words))))
    name, start, length, fixed = words, np.arange(len(words)), np.ones(len(words), dtype=np.int64), in_run
    for round_, longest in enumerate(ROUNDS):
        right = (mix(name + np.uint64(round_)) & np.uint64(1)).astype(bool)
        free = ~fixed & (length <= longest)
        pair = np.flatnonzero(~right[:-1] & right[1:] & free[:-1] & free[1:] & (text[start[:-1]] == text[start[1:]]))
        name = name.copy()
        name[pair] = mix(name[pair] * ODD + name[pair + 1])
        length = length.copy()
        length[pair] += length[pair + 1]
        stays = np.ones(len(name), dtype=bool)
        stays[pair + 1] = False
        name, start, length, fixed = name[stays], start[stays], length[stays], fixed[stays]
    return start, length


def _anchors(words: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """For each symbol that covers the middle of a window: hashes and windows.

    ``key`` hashes the words that all these windows share, ``whole`` all words of
    all of them; ``at`` is the first window's start in its text, ``n`` their number.
    """
    start, length = recompress(words, text)
    owner = text[start]
    begin, stop = first[owner], first[owner] + size[owner]
    low, high = np.maximum(start, begin + MIDDLE), np.minimum(start + length - 1, stop - (WINDOW - MIDDLE))
    some = low <= high
    start, length, owner, low, high, begin = (x[some] for x in (start, length, owner, low, high, begin))
    sums = prefix_sums(words)
    key = span_hash(sums, start + length - 1 - MIDDLE, start + WINDOW - MIDDLE)
    whole = span_hash(sums, low - MIDDLE, high + WINDOW - MIDDLE)
    shape = ((low - start) * 64 + (high - start) * 8 + length).astype(np.uint64)
    return {
        "owner": owner,
        "key": mix(key + length.astype(np.uint64)),
        "whole": mix(whole ^ (shape * ODD)),
        "at": low - MIDDLE - begin,
        "n": high - low + 1,
    }


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same owner as one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # Owners are set far apart, so that a running maximum never reaches over.
    apart = owner.astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    fresh = np.concatenate(([True], (start + apart)[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    return owner[at], start[at], (reach - apart)[np.append(at[1:], len(owner)) - 1]


#: ``spot`` packs where windows start, how many they are, and whether they are settled; ``kind`` half a hash of all words, beside
#: the 64 bits of ``route``, and the text's digest: few bytes cross the shuffle.
_ANCHORS = "route long, kind long, doc long, spot long"


def _spot(at: np.ndarray, n: np.ndarray, known: bool) -> np.ndarray:
    return (at.astype(np.int64) << 32) | (n.astype(np.int64) << 1) | int(known)


def _kind(whole: np.ndarray, digest: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << 32) - 1)
    return ((whole & ~low) | (digest.astype(np.int64).view(np.uint64) & low)).view(np.int64)


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors that are the first of their kind here, and spans that follow an equal one here."""
    for batch in batches:
        batch = batch.drop_duplicates(["doc", "digest"]).sort_values(["doc", "digest"])
        rows, words, size = [], [], []
        for doc, digest, text in zip(batch["doc"], batch["digest"], batch["text"], strict=True):
            found = word_bytes(text)
            if len(found) >= WINDOW:
                rows.append((doc, digest))
                words.append(hash_words(found))
                size.append(len(found))
            if sum(size) >= _CHUNK:
                yield _chunk_anchors(rows, words, size)
                rows, words, size = [], [], []
        if rows:
            yield _chunk_anchors(rows, words, size)


def _chunk_anchors(rows: list, words: list, size: list) -> pd.DataFrame:
    size = np.array(size)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    a = _anchors(np.concatenate(words), np.repeat(np.arange(len(size)), size), first, size)
    order = np.lexsort((a["at"], a["owner"], a["whole"], a["key"]))
    a = {k: v[order] for k, v in a.items()}
    later = np.concatenate(([False], (a["key"][1:] == a["key"][:-1]) & (a["whole"][1:] == a["whole"][:-1])))
    owner, start, end = merged(a["owner"][later], a["at"][later], (a["at"] + a["n"] + WINDOW - 1)[later])
    new = ~later
    doc, digest = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    # Settled spans are dealt out evenly, whatever they repeat.
    even = mix(digest[owner].astype(np.uint64) * ODD + start.astype(np.uint64)).view(np.int64)
    n = end - start - (WINDOW - 1)
    known = pd.DataFrame({"route": even, "kind": _kind(np.uint64(0), digest[owner]), "doc": doc[owner], "spot": _spot(start, n, True)})
    a = {k: v[new] for k, v in a.items()}
    back = np.lexsort((a["at"], a["owner"]))  # neighbours of one text compress well together
    a = {k: v[back] for k, v in a.items()}
    open_ = pd.DataFrame(
        {
            "route": a["key"].view(np.int64),
            "kind": _kind(a["whole"], digest[a["owner"]]),
            "doc": doc[a["owner"]],
            "spot": _spot(a["at"], a["n"], False),
        }
    )
    return pd.concat([open_, known], ignore_index=True)


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two hashes of every window asked for; those that follow an equal one here are settled."""
    for batch in batches:
        batch = batch.drop_duplicates(["doc", "digest"]).sort_values(["doc", "digest"])
        parts = []
        for row, (text, asked) in enumerate(zip(batch["text"], batch["asked"], strict=True)):
            words = hash_words(word_bytes(text))
            at = np.unique(np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in asked]))
            one = span_hash(prefix_sums(words), at, at + WINDOW)
            two = span_hash(prefix_sums(mix(words ^ ODD_2)), at, at + WINDOW)
            parts.append((one, two, np.full(len(at), row), at))
        if not parts:
            continue
        one, two, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, row, two, one))
        one, two, row, at = one[order], two[order], row[order], at[order]
        later = np.concatenate(([False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])))
        doc, digest = (batch[c].to_numpy()[row] for c in ("doc", "digest"))
        even = mix(digest.astype(np.uint64) * ODD + at.astype(np.uint64))
        spot = _spot(at, np.ones(len(at)), False) | later
        yield pd.DataFrame({"route": np.where(later, even, one).view(np.int64), "kind": _kind(two, digest), "doc": doc, "spot": spot})


def _judged(spans: DataFrame) -> DataFrame:
    """``spans`` with ``repeats``: settled, or behind one of an earlier text with equal hashes.

    What a hash has most of was settled where it was found, so that a hash has a row for each batch at most.
    """
    # Taken apart behind the shuffle.
    digest = F.shiftright(F.shiftleft("kind", 32), 32).cast("int")
    spans = spans.repartition("route").select("route", F.shiftright("kind", 32).alias("whole"), "doc", digest.alias("digest"), "spot")
    by_hash = Window.partitionBy("route").orderBy("whole", "doc", "digest", "spot")
    before = F.lag(F.struct("whole", "doc", "digest", "spot")).over(by_hash)
    equal_row = (before["doc"] == F.col("doc")) & (before["digest"] == F.col("digest")) & (before["spot"] == F.col("spot"))
    follows = F.coalesce((before["whole"] == F.col("whole")) & ~equal_row, F.lit(False))
    return spans.withColumn("repeats", (F.col("spot").bitwiseAND(F.lit(1)) == 1) | follows)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, digest, at, n): windows at, …, at+n-1 whose words also start earlier.

    ``docs`` has doc, digest and text; a text is earlier if its doc, or else its
    digest, is smaller, and rows with equal doc and digest are one text.
    """
    anchors = _judged(docs.mapInPandas(_find_anchors, _ANCHORS))
    anchors = anchors.withColumn("firsts", F.sum((~F.col("repeats")).cast("int")).over(Window.partitionBy("route")))
    at, n = F.shiftright("spot", 32).cast("int"), F.shiftright(F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    anchors = anchors.filter("repeats OR firsts > 1").select("doc", "digest", at.alias("at"), n.alias("n"), "repeats")
    anchors = cut_lineage(anchors, "anchors")
    # What shares a key but not all words is compared window by window: the ends of repeated passages.
    asked = anchors.filter("NOT repeats").groupBy("doc", "digest").agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    texts = docs.join(asked, ["doc", "digest"])
    windows = _judged(texts.select("doc", "digest", "text", "asked").mapInPandas(_window_hashes, _ANCHORS))
    windows = windows.filter("repeats").select("doc", "digest", at.alias("at"), F.lit(1).alias("n"))
    return anchors.filter("repeats").drop("repeats").unionByName(windows)


def _cut(text: str | None, spans) -> tuple[int, int, bytes]:
    words = word_bytes(text)
    keep = np.ones(len(words) + 1, dtype=np.int64)
    if spans is not None and len(spans):
        edge = np.zeros(len(words) + 2, dtype=np.int64)
        np.add.at(edge, [x["at"] for x in spans], 1)
        np.add.at(edge, [x["at"] + x["n"] + WINDOW - 1 for x in spans], -1)
        keep = np.cumsum(edge)[: len(words) + 1] == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=False) if k]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text).

    A word goes if a window of 20 words that covers it also starts earlier in
    the corpus; ``kept`` are the others, joined by one space. NULL and blank texts
    have no words; texts are read whole; texts under 20 words lose nothing. Rows
    that repeat a doc_id go by a 32-bit hash of their text, and rows equal in both are one
    text, of which each gets the same result. A NULL doc_id comes before all
    others. An empty table gives an empty result; further columns are not read.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), F.hash("text").alias("digest"), "text")
    spans = repeated_spans(keyed)
    spans = spans.groupBy("doc", "digest").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_cut(t, s) for t, s in zip(batch["text"], batch["spans"], strict=True)]
            found = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            yield found.assign(doc=batch["doc"], kept=found["kept"].str.decode("utf-8"))

    joined = keyed.join(spans, ["doc", "digest"], "left").select("doc", "text", "spans")
    kept = joined.mapInPandas(cut, "doc long, n_words long, n_removed long, kept string")
    return kept.select(F.nullif("doc", F.lit(_FIRST)).alias("doc_id"), "n_words", "n_removed", "kept")
