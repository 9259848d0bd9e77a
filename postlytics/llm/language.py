"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.words import ODD, ODD_2, each_text, mix, per_text
from postlytics.sources.staging import cut_lineage

UNDETERMINED = "und"
GRAMS = (2, 3, 4)
#: A language contains an n-gram that makes up at least this share of its n-grams of that length.
LEAST_SHARE = 5e-5
#: About so many labelled texts of each language are learnt from at most.
SAMPLE_DOCS = 20_000
SLOTS = 1 << 19
HASHES = 2
#: One filter word holds so many languages.
LANGUAGES = 63
#: A text is in no learnt language if it shares less than this with each.
LEAST_KNOWN = 0.1
_NO_LETTERS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20


def gram_hashes(text: str | None) -> list[np.ndarray]:
    """Hashes of the n-grams of the lower-cased letters, one array for each length; blanks stand for the rest."""
    letters = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not letters:
        return [np.zeros(0, dtype=np.uint64) for _ in GRAMS]
    points = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    blank = points == 32
    out, h, inner = [], points, blank.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(h) < 2:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        h = h[:-1] * ODD + points[n - 1 :]
        # A blank may begin or end an n-gram, not stand inside.
        inner = (inner[:-1] | blank[n - 2 : -1]) if n > 2 else np.zeros(len(h), dtype=bool)
        if n in GRAMS:
            out.append((h * ODD_2 + np.uint64(n))[~inner])
    return out


def gram_counts(texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length, the distinct hashes of the n-grams of ``texts`` and how often they occur.

    Counted by runs of about ``_PIECE`` characters, as a hash takes eight bytes for each character and length.
    """
    found: list[list] = [[] for _ in GRAMS]
    for _, run in texts.groupby(texts.str.len().cumsum() // _PIECE):
        for out, arrays in zip(found, zip(*map(gram_hashes, run), strict=True), strict=True):
            out.append(np.unique(np.concatenate(arrays), return_counts=True))
    for n, counted in zip(GRAMS, found, strict=True):
        gram, at = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
        times = np.zeros(len(gram), dtype=np.int64)
        np.add.at(times, at, np.concatenate([t for _, t in counted]))
        yield n, gram, times


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    h = mix(h)
    return [(h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1) for k in range(HASHES)]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that models may not learn from; none without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _bits(languages: int) -> list[np.int64]:
    """The bits of one filter word that so many languages take."""
    return [np.int64(1 << b) for b in range(min(languages, LANGUAGES))]


@dataclass
class LanguageFilters:
    """``table`` has one bit per language in each slot, 63 languages a row; ``rate`` is each language's chance to answer a foreign n-gram."""

    languages: list[str]
    table: np.ndarray
    rate: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of all languages' answers, and the share of n-grams that it contains."""
        if text is None or not self.languages or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0, 0.0
        hits, n = np.zeros(len(self.languages), dtype=np.int64), 0
        for at in range(0, len(text), _PIECE):
            # Pieces overlap by less than an n-gram, and long texts stay small in memory.
            h = np.concatenate(gram_hashes(text[at : at + _PIECE]))
            n += len(h)
            slots = slots_of(h)
            for word, row in enumerate(self.table):
                found = np.bitwise_and.reduce([row[s] for s in slots])
                first = word * LANGUAGES
                hits[first : first + LANGUAGES] += [np.count_nonzero(found & bit) for bit in _bits(len(self.languages) - first)]
        true = np.maximum((hits - n * self.rate) / np.maximum(1 - self.rate, 1e-9), 0)
        best = int(true.argmax())  # of equals, the first by code point
        total = true.sum()
        return self.languages[best], float(true[best] / total) if total else 0.0, float(min(1.0, true[best] / max(n, 1)))


def fit_languages(docs: DataFrame, sample: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE) -> LanguageFilters:
    """Learn from ``docs`` (text, lang) with a language; others are not read.

    Learns from ``sample`` texts of each language or so, chosen by a hash of the text,
    and from all of a language that has fewer: a bound for the model's cost, not for
    what it is applied to. What comes to the driver is one number for each slot of the
    filter and 63 languages.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    # One row for each language: its bit, and the hashes up to which its texts are learnt from.
    most = [min(int(min(1.0, sample / counts[x]) * 2**63), 2**63 - 1) for x in languages]
    bounds = pa.table([pa.array(languages, pa.string()), pa.array(range(len(languages)), pa.int32()), pa.array(most, pa.int64())], ["lang", "number", "bound"])
    # As Arrow, no Python workers of another kind are started to make it.
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds))
    chosen = labelled.join(bounds, "lang").filter(F.shiftrightunsigned(F.xxhash64("text"), 1) <= F.col("bound")).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for n, gram, times in gram_counts(texts):
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.view(np.int64), "times": times})

    grams = chosen.mapInPandas(count, "lang string, n int, gram long, times long")
    grams = cut_lineage(grams.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")), "grams")
    totals = grams.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    part = F.col("times") / F.col("total")
    # One row for each language and length.
    kept = grams.join(F.broadcast(totals), ["lang", "n"]).filter(part >= least_share)
    bit = F.pow(F.lit(2.0), F.col("number") % LANGUAGES).cast("long")
    kept = kept.join(bounds, "lang").select("gram", F.floor(F.col("number") / LANGUAGES).cast("long").alias("word"), bit.alias("mask"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for slot in slots_of(batch["gram"].to_numpy().view(np.uint64)):
                yield pd.DataFrame({"slot": slot.astype(np.int64), "word": batch["word"], "mask": batch["mask"]})

    placed = kept.mapInPandas(place, "slot long, word long, mask long")
    rows = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((-(-len(languages) // LANGUAGES), SLOTS), dtype=np.int64)
    table[rows.column("word").to_numpy(), rows.column("slot").to_numpy()] = rows.column("mask").to_numpy()
    filled = np.array([np.count_nonzero(row & bit) / SLOTS for w, row in enumerate(table) for bit in _bits(len(languages) - w * LANGUAGES)])
    return LanguageFilters(languages, table, filled**HASHES)


def predict_languages(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score, known) for each row of ``docs`` (doc_id, text).

    ``score`` is the language's share of all languages' answers, ``known`` the
    share of n-grams that it contains. NULL texts and texts without a letter are
    ``und`` with score 0, as is everything if no language was learnt; of equal
    languages the first by code point wins; texts are read whole; repeated rows
    get equal answers, an empty table none; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    columns = {"lang_pred": pa.string(), "score": pa.float64(), "known": pa.float64()}
    return per_text(docs, columns, lambda text: shared.value.predict(text))


def keep_identified(docs: DataFrame, model: LanguageFilters, least_known: float = LEAST_KNOWN) -> DataFrame:
    """``docs`` whose text is in a learnt language; columns stay as they are.

    What goes are texts without a letter and texts of whose n-grams the nearest
    language contains less than ``least_known``; texts in several languages stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known_well(text: str | None) -> bool:
        lang, _, known = shared.value.predict(text)
        return lang != UNDETERMINED and known >= least_known

    @F.arrow_udf("boolean")
    def identified(texts: pa.Array) -> pa.Array:
        return each_text(texts, known_well, pa.bool_())

    return docs.filter(identified("text"))
