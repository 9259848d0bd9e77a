"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postlytics.llm import phrases

DOCS = "doc_id long, text string, lang string, words string, f long, code long, rank int"


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)) if w]


def mined_by_brute_force(rows, least, first):
    out = []
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for w in pieces(text):
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        longest = {p: v for p, v in f.items() if len(p) == 3 and v >= least}
        scored = []
        for p, a in f.items():
            if len(p) == 1 or a < least or (len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * v >= 50 * a for q, v in longest.items())):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode("utf-8"), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode("utf-8"), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def texts(seed, n=60):
    """Zipfian words in several languages, passages that repeat, a very common pair, odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "\x85", "　x", "a\x00b", "straße", "\xff", "😀"]
    passage = "the Long passage that is said again and again and again by all"
    out = []
    for _ in range(n):
        said = []
        for _ in range(rng.randrange(60)):
            said.append(words[min(int(rng.paretovariate(0.7)) - 1, len(words) - 1)])
            said.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " very common "]))
        said.insert(rng.randrange(len(said) + 1), rng.choice([f". {passage} ", passage, ""]))
        out.append(("".join(said), rng.choice(["en", "en", "de", None, "und"])))
    return [*out, (None, "en"), ("", "en"), (" \t. ,", None), ("one", "fr"), ("x " * 30_000, "en"), *out[:5]]


@pytest.mark.parametrize("seed,bits,least,first", [(1, 62, 10, 2000), (2, 4, 3, 20)])
def test_collocations(spark, monkeypatch, seed, bits, least, first):
    """With few bits nearly all words share their hash with others."""
    monkeypatch.setattr(phrases, "FLUSH", 500)
    monkeypatch.setattr(phrases, "DISTINCT", 20)
    monkeypatch.setattr(phrases, "REMEMBERED", 30)
    monkeypatch.setattr(phrases, "HOT", 0.01)
    monkeypatch.setattr(phrases, "SALTS", 3)
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, g, "x", 1, 2, 3) for i, (t, g) in enumerate(rows)], DOCS)
    found = phrases.collocations(docs, least, first, bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == mined_by_brute_force(rows, least, first)


def test_odd_documents(spark, documents, nothing):
    rows = [(r.text, r.lang) for r in documents.collect()]
    assert sorted(map(tuple, phrases.collocations(documents, 2).collect())) == mined_by_brute_force(rows, 2, 2000)
    assert phrases.collocations(nothing).count() == 0


def test_flow_in_small_batches():
    """Sums over partitions do not depend on how batches are cut, and END edges count for nodes and words alone."""
    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(1, 4, (200, 3)), axis=0).astype(np.int64)
    rows[:, 2] = rng.integers(0, 3, 200)
    rows = rows[np.lexsort(rows.T[::-1])]
    n = rng.integers(1, 5, 200)
    expected = Counter()
    for (a, b, c), k in zip(rows.tolist(), n.tolist()):
        expected[a, None, None] += k
        expected[a, b, None] += k
        if c:
            expected[a, b, c] += k
    for step in (1, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[i : i + step].T, n[i : i + step])], ["a", "b", "c", "n"]) for i in range(0, 200, step)]
        found = [tuple(r.values()) for b in phrases.flow(9, [(1, 1)])(iter(batches)) for r in b.to_pylist()]
        assert len(found) == len({f[:3] for f in found})
        kept = {k: v for k, v in expected.items() if v >= 9 or k[1:] == (None, None) or k == (1, 1, None)}
        assert {f[:3]: f[3] for f in found} == kept


def test_unary_paths(spark):
    """Words that always stand together are one path; where texts part or pieces end, paths do."""
    rows = [("p q r s t u", "en")] * 4 + [("x r s y", "en")] * 2 + [("k l m", "en"), ("k l m. l m", "en")]
    graph = phrases.Graph(spark.createDataFrame(rows, "text string, lang string"), least=2)
    found = phrases.phrases(graph, phrases.paths(graph))
    assert sorted((" ".join(r.words), r.f) for r in found.collect()) == [("k l m", 2), ("p q r s", 4), ("r s t u", 4), ("r s y", 2), ("x r s", 2)]
    counts = {(r.word): r.f for r in graph.words.collect()}
    assert counts == {**dict.fromkeys("pqtu", 4), **dict.fromkeys("rs", 6), **dict.fromkeys("xyk", 2), **dict.fromkeys("lm", 3)}
