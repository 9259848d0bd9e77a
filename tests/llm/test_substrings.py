import random

import numpy as np
import pandas as pd
import pytest

from postlytics.llm import substrings


def slow_removal(rows):
    """Kept words by document, all windows compared in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone[at : at + 20] = [True] * 20
            seen.add(window)
        out[doc] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_comparing_all_windows(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "dd", "e."] if seed else [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(8)] + [["a"] * 70, ["a", "b"] * 30]
    rows = []
    for doc in range(40):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
        rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert found == slow_removal(rows)


def test_middle_symbol_is_the_same_in_equal_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        window = rng.integers(0, 3, 20).astype(np.uint64) * substrings.ODD
        spans = set()
        for _ in range(4):
            left, right = (rng.integers(0, 3, rng.integers(0, 15)).astype(np.uint64) * substrings.ODD for _ in range(2))
            words = np.concatenate((left, window, right))
            start, length = substrings.recompress(words, np.zeros(len(words), dtype=int))
            at = np.searchsorted(start, len(left) + substrings.MIDDLE, side="right") - 1
            spans.add((int(start[at]) - len(left), int(length[at])))
        assert len(spans) == 1
        (begin, size) = spans.pop()
        assert 0 <= begin and begin + size <= 20


def test_odd_documents(spark, documents, nothing):
    rows = substrings.remove_repeats(documents).collect()
    assert len(rows) == documents.count()
    found = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
    assert {(2, 24, 0), (5, 24, 24), (9, 0, 0), (10, 0, 0), (11, 0, 0), (None, 0, 0), (None, 12, 0), (12, 60_000, 59_999)} <= found
    assert ((1 << 53) + 1, 30, 0) in found
    assert sum(r.doc_id == 2 and r.n_removed == 0 for r in rows) == 2
    assert substrings.remove_repeats(nothing).count() == 0


def test_few_bytes_cross_the_shuffle():
    """The shuffle of anchors is most of the disk: no more than four longs a row."""
    text = " ".join(f"w{i % 37}" for i in range(300))
    docs = pd.DataFrame({"doc": [1, 2, 3], "digest": np.array([-5, 7, -(1 << 31)], dtype="int32"), "text": [text, text + " more", "x " + text]})
    found = pd.concat(substrings._find_anchors(iter([docs])))
    assert found.memory_usage(index=False).sum() <= 32 * len(found) > 0
    assert [str(t) for t in found.dtypes] == ["int64"] * 4
    assert set(((found["kind"].to_numpy() << 32) >> 32).tolist()) <= {-5, 7, -(1 << 31)}
