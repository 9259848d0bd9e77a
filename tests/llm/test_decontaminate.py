import random

import pytest

from postlytics.llm import decontaminate


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_same_as_full_alignment(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "_PIECE", piece)
    rng = random.Random(piece)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    for _ in range(250):
        item = prose(rng.randint(6, 25))
        edited = list(item)
        for _ in range(rng.randint(0, int(len(item) * 0.14))):
            at, kind = rng.randrange(len(edited)), rng.random()
            if kind < 0.4:
                edited[at] = rng.choice("abcdefgh")
            elif kind < 0.7:
                del edited[at]
            else:
                edited.insert(at, rng.choice("abcdefgh"))
        text = f"{prose(rng.randint(0, 20))} {''.join(edited)} {prose(rng.randint(0, 20))}"
        index = decontaminate.ItemIndex([(1, decontaminate.normalized(item))])
        expected = slow_distance(decontaminate.normalized(item), decontaminate.normalized(text))
        found = index.matches(text)
        assert bool(found) == (expected <= index.budget[0])
        if found:
            assert found[0][0] == expected


@pytest.fixture
def benchmark(spark):
    rows = [(1, "Nobody had lived since THE WAR had come, and gone!"), (2, None), (3, " .,"), (4, "own"), (4, "own"), (None, "words of its own to be read")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


def test_documents_and_items(spark, documents, benchmark, nothing, monkeypatch):
    expected = {(5, 1), (2, 1), ((1 << 53) + 1, 1), (None, 4), (None, None)}
    for size in (1 << 22, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = decontaminate.find_contaminated(documents, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == 7
        assert all(r.edits == 0 for r in rows)
    clean = decontaminate.drop_contaminated(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(["9", "10", "11", "12", "None"])
    assert decontaminate.find_contaminated(nothing, benchmark).count() == 0
    assert decontaminate.find_contaminated(documents, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(documents, benchmark.limit(0)).count() == documents.count()
