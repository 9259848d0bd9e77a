from collections import defaultdict

import pytest

from postlytics.llm import mixing, simhash


def slow_targets(sizes):
    """Share, cut at the ceiling, reshare the excess, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.fixture
def sized(spark):
    rows = [(i, (i * 7919) % 97, None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(3000)] + [(1, 5, "s0"), (1, 5, "s0"), (None, 3, "é")]
    return rows, spark.createDataFrame(rows, "doc_id long, words long, source string")


def test_targets_and_words(spark, sized):
    rows, df = sized
    taken = mixing.mix_sources(df, size="words").collect()
    assert len(taken) == len(rows)
    sizes, words = defaultdict(int), defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    for r in taken:
        words[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
    target = {r.source: r.target for r in taken}
    assert target == pytest.approx(slow_targets(sizes))
    assert all(abs(words[s] - target[s]) <= 97 for s in sizes)
    again = mixing.mix_sources(df.repartition(7), size="words").collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))


def test_odd_documents(spark, documents, nothing):
    mixed = mixing.mix_sources(documents)
    assert mixed.count() == documents.count()
    assert {r.doc_id: r.size for r in mixed.collect()}[12] == 60_000
    emitted = mixing.emit_copies(mixed)
    assert emitted.count() == mixed.agg({"copies": "sum"}).first()[0]
    assert mixing.mix_sources(nothing).count() == 0
    assert {r.copies for r in mixing.mix_sources(documents.filter("text = ''")).collect()} == {0}


def test_no_python_on_the_way(sized):
    plan = mixing.mix_sources(sized[1], size="words")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_other_columns_stay_whatever_their_names(spark):
    """Columns called like the operator's own come out as they went in; ``copy`` alone gives way when copies are made."""
    names = ["_at", "_first", "_source", "_each", "_offset", "_part", "_mid", "_before", "_N", "_doc", "_digest", "copy", "_same"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, f"a b c {i} " * (i + 1), "sx"[i % 2], *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, schema)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies"]
    assert sorted(tuple(r)[: len(docs.columns)] for r in mixed.collect()) == rows
    emitted = mixing.emit_copies(mixed)
    assert {tuple(r[n] for n in names if n != "copy") for r in emitted.collect()} <= {tuple(f"{n}{i}" for n in names if n != "copy") for i in range(6)}
    assert sorted(map(tuple, simhash.keep_first(docs).collect())) == rows
