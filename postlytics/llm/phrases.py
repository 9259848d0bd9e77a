"""Collocations from a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges the triples that lead from one
node to the next, weighted by how often they occur. A piece of text ends with two
edges into the end of pieces, so that no shorter phrase needs a count of its own:

* a pair occurs as often as edges flow out of its node, piece ends included;
* a word occurs as often as edges flow out of all nodes that it begins.

Triples are combined in each task, meet once by node, and leave that shuffle as a
stream of sums; only what occurs often enough is kept. Where all that flows
into a node flows on along one edge, its two edges are one path: such paths are
compacted, are the longest phrases that always stand together, and carry the
words of their edges. Words are 62-bit codes meanwhile; the few that share a
hash get codes that no hash is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlytics.sources.staging import cut_lineage, free

UNKNOWN = "und"
LEAST = 10
#: A phrase goes if a longer one has so many per cent of its occurrences.
INSIDE = 50
FIRST = 2000
#: Bits of a word's hash in its code.
BITS = 62
SEED = 42
#: Code of the end of a piece.
END = 0
#: Words that a task combines at once, distinct words that it counts at once, codes that it remembers.
FLUSH = 2_000_000
DISTINCT = 400_000
REMEMBERED = 1_000_000
#: Texts from which nodes with many edges are found, the share of edges that makes one, and parts that it is cut in.
SAMPLE = 2000
HOT, SALTS = 5e-4, 64

_MARK = b"\xff"  # in no UTF-8 text
_MARKED = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with a mark wherever a piece ends."""
    return text.lower().translate(_MARKED).replace(_MARK, b" \xff ").split()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
        yield lang, tokens(text)


def _spoken(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def _hashed(bits: int) -> Column:
    return F.xxhash64("lang", "word").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(1 << 62))


def count_words(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, word, n, code) of all words; ``code`` is a hash, and not yet one word's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, Counter] = {}
        for batch in batches:
            for lang, words in _texts(batch):
                counted.setdefault(lang, Counter()).update(words)
            if sum(map(len, counted.values())) > DISTINCT:
                yield from told(counted)
                counted = {}
        yield from told(counted)

    def told(counted: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counted.items():
            words.pop(_MARK, None)
            arrays = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])

    found = _spoken(docs).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("code", _hashed(bits))


def _spare_codes(words: DataFrame) -> dict[tuple[str, str], int]:
    """Codes of their own for words that share theirs: among N words about N^2 / 2^63 do."""
    shared = words.groupBy("code").agg(F.count("*").alias("k")).filter("k > 1").select("code")
    rows = words.join(shared, "code", "left_semi").select("lang", "word").collect()
    return {tuple(row): at for at, row in enumerate(sorted(rows, key=tuple), 1)}


class _Codes(dict):
    """Codes of a language's words, made when first asked for."""

    def __init__(self, lang: str, spare: dict, bits: int):
        super().__init__({_MARK: END})
        self.lang, self.spare, self.mask = lang, spare, (1 << bits) - 1
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8"), SEED)

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, self.seed) & self.mask | 1 << 62
        if self.spare:
            code = self.spare.get((self.lang, word.decode("utf-8")), code)
        if len(self) > REMEMBERED:
            self.clear()
            self[_MARK] = END
        self[word] = code
        return code


def triples(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, c, n): each word with the two behind it in its piece, equal ones once, sorted well enough to be near each other."""
    codes = np.concatenate([codes, np.zeros(2, dtype=np.int64)])
    words = codes[:-2] != END
    a, b, c = codes[:-2][words], codes[1:-1][words], codes[2:][words]
    c = np.where(b == END, END, c)
    key = (a >> 38 & 0xFFFFFF) << 40 | (b >> 42 & 0xFFFFF) << 20 | c >> 42 & 0xFFFFF
    order = np.argsort(key.view(np.uint64))
    return _combined(a[order], b[order], c[order], np.ones(len(a), dtype=np.int64))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _combined(a, b, c, n) -> tuple[np.ndarray, ...]:
    at = _starts(a, b, c)
    return a[at], b[at], c[at], np.add.reduceat(n, at) if len(at) else n


def _edges(docs: DataFrame, spare: Broadcast, bits: int) -> DataFrame:
    """(a, b, c, n), combined as far as a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Codes] = {}
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lang, words in _texts(batch):
                if lang not in known:
                    known[lang] = _Codes(lang, spare.value, bits)
                held += [np.fromiter(map(known[lang].__getitem__, words), dtype=np.int64, count=len(words)), np.zeros(1, dtype=np.int64)]
                size += len(words)
                if size > FLUSH:
                    yield from told(held)
                    held, size = [], 0
        if held:
            yield from told(held)

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = [pa.array(x) for x in triples(np.concatenate(held))]
        yield from pa.Table.from_arrays(found, ["a", "b", "c", "n"]).to_batches(max_chunksize=1 << 16)

    return _spoken(docs).mapInArrow(run, "a long, b long, c long, n long")


def _hot_nodes(docs: DataFrame, spare: Broadcast, bits: int) -> list[tuple[int, int]]:
    """Nodes that hold so many of the edges of a sample that their edges are dealt to several tasks; at most 2,000."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    seen = _edges(docs.sample(share, seed=SEED), spare, bits).groupBy("a", "b").agg(F.count("*").alias("edges"))
    staged = cut_lineage(seen, "sampled-nodes")
    most = staged.agg(F.sum("edges")).first()[0] or 0
    rows = staged.filter(F.col("edges") > max(SALTS, HOT * most)).select("a", "b").collect()
    free(staged)
    return [tuple(r) for r in rows]


def flow(least: int, hot: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of a partition sorted by (a, b, c): sums of edges, nodes (no c) and words (no b or c).

    Edges and nodes under ``least`` are left out, but for nodes of ``hot``, that
    other partitions hold parts of. Only the last edge, node and word are held.
    """
    hot_a, hot_b = (np.array(sorted({h[i] for h in hot}), dtype=np.int64) for i in range(2))

    def summed(keys: list[np.ndarray], n: np.ndarray, held: list | None, last: bool) -> tuple[list[np.ndarray], np.ndarray, list | None]:
        """Groups of sorted keys with their sums, ``held`` in front; the last one is held back unless nothing follows."""
        if held is not None:
            keys, n = [np.concatenate([[h], k]) for h, k in zip(held, keys)], np.concatenate([[held[-1]], n])
        at = _starts(*keys)
        keys, n = [k[at] for k in keys], np.add.reduceat(n, at) if len(at) else n
        if last or not len(n):
            return keys, n, None
        return [k[:-1] for k in keys], n[:-1], [*(k[-1] for k in keys), n[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = node = word = None
        for columns in chain(_gathered(batches), [None]):
            last = columns is None
            *keys, n = columns or [np.zeros(0, dtype=np.int64)] * 4
            (a, b, c), n, edge = summed(keys, n, edge, last)
            yield told(n >= least, n, a, b, c, end=c)
            (a, b), n, node = summed([a, b], n, node, last)
            yield told((n >= least) | np.isin(a, hot_a) & np.isin(b, hot_b), n, a, b, end=b)
            (a,), n, word = summed([a], n, word, last)
            yield told(n > 0, n, a)

    def told(kept: np.ndarray, n: np.ndarray, *keys: np.ndarray, end: np.ndarray | None = None) -> pa.RecordBatch:
        if end is not None:
            kept = kept & (end != END)
        arrays = [pa.array(k[kept]) for k in keys]
        arrays += [pa.nulls(int(kept.sum()), pa.int64())] * (3 - len(keys))
        return pa.RecordBatch.from_arrays([*arrays, pa.array(n[kept])], ["a", "b", "c", "n"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Columns of several batches at once."""
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= size:
            yield [np.concatenate(c) for c in zip(*held)]
            held, rows = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


class Graph:
    """What occurs ``least`` times or more in ``docs`` (text, lang), as staged tables.

    words  (code, lang, word, f)
    nodes  (a, b, f, into, out, before): ``into`` and ``out`` the most that an edge brings and takes, ``before`` the word in front of the former
    edges  (a, b, c, f)
    sizes  (lang, n): all words, however rare

    NULL texts are empty and a NULL lang is ``und``; rows that repeat count each;
    further columns are not read.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST, bits: int = BITS):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        every = cut_lineage(count_words(docs, bits), "words")
        found = _spare_codes(every)
        spare = spark.sparkContext.broadcast({(lang, word): code for (lang, word), code in found.items()})
        self.sizes = cut_lineage(every.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        hot = _hot_nodes(docs, spare, bits)
        node = F.xxhash64("a", "b")
        dealt = node
        if hot:
            crowded = F.concat_ws(",", "a", "b").isin([f"{a},{b}" for a, b in hot])
            dealt = F.when(crowded, F.xxhash64("a", "b", F.pmod("c", F.lit(SALTS)))).otherwise(node)
        met = _edges(docs, spare, bits).repartition(parts, dealt).sortWithinPartitions("a", "b", "c")
        sums = cut_lineage(met.mapInArrow(flow(least, hot), "a long, b long, c long, n long"), "flow")
        self.edges = sums.filter("c IS NOT NULL").withColumnRenamed("n", "f")
        into = self.edges.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("f").alias("into"), F.max_by("a", "f").alias("before"))
        out = self.edges.groupBy("a", "b").agg(F.max("f").alias("out"))
        nodes = sums.filter("b IS NOT NULL AND c IS NULL").groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        nodes = nodes.join(into, ["a", "b"], "left").join(out, ["a", "b"], "left")
        self.nodes = cut_lineage(nodes.select("a", "b", "f", "into", "out", "before"), "nodes")
        flowed = sums.filter("b IS NULL").groupBy(F.col("a").alias("code")).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        named = every.filter(F.col("n") >= least)
        if found:
            spared = spark.createDataFrame([(*k, v) for k, v in found.items()], "lang string, word string, own long")
            named = named.join(F.broadcast(spared), ["lang", "word"], "left").withColumn("code", F.coalesce("own", "code"))
        self.words = cut_lineage(flowed.join(named.select("code", "lang", "word"), "code"), "named-words")
        free(every)
        self._staged = [sums, self.nodes, self.words, self.sizes]

    def free(self) -> None:
        for table in self._staged:
            free(table)


def paths(graph: Graph) -> DataFrame:
    """(a, b, c, f, head, place): edges with the first edge of their path and their place on it.

    An edge goes on the path of the one before if all that flows into the node
    between them comes by that one and leaves by this one. Heads are found by
    doubling, so a path of n words takes about log2(n) rounds; pieces end, so
    paths do.
    """
    unary = graph.nodes.filter((F.col("into") == F.col("f")) & (F.col("out") == F.col("f"))).select("a", "b", "before")
    key, none = F.struct("a", "b", "c"), F.lit(None).cast("struct<a: bigint, b: bigint, c: bigint>")
    linked = graph.edges.join(unary, ["a", "b"], "left")
    before = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))
    state = linked.select(key.alias("edge"), "f", F.coalesce(before, key).alias("head"), F.when(before.isNotNull(), 1).otherwise(0).alias("place"))
    state = cut_lineage(state, "paths")
    while True:
        known = state.filter("place > 0").select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        moved = state.join(known, "head", "left")
        moved = moved.select("edge", "f", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        done = known.join(state.filter("place > 0").select("head"), "head", "left_semi").isEmpty()
        if done:
            return state.select("edge.a", "edge.b", "edge.c", "f", "head", "place")
        before_, state = state, cut_lineage(moved, "paths")
        free(before_)


def phrases(graph: Graph, found: DataFrame) -> DataFrame:
    """(head, lang, f, words): the words of each path, the longest phrases that always stand together; ``found`` from ``paths``."""
    first = found.filter("place = 0").select("head", "f", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("a").alias("code")), F.struct(F.lit(1).alias("at"), F.col("b").alias("code")))).alias("w"))
    rest = found.select("head", "f", F.struct((F.col("place") + 2).alias("at"), F.col("c").alias("code")).alias("w"))
    spelt = first.unionByName(rest).select("head", "f", "w.at", "w.code").join(graph.words.select("code", "lang", "word"), "code")
    spelt = spelt.groupBy("head").agg(F.first("lang").alias("lang"), F.first("f").alias("f"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    return spelt.select("head", "lang", "f", F.col("words.word").alias("words"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a^2 / (l r)) in whole numbers of 38 digits."""
    return F.expr(f"(1000000BD * CAST({a} AS DECIMAL(16, 0)) * CAST({a} AS DECIMAL(16, 0))) div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def candidates(graph: Graph) -> DataFrame:
    """(words, a, l, r, score, lang): phrases of two and three words, by codes, that no longer one holds most of."""
    word, node = graph.words.select("code", F.col("f").alias("count")), graph.nodes.select("a", "b", F.col("f").alias("count"))

    def counted(df: DataFrame, name: str, *keys: str) -> DataFrame:
        if len(keys) == 1:
            return df.join(word.select(F.col("code").alias(keys[0]), F.col("count").alias(name)), keys[0])
        return df.join(node.select(F.col("a").alias(keys[0]), F.col("b").alias(keys[1]), F.col("count").alias(name)), list(keys))

    longer = F.greatest(F.coalesce("into", F.lit(0)), F.coalesce("out", F.lit(0)))
    # NULL stands for no longer phrase.
    two = graph.nodes.filter((F.col("into").isNull() & F.col("out").isNull()) | (100 * longer < INSIDE * F.col("f"))).select("a", "b", "f")
    two = counted(counted(two, "l", "a"), "r", "b")
    two = two.select("a", "b", F.lit(None).cast("long").alias("c"), "f", "l", "r", _score("f", "l", "r").alias("score"))
    three = counted(counted(graph.edges, "l1", "a"), "r1", "b", "c")
    three = counted(counted(three, "l2", "a", "b"), "r2", "c")
    three = three.select("a", "b", "c", "f", "l1", "r1", "l2", "r2", _score("f", "l1", "r1").alias("s1"), _score("f", "l2", "r2").alias("s2"))
    second = F.col("s2") < F.col("s1")
    picked = [F.when(second, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("l", "l1", "l2"), ("r", "r1", "r2"), ("score", "s1", "s2"))]
    both = two.unionByName(three.select("a", "b", "c", "f", *picked))
    return both.join(graph.words.select(F.col("code").alias("a"), "lang", F.col("word").alias("first")), "a")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by score, count and phrase.

    Texts and languages as in ``Graph``; texts are read whole. Phrases have two
    or three words and ``least`` occurrences; ``l`` and ``r`` are the counts of the
    parts of the cut with the lowest score, the earlier one in a tie. A phrase
    goes if a longer one that holds it has half its occurrences. Counts are
    exact; those up to 10^16 give exact scores. Empty tables give an empty result.
    """
    graph = Graph(docs, least, bits)
    scored = candidates(graph)
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    # Those that tie with the last one stay until their words decide.
    near_top = cut_lineage(scored.withColumn("near", F.rank().over(near)).filter(F.col("near") <= first), "candidates")
    two = near_top.filter("c IS NULL").join(graph.words.select(F.col("code").alias("b"), "word"), "b")
    two = two.select("lang", "f", "l", "r", "score", F.concat_ws(" ", "first", "word").alias("phrase"))
    found = paths(graph)
    placed = near_top.filter("c IS NOT NULL").join(found.select("a", "b", "c", "head", "place"), ["a", "b", "c"])
    three = placed.join(phrases(graph, found).select("head", "words"), "head")
    three = three.select("lang", "f", "l", "r", "score", F.array_join(F.slice("words", F.col("place") + 1, 3), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    result = ranked.join(F.broadcast(graph.sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
    result = cut_lineage(result, "collocations")
    graph.free()
    free(near_top)
    return result
