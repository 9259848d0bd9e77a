import pytest
from pyspark.sql import functions as F

from postlytics.functions.text import distinct_words, split_words, word_tag, word_token
from postlytics.operators import counts
from postlytics.sources.posts import (
    numbered_paths,
    parse_raw_posts,
    parse_tagged_posts,
    read_raw_posts,
    read_tagged_posts,
    union_posts,
)

RAW = [
    # line, post_id, user_id, text
    ('{"id":5,"user":{"id":7},"text":"x y"}', 5, 7, "x y"),
    ('  {"id":5,"user":{"id":7}}  ', 5, 7, None),
    ('{"id":5,"user":{"id":7', None, None, None),
    ("", None, None, None),
    ("   ", None, None, None),
    ("5", None, None, None),
    ("null", None, None, None),
    ('[{"id":5,"user":{"id":7}}]', None, None, None),
    ('{"id":5}', 5, None, None),
    ('{"id":5,"user":{"id":null}}', 5, None, None),
    ('{"id":5,"user":"bob","text":"q"}', 5, None, "q"),
    ('{"id":5,"user":[{"id":7}]}', 5, None, None),
    ('{"id":"77","user":{"id":"78"}}', 77, 78, None),
    ('{"id":3000000000,"user":{"id":3000000000}}', 3000000000, 3000000000, None),
    ('{"id":0,"user":{"id":0}}', 0, 0, None),
    ("{'id':5,'user':{'id':7}}", None, None, None),
    ('{"id":5,"user":{"id":7}} xyz', None, None, None),
    ('{"id":5,"user":{"id":7}} }', None, None, None),
    ('{"id":5,"user":{"id":7}}{"id":6,"user":{"id":8}}', None, None, None),
    ('{"id":5,"user":{"id":7}},{"id":6,"user":{"id":8}}', None, None, None),
    *((line, None, None, None) for line in (
        '{"id":5,"user":{"id":7}}] xyz', '{"id":5,"user":{"id":7}}]', '{"id":5,"user":{"id":7}}][', '{"id":5}],[{"id":2}',
        '{"id":5}] }', '{"id":5}] {"id":2}', '{"id":5},', ",", "]", "}",
    )),
    ('{"id":5,"user":{"id":7},"user":{"id":9}}', 5, 9, None),
    ('{"id":5,"user":{"id":7},"text":"caf\\u00e9 \\u3042"}', 5, 7, "café あ"),
]


def test_raw_lines(spark):
    lines = spark.createDataFrame([(r[0],) for r in RAW], "value string")
    found = [tuple(r) for r in parse_raw_posts(lines).collect()]
    assert found == [r[1:] for r in RAW]


def test_only_asked_fields_are_parsed(spark):
    lines = spark.createDataFrame([(RAW[0][0],)], "value string")
    assert parse_raw_posts(lines, ["user_id"]).collect() == [(7,)]
    assert parse_raw_posts(lines, ["text"]).columns == ["text"]


def test_counts_over_broken_lines(spark):
    lines = spark.createDataFrame([(r[0],) for r in RAW], "value string")
    posts = parse_raw_posts(lines)
    assert counts.unique_posts(posts).first()[0] == len({r[1] for r in RAW if r[1] is not None})
    assert counts.malformed_posts(posts).first()[0] == sum(r[2] is None for r in RAW)
    per_user = {r["user_id"]: r["n_posts"] for r in counts.posts_per_user(posts).collect()}
    assert per_user[0] == 1 and None not in per_user


def test_unique_posts_without_a_broken_line(spark):
    posts = spark.createDataFrame([(1,), (1,), (2,)], "post_id long")
    assert counts.unique_posts(posts).first()[0] == 2


def test_split_words_is_python_split(spark):
    texts = [
        "a  b",
        " lead and trail ",
        "",
        "   ",
        "tab\tnew\nline\r\nvt\x0bff\x0c",
        "nbsp ideographic　nel\u0085end",
        "fs\x1cgs\x1drs\x1eus\x1fend",
        "zero​width stays",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(split_words(F.col("t"))).collect()]
    assert found == [t.split() for t in texts]


def tagged(spark, lines, fields=("user_id", "user_name", "user_description")):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    return [tuple(r) for r in parse_tagged_posts(df, fields).collect()]


def test_tagged_lines(spark):
    json = '{"id":1,"user":{"id":9,"name":"Ann","description":"d e"}}'
    found = tagged(
        spark,
        [
            f"Hi there\tN V\t0.9\t{json}",
            f"Hi\tN\t0.9\t{json[:-1]}",
            "only tokens",
            "two fields\tN N",
            f"\t\t\t{json}",
        ],
    )
    assert found == [
        (["Hi", "there"], ["N", "V"], 9, "Ann", "d e"),
        (["Hi"], ["N"], None, None, None),
        (["only", "tokens"], None, None, None, None),
        (["two", "fields"], ["N", "N"], None, None, None),
        ([], [], 9, "Ann", "d e"),
    ]
    assert tagged(spark, ["a\tN"], []) == [(["a"], ["N"])]


def test_distinct_words(spark):
    rows = [
        (["A", "a", "b"], ["N", "N", "V"]),
        (["a", "a"], ["N", "V"]),
        (["a", "b", "c"], ["N"]),
        (["a"], ["N", "V"]),
        ([], []),
        (["a"], None),
    ]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>")
    found = [r[0] for r in df.select(distinct_words(F.col("tokens"), F.col("tags"))).collect()]
    assert found == [["a\tN", "b\tV"], ["a\tN", "a\tV"], ["a\tN"], ["a\tN"], [], None]


def test_word_parts(spark):
    df = spark.createDataFrame([("a b\tc\t^",), ("x\tN",)], "w string")
    found = df.select(word_token(F.col("w")), word_tag(F.col("w"))).collect()
    assert [tuple(r) for r in found] == [("a b\tc", "^"), ("x", "N")]


def test_many_files_one_scan(spark, tmp_path):
    paths = numbered_paths(str(tmp_path), "t", 1, 2)
    assert [p[-3:] for p in paths] == ["t01", "t02"]
    for at, path in enumerate(paths):
        with open(path, "w") as out:
            out.write('{"id":%d,"user":{"id":1},"text":"w"}\nbroken\n' % at)
    posts = read_raw_posts(spark, paths)
    assert posts.count() == 4
    assert counts.unique_posts(posts).first()[0] == 2
    assert posts.rdd.getNumPartitions() <= 2


def test_no_files(spark):
    assert read_raw_posts(spark, []).count() == 0
    assert read_tagged_posts(spark, []).count() == 0
    assert counts.unique_posts(read_raw_posts(spark, [])).first()[0] == 0


def test_union(spark):
    one = spark.createDataFrame([(1, 2)], "post_id long, user_id long")
    two = spark.createDataFrame([(3, 1)], "user_id long, post_id long")
    assert sorted(map(tuple, union_posts([one, two]).collect())) == [(1, 2), (1, 3)]
    assert union_posts([]).count() == 0
