"""The same queries as plain SQL for an independent engine."""

from __future__ import annotations

from postlytics.plans.queries import FAR, K, LONG_TAIL, MIN_OCCURS, MIN_POSTS, MOST_ROUNDS, ROUNDS, TOLERANCE, TOP
from postlytics.plans.tables import TAG_RULE

_DOCUMENT_WORDS = r"""
words AS (
  SELECT w AS word FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents) WHERE w <> ''
),
histogram AS (
  SELECT n, count(*) AS keys FROM (SELECT word, count(*) AS n FROM words GROUP BY word) GROUP BY n
)"""

_LINE_POSTS = rf"""
posts AS MATERIALIZED (
  SELECT row_number() OVER () AS post, user_id, user_name, user_description, line FROM (
    SELECT doc_id AS user_id, source AS user_name, lang AS user_description,
           unnest(string_split(text, chr(10))) AS line FROM documents)
),
tokens AS (
  SELECT post, user_id, w, {TAG_RULE} AS tag FROM (
    SELECT post, user_id, unnest(string_split_regex(line, '\s+')) AS w FROM posts) WHERE w <> ''
)"""

_WORDS = f"""{_LINE_POSTS},
words AS (SELECT DISTINCT post, lower(w) AS token, tag FROM tokens),
df AS MATERIALIZED (
  SELECT row_number() OVER () AS id, token, tag, tag IN ('N','S','^','Z','L','M') AS content, df
  FROM (SELECT token, tag, count(*) AS df FROM words GROUP BY token, tag)
)"""


def _pairs(above: int = 0) -> str:
    return f"""{_WORDS},
coded AS MATERIALIZED (
  SELECT list(id) AS ids, list(id) FILTER (WHERE content) AS firsts
  FROM words JOIN df USING (token, tag) WHERE df > {above} GROUP BY post
),
anchored AS (SELECT ids, unnest(firsts) AS w1 FROM coded),
listed AS (SELECT w1, unnest(ids) AS w2 FROM anchored),
pairs AS MATERIALIZED (
  SELECT w1, w2, count(*) AS pc FROM listed WHERE w1 <> w2 GROUP BY w1, w2 HAVING count(*) > {above}
)"""


def _pair_listing(above: int = 0) -> str:
    return f"""WITH {_pairs(above)}
SELECT a.token AS token1, a.tag AS tag1, b.token AS token2, b.tag AS tag2, pc AS pair_count
FROM pairs JOIN df a ON a.id = w1 JOIN df b ON b.id = w2"""


def _informative(above: int = 0) -> str:
    return f"""WITH {_pairs(above)},
sums AS (SELECT w1, sum(pc) AS wp FROM pairs GROUP BY w1),
operands AS (
  SELECT w1, a.token, a.tag, a.df::DOUBLE AS c1, b.df::DOUBLE AS c2, pc::DOUBLE AS pc, wp::DOUBLE AS wp,
         (SELECT sum(df) FROM df)::DOUBLE AS total
  FROM pairs JOIN sums USING (w1) JOIN df a ON a.id = w1 JOIN df b ON b.id = w2
),
mixed AS (
  SELECT *, total - wp AS away, c2 - pc AS alone, pc * (total - wp) + wp * (c2 - pc) AS mix FROM operands
)
SELECT token, tag, round((
    sum(pc / wp * log2(2 * pc * away / mix)
      + CASE WHEN alone > 0 THEN alone / away * log2(2 * wp * alone / mix) ELSE 0 END)
    + (any_value(total) - sum(c2) - any_value(c1)) / any_value(away)) / 2, 9) AS jsd
FROM mixed GROUP BY w1, token, tag"""


_PROFILES = f"""{_LINE_POSTS},
users AS MATERIALIZED (
  SELECT user_id, count(*) AS n_posts FROM posts GROUP BY user_id HAVING count(*) >= {MIN_POSTS}
),
terms AS MATERIALIZED (
  SELECT user_id, w AS token, count(*) AS occurs, any_value(n_posts) AS n_posts
  FROM tokens JOIN users USING (user_id) GROUP BY user_id, w
),
vocabulary AS MATERIALIZED (
  SELECT token, occurs, row_number() OVER (ORDER BY token) - 1 AS idx
  FROM (SELECT token, sum(occurs) AS occurs FROM terms GROUP BY token HAVING sum(occurs) >= {MIN_OCCURS})
),
vectors AS MATERIALIZED (
  SELECT user_id, idx, terms.occurs / n_posts AS weight FROM terms JOIN vocabulary USING (token)
),
norms AS (
  SELECT user_id, coalesce(sum(weight * weight), 0) AS xn FROM users LEFT JOIN vectors USING (user_id) GROUP BY user_id
),
ids AS (
  SELECT user_id, row_number() OVER (ORDER BY md5(user_id::VARCHAR)) - 1 AS cid FROM users
  QUALIFY cid < {K}
),
centers0 AS MATERIALIZED (SELECT cid, idx, weight AS value FROM vectors JOIN ids USING (user_id))"""


def _assigned(at: int) -> str:
    """Users with the nearest of the centres ``at``."""
    return f"""
assigned{at} AS MATERIALIZED (
  SELECT user_id, cid, distance2 FROM (
    SELECT user_id, cid, round(min(d) OVER (PARTITION BY user_id), 12) AS distance2,
           d <= min(d) OVER (PARTITION BY user_id) + 1e-12 * (xn + max(cn) OVER ()) AS nearest
    FROM (SELECT norms.user_id, center_norms.cid, xn, cn, greatest(xn - 2 * coalesce(dot, 0) + cn, 0) AS d
    FROM norms
    CROSS JOIN (
      SELECT ids.cid, coalesce(sum(value * value), 0) AS cn
      FROM ids LEFT JOIN centers{at} c ON c.cid = ids.cid GROUP BY ids.cid) center_norms
    LEFT JOIN (
      SELECT user_id, cid, sum(weight * value) AS dot
      FROM vectors JOIN centers{at} USING (idx) GROUP BY user_id, cid) dots
    ON dots.user_id = norms.user_id AND dots.cid = center_norms.cid))
  WHERE nearest QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cid) = 1
)"""


def _moved(at: int) -> str:
    """The centres ``at + 1``: means of the users assigned to the centres ``at``."""
    return f"""
centers{at + 1} AS MATERIALIZED (
  SELECT cid, idx, sum(weight) / any_value(size) AS value
  FROM assigned{at}
  JOIN (SELECT cid, count(*) AS size FROM assigned{at} GROUP BY cid) USING (cid)
  JOIN vectors USING (user_id) GROUP BY cid, idx
  UNION ALL
  SELECT cid, idx, value FROM centers{at} WHERE cid NOT IN (SELECT cid FROM assigned{at})
)"""


def _rounds(n: int) -> str:
    steps = [_PROFILES]
    for at in range(n):
        steps += [_assigned(at), _moved(at)]
    return ",".join(steps)


# The sampled authors as centres, and one more that is far from all.
_FAR = _PROFILES.replace("ids AS (", "chosen AS (").replace(
    "centers0 AS MATERIALIZED (SELECT cid, idx, weight AS value FROM vectors JOIN ids USING (user_id))",
    f"centers0 AS MATERIALIZED (SELECT cid, idx, weight AS value FROM vectors JOIN chosen USING (user_id) UNION ALL SELECT {K}, 0, {FAR}::DOUBLE),"
    f"ids AS (SELECT cid, user_id FROM chosen UNION ALL SELECT {K}, NULL)",
)


def _move(at: int) -> str:
    """Summed squared move from the centres ``at`` to the next."""
    return f"""
move{at} AS (
  SELECT coalesce(sum(pow(coalesce(a.value, 0) - coalesce(b.value, 0), 2)), 0) AS delta
  FROM centers{at} a FULL JOIN centers{at + 1} b ON a.cid = b.cid AND a.idx = b.idx
)"""


def _stopped() -> str:
    """The centres after the first round whose move is small enough, or the last."""
    moves = ",".join(_move(at) for at in range(MOST_ROUNDS))
    picks = " UNION ALL ".join(
        f"SELECT {at + 1} AS rounds, cid, idx, value FROM centers{at + 1} WHERE "
        + " AND ".join([*(f"(SELECT delta FROM move{b}) > {TOLERANCE}" for b in range(at)), *([f"(SELECT delta FROM move{at}) <= {TOLERANCE}"] if at < MOST_ROUNDS - 1 else ["true"])])
        for at in range(MOST_ROUNDS)
    )
    return f"WITH {_rounds(MOST_ROUNDS)},{moves} SELECT rounds::BIGINT AS rounds, cid, idx, round(value, 9) AS value FROM ({picks}) WHERE value <> 0"


_ONE_ROUND = _rounds(1)
_CLUSTERS = ",".join([_ONE_ROUND, _assigned(1)])

_CENTERS = "SELECT cid, idx, round(value, 9) AS value FROM centers{at} WHERE value <> 0"

_ASSIGNED = f"""WITH {_PROFILES},{_assigned(0)}
SELECT user_id, cid, round(distance2, 9) AS distance2 FROM assigned0"""

ORACLES: dict[str, str] = {
    "unique_posts": """
SELECT count(DISTINCT event_id) AS unique_posts
FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)""",
    "malformed_posts": "SELECT count(*) AS malformed_posts FROM events WHERE event_id % 97 = 0",
    "raw_post_scan": """
SELECT CASE WHEN event_id % 97 <> 0 THEN event_id END AS post_id,
       CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id,
       CASE WHEN event_id % 97 <> 0 THEN event_type END AS text
FROM events""",
    "tagged_post_scan": f"""WITH {_LINE_POSTS}
SELECT p.user_id, n_posts, user_name, coalesce(tokens, 0) AS tokens, coalesce(nouns, 0) AS nouns
FROM (
  SELECT CASE WHEN user_id % 7 <> 3 THEN user_id END AS user_id, count(*) AS n_posts,
         min(CASE WHEN user_id % 7 <> 3 THEN user_name END) AS user_name FROM posts GROUP BY 1
) p LEFT JOIN (
  SELECT CASE WHEN user_id % 7 <> 3 THEN user_id END AS user_id, count(*) AS tokens,
         count(*) FILTER (WHERE tag = 'N') AS nouns FROM tokens GROUP BY 1
) t ON p.user_id IS NOT DISTINCT FROM t.user_id""",
    "posts_per_user": "SELECT user_id, count(*) AS n_posts FROM events GROUP BY user_id",
    "user_post_histogram": """
SELECT n, count(*) AS keys FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY n""",
    "union_distinct_posts": """
SELECT event_id AS post_id FROM events WHERE event_type = 'view'
UNION SELECT event_id FROM events WHERE event_type <> 'view'
UNION SELECT event_id FROM events WHERE event_type = 'view'""",
    "vocabulary_size": f"WITH {_DOCUMENT_WORDS} SELECT count(DISTINCT word) AS vocabulary_size FROM words",
    "word_frequency_histogram": f"WITH {_DOCUMENT_WORDS} SELECT n, keys FROM histogram",
    "word_frequency_top": f"WITH {_DOCUMENT_WORDS} SELECT n, keys FROM histogram ORDER BY n DESC LIMIT {TOP}",
    "word_frequency_bottom": f"WITH {_DOCUMENT_WORDS} SELECT n, keys FROM histogram ORDER BY n LIMIT {TOP}",
    "document_frequency": f"WITH {_WORDS} SELECT token, tag, df FROM df",
    "word_pair_counts": f"""
SELECT token1, tag1, tag2, count(*) AS partners, sum(pair_count) AS pair_sum, max(pair_count) AS top_count,
       sum(length(token2) * pair_count) AS letters
FROM ({_pair_listing()}) GROUP BY token1, tag1, tag2""",
    "word_pair_counts_filtered": _pair_listing(LONG_TAIL),
    "word_pair_sums": f"""WITH {_pairs()}
SELECT token, tag, partners, pair_sum
FROM (SELECT w1, count(*) AS partners, sum(pc) AS pair_sum FROM pairs GROUP BY w1) JOIN df ON id = w1""",
    "informative_words": _informative(),
    "informative_words_filtered": _informative(LONG_TAIL),
    "active_users": f"WITH {_PROFILES} SELECT user_id, n_posts FROM users",
    "vocabulary": f"WITH {_PROFILES} SELECT token, occurs, idx FROM vocabulary",
    "user_term_weights": f"WITH {_PROFILES} SELECT user_id, idx, round(weight, 9) AS weight FROM vectors",
    "kmeans_assign": _ASSIGNED,
    "kmeans_assign_by_join": _ASSIGNED,
    "kmeans_step": f"WITH {_ONE_ROUND} {_CENTERS.format(at=1)}",
    "kmeans_fit": f"WITH {_rounds(ROUNDS)} {_CENTERS.format(at=ROUNDS)}",
    "kmeans_empty_cluster": f"WITH {_FAR},{_assigned(0)},{_moved(0)} {_CENTERS.format(at=1)}",
    "kmeans_stop": _stopped(),
    "cluster_members": f"""WITH {_CLUSTERS}
SELECT ids.cid, a.user_id FROM ids LEFT JOIN assigned1 a ON a.cid = ids.cid""",
    "cluster_sizes": f"""WITH {_CLUSTERS}
SELECT ids.cid, count(a.user_id) AS size FROM ids LEFT JOIN assigned1 a ON a.cid = ids.cid GROUP BY ids.cid""",
    "cluster_top_tokens": f"""WITH {_ONE_ROUND}
SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY round(value, 12) DESC, token) AS rank,
       token, round(value, 9) AS weight
FROM centers1 JOIN vocabulary USING (idx) WHERE value <> 0
QUALIFY rank <= {TOP}""",
    "cluster_top_users": f"""WITH {_CLUSTERS},
info AS (SELECT user_id, min({{'a': user_name, 'b': user_description}}) AS i FROM posts GROUP BY user_id)
SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY n_posts DESC, user_id) AS rank, user_id, n_posts,
       i.a AS user_name, i.b AS user_description
FROM assigned1 JOIN users USING (user_id) JOIN info USING (user_id)
QUALIFY rank <= {TOP}""",
    "centers_round_trip": f"""WITH {_ONE_ROUND}
SELECT form, cid, idx, round(value, 9) AS value
FROM centers1 CROSS JOIN (SELECT unnest(['table', 'blocks', 'lines']) AS form) WHERE value <> 0""",
}

# A job over files gives what its operator gives over the table that the files were written from, but that broken lines do not count.
_GOOD = "(SELECT * FROM events WHERE event_id % 97 <> 0)"

JOB_ORACLES: dict[str, str] = {
    "job_unique_posts": f"SELECT count(DISTINCT event_id) AS unique_posts FROM {_GOOD}",
    "job_malformed_posts": ORACLES["malformed_posts"],
    "job_user_histogram": f"SELECT n, count(*) AS keys FROM (SELECT user_id, count(*) AS n FROM {_GOOD} GROUP BY user_id) GROUP BY n",
    "job_unique_words": ORACLES["vocabulary_size"],
    "job_word_histogram": ORACLES["word_frequency_histogram"],
    "job_informative_words": ORACLES["informative_words"],
    "job_cluster_users": ORACLES["kmeans_fit"],
    "job_predict_users": ORACLES["cluster_members"],
    "job_analyze_tokens": ORACLES["cluster_top_tokens"],
    "job_analyze_users": ORACLES["cluster_top_users"],
}
