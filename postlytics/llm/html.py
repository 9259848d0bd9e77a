"""Main text of pages, by differencing pages of neighbouring URLs.

A page is read as lines, one per block. Where the markup says what a line is -
part of an article, or of a menu, footer, advert and the like - it decides. All
other lines are compared with those of the pages with the nearest URL paths on
the same host: what the longest common subsequences share is the site's, not the page's.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.words import numbered
from postlytics.sources.staging import cut_lineage

# Fixed lists of HTML's elements.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input label menu nav noembed noframes noscript object script select style svg "
    "template textarea title video".split()
)
_MAIN = frozenset(["article", "main"])
#: Words in a class, id or role that name what is not the article.
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|byline-social|comments?|cookies?|consent|disqus|dialog|disclaimer|footer|header|masthead|"
    r"menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|popup|promo|promoted|related|replies|reply|respond|search|share|sharing|sidebar|"
    r"side|social|sponsor|sponsored|subscribe|toolbar|widget|alert|complementary|contentinfo|discussion|responses)(?=$|[\s_-]|\d)",
    re.I,
)
#: Words that say what a page has or lacks elsewhere, as in has-sidebar and no-comments.
_ELSEWHERE = re.compile(r"(?:^|\s)(?:has|no|with|without)[_-]\S*", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that class words do not name, as they hold whole pages or articles.
_WHOLE = frozenset(["html", "body", "main", "article"])
_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*|[^>]*)>""")
_TAG_END = re.compile(r"</([A-Za-z]+)")
_BLANKS = re.compile(r"\s+")
#: A new one of these ends an open one, so that its mark does not spread.
_SAME_ENDS = frozenset(["p", "li", "dt", "dd", "option", "tr", "td", "th"])


def _marked(element: str, inside: bool, attributes: str) -> bool:
    """Whether its attributes say that an element is not of the article; ``inside`` one, an article may be a comment."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        named = element not in _WHOLE or element == "article" and inside
        if named and name in ("class", "id", "role") and _CHROME.search(_ELSEWHERE.sub(" ", value)):
            return True
    return False


def page_lines(source: str | None) -> list[tuple[str, bool]]:
    """Lines of a page that may be of its article, and whether the markup says so.

    Character references are decoded, blanks within a block are one space, and what
    the markup marks as something else is left out. Unclosed tags end with what holds them.
    """
    if not source:
        return []
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    #: Open elements: name, whether left out, whether of the article.
    stack: list[tuple[str, bool, bool]] = []
    left_out = main = False

    def end_line() -> None:
        if parts:
            text = _BLANKS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, main))
            parts.clear()

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at and not left_out:
            parts.append(source[at:stop])
        if not m:
            break
        at = m.end()
        token = m[0]
        if token == "<!--":
            end = source.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if token == "<![CDATA[":
            end = source.find("]]>", at)
            at = n if end < 0 else end + 3
            continue
        if not m[1]:
            continue
        name = m[1].lower()
        if token[1] == "/":
            if name in _BLOCKS:
                end_line()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
                # A closing tag within an article does not close what holds the article.
                if stack[depth][0] in _MAIN and name not in ("body", "html") and name not in _MAIN:
                    break
        else:
            if name in _BLOCKS:
                end_line()
            elif name == "br":
                parts.append(" ")
            if name in _SAME_ENDS and stack and stack[-1][0] == name:
                stack.pop()
            if name not in _VOID and not m[2].endswith("/"):
                # A header within an article holds its title.
                inside = bool(stack) and stack[-1][2]
                out = bool(stack) and stack[-1][1] or name in _SKIPPED and not (name == "header" and inside) or _marked(name, inside, m[2])
                stack.append((name, out, inside or name in _MAIN))
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                stack.pop()
        now = bool(stack) and stack[-1][1]
        left_out, main = now, bool(stack) and stack[-1][2]
    end_line()
    return lines


def common_lines(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, through runs of matches instead of a table of all pairs."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < min(len(a), len(b)) - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, low - 1, -1):
        places.setdefault(int(b[j]), []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(low, len(a) - tail):
        for j in places.get(int(a[i]), ()):  # from the last to the first
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(low)] + middle[::-1] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def _site_lines(pages: DataFrame) -> DataFrame:
    """(page, drop): places of lines that a page shares with a neighbour, of ``pages`` (page, url, doubtful).

    ``doubtful`` are hashes of the lines in question; pages without any are still neighbours.
    """
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select("page", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "doubtful")
    placed = cut_lineage(numbered(keyed, ["host", "path", "page"], "pages"), "placed")
    after = placed.select(F.col("page").alias("other"), F.col("host").alias("same_host"), F.col("doubtful").alias("others"), (F.col("at") - 1).alias("at"))
    pairs = placed.join(after, "at").filter((F.col("host") == F.col("same_host")) & (F.size("doubtful") > 0) & (F.size("others") > 0))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                found = common_lines(row.doubtful, row.others)
                if found:
                    out += [(row.page, [i for i, _ in found]), (row.other, [j for _, j in found])]
            yield pd.DataFrame(out, columns=["page", "drop"])

    found = pairs.select("page", "other", "doubtful", "others").mapInPandas(shared, "page string, drop array<int>")
    return found.groupBy("page").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("drop"))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Lines are joined by one space. Lines in an article or main element stay, even
    if another page has them too, but for what is marked as something
    else in there; lines elsewhere go if a nearest page of the host by URL path has them in the same order.
    NULL and empty pages have the empty text; pages without a host, or a NULL url,
    are one host; pages are read whole. Repeated rows are each a page, and
    neighbours, so what is doubtful on them goes; so it does on copies
    of a page without an article element. Further columns are not read; an empty table gives an empty result.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_lines(x.as_py()) for x in batch.column("html")]
            doubtful = [[xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t, main in page if not main] for page in found]
            columns = {
                "page_id": batch.column("page_id"),
                "url": batch.column("url").cast(pa.string()),
                "lines": pa.array([[t for t, _ in page] for page in found], pa.list_(pa.string())),
                "sure": pa.array([[main for _, main in page] for page in found], pa.list_(pa.bool_())),
                "doubtful": pa.array(doubtful, pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    schema = "page_id long, url string, lines array<string>, sure array<boolean>, doubtful array<long>"
    parsed = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lines, schema)
    parsed = parsed.withColumn("page", F.concat_ws(" ", "page_id", F.hex(F.xxhash64("url", "lines"))))
    drop = cut_lineage(_site_lines(parsed.select("page", "url", "doubtful")), "drop")
    # The place of a doubtful line among the doubtful ones, -1 for all others.
    place = F.aggregate(
        "sure",
        F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n")),
        lambda acc, sure: F.struct(
            F.concat(acc["out"], F.array(F.when(sure, F.lit(-1)).otherwise(acc["n"]))).alias("out"),
            (acc["n"] + F.when(sure, 0).otherwise(1)).alias("n"),
        ),
        lambda acc: acc["out"],
    )
    kept = F.filter(F.arrays_zip("lines", place.alias("place")), lambda x: ~F.array_contains(F.col("drop"), x["place"]))
    text = F.when(F.col("drop").isNull(), F.array_join("lines", " ")).otherwise(F.array_join(F.transform(kept, lambda x: x["lines"]), " "))
    out = parsed.join(drop, "page", "left").withColumn("text", text)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
