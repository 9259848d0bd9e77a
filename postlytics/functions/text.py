"""Token and tag expressions for short posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character Python's str.split() treats as a blank.  Java's
# \s in Unicode mode covers all of them except the four separators U+001C-U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Part-of-speech tags that mark a content word (common noun and
# possessive, proper noun and possessive, and the two verbal contractions).
CONTENT_TAGS = ("N", "S", "^", "Z", "L", "M")


def split_words(text: Column) -> Column:
    """Non-empty pieces of ``text`` between runs of blanks."""
    return F.array_remove(F.split(text, BLANKS), "")


def distinct_words(tokens: Column, tags: Column) -> Column:
    """Distinct words of one post.

    A word is the token in lower case, a tab and the tag, so the same spelling
    under two tags makes two words.  Tokens and tags pair by position and the
    longer list is cut to the shorter.
    """
    paired = F.least(F.size(tokens), F.size(tags))
    words = F.zip_with(
        F.slice(tokens, F.lit(1), paired),
        F.slice(tags, F.lit(1), paired),
        lambda token, tag: F.concat(F.lower(token), F.lit("\t"), tag),
    )
    return F.array_distinct(words)


def word_tag(word: Column) -> Column:
    return F.substring_index(word, "\t", -1)


def word_token(word: Column) -> Column:
    return F.left(word, F.length(word) - F.length(word_tag(word)) - 1)


def is_content(tag: Column, content_tags=CONTENT_TAGS) -> Column:
    return tag.isin(*content_tags)


def each(array: Column) -> Column:
    """One row per element of an array that a projection below computes.

    For a bare column the optimizer adds a filter on its size and pushes it
    below the projection, which would compute the array a second time.
    """
    return F.explode(F.slice(array, F.lit(1), F.size(array)))
