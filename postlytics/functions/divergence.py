"""Jensen-Shannon divergence between two distributions over co-occurring words.

For a content word w1 the two distributions are the words seen in posts with w1
and the words seen in posts without it.  With

    total    sum of document frequencies of all words
    wp       sum of pair counts of w1
    pc       posts holding both w1 and w2
    c1, c2   document frequencies of w1 and w2

the divergence is half of: the sum of ``pair_term`` over all w2 seen with w1,
plus the mass of the words never seen with w1 (``(total - sum c2 - c1) / (total - wp)``).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_term(pc: Column, wp: Column, c2: Column, total: Column) -> Column:
    """Contribution of one co-occurring word, in nats: a natural logarithm costs
    half of one to base 2, and there are two per pair.

    Operands turn into DOUBLE first because the products pass BIGINT on a
    large corpus.
    """
    pc, wp, c2, total = (c.cast("double") for c in (pc, wp, c2, total))
    away = total - wp
    alone = c2 - pc
    mix = pc * away + wp * alone
    with_word = pc / wp * F.ln(2 * pc * away / mix)
    without_word = F.when(alone > 0, alone / away * F.ln(2 * wp * alone / mix)).otherwise(0.0)
    return with_word + without_word


def divergence(terms: Column, c2_sum: Column, c1: Column, wp: Column, total: Column) -> Column:
    """Divergence of w1 in bits, from its summed pair terms."""
    unseen = (total - c2_sum - c1).cast("double") / (total - wp).cast("double")
    return (terms / log(2) + unseen) / 2
