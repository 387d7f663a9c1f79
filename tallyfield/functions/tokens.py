"""The counting rule: maximal runs of word characters that are digits only, as integers of at most five digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest integer that is counted.
TOP = 10_000
# Zeros of digit blocks beyond ASCII that are mapped before the cast.
ZEROS = "٠۰߀०০੦૦୦௦౦೦൦๐໐༠၀០᠐０"
_WIDE = "".join(chr(ord(z) + i) for z in ZEROS for i in range(10))


def digit_tokens(text: Column) -> Column:
    """array<string> of the digit tokens of a text."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: F.rlike(x, F.lit(r"^\p{Nd}+$")))


def token_value(token: Column) -> Column:
    """The token as int, null beyond five significant digits; the length is checked before the cast."""
    plain = F.ltrim(F.translate(token, _WIDE, "0123456789" * len(ZEROS)), F.lit("0"))
    return F.when(plain == "", 0).when(F.length(plain) <= 5, plain.try_cast("int"))
