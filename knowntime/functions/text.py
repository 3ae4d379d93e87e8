"""String expressions: ids, names and tokens, all built-in (no Python per row)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F



def _plain_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility decompositions that leave ASCII: one letter each, and longer ones."""
    single, longer = {}, {}
    for code in range(0x80, 0x10000):
        ch = chr(code)
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[ch] = plain
        elif plain and unicodedata.category(ch).startswith("L"):
            longer[ch] = plain
    return single, longer


SINGLE, LONGER = _plain_letters()


def zero_fill(column: str | Column, width: int) -> Column:
    """Left-pad with zeros; longer values are kept whole."""
    c = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def last_token(column: str | Column) -> Column:
    """Last whitespace-separated word, lower-cased; empty for blank input."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.element_at(F.split(F.lower(F.trim(c)), r"\s+"), -1), F.lit(""))


def squash_name(column: str | Column) -> Column:
    """Lower-case letters and digits only; the short city spelling is expanded first."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.replace(F.lower(c), F.lit("la "), F.lit("losangeles")),
                            "[^a-z0-9]", "")


def fold_accents(column: str | Column) -> Column:
    """Latin letters without their marks; anything else outside ASCII is dropped."""
    c = F.col(column) if isinstance(column, str) else column
    plain = F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))
    for ch, letters in LONGER.items():
        if ord(ch) < 0x250 or 0xFB00 <= ord(ch) <= 0xFB06:  # Latin letters and ligatures
            plain = F.replace(plain, F.lit(ch), F.lit(letters))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def person_key(column: str | Column) -> Column:
    """'Hollis Jr., Marcus' and 'Marcus Hollis Jr.' meet as 'marcus hollis jr'."""
    c = F.col(column) if isinstance(column, str) else column
    comma = F.instr(c, ",")
    first = F.trim(F.substr(c, comma + 1))
    last = F.trim(F.substr(c, F.lit(1), comma - 1))
    flipped = F.when(comma > 0, F.concat_ws(" ", first, last)).otherwise(c)
    spaced = F.regexp_replace(fold_accents(flipped), "[.'’-]", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))
