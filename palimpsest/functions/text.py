"""Text functions as Column expressions; all run in the JVM and work on streams as well as on tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: character pairs that scans confuse, and look-alikes, applied in this order
# to lower-cased text.
CANON_PAIRS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m")]
CANON_FROM, CANON_TO = "oli|sz", "011152"
#: What counts as white space: that of Unicode, and the four ASCII separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"


def text_of(column: Column | str) -> Column:
    """Null text is empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def canon(column: Column | str) -> Column:
    """Canonical form of damaged text: broken words rejoined, look-alike characters made equal, blanks collapsed."""
    out = F.lower(F.replace(F.replace(text_of(column), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")))
    for wide, narrow in CANON_PAIRS:
        out = F.replace(out, F.lit(wide), F.lit(narrow))
    return F.regexp_replace(F.translate(out, CANON_FROM, CANON_TO), SPACES, " ")


def tokens(column: Column | str) -> Column:
    """Lower-case ASCII words and numbers, a number keeping one decimal part."""
    return F.regexp_extract_all(F.lower(text_of(column)), F.lit(TOKEN), F.lit(0))


def indexed_text(title: str, section: str, text: str) -> Column:
    """What is indexed of a chunk: its title, section and text."""
    return F.concat_ws(" ", text_of(title), text_of(section), text_of(text))


def contains_answer(passages: Column, answer: Column | str, canonical: bool = False) -> Column:
    """Whether an answer stands in passages, joined by blanks so that it may run over from one to the next."""
    blob = F.array_join(passages, " ")
    return F.contains(canon(blob), canon(answer)) if canonical else F.contains(blob, text_of(answer))


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; values without a name in it are not used."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
