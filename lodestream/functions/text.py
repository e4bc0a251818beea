"""Text functions as SQL expressions: folding, tokens, estimates, names of files, small parsers and formats."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a token of a subword vocabulary covers on average; the usual estimate where no tokenizer is at hand.
CHARS_A_TOKEN = 4


@cache
def _accents() -> tuple[str, str]:
    """Every letter whose canonical decomposition is one character and combining marks, and that character."""
    pairs = []
    for point in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(point), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    letters, plain = _accents()
    marked = F.regexp_replace(F.translate(text, letters, plain), r"\p{M}+", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), marked).otherwise(text))


def tokens(text: Column) -> Column:
    """Runs of Unicode letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS_A_TOKEN).cast("long")


def snippet(text: Column, most: int) -> Column:
    """The text on one line, cut at most code points with an ellipsis in place of what is cut."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """What follows the name's last dot, in lower case; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def relative_path(path: Column, root: str) -> Column:
    """path below root, or path where it does not lie there."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def united(*lists: Column) -> Column:
    """The entries of several lists in lower case, each once, in order of their first place; null lists and entries don't count."""
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(x, empty) for x in lists])
    return F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.lower(x)))


def listed(text: Column) -> Column:
    """The entries between commas and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def share_of(text: Column) -> Column:
    """'42 %' or '42' as 0.42, within 0 and 1; null where there is no number."""
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    return F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number.cast("double") / 100)))


def byte_size(n: Column) -> Column:
    """Bytes with a decimal unit and, from kB on, one digit behind the point, cut and not rounded."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        tenths = F.floor(n / (1000**power // 10)).cast("long")
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1000**power, shown).otherwise(out)
    return out


def from_epoch(seconds: Column) -> Column:
    """A timestamp of epoch seconds; 0 stands for none."""
    return F.when(seconds != 0, F.timestamp_micros((seconds * 1_000_000).cast("long")))


def file_fingerprint(size: Column, modified: Column) -> Column:
    """What tells a file's versions apart without reading it: size and whole seconds of its last change."""
    return F.concat_ws(":", size.cast("string"), F.unix_timestamp(modified).cast("string"))


def numbered_context(parts: Column) -> Column:
    """An array of (title, text) as one numbered text, parted by rules."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit("\n"), p["text"])), "\n\n---\n\n")


def mentions(answer: Column, name: Column, least: int) -> Column:
    """Whether the answer names something of at least so many characters, whatever the case."""
    return F.coalesce((F.length(name) >= least) & F.contains(F.lower(answer), F.lower(name)), F.lit(False))
