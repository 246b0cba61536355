"""Text column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters on the left become the ones on the right; what has no partner goes.
CHARACTERS = {"º": "°", "−": "-", "‒": "–", "—": "–", "―": "–", "‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "●": "•", "▪": "•", "◦": "•", "‣": "•", "⁃": "•", "\t": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "­": ""}
#: Words without weight in retrieval.
STOP_WORDS = "a an and are as at be been by for from has have in into is it its of on or shall should such that the their them then there these this those to under upon was were which will with within without all any each other than per not no only also may must can being both".split()


def mapped_characters(text: Column) -> Column:
    """Line ends to LF and look-alike characters to one form."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    kept = {k: v for k, v in CHARACTERS.items() if v}
    gone = [k for k, v in CHARACTERS.items() if not v]
    return F.translate(lines, "".join(kept) + "".join(gone), "".join(kept.values()))


def line_shape(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"[0-9]+", "#")


def is_page_counter(line: Column) -> Column:
    lower = F.lower(line)
    return lower.rlike(r"^\s*(page\s*)?[0-9]+\s*(of|/)\s*[0-9]+\s*$") | lower.rlike(r"^\s*-?\s*page\s+[0-9]+\s*-?\s*$")


def stem(token: Column) -> Column:
    """Cuts plural, -ing and -ed endings; short tokens and ones with digits stay."""
    n = F.length(token)
    ends = lambda s: F.endswith(token, F.lit(s))
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    # Most words have none of the endings: these are not searched for digits.
    return (
        F.when((n <= 3) | ~(ends("s") | ends("ing") | ends("ed")) | token.rlike("[0-9]"), token)
        .when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("sses"), cut(2))
        .when(ends("ing") & (n > 5), cut(3))
        .when(ends("ed") & (n > 4) & ~ends("eed"), cut(2))
        .when(ends("s") & ~ends("ss") & ~ends("us") & ~ends("is"), cut(1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Stemmed words of ASCII letters and digits, without stop words and single characters."""
    return F.transform(F.filter(words(text), has_weight), stem)


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^a-z0-9]+")


def has_weight(word: Column) -> Column:
    return (F.length(word) > 1) & ~word.isin(STOP_WORDS)


def any_of(phrases: list[str]) -> str:
    """A pattern of any of the phrases, the longest first; a space in them stands for white space or a hyphen, * at an end for more letters."""
    parts = []
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        words = "".join(c if c.isalnum() or c in " *" else "\\" + c for c in phrase)
        parts.append(words.replace(" ", r"[\s-]+").replace("*", r"\w*"))
    return "(?:" + "|".join(parts) + ")"


def has_any(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text has one of the phrases as words."""
    return text.rlike(rf"(?<!\w){any_of(phrases)}(?!\w)")


def ends_with_any(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text ends with one of the phrases."""
    return text.rlike(rf"(?<!\w){any_of(phrases)}\s*$")


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern (with no groups that capture) as structs (start, end, raw), 0-based half-open."""
    marked = F.regexp_replace(text, f"({pattern})", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0001")
    empty = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        raw, rest = F.substring_index(piece, "\u0002", 1), F.substring_index(piece, "\u0002", -1)
        end = acc["at"] + F.length(raw)
        one = F.struct(acc["at"].alias("start"), end.alias("end"), raw.alias("raw"))
        return F.struct((end + F.length(rest)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), empty, add, lambda acc: acc["out"])


def designation_key(designation: Column) -> Column:
    """Upper case, PART as PT, SECTION and SEC. as SEC, letters, digits and strokes only."""
    key = F.regexp_replace(F.upper(designation), "PART", "PT")
    return F.regexp_replace(F.regexp_replace(key, r"SECTION|SEC\.?", "SEC"), r"[^A-Z0-9/]", "")


def title_of(name: Column, file_name: Column, text: Column, most: int = 90) -> Column:
    """The given name, else the file's stem with spaces, else the first line of more than 3 characters."""
    stem_ = F.trim(F.regexp_replace(F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ""), r"[_-]+", " "))
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 3), 0)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.substring(F.coalesce(blank(name), blank(stem_), F.trim(first)), 1, most)


def fnv1a(text: Column) -> Column:
    """FNV-1a in 32 bits over the code points of a text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261).cast("long"), step)
