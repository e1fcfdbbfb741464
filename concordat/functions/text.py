"""Text columns: trimming, folding, quoting, paths, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.fixed_values import MARKDOWN_MARKS, TYPOGRAPHIC, WHITESPACE


def _runs(chars: str) -> str:
    """The characters for a regex class, neighbours as ranges: a class is asked entry by entry."""
    codes = sorted(map(ord, chars))
    firsts = [c for c in codes if c - 1 not in codes]
    lasts = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts))


# One regex class for all whitespace; Java's \s alone only knows the ASCII ones.
SPACE = f"[{_runs(WHITESPACE)}]"
NON_SPACE = "[^" + SPACE[1:]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def squash(c: Column | str) -> Column:
    """Runs of whitespace become one blank, ends are trimmed.  Texts of single blanks and ASCII signs have no runs."""
    c = col(c)
    runs = F.regexp_replace(c, SPACE + "+", " ")
    return F.btrim(F.when(c.rlike("[^!-~]{2}|[^ -~]"), runs).otherwise(c), F.lit(" "))


def fold_case(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def none_if_empty(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def subject_key(c: Column | str) -> Column:
    return fold_case(squash(c))


def scope_key(c: Column | str) -> Column:
    """Letters and digits of the label, lower case, one blank between words."""
    words = F.regexp_replace(fold_case(c), "[^0-9a-z]+", " ")
    return none_if_empty(F.btrim(words, F.lit(" ")))


def basename(uri: Column | str) -> Column:
    uri = col(uri)
    path = F.rtrim(F.replace(uri, F.lit("\\"), F.lit("/")), F.lit("/"))
    name = F.substring_index(path, "/", -1)
    return F.coalesce(F.when(name != "", name).otherwise(uri), F.lit(""))


def file_stem(uri: Column | str) -> Column:
    return F.regexp_replace(basename(uri), r"\.[^.]*$", "")


def suffix(uri: Column | str) -> Column:
    """The lower-case suffix with its dot, empty when the name has none."""
    return F.lower(F.regexp_extract(basename(uri), r"[^.](\.[^.]+)$", 1))


def content_text(c: Column | str) -> Column:
    """Line ends unified, lines trimmed on the right, the whole trimmed."""
    c = col(c)
    unified = F.regexp_replace(c, "\r\n?", "\n")
    trailing = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE if ch != "\n") + "]+(?=\n|$)"
    return strip(F.when(c.rlike("[\r\n]"), F.regexp_replace(unified, trailing, "")).otherwise(c))


def content_hash(c: Column | str) -> Column:
    return F.sha2(content_text(c), 256)


def fold_typography(c: Column | str) -> Column:
    return F.translate(col(c), "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))


def fold_markdown(c: Column | str) -> Column:
    """Layout marks become blanks, one for one, so offsets stay true."""
    blanked = F.translate(col(c), MARKDOWN_MARKS, " " * len(MARKDOWN_MARKS))
    # Quote and heading marks count only in the run that starts a line.
    return F.regexp_replace(blanked, r"(?m)^([ \t]*)[>#]|\G(?!^)[>#]", "$1 ")


def quoted(c: Column | str) -> Column:
    """The value in quotes with control characters escaped, as findings show it."""
    c = col(c)
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single = c.contains("'")
    double = c.contains('"')
    return (
        F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def capitalised(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def title_case(c: Column | str) -> Column:
    """Every run of letters starts with a capital."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalised), "")


def iso(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")
