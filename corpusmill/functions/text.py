"""Text expressions inside the JVM.  White space is Unicode's; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Runs of white space as Unicode has it (a union of code points in brackets is three times slower).
BLANKS = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Without NUL characters, runs of white space as one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, "\0", ""), BLANKS, " "))


def collapse_lines(text: Column) -> Column:
    """Line ends unified; every line collapsed, line breaks kept."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.array_join(F.transform(lines, collapse), "\n")


def same_text(a: Column, b: Column) -> Column:
    return F.lower(collapse(a)) == F.lower(collapse(b))


def question_key(text: Column) -> Column:
    """The form under which questions are looked up (lower case stands for case folding)."""
    return F.lower(collapse(text))


def substitute(text: Column, rules: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Ordered regular-expression substitutions; groups are written $1."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, ("(?i)" if ignore_case else "") + pattern, replacement)
    return text


def replace_terms(text: Column, terms: dict[str, str]) -> Column:
    """Ordered literal replacements."""
    for old, new in terms.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def title_case(text: Column) -> Column:
    """Capital letter behind every character that isn't a letter, small letters elsewhere."""
    low = F.lower(text)
    chars = F.split(low, "")
    raised = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(c)).otherwise(c))
    return F.array_join(raised, "")


def clean_title(text: Column) -> Column:
    return title_case(F.btrim(text, F.lit(" .:-")))


def sentences(text: Column) -> Column:
    """Rule-based sentences: cut at white space behind . ! ? (closing quotes may stand between)."""
    marked = F.regexp_replace(text, r"([.!?…][\"'”’»)\]]*)" + BLANKS, "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(F.trim(s)) > 0)


def page_locator(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page:"), start.cast("string"))).otherwise(F.concat(F.lit("pages:"), start.cast("string"), F.lit("-"), end.cast("string")))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace ``{{name}}`` by columns; null values become empty.  A placeholder that is left raises."""
    import re

    missing = set(re.findall(r"{{(\w+)}}", template)) - set(values)
    if missing:
        raise ValueError(f"unresolved placeholders: {sorted(missing)}")
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def repeated_share(items: Column) -> Column:
    """Number of repeated elements of an array beyond their first."""
    return F.size(items) - F.size(F.array_distinct(items))


PAGE_MARK = r"<<<PAGE:(\d+)>>>"


def page_marks(text: Column) -> Column:
    """The numbers of the page markers in a text, in reading order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARK), F.lit(1)), lambda n: n.try_cast("int"))


def without_page_marks(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_MARK, "")


# Numbers of words that a fallback anchor has, longest first.
ANCHOR_WORDS = (12, 10, 8, 6)


def locate_span(source: Column, text: Column, cursor: Column) -> Column:
    """``begin, end, how`` of a text in its source, from ``cursor`` on.

    how is exact for the text itself; anchor where only its first and last words, in this order and
    whatever stands between the words, are found, the last ones behind the first; else missing (null offsets), and empty for an empty
    text.  Offsets count UTF-16 units where characters beyond the basic plane come before.
    """
    at = F.greatest(cursor, F.lit(0))
    place = F.call_function("locate", text, source, (at + 1).cast("int"))
    exact = F.when(place > 0, F.struct((place - 1).cast("long").alias("begin"), (place - 1 + F.length(text)).cast("long").alias("end"), F.lit("exact").alias("how")))
    rest = F.substring(source, (at + 1).cast("int"), F.length(source))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9']+"), F.lit(0))

    def pattern(part: Column) -> Column:
        return F.concat(F.lit(r"(?i)\b"), F.array_join(part, r"\W+"), F.lit(r"\b"))

    tries = [exact]
    for width in ANCHOR_WORDS:
        many = F.size(words) > width
        first = F.when(many, F.slice(words, 1, width)).otherwise(words)
        last = F.when(many, F.slice(words, F.greatest(F.size(words) - width + 1, F.lit(1)), F.lit(width))).otherwise(words)
        begin = F.regexp_instr(rest, pattern(first))
        behind = begin - 1 + F.length(F.call_function("regexp_extract", rest, pattern(first), F.lit(0)))
        tail = F.substring(rest, (behind + 1).cast("int"), F.length(rest))
        finish = F.regexp_instr(tail, pattern(last))
        reach = behind + finish - 1 + F.length(F.call_function("regexp_extract", tail, pattern(last), F.lit(0)))
        tries.append(F.when((F.size(words) > 0) & (begin > 0) & (finish > 0), F.struct((at + begin - 1).cast("long").alias("begin"), (at + reach).cast("long").alias("end"), F.lit("anchor").alias("how"))))
    none = F.lit(None).cast("long")
    missing = F.struct(none.alias("begin"), none.alias("end"), F.lit("missing").alias("how"))
    empty = F.struct(none.alias("begin"), none.alias("end"), F.lit("empty").alias("how"))
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.coalesce(*tries, missing))
