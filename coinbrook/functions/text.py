"""Text columns: four normalizers that are not interchangeable, token similarity, and cells that are safe in spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Compatibility composition, by the ICU library that Spark's collations bring along: all on the JVM. Texts in ASCII, the large part, are passed as they are."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


#: Fixed patterns: what processors put in front of a merchant's name.
PROCESSOR = r"(?i)^(?:sq\s*\*|tst\s*\*|paypal\s*\*|sp\s*\*|vcg\s*\*|pos\s+|db\s+)"
PLACE = r"(?i)(?:#\s*\d+|store\s*#?\s*\d+|term(?:inal)?\s*#?\s*\d+|loc(?:ation)?\s*#?\s*\d+|ref\s*#?\s*\d+)"
# ASCII word edges; Java's \b would also see letters beyond ASCII.
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
DATES = rf"{_EDGE}\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?{_END}|{_EDGE}\d{{4}}-\d{{2}}-\d{{2}}{_END}"
REFERENCE = rf"{_EDGE}(?=[a-z0-9]{{4,}}{_END})[a-z0-9]*\d[a-z0-9]*{_END}"


def normalize_merchant(text: Column, composed: bool = False) -> Column:
    """Lower-case words of a merchant description without processor prefix, places, dates and reference numbers; null counts as empty. ``composed``: the text is NFKC already."""
    x = F.lower(text if composed else nfkc(text))
    for pattern, by in ((PROCESSOR, ""), (PLACE, " "), (DATES, " "), (REFERENCE, " "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.coalesce(F.trim(x), F.lit(""))


def normalize_recurring(text: Column) -> Column:
    """Upper case, digits deleted, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "[0-9]", ""), r"\s+", " "))


def normalize_duplicate(text: Column, composed: bool = False) -> Column:
    """Lower case; everything but letters and numbers is one blank."""
    return F.trim(F.regexp_replace(F.lower(text if composed else nfkc(text)), r"[^\p{L}\p{N}]+", " "))


def normalize_import(text: Column) -> Column:
    """NFKC with blanks collapsed."""
    return F.trim(F.regexp_replace(nfkc(text), r"(?U)\s+", " "))


def utf16_length(text: Column) -> Column:
    """UTF-16 units, in which limits of texts are stated; null is 0."""
    return F.coalesce(F.octet_length(F.encode(text, "UTF-16BE")) / 2, F.lit(0)).cast("long")


def tokens(normalized: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalized, " "), ""))


def dice(left: Column, right: Column) -> Column:
    """Dice similarity of two token sets; 1 for two empty ones."""
    sizes = F.size(left) + F.size(right)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / sizes)


def spreadsheet_safe(cell: Column) -> Column:
    """A leading quote before what a spreadsheet would run."""
    return F.when(cell.rlike("^[\\t\\r\\n ]*[=+\\-@\\t\\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_cell(cell: Column) -> Column:
    """Quoted only if needed; null is empty."""
    safe = F.coalesce(cell, F.lit(""))
    return F.when(safe.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


#: Fixed pattern: what a statement's cell may start with and be run by a spreadsheet.
FORMULA = r"^(?:[\t\r]|[\t\r\n ]*[=+\-@])"


def sanitized_cell(cell: Column) -> Column:
    """A statement's cell for display: no U+0000, 1,024 characters, a leading quote before what a spreadsheet would run."""
    cut = F.substring(F.replace(cell, F.lit("\x00"), F.lit("")), 1, 1024)
    return F.when(cut.rlike(FORMULA), F.concat(F.lit("'"), cut)).otherwise(cut)


def bounded(cell: Column, most: int = 512) -> Column:
    """The first ``most`` characters."""
    return F.substring(cell, 1, most)


def report_cell(cell: Column) -> Column:
    """A cell of the error report: no U+0000, 1,024 characters, safe, always quoted."""
    safe = spreadsheet_safe(F.substring(F.replace(F.coalesce(cell, F.lit("")), F.lit("\x00"), F.lit("")), 1, 1024))
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def rejected_summary(text: Column) -> Column:
    """At most 16 characters with letters and digits masked, and the length."""
    t = F.trim(F.regexp_replace(text, r"[\r\n\t]", " "))
    shown = F.regexp_replace(F.substring(t, 1, 16), r"[\p{L}\p{N}]", "•")
    more = F.when(F.length(t) > 16, "…").otherwise("")
    return F.when(F.length(t) == 0, "blank value").otherwise(F.concat(shown, more, F.lit(" ("), F.length(t).cast("string"), F.lit(" characters)")))


def mask_account(text: Column) -> Column:
    """Four bullets and the last four digits."""
    return F.concat(F.lit("•" * 4), F.right(F.regexp_replace(text, "[^0-9]", ""), F.lit(4)))


def issue_code(field: Column) -> Column:
    """INVALID_ and the field's name in upper case with underscores."""
    return F.concat(F.lit("INVALID_"), F.upper(F.regexp_replace(field, "([a-z])([A-Z])", "$1_$2")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by U+0000; null parts are empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
