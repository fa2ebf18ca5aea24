"""Column functions with office semantics: cell references, serial dates, literal replace, text forms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell reference form, number formats that show dates, epochs in ms before 1970, largest sheet.
REF = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$"
DATE_FORMAT_IDS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57)
EPOCH_1900_MS, EPOCH_1904_MS, DAY_MS = -2209161600000, -2082844800000, 86400000
MAX_COLUMN, MAX_ROW = 16384, 1048576
#: Fixed value: the characters of the Windows code page 1252, and line breaks and tabs.
WIN_ANSI = r"\t\n\r\x20-\x7E\xA0-\xFF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def col_letters(n: Column) -> Column:
    """Column number (1 is A) to letters; three letters suffice for sheets."""
    n = n.cast("int")
    two = F.floor((n - 1) / 26).cast("int")
    three = F.floor((two - 1) / 26).cast("int")
    letter = lambda x: F.char(x + 65)
    return F.concat(F.when((two > 0) & (three > 0), letter((three - 1) % 26)).otherwise(""), F.when(two > 0, letter((two - 1) % 26)).otherwise(""), letter((n - 1) % 26))


def col_number(letters: Column) -> Column:
    """Letters to column number; null for the empty text."""
    up = F.upper(letters)
    value = F.aggregate(F.split(up, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(F.length(letters) > 0, value)


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """(column, row) of an A1 reference, $ allowed; nulls where it is none."""
    ok = ref.rlike(REF)
    return F.when(ok, col_number(F.regexp_extract(ref, REF, 1))), F.when(ok, F.regexp_extract(ref, REF, 2).try_cast("int"))


def a1(col: Column, row: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def parse_range(text: str) -> tuple[int, int, int, int]:
    """(first column, first row, last column, last row) of a literal A1:B2 range, in any order of corners."""

    def one(ref: str) -> tuple[int, int]:
        m = re.match(REF, ref.strip())
        if not m:
            raise ValueError(f"not a cell reference: {ref!r}")
        return reduce(lambda a, c: a * 26 + ord(c) - 64, m[1].upper(), 0), int(m[2])

    a, _, b = text.partition(":")
    (c0, r0), (c1, r1) = one(a), one(b or a)
    return min(c0, c1), min(r0, r1), max(c0, c1), max(r0, r1)


def is_date_format(fmt_id: Column, code: Column) -> Column:
    """Built-in date formats, or a code with date letters outside quotes, brackets and escapes."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return fmt_id.isin(*DATE_FORMAT_IDS) | (bare.rlike("(?i)[ymdhs]") & ~bare.rlike("(?i)general"))


def serial_to_timestamp(serial: Column, epoch_ms: int = EPOCH_1900_MS) -> Column:
    """Day number to instant, rounded half up to milliseconds."""
    return F.timestamp_millis((F.lit(epoch_ms) + F.floor(serial * DAY_MS + 0.5)).cast("long"))


def timestamp_to_serial(ts: Column, epoch_ms: int = EPOCH_1900_MS) -> Column:
    return (F.unix_millis(ts.cast("timestamp")) - F.lit(epoch_ms)) / F.lit(float(DAY_MS))


def literal_pattern(needle: str, match_case: bool = False) -> str:
    """A Java pattern for the literal; without case also é and É are equal."""
    return ("" if match_case else "(?iu)") + "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 and not c.isspace() else c for c in needle)


def literal_replace(text: Column, find: str, replace: str, match_case: bool = False) -> Column:
    """Every occurrence; `replace` is taken as it stands."""
    if match_case:
        return F.replace(text, F.lit(find), F.lit(replace))
    return F.regexp_replace(text, literal_pattern(find), replace.replace("\\", "\\\\").replace("$", "\\$"))


def literal_contains(text: Column, find: str, match_case: bool = False) -> Column:
    """By the pattern that counts and replaces, so the three agree on letters that fold oddly."""
    return F.contains(text, F.lit(find)) if match_case else text.rlike(literal_pattern(find))


def literal_count(text: Column, find: str, match_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(literal_pattern(find, match_case)))


def preview(text: Column, n: int = 30) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def number_text(x: Column) -> Column:
    """A double as script languages print it: 42, 12345678.9, 1e+21."""
    x = x.cast("double")
    size, plain = F.abs(x), x.cast("string")
    whole = F.when(x == 0, F.lit("0")).otherwise(x.cast("decimal(38,0)").cast("string"))
    decimal = F.regexp_replace(plain.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    power = F.substring_index(plain, "E", -1)
    scientific = F.concat(mantissa, F.lit("e"), F.when(F.startswith(power, F.lit("-")), power).otherwise(F.concat(F.lit("+"), power)))
    return (
        F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("NaN")).when(size == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when((size < 1e21) & (x == F.floor(x).cast("double")), whole).when((size >= 1e-6) & (size < 1e21), decimal).otherwise(scientific)
    )


def text_number(s: Column) -> Column:
    """Text as a number: blank is 0, hexadecimal counts, anything else odd is NaN."""
    t = F.trim(s)
    hexed = F.conv(F.regexp_extract(t, "(?i)^0x([0-9a-f]{1,13})$", 1), 16, 10).try_cast("double")
    plain = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(s.isNull(), F.lit(None).cast("double")).when(t == "", F.lit(0.0)).when(t.rlike("(?i)^0x[0-9a-f]{1,13}$"), hexed).when(plain, t.try_cast("double")).when(t.rlike(r"^[+-]?Infinity$"), F.when(F.startswith(t, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.lit(float("nan")))


def csv_field(s: Column) -> Column:
    """Quoted only if it holds a quote, comma or line break; null is empty."""
    return F.when(s.isNull(), F.lit("")).when(s.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def rotation(degrees: Column) -> Column:
    """To the nearest quarter turn, halves up, from 0 to 270."""
    return F.pmod(F.floor(degrees / 90.0 + 0.5).cast("int") * 90, F.lit(360))


def aspect_name(width: Column, height: Column) -> Column:
    r = width / height
    near = lambda x: F.abs(r - x) < 0.02
    return F.when(near(16 / 9), "16:9").when(near(4 / 3), "4:3").when(near(16 / 10), "16:10").otherwise(F.concat(number_text(F.floor(r * 100 + 0.5) / 100), F.lit(":1")))


def unencodable(text: Column) -> Column:
    """The distinct characters that a standard PDF font cannot show, in order of appearance.

    Runs of plain characters leave first, by a class of ranges only: the full class tries dozens of single characters at each place.
    """
    rest = F.regexp_replace(text, r"[\t\n\r\x20-\x7E\xA0-\xFF]+", "")
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(f"([^{WIN_ANSI}])"), F.lit(1)))


def bigrams(text: Column) -> Column:
    """All two-character strings of a text, repeats kept."""
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Multiset bigram similarity: equal is 1, empty is 0."""
    x, y = bigrams(a), bigrams(b)
    count = lambda arr, g: F.size(F.filter(arr, lambda e: e == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(count(x, g), count(y, g)))
    total = F.size(x) + F.size(y)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == "") | (total == 0), F.lit(0.0)).otherwise(F.lit(2.0) * shared / total)
