"""Scalar text functions on columns: normalising, identifiers, slugs, numerals, values of loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references that legal pages use, in the order in which they are decoded; the ampersand is last.
ENTITIES = {"&nbsp;": " ", "&sect;": "§", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}
#: Fixed values of the roman numerals.
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
#: Characters a token stands for when texts are planned without a tokenizer.
CHARS_PER_TOKEN = 5.2


def decode_entities(text: Column) -> Column:
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def normalize_ws(text: Column) -> Column:
    """Character references decoded, marks before a leading number or bracket dropped, a lost section sign restored, spaces of all kinds made one."""
    decoded = decode_entities(text)
    led = F.regexp_replace(decoded, r"^[�§ ]+(?=[0-9(])", "")
    signed = F.regexp_replace(led, r"�[ \t\r\n]*([0-9])", "§$1")
    plain = F.translate(F.regexp_replace(signed, "�+", ""), "   ", "   ")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


#: What normalize_ws changes is in one of these places; the section sign only at the start.
UNTIDY = "[&\ufffd\u00a0\u2007\u202f\\t\\r\\n]|  |^[ §]| $"


def tidied(text: Column) -> Column:
    """normalize_ws of a text at hand: one with nothing to change is passed on after one search."""
    return F.when(F.regexp_like(text, F.lit(UNTIDY)), normalize_ws(text)).otherwise(text)


def normalize_for_hash(text: Column) -> Column:
    return F.lower(normalize_ws(text))


def strip_trailing_period(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"[.]+$", ""))


def is_blank(text: Column) -> Column:
    return normalize_ws(text) == ""


def is_rule_line(text: Column) -> Column:
    return F.regexp_like(normalize_ws(text), F.lit(r"^_{5,}$"))


def count_rule_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\r?\n"), is_rule_line))


def without_rule_marks(text: Column) -> Column:
    """Underscore rules at a text's ends dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_ws(text), r"^_{5,}\s*", ""), r"\s*_{5,}$", ""))


#: How a line names titles or chapters that are kept free, as a regular expression.
RESERVED = r"(?:titles?|chapters?)\s+[0-9]+[a-z]?(?:\s+(?:to|and)\s+[0-9]+[a-z]?)?(?:\s+et\s+seq\.)?"


def is_reserved_tail(text: Column) -> Column:
    """A line that only names free titles or chapters, with or without the words that say so."""
    return F.regexp_like(normalize_ws(text), F.lit(rf"(?i)^{RESERVED}(?:\s+\[reserved for expansion\]_*)?$"))


def is_reserved_expansion(text: Column) -> Column:
    return F.lower(normalize_ws(text)) == "[reserved for expansion]"


def clean_parser_text(text: Column) -> Column:
    """Normal text without underscore rules and without a free range of chapters at its end; empty if it is nothing else."""
    bare = without_rule_marks(text)
    return F.when(F.regexp_like(normalize_ws(text), F.lit(rf"(?i)^{RESERVED}\s+\[reserved for expansion\]_*$")), "").otherwise(
        F.trim(F.regexp_replace(bare, rf"(?i)\s+{RESERVED}\s+\[reserved for expansion\]_*\s*$", ""))
    )


def is_all_caps_heading(text: Column) -> Column:
    """Four characters or more, no digit, three letters or more, none of them lower case."""
    t = normalize_ws(text)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    return (F.length(t) >= 4) & ~F.regexp_like(t, F.lit("[0-9]")) & (F.length(letters) >= 3) & ~F.regexp_like(letters, F.lit(r"\p{Ll}"))


def sha256_hex(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def stable_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def generate_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), stable_id(F.concat_ws("|", *parts)))


def slug(text: Column, joint: str = "-") -> Column:
    """Lower-case ASCII letters and digits, everything between made one joint, none at the ends."""
    return F.replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "), F.lit(joint))


def preview(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("…"))).otherwise(text)


def percentage(part: Column, total: Column) -> Column:
    """100 * part / total, 0 where there is nothing to share."""
    return F.when(total == 0, 0.0).otherwise(part * 100.0 / total)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def roman_to_int(text: Column) -> Column:
    """The value of a roman numeral, null if a character is none."""
    values = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    each = F.transform(F.array_remove(F.split(F.upper(F.trim(text)), ""), ""), lambda c: F.try_element_at(values, c))
    total = F.aggregate(F.reverse(each), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), v.alias("last")), lambda acc: acc["sum"])
    return total


def to_roman(number: Column) -> Column:
    """The roman numeral of 1 to 3999."""
    digits = [("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "M", "MM", "MMM")]
    parts = [F.element_at(F.array(*[F.lit(d) for d in row]), (F.floor(number / 10**k) % 10 + 1).cast("int")) for k, row in reversed(list(enumerate(digits)))]
    return F.when(number.between(1, 3999), F.concat(*parts))


def sanitize_fulltext(query: Column) -> Column:
    """A query with the full-text operators escaped."""
    return F.regexp_replace(query, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def relative_path(path: Column) -> Column:
    """A clean relative upload path: forward slashes, no empty or dot parts; null for absolute paths and ones that climb."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (F.trim(p) != "") & (p != "."))
    bad = F.exists(parts, lambda p: p == "..") | path.startswith("/") | F.regexp_like(path, F.lit("^[A-Za-z]:"))
    return F.when(~bad & (F.size(parts) > 0), F.array_join(F.transform(parts, lambda p: F.trim(p)), "/"))


def first_clause(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "[;.]"), F.lit(0)))


def first_sentence(text: Column) -> Column:
    return F.trim(F.substring_index(text, ". ", 1))


def first_value(*fields: Column) -> Column:
    """The first field that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields])


def value_bool(field: Column) -> Column:
    t = F.lower(F.trim(field.cast("string")))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False).when(F.regexp_like(t, F.lit(r"^-?[0-9]+$")), t.try_cast("decimal(38,0)") != 0)


def service_date(text: Column) -> Column:
    """/Date(milliseconds)/ as an ISO time in UTC; other text trimmed."""
    millis = F.regexp_extract(text, r"^/Date\((-?[0-9]+)(?:[+-][0-9]{4})?\)/$", 1)
    return F.when(millis != "", F.date_format(F.timestamp_millis(millis.try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.trim(text))


def money_value(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def percent_value(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?) ?(?:percent|%)", 1).try_cast("double")
