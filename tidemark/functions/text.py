"""Turkish-aware text as Column expressions: case, folding, suffixes, sort keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in Turkish order, letters that folding replaces, and what replaces them.
ORDER = "abcçdefgğhıijklmnoöprsştuüvyzâîû"
MARKED, PLAIN = "çğıöşüâîû", "cgiosuaiu"
#: Fixed values of vowel harmony: front vowels take e, voiceless endings take t.
VOWELS, FRONT, VOICELESS = "aeıioöuüâîû", "eiöüî", "çfhkpsşt"
#: White space of any script, which the built-in trim keeps.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Where a space is missing after a full stop, and the short form of "cemetery" with the long one.
INNER_STOP, CEMETERY = r"\.(?=[^\s\d])", (r"(^|\s)Mez\.(?=\s|$)", "$1Mezarlığı")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where f uses it several times: c is worked out once for a row, not once for each use (and each use of these)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def bare(c: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def trimmed(c: Column) -> Column:
    """Trimmed of all white space; empty becomes null."""
    return F.nullif(bare(c), F.lit(""))


def tr_lower(c: Column) -> Column:
    """Turkish lower case; a dot that is set apart on an i goes."""
    return F.replace(F.lower(F.translate(c, "Iİ", "ıi")), F.lit("i\u0307"), F.lit("i"))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def fold(c: Column) -> Column:
    """Lower-cased for search, Turkish letters without marks."""
    return F.translate(tr_lower(c), MARKED, PLAIN)


def slug(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def name_key(c: Column) -> Column:
    """Folded, white space collapsed: equal for equal names."""
    return F.trim(F.regexp_replace(fold(c), f"{SPACE}+", " "))


def upper_first(c: Column) -> Column:
    return F.concat(tr_upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def sentence_case(c: Column) -> Column:
    return upper_first(tr_lower(F.coalesce(c, F.lit(""))))


def title_case(c: Column) -> Column:
    """Each word's first letter upper, the rest lower; a space after inner full stops; Mez. written out."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), INNER_STOP, ". ")
    words = F.array_join(F.transform(F.split(tr_lower(spaced), " "), upper_first), " ")
    return F.regexp_replace(words, *CEMETERY)


def locative(c: Column) -> Column:
    """The name with its locative ending by vowel harmony."""
    low = tr_lower(c)
    vowel = F.coalesce(F.nullif(F.regexp_extract(low, f"([{VOWELS}])[^{VOWELS}]*$", 1), F.lit("")), F.lit("a"))
    ending = F.concat(F.lit("’"), F.when(F.right(low, F.lit(1)).rlike(f"[{VOICELESS}]"), "t").otherwise("d"), F.when(vowel.rlike(f"[{FRONT}]"), "e").otherwise("a"))
    return F.when(c == "", c).otherwise(F.concat(c, ending))


def stems(c: Column) -> Column:
    """First five letters of each word of four letters or more, without repeats."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}{4,})"), F.lit(1)), lambda w: F.substring(tr_lower(w), 1, 5)))


def arabic_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", "٠١٢٣٤٥٦٧٨٩")


def sort_key(c: Column) -> Column:
    """Compares as Turkish names do: letters in their order, then all else by code point."""
    letters = F.filter(F.split(tr_lower(c), ""), lambda x: x != "")
    return F.transform(letters, lambda x: F.when(F.position(x, F.lit(ORDER)) > 0, F.position(x, F.lit(ORDER)) - 1).otherwise(F.ascii(x) + 1000))


def map_address(*parts: Column, base: str = "https://www.google.com/maps/search/?api=1&query=") -> Column:
    """Search address of a map, from the parts that are not blank."""
    joined = F.concat_ws(", ", *(trimmed(p) for p in parts))
    return F.concat(F.lit(base), F.replace(F.url_encode(joined), F.lit("+"), F.lit("%20")))


def digest(c: Column) -> Column:
    """SHA-256 in base64 for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(c, 256))), "+/", "-_"), F.lit("="))


def pin_hash(salt: Column, pin: Column) -> Column:
    return F.sha2(F.concat(salt, F.lit("|"), pin), 256)


def filled(template: Column, *values: Column) -> Column:
    """A label template with {0}, {1}, ... replaced."""
    for k, v in enumerate(values):
        template = F.replace(template, F.lit(f"{{{k}}}"), v.cast("string"))
    return template
