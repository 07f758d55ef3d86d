"""Column functions over text: normal forms, words, sentences, syllables, scripts, masks and check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ABBREVIATIONS, STOP_WORDS, SYLLABLES, B, E

SPACE = r"[ \t\n\r\f\x0B ]+"


def let(value: Column, f) -> Column:
    """f of a value that is made once a row: columns that the optimiser inlines would be made anew for every element of a
    higher-order function around them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up, as floor(x + 0.5)."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def normalize(text: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]", "")


def clean_cell(text: Column) -> Column:
    """No control characters, one line, no runs of | ~ _ or long dash at either end."""
    one = F.regexp_replace(strip_control(text), r"[\r\n]+", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(one), r"^[|~_—]+|[|~_—]+$", "")), r"\s+", " "))


def words(text: Column, most: int | None = None) -> Column:
    """ASCII words with inner apostrophes and hyphens, whole or cut to `most` characters."""
    found = F.regexp_extract_all(text, F.lit(f"({B}[A-Za-z0-9](?:[A-Za-z0-9'-]*[A-Za-z0-9])?{E})"), 1)
    return F.transform(found, lambda w: F.substring(w, 1, most)) if most else found


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences that hold a letter or digit; stops of abbreviations and initials end none."""
    mask = F.regexp_replace(text, f"(?i){B}({ABBREVIATIONS})\\.", "$1_DOT_")
    mask = F.regexp_replace(mask, f"{B}([A-Z])\\.", "$1_DOT_")
    parts = F.transform(F.split(mask, r"(?<=[.!?])[ \t\n\r\f]+|\n+"), lambda p: F.trim(F.replace(p, F.lit("_DOT_"), F.lit("."))))
    return F.filter(parts, lambda p: p.rlike("[A-Za-z0-9]"))


def sentence_count(text: Column, most: int | None = None) -> Column:
    """Sentences; with `most`, longer blocks count by their parts of so many characters."""
    if not most:
        return F.size(sentences(text)).cast("long")
    return F.aggregate(sentences(text), F.lit(0).cast("long"), lambda n, s: n + F.ceil(F.length(s) / most).cast("long"))


def clause_sentences(text: Column) -> Column:
    """Parts of over 10 characters; a boundary is a stop and an upper-case letter or digit behind it."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda p: F.trim(p)), lambda p: F.length(p) > 10)


def summary_sentences(text: Column) -> Column:
    """Sentences of over 25 characters and at least 5 words; a boundary needs an upper-case or Indic letter or a digit behind
    it."""
    boundary = r"(?<=[.!?])\s+(?=[A-Z0-9\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}])"
    parts = F.transform(F.split(F.regexp_replace(text, r"[ \t\n\r\f]+", " "), boundary), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.length(p) > 25) & (F.size(F.split(p, " +")) >= 5))


def syllables(word: Column, plain: bool = False) -> Column:
    """Syllables of an English word: vowel runs, silent-ending rules, irregular words by table.

    `plain` says that all but letters are digits, apostrophes and hyphens, as in words(), which saves a pattern. The
    suffixes -tion, -sion, -cial, -tial, -cious and -tious hold one vowel run between consonants and need no rule.
    """
    return bare_syllables(bare(word, plain))


def bare(word: Column, plain: bool = False, most: int | None = None) -> Column:
    """Lower-case letters of a word, all or the first `most`."""
    letters = F.translate(F.lower(word), "0123456789'-", "") if plain else F.regexp_replace(F.lower(word), "[^a-z]", "")
    return F.substring(letters, 1, most) if most else letters


def bare_syllables(clean: Column) -> Column:
    """syllables of what bare() gives; inside array functions, which evaluate an expression wherever it stands, bare()
    belongs in a transform of its own."""
    table = F.create_map(*[F.lit(x) for kv in SYLLABLES.items() for x in kv])
    l1, l2, l3, l4 = (F.substring(clean, -k, 1) for k in (1, 2, 3, 4))
    silent = (l1 == "e") & ~l2.isin("e", "o") & ((l2 != "l") | l3.isin(*"aeiouy"))
    past = (l1 == "d") & (l2 == "e") & ~l3.isin("t", "d")
    plural = (l1 == "s") & (l2 == "e") & ~l3.isin("s", "z", "x", "c") & ~((l3 == "h") & (l4 == "s"))
    n = F.regexp_count(clean, F.lit("[aeiouy]+")) - F.when(silent | past | plural, 1).otherwise(0)
    return F.when(F.length(clean) == 0, 0).when(F.length(clean) <= 3, 1).otherwise(F.coalesce(F.try_element_at(table, clean), F.greatest(F.lit(1), n)))


def is_heading(line: Column) -> Column:
    """Numbered or named section starts, short capital lines and title-case lines, of at most 12 words."""
    w = spaced_words(line)
    n = F.size(w)
    named = line.rlike(f"(?i)^(\\d+(\\.\\d+)*|[A-Z]\\.|{B}(Section|Chapter|Part|Article|Clause){E})")
    capital = (line == F.upper(line)) & (n <= 8) & line.rlike("[A-Z]")
    title = F.forall(w, lambda x: x.rlike("^[A-Z]") | F.lower(x).isin(STOP_WORDS)) & (n <= 6) & (F.length(line) < 50)
    return (n > 0) & (n <= 12) & ~(line.rlike("\\.$") & (n > 6)) & (named | capital | title)


def mask_sensitive(text: Column) -> Column:
    """Up to 4 characters: four bullets; else first, 4 to 10 bullets, last."""
    bullets = F.repeat(F.lit("•"), F.least(F.lit(10), F.greatest(F.lit(4), F.length(text) - 2)))
    return F.when(F.length(text) <= 4, F.lit("••••")).otherwise(F.concat(F.substring(text, 1, 1), bullets, F.right(text, F.lit(1))))


def luhn_valid(text: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of 10."""
    digits = F.regexp_replace(text, r"\D", "")
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def ean13_check(text: Column) -> Column:
    """Check digit of the first 12 digits."""
    each = F.transform(F.split(F.substring(text, 1, 12), ""), lambda d, i: F.coalesce(d.cast("int"), F.lit(0)) * F.when(i % 2 == 0, 1).otherwise(3))
    return (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10


# Code-point ranges of script families.
SCRIPTS = {
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "odia": [(0x0B00, 0x0B7F)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
}


def script_class(name: str) -> str:
    """Regular-expression class of a script family."""
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SCRIPTS[name]) + "]"
