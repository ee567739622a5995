"""Text functions as Catalyst expressions: character classes, tokenizers, cleaning, transliteration, spacing, codes.

All take a column or its name; null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, one class for all engines.
WS = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MALAYALAM = r"\x{0D00}-\x{0D7F}"
LATIN = "A-Za-z"
#: ASCII classes of symbols, as regular-expression classes.
CLASSES = {
    "alphanumeric": "A-Za-z0-9",
    "alpha": "A-Za-z",
    "control": r"\x{0000}-\x{001F}\x{007F}",
    "digit": "0-9",
    "graph": r"\x{0021}-\x{007E}",
    "lower": "a-z",
    "print": r"\x{0020}-\x{007E}",
    "punct": r"\x{0021}-\x{002F}\x{003A}-\x{0040}\x{005B}-\x{0060}\x{007B}-\x{007E}",
    "space": r"\x{0009}-\x{000D}\x{0020}",
    "upper": "A-Z",
    "vowel": "AEIOUaeiou",
    "consonant": "BCDFGHJKLMNPQRSTVWXYZbcdfghjklmnpqrstvwxyz",
    "ascii": r"\x{0000}-\x{007F}",
}


#: Stands for the sentinel in texts.
SENTINEL = "\uffff"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbols(text: Column | str) -> Column:
    """The code points of a text as an array of strings."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?s)(.)"), 1)


def count_class(text: Column | str, chars: str) -> Column:
    """How many code points of the text are in a class."""
    t = _col(text)
    return F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]", ""))


def to_lower_ascii(text: Column | str) -> Column:
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def to_upper_ascii(text: Column | str) -> Column:
    return F.translate(_col(text), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ratio(text: Column | str, chars: str) -> Column:
    """Code points of a class over those that are no white space; 0 for a text without any."""
    t = _col(text)
    return F.when(t.isNotNull(), F.coalesce(F.try_divide(count_class(t, chars).cast("double"), (F.length(t) - count_class(t, WS)).cast("double")), F.lit(0.0)))


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), f"[{WS}]+", " "))


def clean_malayalam(text: Column | str, wide: bool = False) -> Column:
    """Malayalam letters and plain punctuation; anything else becomes white space, which is collapsed.

    wide also keeps brackets and hyphens, and strips the ends before it replaces, as the second of the two cleaners does.
    """
    kept = rf"[^{MALAYALAM}{WS}.,!?;:{'()-' if wide else ''}]"
    out = F.regexp_replace(_col(text), kept, " ")
    if wide:  # white space at the ends goes, what has become white space there collapses
        return F.regexp_replace(F.regexp_replace(out, f"^[{WS}]+|[{WS}]+$", ""), f"[{WS}]+", " ")
    return collapse_space(out)


def words(text: Column | str) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(_col(text), f"[{WS}]+"), lambda w: w != "")


def alphanumeric_words(text: Column | str) -> Column:
    """Maximal runs of ASCII letters and digits."""
    return F.regexp_extract_all(_col(text), F.lit("([A-Za-z0-9]+)"), 1)


def pairs_of(letters: str) -> str:
    """A regular expression of (non-word, word); each match goes on where the last one ended, so its work is linear."""
    return rf"\G([^{letters}]*+)([{letters}]++)"


def alternation(text: Column | str, letters: str = "A-Za-z0-9") -> Column:
    """(non_word, word) pairs: what stands before each word, and the word; what follows the last word is left out. letters: what words are of."""
    t, pair = _col(text), F.lit(pairs_of(letters))
    return F.arrays_zip(F.regexp_extract_all(t, pair, 1).alias("non_word"), F.regexp_extract_all(t, pair, 2).alias("word"))


def words_and_tags(text: Column | str) -> Column:
    """(word, tag) pairs of a text whose words have a sign above ASCII behind them as their tag."""
    t, pair = _col(text), F.lit(r"([\x{0000}-\x{007F}]+)([^\x{0000}-\x{007F}])")
    return F.arrays_zip(F.regexp_extract_all(t, pair, 1).alias("word"), F.regexp_extract_all(t, pair, 2).alias("tag"))


def last_place(text: Column | str, sign: str) -> Column:
    """Number from 0 of the last place of a sign; null if it isn't there."""
    t = _col(text)
    found = F.instr(F.reverse(t), sign)
    return F.when(found > 0, F.length(t) - found)


def compared(a: Column, b: Column, sentinel: str = SENTINEL) -> Column:
    """-1, 0 or 1 by the code points of two texts, the sentinel being lower than every other sign."""
    low = lambda c: F.replace(c, F.lit(sentinel), F.lit("\x00"))
    x, y = low(a), low(b)
    return F.when(x < y, -1).when(x > y, 1).when(x.isNotNull() & y.isNotNull(), 0)


def overwrite(text: Column, start: int, part: Column, pad: str = "\x00") -> Column:
    """The text with part in place of what stands from start (from 0) on, filled up to there if it is shorter."""
    filled = F.when(F.length(text) < start, F.rpad(text, F.lit(start), F.lit(pad))).otherwise(text)
    return F.concat(F.left(filled, F.lit(start)), part, F.substr(filled, F.length(part) + start + 1))


def replace_alike(text: Column, old: str, new: str | None = None) -> Column:
    """Each old in a text as new, which has as many signs, or as so many nulls: places of all other signs stay."""
    if new is not None and len(new) != len(old):
        raise ValueError("both must have the same number of signs")
    return F.replace(text, F.lit(old), F.lit("\x00" * len(old) if new is None else new))


def word_types(text: Column | str) -> Column:
    """Distinct words without punctuation, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(_col(text), f"[{CLASSES['punct']}]", ""), f"[{WS}]+"), lambda w: w != "")))


def spacing_variants(text: Column | str, longest: int | None = None) -> Column:
    """The four spacings of the study as an array of (spacing, text).

    longest: a longer text is cut there, at its last full stop if that stands in the last fifth (2,000 in the reference); else none is. Groups of the last variant: five signs, then four
    each. A text of ten signs or fewer has no such variant.
    """
    cut = t = _col(text)
    if longest is not None:
        head = F.left(t, F.lit(longest))
        stop = F.length(head) - F.instr(F.reverse(head), ".") + 1  # 1-based; past the end if there is none
        cut = F.when(F.length(t) <= longest, t).when(F.contains(head, F.lit(".")) & (stop - 1 > longest * 0.8), F.left(head, stop)).otherwise(head)
    bare = F.regexp_replace(cut, f"[{WS}]+", "")
    spaced = F.array_join(symbols(bare), " ")
    # a space after the fifth sign and after every fourth from there, none at the end
    first, rest = F.left(bare, F.lit(5)), F.substr(bare, F.lit(6))
    grouped = F.when(F.length(rest) > 0, F.concat(first, F.lit(" "), F.regexp_replace(rest, r"(?s)(.{4})(?=.)", "$1 "))).otherwise(first)
    pair = lambda name, c: F.struct(F.lit(name).alias("spacing"), c.alias("variant"))
    all_four = F.array(pair("original", cut), pair("no_spaces", bare), pair("char_spacing", spaced), pair("random_spacing", grouped))
    return F.when(F.length(bare) > 10, all_four).otherwise(F.slice(all_four, 1, 3))


def phone_keys(text: Column | str) -> Column:
    """A text as it is typed on a telephone's keys: letters as digits, blanks, stops and commas kept, three blanks before."""
    t = F.regexp_replace(_col(text), r"[^A-Za-z .,\n]", "")
    letters, keys = "abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999"
    return F.concat(F.lit("   "), F.translate(t, letters + letters.upper() + "\n", keys + keys + " "))


def sss_bits(value: Column | str, start: int, step: int, stop: int) -> Column:
    """Length in bits of a number's start-step-stop code: a unary prefix that picks the field width, then the field."""
    v = _col(value).cast("bigint")
    if step <= 0:  # one field
        return F.lit(float(start + (start < stop)))
    low, width, ones, out = 0, start, 0, None
    branches = []
    while width < stop:
        branches.append((low + (1 << width), ones + 1 + width))
        low += 1 << width
        width += step
        ones += 1
    bits = ones + width
    for bound, cost in branches:
        out = F.when(v < bound, F.lit(float(cost))) if out is None else out.when(v < bound, F.lit(float(cost)))
    return F.lit(float(bits)) if out is None else out.otherwise(F.lit(float(bits)))


def numbers_as_text(numbers: Column | str) -> Column:
    """An array of numbers from 0 to 983,039 as a text of one sign each, so that models of texts serve number streams."""
    c = _col(numbers)
    return F.decode(F.unhex(F.array_join(F.transform(c, lambda n: F.lpad(F.hex(n.cast("bigint") + 0x10000), 8, "0")), "")), "UTF-32")


def text_as_numbers(text: Column | str) -> Column:
    """The numbers of a text that numbers_as_text made."""
    return F.transform(symbols(text), lambda c: (F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint") - 0x10000))


def labelled_numbers(numbers: Column | str, label: Column | int) -> Column:
    """Numbers under 256 moved by 256 for each step of a label, so that streams of several sources stay apart."""
    shift = label if isinstance(label, Column) else F.lit(label)
    return F.transform(_col(numbers), lambda n: n + shift * 256)


def sss_encode(value: int, start: int, step: int, stop: int) -> str:
    """A number's start-step-stop code as a string of bits: zeros that pick the field, a one unless it is the last field, the field."""
    low, width, prefix = 0, start, ""
    while value >= low + (1 << width) and width < stop and step > 0:
        low, width, prefix = low + (1 << width), width + step, prefix + "0"
    prefix += "1" if width < stop else ""
    return prefix + (format(value - low, f"0{width}b") if width else "")


def sss_decode(bits: str, start: int, step: int, stop: int) -> tuple[int, int]:
    """(number, bits read) of the code at the beginning of a string of bits."""
    low, width, at = 0, start, 0
    while width < stop:
        at += 1
        if bits[at - 1] == "1":
            break
        low, width = low + (1 << width), width + step
    return low + (int(bits[at : at + width], 2) if width else 0), at + width


# --- fixed values: the transliteration table ------------------------------------------------------------------------------
PLAIN = {
    "അ": "a", "ആ": "ā", "ഇ": "i", "ഈ": "ī", "ഉ": "u", "ഊ": "ū", "എ": "e", "ഏ": "ē", "ഒ": "o", "ഓ": "ō", "ം": "ṁ",
    "ക": "k", "ഗ": "g", "ങ": "ṅ", "ച": "c", "ജ": "j", "ഞ": "ñ", "ട": "ṭ", "ഡ": "ḍ", "ണ": "ṇ", "ത": "t", "ദ": "d", "ന": "n", "പ": "p", "ബ": "b",
    "മ": "m", "റ": "ṟ", "ഩ": "ṉ", "ഴ": "ḻ", "യ": "y", "ര": "r", "ല": "l", "ള": "ḷ", "വ": "v", "ശ": "ś", "ഷ": "ṣ", "സ": "s", "ഹ": "h",
    "ാ": "ā", "ി": "i", "ീ": "ī", "ു": "u", "ൂ": "ū", "െ": "e", "േ": "ē", "ൊ": "o", "ോ": "ō",
    "ൺ": "ṇ", "ൻ": "n", "ർ": "ṟ", "ൽ": "l", "ൾ": "ḷ", "ൿ": "k",
    "൦": "0", "൧": "1", "൨": "2", "൩": "3", "൪": "4", "൫": "5", "൬": "6", "൭": "7", "൮": "8", "൯": "9",
}
LONGER = {
    "ഖ": "kh", "ഘ": "gh", "ഛ": "ch", "ഝ": "jh", "ഠ": "ṭh", "ഢ": "ḍh", "ഥ": "th", "ധ": "dh", "ഫ": "ph", "ഭ": "bh",
    "ഋ": "r̥", "ൠ": "r̥̄", "ഌ": "l̥", "ൡ": "l̥̄", "ഐ": "ai", "ഔ": "au", "ൃ": "r̥", "ൄ": "r̥̄", "ൢ": "l̥", "ൣ": "l̥̄", "ൈ": "ai", "ൌ": "au", "ൗ": "au",
}
TWO_PART = {
    "െ" + "ാ": "ൊ", "ാ" + "െ": "ൊ", "േ" + "ാ": "ോ", "ാ" + "േ": "ോ", "െ" + "ൗ": "ൌ", "ൗ" + "െ": "ൌ", "െ" + "െ": "ൈ",
}
LIGATURES = {"ന്റ": ("\ue000", "nṯ"), "റ്റ": ("\ue001", "ṯṯ")}
NO_INHERENT = "അആഇഈഉഊഋഎഏഐഒഓഔം"
VIRAMA = "്"
# ----------------------------------------------------------------------------------------------------------------------------
HOLDS_A = "".join(c for c in [*PLAIN, *LONGER] if c not in NO_INHERENT and c not in "ാിീുൂൃൄൢൣെേൈൊോൌൗൺൻർൽൾൿ")
_MARK = r"[\p{M}&&[^ം]]"
WORD_ENDS = rf"{CLASSES['punct']}\x{{0009}}-\x{{000D}}\x{{0020}}\x{{200C}}\p{{Z}}"


def transliterate(text: Column | str) -> Column:
    """Malayalam in Latin letters with diacritics, by rules in order: ligatures, vowel signs in two parts, the inherent vowel of a letter
    that no sign or virama follows, the virama at a word's end, then single letters. Other signs stay.
    """
    t = _col(text)
    for pair, (mark, _) in LIGATURES.items():
        t = F.replace(t, F.lit(pair), F.lit(mark))
    for pair, one in TWO_PART.items():
        t = F.replace(t, F.lit(pair), F.lit(one))
    t = F.regexp_replace(t, f"([{HOLDS_A}])(?!{_MARK})", "$1a")
    t = F.regexp_replace(t, rf"([\ue000\ue001])(?!{_MARK})(?=[\s\S])", "$1a")
    t = F.regexp_replace(t, f"{VIRAMA}(?=[{WORD_ENDS}]|$)", "ŭ")
    t = F.replace(t, F.lit(VIRAMA), F.lit(""))
    for _, (mark, latin) in LIGATURES.items():
        t = F.replace(t, F.lit(mark), F.lit(latin))
    for letter, latin in LONGER.items():
        t = F.replace(t, F.lit(letter), F.lit(latin))
    return F.translate(t, "".join(PLAIN), "".join(PLAIN.values()))
