"""Text scalar functions: every one maps Column to Column and stays in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.words import (
    BASE_STOPWORDS,
    DOMAIN_STOPWORDS,
    FOLD_SUFFIXES,
    LETTERS,
    VOWELS,
)

# Functions of this module travel to the executors by value: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Whitespace of any script (Java's \s alone is ASCII), as a class and as characters.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Syllables of this block decompose by arithmetic into two or three letters.
HANGUL = (0xAC00, 0xD7A3)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """(from, to, dropped marks, multi-character folds) over all of Unicode, but for Hangul."""
    src, dst, dropped, multi = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if HANGUL[0] <= code <= HANGUL[1] or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFKD", char)
        folded = "".join(c for c in parts if not unicodedata.combining(c))
        if folded == char:
            continue
        if len(folded) == 1:
            src.append(char)
            dst.append(folded)
        elif folded:
            multi[char] = folded
        else:
            dropped.append(char)
    return "".join(src), "".join(dst), "".join(dropped), multi


def _hangul_letters(text: Column) -> Column:
    """Hangul syllables as their letters."""

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def letters(c: Column) -> Column:
        n = F.ascii(c).cast("bigint") - HANGUL[0]
        last = n % 28
        whole = F.concat(
            letter(F.floor(n / 588) + 0x1100),
            letter(F.floor(n % 588 / 28) + 0x1161),
            F.when(last > 0, letter(last + 0x11A7)).otherwise(""),
        )
        return F.when((c >= chr(HANGUL[0])) & (c <= chr(HANGUL[1])), whole).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letters), "")


def _members(letters: str) -> set[str]:
    """The characters of a class body such as ``a-zą``."""
    out, i = set(), 0
    while i < len(letters):
        if letters[i + 1 : i + 2] == "-":
            out.update(map(chr, range(ord(letters[i]), ord(letters[i + 2]) + 1)))
            i += 3
        else:
            out.add(letters[i])
            i += 1
    return out


def _ranges(chars: set[str]) -> str:
    """A class body of as few ranges as possible: regex engines test them one by one."""
    body, codes = [], sorted(map(ord, chars))
    while codes:
        lo = hi = codes.pop(0)
        while codes and codes[0] == hi + 1:
            hi = codes.pop(0)
        body.append(chr(lo) if lo == hi else f"{chr(lo)}-{chr(hi)}")
    return "".join(body)


@lru_cache(maxsize=None)
def letter_classes(letters: str = LETTERS, vowels: str = VOWELS) -> tuple[str, str, str]:
    """Regex classes (letters, vowels, consonants), both cases."""
    every = _members(letters)
    voiced = _members(vowels + vowels.upper())
    return tuple(f"[{_ranges(chars)}]" for chars in (every, voiced, every - voiced))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_ws(text: Column) -> Column:
    """Runs of any whitespace become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _expanded(text: Column, pairs: str) -> Column:
    """The characters that begin the ``pairs`` replaced by the rest of theirs, one after the other; no
    expansion holds another."""
    listed = F.split(F.lit(pairs), "\u0000")
    return F.aggregate(listed, text, lambda acc, p: F.replace(acc, F.substring(p, 1, 1), F.substr(p, F.lit(2))))


@lru_cache(maxsize=1)
def _fold_blocks() -> list[tuple[str, str, str]]:
    """Per block of what expands to several characters: a pattern of all beyond the block's start, one of
    the block's characters, and its pairs; the first is that of the Latin letters."""
    multi = _fold_tables()[3]
    out = []
    for low, high in ((0x80, 0x17F), (0x180, 0x24FF), (0x2500, sys.maxunicode)):
        block = {c: to for c, to in multi.items() if low <= ord(c) <= high}
        out.append((f"[^\\x00-\\x{{{low - 1:x}}}]", f"[{_ranges(set(block))}]", "\u0000".join(c + to for c, to in block.items())))
    return out


def ascii_fold(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks (ł has no decomposition, so it stays)."""
    src, dst, dropped, _ = _fold_tables()
    single = F.translate(text, src + dropped, dst)
    # Cheap tests first: most tokens are ASCII, most texts have no compatibility letter. What
    # expands to several characters is rare, so it is replaced only on demand, by blocks.
    out = F.when(text.rlike(f"[{chr(HANGUL[0])}-{chr(HANGUL[1])}]"), _hangul_letters(single)).otherwise(single)
    for beyond, members, pairs in _fold_blocks():
        out = F.when(text.rlike(beyond) & text.rlike(members), _expanded(out, pairs)).otherwise(out)
    return F.when(~text.rlike("[^\\x00-\\x7f]"), text).when(~text.rlike("[^\\x00-\\x{17f}]") & ~text.rlike(_fold_blocks()[0][1]), single).otherwise(out)


def slugify(text: Column, max_len: int = 80) -> Column:
    """Folded letters and digits joined by dashes, the first ``max_len`` of them.

    Folding goes by single characters, so what a text begins with has the slug of the whole text
    where it is long enough; only other texts are folded to their end.
    """

    def dashed(part: Column) -> Column:
        return F.btrim(F.regexp_replace(ascii_fold(part), "[^A-Za-z0-9]+", "-"), F.lit("-"))

    def chosen(short: Column) -> Column:
        return F.when((F.length(short) >= max_len) | (F.length(text) <= start), short).otherwise(dashed(text))

    def shown(slug: Column) -> Column:
        return F.when(slug != "", F.lower(F.substring(slug, 1, max_len))).otherwise("unknown")

    # Within an array each step is made once, however often the next one names it.
    start = 4 * max_len
    steps = F.transform(F.array(dashed(F.substring(text, 1, start))), lambda short: chosen(short))
    return F.get(F.transform(steps, shown), F.lit(0))


def words(text: Column, letters: str = LETTERS) -> Column:
    """Runs of letters, as written."""
    return F.regexp_extract_all(text, F.lit(f"{letter_classes(letters)[0]}+"), 0)


def raw_tokens(text: Column, letters: str = LETTERS) -> Column:
    """Lower-cased runs of letters, unfiltered. After an explode, ``words`` and a
    lower-casing of each row do the same inside generated code."""
    return F.transform(words(text, letters), F.lower)


def word_count(text: Column, letters: str = LETTERS) -> Column:
    return F.size(words(text, letters))


def stopword_list(base=BASE_STOPWORDS, domain=DOMAIN_STOPWORDS) -> list[str]:
    return sorted(set(base) | set(domain))


def keep_token(token: Column, stopwords, vowels: str = VOWELS) -> Column:
    """Predicate on one token: long enough, voiced, not a stop word."""
    return (F.length(token) > 2) & token.rlike(f"[{vowels}]") & ~token.isin(list(stopwords))


def filtered_tokens(text: Column, stopwords, letters: str = LETTERS) -> Column:
    return F.filter(raw_tokens(text, letters), lambda t: keep_token(t, stopwords))


def fold_token(token: Column, suffixes=FOLD_SUFFIXES) -> Column:
    """Strip one inflectional ending that leaves at least three characters.

    The longest listed ending is taken; in the default list that is also the first, since
    none comes before a longer one that contains it. Endings of one length are compared
    in a single set test.
    """
    out = F.when(F.lit(False), token)
    for n in sorted({len(s) for s in suffixes}, reverse=True):
        ending = F.substring(token, -n, n)
        listed = [s for s in suffixes if len(s) == n]
        out = out.when(
            (F.length(token) >= n + 3) & ending.isin(listed),
            F.substr(token, F.lit(1), F.length(token) - n),
        )
    return out.otherwise(token)


# Words and the three rules again for Arrow arrays, in Python workers.

def arrow_letters(letters: str = LETTERS) -> np.ndarray | None:
    """Whether each code point below 0x800 is one of the letters; None where ``arrow_words`` cannot cut
    by them: where one lies beyond, or its lower case is several characters or hangs on its place."""
    members = _members(letters)
    if any(ord(c) >= 0x800 or len(c.lower()) != 1 or c == "\u03a3" for c in members):
        return None
    out = np.zeros(0x800, bool)
    out[[ord(c) for c in members]] = True
    return out


def arrow_words(texts: pa.Array, letters: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts (valid UTF-8) one after the other, and how many each has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    ascii_letter = np.zeros(256, bool)
    ascii_letter[:128] = letters[:128]
    inside = ascii_letter[data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))
    two = two[letters[(data[two] & 0x1F).astype(np.int64) << 6 | data[two + 1] & 0x3F]]
    inside[two] = inside[two + 1] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = np.flatnonzero(at[:-1] < at[1:])  # a word ends with its text
    begin[at[some]], end[at[some + 1] - 1] = inside[at[some]], inside[at[some + 1] - 1]
    starts = np.flatnonzero(begin)
    written = data[inside]
    offsets = np.append(0, np.cumsum(np.flatnonzero(end) + 1 - starts))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(written))
    return found, np.diff(np.searchsorted(starts, at))


def arrow_keep_token(tokens: pa.Array, stopwords: pa.Array, vowels: str = VOWELS) -> pa.Array:
    """``keep_token`` of each token."""
    long = pc.greater(pc.utf8_length(tokens), 2)
    return pc.and_(pc.and_(long, pc.match_substring_regex(tokens, f"[{vowels}]")), pc.invert(pc.is_in(tokens, value_set=stopwords)))


def arrow_ascii_fold(tokens: pa.Array) -> pa.Array:
    """``ascii_fold`` of each token; few are beyond ASCII."""
    ascii_only = pc.string_is_ascii(tokens)
    if pc.all(ascii_only).as_py() is not False:
        return tokens
    beyond = pc.invert(ascii_only)
    parts = (unicodedata.normalize("NFKD", w) for w in tokens.filter(beyond).to_pylist())
    folded = ["".join(c for c in p if not unicodedata.combining(c)) for p in parts]
    return pc.replace_with_mask(tokens, beyond, pa.array(folded, pa.string()))


def arrow_fold_token(tokens: pa.Array, suffixes=FOLD_SUFFIXES) -> pa.Array:
    """``fold_token`` of each token."""
    length, out = pc.utf8_length(tokens), tokens
    for n in sorted({len(s) for s in suffixes}):  # the longest comes last, over the others
        listed = pa.array([s for s in suffixes if len(s) == n], pa.string())
        ends = pc.and_(pc.greater_equal(length, n + 3), pc.is_in(pc.utf8_slice_codeunits(tokens, -n), value_set=listed))
        out = pc.if_else(ends, pc.utf8_slice_codeunits(tokens, 0, -n), out)
    return out


def syllables(word: Column, vowels: str = VOWELS) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(f"[{vowels}]+")))


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between runs of . ! ? … or backslash."""
    ends = r"\\.!?…"
    return F.regexp_count(text, F.lit(rf"[^{ends}{SPACE[1:-1]}][^{ends}]*+"))


def complex_word_count(text: Column, letters: str = LETTERS, vowels: str = VOWELS) -> Column:
    """Words with three or more vowel runs, counted by one pattern over the whole text."""
    every, v, c = letter_classes(letters, vowels)
    return F.regexp_count(text, F.lit(f"(?<!{every}){c}*+{v}++{c}++{v}++{c}++{v}"))


def fog_index(words: Column, sentences: Column, complex_words: Column) -> Column:
    """Readability from the three counts; zero without words or sentences."""
    index = F.lit(0.4) * (words / sentences + F.lit(100.0) * complex_words / words)
    return F.when((words > 0) & (sentences > 0), index).otherwise(0.0)


FOG_COLUMNS = ["fog_index", "avg_sentence_len", "word_count", "sentence_count"]


def with_fog(df: DataFrame, column: str = "text", letters: str = LETTERS, words_as: str = "_list") -> DataFrame:
    """Adds the FOG columns, and the words under ``words_as``; zeros for no words.

    Words and counts are columns of their own, so each pattern runs over the text once.
    """
    text = F.col(column)
    n, sentences = F.size(words_as), F.col("_sentences")
    some = (n > 0) & (sentences > 0)
    return (
        df.withColumns(
            {
                words_as: words(text, letters),
                "_sentences": sentence_count(text),
                "_complex": complex_word_count(text, letters),
            }
        )
        .withColumns(
            {
                "fog_index": fog_index(n, sentences, F.col("_complex")),
                "avg_sentence_len": F.when(some, n / sentences).otherwise(0.0),
                "word_count": F.when(some, n).otherwise(0),
                "sentence_count": F.when(some, sentences).otherwise(0),
            }
        )
        .drop("_sentences", "_complex")
    )


def mentions(text: Column, needle: str) -> Column:
    """Words that start with ``needle`` once lower-cased and accent-folded."""
    return F.regexp_count(ascii_fold(F.lower(text)), F.lit(rf"(?U)\b{needle}\w*"))


def canonical_label(label: Column, mapping: dict[str, str]) -> Column:
    """Exact-match relabelling; other values pass through."""
    out = None
    for old, new in mapping.items():
        out = F.when(label == old, new) if out is None else out.when(label == old, new)
    return label if out is None else out.otherwise(label)


def str_trunc(label: Column, width: int = 35) -> Column:
    return F.when(
        F.length(label) > width, F.concat(F.substring(label, 1, width - 3), F.lit("..."))
    ).otherwise(label)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def pct_label(share: Column, digits: int = 0) -> Column:
    """A share as a percentage text, halves rounded to even."""
    return F.concat(
        F.format_string(f"%.{digits}f", F.bround(share * 100.0, digits)), F.lit("%")
    )


def n_label(name: Column, n: Column) -> Column:
    return F.concat(name, F.lit("  (n="), n.cast("string"), F.lit(")"))
