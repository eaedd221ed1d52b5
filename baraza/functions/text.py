"""Text functions as Spark columns: words, lexicons, languages, headings and chunk windows.

Everything stays in built-in expressions. ``(?U)`` makes Java's ``\\s``, ``\\b`` and ``\\d`` follow
Unicode, and the extra control characters complete the set that counts as white space.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from baraza import fixed_values as fv

# Every character that counts as white space.
_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set: of characters beyond Latin-1 only those between the outermost two are looked at one by one.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
SPACES = SPACE + "+"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE_CHARS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def dedup_key(text: Column) -> Column:
    """Lower case with single spaces: the key under which equal texts meet."""
    return collapse_spaces(F.lower(text))


def literal_map(entries: dict) -> Column:
    """A constant map; values may be columns."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _whole_word(keys) -> str:
    longest_first = sorted(keys, key=len, reverse=True)
    return r"(?iU)\b(?:" + "|".join(re.escape(k) for k in longest_first) + r")\b"


def replace_words(text: Column, lexicon: dict) -> Column:
    """Replace whole words found in ``lexicon`` (single pass, any case).

    One regular-expression scan decides whether the text holds any entry at all, so texts without
    one skip the word-by-word rewrite.
    """
    if not lexicon:
        return text
    entries, keys = literal_map(lexicon), list(lexicon)

    def rewritten(value):
        # The membership test is a hash lookup; only words that are entries reach the map.
        swap = F.transform(F.split(value, r"(?U)\b"), lambda t: F.when(
            F.lower(t).isin(keys), F.element_at(entries, F.lower(t))).otherwise(t))
        return F.when(value.rlike(_whole_word(lexicon)), F.array_join(swap, "")).otherwise(value)

    return let(text, rewritten)


def expand_slang(text: Column, lexicon: dict = fv.SLANG_TO_SWAHILI) -> Column:
    return replace_words(text, lexicon)


def to_english(text: Column, lexicon: dict = fv.SWAHILI_TO_ENGLISH) -> Column:
    return collapse_spaces(replace_words(text, lexicon))


def query_variants(text: Column, slang: dict = fv.SLANG_TO_SWAHILI,
                   english: dict = fv.SWAHILI_TO_ENGLISH) -> Column:
    """``[text, slang-expanded, English]`` without repeats or an empty translation."""
    def variants(expanded):
        translated = let(to_english(expanded, english), lambda t: F.when(t != "", t))
        return F.array_distinct(F.array_compact(F.array(text, expanded, translated)))

    return let(expand_slang(text, slang), variants)


def lexicon_translation(text: Column, slang: dict = fv.SLANG_TO_SWAHILI,
                        english: dict = fv.SWAHILI_TO_ENGLISH) -> Column:
    return let(to_english(expand_slang(text, slang), english), lambda t: F.when(t != "", t).otherwise(text))


def _latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def marker_hits(text: Column, markers=tuple(fv.SWAHILI_MARKERS)) -> Column:
    return F.size(F.filter(_latin_words(text), lambda w: w.isin(list(markers))))


def reply_language(text: Column, markers=tuple(fv.SWAHILI_MARKERS), threshold=fv.REPLY_MARKER_HITS) -> Column:
    """``sw`` with at least two marker words (repeats count), else ``en``."""
    return F.when(marker_hits(text, markers) >= threshold, "sw").otherwise("en")


def _has_clear_marker(text: Column, markers, ambiguous) -> Column:
    clear = [m for m in markers if m not in set(ambiguous)]
    return F.exists(_latin_words(text), lambda w: w.isin(clear))


def needs_translation(text: Column, markers=tuple(fv.SWAHILI_MARKERS), ambiguous=tuple(fv.AMBIGUOUS_MARKERS),
                      slang=tuple(fv.SLANG_TO_SWAHILI)) -> Column:
    """One clear marker word, or one slang word other than the English ``county``."""
    signal = [s for s in slang if s != "county"]
    return _has_clear_marker(text, markers, ambiguous) | text.rlike(_whole_word(signal))


def query_register(text: Column, markers=tuple(fv.SWAHILI_MARKERS), ambiguous=tuple(fv.AMBIGUOUS_MARKERS)) -> Column:
    return F.when(_has_clear_marker(text, markers, ambiguous), "sw").otherwise("en")


def canned_text(register: Column, texts: dict) -> Column:
    return F.element_at(literal_map(texts), register)


def no_answer_text(query: Column) -> Column:
    return canned_text(query_register(query), fv.NO_ANSWER_TEXT)


def system_error_text(query: Column) -> Column:
    return canned_text(query_register(query), fv.SYSTEM_ERROR_TEXT)


def lexical_terms(text: Column, stop_words=tuple(fv.LEXICAL_STOP_WORDS)) -> Column:
    """Lower-case ``[a-z0-9]+`` terms in order, stop words removed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(tokens, lambda w: ~w.isin(list(stop_words)))


def is_report_keyword(text: Column, keywords=tuple(fv.REPORT_KEYWORDS)) -> Column:
    return dedup_key(text).isin(list(keywords))


def is_value_for_money(text: Column, triggers=tuple(fv.VALUE_FOR_MONEY_TRIGGERS)) -> Column:
    return F.lower(text).rlike("|".join(re.escape(t) for t in triggers))


def clean_translation(text: Column) -> Column:
    """Strip quotes and a leading filler phrase from a supplied translation."""
    unquoted = F.regexp_replace(strip(text), "^[\"'`]+|[\"'`]+\\z", "")
    filler = f"(?iU)^(?:{'|'.join(fv.TRANSLATION_FILLERS)}){SPACE}*[:：\\-]{SPACE}*"
    return strip(F.regexp_replace(unquoted, filler, ""))


def accepted_translation(query: Column, supplied: Column) -> Column:
    """A cleaned translation if usable (non-empty, changed, not Swahili), else the lexicon's.

    Queries that need no translation pass through.
    """
    def usable(cleaned):
        good = cleaned.isNotNull() & (cleaned != "") & (cleaned != query) & (reply_language(cleaned) == "en")
        return F.when(good, cleaned)

    translated = F.coalesce(let(clean_translation(supplied), usable), lexicon_translation(query))
    blank = strip(query) == ""
    return F.when(blank | ~needs_translation(query), query).otherwise(translated)


def clarifying_question(reply: Column) -> Column:
    """A clarifying question, or null for an empty reply or the "not vague" sentinel."""
    text = F.regexp_replace(strip(reply), "^[\"'`]+|[\"'`]+\\z", "")
    return F.when((text != "") & (F.upper(text) != fv.NOT_VAGUE), text)


# ---- headings --------------------------------------------------------------------------------
def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def _letters(name: str) -> str:
    return re.sub("[^a-z]", "", name.lower())


def county_of(text: Column, counties=tuple(fv.COUNTIES)) -> Column:
    """The longest known county whose letters start the text's letters, else null."""
    by_key = {_letters(c): c for c in counties}
    keys = sorted(by_key, key=len, reverse=True)
    found = F.regexp_extract(letters_only(text), "^(" + "|".join(keys) + ")", 1)
    return F.try_element_at(literal_map(by_key), found)


def heading_county(text: Column, counties=tuple(fv.COUNTIES), max_words: int = fv.MAX_HEADING_WORDS) -> Column:
    """County named by the first standalone heading line (alone or joined with the next line)."""
    phrase = "".join(f"{word}{SPACE}+" for word in fv.HEADING_WORDS)
    number = f"(?U)^{SPACE}*\\d+(?:\\.\\d+)*{SPACE}*[.)]?{SPACE}+"

    def named(line):
        rest = F.regexp_extract(line, f"(?iU)^{phrase}(.+)", 1)
        return F.when((rest != "") & (word_count(line) <= max_words), county_of(strip(rest), counties))

    def county(candidate):
        heading = let(F.regexp_replace(strip(candidate), number, ""), named)
        return F.when(F.contains(F.lower(candidate), F.lit("county")), heading)

    def candidates(lines):
        following = F.slice(lines, 2, F.size(lines))
        return F.flatten(F.zip_with(lines, following, lambda a, b: F.when(
            b.isNull(), F.array(a)).otherwise(F.array(a, F.concat_ws(" ", a, b)))))

    found = F.get(F.array_compact(F.transform(let(F.split(text, _LINE_BREAK), candidates), county)), F.lit(0))
    # Most pages hold no such phrase: one scan spares them the line-by-line work.
    return F.when(text.rlike(f"(?iU){phrase}"), found)


# ---- chunks ----------------------------------------------------------------------------------
_SECTION = r"(?U)(?=\b\d{2,3}\.(?:\d+\.?)?" + SPACE + "+[A-Z][a-z])"


def sections(text: Column) -> Column:
    """Cut in front of numbered section headings such as ``839.4. Stalled``.

    Texts without two digits and a dot cannot hold one and skip the costlier look-ahead.
    """
    return F.when(text.rlike(r"\p{Nd}{2}\."), F.split(text, _SECTION)).otherwise(F.array(text))


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")


def word_windows(text: Column, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Overlapping windows of ``size`` words, the last one ending with the text."""
    check_window(size, overlap)
    step = size - overlap

    def windows(section):
        # A one-element array binds the word list once, however many windows are cut from it.
        bound = F.array(words(section))
        cut = F.transform(bound, lambda ws: F.when(F.size(ws) > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - overlap - 1, F.lit(0)), F.lit(step)),
            lambda s: F.array_join(F.slice(ws, s + 1, size), " "))).otherwise(F.array().cast("array<string>")))
        return F.flatten(cut)

    return F.flatten(F.transform(sections(text), windows))


def window_count(text: Column, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """``size(word_windows(text))`` without building a window."""
    step = size - overlap
    lengths = F.transform(sections(text), word_count)
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, n: acc + F.when(n > 0, F.greatest(
        F.floor((n - overlap + step - 1) / step), F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))


def chunk_id(source: Column, page: Column, ordinal: Column) -> Column:
    stem = F.regexp_replace(source, r"\.[^.]*\z", "")
    return F.concat(stem, F.lit("_p"), page.cast("string"), F.lit("_c"), ordinal.cast("string"))
