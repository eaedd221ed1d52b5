import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions import text as tx


def test_slang(one):
    assert one(tx.expand_slang, ["Gava imetumia doo ngapi?", "GAVA na Doo", "doondoo", ""]) == [
        "serikali imetumia pesa ngapi?", "serikali na pesa", "doondoo", ""]


def test_to_english(one):
    assert one(tx.to_english, "hospitali ya Njoro ilikuwa pesa ngapi?") == "hospital Njoro money cost how much?"
    assert one(tx.to_english, "What is  the cost?") == "What is the cost?"


def test_variants(one):
    variants = one(tx.query_variants, ["Gava ilitumia doo ngapi?", "ya za hii hiyo", "plain question"])
    assert len(variants[0]) == 3 and variants[0][-1] == "government ilitumia money cost how much?"
    assert variants[1] == ["ya za hii hiyo"] and variants[2] == ["plain question"]


def test_lexicon_fallback_keeps_text(one):
    assert one(tx.lexicon_translation, "ya za") == "ya za"


def test_reply_language(one):
    assert one(tx.reply_language, ["Mradi huu uligharimu Kshs. 16,999,852.", "The value is NA for this line item.", ""]) == [
        "sw", "en", "en"]


def test_translation_gate(one):
    assert one(tx.needs_translation, ["pesa ngapi", "cost of that barabara", "the Nakuru county budget", "The value is NA",
                                      "how much doo"]) == [True, True, False, False, True]


def test_register_texts(one):
    texts = one(tx.no_answer_text, ["pesa ngapi", "how much"])
    assert texts == [fv.NO_ANSWER_TEXT["sw"], fv.NO_ANSWER_TEXT["en"]]
    assert one(tx.system_error_text, "how much") == fv.SYSTEM_ERROR_TEXT["en"]


def test_lexical_terms(one):
    assert one(tx.lexical_terms, "What is the status of Njoro Level-4 hospital?") == ["njoro", "level", "4", "hospital"]


def test_report_keyword(one):
    assert one(tx.is_report_keyword, ["  Si   KWELI ", "report", "report this please", "si kweli kabisa"]) == [
        True, True, False, False]


def test_value_for_money(one):
    assert one(tx.is_value_for_money, ["Was it WORTH it", "bei gani", "how much"]) == [True, True, False]


def test_translation_cleanup(one):
    assert one(tx.clean_translation, ['"Translation: road budget"', "Sure - road budget", "road"]) == [
        'road budget', "road budget", "road"]


def test_accepted_translation(spark):
    from pyspark.sql import functions as F

    rows = [(1, "pesa ya barabara", "road expenditure"), (2, "pesa ya barabara", "pesa ya barabara"),
            (3, "pesa ya barabara", None), (4, "road budget", "ignored"), (5, "  ", None)]
    df = spark.createDataFrame(rows, "i int, q string, t string").orderBy("i")
    found = [r[0] for r in df.select(tx.accepted_translation(F.col("q"), F.col("t"))).collect()]
    assert found == ["road expenditure", "money cost road", "money cost road", "road budget", "  "]


def test_clarifying_question(one):
    assert one(tx.clarifying_question, ['"Which hospital?"', "not_vague", " ", "NOT_VAGUE"]) == [
        "Which hospital?", None, None, None]


@pytest.mark.parametrize("text,county", [
    ("COUNTY EXECUTIVE OF NAKURU – NO.32", "Nakuru"), ("3.31. County Government of Nakuru", "Nakuru"),
    ("cover\nCOUNTY EXECUTIVE OF\nNAKURU – NO.32\nbody", "Nakuru"), ("COUNTY ASSEMBLY OF THARAKA-NITHI", "Tharaka Nithi"),
    ("COUNTY EXECUTIVE OF MURANG'A", "Murang'a"), ("COUNTY EXECUTIVE OF TAITA/TAVETA", "Taita Taveta"),
    ("COUNTY EXECUTIVE OF NAIROBI CITY", "Nairobi City"),
    ("In its plan the County Executive of Nakuru sets aside money for two new dams in the west", None),
    ("County Executive of Nakuru in its plan for eight new roads and dams", None),
    ("COUNTY EXECUTIVE OF ATLANTIS – NO.99", None), ("", None),
])
def test_heading(one, text, county):
    assert one(tx.heading_county, text) == county


def _model_windows(text, size, overlap):
    out = []
    for part in re.split(r"(?=\b\d{2,3}\.(?:\d+\.?)?\s+[A-Z][a-z])", text):
        ws, start = part.split(), 0
        while start < len(ws):
            out.append(" ".join(ws[start:start + size]))
            if start + size >= len(ws):
                break
            start += size - overlap
    return out


def test_window_checks():
    for size, overlap in ((0, 0), (-1, 0), (10, 10), (10, 11)):
        with pytest.raises(ValueError):
            tx.check_window(size, overlap)


def test_section_split(one):
    text = "665. Supply, Installation and delivery of things 839.4. Stalled Construction of a ward"
    chunks = one(lambda c: tx.word_windows(c, 50, 0), text)
    assert [c.split()[0] for c in chunks] == ["665.", "839.4."]
    flat = "Kshs. 148,902,024 and 10.5 million in Table 3.457 plus 2.6 of it"
    assert len(one(lambda c: tx.word_windows(c, 50, 0), flat)) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t  12. AaÉé", max_size=80), min_size=5, max_size=30),
       st.integers(2, 9), st.integers(0, 1))
def test_windows_match_model(one, texts, size, overlap):
    model = [_model_windows(t, size, overlap) for t in texts]
    assert one(lambda c: tx.word_windows(c, size, overlap), texts) == model
    assert one(lambda c: tx.window_count(c, size, overlap), texts) == [len(m) for m in model]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["doo", "Gava", "county", "doo-doo", "doo_x", "é", "doé", "pesa", ".", "  "]),
                         max_size=8).map(" ".join), min_size=5, max_size=30))
def test_slang_matches_model(one, texts):
    keys = sorted(fv.SLANG_TO_SWAHILI, key=len, reverse=True)
    pattern = re.compile(r"\b(" + "|".join(keys) + r")\b", re.I)
    model = [pattern.sub(lambda m: fv.SLANG_TO_SWAHILI[m.group(0).lower()], t) for t in texts]
    assert one(tx.expand_slang, texts) == model


def test_white_space_is_the_fixed_set(one):
    """Every character beside a word, in both modes of the pattern: only the fixed ones part it."""
    text = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    left = "".join(c for c in text if c not in tx._SPACE_CHARS)
    assert [one(lambda c: F.regexp_replace(c, mode + tx.SPACE, ""), text) for mode in ("", "(?iU)")] == [left, left]
    assert "&&" in tx.SPACE  # characters beyond Latin-1 are told apart by one comparison
