"""Text cleaning as column functions. Patterns spell out Unicode classes, so that they do not depend on the Java version."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f"

#: Mojibake and what it stands for, in order.
MOJIBAKE = (
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ('â€"', "-"),
    ('â€"', "--"),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ã ", "à"),
    ("\xa0", " "),
    ("​", ""),
)
#: Characters that cleaned text keeps besides letters, digits, underscores and blanks.
KEPT_SIGNS = r".,!?;:\-'\"()\[\]{}/@#$%&*+="
#: Transcript patterns, in order of use.
TIMESTAMPS = r"\[\d{2}:\d{2}\]|\(\d{2}:\d{2}\)"
BRACKETED = r"\[.*?\]|\(.*?\)"
SPEAKER_MARK = r"^.*?:[\s\x1c-\x1f]"
TRANSCRIPT_SIGNS = r"[♪|#@&*]"
TAGS = r"<[^>]+>"
URLS = r"https?://[a-z!$-_]+"
#: Fillers, artefacts and phrases that transcripts lose.
FILLERS = ("um", "uh", "er", "ah", "like", "you know")
MEETING_FILLERS = (
    "um", "uh", "like", "you know", "kind of", "sort of", "I mean", "right",
    "so", "well", "okay", "basically", "actually", "literally", "anyway[s]?", "I guess",
)
TRANSITIONS = ("let me", "I'm going to", "we're going to", "going to", "let's see", "you see", "you know what")
ARTEFACTS = ("[Music]", "[Applause]", "[Laughter]", "(music)", "(applause)", "(laughter)", "♪", "►", "¶", "•")
MEETING_ARTEFACTS = (
    "[Music]", "[Applause]", "[Laughter]", "[Background Noise]", "(music)", "(applause)", "(laughter)", "(noise)",
    "♪", "►", "¶", "•",
)


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Blanks (Unicode, and the separators 1c to 1f) at both ends go."""
    return _sub(c, f"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def normalized(c: Column, form: str) -> Column:
    """Unicode normal form. The function counts as non-deterministic, so that the planner never evaluates it, or what goes into it, again in
    a filter or a second projection."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return f.asNondeterministic()(c)


def strip_tags(c: Column) -> Column:
    """Tags go; named and decimal entities become spaces."""
    return _sub(_sub(_sub(c, TAGS, ""), "&[a-zA-Z]+;", " "), "&#[0-9]+;", " ")


def ascii_or_letters(c: Column) -> Column:
    """Compatibility decomposition, of which ASCII and letters stay (accents, typographic signs and symbols go)."""
    return _sub(normalized(c, "NFKD"), r"[^\x00-\x7F\p{L}]", "")


def fix_mojibake(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, c)


def collapse_spaces(c: Column) -> Column:
    """Tabs become spaces, runs of spaces one, and none stays before . , ! ? ; :"""
    return _sub(_sub(F.replace(c, F.lit("\t"), F.lit(" ")), " +", " "), " +([.,!?;:])", "$1")


def collapse_blank_lines(c: Column) -> Column:
    return _sub(c, rf"(?U)\n[{BLANK}]*\n+", "\n\n")


def drop_special(c: Column) -> Column:
    return _sub(c, rf"(?U)[^{WORD_CHARS}{BLANK}{KEPT_SIGNS}]", "")


def clean_text(c: Column, remove_html: bool = True, normalize_whitespace: bool = True) -> Column:
    """Clean prose; null and empty give empty. The mojibake step is left out: nothing that it looks for outlives decomposition."""
    c = F.coalesce(c, F.lit(""))
    c = ascii_or_letters(strip_tags(c) if remove_html else c)
    return strip(drop_special(collapse_blank_lines(collapse_spaces(c) if normalize_whitespace else c)))


def without_controls(c: Column) -> Column:
    """Compatibility composition without control, format and unassigned characters; line ends and tabs stay."""
    return _sub(normalized(c, "NFKC"), r"[\p{C}&&[^\n\t]]", "")


def _words_out(c: Column, words: tuple[str, ...]) -> Column:
    edge = f"[{WORD_CHARS}]"
    return reduce(lambda x, w: _sub(x, f"(?iu)(?<!{edge})(?:{w})(?!{edge})", ""), words, c)


def _artefacts_out(c: Column, artefacts: tuple[str, ...]) -> Column:
    return reduce(lambda x, a: F.replace(x, F.lit(a), F.lit("")), artefacts, c)


def fix_ocr(c: Column) -> Column:
    """Bars, zeros and ones as the letters I, O and l: it spoils numbers, and is what transcripts expect."""
    return F.translate(c, "|01", "IOl")


def _patterns(second: str) -> tuple[str, ...]:
    return (TIMESTAMPS, second, f"[{BLANK}]+", TRANSCRIPT_SIGNS, TAGS, URLS, r"\n+")


def _fold(c: Column, second: str) -> Column:
    return reduce(lambda x, p: _sub(x, f"(?dU){p}", " "), _patterns(second), c)


def clean_transcript_text(c: Column, fix_ocr_digits: bool = True) -> Column:
    """A transcript's text: fillers, then patterns in order, artefacts, look-alikes, blanks."""
    c = _fold(_words_out(without_controls(c), FILLERS), BRACKETED)
    c = _artefacts_out(c, ARTEFACTS)
    return _sub(strip(fix_ocr(c) if fix_ocr_digits else c), f"(?U)[{BLANK}]+", " ")


def clean_meeting_text(c: Column, fix_ocr_digits: bool = True) -> Column:
    """A meeting's text: patterns in order (a leading speaker mark, brackets stay), artefacts, fillers, transitions, look-alikes."""
    c = _artefacts_out(_fold(normalized(c, "NFKC"), SPEAKER_MARK), MEETING_ARTEFACTS)
    c = _words_out(_words_out(c, MEETING_FILLERS), TRANSITIONS)
    return strip(_sub(fix_ocr(c) if fix_ocr_digits else c, f"(?U)[{BLANK}]+", " "))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.shiftright(F.length(c), 2)


def word_count(c: Column) -> Column:
    """Runs of non-blank characters; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(f"(?U)[^{BLANK}]+")), F.lit(0))


def is_valid_text(c: Column, min_length: int = 50, min_words: int = 5) -> Column:
    """At least min_length characters and min_words words of letters, digits and underscores; null is not valid."""
    return F.coalesce((F.length(c) >= min_length) & (F.regexp_count(c, F.lit(f"[{WORD_CHARS}]+")) >= min_words), F.lit(False))
