"""Scalar text functions, all of them built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

HANGUL, LATIN = "[가-힣]", "[A-Za-z]"
#: Characters that names and screens are compared by, and a run of any others.
KEPT = "0-9a-z가-힣"
OTHERS = f"[^{KEPT}]+"
TERMS = rf"({HANGUL}{{2,}}|[A-Z]{LATIN}+)"
_GAP, _NUMBER = r"\s*", r"(\d+)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f mentions it, lambdas included."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def timestamp(sec: Column) -> Column:
    """HH:MM:SS of seconds, cut to whole ones and at least 0."""
    s = F.greatest(F.lit(0).cast("bigint"), sec.cast("bigint"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def short_name(c: Column, limit: int = K.NAME_CHARS) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(limit)), r"(?U)\s+$", ""), F.lit("~")))


def folded_words(c: Column, least: int) -> Column:
    """Distinct words of digits, Latin small letters and Hangul, of at least so many characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"[{KEPT}]{{{least},}}"), F.lit(0)))


def screen_words(lines: Column) -> Column:
    return folded_words(F.array_join(lines, " "), 2)


def name_words(c: Column) -> Column:
    return folded_words(c, 1)


def flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), OTHERS, "")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters after ``flat``; none for fewer than two characters. A look-ahead yields
    the pair at each place without a lambda, which would be interpreted for each character."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(flat(c), F.lit("(?=(..))"), F.lit(1))), F.array().cast("array<string>"))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def mixed_scripts(c: Column) -> Column:
    """Short tokens wholly in the script that the line has less of."""
    han, lat = count_of(c, HANGUL), count_of(c, LATIN)
    short = lambda x: (F.length(x) <= 4) & x.rlike(r"[\p{L}\p{N}]")
    odd = lambda mine, other: F.size(F.filter(tokens(c), lambda x: short(x) & x.rlike(other) & ~x.rlike(mine)))
    return F.when(han > lat, odd(HANGUL, LATIN)).when(lat > han, odd(LATIN, HANGUL)).otherwise(0)


def reading_score(lines: Column) -> Column:
    """Characters read, less the cost of mixed scripts."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x) - mixed_scripts(x) * K.MIX_COST)


def line_score(text: Column, conf: Column) -> Column:
    bonus = F.when(count_of(text, HANGUL) >= 2, K.HANGUL_BONUS).otherwise(0)
    return F.coalesce(conf, F.lit(float(K.MIN_CONF))) - mixed_scripts(text) * K.MIX_COST + bonus + F.length(text) * F.lit(K.LENGTH_GAIN)


def week(c: Column) -> Column:
    """The number before 주차, else the first number."""
    first = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int")
    return F.coalesce(first(r"(?U)(\d+)\s*주차"), first(r"(?U)(\d+)"))


_COURSE = "(?U)^(.*?)" + _GAP + _NUMBER + _GAP + "-" + _GAP + _NUMBER + _GAP + "강?$"


def course(c: Column) -> tuple[Column, Column, Column]:
    """Course, week and period of a name like ``회계 6-1강``; else the whole name."""
    s = strip(c)
    part = lambda k: F.when(s.rlike(_COURSE), F.regexp_extract(s, _COURSE, k))
    return F.coalesce(strip(part(1)), s), part(2).cast("int"), part(3).cast("int")


def garbled(c: Column) -> Column:
    """Whether a line looks misread: mostly single characters, stray jamo or signs inside words, odd capitals."""
    t = tokens(c)
    core = lambda x: F.regexp_replace(x, "^[.,:;!?()\\[\\]'\"·’”“‘…]+|[.,:;!?()\\[\\]'\"·’”“‘…]+$", "")
    bad = r"[ㄱ-ㅣ|\\/\[\]{}<>~^_=＊]|[a-z][A-Z]"
    return (F.size(F.filter(t, lambda x: F.length(x) == 1)) * 2 >= F.size(t)) | F.exists(t, lambda x: core(x).rlike(bad))


def title(lines: Column) -> Column:
    """The first of the first lines that can serve as a title, or NULL."""
    clean = F.transform(F.slice(lines, 1, K.TITLE_LINES), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))

    def good(s: Column) -> Column:
        t = tokens(s)
        spaced = (F.size(t) >= 4) & F.forall(t, lambda x: F.length(x) == 1)
        wordy = (count_of(s, HANGUL) >= 2) | F.exists(t, lambda x: x.rlike(r"^\p{L}{3,}$"))
        return (F.length(s) >= 4) & ~spaced & s.rlike(r"[\p{L}\p{Nl}\p{No}]") & ~garbled(s) & wordy

    return F.left(F.get(F.filter(clean, good), F.lit(0)), F.lit(K.TITLE_CHARS))


def body_hash(c: Column) -> Column:
    """16 hexadecimal digits of the text before the first marker, with any line ends as \\n."""
    return F.left(F.sha2(F.substring_index(F.regexp_replace(c, "\r\n?", "\n"), K.MARKER, 1), 256), F.lit(16))


def fingerprint(model: Column, language: Column, beam: Column, accurate: Column, batch: Column, slides: Column, ocr: Column) -> Column:
    mode = F.when(accurate, F.lit("정확도")).otherwise(F.concat(F.lit("속도b"), batch.cast("string")))
    tail = F.when(slides, F.concat(F.lit("|slide"), ocr)).otherwise("")
    return F.concat(F.lit(f"rev{K.REVISION}|"), model, F.lit("|"), language, F.lit("|beam"), beam.cast("string"), F.lit("|"), mode, tail)


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    """A whole number within bounds; the default where there is none."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def ends_sentence(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)\s+$", "")
    return t.rlike("[.!?\"'”…]$") & ~t.rlike(r"(?U)\d\.$")


def hallucinated(c: Column) -> Column:
    """Whether some phrase of some length comes too often."""
    parts = F.filter(F.transform(F.split(c, "[.!?]"), strip), lambda p: F.length(p) >= K.PHRASE_CHARS)
    # equal phrases are neighbours after sorting, and one that comes k times equals the one k - 1 places on
    often = lambda x: F.exists(F.transform(x, lambda p, i: p == F.get(x, i + K.REPEATS - 1)), lambda e: F.coalesce(e, F.lit(False)))
    return let(F.array_sort(parts), often)


def suspect(logprob: Column, no_speech: Column) -> Column:
    return (F.coalesce(logprob, F.lit(0.0)) < K.MIN_LOGPROB) | (F.coalesce(no_speech, F.lit(0.0)) > K.MAX_NO_SPEECH)


def silence_share(duration: Column, kept: Column) -> Column:
    """Share of the sound that voice detection left out."""
    return 1 - F.coalesce(kept, duration) / F.greatest(duration, F.lit(0.01))


def percent(share: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.format_string("%d", F.bround(share * 100, 0).cast("bigint"))
