"""Text functions: normalisation, similarity, catalogue numbers, keys, forms, lines.

Patterns with fixed word lists equal the published semantics of the archive's tools;
they stand under comments that mark them as fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Brackets and punctuation that normalisation removes.
BRACKETS = r"[()\[\]{}<>「」『』〈〉《》【】〔〕]"
PUNCTUATION = r"[.,;:!?'\"`~@#$%^&*_=+\\|/\-–—·ㆍ]"
#: Words that stand for an absent value.
PLACEHOLDERS = ("-", "--", "n/a", "na", "null", "none", "unknown", "없음", "미상", "해당없음", "알수없음", "알 수 없음")
#: Fixed value: catalogue numbers.
OPUS = (
    r"(?iU)(?:\bOp(?:us)?\.?\s*(?:posth\.?\s*)?(\d+[a-zA-Z]?(?:\s*[-–/]\s*\d+[a-z]?)?)"
    r"|작품\s*(?:번호\s*)?(\d+(?:\s*[-–/]\s*\d+)?)"
    r"|\b(BWV|KV|K|D|Hob|WoO|RV|HWV|TrV|Sz|WAB|FP|BB|CD|JW|MWV|Anh|H|B|S)\.?\s*(?:XVI\s*[:.]\s*)?(\d+[a-zA-Z]?(?:\s*[:.]\s*\d+)?))"
)
#: Ordinals, keys in two languages, and words of titles that say nothing.
NUMBER = r"(?U)(?:No\.?\s*|Nr\.?\s*|제\s*)(\d{1,3})\b|(\d{1,3})\s*번"
KEY_EN = r"\b(?:in\s+)?([A-Ga-g])[\s-]?(sharp|flat|#|♯|♭)?[\s-]*(major|minor|Major|Minor|dur|moll)\b"
KEY_KO = r"((?:올림|내림)?[다라마바사가나])\s?(장조|단조)"
STOPWORDS = ("the a an of in for and or op no nr and with de la le les il un une piano violin cello viola flute oboe clarinet horn trumpet solo duo major minor sharp flat dur moll from and etc").split()


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once: an expression named twice, or inside a lambda, would be computed at each place."""
    return F.element_at(F.transform(F.array(value), then), 1)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return s.str.normalize("NFKC")


def normalize_text(s: Column, compose: bool = True) -> Column:
    """NFKC, lower case, brackets, punctuation and all white space removed; null is ''.

    compose=False skips NFKC and stays on the JVM, for texts that are composed.
    """
    x = F.coalesce(s, F.lit(""))
    x = F.lower(nfkc(x) if compose else x)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, BRACKETS, " "), PUNCTUATION, " "), r"(?U)\s+", "")


def normalize_work(s: Column, compose: bool = True) -> Column:
    """normalize_text after one spelling for opus and number words."""
    x = F.coalesce(s, F.lit(""))
    x = F.lower(nfkc(x) if compose else x)
    x = F.regexp_replace(x, r"(?U)작품\s*번?호?\s*", "op")
    for word, to in (("op", "op"), ("no", "no"), ("nr", "no")):  # word borders are ASCII there
        x = F.regexp_replace(x, rf"(?<![A-Za-z0-9_]){word}\s*\.?\s*", to)
    return normalize_text(x, compose=False)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 if both are empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


#: Words of lines that are no programme, and ends and joints of sentences.
NOISE = (
    r"(문의|예매|티켓|주최|주관|후원|협찬|저작권|홈페이지|www\.|http|할인|취소|환불|입장|"
    r"만\s?\d세|무료|초대|R석|S석|A석|B석|VIP|공연시간|관람시간|인터넷|콜센터|주차|"
    r"변경될 수|사정에 따라|미취학|초등학생|중학생|사진|촬영|녹음|녹화)"
)
SENTENCE = r"(다\.|다$|니다|습니다|였다|이다|였습니다|하였다|한다\.|된다|것이다|였고|하며|면서|때문|그리고|하지만|그러나|또한|이후|당시|현재|오늘날)"


def is_noise(line: Column) -> Column:
    """Whether a line speaks of tickets, sponsors or rules of the house."""
    return line.rlike(NOISE)


def is_sentence(line: Column, least: int = 40) -> Column:
    """Whether a line is prose: longer than ``least`` characters, with an end or joint of a sentence."""
    return (F.length(line) > least) & line.rlike(SENTENCE)


def is_empty_list(values: Column) -> Column:
    """Whether an array of strings is null or holds nothing but empty values."""
    return F.coalesce(F.forall(values, is_empty_value), F.lit(True))


def is_empty_number(x: Column) -> Column:
    """Whether a number is null or not a number."""
    return x.isNull() | F.isnan(x)


def is_empty_value(s: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return (t == "") | t.isin(*PLACEHOLDERS)


def to_number(s: Column) -> Column:
    """Digits, dots and minus signs alone, as double; null if that is no number."""
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")


def work_number(s: Column) -> Column:
    """`No. n`, `제 n` or `n번` from 1 to 120, as string without leading zeros."""
    n = F.coalesce(F.nullif(F.regexp_extract(s, NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract(s, NUMBER, 2), F.lit(""))).try_cast("int")
    return F.when(n.between(1, 120), n.cast("string"))


def parse_opus(s: Column) -> Column:
    """The first catalogue number: `op.n`, or the catalogue in upper case (KV is K), a dot and the number."""
    tidy = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))
    groups = lambda hit: F.struct(*[F.regexp_extract(hit, OPUS, i).alias(f"g{i}") for i in (1, 2, 3, 4)])  # noqa: E731  of the hit alone, so that the text is searched once
    name = lambda g: F.when(F.upper(g["g3"]) == "KV", "K").otherwise(F.upper(g["g3"]))
    said = lambda g: F.when(g["g1"] != "", F.concat(F.lit("op."), tidy(g["g1"]))).when(g["g2"] != "", F.concat(F.lit("op."), tidy(g["g2"]))).when(g["g3"] != "", F.concat(name(g), F.lit("."), tidy(g["g4"])))
    return bound(F.regexp_extract(s, OPUS, 0), lambda hit: F.when(hit != "", bound(groups(hit), said)))


def parse_key(s: Column) -> Column:
    """The Korean key if there is one, else the English one as `C sharp minor`."""
    ko = F.concat(F.regexp_extract(s, KEY_KO, 1), F.regexp_extract(s, KEY_KO, 2))
    note, sign, mode = (F.regexp_extract(s, KEY_EN, i) for i in (1, 2, 3))
    sign = F.when(sign.isin("#", "♯"), "sharp").when(sign == "♭", "flat").otherwise(F.lower(sign))
    mode = F.when(F.lower(mode) == "dur", "major").when(F.lower(mode) == "moll", "minor").otherwise(F.lower(mode))
    en = F.concat_ws(" ", F.upper(note), F.nullif(sign, F.lit("")), mode)
    return F.when(ko != "", ko).when(note != "", en)


def slug(s: Column) -> Column:
    """Up to six telling words of a title line."""
    t = F.element_at(F.split(s, "\n", -1), 1)
    t = F.regexp_replace(t, r"(?U)^[^:：\-–—]{2,45}\s*[-–—:：]\s*", "")
    t = F.regexp_replace(t, "/.*$", "")
    t = F.regexp_replace(t, OPUS, " ")
    t = F.lower(F.regexp_replace(t, "[^A-Za-zÀ-ÿ가-힣0-9 ]", " "))
    return F.array_join(F.slice(F.filter(F.split(t, " +"), lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1)), 1, 6), " ")


#: Characters that a comparison of two readings leaves out.
ZERO_WIDTH = "[\u200B-\u200D\uFEFF]"
READING_MARKS = r"[.,·・:;()\[\]{}<>'\"`~!?/\\-]"


def canonical(s: Column, compose: bool = True) -> Column:
    """NFKC, lower case, without white space, zero-width characters and punctuation; null is ''. compose as in normalize_text."""
    x = F.coalesce(s, F.lit(""))
    x = F.lower(nfkc(x) if compose else x)
    return F.regexp_replace(x, rf"(?U)\s+|{ZERO_WIDTH}|{READING_MARKS}", "")


def venue_text(s: Column) -> Column:
    """Lower case without white space (the ideographic one too) and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?U)[\s\u3000]+|\p{P}+", "")


def catalog_split(opus: Column) -> Column:
    """struct<catalogue, number> of `op.67` or `K.12`: lower case, at the first dot; nulls if there is none."""
    parted = opus.contains(".")
    return F.struct(F.when(parted, F.lower(F.substring_index(opus, ".", 1))).alias("catalogue"), F.when(parted, F.regexp_replace(opus, r"^[^.]*\.", "")).alias("number"))


def separators(s: Column) -> Column:
    """Upright strokes that stand alone between spaces, however they were read, become ` | `."""
    return F.regexp_replace(s, r"\s+[Il|｜ǀ丨ㅣ]\s+", " | ")


def hash_key(s: Column, length: int = 16) -> Column:
    """The first characters of the SHA-256 of a text."""
    return F.substring(F.sha2(s, 256), 1, length)


def latin_ratio(s: Column) -> Column:
    """Share of letters below U+2000; 0 if there are none."""
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(s, r"[^\p{L}&&[\u0000-\u1FFF]]", ""))
    return F.coalesce(F.try_divide(latin, letters), F.lit(0.0))


def sort_name(s: Column) -> Column:
    """`First Last` as `Last, First`; one word stays."""
    w = F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != "")
    n = F.size(w)
    return F.when(n < 2, s).otherwise(F.concat_ws(", ", F.element_at(w, -1), F.array_join(F.slice(w, F.lit(1), n - 1), " ")))


def unescape(s: Column) -> Column:
    """The common character references of a page, read."""
    for name, to in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(to))
    return s


def html_lines(html: Column) -> Column:
    """Lines of a page: comments, scripts and styles dropped, block tags break lines, other tags go, white space is joined, empty lines go."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</(?:script|style)>", "")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/td|/th|/ul|/ol|/table|/title)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    x = F.regexp_replace(F.regexp_replace(unescape(x), "[\u200B-\u200D\uFEFF]", ""), "[ \t\r\f\u00A0]+", " ")
    return F.filter(F.transform(F.split(x, "\n", -1), lambda v: F.trim(v)), lambda v: v != "")
