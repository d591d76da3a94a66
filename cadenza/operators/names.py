"""Composer names: the surname index, names to composers, and composers named in texts.

Dictionaries are tables, and every lookup is an equi-join on a key made from the text,
so they may hold millions of names and a hot name costs a split partition. Accents
are folded by a rule over the Latin letters, on the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import saved

#: Words before a surname that belong to it, in the index and in a name.
PARTICLES = ("van", "von", "de", "del", "da", "der", "vaughan", "saint")
NAME_PARTICLES = ("van", "von", "de", "del", "da", "vaughan", "saint")
#: Edges that a name loses, its greatest length, initials before it, and what keys leave out.
EDGES = ".,;:·-–— "
LONGEST = 60
INITIALS = r"^((?:[A-Z]\.\s*){1,3})"
KEY_GAPS = r"(?U)[\s·.]"
HANGUL = "가-힣"
#: Fixed value: a Latin word of a text, with an apostrophe or a second word after a hyphen or a space.
WORD = r"\p{L}{3,}(?:['’]\p{L}+)*(?:[- ]\p{L}{3,})?"


@cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and plain(c) != c and len(plain(c)) == 1]
    return "".join(marked), "".join(map(plain, marked))


def fold(s: Column) -> Column:
    """Lower case, without accents and combining marks."""
    return F.translate(F.regexp_replace(F.lower(s), r"\p{Mn}", ""), *_accents())


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")


def surname_index(people: DataFrame, name: str, at: str, aliases: DataFrame) -> DataFrame:
    """(key, composer): surnames of people(name, at) in lower case, with and without accents, and the aliases(alias, composer).

    A person's forms are the last word and, after a particle, the last two; the
    composer is what the aliases say of the last form they know, else the last word
    with a capital. Of people with one key the first by ``at`` has it; aliases go
    before all people. Brackets in names do not count.
    """
    words = people.select(F.col(at).alias("at"), _words(F.regexp_replace(name, r"\(.*?\)", "")).alias("w")).filter(F.size("w") > 0)
    last, two = F.element_at("w", -1), F.array_join(F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2)), " ")
    before = F.lower(F.try_element_at("w", F.lit(-2)))
    parted = F.coalesce((F.size("w") > 1) & before.isin(*PARTICLES), F.lit(False))
    forms = words.select("at", F.concat(F.upper(F.substring(last, 1, 1)), F.expr("substring(element_at(w, -1), 2)")).alias("own"), F.posexplode(F.when(parted, F.array(last, two)).otherwise(F.array(last))).alias("form", "text"))
    known = aliases.select(F.col("alias").alias("_alias"), F.col("composer").alias("_said"))
    said = forms.join(known, F.lower("text") == F.col("_alias"), "left")
    person = said.groupBy("at").agg(F.coalesce(F.max_by("_said", F.when(F.col("_said").isNotNull(), F.col("form"))), F.first("own")).alias("composer"), F.collect_list(F.struct("form", "text")).alias("forms"))
    keys = person.select("at", "composer", F.explode("forms").alias("f")).select("at", "composer", "f.form", F.posexplode(F.array(F.lower("f.text"), fold(F.col("f.text")))).alias("variant", "key"))
    first = keys.groupBy("key").agg(F.min_by("composer", F.struct("at", "form", "variant")).alias("composer"))
    return first.join(known, F.col("key") == F.col("_alias"), "left_anti").unionByName(known.select(F.col("_alias").alias("key"), F.col("_said").alias("composer")))


def _read(s: Column) -> Column:
    """What a written name says: struct of the keys to look up and what is left if none is known."""
    return F.struct(
        F.regexp_replace(s, KEY_GAPS, "").alias("whole"),
        F.regexp_replace(F.element_at(_words(s), -1), KEY_GAPS, "").alias("last"),
        s.rlike(f"[{HANGUL}]").alias("hangul"),
        F.lower(F.regexp_replace(F.regexp_extract(s, INITIALS, 1), " ", "")).alias("initials"),
        F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, INITIALS, "")), r"\(.*?\)", ""))), r"(?U)\s+", " "), F.lit(" .,")).alias("low"),
    )


def resolve_names(strings: DataFrame, text: str, hangul: DataFrame, latin: DataFrame, families: DataFrame) -> DataFrame:
    """(text, composer, confidence), saved: one row for each distinct text that says anything.

    hangul(alias, composer), latin(alias, composer): the dictionaries. A Hangul alias
    of the whole counts 1.0, of the last word 0.9, an unknown Hangul name is `KO:` and
    its last word at 0.3. A Latin name counts 0.85: the whole alias, else that of a
    particle with the last word, of the last word, or the last word with a capital.
    families(base, initials, at, composer) tell apart people of one surname: the
    first whose initials begin those written is meant.
    """
    distinct = strings.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    clean = distinct.select("text", F.trim(F.trim("text"), F.lit(EDGES)).alias("s")).filter((F.col("s") != "") & (F.length("s") <= LONGEST))
    parsed = clean.select("text", _read(F.col("s")).alias("r")).select("text", "r.*").withColumn("w", F.filter(F.split(F.replace("low", F.lit("-"), F.lit(" ")), " "), lambda x: x != ""))
    parsed = parsed.withColumn("tail", F.try_element_at("w", F.lit(-1))).withColumn("two", F.when(F.try_element_at("w", F.lit(-2)).isin(*NAME_PARTICLES), F.array_join(F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2)), " ")))
    slot = lambda name, kind, key: F.struct(F.lit(name).alias("slot"), F.lit(kind).alias("kind"), F.col(key).alias("key"))
    asked = parsed.select("text", F.explode(F.array(slot("whole", "h", "whole"), slot("last", "h", "last"), slot("low", "l", "low"), slot("tail", "l", "tail"), slot("two", "l", "two"))).alias("q")).select("text", "q.*").filter("key IS NOT NULL")
    known = hangul.select(F.lit("h").alias("kind"), F.col("alias").alias("key"), "composer").unionByName(latin.select(F.lit("l").alias("kind"), F.col("alias").alias("key"), "composer"))
    slots = ("whole", "last", "low", "tail", "two")
    found = asked.join(known, ["kind", "key"]).groupBy("text").agg(*[F.max(F.when(F.col("slot") == x, F.col("composer"))).alias(f"of_{x}") for x in slots])
    met = parsed.join(found, "text", "left")
    base = F.coalesce("of_low", "of_two", "of_tail", F.initcap("tail"))
    latin_name = F.col("of_whole").isNull() & ~F.col("hangul") & (F.col("low") != "") & (F.col("of_low").isNotNull() | F.col("tail").isNotNull())
    told = met.select(
        "text", "initials", latin_name.alias("latin"),
        F.when(F.col("of_whole").isNotNull(), F.col("of_whole")).when(F.col("hangul"), F.coalesce("of_last", F.concat(F.lit("KO:"), "last"))).otherwise(base).alias("base"),
        F.when(F.col("of_whole").isNotNull(), 1.0).when(F.col("hangul"), F.when(F.col("of_last").isNotNull(), 0.9).otherwise(0.3)).otherwise(0.85).alias("confidence"),
    ).filter("base IS NOT NULL")
    bare = lambda c: F.replace(c, F.lit("."), F.lit(""))
    kin = families.select(F.col("base").alias("_base"), bare(F.col("initials")).alias("_initials"), F.col("at").alias("_at"), F.col("composer").alias("_composer"))
    begins = F.startswith(F.col("initials"), F.col("_initials")) | F.startswith(bare(F.col("initials")), F.col("_initials"))
    named = told.join(kin, (F.col("base") == F.col("_base")) & F.col("latin") & (F.col("initials") != "") & begins, "left")
    best = named.groupBy("text").agg(F.first("base").alias("base"), F.first("confidence").alias("confidence"), F.min_by("_composer", "_at").alias("one"))
    return saved(best.select("text", F.coalesce("one", "base").alias("composer"), "confidence"))


def norm_composers(rows: DataFrame, latin_name: str, hangul_name: str, hangul: DataFrame, latin: DataFrame, families: DataFrame) -> DataFrame:
    """rows with composer and confidence: the better of what the two names say, the Latin one if they are equal; null and 0 if neither says anything."""
    both = rows.select(F.col(latin_name).alias("s")).unionByName(rows.select(F.col(hangul_name).alias("s")))
    known = resolve_names(both, "s", hangul, latin, families)
    side = lambda k: known.select(F.col("text").alias(f"_t{k}"), F.struct("composer", "confidence").alias(f"_c{k}"))
    out = rows.join(side(1), F.col(latin_name) == F.col("_t1"), "left").join(side(2), F.col(hangul_name) == F.col("_t2"), "left")
    worse = F.coalesce(F.col("_c1.confidence"), F.lit(0.0)) < F.coalesce(F.col("_c2.confidence"), F.lit(0.0))
    pick = F.when(worse, F.col("_c2")).otherwise(F.col("_c1"))
    return out.select(*rows.columns, pick["composer"].alias("composer"), F.coalesce(pick["confidence"], F.lit(0.0)).alias("confidence"))


def _prefix(pieces: str, hits: str, at: Column) -> Column:
    """Characters before hit number ``at``, where pieces and hits alternate."""
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x))
    return length(pieces, at + 1) + length(hits, at)


def find_composers(rows: DataFrame, key: str, text: str, hangul: DataFrame, surnames: DataFrame) -> DataFrame:
    """(key, composer, confidence, start, stop) of rows whose text names a known composer; positions are characters, stop exclusive.

    hangul(alias, composer): an alias counts only where no Hangul stands next to it;
    the longest wins, the first among equals (0.95). So the last Hangul run of an alias
    is a whole run of the text, and the two meet by that. Else the first Latin word of
    the text that is a surname(key, composer) as a whole, by its first or by its last
    part (0.9). Rows have keys of their own.
    """
    run = f"[{HANGUL}]+"
    alias = hangul.select(F.col("alias").alias("_alias"), F.col("composer").alias("_composer"), F.regexp_extract("alias", f"({run})[^{HANGUL}]*$", 1).alias("_run"), F.length(F.regexp_extract("alias", f"^(.*?){run}[^{HANGUL}]*$", 1)).alias("_head")).filter("_run <> ''")
    cut = rows.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    runs = cut.filter(F.col("_text").rlike(run)).select("_id", "_text", F.split("_text", run, -1).alias("_pieces"), F.regexp_extract_all("_text", F.lit(f"({run})")).alias("_hits"))
    met = runs.select("_id", "_text", "_pieces", "_hits", F.posexplode("_hits").alias("_at", "_run")).join(alias, "_run")
    start = _prefix("_pieces", "_hits", F.col("_at")) - F.col("_head")
    met = met.select("_id", "_text", "_alias", "_composer", start.alias("start")).filter(F.col("start") >= 0).withColumn("stop", F.col("start") + F.length("_alias"))
    beside = lambda at: F.substring(F.col("_text"), at, F.lit(1)).rlike(f"[{HANGUL}]")
    fits = (F.substring(F.col("_text"), F.col("start") + 1, F.length("_alias")) == F.col("_alias")) & ~((F.col("start") > 0) & beside(F.col("start"))) & ~beside(F.col("stop") + 1)
    longest = F.min(F.struct((F.col("start") - F.col("stop")).alias("n"), "start", "stop", F.col("_composer").alias("composer"))).alias("h")
    korean = met.filter(fits).groupBy("_id").agg(longest)

    words = cut.select("_id", "_text", F.posexplode(F.regexp_extract_all("_text", F.lit(f"({WORD})"))).alias("_at", "_word"))
    lower = F.lower("_word")
    parts = F.array_distinct(F.array(lower, F.element_at(F.split(lower, "[- ]"), 1), F.element_at(F.split(lower, "[- ]"), -1)))
    asked = words.select("_id", "_at", F.posexplode(parts).alias("_part", "_key"))
    first = asked.join(surnames.select(F.col("key").alias("_key"), "composer"), "_key").groupBy("_id").agg(F.min(F.struct("_at", "_part", "_key", "composer")).alias("l"))
    split = cut.select("_id", F.split("_text", WORD, -1).alias("_pieces"), F.regexp_extract_all("_text", F.lit(f"({WORD})")).alias("_hits"))
    placed = first.join(split, "_id").select("_id", "l", (_prefix("_pieces", "_hits", F.col("l._at")) + F.instr(F.lower(F.get("_hits", F.col("l._at"))), F.col("l._key")) - 1).alias("begin"))
    both = korean.join(placed, "_id", "full")
    pick = lambda h, latin: F.when(F.col("h").isNotNull(), F.col(h)).otherwise(latin)
    return both.select(
        F.col("_id").alias(key), pick("h.composer", F.col("l.composer")).alias("composer"), F.when(F.col("h").isNotNull(), 0.95).otherwise(0.9).alias("confidence"),
        pick("h.start", F.col("begin")).cast("int").alias("start"), pick("h.stop", F.col("begin") + F.length("l._key")).cast("int").alias("stop"),
    )
