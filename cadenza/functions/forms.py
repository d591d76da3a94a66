"""Canonical musical forms and genres as ordered first-match rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern and form, first match wins, the specific before the generic.
FORMS = (
    ("교향시|symphonic poem|tone poem", "symphonic poem"), (r"교향곡|symphon(y|ie|ia)\b", "symphony"), ("신포니에타|sinfoniett", "sinfonietta"), ("신포니아|sinfonia", "sinfonia"),
    (r"피아노\s?협주곡|piano concerto|klavierkonzert", "piano concerto"), (r"두\s?대의\s?피아노|two pianos|2\s?pianos", "concerto for two pianos"), (r"플루트\s?협주곡|flute concerto", "flute concerto"),
    (r"클라리넷\s?협주곡|clarinet concerto", "clarinet concerto"), (r"오보에\s?협주곡|oboe concerto", "oboe concerto"), (r"바순\s?협주곡|파곳\s?협주곡|bassoon concerto", "bassoon concerto"),
    (r"호른\s?협주곡|horn concerto", "horn concerto"), (r"트럼펫\s?협주곡|trumpet concerto", "trumpet concerto"), (r"기타\s?협주곡|guitar concerto", "guitar concerto"), (r"하프\s?협주곡|harp concerto", "harp concerto"),
    (r"비올라\s?협주곡|viola concerto", "viola concerto"), (r"바이올린\s?협주곡|violin concerto", "violin concerto"), (r"첼로\s?협주곡|cello concerto", "cello concerto"), ("협주곡|concerto|concerti", "concerto"),
    (r"현악\s?(사중주|4중주)|string quartet", "string quartet"), (r"피아노\s?(삼중주|3중주)|piano trio", "piano trio"), (r"피아노\s?(오중주|5중주)|piano quintet", "piano quintet"),
    (r"피아노\s?(사중주|4중주)|piano quartet", "piano quartet"), (r"현악\s?(오중주|5중주)|string quintet", "string quintet"), ("(사중주|4중주)|quartet", "quartet"), ("(오중주|5중주)|quintet", "quintet"),
    (r"현악\s?(삼중주|3중주)|string trio", "string trio"), (r"클라리넷\s?(삼중주|3중주)|clarinet trio", "clarinet trio"), ("(삼중주|3중주)|trio", "trio"), ("(육중주|6중주)|sextet", "sextet"), ("(팔중주|8중주)|octet", "octet"),
    (r"바이올린\s?소나타|violin sonata|sonata for violin|violinsonate", "violin sonata"), (r"첼로\s?소나타|cello sonata|sonata for (?:violon)?cello", "cello sonata"), (r"비올라\s?소나타|viola sonata", "viola sonata"),
    (r"플루트\s?소나타|flute sonata", "flute sonata"), (r"클라리넷\s?소나타|clarinet sonata", "clarinet sonata"), (r"오보에\s?소나타|oboe sonata", "oboe sonata"), (r"바순\s?소나타|파곳\s?소나타|bassoon sonata", "bassoon sonata"),
    (r"호른\s?소나타|horn sonata", "horn sonata"), (r"트럼펫\s?소나타|trumpet sonata", "trumpet sonata"), (r"피아노\s?소나타|piano sonata|klaviersonate", "piano sonata"), (r"오르간\s?소나타|organ sonata", "organ sonata"),
    ("소나타|sonat[ae]", "sonata"), ("전주곡|prelude", "prelude"), ("녹턴|야상곡|nocturne", "nocturne"), ("연습곡|에튀드|에튜드|[eé]tude|study|studies", "etude"), ("변주곡|variation", "variations"),
    ("모음곡|조곡|suite", "suite"), ("서곡|overture|ouvert", "overture"), ("환상곡|판타지|fantas", "fantasy"), ("즉흥곡|impromptu", "impromptu"), ("마주르카|mazurka", "mazurka"), ("폴로네즈|폴로네이즈|polonaise", "polonaise"),
    ("왈츠|원무곡|waltz|valse|walzer", "waltz"), ("발라드|ballade", "ballade"), ("랩소디|광시곡|rhapsod", "rhapsody"), ("레퀴엠|requiem", "requiem"), (r"미사|miss[ae]\b|mass\b", "mass"), ("칸타타|cantata", "cantata"),
    ("오라토리오|oratorio", "oratorio"), ("세레나데|serenade", "serenade"), ("디베르티멘토|divertimento", "divertimento"), ("론도|rondo", "rondo"), ("스케르초|scherzo", "scherzo"), ("카프리스|카프리치오|capric", "caprice"),
    ("토카타|toccata", "toccata"), ("파르티타|partita", "partita"), ("푸가|fugue", "fugue"), ("모테트|motet", "motet"), ("샤콘|chaconne", "chaconne"), ("파사칼리아|passacaglia", "passacaglia"), ("간주곡|intermezzo", "intermezzo"),
    ("자장가|berceuse|lullaby", "berceuse"), (r"행진곡|march\b|marsch", "march"), ("아리아|aria", "aria"), ("가곡|lied", "lied"),
)


def first_match(s: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first pattern found, ignoring case."""
    chain = None
    for pattern, value in rules:
        hit = s.rlike(f"(?iU){pattern}")
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def canon_form(s: Column) -> Column:
    return first_match(s, FORMS)


def mapped(key: Column, table: Mapping[str, str]) -> Column:
    """Exact map of a short table; null where the key is absent."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_confidence(base: Column, composers: Column, opuses: Column, works: Column) -> Column:
    """Base by how the block was found, and shares of works with composer and catalogue number; two decimals."""
    raw = base + 0.3 * F.try_divide(composers, works) + 0.25 * F.try_divide(opuses, works)
    return F.when(works > 0, F.round(raw, 2)).otherwise(0.0)
