"""Types of entities: codes, their parents, and paths of a class tree mapped to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code, display name and parent of each type.
TYPES = {
    0: ("Person", None),
    3: ("Place", None),
    2: ("Building", 3),
    4: ("River", 3),
    5: ("Road", 3),
    9: ("Mountain", 3),
    10: ("Airport", 3),
    17: ("Island", 3),
    18: ("Museum", 3),
    19: ("Bridge", 3),
    25: ("Hospital", 3),
    31: ("Theatre", 3),
    33: ("Library", 3),
    35: ("Monument", 3),
    11: ("Organisation", None),
    1: ("Company", 11),
    7: ("University", 11),
    13: ("Periodical Literature", 11),
    20: ("Airline", 11),
    22: ("Government Agency", 11),
    27: ("Award", 11),
    32: ("Legislature", 11),
    34: ("Law firm", 11),
    36: ("Disease", 11),
    37: ("Event", 11),
    38: ("Other", None),
}
OTHER = 38

# Class paths, most specific class first, of each type.
PATHS = {
    0: ["Person", "Agent"],
    3: ["Place", "Park|Place", "ProtectedArea|Place", "PowerStation|Infrastructure|ArchitecturalStructure|Place", "ShoppingMall|Building|ArchitecturalStructure|Place"],
    1: ["Company|Organisation", "Non-ProfitOrganisation|Organisation"],
    2: ["Building|ArchitecturalStructure|Place", "Hotel|Building|ArchitecturalStructure|Place"],
    4: ["River|Stream|BodyOfWater|NaturalPlace|Place", "Canal|Stream|BodyOfWater|NaturalPlace|Place", "Stream|BodyOfWater|NaturalPlace|Place", "BodyOfWater|NaturalPlace|Place", "Lake|BodyOfWater|NaturalPlace|Place"],
    5: ["Road|RouteOfTransportation|Infrastructure|ArchitecturalStructure|Place"],
    7: ["University|EducationalInstitution|Organisation", "School|EducationalInstitution|Organisation", "College|EducationalInstitution|Organisation"],
    9: ["Mountain|NaturalPlace|Place", "MountainRange|NaturalPlace|Place"],
    10: ["Airport|Infrastructure|ArchitecturalStructure|Place"],
    11: ["Organisation", "PoliticalParty|Organisation", "TradeUnion|Organisation"],
    13: ["Newspaper|PeriodicalLiterature|WrittenWork|Work", "AcademicJournal|PeriodicalLiterature|WrittenWork|Work", "Magazine|PeriodicalLiterature|WrittenWork|Work"],
    17: ["Island|PopulatedPlace|Place"],
    18: ["Museum|Building|ArchitecturalStructure|Place"],
    19: ["Bridge|RouteOfTransportation|Infrastructure|ArchitecturalStructure|Place"],
    20: ["Airline|Company|Organisation"],
    22: ["GovernmentAgency|Organisation"],
    25: ["Hospital|Building|ArchitecturalStructure|Place"],
    27: ["Award"],
    31: ["Theatre|Venue|ArchitecturalStructure|Place"],
    32: ["Legislature|Organisation"],
    33: ["Library|Building|ArchitecturalStructure|Place"],
    34: ["LawFirm|Company|Organisation"],
    35: ["Monument|Place"],
    36: ["Disease|Medicine"],
    37: ["SocietalEvent|Event"],
}


def _lookup(pairs: list[tuple]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def parse_path(path: Column) -> Column:
    """The type code of a class path: that of its longest end that is known, else other.

    A path runs from the class to the root, so leading classes are dropped one by one; a
    last `|Agent` is left out first.  Null is other.
    """
    known = _lookup([(p, code) for code, paths in PATHS.items() for p in paths])
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\|Agent$", ""), r"\|")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: known[F.array_join(F.slice(parts, i, F.size(parts)), "|")])
    return F.coalesce(F.get(F.array_compact(ends), F.lit(0)), F.lit(OTHER))


def coarse(code: Column) -> Column:
    """The parent of a type code, the code itself where it has none, other for null or unknown codes."""
    up = _lookup([(c, c if parent is None else parent) for c, (_, parent) in TYPES.items()])
    return F.coalesce(up[code.cast("int")], F.lit(OTHER))


def type_name(code: Column) -> Column:
    return F.coalesce(_lookup([(c, n) for c, (n, _) in TYPES.items()])[code.cast("int")], F.lit(TYPES[OTHER][0]))


def ancestors(code: Column) -> Column:
    """A code and its parents, nearest first."""
    c = F.when(F.array_contains(F.array(*map(F.lit, TYPES)), code.cast("int")), code.cast("int")).otherwise(F.lit(OTHER))
    return F.array_distinct(F.array(c, coarse(c)))
