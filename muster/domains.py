"""Domains: people of four roles, and places and programmes, as generators of texts and images."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Generator
from .operators import acceptance, sampling
from .plans.dictionary import Dictionary

# Phrases that no text may hold, of lower case; those of force stand in both lists.
FORCE = ["под замком", "не сбежит", "не сможет уйти", "принудительн", "закрытый режим", "закрытом режиме", "против воли", "против его воли", "против её воли", "насильно"]
BANNED_OF_PEOPLE = [
    "ведущий специалист", "ведущий эксперт", "золотые руки", "уникальная методика", "уникальный подход", "не имеет аналогов", "лучший в своей области", "врач от бога", "как искусственный интеллект", "как ии", "вымышлен", "сгенерирован",
    "мест работы", "места работы", "возрастной фокус", "повышений квалификации", "повышения квалификации", "курсов повышения", "научной деятельностью не", *FORCE,
]
BANNED_OF_THINGS = ["уникальн", "лучший", "лучшие условия", "гарантируем", "гарантия", "100%", "стопроцентн", "эффективность доказана", "не имеет аналогов", "европейского уровня", "премиум-класса", "вымышлен", "сгенерирован", *FORCE]


@dataclass(frozen=True)
class Role:
    """A role of people: the least characters of biography, path and quote, and which parameters are spans of years and ages of events."""

    kind: str
    collection: str
    title: str
    lengths: tuple[int, int, int]
    durations: tuple[str, ...]
    moments: tuple[str, ...]


@dataclass(frozen=True)
class Thing:
    """A kind of object: its fields with what each tells and its least characters, and its shots: role, scene, the shot that it builds on."""

    kind: str
    collection: str
    title: str
    fields: tuple[tuple[str, str, int], ...]
    shots: tuple[tuple[str, str, str | None], ...] = field(default=())


# Fixed values of the roles and kinds.
ROLES = {
    r.kind: r
    for r in (
        Role("doctor", "doctors", "Врачи", (180, 150, 25), ("experience_years",), ("graduation_age",)),
        Role("psychologist", "psychologists", "Психологи", (180, 150, 25), ("experience_years", "addiction_years"), ("graduation_age",)),
        Role("consultant", "consultants", "Консультанты", (140, 120, 25), ("experience_years", "clean_years", "use_years", "volunteer_years"), ("use_start_age", "sobriety_age")),
        Role("director", "directors", "Руководители", (180, 150, 25), ("field_years", "leading_years", "clean_years", "before_field_years", "career_gap_years"), ("start_work_age",)),
    )
}
THINGS = {
    x.kind: x
    for x in (
        Thing(
            "place", "places", "Здания",
            (("description", "the house and how people live in it", 220), ("territory", "the grounds and what is around them", 150), ("rooms", "how the rooms are", 100)),
            (("facade", "The whole house and its door, from the path", None), ("room", "A room to live in, from its door", None), ("territory", "The grounds with the same house in view", "facade")),
        ),
        Thing("program", "programs", "Программы", (("title", "a short name", 8), ("description", "how it works and for whom", 220), ("stages", "its stages in order", 160))),
    )
}


def schema_of(fields: list[tuple[str, int]], numbers: list[str] = ()) -> str:
    """The JSON schema of an answer: all fields required, texts with their least characters and some to spare."""
    props = {name: {"type": "string", "description": f"at least {least + 40} characters"} for name, least in fields} | {name: {"type": "integer"} for name in numbers}
    return json.dumps({"type": "object", "additionalProperties": False, "required": list(props), "properties": props})


def person(kind: str, dictionary: Dictionary, names: Callable[[DataFrame], DataFrame] | None = None) -> Generator:
    """People of a role. Of its spans and moments those count that the dictionary has. Without names, people have none that a text must not repeat."""
    role, known = ROLES[kind], {p["key"] for p in dictionary.params}
    fields = dict(zip(("biography", "professional_path", "quote"), role.lengths, strict=True))
    echoes = {f"stated_{p}": p for p in ("age", "experience_years") if p in known}
    policy = acceptance.Policy(
        fields, BANNED_OF_PEOPLE, echoes, [d for d in role.durations if d in known], [m for m in role.moments if m in known], age="age" if "age" in known else None,
        full_name="full_name" if names or "full_name" in known else None, overlap_least=100, unique=["biography", "professional_path"],
    )
    return Generator(role.kind, role.collection, role.title, dictionary, policy, schema_of(list(fields.items()), list(echoes)), [("portrait", f"A portrait for the page of a {kind}", None)], names)


def thing(kind: str, dictionary: Dictionary) -> Generator:
    """Places or programmes."""
    what = THINGS[kind]
    fields = {name: least for name, _, least in what.fields}
    policy = acceptance.Policy(fields, BANNED_OF_THINGS, overlap_least=100)
    return Generator(what.kind, what.collection, what.title, dictionary, policy, schema_of(list(fields.items())), list(what.shots))


def named_from(book: dict, seed: int, gender: dict[str, str], year: int = acceptance.Policy.year) -> Callable[[DataFrame], DataFrame]:
    """Full names from a name book (records.name_book) by gender and year of birth; gender says which of its values is m and which f. Rows without either have none."""

    def names(rows: DataFrame) -> DataFrame:
        sex = F.element_at(F.create_map(*[F.lit(x) for pair in gender.items() for x in pair]), F.col("gender"))
        people = rows.select(F.col("idx").alias("id"), (F.lit(year) - F.col("age")).cast("long").alias("year"), sex.alias("gender")).where("year is not null and gender is not null")
        surnames = [(r["male"], r["female"], float(r["weight"])) for r in book["surnames"].collect()]  # a short list
        return sampling.full_names(people, book["first"], book["patronymics"], surnames, seed).select(F.col("id").alias("idx"), "full_name")

    return names
