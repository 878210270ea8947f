"""Acceptance of model answers: parse, repair, then checks in a fixed order; the first that fails names the kind of the rejection and its detail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OVERLAP = 0.35
#: Kinds of rejection.
KINDS = ("not_structured", "missing_field", "too_short", "forbidden", "fact_drift")


@dataclass
class Policy:
    fields: dict[str, int]  # required fields and their least characters
    banned: list[str] = field(default_factory=list)
    echoes: dict[str, str] = field(default_factory=dict)  # answer field -> parameter
    durations: list[str] = field(default_factory=list)
    moments: list[str] = field(default_factory=list)  # ages of known events
    age: str | None = None
    full_name: str | None = None  # whose name is repaired
    named: str | None = None  # whose surname must occur
    named_in: list[str] = field(default_factory=list)
    year: int = 2026
    overlap: float = OVERLAP
    overlap_least: int = 0  # fields at least so long are held against one another
    unique: list[str] = field(default_factory=list)  # fields that uniqueness looks at; none: those of 100 characters and more
    latin_is_foreign: bool = True


def judged(answers: DataFrame, policy: Policy, answer: str = "answer") -> DataFrame:
    """answers with the parsed and repaired fields, reject_kind and reject_reason, null for accepted rows, and unique_text.

    The order: parsing; repair of names; missing, short; overlap of two fields, a banned phrase, a foreign word; an echo that differs, an unexplained number of
    years, a year out of lifetime; a person who is not named.
    """
    raw = T.unfenced(F.col(answer))
    names = list(policy.fields)
    schema = ", ".join([*(f"`{f}` string" for f in names), *(f"`{e}` string" for e in policy.echoes)])
    parsed = answers.withColumn("_a", F.from_json(raw, schema)).withColumn("_object", F.coalesce(F.startswith(F.get_json_object(raw, "$"), F.lit("{")), F.lit(False)))
    texts = [F.col("_a")[f] for f in names]
    if policy.full_name:
        full = F.col(policy.full_name)
        texts = T.short_after_first([T.repaired_surname(x, full) for x in texts], full)
    wide = parsed.withColumns({f"_{f}": x for f, x in zip(names, texts, strict=True)} | {f"_{e}": F.col("_a")[e] for e in policy.echoes})
    wide = wide.withColumns({f"_w{i}": T.words(F.col(f"_{f}")) for i, f in enumerate(names)})
    wide = wide.withColumns({f"_s{i}": T.shingles(F.col(f"_w{i}")) for i in range(len(names))})
    wide = wide.withColumn("_prose", F.concat_ws(" ", *[F.coalesce(F.col(f"_{f}"), F.lit("")) for f in names]))
    prose = F.col("_prose")
    tests: list[tuple[Column, str, Column]] = [(~F.col("_object"), "not_structured", F.lit("unparsed"))]
    for f, least in policy.fields.items():
        tests += [(F.col(f"_{f}").isNull(), "missing_field", F.lit(f"missing {f}")), (F.char_length(f"_{f}") < least, "too_short", F.lit(f"short {f}"))]
    long = [i for i, f in enumerate(names) if policy.fields[f] >= policy.overlap_least]
    for at, i in enumerate(long):
        for j in long[at + 1 :]:
            a, b = F.col(f"_s{i}"), F.col(f"_s{j}")
            tests.append((F.greatest(T.containment(a, b), T.containment(b, a)) > F.lit(policy.overlap).cast("float"), "forbidden", F.lit(f"overlap {names[i]} {names[j]}")))
    if policy.banned:
        found = T.first_banned(prose, policy.banned)
        tests.append((found.isNotNull(), "forbidden", F.concat(F.lit("banned "), found)))
    if policy.latin_is_foreign:
        tests.append((T.foreign_word(prose).isNotNull(), "forbidden", F.concat(F.lit("foreign "), T.foreign_word(prose))))
    for e, p in policy.echoes.items():
        stated = F.when(F.regexp_like(F.col(f"_{e}"), F.lit("^-?[0-9]{1,18}$")), F.col(f"_{e}")).cast("long")
        tests.append((F.coalesce(stated != F.col(p).cast("long"), F.lit(False)), "fact_drift", F.lit(f"echo {e}")))
    if policy.age:
        age = F.col(policy.age)
        spans = F.array_compact(F.array(*[F.col(d).cast("long") for d in policy.durations])) if policy.durations else F.array().cast("array<bigint>")
        longest = F.coalesce(F.array_max(spans), F.lit(0))
        earliest = F.least(age - longest, *[F.col(m).cast("long") for m in policy.moments]) if policy.moments else age - longest
        wide = wide.withColumn("_t", F.filter(F.split(F.lower(prose), T.SPLIT), lambda x: x != "")).withColumn("_claims", T.year_claims(F.col("_t")))
        tests.append((age.isNotNull() & ~T.explained(F.col("_claims"), age, spans, earliest), "fact_drift", F.lit("unexplained years")))
        tests.append((F.exists(T.calendar_years(prose), lambda y: (y < policy.year - age) | (y > policy.year)), "fact_drift", F.lit("year out of lifetime")))
    if policy.named:
        surname = F.substring_index(F.col(policy.named), " ", 1)
        tests.append((~T.named(surname, [F.col(f"_{f}") for f in policy.named_in or names]), "missing_field", F.concat(F.lit("not named "), F.col(policy.named))))
    failed = [F.coalesce(t, F.lit(False)) for t, _, _ in tests]
    reason = F.coalesce(*[F.when(t, r) for t, (_, _, r) in zip(failed, tests, strict=True)])
    kind = F.coalesce(*[F.when(t, F.lit(k)) for t, (_, k, _) in zip(failed, tests, strict=True)])
    compared = policy.unique or [f for f in names if policy.fields[f] >= 100]
    unique = F.concat_ws(" ", *[F.col(f"_{f}") for f in compared]) if compared else F.lit(None).cast("string")
    kept = [F.col(f"_{f}").alias(f) for f in names]
    return wide.withColumns({"reject_kind": kind, "reject_reason": reason, "unique_text": unique}).select(*answers.columns, *kept, "reject_kind", "reject_reason", "unique_text")


def reject_reason(answers: DataFrame, policy: Policy, answer: str = "answer") -> DataFrame:
    """judged() without kinds and the text for uniqueness."""
    return judged(answers, policy, answer).drop("reject_kind", "unique_text")
