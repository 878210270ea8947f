"""Words, shingles and claims of texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to tell texts apart. A parameter of all that uses them.
STOP = ["и", "в", "во", "на", "с", "со", "к", "ко", "по", "о", "об", "от", "до", "из", "у", "за", "а", "но", "что", "как", "это", "он", "она", "его", "её", "ее", "их", "он", "же", "ли", "не", "ни", "то", "так", "для", "при", "под", "над", "без"]
SPLIT = r"[^\p{L}\p{N}]+"
# Number words and their values, the words that make a number one of years, and those that make it an age.
NUMBER_WORDS = {
    "один": 1, "одного": 1, "год": 1,
    "два": 2, "двух": 2,
    "три": 3, "трёх": 3, "трех": 3,
    "четыре": 4, "четырёх": 4, "четырех": 4,
    "пять": 5, "пяти": 5,
    "шесть": 6, "шести": 6,
    "семь": 7, "семи": 7,
    "восемь": 8, "восьми": 8,
    "девять": 9, "девяти": 9,
    "десять": 10, "десяти": 10,
    "одиннадцать": 11, "одиннадцати": 11,
    "двенадцать": 12, "двенадцати": 12,
    "тринадцать": 13, "тринадцати": 13,
    "четырнадцать": 14, "четырнадцати": 14,
    "пятнадцать": 15, "пятнадцати": 15,
    "шестнадцать": 16, "шестнадцати": 16,
    "семнадцать": 17, "семнадцати": 17,
    "восемнадцать": 18, "восемнадцати": 18,
    "девятнадцать": 19, "девятнадцати": 19,
    "двадцать": 20, "двадцати": 20, "двадцатью": 20,
    "тридцать": 30, "тридцати": 30,
    "сорок": 40, "сорока": 40,
    "пятьдесят": 50, "пятидесяти": 50,
}
YEAR_WORDS = ["лет", "года", "годами", "год", "летний", "летним"]
AT_WORDS = ["в", "во", "с", "со"]
# The same for English texts.
NUMBER_WORDS |= {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}
YEAR_WORDS += ["year", "years"]
AT_WORDS += ["at"]


def words(text: Column, stop: list[str] | None = None) -> Column:
    """Lower case, ё as е, split at whatever is no letter or digit, without the stop words."""
    parts = F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), SPLIT)
    return F.filter(parts, lambda w: (w != "") & ~w.isin(STOP if stop is None else stop))


def shingles(w: Column, n: int = 3) -> Column:
    """Distinct runs of n words, as texts; of fewer words one run of all, of none none. w should be a plain column: it is used several times."""
    runs = F.transform(F.arrays_zip(*[F.slice(w, k + 1, F.greatest(F.size(w) - (n - 1), F.lit(0))) for k in range(n)]), lambda r: F.concat_ws(" ", *[r[str(k)] for k in range(n)]))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, in single precision; of two empty ones 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both).cast("float"), F.lit(0.0).cast("float"))


def containment(a: Column, b: Column) -> Column:
    """How much of a is in b; of an empty a 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)).cast("float"), F.lit(0.0).cast("float"))


def calendar_years(text: Column) -> Column:
    """Sorted distinct years 1900 to 2100 that stand alone as four digits."""
    found = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda t: F.regexp_like(t, F.lit("^[0-9]{4}$"))), lambda t: t.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(1900, 2100))))


def year_claims(tokens: Column) -> Column:
    """Claims (n, at_age) of a token array: numbers with a year word among the next three tokens.

    Digits of 1900 to 2100 are calendar years, not claims. Tens of 20 or more take a following word below ten with them. at_age: a word like "at" stands before. Equal
    neighbours are one claim. tokens should be a plain column.
    """
    value = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    pad = F.concat(tokens, F.array(*[F.lit("")] * 3))
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), tokens).alias("before"), tokens.alias("now"), F.slice(pad, 2, F.size(tokens)).alias("x"), F.slice(pad, 3, F.size(tokens)).alias("y"), F.slice(F.concat(pad, F.array(F.lit(""))), 4, F.size(tokens)).alias("z"))

    def step(a, t):
        number, word, after = t["number"], t["word"], t["after"]
        joins = (word >= 20) & (after < 10) & number.isNull()
        n = F.coalesce(number, F.when(F.coalesce(joins, F.lit(False)), word + after).otherwise(word))
        ok = F.coalesce(~a["skip"] & n.isNotNull() & t["marked"] & ~F.coalesce(number.between(1900, 2100), F.lit(False)), F.lit(False))
        claim = F.struct(n.cast("int").alias("n"), t["at_age"].alias("at_age"))
        same = F.coalesce(F.try_element_at(a["out"], F.lit(-1)) == claim, F.lit(False))
        return F.struct(F.when(ok & ~same, F.concat(a["out"], F.array(claim))).otherwise(a["out"]).alias("out"), F.coalesce(joins & ok, F.lit(False)).alias("skip"))

    start = F.struct(F.array().cast("array<struct<n:int,at_age:boolean>>").alias("out"), F.lit(False).alias("skip"))
    named = F.transform(F.slice(zipped, 1, F.greatest(F.size(tokens), F.lit(1))), lambda t: F.struct(*[F.coalesce(t[k], F.lit("")).alias(k) for k in ("before", "now", "x", "y", "z")]))

    def told(t):
        """What the fold looks at several times, looked up once a token: a map's entries are gone through one by one."""
        number = F.when(F.regexp_like(t["now"], F.lit("^[0-9]{1,9}$")), t["now"].cast("int"))
        marked = t["x"].isin(YEAR_WORDS) | t["y"].isin(YEAR_WORDS) | t["z"].isin(YEAR_WORDS)
        word, after = (F.when(marked, F.try_element_at(value, t[k])) for k in ("now", "x"))
        return F.struct(number.alias("number"), word.alias("word"), after.alias("after"), marked.alias("marked"), t["before"].isin(AT_WORDS).alias("at_age"))

    return F.aggregate(F.transform(named, told), start, step)["out"]


def claimed_years(claims: Column) -> Column:
    """The numbers of claims, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(claims, lambda c: c["n"])))


def explained(claims: Column, age: Column, durations: Column, earliest: Column | None = None) -> Column:
    """Whether each claim n is 0 < n <= a duration, or age - longest <= n <= age, or, after "at", earliest <= n <= age."""
    longest = F.coalesce(F.array_max(durations), F.lit(0))
    since = age - longest if earliest is None else earliest
    return F.forall(claims, lambda c: ((c["n"] > 0) & (c["n"] <= longest)) | c["n"].between(age - longest, age) | (c["at_age"] & c["n"].between(since, age)))


def first_banned(text: Column, phrases: list[str]) -> Column:
    """The first phrase of the list, in the list's order, that the text holds in lower case."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


def foreign_word(text: Column) -> Column:
    """The first word of three or more letters, all ASCII, between characters that are no letters or digits."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^\p{L}\p{N}])([A-Za-z]{3,})(?![\p{L}\p{N}])", 1), F.lit(""))


def surname_root(surname: Column) -> Column:
    """One form for both genders."""
    return F.regexp_replace(F.regexp_replace(F.lower(surname), "ая$", "ий"), "а$", "")


def grouped_thousands(n: Column, gap: str = " ") -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(gap))


def escaped(text: Column) -> Column:
    """For HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_key(key: Column) -> Column:
    """For a file's name."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_.-]", "_")


def unfenced(text: Column) -> Column:
    """What stands between code fences, if any."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def short_after_first(fields: list[Column], full: Column) -> list[Column]:
    """Texts in order with the full name at its first place in the first text that has it, and without the surname at all later ones."""
    polite = F.regexp_extract(full, r"^\S+\s+(.*)$", 1)
    usable = F.coalesce((full != "") & (polite != ""), F.lit(False))
    out, seen = [], F.lit(False)
    for text in fields:
        at = F.instr(text, full)
        first = F.concat(F.substr(text, F.lit(1), at - 1), full, F.replace(F.substr(text, at + F.length(full)), full, polite))
        out.append(F.when(~usable | F.coalesce(at == 0, F.lit(True)), text).when(seen, F.replace(text, full, polite)).otherwise(first))
        seen = seen | F.coalesce(at > 0, F.lit(False))
    return out


# Endings of a surname's cases, by whether it ends in "а", and how words of a father's name end.
FEMALE_CASES, MALE_CASES = ["ой", "у", "ою"], ["а", "у", "ым", "е", "ом"]
FATHERLY = "(вич|вна|ична|ичем|ича|вной|вну|вне|ичу)$"


def surname_forms(surname: Column) -> Column:
    """A surname and its cases."""
    stem = F.regexp_replace(surname, "а$", "")
    female = F.array(surname, *[F.concat(stem, F.lit(e)) for e in FEMALE_CASES])
    return F.when(F.endswith(surname, F.lit("а")), female).otherwise(F.array(surname, *[F.concat(surname, F.lit(e)) for e in MALE_CASES]))


def repaired_surname(text: Column, full: Column) -> Column:
    """text with words that are nearly the full name's surname made it: four or more letters, its first three, two edits at most from one of its forms and none of
    them. Words like a father's name, and those that begin like the given names, are left."""
    surname = F.substring_index(full, " ", 1)
    own = F.transform(F.slice(F.split(full, r"\s+"), 2, 9), lambda w: F.left(w, F.lit(5)))

    def mend(token):
        word = F.regexp_replace(token, r"[^\p{L}-]", "")
        forms = surname_forms(surname)
        odd = (F.char_length(word) >= 4) & F.startswith(word, F.left(surname, F.lit(3))) & ~F.array_contains(forms, word) & ~F.regexp_like(word, F.lit(FATHERLY))
        odd = odd & ~F.exists(own, lambda o: F.startswith(word, o)) & F.exists(forms, lambda f: F.levenshtein(f, word) <= 2)
        at = F.instr(token, word)
        return F.when(odd & (at > 0), F.concat(F.substr(token, F.lit(1), at - 1), surname, F.substr(token, at + F.length(word)))).otherwise(token)

    return F.when(F.coalesce(F.char_length(surname) >= 4, F.lit(False)), F.array_join(F.transform(F.split(text, " "), mend), " ")).otherwise(text)


def wrapped(text: Column, width: int) -> Column:
    """Lines of whole words of at most so many characters, a longer word alone."""
    def put(a, w):
        last = F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
        fits = (last != "") & (F.char_length(last) + F.char_length(w) < width)
        return F.when(fits, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(a, F.array(w)))

    return F.aggregate(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"), put)


def named(surname: Column, texts: list[Column]) -> Column:
    """Whether one of the texts holds the surname; an empty one is held by all."""
    return F.coalesce(surname == "", F.lit(True)) | F.greatest(*[F.coalesce(F.contains(t, surname), F.lit(False)) for t in texts])


def name_fault(name: Column, banned: list[str], most: int = 3) -> Column:
    """What is wrong with a name for a place: empty, too many words, a banned part, a digit; else null."""
    words_ = F.size(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != ""))
    part = first_banned(name, banned)
    return F.when(words_ == 0, "empty").when(words_ > most, "long").when(part.isNotNull(), F.concat(F.lit("banned "), part)).when(F.regexp_like(name, F.lit("[0-9]")), "digits")
