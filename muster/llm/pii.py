"""Replacement of personal data by keyed surrogates of the same kind, in DataFrame expressions alone.

1. One pass over the texts marks mentions by one pattern and cuts each text at them; the cut texts are written, and all else reads those.
   In a text that names somebody after a title, the words of that name are mentions wherever they stand there, titled or not.
2. An entity is what its mentions share: the letters and digits of a number or address in lower case, or one word of a name. So all
   mentions of a person change alike in all documents, by title, full name, given name or surname.
3. Numbers, addresses and secrets go through a keyed permutation of all strings of their format: each character keeps its class and script,
   so different entities of a format have different surrogates without being compared. Words of names are spelt from a keyed hash in their
   script, ended by the gender of the titles that they are met with, and longer at each attempt.
4. Surrogates that are entities of the corpus themselves, or that two entities share, are drawn again.
5. Each mention is written in its own format: its title, separators and case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Words before a name, by the gender they give.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος", "κ."]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "κυρία"]
NEUTRAL = ["Dr", "Prof"]
_TITLE = "(?:" + "|".join(t.replace(".", "") for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.?"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME, _GAP = r"\p{Lu}[\p{L}'’-]+", r"[ \t\xA0]+"
#: Titles may follow one another, and initials stand before a name or between its parts.
_TITLES, _INITIALS = f"(?:{_TITLE}{_GAP})+", r"(?:\p{Lu}\.[ \t\xA0]*)*"
_HEXES = "[0-9A-Fa-f]{1,4}"
_LABEL = r"(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Kind and pattern, in the order in which they are tried at a place.
KINDS = [
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[\p{L}0-9-]+\.)+\p{L}{2,}"),
    ("secret", rf"(?<![\p{{L}}0-9]){_LABEL}[A-Za-z0-9_/+-]{{8,}}"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEXES}:){{7}}{_HEXES}|(?:{_HEXES}:){{1,6}}(?::{_HEXES}){{1,6}}|::(?:{_HEXES}:){{1,6}}{_HEXES})(?![0-9A-Za-z:])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9.,-])[2-9][0-9]{2}-[0-9]{4}(?![0-9.,-]?[0-9])|(?<![0-9+])\+[1-9](?:[ ./-]?\(?[0-9]\)?){7,14}(?![0-9])|(?<![0-9.,+/-])0[0-9]{1,4}[ /-][0-9]{5,9}(?![0-9]|[.,-][0-9])|(?<![\p{L}0-9.,+/_-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\p{L}0-9_]|[.,/-][0-9])"),
    ("name", rf"(?<![\p{{L}}]){_TITLES}{_INITIALS}{_NAME}(?:{_GAP}{_INITIALS}{_NAME}){{0,2}}"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: Every mention has a digit, an at sign, a label or a title.
HINT = rf"[0-9@]|[0-9A-Fa-f]:|(?i:password|passwd|token|secret|api.?key)|{_TITLE}"
#: What stays in front of a mention.
KEEP = {"secret": rf"^{_LABEL}", "key": "^.{4}", "phone": r"^(?:\+[0-9]{1,3})?", "card": "^.", "iban": "^[A-Z]{2}", "name": f"^{_TITLES}"}
ATTEMPTS = 8
#: Around a mention in a marked text; a private character of the text itself is followed by another.
_PRIVATE, _CUT, _OWN = "\ue000", "\ue000\ue001", "\ue000\ue002"
# Letters that are drawn for one another; a character keeps its row.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"]
HEX = "0123456789abcdef"
# Syllables that surrogate names are built of, and their ends by gender.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "vi"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "да", "де", "до", "за", "ка", "ке", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "но", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "то", "фи"],
    "greek": ["βα", "βε", "γα", "γο", "δα", "δε", "δο", "ζα", "θε", "κα", "κε", "κο", "λα", "λε", "λι", "λο", "μα", "με", "μι", "μο", "να", "νε", "νο", "πα", "πε", "ρα", "ρι", "ρο", "σα", "τα", "τε", "φι"],
}
ENDS = {"latin": {"f": "na", "m": "n", "n": "l"}, "cyrillic": {"f": "на", "m": "н", "n": "ль"}, "greek": {"f": "να", "m": "ς", "n": "λι"}}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).cast("array<string>")


def _number(digest: Column, at: Column | int) -> Column:
    return F.conv(F.substring(digest, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _shifted(c: Column, by: Column, hexadecimal: Column, capital: Column) -> Column:
    """Another character of the row that c is in; letters of no row move among the 64 code points about them, and stay where rows are."""
    low = F.lower(c)

    def within(letters: str, upper: Column) -> Column:
        new = F.substring(F.lit(letters), (F.call_function("instr", F.lit(letters), low) - 1 + by) % len(letters) + 1, F.lit(1))
        return F.when(upper, F.upper(new)).otherwise(new)

    def held(letters: str) -> Column:
        return F.call_function("instr", F.lit(letters), low) > 0

    code = F.ascii(c)
    near = F.decode(F.unhex(F.lpad(F.hex(code - code % 64 + (code % 64 + by) % 64), 4, "0")), "UTF-16BE")
    out = F.when(hexadecimal & held(HEX), within(HEX, capital))
    for letters in ALPHABETS:
        out = out.when(held(letters), within(letters, c != low))
    return out.when(c.rlike(r"^\p{L}$") & (code >= 0x700) & (code < 0xD800), near).otherwise(c)


def permuted(text: Column, tweak: Column, hexadecimal: Column | None = None) -> Column:
    """A keyed permutation of all texts of one format, the tweak being the key.

    The characters at even and at odd places are shifted in turn, by a hash of the others: each round can be undone, so no two texts meet.
    """
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    capital = F.regexp_like(text, F.lit("[A-F]")) & ~F.regexp_like(text, F.lit("[a-f]"))

    def turn(chars, r):
        others = F.array_join(F.filter(chars, lambda _, i: i % 2 != r % 2), "")
        digest = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(chars) / 32).cast("int")), lambda j: F.sha2(F.concat_ws("|", tweak, r.cast("string"), j.cast("string"), others).cast("binary"), 256)), "")
        return _let(digest, lambda d: F.transform(chars, lambda c, i: F.when(i % 2 == r % 2, _shifted(c, _number(d, F.floor(i / 2).cast("int")), hexadecimal, capital)).otherwise(c)).cast("array<string>"))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), _chars(text), turn), "")


def _luhn(digits: Column) -> Column:
    """Digit sum of a card number modulo ten, by its rule."""
    numbers = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10


def _address(text: Column, tweak: Column) -> Column:
    """An IP address, its numbers permuted in the same way as characters."""

    def turn(parts, r):
        digest = F.sha2(F.concat_ws("|", tweak, r.cast("string"), F.array_join(F.filter(parts, lambda _, i: i % 2 != r % 2).cast("array<string>"), ".")).cast("binary"), 256)
        return _let(digest, lambda d: F.transform(parts, lambda x, i: F.when(i % 2 == r % 2, (x + _number(d, i)) % 256).otherwise(x)).cast("array<int>"))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.split(text, r"\.").cast("array<int>"), turn).cast("array<string>"), ".")


def _spelt(key: str, attempt: int, canon: Column, gender: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}:{attempt}:name:"), canon).cast("binary"), 256)

    def name(script: str) -> Column:
        size = min(3 + attempt, 12)
        parts = [F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _number(digest, k) % len(SYLLABLES[script]) + 1) for k in range(size)]
        end = F.when(gender == "f", ENDS[script]["f"]).when(gender == "m", ENDS[script]["m"]).otherwise(ENDS[script]["n"])
        return F.concat(*parts, end)

    out = F.when(F.regexp_like(canon, F.lit(r"\p{IsCyrillic}")), name("cyrillic")).when(F.regexp_like(canon, F.lit(r"\p{IsGreek}")), name("greek"))
    return out.when(F.regexp_like(canon, F.lit(r"\p{IsLatin}")), name("latin")).otherwise(permuted(canon, F.lit(f"{key}:{attempt}:name")))


def _surrogate(key: str, attempt: int) -> Column:
    """The surrogate's canonical form of the row's kind, head, canon and gender."""
    kind, head, canon = F.col("kind"), F.col("lead"), F.col("canon")
    tweak = F.concat_ws("|", F.lit(f"{key}:{attempt}"), kind, head)
    # An address keeps its last label, and its host changes like those of all addresses there; a card keeps whether its digits check.
    local, host = F.regexp_extract(canon, "^(.*)@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
    mail = F.concat(permuted(local, F.concat(tweak, F.lit("|"), host)), F.lit("@"), permuted(host, tweak), F.lit("."), F.substring_index(canon, ".", -1))
    first = permuted(F.left(canon, F.length(canon) - 1), tweak)
    last = (F.lit(10) - _luhn(F.concat(head, first, F.lit("0")))) % 10
    card = F.when(_luhn(F.concat(head, canon)) == 0, F.concat(first, last.cast("string"))).otherwise(permuted(canon, tweak))
    secret = permuted(canon, tweak, F.regexp_like(canon, F.lit("^[0-9A-Fa-f]+$")))
    return F.when(kind == "name", _spelt(key, attempt, canon, F.col("gender"))).when(kind == "ip", _address(canon, tweak)).when(kind == "ipv6", permuted(canon, tweak, F.lit(True))).when(kind == "email", mail).when(kind == "card", card).when(kind == "secret", secret).otherwise(permuted(canon, tweak))


def _drawn(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """kind, lead, canon, surrogate of each of the entities (kind, lead, canon, gender).

    An attempt accepts surrogates that are no entity of the corpus, were not accepted before, and are met once; of several entities with one surrogate that
    of the least canonical form has it. After ATTEMPTS of them a format is so full that its entities keep the first permutation's values, which are one
    another's: still distinct. Words of names go on, for their surrogates grow.
    """
    name, value = ["kind", "lead", "canon"], ["kind", "lead", "surrogate"]
    waiting, accepted, attempt = entities, None, 0
    while True:
        drawn = scratch.write(waiting.withColumn("surrogate", _surrogate(key, attempt)), "drawn")
        free = drawn.join(entities.select("kind", "lead", F.col("canon").alias("surrogate")), value, "left_anti")
        if accepted is not None:
            free = free.join(accepted.select(*value), value, "left_anti")
        won = free.groupBy(*value).agg(F.min("canon").alias("canon")).select(*name, "surrogate")
        accepted = scratch.write(won if accepted is None else accepted.union(won), "accepted")
        waiting, attempt = entities.join(accepted, name, "left_anti"), attempt + 1
        if attempt == ATTEMPTS:
            full = waiting.where("kind != 'name'").withColumn("surrogate", _surrogate(key, 0)).select(*name, "surrogate")
            accepted, waiting = accepted.union(full), waiting.where("kind = 'name'")
        if waiting.isEmpty():
            return accepted


def _kind(mention: Column) -> Column:
    out = None
    for name, pattern in KINDS[:-1]:
        hit = F.regexp_like(mention, F.lit(f"^(?:{pattern})$"))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("name")


def _head(mention: Column, kind: Column) -> Column:
    out = F.lit("")
    for name, pattern in KEEP.items():
        out = F.when(kind == name, F.regexp_extract(mention, pattern, 0)).otherwise(out)
    return out


def _walked(body: Column, new: Column) -> Column:
    """new's letters and digits in the places and case of body's."""
    return F.aggregate(
        _chars(body),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(
            c.rlike(r"^[\p{L}0-9]$"),
            F.struct(F.concat(a["out"], F.when(c != F.lower(c), F.upper(F.substring(new, a["k"] + 1, F.lit(1)))).otherwise(F.substring(new, a["k"] + 1, F.lit(1)))).alias("out"), (a["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )["out"]


def surrogates(scratch: Scratch, mentions: DataFrame, key: str) -> DataFrame:
    """mention, kind and replacement of each distinct mention."""
    known = mentions.select("mention").distinct().select("mention", _kind(F.col("mention")).alias("kind")).withColumn("head", _head(F.col("mention"), F.col("kind")))
    known = scratch.write(known.withColumn("body", F.expr("substring(mention, length(head) + 1)")), "mentions")
    kind, body = F.col("kind"), F.col("body")
    plain = F.regexp_replace(F.lower(body), r"[^\p{L}0-9]", "")
    canon = F.when(kind == "secret", body).when(kind.isin("ip", "email"), F.lower(body)).otherwise(plain)
    others = known.where("kind != 'name'").withColumns({"canon": canon, "lead": F.when(kind == "secret", "").otherwise(F.lower(F.regexp_replace("head", r"[^\p{L}0-9]", "")))})
    # Words of names stand at odd places of what the name is cut into.
    titles = F.split(F.regexp_replace("head", r"\.", ""), r"[\s\xA0]+")

    def among(some: list[str]) -> Column:
        return F.arrays_overlap(titles, F.array(*[F.lit(t.replace(".", "")) for t in some]))

    gender = F.when(among(MALE), "m").when(among(FEMALE), "f")
    cut = F.split(F.regexp_replace(body, r"\p{L}+", f"{_CUT}$0{_CUT}"), _CUT, -1)
    words = known.where("kind = 'name'").select("mention", "head", gender.alias("gender"), F.posexplode(cut).alias("place", "word"))
    is_word = F.col("place") % 2 == 1
    names = words.where(is_word).groupBy(F.lower("word").alias("canon")).agg(F.collect_set("gender").alias("genders"))
    names = names.select(F.lit("name").alias("kind"), F.lit("").alias("lead"), "canon", F.when(F.size("genders") == 1, F.element_at("genders", 1)).otherwise("n").alias("gender"))
    entities = scratch.write(others.select("kind", "lead", "canon", F.lit("n").alias("gender")).distinct().union(names), "entities")
    drawn = scratch.write(_drawn(scratch, entities, key), "surrogates")
    # Formats: an address changes place by place, other numbers walk over their separators, a word of a name has its own case.
    new = F.col("surrogate")
    same = F.array_join(F.zip_with(_chars(body), _chars(new), lambda c, d: F.when(c != F.lower(c), F.upper(d)).otherwise(d)), "")
    shown = F.when(kind.isin("ip", "secret"), new).when(kind == "email", F.when(F.length(body) == F.length(new), same).otherwise(new)).otherwise(_walked(body, new))
    numbers = others.join(drawn, ["kind", "lead", "canon"]).select("mention", "kind", F.concat("head", shown).alias("replacement"))
    spelt = drawn.where("kind = 'name'").select("canon", "surrogate")
    word = F.when(F.length("word") == 1, F.upper(F.left(new, F.lit(1)))).when(F.col("word") == F.upper("word"), F.upper(new)).otherwise(F.concat(F.upper(F.left(new, F.lit(1))), F.expr("substring(surrogate, 2)")))
    said = words.withColumn("canon", F.lower("word")).join(spelt, "canon", "left").select("mention", "head", F.struct("place", F.when(is_word, word).otherwise(F.col("word")).alias("word")).alias("part"))
    people = said.groupBy("mention", "head").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    people = people.select("mention", F.lit("name").alias("kind"), F.concat("head", F.array_join("parts.word", "")).alias("replacement"))
    return scratch.write(numbers.union(people), "replacements")


def _count(text: Column, word: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit(r"(?<!\p{L})"), word, F.lit(r"(?!\p{L})")))


def _named(parts: Column) -> Column:
    """parts cut further, at the words of names that follow a title anywhere in the text, wherever they have their capital.

    A word that stands in lower case there as well, and more than twice as often, is no name: it is what a sentence or a title happened to begin with.
    """
    titled = F.filter(parts, lambda x, i: (i % 2 == 1) & x.rlike(KEEP["name"]))
    tokens = F.array_distinct(F.flatten(F.transform(titled, lambda m: F.regexp_extract_all(F.regexp_replace(m, KEEP["name"], ""), F.lit(r"\p{L}{2,}"), F.lit(0)))))

    def sure(s: Column) -> Column:
        low = F.array_intersect(F.transform(s["tokens"], lambda t: F.lower(t)), F.regexp_extract_all(s["text"], F.lit(r"(?<!\p{L})\p{Ll}{2,}(?!\p{L})"), F.lit(0)))
        often = F.filter(low, lambda t: _count(s["text"], t) > 2 * _count(s["text"], F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))))
        return _let(often, lambda words: F.filter(s["tokens"], lambda t: ~F.array_contains(words, F.lower(t))))

    return F.when(F.size(titled) == 0, parts).otherwise(_let(F.struct(tokens.alias("tokens"), F.array_join(parts, "").alias("text")), lambda s: _let(sure(s), lambda names: _cut_at(parts, names))))


def _cut_at(parts: Column, names: Column) -> Column:
    """Cuts at names. The pattern looks for them by their first letter, so that few are tried at a place however many there are."""
    both = F.array_distinct(F.concat(names, F.transform(names, lambda t: F.upper(t))))
    firsts = F.array_distinct(F.transform(both, lambda t: F.left(t, F.lit(2))))
    by_first = F.transform(firsts, lambda c: F.concat(F.lit("(?="), c, F.lit(")(?:"), F.array_join(F.filter(both, lambda t: F.startswith(t, c)), "|"), F.lit(")")))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(by_first, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(names) == 0, parts).otherwise(_let(pattern, lambda p: F.split(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, p, F.lit(f"{_CUT}$0{_CUT}"))).otherwise(x)), _CUT), _CUT, -1)))


def _whole(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(_OWN)), F.replace(text, F.lit(_OWN), F.lit(_PRIVATE))).otherwise(text)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_entities, kinds, text with its entities replaced.

    Found are e-mail and IP addresses (IPv6 too), phone, card, account and social security numbers, access keys, secrets after a label in any case, and names after
    titles, with initials and of up to three parts, with all else that their words of two letters and more stand for in the same text, in capitals. A name that no title precedes anywhere in a text, and secrets of
    under eight characters, are not found. kinds are the kinds found, sorted and joined by commas. Null texts stay null and
    empty ones empty, without entities; texts of any length are read whole. Repeated rows and ids give a row each; extra columns are not read; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    text = F.col("text").cast("string")
    own = F.when(F.contains(text, F.lit(_PRIVATE)), F.replace(text, F.lit(_PRIVATE), F.lit(_OWN))).otherwise(text)
    parts = F.when(F.regexp_like(text, F.lit(HINT)), F.split(F.regexp_replace(own, PATTERN, f"{_CUT}$0{_CUT}"), _CUT, -1)).otherwise(F.array(own))
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), parts.alias("parts"), F.monotonically_increasing_id().alias("row")), "parts")
    some = scratch.write(rows.where("size(parts) > 1").select("row", "doc_id", _named(F.col("parts")).alias("parts")), "some")
    found = some.select("row", F.posexplode("parts").alias("place", "mention")).where("place % 2 = 1")
    changed = found.join(surrogates(scratch, found, key), "mention")
    lists = scratch.write(changed.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "replacement"))), lambda x: x["replacement"]).alias("new"), F.sort_array(F.collect_set("kind")).alias("kinds")), "lists")
    shown = F.transform("parts", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.get("new", F.floor(i / 2).cast("int"))))
    done = some.join(lists, "row").select("doc_id", F.size("new").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"), _whole(F.array_join(shown, "")).alias("text"))
    plain = rows.where("size(parts) <= 1").select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), _whole(F.col("parts")[0]).alias("text"))
    return plain.union(done)
