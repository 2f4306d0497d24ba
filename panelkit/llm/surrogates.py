"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Entities are found by one pattern. Each distinct entity (type and canonical form, so that
spellings of one entity corefer) gets one surrogate over the whole corpus, drawn from a
keyed hash: letters stay letters of their script, digits digits, marks stay where they are, valid
card numbers and IBANs stay valid, names keep their honorific's gender and their script.
Surrogates that collide, with each other or with an entity that occurs, are drawn again until none
does, so different entities stay different; every type grows where its short forms run out.

Names are found behind an honorific, and a name's words are entities by themselves, so "Mr John Smith",
"Mr Smith" and a later bare "Smith" (or "SMITH") of the same text share a surrogate. A word
that the text also writes in lower case is taken for no bare mention. The gender of a bare mention, or
behind an honorific without one (Dr), is that of the text's first honorific for the word that has one. Initials
become letters drawn from the key alone; particles (von, de) stay.

Documents without an entity pass through as they are and are not shuffled. An entity that most documents
hold meets its surrogate salted, and a document is rebuilt by its own number.

Defined cases: null and empty texts stay as they are; a document's other columns, whatever their
names, are untouched; repeated rows get equal texts; whole texts are read whatever their length; an empty table gives no
rows. The key has no default: whoever knows it can draw the surrogates again. It stands in no plan: keys of the types,
derived from it, reach the entities by a join.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Honorifics by gender. Fixed values.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Доктор", "Профессор")
#: Words inside a name that aren't names. Fixed values.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "af", "bin", "al")
_LETTER = r"[\p{L}\p{M}]"
_HONORIFIC = "(?:" + "|".join((*FEMALE, *MALE, *NEUTRAL)) + r")\.?\s"
_PARTICLE = "(?:(?:" + "|".join(PARTICLES) + ") ){0,3}"
#: A name's first word may be all capitals, its later ones not.
_FIRST, _LATER = (rf"(?:\p{{Lu}}['’])?\p{{Lu}}{more}{_LETTER}+" for more in ("", rf"(?={_LETTER}*\p{{Ll}})"))
_NAME = rf"(?<!{_LETTER})(?:{_HONORIFIC})+(?:\p{{Lu}}\. ?)*{_PARTICLE}{_FIRST}(?:[ -](?:\p{{Lu}}\. ?)*{_PARTICLE}{_LATER})*"
_NAME_WORD = rf"\p{{Lu}}['’]\p{{Lu}}{_LETTER}+|\p{{Lu}}{_LETTER}*"
#: What names a credential. Behind a glued "=" any value counts, else one of digits and
#: letters; no calls, no addresses. The whole value is read, whatever its length: runs are possessive,
#: so a place is read once a condition. Fixed values.
_CREDENTIAL = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_MARKS = r"_+/=.~!@#$%^*\-"
_INNER = rf"[\p{{L}}\p{{N}}{_MARKS}]"
_NO_DIGIT, _NO_LETTER, _NEITHER = rf"[\p{{L}}\p{{N}}{_MARKS}&&[^0-9]]", rf"[\p{{N}}{_MARKS}]", rf"[{_MARKS}]"
_LABEL = rf"""{_CREDENTIAL}(?:=["']?(?={_NEITHER}*+[\p{{L}}\p{{N}}])|["']?[ \t]{{0,2}}[=:][ \t]{{0,2}}["']?(?={_NO_DIGIT}*+\d)(?={_NO_LETTER}*+\p{{L}}))"""
_NO_AT = rf"[\p{{L}}\p{{N}}{_MARKS}&&[^@]]"
_ADDRESS = r"@[\p{L}\p{N}-]++\.\p{L}"
#: A value ends in a letter, a digit or one of these marks, not in punctuation.
_END = r"[\p{L}\p{N}_+/=#$%^*-]"
_ASSIGNED = rf"{_LABEL}(?!{_INNER}*+[(\[])(?!{_NO_AT}*+(?:(?!{_ADDRESS})@{_NO_AT}*+)*+@)(?={_INNER}{{5}}[.~!@]*+{_END})(?:[.~!@]*+{_END}++)++"
#: How issued keys begin. Fixed values.
_ISSUER = "(?:AKIA|(?:sk|ghp|gho|xoxb)[-_])"
#: Patterns by type; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?:{_ASSIGNED})|" r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xoxb)[-_][A-Za-z0-9_-]{16,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?(?=[A-Z0-9]*\d)[A-Z0-9]{4}){3,7}(?: ?\d{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": _NAME,
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_LATIN, _ACCENTED, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "áéíóúàèäöüñç", "абвгдежзиклмнопрстуфхцшэюя"


def _between(first: int, last: int) -> str:
    """The letters of a range of code points."""
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha())


#: Letters to draw from, by script: small ones where a script has two cases.
_CASED = {"Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Cyrillic": _CYRILLIC, "Armenian": _between(0x561, 0x586)}
_UNCASED = {
    "Arabic": _between(0x627, 0x64A), "Hebrew": _between(0x5D0, 0x5EA), "Devanagari": _between(0x915, 0x939), "Bengali": _between(0x995, 0x9A8), "Tamil": _between(0xB95, 0xBB9), "Thai": _between(0xE01, 0xE2E),
    "Georgian": _between(0x10D0, 0x10F0), "Hiragana": _between(0x3042, 0x308D), "Katakana": _between(0x30A2, 0x30ED), "Hangul": _between(0xAC00, 0xACFF), "Han": _between(0x4E00, 0x4EFF),
}
#: What invented names are made of, by script: first letters, vowels, consonants, last letters, a woman's ending.
_NAMES = {
    "Latin": ("BDFGKLMNPRSTV", "aeiou", "bdgklmnprstvz", "lmnrst", "a"),
    "Cyrillic": ("БДГКЛМНПРСТВ", "аеиоу", "бдгклмнпрст", "лмнрст", "а"),
    "Greek": ("ΒΓΔΖΚΛΜΝΠΡΣΤΦ", "αεηιου", "βγδζκλμνπρτφ", "ν", "α"),
    "Armenian": ("ԲԳԴԿԼՄՆՊՌՍՏ", "աեիոու", "բգդկլմնպռստ", "նրս", "ա"),
}
_DIGITS = "0123456789"
ROUNDS = 64
#: After so many attempts short forms grow: letters before e-mail addresses and secrets, digits behind numbers.
SHORT_ROUNDS = 8
#: Names gain one more syllable after each so many attempts.
NAME_ROUNDS = 4


#: No entity is without a digit, an @, an = or one of these: most texts are told clean at once.
_STEMS = ("Mr", "Ms", "Miss", "Frau", "Madame", "Mme", "Señor", "Sr", "Госпо", "Herr", "Monsieur", "Dr", "Prof", "Dokt", "Doct", "Докт", "Проф", "sk-", "sk_", "ghp", "gho", "xoxb", "AKIA")


def holds_entity(text: Column) -> Column:
    """Does a text hold an entity? The full pattern runs only where it could match."""
    may = text.rlike("[0-9@=]")
    for stem in _STEMS:
        may = may | F.contains(text, F.lit(stem))
    all_letters = text.rlike("[a-f]{32}|[A-F]{32}")  # a secret may happen to have no digit
    return F.coalesce((may | all_letters) & text.rlike(PATTERN), F.lit(False))


def kind(surface: Column) -> Column:
    """The type of a found entity: the first whose pattern the whole of it matches, else a bare name."""
    out = F.when(surface.rlike(rf"^[\p{{L}}\p{{M}}'’]+$"), F.lit("bare")).otherwise(F.lit("card"))
    for name in reversed(PATTERNS):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def gender(surface: Column) -> Column:
    """f, m, or n where a name's honorifics don't tell."""
    titles = F.regexp_extract(surface, f"^(?:{_HONORIFIC})+", 0)

    def has(words: tuple[str, ...]) -> Column:
        return titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})")

    return F.when(has(FEMALE), "f").when(has(MALE), "m").otherwise("n")


def bare_secret(surface: Column) -> Column:
    """A secret without the name that it is assigned to."""
    return F.regexp_replace(surface, f"^{_LABEL}", "")


def _groups6(surface: Column) -> Column:
    """The eight groups of an IPv6 address, lower case, without leading zeros."""
    halves = F.split(F.lower(surface), "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def canonical(surface: Column, type_: Column, sex: Column) -> Column:
    """What spellings of one entity share. ``surface`` is one word of a name, with its gender."""
    digits = F.regexp_replace(surface, r"\D", "")
    return (
        F.when(type_ == "email", F.lower(surface))
        .when((type_ == "secret") & bare_secret(surface).rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lower(bare_secret(surface)))
        .when(type_ == "secret", bare_secret(surface))
        .when(type_ == "ip", surface)
        .when(type_ == "ip6", F.array_join(_groups6(surface), ":"))
        .when(type_ == "iban", F.regexp_replace(surface, " ", ""))
        .when(type_.isin("name", "initial"), F.concat_ws(" ", sex, F.translate(F.lower(surface), "’", "'")))
        .otherwise(digits)
    )


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), (byte % len(alphabet)).cast("int") + 1, F.lit(1))


def _luhn(digits: Column, start: int) -> Column:
    """Sum of a number's digits from the right, every other one doubled from place ``start`` on."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when((i + start) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def type_keys(spark: SparkSession, key: str) -> DataFrame:
    """(type, type_key): a row a type. The plans that read it show neither the key nor what is derived from it."""
    rows = [(t, hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest()) for t in (*PATTERNS, "initial")]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "type string, type_key string")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's number: letters count from 10 on."""
    figures = F.transform(F.split(F.upper(text), ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return F.aggregate(F.split(F.array_join(figures, ""), ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _stream(type_: Column, canon: Column, attempt: Column, key: Column) -> Column:
    """Keyed hash digits, two for each letter of the canonical form and more, in parts of 64."""
    seed = F.concat_ws("\x01", key, type_, canon, attempt.cast("string"))
    letters = F.when(type_ == "name", 8).otherwise(32)  # a name's words may take more than a byte a letter
    return F.transform(F.sequence(F.lit(0), (F.length(canon) / letters).cast("int")), lambda j: F.sha2(F.concat_ws("\x01", seed, j.cast("string")), 256))


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """Entities (type, canon, attempt) with the surrogate's canonical form at that attempt."""
    type_, canon, stream = F.col("type"), F.col("canon"), F.col("_stream")

    def byte(i: Column) -> Column:
        return F.conv(F.substring(F.get(stream, (i / 32).cast("int")), i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")

    hexes = (type_ == "secret") & canon.rlike("^[0-9a-f]*[a-f][0-9a-f]*$")
    keep = F.when(type_ == "iban", 2).when(type_ == "card", 1).when(type_ == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).otherwise(0)
    mark = F.length(F.regexp_extract(canon, f"^{_ISSUER}", 0))  # what tells whose key it is stays
    keep_from = F.length(canon) - F.length(F.substring_index(canon, ".", -1))

    def shaped(c: Column, i: Column) -> Column:
        b = byte(i)
        alphabet = F.when(c.rlike("[0-9]"), _DIGITS).when(c.rlike("[A-Za-z]"), _LATIN).when(c.rlike(r"\p{IsLatin}"), _ACCENTED)
        for script, letters in (_CASED | _UNCASED).items():
            alphabet = alphabet.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]"), letters)
        # A letter of another script: one of the same sixteen code points, if that is a letter.
        near = F.decode(F.unhex(F.lpad(F.hex(F.ascii(c) - F.ascii(c) % 16 + b % 16), 8, "0")), "UTF-32")
        other = F.when(c.rlike(r"\p{L}") & near.rlike(r"^\p{L}$"), near).otherwise(c)

        def drawn_from(letters: Column) -> Column:
            picked = F.substring(letters, b % F.length(letters) + 1, F.lit(1))
            return F.when(letters.isNull(), other).when(c.rlike(r"\p{Lu}"), F.upper(picked)).otherwise(picked)

        return F.get(F.transform(F.array(alphabet), drawn_from), F.lit(0))  # the alphabet is told once

    # What reads the whole form stays out of the secrets' loop: they may be long.
    split = F.split(canon, "")
    letters = F.array_join(
        F.when(hexes, F.transform(split, lambda c, i: _pick("0123456789abcdef", byte(i))))
        .when(type_ == "secret", F.transform(split, lambda c, i: F.when(i < mark, c).otherwise(shaped(c, i))))
        .when(type_ == "email", F.transform(split, lambda c, i: F.when(i >= keep_from, c).otherwise(shaped(c, i))))
        .otherwise(F.transform(split, lambda c, i: F.when(i < keep, c).otherwise(shaped(c, i)))),
        "",
    )
    shape = F.col("_shape")
    short = F.col("attempt") >= SHORT_ROUNDS
    # Short forms have few surrogates: after some attempts they grow.
    extra = F.sha2(F.array_join(stream, ""), 256)
    long = F.col("attempt") - (SHORT_ROUNDS - 4)
    figures = F.when(short, F.substring(F.translate(extra, "abcdef", "012345"), F.lit(1), long)).otherwise("")
    # Card numbers and IBANs that were valid stay valid.
    head = F.concat(F.substring(shape, F.lit(1), F.length(canon) - 1), figures)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(head, 1), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(canon, 0), F.lit(10)) == 0, F.concat(head, check)).otherwise(F.concat(shape, figures))
    country, account = F.substring(canon, 1, 2), F.concat(F.substring(shape, F.lit(5), F.length(canon)), figures)
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    iban = F.when(valid, F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)).otherwise(F.concat(shape, figures))
    ip = F.concat_ws(".", (byte(F.lit(0)) % 223 + 1).cast("string"), *[byte(F.lit(k)).cast("string") for k in (1, 2, 3)])
    # IPv6: groups that aren't zero; all of them once those run out.
    ip6 = F.array_join(
        F.transform(F.split(canon, ":"), lambda g, i: F.when((g == "0") & ~short, g).otherwise(F.regexp_replace(F.lower(F.concat(*[F.lpad(F.hex(byte(i * 2 + k)), 2, "0") for k in (0, 1)])), "^0+(?=.)", ""))), ":"
    )
    # Names: an invented word for each part between apostrophes, in the script, with an ending for the gender.
    parts = F.split(F.substring(canon, F.lit(3), F.length(canon)), "'")
    final = F.size(parts) - 1
    # A stock of short words runs out: the last part grows with the attempts.
    more = (F.col("attempt") / NAME_ROUNDS).cast("int")

    def syllables(consonants: str, vowels: str) -> Column:
        start = F.size(parts) * 5
        made = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda j: F.concat(_pick(consonants, byte(start + j * 2 - 2)), _pick(vowels, byte(start + j * 2 - 1))))
        return F.when(more > 0, F.array_join(made, "")).otherwise("")

    grown = {script: syllables(consonants, vowels) for script, (_, vowels, consonants, _, _) in _NAMES.items()}

    def word(w: Column, i: Column) -> Column:
        at, last = i * 5, i == final
        female, letter = (F.substring(canon, 1, 1) == "f") & last, (F.length(w) == 1) & ~last

        def of(script: str) -> Column:
            firsts, vowels, consonants, lasts, ending = _NAMES[script]
            first = _pick(firsts, byte(at))
            whole = F.concat(first, _pick(vowels, byte(at + 1)), _pick(consonants, byte(at + 2)), _pick(vowels, byte(at + 3)), F.when(last, grown[script]).otherwise(""), _pick(lasts, byte(at + 4)), F.when(female, ending).otherwise(""))
            return F.when(letter, first).otherwise(whole)

        out = None
        for script in [s for s in _NAMES if s != "Latin"]:
            here = w.rlike(rf"\p{{Is{script}}}")
            out = F.when(here, of(script)) if out is None else out.when(here, of(script))
        return out.otherwise(of("Latin"))

    name = F.concat(F.substring(canon, 1, 2), F.array_join(F.transform(parts, word), "'"))
    made = F.when(type_ == "ip", ip).when(type_ == "ip6", ip6).when(type_ == "name", name).when(type_ == "card", card).when(type_ == "iban", iban).otherwise(shape)
    roomy = F.when(short & type_.isin("email", "secret"), F.concat(F.substring(extra, F.lit(1), long), made)).when(type_.isin("phone", "ssn"), F.concat(made, figures)).otherwise(made)
    keyed = entities.join(F.broadcast(type_keys(entities.sparkSession, key)), "type")  # a row a type
    hashed = keyed.withColumn("_stream", _stream(type_, canon, F.col("attempt"), F.col("type_key")))
    return hashed.withColumn("_shape", letters).select("type", "canon", "attempt", roomy.alias("surrogate"))


def rendered(surface: Column, type_: Column, surrogate: Column) -> Column:
    """A surrogate written the way its entity was: marks, spaces and case; grown ones run on behind."""
    def digit(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substring(surrogate, before, F.lit(1))).otherwise(c)

    def mark(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), " ", ""))
        return F.when(c == " ", c).otherwise(F.substring(surrogate, before, F.lit(1)))

    letters = F.split(surface, "")
    body = F.when(type_ == "secret", bare_secret(surface)).otherwise(surface)
    upper = (body == F.upper(body)) & body.rlike(r"\p{L}")
    label = F.substring(surface, F.lit(1), F.length(surface) - F.length(body))
    rest = F.when(type_ == "iban", F.substring(surrogate, F.length(F.regexp_replace(surface, " ", "")) + 1, F.length(surrogate))).otherwise(F.substring(surrogate, F.length(F.regexp_replace(surface, r"\D", "")) + 1, F.length(surrogate)))
    word = F.substring(surrogate, F.lit(3), F.length(surrogate))
    # IPv6: the run that "::" left out stays out while it is zero.
    groups, halves = F.split(surrogate, ":"), F.split(surface, "::")
    ahead, behind = (F.size(F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")) for i in (0, 1))
    wide = F.transform(F.split(surface, ":"), lambda g, i: F.lpad(F.get(groups, i), F.greatest(F.length(g), F.length(F.get(groups, i))), "0"))
    left_out = F.slice(groups, ahead + 1, F.greatest(F.lit(8) - ahead - behind, F.lit(0)))
    folded = F.concat(F.array_join(F.slice(groups, 1, ahead), ":"), F.lit("::"), F.array_join(F.slice(groups, F.lit(9) - behind, behind), ":"))
    six = F.when(~F.contains(surface, F.lit("::")), F.array_join(wide, ":")).when(F.forall(left_out, lambda g: g == "0"), folded).otherwise(surrogate)
    return (
        F.when(type_.isin("phone", "card", "ssn"), F.concat(F.array_join(F.transform(letters, digit), ""), rest))
        .when(type_ == "iban", F.concat(F.array_join(F.transform(letters, mark), ""), rest))
        .when(type_ == "name", F.when((F.length(surface) > 1) & upper, F.upper(word)).otherwise(word))
        .when(type_.isin("email", "secret"), F.concat(label, F.when(upper, F.upper(surrogate)).otherwise(surrogate)))
        .when(type_ == "ip6", F.when(upper, F.upper(six)).otherwise(six))
        .otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(type, canon, surrogate) for distinct (type, canon), without collisions.

    A round draws for those that clashed in the one before; whoever is settled stays. Raises RuntimeError if
    ``rounds`` attempts leave a clash. Rounds are written tables: each joins what the one before made.
    """
    waiting, done = written(entities.withColumn("attempt", F.lit(0))), None
    taken = entities.select("type", F.col("canon").alias("surrogate"))
    for _ in range(rounds):
        made = written(drawn(waiting, key))
        held = taken if done is None else taken.unionByName(done.select("type", "surrogate"))
        hit = held.join(made.select("type", "surrogate").distinct(), ["type", "surrogate"], "left_semi").distinct().withColumn("held", F.lit(True))
        order = Window.partitionBy("type", "surrogate").orderBy("canon")
        told = made.withColumn("turn", F.row_number().over(order)).join(hit, ["type", "surrogate"], "left")
        told = written(told.select("type", "canon", "surrogate", "attempt", ((F.col("turn") > 1) | F.col("held").isNotNull()).alias("clash")))
        fresh = told.where("not clash").select("type", "canon", "surrogate")
        done = fresh if done is None else written(done.unionByName(fresh))
        waiting = told.where("clash").select("type", "canon", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return done
    raise RuntimeError("surrogates still collide")


def session_key(spark: SparkSession) -> str:
    """The key that ``spark.panelkit.surrogates.secret`` holds, a name whose value Spark redacts; where unset, one drawn for this call alone."""
    return spark.conf.get("spark.panelkit.surrogates.secret", None) or secrets.token_hex(32)


def _words(named: Column) -> Column:
    """(word, gender, surface) of the words of names behind honorifics, as found."""
    return F.flatten(F.transform(named, lambda s: F.transform(F.regexp_extract_all(F.regexp_replace(s, f"^(?:{_HONORIFIC})+", ""), F.lit(_NAME_WORD), F.lit(0)), lambda w: F.struct(F.lower(w).alias("word"), gender(s).alias("gender"), w.alias("surface")))))


def _units(between: Column, spots: Column, words: Column) -> Column:
    """What is replaced, in order, each with the text ahead of it: (lead, surface, type, gender)."""

    def told(w: Column, own: Column) -> Column:
        same = F.filter(words, lambda x: (x["word"] == F.lower(w)) & (x["gender"] != "n"))
        return F.when(own != "n", own).otherwise(F.coalesce(F.get(same, F.lit(0))["gender"], F.lit("n")))

    def unit(lead: Column, s: Column) -> Column:
        titles = F.regexp_extract(s, f"^(?:{_HONORIFIC})+", 0)
        body = F.substring(s, F.length(titles) + 1, F.length(s))
        found, gaps = F.regexp_extract_all(body, F.lit(_NAME_WORD), F.lit(0)), F.split(body, _NAME_WORD, -1)

        def part(w: Column, i: Column) -> Column:
            before = F.concat(F.when(i == 0, F.concat(lead, titles)).otherwise(""), F.get(gaps, i))
            return F.struct(before.alias("lead"), w.alias("surface"), F.when(F.length(w) == 1, "initial").otherwise("name").alias("type"), told(w, gender(s)).alias("gender"))

        whole = F.struct(lead.alias("lead"), s.alias("surface"), kind(s).alias("type"), F.lit("").alias("gender"))
        return F.when(kind(s).isin("name", "bare"), F.transform(found, part)).otherwise(F.array(whole))

    return F.flatten(F.zip_with(F.slice(between, 1, F.size(spots)), spots, unit))


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced; ``count_col`` names an added count of entities."""
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col("text")
    # A document's own columns travel in a struct, by place: no name can clash.
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    packed = docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hit = holds_entity(text)
    dirty = packed.where(hit).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    dirty = dirty.withColumn("words", F.array_distinct(_words(F.filter("found", lambda s: kind(s) == "name"))))
    # Names may stand again without an honorific: a text that has some is read once more, by its own pattern.
    lone = lambda w: F.concat(F.lit(f"(?<!{_LETTER})(?:"), w, F.lit(f")(?!{_LETTER})"))
    bare = F.array_distinct(F.filter(F.transform("words", lambda x: x["surface"]), lambda w: (F.length(w) > 1) & ~F.rlike(text, lone(F.lower(w)))))
    dirty = dirty.withColumn("bare", bare)
    own = F.concat(F.lit(PATTERN + "|"), lone(F.array_join(F.array_union("bare", F.transform("bare", F.upper)), "|")))
    again = F.size("bare") > 0
    dirty = dirty.withColumn("spots", F.when(again, F.regexp_extract_all("text", own, F.lit(0))).otherwise(F.col("found")))
    dirty = dirty.withColumn("between", F.when(again, F.split("text", own, -1)).otherwise(F.split("text", PATTERN, -1)))
    dirty = cut(dirty.select("row", F.monotonically_increasing_id().alias("id"), F.size("spots").alias("n"), _units(F.col("between"), F.col("spots"), F.col("words")).alias("units"), F.element_at("between", -1).alias("tail")))
    seen = dirty.select("id", F.posexplode("units").alias("pos", "u")).select("id", "pos", "u.surface", "u.type", "u.gender")
    seen = cut(seen.withColumn("canon", canonical(F.col("surface"), F.col("type"), F.col("gender"))))
    known = surrogates(seen.where("type <> 'initial'").select("type", "canon").distinct(), key)
    seen = seen.join(F.broadcast(type_keys(docs.sparkSession, key)), "type", "left")  # a row a type
    drawn_letter = F.conv(F.substring(F.sha2(F.concat_ws("\x01", "type_key", "canon"), 256), 1, 4), 16, 10).cast("int")
    letter = _pick(_NAMES["Latin"][0], drawn_letter)
    for script, (firsts, *_) in _NAMES.items():
        letter = F.when(F.col("surface").rlike(rf"\p{{Is{script}}}"), _pick(firsts, drawn_letter)).otherwise(letter)
    told = attach(seen, known, ["type", "canon"], ["id", "pos"], "left")
    told = told.select("id", "pos", F.when(F.col("type") == "initial", letter).otherwise(rendered(F.col("surface"), F.col("type"), F.col("surrogate"))).alias("new"))
    told = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("news"))
    done = dirty.join(told, "id").select("row", "n", F.concat(F.array_join(F.zip_with("units", "news", lambda u, x: F.concat(u["lead"], x["new"])), ""), "tail").alias("text"))
    rest = packed.where(~hit).select("row", F.lit(0).alias("n"), "text")
    place = {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)}
    out = [(place[c] if c in place else text).alias(c) for c in docs.columns]
    return rest.unionByName(done).select(*out, *([F.col("n").alias(count_col)] if count_col else []))
