"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities (e-mail and IP addresses, phone, card, account and social security numbers,
names after a title) are found by one regular expression. What counts as the same entity
is its key: the address in lower case, the digits of a number without country code, the
letters and digits of an account, the word of a name in lower case. A keyed hash of the
key gives the surrogate's key, and the surrogate is that key in the format of the place
at hand: its blanks, dots, brackets, capitals, title and country code stay. So notations
of one entity stay one entity, everywhere. An address keeps its public suffix, an IP
address stays valid, a card number keeps the validity of its check digit and an account
gets valid check digits. Each word of a name becomes an invented name of the same script;
the first of several is a given name of the title's gender, Cyrillic surnames keep the
ending of their gender, and a name found after a title is also replaced where it stands
alone with a capital in the same text.

Collision checks run over all distinct keys: a surrogate's key must not be shared by two
entities nor be anyone's real one. Losers draw again from the next round's hash, and
after ROUNDS rounds with longer surrogates, until none is left. Documents then rewrite
their own text from the hash in place; only documents with an entity of a later round
look the surrogate up in a join.

The key of the hash comes from the caller, or from the setting KEY_SETTING; without
either one is drawn for the session, and surrogates then differ from session to session.

Null text stays null with no entities. Texts without entities stay as they are, and any
length is read whole. Repeated rows are rewritten alike. Without a match the entity table
is empty and nothing joins; an empty table gives no rows. Columns other than doc_id and
text play no part, whatever their names.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, discard, documents, materialize

KEY_SETTING = "parallaxis.pii.key"
ROUNDS = 8

# Titles by gender, country calling codes of one and two digits, second-level labels of public suffixes.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα")
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
SECOND_LEVEL = "ac co com edu gob gov mil ne net nom or org sch"
#: Given names by script and gender, and syllables of invented names.
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Pablo Quinn Robin Simon Tomas",
    ("latin", "female"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nadia Olivia Paula Rosa Sara Tina Vera",
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман",
    ("cyrillic", "female"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лариса Мария Нина Ольга Полина Раиса",
    ("greek", "male"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος",
    ("greek", "female"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {
    "latin": "ba be bo da do el fa fe ga go ha he ka ke ko la le lo ma me mi mo na ne no pa pe po ra re ri ro sa se so ta te ti to va ve vo wa we",
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе зо ка ке ко ла ле ло ма ме ми мо на не но па пе по ра ре ри ро са се со та те ти то",
    "greek": "βα βε βο γα γο δα δε δο ζα ζε κα κε κο λα λε λο μα με μι μο να νε νο πα πε πο ρα ρε ρι ρο σα σε σο τα τε τι το φα φε φο",
}

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=lambda t: (-len(t), t)))
_TITLE_STARTS = "".join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES}))
#: Letters, marks and digits of all scripts, for use in a class. Properties are asked beyond ASCII only, which is faster.
_LETTERS = r"A-Za-z[[^\x00-\x7F]&&[\p{L}]]"
_LETTERS_DIGITS = r"A-Za-z0-9[[^\x00-\x7F]&&[\p{L}\p{N}]]"
_INNER = r"A-Za-z0-9._%+\-[[^\x00-\x7F]&&[\p{L}\p{M}\p{N}]]"
_END = r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"

_MAIL = rf"(?<![{_INNER}])[_%+\-{_LETTERS_DIGITS}][{_INNER}]{{0,63}}+@(?:[\-{_LETTERS_DIGITS}]{{1,63}}\.){{1,8}}[{_LETTERS}]{{2,24}}"
#: Letters may stand right before it.
_IPV4 = rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
#: A capital and letters, with parts joined by hyphens and apostrophes; or a script without capitals.
_NAME = r"\p{Lu}[\p{L}\p{M}]{0,30}+(?:['’\-]\p{Lu}?[\p{L}\p{M}]{1,30}+)*"
_TITLED = rf"(?<![\p{{L}}\p{{N}}_])(?:{_TITLES})\.? {_NAME}(?: (?!(?:{_TITLES})[. ]){_NAME}){{0,2}}"
#: Alternatives in order of preference at one position. Each group begins with what its members share, so
#: that most positions of a text are done after one look at a character.
_NUMBERS = "|".join(
    (
        rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
        rf"[0-9]{{3}}[.\-][0-9]{{3}}[.\-][0-9]{{4}}{_END}",
        rf"3[47][0-9]{{2}}[ \-]?[0-9]{{6}}[ \-]?[0-9]{{5}}{_END}",
        rf"[0-9]{{4}}(?:[ \-]?[0-9]{{4}}){{2}}[ \-]?[0-9]{{1,7}}{_END}",
    )
)
_PLUS = "|".join(
    (
        r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])",
        r"\+[0-9]{8,15}(?![0-9])",
        r"\+[0-9]{1,3}[ .\-][0-9]{1,4}[ .\-](?:[0-9]{5,8}|[0-9]{2,4}(?:[ .\-][0-9]{2,4}){1,4})(?![0-9])",
        r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-][0-9]{2,4}){1,4}(?![0-9])",
    )
)
PATTERN = "|".join(
    (
        _MAIL,
        rf"(?=[0-9A-Fa-f]{{1,4}}:)(?<![0-9A-Fa-f:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Fa-f:])",
        _IPV4,
        rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_])(?:{_NUMBERS})",
        rf"(?=\+[0-9])(?<![\p{{L}}\p{{N}}_+])(?:{_PLUS})",
        rf"(?=\([0-9])(?<![\p{{L}}\p{{N}}_])\([0-9]{{3}}\)[ .\-]?[0-9]{{3}}[ .\-][0-9]{{4}}{_END}",
        rf"(?=[A-Z]{{2}}[0-9])(?<![\p{{L}}\p{{N}}_])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
        rf"(?=[{_TITLE_STARTS}]){_TITLED}",
    )
)
_HEAD = rf"^(?:{_TITLES})\.? "
#: Country code at the start of a phone number: of one or two digits from the list, else of three.
_CODE = rf"^\+(?:{SHORT_CODES.replace(' ', '|')}|[0-9]{{3}})"


def kind_of(e: Column) -> Column:
    """Of an entity as it stands in a text, or of a single word of a name."""
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(F.contains(e, F.lit(":")), "ipv6")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(r"^[+(]|^[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}$"), "phone")
        .when(e.rlike(r"^[0-9]"), "card")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}"), "account")
        .otherwise("name")
    )


def _bare(e: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(e, r"[^\p{L}\p{M}\p{N}]", "")


def key_of(e: Column) -> Column:
    """What all notations of an entity share, behind its kind; of names, of one word."""
    kind, code = kind_of(e), F.regexp_replace(e, _CODE, "")
    # a trunk zero goes with the country code
    national = F.when(e.startswith("+"), F.regexp_replace(_bare(code), "^0", "")).otherwise(_bare(e))
    plain = (
        F.when(kind == "phone", national)
        .when(kind.isin("ssn", "card", "account"), _bare(e))
        .otherwise(F.lower(e))
    )
    return F.concat_ws("|", kind, plain)


def _plain(key: Column) -> Column:
    return F.substr(key, F.instr(key, "|") + 1)


def _kind(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def _byte(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 of a hexadecimal digest of 128 characters, by position."""
    return F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _digest(of: Column, round_: int, secret: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), F.lit(str(round_)), of), 512)


def _swap(text: Column, digest: Column) -> Column:
    """Each digit and small letter replaced by another of its kind; capitals, too."""

    def one(c: Column, i: Column) -> Column:
        h = _byte(digest, i)

        def within(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + h % size)

        def beyond(alphabet: str) -> Column:
            return F.substr(F.lit(alphabet), h % len(alphabet) + 1, F.lit(1))

        return (
            F.when(c.rlike("[0-9]"), within("0", 10))
            .when(c.rlike("[a-z]"), within("a", 26))
            .when(c.rlike("[A-Z]"), within("A", 26))
            .when(c.rlike("[а-я]"), beyond("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike("[α-ω]"), beyond("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{Ll}"), beyond("àáâãäåçèéêëìíîïñòóôõöùúûüý"))
            .when(c.rlike(r"\p{L}"), beyond("人山水火木金土日月天地上下左右大小中口目"))
            .when(c.rlike(r"\p{N}"), within("0", 10))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(number: Column) -> Column:
    """Check sum modulo 10 of the digits of a number."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _check_digits(country: Column, rest: Column) -> Column:
    """The two digits that make an account number valid: 98 less the number, letters counted from 10, modulo 97."""

    def add(left: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (left * 10 + c.cast("int")) % 97).otherwise((left * 100 + letter) % 97)

    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), add)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _pick(names: str, h: Column) -> Column:
    words = names.split(" ")
    return F.get(F.array(*map(F.lit, words)), h % len(words))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _invented(word: Column, digest: Column) -> Column:
    """A name of syllables in small letters; Cyrillic surnames keep the ending of their gender."""
    script = _script(word)

    def of(name: str) -> Column:
        some = F.concat(*(_pick(SYLLABLES[name], _byte(digest, F.lit(i))) for i in range(3)))
        return F.when(_byte(digest, F.lit(7)) % 3 == 0, some).otherwise(F.concat(some, _pick(SYLLABLES[name], _byte(digest, F.lit(8)))))

    ending = (
        F.when(word.rlike("(ова|ева|ёва|ина|ая)$"), "ова").when(word.rlike("(ов|ев|ёв|ин|ий)$"), "ов").otherwise("н")
    )
    latin = _pick("n r s l t nd rs ng", _byte(digest, F.lit(3)))
    return (
        F.when(script == "cyrillic", F.concat(of("cyrillic"), F.lit("р"), ending))
        .when(script == "greek", F.concat(of("greek"), F.lit("ς")))
        .otherwise(F.concat(of("latin"), latin))
    )


def _given(word: Column, digest: Column, gender: str) -> Column:
    """A given name of a gender and script; many people share one, so the word's own syllable follows."""
    script, h = _script(word), _byte(digest, F.lit(4))

    def of(name: str) -> Column:
        joined = F.concat(_pick(GIVEN[name, gender], h), F.lit("-"), F.initcap(_pick(SYLLABLES[name], _byte(digest, F.lit(5)))), _pick(SYLLABLES[name], _byte(digest, F.lit(6))))
        return F.lower(joined)

    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def surrogate_key(key: Column, round_: int, secret: str) -> Column:
    """The key of an entity's surrogate in a round; rounds from ROUNDS on add hash digits."""
    return bound(F.struct(key.alias("key"), _digest(key, round_, secret).alias("digest")), lambda x: _surrogate(x["key"], x["digest"], round_))


def _surrogate(key: Column, digest: Column, round_: int) -> Column:
    kind, plain = _kind(key), _plain(key)
    # the last label stays, and the one before if it belongs to the suffix
    suffix = F.regexp_extract(plain, rf"((?:\.(?:{SECOND_LEVEL.replace(' ', '|')}))?\.[^.@]+)$", 1)
    mail = F.concat(_swap(F.substr(plain, F.lit(1), F.length(plain) - F.length(suffix)), digest), suffix)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(digest, i) % 254 + 1).cast("string"))
    groups = F.transform(F.split(plain, ":"), lambda g, i: F.when(g == "", g).otherwise(F.lower(F.hex(_byte(digest, i)))))

    def card(swapped: Column) -> Column:
        body = F.substr(swapped, F.lit(1), F.length(swapped) - 1)
        checked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda x: _luhn(x) == 0)
        return F.when(_luhn(plain) == 0, F.get(checked, 0)).otherwise(swapped)

    def account(rest: Column) -> Column:
        country = F.substr(plain, F.lit(1), F.lit(2))
        return F.concat(country, _check_digits(country, rest), rest)

    made = (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "ipv6", F.array_join(groups, ":"))
        .when(kind == "card", bound(_swap(plain, digest), card))
        .when(kind == "account", bound(_swap(F.substr(plain, F.lit(5)), digest), account))
        .when(kind == "name", _invented(plain, digest))
        .when(kind == "given-male", _given(plain, digest, "male"))
        .when(kind == "given-female", _given(plain, digest, "female"))
        .otherwise(_swap(plain, digest))
    )
    if round_ >= ROUNDS:
        made = F.concat(made, F.regexp_replace(F.substr(digest, F.lit(1), F.lit(8)), "[a-f]", "7"))
    return F.concat_ws("|", kind, made)


def _filled(e: Column, values: Column, from_right: bool = False) -> Column:
    """e with its letters and digits replaced by those of values, in order; what values have beyond stays at the end.

    from_right: the last letter or digit of e takes the last of values, and what e has before them stays.
    """
    slots = F.length(_bare(e))
    more = F.greatest(F.length(values) - slots, F.lit(0)) if not from_right else F.lit(0)
    shift = F.length(values) - slots if from_right else F.lit(0)

    def one(c: Column, i: Column) -> Column:
        place = F.length(_bare(F.substr(e, F.lit(1), i + 1))) + shift
        return F.when(c.rlike(r"[\p{L}\p{M}\p{N}]") & (place > 0), F.substr(values, place, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.split(e, ""), one), "")
    return F.concat(filled, F.when(more > 0, F.substr(values, slots + 1)).otherwise(F.lit("")))


def _cased(e: Column, text: Column) -> Column:
    """text with the capitals of e, character by character."""
    def one(c: Column, i: Column) -> Column:
        there = F.substr(e, i + 1, F.lit(1))
        return F.when(there != F.lower(there), F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def written(e: Column, key: Column) -> Column:
    """A surrogate's key in the format of an entity (of one word of a name)."""
    return bound(F.struct(_kind(key).alias("kind"), _plain(key).alias("plain")), lambda x: _written(e, x["kind"], x["plain"]))


def _written(e: Column, kind: Column, plain: Column) -> Column:
    small, shout = F.lower(e) == e, (F.upper(e) == e) & (F.length(e) > 1)
    named = F.when(small, plain).when(shout, F.upper(plain)).otherwise(
        F.array_join(F.transform(F.split(plain, "-"), lambda w: F.initcap(w)), "-")
    )
    phone = F.when(F.length(plain) > F.length(_bare(e)), F.concat(e, plain)).otherwise(_filled(e, plain, True))
    return (
        F.when(kind == "email", _cased(e, plain))
        .when(kind == "ip", plain)
        .when(kind == "ipv6", F.when(F.upper(e) == e, F.upper(plain)).otherwise(plain))
        .when(kind == "phone", phone)
        .when(kind.isin("ssn", "card", "account"), _filled(e, plain))
        .otherwise(named)
    )


def parts_of(e: Column) -> Column:
    """array<struct<text, key>> of what an entity as found is made of: itself, or the words of a name behind its title.

    The first of several words is a given name of the title's gender.
    """
    rest = F.regexp_replace(e, _HEAD, "")
    title = F.regexp_replace(F.substr(e, F.lit(1), F.length(e) - F.length(rest)), r"\.? $", "")
    gender = F.when(title.isin(*MALE_TITLES), "given-male").otherwise("given-female")
    words = F.split(rest, " ")

    def word(w: Column, i: Column) -> Column:
        given = (i == 0) & (F.size(words) > 1)
        return F.struct(w.alias("text"), F.concat_ws("|", F.when(given, gender).otherwise("name"), F.lower(w)).alias("key"))

    whole = F.array(F.struct(e.alias("text"), key_of(e).alias("key")))
    return F.when(kind_of(e) == "name", F.transform(words, word)).otherwise(whole)


def entities(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(PATTERN), F.lit(0))


def secret_of(spark, secret: str | None = None) -> str:
    secret = secret or spark.conf.get(KEY_SETTING, None)
    if not secret:
        secret = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, secret)
    return secret


def assignments(docs: DataFrame, secret: str) -> DataFrame:
    """(key, surrogate) for keys whose first surrogate failed a collision check; distinct and safe."""
    found = docs.select(F.explode(F.array_distinct(entities())).alias("entity")).distinct()
    keys = found.select(F.explode(parts_of(F.col("entity"))["key"]).alias("key")).distinct()
    first = materialize(keys.withColumn("surrogate", surrogate_key(F.col("key"), 0, secret)), "entities")
    real = first.select(F.col("key").alias("surrogate"))
    shared = first.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("owner"))
    owners = shared.join(real, "surrogate", "left_anti").select("surrogate", "owner")
    # few: those that share a surrogate, or hold a real entity
    lost = shared.where("n > 1").select("surrogate").unionByName(shared.join(real, "surrogate", "left_semi").select("surrogate"))
    pending = materialize(
        first.join(lost.distinct(), "surrogate")
        .join(owners, "surrogate", "left")
        .where(F.col("owner").isNull() | (F.col("owner") != F.col("key")))
        .select("key"),
        "pending",
    )
    kept: list[DataFrame] = []
    round_ = 0
    while not pending.isEmpty():
        round_ += 1
        drawn = pending.withColumn("surrogate", surrogate_key(F.col("key"), round_, secret))
        taken = reduce(DataFrame.unionByName, [first.select("surrogate"), real, *(k.select("surrogate") for k in kept)])
        free = drawn.join(taken, "surrogate", "left_anti")
        owner = free.groupBy("surrogate").agg(F.min("key").alias("key"))
        won = materialize(owner.select("key", "surrogate"), "assigned")
        kept.append(won)
        left = materialize(pending.join(won, "key", "left_anti"), "pending")
        discard(pending)
        pending = left
    discard(pending)
    return reduce(DataFrame.unionByName, kept, first.where(F.lit(False)).select("key", "surrogate"))


def _rewritten(text: Column, found: Column, chosen) -> Column:
    """The text's parts between entities, where names found after a title go as well, with the surrogates between them.

    chosen: a key's surrogate.
    """

    def made(e: Column) -> Column:
        pieces = F.transform(parts_of(e), lambda p: F.struct(p["text"].alias("text"), p["key"].alias("key"), written(p["text"], chosen(p["key"])).alias("made")))
        return F.struct(F.regexp_extract(e, _HEAD, 0).alias("head"), (kind_of(e) == "name").alias("named"), pieces.alias("pieces"))

    def with_made(items: Column) -> Column:
        swapped = F.transform(
            items, lambda x: F.concat(F.when(x["named"], x["head"]).otherwise(F.lit("")), F.array_join(F.transform(x["pieces"], lambda p: p["made"]), " "))
        )
        words = F.flatten(F.transform(F.filter(items, lambda x: x["named"]), lambda x: x["pieces"]))
        # of a word that is both, the surname comes last and wins; a single letter is no name by itself
        return F.struct(swapped.alias("swapped"), F.array_sort(F.array_distinct(F.transform(
            F.filter(words, lambda p: F.length(p["text"]) > 1),
            lambda p: F.struct(p["text"].alias("text"), p["key"].alias("key"), p["made"].alias("made")),
        ))).alias("words"))

    def with_names(x: Column) -> Column:
        last = F.filter(x["words"], lambda p, i: F.coalesce(F.get(x["words"], i + 1)["text"] != p["text"], F.lit(True)))
        return F.struct(x["swapped"].alias("swapped"), last.alias("names"))

    def joined(x: Column) -> Column:
        def one(t: Column, p: Column) -> Column:
            alone = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])\Q"), p["text"], F.lit(r"\E(?![\p{L}\p{M}\p{N}_])"))
            return F.when(F.contains(t, p["text"]), F.regexp_replace(t, alone, p["made"])).otherwise(t)

        parts = F.split(text, PATTERN, -1)
        return F.array_join(
            F.transform(parts, lambda p, i: F.concat(F.aggregate(x["names"], p, one), F.coalesce(F.get(x["swapped"], i), F.lit("")))), ""
        )

    return bound(bound(bound(F.transform(found, made), with_made), with_names), joined)


def replace(docs: DataFrame, secret: str | None = None) -> DataFrame:
    """doc_id, text with surrogates, n_entities (without names that stand alone); one row per row."""
    secret = secret_of(docs.sparkSession, secret)
    later = assignments(docs, secret)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("found", entities())
    def finish(rows: DataFrame, chosen) -> DataFrame:
        text = F.when(F.size("found") == 0, F.col("text")).otherwise(_rewritten(F.col("text"), F.col("found"), chosen))
        return rows.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))

    if later.isEmpty():
        return finish(base, lambda key: surrogate_key(key, 0, secret))
    # documents with an entity of a later round, by content: equal rows are rewritten alike
    base = base.withColumn("mark", F.sha2(F.concat_ws("|", "doc_id", "text"), 256))
    each = base.where(F.size("found") > 0).select("mark", "found").dropDuplicates(["mark"])
    parts = each.select("mark", F.explode(F.array_distinct(F.flatten(F.transform("found", parts_of)))["key"]).alias("key"))
    moved = materialize(
        parts.join(later, "key")
        .groupBy("mark")
        .agg(F.map_from_entries(F.collect_set(F.struct("key", "surrogate"))).alias("special")),
        "special",
    )
    joined = base.join(moved, "mark", "left")
    return finish(joined, lambda key: F.coalesce(F.element_at(F.col("special"), key), surrogate_key(key, 0, secret)))


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir))
