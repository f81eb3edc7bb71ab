"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are found by one pattern a kind. Spellings of one entity share a key: case of addresses, separators of numbers,
and title and dot of a person do not count. A person is keyed by given name and by family name apart, an address by
domain and as a whole, so "Mr. John Smith" and "Mrs Smith" keep a common family name and colleagues a common domain. Each
key gets a surrogate of its kind from a keyed digest: digits stay digits and letters letters of the same script and case,
separators and lengths stay, phone numbers keep their country code, cards their check digit rule and bank accounts their
remainder modulo 97 as they were, hosts stay in reserved ranges and domains end in a reserved name, and a given name
becomes one of the same gender and script. Each spelling is filled with its key's surrogate. Over all distinct keys of
the corpus, surrogates that meet each other or a key that occurs are found, and those keys get another one, until none
meet (distinctness); after LONGER attempts surrogates get longer, so that they never run out.

Persons are found by their title, or by two names where somebody is introduced ("my name is ..."); other names without a
title are not. Families' names are put together from syllables. Of the kinds, this one is the roughest.

Defined results: a null text stays null; text without entities is unchanged; repeated rows get repeated results; entities
are found from left to right and do not overlap; a column of the input that has the new column's name is kept, and the
new one gets underscores after its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm.columns import free_name
from loquent.llm.scratch import Scratch

#: From this attempt on, surrogates are longer than what they stand for.
LONGER = 6

# Titles and given names by gender and script, and the patterns of the kinds. Titles of one letter and those
# in small letters want more after them.
TITLES = {"m": r"Mr|Herr|Monsieur|Señor|Sr|Signor|Sig|M(?=\.)|mr|Г-н|Господин", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|mrs|Г-жа|Госпожа", "n": "Dr|Prof"}
TITLED = "|".join(TITLES.values())
NAMES = {
    ("m", "latin"): "Adrian Bruno Carlos Daniel Emil Felix Gregor Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Bianca Clara Diana Emma Flora Greta Helen Irene Julia Katrin Laura Marie Nina Olivia Paula Rosa Sarah Teresa Vera".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Любовь".split(),
}
FAMILY = {
    "latin": ("Al Ber Cas Dor Eb Fal Gar Hol Ib Jan Kel Lor Mor Nor Ol Per Quin Ren San Tor".split(), "ban den fer gel ker lan men nor per ras sel ten ver win zan".split(), "berg dorf feld hart ley man mont ner sen ton".split()),
    "cyrillic": ("Аз Бел Вол Гром Дроз Ер Зим Ил Кот Лад".split(), "ар ен ин ол ор ус".split(), "ов ев ин".split()),
}
# Calling codes of one and of two digits; the others have three.
CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[TtPpSsAa])(?i:(?:token|password|passwd|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-+/.]{8,}"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
IPV6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*(?:[0-9A-Fa-f]{3,4}|:[0-9A-Fa-f]+:[0-9A-Fa-f]))(?=[0-9A-Fa-f:]*[0-9])"
    r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
)
# With + or 00 and a country code; ten digits in three groups; with an area code that begins with 0, nine to twelve digits.
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+|00(?=[1-9][0-9]{0,2}[ .\-]))[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+./\-])(?=\(?0(?:[0-9]\)?[ /\-]?){8,11}(?![0-9]))(?:\(0[1-9][0-9]{1,4}\)|0[1-9][0-9]{1,4})[ /\-][0-9]{3,8}(?:[ \-][0-9]{2,5}){0,3}(?![0-9A-Za-z])"
)
_NAME = r"\p{Lu}[\p{L}'\-]+"
# After a title, with initials or without; or two names where somebody is introduced.
PERSON = (
    rf"(?<![\p{{L}}])(?=[DFHMPSmГ])(?:{TITLED})\.? (?:(?:\p{{Lu}}\. ?)+{_NAME}|{_NAME}(?: {_NAME})?|(?<=\bmrs?\.? )\p{{Ll}}[\p{{L}}'\-]+)"
    rf"|(?<=(?:[Mm]y name is|[Nn]ame:|I am|I'm) ){_NAME} {_NAME}"
)
KINDS = {"email": EMAIL, "ip": IP, "ipv6": IPV6, "secret": SECRET, "iban": IBAN, "ssn": SSN, "phone": PHONE, "card": CARD, "person": PERSON}
ALL = "|".join(f"(?:{p})" for p in KINDS.values())
#: What a match of each kind holds; the pattern of all kinds is tried on texts with one of these only. A look ahead at one
#: character spares the rest of a pattern at most places.
HINTS = {
    "email": "@", "ip": r"(?=[0-9])[0-9]\.[0-9]", "iban": "(?=[A-Z])[A-Z]{2}[0-9]{2}", "ssn": "(?=[0-9])[0-9]{3}", "phone": r"(?=[0-9+])(?:\+[0-9]|[0-9]{3})",
    "card": r"(?=[0-9])[0-9](?:[ \-]?[0-9]){12}", "secret": r"AKIA|(?=[TtPpSsAa])(?i:token|passw|secret|api_?key)", "person": rf"(?=[DFHMPSmГ])(?:{TITLED})\.? (?:\p{{Lu}}|(?<=\bmrs?\.? )\p{{Ll}})", "ipv6": "::|(?:[0-9A-Fa-f]{1,4}:){7}",
}
_NUMBERS = r"(?=[0-9+A-Z])(?:[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[ \-]?[0-9]){12}|[A-Z]{2}[0-9]{2}|AKIA)"


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity: by single characters first, which are cheap to look for."""
    secret = (text.contains("=") | text.contains(":")) & text.rlike(HINTS["secret"])
    address = text.contains(":") & text.rlike(HINTS["ipv6"])
    presented = text.contains("ame is ") | text.contains("ame: ") | text.contains("I am ") | text.contains("I'm ")
    return F.coalesce(text.contains("@") | text.rlike(_NUMBERS) | secret | address | presented | text.rlike(HINTS["person"]), F.lit(False))


def hits(text: Column) -> Column:
    """All entities of a text, from left to right."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(ALL), 0)).otherwise(F.array().cast("array<string>"))


def kind(value: Column) -> Column:
    # Two names without a title were found by what stands before them.
    out = F.lit("person")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def norm(kind: Column, value: Column) -> Column:
    """The key of an entity: what is the same for all its spellings."""
    plain = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    out = F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind.isin("card", "ssn", "iban"), plain)
    abroad = F.when(value.startswith("+"), F.concat(F.lit("+"), plain)).when(value.startswith("00"), F.concat(F.lit("+"), plain.substr(F.lit(3), F.length(plain))))
    return out.when(kind == "phone", abroad.otherwise(plain)).otherwise(value)


def _number(digest: Column, at: int, size: int = 4) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _shaped(value: Column, digest: Column, keep: Column) -> Column:
    """Letters and digits of `value` replaced by others of the same class, apart from its first `keep` characters."""
    hexa = F.substring_index(F.regexp_replace(value, r"[\"'\s]", "="), "=", -1).rlike(r"\A[0-9a-f]+\z")

    def swap(c: Column, i: Column) -> Column:
        own = F.conv(F.substring(F.md5(F.concat(digest, i.cast("string"))), 1, 6), 16, 10).cast("long")

        def pick(letters: str) -> Column:
            return F.lit(letters).substr((own % len(letters) + 1).cast("int"), F.lit(1))

        swapped = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-f]") & hexa, pick("abcdef")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
        swapped = swapped.when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[А-Я]"), pick("АБВГДЕЖЗИКЛМНОПРСТ"))
        return F.when(i < keep, c).otherwise(swapped.otherwise(c))

    return F.array_join(F.transform(_chars(value), swap), "")


def _check_sum(digits: Column) -> Column:
    """Sum of the check digit rule modulo 10, for a string of digits."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _remainder(account: Column) -> Column:
    """A bank account's number modulo 97, its first four characters last and letters as 10 to 35."""
    moved = F.concat(account.substr(F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).when(c == "", a).otherwise((a * 100 + letter) % 97)

    return F.aggregate(_chars(moved), F.lit(0), add)


def digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Keyed: the key stands before and after, so a digest tells nothing without it."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string"), F.lit(key)), 256)


def _pick(values: list[str], digest: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_number(digest, at, 6) % len(values) + 1).cast("int"))


def surrogate(kind: Column, value: Column, attempt: Column, digest: Column) -> Column:
    """The surrogate of a key. That of an address keeps the domain, which has a key of its own."""
    later = attempt > 0
    local = F.substring_index(value, "@", 1)
    local = F.concat(_shaped(local, digest, F.lit(0)), F.when(later, F.substring(digest, 1, 6)).otherwise(""))
    email = F.concat(local, F.lit("@"), F.substring_index(value, "@", -1))
    labels = F.regexp_replace(value, r"\.[^.]*\z", "")
    domain = F.concat(_shaped(labels, digest, F.lit(0)), F.when(later, F.substring(digest, 1, 6)).otherwise(""), F.lit(".example"))
    parts = [_number(digest, 1 + 4 * k) % 256 for k in range(3)]
    first = F.when(later, (_number(digest, 13) % 15 + 240).cast("string")).otherwise("10")
    ip = F.concat_ws(".", first, *(x.cast("string") for x in parts))
    # Later on any address that does not occur, as the reserved ones may run out.
    ip = F.when(attempt < LONGER, ip).otherwise(F.concat_ws(".", (_number(digest, 17) % 223 + 1).cast("string"), *(x.cast("string") for x in parts)))
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *(F.substring(digest, 1 + 4 * k, 4) for k in range(6)))
    secret = F.length(value) - F.length(F.regexp_extract(value, r"(?:AKIA)?([A-Za-z0-9_\-+/.]+)\z", 1))
    country = F.length(F.regexp_extract(value, rf"\A(\+(?:{CODES}))", 1))
    shaped = _shaped(value, digest, F.when(kind == "secret", secret).when(kind == "iban", 2).when(kind == "phone", country).when(kind == "card", 1).otherwise(0))
    # A card number stays as valid, or as wrong, by its check digit as it was; a bank account by its remainder.
    gap = _check_sum(value) - _check_sum(shaped)
    card = F.concat(shaped.substr(F.lit(1), F.length(shaped) - 1), ((F.substring(shaped, -1, 1).try_cast("int") + 10 + gap) % 10).cast("string"))
    body = shaped.substr(F.lit(5), F.length(shaped))
    check = (_remainder(value) - _remainder(F.concat(F.substring(shaped, 1, 2), F.lit("00"), body)) + 97) % 97
    iban = F.concat(F.substring(shaped, 1, 2), F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), body)
    longer = F.when(attempt < LONGER, "").otherwise(F.conv(F.substring(digest, 40, 12), 16, 10))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    # Later attempts make a double given name, and family names of more syllables.
    second = F.when(later, F.concat(F.lit("-"), F.initcap(F.translate(F.substring(digest, 20, 8), "0123456789", "ghijklmnop")))).otherwise("")
    given = F.lit(None).cast("string")
    for gender in ("m", "f"):
        for script, own in (("cyrillic", cyrillic), ("latin", ~cyrillic)):
            given = F.when((kind == f"given {gender}") & own, _pick(NAMES[gender, script], digest, 1)).otherwise(given)

    def built(script: str) -> Column:
        begin, middle, end = FAMILY[script]
        more = F.when(later, _pick(middle, digest, 19)).otherwise("")
        return F.concat(_pick(begin, digest, 1), _pick(middle, digest, 7), more, F.when(attempt >= LONGER, _pick(middle, digest, 25)).otherwise(""), _pick(end, digest, 13))

    family = F.when(cyrillic, built("cyrillic")).otherwise(built("latin"))
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "family", family).when(kind.startswith("given"), F.concat(given, second))
    return out.when(kind == "card", F.concat(card, longer)).when(kind == "iban", F.concat(iban, longer)).otherwise(F.concat(shaped, longer))


def _spelled(value: Column, made: Column) -> Column:
    """The letters and digits of `made` in the places of those of `value`; what is left over comes last."""
    plain = F.regexp_replace(made, r"[^0-9A-Za-z]", "")

    def fill(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(value.substr(F.lit(1), i), r"[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), plain.substr(place + 1, F.lit(1))).otherwise(c)

    size = F.length(F.regexp_replace(value, r"[^0-9A-Za-z]", ""))
    return F.concat(F.array_join(F.transform(_chars(value), fill), ""), plain.substr(size + 1, F.length(plain)))


def made(keys: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, norm and made of all keys (kind, norm): surrogates of which no two meet each other or a key that occurs."""
    rows = scratch.table(keys.withColumn("attempt", F.lit(0)), "keys")
    order = Window.partitionBy("kind", "met").orderBy("attempt", "norm")
    while True:
        tried = rows.withColumn("digest", digest(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        tried = tried.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("digest"))).drop("digest").withColumn("met", F.lower("made"))
        real = rows.select("kind", F.lower("norm").alias("met"), F.lit(True).alias("real")).distinct()
        checked = tried.join(real, ["kind", "met"], "left").withColumn("again", (F.row_number().over(order) > 1) | F.col("real").isNotNull())
        checked = scratch.table(checked.select("kind", "norm", "attempt", "made", "again"), "checked")
        if not checked.filter("again").head(1):
            scratch.drop(rows)
            return checked.select("kind", "norm", "made")
        following = scratch.table(checked.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "keys")
        scratch.drop(rows, checked)
        rows = following


def surrogates(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """value, kind and surrogate of each distinct value."""
    value = F.col("value")
    title = F.regexp_extract(value, rf"\A((?:{TITLED})\.?) ", 1)
    bare = F.regexp_replace(value, rf"\A(?:{TITLED})\.? ", "")
    initials = F.trim(F.regexp_extract(bare, r"\A((?:\p{Lu}\. ?)+)", 1))
    person = F.when(F.col("kind") == "person", F.split(F.regexp_replace(bare, r"\A(?:\p{Lu}\. ?)+", ""), " "))
    cyrillic, given = F.element_at(person, -1).rlike(r"\p{IsCyrillic}"), F.when(F.size(person) > 1, F.lower(person[0]))
    # Without a title that tells, a given name on -a or -e counts as a woman's.
    male = F.when(title.rlike(rf"\A(?:{TITLES['m']})\.?\z") | (title == "M."), True).when(title.rlike(rf"\A(?:{TITLES['f']})\.?\z"), False).otherwise(~F.coalesce(given.rlike("[aeая]$"), F.lit(False)))
    female_end = (~male) & cyrillic & F.element_at(person, -1).endswith("а")
    family = F.lower(F.element_at(person, -1))
    values = values.withColumn("kind", kind(value)).withColumns(
        {
            "norm": norm(F.col("kind"), value),
            "domain": F.when(F.col("kind") == "email", F.lower(F.substring_index(value, "@", -1))),
            "family": F.when(female_end, family.substr(F.lit(1), F.length(family) - 1)).otherwise(family),
            "given": given,
            "gender": F.when(F.col("kind") == "person", F.when(male, "given m").otherwise("given f")),
            "ending": F.when(cyrillic & ~male, "а").otherwise(""),
            "title": F.nullif(title, F.lit("")),
            "initials": F.when(initials != "", _shaped(initials, digest(key, F.lit("initials"), initials, F.lit(0)), F.lit(0))),
        }
    )
    values = scratch.table(values, "values")
    parts = {"domain": F.lit("domain"), "family": F.lit("family"), "given": F.col("gender")}
    keys = values.filter("kind <> 'person'").select("kind", "norm")
    for column, of in parts.items():
        keys = keys.unionByName(values.filter(f"{column} is not null").select(of.alias("kind"), F.col(column).alias("norm")))
    table = made(keys.distinct(), key, scratch)
    out = values.join(table, ["kind", "norm"], "left")
    for column, of in parts.items():
        own = table.select(F.col("kind").alias("__kind"), F.col("norm").alias("__norm"), F.col("made").alias(f"{column}_made"))
        out = out.join(own, (of == F.col("__kind")) & (F.col(column) == F.col("__norm")), "left").drop("__kind", "__norm")
    family = F.concat("family_made", "ending")
    family = F.when(F.element_at(F.split("value", " "), -1).rlike(r"\A\p{Ll}"), F.lower(family)).otherwise(family)
    whole = F.concat_ws(" ", "title", "initials", "given_made", family)
    address = F.concat(F.substring_index("made", "@", 1), F.lit("@"), F.col("domain_made"))
    text = F.when(F.col("kind") == "person", whole).when(F.col("kind") == "email", address).when(F.col("kind").isin("ip", "ipv6", "secret"), F.col("made"))
    # A number with 00 has no place for them in the key.
    abroad = (F.col("kind") == "phone") & value.startswith("00")
    text = text.when(abroad, F.concat(F.lit("00"), _spelled(value.substr(F.lit(3), F.length(value)), F.col("made")))).otherwise(_spelled(value, F.col("made")))
    return out.select("value", "kind", text.alias("surrogate"))


def redact(docs: DataFrame, spark: SparkSession, key: str, name: str = "entities") -> DataFrame:
    """The documents' columns with surrogates in `text`, and `name`: kind and surrogate of each, in order.

    Texts are searched once; rows without entities are neither shuffled nor joined.
    """
    scratch = Scratch(spark)
    name, row, own = (free_name(docs, x) for x in (name, "__row", "__hits"))
    found = scratch.table(docs.withColumn(own, hits(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "found")
    some, none = found.filter(F.size(own) > 0), found.filter(F.size(own) == 0)
    mentions = some.select(F.col(row).alias("row"), F.posexplode(own).alias("pos", "value"))
    table = surrogates(mentions.select("value").distinct(), key, scratch)
    # A value may stand in very many texts: the join's large keys are split when it runs.
    lists = mentions.join(table, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "surrogate"))).alias("list"))
    lists = lists.select(F.col("row").alias(row), F.transform("list", lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate"))).alias(name))
    some = some.join(lists, row)
    text = F.array_join(F.zip_with(F.split("text", ALL, -1), F.col(f"`{name}`.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    some = some.withColumn("text", text)
    none = none.withColumn(name, F.expr("cast(array() as array<struct<kind: string, surrogate: string>>)"))
    columns = [F.col(f"`{c}`") for c in (*docs.columns, name)]
    return scratch.finish(some.select(*columns).unionByName(none.select(*columns)))
