"""PII surrogates: detected entities get keyed replacements of their own type and format.

Entities are found by one pattern in the whole text. An entity's canonical form (lower
case, or bare digits) names it in all its spellings, so it has one surrogate wherever it
occurs (coreference). A surrogate is drawn from SHA-512 of key, kind, canonical form and
attempt, in the shape of the canonical form: digits for digits, letters for letters, hex
for hex; card numbers keep their first digit and whether their check digit holds; names
keep gender and script; addresses keep the form of an address. Draws that equal another
entity's draw or any entity that occurs are drawn again with the next attempt until all
surrogates of a kind are distinct (collision checks). From attempt ``SHAPED`` on each draw
has one character or syllable more than the last, so that a form whose space is used up
goes on in a larger one; a value without any letter or digit is drawn anew as letters and
digits at once. A mention then gets the surrogate in its own spelling: separators, country
prefix and upper case stay, and further digits follow at the end.

Names are found behind titles only, as one run of capitalised words and initials; a name is
an entity as a whole, so parts of it, and mentions without a title, are not brought together.
Secrets are found behind a name and a sign, up to the closing quote or white space; without
quotes they have six characters at least.

Everything is a DataFrame expression or join. Only mentions are exploded; texts are cut at
their mentions and joined again with what replaces them, by a digest of the text.

Runs of words, titles, particles and domain parts are matched without going back into them,
so the length of a run costs no stack (20,000 words and domain parts are tested).

Defined results: a null text stays null, a text without entities stays as it is; repeated
rows are replaced alike; all other columns pass through but for one named ``n_entities``,
which gives way to the result; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import settled

# Draws in an entity's own form before longer ones.
SHAPED = 8

# What the kinds look like (Java patterns). Earlier kinds win.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HONORIFICS = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Lady|Señora|Sra|Госпожа",
    "m": "Mr|Herr|Monsieur|Lord|Sir|Señor|Sr|Господин",
    "n": "Dr|Doctor|Prof|Professor|Mx|Rev|Доктор|Профессор",
}
TITLES = rf"(?:(?:{'|'.join(HONORIFICS.values())})\.? )++"
# A capitalised word, or an initial; small words may stand before it.
NAME_WORD = r"(?:(?:von|van|der|den|de|del|della|di|da|la|le|al|bin|ibn) )*+(?:\p{Lu}[\p{L}'’-]+|\p{Lu}\.)"
SECRET_NAMES = r"(?i:pass(?:word|wd)|secret|token|api[_-]?key|access[_-]?key)"
SECRET_SIGN = r"[\"']?\s*[=:]\s*"
# Up to the closing quote, or up to white space without the marks that end a clause.
SECRET_VALUE = (
    r"(?:\"(?=[^\"\s])[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+(?=\"|\z)|'(?=[^'\s])[^'\\\n]*+(?:\\.[^'\\\n]*+)*+(?='|\z)"
    r"|[\"']?[^\s\"']\S{4,}[^\s,;)\]}>\"'])"
)
KINDS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\p{L}\d-]+(?:\.[\p{L}\d-]+)++",
    "secret": SECRET_NAMES + SECRET_SIGN + SECRET_VALUE,
    "access_key": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_\w{30,}|(?<!\w)sk-[\w-]{20,}|(?<!\w)xox[abprs]-[\w-]{10,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?(?![\w-])|(?<![\w.+])\+\d{8,15}(?!\d)",
    "name": rf"(?<!\p{{L}}){TITLES}{NAME_WORD}(?:(?: |(?<=\.)){NAME_WORD})*+",
}
ANY_KIND = "|".join(f"(?:{pattern})" for pattern in KINDS.values())
# A text without any of these holds no entity, which spares most texts the longer pattern.
TRIGGER = rf"\d|@|[=:]|{TITLES}{NAME_WORD}"
# What of a mention is kept in front of the entity itself.
PREFIX = rf"^(?:{SECRET_NAMES}{SECRET_SIGN}[\"']?|{TITLES})"
KEY_PREFIX = "^(?:AKIA|ASIA|gh._|sk-|xox.-)"
# Syllables of given names by script and gender, of family names by script.
GIVEN = {
    ("latin", "f"): ["Ana", "Clara", "Emma", "Ida", "Julia", "Lena", "Maria", "Nora", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Boris", "David", "Emil", "Jonas", "Lukas", "Martin", "Oskar", "Paul", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Лев", "Максим", "Павел", "Юрий"],
}
GIVEN |= {(script, "n"): GIVEN[script, "f"] + GIVEN[script, "m"] for script in ("latin", "cyrillic")}
FAMILY = {
    "latin": ["bar", "den", "fel", "gor", "hal", "kin", "lor", "mar", "nes", "pol", "ras", "sen", "tam", "vin", "wel", "zor"],
    "cyrillic": ["бар", "ден", "фел", "гор", "хал", "кин", "лор", "мар", "нес", "пол", "рас", "сен", "там", "вин", "вел", "зор"],
}


def mentions_of(text: Column) -> Column:
    return F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY_KIND), 0)).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    cases = [F.when(mention.rlike(f"^(?:{pattern})$"), kind) for kind, pattern in KINDS.items()]
    return F.coalesce(*cases)


def canonical(kind: Column, mention: Column) -> Column:
    """The entity without its spelling. A name's gender and script stand in front of it."""
    value = F.regexp_replace(mention, PREFIX, "")
    digits = F.regexp_replace(value, r"\D", "")
    national = F.regexp_replace(digits, r"^1(?=\d{10}$)", "")
    gender = F.coalesce(*[F.when(mention.rlike(rf"^(?:{titles})\W"), g) for g, titles in HONORIFICS.items()], F.lit("n"))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", national)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", F.concat_ws(" ", script, gender, F.lower(value)))
        .otherwise(value)
    )


def _byte(digest: Column, place: Column) -> Column:
    """A byte of the hex digest, by a place that wraps around."""
    return F.conv(F.substring(digest, F.pmod(place, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, digest: Column) -> Column:
    """Digits, letters (hex letters in hex words) and capitals drawn anew, all else as it stands."""
    hex_word = value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")
    letters = F.when(hex_word, 6).otherwise(26)

    def character(c: Column, i: Column) -> Column:
        byte = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(byte, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + F.pmod(byte, letters)))
            .when(c.rlike("[A-Z]"), F.char(65 + F.pmod(byte, letters)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.element_at(F.split(F.lit("абвгдежзиклмнопрстуфхчшэюя"), ""), F.pmod(byte, F.lit(26)) + 1))
            .when(c.rlike(r"\p{L}"), F.char(97 + F.pmod(byte, letters)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), character), "")


def _luhn(digits: Column) -> Column:
    """The sum of the check rule, modulo 10; 0 for a valid number."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    backwards = F.split(F.reverse(digits), "")
    return F.pmod(F.aggregate(F.transform(backwards, term), F.lit(0), lambda a, b: a + b), F.lit(10))


def drawn(kind: Column, name: Column, digest: Column, more: int) -> Column:
    """The surrogate of a canonical form, ``more`` characters longer than it; ``digest`` has 256 hex digits."""
    longer = F.lit("0a" * more)
    # Marks alone can't be drawn anew.
    blank = ~name.rlike(r"[0-9\p{L}]")
    shaped = F.when(blank, _shaped(F.lit("a0" * 8 + "0a" * more), digest)).otherwise(
        F.expr("_shaped") if not more else _shaped(F.concat(name, F.when(kind.isin("phone", "ssn", "card", "iban"), F.lit("0" * more)).otherwise(longer)), digest)
    )
    body = F.concat(F.substring(name, 1, 1), F.substring(shaped, F.lit(2), F.length(shaped) - 2))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    wrong = F.when(_luhn(name) == 0, 0).otherwise(1)  # an invalid number stays one
    card = F.concat(body, F.pmod(check + wrong, F.lit(10)).cast("string"))
    octets = [1 + F.pmod(_byte(digest, F.lit(0)), F.lit(223)), *[_byte(digest, F.lit(i)) for i in (1, 2, 3)]]
    ip = F.concat_ws(".", *octets)
    if more:  # longer than four octets: an address of the range for documentation
        ip = F.concat(F.lit("2001:db8:"), F.array_join(F.array(*[F.substring(digest, 4 * i + 1, 4) for i in range(6)]), ":"))
    local = _shaped(F.concat(F.substring_index(name, "@", 1), longer), digest)
    host = F.concat(F.substring(F.sha2(F.concat(F.substring_index(name, "@", -1), F.substring(digest, 257, 32)), 256), 1, 8))
    given_prefix = F.regexp_extract(name, KEY_PREFIX, 0)
    key_rest = F.regexp_replace(name, KEY_PREFIX, "")
    key_body = F.when(~key_rest.rlike("[0-9A-Za-z]"), _shaped(F.lit("a0" * 8 + "0a" * more), digest)).otherwise(_shaped(F.concat(key_rest, longer), digest))
    script, gender = F.substring_index(name, " ", 1), F.element_at(F.split(name, " "), 2)

    def pick(values: list[str], place: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.pmod(_byte(digest, F.lit(place)), F.lit(len(values))) + 1)

    given = F.coalesce(*[F.when((script == s) & (gender == g), pick(values, 0)) for (s, g), values in GIVEN.items()])
    family = F.coalesce(*[F.when(script == s, F.concat(*[pick(values, i) for i in range(1, 6 + more)])) for s, values in FAMILY.items()])
    words = F.size(F.split(name, " ")) - 2
    person = F.concat_ws(" ", script, gender, F.when(words > 1, F.lower(given)), family)
    return (
        F.when(kind == "email", F.concat(local, F.lit("@m"), host, F.lit(".example.net")))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "access_key", F.concat(given_prefix, key_body))
        .when(kind == "iban", F.concat(F.substring(name, 1, 2), F.substring(shaped, F.lit(3), F.length(shaped))))
        .when(kind == "name", person)
        .otherwise(shaped)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, name, surrogate of distinct (kind, name) rows; distinct within a kind and never a name that occurs."""
    pending, taken, done = entities, entities.select("kind", F.col("name").alias("surrogate")), None
    for attempt in count():
        seed = F.concat_ws("\0", F.lit(key), "kind", "name", F.lit(str(attempt)))
        # Hosts depend on the key and attempt alone besides their own name, so that addresses of one host keep one.
        digest = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\0")), 512), F.substring(F.sha2(F.lit(f"{key}\0{attempt}"), 512), 1, 32))
        draw = (
            pending.withColumn("_digest", digest)
            .withColumn("_shaped", _shaped(F.col("name"), F.col("_digest")))
            .withColumn("surrogate", drawn(F.col("kind"), F.col("name"), F.col("_digest"), max(0, attempt - SHAPED + 1)))
            .select("kind", "name", "surrogate")
        )
        # The first by name keeps a draw that several share.
        first = draw.groupBy("kind", "surrogate").agg(F.min("name").alias("name")).join(taken, ["kind", "surrogate"], "left_anti")
        round_ = settled(
            draw.join(first.withColumn("kept", F.lit(True)), ["kind", "name", "surrogate"], "left"), "surrogate-draws"
        )
        kept = round_.where("kept").drop("kept")
        done = kept if done is None else done.unionByName(kept)
        taken = taken.unionByName(kept.select("kind", "surrogate"))
        pending = round_.where("kept IS NULL").select("kind", "name")
        if pending.isEmpty():
            return done


def spelled(kind: Column, name: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's spelling."""
    prefix = F.regexp_extract(mention, PREFIX, 0)
    value = F.regexp_replace(mention, PREFIX, "")
    # The last digits of the mention are replaced one by one; a country prefix stands before them.
    skipped = F.length(F.regexp_replace(value, r"\D", "")) - F.length(name)
    further = F.substring(surrogate, F.length(name) + 1, F.length(surrogate))

    def digit(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"\D", "")) - skipped
        return F.when(c.rlike("[0-9]") & (before >= 0), F.substring(surrogate, before + 1, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(F.split(value, ""), digit), "")

    def sign(c: Column, i: Column) -> Column:
        before = i - F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^ ]", ""))
        return F.when(c == " ", c).otherwise(F.substring(surrogate, before + 1, F.lit(1)))

    signs = F.array_join(F.transform(F.split(value, ""), sign), "")
    person = F.initcap(F.array_join(F.slice(F.split(surrogate, " "), 3, 9), " "))
    plain = (
        F.when(kind.isin("card", "ssn", "phone"), F.concat(digits, further))
        .when(kind == "iban", F.concat(signs, further))
        .when(kind == "name", person)
        .otherwise(surrogate)
    )
    loud = kind.isin("email", "name") & (value == F.upper(value)) & (value != F.lower(value))
    return F.concat(prefix, F.when(loud, F.upper(plain)).otherwise(plain))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its entities replaced, and n_entities."""
    # A clash with the caller's own columns is ruled out by a prefix that none of them has.
    docs = docs.drop("n_entities")
    own = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    text = F.col("text")
    found = (
        docs.select(F.sha2("text", 256).alias("digest"), mentions_of(text).alias("mentions"))
        .where(F.size("mentions") > 0)
        .select("digest", F.posexplode("mentions").alias("place", "mention"))
        .withColumn("kind", kind_of(F.col("mention")))
        .withColumn("name", canonical(F.col("kind"), F.col("mention")))
    )
    # Texts that occur often come down to one row a mention before anything is shuffled whole.
    found = settled(found.distinct(), "mentions")
    mapping = surrogates(found.select("kind", "name").distinct(), key)
    parts = found.join(mapping, ["kind", "name"]).select(
        "digest", F.struct("place", spelled(F.col("kind"), F.col("name"), F.col("mention"), F.col("surrogate")).alias("by")).alias("part")
    )
    by_text = settled(
        parts.groupBy("digest").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["by"]).alias("by")), "replacements"
    ).select(F.col("digest").alias(f"{own}digest"), F.col("by").alias(f"{own}by"))
    # Texts without a trigger hold no entity and stay out of the join, and so out of the shuffle.
    triggered = F.coalesce(text.rlike(TRIGGER), F.lit(False))
    keyed = docs.where(triggered).withColumn(f"{own}digest", F.sha2("text", 256))
    joined = keyed.join(by_text.hint("merge"), f"{own}digest", "left")
    by = F.col(f"{own}by")
    pieces = F.zip_with(F.split(text, ANY_KIND, -1), by, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))))
    changed = joined.select(
        *[F.when(by.isNull(), text).otherwise(F.array_join(pieces, "")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(by), F.lit(0)).alias("n_entities"),
    )
    return changed.union(docs.where(~triggered).withColumn("n_entities", F.lit(0)))
