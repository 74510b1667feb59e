"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Mentions are found by one pattern. Each mention stands for entities: an e-mail address, a phone
number, card, address or id number by its digits, or the words of a name after a title. An
entity's surrogate follows from a key, so it is the same in all documents and all spellings; it
keeps the type (check digits, octets, reserved domains), the script and, for names, the gender
that titles tell, and each mention is written in its own format. Surrogates that meet another
surrogate or an entity of the data are made again until none do.

Everything is DataFrame functions. Texts without mentions are only read; of the others, distinct
entities are shuffled and resolved, and a text meets the table of its own surrogates, which is
unique per text, so that adaptive execution can split many copies of one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.functions.checksums import luhn_valid
from veilframe.llm.common import text_key, written

# Titles and the gender that they tell.
MALE = "Mr|Herr|Monsieur|Señor|Signor|г-н|господин|κύριος|श्री"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Signora|г-жа|госпожа|κυρία|श्रीमती"
OTHER = "Dr|Prof|Professor|Doctor|Docteur|Doktor|Mx"
_NAME = r"[\p{Lu}\p{Lo}][\p{L}\p{M}'’-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,8}",
    "ip": rf"(?<![\p{{L}}\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{M}}])(?:{FEMALE}|{MALE}|{OTHER})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these has no mention; it is cheaper to find than the pattern.
HINT = rf"@|\d.?\d|(?:{FEMALE}|{MALE}|{OTHER})\.? "
TITLE = rf"^(?:{FEMALE}|{MALE}|{OTHER})\.? "

# Syllables that names are made of, by script; and endings by gender.
SYLLABLES = {
    "Latin": "ba be bo da de do fa fe fi ga go ha he ho ka ke ki la le lo ma me mi na ne no pa pe ra re ro sa se so ta te to va ve vi".split(),
    "Cyrillic": "ба бе бо да де до ва ве ви га го за зе зо ка ке ки ла ле ло ма ме ми на не но па пе ра ре ро са се со та те то ве ви во".split(),
    "Greek": "βα βε βο δα δε δο φα φε φι γα γο θα θε θο κα κε κι λα λε λο μα με μι να νε νο πα πε ρα ρε ρο σα σε σο τα τε το ξα ξε ξι".split(),
    "Devanagari": "बा बे बो दा दे दो ना ने नो गा गो हा हे हो का के की ला ले लो मा मे मी वा वे वो पा पे रा रे रो सा से सो ता ते तो जा जे जी".split(),
}
ENDINGS = {
    "Latin": {"m": "n r s l".split(), "f": "a ia ina elle".split(), "u": "y i e o".split(), "family": "man son ley rich".split()},
    "Cyrillic": {"m": "н р с л".split(), "f": "а ия ина ла".split(), "u": "и е о у".split(), "family": "нов рин лев кин".split()},
    "Greek": {"m": "ς ος ης ας".split(), "f": "α ια η ω".split(), "u": "ι ε ο ου".split(), "family": "δης κης λος νας".split()},
    "Devanagari": {"m": "न र त ल".split(), "f": "या ना ता ली".split(), "u": "ी े ो ू".split(), "family": "कर राव शर लाल".split()},
}


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """The type of a mention; a card-like number whose check digit is wrong is none."""
    choice = F.when(F.contains(mention, F.lit("@")), "email").when(F.regexp_like(mention, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), "ip")
    choice = choice.when(F.regexp_like(mention, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
    choice = choice.when(F.regexp_like(mention, F.lit(r"^\p{L}")), "name")
    card = F.regexp_like(mention, F.lit(r"^\d(?:[ -]?\d){12,18}$"))
    return choice.when(card & luhn_valid(mention), "card").when(card, F.lit(None)).otherwise("phone")


def canonical(kind: Column, mention: Column) -> Column:
    """What is the same in all spellings of an entity that is not a name."""
    number = digits(mention)
    number = F.when((kind == "phone") & (F.length(number) == 11) & number.startswith("1"), F.substring(number, 2, 10)).otherwise(number)
    return F.when(kind.isin("email", "ip"), F.lower(mention)).otherwise(number)


def _struct(kind: Column, canon: Column, gender: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), gender.alias("gender"))


def entities_of(mention: Column) -> Column:
    """The entities of one mention: the given names and the family name of a name, else itself."""
    kind = kind_of(mention)
    gender = F.when(F.regexp_like(mention, F.lit(rf"^(?:{FEMALE})\.? ")), "f").when(F.regexp_like(mention, F.lit(rf"^(?:{MALE})\.? ")), "m").otherwise("u")
    words = F.split(F.regexp_replace(mention, TITLE, ""), " ")
    parts = F.transform(words, lambda w, i: _struct(F.when(i == F.size(words) - 1, "family").otherwise("given"), F.lower(w), gender))
    return F.when(kind == "name", parts).when(kind.isNotNull(), F.array(_struct(kind, canonical(kind, mention), F.lit("u"))))


def has_mention(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(HINT)) & F.regexp_like(text, F.lit(ANY)), F.lit(False))


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def script_of(word: Column) -> Column:
    choice = F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), "Cyrillic").when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), "Greek")
    return choice.when(F.regexp_like(word, F.lit(r"\p{IsDevanagari}")), "Devanagari").otherwise("Latin")


def _byte(mark: Column, at: Column | int) -> Column:
    """The byte of a 32-byte hex digest at a place (from 0, cyclic)."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(mark, (F.pmod(place, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(values: Column, mark: Column, at: Column | int) -> Column:
    return F.get(values, F.pmod(_byte(mark, at) * 256 + _byte(mark, (F.lit(at) if isinstance(at, int) else at) + 1), F.size(values)))


def _digits(mark: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(_byte(mark, i), F.lit(10)).cast("string")), "")


def _luhn_digit(number: Column) -> Column:
    """The check digit that is put behind a number."""
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substr(F.reverse(number), i.cast("int"), F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)),
        F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(-total, F.lit(10)).cast("string")


def _shaped(text: Column, mark: Column) -> Column:
    """Lower-case letters and digits in place of such, by script; other characters stay."""
    alphabets = {r"[a-z\p{IsLatin}]": "abcdefghijklmnopqrstuvwxyz", r"[0-9]": "0123456789", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
                 r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"}

    def one(c: Column, i: Column) -> Column:
        choice = F.lit(None).cast("string")
        for pattern, letters in reversed(alphabets.items()):
            choice = F.when(F.regexp_like(c, F.lit(pattern)), F.substr(F.lit(letters), (F.pmod(_byte(mark, i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(choice)
        return F.coalesce(choice, c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def surrogate(kind: Column, canon: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The canonical form of the surrogate of an entity; other attempts give others."""
    mark = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)
    size = F.length(canon)
    card = F.concat(F.substring(canon, 1, 1), _digits(mark, size - 2))
    # an area code does not begin with 0 or 1, and so far none with 9 in an id number
    phone = F.concat(F.translate(_digits(mark, F.lit(1)), "01", "23"), _digits(F.sha2(mark, 256), size - 1))
    ssn = F.concat(F.lit("9"), _digits(mark, F.lit(8)))
    ip = F.concat_ws(".", (F.pmod(_byte(mark, 0), F.lit(223)) + 1).cast("string"), *(_byte(mark, i).cast("string") for i in (1, 2, 3)))
    domain = F.split(F.substring_index(canon, "@", -1), r"\.")
    email = F.concat(_shaped(F.substring_index(canon, "@", 1), mark), F.lit("@"), _shaped(F.get(domain, F.lit(0)), F.sha2(mark, 256)), F.lit(".example."), F.element_at(domain, -1))
    script = script_of(canon)
    names = []
    for name, syllables in SYLLABLES.items():
        stem = F.concat(*(_pick(_words(syllables), mark, 2 * i) for i in range(2)), F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(3)) + F.when(kind == "family", 1).otherwise(0)), lambda i: _pick(_words(syllables), mark, 2 * i + 8)), ""))
        end = F.lit(None).cast("string")
        for of, endings in ENDINGS[name].items():
            same = kind == "family" if of == "family" else (kind == "given") & (gender == of)
            end = F.when(same, _pick(_words(endings), mark, 20)).otherwise(end)
        names.append((name, F.concat(stem, end)))
    person = reduce(lambda rest, x: F.when(script == x[0], x[1]).otherwise(rest), reversed(names), F.lit(None).cast("string"))
    choice = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", F.concat(card, _luhn_digit(card)))
    return choice.when(kind == "phone", phone).otherwise(person)


def resolved(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities; no surrogate twice in a kind, and none an entity of the data.

    Rounds: entities without a surrogate try the next one; of equal ones the first entity (by its
    keyed order) keeps it. Each round leaves only those that met another. A round that resolves
    nobody for lack of free forms is an error.
    """
    done: DataFrame | None = None
    open_, attempt, stuck = entities, 0, 0
    taken = entities.select("kind", F.col("canon").alias("form"))
    left = None
    while True:
        tried = open_.withColumn("form", surrogate(F.col("kind"), F.col("canon"), F.col("gender"), key, F.lit(attempt)))
        first = F.row_number().over(Window.partitionBy("kind", "form").orderBy(F.xxhash64("canon", F.lit(key)), "canon"))
        free = tried.withColumn("first", first).where("first = 1").drop("first").join(taken, ["kind", "form"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.col("surrogate").alias("form")), ["kind", "form"], "left_anti")
        made = free.select("kind", "canon", F.col("form").alias("surrogate"))
        done = written(made if done is None else done.unionByName(made), "surrogates")
        open_ = written(entities.join(done, ["kind", "canon"], "left_anti"), "open")
        before, left = left, open_.count()
        if not left:
            return done
        stuck = stuck + 1 if left == before else 0
        if stuck > 8:
            raise ValueError(f"{left} entities have no free surrogate")
        attempt += 1


def _in_format(kind: Column, mention: Column, form: Column) -> Column:
    """A surrogate in the format of a mention: separators, leading country code, and case."""
    size = F.length(form)

    def one(i: Column) -> Column:
        c = F.substr(mention, i.cast("int"), F.lit(1))
        right = F.length(digits(F.substr(mention, i.cast("int"))))
        return F.when(F.regexp_like(c, F.lit("[0-9]")) & (right <= size), F.substr(form, (size - right + 1).cast("int"), F.lit(1))).otherwise(c)

    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), one), "")
    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(form)).otherwise(form)
    return F.when(kind.isin("email", "ip"), cased).otherwise(numbers)


def _named(mention: Column, forms: Column) -> Column:
    title = F.regexp_extract(mention, TITLE, 0)
    words = F.split(F.regexp_replace(mention, TITLE, ""), " ")

    def one(w: Column, i: Column) -> Column:
        form = F.element_at(forms, F.concat(F.when(i == F.size(words) - 1, "family:").otherwise("given:"), F.lower(w)))
        return F.when((F.upper(w) == w) & (F.length(w) > 1) & (F.lower(w) != w), F.upper(form)).otherwise(F.initcap(form))

    return F.concat(title, F.array_join(F.transform(words, one), " "))


def replaced(text: Column, forms: Column) -> Column:
    """The text with its mentions replaced; `forms` maps kind:canon to surrogates."""
    gaps, found = F.split(text, ANY, -1), mentions_of(text)

    def one(m: Column) -> Column:
        kind = kind_of(m)
        form = F.element_at(forms, F.concat(kind, F.lit(":"), canonical(kind, m)))
        return F.when(kind.isNull(), m).when(kind == "name", _named(m, forms)).otherwise(_in_format(kind, m, form))

    made = F.transform(found, one)
    return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(made, i), F.lit(""))))), "")


def with_surrogates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with the text replaced where it has mentions, and `n_mentions` (long) of those replaced.

    Null texts stay null, empty ones empty, with 0 mentions; texts without mentions do not change.
    Equal texts are replaced alike, and the order of rows is not kept. All other columns stay; a
    column named n_mentions is an error. `key` is a secret: without it surrogates are not repeatable.
    """
    if "n_mentions" in df.columns:
        raise ValueError("a column named n_mentions is there already")
    body = F.col(f"`{text}`").cast("string")
    plain = df.where(~has_mention(body)).withColumn("n_mentions", F.lit(0).cast("long"))
    some = df.where(has_mention(body))
    of_text = some.select(text_key(body).alias("__text"), F.explode(F.array_distinct(F.flatten(F.filter(F.transform(mentions_of(body), entities_of), lambda e: e.isNotNull())))).alias("e"))
    of_text = written(of_text.select("__text", "e.*").distinct(), "mentions")
    # the gender that most mentions tell; none tells nothing
    told = lambda g: F.count_if(F.col("gender") == g)
    gender = F.when(told("f") > told("m"), "f").when(told("m") > told("f"), "m").otherwise("u")
    forms = resolved(written(of_text.groupBy("kind", "canon").agg(gender.alias("gender")), "entities"), key)
    by_text = of_text.select("__text", "kind", "canon").distinct().join(forms, ["kind", "canon"])
    by_text = by_text.groupBy("__text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canon"), "surrogate"))).alias("__forms"))
    met = some.withColumn("__text", text_key(body)).join(written(by_text, "forms"), "__text", "left")
    count = F.size(F.filter(mentions_of(body), lambda m: kind_of(m).isNotNull())).cast("long")
    met = met.withColumn("n_mentions", count).withColumn(text, F.when(F.col("__forms").isNull(), body).otherwise(replaced(body, F.col("__forms"))))
    return met.select(plain.columns).unionByName(plain)
