"""Operator 5: surrogates for personal data.  DataFrame functions only.

Detected: e-mail addresses, secrets (password=..., token = "..."), IPv4 and IPv6 addresses, IBANs, card numbers,
phone and social security numbers, and persons after a form of address; the names of these persons are
detected wherever else they stand in the document, too (a person that never has a form of address is not).  Each is made
of atoms (an address has a local part and a
domain, a person a given name and a surname), and an atom's surrogate is a function of a key, the atom's
kind and its value, so equal values have equal surrogates in all documents.  Surrogates keep type and
format: letters stay letters of their script and case, digits digits, separators as they are; phone numbers
keep their country code, card numbers their first digit and a valid check digit, IBANs their country and valid check
digits, IP addresses stay valid, given names keep their gender by ending.

Most texts are searched by a pattern without the kinds that need a mark they lack ('@', a colon, a keyword); entities
are looked for once, and the texts that have any are cut at them.

Collision checks run over all distinct atoms: a surrogate that another atom has, or that is the real value
of some atom, is drawn again in the next round (later rounds add characters), until all are distinct.  Atoms
that needed more than the first draw are joined to the documents that have them.

Nulls: a null text stays null and has no entities; doc_id may be null.  Texts without entities stay as they
are.  Repeated rows each get a row; an empty table gives an empty table.  Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.shared import discard, id_key, stash, table

KEY = "terrane"
#: Redrawn atoms up to which their documents' notes are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000
ROUNDS = 64
#: From this round on each round's surrogates are a character or syllable longer.
LONGER_FROM = 4

#: Forms of address by gender.
FEMALE = r"Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|г-жа|Госпожа|Κυρία"
MALE = r"Mr|Herr|Monsieur|Señor|Sr|г-н|Господин|Κύριος"
OTHER = r"Dr|Prof"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = r"(?<![\p{L}\p{N}])(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9_/+-]{8,}\"?"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
CARD = r"(?<![\d+])\d(?:[ -]?\d){12,18}(?![ -]?\d)"
PHONE = r"(?<![\d\p{L}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d\p{L}])\+\d{8,15}(?!\d)|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = PHONE + r"|(?<![\d\p{L}.,:/-])\d{10}(?![\d\p{L}]|[.,:/-]\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IPV6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
NAME = r"\p{Lu}[\p{L}'’-]+"
PERSON = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{OTHER})\.?[ ]{NAME}(?:[ ]{NAME})?"
#: A person's form of address and blank.
HEAD = rf"^(?:{FEMALE}|{MALE}|{OTHER})\.?[ ]"
#: What every text is searched for; the first character is looked at before anything else.
PLAIN = rf"(?=[0-9+(])(?:{'|'.join((IP, CARD, PHONE))})|(?=[A-Z])(?:{IBAN})|(?=[DFHMPSгГΚ])(?:{PERSON})"
#: The same with the kinds that have a mark of their own.
MARKED = "|".join((EMAIL, SECRET, IPV6, PLAIN))
#: Words that a secret follows.
SECRET_WORDS = ("passw", "secret", "token", "api_key")
#: Syllables and gender endings of made-up names by script, and the scripts' letters.
SYLLABLES = {
    "latin": ("ba re lo mi ta no vi ke su da ri zo pe ga li mo", "na", "n"),
    "cyrillic": ("ба ре ло ми та но ви ке су да ри зо пе га ли мо", "на", "н"),
    "greek": ("βα ρε λο μι τα νο βι κε σα δα ρι ζο πε γα λι μο", "να", "ς"),
}
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value, which stands in the plan once and is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def pattern(text: Column) -> Column:
    """The pattern a text is searched by."""
    marks = text.contains("@") | text.rlike(":[0-9A-Fa-f]{0,4}:")
    for word in SECRET_WORDS:
        marks = marks | text.contains(word)
    return F.when(marks, F.lit(MARKED)).otherwise(F.lit(PLAIN))


def kind_of(m: Column) -> Column:
    """Type of a match, by the order in which the patterns try them; a name alone is a 'name'."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (F.when(whole(EMAIL), "email").when(whole(SECRET), "secret").when(whole(IPV6), "ipv6").when(whole(IP), "ip")
            .when(whole(CARD), "card").when(whole(PHONE), "phone").when(whole(IBAN), "iban").when(whole(PERSON), "person").otherwise("name"))


def _searched(text: Column) -> Column:
    """Matches of a text, in order."""
    marked = pattern(text) == F.lit(MARKED)
    return F.when(marked, F.regexp_extract_all(text, F.lit(MARKED), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)))


def names_of(found: Column) -> Column:
    """The names of the persons among matches, as an array of struct(kind, value), each name once."""
    persons = F.filter(found, lambda m: m.rlike(f"^(?:{PERSON})$") & ~m.rlike(r"[@\d]"))
    return _once(F.flatten(F.transform(persons, person_atoms)), lambda held: F.filter(held, lambda x, i: ~F.exists(F.slice(held, 1, i), lambda y: y["value"] == x["value"])))


def with_names(text: Column, names: Column) -> Column:
    """The pattern for a text whose persons have these names: the longest name first."""
    longest = F.transform(F.array_sort(F.transform(names, lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("value")))), lambda x: x["value"])
    alone = F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, F.concat(pattern(text), alone)).otherwise(pattern(text))


def _bits(kind: Column, value: Column, round_: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, round_.cast("string")), 512)


def _byte(digest: Column, i) -> Column:
    """A number below 65536 for the i-th draw."""
    at = (F.lit(i) if isinstance(i, int) else i) * 4 % 124 + 1
    return F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def like(value: Column, digest: Column, round_: Column, only_hex: Column | bool = False) -> Column:
    """Characters of the same class, script and case; longer in late rounds."""
    padded = F.concat(value, F.repeat(F.lit("x"), F.greatest(round_ - LONGER_FROM + 1, F.lit(0))))
    hexed = F.lit(only_hex) if isinstance(only_hex, bool) else only_hex

    def draw(ch: Column, i: Column) -> Column:
        n = _byte(digest, i) + F.floor(i / 31).cast("int")
        lower = F.lower(ch)
        letter = F.when(lower.rlike("^[а-яё]$"), _pick(CYRILLIC, n)).when(lower.rlike("^[α-ωά-ώ]$"), _pick(GREEK, n)).when(hexed, _pick("abcdef", n)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n))
        cased = F.when(ch.rlike(r"^\p{Lu}$"), F.upper(letter)).otherwise(letter)
        return F.when(ch.rlike(r"^\p{N}$"), (n % 10).cast("string")).when(ch.rlike(r"^[\p{Ll}\p{Lu}]$"), cased).otherwise(ch)

    return F.array_join(F.transform(F.filter(F.split(padded, ""), lambda c: c != ""), draw), "")


def _luhn(digits: Column, last_doubled: bool) -> Column:
    """Sum of the check rule over a string of digits, from its right end."""
    def weigh(c, i):
        d = c.cast("int") * F.when(i % 2 == (0 if last_doubled else 1), 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), weigh), F.lit(0), lambda a, b: a + b)


def _card(value: Column, digest: Column, round_: Column) -> Column:
    made = F.concat(F.substr(value, F.lit(1), F.lit(1)), like(F.substr(value, F.lit(2)), digest, F.least(round_, F.lit(LONGER_FROM - 1))))
    digits, before = F.regexp_replace(value, r"\D", ""), F.regexp_replace(F.left(made, F.length(made) - 1), r"\D", "")
    check = ((F.lit(10) - _luhn(before, True) % 10) % 10).cast("string")
    return F.when(_luhn(digits, False) % 10 == 0, F.concat(F.left(made, F.length(made) - 1), check)).otherwise(made)


def _iban(value: Column, digest: Column, round_: Column) -> Column:
    """The country kept, the rest drawn, check digits made valid where they were."""
    country, body = F.left(value, F.lit(2)), F.substr(value, F.lit(5))
    drawn = like(body, digest, F.least(round_, F.lit(LONGER_FROM - 1)))

    def rest(text: Column) -> Column:  # of the text's number, letters as 10 to 35, modulo 97
        code = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        signs = F.filter(F.split(text, ""), lambda c: (c != "") & (c != " "))
        return F.aggregate(signs, F.lit(0), lambda a, c: F.when(code(c) > 9, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97)

    valid = rest(F.concat(body, F.left(value, F.lit(4)))) == 1
    check = F.lpad((F.lit(98) - rest(F.concat(drawn, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(valid, check).otherwise(F.substr(value, F.lit(3), F.lit(2))), drawn)


def _ipv6(value: Column, digest: Column) -> Column:
    draw = lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_byte(digest, i) % 15 + 1)))
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), draw), "")


def _ip(digest: Column) -> Column:
    return F.concat_ws(".", *[(_byte(digest, i) % 254 + 1).cast("string") for i in range(4)])


def _named(kind: Column, value: Column, digest: Column, round_: Column) -> Column:
    def by_script(one: Callable[[str], Column]) -> Column:
        return F.when(kind.endswith("cyrillic"), one("cyrillic")).when(kind.endswith("greek"), one("greek")).otherwise(one("latin"))

    parts = by_script(lambda x: F.split(F.lit(SYLLABLES[x][0]), " "))
    ending = F.when(kind.startswith("given:f"), by_script(lambda x: F.lit(SYLLABLES[x][1]))).when(kind.startswith("given:m"), by_script(lambda x: F.lit(SYLLABLES[x][2]))).otherwise("")
    n = F.when(kind.startswith("surname"), 4).otherwise(3) + F.greatest(round_ - LONGER_FROM + 1, F.lit(0))
    stem = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, _byte(digest, i) % 16)), "")
    name = F.initcap(F.concat(stem, ending))
    return F.when((F.length(value) > 1) & (F.upper(value) == value), F.upper(name)).otherwise(name)


def surrogate(kind: Column, value: Column, round_: Column, key: str = KEY) -> Column:
    """The atom's surrogate of a round."""
    prefix = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .-]))?", 0)
    last = F.regexp_extract(value, r"\.[^.]+$", 0)
    # what is drawn by characters differs in which of them
    before = F.when(kind == "phone", prefix).otherwise("")
    after = F.when(kind == "domain", last).otherwise("")
    drawn = F.substr(value, F.length(before) + 1, F.length(value) - F.length(before) - F.length(after))

    def made(digest: Column) -> Column:
        only_hex = (kind == "secret") & value.rlike("^[0-9a-f]+$")
        return (F.when(kind == "ip", _ip(digest)).when(kind == "ipv6", _ipv6(value, digest)).when(kind == "iban", _iban(value, digest, round_)).when(kind == "card", _card(value, digest, round_))
                .when(kind.isin("phone", "domain", "secret", "local"), F.concat(before, like(drawn, digest, round_, only_hex), after))
                .otherwise(_named(kind, value, digest, round_)))

    return _once(_bits(kind, value, round_, key), made)


def _person(m: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Head (form of address and blank), given name and its kind, surname and its kind."""
    head = F.regexp_extract(m, HEAD, 0)
    names = F.substr(m, F.length(head) + 1)
    given = F.regexp_extract(names, rf"^({NAME})[ ]", 1)
    surname = F.substr(names, F.when(given == "", 1).otherwise(F.length(given) + 2))
    script = lambda x: F.when(x.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    female = head.rlike(rf"^(?:{FEMALE})\b") | (head.rlike(rf"^(?:{OTHER})\b") & given.rlike("[aeаяαη]$"))
    return head, given, F.concat(F.when(female, "given:f:").otherwise("given:m:"), script(given)), surname, F.concat(F.lit("surname:"), script(surname))


def _secret(m: Column) -> tuple[Column, Column, Column]:
    head = F.regexp_extract(m, r"^.*?[=:]\s?\"?", 0)
    tail = F.when(m.endswith('"'), '"').otherwise("")
    return head, F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail)), tail


def _atom(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def person_atoms(m: Column) -> Column:
    """The atoms of a person, as an array of struct(kind, value)."""
    _, given, given_kind, surname, surname_kind = _person(m)
    return F.when(given == "", F.array(_atom(surname_kind, surname))).otherwise(F.array(_atom(given_kind, given), _atom(surname_kind, surname)))


def atoms(m: Column, kind: Column | None = None) -> Column:
    """The atoms of a match, as an array of struct(kind, value)."""
    if kind is None:
        return _once(kind_of(m), lambda k: atoms(m, k))
    return (F.when(kind == "email", F.array(_atom("local", F.regexp_extract(m, "^([^@]*)@", 1)), _atom("domain", F.regexp_extract(m, "@(.*)$", 1))))
            .when(kind == "secret", F.array(_atom("secret", _secret(m)[1])))
            .when(kind == "person", person_atoms(m))
            .otherwise(F.array(_atom(kind, m))))


def replacement(m: Column, draws: Column | None, names: Column, key: str) -> Column:
    """What stands for a match.  draws: map from 'kind|value' to the round of atoms that were redrawn; names: those of the
    document's persons."""
    def made(atom: Column) -> Column:
        k, v = atom["kind"], atom["value"]
        return surrogate(k, v, F.lit(0) if draws is None else F.coalesce(F.try_element_at(draws, F.concat_ws("|", k, v)), F.lit(0)), key)

    def built(kind: Column, parts: Column) -> Column:
        head = F.regexp_extract(m, HEAD, 0)
        before, _, after = _secret(m)
        out = F.when(kind == "email", F.array_join(parts, "@")).when(kind == "secret", F.concat(before, F.get(parts, F.lit(0)), after))
        return out.when(kind == "person", F.concat(head, F.array_join(parts, " "))).otherwise(F.get(parts, F.lit(0)))

    def of(kind: Column) -> Column:
        held = F.when(kind == "name", F.slice(F.filter(names, lambda x: x["value"] == m), 1, 1)).otherwise(atoms(m, kind))
        return _once(F.transform(held, made), lambda parts: built(kind, parts))

    return _once(kind_of(m), of)


def assign(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, round and surrogate of each of ``found(kind, value)``, distinct within a kind and unlike any value
    of the kind."""
    now = stash(found.select("kind", "value").distinct().withColumn("round", F.lit(0)), "atoms")
    for _ in range(rounds):
        drawn = stash(now.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("round"), key)), "drawn")
        discard(now)
        real = drawn.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        least = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("least"), F.max("value").alias("last"))
        clash = least.join(real, ["kind", "surrogate"], "left").filter("real or least < last").select("kind", "surrogate", "least", F.coalesce("real", F.lit(False)).alias("real"))
        clash = stash(clash, "clashes")
        if not clash.limit(1).count():
            return drawn
        judged = drawn.join(clash, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("real") | (F.col("value") != F.col("least")), F.lit(False))
        now = stash(judged.select("kind", "value", (F.col("round") + again.cast("int")).alias("round")), "atoms")
        discard(drawn)
        discard(clash)
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace(docs: DataFrame, key: str = KEY, counted: str | None = None) -> DataFrame:
    """``docs`` with surrogates in their texts; ``counted`` names a column for the number of entities."""
    held = docs.select(id_key().alias("k"), F.xxhash64("text").alias("th"), _searched(F.col("text")).alias("found"))
    held = stash(held.filter(F.size("found") > 0).select("k", "th", F.explode(F.array_distinct("found")).alias("m")), "entities")
    parts = held.select("k", "th", F.explode(atoms(F.col("m"))).alias("a")).select("k", "th", "a.kind", "a.value")
    redrawn = assign(parts.groupBy("kind", "value").agg(F.count("*").alias("n")), key).filter("round > 0")

    free = [f"pii{n}" for n in range(len(docs.columns) + 7) if f"pii{n}" not in docs.columns][:7]
    found, names, by, draws, k, th, all_ = free
    work, has_draws = docs, False
    if redrawn.limit(1).count():
        has_draws = True
        notes = parts.join(redrawn.select("kind", "value", "round"), ["kind", "value"]).select("k", "th", F.concat_ws("|", "kind", "value").alias("atom"), "round").distinct()
        notes = notes.groupBy("k", "th").agg(F.map_from_entries(F.collect_list(F.struct("atom", "round"))).alias("draws"))
        notes = stash(notes, "draws").toDF(k, th, draws)
        small = notes.count() <= BROADCAST_ROWS
        work = docs.withColumns({k: id_key(), th: F.xxhash64("text")}).join(F.broadcast(notes) if small else notes, [k, th], "left")
    discard(held)
    text = F.col("text")
    # by steps, so that a text is searched once: its matches, its persons' names, and where it has any what matches with these
    work = work.withColumn(found, _searched(text)).withColumn(names, F.when(F.size(found) > 0, names_of(F.col(found))))
    work = work.withColumn(by, F.when(F.size(found) > 0, with_names(text, F.col(names))))
    work = work.withColumn(all_, F.when(F.size(names) > 0, F.regexp_extract_all(text, F.col(by), F.lit(0))).otherwise(F.col(found)))
    pieces = F.split(text, F.col(by), -1)
    ends = F.concat(F.transform(F.col(all_), lambda m: replacement(m, F.col(draws) if has_draws else None, F.col(names), key)), F.array(F.lit("")))
    made = F.array_join(F.zip_with(pieces, ends, lambda p, m: F.concat(p, m)), "")
    out = work.withColumn("text", F.when(F.size(found) > 0, made).otherwise(text))
    extra = [F.greatest(F.coalesce(F.size(all_), F.lit(0)), F.lit(0)).cast("long").alias(counted)] if counted else []
    return out.select(*docs.columns, *extra)


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), counted="n_entities").select("doc_id", "n_entities", "text")
