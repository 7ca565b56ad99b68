"""Replacing personal data by keyed surrogates, in DataFrame expressions only.

Detected entities (e-mail addresses, secrets, IP addresses, card and account numbers, phone
numbers, social security numbers, names after a title) are replaced by surrogates of the
same type and format: digits by digits, letters by letters of their case, names by names of
the same gender, or of the script the name is written in; card numbers and account numbers
have valid check digits again. What shapes an entity (+, @, dots, dashes, brackets, a
country code, a top-level domain) stays.

An entity falls into parts: an address into mailbox and domain, a name into given name and
surname, anything else is one part. A part's surrogate is a keyed hash of the part, so a
part has the same one everywhere (coreference): Mr. John Smith and Mrs. Smith keep one
surname, two mailboxes of a domain keep one domain. A pass over the distinct parts finds
surrogates that two parts share or that are themselves a part of the corpus; those are drawn
again, longer with each attempt (distinctness: parts are told apart, and so are entities).

The key comes from the setting ``spark.meshwright.pii.key``; without one the surrogates can
be recomputed by anyone who has this code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.storage import discard, materialize

#: Detection patterns by type, in the order in which they win. Runs of unbounded
#: length are possessive and begin only where the run does, so that a text of any length is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+|(?:sk|pk|ghp|gho|xox[a-z])[_\-](?=[0-9A-Za-z_\-]{0,255}?[0-9])[0-9A-Za-z_\-]{16,}+|AKIA(?=[A-Z]{0,15}[0-9])[0-9A-Z]{16})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9a-fA-F:]{0,39}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Dr|Prof|Doctor|Professor)\.? \p{Lu}\p{L}++(?: \p{Lu}\p{L}++)?",
}
#: Given-name stand-ins by gender, in Latin script; names in others are mapped letter by letter.
GIVEN_MALE = ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oscar", "Paul")
GIVEN_FEMALE = ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karla", "Laura", "Marta", "Nina", "Olga", "Paula")
#: Surnames are made of these, at first of three, of one more in each further attempt.
SYLLABLES, FIRST_SYLLABLES = tuple(c + v for c in ("b", "br", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w", "z") for v in "aeiou"), 3
MALE_TITLE, OPEN_TITLE = r"^(?:Mr|Herr|Monsieur|Señor|Sr)\.? ", r"^(?:Dr|Prof|Doctor|Professor)\.? "
#: Any entity, and a cheap look for what each must have: a digit, an @ or a title.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[0-9@]|[MHFSDP](?:rs?|s|iss|me|onsieur|adame|err|rau|ra|eñora?|rof|octor|rofessor)[. ]"
ATTEMPTS = 8
#: Letters or syllables by which the last draw of a name is longer still.
LAST_DRAW = 12
#: Least characters of a stand-in for a mailbox and for a domain before its last dot: shorter ones are filled up, for room.
LEAST_MAILBOX, LEAST_DOMAIN = 12, 10
#: Parts drawn again that travel as a literal; more of them are joined.
LITERAL_PARTS = 512
DEFAULT_KEY, KEY_SETTING = "meshwright", "spark.meshwright.pii.key"
_PARTS = "array<struct<type:string,value:string>>"


def kind_of(entity: Column) -> Column:
    """The type of a detected entity: the first pattern that it matches whole."""
    out = F.lit("name")
    for name, p in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, r"^\p{L}+\.? ", 0)


def parts_of(entity: Column, kind: Column) -> Column:
    """The parts of an entity, as an array of (type, value) in their order."""

    def part(kind_: Column | str, value: Column) -> Column:
        return F.struct((F.lit(kind_) if isinstance(kind_, str) else kind_).alias("type"), value.alias("value"))

    name = F.substring(entity, F.length(_title(entity)) + 1, F.length(entity))
    gender = F.when(entity.rlike(MALE_TITLE), F.lit("given male")).when(entity.rlike(OPEN_TITLE), F.lit("given")).otherwise(F.lit("given female"))
    one = F.array(part("surname", name))
    two = F.array(part(gender, F.substring_index(name, " ", 1)), part("surname", F.substring_index(name, " ", -1)))
    email = F.array(part("mailbox", F.substring_index(entity, "@", 1)), part("domain", F.substring_index(entity, "@", -1)))
    return F.when(kind == "email", email).when(kind == "name", F.when(name.contains(" "), two).otherwise(one)).otherwise(F.array(part(kind, entity))).cast(_PARTS)


def put_together(entity: Column, kind: Column, stand_ins: Column) -> Column:
    """The surrogate of an entity from those of its parts."""
    return F.when(kind == "email", F.array_join(stand_ins, "@")).when(kind == "name", F.concat(_title(entity), F.array_join(stand_ins, " "))).otherwise(stand_ins[0])


def _hex(entity: Column, key: str, attempt: Column, n: int = 128) -> Column:
    """Keyed pseudo-random hex digits: sha-256 over key, attempt and entity, and over that again."""
    a = F.sha2(F.concat_ws("\x1f", F.lit(key), attempt.cast("string"), entity), 256)
    b = F.sha2(F.concat(a, F.lit(key)), 256)
    return F.substring(F.concat(a, b), 1, n)


def _nth(hexes: Column, i: Column) -> Column:
    """A number from 0 to 65535 at place i of the stream, which is used in a circle."""
    at = F.pmod(i * F.lit(4), F.lit(124)) + F.lit(1)
    return F.conv(F.substring(hexes, at, F.lit(4)), 16, 10).cast("int")


def _letters(entity: Column, hexes: Column, digits: str = "0123456789", low: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """The entity with every digit and letter replaced by one of its class; other characters stay."""
    chars, up = F.split(entity, ""), low.upper()

    def one(c: Column, i: Column) -> Column:
        r = _nth(hexes, i)
        pick = lambda s: F.substring(F.lit(s), F.pmod(r, F.lit(len(s))) + F.lit(1), F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), pick(digits))
            .when(c.rlike("[a-z]"), pick(low))
            .when(c.rlike("[A-Z]"), pick(up))
            # a letter of another script moves to a near one of the same case
            .when(c.rlike(r"\p{L}"), _near_letter(c, r))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _near_letter(c: Column, r: Column) -> Column:
    """A letter of the same Unicode row of 16 with the same case, or the letter itself."""
    point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint")
    moved = point - F.pmod(point, F.lit(16)) + F.pmod(r, F.lit(16))
    as_text = F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE")
    same = (as_text.rlike(r"\p{Lu}") & c.rlike(r"\p{Lu}")) | (as_text.rlike(r"\p{Ll}") & c.rlike(r"\p{Ll}")) | (as_text.rlike(r"\p{Lo}") & c.rlike(r"\p{Lo}"))
    return F.when((point < 0xD800) & same, as_text).otherwise(c)


def _luhn(digits: Column) -> Column:
    """The check digit that makes a card number of ``digits``."""
    value = lambda c, i: c.cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
    single = lambda v: v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, v: a + single(v))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account number: 98 less the rest by 97, letters counted from A = 10."""
    chars = F.split(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")), "")
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.lpad((F.lit(98) - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def stand_in(part: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a part in one attempt: same type, format, script and, for names, gender."""
    # bound by a lambda, so that the hash is taken once and not for each character
    return F.transform(F.array(_hex(F.concat_ws("\x1f", kind, part), key, attempt)), lambda h: _drawn(part, kind, h, attempt))[0]


def _drawn(part: Column, kind: Column, hexes: Column, attempt: Column) -> Column:
    mixed = _letters(part, hexes)
    # an address keeps its top-level domain; what is short gets more letters, and more with each attempt
    fill = lambda c, least: F.concat(c, F.repeat(F.lit("a"), F.greatest(F.lit(least) - F.length(c), F.lit(0)) + attempt))
    mailbox = _letters(fill(part, LEAST_MAILBOX), hexes)
    tld = F.regexp_extract(part, r"\.[A-Za-z0-9\-]+$", 0)
    domain = F.concat(_letters(fill(F.regexp_replace(part, r"\.[A-Za-z0-9\-]+$", ""), LEAST_DOMAIN), hexes), tld)
    body = F.regexp_replace(part, r"^(?:sk|pk|ghp|gho|xox[a-z])[_\-]|^AKIA", "")
    # hex stays hex in its case; where both cases occur, each character keeps its own
    hexed = part.rlike("^[0-9a-fA-F]{32,}$")
    long_hex = F.substring(F.repeat(F.concat(hexes, F.reverse(hexes)), (F.length(part) / 256 + 1).cast("int")), F.lit(1), F.length(part))
    long_hex = F.when(~part.rlike("[A-F]"), long_hex).when(~part.rlike("[a-f]"), F.upper(long_hex)).otherwise(_letters(part, hexes, low="abcdef"))
    # a secret keeps its prefix
    secret = F.when(hexed, long_hex).otherwise(F.concat(F.substring(part, F.lit(1), F.length(part) - F.length(body)), _letters(body, hexes)))
    country, account = F.substring(part, 1, 2), _letters(F.substring(part, F.lit(5), F.length(part)), hexes)
    iban = F.concat(country, _iban_check(country, account), account)
    octet = lambda i: F.pmod(_nth(hexes, F.lit(i)), F.lit(254)) + F.lit(1)
    ip = F.concat_ws(".", *(octet(i).cast("string") for i in range(4)))
    # a card keeps its first digit, the network; the last one checks the others
    front = F.concat(F.substring(part, 1, 1), _letters(F.substring(part, F.lit(2), F.length(part) - 2), hexes))
    card = F.concat(front, _luhn(F.regexp_replace(front, "[^0-9]", "")))
    code = F.regexp_extract(part, r"^\+[0-9]{1,3}(?![0-9])", 0)
    phone = F.concat(code, _letters(F.substring(part, F.length(code) + 1, F.length(part)), hexes))
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), F.pmod(_nth(hexes, i), F.lit(len(names))) + F.lit(1))
    # given names are double names in the second attempt, and so on; after a title of either gender they are of both
    several = lambda names: F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: of(names, i)), "-")
    given = F.when(kind == "given male", several(GIVEN_MALE)).when(kind == "given female", several(GIVEN_FEMALE)).otherwise(several(GIVEN_MALE + GIVEN_FEMALE))
    surname = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(FIRST_SYLLABLES) + attempt), lambda i: of(SYLLABLES, i)), ""))
    # in other scripts a name gets more letters like its last one
    other = _letters(F.concat(part, F.repeat(F.substring(part, -1, 1), attempt)), hexes)
    latin = part.rlike(r"^\p{IsLatin}+$")
    return (
        F.when(kind == "mailbox", mailbox).when(kind == "domain", domain).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "ip", ip)
        .when(kind == "ip6", _letters(part, hexes, low="abcdef")).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "surname", F.when(latin, surname).otherwise(other)).when(kind.startswith("given"), F.when(latin, given).otherwise(other)).otherwise(mixed)
    )


def detected(text: Column) -> Column:
    """The entities of a text in order; none for a null."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def part_table(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(type, value, surrogate) for the distinct parts of ``entity`` values.

    Within a type all surrogates are distinct and none is a part. In each attempt the first
    claimant (by value) of a free surrogate gets it; the others draw again. After
    ``attempts`` draws a clash is settled by ``LAST_DRAW`` more letters or syllables, or, where
    a format has no room to grow, by a number, so distinctness does not depend on luck.
    """
    parts = entities.select(F.explode(parts_of(F.col("entity"), kind_of(F.col("entity")))).alias("_p")).select("_p.*").distinct()
    draw = lambda n: stand_in(F.col("value"), F.col("type"), key, F.lit(n))
    have = materialize(parts.withColumn("surrogate", draw(0)), "surrogates")
    for attempt in range(1, attempts + 1):
        first = have.groupBy("type", "surrogate").agg(F.min("value").alias("_first"), F.count("*").alias("_n"))
        known = have.select(F.col("type").alias("_type"), F.col("value").alias("_known"))
        clash = (
            have.join(first.where("_n > 1"), ["type", "surrogate"], "left")
            .join(known, (F.col("surrogate") == F.col("_known")) & (F.col("type") == F.col("_type")), "left")
            .withColumn("again", (F.col("_first").isNotNull() & (F.col("_first") != F.col("value"))) | F.col("_known").isNotNull())
        )
        if clash.where("again").isEmpty():
            return have
        drawn = draw(attempt)
        if attempt == attempts:
            grows = F.col("type").isin("surname", "given male", "given female", "given", "mailbox", "domain")
            numbered = F.concat(drawn, F.lit("-"), F.conv(F.substring(F.sha2(F.col("value"), 256), 1, 15), 16, 10))
            drawn = F.when(grows, draw(attempt + LAST_DRAW)).otherwise(numbered)
        nxt = materialize(clash.select("type", "value", F.when(F.col("again"), drawn).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")
        discard(have)
        have = nxt
    return have


def surrogate_table(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(entity, kind, surrogate) for distinct ``entity`` values, all surrogates distinct and none an entity."""
    table = part_table(entities, key, attempts)
    own = entities.select("entity", kind_of(F.col("entity")).alias("kind"))
    each = own.select("entity", "kind", F.posexplode(parts_of(F.col("entity"), F.col("kind"))).alias("_at", "_p")).select("entity", "kind", "_at", "_p.*")
    joined = each.join(table, ["type", "value"]).groupBy("entity", "kind").agg(F.sort_array(F.collect_list(F.struct("_at", "surrogate"))).alias("_s"))
    return joined.select("entity", "kind", put_together(F.col("entity"), F.col("kind"), F.col("_s.surrogate")).alias("surrogate"))


def _name(kind: Column, value: Column) -> Column:
    """How a part is called in a map."""
    return F.concat(kind, F.lit("\x1f"), value)


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and n_entities long; n_chars, where there is one, is the new length.

    Other columns stay as they are. A null text stays null with 0 entities. Equal texts get
    equal results; an empty table gives no rows. A column n_entities of ``docs`` is replaced.
    ``key`` comes from the session's setting unless it is given. A text of any length is read
    whole.

    Texts are read twice: once for the distinct entities, once to replace. Surrogates of the
    first draw are expressions of the parts; only those drawn again are looked up: in a
    literal of at most ``LITERAL_PARTS``, else by a join that keeps the rows' own columns in one struct.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEFAULT_KEY)
    cols = [c for c in docs.columns if c != "n_entities"]
    distinct = docs.select(F.explode(detected(F.col("text"))).alias("entity")).distinct()
    table = part_table(distinct, key)
    first = stand_in(F.col("value"), F.col("type"), key, F.lit(0))
    again = table.where(F.col("surrogate") != first).select("type", "value", F.col("surrogate").alias("_s"))
    rows = docs.select(F.struct(*cols).alias("row"), F.col("text"), detected(F.col("text")).alias("found"))
    few = again.limit(LITERAL_PARTS + 1).collect()
    known: Column | None = F.col("map")
    if not few:
        known = None
    elif len(few) <= LITERAL_PARTS:
        few.sort()
        known = F.create_map(*(F.lit(x) for r in few for x in (f"{r.type}\x1f{r.value}", r._s)))
    else:
        # materialized, so that a row keeps its number; rows without an entity are not joined
        numbered = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "pieces")
        entity = numbered.select("n", F.explode(F.array_distinct("found")).alias("_e"))
        part = entity.select("n", F.explode(parts_of(F.col("_e"), kind_of(F.col("_e")))).alias("_p")).select("n", "_p.*")
        redrawn = part.join(again, ["type", "value"]).groupBy("n").agg(F.map_from_entries(F.collect_set(F.struct(_name(F.col("type"), F.col("value")), "_s"))).alias("map"))
        hit = numbered.where(F.size("found") > 0).join(redrawn, "n", "left").select("row", "text", "found", "map")
        clean = numbered.where(F.size("found") == 0).select("row", "text", "found", F.lit(None).cast("map<string,string>").alias("map"))
        rows = hit.unionByName(clean)
    found = F.col("found")

    def of_part(p: Column) -> Column:
        drawn = stand_in(p["value"], p["type"], key, F.lit(0))
        return drawn if known is None else F.coalesce(F.try_element_at(known, _name(p["type"], p["value"])), drawn)

    def of_entity(e: Column) -> Column:
        kind = F.array(kind_of(e))  # bound by a lambda, so that it is found out once
        return F.transform(kind, lambda k: put_together(e, k, F.transform(parts_of(e, k), of_part)))[0]

    between = F.split(F.col("text"), ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), F.transform(found, of_entity), lambda t, s: F.concat(t, s)), ""), F.element_at(between, -1))
    done = rows.select("row", F.when(F.size(found) > 0, joined).otherwise(F.col("text")).alias("new"), F.size(found).cast("bigint").alias("number"))
    own = {"text": F.col("new")}
    if "n_chars" in cols:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("number") > 0, length).otherwise(F.col("row.n_chars"))
    return done.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols), F.col("number").alias("n_entities"))
