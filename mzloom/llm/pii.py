"""Personal data: detection and surrogate generation with built-in functions only.

Mentions: e-mail, IPv4, phone, card, social security number, names behind one or two titles (the title gives the
gender; behind "Dr." or "Prof." a listed given name does) and, in texts that have such names, bare mentions of them or of their
parts. Words that are ordinary ones as well (``ORDINARY``, or written small in the same text) are no bare mentions. A mention consists of
entities, each with a normal form: a name of its family and its given name, an e-mail of its domain and its
local part. A secret key and the normal form determine an entity's surrogate, so all mentions of one entity
agree, and "Mr. Smith" keeps the family of "Mr. John Smith". Surrogates keep the format of the mention:
digits for digits, letters for letters, capitals for capitals, card checksums stay valid or invalid, private
addresses stay private, names keep gender, script (Latin, Cyrillic, Greek), particles, apostrophes and hyphens.

All distinct entities of the corpus are checked: two entities with one surrogate, or a surrogate that is a
real entity, are given further attempts until all are distinct and unreal. Later attempts have more letters
or digits, so no kind but IPv4 can run out: at most half of a network can be replaced within it (about 8.1 million distinct
addresses in 10.0.0.0/8). What has no surrogate after ``ATTEMPTS`` attempts raises an error. Only these exceptions are looked up; every other
surrogate is computed in its row.

Null texts stay null, empty ones empty. Repeated rows are rewritten alike. An empty table gives an
empty result. Other columns are kept, but a column n_entities is replaced; doc_id isn't read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzloom.llm.common import discard, materialise

MALE = "Mr|MR|Herrn?|HERR|Monsieur|MONSIEUR|Señor|Signor|Sir|г-н"
FEMALE = "Mrs|MRS|Ms|MS|Miss|MISS|Frau|FRAU|Mme|MME|Madame|MADAME|Señora|Sra|Signora|г-жа"
NEUTRAL = "Dr|DR|Prof|PROF|Professor|Doctor"
#: Small words within family names; the second list may also stand between given and family name.
PARTICLES = "van|von|der|den|ter|ten|de|del|della|di|da|dos|du|la|le|zu|VAN|VON|DER|DEN|TER|TEN"
INNER = "van|von|der|den|ter|ten|VAN|VON|DER|DEN|TER|TEN"
# No group is repeated without a bound: the regex engine recurses for those, and a long text would end the task.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-.]+(?<=[A-Za-z0-9\-]\.[A-Za-z]{2,24})(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
CARD = r"(?<![0-9A-Za-z\-])(?:[0-9]{4}[ \-]){3}[0-9]{4}(?![0-9A-Za-z\-])|(?<![0-9A-Za-z\-])[0-9]{13,19}(?![0-9A-Za-z\-])"
PART = r"\p{Lu}[\p{L}'\-]+"
TITLE = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? ){{1,2}}"
LEAD, BETWEEN = rf"(?:(?:{PARTICLES}) ){{0,3}}", rf"(?:(?:{INNER}) ){{0,3}}"
NAME = rf"(?<![\p{{L}}]){TITLE}{LEAD}{PART}(?: {BETWEEN}{PART})?"
ENTITY = "|".join([EMAIL, IPV4, PHONE, SSN, CARD, NAME])
#: In texts with names every capitalised word is looked at as well.
WITH_WORDS = rf"{ENTITY}|(?<![\p{{L}}]){PART}"
NAMED = rf"{TITLE}{LEAD}\p{{Lu}}"
#: A text without any of these has no entity.
HINT = rf"[@0-9]|{NAMED}"
#: Names that are ordinary words, months, weekdays or places as well, in several languages.
ORDINARY = (
    "april august autumn bach baker banks bell berg best bill bishop black bloom blue bold bond book bright brook brown burns bush butler carpenter "
    "chance christian church clay cliff cook cross dale day dean dove drew duke earl early east english fall faith farmer fisher forest fox frank french frost "
    "fuchs gardener gene german glen good grace grant gray green grey groß guy hall hand heath herb hill holly hope house hunter iris ivy jack june kaiser king klein knight "
    "koch lake land lane lang large law lee lily little long lord love mai major mark marsch martin mason may miller moon moore neu noble north page park pat penny "
    "pope price prince queen ray read reed rich rob rock rose rusty schwarz scott sharp short sky small smart snow south spring star stern street strong summer sue "
    "swift taylor tempel turner violet vogel wald walker ward weiss weiß west white will winter wise wolf wood woods young"
)
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "James Robert Michael David Thomas Daniel Paul Mark George Kevin Brian Peter Adam Henry Victor Oscar",
    ("f", "latin"): "Mary Linda Susan Karen Nancy Betty Helen Sandra Donna Carol Ruth Sharon Laura Alice Emma Clara",
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Андрей Павел Николай Михаил Олег Юрий Игорь Антон Борис Глеб Денис Фёдор",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Юлия Вера Дарья Нина Софья Алла Зоя Лидия",
    ("m", "greek"): "Γιώργος Νίκος Γιάννης Κώστας Δημήτρης Παύλος Πέτρος Στέλιος Μάριος Άρης Ηλίας Θάνος Μάκης Λάκης Τάσος Φώτης",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Χριστίνα Βασιλική Αγγελική Ειρήνη Ζωή Εύα Νίκη Θάλεια Δανάη",
}
#: First letters, vowels and last letters of invented syllables, one for each hexadecimal digit.
SOUNDS = {
    "latin": ("bdfghklmnprstvwz", "aeioaeioaeioaeio", "lnrsmtkdlnrsmtkd"),
    "cyrillic": ("бдфгхклмнпрствжз", "аеиоаеиоаеиоаеио", "лнрсмткдлнрсмткд"),
    "greek": ("βδφγχκλμνπρστθψζ", "αειοαειοαειοαειο", "λνρξμτκδλνρξμτκδ"),
}
_HEX = "0123456789abcdef"
#: So many exceptions at most ride in the plan as one literal; more are joined.
LITERAL = 500
ATTEMPTS = 64


# --- mentions and entities --------------------------------------------------------------------


def kind_of(x: Column) -> Column:
    """What a mention is; ``word`` is a capitalised word that may be part of a name."""
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return (
        F.when(F.contains(x, F.lit("@")), "email").when(x.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ipv4").when(x.rlike(r"^[+(]"), "phone")
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(digits >= 13, "card").when(x.rlike(rf"^{NAMED}"), "name").otherwise("word")
    )


def name_of(x: Column) -> Column:
    """Gender and lower-case name without title and particles: ``m:john smith``."""
    name = F.lower(F.regexp_replace(F.regexp_replace(x, rf"^{TITLE}", ""), rf"(?<![\p{{L}}'\-])(?:{PARTICLES}) ", ""))
    women = [w for (g, _), words in GIVEN.items() if g == "f" for w in words.lower().split()]
    by_given = F.when(F.substring_index(name, " ", 1).isin(women) & F.contains(name, F.lit(" ")), "f:").otherwise("m:")
    gender = F.when(x.rlike(rf"^(?:(?:{NEUTRAL})\.? )?(?:{FEMALE})\.? "), "f:").when(x.rlike(rf"^(?:{NEUTRAL})\.? (?!(?:{MALE})\.? )"), by_given).otherwise("m:")
    return F.concat(gender, name)


def family_of(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ":", -1), " ", -1)


def given_of(name: Column) -> Column:
    """The given name, or null."""
    return F.when(F.contains(name, F.lit(" ")), F.substring_index(F.substring_index(name, ":", -1), " ", 1))


def _entity(kind: str | Column, norm: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))


def mentions_in(text: Column) -> Column:
    """All mentions of a text in order, capitalised words included if it has names."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(NAMED), found(WITH_WORDS)).when(text.rlike(HINT), found(ENTITY)).otherwise(F.array().cast("array<string>"))


def with_entities(df: DataFrame, found: str, names: str, text: str | None = None) -> DataFrame:
    """Turns the mentions in ``found`` into structs (x, kind, main, other); ``names`` gets the names of the text.

    The main and the other entity of a mention may be null. Every step is a loop of its own, so that nothing
    is computed more than once for a mention.
    """
    df = df.withColumn(found, F.transform(found, lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind"))))
    df = df.withColumn(found, F.transform(found, lambda m: F.struct(m["x"].alias("x"), m["kind"].alias("kind"), F.lower(m["x"]).alias("low"), F.when(m["kind"] == "name", name_of(m["x"])).alias("name"))))
    df = df.withColumn(names, F.array_distinct(F.transform(F.filter(found, lambda m: m["name"].isNotNull()), lambda m: m["name"])))

    def bare(part: Column) -> Column:
        """The part if a bare mention of it means the name; null for ordinary words."""
        small = F.contains(F.col(text), F.concat(F.lit(" "), part, F.lit(" "))) if text else F.lit(False)
        return F.when(~(part.isin(ORDINARY.split()) | small), part)

    # Each part is looked up in the text once a name, not once a mention.
    df = df.withColumn(names, F.transform(names, lambda n: F.struct(n.alias("name"), bare(family_of(n)).alias("family"), bare(given_of(n)).alias("given"))))

    def parts(m):
        k, low, name = m["kind"], m["low"], m["name"]
        is_family = F.exists(names, lambda n: n["family"] == low)
        full = F.get(F.filter(names, lambda n: n["given"] == low), F.lit(0))["name"]
        word = F.when(is_family, _entity("family", low)).when(full.isNotNull(), _entity("given", full))
        main = (
            F.when(k == "word", word).when(k == "name", _entity("family", family_of(name))).when(k == "email", _entity("email", low))
            .when(k.isin("phone", "card", "ssn"), _entity(k, F.regexp_replace(m["x"], "[^0-9]", ""))).otherwise(_entity(k, m["x"]))
        )
        other = F.when(k == "email", _entity("domain", F.substring_index(low, "@", -1))).when((k == "name") & given_of(name).isNotNull(), _entity("given", name))
        return F.struct(m["x"].alias("x"), k.alias("kind"), main.alias("main"), other.alias("other"))

    return df.withColumn(found, F.transform(found, parts))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of the corpus."""
    # Outer generators: inner ones would push a filter down that evaluates the patterns once more.
    found = docs.where(F.col("text").rlike(HINT)).select(F.explode_outer(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("x")).where("x is not null")
    m = with_entities(found.select(F.array("x").alias("m")), "m", "n").select(F.get("m", F.lit(0)).alias("m"))
    return m.select(F.explode_outer(F.array("m.main", "m.other")).alias("e")).where("e is not null").select("e.kind", "e.norm").distinct()


# --- surrogates in normal form ----------------------------------------------------------------


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)


def _digits(h: Column) -> Column:
    """64 decimal digits from as many hexadecimal ones."""
    return F.translate(h, "abcdef", "024579")


def _letters(h: Column) -> Column:
    return F.translate(h, _HEX, "bcdfghjklmnprstv")


def _fill(x: Column, digits: Column, letters: Column) -> Column:
    """``x`` with every digit and letter replaced by that of its place, case and other characters kept."""

    def new(c, i):
        letter = F.substring(letters, i % 64 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, i % 48 + 1, F.lit(1))).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(F.split(x, ""), new), "")


def _shape(x: Column, digits: Column) -> Column:
    """A short ``x`` (phone, card, social security number) with its digits replaced by ``digits`` in turn."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("d"))

    def step(a, c):
        d = c.rlike("[0-9]")
        return F.struct(F.concat(a["o"], F.when(d, F.substring(digits, a["d"], F.lit(1))).otherwise(c)).alias("o"), (a["d"] + d.cast("int")).alias("d"))

    return F.aggregate(F.split(x, ""), start, step, lambda a: a["o"])


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    pairs = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v) % 10


def _more(letters: Column, attempt: Column, free: int) -> Column:
    """A letter more for every attempt beyond ``free``."""
    return F.substring(letters, F.lit(1), F.greatest(attempt - free, F.lit(0)))


def _domain(norm: Column, d: Column, letters: Column, attempt: Column) -> Column:
    """Labels are refilled under a reserved name: example.com, .net and .org stay, others end in .example."""
    reserved = norm.rlike(r"(^|\.)example\.(com|net|org)$")
    tail = F.when(reserved, F.concat(F.lit("example."), F.substring_index(norm, ".", -1))).otherwise("example")
    labels = F.split(norm, r"\.")
    sub = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - F.when(reserved, 2).otherwise(1), F.lit(0))), ".")
    sub = F.when(F.length(sub) > 0, sub).otherwise("mail")
    return F.concat(_more(letters, attempt, 1), _fill(sub, d, letters), F.lit("."), tail)


def _ip(norm: Column, h: Column, attempt: Column) -> Column:
    """Private networks stay what they are for eight attempts, then turn into 10.x.x.x."""
    o = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    n = [(v % 254 + 1).cast("string") for v in o]
    first = F.when(o[0] % 222 + 1 >= 10, o[0] % 222 + 2).otherwise(o[0] % 222 + 1)
    first = F.when(first.isin(127, 172, 192), first + F.lit(1)).otherwise(first).cast("string")
    public = F.concat_ws(".", first, n[1], n[2], n[3])
    small = norm.rlike(r"^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    return (
        F.when(norm.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(norm, ".", 1), n[1], n[2], n[3]))
        .when(small & (attempt < 8), F.concat_ws(".", F.substring_index(norm, ".", 2), n[2], n[3]))
        .when(small, F.concat_ws(".", F.lit("10"), n[1], n[2], n[3])).otherwise(public)
    )


def _listed(words: str, h: Column) -> Column:
    """One of 16 words, by the last digit of ``h``."""
    return F.get(F.split(F.lit(words.lower()), " "), F.conv(F.substring(h, 64, 1), 16, 10).cast("int"))


def _syllables(script: str, h: Column, count: Column) -> Column:
    """Up to 20 syllables, each one of 512."""
    one = lambda i: F.concat(*[F.translate(F.substring(h, i * 3 + 1 + k, F.lit(1)), _HEX, sounds) for k, sounds in enumerate(SOUNDS[script])])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(count, F.lit(20)) - 1), one), "")


def _by_script(family: Column, make) -> Column:
    return F.when(family.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(family.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))


def _family(norm: Column, h: Column, attempt: Column) -> Column:
    """Invented syllables, with an apostrophe behind as many letters as in ``norm`` and a hyphen where it has one."""
    at = F.instr(norm, "'")
    made = _by_script(norm, lambda script: _syllables(script, h, attempt + 3))
    cut = F.when(at.between(2, 3), at - 1).when(F.contains(norm, F.lit("-")), F.lit(6))
    return F.when(cut.isNull(), made).otherwise(F.concat(F.substring(made, F.lit(1), cut), F.when(at.between(2, 3), "'").otherwise("-"), F.substring(made, cut + 1, F.lit(64))))


def _given(norm: Column, h: Column, attempt: Column) -> Column:
    """A listed name of the same gender, from the second attempt on with an invented one behind; the family is kept for comparison."""

    def make(script):
        listed = F.when(F.substring(norm, 1, 1) == "f", _listed(GIVEN["f", script], h)).otherwise(_listed(GIVEN["m", script], h))
        second = F.when(F.substring(norm, 1, 1) == "f", _listed(GIVEN["f", script], F.reverse(h))).otherwise(_listed(GIVEN["m", script], F.reverse(h)))
        listed = F.when(F.contains(given_of(norm), F.lit("-")), F.concat(listed, F.lit("-"), second)).otherwise(listed)
        return F.concat(listed, F.when(attempt > 0, F.concat(F.lit("-"), _syllables(script, h, attempt))).otherwise(""))

    return F.concat(F.substring(norm, 1, 2), _by_script(norm, make), F.lit(" "), family_of(norm))


def _number(kind: Column, norm: Column, plain: Column, d: Column, attempt: Column) -> Column:
    """Phones keep the country and the first digit, cards the first digit and the state of their checksum."""
    keep = F.when(kind == "phone", F.when(F.length(norm) > 10, F.length(norm) - 10).otherwise(0)).otherwise(F.when(kind == "card", 1).otherwise(0))
    filled = F.concat(F.substring(norm, F.lit(1), keep), F.substring(plain, keep + 1, F.lit(64)))
    body = F.substring(filled, F.lit(1), F.length(filled) - 1)
    last = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    wrong = F.pmod(last + 1 + F.substring(d, 40, 1).cast("int") % 9, F.lit(10))
    card = F.concat(body, F.when(_luhn(norm) == 0, last).otherwise(wrong).cast("string"))
    tail = F.substring(d, F.lit(20), F.greatest(attempt - 23, F.lit(0)))
    return F.concat(F.when(kind == "card", card).otherwise(filled), tail)


def normal_surrogates(entities: Column | str, key: str) -> Column:
    """The surrogates of an array of entities (kind, norm, attempt), null for null.

    Distinct entities of a kind must differ in it. Hash and alphabets are made in loops of their own.
    """
    known = lambda e, make: F.when(e.isNotNull(), make(e))
    own = lambda e: [e[c].alias(c) for c in ("kind", "norm", "attempt")]
    hashed = F.transform(entities, lambda e: known(e, lambda e: F.struct(*own(e), _stream(key, e["kind"], e["norm"], e["attempt"]).alias("h"))))
    spelt = F.transform(hashed, lambda e: known(e, lambda e: F.struct(*own(e), e["h"].alias("h"), _digits(e["h"]).alias("d"), _letters(e["h"]).alias("l"))))
    return F.transform(spelt, lambda e: known(e, lambda e: _normal(e["kind"], e["norm"], e["attempt"], e["h"], e["d"], e["l"])))


def _normal(kind: Column, norm: Column, attempt: Column, h: Column, d: Column, letters: Column) -> Column:
    local = F.concat(_fill(F.substring_index(norm, "@", 1), d, letters), _more(letters, attempt, 1))
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), F.substring_index(norm, "@", -1))).when(kind == "domain", _domain(norm, d, letters, attempt))
        .when(kind == "ipv4", _ip(norm, h, attempt)).when(kind == "family", _family(norm, h, attempt)).when(kind == "given", _given(norm, h, attempt))
        .otherwise(_number(kind, norm, _fill(norm, d, letters), d, attempt))
    )


def exceptions(known: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt) of entities whose first surrogate collides; None if there are none."""

    def named(df, attempt):
        one = F.array(F.struct("kind", "norm", F.lit(attempt).alias("attempt")))
        return df.select("kind", "norm", F.explode(normal_surrogates(one, key)).alias("s"))

    real = known.select("kind", F.col("norm").alias("s"))
    rounds: list[DataFrame] = []
    pending, attempt = known, 0
    while True:
        tried = materialise(named(pending, attempt))
        taken = reduce(DataFrame.unionByName, [real, *[won.select("kind", "s") for won in rounds]])
        free = tried.join(taken, ["kind", "s"], "left_anti")
        rounds.append(materialise(free.groupBy("kind", "s").agg(F.min("norm").alias("norm"))))
        old = pending if attempt else None
        pending = materialise(tried.select("kind", "norm").join(rounds[-1].select("kind", "norm"), ["kind", "norm"], "left_anti"), tried)
        discard(old)
        if pending.isEmpty():
            break
        attempt += 1
        if attempt >= ATTEMPTS:
            left = {r.kind: r["count"] for r in pending.groupBy("kind").count().collect()}  # one row a kind
            raise ValueError(f"no surrogates are left for so many entities of a kind: {left}")
    late = [won.select("kind", "norm", F.lit(k).alias("attempt")) for k, won in enumerate(rounds) if k]
    return reduce(DataFrame.unionByName, late) if late else None


# --- rewriting --------------------------------------------------------------------------------


def _cased(like: Column, s: Column) -> Column:
    """``s`` in capitals if the mention is, else with capital first letters."""
    parts = F.transform(F.split(s, "(?<=[-'])"), lambda p: F.initcap(p))
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(s)).otherwise(F.array_join(parts, ""))


def _given_text(s: Column) -> Column:
    return F.substring_index(F.substring_index(s, ":", -1), " ", 1)


def _dress(x: Column, kind: Column, s: Column, other: Column) -> Column:
    """A mention rewritten in its own format with the surrogates of its main and other entity."""
    piece = lambda k: F.regexp_extract(x, rf"^({TITLE})({LEAD})({PART})(?:( {BETWEEN})({PART}))?$", k)
    given = F.when(other.isNotNull(), F.concat(_cased(piece(3), _given_text(other)), piece(4), _cased(piece(5), s))).otherwise(_cased(piece(3), s))
    name = F.concat(piece(1), piece(2), given)
    n = F.length(F.regexp_replace(x, "[^0-9]", ""))
    shaped = F.concat(_shape(x, s), F.when(F.length(s) > n, F.concat(F.lit("-"), F.substring(s, n + 1, F.lit(64)))).otherwise(""))
    mail = F.concat(F.substring_index(s, "@", 1), F.lit("@"), other)
    return (
        F.when(s.isNull(), x).when(kind == "name", name).when(kind == "word", _cased(x, F.when(F.contains(s, F.lit(":")), _given_text(s)).otherwise(s)))
        .when(kind.isin("phone", "card", "ssn"), shaped).when(kind == "email", F.when((x == F.upper(x)) & (x != F.lower(x)), F.upper(mail)).otherwise(mail)).otherwise(s)
    )


def _label(kind: Column, norm: Column) -> Column:
    return F.concat_ws("\x1f", kind, norm)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, plus n_entities (mentions replaced). ``key`` must stay secret."""
    known = materialise(entities(docs))
    special = exceptions(known, key)
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    free = "_pii"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    found, names, attempts, surrogates, text_key = (f"{free}{k}" for k in ("found", "names", "attempts", "surrogates", "key"))
    df = with_entities(docs.select(*columns, mentions_in(F.col("text")).alias(found)), found, names, "text")
    few = None if special is None else special.limit(LITERAL + 1).collect()
    if not few:
        df = df.withColumn(attempts, F.lit(None).cast("map<string,int>"))
    elif len(few) <= LITERAL:
        table = json.dumps({f"{r.kind}\x1f{r.norm}": r.attempt for r in few})
        df = df.withColumn(attempts, F.from_json(F.lit(table), "map<string,int>"))
    else:
        # The mentions of equal texts are equal: exceptions are looked up once per text, whoever shares it.
        told = docs.where(F.col("text").rlike(HINT)).select(F.xxhash64("text").alias("t"), "text", mentions_in(F.col("text")).alias("m"))
        told = with_entities(told, "m", "n", "text").select("t", F.explode_outer("m").alias("m"))
        told = told.select("t", F.explode_outer(F.array("m.main", "m.other")).alias("e")).where("e is not null").select("t", "e.kind", "e.norm").distinct()
        late = told.join(special, ["kind", "norm"]).select("t", F.struct(_label(F.col("kind"), F.col("norm")).alias("key"), F.col("attempt").alias("value")).alias("e"))
        late = late.groupBy("t").agg(F.map_from_entries(F.collect_list("e")).alias(attempts)).withColumnRenamed("t", text_key)
        df = df.join(late, F.xxhash64("text") == F.col(text_key), "left")

    def tried(e):
        attempt = F.coalesce(F.try_element_at(F.col(attempts), _label(e["kind"], e["norm"])), F.lit(0))
        return F.when(e.isNotNull(), F.struct(e["kind"].alias("kind"), e["norm"].alias("norm"), attempt.alias("attempt")))

    both = F.concat(F.transform(found, lambda m: m["main"]), F.transform(found, lambda m: m["other"]))
    df = df.withColumn(surrogates, normal_surrogates(F.transform(both, tried), key))
    n, s = F.size(found), F.col(surrogates)
    new = F.transform(found, lambda m, i: _dress(m["x"], m["kind"], F.get(s, i), F.get(s, i + n)))
    df = df.withColumn(surrogates, F.struct(new.alias("new"), F.size(F.filter(found, lambda m: m["main"].isNotNull())).cast("long").alias("count")))
    parts = F.when(F.col("text").rlike(NAMED), F.split("text", WITH_WORDS)).otherwise(F.split("text", ENTITY))
    joined = F.array_join(F.zip_with(parts, F.col(f"{surrogates}.new"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    text = F.when(n > 0, joined).otherwise(F.col("text"))
    return df.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], F.col(f"{surrogates}.count").alias("n_entities"))
