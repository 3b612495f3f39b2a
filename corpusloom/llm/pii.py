"""PII surrogates: detected entities get keyed, type-consistent replacements, in SQL functions only.

A text is cut at its entities; each is replaced and the pieces are joined again.  A
replacement is drawn from SHA-256 of (key, kind, entity, attempt) in the entity's own form:
digits stay digits, letters letters of the same case, separators stay where
they are.  Telephone numbers keep the country code, cards the first digit and a right check digit, account numbers the country,
addresses of machines stay addresses, mail keeps its top-level domain.  Persons named with a title or
a known given name get a given name of the same gender and script and a made-up surname of the script (Latin, Cyrillic or Greek).

The same entity gets the same replacement everywhere, in any formatting.  Distinct entities
must get distinct replacements that are no entity of the corpus themselves: the corpus's
distinct entities are drawn for once each and checked as they will be written; those that collide draw again, until none does.
Later attempts are longer, so that draws can't run out.

Patterns take time in proportion to a text's length and no stack: what repeats without bound is possessive and bounded on its left.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import let, partitions, pick, spread_join
from corpusloom.llm.given_names import KNOWN, one_of
from corpusloom.sources.scratch import staged

#: Titles by gender.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа", "κυρία"], "x": ["Dr", "Prof"]}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "ro", "sa", "te", "vi", "wo", "lan", "mer"],
    "cyrillic": ["ба", "ве", "ги", "до", "жа", "за", "ки", "ло", "ма", "не", "по", "ра", "си", "то", "фе", "хо"],
    "greek": ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"],
}
SYLLABLES_IN_NAME, SYLLABLES_IN_GIVEN = 6, 3
#: Ends of replaced given names by script and gender; names of different genders end in different letters.
ENDS = {("latin", "m"): ["on", "us", "or", "ek"], ("latin", "f"): ["na", "ra", "ia", "elle"], ("cyrillic", "m"): ["он", "ор", "ам", "ей"], ("cyrillic", "f"): ["на", "ра", "ия", "ля"], ("greek", "m"): ["ος", "ης", "ων", "ας"], ("greek", "f"): ["να", "ρα", "ια", "λη"]}
#: The given names of a first draw; later draws are longer.
GIVEN = {k: ["".join(x).capitalize() for x in product(*[SYLLABLES[k[0]]] * SYLLABLES_IN_GIVEN, ends)] for k, ends in ENDS.items()}
_NAME = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-]\p{L}++)*+"
_titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_given = one_of(sorted({n for names in KNOWN.values() for n in names}))
_secret = r"password|passwd|secret|token|api_key"
#: Kinds in order of precedence; none has a capturing group or matches empty text.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++(?=(?:\.[A-Za-z0-9-]++){0,4}?\.[A-Za-z]{2}))*+\.[A-Za-z]{2,63}",
    "secret": rf"(?:{_secret})\s?[=:]\s?\"?[A-Za-z0-9_\-/+]{{8,}}+\"?|\bAKIA[A-Z0-9]{{16}}\b|\b[0-9a-f]{{32,128}}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d|\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<!\d)[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<!\d)\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "person": rf"(?<![\p{{L}}\d])(?:(?:{_titles})\.? {_NAME}(?: {_NAME})?|(?:{_given}) {_NAME})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A capitalised word, which may be a later mention of a person.
WORD = rf"(?<![\p{{L}}\d])(?!\p{{L}}*+(?<={_secret})\s?[=:])\p{{Lu}}\p{{L}}*+(?:['’]\p{{L}}++|-\p{{Lu}}\p{{L}}++(?! \p{{Lu}}))*+"
#: Where a person may be named; looked for behind a blank put before the text, as a character is cheaper to test than what lies before.
_initials = "".join(sorted({t[0] for ts in TITLES.values() for t in ts if t[0].islower()}))
_NAMED = rf"[^\p{{L}}\d](?=[\p{{Lu}}{_initials}])(?:(?:{_titles})\.?|{_given}) "
#: Calling codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Put about entities while a text is cut; a text that holds it is cut another way.
MARK = "\x01"


def _sign(text: Column) -> Column:
    """A cheap test without which a text has no entity: every alternative of PATTERN implies it."""
    words = [F.contains(text, F.lit(w)) for w in (*_secret.split("|"), "AKIA")]
    out = text.rlike("[0-9@]") | text.rlike(r"\b[a-f]{32}") | F.concat(F.lit(" "), text).rlike(_NAMED)
    for w in words:
        out = out | w
    return out


def pieces(text: Column, pattern: str) -> Column:
    """What lies between the matches of ``pattern``, and the matches, in turn; what is not matched comes first and last."""
    quick = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    slow = let(F.flatten(pairs), lambda x: F.slice(x, 1, F.size(x) - 1))
    return F.when(F.contains(text, F.lit(MARK)), slow).otherwise(quick)


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole of ``entity``."""
    out = None
    for kind, p in KINDS.items():
        test = entity.rlike(f"^(?:{p})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("secret")


def _last(person: Column) -> Column:
    """The surname, without a genitive."""
    return F.regexp_extract(person, r"([^ ]+?)(?:['’]s)?$", 1)


def canonical(kind: Column, entity: Column) -> Column:
    """What all writings of one entity share; a person is its surname, as given names and titles come and go.

    Secrets are what they are in upper and lower case, with their label; telephone numbers show by ``+`` that they name a country.
    """
    plain = F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")
    label = F.regexp_extract(entity, rf"^({_secret})\s?[=:]", 1)
    secret = F.concat(label, F.when(label != "", F.lit("=")).otherwise(""), F.regexp_replace(F.regexp_replace(entity, rf"^(?:{_secret})\s?[=:]\s?\"?", ""), "\"$", ""))
    phone = F.concat(F.when(F.startswith(entity, F.lit("+")), F.lit("+")).otherwise(""), plain)
    return (
        F.when(kind == "person", F.lower(_last(entity))).when(kind == "ip", entity).when(kind == "email", F.lower(F.regexp_replace(entity, r"^[._%+-]+", "")))
        .when(kind == "secret", secret).when(kind == "phone", phone).otherwise(F.lower(plain))
    )


def _digest(key: str, kind: Column, name: Column, attempt: Column, n: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"{key}:{n}"), kind, name, attempt.cast("string")), 512)


def _number(digest: Column, at: Column, width: int = 4) -> Column:
    return F.conv(F.substr(digest, at, F.lit(width)), 16, 10).cast("long")


def _drawn(name: Column, key: str, kind: Column, attempt: Column, hexadecimal: Column) -> Column:
    """``name`` with every digit and Latin letter drawn anew in its class; a digest serves 32 characters."""

    def one(c: Column, x: Column, letters: Column) -> Column:
        low = F.chr(F.lit(97) + x % letters)
        return F.when(c.rlike("[0-9]"), (x % 10).cast("string")).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low)).otherwise(c)

    def numbers(seed: Column, part: Column) -> Column:
        return let(F.sha2(F.concat_ws("|", seed, part.cast("string")), 512), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _number(d, i * 4 + 1)))

    parts = F.sequence(F.lit(0), F.floor((F.length(name) - 1) / 32).cast("int"))
    every = F.flatten(let(_digest(key, kind, name, attempt, 1), lambda seed: F.transform(parts, lambda p: numbers(seed, p))))
    letters = F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
    return F.array_join(let(letters, lambda n: F.zip_with(F.split(name, ""), every, lambda c, x: one(c, x, n))), "")  # numbers without a character give null, which is left out


def _more(digest: Column, attempt: Column) -> Column:
    """Digits that attempts after the fourth add, one more each, for forms with too few of their own."""
    return F.substr(F.lpad(F.conv(F.substr(digest, F.lit(101), F.lit(14)), 16, 10), 17, "0"), F.lit(2), F.least(F.greatest(attempt - 3, F.lit(0)), F.lit(16)))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits to which a check digit will be added."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _syllables(digest: Column, n: Column, script: str, at: int) -> Column:
    pool = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(pool, (_number(digest, i * 4 + at) % len(SYLLABLES[script])).cast("int"))), "")


def _surname(key: str, name: Column, attempt: Column) -> Column:
    """A made-up surname of the script of ``name``, longer with each attempt."""
    d, n = _digest(key, F.lit("surname"), name, attempt, 0), F.lit(SYLLABLES_IN_NAME) + F.least(attempt.cast("int"), F.lit(16))
    cyrillic, greek = (_syllables(d, n, x, 1) for x in ("cyrillic", "greek"))
    return F.when(_script(name) == "cyrillic", cyrillic).when(_script(name) == "greek", greek).otherwise(_syllables(d, n, "latin", 1))


def _drawn_given(key: str, name: Column, attempt: Column) -> Column:
    """A made-up given name of the gender and script that end ``name``, longer with each attempt."""
    d = _digest(key, F.lit("given"), name, attempt, 0)
    n = F.lit(SYLLABLES_IN_GIVEN) + F.least(attempt.cast("int"), F.lit(8))
    code, out = F.get(F.split(name, r"\|"), F.lit(2)), F.lit(None).cast("string")
    for (script, sex), ends in ENDS.items():
        end = F.get(F.array(*map(F.lit, ends)), (_number(d, F.lit(1)) % len(ends)).cast("int"))
        out = F.when(code == f"{script}-{sex}", F.concat(_syllables(d, n, script, 5), end)).otherwise(out)
    return out


def replacement(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical entity, in canonical form."""
    label = F.regexp_extract(name, rf"^(?:{_secret})=|^AKIA", 0)
    drawn = _drawn(name, key, kind, attempt, (kind == "secret") & F.substr(name, F.length(label) + 1, F.length(name)).rlike("^[0-9a-f]+$"))
    d = _digest(key, kind, name, attempt, 0)
    more = _more(d, attempt)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(d, i * 4 + 1) % 254 + 1).cast("string")), ".")
    host = F.instr(name, "@")
    tail = F.regexp_extract(name, r"\.[a-z]+$", 0)
    email = F.concat(F.substr(drawn, F.lit(1), host - 1), more, F.substr(drawn, host, F.length(drawn) - F.length(tail) - host + 1), tail)
    body = F.concat(F.substr(name, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(drawn) - 2), more)
    real = (_luhn_sum(F.substr(name, F.lit(1), F.length(name) - 1)) + F.substr(name, F.length(name), F.lit(1)).cast("int")) % 10 == 0
    card = F.when(real, F.concat(body, ((10 - _luhn_sum(body) % 10) % 10).cast("string"))).otherwise(F.concat(F.substr(name, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), F.length(drawn)), more))
    iban = F.concat(F.substr(name, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(3), F.length(drawn)), more)
    secret = F.concat(label, F.substr(drawn, F.length(label) + 1, F.length(drawn)), more)
    country = F.regexp_extract(name, COUNTRY, 0)
    phone = F.concat(country, F.substr(drawn, F.length(country) + 1, F.length(drawn)), more)
    given = F.concat_ws("|", F.get(F.split(name, r"\|"), F.lit(0)), _drawn_given(key, name, attempt), F.get(F.split(name, r"\|"), F.lit(2)))
    return (
        F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "card", card).when(kind == "secret", secret).when(kind == "iban", iban)
        .when(kind == "person", _surname(key, name, attempt)).when(kind == "given", given).when(kind == "phone", phone).otherwise(F.concat(drawn, more))
    )


def _woven(entity: Column, drawn: Column) -> Column:
    """``drawn``, character by character, in place of the letters and digits of ``entity``, in their case; what is left of it at the end.

    Entities of bounded length only: the text so far is copied for each character.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(a: Column, c: Column) -> Column:
        x = F.substr(drawn, a["at"], F.lit(1))
        upper = (F.lower(c) != c) & c.rlike(r"\p{L}")
        plain = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(a["out"], F.when(~plain, c).when(upper, F.upper(x)).otherwise(x)).alias("out"), (a["at"] + plain.cast("int")).alias("at"))

    return F.aggregate(F.split(entity, ""), start, one, lambda a: F.concat(a["out"], F.substr(drawn, a["at"], F.length(drawn))))


def _title(person: Column) -> Column:
    return F.regexp_extract(person, rf"^(?:{_titles})\.?(?= )", 0)


def _given_of(person: Column) -> Column:
    """The given name as written, or null."""
    rest = F.split(F.trim(F.substr(person, F.length(_title(person)) + 1, F.length(person))), " ")
    return F.when(F.size(rest) > 1, F.get(rest, F.lit(0)))


def given_name(person: Column) -> Column:
    """Surname, given name, script and gender of a person as an entity of its own; null without given name."""
    given, bare = _given_of(person), F.regexp_replace(_title(person), r"\.$", "")
    female = bare.isin(TITLES["f"]) | (~bare.isin(TITLES["m"]) & (given.isin(KNOWN["f"]) & ~given.isin(KNOWN["m"]) | (~given.isin(KNOWN["m"]) & given.rlike("[aаяе]$"))))
    return F.when(given.isNotNull(), F.concat(F.lower(_last(person)), F.lit("|"), F.lower(given), F.lit("|"), _script(person), F.when(female, "-f").otherwise("-m")))


def _person(entity: Column, surname: Column, given: Column) -> Column:
    """Title, the new given name if there is one, and the new surname in the old one's case; a given name alone stays one."""
    title, last = _title(entity), _last(entity)
    upper = (F.upper(last) == last) & (F.length(last) > 1)
    new = F.when(upper, F.upper(surname)).otherwise(F.initcap(surname))
    first = F.initcap(F.get(F.split(given, r"\|"), F.lit(1)))
    alone = (title == "") & ~F.contains(entity, F.lit(" ")) & given.isNotNull()
    tail = F.regexp_extract(entity, r"['’]s$", 0)
    return F.when(alone, F.when(upper, F.upper(first)).otherwise(first)).otherwise(F.concat(F.concat_ws(" ", F.when(title != "", title), first, new), tail))


def surrogate(entity: Column, kind: Column, drawn: Column, given: Column) -> Column:
    """The replacement in the form of the entity found."""
    lead = F.regexp_extract(entity, r"^[._%+-]*", 0)
    bare = F.substr(entity, F.length(lead) + 1, F.length(entity))
    address = F.concat(lead, F.array_join(F.zip_with(F.split(bare, ""), F.split(drawn, ""), lambda c, x: F.when((F.lower(c) != c), F.upper(x)).otherwise(x)), ""))
    before = F.regexp_extract(entity, rf"^(?:{_secret})\s?[=:]\s?\"?", 0)
    secret = F.concat(before, F.regexp_replace(drawn, rf"^(?:{_secret})=", ""), F.when(F.endswith(entity, F.lit('"')), F.lit('"')).otherwise(""))
    return (
        F.when(kind == "ip", drawn).when(kind == "email", address).when(kind == "secret", secret).when(kind == "person", _person(entity, drawn, given))
        .otherwise(_woven(entity, F.regexp_replace(drawn, r"^\+", "")))
    )


def has_entity(text: Column) -> Column:
    """Whether anything of ``text`` is replaced; never null."""
    return F.coalesce(_sign(text) & text.rlike(PATTERN), F.lit(False))


def _found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pieces, entities) of the texts with entities; entities: array of (at, kind, name, given), at a position among the pieces."""
    some = docs.where(has_entity(F.col("text"))).withColumn("pieces", pieces(F.col("text"), PATTERN))
    whole = F.filter("pieces", lambda e, i: (i % 2 == 1) & ~e.contains("@") & e.contains(" ") & e.rlike(rf"^(?:{KINDS['person']})$"))
    sure = [t + x for t in TITLES["m"] + TITLES["f"] for x in ("", ".")]
    people = F.transform(whole, lambda e: F.struct(F.lower(_last(e)).alias("last"), F.lower(_given_of(e)).alias("first"), given_name(e).alias("given"), _title(e).isin(sure).alias("sure")))
    # The gender that a title tells goes before one that is guessed.
    some = some.withColumn("people", people).withColumn("people", F.concat(F.filter("people", lambda p: p["sure"]), F.filter("people", lambda p: ~p["sure"])))
    some = some.withColumn("pieces", F.when(F.size("people") > 0, pieces(F.col("text"), f"{PATTERN}|{WORD}")).otherwise(F.col("pieces")))
    lasts, firsts = (F.array_distinct(F.transform("people", lambda p: p[x])) for x in ("last", "first"))

    def named(e: Column, i: Column, kind: Column, word: Column, bare: Column, known: Column) -> Column:
        """What ``e`` at ``i`` is; a given name alone belongs to the first who has it, a person's given name has the gender that the text tells."""
        alone = word & ~F.array_contains(known["lasts"], bare)
        owner = lambda: F.get(F.filter(known["people"], lambda p: p["first"] == bare), F.lit(0))
        same = lambda mine: F.get(F.filter(known["people"], lambda p: F.substring_index(p["given"], "|", 2) == F.substring_index(mine, "|", 2)), F.lit(0))
        name = F.when(alone, owner()["last"]).when(word, bare).otherwise(canonical(kind, e))
        given = F.when(alone, owner()["given"]).when(~word & (kind == "person"), let(given_name(e), lambda mine: F.coalesce(same(mine)["given"], mine)))
        return F.struct(i.alias("at"), kind.alias("kind"), name.alias("name"), given.alias("given"))

    def one(e: Column, i: Column, known: Column) -> Column:
        bare = F.lower(F.regexp_replace(e, r"['’]s$", ""))
        word = e.rlike(rf"^(?:{WORD})$") & ~e.rlike(rf"^(?:{KINDS['secret']})$")
        kind = lambda w: F.when(w["word"], F.when(F.array_contains(known["lasts"], w["bare"]) | F.array_contains(known["firsts"], w["bare"]), "person")).otherwise(kind_of(e))
        found = let(F.struct(word.alias("word"), bare.alias("bare")), lambda w: let(kind(w), lambda k: F.when(k.isNotNull(), named(e, i, k, w["word"], w["bare"], known))))
        return F.when(i % 2 == 1, found)

    # What lambdas use is bound by ``let``: a column of a projection below would be computed anew for each piece.
    known = F.struct("people", lasts.alias("lasts"), firsts.alias("firsts"))
    some = some.withColumn("entities", F.filter(let(known, lambda k: F.transform("pieces", lambda e, i: one(e, i, k))), lambda e: e.isNotNull()))
    return some.select(F.monotonically_increasing_id().alias("row"), "doc_id", "pieces", "entities")


def _names(entities: Column) -> Column:
    """What is replaced as a whole, by position; the given name of the entity at i stands at -i."""
    own = F.transform(entities, lambda e: F.struct(e["at"].alias("i"), e["kind"].alias("kind"), e["name"].alias("name")))
    given = F.transform(entities, lambda e: F.struct((-e["at"]).alias("i"), F.lit("given").alias("kind"), e["given"].alias("name")))
    return F.concat(own, F.filter(given, lambda e: e["name"].isNotNull()))


def _draws(names: DataFrame, key: str) -> DataFrame:
    """(kind, name, copies, drawn) of (kind, name, copies): a draw each, redrawn while it collides; usually few do.

    The work is dealt by rows, not bytes, as drawing costs more than reading.  Of equal draws the one of the
    least attempt stays, so what has been accepted stays so.
    """
    draw = lambda df, again: df.withColumn("drawn", F.when(again, replacement(F.col("kind"), F.col("name"), F.col("attempt"), key)).otherwise(F.col("drawn")))
    dealt = names.repartition(partitions(names.sparkSession), "kind", "name").withColumns({"attempt": F.lit(0), "drawn": F.lit(None).cast("string")})
    current = staged(draw(dealt, F.lit(True)), "pii-drawn")
    taken = names.select(F.col("kind"), F.col("name").alias("drawn"), F.lit(True).alias("taken"))
    while True:
        w = Window.partitionBy("kind", "drawn").orderBy("attempt", "name")
        again = current.withColumn("n", F.row_number().over(w)).join(taken, ["kind", "drawn"], "left").where("n > 1 or taken")
        again = staged(again.select("kind", "name", F.lit(True).alias("redo")), "pii-again")
        if again.isEmpty():
            return current.drop("attempt")
        moved = current.join(again, ["kind", "name"], "left").withColumn("redo", F.coalesce("redo", F.lit(False))).withColumn("attempt", F.col("attempt") + F.col("redo").cast("int"))
        current = staged(draw(moved, F.col("redo")).drop("redo"), "pii-drawn")


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with an entity: doc_id, text (with surrogates), n_entities, kinds.

    Replacements hang on ``key`` alone, which should be kept as a secret is.  Texts without entities, also null and empty ones, give
    no row: they stay as they are.  Texts of any length are treated whole.  Repeated rows give repeated results; an
    empty table gives an empty result; further columns are ignored.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    found = staged(_found(d), "pii-found")
    n = partitions(docs.sparkSession)
    uses = found.select("row", F.explode(_names(F.col("entities"))).alias("e")).select("row", "e.*")
    names = staged(uses.groupBy("kind", "name").agg(F.count("*").alias("copies")), "pii-names")
    drawn = spread_join(uses, _draws(names, key), ["kind", "name"], F.hash("row", "i"))
    drawn = drawn.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "drawn"))).alias("drawn"))  # as many as the text has
    both = found.repartition(n, "row").join(drawn, "row")
    new = F.transform("entities", lambda e: F.struct(e["at"].alias("at"), surrogate(F.get("pieces", e["at"]), e["kind"], F.try_element_at("drawn", e["at"]), F.try_element_at("drawn", -e["at"])).alias("text")))
    joined = F.array_join(let(F.map_from_entries(new), lambda m: F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(m, i), p)).otherwise(p))), "")
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"])))
    return both.select("doc_id", joined.alias("text"), F.size("entities").cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))


def surrogate_documents(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, with entities replaced; rows without any, also null and empty texts, pass through.

    As many rows as ``docs`` has, repeated ones too; an empty table gives an empty result; further columns are ignored.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    clean = d.where(~has_entity(F.col("text").cast("string")))
    return clean.unionByName(replaced(docs, key, id_col, text_col).select("doc_id", "text"))
