"""Personal data replaced by keyed surrogates, in DataFrame expressions.

Detected entities are e-mail addresses, IPv4 addresses, bank accounts, phone and card numbers, social
security numbers, and names after forms of address. A surrogate is made from a keyed hash of the
entity's normal form, so one entity has one surrogate in all documents; it has the entity's type, gender,
script and format: digits stand for digits, punctuation and country codes stay, a valid card number stays
valid. The caller gives the key, and who doesn't have it can't make the surrogates.

Names are replaced word by word, family names and given names (by gender) each by their own surrogates; particles
and forms of address stay, initials follow the first letters of given names. So "Mr. John Smith", "Mr. J. Smith"
and "Smith" agree, and the words of a titled name are replaced wherever else they stand in that document.

Surrogates are checked over the whole corpus: where two entities of a type meet in one surrogate, or a
surrogate is an entity that occurs, all but the first are hashed again with a counter until none do. A format
without room widens: names grow by a syllable with each attempt; from the seventh on, private addresses move to
10/8 and later to public ones, and all others get a further letter or digit an attempt, so that any number of
entities finds distinct surrogates.

Null text stays null, text without an entity stays as it is, and every row, repeated ones and those of one
identifier too, is kept with all its columns, whatever they are called; an empty table gives no rows. Where
patterns begin at one place, the first of the listed types wins. Time is in proportion to a text's length, also
for very long texts, addresses and runs of name words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from constella.llm import _store

#: The setting that holds the key of the registered query and of the pipeline, and the key for synthetic tables without it.
KEY_SETTING, SYNTHETIC_KEY = "spark.constella.surrogate.key", "synthetic tables only"
#: Attempts in the entity's own format; each later one widens it. Addresses stay private up to ``PUBLIC`` attempts.
PLAIN, PUBLIC = 6, 20
#: Words, initials and particles before a name's last word at most.
NAME_PARTS = 6

# The patterns of the types, in order of preference where several begin at one place.
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FEMALE = r"(?:Mrs|Ms|Miss|Madam|Lady|Frau|Mme|Mlle|Madame|Mademoiselle|Señora|Señorita|Doña|Sra|Srta|Signora|г-жа|Г-жа|госпожа|Госпожа|κυρία|Κυρία)"
MALE = r"(?:Mr|Mister|Sir|Lord|Herr|Herrn|Monsieur|Señor|Don|Sr|Signor|г-н|Г-н|господин|Господин|κύριος|Κύριος)"
NEUTRAL = r"(?:Dr|Prof|Professor|Doctor|Rev|Hon|Dra|Доктор|доктор|Профессор|профессор|Δρ)"
NAME_WORD = r"\p{Lu}[\p{Ll}\p{M}]++(?:[-'’]\p{Lu}[\p{Ll}\p{M}]++|(?<=Mc|Mac)\p{Lu}[\p{Ll}\p{M}]++)?+"
PARTICLE = r"(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ter|ten|zu|af|av)"
_TITLES = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?\x20)"
PATTERNS = {
    # Each part takes a whole run of its characters, so that no run is tried twice.
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@(?=[\p{L}\p{N}])[\p{L}\p{N}.-]*(?<=[\p{L}\p{N}])\.\p{L}{2,}+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_END}",
    "ssn": rf"{_EDGE}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_END}",
    "phone": rf"(?:(?<![\p{{L}}\p{{N}}+])\+[0-9]{{1,3}}(?:[\x20.-]?\([0-9]{{1,5}}\)|[\x20.-]?[0-9]{{1,5}})(?:[\x20.-]?[0-9]{{2,5}}){{1,4}}|(?<![\p{{L}}\p{{N}}])\([0-9]{{3}}\)\x20?[0-9]{{3}}[\x20.-][0-9]{{4}}|{_EDGE}[0-9]{{3}}[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}){_END}",
    "card": rf"{_EDGE}[2-6][0-9]{{3}}(?:[\x20-]?[0-9]{{4}}){{2}}[\x20-]?[0-9]{{1,7}}{_END}",
    "name": rf"{_EDGE}{_TITLES}{{1,3}}(?:\p{{Lu}}\.\x20?|{PARTICLE}\x20|{NAME_WORD}\x20){{0,{NAME_PARTS}}}{NAME_WORD}",
}
#: What each type begins with: a look at one character spares most places the whole pattern.
_BEGIN = {"email": "", "ip": "(?=[0-9])", "iban": "(?=[A-Z]{2}[0-9])", "ssn": "(?=[0-9])", "phone": "(?=[+(0-9])", "card": "(?=[2-6])", "name": "(?=[DFHLMPRSгГκΚДдПпΔ])"}
ANY = "|".join(f"(?:{_BEGIN[k]}{p})" for k, p in PATTERNS.items())
#: What every entity has, and what every name has: most texts hold none of it.
NAME_HINT = rf"{_BEGIN['name']}{_EDGE}{_TITLES}(?:\p{{Lu}}|{PARTICLE})"
HINT = "[0-9@]"

# Endings of given names by script and gender, and syllables of names by script.
ENDINGS = {
    "latin": {"f": ["a", "ia", "ina", "ella"], "m": ["o", "us", "an", "ert"], "n": ["i", "e", "is", "y"]},
    "cyrillic": {"f": ["а", "ия", "ина", "ья"], "m": ["ан", "ей", "ил", "ор"], "n": ["и", "е", "ис", "ю"]},
    "greek": {"f": ["α", "ία", "ίνα", "η"], "m": ["ος", "ας", "ης", "ων"], "n": ["ι", "ε", "ις", "υ"]},
}
SYLLABLES = {
    "latin": ["ba", "be", "da", "del", "fa", "gar", "ha", "ka", "lin", "lo", "mar", "mo", "ne", "ra", "ro", "va"],
    "cyrillic": ["ба", "ве", "го", "да", "за", "ка", "ле", "ма", "но", "ра", "ри", "са", "то", "фе", "ха", "шу"],
    "greek": ["βα", "γα", "δε", "ζα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τε", "φα", "χα", "ψα", "ρι"],
}
ALPHABETS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "latin": "abcdefghijklmnopqrstuvwxyz"}


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _choose(options: dict[str, Column], by: Column) -> Column:
    """The option that ``by`` names; the last one otherwise."""
    *first, (_, last) = options.items()
    out = F
    for name, value in first:
        out = out.when(by == name, value)
    return out.otherwise(last)


def kind_of(value: Column) -> Column:
    """The type of a match; what no pattern takes whole are words of a name that is known."""
    out = F
    for name, p in PATTERNS.items():
        out = out.when(value.rlike(f"^(?:{p})$"), F.lit(name))
    return out.otherwise(F.lit("name"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def normal_form(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity. A phone number keeps its country code; names have theirs word by word."""
    return (
        F.when(kind == "email", F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), F.lit("+")).otherwise(F.lit("")), _digits(value)))
        .when(kind.isin("card", "ssn"), _digits(value)).otherwise(value)
    )


_NAME_KIND = "array<struct<kind:string,norm:string>>"


def _parts(name: Column) -> Column:
    """The words, initials and particles of a name without its titles, with what stands between them left out."""
    return F.regexp_extract_all(F.regexp_replace(name, rf"^{_TITLES}+", ""), F.lit(rf"\p{{Lu}}\.|[^\x20]+"), F.lit(0))


def name_words(text: Column, named: Column) -> Column:
    """Array of (kind, norm): the distinct name words behind forms of address in a text, each of one kind; none unless it is ``named``."""

    def of(name: Column) -> Column:
        titles = F.regexp_extract(name, rf"^{_TITLES}+", 0)
        gender = F.when(titles.rlike(rf"\b{FEMALE}\b"), F.lit("given:f")).when(titles.rlike(rf"\b{MALE}\b"), F.lit("given:m")).otherwise(F.lit("given:n"))
        word = lambda p, g: F.filter(F.transform(p, lambda w, i: F.struct(F.when(i == F.size(p) - 1, F.lit("family")).otherwise(g).alias("kind"), w.alias("norm"))), lambda x: ~x["norm"].rlike(rf"^(?:\p{{Lu}}\.|{PARTICLE})$"))
        return _let(_parts(name), lambda p: _let(gender, lambda g: word(p, g)))

    # A word that is seen in several roles takes the first kind: a family name, else a given name of known gender.
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_BEGIN["name"] + PATTERNS["name"]), F.lit(0)), of))))
    one = _let(found, lambda all_: F.filter(all_, lambda x: x["kind"] == F.array_min(F.transform(F.filter(all_, lambda y: y["norm"] == x["norm"]), lambda y: y["kind"]))))
    return F.when(named, one).otherwise(F.array().cast(_NAME_KIND))


def pattern_of(words: Column) -> Column:
    """The pattern of a text's entities: that of all types, and the known name words of this text."""
    any_of = F.array_join(F.transform(words, lambda w: w["norm"]), "|")
    known = F.concat(F.lit(f"{ANY}|{_EDGE}(?:"), any_of, F.lit(r")(?:\x20(?:"), any_of, F.lit(f"))*+{_END}"))
    return F.when(F.size(words) > 0, known).otherwise(F.lit(ANY))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _stream(*parts: Column) -> Column:
    """256 keyed hexadecimal characters."""
    return _let(F.concat_ws("|", *parts), lambda seed: F.concat(F.sha2(seed, 512), F.sha2(F.concat(F.lit("more|"), seed), 512)))


def _nth(stream: Column, i: Column | int, n: Column | int) -> Column:
    """A number below n from the stream's characters at i, three at a time."""
    at = F.lit(i * 3 % 252 + 1) if isinstance(i, int) else F.pmod(i * 3, F.lit(252)) + 1
    return F.pmod(F.conv(F.substr(stream, at, F.lit(3)), 16, 10).cast("int"), F.lit(n) if isinstance(n, int) else n)


def _wider(stream: Column, attempt: Column, alphabet: str) -> Column:
    """As many further characters as there were attempts beyond the plain ones."""
    more = attempt - PLAIN
    return F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.substr(F.lit(alphabet), _nth(stream, 83 - i, len(alphabet)) + 1, F.lit(1))), "")).otherwise(F.lit(""))


def _letters(stream: Column, value: Column) -> Column:
    """``value`` with its letters and digits exchanged for others of their case and script."""

    def exchanged(alphabet: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            low = F.substr(alphabet, _nth(stream, i, F.length(alphabet)) + 1, F.lit(1))
            return F.when(c.rlike("[0-9]"), _nth(stream, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return _let(_choose({k: F.lit(v) for k, v in ALPHABETS.items()}, _script(value)), exchanged)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits; a valid number's is a multiple of ten."""

    def one(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(F.pmod(F.length(digits) - 1 - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _woven(value: Column, digits: Column) -> Column:
    """``value`` with its digits exchanged, in order, for those of ``digits``."""

    def one(c: Column, i: Column) -> Column:
        seen = F.length(_digits(F.substr(value, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


#: Country codes that are kept, as the digits after a plus sign: one, two, else three.
_COUNTRY = r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _new_phone(stream: Column, norm: Column, attempt: Column) -> Column:
    """The country code, then a digit from 2 to 9, then any digits."""
    plus = F.when(norm.startswith("+"), F.regexp_extract(norm, _COUNTRY, 0)).otherwise(F.lit(""))

    def rest(head: Column) -> Column:
        fresh = F.transform(F.split(F.substr(norm, F.length(head) + 1), ""), lambda c, i: F.when(i == 0, (_nth(stream, 0, 8) + 2).cast("string")).otherwise(_nth(stream, i, 10).cast("string")))
        return F.concat(head, F.when(F.length(norm) > F.length(head), F.array_join(fresh, "")).otherwise(F.lit("")), _wider(stream, attempt, "0123456789"))

    return _let(plus, rest)


def _new_card(stream: Column, norm: Column, attempt: Column) -> Column:
    """The first digit stays; the last makes the number valid just if it was."""
    n = F.length(norm)
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.array_join(F.transform(F.sequence(F.lit(2), n - 1), lambda i: _nth(stream, i, 10).cast("string")), ""), _wider(stream, attempt, "0123456789"))

    def closed(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        last = _let(check, lambda c: F.when(F.pmod(_luhn(norm), F.lit(10)) == 0, c).otherwise(F.pmod(c + 1 + _nth(stream, 71, 9), F.lit(10))))
        return F.concat(body, last.cast("string"))

    return _let(body, closed)


def _new_email(key: Column, stream: Column, norm: Column, attempt: Column) -> Column:
    """Of the domain the last label stays, and a reserved example domain; the rest is the same for all its addresses."""

    def with_tail(domain: Column, tail: Column) -> Column:
        host = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
        fresh = _let(host, lambda h: F.when(F.length(h) > 0, _let(_stream(key, F.lit("domain"), h), lambda st: _letters(st, h))).otherwise(h))
        return F.concat(_letters(stream, F.regexp_extract(norm, "^([^@]*)@", 1)), _wider(stream, attempt, ALPHABETS["latin"]), F.lit("@"), fresh, tail)

    def with_domain(domain: Column) -> Column:
        tail = F.when(domain.rlike(r"(?:^|\.)example\.\p{L}+$"), F.regexp_extract(domain, r"(\.?example\.\p{L}+)$", 1)).otherwise(F.regexp_extract(domain, r"(\.\p{L}+)$", 1))
        return _let(tail, lambda t: with_tail(domain, t))

    return _let(F.regexp_extract(norm, "@(.*)$", 1), with_domain)


def _new_ip(stream: Column, norm: Column, attempt: Column) -> Column:
    """A private network's head stays while it has room, then comes the largest private network; other addresses get another public one."""
    part = lambda k, low, n: (_nth(stream, k, n) + low).cast("string")
    private = F.regexp_extract(norm, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 1)
    private = F.when((private == "") | (attempt <= PLAIN), private).when(attempt <= PUBLIC, F.lit("10.")).otherwise(F.lit(""))
    public = F.concat(F.when(_nth(stream, 0, 2) == 0, part(1, 11, 89)).otherwise(part(1, 193, 30)), F.lit("."))
    left = lambda head: 4 - F.length(F.regexp_replace(head, "[^.]", ""))
    tail = F.array(part(2, 1, 254), part(3, 1, 254), part(4, 1, 254))
    return _let(_let(private, lambda own: F.when(own != "", own).otherwise(public)), lambda head: F.concat(head, F.array_join(F.slice(tail, F.lit(1), left(head)), ".")))


def _new_ssn(stream: Column, attempt: Column) -> Column:
    return F.concat(F.lpad((_nth(stream, 0, 899) + 1).cast("string"), 3, "0"), F.lpad((_nth(stream, 1, 99) + 1).cast("string"), 2, "0"), F.lpad((_nth(stream, 2, 4000) + 1).cast("string"), 4, "0"), _wider(stream, attempt, "0123456789"))


def _by_script(value: Column, options: dict[str, Column]) -> Column:
    return _choose({s: options[s] for s in ("cyrillic", "greek", "latin")}, _script(value))


def new_initial(key: Column, letter: Column) -> Column:
    """The first letter, in upper case, of all surrogates of given names with this first letter."""
    alphabet = _by_script(letter, {k: F.lit(v) for k, v in ALPHABETS.items()})
    return _let(_stream(key, F.lit("initial"), F.lower(letter)), lambda st: F.upper(_let(alphabet, lambda al: F.substr(al, _nth(st, 0, F.length(al)) + 1, F.lit(1)))))


def _new_word(key: Column, kind: Column, stream: Column, norm: Column, attempt: Column) -> Column:
    """A family name of four syllables, or a given name of two and its gender's ending; a syllable more with each attempt."""
    syllables = _by_script(norm, {k: F.array(*map(F.lit, v)) for k, v in SYLLABLES.items()})
    made = lambda n: _let(syllables, lambda w: F.array_join(F.transform(F.sequence(F.lit(1), n + attempt), lambda i: F.element_at(w, _nth(stream, i, 16) + 1)), ""))
    of = lambda g: _by_script(norm, {k: F.array(*map(F.lit, v[g])) for k, v in ENDINGS.items()})
    ending = F.element_at(_choose({"given:f": of("f"), "given:m": of("m"), "given:n": of("n")}, kind), _nth(stream, 0, 4) + 1)
    # The syllable after an initial loses its own first letter, so that a vowel follows it.
    given = F.concat(new_initial(key, F.substr(norm, F.lit(1), F.lit(1))), F.substr(made(2), F.lit(2)), ending)
    return F.when(kind == "family", F.initcap(made(4))).otherwise(given)


def canonical(key: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, itself in normal form."""

    def by_kind(stream: Column) -> Column:
        iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _letters(stream, F.substr(norm, F.lit(3))), _wider(stream, attempt, "0123456789"))
        made = {"email": _new_email(key, stream, norm, attempt), "ip": _new_ip(stream, norm, attempt), "iban": iban, "phone": _new_phone(stream, norm, attempt), "card": _new_card(stream, norm, attempt), "ssn": _new_ssn(stream, attempt), "word": _new_word(key, kind, stream, norm, attempt)}
        return _choose(made, kind)

    return _let(_stream(key, kind, norm, attempt.cast("string")), by_kind)


def in_format(kind: Column, value: Column, surrogate: Column) -> Column:
    """A normal-form surrogate written the way ``value`` is; what a widened one has more stands at its end."""

    def written(s: Column) -> Column:
        spaced = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(s, F.length(F.replace(F.substr(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
        return (
            F.when(kind.isin("phone", "card", "ssn"), F.concat(_woven(value, _digits(s)), F.substr(_digits(s), F.length(_digits(value)) + 1)))
            .when(kind == "iban", F.concat(spaced, F.substr(s, F.length(F.replace(value, F.lit(" "), F.lit(""))) + 1)))
            .when((kind == "email") & (value == F.upper(value)), F.upper(s)).otherwise(s)
        )

    return _let(surrogate, written)


def _found(text: Column, pattern: Column) -> Column:
    """Array of (kind, value, norm) of a text's entities in order."""

    def one(v: Column) -> Column:
        return _let(kind_of(v), lambda kind: F.struct(kind.alias("kind"), v.alias("value"), normal_form(kind, v).alias("norm")))

    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), one)


def _norms(found: Column, words: Column) -> Column:
    """The distinct (kind, norm) of a text's entities: names by their words."""
    plain = F.transform(F.filter(found, lambda x: x["kind"] != "name"), lambda x: F.struct(x["kind"].alias("kind"), x["norm"].alias("norm")))
    return F.array_distinct(F.concat(plain, words))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, norm): the distinct entities of the corpus."""
    t = F.col("t")
    hinted = docs.select(F.col(text_col).alias("t")).withColumn("n", t.rlike(NAME_HINT)).filter(F.col("n") | t.rlike(HINT))
    return hinted.select(F.explode(_norms(_found(t, F.lit(ANY)), name_words(t, F.col("n")))).alias("e")).select("e.kind", "e.norm").distinct()


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate isn't free; ``found`` should be a written table."""
    k = F.lit(key)
    made = lambda t: t.withColumn("s", canonical(k, F.col("kind"), F.col("norm"), F.col("attempt")))
    now = _store.materialise(made(found.select("kind", "norm", F.lit(0).alias("attempt"))), "surrogates")
    while True:  # each attempt widens the formats that lack room, so the rest shrinks to nothing
        # An entity whose surrogate has settled comes before one that tries again.
        w = Window.partitionBy("kind", "s").orderBy("attempt", "norm")
        taken = found.select("kind", F.col("norm").alias("s"))
        marked = now.withColumn("_no", F.row_number().over(w)).join(taken.withColumn("_real", F.lit(True)), ["kind", "s"], "left")
        bad = F.coalesce(F.col("_real"), F.lit(False)) | (F.col("_no") > 1)
        marked = _store.materialise(marked.select("kind", "norm", "attempt", "s", bad.alias("bad")), "marked")
        if not marked.filter("bad").take(1):
            out = _store.materialise(marked.filter("attempt > 0").select("kind", "norm", "attempt"), "collisions")
            _store.drop(now, marked)
            return out
        again = made(marked.filter("bad").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        later = _store.materialise(marked.filter("not bad").select(*now.columns).unionByName(again.select(*now.columns)), "surrogates")
        _store.drop(now, marked)
        now = later


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", chars_col: str | None = "n_chars", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced; ``chars_col``, if there, follows the text, ``count_col`` gets the number of replaced places.

    ``key`` is a secret of the caller's: with another key all surrogates are others.
    """
    if not key:
        raise ValueError("a key is needed")
    known = _store.materialise(entities(docs, text_col), "entities")
    more = collisions(known, key)
    _store.drop(known)
    e, h, m, f, n, s, w, p = (_store.free_name(docs, x) for x in ("_e", "_hinted", "_map", "_fingerprint", "_named", "_surrogates", "_words", "_pattern"))
    text = F.col(text_col)
    marked = docs.withColumn(n, F.coalesce(text.rlike(NAME_HINT), F.lit(False))).withColumn(h, F.col(n) | F.coalesce(text.rlike(HINT), F.lit(False)))

    def searched(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(w, name_words(text, F.col(n))).withColumn(p, pattern_of(F.col(w)))
        return rows.withColumn(e, F.when(F.col(h), _found(text, F.col(p))).otherwise(F.array().cast("array<struct<kind:string,value:string,norm:string>>")))

    if more.take(1):
        # Few entities try again: the documents that hold them get a map of their attempts. Equal texts share it.
        plain, full = marked.filter(~F.col(h)), searched(marked.filter(h)).withColumn(f, F.sha2(text, 256))
        held = full.filter(F.size(e) > 0).select(f, F.explode(_norms(F.col(e), F.col(w))).alias("x")).select(f, "x.kind", "x.norm").distinct().join(more, ["kind", "norm"])
        maps = held.groupBy(F.col(f).alias(m + "_f")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias(m))
        full = full.join(maps, F.col(f) == F.col(m + "_f"), "left").drop(f, m + "_f")
        attempt = lambda kind, norm: F.coalesce(F.col(m)[F.concat_ws("|", kind, norm)], F.lit(0))
    else:
        _store.drop(more)
        plain, full = None, searched(marked)
        attempt = lambda kind, norm: F.lit(0)
    made = lambda kind, norm: canonical(F.lit(key), kind, norm, attempt(kind, norm))

    def part(t: Column) -> Column:
        """A particle as it is, an initial, or a known word's surrogate."""
        own = F.filter(F.col(w), lambda x: x["norm"] == t)
        return F.when(t.rlike(r"^\p{Lu}\.$"), F.concat(new_initial(F.lit(key), F.substr(t, F.lit(1), F.lit(1))), F.lit("."))).when(F.size(own) > 0, F.element_at(F.transform(own, lambda x: made(x["kind"], x["norm"])), 1)).otherwise(t)

    def put(x: Column) -> Column:
        between = F.regexp_extract(x["value"], rf"^{_TITLES}*", 0)
        named = F.concat(between, F.array_join(F.transform(_parts(x["value"]), part), " "))
        return F.when(x["kind"] == "name", named).otherwise(in_format(x["kind"], x["value"], made(x["kind"], x["norm"])))

    full = full.withColumn(s, F.transform(e, put))
    gaps = F.split(text, F.col(p), -1)
    woven = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(e)), F.col(s), lambda g, x: F.concat(g, x)), ""), F.element_at(gaps, -1))
    full = full.withColumn(text_col, F.when(F.size(e) > 0, woven).otherwise(text))
    if chars_col and chars_col in docs.columns:
        full = full.withColumn(chars_col, F.when((F.size(e) > 0) & F.col(chars_col).isNotNull(), F.char_length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    counted = [F.size(e).alias(count_col)] if count_col else []
    full = full.select(*docs.columns, *counted)
    return full if plain is None else plain.select(*docs.columns, *[F.lit(0).alias(c) for c in [count_col] if c]).unionByName(full)


def setting_key(spark: SparkSession) -> str:
    """The key from the session's settings; the given tables are synthetic and do without one."""
    return spark.conf.get(KEY_SETTING, SYNTHETIC_KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, setting_key(spark), count_col="n_entities")
