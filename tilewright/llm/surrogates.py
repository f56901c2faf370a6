"""Surrogate generation for personal data and secrets. DataFrame and SQL functions only.

Entities are found by one pattern; each mention has a type and a canonical form (lower case, or digits only), which stands for the entity in all
documents. A surrogate is derived from an HMAC-SHA256 of type and canonical form under a key that the caller must give: digits become digits and letters
letters of the same case and script, separators stay where they are, so a mention keeps its format. Without the key, nobody can find a number by trying all.

Names are found after a title, and then, in the same text, wherever their words stand without one ("Mr. John Smith ... John Smith ... Smith"). A name's
words are entities of their own, given names and family names, so one family keeps one name whatever the title, and partial mentions agree with whole
ones. In a pair the first word is the given name; a word alone is the family name, unless the text shows it as a given name only. Given names keep the
gender that their title tells (titles like Dr tell none; then the gender that any text tells for this name, else either), and the script of Latin, Cyrillic
or Greek; names of other scripts become Latin. Upper-case words and names without any title in their text aren't found.

Collision checks: the surrogates of all entities of all types are compared with each other and with all entities found; where two entities meet, the first
keeps it and the others, and any that equals a real entity, try again with the next attempt, until none is left. So different entities stay different,
and one entity is replaced alike everywhere. A format has finitely many surrogates, so from attempt SAME_FORMAT on they grow by one part an attempt:
names by a syllable, local parts by a letter, all others by a digit (addresses in a part of their own). So any number of entities gets some, and the
loop ends. Checks and replacement are joins; no table of entities is broadcast or collected.

Cases: null text stays null; text without entities is returned unchanged, to the byte; other columns pass through, whatever their names; repeated rows
get equal results; an empty table gives an empty result; nested candidates go to the leftmost, then to the first type of the pattern. A text is one
value of one task, as everywhere in Spark's built-in functions: it needs a few times its size there.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.shared import free_name, stage_table

#: Session setting with the key of the registered queries, and the key where it is unset (tests): whoever publishes surrogates must set one.
KEY_SETTING, TEST_KEY = "spark.tilewright.surrogateKey", "not a secret"
SAME_FORMAT = 3

#: By gender; those of "n" tell none.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Sir", "Lord", "господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Lady", "госпожа", "κυρία"),
    "n": ("Dr", "Doctor", "Prof", "Professor", "Rev", "доктор", "профессор", "Δρ"),
}
_ANY_TITLE = "|".join(t for group in TITLES.values() for t in group)
#: A word of a name, as in O'Brien, Doe-Roe; what follows an apostrophe in lower case isn't part of it.
_WORD = r"\p{Lu}(?:\p{L}|(?<=\p{Lu})['’](?=\p{Lu}))+(?:-\p{L}+)*"
#: A cheap look at the first letter fails nearly everywhere, before the alternatives are tried.
_TITLE = f"(?=[{''.join(sorted({t[0] for group in TITLES.values() for t in group}))}])(?:{_ANY_TITLE})"
_TITLED = rf"(?:{_TITLE}\.? )+"
_ASSIGNED = r"(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
#: What a mention looks like, by type, in the order in which types are tried. Secrets and names include what introduces them, which stays.
PATTERNS = {
    "secret": rf"(?=[PpSsTtAa])(?i:{_ASSIGNED})(?=[^\s\"']*\d)[A-Za-z0-9+/_.~!$^-]{{8,}}",
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
    "cloud_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "service_key": r"(?:sk-|ghp_|gho_|xox[bp]-)[A-Za-z0-9-]{16,}",
    "hex": r"[0-9a-f]{32,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})",
    "name": rf"{_TITLED}{_WORD}(?: {_WORD})?",
}
#: No mention begins or ends inside a longer word or number.
_AROUND = {
    **{t: (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") for t in ("cloud_key", "service_key", "hex", "iban")},
    "secret": ("", ""), "email": (r"(?<![A-Za-z0-9._%+-])", ""), "ip": (r"(?<![\d.])", r"(?!\.?\d)"), "phone": (r"(?<![\d+])", r"(?!\d)"), "ssn": (r"(?<![\d-])", r"(?![\d-])"), "card": (r"(?<!\d)", r"(?!\d)"),
    "name": (r"(?<!\p{L})", r"(?![\p{L}\p{N}])"),
}
PATTERN = "|".join(f"{_AROUND[t][0]}(?:{p}){_AROUND[t][1]}" for t, p in PATTERNS.items())
#: What every match has in it; a cheap test that most texts fail.
HINT = rf"[0-9@]|(?:AKIA|ASIA)[A-Z]|(?:sk-|ghp_|gho_|xox[bp]-)[A-Za-z]|(?<![A-Za-z0-9])[a-f]{{32}}|{_TITLE}\.? \p{{Lu}}"
NAME = f"{_AROUND['name'][0]}(?:{PATTERNS['name']}){_AROUND['name'][1]}"
FILLED = ("phone", "ssn", "card", "iban")
NAME_TYPES = ("given_m", "given_f", "given_n", "family")

#: Syllables of invented names: by script, given names' last syllables by gender, and the middle and last ones of family names.
SYLLABLES = {
    "latin": {"start": "Al Ben Cor Dan El Fer Gal Har Jor Kel Lor Mar Nor Or Per Ral Sal Tam Ver Wil".split(), "m": "an ard en ric o us in ald".split(), "f": "a ina elle ette ia essa ine ora".split(), "end": "berg dale field ford ham land ley man mond ner ridge son stein ton ville wick worth wood".split()},
    "cyrillic": {"start": "Ал Бор Вол Гор Дан Ер Жар Зор Ив Кол Лар Мар Ник Ор Пав Рад Сер Тар Фед Яр".split(), "m": "ан ей ир ис о он ий ем".split(), "f": "а ина ия ена ара она ета ика".split(), "end": "ов ев ин ский енко ович ян цев ков лов нов тов".split()},
    "greek": {"start": "Αλ Βασ Γερ Δημ Ελ Ζην Ηρ Θε Ιων Καλ Λεω Μαρ Νικ Ορ Παν Ραλ Σταυ Τιμ Φιλ Χαρ".split(), "m": "ας ης ος ων ιος εας ις υς".split(), "f": "α η ια ινα ουλα ω ιδα ανα".split(), "end": "ακης ίδης όπουλος ιάδης έλης ίνος άτος ούσης".split()},
}


def _type(mention: Column) -> Column:
    """The type of a mention; words of names without a title are "bare"."""
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()], F.when(mention.rlike(rf"^{_WORD}(?: {_WORD})?$"), F.lit("bare")), F.lit("hex"))


def _kept(kind: Column, mention: Column) -> Column:
    """What introduces the entity and stays: an assignment, or titles."""
    return F.when(kind == "secret", F.regexp_extract(mention, rf"^(?i:{_ASSIGNED})", 0)).when(kind == "name", F.regexp_extract(mention, rf"^{_TITLED}", 0)).otherwise("")


def _names(text: Column) -> Column:
    """(gender, words) of the names after titles in a text; empty for most texts, after a cheap test."""
    one = lambda m: F.struct(_gender(m).alias("gender"), F.split(F.regexp_replace(m, rf"^{_TITLED}", ""), " ").alias("words"))
    return F.when(text.rlike(rf"{_TITLE}\.? \p{{Lu}}"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), one)))


def _gender(mention: Column) -> Column:
    of = lambda group: mention.rlike(rf"^(?:(?:{_ANY_TITLE})\.? )*(?:{'|'.join(TITLES[group])})\.? ")
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def _pattern(names: Column) -> Column:
    """The pattern of a text: where it names somebody, the words of those names alone or in pairs are mentions too."""
    words = F.array_distinct(F.flatten(F.transform(names, lambda x: x["words"])))
    longest_first = F.array_join(F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), lambda x: x["w"]), "|")
    one = F.concat(F.lit("(?:"), longest_first, F.lit(")(?![\\p{L}\\p{N}])"))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])"), one, F.lit("(?: "), one, F.lit(")?"))).otherwise(PATTERN)


def _parts(kind: Column, entity: Column, names: Column) -> Column:
    """(k, type, canonical) of the words of a name mention; of any other mention, itself."""
    words = F.split(entity, " ")
    pairs = F.filter(names, lambda x: F.size(x["words"]) > 1)
    given = F.transform(pairs, lambda x: x["words"][0])
    family = F.concat(F.transform(pairs, lambda x: x["words"][1]), F.transform(F.filter(names, lambda x: F.size(x["words"]) == 1), lambda x: x["words"][0]))
    last_of_pair = F.transform(pairs, lambda x: x["words"][1])

    def one(w: Column, k: Column) -> Column:
        genders = F.transform(F.filter(pairs, lambda x: x["words"][0] == w), lambda x: x["gender"])
        told = F.when(F.array_contains(genders, "m"), "m").when(F.array_contains(genders, "f"), "f").otherwise("n")
        alone = F.array_contains(given, w) & ~F.array_contains(F.when(kind == "name", last_of_pair).otherwise(family), w)
        first = F.when(kind == "name", k == 0).otherwise(F.array_contains(given, w) & ((k == 0) | ~F.array_contains(family, w)))
        is_given = F.when(F.size(words) == 1, alone).otherwise(first)
        return F.struct(k.alias("k"), F.when(is_given, F.concat(F.lit("given_"), told)).otherwise("family").alias("type"), w.alias("canonical"))

    whole = F.array(F.struct(F.lit(0).alias("k"), kind.alias("type"), _canonical(kind, entity).alias("canonical")))
    return F.when(kind.isin("name", "bare"), F.transform(words, one)).otherwise(whole)


def _canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share. A phone's country code is set apart by a space."""
    digits = F.regexp_replace(entity, r"\D", "")
    code = F.regexp_extract(entity, r"^\+(\d{1,3})(?=\D)", 1)
    phone = F.when(F.length(code) > 0, F.concat(F.lit("+"), code, F.lit(" "), F.substring(digits, F.length(code) + 1, F.length(digits)))).otherwise(digits)
    return F.when(kind == "phone", phone).when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(entity)).otherwise(entity)


def _byte(stream: Column, i) -> Column:
    at = F.lit(2 * i + 1) if isinstance(i, int) else 2 * i + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _stream(key: str, *parts: Column, size: Column) -> Column:
    """Keyed hash output as hexadecimal digits, two for each of `size` characters."""
    seed = F.concat_ws("\x1f", *parts)
    blocks = F.sequence(F.lit(0), F.floor(size / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: _hmac(key, F.concat_ws("\x1f", seed, b.cast("string")))), "")


def _pick(choices: list[str], value: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), value % len(choices) + 1)


def _mapped(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each digit and ASCII letter replaced by another of its kind, letters of a hexadecimal number by such; the rest as it is."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(stream, i)
        letter = lambda first: F.char(F.lit(first) + v % F.when(hexadecimal, 6).otherwise(26))
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _invented_name(kind: Column, canonical: Column, stream: Column, more: int) -> Column:
    """A given or family name in the script of the canonical one, `more` syllables longer than usual."""

    def of(script: str) -> Column:
        part = SYLLABLES[script]
        low = [s.lower() for s in part["start"]]
        longer = [_pick(low, _byte(stream, 5 + k)) for k in range(more)]
        family = F.concat(_pick(part["start"], _byte(stream, 2)), _pick(low, _byte(stream, 3)), *longer, _pick(part["end"], _byte(stream, 4)))
        given = lambda ends: F.concat(_pick(part["start"], _byte(stream, 0)), *longer, _pick(ends, _byte(stream, 1)))
        return F.when(kind == "given_m", given(part["m"])).when(kind == "given_f", given(part["f"])).when(kind == "given_n", given(part["m"] + part["f"])).otherwise(family)

    return F.when(canonical.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canonical.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _surrogate(kind: Column, canonical: Column, attempt: int, key: str) -> Column:
    size = F.length(canonical)
    more = max(0, attempt - SAME_FORMAT + 1)
    stream = _stream(key, kind, canonical, F.lit(str(attempt)), size=size + (5 + more if more else 0))
    further = lambda choices: [_pick(list(choices), _byte(stream, size + k)) for k in range(more)]
    mapped = _mapped(canonical, stream, kind.isin("hex") | ((kind == "secret") & canonical.rlike("^[0-9a-f]+$")))
    octets = F.concat_ws(".", *[(1 + _byte(stream, i) % 254).cast("string") for i in range(4)])
    domain = F.substring_index(canonical, "@", -1)
    of_domain = _stream(key, F.lit("domain"), domain, size=F.lit(16))
    letters = F.translate(F.substring(of_domain, 1, 10), "0123456789", "ghijklmnop")
    email = F.concat(_mapped(F.substring_index(canonical, "@", 1), stream, F.lit(False)), *further("abcdefghijklmnopqrstuvwxyz"), F.lit("@"), letters, F.lit(".example."), _pick(["com", "net", "org"], _byte(of_domain, 12)))
    keep = lambda n: F.concat(F.substring(canonical, F.lit(1), n), F.substring(mapped, n + 1, size))
    code = F.length(F.regexp_extract(canonical, r"^\+\d+ ", 0))
    phone = F.concat(F.substring(canonical, F.lit(1), code), (2 + _byte(stream, 0) % 8).cast("string"), F.substring(mapped, code + 2, size))
    made = (
        F.when(kind == "phone", phone).when(kind == "card", keep(F.lit(1))).when(kind == "ssn", F.concat(F.lit("9"), F.substring(mapped, F.lit(2), size)))
        .when(kind == "cloud_key", keep(F.lit(4))).when(kind == "iban", keep(F.lit(2))).when(kind == "service_key", keep(F.length(F.regexp_extract(canonical, r"^[a-z]+[-_]", 0))))
        .otherwise(mapped)
    )
    grown = F.concat(made, *further("0123456789")) if more else made
    octets = F.concat(octets, F.lit("."), *further("0123456789")) if more else octets
    return (
        F.when(kind == "ip", octets).when(kind == "email", email)
        .when(kind.isin(*NAME_TYPES), _invented_name(kind, canonical, stream, more)).otherwise(grown)
    )


def _rendered(kind: Column, entity: Column, canonical: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention: its separators, and upper case if the address is all upper case. What it has grown by follows at the end."""
    plain = F.regexp_replace(surrogate, r"[+ ]", "")
    empty = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    put = lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["s"], F.substring(plain, acc["k"] + 1, F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    filled = F.aggregate(F.split(entity, ""), empty, put, lambda acc: F.concat(acc["s"], F.substring(plain, acc["k"] + 1, F.length(plain))))
    return F.when(kind.isin(*FILLED), filled).when((kind == "email") & (entity == F.upper(entity)) & (canonical != entity), F.upper(surrogate)).otherwise(surrogate)


def find_mentions(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, pos, k, kept, entity, type, canonical) of every mention, pos counting the matches of a text and k the words of a name."""
    named = docs.select(F.col(row).alias("row"), F.col(text).alias("text"), _names(F.col(text)).alias("names"))
    found = named.select("row", "names", F.posexplode(F.regexp_extract_all("text", _pattern(F.col("names")), F.lit(0))).alias("pos", "mention"))
    typed = found.withColumn("kind", _type(F.col("mention"))).withColumn("kept", _kept(F.col("kind"), F.col("mention")))
    cut = typed.withColumn("entity", F.substring("mention", F.length("kept") + 1, F.length("mention")))
    parts = cut.select("row", "pos", "kept", "entity", F.explode(_parts(F.col("kind"), F.col("entity"), F.col("names"))).alias("part"))
    return parts.select("row", "pos", "part.k", "kept", "entity", "part.type", "part.canonical").distinct()


def resolved(mentions: DataFrame) -> DataFrame:
    """The mentions with given names of unknown gender as those of a known one, where any text tells it for the name."""
    told = mentions.where(F.col("type").isin("given_m", "given_f")).groupBy("canonical").agg(F.max("type").alias("told")).withColumn("type", F.lit("given_n"))
    return mentions.join(told, ["type", "canonical"], "left").withColumn("type", F.coalesce("told", "type")).drop("told")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canonical, surrogate) for distinct (type, canonical): no surrogate twice, and none that is an entity, of whatever type."""
    done: DataFrame | None = None
    left = entities
    known = entities.select(F.col("canonical").alias("surrogate"))
    for attempt in itertools.count():
        tried = left.withColumn("surrogate", _surrogate(F.col("type"), F.col("canonical"), attempt, key))
        first = tried.groupBy("surrogate").agg(F.min(F.struct("type", "canonical")).alias("e"))
        taken = known if done is None else known.unionByName(done.select("surrogate"))
        good = stage_table(first.join(taken, "surrogate", "left_anti").select("e.type", "e.canonical", "surrogate"), "surrogates")
        done = good if done is None else done.unionByName(good)
        rest = stage_table(left.join(good, ["type", "canonical"], "left_anti"), "unresolved")
        if rest.isEmpty():
            return done
        left = rest


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the entities in `text` replaced under the key; count names a column to add: how many mentions a text has."""
    if not key:
        raise ValueError("surrogates need a key")
    columns = docs.columns
    row, reps = free_name(columns, "row_key"), free_name(columns, "replacements")
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    some = docs.where(hinted).withColumn(row, F.md5(F.col(text)))
    mentions = resolved(stage_table(find_mentions(some, row, text), "mentions"))
    table = assign_surrogates(stage_table(mentions.select("type", "canonical").distinct(), "entities"), key)
    met = mentions.join(table, ["type", "canonical"])
    new_part = F.when(F.col("type").isin(*NAME_TYPES), F.col("surrogate")).otherwise(_rendered(F.col("type"), F.col("entity"), F.col("canonical"), F.col("surrogate")))
    made = F.concat(F.when(F.col("k") == 0, F.col("kept")).otherwise(" "), new_part)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "made"))), lambda x: x["made"]), "")
    whole = met.select("row", "pos", "k", made.alias("made")).groupBy("row", "pos").agg(words.alias("made"))
    per_row = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "made"))).alias(reps))
    names = free_name([*columns, row, reps], "names")
    joined = some.join(per_row.withColumnRenamed("row", row), row, "left").withColumn(names, _names(F.col(text)))
    gaps = F.split(F.col(text), _pattern(F.col(names)), -1)
    woven = F.array_join(F.zip_with(gaps, F.col(reps), lambda g, r: F.concat(g, F.coalesce(r["made"], F.lit("")))), "")
    new = F.when(F.col(reps).isNull(), F.col(text)).otherwise(woven)
    extra = [] if count is None else [F.coalesce(F.size(reps), F.lit(0)).alias(count)]
    none = [] if count is None else [F.lit(0).alias(count)]
    own = [new.alias(c) if c == text else F.col(c) for c in columns]
    return joined.select(*own, *extra).unionByName(docs.where(~hinted).select(*columns, *none))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets, or the one for tests."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)
