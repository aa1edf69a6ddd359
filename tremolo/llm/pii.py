"""Surrogates for personal data: keyed, of the same kind and format, in SQL functions only."""

from __future__ import annotations

import secrets
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm.base import Workspace

#: Honorifics that announce a name, with the gender they tell.
MALE = "Mr|Herr|Señor|Sr|Don|Monsieur|Sir|Lord"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Doña|Madame|Mme|Lady"
EITHER = "Dr|Prof|Professor"
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![\p{N}.])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![\p{N}.])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
    "ip": r"(?<![\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{N}]|\.[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "secret": r"(?<![\p{L}\p{N}_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{24,}(?![\p{L}\p{N}_-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{EITHER})\.? {_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have to hold any of these at all.
SCREEN = rf"[0-9@]|(?:{MALE}|{FEMALE}|{EITHER})\.? \p{{Lu}}"
FIRST_MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary".split()
FIRST_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia".split()
START = "Ba Be Bo Bra Ca Co Da De Do Fa Fe Ga Go Ha He Ho Ja Jo Ka Ke La Le Lo Ma Me Mo Na Ne Pa Pe Ra Re Ro Sa Se So Ta Te Va We".split()
MIDDLE = "ber den der dil gan gar ker lan len lin lor man mer mon nar ner rin ron sel ser ten ter tin tor van ver vin wen win zel".split()
END = "by dale den ford ham holm ler ley man mann more ney ridge sen ser son ston ton ville well wick wood worth".split()
#: Attempts that keep the length of values other than names; from then on surrogates grow with each attempt.
SAME_LENGTH = 4


def _kind(x: Column) -> Column:
    """Which pattern a found string fits, in their order; the name pattern is what is left."""
    out = F.lit("name")
    for kind, p in reversed([*PATTERNS.items()][:-1]):
        out = F.when(x.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _number(h: Column, at: int | Column, n: int) -> Column:
    """n hex digits of the hash from position at, as a number."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(h.substr(start.cast("int"), F.lit(n)), 16, 10).cast("bigint")


def _shape(x: Column, h: Column) -> Column:
    """Each letter or digit of x becomes one of its own script and case; other characters stay."""

    def char(c: Column, i: Column) -> Column:
        n = _number(h, F.pmod(i * 3, F.lit(124)), 4) + i
        letters = F.when(x.rlike("^[0-9a-f]+$"), 6).otherwise(26)  # hexadecimal stays so
        code = F.when(c.between("0", "9"), 48 + n % 10).when(c.between("a", "z"), 97 + n % letters).when(c.between("A", "Z"), 65 + n % 26).when(c.between("а", "я"), 1072 + n % 32).when(c.between("А", "Я"), 1040 + n % 32).when(c.between("α", "ω"), 945 + n % 17).when(c.between("Α", "Ω"), 913 + n % 17)
        accented = F.when(F.lower(c) != c, 65 + n % 26).when(F.upper(c) != c, 97 + n % 26)
        new = F.coalesce(code, accented)
        # chr() ends at 255; other scripts come from tables.
        return F.when(new.isNull(), c).when(new < 256, F.char(new)).when(new >= 1040, F.substring(F.lit("".join(map(chr, range(1040, 1104)))), (new - 1039).cast("int"), 1)).otherwise(F.substring(F.lit("".join(map(chr, range(913, 970)))), (new - 912).cast("int"), 1))

    return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), char), "")


def _luhn(x: Column) -> Column:
    """x with its last digit set so that the digits have a valid check sum."""
    digits = F.filter(F.split(x, ""), lambda c: c.between("0", "9"))
    body = F.reverse(F.slice(digits, 1, F.size(digits) - 1))
    double = lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))
    total = F.aggregate(F.transform(body, double), F.lit(0), lambda a, b: a + b)
    return F.concat(x.substr(F.lit(1), F.length(x) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def surrogate(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The keyed replacement of an atom; each attempt gives another.

    Names grow by a syllable an attempt, and other values by a letter or digit after SAME_LENGTH
    attempts, so that the room for them grows faster than any number of values that clash.
    """
    h = F.sha2(F.concat_ws("\x00", F.lit(secret), kind, value, attempt.cast("string")), 512)
    octet = lambda at: (1 + _number(h, at, 4) % 254).cast("string")
    tail = F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0)
    head = value.substr(F.lit(1), F.length(value) - F.length(tail))
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = value.substr(F.length(code) + 1, F.length(value))
    more = F.when(attempt > 0, _pick(MIDDLE, _number(h, 20, 6))).otherwise("")
    latin = value.rlike(r"^[\p{IsLatin}'’-]+$")
    syllables = F.array_join(F.transform(F.when(attempt > 1, F.sequence(F.lit(2), attempt)).otherwise(F.array().cast("array<int>")), lambda i: _pick(MIDDLE, _number(h, 36 + F.pmod(i * 6, F.lit(84)), 6))), "")
    longer = F.greatest(attempt - (SAME_LENGTH - 1), F.lit(0))
    letters = F.translate(h, "0123456789", "ghijklmnop").substr(F.lit(1), longer)
    digits = F.translate(h, "abcdef", "012345").substr(F.lit(1), longer)
    last = F.concat(_pick(START, _number(h, 0, 6)), _pick(MIDDLE, _number(h, 6, 6)), more, syllables, _pick(END, _number(h, 12, 6)))
    first = lambda names: F.concat(_pick(names, _number(h, 0, 6)), F.when(attempt > 0, F.concat(F.lit("-"), _pick(names, _number(h, 30, 6)))).otherwise(""), F.when(attempt > 1, F.concat(F.lit("-"), _pick(START, _number(h, 24, 6)), syllables)).otherwise(""))
    name = F.when(~latin, _shape(F.concat(value, F.repeat(F.lower(value.substr(1, 1)), longer)), h)).when(kind == "male", first(FIRST_MALE)).when(kind == "female", first(FIRST_FEMALE)).when(kind == "given", first(FIRST_MALE + FIRST_FEMALE)).otherwise(last)
    return (
        F.when(kind == "email", F.concat(letters, _shape(head, h), tail))
        .when(kind == "ip", F.concat(F.concat_ws(".", *(octet(i) for i in (0, 8, 16, 24))), digits))
        .when(kind == "phone", F.concat(code, _shape(rest, h), digits))
        .when(kind == "card", _luhn(F.concat(value.substr(1, 1), _shape(value.substr(F.lit(2), F.length(value)), h), digits)))
        .when(kind == "iban", F.concat(value.substr(1, 2), _shape(value.substr(F.lit(3), F.length(value)), h), digits))
        .when(kind.isin("ssn", "secret"), F.concat(_shape(value, h), digits))
        .otherwise(name)
    )


def _atoms(x: Column) -> Column:
    """The parts of a found string that are replaced: itself, or each word of a name by its role."""
    kind = _kind(x)
    parts = F.split(x, " ")
    title = F.regexp_replace(parts[0], r"\.$", "")
    given = F.when(title.rlike(f"^(?:{MALE})$"), "male").when(title.rlike(f"^(?:{FEMALE})$"), "female").otherwise("given")
    n = F.size(parts)
    named = F.transform(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda w, i: F.struct(F.when((i < n - 2), given).otherwise("surname").alias("kind"), w.alias("value")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), x.alias("value"))))


def surrogates(atoms: DataFrame, secret: str, ws: Workspace) -> DataFrame:
    """(kind, value, new) for the distinct (kind, value) of atoms: all new values of a kind differ.

    A new value that is also a value of the corpus, or that another value has already, is tried again
    with the next attempt, which has more room. Only the values that clash take part in a further round.
    """
    known = ws.save(atoms.select("kind", "value").distinct(), "known")
    done: list[DataFrame] = []
    left = known
    for i in count():
        tried = left.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.lit(i), secret).alias("new"))
        real = known.select("kind", F.col("value").alias("new"))
        free = tried.join(real, ["kind", "new"], "left_anti")
        if done:
            free = free.join(reduce(DataFrame.unionByName, done).select("kind", "new"), ["kind", "new"], "left_anti")
        won = free.groupBy("kind", "new").agg(F.min("value").alias("value")).select("kind", "value", "new")
        won = ws.save(won, f"won{i}")
        done.append(won)
        left = ws.save(left.join(won, ["kind", "value"], "left_anti"), f"left{i}")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


#: The session setting that holds the key. Where it is unset, each application draws one at random.
SECRET = "spark.tremolo.surrogates.key"
_DRAWN: dict[str, str] = {}


def session_secret(spark: SparkSession) -> str:
    """The key of the session: set it to get the same surrogates again, keep it to keep them unlinkable."""
    set_to = spark.conf.get(SECRET, None) or spark.sparkContext.getConf().get(SECRET)
    return set_to or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def replace_pii(docs: DataFrame, *, text: str = "text", secret: str | None = None, count: str | None = None) -> DataFrame:
    """The rows and columns of docs with every found entity of the text replaced; count names a new
    column for their number.

    Found are e-mail addresses, phone numbers, IPv4 addresses, IBANs, card and social security
    numbers, secrets of 24 characters or more, and names after an honorific. One value has one
    surrogate in all texts, different values of a kind have different ones, and none is itself a
    value of the input. A surrogate has the format of what it replaces: digits and letters of each
    script and case stay such, phones keep their country code, addresses their last label, cards keep
    their first digit and get a valid check digit; given names keep the gender that the honorific tells, and a surname is
    replaced alike with or without a given name. There is no limit to the number of values: where
    those of one format use it up, surrogates of it become longer. The key is ``secret``, or else the
    session's (see SECRET): with another key, all surrogates are others.

    Null texts stay null; texts without entities stay as they are. Repeated rows stay. Columns keep
    their names and order, whatever they are called; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    columns = docs.columns
    t = F.col(f"`{text}`")
    # Only rows with an entity meet their surrogates; the others pass without a shuffle.
    hit = F.coalesce(t.rlike(SCREEN) & t.rlike(ANY), F.lit(False))
    hits = docs.where(hit).withColumn("_pii_row", F.md5(t))
    ents = hits.select("_pii_row", F.regexp_extract_all(t, F.lit(f"({ANY})"), 1).alias("ents")).groupBy("_pii_row").agg(F.first("ents").alias("ents"))
    ents = ws.save(ents, "ents")
    atoms = ents.select("_pii_row", F.posexplode("ents").alias("i", "ent")).select("_pii_row", "i", F.posexplode(_atoms(F.col("ent"))).alias("j", "a")).select("_pii_row", "i", "j", "a.kind", "a.value")
    atoms = ws.save(atoms, "atoms")
    table = surrogates(atoms, secret or session_secret(docs.sparkSession), ws)
    made = atoms.join(table, ["kind", "value"]).groupBy("_pii_row").agg(F.array_sort(F.collect_list(F.struct("i", "j", "new", "kind"))).alias("made"))
    one = F.transform("ents", lambda e, i: F.concat(F.when(F.filter("made", lambda m: m["i"] == i)[0]["kind"].isin("male", "female", "given", "surname"), F.concat(F.split(e, " ")[0], F.lit(" "))).otherwise(""), F.array_join(F.transform(F.filter("made", lambda m: m["i"] == i), lambda m: m["new"]), " ")))
    subs = ws.save(ents.join(made, "_pii_row").select("_pii_row", one.alias("_pii_subs")), "subs")
    whole = F.array_join(F.zip_with(F.split(t, ANY), F.col("_pii_subs"), lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    cols = lambda new: [new.alias(c) if c == text else F.col(f"`{c}`") for c in columns]
    number = lambda n: [n.alias(count)] if count else []
    replaced = hits.join(subs, "_pii_row").select(*cols(whole), *number(F.size("_pii_subs")))
    return docs.where(~hit).select(*cols(t), *number(F.lit(0))).unionByName(replaced)
