"""Personal data: keyed surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, phone, card, account and social security
numbers, network addresses, keys, passwords and named persons.  Each entity
is replaced by a surrogate of the same type and format, drawn by a keyed
hash of its canonical value: the same value gets the same surrogate in every
document and notation (coreference), and digits, letters, scripts, separators
and lengths stay as they were.  Card numbers keep their first digit and a
valid Luhn digit, account numbers their country and valid check digits,
addresses move to reserved ranges, social security numbers to the 9xx range.
Names follow the gender of their title and their script; given and family
names are drawn apart, so "Ms Ada Byron" and "Ms Byron" agree.  Mentions
without a title in a text that names the person with one are replaced too:
given and family names of any length between letter boundaries, and Han names
of two characters and more as a whole, family and given name together,
wherever they stand.  Names that are ordinary words (``ORDINARY``: months,
colours and the like) and single Han characters are replaced beside a title
only.  A Han name begins with a family name (``HAN_FAMILY``); inside running
text the one nearest to the title counts.

*Collision checks.*  Surrogates of a type must differ from each other
(distinctness) and from every value of the type that the corpus holds.  All
distinct entities of the corpus form a table; each round counts surrogates
(a combinable count) and joins them with the values, and redraws the losers
with the next attempt number.  After several attempts a draw grows by a
character, so the rounds end even where a format has few values.

*Plan.*  A cheap test leaves most texts alone; they pass through a narrow
filter.  The matches of the other texts are gathered once per distinct text
and written.  Entities join their surrogates by (type, value); the few
replacements of a text come back to it by a hash of the text, so only texts
that hold an entity are shuffled.

*Defined results.*  Null texts stay null, empty texts empty.  Texts are used
whole.  Ids are not used, so null and repeated ids do no harm; repeated rows
get equal results.  Other columns stay as they are.  An empty table gives an
empty result.  Numbers with a wrong check digit are not entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col, fresh
from quire.session import cut_lineage

# Titles by gender, and what follows or precedes a name.
TITLES = {
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Señorita|Signora|госпожа|г-жа|κυρία",
    "m": "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Signor|господин|г-н|κύριος",
    "n": "Dr|Prof",
}
HAN_TITLES = {"f": "女士|小姐", "m": "先生"}
# Common Han family names, of one and of two characters.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤張劉陳楊黃趙吳孫馬羅鄭謝許韓馮鄧蕭葉蘇呂盧鍾譚陸範賈韋鄒閻龍陶賀顧龔萬錢嚴湯"
HAN_FAMILY_2 = "欧阳|司马|上官|诸葛|司徒|东方|独孤|南宫|歐陽|司馬|諸葛|東方|獨孤|南宮"
# Small words inside a family name.
PARTICLES = "van|von|de|der|den|del|della|di|da|du|la|le|ten|ter|zu|zur|dos|das|bin|ibn|al|el"
# Words after a title that make it a role, and names that are
# ordinary words: these are replaced beside a title only.
ROLES = "Developer|Engineer|Manager|Analyst|Architect|Consultant|Director|Designer|Editor|Officer|Scientist|Programmer|Administrator|Universe|World|America|Speaker|Chairman|President|Minister|Secretary"
ORDINARY = (
    "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|"
    "Will|Mark|Bill|Art|Rose|Grace|Hope|Joy|Faith|Dawn|Summer|Autumn|Frank|Grant|Chance|Young|Long|Short|Brown|Black|White|Green|Gray|Grey|King|Prince|"
    "Bishop|Church|Hill|Wood|Woods|Stone|Rivers|Field|Fields|Banks|Bush|Rich|Price|Love|Good|Best|Wise|Swift|Sharp|Strong|Small|Little|Day|Page|Case|Bell"
)
# Letters and syllables from which names and values are drawn.
LETTERS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"\p{IsCyrillic}&&\p{Ll}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsCyrillic}&&\p{Lu}": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"\p{IsGreek}&&\p{Ll}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsGreek}&&\p{Lu}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "安白成丹方高和江康李明南平青荣石天文夏英",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa za zo",
    "cyrillic": "ба ва ве га го да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа ха",
    "greek": "βα γα γε δα δε ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα χα",
    "han": "安 白 成 丹 方 高 和 江 康 李 明 南 平 青 荣 石 天 文 夏 英",
}
# Endings that agree with gender.
ENDINGS = {
    ("latin", "given", "f"): "lia", ("latin", "given", "m"): "ron", ("latin", "given", "n"): "lin", ("latin", "family", "f"): "ner",
    ("latin", "family", "m"): "ner", ("latin", "family", "n"): "ner", ("cyrillic", "given", "f"): "на", ("cyrillic", "given", "m"): "ил",
    ("cyrillic", "given", "n"): "ия", ("cyrillic", "family", "f"): "рова", ("cyrillic", "family", "m"): "ров", ("cyrillic", "family", "n"): "ко",
    ("greek", "given", "f"): "ία", ("greek", "given", "m"): "ος", ("greek", "given", "n"): "ις", ("greek", "family", "f"): "ίδου",
    ("greek", "family", "m"): "ίδης", ("greek", "family", "n"): "άκη",
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
PARTICLE = rf"(?:(?:{PARTICLES}) )"
# a family name and up to two more characters; inside running Han text the
# nearest family name before the title
HAN_NAME = rf"(?=\p{{IsHan}})(?:(?<!\p{{IsHan}})(?:{HAN_FAMILY_2}|[{HAN_FAMILY}])\p{{IsHan}}{{0,2}}?|(?:{HAN_FAMILY_2}|[{HAN_FAMILY}])(?:(?![{HAN_FAMILY}])\p{{IsHan}}){{0,2}}?)"
# The formats that are looked for, in order of precedence.
FORMATS = {
    "secret": r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))["']?(?:\s*=\s*["']?|\s*:\s*["']?(?=[^\s"',;]*[^a-z\s"',;]))[^\s"',;]{8,}""",
    "key": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opusr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})\b",
    "email": r"[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-]@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "ipv4": rf"(?=[0-9])(?<![\w.])(?<!(?i:version|release|build|ver)\.? ){OCTET}(?:\.{OCTET}){{3}}(?!\.?\w)",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "mac": r"(?<![\w:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:])",
    "person": rf"(?<![\p{{L}}])(?:{'|'.join(TITLES.values())})\.? (?!(?:{ROLES})(?!\p{{L}})){PARTICLE}{{0,3}}{NAME}(?: {PARTICLE}{{0,3}}{NAME})?|{HAN_NAME}(?:{'|'.join(HAN_TITLES.values())})",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
GROWS = 4  # attempts after which a draw gets one more character


def _bytes(seed: Column, count: Column) -> Column:
    """A keyed stream of ``count`` numbers from 0 to 255, as an array."""
    block = F.sequence(F.lit(0), F.floor(count / 32).cast("int"))
    hexes = F.array_join(F.transform(block, lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")).cast("binary"), 256)), "")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.conv(F.substring(hexes, 2 * i + 1, F.lit(2)), 16, 10).try_cast("int"))


def _pick(alphabet: str, v: Column) -> Column:
    return F.substring(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _like(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """A drawn string with the digits, letter cases and scripts of ``value``."""

    def draw(c: Column, i: Column) -> Column:
        v = F.element_at(stream, i + 1)
        out = F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", v))
        for group, alphabet in LETTERS.items():
            out = out.when(c.rlike(group if group.startswith("[") else f"[{group}]"), _pick(alphabet, v))
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(value), draw), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is zero for a valid number."""
    numbers = F.transform(_chars(F.reverse(digits)), lambda c: c.try_cast("int"))
    each = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def _mod97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    number = F.transform(_chars(moved), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(_chars(F.array_join(number, "")), F.lit(0), lambda a, d: (a * 10 + d.try_cast("int")) % 97)


def _kind(match: Column) -> Column:
    """The type of a match; null for numbers whose check digits are wrong."""
    out = None
    for kind, pattern in FORMATS.items():
        test = match.rlike(f"^(?:{pattern})$")
        if kind == "card":
            test = test & (_luhn(_digits(match)) % 10 == 0)
        if kind == "iban":
            test = test & (_mod97(F.replace(match, F.lit(" "), F.lit(""))) == 1)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


SECRET_HEAD = r"""^(.*?[=:]\s*["']?)([^\s"',;]{8,})$"""


def _canonical(kind: Column, match: Column) -> Column:
    """What makes two notations the same entity."""
    return (
        F.when(kind == "secret", F.regexp_extract(match, SECRET_HEAD, 2))
        .when(kind == "email", F.lower(match))
        .when(kind.isin("phone", "ssn", "card"), _digits(match))
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind.isin("ipv6", "mac"), F.lower(match))
        .otherwise(match)
    )


def _script(text: Column) -> Column:
    out = F.when(text.rlike(r"\p{IsHan}"), "han").when(text.rlike(r"\p{IsCyrillic}"), "cyrillic")
    return out.when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


HEAD = rf"^((?:{'|'.join(TITLES.values())})\.? )(.*)$"
TAIL = rf"^([\p{{IsHan}}]+?)({'|'.join(HAN_TITLES.values())})$"


def _gender(match: Column) -> Column:
    out = F.lit("n")
    for g in "mf":
        out = F.when(match.rlike(rf"^(?:{TITLES[g]})\.? |(?:{HAN_TITLES[g]})$"), g).otherwise(out)
    return out


def _name_parts(match: Column) -> Column:
    """(kind, value) of the given and family names of a person."""
    han = match.rlike(TAIL)
    name = F.when(han, F.regexp_extract(match, TAIL, 1)).otherwise(F.regexp_extract(match, HEAD, 2))
    double = name.rlike(f"^(?:{HAN_FAMILY_2})")
    size = F.when(double, 2).otherwise(1)
    both = F.array(F.substring(name, F.lit(1), size), F.substring(name, size + 1, F.lit(9)))
    # a small word stays with the name that it precedes
    joined = F.regexp_replace(name, rf"(?<![^ ])({PARTICLES}) ", "$1\u00a0")
    latin = F.transform(F.split(joined, " "), lambda w: F.replace(w, F.lit("\u00a0"), F.lit(" ")))
    words = F.when(han, F.filter(both, lambda w: w != "")).otherwise(latin)
    family = F.when(han, F.lit(0)).otherwise(F.size(words) - 1)
    gender, script = _gender(match), _script(name)

    def part(w: Column, i: Column) -> Column:
        role = F.when(i == family, "family").otherwise("given")
        # one family name for both genders, where the script does not inflect it
        shared = (role == "family") & script.isin("latin", "han")
        return F.struct(F.concat_ws(":", F.lit("name"), script, role, F.when(shared, "n").otherwise(gender)).alias("kind"), w.alias("value"))

    return F.transform(words, part)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``core``, the canonical surrogate of (kind, value) at its attempt.
    Each step is a column of its own, so that nothing is computed twice."""
    kind, value, v, like, more = (F.col(c) for c in ("kind", "value", "v", "like", "more"))
    at = lambda i: F.element_at(v, i + 1)
    head = F.regexp_extract("value", "^(AKIA|ASIA|gh._|xox.-|sk-)", 1)
    drawn = F.when(kind == "email", F.regexp_extract("value", r"^(.*)\.[^.@]*$", 1)).when(
        kind == "key", F.substring("value", F.length(F.col("head")) + 1, F.length("value"))
    )
    rows = entities.withColumn("head", head).withColumn("drawn", drawn.otherwise(value))
    rows = rows.withColumn("more", F.floor(F.col("attempt") / GROWS).cast("int"))
    # a keyed hash of a keyed hash, as in HMAC: the outer one hides the inner's state
    inner = F.sha2(F.concat_ws("|", F.lit(f"inner:{key}"), kind, value, F.col("attempt").cast("string")).cast("binary"), 256)
    seed = F.sha2(F.concat_ws("|", F.lit(f"outer:{key}"), inner).cast("binary"), 256)
    rows = rows.withColumn("v", _bytes(seed, F.length("value") + 48 + 3 * more))
    hexadecimal = kind.isin("ipv6", "mac") | ((kind == "secret") & value.rlike("^[0-9a-f]{12,}$"))
    rows = rows.withColumn("like", _like(F.col("drawn"), v, hexadecimal))
    # characters by which a draw grows after several attempts
    rows = rows.withColumn("extra", F.array_join(F.transform(F.slice(v, F.length("value") + 40, more), lambda x: _pick("0123456789", x)), ""))
    extra = F.col("extra")
    body = F.concat(F.substring("value", 1, 1), F.substring("like", F.lit(2), F.length("value") - 2), extra)
    plain = F.concat(F.substring("value", 1, 2), F.lit("00"), F.substring("like", 5, 99), extra)
    rows = rows.withColumn("body", F.when(kind == "card", body).when(kind == "iban", plain))
    check = F.when(kind == "card", (10 - _luhn(F.concat(F.col("body"), F.lit("0"))) % 10) % 10).when(kind == "iban", 98 - _mod97(F.col("body")))
    rows = rows.withColumn("check", check.cast("string"))
    country = F.greatest(F.lit(1), F.length("value") - 10)
    octets = [F.when(more > 0, 1 + at(F.lit(4)) % 223).otherwise(240 + at(F.lit(0)) % 15), *[at(F.lit(i)) for i in (1, 2, 3)]]
    core = (
        F.when(kind == "email", F.concat(like, extra, F.lit(".example")))
        .when(kind == "phone", F.concat(F.substring("value", F.lit(1), country), F.substring("like", country + 1, F.length("value")), extra))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring("like", 2, 99), extra))
        .when(kind == "card", F.concat("body", "check"))
        .when(kind == "iban", F.concat(F.substring("value", 1, 2), F.lpad("check", 2, "0"), F.substring("body", 5, 99)))
        .when(kind == "ipv4", F.concat_ws(".", *[x.cast("string") for x in octets]))
        .when(kind == "key", F.concat("head", "like", "extra"))
        .when(kind.startswith("name:"), _draw_name())
        .otherwise(F.concat(like, extra))
    )
    capital = kind.startswith("name:") & (F.upper("value") == value) & (F.length("value") > 1)
    rows = rows.withColumn("core", core).withColumn("core", F.when(capital, F.upper("core")).otherwise(F.col("core")))
    return rows.select("kind", "value", "attempt", "core")


def _draw_name() -> Column:
    """A name from syllables of its script, with the ending of its gender."""
    kind = F.split("kind", ":")
    script, role, gender = (F.element_at(kind, i) for i in (2, 3, 4))
    parts = F.split(F.element_at(F.create_map(*[F.lit(x) for kv in SYLLABLES.items() for x in kv]), script), " ")
    ends = F.create_map(*[x for (s, r, g), e in ENDINGS.items() for x in (F.lit(f"{s}:{r}:{g}"), F.lit(e))])
    han = script == "han"
    last = F.when(han, F.length("value") - 1).otherwise(F.lit(2)) + F.col("more")
    number = lambda i: F.element_at(F.col("v"), 2 * i + 1) * 256 + F.element_at(F.col("v"), 2 * i + 2)
    stem = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(parts, number(i) % F.size(parts) + 1)), "")
    end = F.coalesce(F.element_at(ends, F.concat_ws(":", script, role, gender)), F.lit(""))
    return F.when(han, stem).otherwise(F.concat(F.initcap(stem), end))


def _pour(match: Column, core: Column) -> Column:
    """The characters of ``core`` in the places of the match's digits and letters;
    characters left over stand at the end."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        here = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(a["out"], F.when(here, F.substring(core, a["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            F.when(here, a["i"] + 1).otherwise(a["i"]).alias("i"),
        )

    end = F.aggregate(_chars(match), zero, step)
    return F.concat(end["out"], F.substring(core, end["i"] + 1, F.length(core)))


def _entities(match: Column, kind: Column) -> Column:
    """(kind, value) of all entities of a match."""
    single = F.array(F.struct(kind.alias("kind"), _canonical(kind, match).alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(kind == "person", _name_parts(match)).when(kind.isNotNull(), single).otherwise(none)


# A text without any of these holds no entity.
HINT = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)|" + "|".join(
    [rf"\b(?:{t})\.? {PARTICLE}{{0,3}}\p{{Lu}}" for t in TITLES.values()] + ["|".join(HAN_TITLES.values())]
)


def secret_key(spark: SparkSession) -> str:
    """The key of the session's setting ``spark.quire.pii.key``; a fixed one where
    it is unset, for tests and runs whose results must be compared."""
    return spark.conf.get("spark.quire.pii.key", "no secret")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, core): distinct surrogates of distinct entities."""
    table = entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    # drawing costs time, not bytes: rows are dealt evenly, however few bytes they have
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut_lineage(table, "entities")
    group = F.regexp_replace("kind", ":[fmn]$", "")  # names of any gender
    real = table.select(group.alias("k"), F.col("value").alias("c")).distinct()
    while True:
        drawn = cut_lineage(with_surrogates(table.repartition(parts, "kind", "value"), key), "drawn")
        # of equal surrogates the smallest value keeps its draw
        first = drawn.groupBy("kind", "core").agg(F.min("value").alias("first"), F.count("*").alias("n")).where("n > 1")
        first = first.select(F.col("kind").alias("k"), F.col("core").alias("c"), "first")
        same = drawn.join(first, (F.col("kind") == F.col("k")) & (F.col("core") == F.col("c"))).where("value <> first")
        # no surrogate may be a value that stands in the corpus
        taken = drawn.withColumn("g", group).join(real, (F.col("g") == F.col("k")) & (F.col("core") == F.col("c")), "left_semi")
        bad = same.select("kind", "value").unionAll(taken.select("kind", "value")).distinct()
        bad = cut_lineage(bad.withColumn("bad", F.lit(1)), "collided")
        if bad.isEmpty():
            return drawn.select("kind", "value", "core")
        table = table.join(bad, ["kind", "value"], "left")
        table = cut_lineage(table.select("kind", "value", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt")), "entities")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced.  ``key`` is the caller's
    secret: whoever has it can test guesses.  ``count`` names an added column
    with the number of replaced matches."""
    if not key:
        raise ValueError("a key is required")
    t, h = col(text_col), fresh(docs, "_hash")
    hint = F.coalesce(t.rlike(HINT), F.lit(False))
    name = lambda c: F.sha2(c.cast("binary"), 256)
    texts = docs.where(hint).select(name(t).alias("h"), t.alias("t"))
    found = texts.select("h", F.posexplode(F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))).alias("pos", "match")).distinct()
    found = cut_lineage(found.withColumn("kind", _kind(F.col("match"))), "matches")
    parts = found.where("kind IS NOT NULL").select("h", "pos", "match", F.col("kind").alias("type"), F.posexplode(_entities(F.col("match"), F.col("kind"))).alias("part", "e"))
    parts = parts.select("h", "pos", "match", "type", "part", "e.kind", "e.value")
    drawn = draw(parts.select("kind", "value"), key)
    # surrogates of each match, in the order of its parts
    cores = parts.join(drawn, ["kind", "value"]).groupBy("h", "pos", "match", "type").agg(
        F.sort_array(F.collect_list(F.struct("part", "kind", "value", "core"))).alias("parts")
    )
    core, han = F.col("parts")[0]["core"], F.col("match").rlike(TAIL)
    names = F.transform("parts", lambda p: p["core"])
    person = F.when(han, F.concat(F.array_join(names, ""), F.regexp_extract("match", TAIL, 2))).otherwise(
        F.concat(F.regexp_extract("match", HEAD, 1), F.array_join(names, " "))
    )
    new = (
        F.when(F.col("type") == "person", person)
        .when(F.col("type") == "secret", F.concat(F.regexp_extract("match", SECRET_HEAD, 1), core))
        .when(F.col("type").isin("phone", "ssn", "card", "iban"), _pour(F.col("match"), core))
        .otherwise(core)
    )
    whole = F.array(F.struct(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"), F.array_join(names, "").alias("core"), F.lit(True).alias("han")))
    each = F.transform("parts", lambda p: F.struct(p["value"].alias("value"), p["core"].alias("core"), F.lit(False).alias("han")))
    alone = lambda p: F.when(p["han"], F.length(p["value"]) > 1).otherwise(~p["value"].rlike(f"^(?:{ORDINARY})$"))
    later = F.when(F.col("type") == "person", F.filter(F.when(han, whole).otherwise(each), alone))
    cores = cores.select("h", "pos", new.alias("new"), later.alias("later"))
    edits = cores.groupBy("h").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("edits"), F.flatten(F.collect_list("later")).alias("later")
    )
    # longer names first, as a Han name may begin another
    by_length = lambda p: F.struct((-F.length(p["value"])).alias("n"), *[p[c].alias(c) for c in ("value", "core", "han")])
    edits = edits.withColumn("later", F.array_sort(F.array_distinct(F.transform("later", by_length))))
    literal = lambda p: F.concat(F.lit(r"\Q"), p["value"], F.lit(r"\E"))
    forms = F.transform("later", lambda p: F.when(p["han"], literal(p)).otherwise(F.concat(F.lit(r"(?<!\p{L})"), literal(p), F.lit(r"(?!\p{L})"))))
    edits = edits.withColumn("names", F.array_join(forms, "|"))
    edits = cut_lineage(edits.withColumnRenamed("h", h), "edits")

    row = fresh(docs, "_row")
    held = docs.where(hint).select(F.struct(*[col(c).alias(c) for c in docs.columns]).alias(row), t.alias("t"))
    work = held.withColumn("h2", name(F.col("t"))).join(edits, F.col("h2") == col(h), "left")
    kept, match = F.split("t", PATTERN, -1), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))
    pieces = F.concat(F.transform(match, lambda m, i: F.coalesce(F.element_at("edits", i), m)), F.array(F.lit("")))
    text = F.array_join(F.zip_with(kept, pieces, lambda a, b: F.concat(a, b)), "")
    work = work.withColumn("new", F.when(F.col("edits").isNull(), F.col("t")).otherwise(text))
    # mentions of a person by name alone, between the matches
    own_core = lambda m: F.try_element_at(F.filter("later", lambda p: p["value"] == m), F.lit(1))["core"]
    cores_of = lambda s: F.concat(F.transform(F.regexp_extract_all(s, F.col("names"), F.lit(0)), own_core), F.array(F.lit("")))
    bare = lambda s: F.array_join(F.zip_with(F.split(s, F.col("names"), -1), cores_of(s), lambda a, b: F.concat(a, b)), "")
    named = F.array_join(F.zip_with(F.transform(kept, bare), pieces, lambda a, b: F.concat(a, b)), "")
    work = work.withColumn("new", F.when(F.size("later") > 0, named).otherwise(F.col("new")))
    own = [F.col("new").alias(c) if c == text_col else col(row)[c].alias(c) for c in docs.columns]
    number = [F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias(count)] if count else []
    rest = docs.where(~hint).select(*map(col, docs.columns), *([F.lit(0).cast("long").alias(count)] if count else []))
    return work.select(*own, *number).unionAll(rest)
