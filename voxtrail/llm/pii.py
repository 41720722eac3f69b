"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Entities are found by one pattern over the whole text: e-mail addresses, phone numbers, IP
addresses, card numbers, social security and bank account numbers, names behind a title, and
credentials. A surrogate is a function of a secret key, the type and the value, so the same entity
has the same surrogate in every document (coreference). Characters keep their class: a digit stays
a digit, a letter keeps case and script (its row of a Unicode block, if the script has no alphabet
here), punctuation stays; a value without a letter or digit is no entity. Card numbers (only those whose check
digit is right are taken for one) keep their first digit and length, and their check digit is right
again; IP addresses stay addresses; names keep their title,
and given names the title's gender; e-mail domains map alike wherever they occur and end in
``example`` and their old top level.

Distinctness is checked over all documents: two entities of a type with one surrogate, or a surrogate
that is itself an entity of the table, make all but the smallest value draw again, round by
round. Each round leaves a small share of the last; where a format has too few values, later attempts
add a digit more each (names a syllable), so the draw widens tenfold a round and ends for any table.

Only distinct entities are shuffled for that. Documents without an entity never enter a shuffle;
the others are read from a written table, as their row numbers must not change between two uses. The key is the
session's setting ``spark.voxtrail.surrogateKey``, or drawn for the session; none is in the code.

Defined results: null text stays null, empty text empty. Repeated rows are treated each. A table
without entities is returned as it is."""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from voxtrail.functions import arrays as A
from voxtrail.llm.common import stored

WIDE, WIDE_NUMBER = 3, 12  # attempts in the value's own format: free texts; numbers
KEY_SETTING = "spark.voxtrail.surrogateKey"

_TITLE = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"), "n": ("Dr", "Prof")}
_WORDS = "|".join(t for titles in _TITLE.values() for t in sorted(titles, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}\p{M}'’]*+(?:-\p{Lu}[\p{L}\p{M}'’]*+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# In order: what matches first at a place wins. Every pattern takes time in proportion to the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "credential": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
                  r"|(?<=(?i:passport)[ \t]{0,3}(?i:number|no\.?|nr\.?)?[ \t:#]{1,3})[A-Z]{0,2}\d{6,9}(?![\p{L}\d])"
                  r"|(?<=(?i:token|secret|password|passwd|api_key|apikey)[ \t]{0,3}[=:][ \t]{0,3}[\"']?)[^\s\"'=:]{6,}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\d.])(?<!(?i:version|release)[ \t]{{1,3}}){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\d]|\.\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\d])"
             r"|(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\d])"
             r"|(?<![\p{L}\d.,-])0[1-9]\d{1,3}[ /-]\d{6,8}(?![\p{L}\d]|[.,]\d)",
    "card": r"(?<![\p{L}\d])[3-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){3})(?![\p{L}\d])",
    "name": rf"(?<![\p{{L}}])(?:{_WORDS})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
MENTION = r"(?<![\p{L}\p{N}'’])\p{Lu}(?:[\p{L}\p{M}]|['’](?!s(?![\p{L}])))*+(?:-\p{Lu}(?:[\p{L}\p{M}]|['’](?!s(?![\p{L}])))*+)*"
HINT = rf"[@\d]|(?i:token|secret|passw|api_?key)|(?<![\p{{L}}])(?:{_WORDS})\.? \p{{Lu}}"

# Given names by script and gender: fixed values.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oscar Paul Robert Simon Tobias Victor",
    ("latin", "f"): "Alma Berta Clara Diana Elena Frida Greta Helena Irma Julia Karla Laura Maria Nina Olga Paula Rosa Sofia Thea Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим",
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Ирина Карина Лидия Мария",
}
SYLLABLES = {"latin": "ba bel bor da del dor fa fel gar gen hal hem ka kel kor la len lor ma mel mor na nel nor pa pel ra ren ro sa sel sor ta tel tor va vel vor wa zan".split(),
             "cyrillic": "ба бел бор да дел дор га ган ка кел кор ла лен лор ма мел мор на нел нор па пел ра рен ро са сел сор та тел тор ва вел вор за зан".split()}
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
           "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
           "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def _letters(first: int, last: int, kind: str) -> str:
    return "".join(chr(i) for i in range(first, last + 1) if unicodedata.category(chr(i)) == kind)


# Latin with further marks, then Hebrew, Arabic, Devanagari, Thai, Hiragana, Katakana.
CLASSES += [_letters(0x100, 0x17F, "Ll") + "ßÿ", _letters(0x100, 0x17F, "Lu")]
CLASSES += [_letters(a, b, "Lo") for a, b in ((0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA))]
RANGES = [(0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]  # Han, Hangul: every place is a letter
ROW = 16  # Unicode blocks are whole rows of 16
KINDS = [r"\p{Lu}", r"\p{Ll}", r"\p{L}", r"\p{Nd}", r"\p{N}"]


def entity_type(value: Column) -> Column:
    """The first type whose pattern fits the whole value."""
    out = F.lit("credential")
    for name in reversed([n for n in PATTERNS if n != "credential"]):
        out = F.when(F.regexp(value, F.lit(f"^(?:{PATTERNS[name]})$")), F.lit(name)).otherwise(out)
    return out


def secret(spark) -> str:
    """The key of the surrogates: the session's setting, or one drawn for this session and kept in it."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def _stream(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _pick(stream: Column, i, n: int) -> Column:
    return F.pmod(F.xxhash64(stream, i), F.lit(n)).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _kind(c: Column) -> Column:
    out = F.lit(len(KINDS))
    for i in reversed(range(len(KINDS))):
        out = F.when(F.regexp(c, F.lit(f"^{KINDS[i]}$")), F.lit(i)).otherwise(out)
    return out


def _other(c: Column, draw: Column) -> Column:
    """A letter or digit outside CLASSES: another of its kind from its range, or from its row of 16; else x."""
    code = F.ascii(c).cast("bigint")
    row = F.filter(F.transform(F.sequence(F.lit(0), F.lit(ROW - 1)), lambda i: _char(code - code % ROW + i)),
                   lambda x: _kind(x) == _kind(c))
    out = F.when(F.size(row) > 1, F.get(row, F.pmod(draw, F.size(row)).cast("int"))).otherwise("x")
    for a, b in RANGES:
        out = F.when(code.between(a, b), _char(F.lit(a) + F.pmod(draw, F.lit(b - a + 1)))).otherwise(out)
    return out


def _wider(attempt: Column, stream: Column, own: int) -> Column:
    """Digits that are added after ``own`` attempts, one more each time."""
    return F.when(attempt > own, F.array_join(F.transform(
        F.sequence(F.lit(1), attempt - own), lambda j: _pick(stream, j + 1_000_000, 10).cast("string")), "")).otherwise(F.lit(""))


def _chars(value: Column, stream: Column, hexa: Column | None = None) -> Column:
    """Every letter and digit exchanged inside its class; other characters stay. ``hexa``: lower letters up to f."""
    def one(c: Column, i: Column) -> Column:
        out = F.when(F.regexp(c, F.lit(r"[\p{L}\p{N}]")), _other(c, F.xxhash64(stream, i))).otherwise(c)
        n = F.xxhash64(stream, i)
        for group in CLASSES:
            size = F.when(hexa, F.lit(6)).otherwise(F.lit(26)) if hexa is not None and group[0] == "a" else F.lit(len(group))
            out = F.when(F.instr(F.lit(group), c) > 0,
                         F.lit(group).substr(F.pmod(n, size).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digit_sum(value: Column) -> Column:
    """Luhn sum of the digits of a card number."""
    def n(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    d = F.reverse(F.split(F.regexp_replace(value, r"\D", ""), ""))
    doubled = F.transform(d, lambda c, i: F.when(
        i % 2 == 1, (n(c) * 2) % 10 + F.when(n(c) > 4, 1).otherwise(0)).otherwise(n(c)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _checked(body: Column) -> Column:
    check = (F.lit(10) - _digit_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.concat(body, check.cast("string"))


def is_entity(value: Column) -> Column:
    """False for a long number that has no card's check digit, and for a value without letter or digit."""
    return (~F.regexp(value, F.lit(f"^(?:{PATTERNS['card']})$")) | (_digit_sum(value) % 10 == 0)) & F.regexp(value, F.lit(r"[\p{L}\p{N}]"))


def _list(words: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i)


def _name(value: Column, key: str, attempt: Column) -> Column:
    """Title kept; given names by the title's gender, the last word made of syllables, all by script."""
    title = F.regexp_extract(value, rf"^(?:{_WORDS})\.? ", 0)
    word = F.regexp_replace(title, r"\.? $", "")
    gender = F.when(word.isin(*_TITLE["m"]), "m").when(word.isin(*_TITLE["f"]), "f").otherwise("n")
    parts = F.split(value.substr(F.length(title) + 1, F.length(value)), " ")

    def one(p: Column, i: Column) -> Column:
        cyr = F.regexp(p, F.lit(r"\p{IsCyrillic}"))
        s = _stream(key, F.lit("name"), p, attempt.cast("string"))

        def surname(kind):
            syl = SYLLABLES[kind]
            return F.initcap(F.concat(*[_list(syl, _pick(s, F.lit(j), len(syl))) for j in range(3)],
                                      F.when(attempt > 3, F.array_join(F.transform(
                                          F.sequence(F.lit(3), attempt - 1), lambda j: _list(syl, _pick(s, j, len(syl)))), "")).otherwise(F.lit(""))))

        def given(kind):
            men, women = GIVEN[kind, "m"].split(), GIVEN[kind, "f"].split()
            female = (gender == "f") | ((gender == "n") & (_pick(s, F.lit(9), 2) == 0))
            return F.when(female, _list(women, _pick(s, F.lit(0), len(women)))).otherwise(_list(men, _pick(s, F.lit(0), len(men))))

        last = i == F.size(parts) - 1
        return F.when(last, F.when(cyr, surname("cyrillic")).otherwise(surname("latin"))).otherwise(
            F.when(cyr, given("cyrillic")).otherwise(given("latin")))

    return F.concat(title, F.array_join(F.transform(parts, one), " "))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement drawn for a value of a type in a given attempt."""
    s = _stream(key, kind, value, attempt.cast("string"))
    more, digits = _wider(attempt, s, WIDE), _wider(attempt, s, WIDE_NUMBER)
    domain = F.regexp_extract(value, "@(.*)$", 1)
    top = F.regexp_extract(domain, r"[^.]*$", 0)
    head = F.regexp_replace(domain, r"\.[^.]*$", "")
    head = F.regexp_replace(head, r"\.[^.]*$", "")
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_pick(s, i, 254) + 1).cast("string")), ".")
    ip = F.concat(ip, F.when(digits != "", F.concat(F.lit(":"), digits)).otherwise(F.lit("")))  # an address with a port
    # what stays in front, and what is exchanged character by character
    front = (F.when(kind == "card", value.substr(F.lit(1), F.lit(1))).when(kind == "iban", value.substr(F.lit(1), F.lit(2)))
             .when(kind == "phone", F.regexp_extract(value, r"^(\+\d{1,3}[ .-])?", 0))
             .when((kind == "credential") & value.startswith("AKIA"), "AKIA").otherwise(""))
    rest = F.when(kind == "email", F.regexp_extract(value, "^[^@]*", 0)).otherwise(
        value.substr(F.length(front) + 1, F.length(value) - F.length(front) - F.when(kind == "card", 1).otherwise(0)))
    new = F.concat(front, _chars(rest, s, (kind == "credential") & F.regexp(value, F.lit("^[0-9a-f]+$"))),
                   F.when(kind.isin("email", "credential"), more).otherwise(digits))
    email = F.concat(new, F.lit("@"), _chars(head, _stream(key, F.lit("domain"), domain)), F.lit(".example."), top)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _checked(new))
            .when(kind == "name", _name(value, key, attempt)).otherwise(new))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """type, value, surrogate for distinct (type, value); no two of a type share a surrogate.

    A surrogate is never a value of the table either. A round writes what it drew anew, and looks that
    small table up in the values and in what is settled; the rest is not touched again."""
    known = stored(entities.select("type", "value"), "entities")
    values = known.select(F.col("value").alias("surrogate")).distinct()
    settled, attempt = None, 0
    drawn = known.withColumn("surrogate", surrogate(F.col("type"), F.col("value"), F.lit(0), key))
    while True:
        drawn = stored(drawn, "drawn")
        taken = drawn.join(values, "surrogate", "left_semi").select("type", "value")
        if settled is not None:
            taken = taken.unionByName(drawn.join(settled.select("type", "surrogate"), ["type", "surrogate"], "left_semi").select("type", "value"))
        free = drawn.join(taken, ["type", "value"], "left_anti")
        first = free.groupBy("type", "surrogate").agg(F.min("value").alias("value"))
        kept = stored(free.join(first, ["type", "surrogate", "value"], "left_semi").select("type", "value", "surrogate"), "settled")
        settled = kept if settled is None else settled.unionByName(kept)
        again = drawn.join(kept.select("type", "value"), ["type", "value"], "left_anti").select("type", "value")
        if not again.take(1):
            return settled
        attempt += 1
        drawn = again.withColumn("surrogate", surrogate(F.col("type"), F.col("value"), F.lit(attempt), key))


def _later_mentions(part: Column, words: Column) -> Column:
    """Text between entities with the words of the document's names exchanged as in the names."""
    found = F.regexp_extract_all(part, F.lit(MENTION), F.lit(0))
    return A.let(F.struct(found.alias("f"), F.split(part, MENTION, -1).alias("b"), words.alias("w")), lambda t: F.array_join(F.transform(
        t["b"], lambda s, i: F.concat(s, F.coalesce(F.element_at(t["w"], F.get(t["f"], i)), F.get(t["f"], i), F.lit("")))), ""))


def _words(value: Column) -> Column:
    """The words of a name behind its title."""
    return F.split(F.regexp_replace(value, rf"^(?:{_WORDS})\.? ", ""), " ")


def replace(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``__entities``: how many were replaced.

    Words of a name that a document introduces with a title are exchanged wherever else they stand in that
    document, as in the name; the smallest surrogate counts where a word has two."""
    key = key or secret(docs.sparkSession)
    cols = [f"`{c}`" for c in docs.columns]
    found = F.when(F.regexp(F.col(text), F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    d = docs.withColumn("__found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("__row", F.monotonically_increasing_id())
    d = stored(d.withColumn("__real", F.filter("__found", is_entity)), "with-entities")  # the texts are searched once
    clean = d.filter(F.size("__real") == 0).select(*cols, F.lit(0).alias("__entities"))
    some = d.filter(F.size("__real") > 0)
    mentions = some.select("__row", F.explode(F.array_distinct("__real")).alias("value"))
    drawn = assign(mentions.select("value").distinct().select(entity_type(F.col("value")).alias("type"), "value"), key)
    pairs = F.arrays_zip(_words(F.col("value")).alias("a"), _words(F.col("surrogate")).alias("b"))
    maps = (mentions.join(drawn, "value").groupBy("__row").agg(  # a document's own entities
        F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("__map"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == "name", pairs))))).alias("__pairs")))
    firsts = F.filter("__pairs", lambda p, i: (i == 0) | (F.get("__pairs", i - 1)["a"] != p["a"]))
    maps = maps.select("__row", "__map", F.map_from_entries(firsts).alias("__words"))
    j = some.join(maps, "__row")
    new = A.let(F.struct(F.split(text, PATTERN, -1).alias("b"), F.col("__found").alias("f"), F.col("__map").alias("m"), F.col("__words").alias("w")),
                lambda t: F.array_join(F.transform(t["b"], lambda s, i: F.concat(
                    F.when(F.size(t["w"]) > 0, _later_mentions(s, t["w"])).otherwise(s),
                    F.coalesce(F.element_at(t["m"], F.get(t["f"], i)), F.get(t["f"], i), F.lit("")))), ""))
    changed = j.withColumn("__entities", F.size("__real")).withColumn(text, new)
    return clean.unionByName(changed.select(*cols, "__entities"))
