"""Personal data: keyed, type-consistent surrogates, in DataFrame functions only.

Detected entities: e-mail, IPv4 and IPv6 addresses, phone numbers, payment
cards, account numbers (IBAN), US social security numbers, credentials (access
keys, password= and token= values) and names after a form of address. Each gets
a replacement of the same type and format: digits for digits, letters for
letters of the same case and script, separators, lengths, country codes and
forms of address as they were; a card number keeps its first digit and has a
valid check digit; an address is none that anybody can have.

A text is matched once: the entities found are marked, and the text is cut at
the marks. A name that stands after a form of address in a text is also
replaced where it stands without one in that text, unless the text has the same
word in lower case too. Names are replaced word by word: a word has one
replacement in all documents, whatever the form of address and whichever other
words stand by it. A word that ever comes first of two is a given name, and its
replacement one of the gender of the forms of address it is seen with (of
neither, if with both or none).

The replacement is a keyed hash of the type and the entity's canonical form
(letter case, and separators of numbers, don't count), so that one entity has
one replacement in all documents. All distinct entities of the corpus are then
compared: of those with one replacement, or with one that is itself an entity
of the corpus, all but the first are hashed again until none are left. Texts go
by a hash of 128 bits, so copies are looked up once, and only texts that hold
an entity are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage

# The forms of address by gender, with the patterns of the entities. Repeated groups are possessive or
# bounded, so that no text makes Java's matcher recurse.
MALE = ["Mr", "Herr", "Monsieur", "Sr", "Señor", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "госпожа", "κυρία"]
OPEN = ["Dr", "Prof"]
_TITLES = "|".join(MALE + FEMALE + OPEN)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}(?:\p{L}++|(?=['’-]\p{Lu}))(?:['’-]\p{Lu}\p{L}*+)*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+\"?",
    "ip": r"(?<![0-9.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:" + _HEX + r"(?::" + _HEX + r"){7}|" + _HEX + r"(?::" + _HEX + r"){0,5}::(?:" + _HEX + r"(?::" + _HEX + r"){0,5})?|::" + _HEX + r"(?::" + _HEX + r"){1,6})(?![0-9A-Za-z:])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9+-])(?:4[0-9]|5[0-9]|3[04-689]|6[0-9]|2[2-7])[0-9]{2}(?:([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
    # national: France 0x xx xx xx xx, Germany 0xx(xx) and 5 to 9 digits, Spain 6 to 9 and 3 3 3 or 3 2 2 2
    r"|0[1-9](?:[ .-][0-9]{2}){4}|\(?0[1-9][0-9]{1,3}\)?(?: ?/ ?|[ -])[0-9]{3,4}[ -]?[0-9]{2,5}|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3})(?![0-9])",
    "name": r"\b(?:" + _TITLES + r")\b\.? " + _NAME + "(?: " + _NAME + ")?",
}
# The calling codes of countries, none of which begins another.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
TITLE = r"^(\p{L}+)\.? "
#: A capitalised word, for names without their form of address.
WORD = r"(?<![\p{L}\p{N}_'’-])" + _NAME + r"(?![\p{N}_])"
#: Texts that match none of these hold no entity.
HINT = r"[0-9@:]|(?i:password|passwd|pwd|secret|token|api[_-]?key)|\b(?:" + _TITLES + r")\b"
# Given names by gender and script, and syllables and endings of family names.
GIVEN = {
    ("m", "latin"): ["James", "Robert", "Daniel", "Thomas", "Martin", "Simon", "Lucas", "Adrian", "Victor", "Hugo", "Oscar", "Paul", "Marc", "Felix", "Anton", "Leo"],
    ("f", "latin"): ["Mary", "Laura", "Julia", "Anna", "Clara", "Sarah", "Emma", "Nina", "Alice", "Eva", "Helen", "Irene", "Marta", "Sofia", "Rosa", "Vera"],
    ("u", "latin"): ["Robin", "Alex", "Kim", "Sasha", "Jules", "Dana", "Charlie", "Morgan", "Noa", "Toni", "Andrea", "Jamie", "Sam", "Chris", "Lou", "Remy"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Алексей", "Николай", "Павел", "Сергей", "Дмитрий", "Андрей"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна", "Наталья", "Светлана"],
    ("u", "cyrillic"): ["Саша", "Женя", "Валя", "Слава", "Никита", "Шура", "Тоня", "Юля"],
    ("m", "greek"): ["Γιώργος", "Νίκος", "Κώστας", "Γιάννης", "Πέτρος", "Παύλος", "Στέλιος", "Μάρκος"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Ειρήνη", "Κατερίνα", "Δήμητρα", "Χριστίνα"],
    ("u", "greek"): ["Αλέξης", "Άρης", "Φώτης", "Χάρις", "Θέμις", "Άλκης", "Μάκης", "Νεφέλη"],
    ("m", "armenian"): ["Արամ", "Դավիթ", "Գևորգ", "Հայկ", "Տիգրան", "Վահան", "Սարգիս", "Կարեն"],
    ("f", "armenian"): ["Անի", "Մարիամ", "Նարե", "Լիլիթ", "Աննա", "Գայանե", "Սոնա", "Սիրան"],
    ("u", "armenian"): ["Արև", "Նվեր", "Մասիս", "Արփի", "Հրայր", "Արեգ", "Լույս", "Մեր"],
}
SYLLABLES = {
    "latin": ["bar", "del", "fin", "gor", "hal", "jen", "kos", "lin", "mar", "nor", "pel", "rad", "sol", "tam", "ver", "wen"],
    "cyrillic": ["бар", "дол", "фин", "гор", "кос", "лин", "мар", "нор", "пел", "рад", "сол", "там", "вер", "зим", "лук", "жар"],
    "greek": ["βαρ", "δελ", "φιν", "γορ", "καλ", "λιν", "μαρ", "νορ", "πελ", "ραδ", "σολ", "ταμ", "ζερ", "θαλ", "ξεν", "παν"],
    "armenian": ["բար", "դել", "ֆին", "գոր", "հալ", "լին", "մար", "նոր", "պել", "ռադ", "սոլ", "տամ", "վեր", "զար", "քոս", "ջեն"],
}
ENDINGS = {("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов", ("cyrillic", "u"): "ко", ("greek", "f"): "ίδου", ("greek", "m"): "ίδης", ("greek", "u"): "άκη", ("armenian", "f"): "յան", ("armenian", "m"): "յան", ("armenian", "u"): "յան"}
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
_NUMBERS = ["card", "ssn", "phone", "iban"]

# Before the alternatives, a look at the next character: most places begin none of them.
_STARTS = {"ip": "[0-9]", "card": "[2-6]", "ssn": "[0-9]", "phone": "[0-9+(]", "ipv6": "[0-9A-Fa-f:]", "iban": "[A-Z]{2}[0-9]", "key": "AKIA", "secret": "[psta]", "name": r"[MHSDPFгκ]"}
_MASTER = "|".join(f"(?:(?={'(?i)' * (k == 'secret')}{_STARTS[k]}){p})" if k in _STARTS else f"(?:{p})" for k, p in PATTERNS.items()).replace(r"([ -]?)[0-9]{4}\1[0-9]{4}\1", r"(?:[ -]?[0-9]{4}){2}[ -]?")
#: What cuts a text, and stands for characters of this kind that it has itself.
_CUT, _ESCAPE, _OF_CUT, _OF_ESCAPE = "\u0001", "\u0002", "\u0003", "\u0004"


def luhn(digits: Column) -> Column:
    """The Luhn sum, mod 10, of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def described(entities: DataFrame) -> DataFrame:
    """entities (entity, ...) with `kind`, the first pattern that fits all of it, and `canon`, what counts of it.

    No letter case counts in addresses and names, no separators in numbers; of
    credentials the value counts. A number in the form of a card's that fails
    the check digit is none: its kind is null.
    """
    e = F.col("entity")
    number = F.regexp_replace(e, r"[^0-9A-Za-z]", "")
    kind = F.coalesce(*(F.when(e.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()), F.lit("phone"))
    canon = (
        F.when(F.col("kind").isin("email", "ipv6", "name"), F.lower(e))
        .when(F.col("kind").isin(_NUMBERS), F.upper(number))
        .when(F.col("kind") == "secret", F.regexp_extract(e, r"[=:] ?\"?([A-Za-z0-9+/_-]+)", 1))
        .otherwise(e)
    )
    typed = entities.withColumn("kind", kind)
    typed = typed.withColumn("kind", F.when((F.col("kind") == "card") & (luhn(number) != 0), None).otherwise(F.col("kind")))
    return typed.withColumn("canon", canon)


def _nibbles(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    text = F.concat_ws("\u0001", F.lit(key), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(F.lit("+"), text), 256))


def _number(stream: Column, at: Column | int) -> Column:
    """The number in four of the hexadecimal digits, from place 2 x at on, going round."""
    return F.conv(F.substr(stream, F.lit(2) * (at % 62) + 1, F.lit(4)), 16, 10).cast("int")


def _places(text: Column, upto: Column) -> Column:
    """How many of the first characters of text are ASCII letters or digits."""
    return F.length(F.regexp_replace(F.substr(text, F.lit(1), upto), r"[^0-9A-Za-z]", ""))


def _alike(text: Column, stream: Column, keep: Column | int = 0, loose: Column | bool = False, hexadecimal: Column | bool = False) -> Column:
    """text with keyed digits for digits and letters for ASCII letters, upper and lower; the first `keep` characters stay.

    A number's first digit other than 0 stays other than 0, and a text of
    hexadecimal digits after the kept ones stays one. loose: separators don't
    count, so that the forms of one number get the same digits.
    """
    keep = F.lit(keep) if isinstance(keep, int) else keep
    loose = F.lit(loose) if isinstance(loose, bool) else loose
    hexadecimal = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal
    letters = F.when(hexadecimal | text.rlike(r'[0-9a-f]{12}"?$') | text.rlike(r'[0-9A-F]{12}"?$'), 6).otherwise(26)
    kept = _places(text, keep)

    def one(i: Column) -> Column:
        c, place = F.substr(text, i, F.lit(1)), F.when(loose, _places(text, i)).otherwise(i)
        n = _number(stream, place)
        starts = F.when(loose, place == kept + 1).otherwise((i == 1) | ~F.substr(text, i - 1, F.lit(1)).rlike("[0-9]"))
        digit = F.when((c != "0") & starts, n % 9 + 1).when(starts & loose, F.lit(0)).otherwise(n % 10).cast("string")
        return F.when(i <= keep, c).when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), F.char(97 + n % letters)).when(c.rlike("[A-Z]"), F.char(65 + n % letters)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), "")


def _ip(entity: Column, stream: Column, attempt: Column) -> Column:
    """An IPv4 address of a reserved or private network.

    The parts keep their numbers of digits; after some attempts, as there are
    few of a shape, they don't, and at last any network does.
    """
    parts = F.split(entity, r"\.")
    size = F.length(parts[0])
    first = F.when(size == 3, _number(stream, 0) % 15 + 240).when(size == 2, 10).otherwise(0)

    def part(i: int) -> Column:
        n, width = _number(stream, 2 * i), F.length(parts[i])
        return F.when(width == 3, n % 156 + 100).when(width == 2, n % 90 + 10).otherwise(n % 10)

    shaped = F.concat_ws(".", first.cast("string"), *(part(i).cast("string") for i in (1, 2, 3)))
    loose = F.concat_ws(".", F.when(attempt < 16, _number(stream, 0) % 15 + 240).otherwise(_number(stream, 0) % 254 + 1).cast("string"), *((_number(stream, 2 * i) % 256).cast("string") for i in (1, 2, 3)))
    return F.when(attempt < 8, shaped).otherwise(loose)


def _script(word: Column) -> Column:
    found = F
    for name, pattern in _SCRIPTS.items():
        found = found.when(word.rlike(pattern), name)
    return found.otherwise("latin")


def _listed(values: list[str]) -> Column:
    return F.split(F.lit(",".join(values)), ",")


def _word(stream: Column, script: Column, role: Column, gender: Column, attempt: Column) -> Column:
    """A name for a name's word: a given one (from the second attempt on, several joined by hyphens) or a family one."""
    names = F.coalesce(*(F.when((gender == g) & (script == s), _listed(x)) for (g, s), x in GIVEN.items()))
    parts = F.coalesce(*(F.when(script == s, _listed(x)) for s, x in SYLLABLES.items()))
    values = F.when(role == "given", names).otherwise(parts)
    places = F.when(role == "given", F.sequence(F.lit(0), F.least(attempt, F.lit(7)))).otherwise(F.sequence(F.lit(0), F.lit(4) + F.least(F.floor(attempt / 2), F.lit(8)).cast("int")))
    picked = F.transform(places, lambda i: F.element_at(values, _number(stream, 2 * i) % F.size(values) + 1))
    ending = F.coalesce(*(F.when((script == s) & (gender == g), e) for (s, g), e in ENDINGS.items()), F.lit(""))
    return F.when(role == "given", F.array_join(picked, "-")).otherwise(F.concat(F.initcap(F.array_join(picked, "")), ending))


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (entity, kind, canon, role, gender, attempt, ...) with `new`, the replacement; role and gender count for words of names."""
    e, kind, stream = F.col("entity"), F.col("kind"), F.col("_stream")
    keyed = entities.withColumn("_stream", _nibbles(key, kind, F.col("canon"), F.col("attempt").cast("string")))
    keyed = keyed.withColumn("_domain", F.lower(F.substring_index(e, "@", -1))).withColumn("_of_domain", _nibbles(key, F.lit("domain"), F.col("_domain")))
    body = F.when(kind == "email", F.substring_index(e, "@", 1)).otherwise(e)
    stays = (
        F.when(kind == "card", 1)
        .when(kind == "key", 4)
        .when(kind == "iban", 2)
        .when((kind == "phone") & e.startswith("+"), F.length(F.regexp_extract(e, COUNTRY, 0)))
        .when(kind == "secret", F.length(F.regexp_extract(e, r"^([^=:]*[=:] ?\"?)", 1)))
        .otherwise(0)
    )
    keyed = keyed.withColumn("_body", body).withColumn("_keep", stays).withColumn("_script", _script(F.col("canon")))
    keyed = keyed.withColumn("_alike", F.when(~kind.isin("ip", "word"), _alike(F.col("_body"), stream, F.col("_keep"), kind.isin("card", "phone", "iban"), kind == "ipv6")))
    alike = F.col("_alike")
    check = ((10 - luhn(F.concat(F.substr(F.regexp_replace(alike, "[^0-9]", ""), F.lit(1), F.length(F.regexp_replace(e, "[^0-9]", "")) - 1), F.lit("0")))) % 10).cast("string")
    local = F.when(alike.rlike("^[0-9A-Fa-f]{4}:"), F.concat(F.when(e.rlike("[A-F]"), "FD").otherwise("fd"), F.substr(alike, F.lit(3)))).otherwise(alike)
    new = (
        F.when(kind == "email", F.concat(alike, F.lit("@"), _alike(F.substring_index("_domain", ".", 1), F.col("_of_domain")), F.lit(".example")))
        .when(kind == "ip", _ip(e, stream, F.col("attempt")))
        .when(kind == "ipv6", local)
        .when(kind == "card", F.concat(F.substr(alike, F.lit(1), F.length(alike) - 1), check))
        .when(kind == "word", _word(stream, F.col("_script"), F.col("role"), F.col("gender"), F.col("attempt")))
        .otherwise(alike)
    )
    return keyed.withColumn("new", new).drop("_stream", "_domain", "_of_domain", "_body", "_keep", "_script", "_alike")


def _cut(text: Column, pattern: str) -> Column:
    """text cut into what stands between matches (even places) and matches (odd places); text has none of the cutting character."""
    return F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT)


def _words_of_name(entity: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(entity, TITLE, "")), " ")


def pieces(text: Column) -> Column:
    """text cut at its entities: what stands between them (even places) and entities (odd places), names without form of address too.

    Cutting characters of the text are written by others; see restored().
    """
    own = F.when(text.contains(_CUT) | text.contains(_ESCAPE), F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _OF_ESCAPE)), F.lit(_CUT), F.lit(_ESCAPE + _OF_CUT))).otherwise(text)
    return F.when(text.rlike(HINT), _cut(own, _MASTER)).otherwise(F.array(own))


def restored(text: Column) -> Column:
    return F.when(text.contains(_ESCAPE), F.replace(F.replace(text, F.lit(_ESCAPE + _OF_CUT), F.lit(_CUT)), F.lit(_ESCAPE + _OF_ESCAPE), F.lit(_ESCAPE))).otherwise(text)


def _odd(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def _with_bare_names(marked: DataFrame) -> DataFrame:
    """marked (text, _al_pieces) with known names without their form of address cut out too."""
    names = F.filter(_odd(F.col("_al_pieces")), lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    known = F.array_distinct(F.flatten(F.transform(names, _words_of_name)))
    known = F.filter(known, lambda w: ~F.regexp_like(F.col("text"), F.concat(F.lit(r"(?<![\p{L}])"), w, F.lit(r"(?![\p{L}])"))))
    titled = marked.withColumn("_al_known", F.when(F.size(_odd(F.col("_al_pieces"))) > 0, known).otherwise(F.array().cast("array<string>")))

    def finer(piece: Column, i: Column) -> Column:
        """Of the words cut out, those that aren't known are put back."""
        cut = _cut(piece, WORD)
        back = F.transform(cut, lambda w, k: F.when((k % 2 == 1) & F.array_contains("_al_known", F.lower(w)), F.concat(F.lit(_CUT), w, F.lit(_CUT))).otherwise(w))
        return F.when(i % 2 == 0, F.split(F.array_join(back, ""), _CUT)).otherwise(F.array(piece))

    finest = F.when(F.size("_al_known") > 0, F.flatten(F.transform("_al_pieces", finer))).otherwise(F.col("_al_pieces"))
    return titled.withColumn("_al_pieces", finest).drop("_al_known")


def resolve(entities: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(entity, new): each distinct entity of entities (entity) with its replacement.

    Two canonical forms may not share a replacement, and none may be an entity
    of the corpus: all but the first, by canonical form, are hashed again.
    Forms of one canonical form differ as they do in writing only. A capitalised
    word by itself is taken for one of a name's. An error after `most` attempts:
    the corpus then has nearly all entities of some type.
    """
    bare = F.col("entity").rlike(r"^\p{Lu}[\p{L}'’-]+$") & ~F.col("entity").rlike("^(?:" + PATTERNS["key"] + ")$")
    found = entities.distinct()
    forms = stage(described(found.where(~bare)).where("kind is not null").unionByName(found.where(bare).select("entity", F.lit("bare").alias("kind"), F.lower("entity").alias("canon"))), "forms")
    title = F.regexp_extract("entity", r"^(\p{L}+)", 1)
    named = forms.where("kind = 'name'").select(title.isin(MALE).alias("m"), title.isin(FEMALE).alias("f"), F.posexplode(_words_of_name(F.col("entity"))).alias("at", "canon"), (F.size(_words_of_name(F.col("entity"))) > 1).alias("two"))
    m, f = F.bool_or("m"), F.bool_or("f")
    words = named.groupBy("canon").agg(F.when(F.bool_or((F.col("at") == 0) & F.col("two")), "given").otherwise("family").alias("role"), F.when(m & ~f, "m").when(f & ~m, "f").otherwise("u").alias("gender"))
    words = words.select(F.lit("word").alias("kind"), "canon", F.col("canon").alias("entity"), "role", "gender")
    none = F.lit(None).cast("string")
    other = forms.where("kind not in ('name', 'bare')").groupBy("kind", "canon").agg(F.min("entity").alias("entity")).select("kind", "canon", "entity", none.alias("role"), none.alias("gender"))
    known = stage(other.unionByName(words).withColumn("attempt", F.lit(0)), "known")
    for _ in range(most):
        made = with_surrogates(known, key).select("kind", "canon", "new")
        renamed = made.where("kind = 'word'").select("kind", "canon", F.lower("new").alias("canon_new"))
        tried = described(made.where("kind <> 'word'").select(F.col("new").alias("entity"), F.col("kind").alias("of"), F.col("canon").alias("of_canon"))).select(F.col("of").alias("kind"), F.col("of_canon").alias("canon"), F.coalesce("canon", "entity").alias("canon_new"))
        tried = stage(tried.unionByName(renamed), "tried")
        per = tried.groupBy("kind", "canon_new").agg(F.count("*").alias("n"), F.min("canon").alias("keeps"))
        real = known.select("kind", F.col("canon").alias("canon_new"), F.lit(True).alias("real"))
        taken = per.join(real, ["kind", "canon_new"], "left").where("n > 1 or real")
        again = stage(tried.join(taken, ["kind", "canon_new"]).where("real or canon <> keeps").select("kind", "canon", F.lit(1).alias("again")), "again")
        if again.isEmpty():
            break
        known = stage(known.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"), "known")
    else:
        raise RuntimeError(f"replacements still collide after {most} attempts")
    settled = known.select("kind", "canon", "role", "gender", "attempt")
    plain = with_surrogates(forms.where("kind not in ('name', 'bare')").join(settled, ["kind", "canon"]), key).select("entity", "new")
    written = forms.where("kind in ('name', 'bare')").select("entity", "kind", F.posexplode(F.split(F.when(F.col("kind") == "name", F.regexp_replace("entity", TITLE, "")).otherwise(F.col("entity")), " ")).alias("at", "old")).withColumn("canon", F.lower("old"))
    fresh = with_surrogates(known.where("kind = 'word'"), key).select("canon", F.col("new").alias("word"))
    cased = F.when((F.length("old") > 1) & (F.upper("old") == F.col("old")), F.upper("word")).otherwise(F.col("word"))
    parts = written.join(fresh, "canon").withColumn("word", cased).groupBy("entity", "kind").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))  # two words at most
    prefix = F.when(F.col("kind") == "name", F.regexp_extract("entity", r"^(\p{L}+\.? )", 1)).otherwise("")
    return plain.unionByName(parts.select("entity", F.concat(prefix, F.array_join(F.col("parts.word"), " ")).alias("new")))


def pseudonymise(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """docs with its entities replaced in `text`, and a column n_entities; all other columns and all rows as they were.

    Null and empty texts stay. A column of docs by the name n_entities is
    replaced. key: a secret of the caller's; another key gives other
    replacements.
    """
    names = [*(c for c in docs.columns if c != "n_entities"), "n_entities"]
    marked = _with_bare_names(docs.select(*names[:-1]).withColumn("_al_pieces", pieces(F.col("text")))).withColumn("_al_key", F.when(F.size("_al_pieces") > 1, F.md5("text")))
    marked = stage(marked.drop("text"), "marked")
    some = F.col("_al_key").isNotNull()
    held = marked.where(some).select("_al_key", F.posexplode("_al_pieces").alias("at", "entity")).where("at % 2 = 1").distinct()
    held = stage(held, "held")
    with scratch(docs.sparkSession):
        new = stage(resolve(held.select("entity"), key), "surrogates", outer=True)
    put = held.join(new, "entity", "left").groupBy("_al_key").agg(F.sort_array(F.collect_list(F.struct("at", "entity", "new"))).alias("_al_new"))
    put = put.select("_al_key", F.transform("_al_new", lambda x: F.coalesce(x["new"], x["entity"])).alias("_al_put"), F.size(F.filter("_al_new", lambda x: x["new"].isNotNull())).alias("n_entities"))
    with_any = marked.where(some).join(stage(put, "put"), "_al_key")  # two exchanges, so a text with many copies can be split
    spliced = F.transform("_al_pieces", lambda p, i: F.when(i % 2 == 1, F.get("_al_put", F.floor(i / 2).cast("int"))).otherwise(p))
    with_any = with_any.withColumn("text", restored(F.array_join(spliced, "")))
    rest = marked.where(~some).withColumn("text", restored(F.col("_al_pieces")[0])).withColumn("n_entities", F.lit(0))
    return with_any.select(names).unionByName(rest.select(names))
