"""Personal data: detected entities receive keyed surrogates of their own type and format. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: fixed values: titles by the gender they tell; title and names of one script belong together
TITLES = {
    ("latin", "f"): ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Signora"],
    ("latin", "m"): ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor"],
    ("latin", "n"): ["Dr", "Prof"],
    ("cyrillic", "f"): ["г-жа", "Госпожа"],
    ("cyrillic", "m"): ["г-н", "Господин"],
}
#: fixed values: given and family names that surrogates are made of
GIVEN = {
    ("latin", "f"): "Ada Alma Anna Bella Clara Cora Dora Edith Ella Emma Erika Eva Flora Greta Helga Ida Irene Jana Julia Karla Lena Lisa Lola Marta Mila Nina Nora Olga Paula Petra Rita Rosa Sara Silvia Tina Vera".split(),
    ("latin", "m"): "Adam Alan Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Georg Hans Hugo Ivan Jakob Jonas Karl Leo Lucas Marco Max Nils Oscar Otto Paul Peter Ralf Robert Rudolf Simon Thomas Tom Victor Walter".split(),
    ("latin", "n"): "Alex Andrea Ariel Charlie Chris Dana Eden Jamie Jean Jess Jordan Kai Kim Kit Lee Leslie Lou Max Nicky Noa Pat Quinn Ray Robin Rowan Sam Sasha Sky Toni Val".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Инна Ирина Лариса Марина Мария Нина Ольга Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Максим Никита Олег Павел Роман Семён".split(),
}
FAMILY = {
    "latin": "Abel Adler Arnold Bauer Becker Berg Blum Brand Braun Cole Costa Cruz Dahl Diaz Ebert Falk Fischer Ford Frank Garcia Grant Haas Hahn Hill Holm Horn Jung Kaiser Keller Klein Koch Kraus Lang Leroy Lopez Marin Martin Moreau Moss Neal Nagel Olsen Ortiz Pohl Porter Ramos Reed Ruiz Sand Schmitt Silva Stein Stone Torres Vidal Vogel Wagner Weber West Wolf".split(),
    "cyrillic": {"m": "Белов Волков Громов Егоров Зайцев Козлов Лебедев Морозов Орлов Попов Соколов Титов".split(), "f": "Белова Волкова Громова Егорова Зайцева Козлова Лебедева Морозова Орлова Попова Соколова Титова".split()},
}


def _titles(script: str, gender: str) -> str:
    return "(?:" + "|".join(TITLES[script, gender]) + ")"


#: what the types look like that are told by their own form
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++",
    "ip6": r"(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}\b",
    "ssn": r"\d{3}-\d{2}-\d{4}\b",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b",
    "card": r"(?:\d{4}[ -]?){3}\d{4}\b|\d{13,19}\b",
    "key": r"AKIA[A-Z0-9]{16}\b|(?=[a-f]*\d)[0-9a-f]{32,64}\b",
}
IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
WORDS = r"(?:password|passwd|secret|token|api_key)"
NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"
ANY_TITLE = "(?:" + "|".join(t for x in TITLES.values() for t in x) + ")"
#: one pass over a text finds all: most of its characters fail at the first test, which no entity but a host's address skips.
#: Groups: what stands before a secret, the secret, the same of a quoted one, a title, the name, any other entity
PATTERN = (
    rf"(?<![A-Za-z0-9_])(?:({WORDS}\s?[=:]\s?)([^\s\"',;]++)|({WORDS} ?[=:] ?\")([^\s\"]++)|(?<!\p{{L}})({ANY_TITLE}\.? )({NAME})|({FORMS['email']}|{IP}"
    + "".join(f"|{FORMS[k]}" for k in ("ip6", "phone", "ssn", "iban", "card", "key"))
    + rf"))|(?<=[A-Za-z_])({IP})"
)
#: marks around an entity; a text that has such characters itself has them written with the first one while it is worked on
ESCAPE, OPEN, CLOSE = "\x01", "\x02", "\x03"
MARKED = f"$1$3$5{OPEN}$2$4$6$7$8{CLOSE}"


def kind_of(value: Column) -> Column:
    """The type of an entity that isn't a name, by its form; what has no other form is a secret."""
    shapes = {"email": FORMS["email"], "ip": r"\d{1,3}(\.\d{1,3}){3}", "ip6": FORMS["ip6"], "ssn": FORMS["ssn"], "card": FORMS["card"], "phone": FORMS["phone"], "iban": FORMS["iban"]}
    out = F.when(F.lit(False), "")
    for kind, pattern in shapes.items():
        out = out.when(value.rlike(rf"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.lit("secret"))


def canonical(kind: Column, value: Column) -> Column:
    """What two mentions of one entity have in common: emails but for case, numbers but for their punctuation."""
    return F.when(kind.isin("email", "ip6"), F.lower(value)).when(kind.isin("card", "iban", "phone"), F.regexp_replace(value, "[^0-9A-Za-z]", "")).otherwise(value)


def _byte(digest: Column, i: Column | int) -> Column:
    at = (F.lit(i) if isinstance(i, int) else i) % 63
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _each(value: Column, which: str, new: Callable[[Column, Column], Column]) -> Column:
    """value with each character of the class `which` replaced by new(character, its number among them). What stands between them is
    kept: value is split at them, and both lists are joined in turn, so that time grows with the length alone."""
    signs = F.filter(F.split(F.regexp_replace(value, f"[^{which}]", ""), ""), lambda c: c != "")
    made = F.zip_with(F.split(value, f"[{which}]", -1), F.transform(signs, new), lambda between, c: F.concat(between, F.coalesce(c, F.lit(""))))
    return F.array_join(made, "")


def _shaped(value: Column, digest: Column, fixed: Column) -> Column:
    """value with each letter and digit after the first `fixed` ones replaced by one of its own class, from the digest.
    Letters and digits are counted without punctuation, so mentions that differ in it stay one entity."""

    def new(c: Column, n: Column) -> Column:
        b = _byte(digest, n)
        return F.when(n < fixed, c).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-f]"), F.char(F.lit(97) + b % 6)).when(c.rlike("[g-z]"), F.char(F.lit(97) + b % 26)).otherwise(F.char(F.lit(65) + b % 26))

    return _each(value, "0-9A-Za-z", new)


#: small letters of a script that others are replaced by, and consonants and vowels of the syllables that lengthen a surrogate
SMALL = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}
SYLLABLES = {"latin": ("bdfghklmnprst", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}
#: attempts before surrogates grow, and syllables that are added at most
PLAIN, LONGEST = 4, 12


def _filled(value: Column, digest: Column) -> Column:
    """value with every letter and digit of any script replaced: Cyrillic letters by Cyrillic ones, other letters by Latin ones,
    capitals by capitals. A value without letters and digits becomes as many small letters."""

    def new(c: Column, n: Column) -> Column:
        b = _byte(digest, n)
        pick = lambda script: F.substring(F.lit(SMALL[script]), b % len(SMALL[script]) + 1, F.lit(1))
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), pick("cyrillic")).otherwise(pick("latin"))
        return F.when(c.rlike(r"\p{N}"), (b % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)

    bare = F.when(value.rlike(r"[\p{L}\p{N}]"), value).otherwise(F.regexp_replace(value, "(?s).", "x"))
    return _each(bare, r"\p{L}\p{N}", new)


def _growth(digest: Column, attempt: Column, script: str) -> Column:
    """Nothing for the first attempts, then keyed syllables, one more at each attempt: each makes room for 65 times as many."""
    one = lambda letters, i: F.substring(F.lit(letters), _byte(digest, i) % len(letters) + 1, F.lit(1))
    each = F.transform(F.sequence(F.lit(0), F.least(attempt - PLAIN, F.lit(LONGEST - 1))), lambda i: F.concat(one(SYLLABLES[script][0], i * 2 + 20), one(SYLLABLES[script][1], i * 2 + 21)))
    return F.when(attempt < PLAIN, "").otherwise(F.array_join(each, ""))


def _luhn(digits: Column) -> Column:
    """The digit that makes these digits pass the check that card numbers pass."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int"))
    return ((10 - F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def _spread(digits: Column, like: Column) -> Column:
    """digits with the punctuation that `like` has between its own."""
    return _each(like, "0-9", lambda _, n: F.substring(digits, n + 1, F.lit(1)))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A value of the same type and format, a function of the key, the type, the canonical value and the attempt alone."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical(kind, value), attempt.cast("string")).cast("binary"), 512)
    local, domain = F.substring_index(F.lower(value), "@", 1), F.substring_index(F.lower(value), "@", -1)
    octets = F.concat_ws(".", *[(F.lit(1) + _byte(digest, 2 * i) * 7 % 223 + _byte(digest, 2 * i + 1) % 31).cast("string") for i in range(4)])
    bare = F.regexp_replace(value, "[^0-9]", "")
    head = F.substring(_shaped(bare, digest, F.lit(1)), F.lit(1), F.length(bare) - 1)
    out = F.when(kind == "email", F.concat(F.when(local.rlike("^[!-~]*[0-9a-z][!-~]*$"), _shaped(local, digest, F.lit(0))).otherwise(_filled(local, digest)), _growth(digest, attempt, "latin"), F.lit("@"), domain))
    out = out.when(kind == "ip", octets).when(kind == "ip6", _shaped(F.lower(value), digest, F.lit(0))).when(kind == "card", _spread(F.concat(head, _luhn(head)), value))
    country = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(\d{1,3})", 1))).otherwise(F.lit(0))
    # a short number with a country has room for some digits more in its pattern
    more = F.when((attempt >= PLAIN) & value.startswith("+") & (F.length(bare) < 11), F.concat(*[(_byte(digest, 40 + i) % 10).cast("string") for i in range(4)])).otherwise("")
    out = out.when(kind == "phone", F.concat(_shaped(value, digest, country), more)).when(kind == "iban", _shaped(value, digest, F.lit(2)))
    out = out.when(value.rlike("^AKIA[A-Z0-9]{16}$"), _shaped(value, digest, F.lit(4)))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("long"), F.lit(len(names))).cast("int") + 1)
    for script, gender in TITLES:
        family = FAMILY[script] if script == "latin" else FAMILY[script][gender]
        given = F.concat(pick(GIVEN[script, gender], 0), F.when(attempt > 0, _growth(digest, attempt + PLAIN - 1, script)).otherwise(""))
        name = F.concat(pick(family, 1), F.lower(F.when(attempt > 0, pick(family, 2)).otherwise("")))
        ending = {"m": "ов", "f": "ова"}[gender] if script == "cyrillic" else ""
        grown = F.when(attempt < PLAIN, "").otherwise(F.concat(_growth(digest, attempt, script), F.lit(ending)))
        out = out.when(kind == f"given_{script}_{gender}", given).when(kind == f"family_{script}_{gender}", F.concat(name, grown))
    plain = (kind == "ssn") | value.rlike("^[!-~]*[0-9A-Za-z][!-~]*$")
    shaped = F.when(plain, _shaped(value, digest, F.lit(0))).otherwise(_filled(value, digest))
    grown = F.when(value.rlike(r"\p{IsCyrillic}"), _growth(digest, attempt, "cyrillic")).otherwise(_growth(digest, attempt, "latin"))
    return out.otherwise(F.when(kind == "ssn", shaped).otherwise(F.concat(shaped, grown)))


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, row, text, parts (null where there is no entity) and names. parts are the text in pieces; every second one is an
    entity. names are the words of the names with a title in this text and what each is: later ones without a title are
    found by them."""
    own = f"[{ESCAPE}-{CLOSE}]"
    plain = F.when(F.col("text").rlike(own), _escaped(F.col("text"))).otherwise(F.col("text"))
    pieces = lambda x: F.split(x, f"[{OPEN}{CLOSE}]", -1)
    rows = docs.select("doc_id", "text", F.regexp_replace(plain, PATTERN, MARKED).alias("marked"))
    rows = rows.withColumn("parts", F.when(F.col("marked").contains(OPEN), pieces(F.col("marked"))))
    rows = rows.withColumn("names", _names(F.col("parts")))
    search = F.concat(F.lit(r"(?<![\p{L}])("), F.array_join(F.array_distinct(F.transform("names", lambda n: n["word"])), "|"), F.lit(r")(?![\p{L}])"))
    again = lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, search, f"{OPEN}$1{CLOSE}")).otherwise(F.concat(F.lit(OPEN), F.when(F.exists("names", lambda n: F.split(x, " ")[0] == n["word"]), F.regexp_replace(x, " ", f"{CLOSE} {OPEN}")).otherwise(x), F.lit(CLOSE)))
    found = F.when(F.size("names") > 0, pieces(F.array_join(F.transform("parts", again), ""))).otherwise(F.col("parts"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", found.alias("parts"), "names")


def _escaped(text: Column) -> Column:
    for i, c in enumerate((ESCAPE, OPEN, CLOSE)):
        text = F.replace(text, F.lit(c), F.lit(f"{ESCAPE}{'abc'[i]}"))
    return text


def _plain(text: Column) -> Column:
    for i, c in reversed([*enumerate((ESCAPE, OPEN, CLOSE))]):
        text = F.replace(text, F.lit(f"{ESCAPE}{'abc'[i]}"), F.lit(c))
    return text


def _names(parts: Column) -> Column:
    """(word, kind) of the words of names whose title ends the piece before: of two words the given and the family name, one word
    is a family name."""

    def one(i: Column) -> Column:
        value, before = F.get(parts, i), F.get(parts, i - 1)
        tail = F.substring(before, F.greatest(F.length(before) - 11, F.lit(1)), F.lit(12))
        told = F.coalesce(*[F.when(tail.rlike(rf"(?:^|[^\p{{L}}]){_titles(s, g)}\.? $"), F.lit(f"{s}_{g}")) for s, g in TITLES])
        words = F.split(value, " ")
        word = lambda k, what: F.struct(F.get(words, F.lit(k)).alias("word"), F.concat(F.lit(what), told).alias("kind"))
        both = F.when(F.size(words) > 1, F.array(word(0, "given_"), word(1, "family_"))).otherwise(F.array(word(0, "family_")))
        return F.when(told.isNotNull() & value.rlike(rf"^{NAME}$"), both)

    each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), one)
    return F.when(parts.isNotNull(), F.array_distinct(F.flatten(F.filter(each, lambda x: x.isNotNull()))))


def mentions(pieces: DataFrame) -> DataFrame:
    """row, at (ordinal), kind, value and entity of every entity in the pieces that cut() made."""
    every = F.transform(F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)), lambda i: F.get("parts", i))
    rows = pieces.filter("parts IS NOT NULL").select("row", "names", F.posexplode(every).alias("at", "value"))
    known = F.get(F.filter("names", lambda n: n["word"] == F.col("value")), F.lit(0))["kind"]
    rows = rows.select("row", "at", F.coalesce(known, kind_of(F.col("value"))).alias("kind"), "value")
    return rows.withColumn("entity", canonical(F.col("kind"), F.col("value")))


def settle_collisions(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """kind, entity, value, attempt: for every entity the first attempt whose surrogate no other entity has and which is
    no entity of the corpus itself. All names are one pool, whatever their gender. Making a surrogate is the work here, so
    entities are dealt over all tasks however few bytes they are (by a hash of their key: a partitioning by the key itself would
    be taken for the one that the grouping has, and its small parts put together)."""
    spark = entities.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pool = F.when(F.col("kind").rlike("^(given|family)_"), "name").otherwise(F.col("kind"))
    settled, now = None, entities.withColumns({"pool": pool, "attempt": F.lit(0)})
    real = stash(now.select("pool", F.col("entity").alias("made")).distinct(), "real")
    for _ in range(rounds):
        made = now.repartition(tasks, F.xxhash64("kind", "entity")).withColumn("made", canonical(F.col("kind"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
        made = stash(made, "surrogates")
        # of entities with one surrogate the first keeps it; what is settled stays
        first = made.groupBy("pool", "made").agg(F.min(F.struct("kind", "entity")).alias("first"))
        taken = real if settled is None else real.union(settled.select("pool", "made"))
        judged = made.join(first, ["pool", "made"]).join(taken.withColumn("is_taken", F.lit(True)), ["pool", "made"], "left")
        bad = F.col("is_taken").isNotNull() | (F.col("first.entity") != F.col("entity")) | (F.col("first.kind") != F.col("kind"))
        judged = stash(judged.withColumn("bad", bad).drop("first", "is_taken"), "surrogates")
        good = judged.filter("NOT bad").drop("bad")
        settled = good if settled is None else settled.union(good)
        now = judged.filter("bad").select("kind", "entity", "value", "pool", (F.col("attempt") + 1).alias("attempt"))
        if not now.limit(1).count():
            return settled.select("kind", "entity", "value", "attempt")
    raise RuntimeError("too few surrogates of some type to keep all entities apart")


def made_for(found: DataFrame, key: str) -> DataFrame:
    """The mentions with the surrogate of each. It is made once for each way that an entity is written. Ways with a thousandth of
    all mentions or more, a thousand at most, are joined by broadcast; the rest by a shuffle that then has no hot key."""
    ways = found.groupBy("kind", "entity", "value").agg(F.count(F.lit(1)).alias("n"))
    ways = stash(ways, "ways")
    attempts = settle_collisions(ways.groupBy("kind", "entity").agg(F.min("value").alias("value")), key).drop("value")
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.sparkSession.sparkContext.defaultParallelism)
    made = ways.join(attempts, ["kind", "entity"]).repartition(tasks, "kind", "value")
    made = stash(made.select("kind", "value", "n", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("made")), "made")
    total = made.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = made.filter(F.col("n") >= max(1000, total / 1000)).select("kind", "value", F.col("made").alias("often"))
    hot = found.join(F.broadcast(often), ["kind", "value"], "left")
    rest = hot.filter("often IS NULL").drop("often").join(made.select("kind", "value", "made"), ["kind", "value"])
    return hot.filter("often IS NOT NULL").withColumnRenamed("often", "made").select("row", "at", "made").union(rest.select("row", "at", "made"))


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: doc_id, n_entities, text with every entity replaced by its surrogate. key: what surrogates are
    derived from; keep it secret.

    Emails (in any script), phone numbers, addresses of hosts (IPv4 and IPv6), card, bank and social security numbers, passwords and keys are found by their
    form; names by a title before them, and then by themselves wherever else in the text they stand. One entity has one
    surrogate in all documents, different entities have different ones, and no surrogate is an entity of the corpus; given
    and family names are entities of their own, so Mr. John Smith and Mr. Smith keep the family name in common. Surrogates
    keep letters as letters and digits as digits, a card's check digit, an email's domain, a phone's country, and a name's
    gender and script. After some attempts emails, names, secrets and short phone numbers grow, so that there are
    surrogates for any number of entities; a secret without letters and digits becomes letters. Null and empty texts and
    texts without entities come back unchanged, as do repeated rows, each of them. A null doc_id is allowed. An empty table
    gives an empty result; other columns are ignored. Texts are searched once and written; only those with entities move.
    """
    pieces = stash(cut(docs.select("doc_id", "text")), "pieces")
    found = stash(mentions(pieces), "mentions")
    lists = made_for(found, key).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "made"))).alias("made"))
    joined = pieces.filter("parts IS NOT NULL").join(lists.select("row", F.col("made.made").alias("made")), "row")
    whole = F.array_join(F.transform("parts", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.get("made", F.floor(i / 2).cast("int")))), "")
    whole = F.when(whole.contains(ESCAPE), _plain(whole)).otherwise(whole)
    none = pieces.filter("parts IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    return none.union(joined.select("doc_id", F.size("made").cast("long").alias("n_entities"), whole.alias("text")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents", "doc_id", "text"), key="the key of this run")
