"""Names that come back, hot entities, texts with marks, and every surrogate against the rules."""

import re
import time

import regex
from pyspark.sql import functions as F

from tidewatch.llm import privacy


def replaced(spark, texts, key="k"):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "parts": F.lit("x"), "made": F.lit(None)})
    return {r["doc_id"]: (r["n_entities"], r["text"]) for r in privacy.replace_private(df, key).collect()}


def test_names_come_back(spark):
    got = replaced(spark, [
        "Mr. John Smith came. Smith said that John's friends, the Smiths, know Johnson. Mr. Smith left.", "Mr. Smith is elsewhere, and John too.",
        "Госпожа Анна Белова и г-жа Белова. Анна ушла.",
    ])
    n, text = got[0]
    given, family = re.match(r"Mr\. (\w+) (\w+) came", text).groups()
    assert n == 5 and text == f"Mr. {given} {family} came. {family} said that {given}'s friends, the Smiths, know Johnson. Mr. {family} left."
    assert got[1] == (1, f"Mr. {family} is elsewhere, and John too.") and not {given, family} & {"John", "Smith"}
    a, b = re.match(r"Госпожа (\w+) (\w+) и", got[2][1]).groups()
    assert got[2] == (4, f"Госпожа {a} {b} и г-жа {b}. {a} ушла.")


def test_marks_and_keys(spark):
    odd = "\x01a \x02 bob@x.org \x03\x01 end\x01"
    got, other = replaced(spark, [odd, "bob@x.org"]), replaced(spark, [odd, "bob@x.org"], "another key")
    assert got[0] == (1, odd.replace("bob@x.org", got[1][1])) and got[1][1] != other[1][1]


def test_hot_entity(spark):
    texts = ["write to all@x.org and to me%d@x.org" % (i % 50) for i in range(3000)]
    got = replaced(spark, texts)
    mails = [re.findall(r"\S+@x\.org", t) for _, t in got.values()]
    assert len({m[0] for m in mails}) == 1 and len({m[1] for m in mails}) == 50 and all(n == 2 for n, _ in got.values())


def test_against_rules(spark):
    """Each type in many forms: the same type comes back, no entity stays, equal ones stay equal, all else is untouched."""
    values = {
        "email": [f"u{i}.x@mail{i % 3}.org" for i in range(20)], "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111"], "ip": ["10.1.2.3", "192.168.0.77"],
        "ssn": ["123-45-6789", "987-65-4321"], "phone": ["+1 (619) 555-0053", "619-555-0199"], "iban": ["DE89 3704 0044 0532 0130 00"],
    }
    texts = [f"before {v}, after" for kind in values for v in values[kind]] * 2
    got = replaced(spark, texts)
    forms = dict(privacy.FORMS, ip=privacy.IP)
    kinds = [kind for kind in values for _ in values[kind]] * 2
    made = {}
    for d, kind in enumerate(kinds):
        n, text = got[d]
        value = text.removeprefix("before ").removesuffix(", after")
        assert n == 1 and regex.fullmatch(forms[kind], value) and text == f"before {value}, after" and value not in texts[d]
        made.setdefault(texts[d], set()).add(value)
    assert all(len(x) == 1 for x in made.values())
    cards = [re.sub(r"\D", "", next(iter(made[f"before {v}, after"]))) for v in values["card"]]
    assert cards[0] == cards[2] and all(sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(x[::-1])) % 10 == 0 for x in cards)
    assert privacy.replace_private(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_mails_of_any_script_and_long_addresses(spark):
    texts = [
        "an Jürgen.Groß@example.de, müller@example.org; иван@почта.рф", "at 2001:db8::8a2e:370:7334 or FE80:0:0:0:1:2:3:4.", "at 12:30:45, std::vector, a::b, 1::2 x",
        "again müller@example.org and 2001:DB8::8A2E:370:7334",
    ]
    got = replaced(spark, texts)
    n, text = got[0]
    a, b, c = regex.fullmatch(r"an ([\p{L}.]+)@example\.de, (\p{L}+)@example\.org; (\p{IsCyrillic}+)@почта\.рф", text).groups()
    assert n == 3 and not {a, b, c} & {"Jürgen.Groß", "müller", "иван"} and len(a) == 11 and len(b) == 6
    n, text = got[1]
    first, second = regex.fullmatch(r"at (\S+) or (\S+)\.", text).groups()
    assert n == 2 and regex.fullmatch(privacy.FORMS["ip6"], first) and regex.fullmatch(privacy.FORMS["ip6"], second) and "db8" not in text
    assert got[2][1].startswith("at 12:30:45, std::vector, a::b, ")
    assert got[3] == (2, f"again {b}@example.org and {first}")


def test_long_secrets(spark):
    """Time grows with the length of a secret, not with its square."""
    secret = "aB3$" * 10_000
    began = time.perf_counter()
    n, text = replaced(spark, [f"token={secret} end"])[0]
    assert n == 1 and len(text) == len(secret) + 10 and text[6:20] != secret[:14] and text[9] == "$" and time.perf_counter() - began < 60
