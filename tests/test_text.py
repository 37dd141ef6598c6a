import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echometer.checks import views
from echometer.functions import text
from echometer.functions.emoji import _rough_class, name_emoji, substituter

NAMES = {"🥑": "aguacate", "🙄": "cara con los ojos en blanco", "👩‍🚀": "astronauta", "👩": "mujer", "❤️": "corazón"}

# Inputs and results the normalisation has to give.
GOLDEN = [
    ("this text has an url: http://hello.com", "this text has an url"),
    ("this text has an 🥑", "this text has an aguacate"),
    ("this text has a 🙄", "this text has a cara con los ojos en blanco"),
    ("this text has a #hashtag", "this text has a hashtag"),
    ("this text has a @mention", "this text has a"),
    ("¿¿??!!this text has... punctuation!! éáó,", "this text has punctuation éáó"),
    ("RT this text is a RT", "this text is a rt"),
    ("this text has multiple      spaces", "this text has multiple spaces"),
]
OURS = [
    (None, None),
    ("", ""),
    ("RTVE hoy", "ve hoy"),
    ("http://a.b/" + "x" * 20_000, ""),
    ("a@b.com", "a com"),
    ("un\u00a0dos\u3000tres\x1ccuatro", "un dos tres cuatro"),
    ("foohttp://x.y~bar", "foo bar"),
    ("@abc's @@x", "'s"),
    ("👩‍🚀 y 👩", "astronauta y mujer"),
    ("amor❤️", "amorcorazón"),
    ("rt RT", "rt rt"),
    ("' + [ ] | < > \\ « » …", "' + [ ] | < > \\ « » …"),
]


def run(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def step_by_step(column):
    for step in (
        text.strip_urls,
        lambda c: name_emoji(c, NAMES),
        text.drop_leading_mark,
        text.strip_handles,
        text.blank_punctuation,
        text.collapse_spaces,
        F.lower,
        F.trim,
    ):
        column = step(column)
    return column


@pytest.mark.parametrize("function", [lambda c: text.normalize(c, NAMES), step_by_step])
def test_golden_rows(spark, function):
    pairs = GOLDEN + OURS
    assert run(spark, [p[0] for p in pairs], function) == [p[1] for p in pairs]


def test_emoji_from_left_to_right_in_any_table(spark):
    names = {"🇺🇸": "estados unidos", "🇸🇸": "sudán del sur", "🇸🇻": "el salvador", "🙂": "🥑", "🥑": "aguacate"}
    texts, want = ["🇺🇸🇸🇻", "🇸🇸🇻", "🙂🥑", None], ["estados unidosel salvador", "sudán del sur🇻", "🥑aguacate", None]
    for more in (0, 100):
        table = names | {chr(0x1F600 + i): f"n{i}" for i in range(more) if i != 66}
        assert run(spark, texts, lambda c: name_emoji(c, table)) == want


def test_long_emoji_table(spark):
    many = {chr(0x1F400 + i): f"n{i}" for i in range(100)} | NAMES
    pairs = GOLDEN + OURS
    many["🥑"], many["🙄"] = NAMES["🥑"], NAMES["🙄"]
    assert run(spark, [p[0] for p in pairs], lambda c: text.normalize(c, many)) == [p[1] for p in pairs]


def test_rough_class_finds_every_emoji():
    names = {"©": "c", "1️⃣": "uno", "🥑": "a", "‼": "b", "🇪🇸": "es", "⌚": "reloj"}
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m.group(1), 16)), _rough_class(names)))
    assert all(pattern.search(e) for e in names)
    assert _rough_class({":)": "smile", "🥑": "a"}) is None


ALPHABET = "aZRTé1_ñ@#. \t\u2003\u0085/:~'“http://"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30) | st.sampled_from(["RT @a_b: http://x.y/z?q#k", "@@é1 x"]), min_size=1, max_size=50))
def test_equals_its_steps(spark, values):
    assert run(spark, values, lambda c: text.normalize(c, NAMES)) == run(spark, values, step_by_step)


def test_mentions(spark):
    got = run(spark, ["@Ab, mail a@b.com (@x_1) @ab", None, "", "@@y"], text.mentions)
    assert got == [["ab", "x_1"], [], [], ["y"]]


def test_cap_tokens(spark):
    words = " ".join(str(i) for i in range(300))
    assert run(spark, [words, " a  b ", None], text.cap_tokens) == [
        " ".join(str(i) for i in range(256)),
        "a b",
        None,
    ]


def _flat(names):
    """The plain way: one alternation of all entries, longest first."""
    pattern = re.compile("|".join(re.escape(e) for e in sorted(names, key=lambda e: (-len(e), e))))
    return lambda t: pattern.sub(lambda m: names[m.group()], t)


LARGE = {views.large_emoji(i): f"e{i}" for i in range(views.LARGE_EMOJI)} | {":)": "smile", "1️⃣": "uno", "©": "c"}


def test_trie_equals_one_alternation():
    rng = random.Random(5)
    keys = list(LARGE)
    pieces = ["hola ", "x", "‍", "\U0001F3FB", "1", ":", "(", "é"]
    texts = ["".join(rng.choice(keys if rng.random() < 0.4 else pieces) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for names in (LARGE, dict(list(LARGE.items())[:4]), {"ab": "1", "abc": "2", "b": "3", "c": "4"}):
        plain, trie = _flat(names), substituter(names)
        assert [trie(t) for t in texts] == [plain(t) for t in texts]
    assert substituter({"ab": "1", "abc": "2", "b": "3"})("xabcabxabb") == "x21x13"


def test_trie_cost_hardly_grows_with_the_table():
    def cost(names):
        rng = random.Random(1)
        keys = list(names)
        texts = [("lorem ipsum dolor sit amet " * 4)[:90] + rng.choice(keys) + ("consectetur elit " * 6)[:90] + rng.choice(keys) for _ in range(5000)]
        run = substituter(names)
        best = float("inf")
        for _ in range(5):
            start = time.perf_counter()
            for t in texts:
                run(t)
            best = min(best, time.perf_counter() - start)
        return best

    assert cost(LARGE) <= 3 * cost(dict(list(LARGE.items())[-4:]))
