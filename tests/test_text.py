from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from joulecorpus.functions import casting, text, tokens
from joulecorpus.operators.tokens import tokenize_pad


def apply(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    found = rows.select("i", build(F.col("s")).alias("out")).collect()
    return [row["out"] for row in sorted(found, key=lambda row: row["i"])]


def expected_clean(value, lower=False, punctuation=False):
    """The cleaning rules, stated directly."""
    if value is None:
        return ""
    for debris, meaning in (*text.ESCAPED_SPACES, *text.MISDECODED_QUOTES):
        value = value.replace(debris, meaning)
    value = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()
    if lower:
        value = value.lower()
    if punctuation:
        value = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", value)).strip()
    return value


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Texto    com    espaços   extras", "Texto com espaços extras"),
        ("Texto_x000D_com_x000A_artefatos_x0009_aqui", "Texto com artefatos aqui"),
        ("  a b c\x1fd\u0085 ", "a b c d"),
        ("itâ€™s â€œquotedâ€\u009d â€\" end", "it's \"quoted\" — end"),
        ("ﬁne ½ ＡＢＣ", "fine 1⁄2 ABC"),
        ("a ¨ b¨", "a ̈ b ̈"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_examples(spark, raw, clean):
    assert apply(spark, [raw], text.clean_text) == [clean]


def test_clean_random_strings(spark):
    random.seed(3)
    alphabet = "ab Z_é\t\n\r  ́¨ﬁ９½ß。!—’" + "\x1c 　"
    pieces = [*alphabet, "_x000D_", "_x000A_", "_x0009_", "â€™", "â€œ", "â€\u009d", 'â€"', "  ", "{summary}"]
    values = ["".join(random.choices(pieces, k=random.randint(0, 40))) for _ in range(3000)]
    assert apply(spark, values, text.clean_text) == [expected_clean(v) for v in values]
    full = apply(spark, values, lambda c: text.clean_text(c, lower=True, punctuation=True))
    assert full == [expected_clean(v, True, True) for v in values]


def test_cleaning_is_idempotent(spark):
    values = ["a_x000D_\n b", " ¨x  y ", "ﬁ  ﬂ"]
    once = apply(spark, values, text.clean_text)
    assert apply(spark, once, text.clean_text) == once


def test_newlines_without_collapse(spark):
    def keep_lines(c):
        return text.clean_text(c, whitespace=False)

    values = ["a\n \t\n\nb\r\nc\rd", "x_x000D_\n_x000D_\ny"]
    expected = []
    for value in values:
        value = value.replace("_x000D_", "\n")
        value = re.sub(r"\n\s*\n", "\n\n", value)
        expected.append(value.replace("\r\n", "\n").replace("\r", "\n"))
    assert apply(spark, values, keep_lines) == expected


def test_white_space_and_nfkc_on_all_code_points(spark):
    points = [i for i in range(1, 0x30000) if not 0xD800 <= i <= 0xDFFF]
    values = [f"a{chr(i)}b" for i in points]
    assert apply(spark, values, text.collapse_ws) == [re.sub(r"\s+", " ", v).strip() for v in values]
    normal = apply(spark, values, text.nfkc)
    known = [k for k, i in enumerate(points) if unicodedata.category(chr(i)) != "Cn"]
    wrong = [points[k] for k in known if normal[k] != unicodedata.normalize("NFKC", values[k])]
    assert wrong == []


def test_word_class_misses_only_letters_newer_than_the_jvm(spark):
    points = [i for i in range(1, 0x3000) if not 0xD800 <= i <= 0xDFFF]
    values = [f"a{chr(i)}b" for i in points]
    found = apply(spark, values, text.strip_punct)
    expected = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", v)).strip() for v in values]
    wrong = [points[k] for k in range(len(points)) if found[k] != expected[k]]
    # Letters assigned after the Unicode version of Java 17, e.g. Arabic Extended-B.
    assert all(chr(i).isalnum() and i > 0x85F for i in wrong)


def test_template_is_not_filled_twice(spark):
    def fill(c):
        return text.fill_template("{{x}} {text} | {summary}", text=c, summary=F.lit("S"))

    assert apply(spark, ["has {summary} inside"], fill) == ["{x} has {summary} inside | S"]


def test_prompt(spark):
    values = ["[INST] q [/INST] a", "[INST] only", None]
    assert apply(spark, values, text.prompt_text) == [
        "[INST] q [/INST] a",
        "Summarize:\n[INST] only\nSummary:",
        "Summarize:\n\nSummary:",
    ]


def test_safe_cast(spark):
    values = ["1.5", "100", "invalid", None, " 12 ", "1e3", "1_0", "1d", "inf", "-7", "1__0", ""]
    ints = apply(spark, values, lambda c: casting.safe_cast(c, "bigint", 0))
    floats = apply(spark, values, lambda c: casting.safe_cast(c, "double", -1.0))

    def cast(kind, value, default):
        try:
            return kind(value)
        except (ValueError, TypeError):
            return default

    assert ints == [cast(int, v, 0) for v in values]
    assert floats == [cast(float, v, -1.0) for v in values]


def test_tokenize_pad_truncates_and_masks(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, " ".join("w" * 1 for _ in range(9)))], "i int, s string")
    out = tokenize_pad(rows, F.col("s"), ["i"], length=5).orderBy("i").collect()
    assert [row["attention_mask"] for row in out] == [[1, 1, 1, 0, 0], [1] * 5]
    assert out[0]["input_ids"][3:] == [0, 0] and len(set(out[1]["input_ids"])) == 1


def test_pluggable_encoder(spark):
    def factory():
        return lambda value: [ord(ch) for ch in value]

    rows = spark.createDataFrame([("ab",), (None,)], "s string")
    encode, count = tokens.encoder_udf(factory), tokens.count_udf(factory)
    out = tokenize_pad(rows, F.col("s"), encoder=encode, length=3).collect()
    assert [row["input_ids"] for row in out] == [[97, 98, 0], [0, 0, 0]]
    counts = rows.select(tokens.token_count(F.col("s"), count).alias("n")).collect()
    assert [row["n"] for row in counts] == [2, 0]
