"""Checksums, entropy, language and label functions on fixed vectors."""

from pyspark.sql import functions as F

from veilframe.functions import (
    is_high_entropy, ledger_type, lenient_card, luhn_valid, platform_of, shannon_entropy,
    verhoeff_check_digit, verhoeff_valid, guess_language,
)
from veilframe.operators.redact import repair_ocr_digits


def answers(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_luhn(spark):
    good = ["4532015987412365", "5105105105105100", "378282246310005", "4532 0159-8741 2365"]
    bad = ["4532015987412364", "4532105987412365", "9876543210123456", "", "12", None]
    assert answers(spark, good + bad, luhn_valid) == [True] * 4 + [False] * 6
    assert answers(spark, ["4532015987412364", "12345678901234"], lenient_card) == [True, False]


def test_verhoeff(spark):
    assert answers(spark, ["28947513904"], verhoeff_check_digit) == [0]
    values = ["289475139040", "2894 7513 9040", "289485139040", "284975139040", "089475139040",
              "189475139040", None]
    assert answers(spark, values, verhoeff_valid) == [True, True] + [False] * 5


def test_every_single_digit_error_is_found(spark):
    base = "289475139040"
    changed = [base[:i] + str((int(base[i]) + k) % 10) + base[i + 1:]
               for i in range(12) for k in range(1, 10)]
    assert not any(answers(spark, changed, verhoeff_valid))


def test_entropy(spark):
    values = ["d3f0a7b1c4e9821a4f5b6c7d8e9f0123", "7a8b9c1d2e3f4a5b6c7d8e9f0",
              "internationalization", "enterpriseinfrastructure", "unauthorizedaccess",
              "AKIA" + "IOSFODNN7EXAMPLE", ""]
    assert answers(spark, values, lambda v: shannon_entropy(v, 3)) == [
        3.953, 3.924, 2.946, 3.236, 3.614, 3.684, 0.0]
    assert answers(spark, values, is_high_entropy) == [True, True] + [False] * 5


def test_language_and_names(spark):
    texts = ["server timeout zhala ahe", "connect karte waqt error", "plain text", "नमस्ते",
             "हे काम आहे", ""]
    assert answers(spark, texts, guess_language) == ["mr", "hi", "en", "hi", "mr", "en"]
    assert answers(spark, ["NER_PER", "card number", "api-key", "", None], ledger_type) == [
        "PERSON", "CREDIT_CARD", "API_KEY", "SECRET", "SECRET"]
    assert answers(spark, ["chatgpt.com", "claude.ai", "x.org"], platform_of) == [
        "ChatGPT", "Claude", "Custom AI"]


def test_ocr_repair(spark):
    assert answers(spark, ["no 4532 O159 874l 2365.", "4532 O159"], repair_ocr_digits) == [
        "no 4532 0159 8741 2365.", "4532 O159"]
