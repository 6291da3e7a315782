"""The forms in which account numbers, passports and secrets are usually written."""

import pytest

from faultline.llm import pii

FOUND = [
    ("IBAN: DE89 3704 0044 0532 0130 00 and more", "DE89 3704 0044 0532 0130 00"),
    ("my Iban DE89370400440532013000.", "DE89370400440532013000"),
    ("iban GB82 WEST 1234 5698 7654 32 then 1234", "GB82 WEST 1234 5698 7654 32"),
    ("account number: 1234 5678 9012, thanks", "1234 5678 9012"),
    ("Account No. 1234-5678-9012", "1234-5678-9012"),
    ("Konto 12345678", "12345678"),
    ("account: FR76 3000 6000 0112 3456 7890 189", "FR76 3000 6000 0112 3456 7890 189"),
    ("Passport C01X00T47 is lost", "C01X00T47"),
    ("passport number 12 345 6789", "12 345 6789"),
    ("SSN 123 45 6789", "123 45 6789"),
    ("ssn: 123-45-6789", "123-45-6789"),
    ("password: correcthorse", "correcthorse"),
    ("PassWord = 'correct horse battery'", "correct horse battery"),
    ('{"password":"hunter2!x"}', "hunter2!x"),
    ("API key: sk_live_abcdef", "sk_live_abcdef"),
    ("API Key=abcdef123456;", "abcdef123456"),
    ('token = "04dbebab91ab8568"', "04dbebab91ab8568"),
    ("İİ API-KEY: abcdef123456", "abcdef123456"),
    ("IBAN: XX1234567", "XX1234567"),
]
NOTHING = [
    "iban DE89 3704 0044 0532 0130 01",
    "passport control hall",
    "on account of 123456 reasons",
    "account 2023 2024",
    "the password is unknown",
    "password: abc",
    "multiaccount 12345678",
]


@pytest.mark.parametrize("text,value", FOUND)
def test_account_values(text, value):
    spans = [text[s:e] for s, k, e in pii.spans_of(text, pii.anchors()) if pii.KINDS[k] == "account"]
    assert spans == [value]


@pytest.mark.parametrize("text", NOTHING)
def test_no_account_value(text):
    assert not [s for s in pii.spans_of(text, pii.anchors()) if pii.KINDS[s[1]] == "account"]


def test_redaction_of_grouped_values(spark):
    df = spark.createDataFrame([(1, "IBAN: DE89 3704 0044 0532 0130 00, API Key: abcdefgh")], "doc_id long, text string")
    assert pii.redacted(df).first().text == "IBAN: [account], API Key: [account]"
