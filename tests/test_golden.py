"""Golden cases: encode, decode, lenient decode, fix and validate give the expected results."""

import json
from pathlib import Path

import pytest

from leafwork.functions import decoding, encoding

CASES = json.loads((Path(__file__).parent / "fixtures" / "golden.json").read_text())


def ids(kind):
    return [c["name"] for c in CASES[kind]]


def kinds(result):
    return sorted(k for k, _ in result.repairs)


@pytest.mark.parametrize("case", CASES["encode"], ids=ids("encode"))
def test_encode(case):
    assert encoding.encode_value(case["input"], **(case.get("opts") or {})) == case["expected"]


@pytest.mark.parametrize("case", CASES["decode"], ids=ids("decode"))
def test_decode(case):
    found = decoding.decode_text(case["input"], case.get("schema"))
    if case.get("error"):
        assert found.error is not None
    else:
        assert found.error is None
        assert found.value == case["expected"]
        assert kinds(found) == sorted(case["repairs"])


@pytest.mark.parametrize("case", CASES["lenient"], ids=ids("lenient"))
def test_lenient(case):
    found = decoding.decode_lenient_text(case["input"], case.get("schema"))
    assert found.value == case["expected"]
    assert found.truncated == case["truncated"]
    assert len(found.errors) == case["errorCount"]
    assert kinds(found) == sorted(case["repairs"])


@pytest.mark.parametrize("case", CASES["fix"], ids=ids("fix"))
def test_fix(case):
    found = decoding.decode_text(case["input"], case.get("schema"))
    assert found.canonical == case["expected"]
    assert kinds(found) == sorted(case["repairs"])


@pytest.mark.parametrize("case", CASES["validate"], ids=ids("validate"))
def test_validate(case):
    assert (not decoding.validate_text(case["input"], case.get("schema"))) == case["valid"]
