"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, schemes, cues of identifiers (``iban``, ``ssn``,
``passport`` and the like), a plus before a digit, and digits that begin a number. At every anchor a
deterministic parser of the kind expands to the left and right as far as the grammar of the kind
reaches, and validates what it found:

* ``email`` – local part of up to 64 and domain of up to 253 characters (the standard's bounds) with
  dots, labels and a top-level label of letters; Latin, Greek and Cyrillic letters of any kind,
* ``url_login`` – an address whose scheme is followed by a name and a password of any length,
* ``ip`` – four numbers up to 255, not part of a longer dotted number (version or the like),
* ``phone`` – ``+`` and 8 to 15 digits in groups, or ``(ddd) ddd-dddd``, ``ddd-ddd-dddd``,
* ``card`` – 13 to 19 digits, in groups of 4 or together, that no letter or digit adjoins and that
  begin as cards do; a failed check digit is reported as ``valid`` false,
* ``iban`` – country, check digits and 11 to 30 characters, with remainder 1 by 97: after any cue, or
  without one where the length is that of the country,
* ``ssn`` – ``ddd-dd-dddd`` out of the ranges never issued,
* ``account`` – 5 or more letters and digits, after a cue and a separator, with one digit at least;
  with five where the separator is a blank alone; what has the length of its country's IBAN has to
  be one.

Where spans of several kinds overlap, the longest stays (of equal ones the first of the list).

Defined results: null and empty texts have no rows; repeated rows are searched each for itself; a
row with a null id is reported with a null id; an empty table gives no rows; other columns are not
read. Places count characters.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.tables import batched, table

KINDS = ("email", "url_login", "ip", "phone", "card", "iban", "ssn", "account")
CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "tax id", "taxid", "driver license", "licence no", "license no", "customer id", "member id", "patient id", "konto", "kontonummer", "cuenta", "compte", "dni", "nif", "steuer-id")
SCHEMES = ("http://", "https://", "ftp://", "postgres://", "postgresql://", "mysql://", "redis://", "amqp://", "mongodb://", "ssh://", "sftp://")
#: Digits that an identifier needs where only a blank separates it from its cue.
BARE_DIGITS = 5
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_EDGE = ".!#$%&'*/=?^`{|}~-"
#: Beyond ASCII letters of addresses end here; scripts that are written without blanks come later.
_LETTERS = "\u0530"
#: Lengths of IBANs by country, of the public registry.
_IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+;=-]+:[^\s/@:\"'<>]+@[A-Za-z0-9.-]{1,253}(?::\d{1,5})?")
_PHONE = re.compile(r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)|[ .\-]?\d{1,4})(?:[ .\-]?\d{2,4}){1,5}(?!\d)")
_NANP = re.compile(r"\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)")
_LOCAL_PHONE = re.compile(r"(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\d\-])")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d|\.\d)")
_CARD = re.compile(r"\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}(?!\d)|3[47]\d{2}[ -]\d{6}[ -]\d{5}(?!\d)")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6(?:011|5|4[4-9]|2)|35")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")
_LEAD = r"(?i:(?: ?(?:number|nummer|no\.?|nr\.?|id|#))?(?:(?P<sign>[ ]?(?:[:#=]|is|ist|es)[ ]?)|[ ]))"
_BEFORE = re.compile(_LEAD)
_ACCOUNT = re.compile(_LEAD + r"(?P<code>[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){3,}[A-Za-z0-9])(?![A-Za-z0-9])")


@lru_cache(maxsize=1)
def _automaton():
    found: dict[str, list[str]] = {"@": ["email"], "+": ["phone"], "(": ["phone_local"]}
    for d in "0123456789":
        found[d] = ["number"]
    for s in SCHEMES:
        found.setdefault(s, []).append("login")
    for c in CUES:
        found.setdefault(c, []).append("cue")
    automaton = ahocorasick.Automaton()
    for anchor, kinds in found.items():
        automaton.add_word(anchor, (len(anchor), kinds[0]))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int) -> tuple[int, int] | None:
    begin, end = at, at + 1
    letter = lambda c: "\x7f" < c < _LETTERS and c.isalpha()
    while begin > 0 and at - begin < 64 and (text[begin - 1] in _LOCAL or letter(text[begin - 1])):
        begin -= 1
    if begin > 0 and at - begin == 64 and (text[begin - 1] in _LOCAL or letter(text[begin - 1])):
        return None
    while begin < at and text[begin] in _EDGE:
        begin += 1
    while end < len(text) and end - at <= 253 and (text[end] in _HOST or letter(text[end])):
        end += 1
    while end > at + 1 and text[end - 1] in ".-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    local = text[begin:at]
    if not local or local[-1] == "." or ".." in local or len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2:
        return None
    return (begin, end) if all(0 < len(x) < 64 and x[0] != "-" and x[-1] != "-" for x in labels) else None


def _phone(text: str, at: int) -> int | None:
    """Where the number that begins with a plus ends; groups beyond 15 digits belong to something else."""
    if at and text[at - 1].isalnum():
        return None
    if m := _NANP.match(text, at):
        return m.end()
    end = m.end() if (m := _PHONE.match(text, at)) else at
    while (n := sum(c.isdigit() for c in text[at:end])) > 15:
        end = max(text.rfind(c, at, end) for c in " .-")
    return end if n >= 8 else None


def _iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban_of_country(text: str, begin: int) -> int | None:
    """Where the IBAN that begins here ends, if its length is its country's and its check digits hold."""
    size = _IBAN_SIZES.get(text[begin : begin + 2])
    if not size or begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-."):
        return None
    end, n = begin, 0
    while n < size and end < len(text) and (text[end].isascii() and (text[end].isdigit() or text[end].isupper()) or text[end] == " " and n and n % 4 == 0 and text[end - 1] != " "):
        n += text[end] != " "
        end += 1
    if n < size or text[end : end + 1].isalnum() or not _iban(text[begin:end]):
        return None
    return end


def _alone(text: str, begin: int) -> bool:
    return begin == 0 or not (text[begin - 1].isalnum() or text[begin - 1] in "_-." and begin > 1 and text[begin - 2].isalnum())


def _number(text: str, at: int) -> Iterator[tuple[str, int, int, bool]]:
    """What a number that begins at a digit may be."""
    if at > 1 and text[at - 1].isupper() and (end := _iban_of_country(text, at - 2)):
        yield "iban", at - 2, end, True
    if not _alone(text, at):
        return
    if m := _IP.match(text, at):
        if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m.groups()):
            yield "ip", at, m.end(), True
    if m := _SSN.match(text, at):
        yield "ssn", at, m.end(), True
    if m := _LOCAL_PHONE.match(text, at):
        yield "phone", at, m.end(), True
    if (m := _CARD.match(text, at)) and _ISSUERS.match(text, at) and not text[m.end() : m.end() + 1].isalnum():
        digits = re.sub(r"\D", "", m[0])
        if 13 <= len(digits) <= 19:
            yield "card", at, m.end(), luhn(digits)


def _cue(text: str, lower: str, begin: int, end: int) -> Iterator[tuple[str, int, int, bool]]:
    if begin and lower[begin - 1].isalnum():
        return
    tail = end
    while tail < len(text) and text[tail] in " :#=.":
        tail += 1
    lead = _BEFORE.match(text, end)
    for at in {tail, lead.end() if lead else tail}:
        if m := _IBAN.match(text, at):
            last = m.end()
            while last > at + 14:  # groups that follow may be words; the longest valid code counts
                if _iban(text[at:last]):
                    yield "iban", at, last, True
                    return
                last = max(text.rfind(" ", at, last), at)
    if (m := _ACCOUNT.match(text, end)) and sum(c.isdigit() for c in m["code"]) >= (1 if m["sign"] else BARE_DIGITS) and len(m["code"].replace("-", "")) >= 5 and _IBAN_SIZES.get(m["code"][:2]) != len(m["code"]):
        yield "account", m.start("code"), m.end("code"), True


def found(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, begin, end, valid) of a text, in order and without overlaps."""
    lower = text.lower()
    if len(lower) != len(text):  # letters whose small form is longer would shift the places
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans: list[tuple[str, int, int, bool]] = []
    skip = -1
    for last, (n, kind) in _automaton().iter(lower):
        begin = last + 1 - n
        if kind == "number":
            if begin <= skip:
                continue  # the number goes on
            end = begin
            while end + 1 < len(text) and text[end + 1] in "0123456789":
                end += 1
            skip = end
            spans += _number(text, begin)
        elif kind == "email":
            if span := _email(text, begin):
                spans.append(("email", *span, True))
        elif kind == "phone":
            if end := _phone(text, begin):
                spans.append(("phone", begin, end, True))
        elif kind == "phone_local":
            if m := _LOCAL_PHONE.match(text, begin):
                spans.append(("phone", begin, m.end(), True))
        elif kind == "login":
            if m := _LOGIN.match(text, last + 1):
                spans.append(("url_login", begin, m.end(), True))
        else:
            spans += _cue(text, lower, begin, last + 1)
    return _apart(spans)


def _apart(spans: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, bool]]:
    """The longest spans that don't overlap, in order of place."""
    begins: list[int] = []
    taken: list[tuple[str, int, int, bool]] = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], KINDS.index(s[0]), s[1])):
        k = bisect.bisect_left(begins, s[1])
        if (not k or taken[k - 1][2] <= s[1]) and (k == len(taken) or s[2] <= taken[k][1]):
            begins.insert(k, s[1])
            taken.insert(k, s)
    return taken


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, begin, end, value, valid) of all personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *span, x[span[1] : span[2]]) for k, x in enumerate(batch.column(1).to_pylist()) if x for span in found(x)]
            if rows:
                at, kind, begin, end, valid, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(value), pa.array(valid)], ["doc_id", "kind", "begin", "end", "value", "valid"])

    rows = batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, kind string, begin int, end int, value string, valid boolean")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}
