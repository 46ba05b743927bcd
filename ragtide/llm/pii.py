"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes and identifier cues (digits, digits
with a dot, plus signs, and words such as IBAN); local parsers then expand each anchor to its bounds and validate it.
An anchor inside what its kind's last match took is passed over, and every parser reads forward or back over a run a
fixed number of times, so the time is linear in the text.

Kinds, in order: email, ip, card, phone (their matches are those of the patterns in the module's tests, leftmost and
without overlap, failing ones dropped); then url (a scheme and a host), iban (its check digits hold) and account (a cue
such as "account no." before 6 to 17 digits). Spans are in code points, the end exclusive. A null text counts as empty
and gives no spans; rows may repeat; further columns are not touched.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"(?:[A-Za-z0-9._~%!$&'()*+,;=:-]++@)?([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)(?::[0-9]{1,5})?")
_PATH = re.compile(r"[/?#][^\s<>\"'{}|\\^`]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[\x20]?(?:no\.?|number|nr\.?|#))?[\x20]?[:#=]?[\x20]?([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I)

_LUHN = str.maketrans("", "", " -")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

_CUES = [w for c in ("iban", "account", "acct", "konto", "compte", "cuenta") for w in (c, c.upper(), c.capitalize())]
_SCHEMES = [w for s in ("http://", "https://", "ftp://") for w in (s, s.upper(), s.capitalize())]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("card", 1))
        a.add_word(d + ".", ("ip", 2))
    for w in _SCHEMES:
        a.add_word(w, ("url", len(w)))
    for w in _CUES:
        a.add_word(w, ("iban" if w.lower() == "iban" else "account", len(w)))
    a.make_automaton()
    return a


_anchors = None


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _iban_holds(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    global _anchors
    _anchors = _anchors or _automaton()
    found = []
    mail_end = ip_end = card_end = phone_end = url_end = 0
    for last, (kind, size) in _anchors.iter(text):
        if kind == "card":
            if last >= card_end:
                if not (m := _CARD.match(text, last)):
                    card_end = last + 1
                    continue
                card_end = m.end()
                if card_end - last >= 14:
                    digits = m[0].translate(_LUHN)
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, 2, card_end))
        elif kind == "ip":
            # The first part runs back over its digits.
            start = last - 1
            if start >= ip_end:
                while start > ip_end and text[start - 1] in _DIGITS:
                    start -= 1
                if m := _IP.match(text, start):
                    ip_end = m.end()
                    if all(map(_small, m[0].split("."))):
                        found.append((start, 1, ip_end))
        elif kind == "@":
            # A local part runs back to the last character that can't be in it, or to the previous address.
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                found.append((start, 0, m.end()))
                mail_end = m.end()
        elif kind == "phone":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found.append((last, 3, phone_end))
        elif kind == "url":
            # The path is read only after a host that holds.
            if last + 1 > url_end and (m := _HOST.match(text, last + 1)) and ("." in m[1] or m[1].lower() == "localhost"):
                url_end = m.end()
                if m := _PATH.match(text, url_end):
                    url_end = m.end()
                while text[url_end - 1] in ".,;:!?)'":
                    url_end -= 1
                found.append((last + 1 - size, 4, url_end))
        elif kind == "iban":
            at = last + 1
            while at < len(text) and at < last + 4 and text[at] in " :=":
                at += 1
            if (m := _IBAN.match(text, at)) and _iban_holds(m[0]):
                found.append((at, 5, m.end()))
        elif m := _ACCOUNT.match(text, last + 1):
            found.append((m.start(1), 6, m.end(1)))
    return sorted(set(found))


_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end>> for each row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t or "")] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["id", "spans"])

    of = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {of}, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str | None) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    text, out, at = text or "", [], 0
    for s, k, e in spans(text):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])


def digest(found: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < len(BASE)).encode()).hexdigest()
