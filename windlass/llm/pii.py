"""Personal data: fixed formats, further candidates from high-recall generators, and boosted trees that select them.

The base spans (fixed formats, checked by range, Luhn or digit count) always stay. Generators propose overlapping spans
of looser formats and of further kinds (credentials, opaque tokens, bank account and national numbers), also across base
spans (only those within one are left out); boosted trees score each by format and context, a threshold per kind,
calibrated to a precision on held-out rows, admits them, and the best of overlapping admitted spans remains, beside any
base span. The trees are fitted on TRAIN_ROWS synthetic labelled candidates (a seeded, documented bound), so they don't
depend on the corpus; report() has their precision and recall on rows that neither fitting nor calibration saw.

Defined results: a null or empty text has no spans; repeated rows are treated alike; spans are in code points, end
exclusive; columns other than the text are carried along; a table with a column named like a result gets it replaced.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .boost import Boosted, threshold
from .common import load, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "national_id")
TRAIN_ROWS, PRECISION = 9000, 0.98
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A digit run is entered at its first digit only: starts inside it would fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# What follows the local part of an obfuscated address; the local part itself is read backwards from here.
_AT_DOT = re.compile(r"(?: ?[(\[{] ?at ?[)\]}] ?| at )[A-Za-z0-9-]{1,64}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,64})+", re.I)
_AT = ("(at", "[at", "{at", "( at", "[ at", "{ at", " at ")  # one of these is in every match, whatever its case
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{2,6}){2,4}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z])(?:api|secret|token|passw(?:or)?d|passphrase|pwd|credentials?|auth|bearer|access|private|client|session)(?:[ _-]?(?:key|id|token|secret|code))?[\"']?(?:\s{0,3}(?:[:=]|=>|:=|is)\s{0,3}|\s{1,3})[\"'<]?([A-Za-z0-9+/_.=!@#$%^&*~-]{6,400})", re.I)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,400}={0,2}(?![A-Za-z0-9+/_=-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9.-])")
_SAYS_SECRET = ("api", "secret", "token", "passw", "passphrase", "pwd", "credential", "auth", "bearer", "access", "private", "client", "session")
_HINTS = {  # fixed values: context words of each kind
    "email": ("mail", "contact", "write", "address", "reach"),
    "ip": ("ip", "host", "server", "addr", "login", "client"),
    "card": ("card", "visa", "amex", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"),
    "secret": _SAYS_SECRET,
    "account": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "national_id": ("ssn", "social", "security", "national", "tax", "insurance", "passport", "id"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(s: str) -> bool:
    """Whether an account number has its check digits."""
    s = s.replace(" ", "")
    return len(s) > 4 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start, nxt = at, at + 1
        while start > done and start > 0 and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = nxt = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", nxt)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _obfuscated(text: str):
    done = at = 0
    while m := _AT_DOT.search(text, at):
        start = m.start()
        while start > done and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall, overlapping; each generator looks only where its rarest part occurs."""
    out = []
    lower = text.lower()
    if any(x in lower for x in _AT):
        out += [("email", s, e) for s, e in _obfuscated(text)]
    if text.count(":") >= 2:
        out += [("ip", m.start(), m.end()) for m in _IP6.finditer(text)]
    if _DIGIT.search(text):
        out += [("card", m.start(), m.end()) for m in _LOOSE_CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19]
        out += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
        out += [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
        out += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
        out += [("secret", m.start(), m.end()) for m in _OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    if any(x in lower for x in _SAYS_SECRET):
        out += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    return sorted(set(out))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    before, after = text[max(0, start - 32):start].lower(), text[end:end + 16].lower()
    seps = [c for c in s if not c.isalnum()]
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), float(bool(digits) and luhn(digits)), float(len(set(seps))), len(seps), len(groups), max(groups, default=0), min(groups, default=0),
        len(set(digits)), float(digits[:1] in ("3", "4", "5", "6")), *(float(any(h in before for h in _HINTS[k])) for k in KINDS), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float("(" in s or "[" in s or "{" in s), float(" dot " in s.lower()), float(" at " in s.lower()), float(before.rstrip()[-1:] in ("+", "=", "#", "$", "/")),
        len(digits) / len(s), len(set(s)) / len(s), float(all(c in "0123456789abcdefABCDEF" for c in s)), sum(c.isupper() for c in s) / len(s), sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) / len(s),
        float(kind == "account" and mod97(s)), float(before.rstrip(" \"'<")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'", "<")), float(s[:3] in ("000", "666") or s[:1] == "9"),
    ]


def _synthetic(rng: random.Random) -> tuple[str, str, int, int, int]:
    """A labelled candidate in an invented context: (text, kind, start, end, label)."""
    word = lambda: "".join(rng.choice("aeiounrstlhdmz") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, good = rng.choice(KINDS), rng.random() < 0.5
    sep = rng.choice([" ", "-", "."])
    if kind == "email":
        if good:
            a, d = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", "."), ("[at]", "."), (" {at} ", "."), ("{at}", "{dot}"), (" [ at ] ", "."), (" ( at ) ", " ( dot ) ")])
            s = f"{word()}{rng.choice(['', num(2), '.' + word()])}{a}{word()}{d}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
        else:
            s = rng.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{num(2)}", f"{word()} at {word()}.{word()}.{word()}"])
    elif kind == "ip":
        s = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if good else rng.choice([f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}", f"{rng.randint(1, 9)}:{num(2)}:{num(3)}"])
    elif kind == "card":
        n = rng.choice([13, 15, 16, 16])
        body = rng.choice("3456") + num(n - 2)
        check = next(c for c in "0123456789" if luhn(body + c))
        digits = body + (check if good else rng.choice([c for c in "0123456789" if c != check]))
        cut = [4, 6, 5] if n == 15 else [4, 4, 4, 4]
        s, at = [], 0
        for c in cut:
            s.append(digits[at:at + c])
            at += c
        s = rng.choice(["", " ", "-", ".", "/"]).join(x for x in s if x) if good or rng.random() < 0.5 else rng.choice([digits, num(n)])
    elif kind == "secret":
        draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
        hexes, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        if good:
            s = rng.choice([draw(hexes, rng.choice([24, 32, 40, 64])), draw(hexes, 40).upper(), draw(letters + "+/_-", rng.randint(20, 60)), draw(letters + "!@#$%", rng.randint(8, 16)), rng.choice(["sk-", "key-", "gh_"]) + draw(letters, 24)])
        else:
            s = rng.choice([word(), word() + word(), word() + "-" + word() + "-" + word() + num(1), "/".join(word() for _ in range(4)) + num(2), word() + num(1), draw("=-_", 24) + num(1), "http://" + word() + "/" + word() + num(3), "".join(word() for _ in range(4)) + num(1)])
    elif kind == "account":
        body, land = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 18, 20]))), rng.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = land + (f"{check:02d}" if good else rng.choice([f"{(check + rng.randint(1, 60)) % 100:02d}", num(2)])) + body
        s = " ".join(s[i:i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s
    elif kind == "national_id":
        s = f"{rng.randint(1, 665) if good else rng.choice([0, 666, rng.randint(900, 999), rng.randint(1, 899)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    else:
        s = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"00{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}"]) if good else rng.choice([f"{num(4)}-{num(3)}-{num(3)}", f"{num(2)}/{num(3)}/{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)} {num(4)} {num(4)}"])
    hint = rng.choice(_HINTS[kind]) + rng.choice([" ", ": ", " = ", "=\"", " = \""] if kind == "secret" else [" ", ": "]) if rng.random() < (0.5 if kind == "secret" else 0.8 if good else 0.1) else ""
    glued = rng.choice(["=", "#", "/", num(3) + " "]) if not good and rng.random() < 0.4 else ""
    before = " ".join(word() for _ in range(rng.randint(0, 4))) + " " + hint + glued
    return before + s + " " + word(), kind, len(before), len(before) + len(s), int(good)


@functools.cache
def _fitted(rows: int, precision: float, seed: int):
    """Trees fitted on half of the rows, thresholds calibrated on a quarter; precision and recall of each kind on the rest."""
    rng = random.Random(seed)
    made = [_synthetic(rng) for _ in range(rows)]
    x, y = np.array([features(t, k, s, e) for t, k, s, e, _ in made]), np.array([r[-1] for r in made], float)
    kinds, cut, last = np.array([r[1] for r in made]), rows // 2, 3 * rows // 4
    trees = Boosted().fit(x[:cut], y[:cut])
    p = trees.predict(x)
    part = lambda k, lo, hi: np.flatnonzero(kinds[lo:hi] == k) + lo
    limits = {k: threshold(p[part(k, cut, last)], y[part(k, cut, last)], precision) for k in KINDS}
    found = {}
    for k in KINDS:
        i = part(k, last, rows)
        hit = p[i] >= limits[k]
        found[k] = float(y[i][hit].mean()) if hit.any() else 0.0, float(hit[y[i] > 0].mean())
    return trees, limits, found


def model(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = 7) -> tuple[Boosted, dict[str, float]]:
    return _fitted(rows, precision, seed)[:2]


def report(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = 7) -> dict[str, tuple[float, float]]:
    """kind -> (precision, recall) on held-out candidates."""
    return _fitted(rows, precision, seed)[2]


def spans(text: str | None, trees: Boosted, limits: dict[str, float]) -> list[dict]:
    text = text or ""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    free = []
    if cands := candidates(text):
        starts = np.array([s for s, _ in taken] or [len(text) + 1])
        reach = np.maximum.accumulate([e for _, e in taken] or [0])
        for c in cands:  # those within a base span add nothing
            i = int(np.searchsorted(starts, c[1], "right")) - 1
            if i < 0 or reach[i] < c[2]:
                free.append(c)
    if free:
        scored = zip(trees.predict(np.array([features(text, *c) for c in free])).tolist(), free)
        kept: list[tuple[int, int]] = []
        for score, (k, s, e) in sorted(scored, key=lambda x: (-x[0], x[1][1], x[1])):
            if score >= limits[k] and all(e <= a or s >= b for a, b in kept):
                kept.append((s, e))
                out.append({"kind": k, "start": s, "end": e, "base": False, "score": score})
    return sorted(out, key=lambda x: (KINDS.index(x["kind"]), x["start"]))


def redacted(text: str | None, found: list[dict]) -> str | None:
    """Text with [KIND] for each maximal run of overlapping spans, named by the first of them."""
    if text is None or not found:
        return text
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            out += [text[at:x["start"]], f"[{x['kind'].upper()}]"]
        at = max(at, x["end"])
    return "".join(out) + text[at:]


def _mapper(trees, limits, text_col: str, redact: bool, schema: pa.Schema):
    def run(batches):
        for piece in slices(batches, rows=256, chars=1 << 20, column=text_col):
            cols = {n: piece.column(i) for i, n in enumerate(piece.schema.names)}
            texts = cols[text_col].to_pylist()
            found = [spans(t, trees, limits) for t in texts]
            if redact:
                cols[text_col] = pa.array([redacted(t, f) for t, f in zip(texts, found)], schema.field(text_col).type)
            cols["pii_spans"] = pa.array(found, schema.field("pii_spans").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in schema.names], names=schema.names)

    return run


def find(docs: DataFrame, *, text_col: str = "text", redact: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with pii_spans; with redact the text has its spans replaced by [KIND]."""
    out = docs.withColumn("pii_spans", F.array().cast(SPANS))
    schema = (out if keep_text else out.drop(text_col)).schema
    return out.mapInArrow(_mapper(*model(), text_col, redact and keep_text, to_arrow_schema(schema)), schema)


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("pii_spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    added = F.size(F.filter("pii_spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"), added)


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans straight from the stated patterns, for tests."""
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out
